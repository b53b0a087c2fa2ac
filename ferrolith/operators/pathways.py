"""Bounded searches over step graphs: non-dominated paths by summed cost and barrier, step by step as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrolith.operators.ordered import cut


def paths(edges: DataFrame, starts: DataFrame, goals: DataFrame, most_steps: int = 4) -> DataFrame:
    """(entity, path, delta_g, activation, steps): the non-dominated simple paths from a start to a goal.

    edges: (entity, src, dst, delta_g, activation); starts and goals: (entity, node). Each round joins
    the frontier to the edges. A path is dropped only where another path to its node, of no more steps,
    is nowhere worse in activation and delta_g and somewhere better, and visits none but the path's own
    nodes, so that it can go on wherever the path can; of equal costs all stay. What reaches a goal is
    then pruned by the costs alone.
    """
    frontier = starts.select("entity", F.col("node").alias("at"), F.array("node").alias("path"), F.lit(0.0).alias("delta_g"), F.lit(0.0).alias("activation"))
    found = None
    for _ in range(most_steps):
        step = frontier.join(edges.withColumnsRenamed({"delta_g": "dg", "activation": "ea"}), (frontier["entity"] == edges["entity"]) & (F.col("at") == F.col("src"))).where(~F.array_contains("path", F.col("dst")))
        step = step.select(frontier["entity"], F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"), (F.col("delta_g") + F.col("dg")).alias("delta_g"), (F.col("activation") + F.col("ea")).alias("activation"))
        step = cut(step)
        frontier = cut(_undominated(step, within=True))
        done = frontier.join(goals.select("entity", F.col("node").alias("at")), ["entity", "at"], "left_semi")
        found = done if found is None else found.unionByName(done)
    return _undominated(found, within=False).select("entity", "path", "delta_g", "activation", (F.size("path") - 1).alias("steps"))


def _undominated(labels: DataFrame, within: bool) -> DataFrame:
    """The labels that no other of their entity and node dominates in activation, delta_g and steps; ``within``: none that visits their own nodes alone."""
    other = labels.select(F.col("entity").alias("__e"), F.col("at").alias("__at"), F.col("path").alias("__p"), F.col("delta_g").alias("__dg"), F.col("activation").alias("__ea"))
    steps, its = F.size("path"), F.size("__p")
    worse = (F.col("entity") == F.col("__e")) & (F.col("at") == F.col("__at")) & (F.col("__ea") <= F.col("activation")) & (F.col("__dg") <= F.col("delta_g")) & (its <= steps)
    worse = worse & ((F.col("__ea") < F.col("activation")) | (F.col("__dg") < F.col("delta_g")) | (its < steps))
    if within:
        worse = worse & (F.size(F.array_except("__p", "path")) == 0)
    return labels.join(other, worse, "left_anti")


def feasible(found: DataFrame, most_activation: float = 3.0, most_delta_g: float = 1.0, most_steps: int = 4) -> DataFrame:
    return found.where((F.col("activation") <= most_activation) & (F.col("delta_g") <= most_delta_g) & (F.col("steps") <= most_steps))


def best_path(found: DataFrame, weights: tuple = (0.5, 0.4, 0.1), rho: float = 0.05) -> DataFrame:
    """Each entity's path of the least augmented Tchebycheff distance from the best of each cost."""
    costs = ["activation", "delta_g", "steps"]
    w = Window.partitionBy("entity")
    gaps = [wt * F.coalesce(F.try_divide(F.col(c) - F.min(c).over(w), F.max(c).over(w) - F.min(c).over(w)), F.lit(0.0)) for c, wt in zip(costs, weights, strict=True)]
    scored = found.withColumn("score", F.greatest(*gaps) + rho * sum(gaps[1:], gaps[0]))
    return scored.groupBy("entity").agg(F.min_by(F.struct("path", "delta_g", "activation", "steps", "score"), F.struct("score", F.array_join("path", ">"))).alias("b")).select("entity", "b.*")


def synthesis_score(best: DataFrame, scale: float = 1.0) -> DataFrame:
    """``best`` with ``synthesis_score``: exp(-(barrier + positive cost) / scale) over the number of steps' root."""
    return best.withColumn("synthesis_score", F.exp(-(F.col("activation") + F.greatest(F.col("delta_g"), F.lit(0.0))) / scale) / F.sqrt(F.greatest(F.col("steps"), F.lit(1))))
