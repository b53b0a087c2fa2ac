"""Quality rules with risk-controlled cutoffs.

Each rule rejects texts whose measure lies beyond a cutoff. Cutoffs come from labelled holdouts, parted
by a hash of the id. In each stratum (language) the lesser part of the good texts proposes, with all
bad ones, a cutoff for each rule: the strictest of its grid that rejects next to none of these good
texts, or a looser one that rejects as many bad ones; LEVELS nested sets of cutoffs lead from none to
these, all rules together. The greater part of the good texts then tests the sets, the loosest first: a set
holds while the exact binomial upper bound of the share of good texts that its rules reject together
stays within the risk; the walk ends at the first failure, so that neither the grid nor the number of
rules costs a correction, and the confidence is divided among strata. With confidence 1 - ``error`` the
rules thus reject at most ``risk`` of the good texts in every stratum. A stratum with too few labels to
show that keeps all: with the default risk and error and four strata it takes 144 good texts that are
tested and none rejected.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrolith.llm._common import cut, remainder, sized

RISK = 0.03
ERROR = 0.05
LEVELS = 12
#: Rule: its grid, from the loosest cutoff to the strictest. Texts above it are rejected; measures of "short" are negative.
RULES = {
    "symbols": [2.0, 1.0, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02],
    "shouts": [2.0, 1.0, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04],
    "uppers": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15],
    "same_lines": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1],
    "repeats": [0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1],
    "long_words": [20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0, 8.5, 8.0],
    "short_words": [-1.5, -2.0, -2.5, -3.0, -3.5, -4.0],
}
_SYMBOLS, _SPACE, _UPPER, _LOWER = (list(x) for x in (b"#*$%&|<>", b" \t\n\x0b\x0c\r", range(65, 91), range(97, 123)))
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_shouts", "n_upper", "n_letters", "n_lines"]


def counts(text: bytes | None) -> tuple[int, ...]:
    """COUNTS of one text; all 0 for null."""
    if not text:
        return (0,) * len(COUNTS)
    words = text.split()  # bytes: by ASCII white space alone
    n = len(words)
    byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        often = Counter(windows)
        if len(often) < len(windows):
            hit = np.zeros(n, bool)
            twice = np.fromiter((often[w] > 1 for w in windows), bool, n - 2)
            for i in range(3):
                hit[i : n - 2 + i] |= twice
            repeated = int(hit.sum())
    chars = len(text) - int(byte[128:192].sum()) - int(byte[_SPACE].sum())  # bytes that begin a code point
    upper = int(byte[_UPPER].sum())
    return n, chars, int(byte[_SYMBOLS].sum()), len(lines) - len(set(lines)), repeated, int(byte[33]), upper, upper + int(byte[_LOWER].sum()), len(lines)


def counted(documents: DataFrame) -> DataFrame:
    """(doc_id, stratum, COUNTS) of every row; a null language is the stratum ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = np.array([counts(t.as_py()) for t in b.column(2).cast(pa.binary())], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(made[:, i]) for i in range(len(COUNTS)))], ["doc_id", "stratum", *COUNTS])

    kind = documents.schema["doc_id"].dataType.simpleString()
    source = documents.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("stratum"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, f"doc_id {kind}, stratum string, " + ", ".join(f"{c} long" for c in COUNTS))


def with_measures(table: DataFrame) -> DataFrame:
    """``table`` with base_failed and each rule's measure."""
    words, letters, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "n_letters", "n_lines"))
    made = {"symbols": F.col("n_symbols") / words, "shouts": F.col("n_shouts") / words, "uppers": F.col("n_upper") / letters, "same_lines": F.col("n_dup_lines") / lines, "repeats": F.col("n_repeat_words") / words, "long_words": F.col("word_chars") / words, "short_words": -F.col("word_chars") / words}
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return table.withColumns(made).withColumn("base_failed", failed)


def _beta(a: float, b: float, x: float) -> float:
    """The regularized incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    out = d
    for m in range(1, 10_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d)
            c = 1 + top / c
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out


def within_risk(rejected: int, n: int, risk: float, error: float) -> bool:
    """Whether the exact (Clopper-Pearson) upper bound of the rejected share, at level 1 - error, is at most risk."""
    return n > 0 and rejected < n and _beta(n - rejected, rejected + 1, 1 - risk) <= error


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(stratum, rule, cutoff, n, rejected): each stratum's strictest set of cutoffs that holds, if one does.

    ``n`` good texts were tested, of which the set rejects ``rejected``. Good texts are those labelled 1
    that no base rule fails; of contradicting labels the majority counts.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("q")).where("q <> 0.5")
    held = measured.where("not base_failed").join(known, "doc_id").withColumn("good", F.col("q") > 0.5)
    held = held.withColumn("proposes", ~F.col("good") | (remainder(F.col("doc_id"), 4) == 3))
    held = cut(held.select("stratum", "good", "proposes", *RULES))  # labelled rows alone
    steps = [F.struct(F.lit(rule).alias("rule"), sum((F.col(rule) > c).cast("int") for c in grid).alias("passed")) for rule, grid in RULES.items()]
    tallied = held.where("proposes").select("stratum", "good", F.explode(F.array(*steps)).alias("s")).groupBy("stratum", "s.rule", "s.passed").agg(F.count_if("good").alias("n"), F.count_if(~F.col("good")).alias("bad"))
    strata = max(held.where("not proposes").select("stratum").distinct().count(), 1)

    def propose(table: pd.DataFrame) -> pd.DataFrame:
        out = []
        for rule, rows in table.groupby("rule"):
            spare = risk / len(RULES) * rows.n.sum()
            caught = [int(rows.bad[rows.passed > i].sum()) for i in range(len(RULES[rule]))]
            steps = [i for i in range(len(caught)) if rows.n[rows.passed > i].sum() <= spare]
            # of those, none that is stricter than it takes to catch the same bad texts
            steps = [i for i in steps if i == 0 or caught[i - 1] < max(caught[j] for j in steps)] if rows.bad.sum() else steps
            for level in range(1, LEVELS + 1):
                if (k := -(-level * len(steps) // LEVELS)) > 0:
                    out.append((rows.stratum.iloc[0], level, rule, RULES[rule][steps[k - 1]]))
        return pd.DataFrame(out, columns=["stratum", "level", "rule", "cutoff"])

    # a stratum's tally has a row for each rule and grid step at most
    proposed = cut(tallied.groupBy("stratum").applyInPandas(propose, "stratum string, level int, rule string, cutoff double"))
    sets = proposed.groupBy("stratum").agg(F.collect_list(F.struct("level", "rule", "cutoff")).alias("sets"))
    tested = held.where("not proposes").join(sized(cut(sets)), "stratum")
    # the loosest set that rejects a text, or none
    first = F.array_min(F.transform(F.filter("sets", lambda x: F.coalesce(*(F.when(x["rule"] == r, F.col(r)) for r in RULES)) > x["cutoff"]), lambda x: x["level"]))
    levels = tested.select("stratum", first.alias("level")).groupBy("stratum", "level").agg(F.count("*").alias("n"))

    def test(table: pd.DataFrame) -> pd.DataFrame:
        n, best = int(table.n.sum()), None
        for level in range(1, LEVELS + 1):
            rejected = int(table.n[table.level <= level].sum())  # no level is no number, and never at most one
            if not within_risk(rejected, n, risk, error / strata):
                break
            best = (table.stratum.iloc[0], level, n, rejected)
        return pd.DataFrame([best] if best else [], columns=["stratum", "level", "n", "rejected"])

    chosen = levels.groupBy("stratum").applyInPandas(test, "stratum string, level int, n long, rejected long")
    return proposed.join(chosen, ["stratum", "level"]).select("stratum", "rule", "cutoff", "n", "rejected")


def report(documents: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """Every row with COUNTS, base_failed, failed_rules and kept; repeated rows get equal rows."""
    made = cut(counted(documents))
    measured = with_measures(made)
    chosen = cutoffs(measured, labels, risk, error).groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cutoff"))
    chosen = cut(chosen.withColumnsRenamed({r: f"{r}_cut" for r in RULES}))
    met = measured.join(sized(chosen), "stratum", "left")
    failed = F.array_compact(F.array(*(F.when(F.col(r) > F.col(f"{r}_cut"), F.lit(r)) for r in RULES)))
    met = met.withColumn("failed_rules", failed)
    return met.select("doc_id", "stratum", *COUNTS, "base_failed", "failed_rules", (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"))
