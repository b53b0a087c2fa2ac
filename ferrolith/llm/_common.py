"""Small helpers that the training-data operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What separates words of digits, a-z and non-ASCII characters.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What separates words of anything but white space.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what the cluster names in ``spark.checkpoint.dir``; where that is unset (tests on one
    machine) a temporary folder is made once and kept as the session's checkpoint folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='checkpoints-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, where the loss of an executor leaves it."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again: ``cut`` for tables of many rows, columnar and compressed."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Have the driver collect its garbage, so that Spark deletes the shuffles and, where it is told to, the checkpoints that nothing reads any more.

    Loops of many small jobs fill disks otherwise, as the driver's own heap hardly grows.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove_saved(*tables: DataFrame) -> None:
    """Delete what ``saved`` wrote, once nothing reads it any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a few numbers each that are worth a task, and tasks of such a table, at least.
ROWS_A_TASK, LEAST_TASKS = 100_000, 8


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of about ``rows`` rows of a few numbers each, in partitions that are worth a task and its files."""
    return df.coalesce(max(LEAST_TASKS, rows // ROWS_A_TASK))


#: Rows of a few numbers each that a join may broadcast; beyond that it shuffles.
MOST_BROADCAST = 200_000


def sized(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """``df``, which is cut or as cheap to count, to be broadcast if it has at most ``most`` rows."""
    return F.broadcast(df) if df.count() <= most else df


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is; ``lower`` does just that where all is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def with_words(df: DataFrame, text: Column, name: str, separator: str, lower: bool) -> DataFrame:
    """``df`` with the array ``name`` of the words of ``text``; null and blank texts have none."""
    text = F.coalesce(text, F.lit(""))
    raw = f"{name}__raw"
    out = df.withColumn(raw, F.split(ascii_lower(text) if lower else text, separator))
    lead = (F.get(raw, F.lit(0)) == "").cast("int")
    trail = (F.get(raw, F.size(raw) - 1) == "").cast("int")
    return out.withColumn(name, F.slice(raw, lead + 1, F.greatest(F.size(raw) - lead - trail, F.lit(0)))).drop(raw)


def n_space_words(text: Column) -> Column:
    """How many words, by white space, a text has; 0 for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE))).cast("long")


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def rows(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, whatever other columns ``df`` has."""
    return df.select(*(F.col(n) for n in names))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many '_' appended as it takes not to be a column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b: long): rows (node, root), root the least node.

    Alternates large-star and small-star steps, both joins on a node, until nothing changes; nodes
    without an edge are left out. Each round is cut, so that no plan grows and lost executors cost
    one round. A hub joins its one minimum, so its rows may be split among tasks.
    """
    first = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now, n, mark = cut(first), 0, None
    for _ in range(most_rounds):
        n = n or now.count()
        now = few(now, n)
        both = now.select("a", "b").unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = few(few(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")), n).distinct(), n)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        now = cut(few(few(small.where("a <> b"), n).distinct(), n))
        new = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if new == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark, n = new, new[0]
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
