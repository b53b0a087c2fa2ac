"""A quality classifier learned by Bradley-Terry pairwise ranking.

Texts become a few dozen numbers (in Arrow batches). Pairs of a text labelled 1 and one labelled 0
say which is preferred; the chance that the first wins is the logistic function of the difference of
the two scores, and a score is linear in the features' standardized values and quantile bins, so
that fitting is logistic loss on feature differences. The cut is the quantile of the training
scores that parts the labels best, and what a text is given is the logistic function of its score's
distance from the cut.

Fitting uses at most ``most_labelled`` labelled rows (drawn by a hash of their ids; only their
features, not their texts, reach the driver); each row of the more frequent label is in PARTNERS pairs.
Scoring covers all rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrolith.llm._common import remainder

MOST_LABELLED = 12_000
PARTNERS = 3
BINS = 8
RIDGE = 1.0
#: Byte classes whose shares are features.
CLASSES = {"lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t\n\x0b\x0c\r", "stop": b".?", "comma": b",;:", "shout": b"!", "symbol": b"#*$%&|<>", "other": b"\"'()/-_=+[]{}@\\^`~"}
NAMES = ["log_words", "word_length", "log_lines", "line_words", *CLASSES, "high", "types", "top_word", "same_next", "same_line", "shouted", "odd_end", "squeezed"]

_OF_BYTE = np.zeros((256, len(CLASSES) + 1))
for _i, _chars in enumerate(CLASSES.values()):
    _OF_BYTE[list(_chars), _i] = 1
_OF_BYTE[128:, -1] = 1


def features(text: bytes | None) -> list[float]:
    """The numbers of one text, by NAMES; all 0 for null and empty texts."""
    if not text:
        return [0.0] * len(NAMES)
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    n, n_lines = max(len(words), 1), max(len(lines), 1)
    shares = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _OF_BYTE / len(text)
    counts = Counter(words)
    top = max(counts.values(), default=0)
    odd = sum(c for w, c in counts.items() if w[-1:] in b"!#*$%&|<>")
    return [
        float(np.log1p(len(words))), sum(map(len, words)) / n, float(np.log1p(len(lines))), float(np.log1p(len(words) / n_lines)), *shares.tolist(),
        len(counts) / n, top / n, sum(map(eq, words, words[1:])) / n, 1 - len(set(lines)) / n_lines,
        sum(c for w, c in counts.items() if len(w) > 1 and w.isupper()) / n, odd / n, len(zlib.compress(text, 1)) / len(text),
    ]


def featured(documents: DataFrame) -> DataFrame:
    """(doc_id, f array<float>) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [features(t.as_py()) for t in b.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.list_(pa.float32()))], ["doc_id", "f"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, f array<float>")


@dataclass
class Model:
    """What scoring needs; a few kilobytes."""

    mean: np.ndarray
    spread: np.ndarray
    edges: list[np.ndarray]
    weight: np.ndarray
    cut: float

    def design(self, f: np.ndarray) -> np.ndarray:
        z = np.clip((f - self.mean) / self.spread, -4, 4)
        bins = [(np.searchsorted(e, f[:, i], side="right")[:, None] == np.arange(len(e) + 1)).astype(float) for i, e in enumerate(self.edges)]
        return np.concatenate([z, *bins], axis=1)

    def score(self, f: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.design(f) @ self.weight - self.cut, -30, 30)))


def training_rows(documents: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """(doc_id, f, y) of at most ``most_labelled`` labelled documents whose id's remainder by 3 is not 1, by id.

    Of contradicting labels of an id the more frequent counts, 1 if they are even; null labels and ids
    don't. Of texts that share an id the one of the least hash counts.
    """
    known = labels.where("doc_id is not null and quality is not null").where(remainder(F.col("doc_id"), 3) != 1)
    known = known.groupBy("doc_id").agg((F.avg(F.col("quality").cast("double")) >= 0.5).cast("int").alias("y"))
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled).withColumnRenamed("doc_id", "labelled_id")
    texts = documents.select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("labelled_id"))  # at most most_labelled rows of two numbers
    one = texts.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return featured(one).join(F.broadcast(drawn), F.col("doc_id") == F.col("labelled_id")).select("doc_id", "f", "y").orderBy("doc_id")


def fit_rows(f: np.ndarray, y: np.ndarray, bins: int = BINS, ridge: float = RIDGE, seed: int = 7) -> Model:
    """Bradley-Terry on feature differences by Newton steps; rows in any fixed order."""
    width = len(NAMES)
    if not len(y):
        return Model(np.zeros(width), np.ones(width), [np.zeros(0)] * width, np.zeros(2 * width), 0.0)
    mean, spread = f.mean(axis=0), f.std(axis=0)
    edges = [np.unique(np.quantile(f[:, i], np.arange(1, bins) / bins)) for i in range(width)]
    model = Model(mean, np.where(spread > 1e-9, spread, 1), edges, np.zeros(0), 0.0)
    x = model.design(f)
    model.weight = np.zeros(x.shape[1])
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y != 1)
    if not len(good) or not len(bad):
        model.cut = -1.0 if len(good) else 1.0
        return model
    rng = np.random.default_rng(seed)
    # every row is in pairs: the more frequent label's rows meet PARTNERS of the other's each
    each = PARTNERS * max(len(good), len(bad))
    d = x[np.resize(rng.permutation(good), each)] - x[rng.permutation(np.resize(rng.permutation(bad), each))]
    for _ in range(12):
        p = 1 / (1 + np.exp(np.clip(d @ model.weight, -30, 30)))  # the chance that the worse one wins
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + ridge * np.eye(d.shape[1]), d.T @ p - ridge * model.weight)
        model.weight = model.weight + step
        if np.abs(step).max() < 1e-4:
            break
    score = x @ model.weight
    order = np.argsort(score, kind="stable")
    s, right = score[order], (y[order] == 1).astype(float)
    # by cutting below row i: the share of each label on its side, for every quantile i / n
    balance = np.concatenate(([0], np.cumsum(1 - right))) / len(bad) + (len(good) - np.concatenate(([0], np.cumsum(right)))) / len(good)
    level = int(np.argmax(balance))
    low, high = s[max(level - 1, 0)], s[min(level, len(s) - 1)]
    model.cut = float((low + high) / 2)
    return model


def fit(documents: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED, **how) -> Model:
    """The model from the labelled documents; without labels every text scores 0.5."""
    got = training_rows(documents, labels, most_labelled).toPandas()
    f = np.array(got["f"].tolist(), float).reshape(-1, len(NAMES))
    return fit_rows(f, got["y"].to_numpy(int), **how)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted, n_bytes) of every row; repeated rows get equal rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py() or b"" for t in b.column(1).cast(pa.binary())]
            got = model.score(np.array([features(t) for t in texts], float).reshape(-1, len(NAMES)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got), pa.array((got >= 0.5).astype(np.int32)), pa.array([len(t) for t in texts], pa.int64())], ["doc_id", "score", "predicted", "n_bytes"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double, predicted int, n_bytes long")


def keep_good(documents: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows, all their columns, whose text is predicted good.

    Null texts are scored as empty ones; repeated rows share one fate; an empty table stays empty; without
    labels every text scores 0.5 and stays.
    """
    model = fit(documents, labels, **how)
    kinds = documents.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).cast(pa.binary())
            got = model.score(np.array([features(t.as_py()) for t in texts], float).reshape(-1, len(NAMES)))
            yield b.filter(pa.array(got >= 0.5))

    return documents.mapInArrow(run, kinds)
