"""Language-model scoring by logistic context mixing over bits.

A text is a stream of tokens, each followed by a space, and a last space for the text's end; each byte
is eight binary choices. Predictors know how often a bit was 0 or 1 after a hashed context. Their
log-odds are combined by weights that a gate selects, and the mixed chance is refined by a table of
what came true after it; weights and refinement are learned online.

- A token's first byte is told from no context; from the last byte of the token before (a space where
  there is none) with the last byte over 127 in the text so far; and from these with the byte before
  the last. Its second byte is told from its first one, and from that with the second of these.
- Its other bytes are told from the one, two, three or four bytes before them and from all of the
  token so far.

So the chances of first and second bytes are kept in two tables of bounded size, and the rest of a
token's depends on its own bytes: each distinct token is coded once, and of tokens that begin alike
the common bytes once. The sums are those of coding every occurrence.

All counts are of the whole training part. Learning starts anew in each of a number of shards of
tokens that follows from how many distinct tokens there are, goes through a shard in the order of its
keys, and is averaged over the shards; so results do not depend on partitions. An occurrence is
predicted from the others' counts. What is shared has a fixed size: the tables of counts, weights and
refinement, and the ``kept`` most frequent tokens. All other tokens are joined.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrolith.llm._common import remainder, saved

ORDERS = 5
#: Places of each predictor's counts: one, two, three, four bytes, the token so far.
SLOTS = (1 << 16, 1 << 19, 1 << 20, 1 << 21, 1 << 22)
#: Places of all that a first byte follows, of the last byte and the last over 127, and of the latter alone.
PREVIOUS, COARSE, FAR = 1 << 14, 1 << 8, 1 << 4
BLOCK = 1 << 16
KEPT = 400_000
#: The gate: how many predictors know their context, or how often the last has seen it; and the place in the token.
SEEN, PLACES = (2, 4, 16, 256), 4
GATES = (ORDERS + len(SEEN) + 1) * PLACES
STEPS = 33
#: Bytes that share one step of learning, and bytes of tokens taken at once.
CHUNK, HELD = 4096, 1 << 16
SHARD_TOKENS = 1 << 16
MOST_COUNTED = 400_000
TEXTS_AT_ONCE = 50_000
PRIOR = 0.1
RATE = 0.03


def tokens_of(text: bytes | None) -> list[bytes]:
    """The tokens of a text, its end (an empty token) included."""
    words = (text or b"").lower().split()  # bytes: A-Z and ASCII white space alone
    words.append(b"")
    return words


def _openings(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each token's place in the table of first bytes, in that of second bytes (-1 for an end), and where it begins.

    The tokens are whole texts with their ends, so that no text sees the one before it.
    """
    flat = np.frombuffer(b"  " + b" ".join(tokens) + b" ", np.uint8).astype(np.int32)
    start = np.concatenate(([2], np.flatnonzero(flat[2:] == 32)[:-1] + 3))
    first = flat[start]
    # the space before a token is at start - 1; an empty token has a space of its own
    last, second = (flat[np.maximum(start - k, 0)] for k in (2, 3))
    new = np.concatenate(([True], first[:-1] == 32))  # a text's first token
    second = np.where(new, 32, second)
    far = np.maximum.accumulate(np.where(flat > 127, np.arange(len(flat)), -1))[start - 1]
    far = np.where(far >= np.maximum.accumulate(np.where(new, start, 0)), 1 + flat[far] % (FAR - 1), 0)
    coarse = far * (COARSE // FAR) + last * 7 % (COARSE // FAR)
    fine = coarse * (PREVIOUS // COARSE) + (last * 3 + second * 37) % (PREVIOUS // COARSE)
    follow = (coarse * 256 + first) * 256 + flat[np.minimum(start + 1, len(flat) - 1)]
    return fine * 256 + first, np.where(first == 32, -1, follow), start


def _gathered(documents: DataFrame) -> DataFrame:
    """(kind, token, place, c): tokens and how often they are in training texts (kind 0); first (1) and second bytes (2) by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, others = Counter(), set()
        opened = np.zeros(PREVIOUS * 256, np.int32), np.zeros(COARSE << 16, np.int32)

        def flush() -> Iterator[pa.RecordBatch]:
            tokens = [*count, *(others - count.keys())]
            for i in range(0, len(tokens), 50_000):
                some = tokens[i : i + 50_000]
                yield rows(0, some, np.zeros(len(some), np.int32), np.array([count[t] for t in some], np.int64))
            count.clear()
            others.clear()

        def add(tokens: list[bytes]) -> None:
            count.update(tokens)
            first, second, _ = _openings(tokens)
            np.add.at(opened[0], first, 1)
            np.add.at(opened[1], second[second >= 0], 1)

        for b in batches:
            stream: list[bytes] = []
            for held, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                if held:
                    others.update(tokens_of(text.as_py()))
                else:
                    stream += tokens_of(text.as_py())
                if len(stream) > TEXTS_AT_ONCE:
                    add(stream)
                    stream = []
                if len(count) + len(others) > MOST_COUNTED:
                    yield from flush()
            if stream:
                add(stream)
        yield from flush()
        for kind in (1, 2):
            some = np.flatnonzero(opened[kind - 1])
            for i in range(0, len(some), 50_000):
                at = some[i : i + 50_000]
                yield rows(kind, [None] * len(at), at.astype(np.int32), opened[kind - 1][at].astype(np.int64))

    def rows(kind: int, tokens, place, c) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(c), kind, np.int32)), pa.array(tokens, pa.binary()), pa.array(place), pa.array(c)], ["kind", "token", "place", "c"])

    source = documents.select((remainder(F.col("doc_id"), 10) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "kind int, token binary, place int, c long")


class Mixer:
    """Weights by gate and the refinement; all of fixed size."""

    def __init__(self, orders: int, gates: int, weight: np.ndarray):
        self.orders, self.gates, self.weight = orders, gates, weight.astype(float)
        self.square, self.came = np.full((gates, orders), 1e-4), np.zeros((2, gates * STEPS))

    @staticmethod
    def stretch(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.clip(np.log((b + np.float32(PRIOR)) / (a + np.float32(PRIOR))), -9, 9)

    def mixed(self, stretch: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """The mixed log-odds."""
        return np.clip((self.weight.T.astype(np.float32)[:, gate] * stretch).sum(axis=0), -12, 12).astype(float)

    @staticmethod
    def step_of(dot: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return gate * STEPS + np.rint((dot + 12) * ((STEPS - 1) / 24)).astype(np.int64)

    def learn(self, stretch, gate, ones, zeros) -> None:
        """One step from bits that were 1 ``ones`` times, 0 ``zeros`` times."""
        dot = self.mixed(stretch, gate)
        step = self.step_of(dot, gate)
        self.came += np.stack([np.bincount(step, n, self.gates * STEPS) for n in (zeros, ones)])
        miss = ones - (ones + zeros) / (1 + np.exp(-dot))
        total = np.maximum(np.bincount(gate, ones + zeros, self.gates), 1e-9)
        slope = np.stack([np.bincount(gate, miss * s, self.gates) for s in stretch], axis=1) / total[:, None]
        self.square += slope**2
        self.weight += RATE * slope / np.sqrt(self.square)

    def freeze(self) -> None:
        seen = self.came.sum(axis=0)
        self.refined, self.trust = (self.came[1] + 0.02) / (seen + 0.04), 0.5 * seen / (seen + 50)

    def chance(self, stretch: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """The refined chance of a 1."""
        dot = self.mixed(stretch, gate)
        step = self.step_of(dot, gate)
        trust = self.trust[step]
        return (1 - trust) / (1 + np.exp(-dot)) + trust * self.refined[step]


# ---- first and second bytes ----------------------------------------------------------------------------


def _seen_level(n: np.ndarray) -> np.ndarray:
    return sum((n >= k).astype(np.int64) for k in (1, *SEEN))


def byte_table(counts: np.ndarray, groups: list[np.ndarray]) -> np.ndarray:
    """log10 of the chance of each byte in each context (row), from the counts of these.

    ``groups`` has coarser contexts, as the number of each row's group. Learned online, in runs of rows
    in a fixed order.
    """
    by = [np.zeros((int(g.max()) + 1, 256), np.float64) for g in groups] + [counts.astype(np.float64)]
    for table, g in zip(by, groups, strict=False):
        np.add.at(table, g, counts)
    # how often bits 0 and 1 came at each node of the eight-level tree of a byte
    trees = [[t.reshape(len(t), 1 << k, 2, -1).sum(axis=3).astype(np.float32) for t in by] for k in range(8)]
    levels, orders, own = len(SEEN) + 2, len(by), [*groups, np.arange(len(counts))]
    mixer = Mixer(orders, levels * 8, np.full((levels * 8, orders), 1 / orders))

    def inputs(k: int, rows: np.ndarray, node: np.ndarray, without: int | None = None):
        """(log-odds by context, gate) of nodes of level ``k`` in the rows."""
        got = np.stack([t[g[rows], node] for t, g in zip(trees[k], own, strict=True)])
        if without is not None:
            got[..., without] -= 1  # each occurrence is predicted from the others
        return Mixer.stretch(got[..., 0], got[..., 1]), _seen_level(got[-1].sum(axis=1)) * 8 + k

    used = np.flatnonzero(counts.any(axis=1))
    used = np.random.default_rng(5).permutation(used)
    for start in range(0, len(used), 256):
        block = used[start : start + 256]
        for k in range(8):
            for bit in (0, 1):
                n = trees[k][-1][block, :, bit]
                at, node = np.nonzero(n)
                times = n[at, node].astype(float)
                mixer.learn(*inputs(k, block[at], node, bit), times * bit, times * (1 - bit))
    mixer.freeze()
    out = np.zeros(counts.shape, np.float32)
    for k in range(8):
        for start in range(0, len(counts), 1024):
            rows = np.arange(start, min(start + 1024, len(counts)))
            p = mixer.chance(*inputs(k, np.repeat(rows, 1 << k), np.tile(np.arange(1 << k), len(rows)))).reshape(len(rows), 1 << k, 1)
            out[rows] += np.repeat(np.log10(np.concatenate((1 - p, p), axis=2)), 1 << (7 - k), axis=2).reshape(len(rows), 256)
    return out


@dataclass
class Opening:
    """log10 of the chances of first and second bytes. ``row`` finds the row of (place of COARSE, first byte) in the second table."""

    first: np.ndarray
    second: np.ndarray
    row: np.ndarray

    def said(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """What the first two bytes of tokens add, by their places."""
        out = self.first.ravel()[first].astype(float)
        has = second >= 0
        out[has] += self.second[self.row[second[has] >> 8], second[has] & 255]
        return out


def opening(gathered: DataFrame) -> Opening:
    """The tables of first and second bytes, whose size is bounded by PREVIOUS and COARSE * 256 rows."""
    got = gathered.where("kind > 0").groupBy("kind", "place").agg(F.sum("c").alias("c")).toArrow()
    kind, place, c = (got[x].to_numpy() for x in ("kind", "place", "c"))
    first = np.zeros(PREVIOUS * 256, np.int64)
    first[place[kind == 1]] = c[kind == 1]
    rows = np.arange(PREVIOUS)
    one = byte_table(first.reshape(PREVIOUS, 256), [rows * 0, rows // (PREVIOUS // COARSE)])
    place, c = place[kind == 2], c[kind == 2]
    pairs = np.unique(place >> 8)
    row = np.tile(np.arange(256, dtype=np.int32) + len(pairs), COARSE)  # pairs that never came go by their first byte alone
    row[pairs] = np.arange(len(pairs))
    second = np.zeros((len(pairs) + 256, 256), np.int64)
    second[row[place >> 8], place & 255] = c
    return Opening(one, byte_table(second, [np.concatenate((pairs & 255, np.arange(256)))]), row)


# ---- the rest of a token -----------------------------------------------------------------------------

_POWER = np.uint64(0x9E3779B97F4A7C15)


class Edges:
    """The bytes of sorted tokens and their ends from the third on, those of a common beginning once."""

    def __init__(self, tokens: list[bytes]):
        flat = np.frombuffer(b" ".join(tokens) + b" ", np.uint8)
        length = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
        start = np.cumsum(length) - length
        of = np.repeat(np.arange(len(tokens)), length)
        at = np.arange(len(flat)) - start[of]
        # a byte is shared if it and all before it are the token's before
        other = start[of - 1] + at
        apart = (of == 0) | (at >= length[of - 1]) | (flat[np.minimum(other, len(flat) - 1)] != flat)
        unlike = np.cumsum(apart)
        fresh = unlike > (unlike[start] - apart[start])[of]
        order = np.argsort(at.astype(np.int32), kind="stable")  # by place, then by token
        last = np.maximum.accumulate(np.where(fresh[order], np.arange(len(flat)), 0))
        source = np.empty(len(flat), np.int64)
        source[order] = order[last]  # where each byte's edge was met first
        inside = at > 1
        self.edge = np.flatnonzero(fresh & inside)
        number = np.zeros(len(flat), np.int64)
        number[self.edge] = np.arange(len(self.edge))
        self.of, self.number = of[inside], number[source[inside]]
        self.n, self.byte, self.at = len(tokens), flat[self.edge], at[self.edge]
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.full(int(length.max()), _POWER, np.uint64))
            whole = np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * powers[at], dtype=np.uint64)
            before = np.concatenate((np.zeros(1, np.uint64), whole[:-1]))
            contexts, last = [], np.zeros(len(self.edge), np.uint64)
            for k in range(1, ORDERS):
                byte = np.where(self.at >= k, flat[np.maximum(self.edge - k, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
                last = last * np.uint64(257) + byte
                contexts.append(last)
            contexts.append((before[self.edge] - before[start[of[self.edge]]]) ^ (self.at.astype(np.uint64) << np.uint64(56)))
            #: The contexts' part of the hash, the same for all eight bits of a byte.
            self.hashed = (np.array(contexts) + np.arange(1, ORDERS + 1, dtype=np.uint64)[:, None]) * np.uint64(0xD6E8FEB86659FD93)

    def shuffled(self) -> np.ndarray:
        """Order the edges by a hash of what they follow; return which edge each was."""
        order = np.lexsort((self.byte, self.hashed[-1] ^ (self.hashed[-1] >> np.uint64(31))))
        self.edge, self.byte, self.at, self.hashed = self.edge[order], self.byte[order], self.at[order], self.hashed[:, order]
        return order

    def times(self, c: np.ndarray) -> np.ndarray:
        """How often each edge is met, if the tokens are met ``c`` times."""
        return np.bincount(self.number, c[self.of], len(self.edge))

    def bits(self, size: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """(edges, node, bit) of eight bits for ``size`` edges at a time."""
        for i in range(0, len(self.edge), size):
            part = slice(i, min(i + size, len(self.edge)))
            byte = self.byte[part].astype(np.int64)
            for k in range(8):
                yield part, (1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1


def _held(tokens: list[bytes], size: int = HELD) -> Iterator[slice]:
    """Runs of tokens of about ``size`` bytes."""
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    cuts = np.flatnonzero(np.diff(ends // size)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(tokens)], strict=True):
        if a < b:
            yield slice(a, b)


def _slots(hashed: np.ndarray, node: np.ndarray, slots: tuple) -> np.ndarray:
    """The place, by order and bit, in the table of sum(slots); each of ``slots`` is a power of two."""
    sizes = np.array(slots, np.int64)[:, None]
    with np.errstate(over="ignore"):
        h = hashed + node.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xE7037ED1A0B428DB)
    h >>= np.uint64(32)
    spread = h.view(np.int64)
    spread &= sizes - 1
    spread += np.cumsum(sizes, axis=0) - sizes
    return spread


class Inside:
    """The predictors of a token's bytes after the second, with their mixer."""

    def __init__(self, counts: np.ndarray, slots: tuple = SLOTS):
        """``counts``: how often a bit was 0 and 1, as the parts of complex numbers: one look into memory finds both."""
        self.counts, self.slots = counts, slots
        self.fresh()

    def fresh(self) -> None:
        start = np.zeros((ORDERS + len(SEEN) + 1, ORDERS))
        for k in range(len(start)):  # the longest context that is known leads
            top = min(max(k - 1, 0), ORDERS - 1)
            start[k, top] += 0.8
            start[k, max(top - 1, 0)] += 0.15
        self.mixer = Mixer(ORDERS, GATES, np.repeat(start, PLACES, axis=0))

    def inputs(self, edges: Edges, part: slice, node: np.ndarray, own: np.ndarray | None = None):
        """(log-odds by order, gate); of an occurrence that has the bit ``own``, its own count is left out."""
        got = self.counts[_slots(edges.hashed[:, part], node, self.slots)]
        a, b = got.real, got.imag
        if own is not None:
            a, b = np.maximum(a - (own == 0).astype(np.float32), 0), np.maximum(b - (own == 1).astype(np.float32), 0)
        n = a + b
        known, all_so_far = np.zeros(n.shape[1], np.int64), np.ones(n.shape[1], bool)
        for order in n > 0:
            all_so_far = all_so_far & order
            known += all_so_far
        known = np.where(n[-1] > 0, ORDERS - 1 + _seen_level(n[-1]), np.minimum(known, ORDERS - 1))
        return Mixer.stretch(a, b), known * PLACES + np.minimum(edges.at[part] - 2, PLACES - 1)

    def learn(self, tokens: list[bytes], c: np.ndarray) -> None:
        """One online pass over sorted tokens, met ``c`` times."""
        for held in _held(tokens, 16 * HELD):
            edges = Edges(tokens[held])
            times = edges.times(c[held].astype(float))[edges.shuffled()]
            for part, node, bit in edges.bits(CHUNK):
                self.mixer.learn(*self.inputs(edges, part, node, bit), times[part] * bit, times[part] * (1 - bit))

    def log10(self, tokens: list[bytes]) -> np.ndarray:
        """log10 of the chance of each sorted token, its first two bytes given."""
        out = np.zeros(len(tokens))
        for held in _held(tokens):
            edges = Edges(tokens[held])
            total = np.zeros(len(edges.edge))
            for part, node, bit in edges.bits(2 * CHUNK):
                p = self.mixer.chance(*self.inputs(edges, part, node))
                total[part] += np.log10(np.where(bit == 1, p, 1 - p))
            out[held] = np.bincount(edges.of, total[edges.number], edges.n)
        return out


#: The counts that this worker process has unpacked last, under their broadcast's number.
_UNPACKED: dict = {}


def _unpacked(shared: Shared) -> np.ndarray:
    """The counts of a broadcast that holds them compressed: most places are empty in a small corpus."""
    if shared.id not in _UNPACKED:
        _UNPACKED.clear()
        _UNPACKED[shared.id] = np.frombuffer(zlib.decompress(shared.broadcast.value), np.complex64)
    return _UNPACKED[shared.id]


class Shared:
    """A broadcast with a number of its own, which tasks can see."""

    def __init__(self, spark, counts: np.ndarray):
        self.id = uuid.uuid4().hex
        self.broadcast = spark.sparkContext.broadcast(zlib.compress(counts.tobytes(), 1))


def _tokens(batch: pa.RecordBatch, i: int = 0) -> list[bytes]:
    return batch.column(i).cast(pa.binary()).to_pylist()


def counted(types: DataFrame, slots: tuple = SLOTS) -> np.ndarray:
    """The table of sum(slots) counts, as complex numbers, from (token, c)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, sum(slots)))
        for b in batches:
            tokens, c = _tokens(b), b.column(1).to_numpy()
            for held in _held(tokens):
                edges = Edges(tokens[held])
                times = edges.times(c[held])
                for part, node, bit in edges.bits(8 * CHUNK):
                    slot, weight = _slots(edges.hashed[:, part], node, slots), times[part]
                    for v in (0, 1):
                        some = bit == v
                        for row in slot[:, some]:
                            np.add.at(n[v], row, weight[some])
        yield from packed((k, n[:, k * BLOCK : (k + 1) * BLOCK]) for k in range(-(-n.shape[1] // BLOCK)))

    def packed(blocks) -> Iterator[pa.RecordBatch]:
        # numbers under 65,536 take two bytes, others eight; most are 0, so that they pack well
        for k, a in blocks:
            if a.any():
                kind = np.uint16 if a.max() < 65_536 else np.int64
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(a.astype(kind).tobytes(), 1)], pa.binary())], ["block", "data"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}  # this task's blocks of the fixed table
        for b in batches:
            for k, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                a = unpacked(k, data.as_py())
                sums[k] = sums[k] + a if k in sums else a
        yield from packed(sums.items())

    def unpacked(k: int, data: bytes) -> np.ndarray:
        width = min(BLOCK, sum(slots) - k * BLOCK)
        raw = zlib.decompress(data)
        return np.frombuffer(raw, np.uint16 if len(raw) == 4 * width else np.int64).reshape(2, -1).astype(np.int64)

    schema = "block int, data binary"
    got = types.mapInArrow(count, schema).repartition("block").mapInArrow(add, schema).toArrow()  # the table of sum(slots), however large the corpus
    counts = np.zeros(sum(slots), np.complex64)
    for k, data in zip(got["block"].to_pylist(), got["data"], strict=True):
        a = unpacked(k, data.as_py())
        counts.real[k * BLOCK : k * BLOCK + a.shape[1]], counts.imag[k * BLOCK : k * BLOCK + a.shape[1]] = a
    return counts


def train(types: DataFrame, slots: tuple = SLOTS) -> tuple[Shared, np.ndarray, np.ndarray]:
    """(counts, weights, refinement) from (shard, token, c) of all training tokens."""
    trained = types.where("c > 0").select("token", "c", "shard")
    shared = Shared(types.sparkSession, counted(trained, slots))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, now, tokens, c = Inside(_unpacked(shared), slots), None, [], []

        def done() -> Iterator[pa.RecordBatch]:
            if now is not None:
                model.fresh()
                model.learn(tokens, np.array(c))
                seen = float(sum(c))
                made = np.concatenate((model.mixer.weight.ravel() * seen, model.mixer.came.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(made), dtype=np.int32)), pa.array(made), pa.array(np.full(len(made), seen))], ["i", "v", "seen"])

        for b in batches:
            shard = b.column(2).to_numpy()
            for at, n in zip(*np.unique(shard, return_index=True), strict=True):  # rows are sorted by shard
                if at != now:
                    yield from done()
                    now, tokens, c = at, [], []
                some = b.slice(n, int((shard == at).sum()))
                tokens += _tokens(some)
                c += some.column(1).to_pylist()
        yield from done()

    # a shard is learned in one task, in the order of its tokens
    dealt = trained.repartition("shard").sortWithinPartitions("shard", "token")
    parts = dealt.mapInArrow(learn, "i int, v double, seen double").groupBy("i").agg(F.sum("v").alias("v"), F.sum("seen").alias("seen")).toArrow()
    if not parts.num_rows:
        fresh = Inside(np.zeros(0, np.complex64), slots).mixer
        return shared, fresh.weight, fresh.came
    order = np.argsort(parts["i"].to_numpy())
    v, seen = parts["v"].to_numpy()[order], parts["seen"].to_numpy()[order]
    return shared, (v / seen)[: GATES * ORDERS].reshape(GATES, ORDERS), v[GATES * ORDERS :].reshape(2, -1)


def token_types(gathered: DataFrame) -> DataFrame:
    """(shard, token, c): each token once; how many shards there are follows from the tokens, not from partitions."""
    tokens = gathered.where("kind = 0").select("token", "c")
    about = tokens.agg(F.approx_count_distinct("token")).first()[0]
    shards = 1 << max(0, (about // SHARD_TOKENS).bit_length())
    spread = tokens.withColumn("shard", F.pmod(F.xxhash64("token"), F.lit(shards)).cast("int")).repartition("shard")
    return spread.groupBy("shard", "token").agg(F.sum("c").alias("c")).sortWithinPartitions("shard", "token")


def score(documents: DataFrame, slots: tuple = SLOTS, kept: int = KEPT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) of every row.

    Rows whose id's crc32 has the remainder 0 by 10 don't train. Null texts are empty ones: their end
    is their one token. ``n_bytes`` counts what is coded: the bytes of the tokens and a space after
    each, one for the end. Repeated rows get equal rows; an empty table gives no rows.
    """
    spark = documents.sparkSession
    gathered = saved(_gathered(documents))
    types = saved(token_types(gathered))
    sums = types.where("c > 0").agg(F.count("*").alias("v"), F.sum("c").alias("n")).first()
    n_all, below = int(sums["n"] or 0), 0.1 * (int(sums["v"]) + 1)
    begun = opening(gathered)
    shared, weight, came = train(types, slots)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Inside(_unpacked(shared), slots)
        model.mixer.weight, model.mixer.came = weight, came
        model.mixer.freeze()
        for b in batches:
            c = b.column(1).to_numpy()
            base = np.log10((c + 0.1) / (n_all + below))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(base), pa.array(model.log10(_tokens(b)))], ["token", "c", "base", "said"])

    coded = saved(types.select("token", "c").mapInArrow(code, "token binary, c long, base double, said double"))
    # the least count, in steps of an eighth of a doubling, that at most ``kept`` tokens reach
    step = F.floor(F.log2(F.col("c").cast("double")) * 8)
    tally = coded.where("c > 1").groupBy(step.alias("s")).agg(F.count("*").alias("n"), F.min("c").alias("least")).orderBy(F.desc("s")).collect()
    room, least = kept, 1 << 62
    for r in tally:
        room -= r.n
        if room < 0:
            break
        least = r.least
    often = coded.where(F.col("c") >= least).select("token", "base", "said").toArrow()
    names = often["token"].to_pylist()
    numbers = [np.append(often[x].to_numpy(), 0) for x in ("base", "said")]
    known = spark.sparkContext.broadcast((dict(zip(names, range(len(names)), strict=True)), *numbers, begun))

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, base, said, begun = known.value
        for b in batches:
            texts, ids, hashes = b.column(2).cast(pa.binary()), b.column(0), b.column(1).to_pylist()
            for held in texts_at_once(texts):
                some = [tokens_of(texts[i].as_py()) for i in range(held.start, held.stop)]
                words = [w for doc in some for w in doc]
                n = np.fromiter(map(len, some), np.int64, len(some))
                start = np.cumsum(n) - n
                at = np.fromiter(map(place.get, words, repeat(-1)), np.int64, len(words))
                first, second, byte = _openings(words)
                size = np.diff(np.append(byte[start], byte[-1] + 1))
                total = np.add.reduceat(said[at] + begun.said(first, second), start)
                row = hashes[held]
                own = [pa.array(x) for x in (n, size, np.add.reduceat((at >= 0).astype(np.int64), start), np.add.reduceat(base[at], start), total)]
                yield pa.RecordBatch.from_arrays([ids[held.start : held.stop], pa.array(row, pa.int64()), pa.nulls(len(row), pa.binary()), *own], columns)
                rare = np.flatnonzero(at < 0)
                if len(rare):
                    names = [words[i] for i in rare.tolist()]
                    keys, times, of = [], [], []
                    bounds = np.searchsorted(rare, [*start.tolist(), len(words)]).tolist()
                    for r, x, y in zip(row, bounds, bounds[1:], strict=False):
                        if x < y:
                            met = Counter(names[x:y])
                            keys += met.keys()
                            times += met.values()
                            of += repeat(r, len(met))
                    k = len(keys)
                    yield pa.RecordBatch.from_arrays([pa.nulls(k, ids.type), pa.array(of, pa.int64()), pa.array(keys, pa.binary()), pa.array(times, pa.int64()), *(pa.nulls(k, t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64()))], columns)

    def texts_at_once(texts) -> Iterator[slice]:
        size, start = 0, 0
        for i, n in enumerate(pa.compute.binary_length(texts).to_pylist()):
            size += n or 0
            if size > 6 * TEXTS_AT_ONCE:
                yield slice(start, i + 1)
                size, start = 0, i + 1
        if start < len(texts):
            yield slice(start, len(texts))

    columns = ["doc_id", "row", "token", "times", "n_bytes", "known", "base", "said"]
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), F.col("text").cast("string").alias("text"))
    lines = rows.mapInArrow(sum_up, f"doc_id {kind}, row long, token binary, times long, n_bytes long, known long, base double, said double")
    seldom = coded.where(F.col("c") < least).select(F.col("token").alias("t"), (F.col("c") > 0).alias("t_known"), F.col("base").alias("t_base"), F.col("said").alias("t_said"))
    own = F.col("token").isNull()
    met = lines.join(seldom, F.col("token") == F.col("t"), "left")
    each = met.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.count_if(own).alias("copies"),
        F.sum(F.when(own, F.col("times"))).alias("n_tokens"),
        F.sum("n_bytes").alias("n_bytes"),
        F.sum(F.when(own, F.col("known")).when(F.col("t_known"), F.col("times")).otherwise(0)).alias("n_known"),
        F.sum(F.when(own, F.col("base")).otherwise(F.col("times") * F.col("t_base"))).alias("base_score"),
        F.sum(F.when(own, F.col("said")).otherwise(F.col("times") * F.col("t_said"))).alias("score"),
    )
    # rows that repeat id and text were added up together
    each = each.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    share = lambda c: F.col(c) / F.col("copies")
    return each.select(
        "doc_id", (remainder(F.col("doc_id"), 10) == 0).alias("held_out"), share("n_tokens").cast("long").alias("n_tokens"), share("n_known").cast("long").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"), share("base_score").alias("base_score"), share("score").alias("score"), share("n_bytes").cast("long").alias("n_bytes"),
        (-F.col("score") * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
