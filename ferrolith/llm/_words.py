"""Words of whole Arrow batches at once: bytes translated, split and coded by dictionary, without a loop over words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at a time; a longer text is worked on alone.
SLICE = 2_000_000
_LOWER = bytes(range(256)).lower()  # A-Z alone, as it is for bytes


class Words(NamedTuple):
    """The words of some texts in order: ``codes`` into ``values``, ``rows`` of their texts, ``linked`` to the next word."""

    codes: np.ndarray
    values: list[bytes]
    rows: np.ndarray
    linked: np.ndarray


def slices(batches: Iterable[pa.RecordBatch], text: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """``batches`` cut so that each holds ``most`` bytes of ``text`` at most, or a single row; empty ones are left out."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield b.slice(at, to - at)
            at = to


def split_words(texts: pa.Array, spaces: bytes, breaks: bytes = b"", lower: bool = False, tails: bytes = b"") -> Words:
    """Maximal runs of bytes that are neither ``spaces`` nor ``breaks`` (white space or punctuation of ASCII).

    A word is linked to the next one of its text if no byte of ``breaks`` lies between them. A byte of
    ``tails`` begins a new word where it follows a letter of ASCII. Null texts have no words. White space
    of ASCII must all be in ``spaces`` or ``breaks``.
    """
    assert set(b" \t\n\x0b\x0c\r") <= set(spaces + breaks)
    parts = [t or b"" for t in texts.cast(pa.large_binary()).to_pylist()]
    joined = b"\n".join([*parts, b""])
    data = np.frombuffer(joined.translate(_LOWER) if lower else joined, np.uint8)
    kind = np.zeros(256, np.int8)
    kind[list(spaces)], kind[list(breaks)] = 1, 2
    flat = kind[data]
    word = flat == 0
    starts = word.copy()
    starts[1:] &= ~word[:-1]
    if tails:
        tail, letter = np.zeros(256, bool), np.zeros(256, bool)
        tail[list(tails)], letter[[*range(65, 91), *range(97, 123)]] = True, True
        starts[1:] |= tail[data[1:]] & letter[data[:-1]]
    starts = np.flatnonzero(starts)
    rows = np.searchsorted(np.cumsum([len(p) + 1 for p in parts]), starts, "right")
    # where the words begin among the bytes of words alone
    kept = data[word]
    offsets = np.zeros(len(starts) + 1, np.int64)
    offsets[:-1] = starts - np.searchsorted(np.flatnonzero(~word), starts)
    offsets[-1] = len(kept)
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(kept)]).dictionary_encode()
    linked = np.zeros(len(starts), bool)
    if breaks:
        piece = np.cumsum(flat == 2, dtype=np.int32)[starts]
        linked[:-1] = (piece[1:] == piece[:-1]) & (rows[1:] == rows[:-1])
    else:
        linked[:-1] = rows[1:] == rows[:-1]
    return Words(found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary.to_pylist(), rows, linked)
