"""Vectorised word and n-gram hashing over Arrow string batches.

A word is a maximal run of bytes other than space and 0x09-0x0D, i.e. the
pattern ``[^\\x20\\x09-\\x0D]+``; UTF-8 never uses those bytes inside a longer
character, so the byte view and the character view agree.  All texts of a
batch are hashed at once: a polynomial over the bytes modulo 2**64, read off
per word with one ``reduceat``, then mixed.  N-gram hashes combine mixed word
hashes the same way.  Callers slice batches with ``slices`` so that
temporary arrays stay a fixed multiple of ``SLICE_BYTES`` (or of the longest
single text).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18
U64 = np.uint64
_P = U64(0x9E3779B97F4A7C15)
_Q = U64(0xC2B2AE3D27D4EB4F)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def release_memory() -> None:
    """Give freed memory back to the system: Python workers wait for their
    next task with all the memory they ever used."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim:
        trim(0)


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """Avalanche of 64-bit values (splitmix finaliser)."""
    with np.errstate(over="ignore"):
        h = h + U64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: np.uint64):
        self.base, self.inv = base, U64(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, 2 * len(self.up), 1 << 16)
            self.up, self.down = (self._table(b, m) for b in (self.base, self.inv))
        return self.up[:n], self.down[:n]

    @staticmethod
    def _table(base: np.uint64, n: int) -> np.ndarray:
        out = np.full(n, base, U64)
        out[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(out, out=out)
        return out


_BYTE_POWERS, _WORD_POWERS = _Powers(_P), _Powers(_Q)


def text_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    n = len(col)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + n + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into row ranges of about ``limit`` text bytes (one row at
    least); every row of the batch is in exactly one piece."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    end = np.cumsum(size)
    at = 0
    while at < batch.num_rows:
        base = end[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(end, base + limit, "right")))
        yield batch.slice(at, stop - at)
        at = stop


class Words:
    """Words of a slice: ``start``/``end`` byte offsets into ``raw``,
    ``doc_off`` (words of text i are ``doc_off[i]:doc_off[i+1]``)."""

    def __init__(self, col: pa.Array, lower: bool = False):
        raw, off = text_bytes(col)
        self.raw, self.off = (_LOWER[raw] if lower else raw), off
        word = np.zeros(len(raw) + 2, bool)
        word[1:-1] = ~_SPACE[raw]
        begins = word[1:-1] & ~word[:-2]
        ends = word[1:-1] & ~word[2:]
        edge = off[1:-1]
        edge = edge[(edge > 0) & (edge < len(raw))]
        cut = edge[word[edge + 1] & word[edge]]  # a word on both sides of a text boundary
        begins[cut] = True
        ends[cut - 1] = True
        self.word = word[1:-1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.doc_off = np.searchsorted(self.start, off)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.doc_off)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.doc_off) - 1), self.counts)

    def hashes(self, salt: int = 0) -> np.ndarray:
        """64-bit hash per word; equal words get equal hashes in any text."""
        if not len(self.start):
            return np.empty(0, U64)
        up, down = _BYTE_POWERS.get(len(self.raw))
        with np.errstate(over="ignore"):
            part = (self.raw.astype(U64) + U64(1 + 2 * salt)) * up
            part[~self.word] = 0
            total = np.add.reduceat(part, self.start) * down[self.start]
        return mix(total + (self.end - self.start).astype(U64), salt)

    def strings(self) -> pa.Array:
        """The words themselves as a binary Arrow array."""
        n = len(self.start)
        size = self.end - self.start
        offsets = np.zeros(n + 1, np.int64)
        np.cumsum(size, out=offsets[1:])
        packed = self.raw[self.word]
        return pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(packed.tobytes())])


def ngram_hashes(word_hash: np.ndarray, doc_off: np.ndarray, n: int, salt: int = 0
                 ) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``n`` consecutive words inside one text, and the index of
    each n-gram's first word (ascending)."""
    m = len(word_hash)
    room = np.diff(doc_off) - n + 1
    room = np.maximum(room, 0)
    total = int(room.sum())
    if not total:
        return np.empty(0, U64), np.empty(0, np.int64)
    shift = np.repeat(doc_off[:-1] - (np.cumsum(room) - room), room)
    first = np.arange(total, dtype=np.int64) + shift
    up, down = _WORD_POWERS.get(m + 1)
    run = np.zeros(m + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum(word_hash * up[:m], out=run[1:])
        h = (run[first + n] - run[first]) * down[first]
    return mix(h, salt + n), first
