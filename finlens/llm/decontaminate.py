"""Benchmark decontamination by SimHash over item-sized windows.

For every benchmark item of L words, the windows of L consecutive words of
every text (a shorter text is one window) are compared on 5-word shingles:

1. Bound.  Similarity 0.8 needs a window to hold 8/9 as many benchmark
   shingles as the mean of both sizes; running counts of positions whose
   shingle occurs in any item (a bitmap, then a sorted search) rule out all
   other windows without loss.
2. Fingerprints.  The remaining windows get a 64-bit SimHash of their
   shingles, each numbered by its occurrence in the window: the sets of
   (shingle, number) have the weighted Jaccard similarity of the shingles, and
   a repeated one moves no bit more than others do.
3. Multi-index.  Fingerprints are cut into ``RADIUS + 1`` blocks.  Two
   fingerprints within ``RADIUS`` bits agree in at least one block, so looking
   up every block among the items of that length finds all of them; the exact
   Hamming distance follows.
4. Verification.  Weighted Jaccard similarity of the full shingle counts,
   sum of minima over sum of maxima, must reach the threshold.

The benchmark is cut into parts of at most ``ITEMS_PER_PASS`` items and
``BYTES_PER_PASS`` bytes by id order.  The driver fetches one part at a time,
and its broadcast is released when the results of that part are written, so
any number of items works in bounded memory.  Texts are never shuffled.

Defined results: null or empty texts hit nothing; null, empty or wordless
items are passed over; an empty benchmark hits nothing; items shorter than a
shingle match as one whole sequence; repeated texts or items each count.
Letters A-Z are lower-cased.  Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finlens.llm.store import TEXT_ROWS, pick, save, spare_name
from finlens.llm.textops import U64, Words, mix, ngram_hashes, release_memory, slices

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 20
ITEMS_PER_PASS, BYTES_PER_PASS = 20_000, 8 << 20
_FILTER_BITS = 24
_EPS = 1e-9


def simhash(grams: np.ndarray, off: np.ndarray) -> np.ndarray:
    """64-bit SimHash of each segment ``grams[off[i]:off[i+1]]`` (none empty);
    a repeated gram weighs as often as it occurs."""
    bits = np.unpackbits(mix(grams, 77).view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1
    total = np.add.reduceat(bits, off[:-1], axis=0)
    return np.packbits(total > 0, axis=1).view(U64).ravel()


def numbered(grams: np.ndarray, off: np.ndarray) -> np.ndarray:
    """``grams`` with the later occurrences of a gram in its segment told
    apart: hashes of (gram, number), the gram itself for the first."""
    segment = np.repeat(np.arange(len(off) - 1), np.diff(off))
    order = np.lexsort((grams, segment))
    g, s = grams[order], segment[order]
    again = np.append(False, (g[1:] == g[:-1]) & (s[1:] == s[:-1]))[:len(g)]
    at = np.arange(len(g))
    number = at - np.maximum.accumulate(np.where(again, 0, at))
    out = grams.copy()
    out[order[again]] = mix(g[again] ^ mix(number[again].astype(U64), 78), 79)
    return out


def _blocks(prints: np.ndarray, radius: int) -> list[np.ndarray]:
    """Values of the ``radius + 1`` blocks the 64 bits are cut into."""
    edges = np.linspace(0, 64, radius + 2).astype(int)
    return [(prints >> U64(a)) & U64((1 << int(b - a)) - 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]


@dataclass
class _Length:
    """Items of one length."""

    words: int
    size: int  # words of a shingle
    index: np.ndarray  # item numbers
    prints: np.ndarray
    blocks: list[tuple[np.ndarray, np.ndarray]]  # sorted values, order


class Items:
    """Searchable part of a benchmark."""

    def __init__(self, rows: list[tuple], similarity: float = SIMILARITY, radius: int = RADIUS,
                 shingle: int = SHINGLE):
        self.similarity, self.radius = similarity, radius
        w = Words(pa.array([r[1] for r in rows], pa.large_string()), lower=True)
        h = w.hashes()
        self.ids = [r[0] for r in rows]
        self.grams: list[np.ndarray | None] = [None] * len(rows)
        by_length: dict[int, list[int]] = {}
        for i, (a, b) in enumerate(zip(w.doc_off[:-1], w.doc_off[1:], strict=True)):
            if b > a:
                size = min(shingle, int(b - a))
                self.grams[i], _ = ngram_hashes(h[a:b], np.array([0, b - a]), size)
                by_length.setdefault(int(b - a), []).append(i)
        self.lengths = [self._length(n, min(shingle, n), np.array(who)) for n, who in sorted(by_length.items())]
        self.known = {}
        for size in {x.size for x in self.lengths}:
            values = np.unique(np.concatenate([self.grams[i] for x in self.lengths if x.size == size for i in x.index]))
            bitmap = np.zeros(1 << _FILTER_BITS, bool)
            bitmap[(values >> U64(64 - _FILTER_BITS)).astype(np.int64)] = True
            self.known[size] = values, bitmap

    def _length(self, words: int, size: int, who: np.ndarray) -> _Length:
        sets = [self.grams[i] for i in who]
        off = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        prints = simhash(numbered(np.concatenate(sets), off), off)
        blocks = []
        for values in _blocks(prints, self.radius):
            order = np.argsort(values, kind="stable")
            blocks.append((values[order], order))
        return _Length(words, size, who, prints, blocks)

    def _marks(self, grams: np.ndarray, size: int) -> np.ndarray:
        values, bitmap = self.known[size]
        out = bitmap[(grams >> U64(64 - _FILTER_BITS)).astype(np.int64)]
        at = np.flatnonzero(out)
        found = np.minimum(np.searchsorted(values, grams[at]), len(values) - 1)
        out[at] = values[found] == grams[at]
        return out

    def _near(self, prints: np.ndarray, length: _Length) -> tuple[np.ndarray, np.ndarray]:
        """(window, item place) pairs within the radius."""
        pairs = [np.empty(0, np.int64)]
        for values, (sorted_, order) in zip(_blocks(prints, self.radius), length.blocks, strict=True):
            lo, hi = np.searchsorted(sorted_, values), np.searchsorted(sorted_, values, "right")
            n = hi - lo
            total = int(n.sum())
            if total:
                window = np.repeat(np.arange(len(prints)), n)
                place = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
                pairs.append(window * len(order) + order[place])
        pair = np.unique(np.concatenate(pairs))
        window, place = pair // len(length.index), pair % len(length.index)
        apart = np.bitwise_count(prints[window] ^ length.prints[place])
        near = apart <= self.radius
        return window[near], place[near]

    def hits(self, col: pa.Array) -> dict[int, list[tuple]]:
        """text number -> [(item id, first word, words, similarity)], the best
        window per item, leftmost among equals."""
        w = Words(col, lower=True)
        h = w.hashes()
        best: dict[tuple[int, int], tuple] = {}
        marks = {}
        for size in self.known:
            grams, first = ngram_hashes(h, w.doc_off, size)
            mark = self._marks(grams, size)
            if mark.any():
                doc = np.searchsorted(w.doc_off, first[mark], "right") - 1
                marks[size] = grams, first, np.concatenate([[0], np.cumsum(mark)]), np.unique(doc)
        for length in self.lengths:
            if length.size in marks:
                self._length_hits(length, w, *marks[length.size], best)
        out: dict[int, list[tuple]] = {}
        for (doc, item), (score, at, n) in sorted(best.items()):
            out.setdefault(doc, []).append((self.ids[item], -at, n, score))
        return out

    def _length_hits(self, length, w, grams, first, running, docs, best) -> None:
        item_size = length.words - length.size + 1
        # windows of texts that hold any benchmark shingle, as gram ranges
        place = np.searchsorted(first, w.doc_off)  # grams before each text
        room = place[docs + 1] - place[docs]
        count = np.where(room > 0, np.maximum(room - item_size + 1, 1), 0)
        total = int(count.sum())
        if not total:
            return
        begin = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(place[docs], count)
        size = np.repeat(np.minimum(room, item_size), count)
        doc = np.repeat(docs, count)
        held = running[begin + size] - running[begin]
        share = self.similarity / (1 + self.similarity)
        keep = held >= share * (size + item_size) - _EPS
        begin, size, doc = begin[keep], size[keep], doc[keep]
        if not len(begin):
            return
        off = np.concatenate([[0], np.cumsum(size)])
        inside = np.arange(off[-1]) - np.repeat(off[:-1] - begin, size)
        window, place_ = self._near(simhash(numbered(grams[inside], off), off), length)
        for x, i in zip(window.tolist(), length.index[place_].tolist(), strict=True):
            mine, theirs = grams[begin[x]:begin[x] + size[x]], self.grams[i]
            score = weighted_jaccard(mine, theirs)
            if score >= self.similarity - _EPS:
                d = int(doc[x])
                found = (score, -int(first[begin[x]] - w.doc_off[d]), int(size[x]) + length.size - 1)
                if (d, i) not in best or found > best[d, i]:
                    best[d, i] = found


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of the smaller counts over sum of the larger counts."""
    values, n_a = np.unique(a, return_counts=True)
    other, n_b = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(values, other, assume_unique=True, return_indices=True)
    shared = int(np.minimum(n_a[i], n_b[j]).sum())
    return shared / (len(a) + len(b) - shared)


_HIT = pa.struct([("item_id", pa.int64()), ("first_word", pa.int64()), ("n_words", pa.int64()),
                  ("similarity", pa.float64())])
_HITS_DDL = "array<struct<item_id:bigint,first_word:bigint,n_words:bigint,similarity:double>>"


def _search(part):
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        items = part.value
        for col in batches:
            for piece in slices(pa.record_batch([col], ["t"]), "t"):
                found = items.hits(piece.column(0))
                yield pa.array([[dict(zip(("item_id", "first_word", "n_words", "similarity"), h, strict=True))
                                 for h in found.get(i, [])] for i in range(piece.num_rows)], pa.list_(_HIT))
        release_memory()

    # else the planner may run the search once more to drop rows without hits
    return F.arrow_udf(search, _HITS_DDL).asNondeterministic()


def bounded_parts(benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text",
                  items_per_pass: int = ITEMS_PER_PASS, bytes_per_pass: int = BYTES_PER_PASS) -> Iterator[list[tuple]]:
    """The benchmark's (item, text) rows in id order, in parts of at most
    ``items_per_pass`` items and ``bytes_per_pass`` text bytes (one item at
    least).  The driver holds one part at a time."""
    items = pick(benchmark, item=item_col, t=item_text_col).where("t is not null").orderBy("item", "t")
    rows: list[tuple] = []
    size = 0
    for r in items.toLocalIterator():
        own = len(r["t"].encode("utf-8", "surrogatepass"))
        if rows and (len(rows) == items_per_pass or size + own > bytes_per_pass):
            yield rows
            rows, size = [], 0
        rows.append((r["item"], r["t"]))
        size += own
    if rows:
        yield rows


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       similarity: float = SIMILARITY, radius: int = RADIUS, shingle: int = SHINGLE, **bounds) -> DataFrame:
    """One row per text and item found in it: id, item_id, first_word,
    n_words, similarity.  A benchmark of one part is a plan; of several, the
    hits of each part are written before the next part is fetched."""
    rows, found, part = pick(docs, _id=id_col, _t=text_col), [], None
    sc = docs.sparkSession.sparkContext

    def pairs(hits: Column) -> DataFrame:
        return rows.select(F.col("_id").alias(id_col), hits.alias("_h")).select(id_col, F.inline("_h"))

    for items in bounded_parts(benchmark, **bounds):
        if part is not None:
            found.append(save(pairs(_search(part)(F.col("_t"))), "benchmark-hits", TEXT_ROWS))
            part.unpersist()
        part = sc.broadcast(Items(items, similarity, radius, shingle))
    found.append(pairs(_search(part)(F.col("_t")) if part is not None else F.array().cast(_HITS_DDL)))
    return reduce(DataFrame.unionByName, found)


def without_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", similarity: float = SIMILARITY,
                 radius: int = RADIUS, shingle: int = SHINGLE, **bounds) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; what each part of
    a large benchmark leaves is written before the next."""
    name, left = spare_name(docs, "_hits"), docs
    sc, part = docs.sparkSession.sparkContext, None
    for rows in bounded_parts(benchmark, **bounds):
        if part is not None:
            left = save(left, "not-in-benchmark", TEXT_ROWS)
            part.unpersist()
        part = sc.broadcast(Items(rows, similarity, radius, shingle))
        left = left.withColumn(name, _search(part)(F.col(text_col))).where(F.size(name) == 0).select(*docs.columns)
    return left
