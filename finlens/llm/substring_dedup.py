"""Exact substring dedup behind a count-min prefilter.

A window is ``WINDOW`` consecutive words of one text.  Every window whose word
sequence also starts earlier (smaller id, or the same text further left) is
removed, with all the words it covers; windows are judged on the input.

1. Sketch.  Each partition counts into a count-min sketch; partition sketches
   merge block by block.  A window is counted through its anchor, the
   ``GRAM``-word gram with the smallest hash inside it: equal windows have the
   same anchor at the same offset, so an anchor's count is at least the count
   of any window it stands for, and the sketch's count is at least that.  The
   estimate therefore never falls short, while only about one position in
   seven is counted.  As only "once" or "more often" matters, cells saturate
   at two, and the merged sketch is a bitmap of at most
   ``2 * CELLS / 8`` bytes (32 MB), which is broadcast.  When more than
   ``MAX_LOAD`` of it counts as repeated, it would let most windows through;
   then the anchors are counted in 2**``WIDE_BITS`` cells as a table instead,
   and the texts get the repeated cells of their own anchors by a join.
2. Exact pass.  Windows estimated repeated get a 128-bit hash.  Each chunk of
   a task keeps the earliest occurrence of a window; later ones in the chunk
   are known repeats and leave as runs of starts.  The earliest ones are
   shuffled by hash and ranked.  A window in a third of all texts so sends at
   most one row per chunk, never one per text.
3. Removal.  Starts per text are grouped (bounded by the text) and joined to
   the texts.

Defined results: null and empty texts, and texts shorter than a window, lose
nothing.  Rows that share id and text count as one text and get the same
result; rows with one id and different texts are ordered by a hash of the
text; a null id orders first.  Extra input columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from finlens.llm.store import partitions, pick, save, spare_name
from finlens.llm.textops import U64, Words, mix, ngram_hashes, release_memory, slices

WINDOW, GRAM = 20, 8
CELL_BITS, BLOCK_BITS, DEPTH = 27, 16, 2
CHUNK_WINDOWS = 250_000
MAX_LOAD, WIDE_BITS = 0.2, 44


def _sliding(a: np.ndarray, n: int, op) -> np.ndarray:
    """``op`` (minimum or maximum) over every ``n`` consecutive values."""
    width = 1
    while 2 * width <= n:
        a = op(a[:-width], a[width:])
        width *= 2
    return a if width == n else op(a[:len(a) - (n - width)], a[n - width:])


def anchors(w: Words, h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the anchor of each window, first word of each window)."""
    room = np.maximum(w.counts - window + 1, 0)
    total = int(room.sum())
    if not total:
        return np.empty(0, U64), np.empty(0, np.int64)
    first = np.arange(total) + np.repeat(w.doc_off[:-1] - (np.cumsum(room) - room), room)
    grams, _ = ngram_hashes(h, np.array([0, len(h)]), gram)
    return _sliding(grams, window - gram + 1, np.minimum)[first], first


def _anchor_places(w: Words, h: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Hashes at the positions that are the anchor of some window, one entry
    per position."""
    best, first = anchors(w, h, window, gram)
    if not len(best):
        return best
    grams, _ = ngram_hashes(h, np.array([0, len(h)]), gram)
    span = window - gram + 1
    by_window = np.zeros(len(grams) + span - 1, U64)
    by_window[first + span - 1] = best
    return grams[_sliding(by_window, span, np.maximum) == grams]


def _cells(anchor: np.ndarray, row: int, cell_bits: int) -> np.ndarray:
    return (mix(anchor, 101 + row) >> U64(64 - cell_bits)).astype(np.int64)


def _bit_set(bits: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))


def _has_bit(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 != 0


def _partition_sketch(window: int, gram: int, cell_bits: int, block_bits: int):
    """Per partition: the saturating counts of each touched block, as offsets
    of the cells seen once and more often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            places = np.concatenate(found)
            for row in range(DEPTH):
                cells = np.sort(_cells(places, row, cell_bits))
                head = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
                times = np.diff(np.append(head, len(cells)))
                cells = cells[head]
                blocks = cells >> block_bits
                cut = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1]))
                inside = (cells & ((1 << block_bits) - 1)).astype(np.uint16)
                rows = [(row, int(blocks[a]), inside[a:b][times[a:b] == 1].tobytes(), inside[a:b][times[a:b] > 1].tobytes())
                        for a, b in zip(cut, np.append(cut[1:], len(cells)), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
                     pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.binary())],
                    names=["row", "block", "once", "more"])

        for batch in batches:
            for part in slices(batch, "t"):
                w = Words(part.column("t"))
                places = _anchor_places(w, w.hashes(), window, gram)
                found.append(places)
                size += len(places)
                if size > 4 * CHUNK_WINDOWS:
                    yield from flush()
                    found, size = [], 0
        if size:
            yield from flush()
        found.clear()
        release_memory()

    return run


def _merge_blocks(block_bits: int):
    """Add up the counts of each block, streaming; yields its repeated cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        size = max(1, (1 << block_bits) >> 3)
        for batch in batches:
            for r in batch.to_pylist():
                key = r["row"], r["block"]
                if key not in blocks:
                    blocks[key] = np.zeros(size, np.uint8), np.zeros(size, np.uint8)
                seen, repeated = blocks[key]
                once = np.frombuffer(r["once"], np.uint16).astype(np.int64)
                more = np.frombuffer(r["more"], np.uint16).astype(np.int64)
                _bit_set(repeated, more)
                _bit_set(repeated, once[_has_bit(seen, once)])
                _bit_set(seen, once)
                _bit_set(repeated, more[_has_bit(seen, more)])
                _bit_set(seen, more)
        kept = [(k, v[1].tobytes()) for k, v in blocks.items() if v[1].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k, _ in kept], pa.int32()), pa.array([k[1] for k, _ in kept], pa.int32()),
             pa.array([b for _, b in kept], pa.binary())], names=["row", "block", "repeated"])

    return run


class Sketch:
    """The merged sketch's cells that were counted more than once."""

    def __init__(self, blocks: dict[tuple[int, int], bytes], cell_bits: int, block_bits: int):
        self.blocks, self.cell_bits, self.block_bits = blocks, cell_bits, block_bits
        self._bits: list[np.ndarray] | None = None

    def __getstate__(self):
        return self.blocks, self.cell_bits, self.block_bits

    def __setstate__(self, state):
        self.__init__(*state)

    def load(self) -> float:
        """Share of the cells that count as repeated, in the fuller row."""
        bits = [0] * DEPTH
        for (row, _), raw in self.blocks.items():
            bits[row] += int(np.bitwise_count(np.frombuffer(raw, np.uint8)).sum())
        return max(bits) / (1 << self.cell_bits)

    def repeated(self, anchor: np.ndarray) -> np.ndarray:
        """Whether the estimate of each anchor is two or more."""
        if self._bits is None:
            size = max(1, (1 << self.block_bits) >> 3)
            self._bits = [np.zeros(max(1, (1 << self.cell_bits) >> 3), np.uint8) for _ in range(DEPTH)]
            for (row, block), raw in self.blocks.items():
                self._bits[row][block * size:(block + 1) * size] = np.frombuffer(raw, np.uint8)
            self.blocks = {}  # a worker's copy needs the bits only
        keep = np.ones(len(anchor), bool)
        for row in range(DEPTH):
            at = np.flatnonzero(keep)
            keep[at] = _has_bit(self._bits[row], _cells(anchor[at], row, self.cell_bits))
        return keep


def build_sketch(rows: DataFrame, window: int = WINDOW, gram: int = GRAM, cell_bits: int = CELL_BITS) -> Sketch:
    """Sketch of all windows of column ``t``."""
    block_bits = min(BLOCK_BITS, cell_bits)
    parts = rows.select("t").mapInArrow(
        _partition_sketch(window, gram, cell_bits, block_bits), "row int, block int, once binary, more binary")
    merged = parts.repartition(partitions(rows.sparkSession), "row", "block").mapInArrow(
        _merge_blocks(block_bits), "row int, block int, repeated binary")
    blocks = {(r["row"], r["block"]): bytes(r["repeated"]) for r in merged.collect()}  # bounded by the cells
    return Sketch(blocks, cell_bits, block_bits)


def _wide_cells(anchor: np.ndarray) -> np.ndarray:
    return _cells(anchor, DEPTH, WIDE_BITS)


def _text_cells(window: int, gram: int):
    """Per text: the cells of its anchors, each once, and how many anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                w = Words(part.column("t"))
                h = w.hashes()
                best, first = anchors(w, h, window, gram)
                doc = np.searchsorted(w.doc_off, first, "right") - 1
                # neighbouring windows share the place of their anchor: count places
                _, place = _anchor_at(w, h, best, first, window, gram)
                spot = np.unique(np.stack([doc, _wide_cells(best), place]), axis=1)
                new = np.append(spot.shape[1] > 0, (spot[:2, 1:] != spot[:2, :-1]).any(axis=0))[:spot.shape[1]]
                at = np.flatnonzero(new)
                n = np.diff(np.append(at, spot.shape[1]))
                who = pa.array(spot[0, at])
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(who), part.column("th").take(who), pa.array(spot[1, at]), pa.array(n)],
                    names=["id", "th", "cell", "n"])
        release_memory()

    return run


def _anchor_at(w: Words, h: np.ndarray, best: np.ndarray, first: np.ndarray, window: int, gram: int
               ) -> tuple[np.ndarray, np.ndarray]:
    """The anchors of windows and the word each starts at: the first gram of
    the window with the smallest hash."""
    place = np.full(len(best), -1, np.int64)
    if len(best):
        grams, _ = ngram_hashes(h, np.array([0, len(h)]), gram)
        for k in range(window - gram, -1, -1):
            place = np.where(grams[first + k] == best, first + k, place)
    return best, place


def _with_cells(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """``rows`` (id, th, t) plus ``cells``: the repeated cells of each text."""
    own = save(rows.mapInArrow(_text_cells(window, gram), "id bigint, th bigint, cell bigint, n bigint"), "anchors")
    own = own.distinct()  # repeated rows are one text
    often = save(own.groupBy("cell").agg(F.sum("n").alias("n")).where("n > 1").select("cell"), "repeated-anchors")
    cells = own.join(often, "cell").groupBy("id", "th").agg(F.collect_list("cell").alias("cells"))
    return rows.join(cells, ["id", "th"], "left").select("id", "th", "t", "cells")


def _cells_repeated(part: pa.RecordBatch, doc: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Whether each anchor's cell is among the repeated ones of its text."""
    col = part.column("cells")
    size = pa.compute.fill_null(pa.compute.list_value_length(col), 0).to_numpy()
    known = pa.compute.list_flatten(col).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(part.num_rows), size)
    if not len(known):
        return np.zeros(len(anchor), bool)
    values, number = np.unique(np.concatenate([known, _wide_cells(anchor)]), return_inverse=True)
    pair = np.concatenate([owner, doc]) * len(values) + number
    return np.isin(pair[len(known):], pair[:len(known)])


def _runs(starts: np.ndarray) -> list[int]:
    """Sorted starts as first, length, first, length, ..."""
    cut = np.flatnonzero(np.append(True, starts[1:] != starts[:-1] + 1))
    return np.stack([starts[cut], np.diff(np.append(cut, len(starts)))], 1).ravel().tolist()


_OCCURRENCE = "id bigint, th bigint, h1 bigint, h2 bigint, start int, runs array<int>"


def _occurrences(sketch, window: int, gram: int, chunk: int):
    """Per chunk: one row per window that may be repeated, at its earliest
    place in the chunk; one row per text with its later places as runs."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32())]
    names = ["id", "th", "h1", "h2", "start", "runs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = sketch.value if sketch is not None else None
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            ids, th, h1, h2, start = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((start, th, ids, h1))
            ids, th, h1, h2, start = (c[order] for c in (ids, th, h1, h2, start))
            new = np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))
            lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            same = (ids == ids[lead]) & (th == th[lead]) & (start == start[lead])
            n = int(new.sum())
            for at in range(0, n, 100_000):
                pick_ = np.flatnonzero(new)[at:at + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(c[pick_].view(np.int64)) for c in (ids, th, h1, h2)],
                     pa.array(start[pick_].astype(np.int32)), pa.nulls(len(pick_), kinds[5])], names=names)
            late = np.flatnonzero(~same)
            late = late[np.lexsort((start[late], th[late], ids[late]))]
            if len(late):
                i, t, s = ids[late], th[late], start[late]
                cut = np.flatnonzero(np.append(True, (i[1:] != i[:-1]) | (t[1:] != t[:-1])))
                runs = [_runs(np.unique(s[a:b])) for a, b in zip(cut, np.append(cut[1:], len(s)), strict=True)]
                # keyed by their text, so that the ranking spreads them evenly
                yield pa.RecordBatch.from_arrays(
                    [pa.array(i[cut]), pa.array(t[cut]), pa.array(t[cut]), pa.array(i[cut]),
                     pa.nulls(len(cut), pa.int32()), pa.array(runs, kinds[5])], names=names)

        for batch in batches:
            for part in slices(batch, "t"):
                w = Words(part.column("t"))
                h = w.hashes()
                anchor, first = anchors(w, h, window, gram)
                doc = np.searchsorted(w.doc_off, first, "right") - 1
                keep = filter_.repeated(anchor) if filter_ is not None else _cells_repeated(part, doc, anchor)
                if not keep.any():
                    continue
                h1, _ = ngram_hashes(h, w.doc_off, window)
                h2, _ = ngram_hashes(w.hashes(1), w.doc_off, window, 1)
                first, doc = first[keep], doc[keep]
                ids = part.column("id").to_numpy(zero_copy_only=False)[doc]
                th = part.column("th").to_numpy(zero_copy_only=False)[doc]
                held.append((ids, th, h1[keep], h2[keep], first - w.doc_off[doc]))
                size += len(first)
                if size >= chunk:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()
        held.clear()
        release_memory()

    return run


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = pick(df, id=id_col, t=text_col)
    return rows.select(F.coalesce(F.col("id").cast("bigint"), F.lit(-(1 << 63))).alias("id"),
                       F.xxhash64("t").alias("th"), "t")


def repeated_windows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                     gram: int = GRAM, cell_bits: int = CELL_BITS, chunk: int = CHUNK_WINDOWS) -> DataFrame:
    """Per text that has any: id, th (hash of the text), ``starts`` and
    ``runs`` (first, length, ...) of its windows that also start earlier."""
    rows = _keyed(df, id_col, text_col)
    sketch = build_sketch(rows, window, gram, cell_bits)
    if sketch.load() <= MAX_LOAD:
        shared = df.sparkSession.sparkContext.broadcast(sketch)
        found = rows.mapInArrow(_occurrences(shared, window, gram, chunk), _OCCURRENCE)
    else:
        found = _with_cells(rows, window, gram).mapInArrow(_occurrences(None, window, gram, chunk), _OCCURRENCE)
    order = Window.partitionBy("h1", "h2").orderBy("id", "th", "start")
    late = found.withColumn("place", F.dense_rank().over(order)).where(
        F.col("runs").isNotNull() | (F.col("place") > 1))
    return late.groupBy("id", "th").agg(
        F.collect_list("start").alias("starts"), F.flatten(F.collect_list("runs")).alias("runs"))


def _removed_words(n_words: int, starts, runs, window: int) -> np.ndarray:
    """Per word: whether a removed window covers it."""
    edge = np.zeros(n_words + 1, np.int64)
    if starts is not None and len(starts):
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + window, -1)
    if runs is not None and len(runs):
        first, size = runs[::2], runs[1::2]
        np.add.at(edge, first, 1)
        np.add.at(edge, first + size - 1 + window, -1)
    return np.cumsum(edge[:-1]) > 0


def _cells_of(col: pa.Array):
    """Values per row of an integer list column (None where null)."""
    values, off = np.asarray(col.values), np.asarray(col.offsets)
    valid = np.asarray(col.is_valid())
    return [values[off[i]:off[i + 1]].astype(np.int64) if valid[i] else None for i in range(len(col))]


def _digest(window: int):
    fields = [pa.field("n_words", pa.int64()), pa.field("n_removed", pa.int64()), pa.field("kept_sha256", pa.string())]

    def digest(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for text, starts, runs in batches:
            out = []
            for t, s, r in zip(text, _cells_of(starts), _cells_of(runs), strict=True):
                words = (t.as_py() or "").encode("utf-8").split()
                n = len(words)
                if s is not None:
                    gone = _removed_words(n, s, r, window)
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                out.append((n, n - len(words), hashlib.sha256(b" ".join(words)).hexdigest()))
            yield pa.StructArray.from_arrays([pa.array([o[i] for o in out], f.type) for i, f in enumerate(fields)],
                                             fields=fields)

    return F.arrow_udf(digest, "struct<n_words:bigint,n_removed:bigint,kept_sha256:string>")


def _kept_text(window: int):
    def keep(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for text, starts, runs in batches:
            out = []
            for t, s, r in zip(text, _cells_of(starts), _cells_of(runs), strict=True):
                value = t.as_py()
                if s is not None and value:
                    raw = value.encode("utf-8")
                    w = Words(pa.array([value]))
                    gone = _removed_words(len(w), s, r, window)
                    begin = np.append(0, w.start[1:])
                    stop = np.append(w.start[1:], len(raw))
                    value = b"".join(raw[a:b] for a, b, g in zip(begin, stop, gone, strict=True) if not g
                                     ).decode("utf-8").strip(" \t\n\x0b\x0c\r")
                out.append(value)
            yield pa.array(out, pa.string())

    # evaluated once, whatever is filtered or derived from the text later on
    return F.arrow_udf(keep, "string").asNondeterministic()


def _with_repeats(df: DataFrame, id_col: str, text_col: str, window: int, **options) -> tuple[DataFrame, str, str]:
    """``df`` plus two columns, named as returned: the starts and runs of the
    later windows of each text."""
    late = repeated_windows(df, id_col, text_col, window, **options)
    kid, kth, lid, lth, starts, runs = (spare_name(df, n) for n in ("_kid", "_kth", "_lid", "_lth", "_starts", "_runs"))
    late = late.withColumnsRenamed({"id": lid, "th": lth, "starts": starts, "runs": runs})
    keyed = df.withColumns({
        kid: F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63))), kth: F.xxhash64(text_col)})
    rows = keyed.join(late, (F.col(kid) == F.col(lid)) & (F.col(kth) == F.col(lth)), "left")
    return rows.drop(kid, kth, lid, lth), starts, runs


def dedup_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                 **options) -> DataFrame:
    """id, n_words, n_removed, kept_sha256 (kept words joined by one space)."""
    rows, starts, runs = _with_repeats(
        pick(df, **{id_col: id_col, text_col: text_col}), id_col, text_col, window, **options)
    rows = rows.select(id_col, _digest(window)(text_col, starts, runs).alias("_d"))
    return rows.select(id_col, "_d.n_words", "_d.n_removed", "_d.kept_sha256")


def dedup_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
               **options) -> DataFrame:
    """``df`` with ``text_col`` replaced: removed words go, each with the white
    space after it; all other columns and texts stay as they are."""
    rows, starts, runs = _with_repeats(df, id_col, text_col, window, **options)
    kept: Column = _kept_text(window)(text_col, starts, runs)
    return rows.withColumn(text_col, kept).select(*df.columns)
