"""Hidden Markov language model: training by Baum-Welch, exact forward scores.

Tokens are lower-cased (A-Z) words and one end per text.  Counts of all
training words come from one aggregation.  The ``VOCABULARY`` most frequent
words are the head: their emissions are broadcast, a table of fixed size.  All
other training words, however many, have emissions of their own as well, in a
distributed table (word, count, share of each state); they reach the texts by
a join.

Texts are kept as symbols in bytes, as few to a symbol as the model needs, and
lifts as bytes, so that rows are copied whole between Spark and Python.

Training: each pass over all training texts runs the scaled forward-backward
recursions over whole texts, many side by side in numpy, the longest together.
In all passes but the last, words outside the head share the emissions of one
of ``TAIL`` spelling classes, so a pass needs no join; expected counts of
transitions, head and classes are summed block by block, in levels of at most
``FAN`` parts, and only the summed model (fixed size) reaches the driver.  The
last pass sums the expected counts of every word in Spark: each word then has
the state shares of its own counts.  Words never seen in training keep their
class.

Scoring: the scaled forward recursion over each whole text gives the exact log
probability of its tokens, every word with its own emissions.  Long texts are
cut at ``LONG`` tokens; later pieces propagate all states at once, and the
pieces' transfer matrices are then multiplied in order, so no step depends on
the longest text alone.

Defined results: null and empty texts are one end token.  Repeated rows are
scored each, and counted each in training.  With no training rows all counts
are 0 and both scores are those of a uniform model over one unknown word.
Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finlens.llm.store import partitions, pick, save
from finlens.llm.textops import U64, Words, mix, release_memory, slices

VOCABULARY, TAIL = 1 << 17, 256
STATES, PASSES = 8, 5
LONG = 4096
SMOOTH = 0.1  # of the base model and of words inside a class
PULL = 1.0  # tokens' worth of the states' shares in what a symbol says of its state
BLOCK = 1 << 13
FAN = 64
_CHUNK_TOKENS = 1 << 19
_SCORE_ROWS = 1000
# words have negative keys; sums that belong to none: symbols from 0, then moves and starts
_WORD, _MOVES = U64(1 << 63), 1 << 30


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) of column ``t``: words of all rows, and the number of ends
    under a null word.  Each batch sends every distinct word once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, words = [], []
            for piece in slices(batch, "t"):
                w = Words(piece.column("t"), lower=True)
                h, first, n = np.unique(w.hashes(), return_index=True, return_counts=True)
                hashes.append((h, n))
                words.append(w.strings().take(pa.array(first)).cast(pa.binary()))
            h = np.concatenate([x[0] for x in hashes]) if hashes else np.empty(0, U64)
            n = np.concatenate([x[1] for x in hashes]) if hashes else np.empty(0, np.int64)
            _, first, group = np.unique(h, return_index=True, return_inverse=True)
            total = np.bincount(group, weights=n, minlength=len(first)).astype(np.int64)
            text = pa.chunked_array(words, pa.binary()).combine_chunks().take(pa.array(first))
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([text, pa.nulls(1, pa.binary())]),
                 pa.array(np.append(total, batch.num_rows))], names=["word", "c"])

    return texts.select("t").mapInArrow(count, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def _tail_class(h: np.ndarray, w: Words, at: np.ndarray, tail: int) -> np.ndarray:
    """Class of words by their last two bytes and length (a property of the
    spelling, so training and scoring agree)."""
    end = w.end[at] - 1
    before = np.maximum(end - 1, w.start[at])
    size = np.minimum(w.end[at] - w.start[at], 24)
    key = w.raw[end].astype(U64) + U64(256) * w.raw[before] + U64(65536) * (size // 4).astype(U64)
    return (mix(key, 3) % U64(tail)).astype(np.int64)


@dataclass
class Vocabulary:
    """Frequent words by hash, and what the base model needs."""

    hashes: np.ndarray  # sorted
    symbol: np.ndarray
    counts: np.ndarray  # by symbol
    ends: int
    total: int
    distinct: int
    tail: int

    @property
    def end_symbol(self) -> int:
        return len(self.counts) + self.tail

    @cached_property
    def _begin(self) -> np.ndarray:
        """Place of the first hash of each group of equal leading bits."""
        bits = (2 * len(self.hashes)).bit_length()
        return np.searchsorted(self.hashes, np.arange(1 << bits, dtype=U64) << U64(64 - bits))

    def places(self, h: np.ndarray) -> np.ndarray:
        """Place of the first of ``hashes`` not below each of ``h`` (the last
        place if none): hashes are spread evenly, so few steps remain from the
        begin of a group."""
        last = len(self.hashes) - 1
        at = np.minimum(self._begin[(h >> U64(65 - len(self._begin).bit_length())).astype(np.int64)], last)
        below = np.flatnonzero(self.hashes[at] < h)
        while len(below):
            below = below[at[below] < last]
            at[below] += 1
            below = below[self.hashes[at[below]] < h[below]]
        return at

    def encode(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words, and which of them are outside."""
        h = w.hashes()
        out = np.zeros(len(h), np.int64)
        known = np.zeros(len(h), bool)
        if len(self.hashes):
            at = self.places(h)
            known = self.hashes[at] == h
            out[known] = self.symbol[at[known]]
        rest = np.flatnonzero(~known)
        out[rest] = len(self.counts) + _tail_class(h, w, rest, self.tail)
        return out.astype(np.int32), ~known


def vocabulary(counts: DataFrame, size: int, tail: int) -> tuple[Vocabulary, np.ndarray]:
    """The vocabulary and the smoothed mass of each tail class.

    Bounded: at most ``size`` rows and one row per class reach the driver.
    """
    top = counts.where("word is not null").orderBy(F.desc("c"), "word").limit(size).toArrow()
    totals = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"),
                        F.sum(F.when(F.col("word").isNull(), F.col("c"))).alias("ends")).first()
    h = Words(top.column("word").cast(pa.string())).hashes()
    order = np.argsort(h)
    vocab = Vocabulary(h[order], order.astype(np.int64), top.column("c").to_numpy().astype(np.int64),
                       totals["ends"] or 0, totals["n"] or 0, totals["v"] if totals["ends"] else 0, tail)

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").drop_null()
            n = batch.column("c").filter(batch.column("word").is_valid()).to_numpy(zero_copy_only=False)
            words = Words(words.cast(pa.string()))
            symbol, outside = vocab.encode(words)
            mass = np.bincount(symbol[outside] - len(vocab.counts), weights=n[outside] + SMOOTH, minlength=tail)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(tail, dtype=np.int32)), pa.array(mass.astype(np.float64))], names=["k", "m"])

    mass = np.full(tail, SMOOTH)
    for r in counts.mapInArrow(classes, "k int, m double").groupBy("k").agg(F.sum("m").alias("m")).collect():
        mass[r["k"]] += r["m"]
    return vocab, mass


_CODES = "key bigint, id bigint, held_out boolean, symbols binary, tail array<bigint>"


def _width(n_symbols: int) -> int:
    """Bytes that hold a symbol."""
    return max(1, -(-(n_symbols - 1).bit_length() // 8))


def _pack(symbols: np.ndarray, off: np.ndarray, width: int) -> pa.Array:
    """Lists of symbols as bytes, ``width`` to a symbol."""
    raw = np.ascontiguousarray(symbols.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :width])
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer((off * width).astype(np.int32)), pa.py_buffer(raw)])


def _bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column without nulls, and their offsets."""
    if not len(col) or col.buffers()[2] is None:
        return np.empty(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    return np.frombuffer(col.buffers()[2], np.uint8)[off[0]:off[-1]], off - off[0]


def _unpack(col: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and offsets of a column that ``_pack`` made."""
    raw, off = _bytes(col)
    out = np.zeros((len(raw) // width, 4), np.uint8)
    out[:, :width] = raw.reshape(-1, width)
    return out.view("<i4").ravel(), off // width


def encoded(docs: DataFrame, vocab) -> DataFrame:
    """Texts (key, id, held_out, t) as symbols with the end; ``tail`` holds the
    hashes of the words outside the head, in the order of the text."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocab.value
        for batch in batches:
            for piece in slices(batch, "t"):
                w = Words(piece.column("t"), lower=True)
                symbols, outside = v.encode(w)
                n = piece.num_rows
                flat = np.insert(symbols, w.doc_off[1:], v.end_symbol)
                off = w.doc_off + np.arange(n + 1)
                at = np.flatnonzero(outside)
                cut = np.searchsorted(w.doc_of()[at], np.arange(n + 1))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("key"), piece.column("id"), piece.column("held_out"),
                     _pack(flat, off, _width(v.end_symbol + 1)),
                     pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array((w.hashes()[at] | _WORD).view(np.int64)))],
                    names=["key", "id", "held_out", "symbols", "tail"])
        release_memory()

    return docs.mapInArrow(encode, _CODES)


@dataclass
class Model:
    start: np.ndarray  # (S,)
    move: np.ndarray  # (S, S)
    emit: np.ndarray  # (symbols, S), float32


def first_model(p: np.ndarray, states: int) -> Model:
    """Corpus distribution, jittered per state by hashes so that states can
    part; states prefer to stay."""
    noise = mix(np.arange(len(p) * states, dtype=U64), 9).reshape(len(p), states)
    emit = p[:, None] * np.exp(noise.astype(np.float64) / 2.0**64 * 4 - 2)
    move = np.full((states, states), 0.2 / max(1, states - 1))
    np.fill_diagonal(move, 0.8 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move, (emit / emit.sum(0)).astype(np.float32))


def _lists(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    off = np.asarray(col.offsets).astype(np.int64)
    return np.asarray(col.values)[off[0]:off[-1]], off - off[0]


def _packed(off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of sequences by falling length, and how many reach each step."""
    size = np.diff(off)
    order = np.argsort(-size, kind="stable")
    reach = np.searchsorted(-size[order], -np.arange(size.max(initial=0)), "left")
    return order, reach


def _forward_backward(symbols: np.ndarray, off: np.ndarray, m: Model):
    """Posterior of the states at each token (rows in the order of ``place``),
    place of each token, expected moves, log10 likelihood.

    Rows are kept step by step (all first tokens, all second ones, ...), so a
    step works on consecutive rows of every array."""
    order, reach = _packed(off)
    s, steps = len(m.start), len(reach)
    at = np.append(0, np.cumsum(reach))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    size = np.diff(off)
    step = np.arange(int(off[-1] - off[0])) - np.repeat(off[:-1] - off[0], size)
    place = at[step] + np.repeat(rank, size)
    by_step = np.empty(len(place), np.int32)
    by_step[place] = symbols[off[0]:off[-1]]
    emit = m.emit[by_step]
    state, inverse = np.empty((len(place), s), np.float32), np.empty((len(place), 1))
    alpha, ones = np.tile(m.start, (len(order), 1)), np.ones((s, 1))
    for t in range(steps):
        n, rows = reach[t], slice(at[t], at[t + 1])
        alpha = alpha[:n] @ m.move if t else alpha
        alpha *= emit[rows].astype(np.float64)
        inverse[rows] = np.reciprocal(alpha @ ones)
        alpha *= inverse[rows]
        state[rows] = alpha
    moves, like = np.zeros((s, s)), -float(np.log10(inverse).sum())
    beta = np.ones((0, s))
    back_move = np.ascontiguousarray(m.move.T)
    for t in range(steps - 1, -1, -1):
        n, rows = reach[t], slice(at[t], at[t + 1])
        if len(beta) < n:
            beta = np.concatenate([beta, np.ones((n - len(beta), s))])
        if t:
            back = emit[rows].astype(np.float64)
            back *= beta
            back *= inverse[rows]
            moves += state[at[t - 1]:at[t - 1] + n].T.astype(np.float64) @ back
        state[rows] *= beta.astype(np.float32)
        if t:
            beta = back @ back_move
    return state, by_step, place, moves * m.move, like


def expected_counts(symbols: np.ndarray, off: np.ndarray, first: np.ndarray, m: Model):
    """Baum-Welch counts of sequences ``symbols[off[i]:off[i+1]]``: starts
    (of those flagged ``first``), moves, emissions, log10 likelihood."""
    state, ids, place, moves, like = _forward_backward(symbols, off, m)
    begin = place[off[:-1] - off[0]] if len(place) else np.empty(0, np.int64)
    return state[begin[first]].sum(0, dtype=np.float64), moves, ids, state, like


def _chunks(off: np.ndarray) -> Iterator[np.ndarray]:
    """Texts by falling length, in groups of about ``_CHUNK_TOKENS`` tokens:
    long texts keep each other company."""
    size = np.diff(off)
    order = np.argsort(-size, kind="stable")
    end = np.cumsum(size[order])
    a = 0
    while a < len(order):
        base = end[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(end, base + _CHUNK_TOKENS, "right")))
        yield order[a:b]
        a = b


def _taken(values: np.ndarray, off: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists ``values[off[r]:off[r+1]]`` of some rows, and their offsets."""
    size = np.diff(off)[rows]
    cut = np.append(0, np.cumsum(size))
    return values[np.arange(cut[-1]) + np.repeat(off[rows] - cut[:-1], size)], cut


def _segments(off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of pieces of at most ``size``, and which are first."""
    n = np.diff(off)
    pieces = -(-n // size)
    first = np.repeat(np.cumsum(pieces) - pieces, pieces)
    k = np.arange(int(pieces.sum())) - first
    return np.append(np.repeat(off[:-1], pieces) + k * size, off[-1]), k == 0


class _Sums:
    """A task's expected counts of symbols, moves and starts."""

    def __init__(self, m: Model):
        self.m, (self.n, self.s) = m, m.emit.shape
        self.emit = np.zeros((self.n, self.s))
        self.starts, self.moves, self.like = np.zeros(self.s), np.zeros((self.s, self.s)), 0.0

    def add(self, symbols: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count some texts; the state posteriors and each token's row in them."""
        state, ids, place, moves, like = _forward_backward(symbols, off, self.m)
        for k in range(self.s):
            self.emit[:, k] += np.bincount(ids, weights=state[:, k], minlength=self.n)
        self.starts += state[place[off[:-1] - off[0]]].sum(0, dtype=np.float64)
        self.moves += moves
        self.like += like
        return state, place


def _summed_blocks(parts: DataFrame, levels: int) -> DataFrame:
    """Rows (b, part, x) added up by block, in levels of at most ``FAN`` parts
    of a block, so no task reads more than that many parts of one."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            keys = zip(batch.column("b").to_pylist(), batch.column("part").to_pylist(), strict=True)
            for key, x in zip(keys, batch.column("x"), strict=True):
                part = np.frombuffer(x.as_buffer(), np.float64 if key[0] < 0 else np.float32).astype(np.float64)
                if key in total:
                    total[key] += part
                else:
                    total[key] = part
        rows = [(b, p, (v if b < 0 else v.astype(np.float32)).tobytes()) for (b, p), v in total.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
             pa.array([r[2] for r in rows], pa.binary())], names=["b", "part", "x"])

    while levels > 1:
        levels = -(-levels // FAN)
        parts = parts.withColumn("part", (F.col("part") % levels).cast("int"))
        parts = parts.repartition(partitions(parts.sparkSession) * levels, "b", "part").mapInArrow(add_up, "b int, part int, x binary")
    return parts


def baum_welch_pass(codes: DataFrame, model: Model, tasks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts of all training texts under ``model``; ``codes`` has
    ``tasks`` partitions."""
    spark = codes.sparkSession
    shared = spark.sparkContext.broadcast(model)
    n_symbols, s = model.emit.shape

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, used = _Sums(shared.value), False
        for batch in batches:
            symbols, off = _unpack(batch.column("symbols"), _width(n_symbols))
            for rows in _chunks(off):
                sums.add(*_taken(symbols, off, rows))
                used = True
        if used:
            blocks = [(-1, np.concatenate([[sums.like], sums.starts, sums.moves.ravel()]).tobytes())]
            for b in range(0, n_symbols, BLOCK):
                part = sums.emit[b:b + BLOCK]
                if part.any():
                    blocks.append((b, part.astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in blocks], pa.int32()),
                                              pa.array([x for _, x in blocks], pa.binary())], names=["b", "x"])
        release_memory()

    parts = codes.select("symbols").mapInArrow(expect, "b int, x binary")
    summed = _summed_blocks(parts.withColumn("part", F.spark_partition_id()), max(2, tasks))
    emit, small = np.zeros((n_symbols, s)), np.zeros(1 + s + s * s)
    for r in summed.collect():  # one row per block
        if r["b"] < 0:
            small = np.frombuffer(r["x"], np.float64)
        else:
            emit[r["b"]:r["b"] + BLOCK] = np.frombuffer(r["x"], np.float32).reshape(-1, s)
    shared.unpersist()
    return small[1:1 + s], small[1 + s:].reshape(s, s), emit, float(small[0])


def word_expectations(codes: DataFrame, model: Model, vocab: Vocabulary) -> DataFrame:
    """(h, n, g0, g1, ...): occurrences and expected counts by state of every
    training word outside the head (h its hash), of the symbols (h from 0),
    of the moves from each state and of the starts (h from ``_MOVES``).  A batch
    sends every distinct word once."""
    shared = codes.sparkSession.sparkContext.broadcast(model)
    n_symbols, s = model.emit.shape
    low, high = len(vocab.counts), len(vocab.counts) + vocab.tail
    names = ["h", "n", *[f"g{k}" for k in range(s)]]

    def rows(h, n, g) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(h.astype(np.int64)), pa.array(n.astype(np.int64)), *[pa.array(g[:, k].astype(np.float32)) for k in range(s)]],
            names=names)

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, used = _Sums(shared.value), False
        for batch in batches:
            symbols, off = _unpack(batch.column("symbols"), _width(n_symbols))
            tail, cut = _lists(batch.column("tail"))
            words, number = np.unique(tail, return_inverse=True)
            total = np.zeros((len(words), s))
            for text in _chunks(off):
                flat, ends = _taken(symbols, off, text)
                state, place = sums.add(flat, ends)
                own = state[place[(flat >= low) & (flat < high)]]
                who, _ = _taken(number, cut, text)
                for k in range(s):
                    total[:, k] += np.bincount(who, weights=own[:, k], minlength=len(words))
                used = True
            if len(words):
                yield rows(words, np.bincount(number, minlength=len(words)), total)
        if used:
            seen = np.flatnonzero(sums.emit.any(axis=1))
            yield rows(seen, np.zeros(len(seen)), sums.emit[seen])
            yield rows(_MOVES + np.arange(s + 1), np.zeros(s + 1), np.concatenate([sums.moves, sums.starts[None]]))
        release_memory()

    found = codes.select("symbols", "tail").mapInArrow(
        expect, "h bigint, n bigint, " + ", ".join(f"g{k} float" for k in range(s)))
    return found.groupBy("h").agg(F.sum("n").alias("n"), *[F.sum(f"g{k}").cast("float").alias(f"g{k}") for k in range(s)])


def _shares(emit: np.ndarray) -> np.ndarray:
    """The states' shares of all tokens."""
    return (emit.sum(0) + 1) / (emit.sum() + emit.shape[1])


def _stepped(starts: np.ndarray, moves: np.ndarray, emit: np.ndarray) -> Model:
    return Model((starts + 1) / (starts + 1).sum(), (moves + 1) / (moves + 1).sum(1, keepdims=True),
                 (emit / emit.sum(0)).astype(np.float32))


def train(codes: DataFrame, p: np.ndarray, states: int, passes: int, tasks: int) -> Model:
    """Baum-Welch passes from the corpus distribution ``p`` of the symbols."""
    model = first_model(p, states)
    for _ in range(passes):
        starts, moves, emit, _ = baum_welch_pass(codes, model, tasks)
        share = _shares(emit)
        # P(state | symbol), drawn to the states' shares; by Bayes an unseen
        # symbol keeps its corpus probability in every state
        of = (emit + PULL * share) / (emit.sum(1, keepdims=True) + PULL)
        model = _stepped(starts, moves, p[:, None] * of / share)
    return model


@dataclass
class Final:
    """The last model: head, classes (of words never seen) and end as symbols;
    a word outside the head with count n and lifts r (P(state | word) over the
    states' shares) has the emissions ``(n + SMOOTH) * r * per_word``."""

    model: Model
    per_word: np.ndarray


def finish(sums: DataFrame, vocab: Vocabulary, states: int) -> tuple[Final, DataFrame]:
    """The final model from ``word_expectations``, and the table (h, n, r) of
    the words outside the head (r: the lifts' bytes)."""
    inner = F.col("h") >= 0
    n_symbols = vocab.end_symbol + 1
    emit, moves = np.zeros((n_symbols, states)), np.zeros((states + 1, states))
    for batch in sums.where(inner).drop("n").toArrow().to_batches():  # a row per symbol and state
        h = batch.column("h").to_numpy()
        g = np.stack([batch.column(f"g{k}").to_numpy(zero_copy_only=False) for k in range(states)], 1).astype(np.float64)
        emit[h[h < n_symbols]] = g[h < n_symbols]
        moves[h[h >= _MOVES] - _MOVES] = g[h >= _MOVES]
    share = _shares(emit)
    k = len(vocab.counts)
    # a class stands for its one unseen word
    own = np.concatenate([vocab.counts + SMOOTH, np.full(vocab.tail, SMOOTH), [vocab.ends + SMOOTH]])
    lift = (emit + PULL * share) / (emit.sum(1, keepdims=True) + PULL) / share
    part = own[:, None] * lift
    pull = PULL * share
    own_words = sums.where(~inner)
    total = own_words.agg(*[F.coalesce(F.sum((F.col("n") + SMOOTH) * (
        (F.col(f"g{i}") + F.lit(float(pull[i]))) / (F.col("n") + F.lit(PULL)) / F.lit(float(share[i]))).cast("float")),
        F.lit(0.0)).alias(f"t{i}") for i in range(states)]).first()

    def lifts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy(zero_copy_only=False)[:, None]
            g = np.stack([batch.column(f"g{i}").to_numpy(zero_copy_only=False) for i in range(states)], 1).astype(np.float64)
            r = ((g + pull) / (n + PULL) / share).astype("<f4")
            ends = np.arange(len(n) + 1, dtype=np.int32) * (4 * states)
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("n"), pa.Array.from_buffers(
                pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(r)])], names=["h", "n", "r"])

    words = own_words.mapInArrow(lifts, "h bigint, n bigint, r binary")
    norm = part.sum(0) + np.array([total[f"t{i}"] for i in range(states)])
    model = Model((moves[states] + 1) / (moves[states] + 1).sum(), (moves[:states] + 1) / (moves[:states] + 1).sum(1, keepdims=True),
                  (part / norm).astype(np.float32))
    return Final(model, 1 / norm), words


def log10_forward(symbols: np.ndarray, off: np.ndarray, m: Model, long: int = LONG) -> np.ndarray:
    """Exact log10 probability of each sequence."""
    s = len(m.start)
    cut, first = _segments(off, long)
    out = np.zeros(len(off) - 1)
    text = np.searchsorted(off, cut[:-1], "right") - 1
    # first pieces carry the start distribution, later ones every unit vector
    rows = np.where(first, 1, s)
    row0 = np.cumsum(rows) - rows
    piece = np.repeat(np.arange(len(first)), rows)
    init = np.tile(m.start, (len(piece), 1))
    unit = np.flatnonzero(~first[piece])
    init[unit] = np.eye(s)[(unit - row0[piece[unit]])]
    size = np.diff(cut)[piece]
    order = np.argsort(-size, kind="stable")
    reach = np.searchsorted(-size[order], -np.arange(size.max(initial=0)), "left")
    begin, opens = cut[:-1][piece][order], first[piece][order]
    alpha, log, ones = init[order], np.zeros(len(order)), np.ones((s, 1))
    for t, n in enumerate(reach):
        a = alpha[:n] @ m.move
        if not t:
            a = np.where(opens[:n, None], alpha[:n], a)
        a *= m.emit[symbols[begin[:n] + t]].astype(np.float64)
        c = a @ ones
        np.divide(a, c, out=alpha[:n])
        log[:n] += np.log10(c[:, 0])
    final, logs = np.empty_like(alpha), np.empty_like(log)
    final[order], logs[order] = alpha, log
    one = np.flatnonzero(first)
    out[text[one]] = logs[row0[one]]
    state = {int(text[i]): final[row0[i]] for i in one[np.isin(text[one], text[~first])]}
    for i in np.flatnonzero(~first):
        k, r = int(text[i]), slice(row0[i], row0[i] + s)
        top = logs[r].max()
        v = (state[k] * 10 ** (logs[r] - top)) @ final[r]
        out[k] += top + np.log10(v.sum())
        state[k] = v / v.sum()
    return out


def _score(vocab, final):
    """Per text: tokens, known tokens, sum of log10 (count + SMOOTH), forward
    score.  ``found`` holds, for the places of ``tail`` whose word is known,
    place and count in one number, and the word's lifts."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, f = vocab.value, final.value
        k, states = len(v.counts), len(f.per_word)
        c = np.concatenate([v.counts, np.zeros(v.tail), [v.ends]])
        head_base, head_known = np.log10(c + SMOOTH), (c > 0).astype(np.int64)
        for batch in (b.slice(i, _SCORE_ROWS) for b in batches for i in range(0, b.num_rows, _SCORE_ROWS)):
            symbols, off = _unpack(batch.column("symbols"), _width(len(c)))
            symbols = symbols.astype(np.int64)
            outside = np.flatnonzero((symbols >= k) & (symbols < k + v.tail))
            cut = np.append(0, np.cumsum(batch.column("n_tail").to_numpy()))
            col = batch.column("found")
            rows = np.repeat(np.arange(batch.num_rows), pa.compute.fill_null(pa.compute.list_value_length(col), 0).to_numpy())
            flat = pa.compute.list_flatten(col)
            place_n = flat.field("pn").to_numpy(zero_copy_only=False)
            n = (place_n & 0xFFFFFFFF).astype(np.float64)
            lift = _bytes(flat.field("r"))[0].view("<f4").reshape(-1, states)
            at = outside[cut[rows] + (place_n >> 32)]
            base, known = head_base[symbols], head_known[symbols]
            base[at], known[at] = np.log10(n + SMOOTH), 1
            symbols[at] = len(c) + np.arange(len(at))
            own = ((n + SMOOTH)[:, None] * lift * f.per_word).astype(np.float32)
            m = Model(f.model.start, f.model.move, np.concatenate([f.model.emit, own]))
            like = log10_forward(symbols, off, m)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("held_out"), pa.array(np.diff(off)), pa.array(np.add.reduceat(known, off[:-1])),
                 pa.array(np.add.reduceat(base, off[:-1])), pa.array(like)],
                names=["id", "held_out", "n_tokens", "n_known", "base", "score"])
        release_memory()

    return score


def scores(df: DataFrame, training, id_col: str = "doc_id", text_col: str = "text", vocabulary_size: int = VOCABULARY,
           tail: int = TAIL, states: int = STATES, passes: int = PASSES) -> DataFrame:
    """id, held_out (not ``training``), n_tokens, n_known, train_tokens,
    base_score, score for every row; ``training`` is a condition on ``id``."""
    spark = df.sparkSession
    sc = spark.sparkContext
    docs = pick(df, id=id_col, t=text_col).select(F.col("id").cast("bigint").alias("id"), "t")
    docs = docs.withColumn("held_out", ~F.coalesce(training, F.lit(False)))
    counts = save(word_counts(docs.where(~F.col("held_out"))), "word-counts", codec="zstd")
    vocab, mass = vocabulary(counts, vocabulary_size, tail)
    p = np.concatenate([vocab.counts + SMOOTH, mass, [vocab.ends + SMOOTH]])
    shared = sc.broadcast(vocab)
    codes = save(encoded(docs.select(F.monotonically_increasing_id().alias("key"), "id", "held_out", "t"), shared), "codes",
                 codec="zstd")
    # a task sends its sums once, whatever it reads: two tasks a core, not one per file
    learn = codes.where(~F.col("held_out")).coalesce(2 * sc.defaultParallelism)
    tasks = 2 * sc.defaultParallelism
    model = train(learn, p / p.sum(), states, passes - 1, tasks)
    final, words = finish(save(word_expectations(learn, model, vocab), "word-expectations", codec="zstd"), vocab, states)

    placed = codes.select("key", F.posexplode("tail").alias("place", "h")).join(words, "h")
    pn = F.shiftleft(F.col("place").cast("bigint"), 32).bitwiseOR(F.col("n"))
    # flat rows travel, lists are made where they arrive
    placed = placed.select("key", pn.alias("pn"), "r").repartition("key")
    found = placed.groupBy("key").agg(F.collect_list(F.struct("pn", "r")).alias("found"))
    rows = codes.select("key", "id", "held_out", "symbols", F.size("tail").alias("n_tail")).join(found, "key", "left")
    rows = rows.select("id", "held_out", "symbols", "n_tail", "found").mapInArrow(
        _score(shared, sc.broadcast(final)),
        "id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double")
    floor = float(np.log10(vocab.total + SMOOTH * (vocab.distinct + 1)))
    return rows.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", "n_known",
        F.lit(vocab.total).cast("bigint").alias("train_tokens"),
        (F.col("base") - F.lit(floor) * F.col("n_tokens")).alias("base_score"), "score")
