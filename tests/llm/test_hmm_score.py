from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from finlens.llm import hmm_score as H
from finlens.llm.queries import QUERIES
from tests.llm.helpers import EDGE_TEXTS, by_id, documents, lower, with_clashes, words


def model(seed, states=3, symbols=11):
    r = np.random.default_rng(seed)
    return H.Model(r.dirichlet(np.ones(states)), r.dirichlet(np.ones(states), states),
                   r.dirichlet(np.ones(symbols), states).T.astype(np.float32))


def sequences(seed, sizes, symbols=11):
    r = np.random.default_rng(seed)
    seqs = [r.integers(0, symbols, n) for n in sizes]
    return seqs, np.concatenate(seqs), np.concatenate([[0], np.cumsum(sizes)])


def forward(m, s):
    a = [m.start * m.emit[s[0]].astype(float)]
    for x in s[1:]:
        a.append((a[-1] @ m.move) * m.emit[x])
    return a


@pytest.mark.parametrize("long", [1, 4, 7, 4096])
def test_forward_is_exact_however_texts_are_cut(long):
    seqs, flat, off = sequences(1, [1, 2, 5, 13, 30, 7, 1])
    m = model(2)
    want = [math.log10(forward(m, s)[-1].sum()) for s in seqs]
    assert H.log10_forward(flat, off, m, long) == pytest.approx(want, abs=1e-9)


def test_expected_counts_equal_brute_force():
    seqs, flat, off = sequences(3, [4, 1, 9, 2, 17])
    m = model(4)
    starts, moves, ids, gamma, like = H.expected_counts(flat, off, np.ones(5, bool), m)
    emit = np.zeros_like(m.emit, dtype=float)
    np.add.at(emit, ids, gamma)
    s0, t0, e0, l0 = np.zeros(3), np.zeros((3, 3)), np.zeros(emit.shape), 0.0
    for s in seqs:
        a = forward(m, s)
        b = [np.ones(3)]
        for x in s[:0:-1]:
            b.insert(0, m.move @ (m.emit[x] * b[0]))
        z = a[-1].sum()
        l0 += math.log10(z)
        s0 += a[0] * b[0] / z
        for t, x in enumerate(s):
            e0[x] += a[t] * b[t] / z
            if t:
                t0 += np.outer(a[t - 1], m.emit[x] * b[t]) * m.move / z
    assert np.allclose(starts, s0) and np.allclose(moves, t0) and np.allclose(emit, e0) and like == pytest.approx(l0)


def base(texts, held):
    tokens = [[*words(lower(t)), None] for t in texts]
    c = Counter(x for w, h in zip(tokens, held, strict=True) if not h for x in w)
    n, v = sum(c.values()), len(c)
    return [(len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
            for w in tokens]


@pytest.mark.parametrize(("size", "tail"), [(1 << 17, 256), (3, 4)])
def test_base_scores_equal_brute_force(spark, size, tail):
    """Also with almost every word outside the vocabulary."""
    texts = [*EDGE_TEXTS, "the cat sat", "The dog sat", "unseen words only", "the the the"]
    held = [i % 4 == 3 for i in range(len(texts))]
    got = by_id(H.scores(with_clashes(documents(spark, texts)), F.col("id") % 4 != 3, vocabulary_size=size, tail=tail,
                         states=2, passes=1))
    for i, (n, known, total, score) in enumerate(base(texts, held)):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], n, known, total)
        assert r.base_score == pytest.approx(score) and r.score < 0
    assert got[9].score == got[10].score if held[9] == held[10] else True


def test_model_is_a_distribution_over_tokens(spark):
    """All one-token continuations of the vocabulary, classes and unknowns add
    up to one in every state."""
    docs = documents(spark, ["a b a c", "b c d"]).selectExpr("text t")
    vocab, mass = H.vocabulary(H.word_counts(docs), 2, 5)
    p = np.concatenate([vocab.counts + H.SMOOTH, mass, [vocab.ends + H.SMOOTH]])
    assert H.first_model(p / p.sum(), 4).emit.sum(0) == pytest.approx(np.ones(4), abs=1e-5)
    assert mass.sum() == pytest.approx(5 * H.SMOOTH + (2 + H.SMOOTH) + (1 + H.SMOOTH))


def test_training_helps_held_out_texts(spark, small_dir):
    rows = QUERIES["op4_hmm_score"](spark, small_dir).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 200 and {r.held_out for r in rows} == {True, False}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0) for r in rows)
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_no_rows_and_no_training_rows(spark):
    assert H.scores(documents(spark, []), F.lit(True), states=2, passes=1).collect() == []
    got = by_id(H.scores(documents(spark, ["a b", None]), F.lit(False), states=2, passes=1))
    assert (got[0].n_tokens, got[0].n_known, got[0].train_tokens) == (3, 0, 0)
    assert got[0].base_score == pytest.approx(0.0) and got[1].base_score == pytest.approx(0.0)


def plain_counts(m, s):
    """Starts, moves and per-token posteriors of one sequence of emissions."""
    a = [m[0] * s[0]]
    for e in s[1:]:
        a.append((a[-1] / a[-1].sum()) @ m[1] * e)
    a = [x / x.sum() for x in a]
    b = [np.ones(len(m[0]))]
    for e in s[:0:-1]:
        b.insert(0, m[1] @ (e * b[0]))
        b[0] /= b[0].max()
    gamma = [x * y / (x * y).sum() for x, y in zip(a, b, strict=True)]
    moves = np.zeros_like(m[1])
    for t in range(1, len(s)):
        x = np.outer(a[t - 1], s[t] * b[t]) * m[1]
        moves += x / x.sum()
    return gamma[0], moves, gamma


def brute_scores(texts, held, head_size, classes, states, passes):
    """The whole model in plain loops: classes in all passes but the last,
    then every training word by its own expected counts."""
    tokens = [[*words(lower(t)), None] for t in texts]
    learn = [w for w, h in zip(tokens, held, strict=True) if not h]
    c = Counter(x for w in learn for x in w)
    top = sorted((x for x in c if x is not None), key=lambda x: (-c[x], x.encode()))[:head_size]

    def class_of(word):
        w = H.Words(pa.array([word]))
        return int(H._tail_class(w.hashes(), w, np.array([0]), classes)[0])

    spelled = {x: class_of(x) for w in tokens for x in w if x is not None}
    k = len(top)
    symbol = {x: top.index(x) if x in top else k + spelled[x] for x in spelled} | {None: k + classes}
    mass = np.full(classes, 0.1)
    for x in c:
        if x is not None and x not in top:
            mass[spelled[x]] += c[x] + 0.1
    p = np.concatenate([[c[x] + 0.1 for x in top], mass, [c[None] + 0.1]])
    first = H.first_model(p / p.sum(), states)
    p /= p.sum()
    m = (first.start, first.move, first.emit.astype(float))
    for last in range(passes):
        starts, moves, emit = np.zeros(states), np.zeros((states, states)), np.zeros((len(p), states))
        own = {x: np.zeros(states) for x in c}
        for w in learn:
            s0, mv, gamma = plain_counts(m, [m[2][symbol[x]] for x in w])
            starts, moves = starts + s0, moves + mv
            for x, g in zip(w, gamma, strict=True):
                emit[symbol[x]] += g
                own[x] += g
        share = (emit.sum(0) + 1) / (emit.sum() + states)
        of = (emit + H.PULL * share) / (emit.sum(1, keepdims=True) + H.PULL)
        start, move = (starts + 1) / (starts + 1).sum(), (moves + 1) / (moves + 1).sum(1, keepdims=True)
        e = p[:, None] * of / share
        m = (start, move, e / e.sum(0))
        if last == passes - 1:
            word = {x: (c[x] + 0.1) * (own[x] + H.PULL * share) / (c[x] + H.PULL) / share for x in c}
            unseen = 0.1 * of[k:k + classes] / share
            norm = sum(word.values()) + unseen.sum(0)
            m = (start, move, {x: v / norm for x, v in word.items()})
            unseen = unseen / norm
    out = []
    for w in tokens:
        e = [m[2][x] if x in m[2] else unseen[spelled[x]] for x in w]
        a, log = m[0] * e[0], 0.0
        for x in e[1:]:
            log += math.log10(a.sum())
            a = (a / a.sum()) @ m[1] * x
        out.append(log + math.log10(a.sum()))
    assert np.allclose(sum(m[2].values()) + unseen.sum(0), 1)  # over words, ends and unseen spellings
    return out


@pytest.mark.parametrize(("head", "classes", "states", "passes"), [(3, 4, 2, 3), (1000, 4, 3, 2), (5, 2, 2, 1), (2, 3, 1, 2)])
def test_scores_equal_brute_force(spark, head, classes, states, passes):
    """Whole texts, most words outside the head, some never seen."""
    import random

    rnd = random.Random(head)
    vocab = [f"{'ab'[i % 2]}{i}{'xyz'[i % 3]}" for i in range(60)]
    texts = [" ".join(vocab[min(59, int(rnd.expovariate(0.08)))] for _ in range(rnd.choice([1, 3, 20, 700]))) for _ in range(40)]
    texts += ["a1y zz new never", "", None, "A1Y a1y", "a1y"]
    held = [i % 4 == 3 for i in range(len(texts))]
    df = documents(spark, texts).repartition(5)
    got = by_id(H.scores(df, F.col("id") % 4 != 3, vocabulary_size=head, tail=classes, states=states, passes=passes))
    want = brute_scores(texts, held, head, classes, states, passes)
    for i, score in enumerate(want):
        assert got[i].score == pytest.approx(score, rel=2e-5, abs=2e-5), texts[i]


def test_sums_in_levels(spark, monkeypatch):
    """Hundreds of parts of a block, added up a few at a time."""
    monkeypatch.setattr(H, "FAN", 3)
    rows = [(b, p, (np.arange(4) + p).astype(np.float64 if b < 0 else np.float32).tobytes()) for b in (-1, 0, 8192) for p in range(100)]
    df = spark.createDataFrame(rows, "b int, part int, x binary").repartition(7)
    got = {r.b: np.frombuffer(r.x, np.float64 if r.b < 0 else np.float32).tolist() for r in H._summed_blocks(df, 100).collect()}
    assert got == {b: [4950.0 + 100 * i for i in range(4)] for b in (-1, 0, 8192)}


def test_null_ids(spark):
    rows = [(None, "a b c", "en", "s", 1), (None, "a b c", "en", "s", 1), (3, "a", "en", "s", 1)]
    got = H.scores(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"),
                   F.lit(True), states=2, passes=2, vocabulary_size=1, tail=2).collect()
    assert len(got) == 3 and len({r.score for r in got if r.doc_id is None}) == 1


def test_places_equal_a_binary_search():
    r = np.random.default_rng(5)
    for n in (1, 2, 3, 1000):
        hashes = np.unique(np.append(r.integers(0, 2**64, n, np.uint64), np.uint64(2**64 - 1) if n == 3 else np.uint64(7)))
        v = H.Vocabulary(hashes, np.arange(len(hashes)), np.ones(len(hashes)), 1, 1, 1, 4)
        h = np.concatenate([hashes, r.integers(0, 2**64, 3000, np.uint64), np.array([0, 2**64 - 1], np.uint64)])
        assert (v.places(h) == np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)).all()


@pytest.mark.parametrize("n_symbols", [1, 2, 256, 257, 65536, 131329, 1 << 24])
def test_symbols_take_no_more_bytes_than_they_need(n_symbols):
    width = H._width(n_symbols)
    assert 256 ** (width - 1) < max(2, n_symbols) <= 256**width
    symbols, off = np.array([0, n_symbols - 1, 0, n_symbols // 2], np.int32), np.array([0, 1, 1, 4])
    col = H._pack(symbols, off, width)
    assert col.nbytes <= 4 * width + 16
    for part, want in ((col, symbols), (col.slice(1), symbols[1:]), (col.slice(3), symbols[:0])):
        got, ends = H._unpack(part, width)
        assert got.tolist() == want.tolist() and ends[-1] == len(want) and len(ends) == len(part) + 1
