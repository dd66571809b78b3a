from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from finlens.llm import decontaminate as D
from finlens.llm.textops import mix
from tests.llm.helpers import DOCS, EDGE_TEXTS, documents, lower, with_clashes, words

ITEMS = "item_id bigint, text string"


def grams(w, n=5):
    n = min(n, len(w))
    return [tuple(w[i:i + n]) for i in range(len(w) - n + 1)] if w else []


def brute(texts, items):
    """(doc, item): best (similarity, -first word) over item-sized windows."""
    out = {}
    for d, t in enumerate(texts):
        w = words(lower(t))
        for i, item in enumerate(items):
            v = words(lower(item))
            if not w or not v:
                continue
            n = min(5, len(v))
            if len(w) < n:
                continue
            b, g, size = Counter(grams(v)), [tuple(w[k:k + n]) for k in range(len(w) - n + 1)], len(v) - n + 1
            for k in range(max(1, len(g) - size + 1)):
                a = Counter(g[k:k + size])
                x = sum((a & b).values())
                s = x / (sum(a.values()) + sum(b.values()) - x)
                if s >= 0.8 - 1e-9:
                    out[d, i] = max(out.get((d, i), (0, 0)), (s, -k))
    return out


def planted(seed):
    rnd = random.Random(seed)
    items = [" ".join(f"q{rnd.randrange(3000)}" for _ in range(rnd.randint(2, 60))) for _ in range(40)] + [None, "", "  "]
    texts = []
    for _ in range(150):
        w = [f"z{rnd.randrange(5000)}" for _ in range(rnd.randint(0, 80))]
        if rnd.random() < 0.6:
            item = words(rnd.choice(items[:40]))
            for _ in range(rnd.randint(0, 2)):  # edits at the edge hurt least
                k = rnd.choice([0, len(item) - 1, rnd.randrange(len(item))])
                item[k] = "edit"
            at = rnd.randint(0, len(w))
            w[at:at] = [x.upper() for x in item] if rnd.random() < 0.3 else item
        texts.append(" ".join(w))
    return texts, items


@pytest.mark.parametrize("per_pass", [20_000, 7])
def test_pairs_equal_brute_force(spark, per_pass):
    texts, items = planted(4)
    texts = [*EDGE_TEXTS, *texts]
    want = brute(texts, items)
    bench = spark.createDataFrame(list(enumerate(items)), ITEMS)
    rows = D.contaminated_pairs(with_clashes(documents(spark, texts)), with_clashes(bench, but=("text",)),
                                items_per_pass=per_pass).collect()
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), -r.first_word) for r in rows}
    assert len(got) == len(rows) > 30 and got == {k: (round(s, 9), at) for k, (s, at) in want.items()}


def test_blocks_find_everything_within_the_radius():
    rnd = np.random.default_rng(5)
    items = D.Items([(i, " ".join(f"w{i}x{k}" for k in range(20))) for i in range(50)])
    length = items.lengths[0]
    flips = np.array([sum(1 << int(b) for b in rnd.choice(64, rnd.integers(0, 30), replace=False)) for _ in range(3000)],
                     np.uint64)
    prints = length.prints[rnd.integers(0, 50, 3000)] ^ flips
    window, place = items._near(prints, length)
    apart = np.bitwise_count(prints[:, None] ^ length.prints[None])
    assert set(zip(window.tolist(), place.tolist(), strict=True)) == set(
        zip(*map(np.ndarray.tolist, np.nonzero(apart <= D.RADIUS)), strict=True))


def test_simhash_weighs_by_count():
    g = mix(np.arange(40, dtype=np.uint64), 1)
    heavy = np.concatenate([np.repeat(g[:1], 100), g])
    prints = D.simhash(np.concatenate([heavy, g[:1], g]), np.array([0, len(heavy), len(heavy) + 1, len(heavy) + 41]))
    assert np.bitwise_count(prints[0] ^ prints[1]) == 0 < np.bitwise_count(prints[2] ^ prints[1])


def test_runs_of_repeated_words_are_found():
    """Similarity 0.8, where the item's own part is one shingle five times."""
    heads = [" ".join(f"a{i}x{k}" for k in range(40)) for i in range(200)]
    items = D.Items([(i, t + " z" * 9) for i, t in enumerate(heads)])
    texts = [t + " z" * 4 + "".join(f" b{i}x{k}" for k in range(5)) for i, t in enumerate(heads)]
    got = items.hits(pa.array(texts))
    assert {i: [(h[0], round(h[3], 9)) for h in x] for i, x in got.items()} == {i: [(i, 0.8)] for i in range(200)}


def test_numbered_grams():
    g = np.array([7, 7, 5, 7, 5, 7], np.uint64)
    a = D.numbered(g, np.array([0, 4, 6]))
    assert list(a[[0, 2, 4, 5]]) == [7, 5, 5, 7] and len(set(a[:4].tolist())) == 4
    assert len(D.numbered(g[:0], np.array([0]))) == 0


def test_empty_tables(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g")], ITEMS)
    none = spark.createDataFrame([], ITEMS)
    assert D.contaminated_pairs(documents(spark, []), bench).collect() == []
    assert D.contaminated_pairs(documents(spark, ["a b c d e f g"]), none).collect() == []
    assert D.contaminated_pairs(documents(spark, ["x a b c d e f g y"] * 2), bench).count() == 2


def test_parts_are_bounded_by_items_and_bytes(spark):
    items = [(i, "w " * (1 + 400 * (i == 3))) for i in range(10)] + [(None, "no id"), (11, None)]
    bench = spark.createDataFrame(items, ITEMS)
    assert [len(p) for p in D.bounded_parts(bench, items_per_pass=4)] == [4, 4, 3]
    parts = list(D.bounded_parts(bench, bytes_per_pass=100))
    assert sum(map(len, parts)) == 11 and [len(p) for p in parts if any(r[0] == 3 for r in p)] == [1]
    assert list(D.bounded_parts(bench.where("false"))) == []


@pytest.mark.parametrize("per_pass", [20_000, 7])
def test_clean_documents_stay(spark, per_pass):
    texts, items = planted(6)
    leaks = {d for d, _ in brute(texts, items)}
    docs = with_clashes(documents(spark, texts))
    left = D.without_hits(docs, spark.createDataFrame(list(enumerate(items)), ITEMS), items_per_pass=per_pass)
    assert left.columns == docs.columns and leaks
    assert sorted(r.doc_id for r in left.collect()) == [i for i in range(len(texts)) if i not in leaks]
    rows = spark.createDataFrame([(None, items[0], "en", "s", 1), (None, "clean words only here", "en", "s", 1)], DOCS)
    assert [r.text for r in D.without_hits(rows, spark.createDataFrame([(0, items[0])], ITEMS)).collect()] == ["clean words only here"]
