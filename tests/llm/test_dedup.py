from __future__ import annotations

import hashlib
import random

import pytest

from finlens.llm import near_dedup as N
from finlens.llm import substring_dedup as S
from finlens.llm.components import components, roots
from finlens.llm.store import save
from tests.llm.helpers import EDGE_TEXTS, DOCS, by_id, documents, lower, with_clashes, words


def shingles(text, n):
    w = words(lower(text))
    if not w:
        return frozenset()
    return frozenset({tuple(w)} if len(w) < n else {tuple(w[i:i + n]) for i in range(len(w) - n + 1)})


def brute_components(texts, n):
    sets = [shingles(t, n) for t in texts]
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            x = len(a & sets[j])
            if x and 100 * x >= 80 * len(a | sets[j]):
                p, q = sorted((root(i), root(j)))
                label[q] = p
    return [root(i) for i in range(len(texts))], [len(s) for s in sets]


def families(seed, groups, most):
    """Texts in groups of edited copies, some at the edge of the threshold."""
    rnd = random.Random(seed)
    vocab = [f"v{i}" for i in range(400)]
    texts = []
    for _ in range(groups):
        base = [rnd.choice(vocab) for _ in range(rnd.randint(3, 120))]
        for _ in range(rnd.randint(1, most)):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, len(w) // 9))):
                k = rnd.randrange(len(w))
                w[k:k + 1] = rnd.choice([[], [rnd.choice(vocab)], [w[k], rnd.choice(vocab)]])
            texts.append(" ".join(w).title() if rnd.random() < 0.3 else " ".join(w))
    rnd.shuffle(texts)
    return texts


@pytest.mark.parametrize(("n", "groups", "most"), [(2, 60, 6), (5, 60, 6), (2, 3, 120)])
def test_components_equal_brute_force(spark, n, groups, most):
    texts = [*EDGE_TEXTS, *families(n + groups, groups, most)]
    want, sizes = brute_components(texts, n)
    got = by_id(N.near_duplicates(with_clashes(documents(spark, texts)), n=n))
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert [got[i].component_id for i in range(len(texts))] == want
    assert all(got[i].kept == (want[i] == i) for i in range(len(texts)))


def test_hot_buckets_by_aggregates(spark):
    """Buckets of more than three nodes settle their hubs by joins."""
    texts = families(11, 8, 40)
    want, _ = brute_components(texts, 2)
    got = by_id(N.near_duplicates(documents(spark, texts), n=2, hot=3))
    assert [got[i].component_id for i in range(len(texts))] == want


@pytest.mark.parametrize("bits", [64, 1 << 16])
def test_texts_are_thinned_out_before_they_are_shuffled(spark, bits):
    """No wanted row is lost, however full the bitmap; a roomy one drops most
    others, and texts of no node under a hub reach no set builder."""
    from pyspark.sql import functions as F

    rows = spark.range(-3000, 3000).select("id", F.xxhash64("id").alias("k"))
    wanted = rows.where("id % 50 = 0")
    left = {r.id for r in N.maybe_in(rows, F.col("k"), wanted.select(F.col("k").alias("w")), F.col("w"), bits).collect()}
    assert {i for i in range(-3000, 3000) if i % 50 == 0} <= left
    assert bits == 64 or len(left) < 200
    texts = families(13, 8, 12)
    want, _ = brute_components(texts, 2)
    got = by_id(N.near_duplicates(documents(spark, texts), n=2, sketch_bits=bits))
    assert [got[i].component_id for i in range(len(texts))] == want


def test_tables_agree_with_their_probability():
    """Band hashes of a pair agree about as often as similarity to the power
    of the band size, in both collections."""
    import numpy as np
    import pyarrow as pa

    base = [f"w{i}" for i in range(2001)]
    texts = [" ".join(base), " ".join([f"x{i}" for i in range(222)] + base[222:])]
    grams, off = N.shingle_sets(pa.array(texts), 2)
    a, b = set(grams[:off[1]].tolist()), set(grams[off[1]:].tolist())
    s = len(a & b) / len(a | b)
    keys = N.band_hashes(grams, off, 200, 3)
    assert abs((keys[0] == keys[1]).mean() - s ** 3) < 0.1
    assert np.all(N.band_hashes(grams[:0], np.zeros(3, int), 4, 3) == 0)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 200)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 140)} == {100} and got[201] == 200
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_roots_of_a_forest(spark):
    parents = [(i, i + 1) for i in range(37)] + [(i, 100) for i in range(50, 80)] + [(100, 200)]
    got = {r.node: r.label for r in roots(spark.createDataFrame(parents, "node bigint, up bigint")).collect()}
    assert {got[i] for i in range(38)} == {37} and {got[i] for i in [*range(50, 80), 100, 200]} == {200} and len(got) == 70
    assert roots(spark.createDataFrame([], "node bigint, up bigint")).collect() == []


def test_trees_of_a_family_are_joined(spark):
    """Links found in a family join the trees of the best hubs, on many
    partitions that nothing merges as on few; narrow tables make few files."""
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(base[:k] + [f"y{k}"] + base[k + 1:]) for k in range(0, 120, 4)]
    texts += [" ".join(base[:60] + [f"z{i}" for i in range(13 + k)] + base[73 + k:]) for k in range(4)] + ["alone here"]
    want, _ = brute_components(texts, 2)
    kept = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for n, merges in ((24, "false"), (8, "true")):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", merges)
            got = N.near_duplicates(documents(spark, texts)).collect()
            assert [r.component_id for r in sorted(got, key=lambda r: r.doc_id)] == list(want)
            counted = spark.range(500).selectExpr("id % 97 AS k").groupBy("k").count()
            saved = save(counted, "test", narrow=True)
            assert saved.count() == 97 and len(saved.inputFiles()) <= 12
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_one_per_group(spark):
    text = "a b c d e f g h i j k l"
    rows = [(3, text, "en", "s", 1), (3, text, "en", "s", 1), (1, text.upper(), "en", "s", 2), (None, "p q r s t u", "en", "s", 1),
            (7, "other words here in this one", "en", "s", 3), (8, None, "en", "s", 0), (8, None, "en", "s", 0)]
    got = N.one_per_group(with_clashes(spark.createDataFrame(rows, DOCS)))
    assert sorted((r.doc_id or -1) for r in got.collect()) == [-1, 1, 7, 8, 8]
    assert got.columns == with_clashes(spark.createDataFrame(rows, DOCS)).columns


def brute_substrings(texts, size):
    """Words of each text that a window with an earlier start elsewhere covers."""
    seen, out = set(), []
    for t in texts:
        w, gone = words(t), set()
        for i in range(len(w) - size + 1):
            key = tuple(w[i:i + size])
            if key in seen:
                gone.update(range(i, i + size))
            seen.add(key)
        out.append((w, gone))
    return out


def repeating(seed):
    rnd = random.Random(seed)
    passages = [[f"p{k}x{i}" for i in range(rnd.randint(15, 60))] for k in range(12)]
    texts = []
    for _ in range(120):
        w = []
        for _ in range(rnd.randint(0, 4)):
            w += [f"u{rnd.randrange(10**6)}" for _ in range(rnd.randint(0, 12))]
            w += rnd.choice(passages) if rnd.random() < 0.8 else ["ab", "cd"] * rnd.randint(1, 40)
        texts.append(rnd.choice([" ", "\n", "  "]).join(w))
    return texts


@pytest.mark.parametrize(("window", "gram", "cell_bits", "chunk"), [(20, 8, 27, 1_000_000), (20, 8, 6, 50), (3, 2, 12, 7)])
def test_substrings_equal_brute_force(spark, window, gram, cell_bits, chunk):
    """Also with a sketch far too small and with tiny chunks: nothing is lost."""
    texts = [*EDGE_TEXTS, *repeating(window)]
    want = brute_substrings(texts, window)
    df = with_clashes(documents(spark, texts)).repartition(5)
    got = by_id(S.dedup_digest(df, window=window, gram=gram, cell_bits=cell_bits, chunk=chunk))
    text = by_id(S.dedup_text(df, window=window, gram=gram, cell_bits=cell_bits, chunk=chunk))
    for i, (w, gone) in enumerate(want):
        kept = [x for k, x in enumerate(w) if k not in gone]
        assert (got[i].n_words, got[i].n_removed) == (len(w), len(gone)), texts[i]
        assert got[i].kept_sha256 == hashlib.sha256(" ".join(kept).encode()).hexdigest()
        assert words(text[i].text) == kept and (gone or text[i].text == texts[i])


@pytest.mark.parametrize(("window", "gram", "chunk"), [(20, 8, 1_000_000), (20, 8, 50), (3, 2, 7)])
def test_anchors_as_a_table(spark, monkeypatch, window, gram, chunk):
    """The way for a sketch that is too full: the same result, and no more
    windows in the exact pass than share an anchor with another."""
    monkeypatch.setattr(S, "MAX_LOAD", -1.0)
    texts = [*EDGE_TEXTS, *repeating(window + 1)]
    want = brute_substrings(texts, window)
    df = with_clashes(documents(spark, texts)).repartition(5)
    got = by_id(S.dedup_digest(df, window=window, gram=gram, chunk=chunk))
    for i, (w, gone) in enumerate(want):
        kept = [x for k, x in enumerate(w) if k not in gone]
        assert (got[i].n_words, got[i].n_removed) == (len(w), len(gone)), texts[i]
        assert got[i].kept_sha256 == hashlib.sha256(" ".join(kept).encode()).hexdigest()
    unique = documents(spark, [" ".join(f"q{k}x{i}" for i in range(60)) for k in range(50)])
    rows = S._with_cells(S._keyed(unique, "doc_id", "text"), window, gram)
    assert rows.where("cells is not null").count() == 0
    long = " ".join(f"w{i}" for i in range(30))
    twice = spark.createDataFrame([(5, long, "en", "s", 1), (5, long, "en", "s", 1), (None, long, "en", "s", 1)], DOCS)
    assert sorted((r.doc_id or 0, r.n_removed) for r in S.dedup_digest(twice).collect()) == [(0, 0), (5, 30), (5, 30)]
    assert S.dedup_digest(documents(spark, [])).collect() == []


def test_a_text_of_a_million_words(spark):
    """Its last thousand words repeat its first, and stand in another text."""
    w = [f"w{i}" for i in range(1_000_000)]
    texts = [" ".join([*w, *w[:1000]]), " ".join(["x", *w[500:600], "y"])]
    got = by_id(S.dedup_digest(documents(spark, texts)))
    assert [(got[i].n_words, got[i].n_removed) for i in (0, 1)] == [(1_001_000, 1000), (102, 100)]
    assert got[1].kept_sha256 == hashlib.sha256(b"x y").hexdigest()


def test_load_of_a_sketch(spark):
    rows = S._keyed(documents(spark, repeating(4)), "doc_id", "text")
    assert S.build_sketch(rows, cell_bits=4).load() > 0.2 > S.build_sketch(rows).load() > 0


def test_repeated_rows_share_a_result(spark):
    long = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(5, long, "en", "s", 1), (5, long, "en", "s", 1), (None, long, "en", "s", 1),
                                (9, long + " end", "en", "s", 1)], DOCS)
    got = sorted((r.doc_id or 0, r.n_removed) for r in S.dedup_digest(df).collect())
    assert got == [(0, 0), (5, 30), (5, 30), (9, 30)]


def test_empty_tables(spark):
    empty = documents(spark, [])
    assert N.near_duplicates(empty).collect() == [] and N.one_per_group(empty).collect() == []
    assert S.dedup_digest(empty).collect() == [] and S.dedup_text(empty).collect() == []


def test_thousands_of_null_ids(spark):
    """Rows without an id, of many texts, meet by their text only."""
    texts = [" ".join(f"n{k % 400}x{i}" for i in range(12)) for k in range(4000)]
    near = [" ".join([f"n{k}x{i}" for i in range(12)] + ["end"]) for k in range(400)]
    rows = [(None, t, "en", "s", 1) for t in texts + near] + [(7, near[0], "en", "s", 1)]
    got = N.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == 4401 and {r.component_id for r in got} == {None, 7}
    assert sum(r.component_id == 7 for r in got) == 10 + 1 + 1
