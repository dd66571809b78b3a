from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from finlens.llm import mixing as M
from tests.llm.helpers import EDGE_TEXTS, by_id, documents, with_clashes, words


def fill(sizes, weights=(1, 2, 3), cap=3):
    """Targets by repeated sharing of the excess."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s]}
        if not over:
            return {s: share.get(s, cap * sizes[s]) for s in names}
        capped |= over


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 1000, "b": 1, "c": 10, None: 300}, {"a": 5}, {"a": 0, "b": 7},
    {"z": 900, "Z": 20, "é": 3, "b": 0, None: 40, "c": 60, "d": 5000},
])
def test_targets_fill_up_to_the_caps(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size bigint")
    got = {r.source: r.target for r in M.targets(df, (1, 2, 3), 3).collect()}
    assert got == pytest.approx(fill(sizes))


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 64, 1001):
        rows = spark.range(n).select(M.permuted(F.col("id"), F.lit(n).cast("bigint"), F.lit("k"), F.lit(3)).alias("p"))
        values = [r.p for r in rows.collect()]
        assert sorted(values) == list(range(n))
    assert values != list(range(1001))


def sample(spark):
    sizes = [("src0", 4000), ("src1", 300), ("src2", 40), (None, 900), ("tiny", 2)]
    texts, source = list(EDGE_TEXTS[:9]), ["src1"] * 9
    for s, n in sizes:
        while n > 0:
            k = min(n, 1 + (n * 7919) % 61)
            texts.append(" ".join(f"w{n}x{i}" for i in range(k)))
            source.append(s)
            n -= k
    return texts, source, with_clashes(documents(spark, texts, source=source), but=("source",))


def test_mix_meets_targets_and_limits(spark):
    texts, source, df = sample(spark)
    rows = M.taken(M.plan_mix(df)).collect()
    got = {r.id: r for r in rows}
    sizes = Counter()
    for t, s in zip(texts, source, strict=True):
        sizes[s] += len(words(t))
    want, taken = fill(dict(sizes)), Counter()
    assert len(rows) == len(texts)
    for i, (t, s) in enumerate(zip(texts, source, strict=True)):
        r = got[i]
        assert (r.size, r.source_size) == (len(words(t)), sizes[s]) and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 5 * t ** 0.5 + 3, s
    again = {r.id: r.taken for r in M.taken(M.plan_mix(df.repartition(7))).collect()}
    assert again == {i: r.taken for i, r in got.items()}


@pytest.mark.parametrize("times", [1, 40])
def test_blocks_have_one_length_at_every_size(spark, times):
    """Every piece is a whole block but a source's last; each source is within
    two blocks of its target."""
    sizes = {"big": 3000 * times + 5, "mid": 500 * times, "small": 70, "tiny": 3}
    texts = [" ".join(f"w{i}" for i in range(n)) for n in sizes.values()]
    mix = M.plan_mix(documents(spark, texts, source=list(sizes)))
    for r in M.mixed(mix).collect():
        left = sizes[r.source] - r.from_word
        assert (r.from_word, r.n_words) == (M.BLOCK_WORDS * r.block, min(M.BLOCK_WORDS, left))
    want = fill(sizes)
    for r in M.taken(mix).collect():
        assert abs(r.taken - want[r.source]) <= 2 * M.BLOCK_WORDS


def test_shards_vary_as_draws_do(spark):
    _, _, df = sample(spark)
    mix = M.plan_mix(df)
    counts = Counter((r.shard, r.source) for r in mix.slots.collect())
    assert len({n for (shard, s), n in counts.items() if s == "src0"}) > 1


def test_mixed_pieces_are_the_words_taken(spark):
    _, _, df = sample(spark)
    mix = M.plan_mix(df)
    total = Counter()
    for r in M.mixed(mix).collect():
        total[r.id] += r.n_words
    assert dict(total) == {r.id: r.taken for r in M.taken(mix).collect() if r.taken}


def test_edges(spark):
    assert M.taken(M.plan_mix(documents(spark, []))).collect() == []
    rows = M.taken(M.plan_mix(documents(spark, [None, "", None], source=[None, "a", "a"]))).collect()
    assert [(r.size, r.taken, r.target) for r in rows] == [(0, 0, 0.0)] * 3
    same = documents(spark, ["a b c d e f"] * 4).withColumn("doc_id", F.lit(1))
    rows = M.taken(M.plan_mix(same)).collect()
    assert len(rows) == 4 and sum(r.taken for r in rows) > 0


def test_no_python_in_the_plan(spark, small_dir):
    from finlens.llm.queries import QUERIES

    plan = QUERIES["op9_source_mix"](spark, small_dir)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


def test_stepwise_permutation_equals_the_expression(spark):
    from pyspark.sql import functions as F

    df = spark.range(1000).select(F.col("id"), F.lit(7).alias("_n"), F.lit("x").alias("_partner"))
    n = F.lit(1000).cast("bigint")
    both = M.with_permuted(df.withColumn("want", M.permuted(F.col("id"), n, F.lit(20), F.lit("slots"))), "got", F.col("id"), n,
                           F.lit(20), F.lit("slots"))
    rows = both.collect()
    assert both.columns == ["id", "_n", "_partner", "want", "got"]
    assert all(r.want == r.got for r in rows) and sorted(r.got for r in rows) == list(range(1000))


def test_the_mix_itself_holds_what_is_taken(spark, small_dir):
    """The output's pieces over the whole table: each slot is one block, the
    words of a document's pieces are those it reports as taken, and no piece
    leaves its document."""
    mix = M.plan_mix(spark.read.parquet(f"{small_dir}/documents.parquet"))
    taken = {r.id: r for r in M.taken(mix).collect()}
    pieces = M.mixed(mix).collect()
    got = Counter()
    for p in pieces:
        assert 0 <= p.from_word and p.n_words > 0 and p.from_word + p.n_words <= taken[p.id].size
        got[p.id] += p.n_words
    assert {i: r.taken for i, r in taken.items() if r.taken} == dict(got)
    slots = Counter((p.shard, p.source, p.block) for p in pieces)
    assert len(slots) > 100 and max(Counter(p.shard for p in pieces).values()) >= M.SHARD_SLOTS


def test_the_draw_recomputed(spark):
    """Counts per shard and the blocks of every slot, recomputed from the
    permutations alone."""
    texts = [" ".join(f"w{i}" for i in range(40 + 7 * k)) for k in range(60)]
    docs = documents(spark, texts, source=[f"s{k % 5}" if k % 7 else None for k in range(60)])
    mix = M.plan_mix(docs)
    sources = sorted(mix.sources.collect(), key=lambda s: s.place)
    n = -int(-sum(s.n_slots for s in sources) // 1)
    place = {r.id: r.p for r in spark.range(n).select("id", M.permuted(
        F.col("id"), F.lit(n).cast("bigint"), F.lit(20), F.lit("slots")).alias("p")).collect()}
    edges, total = [], sum(s.n_slots for s in sources)
    for s in sources:
        edges.append((edges[-1][1] if edges else 0.0, (edges[-1][1] if edges else 0.0) + s.n_slots / total, s))
    drawn = Counter()
    for i in range(n):
        u = (place[i] + 0.5) / n
        owner = [s for lo, hi, s in edges if lo <= u < hi] or [edges[-1][2]]
        drawn[i // M.SHARD_SLOTS, owner[0].source] += 1
    got = mix.slots.collect()
    assert Counter((r.shard, r.source) for r in got) == drawn
    for s in sources:
        mine = [r for r in got if r.source == s.source]
        blocks = Counter(r.block for r in mine)
        full, rest = divmod(len(mine), s.n_blocks)
        # whole epochs take every block once more, the last one some of them
        assert set(blocks) <= set(range(s.n_blocks)) and sum(blocks.values()) == len(mine)
        assert set(blocks.values()) <= {full, full + 1} and sum(v == full + 1 for v in blocks.values()) in (rest, s.n_blocks)
