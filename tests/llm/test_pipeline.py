from __future__ import annotations

from collections import Counter

import corpus_pipeline as P
from finlens.llm.queries import ORACLES, QUERIES
from tests.llm.helpers import EDGE_TEXTS, documents, with_clashes, words
from tests.llm.test_decontaminate import brute
from tests.llm.test_dedup import brute_components, brute_substrings, families


def corpus(spark, small_dir):
    """Documents of the table with odd rows of our own between them."""
    table = spark.read.parquet(f"{small_dir}/documents.parquet")
    bench = [r.text for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").orderBy("item_id").collect()]
    texts = [r.text for r in table.orderBy("doc_id").limit(60).collect()]
    texts += ["the of and in " + t for t in texts[:5]] + [f"the of and {bench[k]}" for k in (0, 3)]
    return documents(spark, texts, source=[f"s{i % 4}" for i in range(len(texts))]), texts, bench


def test_stages_equal_brute_force(spark, small_dir):
    """Each stage on its own input against a plain version of it."""
    docs, texts, bench = corpus(spark, small_dir)
    docs = with_clashes(docs.unionByName(documents(spark, EDGE_TEXTS).withColumnRenamed("doc_id", "d").selectExpr(
        "d + 1000 doc_id", "text", "lang", "source", "n_chars")), but=("source",))
    columns = docs.columns
    stages = dict(P.STAGES)

    def run(name, df):
        out = stages[name](spark, df, small_dir)
        if name != P.STAGES[-1][0]:
            assert out.columns == columns
        rows = sorted(out.collect(), key=lambda r: r["doc_id"])
        return out, rows

    kept, rows = run("language_id", docs)
    ids = {r.doc_id for r in rows}
    assert not ids & {1000, 1001, 1002, 1006} and ids >= set(range(60))

    before = sorted(kept.collect(), key=lambda r: r["doc_id"])
    kept, rows = run("near_dedup", kept)
    group, _ = brute_components([r.text for r in before], 5)
    assert [r.doc_id for r in rows] == [r.doc_id for i, r in enumerate(before) if group[i] == i]

    before = rows
    kept, rows = run("substring_dedup", kept)
    want = [(r.doc_id, [w for k, w in enumerate(ws) if k not in gone])
            for r, (ws, gone) in zip(before, brute_substrings([r.text for r in before], 20), strict=True)]
    assert [(r.doc_id, words(r.text)) for r in rows] == [x for x in want if x[1]]
    assert all(r.n_chars == len(r.text) for r in rows)

    before = rows
    kept, rows = run("decontamination", kept)
    leaks = {d for d, _ in brute([r.text for r in before], bench)}
    assert leaks and [r.doc_id for r in rows] == [r.doc_id for i, r in enumerate(before) if i not in leaks]

    size = Counter({r.doc_id: len(words(r.text)) for r in rows})
    _, rows = run("source_mix", kept)
    assert {r.doc_id: r.size for r in rows} == size and all(r.taken <= 3 * r.size for r in rows)


def test_near_groups_lose_all_but_one(spark):
    texts = families(9, 12, 5)
    group, _ = brute_components(texts, 5)
    out = P.near_duplicates(spark, documents(spark, texts), "")
    assert sorted(r.doc_id for r in out.collect()) == [i for i, g in enumerate(group) if g == i]


def test_run_and_empty_tables(spark, small_dir, tmp_path):
    rows = P.run(spark, small_dir).collect()
    assert 0 < len(rows) <= 200 and len({r.doc_id for r in rows}) == len(rows)
    documents(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert P.run(spark, str(tmp_path)).collect() == []


def test_repeats_nulls_and_clashes_through_all_stages(spark, small_dir, tmp_path):
    """Copies under several ids, repeated rows and null ids leave one row each;
    texts without a letter go."""
    table = spark.read.parquet(f"{small_dir}/documents.parquet").limit(40)
    text = table.where("length(text) > 400").first().text
    own = "the of and this is a document of its own with words that no other document here has at all to be kept"
    rows = [(900, text), (901, text), (901, text), (None, own), (None, own), (902, None), (903, "1234 ½"), (904, "")]
    odd = spark.createDataFrame([(i, t, None, None, None) for i, t in rows],
                                "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs = with_clashes(table.select(*odd.columns).unionByName(odd), but=("source",))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{small_dir}/benchmark.parquet").limit(0).write.parquet(str(tmp_path / "benchmark.parquet"))
    got = [r.doc_id for r in P.run(spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and not {900, 901, 902, 903, 904} & set(got) and None in got


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
