from __future__ import annotations

from collections import Counter

import pytest

from finlens.llm import quality_ledger as L
from finlens.llm import url_filter as U
from finlens.llm.queries import URL_RULES
from tests.llm.helpers import EDGE_TEXTS, by_id, documents, with_clashes, words

PAGES = "page_id bigint, url string, html string"


def judge(spark, urls, **options):
    df = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], PAGES)
    return by_id(U.judge_urls(with_clashes(df), **options), "page_id")


def test_hosts_paths_and_rules(spark):
    got = judge(spark, [
        "https://WWW.Example.com/en/1?q#f", "http://a.example.com/en/x", "http://example.com", "http://x.net/es/",
        "http://anet/es/", "http://net/fr/a", "no scheme/en/", None, "", "a://b?c/d", "http://x.com/",
    ], rules=URL_RULES)
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(11)] == [
        ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("a.example.com", "/en/x", "example.com/en/", "block"),
        ("example.com", "", None, "allow"),
        ("x.net", "/es/", "net/es/", "block"),
        ("anet", "/es/", None, "allow"),
        ("net", "/fr/a", "net/fr/", "block"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("b", "", None, "allow"), ("x.com", "/", "com/", "allow"),
    ]


def test_terms_need_boundaries_and_soft_terms_add_up(spark):
    got = judge(spark, [
        "http://casino.org/", "http://casinos.org/", "http://x.org/CASINO-1", "http://cheap.org/", "http://cheap.org/free",
        "http://cheap.org/cheap", "http://x.org/sexton-essex", "http://x.org/éporn",
    ])
    assert [got[i].verdict for i in range(8)] == [
        "block", "allow", "block", "allow", "block", "allow", "allow", "block"]
    assert (got[4].n_strict, got[4].n_soft) == (0, 2)


def test_empty_pages(spark):
    assert U.judge_urls(spark.createDataFrame([], PAGES), rules=URL_RULES).collect() == []


def brute(text):
    w = words(text)
    spans = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    n = Counter(spans)
    covered = {i + k for i, s in enumerate(spans) if n[s] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_measures_equal_brute_force(spark):
    texts = [*EDGE_TEXTS, "a b c d e\na b c d e\n\n \nx", "# $ % a|b <c>\n\v\f a b c d e a b c d e f", "é\u00a0b"]
    got = by_id(L.evaluate(with_clashes(documents(spark, texts))))
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t), t
    assert got[0].fail_mask == 1 and got[8].fail_mask & 2


def test_policies_and_ablations(spark):
    df = documents(spark, ["a b", "# " * 50 + "a b c d e", " ".join(f"word{i}" for i in range(50)), "!! " * 30])
    ledger = L.evaluate(df)
    kept = {p.version: sorted(r.doc_id for r in ledger.where(L.passes(p)).collect()) for p in L.POLICIES}
    assert kept["base"] == [2] and kept["v2"] == [2]
    rows = {(r.policy, r.rule): r for r in L.ablations(ledger).collect()}
    assert rows["base", "few_words"].n_only == 1 and rows["base", "few_words"].n_kept == 1
    assert rows["v1", "symbols"].n_failed == 1 and rows["v1", "symbols"].other_mask == 2
    assert L.ablations(L.evaluate(documents(spark, []))).where("n_kept != 0").count() == 0


@pytest.mark.parametrize("make", [L.evaluate])
def test_empty_table(spark, make):
    assert make(documents(spark, [])).collect() == []


def test_vocabulary_of_thousands_of_terms(spark):
    """Terms from a table: overlapping ones, each with its own boundaries,
    non-ASCII ones, one listed as both kinds."""
    rows = [(f"t{i}x", i % 5 == 0) for i in range(4000)]
    rows += [("he", False), ("she", False), ("hers", False), ("süß-wört", True), ("Both", True), ("both", False), (None, True), ("", True)]
    strict, soft = U.vocabulary(spark.createDataFrame(rows, "term string, strict boolean"))
    assert len(strict) + len(soft) == 4005 and "both" in strict and "both" not in soft
    urls = ["http://a/she", "http://a/she-he", "http://a/hers.he.she", "http://a/SÜSS", "http://a/süß-wört/", "http://a/xsüß-wört",
            "http://a/both", "http://a/t10x", "http://a/t11x?t12x", "http://a/t11x?t11x", "http://a/éhe~he"]
    got = judge(spark, urls, strict=strict, soft=soft)
    assert [(got[i].n_strict, got[i].n_soft) for i in range(len(urls))] == [
        (0, 1), (0, 2), (0, 3), (0, 0), (1, 0), (0, 0), (1, 0), (1, 0), (0, 2), (0, 1), (0, 1)]
    assert [got[i].verdict for i in (0, 1, 4)] == ["allow", "block", "block"]
    assert judge(spark, ["http://casino.org"], strict=(), soft=())[0].verdict == "allow"


def test_too_many_terms_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(U, "MAX_TERMS", 3)
    with pytest.raises(ValueError):
        U.vocabulary(spark.createDataFrame([(f"t{i}", True) for i in range(5)], "term string, strict boolean"))


def test_ablations_of_the_table(spark, small_dir):
    """Every policy and rule over all documents against plain counting."""
    ledger = L.evaluate(spark.read.parquet(f"{small_dir}/documents.parquet"))
    masks = [r.fail_mask for r in ledger.collect()]
    rows = L.ablations(ledger).collect()
    assert len(rows) == sum(len(p.rules) for p in L.POLICIES) and len(masks) == 200
    bit = {r.name: 1 << r.bit for r in L.RULES}
    rules = {p.version: p.mask(L.RULES) for p in L.POLICIES}
    for r in rows:
        hits = [m & rules[r.policy] for m in masks]
        failed = [h for h in hits if h & bit[r.rule]]
        others = 0
        for h in failed:
            others |= h & ~bit[r.rule]
        assert (r.n_kept, r.n_failed, r.n_only, r.other_mask) == (
            hits.count(0), len(failed), sum(h == bit[r.rule] for h in failed), others)
    assert any(r.n_only for r in rows)
