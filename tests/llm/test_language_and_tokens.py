from __future__ import annotations

import random

import pytest

from finlens.llm import language_id as G
from finlens.llm import token_counts as T
from finlens.llm.queries import QUERIES
from tests.llm.helpers import EDGE_TEXTS, by_id, documents, with_clashes

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def test_held_out_accuracy(spark, small_dir):
    rows = QUERIES["op3_language_id"](spark, small_dir).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark):
    train = documents(spark, ["the house and the tree are green", "das haus und der baum sind gruen", None, "x"],
                      lang=["en", "de", "en", None])
    content = G.learn(train)
    assert list(content) == ["de", "en"]
    got = by_id(G.identify(with_clashes(documents(spark, [*EDGE_TEXTS, "THE HOUSE!! and", "baum der das"])), content))
    assert [got[i].lang_pred for i in (0, 1, 2, 6)] == ["und"] * 4 and got[0].score == 0.0
    assert (got[12].lang_pred, got[13].lang_pred) == ("en", "de")
    assert got[9].asDict() | {"doc_id": 0} == got[10].asDict() | {"doc_id": 0}
    assert by_id(G.identify(documents(spark, ["text"]), {}))[0].lang_pred == "und"
    assert G.learn(documents(spark, [])) == {}


def test_long_texts_are_read_to_the_end(spark):
    content = {"a": b"lorem ipsum dolor sit amet " * 40, "b": b"quick brown fox jumps over " * 40}
    tail = "lorem ipsum dolor sit amet " * 4000
    assert G.Classifier(content)("quick brown fox " * 300 + tail)[0] == "a"


def library_counts(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [len(e.ids) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def odd_texts():
    rnd = random.Random(3)
    pick = "abcé'sSTDdΣσİ 1٣½\t\n\x0b\x1c\x1f\x85\xa0é́​<|>!日🙂"
    return ["".join(rnd.choice(pick) for _ in range(rnd.randint(0, 50))) for _ in range(1500)]


def test_counts_equal_the_library(spark):
    texts = [*EDGE_TEXTS, "a<|endoftext|>b <|startoftext|>", "don't 'RE x'll", "aaaa" * 500, *odd_texts()]
    got = by_id(T.count_tokens(with_clashes(documents(spark, texts)), PATH))
    assert [got[i].n_tokens for i in range(len(texts))] == library_counts(texts)
    assert [got[i].n_bytes for i in range(len(texts))] == [len((t or "").encode()) for t in texts]
    assert got[11].over_limit and not got[0].over_limit


def test_counts_of_the_table(spark, small_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    got = by_id(QUERIES["op8_token_counts"](spark, small_dir))
    assert [got[i].n_tokens for i in texts] == library_counts(texts.values())


def test_empty_tables(spark):
    assert T.count_tokens(documents(spark, []), PATH).collect() == []
    assert G.identify(documents(spark, []), {"a": b"x"}).collect() == []


def test_full_cache_changes_nothing(monkeypatch):
    table = T.MergeTable(PATH)
    texts = [f"word{i} other{i % 7} longer{'x' * 300}" for i in range(200)]
    whole = T.Counter(table).count(texts)
    monkeypatch.setattr(T, "CACHE_PIECES", 5)
    counter = T.Counter(table)
    assert [n for t in texts for n in counter.count([t])] == whole


def test_texts_without_a_letter_are_undetermined(spark):
    """Letters are Unicode category L: fractions, number signs, marks and
    underscores alone are none."""
    content = {"en": b"the house and the tree " * 40, "de": b"das haus und der baum " * 40}
    texts = ["½ ²", "Ⅷ", "_1_", "́́", "①②", "١٢٣", "ª", "日", "der _½_ baum"]
    got = by_id(G.identify(documents(spark, texts), content))
    assert [(got[i].lang_pred, got[i].score) for i in range(6)] == [("und", 0.0)] * 6
    assert all(got[i].lang_pred in content for i in (6, 7)) and got[8].lang_pred == "de"
