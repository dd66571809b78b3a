from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from finlens.llm import periodic_runs as R
from finlens.llm import queries as Q
from tests.llm.helpers import DOCS, EDGE_TEXTS, by_id, documents, with_clashes, words


def brute_runs(w, exponent=4, least=6):
    """Every maximal stretch of every period, smallest period per stretch."""
    best = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, exponent * q):
                best.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b - a, q) for (a, b), q in best.items())


def brute_collapsed(w, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def periodic(seed, count):
    rnd = random.Random(seed)
    texts = []
    for _ in range(count):
        vocab = [f"v{i}" for i in range(rnd.choice([1, 2, 2, 3, 50]))]
        w = []
        for _ in range(rnd.randint(1, 6)):
            unit = [rnd.choice(vocab) for _ in range(rnd.randint(1, 9))]
            w += unit * rnd.randint(1, 9) + unit[:rnd.randint(0, len(unit))]
            if rnd.random() < 0.3:
                w += w[-rnd.randint(1, len(w)):]
        texts.append(rnd.choice([" ", "\n", " \t "]).join(w))
    return texts


@pytest.mark.parametrize(("exponent", "least"), [(4, 6), (4, 1), (6, 20)])
def test_runs_equal_brute_force(spark, exponent, least):
    texts = [*EDGE_TEXTS, "é é é é é é é", "a b " * 400 + "c " + "a b " * 300, *periodic(exponent + least, 250)]
    df = with_clashes(documents(spark, texts)).repartition(3)
    got = by_id(R.periodic_runs(df, min_exponent=exponent, min_length=least))
    for i, t in enumerate(texts):
        w = words(t)
        want = brute_runs(w, exponent, least) if len(w) < 4000 else [tuple(r) for r in got[i].runs]
        assert [tuple(r) for r in got[i].runs] == want, t
        assert got[i].n_words == len(w) and got[i].collapsed == brute_collapsed(w, want)
    deep = got[EDGE_TEXTS.index("x " * 5000)]
    assert [tuple(r) for r in deep.runs] == [(0, 5000, 1)] and deep.collapsed == "x"
    assert [tuple(r) for r in got[len(EDGE_TEXTS) - 1].runs] == [(0, 30000, 701)]


def test_smaller_exponents_are_refused():
    import numpy as np

    with pytest.raises(ValueError):
        R.find_runs(np.zeros(4, np.int64), np.array([0, 4]), min_exponent=3)


def rebuilt(doc_id, text):
    w = words(text)
    h = zlib.crc32(str("" if doc_id is None else doc_id).encode())
    g = h // 10
    if h % 10 or not w:
        return w
    n = len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def brute_row(doc_id, text):
    w = rebuilt(doc_id, text)
    runs = brute_runs(w)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    digest = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
    kept = hashlib.sha256(brute_collapsed(w, runs).encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest, kept)


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_equals_brute_force(spark, tmp_path, small_dir):
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()]
    own = [(10_000 + i, t) for i, t in enumerate([*EDGE_TEXTS[:-1], *periodic(5, 150)])]
    rows = [*table, *own, (None, "a b c a b c a b c a b c a b c"), (10_003, "one")]
    spark.createDataFrame([(d, t, None, None, None) for d, t in rows], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    out = Q.op11_periodic_runs(spark, str(tmp_path))
    got = sorted((tuple(r[c] for c in COLUMNS) for r in out.collect()), key=str)
    assert got == sorted((brute_row(d, t) for d, t in rows), key=str)
    assert sum(zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in table) > 10


def test_empty_table(spark, tmp_path):
    documents(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert Q.op11_periodic_runs(spark, str(tmp_path)).collect() == []
