"""The table that grows by batches: replays, half-written batches, and what a
batch reads."""

from __future__ import annotations

from finlens.sources import batch_table as B

SCHEMA = "k string, t string, v bigint"
KEYS = ["k", "t"]


def _rows(spark, ids, v):
    return spark.createDataFrame([(f"k{i}", "a", v) for i in ids], SCHEMA)


def _table(spark, path):
    return {r["k"]: r["v"] for r in B.read_batches(spark, path, _rows(spark, [], 0).schema).collect()}


def test_replays_and_half_written_batches(spark, tmp_path):
    path = str(tmp_path / "t")
    assert _table(spark, path) == {}
    B.write_batch(_rows(spark, range(10), 0), 0, path, KEYS)
    B.write_batch(_rows(spark, range(5, 30), 1), 1, path, KEYS, commit=False)  # the writer was lost here
    assert set(_table(spark, path).values()) == {0}
    B.write_batch(_rows(spark, range(5, 20), 1), 1, path, KEYS)
    B.write_batch(_rows(spark, range(5, 20), 7), 1, path, KEYS)  # delivered again
    B.write_batch(_rows(spark, range(0, 40), 2), 2, path, KEYS)
    B.write_batch(_rows(spark, range(10), 9), 0, path, KEYS)
    want = {f"k{i}": 0 if i < 10 else 1 if i < 20 else 2 for i in range(40)}
    assert _table(spark, path) == want


def test_a_batch_reads_only_the_buckets_it_touches(spark, tmp_path):
    path = str(tmp_path / "t")
    B.write_batch(_rows(spark, range(200), 0), 0, path, KEYS, buckets=16)
    written = {p.name for p in (tmp_path / "t" / "_keys" / "batch=0").glob("bucket=*")}
    assert len(written) > 8
    # the index of every other bucket may be unreadable
    batch = _rows(spark, [3], 1)
    own = batch.select(B._bucket(KEYS, 16).alias("b")).first()["b"]
    for p in (tmp_path / "t" / "_keys" / "batch=0").glob("bucket=*"):
        if p.name != f"bucket={own}":
            for f in p.glob("*.parquet"):
                f.write_bytes(b"not parquet")
    B.write_batch(batch, 1, path, KEYS, buckets=16)
    assert _table(spark, path)["k3"] == 0


def test_an_empty_batch_commits(spark, tmp_path):
    path = str(tmp_path / "t")
    B.write_batch(_rows(spark, [], 0), 0, path, KEYS)
    B.write_batch(_rows(spark, [1], 1), 1, path, KEYS)
    assert _table(spark, path) == {"k1": 1}
    assert sorted(r["batch"] for r in B.committed(spark, path).collect()) == [0, 1]
