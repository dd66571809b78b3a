from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from finlens.llm import prefix_trie as T
from finlens.llm import queries as Q
from tests.llm.helpers import with_clashes

TURNS = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def conversations(rows):
    """conv_id -> ordered (role, text) turns."""
    out = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            out[c].append((turn is not None, turn or 0, digest(role, text), role, text))
    return {c: [x[3:] for x in sorted(t)] for c, t in out.items()}


def rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - c % 100, [])[:h] + turns[h:]
    return out


def brute_trie(convs):
    """Rows of a plain trie over all prefixes."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())


def rows_of(df):
    return sorted(((tuple(r[c] for c in COLUMNS)) for r in df.collect()), key=lambda r: (r[0], r[1]))


def forest(seed, count, hot=0.3):
    rnd = random.Random(seed)
    rows = []
    for c in range(count):
        if rnd.random() < hot:
            turns = [("system", "hot")] * 3
        else:
            turns = [(rnd.choice(["user", "bot"]), rnd.choice(["", "a", "bb", "ö€"])) for _ in range(rnd.randint(1, 7))]
            if rnd.random() < 0.5:
                turns[0] = ("system", "hot")
        rows += [(c * 7 % 100_003, i, *t) for i, t in enumerate(turns)]
    rnd.shuffle(rows)
    return rows


ODD = [(500, None, None, None), (500, 1, "user", "x"), (500, 1, "user", "x"), (500, 1, "a", None), (None, 0, "user", "y"),
       (600, 0, "", ""), (7, 2, "user", "z"), (-150, 3, "bot", "t" * 30000), (-151, 3, "bot", "t" * 30000)]


@pytest.mark.parametrize(("seed", "block_rows"), [(1, 1), (2, 3), (3, 50), (4, 20_000)])
def test_trie_equals_brute_force(spark, seed, block_rows):
    """Also when nearly every node is shared by many blocks."""
    rows = forest(seed, 300) + ODD + [(90_001, i, "user", "deep") for i in range(200)]
    df = with_clashes(spark.createDataFrame(rows, TURNS)).repartition(4)
    got = T.prefix_trie(T.sequences(df), block_rows=block_rows)
    assert rows_of(got) == sorted(brute_trie(conversations(rows)), key=lambda r: (r[0], r[1]))


def test_many_copies_and_sparse_ids(spark):
    rows = [(c * c, 0, "user", "same") for c in range(3000)] + [(7, 1, "bot", "more")]
    got = T.prefix_trie(T.sequences(spark.createDataFrame(rows, TURNS)))
    assert rows_of(got) == sorted(brute_trie(conversations(rows)), key=lambda r: (r[0], r[1]))


def test_query_equals_brute_force(spark, tmp_path, small_dir):
    table = [tuple(r) for r in spark.read.parquet(f"{small_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows = table + [(c + 1000 if c is not None else None, *t) for c, *t in forest(9, 250) + ODD]
    spark.createDataFrame(rows, TURNS).write.parquet(str(tmp_path / "conversations.parquet"))
    got = rows_of(Q.op12_prefix_trie(spark, str(tmp_path)))
    want = sorted(brute_trie(rebuilt(conversations([r for r in rows if r[0] is None or r[0] >= 0]))), key=lambda r: (r[0], r[1]))
    assert got == want
    assert any(r[1] == 0 and r[7] != hashlib.sha256(b"").hexdigest() for r in want)  # some conversation is left turnless


def test_empty_table(spark):
    assert T.prefix_trie(T.sequences(spark.createDataFrame([], TURNS))).collect() == []
