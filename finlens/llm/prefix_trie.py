"""Prefix trie of turn sequences, by range minima over sorted LCPs.

``sequences`` turns each conversation into the 16-byte digests of its (role,
text) turns, in order; ``prefix_trie`` gives one row per distinct prefix.

1. Equal sequences collapse, with their members' ids in chunks of ``CHUNK``
   consecutive ids, so a conversation copied a million times is some hundreds
   of short rows.
2. Distinct sequences are sorted over the cluster (range partitions) and cut
   into blocks of a bounded size.  In a block, LCPs of neighbours go into a
   sparse table of minima.  Row r brings the candidates (r, d), d from its LCP
   with row r - 1 to its length; each candidate binary-searches its left and
   its right extent on its own.  Those whose left extent is r are the nodes,
   in preorder; the others (d = LCP) lead to the parent.  Members are prefix
   sums over an extent, the smallest member a second sparse table, subtree
   sums prefix sums over the preorder.
3. A node whose extent ends inside the block on both sides is whole.  The
   prefixes of a block's first and last row may go on in other blocks: at most
   two per turn and block, whatever their number of members.  They are added
   up by their key; what a node counts for its ancestors (its leaf, its
   savings) is owned by one block, where all its ancestors are, and is summed
   up along that block's two paths.

So a first turn shared by a third of all conversations is one row per block,
and its subtree is spread over all of them.  The members' ids of one node are
hashed in one task, since SHA-256 is sequential, but as a stream of chunks.
A conversation is the unit: its digests (16 bytes a turn) and text lengths
are one row, as a text is elsewhere.

Defined results: turns are ordered by turn number, null first, equal ones by
digest; a repeated row is a turn of its own.  Null role or text counts as
empty.  Rows without a conversation id belong to no conversation and are left
out.  A conversation without turns is a member of the root only; an empty
table has no node.  Extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from finlens.llm.store import partitions, pick, save

DIGEST = 16
CHUNK = 4096
BLOCK_BYTES, BLOCK_ROWS = 4 << 20, 20_000


def sequences(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
              text_col: str = "text") -> DataFrame:
    """conv_id, seq (digests of the turns, joined), sizes (code points of each
    turn's text)."""
    rows = pick(turns, conv_id=id_col, turn=turn_col, role=role_col, text=text_col).where("conv_id is not null")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turn = F.struct("turn", digest.alias("digest"), F.length(text).alias("size"))
    rows = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), turn.alias("t"))
    rows = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return rows.select("conv_id", F.unhex(F.array_join("t.digest", "")).alias("seq"), F.col("t.size").alias("sizes"))


def _range_minima(a: np.ndarray) -> list[np.ndarray]:
    """Level k holds the minimum of ``a[i:i + 2**k]`` at i."""
    levels = [a]
    while 2 << (len(levels) - 1) <= len(a):
        last, width = levels[-1], 1 << (len(levels) - 1)
        levels.append(np.minimum(last[:-width], last[width:]))
    return levels


def _least_between(levels: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Minimum of ``a[left:right + 1]``, from two overlapping ranges."""
    out = np.empty(len(left), np.int64)
    k = np.frexp((right - left + 1).astype(np.float64))[1] - 1
    for level in np.unique(k):
        at = np.flatnonzero(k == level)
        out[at] = np.minimum(levels[level][left[at]], levels[level][right[at] - (1 << int(level)) + 1])
    return out


def _extents(levels: list[np.ndarray], row: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last row that share the first ``depth`` turns with ``row``."""
    m = len(levels[0])
    left, right = row.copy(), row.copy()
    for k in range(len(levels) - 1, -1, -1):
        step, low = 1 << k, levels[k]
        at = right + 1
        go = (right + step < m) & (low[np.minimum(at, len(low) - 1)] >= depth)
        right[go] += step
        at = left - step + 1
        go = (left - step >= 0) & (low[np.maximum(at, 0)] >= depth)
        left[go] -= step
    return left, right


def _common(turn: np.ndarray, off: np.ndarray) -> np.ndarray:
    """LCP of each sequence with the one before it, in turns; -1 for the first."""
    size = np.diff(off)
    lcp = np.zeros(len(size), np.int64)
    most = np.minimum(size[1:], size[:-1])
    rows, d = np.flatnonzero(most > 0) + 1, 0
    while len(rows):
        rows = rows[(turn[off[rows] + d] == turn[off[rows - 1] + d]).all(axis=1)]
        d += 1
        lcp[rows] = d
        rows = rows[most[rows - 1] > d]
    lcp[0] = -1
    return lcp


def _prefix_keys(seq: bytes) -> list[bytes]:
    h = hashlib.blake2b(digest_size=DIGEST)
    keys = [h.copy().digest()]
    for i in range(0, len(seq), DIGEST):
        h.update(seq[i:i + DIGEST])
        keys.append(h.copy().digest())
    return keys


#: ``side`` of a node that may go on in other blocks: on the path of the first
#: row (1), of the last (2), of both (0); null: the node is whole
_NODE = pa.schema([
    ("block", pa.binary()), ("side", pa.int32()), ("key", pa.binary()), ("parent_key", pa.binary()),
    ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
    ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("size", pa.int64()),
    ("ends_sha256", pa.string())])


def block_nodes(seqs: list[bytes], sizes: np.ndarray, copies: np.ndarray, least: np.ndarray, ends: list[str]
                ) -> pa.RecordBatch:
    """Nodes of sorted distinct sequences; ``sizes`` of all turns joined,
    ``copies`` and ``least`` id of each sequence's members, hash of their ids."""
    m = len(seqs)
    off = np.append(0, np.cumsum([len(s) // DIGEST for s in seqs]))
    turn = np.frombuffer(b"".join(seqs), np.uint64).reshape(-1, 2)
    size = np.diff(off)
    lcp = _common(turn, off)
    lcps = _range_minima(lcp)
    count = size - np.maximum(lcp, 0) + 1
    row = np.repeat(np.arange(m), count)
    depth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.maximum(lcp, 0)[row]
    left, right = _extents(lcps, row, depth)

    node = np.flatnonzero(left == row)
    first = np.append(0, np.cumsum(size - lcp))  # nodes in preorder; first of each row
    number = first[left] + depth - lcp[left] - 1  # node of each candidate
    parent = np.where(depth[node] > 0, number[np.maximum(node - 1, 0)], -1)
    row, depth, left, right = row[node], depth[node], left[node], right[node]
    members = np.append(0, np.cumsum(copies))
    n_convs = members[right + 1] - members[left]
    smallest = _least_between(_range_minima(least), left, right)
    own = np.where(depth > 0, np.append(sizes, 0)[np.where(depth > 0, off[row] + depth - 1, 0)], 0)
    whole = (left > 0) & (right < m - 1)
    children = np.bincount(parent[whole], minlength=len(node))
    after = first[right + 1]
    leaves = np.append(0, np.cumsum(whole & (children == 0)))
    saved = np.append(0, np.cumsum(np.where(whole, (n_convs - 1) * own, 0)))
    here = np.arange(len(node))

    keys = [None] * len(node)
    first_keys, last_keys = _prefix_keys(seqs[0]), _prefix_keys(seqs[-1])
    for i in np.flatnonzero(~whole).tolist():
        keys[i] = (first_keys if left[i] == 0 else last_keys)[depth[i]]
    side = np.where(left > 0, 2, np.where(right < m - 1, 1, 0))
    inner = (parent >= 0) & whole[parent]
    parents = parent.tolist()
    ending = (size[row] == depth).tolist()
    return pa.RecordBatch.from_arrays([
        pa.array([first_keys[-1]] * len(node), pa.binary()), pa.array(side.astype(np.int32), mask=whole),
        pa.array(keys, pa.binary()),
        pa.array([keys[p] if p >= 0 else None for p in parents], pa.binary()),
        pa.array(smallest), pa.array(depth), pa.array(smallest[parent], mask=~inner), pa.array(n_convs),
        pa.array(children.astype(np.int64)), pa.array(leaves[after] - leaves[here]), pa.array(saved[after] - saved[here]),
        pa.array(own.astype(np.int64)),
        pa.array([ends[r] if e else None for r, e in zip(row.tolist(), ending, strict=True)], pa.string()),
    ], schema=_NODE)


def _blocks(block_rows: int, block_bytes: int):
    """Sorted chunk rows in; nodes of blocks of whole sequences out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seqs: list[bytes] = []
        sizes: list[np.ndarray] = []
        copies: list[int] = []
        least: list[int] = []
        ends: list = []
        held = 0

        def block() -> pa.RecordBatch:
            return block_nodes(seqs, np.concatenate(sizes), np.array(copies, np.int64), np.array(least, np.int64),
                               [h.hexdigest() for h in ends])

        for batch in batches:
            flat, bound = np.asarray(batch.column("sizes").flatten()), np.asarray(batch.column("sizes").offsets)
            bound = bound - bound[0]
            rows = zip(*(batch.column(c).to_pylist() for c in ("seq", "n", "least", "ids")), strict=True)
            for i, (seq, n, low, ids) in enumerate(rows):
                if seqs and seqs[-1] == seq:
                    copies[-1] += n
                    least[-1] = min(least[-1], low)
                    ends[-1].update(b"," + ids.encode())
                    continue
                if seqs and (len(seqs) >= block_rows or held >= block_bytes):
                    yield block()
                    seqs, sizes, copies, least, ends, held = [], [], [], [], [], 0
                seqs.append(seq)
                sizes.append(flat[bound[i]:bound[i + 1]].astype(np.int64))
                copies.append(n)
                least.append(low)
                ends.append(hashlib.sha256(ids.encode()))
                held += 2 * len(seq)
        if seqs:
            yield block()

    return run


def _along_paths(parts: DataFrame, merged: DataFrame) -> DataFrame:
    """key, leaves and savings of the subtrees of the nodes that several blocks
    may share: what whole nodes below add, and the shared ones, each counted
    in its owner."""
    owned = merged.select("key", "owner", F.expr("int(n_children = 0)").alias("leaf"),
                          ((F.col("n_convs") - 1) * F.col("size")).alias("saving"))
    mine = parts.select("key", "block", "side", "depth", "n_leaves", "saved_tokens").join(owned, "key").withColumns({
        "leaf": F.when(F.col("block") == F.col("owner"), F.col("leaf")).otherwise(0),
        "saving": F.when(F.col("block") == F.col("owner"), F.col("saving")).otherwise(0)})
    both = Window.partitionBy("block").orderBy(F.desc("depth"))
    one = Window.partitionBy("block", "side").orderBy(F.desc("depth"))

    def below(c):
        return F.when(F.col("side") == 0, F.sum(c).over(both)).otherwise(F.sum(c).over(one))

    mine = mine.select("key", (F.col("n_leaves") + below("leaf")).alias("n_leaves"),
                       (F.col("saved_tokens") + below("saving")).alias("saved_tokens"))
    return mine.groupBy("key").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))


def prefix_trie(seqs: DataFrame, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per distinct prefix of the ``sequences`` rows: conv_id (smallest
    member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (over the subtree, text lengths its members need not repeat),
    ends_sha256 (of the ids that end here)."""
    spark = seqs.sparkSession
    chunks = save(seqs.groupBy("seq", F.expr(f"conv_id div {CHUNK}").alias("chunk")).agg(
        F.first("sizes").alias("sizes"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"),
        F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids")), "sequences")
    ranged = chunks.repartitionByRange(partitions(spark), "seq").sortWithinPartitions("seq", "chunk")
    found = ranged.select("seq", "sizes", "n", "least", "ids").mapInArrow(
        _blocks(block_rows, block_bytes),
        "block binary, side int, key binary, parent_key binary, conv_id bigint, depth bigint, parent_conv_id bigint, "
        "n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, size bigint, ends_sha256 string")
    found = save(found, "nodes")
    out = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")

    parts, whole = found.where("side is not null"), found.where("side is null")
    merged = parts.groupBy("key").agg(
        F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"),
        F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_whole"), F.max("size").alias("size"),
        F.max("ends_sha256").alias("ends_sha256"), F.min("block").alias("owner"))
    shared = merged.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(
        F.count(F.lit(1)).alias("n_shared"))
    merged = save(merged.join(shared, "key", "left").withColumn(
        "n_children", F.col("n_whole") + F.coalesce("n_shared", F.lit(0))), "shared-nodes")
    parents = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    top = merged.join(_along_paths(parts, merged), "key").join(parents, "parent_key", "left").select(*out)

    # whole nodes below a shared one: looked up inside their block, so that a
    # parent with very many children is no hot key
    by_block = parts.select("block", F.col("key").alias("parent_key")).join(parents, "parent_key")
    under = whole.where("parent_key is not null").drop("parent_conv_id").join(by_block, ["block", "parent_key"]).select(*out)
    nodes = whole.where("parent_key is null").select(*out).unionByName(under).unionByName(top)
    return nodes.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
