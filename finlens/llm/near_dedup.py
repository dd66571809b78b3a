"""MinHash near-duplicates by tensored banding, every link verified on full sets.

Signatures.  A text's set holds its distinct ``n``-word shingles (a text with
fewer words: the whole sequence).  Equal sets collapse to one node first, so a
group of exact copies costs one row.  Each node gets two small collections of
``BANDS`` band hashes, of ``BAND_SIZE`` minhashes each; table (i, j) of the
``BANDS**2`` tables is keyed by the pair (first[i], second[j]).  ``2 * BANDS *
BAND_SIZE`` minhashes so serve ``BANDS**2`` tables of ``2 * BAND_SIZE``
minhashes each.  At similarity 0.8 a pair shares a table with probability
1 - 4e-5.

Tables.  Rows travel once per first-collection hash; those alone in their
bucket leave, the rest are combined with the second collection after the
shuffle.  A bucket yields no pairs within the group, only (hub, member), the
hub being its most crowded node; a (hub, member) pair agreeing in fewer than
``AGREE`` of the band hashes is no candidate (at 0.8, probability 1e-6).  Two
similar members of one table whose hub one of them so leaves need another of
the tables they share.

Verification, on full 64-bit shingle sets:
1. every node against the hub it agrees with most; these links are a forest,
   whose trees are found by pointer jumping;
2. families (all members met under one hub) that still hold several
   components: each member's symmetric difference to the hub gives its
   similarity to the hub.  Two members x, y are similar exactly when
   |dx| + |dy| - 2 |dx & dy| <= (|x| + |y|) / 9 (for 0.8), so a member outside
   the hub's component must share a minimum of difference elements with any
   partner.  Differences are joined rarest first with that minimum as the
   join condition, and the pairs found are verified on full sets.
So every candidate pair of the tables that could join two components is
decided exactly, without writing out the pairs of a group; a large family
costs rows in proportion to its members and their differences.

Defined results: no text or no words: empty set, linked with nothing,
component its own id.  Rows with one id and different texts are separate
nodes; a repeated row shares its node.  ``component_id`` is the smallest id
reachable (null ids are passed over); ``kept`` is id = component_id, or both
null.  Extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from finlens.llm.components import components, roots
from finlens.llm.store import TEXT_ROWS, partitions, pick, save, spare_name
from finlens.llm.textops import U64, Words, mix, ngram_hashes, release_memory, slices

BANDS, BAND_SIZE, AGREE = 15, 3, 3
HOT_BUCKET = 512
SKETCH_BITS = 1 << 26
SIMILARITY = (4, 5)


def shingle_sets(col: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted inside a text, with
    offsets; ASCII letters are lower-cased first."""
    w = Words(col, lower=True)
    h = w.hashes()
    grams, first = ngram_hashes(h, w.doc_off, n)
    doc = np.searchsorted(w.doc_off, first, "right") - 1
    for size in range(1, n):  # texts of fewer words: one shingle
        short = np.flatnonzero(w.counts == size)
        if len(short):
            own = (w.doc_off[short][:, None] + np.arange(size)).ravel()
            g, _ = ngram_hashes(h[own], np.arange(len(short) + 1) * size, size)
            grams, doc = np.concatenate([grams, g]), np.concatenate([doc, short])
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    if len(grams):
        new = np.append(True, (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1]))
        grams, doc = grams[new], doc[new]
    return grams, np.searchsorted(doc, np.arange(len(col) + 1))


def _node(grams: np.ndarray) -> bytes | None:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None


def band_hashes(grams: np.ndarray, off: np.ndarray, bands: int, size: int) -> np.ndarray:
    """(texts, 2 * bands) array of band hashes; rows of empty sets are 0."""
    full = np.flatnonzero(np.diff(off) > 0)
    out = np.zeros((len(off) - 1, 2 * bands), np.int32)
    if not len(full):
        return out
    low, start = (grams & U64(0xFFFFFFFF)).astype(np.uint32), off[full]
    seeds = mix(np.arange(4 * bands * size, dtype=U64), 31)
    with np.errstate(over="ignore"):
        for b in range(2 * bands):
            key = np.full(len(full), b, U64)
            for r in range(size):
                i = 2 * (b * size + r)
                a, c = np.uint32((int(seeds[i]) | 1) & 0xFFFFFFFF), np.uint32(int(seeds[i + 1]) & 0xFFFFFFFF)
                least = np.minimum.reduceat(low * a + c, start)
                key = mix(key * U64(0x100000001B3) + least.astype(U64), 5)
            out[full, b] = (key & U64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
    return out


def signatures(df: DataFrame, n: int, bands: int = BANDS, size: int = BAND_SIZE) -> DataFrame:
    """id, th (hash of the text), n (size of the set), node (its digest, null
    if empty), u, v of rows (id, t)."""
    fields = [pa.field("n", pa.int64()), pa.field("node", pa.binary()),
              pa.field("u", pa.list_(pa.int32())), pa.field("v", pa.list_(pa.int32()))]

    def sign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in batches:
            for piece in slices(pa.record_batch([col], ["t"]), "t"):
                grams, off = shingle_sets(piece.column(0), n)
                keys = band_hashes(grams, off, bands, size)
                ends = pa.array(np.arange(len(off), dtype=np.int32) * bands)
                yield pa.StructArray.from_arrays([
                    pa.array(np.diff(off)),
                    pa.array([_node(grams[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)], pa.binary()),
                    pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(keys[:, :bands]).ravel())),
                    pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(keys[:, bands:]).ravel())),
                ], fields=fields)
        release_memory()

    signed = F.arrow_udf(sign, "struct<n:bigint,node:binary,u:array<int>,v:array<int>>")
    return df.select("id", F.xxhash64("t").alias("th"), signed("t").alias("s")).select("id", "th", "s.*")


def _set_builder(n: int):
    fields = [pa.field("node", pa.binary()), pa.field("s", pa.list_(pa.int64()))]

    def build(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in batches:
            for piece in slices(pa.record_batch([col], ["t"]), "t"):
                grams, off = shingle_sets(piece.column(0), n)
                yield pa.StructArray.from_arrays([
                    pa.array([_node(grams[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(grams.view(np.int64))),
                ], fields=fields)
        release_memory()

    return build


def _set_column(n: int):
    # not deterministic to the optimizer: a filter on its result would else be
    # evaluated on rows that a join has not yet thinned out
    return F.arrow_udf(_set_builder(n), "struct<node:binary,s:array<bigint>>").asNondeterministic()


def maybe_in(rows: DataFrame, key, wanted: DataFrame, wanted_key, bits: int = SKETCH_BITS) -> DataFrame:
    """``rows`` less most of those whose ``key`` (a hash) is no ``wanted_key``
    of ``wanted``: all with such a key stay, of the others a share that is the
    load of a bitmap of ``bits`` cells.  The bitmap (8 MB at most) is broadcast,
    so rows are thinned out before they are shuffled."""

    def cell(h):
        return F.pmod(h, F.lit(bits)) + 1

    at = cell(wanted_key)
    cells = wanted.select(F.bitmap_bucket_number(at).alias("_bucket"), F.bitmap_bit_position(at).alias("_bit"))
    bitmap = cells.groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    at = cell(key)
    bit = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring("_bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    here = (F.bitmap_bucket_number(at) == F.col("_bucket")) & (F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1)
    return rows.join(F.broadcast(bitmap), here, "left_semi")


def star_pairs(reps: DataFrame, agree: int, hot: int = HOT_BUCKET) -> DataFrame:
    """(hub, node, agree): members of a table bucket against its hub.

    Bucket sizes and, for buckets of more than ``hot`` nodes, the hubs of
    their tables come from aggregates that combine before the shuffle, and are
    joined back; smaller buckets find their hubs inside one task each.
    """
    rows = reps.select("node", F.posexplode("u").alias("i", "u"))
    sizes = save(rows.groupBy("i", "u").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "bucket-sizes", narrow=True)
    crowded = save(rows.join(sizes, ["i", "u"]), "buckets", narrow=True)
    # second band hashes join only nodes that share a bucket, once each
    crowd = crowded.groupBy("node").agg((-F.sum("c")).alias("crowd"))
    crowd = save(crowd.join(reps.select("node", "v"), "node"), "crowds", narrow=True)
    placed = crowded.join(crowd, "node")
    table = Window.partitionBy("i", "u", "j", "w")

    def by_table(df: DataFrame) -> DataFrame:
        return df.select("i", "u", "node", "crowd", F.posexplode("v").alias("j", "w"))

    few = by_table(placed.where(F.col("c") <= hot).repartition(partitions(reps.sparkSession), "i", "u")).withColumn(
        "hub", F.min(F.struct("crowd", "node")).over(table)["node"])
    many = by_table(placed.where(F.col("c") > hot))
    hubs = save(many.groupBy("i", "u", "j", "w").agg(
        F.min(F.struct("crowd", "node")).alias("h"), F.count(F.lit(1)).alias("c")).where("c > 1").select(
        "i", "u", "j", "w", F.col("h.node").alias("hub")), "hubs", narrow=True)
    many = many.join(hubs, ["i", "u", "j", "w"])
    members = few.select("hub", "node").unionByName(many.select("hub", "node")).where("hub <> node").distinct()
    mine = reps.select("node", F.col("u").alias("u1"), F.col("v").alias("v1"))
    hubs = reps.select(F.col("node").alias("hub"), F.col("u").alias("u2"), F.col("v").alias("v2"))
    same = F.size(F.array_intersect("u1", "u2")) + F.size(F.array_intersect("v1", "v2"))
    return members.join(mine, "node").join(hubs, "hub").select("hub", "node", same.alias("agree")).where(
        F.col("agree") >= agree)


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ...) with both sets."""
    first = sets.select(F.col("node").alias("a"), F.col("s").alias("sa"))
    second = sets.select(F.col("node").alias("b"), F.col("s").alias("sb"))
    return pairs.join(first, "a").join(second, "b")


def _slack(total, similarity: tuple[int, int]):
    """Largest symmetric difference of a linked pair whose sizes add to ``total``."""
    p, q = similarity
    return F.floor(total * (q - p) / F.lit(p + q))


def verified(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    p, q = similarity
    both = F.size(F.array_intersect("sa", "sb"))
    rows = _with_sets(pairs.select("a", "b"), sets).withColumn("x", both)
    return rows.where(q * F.col("x") >= p * (F.size("sa") + F.size("sb") - F.col("x"))).select("a", "b")


def _family_links(star: DataFrame, labels: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Links (a, b) that families with several components still owe."""
    own = labels.select("node", F.col("label").alias("lab"))
    hubs = labels.select(F.col("node").alias("hub"), F.col("label").alias("hub_lab"))
    family = star.join(own, "node", "left").join(hubs, "hub", "left").select(
        "hub", "node", F.coalesce("lab", "node").alias("lab"), F.coalesce("hub_lab", "hub").alias("hub_lab"))
    # written: a join with a plain table can be split at a hub with very many members
    open_ = save(family.where("lab != hub_lab").select("hub").distinct(), "open-hubs", narrow=True)
    family = family.join(open_, "hub").withColumnsRenamed({"hub": "a", "node": "b"})
    delta = _with_sets(family, sets).select(
        F.col("a").alias("hub"), F.col("b").alias("node"), "lab", "hub_lab",
        F.size("sa").alias("n_hub"), F.size("sb").alias("n"),
        F.concat(F.array_except("sa", "sb"), F.array_except("sb", "sa")).alias("d"))
    delta = delta.withColumn("nd", F.size("d")).withColumn(
        "linked", F.col("nd") <= _slack(F.col("n_hub") + F.col("n"), similarity))
    delta = save(delta.withColumn("outside", ~F.col("linked") & (F.col("lab") != F.col("hub_lab"))), "deltas")
    to_hub = delta.where("linked and lab != hub_lab").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    owing = save(delta.where("outside").select("hub").distinct(), "owing-hubs", narrow=True)
    rest = delta.join(owing, "hub").select(
        "hub", "node", "n", "nd", "outside", F.when(F.col("linked"), F.col("hub_lab")).otherwise(F.col("lab")).alias("lab"),
        F.explode("d").alias("e"))
    often = rest.groupBy("hub", "e").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    rarest = Window.partitionBy("hub", "node").orderBy(F.coalesce("often", F.lit(1)), "e")
    ranked = save(rest.join(often, ["hub", "e"], "left").withColumn(
        "left", F.col("nd") - F.row_number().over(rarest) + 1).where("often is not null").drop("often"), "differences")
    x = ranked.where("outside").select(*[F.col(c).alias(f"x_{c}") for c in ("hub", "e", "node", "n", "nd", "lab", "left")])
    y = ranked
    shared_least = F.ceil((F.col("x_nd") + F.col("nd") - _slack(F.col("x_n") + F.col("n"), similarity)) / 2)
    met = x.join(y, (F.col("x_hub") == y["hub"]) & (F.col("x_e") == y["e"]) & (F.col("x_lab") != y["lab"])
                 & (F.least("x_left", "left") >= shared_least))
    pairs = met.select(F.least("x_node", "node").alias("a"), F.greatest("x_node", "node").alias("b")).distinct()
    return to_hub.unionByName(verified(pairs, sets, similarity))


def grouped(docs: DataFrame, n: int, similarity: tuple[int, int] = SIMILARITY, bands: int = BANDS,
            size: int = BAND_SIZE, agree: int = AGREE, hot: int = HOT_BUCKET, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """Per row (id, t) of ``docs``: id, th, n, node, and one node (label) and
    the smallest id of its component; empty sets have null label."""
    signed = save(signatures(docs, n, bands, size), "signatures", TEXT_ROWS)
    reps = save(signed.where("n > 0").groupBy("node").agg(
        F.min("id").alias("id"), F.min(F.struct("id", "th")).alias("row"), F.first("u").alias("u"),
        F.first("v").alias("v")), "nodes", narrow=True)
    star = save(star_pairs(reps, agree, hot), "stars", narrow=True)
    wanted = star.select(F.col("hub").alias("node")).unionByName(star.select("node")).distinct()
    # one row of each node, by id and text hash: many rows may share an id (or
    # have none), few also the text
    wanted = reps.join(wanted, "node", "left_semi").select("row.*", "node")
    wanted = save(wanted.select(F.col("id").alias("wid"), F.col("th").alias("wth"), F.col("node").alias("wnode")), "wanted", narrow=True)
    keyed = docs.select("id", F.xxhash64("t").alias("th"), "t")
    keyed = maybe_in(keyed, F.xxhash64("id", "th"), wanted, F.xxhash64("wid", "wth"), sketch_bits)
    texts = keyed.join(wanted, F.col("id").eqNullSafe(F.col("wid")) & (F.col("th") == F.col("wth")))
    sets = texts.select("wnode", _set_column(n)("t").alias("s")).where("wnode = s.node")
    sets = save(sets.select("s.*").dropDuplicates(["node"]), "sets", TEXT_ROWS)

    # a hub comes before its members by (crowd, node): the links are a forest
    best = star.groupBy("node").agg(F.max_by("hub", F.struct("agree", "hub")).alias("hub"))
    links = verified(best.select(F.col("hub").alias("a"), F.col("node").alias("b")), sets, similarity)
    trees = save(roots(links.select(F.col("b").alias("node"), F.col("a").alias("up"))), "trees", narrow=True)
    more = _family_links(star, trees, sets, similarity)

    def tree(of: str):
        return trees.select(F.col("node").alias(of), F.col("label").alias(f"{of}_tree"))

    # what joins two trees, as links between their roots
    more = more.join(tree("a"), "a", "left").join(tree("b"), "b", "left").select(
        F.coalesce("a_tree", "a").alias("a"), F.coalesce("b_tree", "b").alias("b"))
    joined = components(more.where("a != b")).select(F.col("node").alias("tree"), F.col("label").alias("joined"))

    named = reps.join(trees.withColumnRenamed("label", "tree"), "node", "left").select(
        "node", "id", F.coalesce("tree", "node").alias("tree"))
    named = named.join(joined, "tree", "left").select("node", "id", F.coalesce("joined", "tree").alias("label"))
    least = named.groupBy("label").agg(F.min("id").alias("component_id"))
    member = named.select("node", "label").join(least, "label")
    return signed.select("id", "th", "n", "node").join(member, "node", "left")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 2, **options) -> DataFrame:
    """id, n_shingles, component_id, kept; one row per input row."""
    rows = grouped(pick(df, id=id_col, t=text_col), n, **options)
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                       F.col("id").eqNullSafe(component).alias("kept"))


def one_per_group(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, **options) -> DataFrame:
    """``df`` with one row of each group of near-duplicates: the smallest id
    (of equal ids the smaller text hash, of equal rows any one); rows without
    words all stay."""
    rows = grouped(pick(df, id=id_col, t=text_col), n, **options)
    fid, fth, h, place = (spare_name(df, n) for n in ("_fid", "_fth", "_h", "_place"))
    first = rows.where("n > 0").groupBy("label").agg(F.min(F.struct("id", "th")).alias("k")).select(
        F.col("k.id").alias(fid), F.col("k.th").alias(fth)).distinct()
    keyed = df.withColumn(h, F.xxhash64(text_col))
    wordless = F.coalesce(~F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    kept = keyed.where(~wordless).join(first, keyed[id_col].eqNullSafe(F.col(fid)) & (F.col(h) == F.col(fth)))
    same = Window.partitionBy(id_col, h).orderBy(F.lit(0))
    kept = kept.withColumn(place, F.row_number().over(same)).where(F.col(place) == 1).select(*df.columns)
    return kept.unionByName(df.where(wordless))
