"""Language identification by compression with per-language dictionaries.

Learning takes a documented, bounded sample of labelled rows: per label the
``SAMPLE_TEXTS`` distinct texts with the smallest hash, ``SAMPLE_CHARS``
normalised characters of each, at most ``DICT_BYTES`` bytes in total.  That
becomes a zstandard raw-content dictionary.  A text is normalised (lower case,
every run of non-letters one space), cut into chunks, and every chunk is
compressed with every dictionary; the label with the smallest total wins, and
``score`` = (second - best) / second.  Ties go to the label with more training
rows, then the smaller label.  Scores under ``min_margin`` are ``rejected``.

The whole text is encoded, never a prefix; chunks keep a long text from
becoming its own dictionary.  Prediction is one Arrow pass without a shuffle.
Learning scans once for (label, hash) pairs, which two rankings thin, and once for the chosen texts, joined on a broadcast of at most
``labels * SAMPLE_TEXTS`` hashes.  Copies count once, so a hot group of copies
takes one place in the sample.

Defined results: null text, or one without a letter: ``und``, score 0, not
rejected unless ``min_margin`` > 0.  No training rows: ``und`` for all.
Repeated rows each get their own result; input columns other than the ones
named are left out by ``identify`` and untouched by the pipeline's use.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from finlens.llm.store import pick
from finlens.llm.textops import release_memory, slices

UNKNOWN = "und"
SAMPLE_TEXTS = 400
RANK_GROUPS = 16
SAMPLE_CHARS = 2000
DICT_BYTES = 96 << 10
CHUNK_BYTES = 4096
LEVEL, MIN_MATCH = 5, 3
# appended to each chunk: with a run to shorten, the encoder never falls back
# to a stored block, so one dictionary match shows in the size of a short text
TAIL = bytes(64)
MIN_MARGIN = 0.002
_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")


def normalise(text: str | None) -> str:
    """Lower-cased letters with single spaces between runs of them."""
    return _NOT_LETTERS.sub(" ", text).strip().lower() if text and _LETTER.search(text) else ""


def learn(df: DataFrame, text_col: str = "text", label_col: str = "lang") -> dict[str, bytes]:
    """label -> dictionary content, in the order that breaks ties.

    ``df`` holds training rows only; rows with a null label or text are
    passed over.
    """
    rows = pick(df, t=text_col, label=label_col).where("t is not null and label is not null")
    rows = rows.withColumn("h", F.xxhash64("t"))
    keys = rows.select("label", "h").distinct()
    # a task sends a label's SAMPLE_TEXTS smallest hashes at most; they are
    # ranked in groups of tasks first, so the last ranking reads at most
    # RANK_GROUPS * SAMPLE_TEXTS hashes of a label, whatever the input
    keys = keys.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(RANK_GROUPS)))
    for by in (["label", "part"], ["label"]):
        place = F.row_number().over(Window.partitionBy(*by).orderBy("h"))
        keys = keys.withColumn("place", place).where(F.col("place") <= SAMPLE_TEXTS).drop("place")
    keys = keys.drop("part")
    chosen = (rows.join(F.broadcast(keys), ["label", "h"])
              .groupBy("label", "h").agg(F.min(F.substring("t", 1, 4 * SAMPLE_CHARS)).alias("t")))
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    content: dict[str, bytes] = {}
    for r in sorted(chosen.collect(), key=lambda r: (r["label"], r["h"])):
        piece = normalise(r["t"])[:SAMPLE_CHARS]
        if piece:
            content[r["label"]] = content.get(r["label"], b"") + piece.encode() + b" "
    order = sorted(content, key=lambda label: (-sizes[label], label))
    return {label: content[label][:DICT_BYTES] for label in order}


class Classifier:
    def __init__(self, content: dict[str, bytes]):
        self.labels = list(content)
        self.coders = []
        for raw in content.values():
            words = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            params = zstandard.ZstdCompressionParameters.from_level(
                LEVEL, min_match=MIN_MATCH, write_content_size=0, write_checksum=0, write_dict_id=0,
                format=zstandard.FORMAT_ZSTD1_MAGICLESS)
            self.coders.append(zstandard.ZstdCompressor(dict_data=words, compression_params=params))

    def __call__(self, text: str | None) -> tuple[str, float]:
        data = normalise(text).encode("utf-8", "surrogatepass")
        if not data or not self.coders:
            return UNKNOWN, 0.0
        chunks = [data[i:i + CHUNK_BYTES] + TAIL for i in range(0, len(data), CHUNK_BYTES)]
        sizes = [sum(len(c.compress(x)) for x in chunks) for c in self.coders]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        if len(sizes) == 1:
            return self.labels[best], 1.0
        second = min(s for i, s in enumerate(sizes) if i != best)
        return self.labels[best], (second - sizes[best]) / second


def predict(content: dict[str, bytes], text: Column) -> Column:
    """struct<lang_pred, score> of a text column."""
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    def classify(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Classifier(content)
        for col in batches:
            for piece in slices(pa.record_batch([col], ["t"]), "t"):
                found = [model(t.as_py()) for t in piece.column(0)]
                yield pa.StructArray.from_arrays(
                    [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                    fields=list(kind))
        release_memory()

    return F.arrow_udf(classify, "struct<lang_pred:string,score:double>")(text)


def identify(df: DataFrame, content: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text",
             min_margin: float = MIN_MARGIN) -> DataFrame:
    """id, lang_pred, score, rejected (margin under ``min_margin``)."""
    rows = pick(df, _id=id_col, _t=text_col)
    rows = rows.select(F.col("_id").alias(id_col), predict(content, F.col("_t")).alias("_p"))
    return rows.select(id_col, "_p.lang_pred", "_p.score", (F.col("_p.score") < min_margin).alias("rejected"))
