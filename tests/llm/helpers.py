from __future__ import annotations

import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# names an operator might use for columns of its own
CLASHING = ("score", "kept", "t", "id", "_t", "_p", "node", "th", "size", "target", "host", "n_tokens", "words", "key")


def words(text):
    return WORDS.findall(text or "")


def lower(text):
    return (text or "").translate(_AZ)


def documents(spark, texts, **columns):
    """Rows of the documents schema: doc_id 0.., given texts."""
    rows = [(i, t, columns.get("lang", ["en"] * len(texts))[i], columns.get("source", ["s"] * len(texts))[i],
             None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def with_clashes(df, but=()):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("x") for c in CLASHING if c not in df.columns and c not in but})


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


EDGE_TEXTS = [
    None, "", "   \n\t ", "one", "One two", "a b c d e f g h i j k l", "1234 5678", "é ü ß ñ", "x " * 5000,
    "same text in two rows here", "same text in two rows here", " ".join(f"w{i % 701}" for i in range(30000)),
]
