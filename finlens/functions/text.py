"""String expressions: blank handling, name keys, sector title case."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(col: Column | str) -> Column:
    """trim, then '' -> null (the canonical string rule)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def unknown_if_blank(col: Column | str, label: str = "Unknown") -> Column:
    """null or blank -> ``label``; otherwise the trimmed value."""
    return F.coalesce(blank_to_null(col), F.lit(label))


def name_key(col: Column | str) -> Column:
    """Name matching key: lower, collapse whitespace, drop [^a-z0-9 ], trim.

    The order matters: whitespace collapses *before* punctuation is removed,
    so ``a - b`` keeps two spaces.
    """
    c = F.col(col) if isinstance(col, str) else col
    lowered = F.lower(c.cast("string"))
    # a lone space stays as it is and need not match
    collapsed = F.regexp_replace(lowered, r"\s{2,}|[^\S ]", " ")
    stripped = F.regexp_replace(collapsed, r"[^a-z0-9 ]+", "")
    return F.trim(stripped)


def title_case_words(col: Column | str) -> Column:
    """Sector label normalisation of the browser app.

    trim, collapse whitespace, lower-case, then upper-case every ASCII letter
    that starts a word (a letter preceded by a non-word character or the
    start).  ``initcap`` alone only splits on spaces, so the string is cut
    into alternating word / non-word runs and each word run is capitalised.
    """
    c = F.col(col) if isinstance(col, str) else col
    base = F.lower(F.regexp_replace(F.trim(c.cast("string")), r"\s+", " "))
    runs = F.regexp_extract_all(base, F.lit(r"([a-z0-9_]+|[^a-z0-9_]+)"), 1)
    capped = F.transform(
        runs,
        lambda r: F.when(
            r.rlike("^[a-z]"), F.concat(F.upper(F.substring(r, 1, 1)), F.substring(r, 2, 1 << 30))
        ).otherwise(r),
    )
    return F.when(c.isNull() | (c.cast("string") == ""), c.cast("string")).otherwise(
        F.array_join(capped, "")
    )


def normalize_column_name(name: str) -> str:
    """Driver-side: lower-case and keep only [a-z0-9] (used while planning)."""
    return re.sub(r"[^a-z0-9]+", "", str(name).lower())
