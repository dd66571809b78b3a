"""Numeric cleaning expressions (ANSI-safe: no expression here can raise)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A cleaned numeric literal: optional sign, digits with optional fraction or a
# bare fraction, optional exponent.  Guarding with it keeps Spark from
# accepting strings such as '1d' that a strict numeric parser rejects.
NUMERIC_PATTERN = "^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def nan_to_null(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def clean_numeric_sql(x: str, multiplier: float = 1.0) -> str:
    """SQL for text expression ``x``: drop ',' '$' ')', turn '(' into '-',
    trim, parse as double, scale.  Unparsable text and NaN become null."""
    t = f"trim(replace(translate(CAST({x} AS STRING), ',$)', ''), '(', '-'))"
    # strict literal check without a regex: only digits, sign, point and
    # exponent characters may appear, and the parse must succeed (this
    # rejects '1d', 'NaN', 'Infinity' and blanks exactly as NUMERIC_PATTERN)
    v = f"CASE WHEN {t} <> '' AND translate({t}, '0123456789+-.eE', '') = '' THEN try_cast({t} AS DOUBLE) END"
    return v if multiplier == 1.0 else f"({v}) * CAST({float(multiplier)!r} AS DOUBLE)"


def clean_numeric(col: str, multiplier: float = 1.0) -> Column:
    """Column ``col`` (text or number) cleaned and parsed as DOUBLE."""
    from finlens.functions.dates import quote

    return F.expr(clean_numeric_sql(quote(col), multiplier))


def strict_numeric_sql(x: str) -> str:
    """SQL for text expression ``x``: a plain numeric literal as double, all
    else (currency signs, separators, parentheses) null."""
    t = f"trim(CAST({x} AS STRING))"
    return f"CASE WHEN {t} RLIKE '{NUMERIC_PATTERN}' THEN try_cast({t} AS DOUBLE) END"


def exact_pct(num: str, den: str, digits: int) -> Column:
    """100 * num / den rounded half-up to ``digits`` decimals, computed in
    exact integer arithmetic (so every engine agrees, ties included); null
    when ``den`` is 0.  ``num`` and ``den`` are count column names."""
    scale = 10 ** digits
    n = f"CAST(`{num}` AS BIGINT)"
    d = f"CAST(`{den}` AS BIGINT)"
    return F.expr(f"CASE WHEN {d} > 0 THEN (({n} * {200 * scale} + {d}) div ({d} * 2)) / CAST({scale} AS DOUBLE) END")
