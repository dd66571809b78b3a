"""Deterministic project identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ID_PREFIX = "gen_"
ID_HEX_CHARS = 16


def deterministic_id(source: Column | str, name: Column, year: Column, country: Column) -> Column:
    """'gen_' + first 16 hex chars of sha1('source|name|year|country').

    Null parts become '' (``concat_ws`` would skip them and shift the fields).
    ``source`` is the logical source name, not a file path.
    """
    src = F.lit(source) if isinstance(source, str) else source
    payload = F.concat(
        src,
        F.lit("|"),
        F.coalesce(name.cast("string"), F.lit("")),
        F.lit("|"),
        F.coalesce(year.cast("string"), F.lit("")),
        F.lit("|"),
        F.coalesce(country.cast("string"), F.lit("")),
    )
    return F.concat(F.lit(ID_PREFIX), F.substring(F.sha1(payload.cast("binary")), 1, ID_HEX_CHARS))


def deterministic_id_sql(source: str, name: str, year: str, country: str) -> str:
    """SQL form of :func:`deterministic_id` over SQL expressions."""
    src = "'" + source.replace("'", "''") + "'"
    payload = (f"concat({src}, '|', coalesce(CAST({name} AS STRING), ''), '|', "
               f"coalesce(CAST({year} AS STRING), ''), '|', coalesce(CAST({country} AS STRING), ''))")
    return f"concat('{ID_PREFIX}', substring(sha1(CAST({payload} AS BINARY)), 1, {ID_HEX_CHARS}))"
