"""Date parsing: a fixed, ordered list of layouts plus spreadsheet serial days.

Built as SQL text (one ``F.expr`` per field keeps plan construction cheap).
Each layout is tried only when the text already has its shape: a failed
format parse is an exception inside the engine, and doing that for every row
and layout is what makes naive multi-format parsing slow at scale.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed layouts, tried in this order (row-local, independent of row order);
# a time of day may follow a full date and is dropped:
#   yyyy-MM-dd, yyyy/MM/dd, M/d/yyyy, bare yyyy (Jan 1), serial days
EXCEL_EPOCH = "1899-12-30"
_TIME = "([ T][0-9]{1,2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?( ?[AaPp][Mm]|Z|[+-][0-9]{2}:?[0-9]{2})?)?$"
ISO_SHAPE = "^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}" + _TIME
SLASH_SHAPE = "^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}" + _TIME
MDY_SHAPE = "^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}" + _TIME
YEAR_SHAPE = "^[0-9]{4}$"
SERIAL_SHAPE = "^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)$"


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _text(x: str) -> str:
    return f"nullif(trim(CAST({x} AS STRING)), '')"


def _calendar_cases(t: str) -> list[str]:
    # each shape regex runs only after a cheap LIKE / length pre-check passes
    day = f"substring_index(substring_index({t}, ' ', 1), 'T', 1)"
    return [
        f"CASE WHEN {t} LIKE '____-%' AND {t} RLIKE '{ISO_SHAPE}' THEN try_cast({day} AS DATE) END",
        f"CASE WHEN {t} LIKE '____/%' AND {t} RLIKE '{SLASH_SHAPE}' THEN try_cast(replace({day}, '/', '-') AS DATE) END",
        f"CASE WHEN {t} LIKE '%/%/%' AND {t} RLIKE '{MDY_SHAPE}' "
        f"THEN CAST(try_to_timestamp({day}, 'M/d/yyyy') AS DATE) END",
        f"CASE WHEN length({t}) = 4 AND {t} RLIKE '{YEAR_SHAPE}' THEN try_cast(concat({t}, '-01-01') AS DATE) END",
    ]


def calendar_date_sql(x: str) -> str:
    """SQL for text expression ``x`` -> DATE, calendar layouts only."""
    return f"coalesce({', '.join(_calendar_cases(_text(x)))})"


def parse_date_sql(x: str) -> str:
    """SQL for text expression ``x`` -> DATE (null when no layout fits).

    Never casts free text straight to a date/timestamp ('43831' would
    become year 43831); the serial-day branch handles plain numbers.
    """
    t = _text(x)
    serial = (
        f"CASE WHEN translate({t}, '0123456789.+-', '') = '' AND {t} RLIKE '{SERIAL_SHAPE}' "
        f"AND try_cast({t} AS DOUBLE) BETWEEN -693593 AND 2958465 "
        f"THEN date_add(DATE'{EXCEL_EPOCH}', CAST(floor(try_cast({t} AS DOUBLE)) AS INT)) END")
    return f"coalesce({', '.join([*_calendar_cases(t), serial])})"


def parse_date_any(col: str) -> Column:
    """Column ``col`` (text, date or timestamp) -> DATE."""
    return F.expr(parse_date_sql(quote(col)))
