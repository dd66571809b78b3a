"""Named queries: a Spark plan builder plus (when SQL can say it) oracle SQL.

A query reads the driver tables under ``sf_dir`` (or data Spark derives from
them) and returns a lazy DataFrame.  The oracle SQL is independent ANSI SQL
for DuckDB over the same tables, used to check results.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Builder
    oracle: str | None
    operators: tuple[str, ...] = field(default_factory=tuple)
    doc: str = ""


REGISTRY: dict[str, Query] = {}


def register(name: str, operators: tuple[str, ...] | list[str], oracle: str | None):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""

    def wrap(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query name {name!r}")
        REGISTRY[name] = Query(name, fn, oracle, tuple(operators), (fn.__doc__ or "").strip())
        return fn

    return wrap
