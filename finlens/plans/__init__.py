"""Query catalogue: importing this package registers every named query."""

from finlens.plans import browser_queries, etl_queries, facet_queries, file_queries, geo_queries, metric_queries, report_queries  # noqa: F401
from finlens.plans.registry import REGISTRY, Query  # noqa: F401


def all_queries() -> dict[str, Query]:
    return dict(REGISTRY)
