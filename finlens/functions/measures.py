"""Per-row portfolio measures as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from finlens.schema import DEFAULT_RISK_WEIGHTS, INACTIVE_STATUSES


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def safe_divide(num: Column, den: Column) -> Column:
    """num / den, null when den is 0 or null (ANSI-safe)."""
    return num / F.nullif(den, F.lit(0.0))


def realization_rate(committed: Column | str = "committed_usd", disbursed: Column | str = "disbursed_usd") -> Column:
    return safe_divide(_c(disbursed).cast("double"), _c(committed).cast("double"))


def implementation_days(approval: Column | str = "approval_date", operation: Column | str = "operation_date") -> Column:
    """Whole days from approval to operation, floored (dates: calendar days)."""
    a, o = _c(approval), _c(operation)
    return F.datediff(o.cast("date"), a.cast("date"))


def is_active(status: Column | str = "status") -> Column:
    """A null status counts as active (NOT IN would yield null in SQL)."""
    return ~F.coalesce(F.lower(_c(status)).isin(INACTIVE_STATUSES), F.lit(False))


def active_exposure(disbursed: Column | str = "disbursed_usd", status: Column | str = "status") -> Column:
    """Disbursed (null -> 0) for active rows, 0 for cancelled/stalled."""
    return F.when(is_active(status), F.coalesce(_c(disbursed).cast("double"), F.lit(0.0))).otherwise(F.lit(0.0))


def risk_weight(status: Column | str = "status", weights: dict[str, float] | None = None) -> Column:
    """Case-insensitive status -> weight; unmapped and null statuses weigh 0."""
    table = weights or DEFAULT_RISK_WEIGHTS
    s = F.lower(_c(status))
    expr = None
    for name, weight in table.items():
        expr = (F.when(s == F.lit(name.lower()), F.lit(float(weight))) if expr is None
                else expr.when(s == F.lit(name.lower()), F.lit(float(weight))))
    return F.lit(0.0) if expr is None else expr.otherwise(F.lit(0.0))


def risk_exposure(committed: Column | str = "committed_usd") -> Column:
    """Exposure used by the risk index: committed when > 0, else 1."""
    c = _c(committed).cast("double")
    return F.when(c > 0, c).otherwise(F.lit(1.0))
