"""Facet filters and facet option lists.

A facet is one of year, finance_type, sector, province, status (plus the
optional sponsor_type, which the canonical table does not carry).  Filters
are conjunctions of ``isin`` predicates; those on plain columns are pushed
down when the input is a scan (finance_type is compared upper-cased and
prunes partitions instead).

The dashboard filter (C4) skips a facet whose selection equals *all* its
options, so rows with a null value survive.  Given the option lists, that is
settled while planning; else a one-row aggregate decides inside the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finlens.functions.text import blank_to_null

FACETS = ["year", "finance_type", "sector", "province", "status", "sponsor_type"]
FACET_LABELS = {
    "year": "Year",
    "finance_type": "Finance Type",
    "sector": "Sector",
    "province": "Province",
    "status": "Status",
    "sponsor_type": "Sponsor Type",
}
PREFERRED_FINANCE = ["DF", "FDI"]


def _option_value(df: DataFrame, facet: str) -> Column | None:
    """The facet's option expression (the value an option list is built from)."""
    if facet not in df.columns:
        return None
    if facet == "year":
        return F.col("year").cast("int").cast("string")
    if facet == "finance_type":
        return blank_to_null(F.upper(F.col("finance_type")))
    return blank_to_null(F.col(facet))


def _row_value(facet: str) -> Column:
    """The row value the selection is tested against."""
    if facet == "year":
        return F.col("year").cast("int").cast("string")
    if facet == "finance_type":
        return F.upper(F.col("finance_type"))
    return F.col(facet)


def _selection(facet: str, values: list) -> list[str]:
    out: list[str] = []
    for v in values:
        if facet == "year":
            try:
                out.append(str(int(v)))
            except (TypeError, ValueError):
                continue
        elif facet == "finance_type":
            out.append(str(v).upper())
        else:
            out.append(str(v))
    return sorted(set(out))


def apply_facets_strict(projects: DataFrame, selections: dict[str, list]) -> DataFrame:
    """Every facet with a non-empty list becomes ``col IN (list)``;
    null values never match."""
    df = projects
    for facet in FACETS:
        values = selections.get(facet) or []
        if values and facet in df.columns:
            df = df.where(F.col(facet).isin(list(values)))
    return df


def selection_flags(projects: DataFrame, selections: dict[str, list]) -> DataFrame:
    """One row: for each selected facet, whether the selection equals the
    full option set (``_all_<facet>``).  One pass over the table.

    The option set is the distinct non-blank values; selection == options
    iff no option lies outside the selection and every selected value is an
    option.
    """
    return projects.agg(*_flag_aggs(projects, selections))


def _flag_aggs(projects: DataFrame, selections: dict[str, list]) -> list[Column]:
    aggs: list[Column] = [F.count(F.lit(1)).alias("_rows")]
    for facet in FACETS:
        sel = _selection(facet, selections.get(facet) or [])
        opt = _option_value(projects, facet)
        if not sel or opt is None:
            continue
        # selection == options: no option outside the selection, and each
        # selected value occurs (one boolean max per selected value — no
        # distinct-count expansion of the rows)
        outside = F.count_if(opt.isNotNull() & ~opt.isin(sel))
        present = [F.max(F.coalesce(opt == F.lit(v), F.lit(False))) for v in sel]
        every = present[0]
        for p in present[1:]:
            every = every & p
        aggs.append(((outside == 0) & every).alias(f"_all_{facet}"))
        aggs.append(F.count(opt).alias(f"_opts_{facet}"))
    return aggs


MAX_OPTIONS = 100_000


def option_lists(projects: DataFrame, facets: list[str]) -> dict[str, list[str]]:
    """The option lists of some facets, as a dashboard holds them (one job
    over distinct values).  Lists of more than ``MAX_OPTIONS`` values in all
    are no dashboard's: an error, not a cut list."""
    rows = facet_values(projects).where(F.col("facet").isin(facets)).limit(MAX_OPTIONS + 1).collect()
    if len(rows) > MAX_OPTIONS:
        raise ValueError(f"more than {MAX_OPTIONS} facet options; filter without option lists instead")
    return {f: [r["value"] for r in rows if r["facet"] == f] for f in facets}


def apply_facets(projects: DataFrame, selections: dict[str, list], options: dict[str, list] | None = None) -> DataFrame:
    """C4: the dashboard filter.  A facet is applied only when its selection
    is non-empty and differs from the full option list; finance_type matches
    case-insensitively and year as an integer.

    With ``options`` (facet -> option list) the comparison is settled while
    planning and what remains are plain predicates that reach the scan.
    Without, it is a one-row aggregate inside the plan."""
    active = [f for f in FACETS if _selection(f, selections.get(f) or []) and f in projects.columns]
    if not active:
        return projects
    if options is not None:
        df = projects
        for facet in active:
            sel = _selection(facet, selections[facet])
            if set(sel) == set(_selection(facet, options.get(facet) or [])):
                continue
            if facet == "year":
                df = df.where(F.col("year").isin([int(v) for v in sel]))
            elif facet == "finance_type":
                df = df.where(F.upper("finance_type").isin(sel))
            else:
                df = df.where(F.col(facet).isin(sel))
        return df
    flags = selection_flags(projects, selections)
    f = flags.select(F.struct(*flags.columns)).scalar()  # one row, a scalar subquery
    df = projects
    for facet in active:
        sel = _selection(facet, selections[facet])
        if facet == "finance_type":
            # an all-blank finance column falls back to the DF/FDI options
            all_sel = F.when(f["_opts_finance_type"] == 0,
                             F.lit(set(sel) == set(PREFERRED_FINANCE))).otherwise(f["_all_finance_type"])
        else:
            all_sel = f[f"_all_{facet}"]
        df = df.where(all_sel | F.coalesce(_row_value(facet).isin(sel), F.lit(False)))
    return df


def facet_values(projects: DataFrame) -> DataFrame:
    """E47 + H3: the option list of every facet as rows
    (facet, position, value); DF and FDI lead the finance types, years sort
    numerically, the rest lexicographically.  Distinct values come from one
    stacked ``distinct`` (a shuffle of distinct values, not of rows)."""
    parts = []
    for facet in FACETS:
        opt = _option_value(projects, facet)
        if opt is None:
            continue
        if facet == "year":
            key = F.lpad(opt, 12, "0")
        elif facet == "finance_type":
            key = F.when(opt == "DF", F.lit("0")).when(opt == "FDI", F.lit("1")).otherwise(F.concat(F.lit("2"), opt))
        else:
            key = opt
        parts.append(F.struct(F.lit(facet).alias("facet"), opt.alias("value"), key.alias("sort_key")))
    stacked = projects.select(F.explode(F.array(*parts)).alias("f")).select("f.*").where(F.col("value").isNotNull())
    ft = _option_value(projects, "finance_type")
    if ft is not None:
        # a non-empty table whose finance types are all blank still offers DF, FDI
        n = projects.agg(F.struct(F.count(F.lit(1)).alias("rows"), F.count(ft).alias("typed"))).scalar()
        fallback = projects.sparkSession.createDataFrame(
            [("finance_type", v, str(i)) for i, v in enumerate(PREFERRED_FINANCE)], "facet string, value string, sort_key string"
        ).where((n["rows"] > 0) & (n["typed"] == 0))
        stacked = stacked.unionByName(fallback)
    distinct = stacked.distinct()
    from pyspark.sql.window import Window

    # one window partition per facet over *distinct* values only
    w = Window.partitionBy("facet").orderBy("sort_key")
    return distinct.select("facet", F.row_number().over(w).cast("int").alias("position"), "value")


def facet_narrowing(projects: DataFrame, selections: dict[str, list], rows_col: str | None = None) -> DataFrame:
    """For each selected facet: is it narrowing (selection non-empty,
    options non-empty, selection != options), how many rows its predicate
    alone keeps, and how many rows the whole dashboard filter keeps — in a
    single aggregate pass.  ``rows_col`` says how many projects a row stands
    for (cells of the facet cube)."""
    weight = F.col(rows_col) if rows_col else F.lit(1)
    per_facet = []
    aggs = _flag_aggs(projects, selections)
    for facet in FACETS:
        sel = _selection(facet, selections.get(facet) or [])
        if not sel or facet not in projects.columns:
            continue
        hit = F.when(F.coalesce(_row_value(facet).isin(sel), F.lit(False)), weight).otherwise(0)
        aggs.append(F.coalesce(F.sum(hit), F.lit(0)).alias(f"_hit_{facet}"))
        per_facet.append((facet, sel))
    if not per_facet:
        return projects.sparkSession.createDataFrame(
            [], "facet string, label string, selected string, narrowing boolean, rows_matching bigint, "
                "rows_after_filter bigint"
        )
    row = projects.agg(*aggs).withColumn(
        "rows_after_filter", apply_facets(projects, selections).agg(F.coalesce(F.sum(weight), F.lit(0))).scalar())
    stacked = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(facet).alias("facet"),
                    F.lit(FACET_LABELS[facet]).alias("label"),
                    F.lit(", ".join(sel)).alias("selected"),
                    ((F.col(f"_opts_{facet}") > 0) & ~F.col(f"_all_{facet}")).alias("narrowing"),
                    F.col(f"_hit_{facet}").cast("bigint").alias("rows_matching"),
                    F.col("rows_after_filter").cast("bigint").alias("rows_after_filter"),
                )
                for facet, sel in per_facet
            ]
        )
    )
    return row.select(stacked.alias("n")).select("n.*")
