"""Canonical schema, field groups and the fixed values the semantics depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values (must equal the reference for identical results) ---------
CANONICAL_FIELDS = [
    "project_id",
    "project_name",
    "finance_type",
    "sector",
    "province",
    "district",
    "latitude",
    "longitude",
    "status",
    "approval_date",
    "construction_start_date",
    "financial_close_date",
    "operation_date",
    "committed_usd",
    "disbursed_usd",
    "year",
]
DATE_FIELDS = [
    "approval_date",
    "construction_start_date",
    "financial_close_date",
    "operation_date",
]
NUMERIC_FIELDS = ["latitude", "longitude", "committed_usd", "disbursed_usd"]
STRING_FIELDS = [
    "project_id",
    "project_name",
    "finance_type",
    "sector",
    "province",
    "district",
    "status",
]
FINANCE_TYPES = ["DF", "FDI"]

# status -> risk weight; statuses not listed weigh 0
DEFAULT_RISK_WEIGHTS = {"cancelled": 1.0, "stalled": 0.8, "delayed": 0.5}
# statuses whose disbursement does not count as active exposure
INACTIVE_STATUSES = ["cancelled", "stalled"]

# lifecycle funnel stages, in display order
FUNNEL_STAGES = [
    ("Approved", "approval_date"),
    ("Financial Close", "financial_close_date"),
    ("Construction Start", "construction_start_date"),
    ("Operation", "operation_date"),
]

# fields the enrichment source may fill when the primary row has a null
ENRICH_FILL_FIELDS = [
    "sector",
    "province",
    "district",
    "latitude",
    "longitude",
    "status",
    "approval_date",
    "construction_start_date",
    "financial_close_date",
    "operation_date",
    "committed_usd",
    "disbursed_usd",
    "year",
]

# country-column hints and the default country filter
COUNTRY_HINTS = ["country", "recipient", "host"]
DEFAULT_COUNTRY = "indonesia"
DEFAULT_COUNTRY_ISO = "IDN"

# location candidate lists used when a source has no explicit mapping
PROVINCE_CANDIDATES = [
    "Available ADM1 Level",
    "Province",
    "State/Province",
    "Region",
    "Project Location",
    "Location",
    "ADM1",
]
DISTRICT_CANDIDATES = [
    "Available ADM2 Level",
    "District",
    "City",
    "Kabupaten",
    "Kota",
    "ADM2",
]
LATITUDE_CANDIDATES = ["Latitude", "latitude", "Lat", "lat", "Y", "y_coord"]
LONGITUDE_CANDIDATES = ["Longitude", "longitude", "Lon", "lng", "Long", "X", "x_coord"]

# browser app: statuses shown in the status-by-year chart
BROWSER_STATUSES = [
    "Completion",
    "Implementation",
    "Pipeline: Commitment",
    "Pipeline: Pledge",
    "Suspended",
]
# ---------------------------------------------------------------------------

_TYPE_OF = {
    **{c: T.StringType() for c in STRING_FIELDS},
    **{c: T.DoubleType() for c in NUMERIC_FIELDS},
    **{c: T.DateType() for c in DATE_FIELDS},
    "year": T.IntegerType(),
}

CANONICAL_SCHEMA = T.StructType(
    [T.StructField(c, _TYPE_OF[c], True) for c in CANONICAL_FIELDS]
)


def spark_type(column: str) -> T.DataType:
    return _TYPE_OF[column]
