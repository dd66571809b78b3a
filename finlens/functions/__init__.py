"""Column-expression builders (all native Spark expressions, codegen-friendly)."""

from finlens.functions.dates import parse_date_any  # noqa: F401
from finlens.functions.ids import deterministic_id  # noqa: F401
from finlens.functions.measures import (  # noqa: F401
    active_exposure,
    implementation_days,
    realization_rate,
    risk_exposure,
    risk_weight,
    safe_divide,
)
from finlens.functions.numeric import clean_numeric, nan_to_null  # noqa: F401
from finlens.functions.text import (  # noqa: F401
    blank_to_null,
    name_key,
    title_case_words,
    unknown_if_blank,
)
