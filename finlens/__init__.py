"""finlens — project-finance portfolio analytics as lazy Spark DataFrame plans.

Every public function takes DataFrames (and plain Python parameters) and
returns a DataFrame.  Nothing is collected to the driver; no SparkSession is
created inside the library except by :mod:`finlens.session`.
"""

from finlens.schema import CANONICAL_FIELDS, CANONICAL_SCHEMA  # noqa: F401

__all__ = ["CANONICAL_FIELDS", "CANONICAL_SCHEMA"]
