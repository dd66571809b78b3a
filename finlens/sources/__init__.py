"""Scans, fixtures derived from the driver tables, and file sources/sinks."""

from finlens.sources.fixtures import projects  # noqa: F401
from finlens.sources.tables import read_table  # noqa: F401
