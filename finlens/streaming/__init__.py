"""Structured Streaming form of the conform run (incremental ingestion)."""

from finlens.streaming.ingest import start_incremental_conform  # noqa: F401
