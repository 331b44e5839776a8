"""Batches: audit columns and the newest batch of an append-only table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def add_audit_columns(df: DataFrame, batch_ts: str, source_name: Column | str) -> DataFrame:
    """Stamp rows with the run's one timestamp and the file they came from.

    The timestamp is a value handed in, not the clock, so that every action on the
    same batch writes the same stamp."""
    source = F.lit(source_name) if isinstance(source_name, str) else source_name
    return df.withColumns(
        {"etl_created_at": F.lit(batch_ts).cast("timestamp"), "source_file_name": source}
    )


def latest_batch(df: DataFrame, stamp: str | Column = "etl_created_at") -> DataFrame:
    """Rows that carry the highest stamp.

    The maximum is a scalar subquery: a small aggregate whose value then reaches the
    scan as a filter, and prunes directories when the stamp is a partition column."""
    stamp = F.col(stamp) if isinstance(stamp, str) else stamp
    return df.where(stamp == df.select(F.max(stamp)).scalar())

