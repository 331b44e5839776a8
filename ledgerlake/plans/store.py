"""Raw text to typed, keyed store rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.contracts import Field, TableContract
from ledgerlake.functions.typing import blank_to_null, parse_date, repair_partial_date, typed
from ledgerlake.operators.dedup import dedup_by_completeness


def _conform(f: Field) -> Column:
    text = blank_to_null(f.raw) if f.blank_is_null else F.col(f.raw)
    if f.dtype == "string":
        return F.trim(text) if f.trim else text
    return typed(text, f.dtype)


def store_rows(
    raw: DataFrame,
    contract: TableContract,
    batch_ts: str,
    computed: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Raw columns renamed and typed in contract order, stamped, one row per key.

    ``computed`` replaces the plain conversion of a column. Where ``raw`` holds several
    batches (``batch_id``), a key's rows of the newest batch stand for it."""
    computed = {"etl_created_at": F.lit(batch_ts).cast("timestamp"), **(computed or {})}
    columns = []
    for f in contract.fields:
        value = computed.get(f.name)
        if value is None:
            value = _conform(f) if f.raw else F.col(f.name)
        columns.append(value.alias(f.name))
    if "batch_id" not in raw.columns:
        return dedup_by_completeness(raw.select(*columns), contract.key)
    columns.append(F.col("batch_id").cast("string").alias("_batch"))
    return dedup_by_completeness(raw.select(*columns), contract.key, newest="_batch")


def store_product(raw: DataFrame, contract: TableContract, batch_ts: str) -> DataFrame:
    return store_rows(raw, contract, batch_ts)


def store_header(
    raw: DataFrame, contract: TableContract, batch_ts: str, gap_days: int = 7
) -> DataFrame:
    """Order dates that lack the day are set to the shipping date less ``gap_days``."""
    shipped = parse_date("ShipDate")
    ordered = repair_partial_date("OrderDate", shipped, gap_days)
    return store_rows(raw, contract, batch_ts, {"order_date": ordered, "ship_date": shipped})


def store_detail(raw: DataFrame, contract: TableContract, batch_ts: str) -> DataFrame:
    return store_rows(raw, contract, batch_ts)
