"""Store rows to business-ready rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.contracts import sales_contracts
from ledgerlake.functions.calendars import business_days_between
from ledgerlake.functions.enrich import CATEGORY_RULES, NO_COLOR, Rule, line_total, rule_enrichment
from ledgerlake.operators.joins import join_on_key


_CONTRACTS = sales_contracts()


def _own(table: str) -> list[str]:
    """Columns of a store table that come from its source."""
    return [f.name for f in _CONTRACTS[table].fields if f.raw]


def publish_product(
    store: DataFrame, batch_ts: str, rules: Sequence[Rule] = CATEGORY_RULES
) -> DataFrame:
    """Missing colours named, missing categories filled in by rule, lineage dropped."""
    category, sub_category = F.col("product_category_name"), F.col("product_sub_category_name")
    return store.withColumns(
        {
            "color": F.coalesce("color", F.lit(NO_COLOR)),
            "product_category_name": rule_enrichment(category, sub_category, rules),
            "etl_created_at": F.lit(batch_ts).cast("timestamp"),
        }
    ).drop("source_file_name")


def publish_orders(
    detail: DataFrame, header: DataFrame, batch_ts: str, hot: Sequence[int] = ()
) -> DataFrame:
    """Order lines with their order's columns, the line total and the lead time.

    ``hot`` names orders with very many lines (`hot_keys(detail, "sales_order_id")`)."""
    lines = detail.select(*_own("store_sales_order_detail"))
    orders = header.select(*_own("store_sales_order_header"))
    return published_lines(join_on_key(lines, orders, "sales_order_id", hot=hot), batch_ts)


def published_lines(joined: DataFrame, batch_ts: str) -> DataFrame:
    """Joined lines and orders as published."""
    computed = {
        "total_line_extended_price": line_total(
            F.col("order_qty"), F.col("unit_price"), F.col("unit_price_discount")
        ),
        "total_order_freight": F.col("freight"),
        "lead_time_in_business_days": business_days_between(
            F.col("order_date"), F.col("ship_date")
        ),
        "etl_created_at": F.lit(batch_ts).cast("timestamp"),
    }
    return joined.select(
        *[computed.get(c, F.col(c)).alias(c) for c in _CONTRACTS["publish_orders"].columns]
    )
