"""The two analytical questions.

Order lines are summed per product before they meet the product table: the shuffle
carries one row per product (and year) and task, however many lines a product has,
and the join needs no broadcast to be safe from a best-seller.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.enrich import exact_average
from ledgerlake.operators.ranking import rank_top1_per_group


def line_measures() -> dict[str, Column]:
    """What is summed up of order lines, besides their number."""
    return {
        "revenue": F.sum("total_line_extended_price"),
        "days": F.sum("lead_time_in_business_days"),
        "timed": F.count("lead_time_in_business_days"),
    }


def _sums(orders: DataFrame, *by) -> DataFrame:
    measures = [c.alias(name) for name, c in line_measures().items()]
    return orders.groupBy(*by, "product_id").agg(*measures, F.count("*").alias("lines"))


def line_sums(orders: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All that both questions need of the order lines: sums per product and year, and per ``by``."""
    return _sums(orders, *by, F.year("order_date").alias("year"))


def revenue_of(sums: DataFrame, products: DataFrame) -> DataFrame:
    per_product = sums.groupBy("product_id", "year").agg(F.sum("revenue").alias("revenue"))
    return (
        per_product.join(products.select("product_id", "color"), "product_id")
        .groupBy("year", "color")
        .agg(F.sum("revenue").alias("total_revenue"))
    )


def revenue_by_color_year(orders: DataFrame, products: DataFrame) -> DataFrame:
    """``year``, ``color``, ``total_revenue`` (unrounded). Lines without a known product
    drop out."""
    return revenue_of(line_sums(orders), products)


def top_color_of(sums: DataFrame, products: DataFrame) -> DataFrame:
    best = rank_top1_per_group(revenue_of(sums, products), "year", "total_revenue")
    shown = F.round("total_revenue", 2).cast("decimal(38,2)").alias("total_revenue")
    return best.select("year", "color", shown).orderBy(F.col("year").asc_nulls_last())


def top_color_by_year(orders: DataFrame, products: DataFrame) -> DataFrame:
    """The colour with the highest revenue of each year, ties included. Colours are
    ranked by the exact revenue; what is shown is rounded to cents."""
    return top_color_of(line_sums(orders), products)


def lead_time_of(sums: DataFrame, products: DataFrame) -> DataFrame:
    per_product = sums.groupBy("product_id").agg(
        F.sum("days").alias("days"), F.sum("timed").alias("timed"), F.sum("lines").alias("lines")
    )
    known = products.select("product_id", "product_category_name").where(
        "product_category_name IS NOT NULL"
    )
    return (
        per_product.join(known, "product_id")
        .groupBy("product_category_name")
        .agg(
            exact_average(F.sum("days"), F.sum("timed")).alias("avg_lead_time_business_days"),
            F.sum("lines").alias("order_lines"),
        )
        .orderBy(F.col("avg_lead_time_business_days").asc_nulls_last())
    )


def lead_time_by_category(orders: DataFrame, products: DataFrame) -> DataFrame:
    """``product_category_name``, average lead time in business days, and the number of
    order lines; products without a category are left out. Lines without a lead time
    count as lines but not in the average."""
    return lead_time_of(_sums(orders), products)


def avg_lead_time_by_category(orders: DataFrame, products: DataFrame) -> DataFrame:
    return lead_time_by_category(orders, products).drop("order_lines")
