"""Projections, casts, scalar expressions and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.catalog.registry import query
from ledgerlake.catalog.views import BATCH_TS, RULES, given, view
from ledgerlake.functions import calendars, enrich, typing
from ledgerlake.operators.batches import add_audit_columns
from ledgerlake.operators.joins import hot_keys, join_on_key
from ledgerlake.plans.validation import formula_deviation


def _dated_lines(spark, folder):
    """Order lines with the order's date."""
    orders = given(spark, folder, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"),
        F.col("o_orderdate").cast("date").alias("order_date"),
    )
    lines = given(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.col("l_shipdate").cast("date").alias("ship_date"),
    )
    return join_on_key(lines, orders, "l_orderkey", hot=hot_keys(lines, "l_orderkey"))


@query(
    "add_audit_columns",
    f"""SELECT *, TIMESTAMP '{BATCH_TS}' AS etl_created_at, 'orders.csv' AS source_file_name
    FROM header""",
)
def _(spark, folder):
    stamped = add_audit_columns(view(spark, folder, "header"), BATCH_TS, "orders.csv")
    return stamped.withColumn("etl_created_at", F.col("etl_created_at").cast("timestamp_ntz"))


@query(
    "rename_project",
    """SELECT p_partkey AS product_id, p_name AS product_desc, p_brand AS product_number,
    p_retailprice AS list_price FROM part""",
)
def _(spark, folder):
    return given(spark, folder, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_desc"),
        F.col("p_brand").alias("product_number"),
        F.col("p_retailprice").alias("list_price"),
    )


@query("rename_on_read", "SELECT sales_order_id, freight AS total_order_freight FROM header")
def _(spark, folder):
    header = view(spark, folder, "header").withColumnRenamed("freight", "total_order_freight")
    return header.select("sales_order_id", "total_order_freight")


@query("drop_columns", "SELECT p_partkey, p_name, p_type, p_size, p_retailprice FROM part")
def _(spark, folder):
    return given(spark, folder, "part").drop("p_brand")


@query(
    "typed_cast",
    """SELECT CAST("SalesOrderDetailID" AS BIGINT) AS detail_id,
    CAST("OrderQty" AS INT) AS qty, CAST("ProductID" AS BIGINT) AS product_id,
    CAST("UnitPrice" AS DECIMAL(18,6)) AS price, CAST("UnitPrice" AS DECIMAL(18,4)) AS price4,
    CAST(NULL AS INT) AS not_a_number, CAST(floor(CAST("UnitPrice" AS DECIMAL(18,6))) AS INT)
      AS whole_price,
    CASE WHEN CAST("OrderQty" AS INT) < 0 THEN true ELSE false END AS is_return
    FROM detail_text""",
)
def _(spark, folder):
    text = view(spark, folder, "detail_text").withColumns(
        {
            "flag": F.when(F.col("OrderQty").startswith("-"), F.lit("True")).otherwise("False"),
            "word": F.concat(F.lit("x"), F.col("OrderQty")),
        }
    )
    return text.select(
        typing.typed("SalesOrderDetailID", "bigint").alias("detail_id"),
        typing.typed("OrderQty", "int").alias("qty"),
        typing.typed("ProductID", "bigint").alias("product_id"),
        typing.typed("UnitPrice", "decimal(18,6)").alias("price"),
        typing.typed("UnitPrice", "decimal(18,4)").alias("price4"),
        typing.typed("word", "int").alias("not_a_number"),
        typing.typed("UnitPrice", "int").alias("whole_price"),
        typing.typed("flag", "boolean").alias("is_return"),
    )


@query(
    "blank_to_null",
    """SELECT "ProductID" AS product_id, nullif(trim("Color"), '') AS color,
    nullif(trim("SizeUnitMeasureCode"), '') AS unit FROM product_text""",
)
def _(spark, folder):
    return view(spark, folder, "product_text").select(
        F.col("ProductID").alias("product_id"),
        typing.blank_to_null("Color").alias("color"),
        typing.blank_to_null("SizeUnitMeasureCode").alias("unit"),
    )


@query(
    "nullable_int",
    """SELECT "SalesOrderID" AS order_id, CAST(nullif("SalesPersonID", '') AS INT)
    AS sales_person_id FROM header_text""",
)
def _(spark, folder):
    return view(spark, folder, "header_text").select(
        F.col("SalesOrderID").alias("order_id"),
        typing.nullable_int("SalesPersonID").alias("sales_person_id"),
    )


@query(
    "nullable_float",
    """SELECT "ProductID" AS product_id, CAST(nullif(trim("Weight"), '') AS FLOAT) AS weight
    FROM product_text""",
)
def _(spark, folder):
    return view(spark, folder, "product_text").select(
        F.col("ProductID").alias("product_id"), typing.nullable_float("Weight").alias("weight")
    )


@query(
    "trim_text",
    """SELECT "SalesOrderID" AS order_id, trim("AccountNumber") AS account FROM header_text""",
)
def _(spark, folder):
    return view(spark, folder, "header_text").select(
        F.col("SalesOrderID").alias("order_id"), F.trim("AccountNumber").alias("account")
    )


@query(
    "parse_date",
    """SELECT "SalesOrderID" AS order_id, CAST("ShipDate" AS DATE) AS ship_date,
    CASE WHEN length(trim("OrderDate")) > 7 THEN CAST("OrderDate" AS DATE) END AS order_date
    FROM header_text""",
)
def _(spark, folder):
    return view(spark, folder, "header_text").select(
        F.col("SalesOrderID").alias("order_id"),
        typing.parse_date("ShipDate").alias("ship_date"),
        typing.parse_date("OrderDate").alias("order_date"),
    )


@query("repair_partial_date", "SELECT sales_order_id, order_date, ship_date FROM store_header")
def _(spark, folder):
    shipped = typing.parse_date("ShipDate")
    return view(spark, folder, "header_text").select(
        typing.to_whole("SalesOrderID", "bigint").alias("sales_order_id"),
        typing.repair_partial_date("OrderDate", shipped).alias("order_date"),
        shipped.alias("ship_date"),
    )


@query("default_when_null", "SELECT product_id, coalesce(color, 'N/A') AS color FROM product")
def _(spark, folder):
    color = F.coalesce("color", F.lit(enrich.NO_COLOR)).alias("color")
    return view(spark, folder, "product").select("product_id", color)


@query(
    "rule_enrichment",
    "SELECT product_id, product_category_name, product_sub_category_name FROM published",
)
def _(spark, folder):
    category = enrich.rule_enrichment(
        F.col("product_category_name"), F.col("product_sub_category_name"), RULES
    )
    return view(spark, folder, "product").select(
        "product_id", category.alias("product_category_name"), "product_sub_category_name"
    )


@query(
    "line_total",
    """SELECT sales_order_detail_id, order_qty, CAST(order_qty * (unit_price
    - unit_price_discount) AS DECIMAL(18,6)) AS total_line_extended_price FROM detail""",
)
def _(spark, folder):
    total = enrich.line_total(F.col("order_qty"), F.col("unit_price"), F.col("unit_price_discount"))
    return view(spark, folder, "detail").select(
        "sales_order_detail_id", "order_qty", total.alias("total_line_extended_price")
    )


@query(
    "business_days_between",
    """SELECT l_orderkey, l_linenumber, CAST(o_orderdate AS DATE) AS order_date,
    CAST(l_shipdate AS DATE) AS ship_date,
    greatest(0, s.weekdays - o.weekdays) AS business_days
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN calendar o ON o.day = CAST(o_orderdate AS DATE)
    JOIN calendar s ON s.day = CAST(l_shipdate AS DATE)""",
)
def _(spark, folder):
    lines = _dated_lines(spark, folder).select(
        "l_orderkey", "l_linenumber", "order_date", "ship_date"
    )
    days = calendars.business_days_between(F.col("order_date"), F.col("ship_date"))
    return lines.withColumn("business_days", days)


@query(
    "extract_year",
    "SELECT sales_order_id, CAST(year(order_date) AS INT) AS year FROM header",
)
def _(spark, folder):
    header = view(spark, folder, "header")
    return header.select("sales_order_id", F.year("order_date").alias("year"))


@query(
    "round_money",
    """SELECT sales_order_detail_id, CAST(round(unit_price * unit_price_discount, 2)
    AS DECIMAL(38,2)) AS discount_money FROM detail""",
)
def _(spark, folder):
    money = F.round(F.col("unit_price") * F.col("unit_price_discount"), 2).cast("decimal(38,2)")
    return view(spark, folder, "detail").select(
        "sales_order_detail_id", money.alias("discount_money")
    )


@query(
    "formula_deviation",
    """SELECT sales_order_detail_id, CAST(abs(CAST(abs(order_qty) * unit_price AS DECIMAL(18,6))
    - order_qty * (unit_price - unit_price_discount)) AS DECIMAL(18,6)) AS deviation
    FROM detail""",
)
def _(spark, folder):
    claimed = (F.abs("order_qty") * F.col("unit_price")).cast("decimal(18,6)")
    deviation = formula_deviation(
        claimed, F.col("order_qty"), F.col("unit_price"), F.col("unit_price_discount")
    )
    return view(spark, folder, "detail").select(
        "sales_order_detail_id", deviation.cast("decimal(18,6)").alias("deviation")
    )


@query(
    "filter_not_null",
    "SELECT product_id, product_category_name FROM product WHERE product_category_name IS NOT NULL",
)
def _(spark, folder):
    products = view(spark, folder, "product").select("product_id", "product_category_name")
    return products.where(F.col("product_category_name").isNotNull())


@query("filter_null", "SELECT product_id, product_desc FROM product WHERE color IS NULL")
def _(spark, folder):
    products = view(spark, folder, "product").where(F.col("color").isNull())
    return products.select("product_id", "product_desc")


@query(
    "filter_compare",
    """SELECT l_orderkey, l_linenumber, l_partkey, CAST(o_orderdate AS DATE) AS order_date,
    CAST(l_shipdate AS DATE) AS ship_date FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    WHERE CAST(l_shipdate AS DATE) <= CAST(o_orderdate AS DATE)""",
)
def _(spark, folder):
    late = _dated_lines(spark, folder).where(F.col("ship_date") <= F.col("order_date"))
    return late.select("l_orderkey", "l_linenumber", "l_partkey", "order_date", "ship_date")


@query(
    "filter_in_list",
    """SELECT p_partkey, p_type, p_name FROM part
    WHERE p_type IN ('PROMO', 'LARGE') OR contains(p_name, 'wid')""",
)
def _(spark, folder):
    part = given(spark, folder, "part").select("p_partkey", "p_type", "p_name")
    return part.where(F.col("p_type").isin("PROMO", "LARGE") | F.col("p_name").contains("wid"))
