"""The given tables, seen as products, orders and order lines.

Each view is one SELECT in SQL that Spark and other engines read alike, so queries
and their check start from the same rows. What real feeds get wrong is put in by
rule: colours and categories are missing for some names and types, some order dates
lack the day, some orders have no sales person, some lines are returns, and some
lines name no product or one that does not exist.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.functions.enrich import Rule

BATCH_TS = "2026-01-15 06:00:00"

# What stands in for the category rules on these tables' product names.
RULES = (
    Rule("Clothing", values=("ring", "plate")),
    Rule("Accessories", values=("bolt", "gear")),
    Rule("Components", values=("rod",), fragments=("wid",)),
)

_COLOR = "CASE WHEN split_part(p_name, ' ', 1) IN ('new', 'old') THEN NULL ELSE split_part(p_name, ' ', 1) END"
_CATEGORY = "CASE WHEN p_type IN ('PROMO', 'SMALL') THEN NULL ELSE p_type END"
_SUB_CATEGORY = "split_part(p_name, ' ', 2)"

# One to fifteen days by priority and status.
_SHIP_DAYS = (
    "3 * CAST(substr(o_orderpriority, 1, 1) AS INT) - 2"
    " + CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END"
)
_ORDERED = "CAST(o_orderdate AS DATE)"
_IS_RETURN = "l_returnflag = 'R' AND l_linestatus = 'F' AND l_linenumber = 1"
_QTY = f"CASE WHEN {_IS_RETURN} THEN -1 ELSE CAST(l_quantity AS INT) END"
_NO_PRODUCT = "l_returnflag = 'N' AND l_quantity = 50"
_BAD_PRODUCT = "l_returnflag = 'A' AND l_quantity = 49"
_LINE_ID = "l_orderkey * 10 + l_linenumber"

# name: (source table, select list). Names are in the order they build on each other.
_SOURCES = {
    "product": (
        "part",
        f"""p_partkey AS product_id, p_name AS product_desc, p_brand AS product_number,
        p_size >= 25 AS make_flag, {_COLOR} AS color, CAST(p_size AS STRING) AS size,
        CAST(p_retailprice AS DECIMAL(18,6)) AS list_price,
        {_CATEGORY} AS product_category_name, {_SUB_CATEGORY} AS product_sub_category_name""",
    ),
    "header": (
        "orders",
        f"""o_orderkey AS sales_order_id, {_ORDERED} AS order_date,
        CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN {_ORDERED}
             ELSE {_ORDERED} + ({_SHIP_DAYS}) END AS ship_date,
        o_orderstatus = 'F' AS online_order_flag,
        '10-4030-' || lpad(CAST(o_custkey AS STRING), 6, '0') AS account_number,
        o_custkey AS customer_id,
        CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_custkey END AS sales_person_id,
        CAST(o_totalprice AS DECIMAL(18,4)) AS freight""",
    ),
    "detail": (
        "lineitem",
        f"""{_LINE_ID} AS sales_order_detail_id, l_orderkey AS sales_order_id,
        {_QTY} AS order_qty,
        CASE WHEN {_NO_PRODUCT} THEN NULL
             WHEN {_BAD_PRODUCT} THEN l_partkey + 1000000000000 ELSE l_partkey END AS product_id,
        CAST(l_extendedprice AS DECIMAL(18,6)) AS unit_price,
        CAST(l_discount AS DECIMAL(18,6)) AS unit_price_discount,
        CAST(l_shipdate AS DATE) AS ship_date""",
    ),
    "product_text": (
        "part",
        f"""CAST(p_partkey AS STRING) AS "ProductID", p_name AS "ProductDesc",
        p_brand AS "ProductNumber",
        CASE WHEN p_size >= 25 THEN 'True' ELSE 'False' END AS "MakeFlag",
        coalesce({_COLOR}, '') AS "Color", CAST(p_size * 10 AS STRING) AS "SafetyStockLevel",
        CAST(p_size AS STRING) AS "ReorderPoint",
        CAST(CAST(p_retailprice AS DECIMAL(18,6)) AS STRING) AS "StandardCost",
        CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS STRING) AS "ListPrice",
        CASE WHEN p_type = 'LARGE' THEN 'L' ELSE CAST(p_size AS STRING) END AS "Size",
        CASE WHEN p_type = 'LARGE' THEN '' ELSE 'CM ' END AS "SizeUnitMeasureCode",
        CASE WHEN p_type = 'ECONOMY' THEN '  '
             ELSE CAST(p_size AS STRING) || '.25' END AS "Weight",
        CASE WHEN p_type = 'ECONOMY' THEN '' ELSE 'LB ' END AS "WeightUnitMeasureCode",
        coalesce({_CATEGORY}, '') AS "ProductCategoryName",
        {_SUB_CATEGORY} AS "ProductSubCategoryName" """,
    ),
    "header_text": (
        "orders",
        f"""CAST(o_orderkey AS STRING) AS "SalesOrderID",
        CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P'
             THEN substr(CAST({_ORDERED} AS STRING), 1, 7)
             WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'P' THEN ' '
             ELSE CAST({_ORDERED} AS STRING) END AS "OrderDate",
        CAST({_ORDERED} + ({_SHIP_DAYS}) AS STRING) AS "ShipDate",
        CASE WHEN o_orderstatus = 'F' THEN 'True' ELSE 'False' END AS "OnlineOrderFlag",
        ' 10-4030-' || lpad(CAST(o_custkey AS STRING), 6, '0') AS "AccountNumber",
        CAST(o_custkey AS STRING) AS "CustomerID",
        CASE WHEN o_orderstatus = 'F' THEN '' ELSE CAST(o_custkey AS STRING) END AS "SalesPersonID",
        CAST(CAST(o_totalprice AS DECIMAL(18,4)) AS STRING) AS "Freight" """,
    ),
    "detail_text": (
        "lineitem",
        f"""CAST({_LINE_ID} AS STRING) AS "SalesOrderDetailID",
        CAST(l_orderkey AS STRING) AS "SalesOrderID", CAST({_QTY} AS STRING) AS "OrderQty",
        CASE WHEN {_NO_PRODUCT} THEN NULL ELSE CAST(l_partkey AS STRING) END AS "ProductID",
        CAST(CAST(l_extendedprice AS DECIMAL(18,6)) AS STRING) AS "UnitPrice",
        CAST(CAST(l_discount AS DECIMAL(18,6)) AS STRING) AS "UnitPriceDiscount" """,
    ),
}

# Second copies of some products, with the category filled in: what dedup resolves.
_FULLER = """SELECT "ProductID", "ProductDesc", "ProductNumber", "MakeFlag", "Color",
    "SafetyStockLevel", "ReorderPoint", "StandardCost", "ListPrice", "Size",
    "SizeUnitMeasureCode", "Weight", "WeightUnitMeasureCode",
    'Clothing' AS "ProductCategoryName", 'Shirt' AS "ProductSubCategoryName"
    FROM product_text WHERE "ProductCategoryName" = '' AND "Color" <> ''"""

_ENRICHED = """CASE WHEN product_category_name IS NOT NULL THEN product_category_name
             WHEN product_sub_category_name IN ('ring', 'plate') THEN 'Clothing'
             WHEN product_sub_category_name IN ('bolt', 'gear') THEN 'Accessories'
             WHEN contains(product_sub_category_name, 'wid')
               OR product_sub_category_name = 'rod' THEN 'Components'
             ELSE NULL END AS product_category_name"""

# The same conversions, merges and joins as the library, in SQL.
_DERIVED = {
    "product_feed": f"SELECT * FROM product_text UNION ALL {_FULLER}",
    "store_product": """SELECT product_id, product_desc, product_number, make_flag, color,
        safety_stock_level, reorder_point, standard_cost, list_price, size,
        size_unit_measure_code, weight, weight_unit_measure_code, product_category_name,
        product_sub_category_name FROM (
      SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY
        CAST(color IS NULL AS INT) + CAST(size IS NULL AS INT)
        + CAST(size_unit_measure_code IS NULL AS INT) + CAST(weight IS NULL AS INT)
        + CAST(weight_unit_measure_code IS NULL AS INT)
        + CAST(product_category_name IS NULL AS INT),
        product_category_name NULLS LAST, product_sub_category_name NULLS LAST) AS nth
      FROM (SELECT CAST("ProductID" AS BIGINT) AS product_id, "ProductDesc" AS product_desc,
        "ProductNumber" AS product_number, CAST("MakeFlag" AS BOOLEAN) AS make_flag,
        nullif(trim("Color"), '') AS color,
        CAST("SafetyStockLevel" AS INT) AS safety_stock_level,
        CAST("ReorderPoint" AS INT) AS reorder_point,
        CAST("StandardCost" AS DECIMAL(18,6)) AS standard_cost,
        CAST("ListPrice" AS DECIMAL(18,6)) AS list_price,
        nullif(trim("Size"), '') AS size,
        nullif(trim("SizeUnitMeasureCode"), '') AS size_unit_measure_code,
        CAST(nullif(trim("Weight"), '') AS FLOAT) AS weight,
        nullif(trim("WeightUnitMeasureCode"), '') AS weight_unit_measure_code,
        nullif(trim("ProductCategoryName"), '') AS product_category_name,
        nullif(trim("ProductSubCategoryName"), '') AS product_sub_category_name
        FROM product_feed) typed) ranked WHERE nth = 1""",
    "store_header": """SELECT CAST("SalesOrderID" AS BIGINT) AS sales_order_id,
        CASE WHEN length(trim("OrderDate")) > 7 THEN CAST(trim("OrderDate") AS DATE)
             ELSE CAST("ShipDate" AS DATE) - 7 END AS order_date,
        CAST("ShipDate" AS DATE) AS ship_date,
        CAST("OnlineOrderFlag" AS BOOLEAN) AS online_order_flag,
        trim("AccountNumber") AS account_number, CAST("CustomerID" AS BIGINT) AS customer_id,
        CAST(nullif("SalesPersonID", '') AS BIGINT) AS sales_person_id,
        CAST("Freight" AS DECIMAL(18,4)) AS freight FROM header_text""",
    "store_detail": """SELECT sales_order_detail_id, sales_order_id, order_qty, product_id,
        unit_price, unit_price_discount FROM (
      SELECT *, row_number() OVER (PARTITION BY sales_order_detail_id ORDER BY
        CAST(product_id IS NULL AS INT), sales_order_id, order_qty, product_id NULLS LAST,
        unit_price, unit_price_discount) AS nth
      FROM (SELECT CAST("SalesOrderDetailID" AS BIGINT) AS sales_order_detail_id,
        CAST("SalesOrderID" AS BIGINT) AS sales_order_id, CAST("OrderQty" AS INT) AS order_qty,
        CAST("ProductID" AS BIGINT) AS product_id,
        CAST("UnitPrice" AS DECIMAL(18,6)) AS unit_price,
        CAST("UnitPriceDiscount" AS DECIMAL(18,6)) AS unit_price_discount
        FROM detail_text) typed) ranked WHERE nth = 1""",
    "calendar": """SELECT d AS day, CAST(sum(CASE WHEN isodow(d) < 6 THEN 1 ELSE 0 END)
        OVER (ORDER BY d) AS INT) AS weekdays
      FROM (SELECT CAST(range AS DATE) AS d
            FROM range(DATE '1990-01-01', DATE '2010-01-01', INTERVAL 1 DAY)) days""",
    "lines": """SELECT d.sales_order_detail_id, d.sales_order_id, order_qty, product_id,
        unit_price, unit_price_discount,
        CAST(order_qty * (unit_price - unit_price_discount) AS DECIMAL(18,6))
          AS total_line_extended_price,
        order_date, h.ship_date, online_order_flag, account_number, customer_id,
        sales_person_id, freight AS total_order_freight,
        greatest(0, s.weekdays - o.weekdays) AS lead_time_in_business_days
      FROM detail d JOIN header h ON d.sales_order_id = h.sales_order_id
      JOIN calendar o ON o.day = h.order_date JOIN calendar s ON s.day = h.ship_date""",
    "published": f"""SELECT * REPLACE (coalesce(color, 'N/A') AS color, {_ENRICHED})
      FROM product""",
    "flow_orders": """SELECT d.sales_order_detail_id, d.sales_order_id, order_qty, product_id,
        unit_price, unit_price_discount,
        CAST(order_qty * (unit_price - unit_price_discount) AS DECIMAL(18,6))
          AS total_line_extended_price,
        order_date, ship_date, online_order_flag, account_number, customer_id,
        sales_person_id, freight AS total_order_freight,
        greatest(0, s.weekdays - o.weekdays) AS lead_time_in_business_days
      FROM store_detail d JOIN store_header h ON d.sales_order_id = h.sales_order_id
      JOIN calendar o ON o.day = h.order_date JOIN calendar s ON s.day = h.ship_date""",
    "flow_product": f"""SELECT * REPLACE (coalesce(color, 'N/A') AS color, {_ENRICHED})
      FROM store_product""",
}

_DEFINITIONS = {
    **{n: f"SELECT {columns} FROM {table}" for n, (table, columns) in _SOURCES.items()},
    **_DERIVED,
}


def with_definitions(sql: str) -> str:
    """``sql`` behind the definitions of the views it names, directly or through others."""
    needed: set[str] = set()
    todo = [sql]
    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        for name in _DEFINITIONS.keys() & words - needed:
            needed.add(name)
            todo.append(_DEFINITIONS[name])
    if not needed:
        return sql
    parts = [f"{n} AS ({_DEFINITIONS[n]})" for n in _DEFINITIONS if n in needed]
    return "WITH " + ",\n".join(parts) + "\n" + sql


def given(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A view over a given table, computed by Spark."""
    table, columns = _SOURCES[name]
    text = columns.replace('"', "`")
    return spark.sql(f"SELECT {text} FROM {{source}}", source=given(spark, folder, table))


def product_feed(spark: SparkSession, folder: str) -> DataFrame:
    """Products as text, some of them twice."""
    once = view(spark, folder, "product_text")
    fuller = once.where("ProductCategoryName = '' AND Color <> ''").withColumns(
        {"ProductCategoryName": F.lit("Clothing"), "ProductSubCategoryName": F.lit("Shirt")}
    )
    return once.unionByName(fuller)
