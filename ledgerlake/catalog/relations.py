"""Joins, aggregations, windows, sorts, and the tables made of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.catalog.registry import query
from ledgerlake.catalog.views import BATCH_TS, RULES, given, product_feed, view
from ledgerlake.contracts import sales_contracts
from ledgerlake.functions.enrich import exact_average
from ledgerlake.functions.typing import typed
from ledgerlake.operators.batches import latest_batch
from ledgerlake.operators.dedup import dedup_by_completeness, dedup_report, duplicate_keys
from ledgerlake.operators.joins import anti_join_orphans, fk_violations, hot_keys, join_on_key
from ledgerlake.operators.ranking import rank_top1_per_group
from ledgerlake.operators.upsert import upsert_by_key
from ledgerlake.plans import analysis, publish, store
from ledgerlake.sources.scratch import new_folder
from ledgerlake.sources.tables import VersionedTable


def published_orders(spark, folder):
    header, detail = view(spark, folder, "header"), view(spark, folder, "detail")
    hot = hot_keys(detail, "sales_order_id")
    return publish.publish_orders(detail, header, BATCH_TS, hot).drop("etl_created_at")


def published_products(spark, folder):
    products = publish.publish_product(view(spark, folder, "product"), BATCH_TS, RULES)
    return products.drop("etl_created_at")


# ---- joins


@query(
    "join_inner_on_key",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, o_custkey, o_orderpriority
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def _(spark, folder):
    lines = given(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"
    )
    orders = given(spark, folder, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderpriority"
    )
    return join_on_key(lines, orders, "l_orderkey", hot=hot_keys(lines, "l_orderkey"))


@query(
    "join_inner_using",
    """SELECT sales_order_detail_id, d.product_id, product_desc, product_category_name
    FROM detail d JOIN product p ON d.product_id = p.product_id""",
)
def _(spark, folder):
    lines = view(spark, folder, "detail").select("sales_order_detail_id", "product_id")
    products = view(spark, folder, "product").select(
        "product_id", "product_desc", "product_category_name"
    )
    return join_on_key(lines, products, "product_id", hot=hot_keys(lines, "product_id"))


@query(
    "anti_join_orphans",
    """SELECT sales_order_detail_id, sales_order_id, product_id, unit_price FROM detail
    WHERE NOT EXISTS (SELECT 1 FROM product p WHERE p.product_id = detail.product_id)""",
)
def _(spark, folder):
    lines = view(spark, folder, "detail").select(
        "sales_order_detail_id", "sales_order_id", "product_id", "unit_price"
    )
    products = view(spark, folder, "product")
    return anti_join_orphans(lines, products, "product_id", hot=hot_keys(lines, "product_id"))


@query(
    "fk_violations",
    """SELECT sales_order_detail_id, sales_order_id, product_id, unit_price FROM detail
    WHERE product_id IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM product p WHERE p.product_id = detail.product_id)""",
)
def _(spark, folder):
    lines = view(spark, folder, "detail").select(
        "sales_order_detail_id", "sales_order_id", "product_id", "unit_price"
    )
    products = view(spark, folder, "product")
    return fk_violations(lines, products, "product_id", hot=hot_keys(lines, "product_id"))


# ---- aggregations


@query(
    "agg_sum_by_group",
    """SELECT CAST(year(order_date) AS INT) AS year, color,
    CAST(sum(total_line_extended_price) AS DECIMAL(38,6)) AS total_revenue
    FROM lines o JOIN published p ON o.product_id = p.product_id GROUP BY 1, 2""",
)
def _(spark, folder):
    revenue = analysis.revenue_by_color_year(
        published_orders(spark, folder), published_products(spark, folder)
    )
    return revenue.withColumn("total_revenue", F.col("total_revenue").cast("decimal(38,6)"))


_AVERAGE = "CAST(CAST((200 * sum({0}) + count({0})) // (2 * count({0})) AS DECIMAL(18,0)) * 0.01 AS DECIMAL(38,2))"


@query(
    "agg_avg_by_group",
    f"SELECT p_type, {_AVERAGE.format('p_size')} AS avg_size FROM part GROUP BY p_type",
)
def _(spark, folder):
    average = exact_average(F.sum("p_size"), F.count("p_size"))
    return given(spark, folder, "part").groupBy("p_type").agg(average.alias("avg_size"))


@query(
    "agg_count_by_group",
    """SELECT product_category_name, count(*) AS order_lines
    FROM detail d JOIN product p ON d.product_id = p.product_id GROUP BY 1""",
)
def _(spark, folder):
    per_product = (
        view(spark, folder, "detail").groupBy("product_id").agg(F.count("*").alias("n"))
    )
    products = view(spark, folder, "product").select("product_id", "product_category_name")
    joined = per_product.join(products, "product_id")
    return joined.groupBy("product_category_name").agg(F.sum("n").alias("order_lines"))


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@query(
    "agg_row_count",
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in _TABLES),
)
def _(spark, folder):
    counts = None
    for t in _TABLES:
        one = given(spark, folder, t).agg(F.count("*").alias("n"))
        one = one.select(F.lit(t).alias("table_name"), "n")
        counts = one if counts is None else counts.unionByName(one)
    return counts


@query("agg_max_scalar", "SELECT max(ts) AS newest FROM events")
def _(spark, folder):
    return given(spark, folder, "events").agg(F.max("ts").alias("newest"))


@query(
    "latest_batch",
    """SELECT event_id, CAST(ts AS DATE) AS batch, user_id, event_type, value FROM events
    WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events)""",
)
def _(spark, folder):
    events = given(spark, folder, "events").select(
        "event_id", F.to_date("ts").alias("batch"), "user_id", "event_type", "value"
    )
    return latest_batch(events, "batch")


_LINE_KEY = ["l_orderkey", "l_linenumber"]


@query(
    "duplicate_keys",
    """SELECT l_orderkey, l_linenumber, count(*) AS occurrences FROM lineitem
    GROUP BY 1, 2 HAVING count(*) > 1""",
)
def _(spark, folder):
    return duplicate_keys(given(spark, folder, "lineitem"), _LINE_KEY)


@query(
    "filter_having",
    """SELECT user_id, count(*) AS events_seen FROM events GROUP BY user_id
    HAVING count(*) > 1""",
)
def _(spark, folder):
    per_user = given(spark, folder, "events").groupBy("user_id")
    return per_user.agg(F.count("*").alias("events_seen")).where("events_seen > 1")


# ---- windows

_LINES_WITH_GAPS = """SELECT * REPLACE (nullif(l_returnflag, 'N') AS l_returnflag,
    nullif(l_linestatus, 'O') AS l_linestatus) FROM lineitem"""


@query(
    "dedup_by_completeness",
    f"""SELECT * EXCLUDE (nth) FROM (SELECT *, row_number() OVER (
      PARTITION BY l_orderkey, l_linenumber ORDER BY
      CAST(l_returnflag IS NULL AS INT) + CAST(l_linestatus IS NULL AS INT),
      l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
      l_returnflag NULLS LAST, l_linestatus NULLS LAST, l_shipdate) AS nth
    FROM ({_LINES_WITH_GAPS}) gaps) ranked WHERE nth = 1""",
)
def _(spark, folder):
    lines = given(spark, folder, "lineitem").withColumns(
        {
            "l_returnflag": F.nullif("l_returnflag", F.lit("N")),
            "l_linestatus": F.nullif("l_linestatus", F.lit("O")),
        }
    )
    return dedup_by_completeness(lines, _LINE_KEY)


@query(
    "dedup_report",
    """SELECT CAST(sum(n) AS BIGINT) AS rows_before, count(*) AS rows_kept,
    CAST(sum(n - 1) AS BIGINT) AS rows_dropped
    FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber) per_key""",
)
def _(spark, folder):
    return dedup_report(given(spark, folder, "lineitem"), _LINE_KEY)


@query(
    "rank_top1_per_group",
    """SELECT * EXCLUDE (place) FROM (SELECT o_custkey, o_orderkey, o_totalprice,
      o_orderpriority, rank() OVER (PARTITION BY o_custkey
        ORDER BY o_totalprice DESC NULLS FIRST) AS place FROM orders) ranked WHERE place = 1""",
)
def _(spark, folder):
    orders = given(spark, folder, "orders").select(
        "o_custkey", "o_orderkey", "o_totalprice", "o_orderpriority"
    )
    return rank_top1_per_group(orders, "o_custkey", "o_totalprice")


@query(
    "filter_rank",
    """SELECT * EXCLUDE (nth) FROM (SELECT user_id, event_id, ts, event_type,
      row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth
    FROM events) ranked WHERE nth = 1""",
)
def _(spark, folder):
    from pyspark.sql import Window

    first = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = given(spark, folder, "events").select("user_id", "event_id", "ts", "event_type")
    return events.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")


# ---- sorts and limits


@query(
    "order_by",
    "SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal NULLS LAST, c_custkey",
)
def _(spark, folder):
    """The key comes last in the order so that many equal balances can be cut into
    several ranges."""
    customers = given(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal")
    return customers.orderBy(F.col("c_acctbal").asc_nulls_last(), "c_custkey")


@query("limit_sample", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10")
def _(spark, folder):
    return given(spark, folder, "orders").orderBy("o_orderkey").limit(10)


# ---- merge by key

_SETTLED = "SELECT * FROM orders WHERE o_orderstatus <> 'O'"
_ARRIVED = (
    "SELECT * REPLACE (o_totalprice + 1 AS o_totalprice) FROM orders WHERE o_orderstatus <> 'F'"
)


@query(
    "upsert_by_key",
    f"""SELECT * FROM ({_ARRIVED}) s UNION ALL SELECT * FROM ({_SETTLED}) t
    WHERE NOT EXISTS (SELECT 1 FROM ({_ARRIVED}) s WHERE s.o_orderkey = t.o_orderkey)""",
)
def _(spark, folder):
    """Open orders are new, pending ones known and changed, finished ones left alone."""
    orders = given(spark, folder, "orders")
    target = orders.where("o_orderstatus <> 'O'")
    source = orders.where("o_orderstatus <> 'F'").withColumn(
        "o_totalprice", F.col("o_totalprice") + 1
    )
    return upsert_by_key(target, source, "o_orderkey")


# ---- the tables of the store, publish and analysis layers

_CONTRACTS = sales_contracts("bigint")
_LINEAGE = ("etl_created_at", "source_file_name")


def _named(text):
    return text.withColumn("source_file_name", F.lit("source.csv"))


@query("store_product", "SELECT * FROM store_product")
def _(spark, folder):
    raw, contract = _named(product_feed(spark, folder)), _CONTRACTS["store_product_master"]
    return store.store_product(raw, contract, BATCH_TS).drop(*_LINEAGE)


@query("store_header", "SELECT * FROM store_header")
def _(spark, folder):
    raw = _named(view(spark, folder, "header_text"))
    return store.store_header(raw, _CONTRACTS["store_sales_order_header"], BATCH_TS).drop(*_LINEAGE)


@query("store_detail", "SELECT * FROM store_detail")
def _(spark, folder):
    raw = _named(view(spark, folder, "detail_text"))
    return store.store_detail(raw, _CONTRACTS["store_sales_order_detail"], BATCH_TS).drop(*_LINEAGE)


def flow_tables(spark, folder):
    """Lines and products as the layers publish them. The lines, which are read again and again, are written down."""
    product = store.store_product(
        _named(product_feed(spark, folder)), _CONTRACTS["store_product_master"], BATCH_TS
    )
    header = store.store_header(
        _named(view(spark, folder, "header_text")), _CONTRACTS["store_sales_order_header"], BATCH_TS
    )
    detail = store.store_detail(
        _named(view(spark, folder, "detail_text")), _CONTRACTS["store_sales_order_detail"], BATCH_TS
    )
    # Where rows go is all that these steer: they are taken before the lines are moved to find repeated ones.
    orders = view(spark, folder, "detail_text").select(typed("SalesOrderID", "bigint").alias("sales_order_id"))
    lines = publish.publish_orders(detail, header, BATCH_TS, hot_keys(orders, "sales_order_id"))
    published = VersionedTable(spark, new_folder(spark, "published"))
    published.replace(lines)
    lines = published.read()
    return lines, publish.publish_product(product, BATCH_TS, RULES)


@query("publish_product", "SELECT * FROM published")
def _(spark, folder):
    return published_products(spark, folder)


@query("publish_orders", "SELECT * FROM lines")
def _(spark, folder):
    return published_orders(spark, folder)


_Q1 = """SELECT year, color, CAST(round(total_revenue, 2) AS DECIMAL(38,2)) AS total_revenue
    FROM (SELECT *, rank() OVER (PARTITION BY year ORDER BY total_revenue DESC NULLS FIRST)
        AS place
      FROM (SELECT CAST(year(order_date) AS INT) AS year, color,
          sum(total_line_extended_price) AS total_revenue
        FROM {orders} o JOIN {products} p ON o.product_id = p.product_id GROUP BY 1, 2) revenue
    ) ranked WHERE place = 1"""

_Q2 = f"""SELECT product_category_name,
      {_AVERAGE.format("lead_time_in_business_days")} AS avg_lead_time_business_days,
      count(*) AS order_lines
    FROM {{orders}} o JOIN {{products}} p ON o.product_id = p.product_id
    WHERE product_category_name IS NOT NULL GROUP BY 1"""

Q1 = _Q1.format(orders="lines", products="published")
Q2 = _Q2.format(orders="lines", products="published")
FLOW_Q1 = _Q1.format(orders="flow_orders", products="flow_product")
FLOW_Q2 = _Q2.format(orders="flow_orders", products="flow_product")


@query("q1_revenue_by_color_year", Q1)
def q1(spark, folder):
    return analysis.top_color_by_year(
        published_orders(spark, folder), published_products(spark, folder)
    )


@query(
    "q2_avg_lead_time_by_category",
    f"SELECT product_category_name, avg_lead_time_business_days FROM ({Q2}) q",
)
def _(spark, folder):
    return analysis.avg_lead_time_by_category(
        published_orders(spark, folder), published_products(spark, folder)
    )


@query("q2_with_line_counts", Q2)
def _(spark, folder):
    return analysis.lead_time_by_category(
        published_orders(spark, folder), published_products(spark, folder)
    )
