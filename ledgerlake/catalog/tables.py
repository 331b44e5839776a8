"""Scans, sinks, file sets and whole flows. What these write goes to a new folder
under the one the session names for shared files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.catalog import relations
from ledgerlake.catalog.registry import query
from ledgerlake.catalog.views import BATCH_TS, RULES, given, product_feed, view
from ledgerlake.plans import analysis, publish, run
from ledgerlake.sources.bucketed import BucketedTable, buckets_for, join_colocated
from ledgerlake.sources.csv import csv_scan_raw
from ledgerlake.sources.files import (
    changed_files,
    file_fingerprint,
    manifest_upsert,
    missing_sources,
)
from ledgerlake.sources.scratch import new_folder
from ledgerlake.sources.tables import BatchTable, BucketSummary, KeyedTable, VersionedTable

LATER_TS = "2026-01-16 06:00:00"


def write_csv(df: DataFrame, folder: str) -> str:
    (
        df.write.option("header", "true")
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", "false")
        .option("ignoreTrailingWhiteSpace", "false")
        .csv(folder)
    )
    return folder


def _union(parts):
    return reduce(DataFrame.unionByName, parts)


# ---- scans and sinks


@query("csv_scan_raw", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang FROM documents")
def _(spark, folder):
    """Whole documents: line breaks, quotes and separators inside the fields."""
    documents = given(spark, folder, "documents").select("doc_id", "text", "lang")
    path = write_csv(documents, new_folder(spark, "csv"))
    return csv_scan_raw(spark, path).drop("source_file_name")


@query("csv_scan_raw_framed", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang FROM documents")
def _(spark, folder):
    """The same from many files, a task each."""
    documents = given(spark, folder, "documents").select("doc_id", "text", "lang")
    path = write_csv(documents.repartition(32, "doc_id"), new_folder(spark, "csv"))
    return csv_scan_raw(spark, path).drop("source_file_name")


@query(
    "csv_scan_raw_in_splits",
    """SELECT "SalesOrderID", "OrderDate", "ShipDate", "OnlineOrderFlag",
    "AccountNumber", "CustomerID", nullif("SalesPersonID", '') AS "SalesPersonID", "Freight"
    FROM header_text""",
)
def _(spark, folder):
    """A feed without line breaks in its fields is read the same way."""
    path = write_csv(view(spark, folder, "header_text"), new_folder(spark, "csv"))
    return csv_scan_raw(spark, path).drop("source_file_name")


@query("parquet_scan", "SELECT p_partkey, p_name, p_retailprice FROM part")
def _(spark, folder):
    return given(spark, folder, "part").select("p_partkey", "p_name", "p_retailprice")


@query(
    "parquet_append_sink",
    """SELECT o_orderkey, o_totalprice, 'b1' AS batch_id FROM orders
    UNION ALL SELECT o_orderkey, o_totalprice + 1, 'b2' FROM orders WHERE o_orderstatus <> 'F'""",
)
def _(spark, folder):
    orders = given(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    table = BatchTable(spark, new_folder(spark, "append"))
    first = orders.drop("o_orderstatus")
    second = orders.where("o_orderstatus <> 'F'").select(
        "o_orderkey", (F.col("o_totalprice") + 1).alias("o_totalprice")
    )
    table.append(first, "b1")
    table.append(second, "b2")
    table.append(second, "b2")  # the same batch again changes nothing
    return table.read()


@query("parquet_overwrite_sink", "SELECT p_partkey, p_size + 1 AS p_size FROM part")
def _(spark, folder):
    part = given(spark, folder, "part").select("p_partkey", "p_size")
    table = VersionedTable(spark, new_folder(spark, "overwrite"))
    table.replace(part)
    table.replace(table.read().withColumn("p_size", F.col("p_size") + 1))
    return table.read()


@query("rebuild_table", relations.Q1)
def _(spark, folder):
    table = VersionedTable(spark, new_folder(spark, "rebuild"))
    table.replace(relations.q1(spark, folder))
    return table.read()


@query(
    "upsert_keyed_table",
    f"""SELECT * FROM ({relations._ARRIVED}) s UNION ALL SELECT * FROM ({relations._SETTLED}) t
    WHERE NOT EXISTS (SELECT 1 FROM ({relations._ARRIVED}) s WHERE s.o_orderkey = t.o_orderkey)""",
)
def _(spark, folder):
    """The same merge as `upsert_by_key`, into a stored table."""
    orders = given(spark, folder, "orders")
    source = orders.where("o_orderstatus <> 'F'").withColumn(
        "o_totalprice", F.col("o_totalprice") + 1
    )
    table = KeyedTable(spark, new_folder(spark, "keyed"), "o_orderkey", buckets=4)
    table.merge(orders.where("o_orderstatus <> 'O'"))
    table.merge(source)
    return table.read()


@query(
    "agg_row_count_on_write",
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in ("orders", "lineitem")),
)
def _(spark, folder):
    """Counted by the write itself."""
    counts = [
        (t, VersionedTable(spark, new_folder(spark, t)).replace(given(spark, folder, t)))
        for t in ("orders", "lineitem")
    ]
    return spark.createDataFrame(counts, "table_name string, n bigint")


@query(
    "batches_with_other_columns",
    """SELECT o_orderkey, o_totalprice, CAST(NULL AS VARCHAR) AS o_orderstatus, 'b1' AS batch_id FROM orders
    UNION ALL SELECT o_orderkey, NULL, o_orderstatus, 'b2' FROM orders""",
)
def _(spark, folder):
    """A batch lacks a column of an earlier one and adds another."""
    orders = given(spark, folder, "orders")
    table = BatchTable(spark, new_folder(spark, "columns"))
    table.append(orders.select("o_orderkey", "o_totalprice"), "b1")
    table.append(orders.select("o_orderkey", "o_orderstatus"), "b2")
    return table.read()


def _by_order(spark, folder):
    """Headers and lines, stored in equally many buckets of the order's key."""
    sides, tables = {name: view(spark, folder, name) for name in ("header", "detail")}, []
    buckets = buckets_for(*sides.values(), least=8)
    for name, side in sides.items():
        table = BucketedTable(spark, new_folder(spark, name), "sales_order_id", buckets)
        table.replace(side)
        tables.append(table)
    return tables


@query(
    "join_colocated",
    """SELECT d.sales_order_detail_id, d.sales_order_id, d.order_qty, h.customer_id, h.order_date
    FROM detail d JOIN header h ON d.sales_order_id = h.sales_order_id""",
)
def _(spark, folder):
    header, detail = _by_order(spark, folder)
    joined = join_colocated(detail, header)
    return joined.select("sales_order_detail_id", "sales_order_id", "order_qty", "customer_id", "order_date")


@query("publish_orders_colocated", "SELECT * FROM lines")
def _(spark, folder):
    """As `publish_orders`, from stored sides that no shuffle moves."""
    header, lines = _by_order(spark, folder)
    detail = lines.read().drop("ship_date")
    joined = detail.join(header.read(), "sales_order_id")
    return publish.published_lines(joined, BATCH_TS).drop("etl_created_at")


def _kept_sums(spark, folder):
    """Sums of published lines after two deliveries, and products. The first has wrong totals and lead times in
    lines of over ten pieces and lacks lines of one piece; the second replaces and adds these."""
    table = KeyedTable(spark, new_folder(spark, "lines"), "sales_order_detail_id", buckets=4)
    sums = BucketSummary(table, new_folder(spark, "sums"), analysis.line_sums)
    lines, products = relations.flow_tables(spark, folder)
    wrong = F.col("order_qty") > 10
    price, lead = F.col("total_line_extended_price"), F.col("lead_time_in_business_days")
    table.merge(
        lines.where("order_qty <> 1").withColumns(
            {
                "total_line_extended_price": F.when(wrong, price + 1).otherwise(price).cast("decimal(18,6)"),
                "lead_time_in_business_days": F.when(wrong, lead + 1).otherwise(lead),
            }
        )
    )
    sums.refresh()
    table.merge(lines.where(wrong | (F.col("order_qty") == 1)))
    return sums.refresh(), products


@query("q1_kept_up_to_date", relations.FLOW_Q1)
def _(spark, folder):
    return analysis.top_color_of(*_kept_sums(spark, folder))


@query("q2_kept_up_to_date", relations.FLOW_Q2)
def _(spark, folder):
    return analysis.lead_time_of(*_kept_sums(spark, folder))


# ---- file sets


_FILES = 64


@query(
    "file_fingerprint",
    f"""SELECT doc_id % {_FILES} AS part, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS file_size_bytes,
    md5(string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id)) AS file_hash FROM documents GROUP BY 1""",
)
def _(spark, folder):
    """The whole texts of the documents in files, each with a line end, in order of their numbers."""
    path = new_folder(spark, "text")
    text = F.coalesce("text", F.lit("")).alias("text")
    parts = given(spark, folder, "documents").select((F.col("doc_id") % _FILES).alias("part"), "doc_id", text)
    ordered = parts.repartition("part").sortWithinPartitions("part", "doc_id")
    ordered.select("part", "text").write.partitionBy("part").text(path)
    key = F.regexp_extract("file_path", r"part=(\d+)/", 1).cast("bigint")
    return file_fingerprint(spark, path, "*.txt").select(key.alias("part"), "file_size_bytes", "file_hash")


def _document_files(spark, folder):
    """Every document as a source file: its key, size and the hash of its whole text."""
    return given(spark, folder, "documents").select(
        F.concat(F.col("lang"), F.lit("/"), F.col("doc_id")).alias("file_key"),
        F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_name"),
        F.concat(F.lit("/in/"), F.col("doc_id"), F.lit(".txt")).alias("file_path"),
        F.md5("text").alias("file_hash"),
        F.octet_length("text").cast("bigint").alias("file_size_bytes"),
        "lang",
    )


def _known_files(files):
    """What an earlier run is taken to have loaded: English and French unchanged, German
    with other content, Spanish not at all."""
    known_hash = F.when(F.col("lang") == "de", F.md5("file_key")).otherwise(F.col("file_hash"))
    return files.where("lang <> 'es'").withColumn("file_hash", known_hash)


_FILES_SQL = """SELECT lang || '/' || doc_id AS file_key, doc_id || '.txt' AS file_name,
    '/in/' || doc_id || '.txt' AS file_path, md5(text) AS file_hash,
    CAST(strlen(text) AS BIGINT) AS file_size_bytes, lang FROM documents"""
_KNOWN_SQL = f"""SELECT * REPLACE (CASE WHEN lang = 'de' THEN md5(file_key) ELSE file_hash END
    AS file_hash) FROM ({_FILES_SQL}) f WHERE lang <> 'es'"""
_CHANGED_SQL = f"""SELECT f.file_key, f.file_hash, f.file_size_bytes FROM ({_FILES_SQL}) f
    LEFT JOIN ({_KNOWN_SQL}) k ON f.file_key = k.file_key
    WHERE k.file_hash IS DISTINCT FROM f.file_hash"""


@query("changed_files", _CHANGED_SQL)
def _(spark, folder):
    files = _document_files(spark, folder)
    changed = changed_files(files, _known_files(files))
    return changed.select("file_key", "file_hash", "file_size_bytes")


@query(
    "manifest_upsert",
    f"""SELECT f.file_key, f.file_name, f.file_hash, f.file_size_bytes,
      CASE WHEN k.file_key IS NULL THEN 1 WHEN k.file_hash <> f.file_hash THEN 2 ELSE 1 END
        AS load_count,
      CASE WHEN k.file_hash IS DISTINCT FROM f.file_hash THEN '{LATER_TS}' ELSE '{BATCH_TS}' END
        AS last_loaded_at
    FROM ({_FILES_SQL}) f LEFT JOIN ({_KNOWN_SQL}) k ON f.file_key = k.file_key""",
)
def _(spark, folder):
    files = _document_files(spark, folder).withColumn(
        "last_modified_at", F.lit(BATCH_TS).cast("timestamp")
    )
    before = _known_files(files).select(
        "file_key", "file_name", "file_path", "file_hash", "file_size_bytes", "last_modified_at",
        F.lit(BATCH_TS).cast("timestamp").alias("last_loaded_at"), F.lit(1).alias("load_count"),
    )
    after = manifest_upsert(before, changed_files(files, before), LATER_TS)
    return after.select(
        "file_key", "file_name", "file_hash", "file_size_bytes", "load_count",
        F.date_format("last_loaded_at", "yyyy-MM-dd HH:mm:ss").alias("last_loaded_at"),
    )


@query(
    "missing_source_check",
    """SELECT doc_id, lang FROM documents d WHERE NOT EXISTS
    (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""",
)
def _(spark, folder):
    """Every document is expected to have come with a label."""
    expected = given(spark, folder, "documents").select("doc_id", "lang")
    return missing_sources(expected, given(spark, folder, "labels"), "doc_id")


# ---- flows


def _feeds(spark, folder, entities=tuple(run.ENTITIES)):
    """The given tables as the CSV files of source entities."""
    root = new_folder(spark, "feeds")
    feeds = {
        "products": lambda: product_feed(spark, folder),
        "sales_order_header": lambda: view(spark, folder, "header_text"),
        "sales_order_detail": lambda: view(spark, folder, "detail_text"),
    }
    return {entity: write_csv(feeds[entity](), f"{root}/{entity}") for entity in entities}


def _product_halves(spark, folder):
    """The product feed as two deliveries; a key is in one of them."""
    root, feed = new_folder(spark, "feeds"), product_feed(spark, folder)
    odd = F.pmod(F.xxhash64("ProductID"), F.lit(2)) == 1
    return write_csv(feed.where(odd), f"{root}/1"), write_csv(feed.where(~odd), f"{root}/2")


def _new_lake(spark):
    return run.Lake(spark, new_folder(spark, "lake"), "bigint", buckets=4, rules=RULES)


@query(
    "flow_raw_ingest",
    """SELECT 'products' AS entity, count(*) AS raw_rows, count(DISTINCT "ProductID") AS keys
      FROM product_feed
    UNION ALL SELECT 'sales_order_header', count(*), count(DISTINCT "SalesOrderID")
      FROM header_text
    UNION ALL SELECT 'sales_order_detail', count(*), count(DISTINCT "SalesOrderDetailID")
      FROM detail_text""",
)
def _(spark, folder):
    lake, feeds = _new_lake(spark), _feeds(spark, folder)
    keys = {
        "products": "ProductID",
        "sales_order_header": "SalesOrderID",
        "sales_order_detail": "SalesOrderDetailID",
    }
    parts = []
    for entity, key in keys.items():
        run.ingest(lake, entity, feeds[entity], BATCH_TS)
        run.ingest(lake, entity, feeds[entity], LATER_TS)  # nothing changed, nothing loaded
        raw = lake.raw(run.ENTITIES[entity]).read()
        counts = raw.agg(F.count("*").alias("raw_rows"), F.countDistinct(key).alias("keys"))
        parts.append(counts.select(F.lit(entity).alias("entity"), "raw_rows", "keys"))
    return _union(parts)


_LINEAGE = ("etl_created_at", "source_file_name")


@query("flow_store_product", "SELECT * FROM store_product")
def _(spark, folder):
    """Two deliveries, and no store load between them: neither is lost."""
    lake = _new_lake(spark)
    first, second = _product_halves(spark, folder)
    run.ingest(lake, "products", first, BATCH_TS)
    run.ingest(lake, "products", second, LATER_TS)
    run.load_store_product(lake, LATER_TS)
    return lake.keyed("store_product_master").read().drop(*_LINEAGE)


@query("flow_store_header", "SELECT * FROM store_header")
def _(spark, folder):
    lake, feeds = _new_lake(spark), _feeds(spark, folder, ["sales_order_header"])
    run.ingest(lake, "sales_order_header", feeds["sales_order_header"], BATCH_TS)
    run.load_store_header(lake, BATCH_TS)
    return lake.keyed("store_sales_order_header").read().drop(*_LINEAGE)


@query("flow_store_detail", "SELECT * FROM store_detail")
def _(spark, folder):
    lake, feeds = _new_lake(spark), _feeds(spark, folder)
    for entity in run.ENTITIES:
        run.ingest(lake, entity, feeds[entity], BATCH_TS)
    run.load_store_product(lake, BATCH_TS)
    run.load_store_header(lake, BATCH_TS)
    run.load_store_detail(lake, BATCH_TS)
    return lake.keyed("store_sales_order_detail").read().drop(*_LINEAGE)


@query(
    "flow_end_to_end",
    f"""SELECT 'revenue' AS answer, CAST(year AS VARCHAR) || ' ' || color AS item,
      total_revenue AS result FROM ({relations.FLOW_Q1}) q
    UNION ALL SELECT 'lead time', product_category_name, avg_lead_time_business_days
      FROM ({relations.FLOW_Q2}) q
    UNION ALL SELECT 'published lines', 'all', CAST(count(*) AS DECIMAL(38,2)) FROM flow_orders
    UNION ALL SELECT 'failed checks', 'warning', CAST(
        CASE WHEN count(*) FILTER (order_qty < 0) <> 2 THEN 1 ELSE 0 END
        + CASE WHEN count(*) FILTER (product_id IS NULL) > 0 THEN 1 ELSE 0 END AS DECIMAL(38,2))
      FROM flow_orders""",
)
def _(spark, folder):
    """All layers: the two answers, the number of published lines and of checks that did
    not pass (warnings, for the returns and for lines without a product)."""
    lake, feeds = _new_lake(spark), _feeds(spark, folder, ["sales_order_header", "sales_order_detail"])
    # Products come in two deliveries; the first one's run goes no further than raw.
    first, second = _product_halves(spark, folder)
    run.ingest(lake, "products", first, BATCH_TS)
    report = run.run_all(lake, {**feeds, "products": second}, LATER_TS)

    def number(c):
        return F.col(c).cast("decimal(38,2)").alias("result")

    tables = run.all_tables(lake)
    revenue = tables["analysis_revenue_by_color_year"].select(
        F.lit("revenue").alias("answer"),
        F.concat_ws(" ", F.col("year").cast("string"), "color").alias("item"),
        number("total_revenue"),
    )
    lead = tables["analysis_avg_lead_time_by_category"].select(
        F.lit("lead time").alias("answer"),
        F.col("product_category_name").alias("item"),
        number("avg_lead_time_business_days"),
    )
    lines = tables["publish_orders"].agg(F.count("*").alias("n"))
    lines = lines.select(F.lit("published lines").alias("answer"), F.lit("all").alias("item"), number("n"))
    failed = report.where("status = 'fail'").groupBy("severity").agg(F.count("*").alias("n"))
    failed = failed.select(
        F.lit("failed checks").alias("answer"), F.col("severity").alias("item"), number("n")
    )
    return _union([revenue, lead, lines, failed])
