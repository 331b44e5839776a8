"""Quality checks, contracts and profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.catalog import relations
from ledgerlake.catalog.registry import query
from ledgerlake.catalog.relations import published_orders, published_products
from ledgerlake.catalog.views import given, view
from ledgerlake.contracts import Field, ForeignKey, TableContract
from ledgerlake.operators import profiling, quality
from ledgerlake.operators.joins import hot_keys, join_on_key, orphan_count
from ledgerlake.plans import analysis, validation
from ledgerlake.sources.scratch import new_folder
from ledgerlake.sources.tables import KeyedTable


def _union(parts):
    return reduce(DataFrame.unionByName, parts)


def _sql_union(parts):
    return " UNION ALL ".join(parts)


def _verdict(failed):
    return f"CASE WHEN {failed} THEN 'fail' ELSE 'pass' END AS status"


_DUPLICATES = (
    "(SELECT count(*) FROM (SELECT 1 AS one FROM {0} GROUP BY {1} HAVING count(*) > 1) d)"
)


def _gate_sql(table, key, null_test):
    duplicates = _DUPLICATES.format(table, key)
    nulls = f"(SELECT count(*) FROM {table} WHERE {null_test})"
    rows = f"(SELECT count(*) FROM {table})"
    return _sql_union(
        [
            f"SELECT '{table}' AS table_name, '{name}' AS check_name, {measure} AS measure, "
            + _verdict(f"{measure} {bad}")
            for name, measure, bad in (
                ("duplicate_keys", duplicates, "> 0"),
                ("null_keys", nulls, "> 0"),
                ("row_count", rows, "= 0"),
            )
        ]
    )


@query(
    "dq_gate",
    _sql_union(
        [
            _gate_sql("orders", "o_orderkey", "o_orderkey IS NULL"),
            _gate_sql(
                "lineitem", "l_orderkey, l_linenumber", "l_orderkey IS NULL OR l_linenumber IS NULL"
            ),
            _gate_sql("detail", "product_id", "product_id IS NULL"),
        ]
    ),
)
def _(spark, folder):
    return _union(
        [
            quality.dq_gate(given(spark, folder, "orders"), "o_orderkey", "orders"),
            quality.dq_gate(
                given(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"], "lineitem"
            ),
            quality.dq_gate(view(spark, folder, "detail"), "product_id", "detail"),
        ]
    )


_COUNTED = ("part", "orders", "lineitem", "customer", "supplier", "events")


@query(
    "dq_row_counts",
    _sql_union(
        f"SELECT '{t}' AS table_name, count(*) AS measure, {_verdict('count(*) = 0')} FROM {t}"
        for t in _COUNTED
    ),
)
def _(spark, folder):
    parts = []
    for t in _COUNTED:
        counted = given(spark, folder, t).agg(F.count("*").alias("measure"))
        status = F.when(F.col("measure") == 0, "fail").otherwise("pass").alias("status")
        parts.append(counted.select(F.lit(t).alias("table_name"), "measure", status))
    return _union(parts)


_KEYS = (
    ("product", "product_id"),
    ("header", "sales_order_id"),
    ("detail", "sales_order_detail_id"),
    ("published", "product_id"),
    ("lines", "sales_order_detail_id"),
)


def _keyed_tables(spark, folder):
    return {
        "product": view(spark, folder, "product"),
        "header": view(spark, folder, "header"),
        "detail": view(spark, folder, "detail"),
        "published": published_products(spark, folder),
        "lines": published_orders(spark, folder),
    }


def _key_measure(spark, folder, measure):
    tables = _keyed_tables(spark, folder)
    return _union(
        quality.key_summary(tables[name], key).select(
            F.lit(name).alias("table_name"), F.lit(key).alias("key_name"), F.col(measure)
        )
        for name, key in _KEYS
    )


@query(
    "dq_duplicate_pks",
    _sql_union(
        f"SELECT '{t}' AS table_name, '{k}' AS key_name, {_DUPLICATES.format(t, k)} "
        "AS duplicate_keys"
        for t, k in _KEYS
    ),
)
def _(spark, folder):
    return _key_measure(spark, folder, "duplicate_keys")


@query(
    "dq_null_pks",
    _sql_union(
        f"SELECT '{t}' AS table_name, '{k}' AS key_name, "
        f"(SELECT count(*) FROM {t} WHERE {k} IS NULL) AS null_keys"
        for t, k in _KEYS
    ),
)
def _(spark, folder):
    return _key_measure(spark, folder, "null_keys")


@query(
    "dq_orphans",
    """SELECT 'detail' AS child, 'header' AS parent, 'critical' AS severity,
      count(*) AS violations FROM detail LEFT JOIN header USING (sales_order_id)
      WHERE header.sales_order_id IS NULL
    UNION ALL SELECT 'lines', 'product', 'warning', count(*)
      FROM lines LEFT JOIN product USING (product_id) WHERE product.product_id IS NULL""",
)
def _(spark, folder):
    tables = _keyed_tables(spark, folder)
    checks = (
        ("detail", "header", "sales_order_id", "critical"),
        ("lines", "product", "product_id", "warning"),
    )
    return _union(
        orphan_count(tables[child], tables[parent], key).select(
            F.lit(child).alias("child"),
            F.lit(parent).alias("parent"),
            F.lit(severity).alias("severity"),
            "violations",
        )
        for child, parent, key, severity in checks
    )


@query(
    "dq_null_color",
    """SELECT 'store' AS layer, count(*) FILTER (color IS NULL) AS null_color,
      count(*) FILTER (color = 'N/A') AS named_missing FROM product
    UNION ALL SELECT 'publish', count(*) FILTER (color IS NULL),
      count(*) FILTER (color = 'N/A') FROM published""",
)
def _(spark, folder):
    layers = {
        "store": view(spark, folder, "product"),
        "publish": published_products(spark, folder),
    }
    return _union(
        table.agg(
            F.count_if(F.col("color").isNull()).alias("null_color"),
            F.count_if(F.col("color") == "N/A").alias("named_missing"),
        ).select(F.lit(layer).alias("layer"), "null_color", "named_missing")
        for layer, table in layers.items()
    )


@query(
    "dq_date_order",
    "SELECT count(*) AS violations FROM header WHERE ship_date <= order_date",
)
def _(spark, folder):
    bad = validation.date_order_violation()
    return view(spark, folder, "header").agg(F.count_if(bad).alias("violations"))


@query(
    "dq_negative_lead",
    "SELECT count(*) AS violations FROM lines WHERE lead_time_in_business_days < 0",
)
def _(spark, folder):
    negative = F.col("lead_time_in_business_days") < 0
    return published_orders(spark, folder).agg(F.count_if(negative).alias("violations"))


@query(
    "dq_expected_returns",
    f"""SELECT count(*) AS returns, {_verdict("count(*) <> 2")} FROM lines
    WHERE order_qty < 0""",
)
def _(spark, folder):
    returns = published_orders(spark, folder).agg(
        F.count_if(F.col("order_qty") < 0).alias("returns")
    )
    status = F.when(F.col("returns") != 2, "fail").otherwise("pass")
    return returns.withColumn("status", status)


# A total that forgets the discount, so that there is something to find.
_OFF_SQL = """SELECT CASE WHEN abs(CAST(order_qty * unit_price AS DECIMAL(18,6))
    - order_qty * (unit_price - unit_price_discount)) > 0.01 THEN 1 ELSE 0 END AS off
    FROM detail"""


def _off_lines(spark, folder):
    return view(spark, folder, "detail").withColumn(
        "total_line_extended_price",
        (F.col("order_qty") * F.col("unit_price")).cast("decimal(18,6)"),
    )


@query("dq_formula_check", f"SELECT CAST(sum(off) AS BIGINT) AS violations FROM ({_OFF_SQL}) x")
def _(spark, folder):
    lines = _off_lines(spark, folder)
    return lines.agg(F.count_if(validation.formula_violation()).alias("violations"))


@query(
    "capped_violations",
    f"SELECT CAST(least(sum(off), 1000) AS BIGINT) AS violations FROM ({_OFF_SQL}) x",
)
def _(spark, folder):
    """Stops reading once there are a thousand."""
    found = quality.capped_violations(_off_lines(spark, folder), validation.formula_violation(), 1000)
    return spark.createDataFrame([(found,)], "violations bigint")


@query(
    "dq_analysis_nonempty",
    f"""SELECT 'q1' AS answer, count(*) AS rows_found FROM ({relations.Q1}) q
    UNION ALL SELECT 'q2', count(*) FROM ({relations.Q2}) q""",
)
def _(spark, folder):
    orders, products = published_orders(spark, folder), published_products(spark, folder)
    answers = {
        "q1": analysis.top_color_by_year(orders, products),
        "q2": analysis.lead_time_by_category(orders, products),
    }
    return _union(
        a.agg(F.count("*").alias("rows_found")).select(F.lit(n).alias("answer"), "rows_found")
        for n, a in answers.items()
    )


def _report_sql():
    tables = {
        "raw_product_master": "part",
        "raw_sales_order_header": "orders",
        "raw_sales_order_detail": "lineitem",
        "store_product_master": "product",
        "store_sales_order_header": "header",
        "store_sales_order_detail": "detail",
        "publish_product": "published",
        "publish_orders": "lines",
        "analysis_revenue_by_color_year": f"({relations.Q1}) q",
        "analysis_avg_lead_time_by_category": f"({relations.Q2}) q",
    }
    rows = []

    def add(section, check, table, sql, bad="> 0", severity="critical"):
        rows.append(
            f"SELECT '{section}' AS section, '{check}' AS check_name, '{table}' AS table_name, "
            f"'{severity}' AS severity, measure, {_verdict(f'measure {bad}')} "
            f"FROM (SELECT CAST(({sql}) AS BIGINT) AS measure) m"
        )

    for name, source in tables.items():
        add("row counts", "not empty", name, f"SELECT count(*) FROM {source}", "= 0")
    for name, key in validation.KEYED.items():
        source = tables[name]
        add("duplicate keys", "unique key", name, _DUPLICATES.format(source, key))
        nulls = f"SELECT count(*) FROM {source} WHERE {key} IS NULL"
        add("null keys", "key filled in", name, nulls)
    add(
        "orphans",
        "sales_order_id in store_sales_order_header",
        "store_sales_order_detail",
        "SELECT count(*) FROM detail d WHERE NOT EXISTS "
        "(SELECT 1 FROM header h WHERE h.sales_order_id = d.sales_order_id)",
    )
    add(
        "orphans",
        "product_id in store_product_master",
        "publish_orders",
        "SELECT count(*) FROM lines d WHERE NOT EXISTS "
        "(SELECT 1 FROM product p WHERE p.product_id = d.product_id)",
        severity="warning",
    )
    rule = "business rules"
    null_color = "SELECT count(*) FROM published WHERE color IS NULL"
    add(rule, "color filled in", "publish_product", null_color)
    dates = "SELECT count(*) FROM header WHERE ship_date <= order_date"
    add(rule, "shipped after ordered", "store_sales_order_header", dates)
    lead = "SELECT count(*) FROM lines WHERE lead_time_in_business_days < 0"
    add(rule, "lead time not negative", "publish_orders", lead)
    returns = "SELECT count(*) FROM lines WHERE order_qty < 0"
    add(rule, "expected number of returns", "publish_orders", returns, "<> 2", "warning")
    formula = (
        "SELECT least(count(*), 1000) FROM lines WHERE abs(total_line_extended_price - "
        "round(order_qty * (unit_price - unit_price_discount), 6)) > 0.01"
    )
    add(rule, "line total formula", "publish_orders", formula)
    for name, sql in (
        ("revenue by color and year", relations.Q1),
        ("lead time by category", relations.Q2),
    ):
        add("analysis", name, "publish_orders", f"SELECT count(*) FROM ({sql}) q", "= 0")
    return _sql_union(rows)


@query("validation_report", _report_sql())
def _(spark, folder):
    keyed = _keyed_tables(spark, folder)
    orders, products = keyed["lines"], keyed["published"]
    return validation.validation_report(
        {
            "raw_product_master": given(spark, folder, "part"),
            "raw_sales_order_header": given(spark, folder, "orders"),
            "raw_sales_order_detail": given(spark, folder, "lineitem"),
            "store_product_master": keyed["product"],
            "store_sales_order_header": keyed["header"],
            "store_sales_order_detail": keyed["detail"],
            "publish_product": products,
            "publish_orders": orders,
            "analysis_revenue_by_color_year": analysis.top_color_by_year(orders, products),
            "analysis_avg_lead_time_by_category": analysis.avg_lead_time_by_category(
                orders, products
            ),
        }
    )


_LINE_CONTRACT = TableContract(
    "detail",
    ("sales_order_detail_id",),
    (
        Field("sales_order_detail_id", "bigint", not_null=True),
        Field("sales_order_id", "bigint", not_null=True),
        Field("order_qty", "int"),
        Field("product_id", "bigint", not_null=True),
        Field("product_desc", "string", max_length=9),
    ),
    (
        ForeignKey("sales_order_id", "header", "sales_order_id"),
        ForeignKey("product_id", "product", "product_id"),
    ),
)


def _contract_sql():
    source = "(SELECT d.*, product_desc FROM detail d LEFT JOIN product p USING (product_id)) x"

    def row(check, sql):
        return (
            f"SELECT 'detail' AS table_name, '{check}' AS check_name, measure, "
            f"{_verdict('measure > 0')} FROM (SELECT ({sql}) AS measure) m"
        )

    def count(where):
        return f"SELECT count(*) FROM {source} WHERE {where}"

    def missing(parent, key):
        return (
            f"SELECT count(*) FROM detail d WHERE {key} IS NOT NULL AND NOT EXISTS "
            f"(SELECT 1 FROM {parent} p WHERE p.{key} = d.{key})"
        )

    return _sql_union(
        [
            row("unique sales_order_detail_id", _DUPLICATES.format(source, "sales_order_detail_id")),
            row("not null sales_order_detail_id", count("sales_order_detail_id IS NULL")),
            row("not null sales_order_id", count("sales_order_id IS NULL")),
            row("not null product_id", count("product_id IS NULL")),
            row("length product_desc", count("length(product_desc) > 9")),
            row("foreign key sales_order_id", missing("header", "sales_order_id")),
            row("foreign key product_id", missing("product", "product_id")),
        ]
    )


@query("enforce_contract", _contract_sql())
def _(spark, folder):
    header, product = view(spark, folder, "header"), view(spark, folder, "product")
    lines, names = view(spark, folder, "detail"), product.select("product_id", "product_desc")
    described = join_on_key(lines, names, "product_id", "left", hot_keys(lines, "product_id"))
    parents = {"header": header, "product": product}
    return quality.enforce_contract(described, _LINE_CONTRACT, parents)


@query("enforce_contract_stored_parents", _contract_sql())
def _(spark, folder):
    """The same, with stored parents of which only the buckets that the lines fall into are read."""
    names = view(spark, folder, "product").select("product_id", "product_desc")
    lines = view(spark, folder, "detail")
    described = join_on_key(lines, names, "product_id", "left", hot_keys(lines, "product_id"))
    parents = {}
    for fk in _LINE_CONTRACT.foreign_keys:
        parent = KeyedTable(spark, new_folder(spark, fk.parent), fk.parent_column, buckets=4)
        parent.merge(view(spark, folder, fk.parent))
        parents[fk.parent] = parent.holding(lines.select(F.col(fk.column).alias(fk.parent_column)))
    return quality.enforce_contract(described, _LINE_CONTRACT, parents)


# ---- profiles


@query(
    "profile_castability",
    r"""SELECT 'Freight' AS column_name,
      count(*) FILTER (NOT regexp_matches("Freight", '^\d+$')) AS misfits FROM header_text
    UNION ALL SELECT 'OrderDate',
      count(*) FILTER (NOT regexp_matches("OrderDate", '^\d{4}-\d{2}-\d{2}$')) FROM header_text
    UNION ALL SELECT 'CustomerID',
      count(*) FILTER (NOT regexp_matches("CustomerID", '^\d+$')) FROM header_text
    UNION ALL SELECT 'SalesPersonID',
      count(*) FILTER (NOT regexp_matches("SalesPersonID", '^\d+$')) FROM header_text""",
)
def _(spark, folder):
    patterns = {
        "Freight": profiling.WHOLE_NUMBER,
        "OrderDate": r"^\d{4}-\d{2}-\d{2}$",
        "CustomerID": profiling.WHOLE_NUMBER,
        "SalesPersonID": profiling.WHOLE_NUMBER,
    }
    return profiling.profile_castability(view(spark, folder, "header_text"), patterns)


@query(
    "profile_uncastable_rows",
    r"""SELECT "ProductID" AS product_id, "Size" AS size, "Weight" AS weight FROM product_text
    WHERE NOT regexp_matches("Size", '^\d+$')
       OR ("Weight" <> '' AND NOT regexp_matches("Weight", '^\d+(\.\d+)?$'))""",
)
def _(spark, folder):
    patterns = {"Size": profiling.WHOLE_NUMBER, "Weight": profiling.DECIMAL_NUMBER}
    found = profiling.uncastable_rows(view(spark, folder, "product_text"), patterns, True)
    return found.select(
        F.col("ProductID").alias("product_id"),
        F.col("Size").alias("size"),
        F.col("Weight").alias("weight"),
    )


@query(
    "profile_fill_counts",
    """SELECT count(*) AS total, count(nullif("Color", '')) AS "Color_filled",
    count(nullif("ProductCategoryName", '')) AS "ProductCategoryName_filled",
    count(nullif("WeightUnitMeasureCode", '')) AS "WeightUnitMeasureCode_filled"
    FROM product_text""",
)
def _(spark, folder):
    columns = ["Color", "ProductCategoryName", "WeightUnitMeasureCode"]
    return profiling.profile_fill_counts(view(spark, folder, "product_text"), columns)


@query(
    "profile_distinct",
    "SELECT DISTINCT product_category_name, product_sub_category_name FROM product",
)
def _(spark, folder):
    columns = ["product_category_name", "product_sub_category_name"]
    return profiling.profile_distinct(view(spark, folder, "product"), columns)


@query(
    "profile_length_histogram",
    """SELECT CAST(length("OrderDate") AS INT) AS text_length, count(*) AS occurrences
    FROM header_text GROUP BY 1""",
)
def _(spark, folder):
    return profiling.profile_length_histogram(view(spark, folder, "header_text"), "OrderDate")


@query(
    "profile_min_max",
    """SELECT min(CAST("SalesOrderID" AS BIGINT)) AS "min_SalesOrderID",
    max(CAST("SalesOrderID" AS BIGINT)) AS "max_SalesOrderID",
    min(CAST("CustomerID" AS BIGINT)) AS "min_CustomerID",
    max(CAST("CustomerID" AS BIGINT)) AS "max_CustomerID",
    min(CAST(nullif("SalesPersonID", '') AS BIGINT)) AS "min_SalesPersonID",
    max(CAST(nullif("SalesPersonID", '') AS BIGINT)) AS "max_SalesPersonID" FROM header_text""",
)
def _(spark, folder):
    columns = ["SalesOrderID", "CustomerID", "SalesPersonID"]
    return profiling.profile_min_max(view(spark, folder, "header_text"), columns)


_PROFILED = {
    "header_text": ["SalesOrderID", "OrderDate", "CustomerID", "SalesPersonID"],
    "product_text": ["Color", "Size", "ProductCategoryName"],
}


def _profile_sql(table, column):
    value = f'"{column}"'
    return f"""SELECT '{table}' AS table_name, '{column}' AS column_name, count(*) AS total,
    count(nullif({value}, '')) AS filled, count(DISTINCT {value}) AS distinct_values, true AS estimate_is_near,
    min(CASE WHEN regexp_matches({value}, '^[0-9]+$') THEN CAST({value} AS BIGINT) END) AS smallest,
    max(CASE WHEN regexp_matches({value}, '^[0-9]+$') THEN CAST({value} AS BIGINT) END) AS largest,
    (SELECT string_agg(l || ':' || n, ',' ORDER BY l) FROM (SELECT length({value}) AS l, count(*) AS n
        FROM {table} WHERE {value} IS NOT NULL GROUP BY 1) h) AS lengths
    FROM {table}"""


@query("profile_columns", _sql_union([_profile_sql(t, c) for t, names in _PROFILED.items() for c in names]))
def _(spark, folder):
    """One scan per table. Estimates are near if they are off by at most 6 %, over four standard errors."""

    def of(table):
        found = profiling.profile_columns(view(spark, folder, table), _PROFILED[table])
        off = F.abs(F.col("distinct_estimate") - F.col("distinct_values"))
        shown = F.transform("lengths", lambda e: F.concat_ws(":", e["text_length"], e["occurrences"]))
        return found.select(
            F.lit(table).alias("table_name"), "column_name", "total", "filled", "distinct_values",
            (off <= 0.06 * F.col("distinct_values")).alias("estimate_is_near"), "smallest", "largest",
            F.array_join(shown, ",").alias("lengths"),
        )

    return _union([of(t) for t in _PROFILED])


@query(
    "profile_date_gap",
    """SELECT CAST(date_diff('day', order_date, ship_date) AS INT) AS gap_days,
    count(*) AS occurrences FROM header WHERE NOT online_order_flag GROUP BY 1""",
)
def _(spark, folder):
    in_store = view(spark, folder, "header").where("NOT online_order_flag")
    return profiling.profile_date_gap(in_store, "order_date", "ship_date")
