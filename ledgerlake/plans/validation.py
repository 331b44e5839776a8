"""The report over all layers: 29 checks, one scan per table and rule set."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.operators.quality import key_summary, rows_from
from ledgerlake.plans.analysis import lead_time_of, line_measures, top_color_of
from ledgerlake.sources.scratch import new_folder

# The tables of the report, and the key of each that has one.
RAW = ("raw_product_master", "raw_sales_order_header", "raw_sales_order_detail")
KEYED = {
    "store_product_master": "product_id",
    "store_sales_order_header": "sales_order_id",
    "store_sales_order_detail": "sales_order_detail_id",
    "publish_product": "product_id",
    "publish_orders": "sales_order_detail_id",
}
ANALYSIS = ("analysis_revenue_by_color_year", "analysis_avg_lead_time_by_category")

COLUMNS = ("section", "check_name", "table_name", "severity", "measure", "status")


def formula_deviation(total: Column, quantity: Column, price: Column, discount: Column) -> Column:
    """Distance of a stored line total from the one its parts give."""
    return F.abs(total - F.round(quantity * (price - discount), 6))


def date_order_violation() -> Column:
    """Shipped on or before the day of the order."""
    return F.col("ship_date") <= F.col("order_date")


def formula_violation(tolerance: str = "0.01") -> Column:
    deviation = formula_deviation(
        F.col("total_line_extended_price"),
        F.col("order_qty"),
        F.col("unit_price"),
        F.col("unit_price_discount"),
    )
    return deviation > F.lit(tolerance).cast("decimal(18,6)")


def capped(count: Column, cap: int = 1000) -> Column:
    return F.least(count, F.lit(cap)).cast("bigint")


def _row(section: str, check: str, table: str, measure: Column, failed: Column, warn=False):
    severity = "warning" if warn else "critical"
    status = F.when(failed, F.lit("fail")).otherwise(F.lit("pass"))
    return (section, check, table, severity, measure.cast("bigint"), status)


def _count_row(table: str):
    return _row("row counts", "not empty", table, F.col("rows"), F.col("rows") == 0)


def _total(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("bigint")


def _by_key(df: DataFrame, key: str, rules: Mapping[str, Column]) -> DataFrame:
    """A row per key: its rows, ``n``, and how many of them meet each rule."""
    hits = [F.count_if(c).alias(name) for name, c in rules.items()]
    return df.groupBy(key).agg(F.count("*").alias("n"), *hits)


def _measures(by_key: DataFrame, key: str, rules: Iterable[str]) -> DataFrame:
    return by_key.agg(
        _total(F.col("n")).alias("rows"),
        F.count_if(F.col("n") > 1).alias("duplicate_keys"),
        _total(F.when(F.col(key).isNull(), F.col("n"))).alias("null_keys"),
        *[_total(F.col(name)).alias(name) for name in rules],
    )


def _by_key_and_other(
    df: DataFrame,
    key: str,
    other: Sequence[str],
    rules: Mapping[str, Column],
    sums: Mapping[str, Column],
    summed: Sequence[str] = (),
) -> DataFrame:
    """One scan grouped two ways: ``own`` marks the row with what concerns the key, with the columns
    of `_measures`; the other rows have the number of rows and the sums per ``other``,
    which are of the columns ``summed``."""
    # Either kind of row carries what is asked of it alone: a sum per key, which nobody asks for, would be
    # most of what is shuffled.
    held = {c: df.schema[c].dataType for c in (key, *other)}
    flags = {f"_{name}": F.coalesce(c, F.lit(False)) for name, c in rules.items()}
    kinds = []
    for own in (True, False):
        names = [F.when(F.lit(own == (c == key)), F.col(c)).cast(t).alias(c) for c, t in held.items()]
        hits = [(c if own else F.lit(False)).alias(name) for name, c in flags.items()]
        values = [F.when(F.lit(not own), F.col(c)).alias(c) for c in summed]
        kinds.append(F.struct(F.lit(own).alias("own"), *names, *hits, *values))
    grouped = df.select(F.inline(F.array(*kinds))).groupBy("own", key, *other).agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col(f"_{name}")).alias(name) for name in rules],
        *[c.alias(name) for name, c in sums.items()],
    )
    # All rows of the first kind meet in one group: each task folds its own into one row.
    null_key = F.when(F.col("own") & F.col(key).isNull(), F.col("n"))
    return grouped.groupBy("own", *other).agg(
        _total(F.col("n")).alias("rows"),
        F.count_if(F.col("own") & (F.col("n") > 1)).alias("duplicate_keys"),
        _total(null_key).alias("null_keys"),
        *[F.sum(name).alias(name) for name in (*rules, *sums)],
    )


def _own(counted: DataFrame, rules: Iterable[str]) -> DataFrame:
    """The row on the key; zeros if the table has no rows."""
    names = ("rows", "duplicate_keys", "null_keys", *rules)
    return counted.where("own").agg(*[_total(F.col(n)).alias(n) for n in names])


def _kept(df: DataFrame, label: str) -> DataFrame:
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def validation_report(
    tables: Mapping[str, DataFrame], expected_returns: int = 2, formula_cap: int = 1000
) -> DataFrame:
    """One row per check: section, check, table, severity, measure, status.

    ``tables`` maps the ten names above to DataFrames. Each is scanned once: counts per key, and per
    the key of the table that it refers to, are written down, and every check is made from these."""
    rules: dict[str, dict[str, Column]] = {
        "publish_product": {"null_color": F.col("color").isNull()},
        "store_sales_order_header": {"bad_dates": date_order_violation()},
        "publish_orders": {
            "negative_lead": F.col("lead_time_in_business_days") < 0,
            "returns": F.col("order_qty") < 0,
            "off_formula": formula_violation(),
        },
    }

    def some(measure: str) -> tuple[Column, Column]:
        return F.col(measure), F.col(measure) > 0

    business = {
        "publish_product": [
            _row("business rules", "color filled in", "publish_product", *some("null_color"))
        ],
        "store_sales_order_header": [
            _row(
                "business rules",
                "shipped after ordered",
                "store_sales_order_header",
                *some("bad_dates"),
            )
        ],
        "publish_orders": [
            _row("business rules", "lead time not negative", "publish_orders", *some("negative_lead")),
            _row(
                "business rules",
                "expected number of returns",
                "publish_orders",
                F.col("returns"),
                F.col("returns") != expected_returns,
                warn=True,
            ),
            _row(
                "business rules",
                "line total formula",
                "publish_orders",
                capped(F.col("off_formula"), formula_cap),
                F.col("off_formula") > 0,
            ),
        ],
    }

    keys = {
        name: _kept(_by_key(tables[name], KEYED[name], rules.get(name, {})), name)
        for name in ("store_product_master", "store_sales_order_header")
    }
    product_columns = tables["publish_product"].select("product_id", "color", "product_category_name")
    products = _kept(product_columns, "publish_product")
    detail = _by_key_and_other(
        tables["store_sales_order_detail"], KEYED["store_sales_order_detail"], ["sales_order_id"], {}, {}
    )
    detail = _kept(detail, "store_sales_order_detail")
    dated = tables["publish_orders"].withColumn("year", F.year("order_date"))
    lines = _by_key_and_other(
        dated,
        KEYED["publish_orders"],
        ["product_id", "year"],
        rules["publish_orders"],
        line_measures(),
        ["total_line_extended_price", "lead_time_in_business_days"],
    )
    lines = _kept(lines, "publish_orders")
    measures = {
        **{n: _measures(k, KEYED[n], rules.get(n, {})) for n, k in keys.items()},
        "publish_product": key_summary(products, "product_id", rules["publish_product"]),
        "store_sales_order_detail": _own(detail, ()),
        "publish_orders": _own(lines, rules["publish_orders"]),
    }

    parts = []
    for name in (*RAW, *ANALYSIS):
        parts.append(rows_from(tables[name].agg(F.count("*").alias("rows")), COLUMNS, [_count_row(name)]))
    for name in KEYED:
        rows = [
            _count_row(name),
            _row("duplicate keys", "unique key", name, *some("duplicate_keys")),
            _row("null keys", "key filled in", name, *some("null_keys")),
            *business.get(name, []),
        ]
        parts.append(rows_from(measures[name], COLUMNS, rows))

    orphans = (
        ("store_sales_order_detail", detail, "store_sales_order_header", "sales_order_id", False),
        ("publish_orders", lines, "store_product_master", "product_id", True),
    )
    for child, counted, parent, key, warn in orphans:
        alone = counted.where("NOT own").join(keys[parent].select(key), key, "left_anti")
        row = _row("orphans", f"{key} in {parent}", child, *some("violations"), warn=warn)
        parts.append(rows_from(alone.agg(_total(F.col("rows")).alias("violations")), COLUMNS, [row]))

    sums = lines.where("NOT own").withColumnRenamed("rows", "lines")
    answers = {
        "revenue by color and year": top_color_of(sums, products),
        "lead time by category": lead_time_of(sums, products),
    }
    for name, answer in answers.items():
        row = _row("analysis", name, "publish_orders", F.col("rows"), F.col("rows") == 0)
        parts.append(rows_from(answer.agg(F.count("*").alias("rows")), COLUMNS, [row]))
    return reduce(DataFrame.unionByName, parts)


def assert_no_critical(report: DataFrame) -> None:
    """Raise one error naming every critical check that failed; warnings never raise.
    The report has 29 rows, so collecting the failed ones is bounded."""
    failed = report.where("status = 'fail' AND severity = 'critical'").collect()
    if failed:
        lines = [f"{r['table_name']}: {r['check_name']} = {r['measure']}" for r in failed]
        raise ValueError(f"validation failed ({len(lines)}):\n" + "\n".join(sorted(lines)))
