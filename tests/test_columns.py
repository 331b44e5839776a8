import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlake.functions import typing
from ledgerlake.functions.calendars import business_days_between
from ledgerlake.functions.enrich import CATEGORY_RULES, exact_average, line_total, rule_enrichment


def values(df):
    return [r[0] for r in df.collect()]


def one_column(spark, cells, dtype="string"):
    return spark.createDataFrame([(i, c) for i, c in enumerate(cells)], f"i int, c {dtype}")


def converted(spark, cells, expression):
    return values(one_column(spark, cells).orderBy("i").select(expression))


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_casts_do_not_depend_on_ansi_mode(spark, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        cells = ["12", " 7 ", "4.7", "-3.9", "", "  ", "abc", None, "99999999999", "1.2.3", "-5"]
        assert converted(spark, cells, typing.typed("c", "int")) == [
            12, 7, 4, -3, None, None, None, None, None, None, -5,
        ]
        assert converted(spark, ["True", "false", "x", None], typing.typed("c", "boolean")) == [
            True, False, None, None,
        ]
        money = converted(
            spark, [".0000", "1.23456750", "2024.9940", "n/a"], typing.typed("c", "decimal(18,6)")
        )
        assert money == [Decimal("0E-6"), Decimal("1.234568"), Decimal("2024.994000"), None]
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_blanks(spark):
    cells = ["Black", " CM ", "", "   ", None]
    assert converted(spark, cells, typing.blank_to_null("c")) == ["Black", "CM", None, None, None]
    numbers = ["279", "", " ", None]
    assert converted(spark, numbers, typing.nullable_int("c")) == [279, None, None, None]
    weights = ["2.25", "", " ", "heavy"]
    assert converted(spark, weights, typing.nullable_float("c")) == [2.25, None, None, None]


def test_nan_becomes_null(spark):
    df = one_column(spark, [1.5, float("nan"), None], "double")
    assert values(df.orderBy("i").select(typing.nan_to_null("c"))) == [1.5, None, None]


def test_dates(spark):
    day = dt.date
    cells = ["2021-05-31", " 2021-05-31 ", "2021-13-45", "2021-06", "", None]
    assert converted(spark, cells, typing.parse_date("c")) == [
        day(2021, 5, 31), day(2021, 5, 31), None, None, None, None,
    ]
    repaired = typing.repair_partial_date("c", F.lit("2021-07-05").cast("date"))
    assert converted(spark, cells, repaired) == [
        day(2021, 5, 31), day(2021, 5, 31), None, day(2021, 6, 28), day(2021, 6, 28),
        day(2021, 6, 28),
    ]


def weekdays_one_by_one(start, end):
    if start is None or end is None:
        return None
    days = range((end - start).days) if end > start else ()
    return sum((start + dt.timedelta(n + 1)).weekday() < 5 for n in days)


def test_business_days_known_cases(spark):
    day = dt.date
    cases = [
        (day(2024, 1, 1), day(2024, 1, 3), 2),
        (day(2021, 5, 31), day(2021, 6, 7), 5),
        (day(2024, 1, 5), day(2024, 1, 8), 1),
        (day(2024, 1, 5), day(2024, 1, 6), 0),
        (day(2024, 1, 6), day(2024, 1, 7), 0),
        (day(2024, 1, 1), day(2024, 1, 1), 0),
        (day(2024, 1, 9), day(2024, 1, 1), 0),
        (None, day(2024, 1, 1), None),
        (day(2024, 1, 1), None, None),
    ]
    df = spark.createDataFrame(cases, "a date, b date, want int")
    got = df.select(business_days_between(F.col("a"), F.col("b")).alias("got"), "want").collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_business_days_equal_counting_day_by_day(spark):
    rng = random.Random(7)
    pairs = []
    for _ in range(2000):
        start = dt.date(1960, 1, 1) + dt.timedelta(rng.randrange(30000))
        pairs.append((start, start + dt.timedelta(rng.randrange(-30, 400))))
    df = spark.createDataFrame([(*p, weekdays_one_by_one(*p)) for p in pairs], "a date, b date, w int")
    wrong = df.where(business_days_between(F.col("a"), F.col("b")) != F.col("w"))
    assert wrong.count() == 0


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_a_line_total_that_does_not_fit_is_an_error(spark, ansi):
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        df = spark.sql("SELECT 2000000000 AS q, 999999999999.0BD AS p, 0.0BD AS d")
        total = line_total(F.col("q"), F.col("p").cast("decimal(18,6)"), F.col("d").cast("decimal(18,6)"))
        with pytest.raises(Exception, match="line total too large"):
            df.select(total).collect()
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_line_total_and_credit(spark):
    df = spark.createDataFrame(
        [(2, Decimal("10.5"), Decimal("0.5")), (-1, Decimal("5.70"), Decimal("0"))],
        "q int, p decimal(18,6), d decimal(18,6)",
    )
    total = df.select(line_total(F.col("q"), F.col("p"), F.col("d")).alias("t"))
    assert total.schema["t"].dataType.simpleString() == "decimal(18,6)"
    assert values(total) == [Decimal("20.000000"), Decimal("-5.700000")]


def test_categories(spark):
    rows = [
        (0, None, "Socks"), (1, None, "Pumps"), (2, None, "Road Frames"), (3, None, "Saddles"),
        (4, None, "Jerseys"), (5, "Bikes", "Road Frames"), (6, None, None), (7, None, "socks"),
    ]
    df = spark.createDataFrame(rows, "i int, cat string, sub string").orderBy("i")
    got = values(df.select(rule_enrichment(F.col("cat"), F.col("sub"), CATEGORY_RULES)))
    assert got == [
        "Clothing", "Accessories", "Components", "Components", None, "Bikes", None, None,
    ]


def test_average_rounds_half_up(spark):
    df = spark.createDataFrame([(1, 8), (1, 3), (2, 3)], "s bigint, n bigint")
    got = values(df.select(exact_average(F.col("s"), F.col("n"))))
    assert got == [Decimal("0.13"), Decimal("0.33"), Decimal("0.67")]
