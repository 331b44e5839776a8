import random

import pytest
from pyspark.sql import functions as F

from ledgerlake.contracts import Field, ForeignKey, TableContract, sales_contracts
from ledgerlake.operators import joins
from ledgerlake.operators.batches import add_audit_columns, latest_batch
from ledgerlake.operators.dedup import dedup_by_completeness, dedup_report, duplicate_keys
from ledgerlake.operators.profiling import (
    LG_K,
    WHOLE_NUMBER,
    column_lengths,
    combined,
    profile_castability,
    profile_columns,
    uncastable_rows,
)
from ledgerlake.operators.quality import dq_gate, enforce_contract, key_summary, raise_on_fail
from ledgerlake.operators.ranking import rank_top1_per_group
from ledgerlake.operators.upsert import upsert_by_key


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---- joins


@pytest.fixture
def skewed(spark):
    """A third of 30,000 rows on one key, a tenth on NULL, some keys without a parent."""
    left = spark.range(30000, numPartitions=12).select(
        "id",
        F.when(F.col("id") < 10000, F.lit(7))
        .when(F.col("id") < 13000, F.lit(None))
        .otherwise(F.col("id") - F.lit(12000))
        .cast("bigint")
        .alias("k"),
    )
    right = spark.range(15000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    return left, right


def test_hot_keys_finds_the_heavy_one(skewed):
    left, _ = skewed
    hash_of_7 = left.where("k = 7").select(joins._key_hash(left, ["k"])).first()[0]
    assert joins.hot_keys(left, "k") == [hash_of_7]
    assert joins.hot_keys(left.where("id >= 13000"), "k") == []
    assert joins.hot_keys(left.where("k IS NULL"), "k") == []


@pytest.mark.parametrize("how", ["inner", "left", "left_anti"])
def test_salted_join_gives_the_plain_result(spark, skewed, how):
    left, right = skewed
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hot = joins.hot_keys(left, "k")
        got = joins.join_on_key(left, right, "k", how, hot)
        want = left.join(right, "k", how)
        assert got.columns == want.columns
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_salted_join_on_keys_of_two_widths(spark, skewed):
    left, right = skewed
    narrow = right.withColumn("k", F.col("k").cast("int"))
    got = joins.join_on_key(left, narrow, "k", hot=joins.hot_keys(left, "k"))
    assert got.count() == left.join(right, "k").count()


def test_salting_spreads_the_hot_key(spark, skewed):
    left, right = skewed
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = joins.join_on_key(left, right, "k", hot=joins.hot_keys(left, "k"))
        sizes = joined.where("k = 7").groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in sizes) == 10000
        assert max(r["count"] for r in sizes) < 8000
        assert len(sizes) > 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_orphans_and_foreign_keys(spark):
    child = spark.createDataFrame([(1, 10), (2, None), (3, 99), (4, 99)], "id int, p int")
    parent = spark.createDataFrame([(10,), (11,)], "key int")
    assert rows(joins.anti_join_orphans(child, parent, "p", "key").select("id")) == [(2,), (3,), (4,)]
    assert rows(joins.fk_violations(child, parent, "p", "key").select("id")) == [(3,), (4,)]
    assert joins.orphan_count(child, parent, "p", "key").first()[0] == 3
    assert joins.fk_violation_count(child, parent, "p", "key").first()[0] == 2
    assert joins.orphan_count(child.limit(0), parent, "p", "key").first()[0] == 0


# ---- dedup

PAIR = [(713, None, "Jerseys"), (713, "Clothing", "Shirt"), (714, None, None)]


def test_most_complete_row_wins(spark):
    df = spark.createDataFrame(PAIR, "id int, cat string, sub string")
    assert rows(dedup_by_completeness(df, "id")) == [(713, "Clothing", "Shirt"), (714, None, None)]
    assert rows(dedup_report(df, "id")) == [(3, 2, 1)]
    assert rows(duplicate_keys(df, "id")) == [(713, 2)]


def test_ties_do_not_depend_on_order_or_partitioning(spark):
    rng = random.Random(3)
    data = [
        (rng.randrange(40), rng.choice([None, 1, 2]), rng.choice([None, "a", "b"]))
        for _ in range(600)
    ]
    results = set()
    for parts in (1, 3, 11):
        rng.shuffle(data)
        df = spark.createDataFrame(data, "k int, a int, b string").repartition(parts)
        results.add(tuple(rows(dedup_by_completeness(df, "k"))))
    assert len(results) == 1
    best = {}
    for k, a, b in data:
        rank = ((a is None) + (b is None), a is None, a or 0, b is None, b or "")
        if k not in best or rank < best[k][0]:
            best[k] = (rank, (k, a, b))
    assert list(results.pop()) == sorted((row for _, row in best.values()), key=str)


def test_null_keys_are_one_group(spark):
    df = spark.createDataFrame([(None, 1), (None, None), (1, 1)], "k int, v int")
    assert rows(dedup_by_completeness(df, "k")) == [(1, 1), (None, 1)]
    assert rows(dedup_report(df, "k")) == [(3, 2, 1)]


def test_dedup_prunes_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 10).alias("k"), "id")
    text = plan(dedup_by_completeness(df, "k"))
    assert text.count("WindowGroupLimit") == 2
    assert text.rindex("WindowGroupLimit") > text.index("Exchange")


def test_rank_keeps_ties_and_puts_null_first(spark):
    data = [(1, "a", 5), (1, "b", 5), (1, "c", 4), (2, "a", None), (2, "b", 9)]
    df = spark.createDataFrame(data, "year int, color string, v int")
    best = rank_top1_per_group(df, "year", "v")
    assert plan(best).count("WindowGroupLimit") == 2
    assert rows(best) == [(1, "a", 5), (1, "b", 5), (2, "a", None)]


# ---- merge


def test_upsert(spark):
    target = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, n int")
    source = spark.createDataFrame([(2, None, 3), (4, "d", 4)], "k int, v string, n int")
    merged = upsert_by_key(target, source, "k")
    assert rows(merged) == [(1, "a", 1), (2, None, 3), (4, "d", 4)]
    assert rows(upsert_by_key(merged, source, "k")) == rows(merged)


def test_upsert_matches_a_dictionary(spark):
    rng = random.Random(11)
    model, table = {}, spark.createDataFrame([], "k int, v int")
    for _ in range(3):
        batch = {rng.randrange(60): rng.choice([None, rng.randrange(9)]) for _ in range(25)}
        source = spark.createDataFrame(list(batch.items()), "k int, v int")
        table = upsert_by_key(table, source, "k")
        model.update(batch)
    assert rows(table) == sorted(model.items(), key=str)


# ---- batches


def test_latest_batch_and_audit(spark):
    df = spark.createDataFrame([(1, "b1"), (2, "b2"), (3, "b2"), (4, None)], "id int, batch string")
    assert rows(latest_batch(df, "batch")) == [(2, "b2"), (3, "b2")]
    stamped = add_audit_columns(df, "2026-01-15 06:00:00", "x.csv")
    first = stamped.first()
    assert str(first["etl_created_at"]) == "2026-01-15 06:00:00"
    assert first["source_file_name"] == "x.csv"


# ---- quality


def test_gate_passes_and_collects_every_failure(spark):
    good = spark.createDataFrame([(1,), (2,)], "k int")
    raise_on_fail(dq_gate(good, "k", "good"))
    bad = spark.createDataFrame([(1,), (1,), (None,)], "k int")
    with pytest.raises(ValueError, match="duplicate_keys = 1\n.*null_keys = 1"):
        raise_on_fail(dq_gate(bad, "k", "bad"))
    with pytest.raises(ValueError, match="row_count = 0"):
        raise_on_fail(dq_gate(good.limit(0), "k", "empty"))


def test_key_summary_counts_rules_once(spark):
    df = spark.createDataFrame([(1, 5), (1, -5), (None, None), (None, 1)], "k int, v int")
    got = key_summary(df, "k", {"negative": F.col("v") < 0}).first().asDict()
    assert got == {"rows": 4, "duplicate_keys": 2, "null_keys": 2, "negative": 1}


CONTRACT = TableContract(
    "lines",
    ("id",),
    (
        Field("id", "int", not_null=True),
        Field("day", "string", not_null=True),
        Field("name", "string", max_length=3),
        Field("p", "int"),
    ),
    (ForeignKey("p", "parents", "key"),),
)


@pytest.mark.parametrize(
    ("data", "broken"),
    [
        ([(1, "d", "abc", 10), (2, "d", None, None)], set()),
        ([(1, "d", "a", 10), (1, "d", "a", 10)], {"unique id"}),
        ([(None, "d", "a", 10)], {"not null id"}),
        ([(1, None, "a", 10)], {"not null day"}),
        ([(1, "d", "abcd", 10)], {"length name"}),
        ([(1, "d", "a", 99)], {"foreign key p"}),
    ],
)
def test_contract(spark, data, broken):
    parents = {"parents": spark.createDataFrame([(10,)], "key int")}
    df = spark.createDataFrame(data, "id int, day string, name string, p int")
    report = enforce_contract(df, CONTRACT, parents)
    assert {r["check_name"] for r in report.where("status = 'fail'").collect()} == broken
    if broken:
        with pytest.raises(ValueError, match=broken.pop()):
            raise_on_fail(report)
    else:
        raise_on_fail(report)


def test_sales_contracts():
    contracts = sales_contracts()
    assert [len(c.fields) for c in contracts.values()] == [17, 10, 8, 16, 16]
    assert contracts["store_sales_order_detail"].key == ("sales_order_detail_id",)
    required = {
        name: {f.name for f in c.fields if f.not_null} for name, c in contracts.items()
    }
    assert required["publish_product"] == {"product_id", "color"}
    assert required["store_sales_order_header"] == {
        "sales_order_id", "order_date", "ship_date", "customer_id",
    }


# ---- profiles


def test_profiles(spark):
    df = spark.createDataFrame([("1", "x"), ("a", ""), (None, "3")], "n string, m string")
    patterns = {"n": WHOLE_NUMBER, "m": WHOLE_NUMBER}
    assert rows(profile_castability(df, patterns)) == [("m", 2), ("n", 1)]
    assert rows(profile_castability(df, patterns, blank_allowed=True)) == [("m", 1), ("n", 1)]
    assert uncastable_rows(df, patterns, blank_allowed=True).count() == 2


def test_profile_of_many_columns_is_one_scan(spark, folder):
    texts = [("1", "x"), ("22", ""), (None, "x"), ("a", "x"), ("22", "x"), ("7", None)]
    spark.createDataFrame(texts, "n string, m string").write.parquet(folder + "/t")
    df = spark.read.parquet(folder + "/t")
    want = {
        "n": (6, 5, 4, 4, 1, 22, [(1, 3), (2, 2)]),
        "m": (6, 4, 2, 2, None, None, [(0, 1), (1, 4)]),
    }
    for exact in (True, False):
        got = profile_columns(df, ["n", "m"], exact)
        assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
        for r in got.collect():
            row = (r.total, r.filled, r.distinct_values if exact else want[r.column_name][2])
            rest = (r.distinct_estimate, r.smallest, r.largest, [tuple(e) for e in r.lengths])
            assert row + rest == want[r.column_name]
    assert profile_columns(df.where("n = 'none'"), ["n", "m"]).collect() == []


def test_estimates_of_distinct_values(spark):
    """Within four standard errors, also of two batches that overlap."""
    first, second = spark.range(60_000), spark.range(30_000, 100_000)
    parts = [column_lengths(d, ["id"], exact=False) for d in (first, second)]
    found = combined(parts[0].unionByName(parts[1])).first()
    assert found.total == 130_000 and found.distinct_values is None
    assert abs(found.distinct_estimate - 100_000) < 4 * 0.83 / 2 ** (LG_K / 2) * 100_000


@pytest.mark.parametrize(
    "a, b",
    [("decimal(18,2)", "decimal(18,4)"), ("bigint", "decimal(18,2)"), ("double", "bigint"), ("double", "double")],
)
def test_salt_never_loses_rows_of_other_key_types(spark, a, b):
    left = spark.range(4000).selectExpr(f"cast(if(id % 2 = 0, 0, id % 40) as {a}) AS k", "id")
    if a == "double":
        left = left.selectExpr("if(k = 0, -0.0D, k) AS k", "id")
    right = spark.range(40).selectExpr(f"cast(id as {b}) AS k", "id AS r")
    hot = joins.hot_keys(left, "k")
    assert joins.join_on_key(left, right, "k", hot=hot).count() == 4000


def test_upsert_of_some_columns_keeps_the_others(spark):
    target = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k bigint, a string, b double")
    source = spark.createDataFrame([(2, None), (3, "c")], "k int, a string")
    got = upsert_by_key(target, source, "k")
    assert got.dtypes == target.dtypes
    assert sorted(map(tuple, got.collect())) == [(1, "a", 1.0), (2, None, 2.0), (3, "c", None)]
    with pytest.raises(ValueError):
        upsert_by_key(target, source.withColumnRenamed("a", "other"), "k")
