"""Stored tables: batches of other columns, buckets that need not be read, kept summaries, and checks
that read no more than they need."""

import pytest
from pyspark.sql import functions as F

from ledgerlake.catalog import checks, relations
from ledgerlake.contracts import Field, ForeignKey, TableContract
from ledgerlake.operators.quality import capped_violations, enforce_contract
from ledgerlake.plans import validation
from ledgerlake.sources.bucketed import BucketedTable, buckets_for, join_colocated
from ledgerlake.sources.tables import BatchTable, BucketSummary, KeyedTable, VersionedTable


# ---- batches with other columns


def test_batches_keep_the_columns_of_all(spark, folder):
    table = BatchTable(spark, folder + "/t")
    assert table.append(spark.createDataFrame([(1, "x")], "k int, a string"), "b1") == 1
    table.append(spark.createDataFrame([(2, "y", 0.5), (3, None, None)], "k int, a string, c double"), "b2")
    assert table.append(spark.createDataFrame([(4,)], "k int"), "20260115") == 1
    assert table.append(spark.createDataFrame([], "k int, d date"), "b4") == 0
    got = table.read()
    assert sorted(got.columns[:-1]) == ["a", "c", "d", "k"] and got.columns[-1] == "batch_id"
    assert dict(got.dtypes)["batch_id"] == "string"
    assert sorted((r.k, r.a, r.c, r.d, r.batch_id) for r in got.collect()) == [
        (1, "x", None, None, "b1"), (2, "y", 0.5, None, "b2"), (3, None, None, None, "b2"),
        (4, None, None, None, "20260115"),
    ]
    assert table.latest().columns == ["k", "d", "batch_id"]


def test_a_column_of_another_type_is_refused(spark, folder):
    table = BatchTable(spark, folder + "/t")
    table.append(spark.createDataFrame([(1, "x")], "k int, a string"), "b1")
    retyped = spark.createDataFrame([(1, 2)], "k int, a int")
    with pytest.raises(ValueError, match="a is int in batch b2 and string in batch b1"):
        table.append(retyped, "b2")
    assert table.batches() == ["b1"]
    # The batch itself may come again with other types, and so may all once it is withdrawn.
    table.append(retyped, "b1")
    assert table.read().collect()[0].a == 2


def test_an_older_log_without_columns_is_read(spark, folder):
    table = BatchTable(spark, folder + "/t")
    spark.createDataFrame([(1,)], "k int").write.parquet(f"{folder}/t/data/batch_id=b1/attempt=1")
    old = [("b1", 1, "data/batch_id=b1/attempt=1")]
    spark.createDataFrame(old, "batch_id string, attempt int, directory string").write.parquet(f"{folder}/t/batches")
    table.append(spark.createDataFrame([(2, 3)], "k int, c int"), "b2")
    assert sorted((r.k, r.c, r.batch_id) for r in table.read().collect()) == [(1, None, "b1"), (2, 3, "b2")]


# ---- buckets of parents, kept summaries, co-located joins


def _directories(df):
    return {f.split("/data/")[-1].split("/incoming/")[-1].rsplit("/", 1)[0] for f in df.inputFiles()}


def test_only_the_parent_buckets_of_a_batch_are_read(spark, folder):
    table = KeyedTable(spark, folder + "/p", "key", buckets=8)
    table.merge(spark.range(1000).select(F.col("id").cast("int").alias("key"), F.lit(1).alias("v")))
    in_one = table.read().withColumn("b", table._bucket(8)).where("b = 3").limit(5).select("key")
    held = table.holding(in_one.select(F.col("key").cast("bigint").alias("key")))
    assert len(_directories(held)) == 1 and len(_directories(table.read())) == 8
    assert held.join(in_one, "key").count() == 5
    assert table.holding(in_one.limit(0)).count() == 0
    assert enforced(spark, table, in_one, [0])
    assert not enforced(spark, table, in_one, [5000])


def enforced(spark, parent, keys, more):
    contract = TableContract("t", ("k",), (Field("k", "int"),), (ForeignKey("k", "parents", "key"),))
    rows = keys.select(F.col("key").alias("k")).unionByName(spark.createDataFrame([(m,) for m in more], "k int"))
    held = {"parents": parent.holding(rows.select(F.col("k").alias("key")))}
    return all(r.status == "pass" for r in enforce_contract(rows.distinct(), contract, held).collect())


def test_a_summary_reads_only_buckets_that_changed(spark, folder):
    table = KeyedTable(spark, folder + "/t", "k", buckets=6)

    def build(rows, by):
        return rows.groupBy(*by, "g").agg(F.sum("v").alias("v"), F.count("*").alias("n"))

    sums = BucketSummary(table, folder + "/s", build)

    def same():
        made = sums.refresh().groupBy("g").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
        whole = build(table.read(), []).select("g", "v", "n")
        assert sorted(map(tuple, made.collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)

    with pytest.raises(FileNotFoundError):
        sums.refresh()
    rows = spark.range(3000).selectExpr("CAST(id AS INT) AS k", "CAST(id % 7 AS INT) AS g", "id AS v")
    table.merge(rows)
    assert len(sums.stale()) == 6
    same()
    assert sums.stale() == {} and sums.stale_rows() is None
    version = sums.version
    same()
    assert sums.version == version
    # One bucket's lines replaced, moved to other groups, and one added.
    few = table.read().withColumn("b", table._bucket(6)).where("b = 2").limit(9).select("k")
    table.merge(few.selectExpr("k", "k % 5 AS g", "CAST(-k AS BIGINT) AS v"))
    assert list(sums.stale()) == [2] and len(_directories(sums.stale_rows())) == 1
    same()
    # Two merges before the next refresh.
    table.merge(spark.createDataFrame([(9001, 1, 5)], "k int, g int, v bigint"))
    table.merge(spark.createDataFrame([(9001, 2, 6), (9002, None, None)], "k int, g int, v bigint"))
    same()


def test_a_merge_writes_the_rows_it_replaces_once(spark, folder):
    table = KeyedTable(spark, folder + "/t", "k", buckets=4)
    sums = BucketSummary(table, folder + "/s", lambda df, by: df.groupBy(*by).agg(F.sum("v").alias("v")))

    def same(expected):
        assert {r.k: r.v for r in table.read().collect()} == expected
        assert sums.refresh().agg(F.sum("v")).first()[0] == sum(expected.values())

    table.merge(spark.range(100).selectExpr("id AS k", "id AS v"))
    same({k: k for k in range(100)})
    table.merge(spark.range(40, 110).selectExpr("id AS k", "-id AS v"))
    assert spark.read.parquet(folder + "/t/data/version=2").count() == 40
    same({k: k if k < 40 else -k for k in range(110)})
    assert sorted(r.k for r in table.latest_batch().collect()) == list(range(40, 110))
    assert table.rewritten().count() == 110
    # Nothing of the table is left alone.
    table.merge(spark.range(110).selectExpr("id AS k", "id * 2 AS v"))
    same({k: 2 * k for k in range(110)})
    table.merge(spark.createDataFrame([(7, 1)], "k bigint, v bigint"))
    same({k: 1 if k == 7 else 2 * k for k in range(110)})
    assert table.holding(spark.createDataFrame([(7,)], "k bigint")).where("k = 7").count() == 1


def test_lines_of_the_flow_are_made_once(spark):
    lines, _ = relations.flow_tables(spark, "/root/testdata/sf0.001")
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and lines.count() > 0


def test_stored_sides_are_joined_without_an_exchange(spark, folder):
    tables = []
    for name, rows in (("a", 4000), ("b", 500)):
        table = BucketedTable(spark, f"{folder}/{name}", "k", buckets=6)
        table.replace(spark.range(rows).selectExpr("id % 500 AS k", f"id AS {name}"))
        tables.append(table)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = join_colocated(*tables)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert joined.count() == 4000
        # As another session finds the table: by its folder alone.
        name = tables[0]._name("data/version=1", 6)
        spark.sql(f"DROP TABLE {name}")
        again = join_colocated(BucketedTable(spark, f"{folder}/a", "k", buckets=99), tables[1])
        plan = again._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan and again.count() == 4000
        tables[0].replace(spark.range(10).selectExpr("id AS k", "id AS a"))
        assert join_colocated(*tables).count() == 10
        assert tables[0].version == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_buckets_grow_with_the_largest_side(spark, folder):
    sides = [spark.range(n).selectExpr("id % 90 AS k", f"id AS v{n}") for n in (90, 1000)]
    assert buckets_for(*sides, least=8) == 8
    buckets = buckets_for(*sides, least=8, rows_per_bucket=40)
    assert buckets == 32
    tables = [BucketedTable(spark, f"{folder}/{n}", "k", buckets) for n in "ab"]
    for table, side in zip(tables, sides):
        table.replace(side)
    joined = tables[1].read().join(tables[0].read().hint("merge"), "k")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and joined.count() == 1000 and joined.rdd.getNumPartitions() == 32


def test_a_hot_key_does_not_stay_in_one_bucket(spark, folder):
    a, b = (BucketedTable(spark, f"{folder}/{n}", "k", buckets=16) for n in "ab")
    a.replace(spark.range(9000).selectExpr("IF(id < 6000, 7, id % 400) AS k", "id AS a"))
    b.replace(spark.range(400).selectExpr("id AS k", "id * 2 AS b"))
    joined = join_colocated(a, b)
    assert "_salt" in joined._jdf.queryExecution().analyzed().toString()
    assert joined.count() == 9000 and joined.where("b <> 2 * k").count() == 0
    with pytest.raises(ValueError, match="buckets of"):
        join_colocated(a, BucketedTable(spark, f"{folder}/c", "a", buckets=16))


def test_empty_and_missing_bucketed_tables(spark, folder):
    a, b = (BucketedTable(spark, f"{folder}/{n}", "k", buckets=8) for n in "ab")
    with pytest.raises(FileNotFoundError):
        a.read()
    a.replace(spark.createDataFrame([(None, 1), (2, 3)], "k int, a int"))
    b.replace(spark.createDataFrame([], "k int, b int"))
    assert join_colocated(a, b).collect() == []


# ---- counts and checks that read no more than they need


def test_a_write_counts_its_rows(spark, folder):
    table = VersionedTable(spark, folder + "/v")
    assert table.replace(spark.range(1234).repartition(7)) == 1234
    assert table.replace(table.read().where("id < 0")) == 0
    assert table.replace(spark.createDataFrame([], "k int")) == 0


def test_a_capped_check_starts_few_tasks(spark, folder):
    spark.range(1_000_000).repartition(64).write.parquet(folder + "/many")
    many = spark.read.parquet(folder + "/many")
    context = spark.sparkContext

    def tasks(violated, cap):
        group = f"capped-{violated}-{cap}"
        context.setJobGroup(group, group)
        found = capped_violations(many, F.expr(violated), cap)
        tracker = context.statusTracker()
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(group)]
        context.setJobGroup("other", "other")
        return found, sum(tracker.getStageInfo(s).numTasks for j in jobs for s in j.stageIds)

    spark.conf.set("spark.sql.files.openCostInBytes", "256m")
    try:
        everything = many.rdd.getNumPartitions()
        found, started = tasks("id >= 0", 1000)
        assert (found, everything >= 32) == (1000, True) and started < everything / 8
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert capped_violations(many, F.expr("id < 17"), 1000) == 17
    assert capped_violations(many, F.expr("id IS NULL"), 1000) == 0


def test_the_report_scans_each_table_once(spark):
    where = "/root/testdata/sf0.001"
    keyed = checks._keyed_tables(spark, where)
    q1 = spark.createDataFrame([(2020, "red")], "year int, color string")
    frames = {
        "raw_product_master": keyed["product"], "raw_sales_order_header": keyed["header"],
        "raw_sales_order_detail": keyed["detail"], "store_product_master": keyed["product"],
        "store_sales_order_header": keyed["header"], "store_sales_order_detail": keyed["detail"],
        "publish_product": keyed["published"], "publish_orders": relations.published_orders(spark, where),
        "analysis_revenue_by_color_year": q1, "analysis_avg_lead_time_by_category": q1,
    }
    read, tables = {}, {}
    for name, df in frames.items():
        read[name] = spark.sparkContext.accumulator(0)

        def count(batches, seen=read[name]):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        tables[name] = df.mapInArrow(count, df.schema)
    report = validation.validation_report(tables).collect()
    assert len(report) == 29
    rows = {r.table_name: r.measure for r in report if r.check_name == "not empty"}
    assert {name: seen.value for name, seen in read.items()} == rows and rows["publish_orders"] > 1000


def test_the_report_of_empty_tables(spark):
    keyed = {n: df.limit(0) for n, df in checks._keyed_tables(spark, "/root/testdata/sf0.001").items()}
    empty = {n: keyed["product"] for n in (*validation.RAW, *validation.ANALYSIS, "store_product_master")}
    empty |= {
        "store_sales_order_header": keyed["header"], "store_sales_order_detail": keyed["detail"],
        "publish_product": keyed["published"], "publish_orders": keyed["lines"],
    }
    report = validation.validation_report(empty).collect()
    assert len(report) == 29 and all(r.measure == 0 for r in report)
    assert {r.check_name for r in report if r.status == "fail"} == {
        "not empty", "expected number of returns", "revenue by color and year", "lead time by category",
    }


def test_lines_are_counted_two_ways_without_sums_per_key(spark):
    rows = [(1, 7, 2.0, 5), (2, 7, 3.0, None), (2, None, None, 1), (None, 7, 1.0, 1)]
    df = spark.createDataFrame(rows, "k long, p long, price double, days int")
    sums = {"revenue": F.sum("price"), "timed": F.count("days")}
    counted = validation._by_key_and_other(df, "k", ["p"], {"dear": F.col("price") > 1}, sums, ["price", "days"])
    own = validation._own(counted, ["dear"]).first()
    assert (own["rows"], own["duplicate_keys"], own["null_keys"], own["dear"]) == (4, 1, 1, 2)
    others = {r["p"]: (r["rows"], r["revenue"], r["timed"]) for r in counted.where("NOT own").collect()}
    assert others == {7: (3, 6.0, 2), None: (1, None, 1)}
    assert [(r["revenue"], r["timed"]) for r in counted.where("own").collect()] == [(None, 0)]
    text = counted._jdf.queryExecution().executedPlan().toString()
    assert text.count("Scan") == 1
