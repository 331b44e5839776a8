import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from ledgerlake.sources import csv, files, jdbc
from ledgerlake.sources.scratch import new_folder, shared_folder
from ledgerlake.sources.tables import BatchTable, BucketSummary, KeyedTable, VersionedTable


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    return path


# ---- CSV


def test_quotes_and_line_breaks(spark, folder):
    path = write(
        f"{folder}/in/a.csv",
        'id,name,note\n1,"x ""q"" y","two\nlines"\n2,"a, b",""\n3,plain,\n4,"  ","end"\n',
    )
    df = csv.csv_scan_raw(spark, path)
    assert {t for _, t in df.dtypes} == {"string"}
    assert rows(df.drop("source_file_name")) == [
        ("1", 'x "q" y', "two\nlines"),
        ("2", "a, b", None),
        ("3", "plain", None),
        ("4", "  ", "end"),
    ]
    assert {r[0] for r in df.select("source_file_name").collect()} == {"a.csv"}


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ('1,"a\r\nb"\n', [("1", "a\r\nb")]),
        ('1,"a\rb"\n2,"c\n\nd"\n', [("1", "a\rb"), ("2", "c\n\nd")]),
        ("1,a\rb\n2,c\n", None),  # a lone break outside quotes
        ("1,a\r\n2,c\n", None),  # mixed line ends
        ('1,x"y\n2,"a\nb"\n', None),  # a quote inside an unquoted field
        ('1,"a"b\n2,"a\nb"\n', None),  # text after a closing quote
        ('1,"never\nclosed\n2,b\n', None),  # one stray quote
        ("1,2\n   \n3,4\n", None),
    ],
)
@pytest.mark.parametrize("max_partition", ["16b", "128MB"])
def test_rows_do_not_depend_on_size_or_content(spark, folder, body, want, max_partition):
    path = write(f"{folder}/in/f.csv", "p,q\n" + body)
    plain = spark.read.csv(path, header=True, escape='"', multiLine=True, inferSchema=False)
    spark.conf.set("spark.sql.files.maxPartitionBytes", max_partition)
    try:
        got = rows(csv.csv_scan_raw(spark, path).drop("source_file_name"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == (rows(plain) if want is None else want)


def test_a_different_header_is_an_error(spark, folder):
    write(f"{folder}/in/a.csv", "a,b\n1,2\n")
    write(f"{folder}/in/b.csv", "b,a\n1,2\n")
    with pytest.raises(Exception, match="CSV header"):
        csv.csv_scan_raw(spark, f"{folder}/in").collect()


# ---- file sets


def test_fingerprints(spark, folder):
    rng = random.Random(1)
    want = set()
    for n, size in enumerate([0, 1, 5000, 3_000_000]):
        content = rng.randbytes(size)
        path = f"{folder}/in/f{n}.bin"
        os.makedirs(f"{folder}/in", exist_ok=True)
        with open(path, "wb") as f:
            f.write(content)
        want.add((f"f{n}.bin", size, hashlib.md5(content).hexdigest()))
    df = files.file_fingerprint(spark, f"{folder}/in", "*.bin")
    name = F.element_at(F.split("file_path", "/"), -1)
    assert set(map(tuple, df.select(name, "file_size_bytes", "file_hash").collect())) == want


def test_schemes_that_arrow_names_otherwise():
    assert files.arrow_address("s3a://bucket/in/a b%20#1.csv") == ("s3://bucket/", "/in/a b%20#1.csv")
    assert files.arrow_address("hdfs://host:8020/in") == ("hdfs://host:8020/", "/in")
    assert files.arrow_address("abfss://c@a.dfs.core.windows.net/x/y") == ("abfss://c@a.dfs.core.windows.net/", "/x/y")
    assert files.arrow_address("file:/a/b") == files.arrow_address("file:///a/b") == files.arrow_address("/a/b") == ("", "/a/b")


def test_listing_follows_a_scan(spark, folder):
    for name in ("a.csv", "b%20 c.csv", "x.txt", "_d.csv", "k=1/e.csv", "k=1/m=2/f.csv", "k=2/.g.csv", "plain/h.csv"):
        os.makedirs(os.path.dirname(f"{folder}/in/{name}"), exist_ok=True)
        write(f"{folder}/in/{name}", "" if name == "a.csv" else name)
    got = files.list_files(spark, f"{folder}/in/", "*.csv").collect()
    names = ["a.csv", "b%20 c.csv", "k=1/e.csv", "k=1/m=2/f.csv"]
    assert sorted(r.file_path for r in got) == [f"file:{folder}/in/{n}" for n in names]
    scanned = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{folder}/in/k=1")
    mine = {(r.file_path, r.file_size_bytes, r.last_modified_at) for r in got if "k=1" in r.file_path}
    assert {(r.path, r.length, r.modificationTime) for r in scanned.collect()} == mine
    with pytest.raises(FileNotFoundError):
        files.list_files(spark, f"{folder}/nowhere")
    os.makedirs(f"{folder}/empty")
    assert files.file_fingerprint(spark, f"{folder}/empty").collect() == []


def test_files_of_another_store(spark, folder):
    """A store under a Hadoop scheme, here a folder that stands in for it."""
    os.makedirs(f"{folder}/bucket/in")
    write(f"{folder}/bucket/in/a.csv", "a")

    def opener(path):
        from pyarrow import fs

        address, inside = files.arrow_address(path)
        return fs.LocalFileSystem(), folder + "/" + address.removeprefix("s3://").rstrip("/") + inside

    got = files.file_fingerprint(spark, "s3a://bucket/in", "*.csv", opener).collect()
    assert [(r.file_path, r.file_hash) for r in got] == [("s3a://bucket/in/a.csv", hashlib.md5(b"a").hexdigest())]


MANIFEST_ROW = "file_key string, file_hash string"


def test_changed_files(spark):
    found = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")], MANIFEST_ROW)
    known = spark.createDataFrame([("a", "1"), ("b", "x"), ("c", None)], MANIFEST_ROW)
    assert rows(files.changed_files(found, known)) == [("b", "2"), ("c", "3"), ("d", "4")]


def test_missing_sources(spark):
    expected = spark.createDataFrame([("a",), ("b",)], "k string")
    files.require_sources(expected, expected, "k")
    with pytest.raises(FileNotFoundError, match="b"):
        files.require_sources(expected, expected.where("k = 'a'"), "k")


def test_manifest(spark):
    def loaded(*found):
        columns = "file_key string, file_name string, file_path string, file_hash string, n bigint"
        df = spark.createDataFrame(found, columns).withColumnRenamed("n", "file_size_bytes")
        return df.withColumn("last_modified_at", F.lit("2026-01-01").cast("timestamp"))

    def shown(df):
        return rows(df.select("file_key", "file_name", "file_hash", "load_count",
                              F.date_format("last_loaded_at", "dd")))

    empty = spark.createDataFrame([], files.MANIFEST)
    one = files.manifest_upsert(
        empty, loaded(("a", "a.csv", "/a", "1", 1), ("b", "b.csv", "/b", "1", 1)), "2026-01-02"
    )
    assert shown(one) == [("a", "a.csv", "1", 1, "02"), ("b", "b.csv", "1", 1, "02")]
    two = files.manifest_upsert(
        one, loaded(("b", "moved.csv", "/x", "2", 2), ("c", "c.csv", "/c", "1", 1)), "2026-01-03"
    )
    assert shown(two) == [
        ("a", "a.csv", "1", 1, "02"), ("b", "b.csv", "2", 2, "03"), ("c", "c.csv", "1", 1, "03"),
    ]
    assert dict(two.dtypes) == dict(empty.dtypes)


# ---- tables


def test_append_is_repeatable(spark, folder):
    table = BatchTable(spark, f"{folder}/t")
    with pytest.raises(FileNotFoundError):
        table.latest()
    table.append(spark.range(5), "b1")
    table.append(spark.range(7), "b2")
    table.append(spark.range(7), "b2")
    spark.range(99).write.parquet(f"{folder}/t/data/batch_id=b3")  # never finished
    assert table.batches() == ["b1", "b2"]
    assert table.read().groupBy("batch_id").count().orderBy("batch_id").collect() == [
        ("b1", 5), ("b2", 7),
    ]
    assert table.latest().count() == 7


def test_a_failed_second_attempt_leaves_the_batch(spark, folder):
    table = BatchTable(spark, f"{folder}/t")
    table.append(spark.range(5), "b1")
    failing = spark.range(9).select(F.when(F.col("id") < 8, F.col("id")).otherwise(F.raise_error(F.lit("no"))).cast("bigint").alias("id"))
    with pytest.raises(Exception, match="no"):
        table.append(failing, "b1")
    assert table.read().count() == 5
    table.append(spark.range(6), "b1")
    assert table.read().count() == 6
    assert table.read().columns == ["id", "batch_id"]
    table.withdraw("b1")
    assert table.batches() == []


def test_rows_of_several_versions_and_partial_batches(spark, folder):
    table = KeyedTable(spark, f"{folder}/t", "k", buckets=3)
    table.merge(spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, w int"))
    table.merge(spark.createDataFrame([(2, "c")], "k int, v string"), consumed=[("raw", "x")])
    assert rows(table.latest_batch()) == [(2, "c", 2)]
    assert rows(table.changed_in([1, 2])) == [(1, "a", 1), (2, "c", 2)]
    assert table.consumed("raw") == {"x"} and table.consumed("other") == set()
    assert table.versions() == [1, 2]


def test_versioned_table_replaces_itself(spark, folder):
    table = VersionedTable(spark, f"{folder}/t")
    with pytest.raises(FileNotFoundError):
        table.read()
    assert table.read(empty="id bigint").count() == 0
    table.replace(spark.range(5))
    before = table.read()
    table.replace(before.withColumn("id", F.col("id") + 10))
    assert rows(table.read()) == [(n,) for n in range(10, 15)]
    assert before.count() == 5  # an earlier version stays readable


def test_unfinished_write_is_invisible_and_is_overwritten(spark, folder):
    table = VersionedTable(spark, f"{folder}/t")
    table.replace(spark.range(3))
    spark.range(99).write.parquet(f"{folder}/t/data/version=2")  # no commit followed
    assert table.read().count() == 3
    table.replace(spark.range(4))
    assert table.read().count() == 4


def test_keyed_table_matches_a_dictionary(spark, folder):
    rng = random.Random(2)
    table, model = KeyedTable(spark, f"{folder}/t", "k", buckets=5), {}
    for _ in range(4):
        batch = {rng.randrange(50): rng.choice([None, 1.5, 2.5]) for _ in range(12)}
        report = table.merge(spark.createDataFrame(list(batch.items()), "k int, v double"))
        model.update(batch)
        assert report["rows"] == len(batch)
        assert rows(table.latest_batch()) == sorted(batch.items(), key=str)
        assert rows(table.read()) == sorted(model.items(), key=str)
    assert table.version == 4


def test_merge_rewrites_only_touched_buckets(spark, folder):
    table = KeyedTable(spark, f"{folder}/t", "k", buckets=8)
    table.merge(spark.range(100).withColumnRenamed("id", "k"))
    report = table.merge(spark.createDataFrame([(5,)], "k bigint"))
    assert report["touched_buckets"] == 1
    assert sum("version=1/" in e["directory"] for e in table._entries()) == 7
    assert table.read().count() == 100


def test_buckets_double_as_the_table_grows(spark, folder):
    rng = random.Random(3)
    table, model, counts = KeyedTable(spark, f"{folder}/t", "k", buckets=2, rows_per_bucket=20), {}, []
    for size in (15, 40, 1, 60, 200, 5, 0):
        batch = {rng.randrange(400): rng.random() for _ in range(size)}
        table.merge(spark.createDataFrame(list(batch.items()), "k int, v double"))
        model.update(batch)
        counts.append(table._entries()[0]["buckets"])
        assert rows(table.read()) == sorted(model.items(), key=str)
        assert rows(table.latest_batch()) == sorted(batch.items(), key=str)
        # Each key is in the bucket that its hash names.
        wanted = list(model)[:2]
        held = table.holding(spark.createDataFrame([(k,) for k in wanted], "k int"))
        assert set(wanted) <= {r.k for r in held.collect()}
        assert held.inputFiles() and len({f.rsplit("/", 1)[0] for f in held.inputFiles()}) <= 2
    assert counts == sorted(counts) and counts[0] == 2 and counts[-1] >= 8
    wide = KeyedTable(spark, f"{folder}/t", "k", rows_per_bucket=3)
    wide.merge(spark.createDataFrame([(k,) for k in list(model)[:3]], "k int"))
    assert wide._entries()[0]["buckets"] > counts[-1]
    assert rows(wide.read()) == sorted(model.items(), key=str)


def test_a_summary_follows_a_split(spark, folder):
    table = KeyedTable(spark, f"{folder}/t", "k", buckets=2, rows_per_bucket=10)
    sums = BucketSummary(table, f"{folder}/s", lambda df, by: df.groupBy(*by).agg(F.sum("v").alias("v")))
    for start in (0, 50, 90):
        table.merge(spark.range(start, start + 60).selectExpr("id AS k", "id AS v"))
        assert sums.refresh().agg(F.sum("v")).first()[0] == sum(range(start + 60))
    assert table._entries()[0]["buckets"] > 2


def test_empty_batch_changes_no_row(spark, folder):
    table = KeyedTable(spark, f"{folder}/t", "k", buckets=3)
    table.merge(spark.createDataFrame([(1, "a")], "k int, v string"))
    assert table.merge(spark.createDataFrame([], "k int, v string"))["rows"] == 0
    assert rows(table.read()) == [(1, "a")]
    assert table.latest_batch().count() == 0


def test_merge_refuses_bad_keys_and_changes_nothing(spark, folder):
    table = KeyedTable(spark, f"{folder}/t", "k", buckets=3)
    table.merge(spark.createDataFrame([(1, "a")], "k int, v string"))
    for bad in ([(1, "x"), (1, "y")], [(None, "x")]):
        with pytest.raises(ValueError, match="keys on k"):
            table.merge(spark.createDataFrame(bad, "k int, v string"))
    assert rows(table.read()) == [(1, "a")]
    assert table.version == 1


def test_nan_is_stored_as_null(spark, folder):
    table = KeyedTable(spark, f"{folder}/t", "k", buckets=2)
    table.merge(spark.createDataFrame([(1, float("nan"))], "k int, v float"))
    assert rows(table.read()) == [(1, None)]


def test_shared_folder_comes_from_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert new_folder(spark, "x") != new_folder(spark, "x")


# ---- database statements (no database is started here)


def test_database_statements():
    assert jdbc.newest_rows_of("raw.t") == (
        '(SELECT * FROM raw.t WHERE "etl_created_at" = (SELECT MAX("etl_created_at") FROM raw.t)) '
        "newest"
    )
    assert jdbc.merge_statement("t", "s", ["k", "a", "b"], ["k"]) == (
        'MERGE INTO t t USING (SELECT DISTINCT "k", "a", "b" FROM s) s ON t."k" = s."k" '
        'WHEN MATCHED THEN UPDATE SET "a" = s."a", "b" = s."b" '
        'WHEN NOT MATCHED THEN INSERT ("k", "a", "b") VALUES (s."k", s."a", s."b")'
    )
    assert "UPDATE" not in jdbc.merge_statement("t", "s", ["k"], ["k"])
    assert jdbc.append_statement("t", "s", ["a"]) == (
        'INSERT INTO t ("a") SELECT "a" FROM (SELECT DISTINCT "a", "_staged_row" FROM s) staged'
    )
    assert jdbc.Slices("id", 1, 100, 8).options() == {
        "partitionColumn": "id", "lowerBound": "1", "upperBound": "100", "numPartitions": "8",
    }


def test_database_writes_go_through_staging(spark, monkeypatch):
    steps = []

    def write(df, options, table, mode, connections):
        steps.append((table, mode, df.count(), options["url"]))

    monkeypatch.setattr(jdbc, "_write", write)
    df, options = spark.range(3), {"url": "jdbc:somewhere"}
    jdbc.jdbc_append(df, options, "t", steps.append)
    jdbc.jdbc_overwrite(df, options, "t", steps.append)
    jdbc.jdbc_upsert(df, options, "t", "id", steps.append)
    moved = jdbc.append_statement("t", "t_staging", ["id"])
    into_staging = ("t_staging", "overwrite", 3, "jdbc:somewhere")
    created = ("t", "append", 0, "jdbc:somewhere")
    assert steps == [
        created, into_staging, [moved],
        created, into_staging, ["DELETE FROM t", moved],
        into_staging, [jdbc.merge_statement("t", "t_staging", ["id"], ["id"])],
    ]
