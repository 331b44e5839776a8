"""Parquet tables that a reader never sees half-written.

A table's folder has ``data/``, where every write goes to a directory of its own, and
``versions/``, a small Parquet table listing the directories of each version and what the
version took in from other tables. A write becomes visible by appending one file to
``versions/``, after its data is complete.
A run that dies before that leaves nothing visible, and the next run overwrites what
it left. One writer at a time; earlier versions stay readable.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ledgerlake.functions.typing import nan_to_null
from ledgerlake.operators.quality import key_summary
from ledgerlake.operators.upsert import untouched, upsert_by_key

# A row names a directory of the version or, with ``source``, an entry that it took in.
_VERSIONS = (
    "version int, directory string, bucket int, buckets int, source string, entry string"
)
# The source of the row that says whether a version's batch had all columns.
_INCOMING, _WHOLE = "incoming", "whole"
#: Up to so many buckets, a task writes its rows of each to a file of its own; for more, rows are dealt
#: out by bucket first, so that files do not become many and small.
_FEW_BUCKETS = 8
#: How files are compressed: half the bytes of Spark's default for rows of these tables.
COMPRESSION = "zstd"


def _rows_or_none(spark: SparkSession, schema: str, path: str) -> DataFrame | None:
    """A small log table, or None before anything was written to it."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _append_log(spark: SparkSession, rows: Sequence[tuple], schema: str, path: str) -> None:
    # One file, which the writer moves into place in one step.
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def counted(df: DataFrame) -> tuple[DataFrame, Observation]:
    """``df`` and the number of its rows, ``rows``, as soon as it was written once: no second scan.

    Exact where the rows go straight into files; below a shuffle, a task that is repeated after a
    lost executor counts again."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def _write_counted(df: DataFrame, path: str) -> int:
    rows, seen = counted(df)
    rows.write.mode("overwrite").parquet(path, compression=COMPRESSION)
    return seen.get["rows"]


def write_buckets(df: DataFrame, path: str, buckets: int) -> None:
    """A directory per value of ``bucket``, of which there are ``buckets`` at most."""
    if buckets > _FEW_BUCKETS:
        # Even-sized output files: small buckets share a task, a large one is split.
        df = df.hint("rebalance", F.col("bucket"))
    df.write.mode("overwrite").partitionBy("bucket").parquet(path, compression=COMPRESSION)


class BatchTable:
    """An append-only table: a directory per batch and attempt, and a log of the finished ones with
    their columns. A batch may add columns or lack some; readers have the columns of all."""

    _LOG = "batch_id string, attempt int, directory string, columns string"

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _finished(self) -> list:
        """Last finished attempt of each batch, oldest batch first; one short row per batch."""
        log = _rows_or_none(self.spark, self._LOG, f"{self.root}/batches")
        if log is None:
            return []
        last = log.groupBy("batch_id").agg(
            F.max_by(F.struct("directory", "columns"), "attempt").alias("last"), F.max("attempt").alias("attempt")
        )
        return sorted(last.select("batch_id", "attempt", "last.*").collect(), key=lambda r: r["batch_id"])

    def batches(self) -> list[str]:
        """Names of the finished batches, oldest first."""
        return [r["batch_id"] for r in self._finished() if r["directory"]]

    def entries(self) -> list[str]:
        """Directories of the finished batches, oldest first. A batch that was added again
        is a new entry."""
        return [r["directory"] for r in self._finished() if r["directory"]]

    def _log(self, batch_id: str, attempt: int, directory: str | None, columns: str | None = None) -> None:
        _append_log(self.spark, [(batch_id, attempt, directory, columns)], self._LOG, f"{self.root}/batches")

    def _check_types(self, schema: StructType, batch_id: str) -> None:
        """Refuse a column that has another type in another batch."""
        for other in self._finished():
            if other["directory"] and other["columns"] and other["batch_id"] != batch_id:
                known = {f.name: f.dataType for f in StructType.fromJson(json.loads(other["columns"]))}
                for f in schema:
                    if known.get(f.name, f.dataType) != f.dataType:
                        raise ValueError(
                            f"{self.root}: {f.name} is {f.dataType.simpleString()} in batch {batch_id} and "
                            f"{known[f.name].simpleString()} in batch {other['batch_id']}"
                        )

    def _next_attempt(self, batch_id: str) -> int:
        return 1 + max((r["attempt"] for r in self._finished() if r["batch_id"] == batch_id), default=0)

    def append(self, df: DataFrame, batch_id: str) -> int:
        """Add a batch; the number of its rows. Adding the same batch again replaces it, so a
        repeated run does not duplicate rows; until that is complete, readers have the batch as it
        was. A column whose type differs from that in another batch is refused."""
        plain = StructType([StructField(f.name, f.dataType) for f in df.schema])
        self._check_types(plain, batch_id)
        attempt = self._next_attempt(batch_id)
        directory = f"data/batch_id={batch_id}/attempt={attempt}"
        rows = _write_counted(df, f"{self.root}/{directory}")
        self._log(batch_id, attempt, directory, plain.json())
        return rows

    def withdraw(self, batch_id: str) -> None:
        """Take back a batch, such as one that a later step refuses for good."""
        self._log(batch_id, self._next_attempt(batch_id), None)

    def load(self, entries: Sequence[str]) -> DataFrame:
        """The rows of some entries with the columns of all of them and their ``batch_id``. A batch
        without a column has NULL there."""
        if not entries:
            raise FileNotFoundError(f"no batch at {self.root}")
        columns = {r["directory"]: r["columns"] for r in self._finished()}
        alike: dict[str | None, list[str]] = {}
        for e in entries:
            alike.setdefault(columns.get(e), []).append(f"{self.root}/{e}")
        parts = []
        for schema, paths in alike.items():
            reader = self.spark.read.option("basePath", f"{self.root}/data")
            if schema:
                own = StructType.fromJson(json.loads(schema))
                reader = reader.schema(own.add("batch_id", StringType()).add("attempt", IntegerType()))
            parts.append(reader.parquet(*paths).drop("attempt"))
        whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        return whole.select(*[c for c in whole.columns if c != "batch_id"], "batch_id")

    def read(self) -> DataFrame:
        return self.load(self.entries())

    def latest(self) -> DataFrame:
        """The newest batch; only its directory is opened."""
        return self.load(self.entries()[-1:])


class VersionedTable:
    """A table that is replaced as a whole."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _versions(self) -> DataFrame | None:
        return _rows_or_none(self.spark, _VERSIONS, f"{self.root}/versions")

    def _entries(self) -> list:
        """Directories of the current version. A bucket that a merge touched has two at most: the batch's rows
        and those that the batch left alone."""
        versions = self._versions()
        if versions is None:
            return []
        held = versions.where("directory IS NOT NULL")
        return held.where(F.col("version") == held.select(F.max("version")).scalar()).collect()

    def consumed(self, source: str) -> set[str]:
        """Entries of ``source`` that this table's versions took in."""
        versions = self._versions()
        if versions is None:
            return set()
        taken = versions.where(F.col("source") == source).select("entry").distinct()
        return {r["entry"] for r in taken.collect()}

    def _load(self, directories: Iterable[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.root}/{d}" for d in directories])

    def _commit(self, entries: Sequence[tuple]) -> None:
        _append_log(self.spark, entries, _VERSIONS, f"{self.root}/versions")

    @property
    def version(self) -> int:
        """Number of the current version, 0 before the first write."""
        return max((e["version"] for e in self._entries()), default=0)

    def read(self, empty: str | None = None) -> DataFrame:
        """The current version. Before the first write: no rows of schema ``empty``, or
        an error if none is given."""
        entries = self._entries()
        if entries:
            return self._load([e["directory"] for e in entries])
        if empty is None:
            raise FileNotFoundError(f"no table at {self.root}")
        return self.spark.createDataFrame([], empty)

    def replace(self, df: DataFrame) -> int:
        """Make ``df`` the whole content; the number of its rows. ``df`` may read from this same table."""
        version = self.version + 1
        directory = f"data/version={version}"
        rows = _write_counted(df, f"{self.root}/{directory}")
        self._commit([(version, directory, None, None, None, None)])
        return rows


class KeyedTable(VersionedTable):
    """A table with a unique key, kept in hash buckets so that a merge rewrites only
    the buckets that the batch touches. ``buckets`` is the number that the first write makes. With
    ``rows_per_bucket``, a merge that finds more rows than that in the average bucket splits
    every bucket by one more bit of its keys' hashes, as often as needed: it rewrites the whole
    table, which comes once per doubling, so a row is rewritten a bounded number of times for it."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        key: str | Sequence[str],
        buckets: int = 16,
        rows_per_bucket: int | None = None,
    ):
        super().__init__(spark, root)
        self.key = [key] if isinstance(key, str) else list(key)
        self.buckets = buckets
        self.rows_per_bucket = rows_per_bucket

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(buckets)).cast("int")

    def _buckets_now(self, entries: Sequence) -> int:
        """How many buckets the next version has. Rows are counted from the files' footers."""
        buckets = entries[0]["buckets"] if entries else self.buckets
        if entries and self.rows_per_bucket:
            rows = self._load([e["directory"] for e in entries]).count()
            while rows > buckets * self.rows_per_bucket:
                buckets *= 2
        return buckets

    def check_key(self, batch: DataFrame) -> None:
        """Refuse a batch in which a key is NULL or occurs twice."""
        found = key_summary(batch, self.key).first()
        if found["duplicate_keys"] or found["null_keys"]:
            raise ValueError(
                f"{self.root}: batch has {found['duplicate_keys']} duplicate and "
                f"{found['null_keys']} NULL keys on {', '.join(self.key)}"
            )

    def merge(
        self,
        source: DataFrame,
        check: Callable[[DataFrame], None] | None = None,
        consumed: Sequence[tuple[str, str]] = (),
    ) -> dict[str, int]:
        """Insert new keys, overwrite known ones, keep the rest.

        The batch is written once under ``incoming/``; everything after reads that, so
        an expensive source is computed one time and a lost executor costs a re-read.
        ``check`` sees the written batch before anything changes and raises to refuse
        it; it must cover the key, as the default `check_key` does. ``consumed`` names, as
        (source, entry), what the batch was made of: it is recorded with the version, so
        that either both are there or neither.
        """
        entries = self._entries()
        version = max((e["version"] for e in entries), default=0) + 1
        buckets = self._buckets_now(entries)
        split = bool(entries) and buckets > entries[0]["buckets"]

        floats = [n for n, t in source.dtypes if t in ("float", "double")]
        clean = source.withColumns({n: nan_to_null(n) for n in floats}) if floats else source
        stored = self._load([entries[0]["directory"]]).schema if entries else clean.schema
        if unknown := [c for c in clean.columns if c not in stored.names]:
            raise ValueError(f"{self.root}: columns unknown to the table: {', '.join(unknown)}")
        # In the table's types, so that a key is in the same bucket whatever type it came in.
        clean = clean.select(*[F.col(c).cast(stored[c].dataType).alias(c) for c in clean.columns])
        partial = len(clean.columns) < len(stored.names)
        staged = clean.withColumn("bucket", self._bucket(buckets))
        incoming = f"incoming/version={version}"
        write_buckets(staged, f"{self.root}/{incoming}", buckets)
        batch = self.spark.read.schema(staged.schema).parquet(f"{self.root}/{incoming}")
        (check or self.check_key)(batch.drop("bucket"))

        touched = {r["bucket"]: r["count"] for r in batch.groupBy("bucket").count().collect()}
        old = [e for e in entries if split or e["bucket"] in touched]
        now: dict[int, list[str]] = {}
        for e in entries:
            if not split and e["bucket"] not in touched:
                now.setdefault(e["bucket"], []).append(e["directory"])
        whole = partial or split
        if not whole:
            # The batch's own files are its buckets' new rows; only what they do not replace is written.
            now |= {b: [f"{incoming}/bucket={b}"] for b in touched}
        if old or partial:
            rows = self._load([e["directory"] for e in old]) if old else self.spark.createDataFrame([], stored)
            before = rows.withColumn("bucket", self._bucket(buckets))
            kept = upsert_by_key(before, batch, self.key) if whole else untouched(before, batch, self.key)
            written = f"data/version={version}"
            write_buckets(kept, f"{self.root}/{written}", buckets)
            found = self.spark.read.schema(before.schema).parquet(f"{self.root}/{written}").select("bucket")
            for r in found.distinct().collect():
                now.setdefault(r["bucket"], []).append(f"{written}/bucket={r['bucket']}")

        held = [(version, d, b, buckets, None, None) for b, ds in sorted(now.items()) for d in ds]
        taken = [(_INCOMING, "part" if partial else _WHOLE), *consumed]
        self._commit([*held, *[(version, None, None, None, *t) for t in taken]])
        rows = sum(touched.values())
        return {"version": version, "rows": rows, "touched_buckets": len(touched)}

    def versions(self) -> list[int]:
        """Numbers of all versions that hold rows, oldest first."""
        versions = self._versions()
        if versions is None:
            return []
        held = versions.where("directory IS NOT NULL").select("version").distinct()
        return sorted(r["version"] for r in held.collect())

    def changed_in(self, versions: Sequence[int]) -> DataFrame:
        """The rows that the merges of ``versions`` brought in, as they are now.

        Those of the current version alone are read from where its merge left them. For
        several, or for a batch that lacked columns, their keys are looked up in the table."""
        entries = self._entries()
        if not entries or not versions:
            raise FileNotFoundError(f"no such version at {self.root}")
        schema = self._load([entries[0]["directory"]]).schema
        if list(versions) == [entries[0]["version"]]:
            log = self._versions().where((F.col("version") == versions[0]) & (F.col("source") == _INCOMING))
            if [r["entry"] for r in log.collect()] == [_WHOLE]:
                path = f"{self.root}/incoming/version={versions[0]}"
                return self.spark.read.schema(schema).parquet(path).drop("bucket")
        keys = StructType([schema[k] for k in self.key])
        paths = [f"{self.root}/incoming/version={v}" for v in versions]
        parts = [self.spark.read.schema(keys).parquet(p).select(*self.key) for p in paths]
        touched = reduce(DataFrame.unionByName, parts)
        return self.read().join(touched, self.key, "left_semi")

    def latest_batch(self) -> DataFrame:
        """The rows that the last merge brought in."""
        return self.changed_in(self.versions()[-1:])

    def holding(self, keys: DataFrame) -> DataFrame:
        """The buckets that may hold some of ``keys`` (columns named like the table's key). What comes
        to the driver is the numbers of these buckets; no other bucket is opened."""
        entries = self._entries()
        if not entries:
            raise FileNotFoundError(f"no table at {self.root}")
        schema = self._load([entries[0]["directory"]]).schema
        typed = keys.select(*[F.col(k).cast(schema[k].dataType).alias(k) for k in self.key])
        numbers = typed.select(self._bucket(entries[0]["buckets"]).alias("b")).distinct()
        touched = {r["b"] for r in numbers.collect()}
        chosen = [e["directory"] for e in entries if e["bucket"] in touched]
        return self._load(chosen) if chosen else self.spark.createDataFrame([], schema)

    def rewritten(self) -> DataFrame | None:
        """The buckets that the last merge wrote, None if it wrote none. A key is in one
        bucket only, so what holds for the others still does."""
        entries = self._entries()
        new = [e["directory"] for e in entries if f"/version={e['version']}/" in e["directory"]]
        return self._load(new) if new else None


class BucketSummary(VersionedTable):
    """What a function makes of each bucket of a `KeyedTable`, kept up to date bucket by bucket.

    Each entry records the directories of the source's bucket that it was made of. A merge gives every
    bucket it touches new directories, so what is out of date shows by itself, after any number of
    merges and after a run that died; rows that a merge replaced are gone with their bucket's old
    summary."""

    def __init__(self, source: KeyedTable, root: str, build: Callable[[DataFrame, list[str]], DataFrame]):
        super().__init__(source.spark, root)
        self.source, self.build = source, build

    def stale(self) -> dict[int, str]:
        """Buckets of the source that are not summed up yet, with their directories, separated by blanks."""
        known = {e["bucket"]: e["entry"] for e in self._entries()}
        now: dict[int, list[str]] = {}
        for e in self.source._entries():
            now.setdefault(e["bucket"], []).append(e["directory"])
        return {b: made for b, ds in now.items() if known.get(b) != (made := " ".join(sorted(ds)))}

    def stale_rows(self) -> DataFrame | None:
        """The rows to be read for the next refresh, with their ``bucket``."""
        due = self.stale()
        if not due:
            return None
        buckets = self.source._entries()[0]["buckets"]
        directories = [d for made in due.values() for d in made.split(" ")]
        return self.source._load(directories).withColumn("bucket", self.source._bucket(buckets))

    def refresh(self) -> DataFrame:
        """Sum up the buckets that changed, and no others; the summaries of all."""
        due, rows = self.stale(), self.stale_rows()
        if rows is not None:
            version = self.version + 1
            buckets = self.source._entries()[0]["buckets"]
            write_buckets(self.build(rows, ["bucket"]), f"{self.root}/data/version={version}", buckets)
            kept = [e for e in self._entries() if e["bucket"] not in due]
            same = [(version, e["directory"], e["bucket"], None, None, e["entry"]) for e in kept]
            new = [(version, f"data/version={version}/bucket={b}", b, None, None, d) for b, d in due.items()]
            self._commit([*same, *new])
        return self.read()
