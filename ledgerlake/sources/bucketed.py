"""Tables in Spark's own buckets of a join key.

Two such tables with equally many buckets of the same key are joined on it without a shuffle: a task
reads bucket k of both. A table is a folder of versions (see `tables`); the session's catalog only
gets an entry for the version that is read, with its buckets, over the files where they lie. So another
session, or a cluster without a catalog of its own, reads the same table by its folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.operators.joins import hot_keys, is_hot, join_on_key
from ledgerlake.sources.tables import VersionedTable


#: Rows of a bucket, about: what a task sorts at once. Spark takes no more buckets than _MOST_BUCKETS.
ROWS_PER_BUCKET = 1_000_000
_MOST_BUCKETS = 65_536


def buckets_for(*tables: DataFrame, least: int = 16, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    """How many buckets tables that are to be joined should all have: ``least``, doubled until the largest
    table has no more than ``rows_per_bucket`` rows in the average bucket."""
    rows, buckets = max(t.count() for t in tables), least
    while rows > buckets * rows_per_bucket and buckets * 2 <= _MOST_BUCKETS:
        buckets *= 2
    return buckets


class BucketedTable(VersionedTable):
    """A table that is replaced as a whole, kept in ``buckets`` buckets of ``key``, each sorted by it.

    A bucket is one task's work: choose ``buckets`` by `buckets_for`, alike for tables that are to be joined."""

    def __init__(self, spark: SparkSession, root: str, key: str | Sequence[str], buckets: int = 16):
        super().__init__(spark, root)
        self.key = [key] if isinstance(key, str) else list(key)
        self.buckets = buckets

    def _name(self, directory: str, buckets: int) -> str:
        path = f"{self.root}/{directory} {buckets} {self.key}"
        return "bucketed_" + hashlib.md5(path.encode()).hexdigest()

    def replace(self, df: DataFrame) -> None:
        """Make ``df`` the whole content: one shuffle by the key, one file per bucket."""
        version = self.version + 1
        directory = f"data/version={version}"
        name = self._name(directory, self.buckets)
        # A run that died may have left the entry and its files.
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        dealt = df.repartition(self.buckets, *self.key)
        writer = dealt.write.mode("overwrite").format("parquet").option("path", f"{self.root}/{directory}")
        writer.bucketBy(self.buckets, *self.key).sortBy(*self.key).saveAsTable(name)
        self._commit([(version, directory, None, self.buckets, None, None)])

    def read(self, empty: str | None = None) -> DataFrame:
        entries = self._entries()
        if not entries:
            return super().read(empty)
        directory, buckets = entries[0]["directory"], entries[0]["buckets"]
        name = self._name(directory, buckets)
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"`{n}` {t}" for n, t in self._load([directory]).dtypes)
            key = ", ".join(f"`{k}`" for k in self.key)
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({key}) "
                f"SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{self.root}/{directory}'"
            )
        return self.spark.table(name)


def join_colocated(left: BucketedTable, right: BucketedTable) -> DataFrame:
    """Inner join of two tables in equally many buckets of one key, without a shuffle.

    A key with so many rows that its bucket stands out would be one task's work: such rows alone are
    dealt out anew by `join_on_key`, all others stay where they are."""
    if left.key != right.key:
        raise ValueError(f"buckets of {left.key} and {right.key}")
    rows, others = left.read(), right.read()
    hot = hot_keys(rows, left.key, share=4 / left.buckets) if left.buckets > 4 else []
    if not hot:
        return rows.join(others, left.key)
    a, b = is_hot(rows, left.key, hot), is_hot(others, left.key, hot)
    cold = rows.where(~a).join(others.where(~b), left.key)
    return cold.unionByName(join_on_key(rows.where(a), others.where(b), left.key, hot=hot))
