"""Database tables through Spark's JDBC source.

``options`` are the connection options of that source (url, driver, user, password).
Statements that Spark cannot send are run by ``execute``, a function of the caller
that runs a list of SQL texts in the same database as one transaction.

A task that is repeated after its rows were already committed would write them twice.
So no target is written to directly: rows go to a staging table, and one transaction
moves them over, dropping repeats. That transaction is the commit point.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROW = "_staged_row"


@dataclass(frozen=True)
class Slices:
    """How to cut a table scan into parallel reads."""

    column: str
    lower: int | str
    upper: int | str
    count: int

    def options(self) -> dict[str, str]:
        return {
            "partitionColumn": self.column,
            "lowerBound": str(self.lower),
            "upperBound": str(self.upper),
            "numPartitions": str(self.count),
        }


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def newest_rows_of(table: str, stamp: str = "etl_created_at", alias: str = "newest") -> str:
    """A table expression for the rows of the newest batch, evaluated in the database."""
    column = quoted(stamp)
    return f"(SELECT * FROM {table} WHERE {column} = (SELECT MAX({column}) FROM {table})) {alias}"


def jdbc_table_scan(
    spark: SparkSession, options: Mapping[str, str], table: str, slices: Slices | None = None
) -> DataFrame:
    """A table, or a parenthesised query with an alias, as a DataFrame."""
    reader = spark.read.format("jdbc").options(**options).option("dbtable", table)
    return reader.options(**slices.options()).load() if slices else reader.load()


def _write(df: DataFrame, options: Mapping[str, str], table: str, mode: str, connections: int):
    (
        df.write.format("jdbc")
        .options(**options)
        .option("dbtable", table)
        .option("numPartitions", str(connections))
        .option("batchsize", "10000")
        .mode(mode)
        .save()
    )


def append_statement(table: str, staging: str, columns: Sequence[str]) -> str:
    """Move staged rows over. Equal rows are told apart by the staged row number, so
    only a repeated write of the same row is dropped."""
    names = ", ".join(quoted(c) for c in columns)
    return (
        f"INSERT INTO {table} ({names}) SELECT {names} "
        f"FROM (SELECT DISTINCT {names}, {quoted(_ROW)} FROM {staging}) staged"
    )


def merge_statement(table: str, staging: str, columns: Sequence[str], keys: Sequence[str]) -> str:
    """Standard MERGE: every non-key column of a known key is overwritten."""
    names = [quoted(c) for c in columns]
    rest = [quoted(c) for c in columns if c not in keys]
    match = " AND ".join(f"t.{quoted(k)} = s.{quoted(k)}" for k in keys)
    update = ", ".join(f"{c} = s.{c}" for c in rest)
    matched = f"WHEN MATCHED THEN UPDATE SET {update} " if rest else ""
    return (
        f"MERGE INTO {table} t USING (SELECT DISTINCT {', '.join(names)} FROM {staging}) s "
        f"ON {match} {matched}WHEN NOT MATCHED THEN INSERT ({', '.join(names)}) "
        f"VALUES ({', '.join('s.' + c for c in names)})"
    )


def _numbered(df: DataFrame) -> DataFrame:
    return df.withColumn(_ROW, F.monotonically_increasing_id())


def jdbc_append(
    df: DataFrame,
    options: Mapping[str, str],
    table: str,
    execute: Callable[[list[str]], None],
    connections: int = 8,
) -> None:
    """Add rows to a database table, each once; the table is created if absent.

    ``df`` should come straight from a scan, whose row numbers a repeated task gives
    out again in the same order."""
    staging = f"{table}_staging"
    _write(df.limit(0), options, table, "append", 1)
    _write(_numbered(df), options, staging, "overwrite", connections)
    execute([append_statement(table, staging, df.columns)])


def jdbc_overwrite(
    df: DataFrame,
    options: Mapping[str, str],
    table: str,
    execute: Callable[[list[str]], None],
    connections: int = 8,
) -> None:
    """Replace the rows of a database table, keeping its definition; readers see the old
    rows until the new ones are in. ``df`` as for `jdbc_append`."""
    staging = f"{table}_staging"
    _write(df.limit(0), options, table, "append", 1)
    _write(_numbered(df), options, staging, "overwrite", connections)
    execute([f"DELETE FROM {table}", append_statement(table, staging, df.columns)])


def jdbc_upsert(
    df: DataFrame,
    options: Mapping[str, str],
    table: str,
    keys: str | Sequence[str],
    execute: Callable[[list[str]], None],
    connections: int = 8,
) -> None:
    """Merge ``df``, unique by ``keys``, into a database table with that key."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    staging = f"{table}_staging"
    _write(df, options, staging, "overwrite", connections)
    execute([merge_statement(table, staging, df.columns, keys)])
