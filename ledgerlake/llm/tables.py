"""Given tables, intermediate tables in the shared folder, and bounded labelled samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.sources.scratch import new_folder

HELD_OUT = 2


def given(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there, and every
    executor can read what another one wrote."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; NULL without an id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def held_out(doc_id: Column) -> Column:
    """Documents without an id are in no fold: not held out, and not learned from either."""
    return F.coalesce(fold(doc_id) == HELD_OUT, F.lit(False))


def first_by_hash(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows, the same ones on every run: those whose key hashes lowest."""
    return rows.orderBy(F.xxhash64(key), key).limit(most)
