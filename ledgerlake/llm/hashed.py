"""Words, hashed features and multinomial weights with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.tables import first_by_hash

SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; none for NULL."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def word_hashes(own: str) -> Column:
    return F.transform(own, lambda x: F.xxhash64(x))


def pair_hashes(own: str) -> Column:
    """Of two neighbouring words each. ``own`` is a column's name: an expression would be computed anew
    for every word."""
    firsts = F.slice(own, 1, F.greatest(F.size(own) - 1, F.lit(0)))
    return F.transform(firsts, lambda x, i: F.xxhash64(x, F.get(own, i + 1)))


def bucket(h: Column, buckets: int) -> Column:
    return F.pmod(h, F.lit(buckets)).cast("int")


def bucket_counts(words: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n) of the words of a column ``w`` and their pairs: at most one row per bucket from each task.

    The outer form of explode keeps the planner from hashing once more, to leave out rows without
    any. To join the two arrays into one would take as long as to hash the words."""
    both = words.select(F.explode_outer(F.array(word_hashes("w"), pair_hashes("w"))).alias("hashes"))
    flat = both.select(F.explode_outer("hashes").alias("h")).select(bucket(F.col("h"), buckets).alias("bucket"))
    return flat.groupBy("bucket").agg(F.count("bucket").alias("n")).where("bucket IS NOT NULL")


def dense(weights: DataFrame, buckets: int, missing: Column) -> Column:
    """An array with ``weight`` at place ``bucket``, as the one value of a scalar subquery: its size
    is the number of buckets, whatever the corpus holds."""
    every = weights.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    filled = every.join(weights.select("bucket", "weight"), "bucket", "left").select(
        F.struct("bucket", F.coalesce("weight", missing).alias("weight")).alias("w")
    )
    placed = filled.agg(F.sort_array(F.collect_list("w")).alias("w"))
    return placed.select(F.transform("w", lambda w: w["weight"])).scalar()


def labelled(labels: DataFrame, condition: Column, most: int) -> DataFrame:
    """Ids of at most ``most`` rows of ``labels`` that meet ``condition``. A document labelled twice
    counts by its lower quality and its higher toxicity."""
    one = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.min("quality").alias("quality"), F.max("toxic").alias("toxic")
    )
    return first_by_hash(one.where(condition).select("doc_id"), "doc_id", most)
