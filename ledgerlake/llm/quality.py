"""Quality rules: plain counts, and a likelihood ratio between trusted and raw text. DataFrame
functions only.

Words and pairs of neighbouring words are hashed into buckets. One multinomial is counted over
documents that labels call good, one over the whole corpus; a document's score is the mean log of
their ratio over its features. A fixed threshold decides, so equal texts always fare alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm import hashed
from ledgerlake.llm.tables import written

BUCKETS = 1 << 14
#: Trusted text: at most this many documents with quality 1.
SAMPLE = 10_000
#: Mean log ratio below which a document goes.
THRESHOLD = -0.2
MIN_WORDS = 50
_ADDED = 0.5


def _weights(docs: DataFrame, labels: DataFrame, sample: int, buckets: int) -> Column:
    """log of trusted over raw share per bucket, smoothed by the raw share."""

    def counted(rows: DataFrame) -> DataFrame:
        return hashed.bucket_counts(rows.select(hashed.words(F.col("text")).alias("w")), buckets)

    raw = written(counted(docs), "raw")
    ids = hashed.labelled(labels, F.col("quality") == 1, sample)
    chosen = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    trusted = written(counted(chosen), "trusted")
    n_raw = raw.agg(F.sum("n")).first()[0] or 1
    n_trusted = trusted.agg(F.sum("n")).first()[0] or 0
    share = F.col("n") / n_raw
    both = raw.join(trusted.withColumnRenamed("n", "m"), "bucket", "left").fillna(0, ["m"])
    added = _ADDED * buckets
    ratio = F.log((F.col("m") + added * share) / (n_trusted + added) / share)
    return hashed.dense(both.select("bucket", F.round(ratio, 9).alias("weight")), buckets, F.lit(0.0))


def _repeats(named: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words``: words in three-word windows that the text holds twice or more.

    Windows are compared within one text by a 64-bit hash of the hashes of their words, ``hw``. They are
    sorted only where there are fewer distinct ones than windows; then equal ones are neighbours."""
    windows = F.transform(
        F.slice("hw", 1, F.greatest(F.size("hw") - 2, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get("hw", i + 1), F.get("hw", i + 2)),
    )
    hashes = named.withColumn("h", windows)
    some = F.size(F.array_distinct("h")) < F.size("h")
    placed = F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    ordered = hashes.withColumn("s", F.when(some, placed))

    def same(x, j):
        return F.coalesce(F.get("s", j)["h"] == x["h"], F.lit(False))

    twice = F.transform("s", lambda x, j: F.when(same(x, j - 1) | same(x, j + 1), x["i"]))
    found = ordered.withColumn("r", F.array_compact(twice))
    covered = F.flatten(F.transform("r", lambda i: F.array(i, i + 1, i + 2)))
    count = F.coalesce(F.size(F.array_distinct(covered)), F.lit(0))
    return found.withColumn("n_repeat_words", F.when(F.col("s").isNull(), 0).otherwise(count)).drop("h", "s", "r")


def judge(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample: int = SAMPLE,
    threshold: float = THRESHOLD,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Per row: ``id``, the counts, ``base_failed``, ``score`` (NULL without a word) and ``kept``.

    A NULL text has no words. A document without a word fails. Without trusted text every score is
    0, so the counts alone decide. Repeated rows stay."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    weights = _weights(named, labels, sample, buckets)
    cut = named.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("w", hashed.words(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = _repeats(cut.withColumn("lines", lines).withColumn("hw", hashed.word_hashes("w"))).select(
        F.col("doc_id").alias("id"),
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.col("n_repeat_words").cast("long").alias("n_repeat_words"),
        "hw",
        hashed.pair_hashes("w").alias("hp"),
        weights.alias("weights"),
    )

    def summed(hashes: str, start: Column) -> Column:
        return F.aggregate(hashes, start, lambda a, h: a + F.get("weights", hashed.bucket(h, buckets)))

    total = summed("hp", summed("hw", F.lit(0.0)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    features = F.size("hw") + F.size("hp")
    scored = counted.withColumn("base_failed", failed).withColumn(
        "score", F.when(features > 0, F.round(total / features, 9))
    )
    kept = ~F.col("base_failed") & F.coalesce(F.col("score") >= threshold, F.lit(False))
    # Written down: a filter or a column that a caller puts on top would be drawn into the counting,
    # which then is done once per word.
    return written(scored.withColumn("kept", kept).drop("hw", "hp", "weights"), "judged")
