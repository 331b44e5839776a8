"""Looking at raw text before deciding on types. Each profile is one aggregate; `profile_columns` makes
several of them, for many columns, from one scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.typing import to_whole
from ledgerlake.operators.quality import rows_from

# What counts as a whole and as a decimal number in source text.
WHOLE_NUMBER = r"^\d+$"
DECIMAL_NUMBER = r"^\d+(\.\d+)?$"


def _misfit(column: str, pattern: str, blank_allowed: bool) -> Column:
    misfit = ~F.col(column).rlike(pattern)
    return misfit & (F.col(column) != "") if blank_allowed else misfit


def uncastable_rows(
    df: DataFrame, patterns: Mapping[str, str], blank_allowed: bool = False
) -> DataFrame:
    """Rows in which at least one column does not look like its pattern. NULL fits."""
    found = F.lit(False)
    for column, pattern in patterns.items():
        found = found | F.coalesce(_misfit(column, pattern, blank_allowed), F.lit(False))
    return df.where(found)


def profile_castability(
    df: DataFrame, patterns: Mapping[str, str], blank_allowed: bool = False
) -> DataFrame:
    """``column_name``, ``misfits``: how many values would not cast, per column."""
    counted = df.agg(
        *[F.count_if(_misfit(c, p, blank_allowed)).alias(c) for c, p in patterns.items()]
    )
    return rows_from(counted, ("column_name", "misfits"), [(c, F.col(c)) for c in patterns])


def profile_fill_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``total`` rows and, per column, how many values are neither NULL nor empty."""
    return df.agg(
        F.count("*").alias("total"),
        *[F.count(F.nullif(F.col(c), F.lit(""))).alias(f"{c}_filled") for c in columns],
    )


def profile_distinct(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns).distinct()


def profile_length_histogram(df: DataFrame, column: str) -> DataFrame:
    """Text length and how often it occurs; odd lengths give odd formats away."""
    return df.groupBy(F.length(column).alias("text_length")).agg(F.count("*").alias("occurrences"))


def profile_min_max(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Smallest and largest whole number per column of text; blanks are left out."""
    values = {c: to_whole(F.nullif(F.col(c), F.lit("")), "bigint") for c in columns}
    low = [F.min(v).alias(f"min_{c}") for c, v in values.items()]
    high = [F.max(v).alias(f"max_{c}") for c, v in values.items()]
    return df.agg(*low, *high)


def profile_date_gap(df: DataFrame, start: str, end: str) -> DataFrame:
    """Days from ``start`` to ``end`` and how often each gap occurs."""
    gap = F.datediff(F.col(end), F.col(start))
    return df.groupBy(gap.alias("gap_days")).agg(F.count("*").alias("occurrences"))


#: Registers of a distinct-count sketch, as a power of two. The estimate's standard error is
#: 0.83 / sqrt(2 ** LG_K), 1.3 % here, and a sketch takes about 2 KB.
LG_K = 12


def column_lengths(df: DataFrame, columns: Sequence[str], exact: bool = True, lg_k: int = LG_K) -> DataFrame:
    """One row per column and length of text (NULL for NULL values): ``column_name``, ``text_length``,
    ``occurrences``, ``distinct_values``, ``sketch``, ``smallest`` and ``largest`` whole number.

    All columns are read by one scan. With ``exact``, equal values are folded in each task and
    counted by value, so a frequent value is one row per task in the shuffle; without it, only lengths
    and sketches move and ``distinct_values`` is NULL. Rows of several tables or batches can be put
    together by `combined`, then without exact counts."""
    named = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns]
    values = df.select(F.explode(F.array(*named)).alias("v")).select("v.*")
    length = F.length("value").alias("text_length")
    number = to_whole(F.nullif(F.col("value"), F.lit("")), "bigint")
    least, most = F.min(number).alias("smallest"), F.max(number).alias("largest")
    # A sketch leaves out empty text, so every value gets a sign in front.
    sketch = F.hll_sketch_agg(F.concat(F.lit("="), "value"), lg_k).alias("sketch")
    if not exact:
        counts = [F.count("*").alias("occurrences"), F.lit(None).cast("bigint").alias("distinct_values")]
        return values.groupBy("column_name", length).agg(*counts, sketch, least, most)
    different = values.groupBy("column_name", "value").agg(F.count("*").alias("n"))
    counts = [F.sum("n").alias("occurrences"), F.count("value").alias("distinct_values")]
    return different.groupBy("column_name", length).agg(*counts, sketch, least, most)


def combined(lengths: DataFrame) -> DataFrame:
    """One row per column of rows of `column_lengths`: ``total`` values, ``filled`` ones (neither NULL nor
    empty), ``distinct_values`` (NULL if they were not counted), ``distinct_estimate``, ``smallest``
    and ``largest`` whole number, and ``lengths``, an array of each text length and how often it occurs.

    NULL is not a distinct value, empty text is one. Rows of several tables give the estimate of
    the whole; their exact counts add up only where their values differ."""
    per_length = lengths.groupBy("column_name", "text_length").agg(
        F.sum("occurrences").alias("occurrences"),
        F.sum("distinct_values").alias("distinct_values"),
        F.hll_union_agg("sketch").alias("sketch"),
        F.min("smallest").alias("smallest"),
        F.max("largest").alias("largest"),
    )
    each = F.struct("text_length", "occurrences")
    found = F.collect_list(F.when(F.col("text_length").isNotNull(), each))
    return per_length.groupBy("column_name").agg(
        F.sum("occurrences").alias("total"),
        F.coalesce(F.sum(F.when(F.col("text_length") > 0, F.col("occurrences"))), F.lit(0)).alias("filled"),
        F.sum("distinct_values").alias("distinct_values"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_estimate"),
        F.min("smallest").alias("smallest"),
        F.max("largest").alias("largest"),
        F.sort_array(found).alias("lengths"),
    )


def profile_columns(df: DataFrame, columns: Sequence[str], exact: bool = True, lg_k: int = LG_K) -> DataFrame:
    """Fill counts, distinct counts beside their estimates, ranges of whole numbers and lengths of text of
    many columns from one scan; the columns are those of `combined`. An empty table has no rows."""
    return combined(column_lengths(df, columns, exact, lg_k))
