"""Best rows per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rank_top1_per_group(df: DataFrame, group: str | Sequence[str], by: str) -> DataFrame:
    """Rows with the highest ``by`` of their group; ties are all kept.

    A NULL ranks above every value, as it does in a database that sorts NULLs first on
    a descending order. The filter on the rank prunes each task's rows before the shuffle.
    """
    group = [group] if isinstance(group, str) else list(group)
    highest_first = Window.partitionBy(*group).orderBy(F.col(by).desc_nulls_first())
    return df.withColumn("_rank", F.rank().over(highest_first)).where("_rank = 1").drop("_rank")
