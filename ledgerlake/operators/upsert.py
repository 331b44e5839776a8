"""Merge by key, as a DataFrame expression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def untouched(target: DataFrame, source: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Target rows whose key is not in ``source``: what a merge keeps as it is."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    typed = source.select(*[F.col(k).cast(target.schema[k].dataType).alias(k) for k in keys])
    return target.join(typed, keys, "left_anti").select(*target.columns)


def upsert_by_key(target: DataFrame, source: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Target rows whose key is not in ``source``, plus the rows of ``source``.

    The result has the target's columns and types. A key in both takes every column that the source
    has, NULLs included, and keeps the others; a new key has NULL there. A column that the target does
    not know is refused. ``source`` must hold each key once; `KeyedTable.merge` checks that before it
    writes.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    unknown = [c for c in source.columns if c not in target.columns]
    if unknown:
        raise ValueError(f"columns unknown to the target: {', '.join(unknown)}")
    absent = [c for c in target.columns if c not in source.columns]
    typed = source.select(*[F.col(c).cast(target.schema[c].dataType).alias(c) for c in source.columns])
    kept = untouched(target, source, keys)
    if absent:
        typed = typed.join(target.select(*keys, *absent), keys, "left")
    return kept.unionByName(typed.select(*target.columns))
