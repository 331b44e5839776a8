"""Keyed joins that hold up when one key carries a large share of the rows.

Three measures, cheapest first:

* counts per key are taken before the join, so a hot key is one row by the time it is
  shuffled (`orphan_count`, `fk_violation_count`, the analysis plans);
* rows with a NULL key can never find a partner, so an anti or outer join lets them
  past it instead of sending them all to one task;
* where whole rows must travel, `hot_keys` names the heavy keys and `join_on_key`
  spreads their rows over a salt, repeating only the matching right-hand rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SALT = "_salt"


def _as_list(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


_WHOLE = ("tinyint", "smallint", "int", "bigint")
_FLOATS = ("float", "double")
#: Right rows of a hot key are repeated this many times at most.
_MOST_SALTS = 64


def _key_hash(df: DataFrame, keys: Sequence[str]) -> Column:
    """Equal keys hash alike: integers in one type, zeros without a sign."""
    types = dict(df.dtypes)

    def plain(k: str) -> Column:
        if types[k] in _WHOLE:
            return F.col(k).cast("bigint")
        return (F.col(k) + F.lit(0.0)).cast("string") if types[k] in _FLOATS else F.col(k).cast("string")

    return F.xxhash64(*map(plain, keys))


def _hash_alike(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> bool:
    """Whether equal keys of both sides have equal hashes, which other pairs of types need not."""
    a, b = dict(left.dtypes), dict(right.dtypes)
    return all(a[k] == b[k] or a[k] in _WHOLE and b[k] in _WHOLE for k in keys)


def _any_null(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])


def hot_keys(df: DataFrame, keys: str | Sequence[str], share: float = 0.01) -> list[int]:
    """Hashes of the keys that hold at least ``share`` of the rows, as far as a
    frequent-items sketch can tell.

    One pass over the key columns; every task sends a sketch of fixed size and the
    driver gets at most ``1 / share`` numbers. The list only steers the salting: a
    key missed or named in error changes where rows go, never the result.
    """
    keys = _as_list(keys)
    most = int(1 / share)
    found = (
        df.where(~_any_null(keys))
        .select(_key_hash(df, keys).alias("h"))
        .agg(
            F.expr(f"approx_top_k(h, {most}, {10 * most})").alias("top"),
            F.count("*").alias("n"),
        )
        .first()
    )
    return [t["item"] for t in found["top"] or [] if t["count"] >= share * found["n"]]


def is_hot(df: DataFrame, keys: str | Sequence[str], hot: Sequence[int]) -> Column:
    """Whether a row's key is one of `hot_keys`; not if it is NULL."""
    keys = _as_list(keys)
    return F.coalesce(_key_hash(df, keys).isin(*hot) & ~_any_null(keys), F.lit(False))


def _spread_join(
    left: DataFrame, right: DataFrame, keys: list[str], how: str, hot: Sequence[int]
) -> DataFrame:
    if not hot or not _hash_alike(left, right, keys):
        return left.join(right, keys, how)
    salts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = min(_MOST_SALTS, max(8, salts))
    left_hot, right_hot = (_key_hash(side, keys).isin(*hot) for side in (left, right))
    content = [F.col(n) for n, t in left.dtypes if "map<" not in t and "variant" not in t]
    origin = F.pmod(F.xxhash64(*content), F.lit(salts)).cast("int")
    every_salt = F.sequence(F.lit(0), F.lit(salts - 1))
    salted_left = left.withColumn(_SALT, F.when(left_hot, origin).otherwise(F.lit(0)))
    salted_right = right.withColumn(
        _SALT, F.explode(F.when(right_hot, every_salt).otherwise(F.array(F.lit(0))))
    )
    return salted_left.join(salted_right, [*keys, _SALT], how).drop(_SALT)


def join_on_key(
    left: DataFrame,
    right: DataFrame,
    keys: str | Sequence[str],
    how: str = "inner",
    hot: Sequence[int] = (),
) -> DataFrame:
    """Inner, left or left-anti equi-join keeping one copy of the key.

    ``hot`` comes from `hot_keys(left, keys)`. Left rows of a hot key are spread by
    their content, which a retried task reproduces, wherever they come from; the right
    rows of these keys are repeated once per salt. Keys whose types differ by more than
    the width of integers are joined without salt.
    """
    keys = _as_list(keys)
    if how == "inner":
        return _spread_join(left, right, keys, how, hot)
    if how not in ("left", "left_anti"):
        raise ValueError(f"join_on_key does not support how={how!r}")
    # NULL keys would all meet in one task to find nothing.
    unmatched = left.where(_any_null(keys))
    joined = _spread_join(left.where(~_any_null(keys)), right, keys, how, hot)
    return joined.unionByName(unmatched, allowMissingColumns=True)


def _renamed_keys(parent: DataFrame, key: Sequence[str], parent_key: Sequence[str]) -> DataFrame:
    return parent.select(*[F.col(p).alias(k) for k, p in zip(key, parent_key, strict=True)])


def anti_join_orphans(
    child: DataFrame,
    parent: DataFrame,
    key: str | Sequence[str],
    parent_key: str | Sequence[str] | None = None,
    hot: Sequence[int] = (),
) -> DataFrame:
    """Child rows without a parent. A NULL key counts as an orphan."""
    key = _as_list(key)
    names = _renamed_keys(parent, key, _as_list(parent_key or key))
    return join_on_key(child, names, key, "left_anti", hot)


def fk_violations(
    child: DataFrame,
    parent: DataFrame,
    key: str | Sequence[str],
    parent_key: str | Sequence[str] | None = None,
    hot: Sequence[int] = (),
) -> DataFrame:
    """Child rows whose key is filled in and has no parent. A NULL key is legal."""
    key = _as_list(key)
    names = _renamed_keys(parent, key, _as_list(parent_key or key))
    return _spread_join(child.where(~_any_null(key)), names, key, "left_anti", hot)


def orphan_count(
    child: DataFrame,
    parent: DataFrame,
    key: str | Sequence[str],
    parent_key: str | Sequence[str] | None = None,
) -> DataFrame:
    """One row, one column ``violations``: how many child rows have no parent.

    Rows are counted per key first, so the anti join sees each key once."""
    key = _as_list(key)
    names = _renamed_keys(parent, key, _as_list(parent_key or key))
    per_key = child.groupBy(*key).agg(F.count("*").alias("n"))
    return per_key.join(names, key, "left_anti").agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("violations")
    )


def fk_violation_count(
    child: DataFrame,
    parent: DataFrame,
    key: str | Sequence[str],
    parent_key: str | Sequence[str] | None = None,
) -> DataFrame:
    """As `orphan_count`, leaving out NULL keys."""
    key = _as_list(key)
    return orphan_count(child.where(~_any_null(key)), parent, key, parent_key)
