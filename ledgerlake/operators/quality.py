"""Quality checks as small result frames, and the step that turns them into an error.

Every check on a table comes out of one scan and one shuffle on its key: rows and
rule hits are first counted per key, which folds a hot key into one row per task,
and then summed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.contracts import TableContract
from ledgerlake.operators.joins import fk_violation_count


def key_summary(
    df: DataFrame, keys: str | Sequence[str], rules: Mapping[str, Column] | None = None
) -> DataFrame:
    """One row: ``rows``, ``duplicate_keys``, ``null_keys`` and the number of rows that
    meet each of ``rules`` (a NULL condition does not count)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    rules = dict(rules or {})
    per_key = df.groupBy(*keys).agg(
        F.count("*").alias("_n"), *[F.count_if(c).alias(f"_{name}") for name, c in rules.items()]
    )
    key_is_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(c), F.lit(0)).cast("bigint")

    return per_key.agg(
        total(F.col("_n")).alias("rows"),
        F.count_if(F.col("_n") > 1).alias("duplicate_keys"),
        total(F.when(key_is_null, F.col("_n"))).alias("null_keys"),
        *[total(F.col(f"_{name}")).alias(name) for name in rules],
    )


def rows_from(one_row: DataFrame, columns: Sequence[str], rows: Sequence[Sequence]) -> DataFrame:
    """Lay a one-row summary out as several rows; cells are values or expressions."""
    cells = [
        F.struct(
            *[
                (c if isinstance(c, Column) else F.lit(c)).alias(name)
                for name, c in zip(columns, row, strict=True)
            ]
        )
        for row in rows
    ]
    return one_row.select(F.inline(F.array(*cells)))


def _verdict(failed: Column) -> Column:
    return F.when(failed, F.lit("fail")).otherwise(F.lit("pass"))


def dq_gate(df: DataFrame, keys: str | Sequence[str], table: str) -> DataFrame:
    """Three rows for a keyed table: no duplicate key, no NULL key, not empty."""
    measures = (
        ("duplicate_keys", F.col("duplicate_keys"), F.col("duplicate_keys") > 0),
        ("null_keys", F.col("null_keys"), F.col("null_keys") > 0),
        ("row_count", F.col("rows"), F.col("rows") == 0),
    )
    return rows_from(
        key_summary(df, keys),
        ("table_name", "check_name", "measure", "status"),
        [(table, name, measure, _verdict(failed)) for name, measure, failed in measures],
    )


def raise_on_fail(report: DataFrame) -> None:
    """Raise one error naming every failed check. A report has one row per check, so
    what reaches the driver is bounded by the number of checks."""
    failed = report.where("status = 'fail'").collect()
    if failed:
        lines = [f"{r['table_name']}: {r['check_name']} = {r['measure']}" for r in failed]
        raise ValueError("quality checks failed:\n" + "\n".join(sorted(lines)))


def capped_violations(rows: DataFrame, violated: Column, cap: int = 1000) -> int:
    """How many rows violate a rule, counted up to ``cap``.

    Tasks are started a few at a time and no more once ``cap`` is reached, so where violations are
    many, little is read. At most ``cap`` rows without content come to the driver. Where several rules
    look at one table, `key_summary` counts them all in one scan."""
    return len(rows.where(violated).select(F.lit(True)).take(cap))


def enforce_contract(
    df: DataFrame, contract: TableContract, parents: Mapping[str, DataFrame] | None = None
) -> DataFrame:
    """One row per rule of the contract with the number of violations: unique key,
    filled-in columns, text lengths, and foreign keys to ``parents``.

    Uniqueness counts surplus keys, as `dq_gate` does; `raise_on_fail` refuses the load."""
    rules: dict[str, tuple[str, Column]] = {}
    for f in contract.fields:
        if f.not_null and f.name not in contract.key:
            rules[f"null_{f.name}"] = (f"not null {f.name}", F.col(f.name).isNull())
        if f.max_length is not None:
            too_long = F.length(f.name) > f.max_length
            rules[f"long_{f.name}"] = (f"length {f.name}", too_long)
    summary = key_summary(df, contract.key, {k: c for k, (_, c) in rules.items()})
    key_text = ", ".join(contract.key)
    rows = [
        (f"unique {key_text}", F.col("duplicate_keys")),
        (f"not null {key_text}", F.col("null_keys")),
        *[(label, F.col(k)) for k, (label, _) in rules.items()],
    ]
    columns = ("table_name", "check_name", "measure", "status")
    report = rows_from(
        summary, columns, [(contract.name, label, m, _verdict(m > 0)) for label, m in rows]
    )
    for fk in contract.foreign_keys:
        missing = fk_violation_count(df, (parents or {})[fk.parent], fk.column, fk.parent_column)
        label = f"foreign key {fk.column}"
        measure = F.col("violations")
        row = [(contract.name, label, measure, _verdict(measure > 0))]
        report = report.unionByName(rows_from(missing, columns, row))
    return report
