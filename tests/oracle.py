"""Compare a query with its SQL, cell by cell, whatever the order of the rows."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(table):
    names = sorted(table.column_names)
    rows = zip(*[table.column(n).to_pylist() for n in names], strict=True)
    return names, sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def differences(got, want) -> str | None:
    """``got`` and ``want`` are Arrow tables."""
    names, rows = _plain(got)
    want_names, want_rows = _plain(want)
    if names != want_names:
        return f"columns {names} and {want_names}"

    def kind(t):
        text = str(t).replace("large_", "").replace("[ns]", "[us]")
        return text.split(", tz")[0] + ("]" if ", tz" in text else "")

    for n in names:
        a, b = kind(got.schema.field(n).type), kind(want.schema.field(n).type)
        if a != b:
            return f"type of {n}: {a} and {b}"
    if len(rows) != len(want_rows):
        return f"{len(rows)} and {len(want_rows)} rows"
    for a, b in zip(rows, want_rows, strict=True):
        if a != b:
            return f"{a}\n{b}"
    return None
