"""One run through all layers, as plain functions in dependency order."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.contracts import TableContract, sales_contracts
from ledgerlake.functions.enrich import CATEGORY_RULES, Rule
from ledgerlake.operators.batches import add_audit_columns
from ledgerlake.operators.joins import hot_keys
from ledgerlake.operators.quality import dq_gate, enforce_contract, raise_on_fail
from ledgerlake.plans import analysis, publish, store, validation
from ledgerlake.sources.csv import csv_scan_raw
from ledgerlake.sources.files import (
    MANIFEST,
    changed_files,
    file_fingerprint,
    list_files,
    manifest_upsert,
    require_sources,
)
from ledgerlake.sources.tables import BatchTable, BucketSummary, KeyedTable, VersionedTable, counted

log = logging.getLogger(__name__)

# Source entities and the raw table each one fills.
ENTITIES = {
    "products": "raw_product_master",
    "sales_order_header": "raw_sales_order_header",
    "sales_order_detail": "raw_sales_order_detail",
}


@dataclass
class Lake:
    """Where the layers are, and how their keyed tables are cut."""

    spark: SparkSession
    root: str
    id_type: str = "int"
    buckets: int = 16
    rows_per_bucket: int | None = None
    rules: Sequence[Rule] = CATEGORY_RULES
    contracts: dict[str, TableContract] = field(init=False)

    def __post_init__(self):
        self.contracts = sales_contracts(self.id_type)

    def keyed(self, name: str) -> KeyedTable:
        return KeyedTable(
            self.spark, f"{self.root}/{name}", self.contracts[name].key, self.buckets, self.rows_per_bucket
        )

    def rebuilt(self, name: str) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.root}/{name}")

    @property
    def manifest(self) -> VersionedTable:
        """One row per source file, so small enough to be written anew at each load."""
        return self.rebuilt("raw_file_metadata")

    def manifest_rows(self) -> DataFrame:
        return self.manifest.read(empty=MANIFEST)

    def raw(self, name: str) -> BatchTable:
        return BatchTable(self.spark, f"{self.root}/{name}")


def batch_id_of(batch_ts: str) -> str:
    """A directory name that sorts as the timestamp does."""
    return "b" + "".join(c for c in batch_ts if c.isdigit())


def ingest(
    lake: Lake, entity: str, folder: str, batch_ts: str, expected: Sequence[str] = ()
) -> int:
    """Take in the new and changed CSV files of an entity; the number of files loaded.

    It is an error if a file named in ``expected`` is not there or, without such names,
    if no file is. An empty file is recorded and brings no rows.
    The manifest is written last: a run that dies before it repeats the load, and a
    load under the same timestamp replaces its own batch."""
    spark, table = lake.spark, ENTITIES[entity]
    name = F.element_at(F.split("file_path", "/"), -1)
    keyed = file_fingerprint(spark, folder, "*.csv").withColumns(
        {"file_name": name, "file_key": F.concat(F.lit(f"{entity}/"), name)}
    )
    columns = [
        "file_key", "file_name", "file_path", "file_hash", "file_size_bytes", "last_modified_at",
    ]
    # Hashed once and written down: what goes into the manifest is what was compared,
    # and only the names of the changed files come to the driver, for the reader.
    manifest, batch_id = lake.manifest_rows(), batch_id_of(batch_ts)
    seen = f"{lake.root}/seen/{entity}/{batch_id}"
    keyed.select(*columns).write.mode("overwrite").parquet(seen)
    there = spark.read.parquet(seen)
    if expected:
        named = spark.createDataFrame([(n,) for n in expected], "file_name string")
        require_sources(named, there, "file_name")
    elif there.isEmpty():
        raise FileNotFoundError(f"source files not found: {entity}")
    loaded = changed_files(there, manifest).select(*columns)
    sizes = {r["file_path"]: r["file_size_bytes"] for r in loaded.collect()}
    if not sizes:
        return 0

    if paths := [p for p, size in sizes.items() if size]:
        rows = csv_scan_raw(spark, paths)
        stamped = add_audit_columns(rows, batch_ts, F.col("source_file_name"))
        lake.raw(table).append(stamped, batch_id)

    now = list_files(spark, folder, "*.csv").select(
        "file_path", F.col("file_size_bytes").alias("_size"), F.col("last_modified_at").alias("_at")
    )
    same = F.col("file_size_bytes").eqNullSafe(F.col("_size")) & F.col(
        "last_modified_at"
    ).eqNullSafe(F.col("_at"))
    moved = loaded.join(now, "file_path", "left").where(~same).limit(1).collect()
    if moved:
        raise RuntimeError(f"{moved[0]['file_path']} changed while it was being loaded")

    lake.manifest.replace(manifest_upsert(manifest, loaded, batch_ts))
    return len(sizes)


def load(
    lake: Lake,
    name: str,
    rows: DataFrame,
    parents: Mapping[str, KeyedTable] | None = None,
    consumed: Sequence[tuple[str, str]] = (),
):
    """Merge rows into table ``name`` if they keep its contract; otherwise nothing changes.

    Of a parent table, only the buckets that the batch's foreign keys fall into are read."""

    def check(batch: DataFrame) -> None:
        contract = lake.contracts[name]
        held = {}
        for fk in contract.foreign_keys:
            filled = batch.where(F.col(fk.column).isNotNull())
            held[fk.parent] = parents[fk.parent].holding(filled.select(F.col(fk.column).alias(fk.parent_column)))
        raise_on_fail(enforce_contract(batch, contract, held))

    return lake.keyed(name).merge(rows, check, consumed)


NOTHING = {"rows": 0, "touched_buckets": 0}


def gate(lake: Lake, name: str) -> None:
    """Stop the run if a stored table has a bad key or is empty. Looks at the buckets that
    the last merge wrote; the others were looked at after the merge that wrote them."""
    table = lake.keyed(name)
    rows = table.rewritten()
    if rows is not None:
        raise_on_fail(dq_gate(rows, table.key, name))
    elif table.read().isEmpty():
        raise ValueError(f"{name}: row_count = 0")


def _load_store(lake: Lake, raw_name: str, name: str, build, batch_ts: str, parents=None):
    """Take in every raw batch that table ``name`` has not: the newest row of each key.

    A batch that was refused, or whose run died, stays due until a version has it; one that
    can never be taken in has to be withdrawn (`BatchTable.withdraw`)."""
    raw, seen = lake.raw(raw_name), lake.keyed(name).consumed(raw_name)
    entries = raw.entries()
    if not entries:
        raise FileNotFoundError(f"no batch at {raw.root}")
    due = [e for e in entries if e not in seen]
    if not due:
        return NOTHING
    rows, seen = counted(raw.load(due))
    stored = build(rows, lake.contracts[name], batch_ts)
    report = load(lake, name, stored, parents, [(raw_name, e) for e in due])
    if dropped := seen.get["rows"] - report["rows"]:
        log.warning("%s: %d rows dropped for their keys came again", name, dropped)
    return {**report, "rows_dropped": dropped}


def load_store_product(lake: Lake, batch_ts: str):
    return _load_store(
        lake, "raw_product_master", "store_product_master", store.store_product, batch_ts
    )


def load_store_header(lake: Lake, batch_ts: str):
    return _load_store(
        lake, "raw_sales_order_header", "store_sales_order_header", store.store_header, batch_ts
    )


def load_store_detail(lake: Lake, batch_ts: str):
    """Needs the products and headers of the run in place, for its foreign keys."""
    parents = {p: lake.keyed(p) for p in ("store_sales_order_header", "store_product_master")}
    return _load_store(
        lake,
        "raw_sales_order_detail",
        "store_sales_order_detail",
        store.store_detail,
        batch_ts,
        parents,
    )


def _due_versions(lake: Lake, source: str, name: str) -> list[int]:
    """Versions of ``source`` whose rows table ``name`` has not taken in."""
    seen = lake.keyed(name).consumed(source)
    return [v for v in lake.keyed(source).versions() if str(v) not in seen]


def load_publish_product(lake: Lake, batch_ts: str):
    source, name = "store_product_master", "publish_product"
    due = _due_versions(lake, source, name)
    if not due:
        return NOTHING
    rows = publish.publish_product(lake.keyed(source).changed_in(due), batch_ts, lake.rules)
    return load(lake, name, rows, consumed=[(source, str(v)) for v in due])


def load_publish_orders(lake: Lake, batch_ts: str):
    """The detail rows that are not published yet, with all headers. A header that comes
    again without its lines leaves their published rows as they were."""
    source, name = "store_sales_order_detail", "publish_orders"
    due = _due_versions(lake, source, name)
    if not due:
        return NOTHING
    detail = lake.keyed(source).changed_in(due)
    header = lake.keyed("store_sales_order_header").read()
    hot = hot_keys(detail, "sales_order_id")
    rows = publish.publish_orders(detail, header, batch_ts, hot)
    return load(lake, name, rows, consumed=[(source, str(v)) for v in due])


def line_sums(lake: Lake) -> BucketSummary:
    """Sums per product and year of each bucket of the published lines."""
    return BucketSummary(lake.keyed("publish_orders"), f"{lake.root}/analysis_line_sums", analysis.line_sums)


def load_analysis(lake: Lake) -> None:
    """Both answers, from sums of which only those of changed buckets are made anew."""
    sums, products = line_sums(lake).refresh(), lake.keyed("publish_product").read()
    lake.rebuilt("analysis_revenue_by_color_year").replace(analysis.top_color_of(sums, products))
    lead = analysis.lead_time_of(sums, products).drop("order_lines")
    lake.rebuilt("analysis_avg_lead_time_by_category").replace(lead)


def all_tables(lake: Lake) -> dict[str, DataFrame]:
    return {
        **{n: lake.raw(n).read() for n in validation.RAW},
        **{n: lake.keyed(n).read() for n in validation.KEYED},
        **{n: lake.rebuilt(n).read() for n in validation.ANALYSIS},
    }


def run_all(
    lake: Lake,
    folders: Mapping[str, str],
    batch_ts: str,
    expected_returns: int = 2,
    expected_files: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Every layer in order; the validation report. ``folders`` maps entities to where
    their CSV files are, ``expected_files`` to the names that must be there. An unchanged
    file is not loaded again; later steps take in whatever they have not yet."""
    for entity in ENTITIES:
        ingest(lake, entity, folders[entity], batch_ts, (expected_files or {}).get(entity, ()))
    load_store_product(lake, batch_ts)
    gate(lake, "store_product_master")
    load_publish_product(lake, batch_ts)
    load_store_header(lake, batch_ts)
    gate(lake, "store_sales_order_header")
    load_store_detail(lake, batch_ts)
    gate(lake, "store_sales_order_detail")
    load_publish_orders(lake, batch_ts)
    load_analysis(lake)
    report = validation.validation_report(all_tables(lake), expected_returns)
    validation.assert_no_critical(report)
    return report
