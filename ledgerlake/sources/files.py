"""Sets of source files: fingerprints, what changed, what is missing, the manifest.

Folders are listed by tasks, level by level, and what they find is a written table: neither the paths
nor the names of the files come to the driver."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from fnmatch import fnmatchcase
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerlake.sources.scratch import new_folder

_CHUNK = 1 << 20
#: Bytes that a task hashes, about.
_SHARE = 256 << 20

LISTED = "file_path string, file_size_bytes bigint, last_modified_at timestamp"
FINGERPRINT = f"{LISTED}, file_hash string"

# Schemes of Hadoop's connectors for which Arrow has another name.
ARROW_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def arrow_address(path: str) -> tuple[str, str]:
    """The address of the store that Arrow opens for a path, and the path inside it. A local path has
    no address."""
    scheme, mark, rest = path.partition("://")
    if not mark or scheme == "file":
        return "", "/" + path.removeprefix("file:").lstrip("/")
    store, _, inside = rest.partition("/")
    return f"{ARROW_SCHEMES.get(scheme, scheme)}://{store}/", f"/{inside}"


def open_store(path: str):
    """Arrow's file system for a path, and the path's name in it. The names are not read as URLs, so
    any character may occur in them."""
    from pyarrow import fs

    address, inside = arrow_address(path)
    if not address:
        return fs.LocalFileSystem(), inside
    filesystem, root = fs.FileSystem.from_uri(address)
    return filesystem, root.rstrip("/") + inside


def _md5_of(path: str, opener: Callable) -> str:
    filesystem, name = opener(path)
    digest = hashlib.md5()
    with filesystem.open_input_stream(name) as stream:
        while chunk := stream.read(_CHUNK):
            digest.update(chunk)
    return digest.hexdigest()


def _written_as_scans_do(path: str) -> str:
    address, inside = arrow_address(path.rstrip("/"))
    return path.rstrip("/") if address else f"file:{inside}"


def _content(folder: str, pattern: str, opener: Callable) -> pd.DataFrame:
    """Files and folders right below a folder."""
    from pyarrow import fs

    filesystem, name = opener(folder)
    rows = []
    for info in filesystem.get_file_info(fs.FileSelector(name)):
        own, inner = info.base_name, info.type == fs.FileType.Directory
        if own.startswith((".", "_")) or not ("=" in own if inner else fnmatchcase(own, pattern)):
            continue
        # To the millisecond, as a scan has it.
        at = None if inner or info.mtime is None else pd.Timestamp(info.mtime).floor("ms").tz_convert(None)
        rows.append((f"{folder}/{own}", None if inner else info.size, at))
    found = pd.DataFrame(rows, columns=["file_path", "file_size_bytes", "last_modified_at"])
    return found.astype({"file_size_bytes": "Int64", "last_modified_at": "datetime64[ns]"})


def list_files(
    spark: SparkSession, path: str, pattern: str = "*", opener: Callable = open_store
) -> DataFrame:
    """Path, size and modification time of the files, empty ones too; contents are not read.

    As in a scan, folders named ``key=value`` are entered, and names that start with ``_`` or ``.``
    are left out. Each level of folders is listed by one job, a task for some of its folders, and
    written down. ``opener`` makes Arrow's file system of a path, for stores that need
    credentials of their own."""
    from pyarrow import fs

    root = _written_as_scans_do(path)
    filesystem, name = opener(root)
    if filesystem.get_file_info(name).type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    # Times are stored without a zone: tasks and the session need not agree on one.
    schema = LISTED.replace("timestamp", "timestamp_ntz")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for folders in batches:
            for folder in folders["file_path"]:
                yield _content(folder, pattern, opener)

    levels, folders = [], spark.createDataFrame([(root,)], "file_path string")
    while True:
        level, seen = new_folder(spark, "listing"), Observation()
        below = folders.mapInPandas(run, schema)
        inner = F.count_if(F.col("file_size_bytes").isNull()).alias("folders")
        below.observe(seen, inner).write.parquet(level)
        levels.append(spark.read.schema(schema).parquet(level))
        if not seen.get["folders"]:
            break
        folders = levels[-1].where("file_size_bytes IS NULL").select("file_path")
        folders = folders.repartition(spark.sparkContext.defaultParallelism, "file_path")
    at = F.convert_timezone(F.lit("UTC"), F.current_timezone(), "last_modified_at").cast("timestamp")
    files = reduce(DataFrame.unionByName, levels).where("file_size_bytes IS NOT NULL")
    return files.withColumn("last_modified_at", at)


def file_fingerprint(
    spark: SparkSession, path: str, pattern: str = "*", opener: Callable = open_store
) -> DataFrame:
    """MD5 of the whole content, size and modification time of every file.

    Files are dealt out to as many tasks as their bytes ask for; a task reads each of its files in
    chunks, so memory does not grow with the file. MD5 is sequential, so one file is
    always one task's work."""
    files = list_files(spark, path, pattern, opener)
    held = files.agg(F.count("*").alias("n"), F.sum("file_size_bytes").alias("size")).first()
    wanted = max(spark.sparkContext.defaultParallelism, (held["size"] or 0) // _SHARE)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for found in batches:
            yield found.assign(file_hash=[_md5_of(p, opener) for p in found["file_path"]])

    tasks = max(1, min(held["n"], wanted))
    return files.repartition(tasks, "file_path").mapInPandas(run, FINGERPRINT)


def changed_files(fingerprints: DataFrame, manifest: DataFrame) -> DataFrame:
    """Fingerprints whose ``file_key`` is new or was last loaded with another hash.
    A manifest row without a hash counts as another hash."""
    known = manifest.select("file_key", F.col("file_hash").alias("_known"))
    return (
        fingerprints.join(known, "file_key", "left")
        .where(~F.col("file_hash").eqNullSafe(F.col("_known")))
        .drop("_known")
    )


def missing_sources(expected: DataFrame, discovered: DataFrame, key: str) -> DataFrame:
    """Expected sources that were not found."""
    return expected.join(discovered.select(key).distinct(), key, "left_anti")


def require_sources(expected: DataFrame, discovered: DataFrame, key: str, show: int = 20) -> None:
    """A missing source file is an error, not a reason to skip."""
    missing = missing_sources(expected, discovered, key).select(key)
    names = [r[0] for r in missing.orderBy(key).take(show)]
    if names:
        more = missing.count() - len(names)
        also = f" and {more} more" if more else ""
        raise FileNotFoundError("source files not found: " + ", ".join(map(str, names)) + also)


MANIFEST = (
    "file_key string, file_name string, file_path string, file_hash string, "
    "file_size_bytes bigint, last_modified_at timestamp, last_loaded_at timestamp, load_count int"
)


def manifest_upsert(manifest: DataFrame, loaded: DataFrame, loaded_at: str) -> DataFrame:
    """The manifest after ``loaded`` files were taken in.

    A new key starts at ``load_count`` 1. A known key takes hash, size and times and
    counts one up, and keeps its name and path. Other keys stay as they are."""
    old, new = manifest.alias("old"), loaded.alias("new")
    both = old.join(new, F.col("old.file_key") == F.col("new.file_key"), "full")
    is_loaded = F.col("new.file_key").isNotNull()

    def newest(name: str):
        return F.when(is_loaded, F.col(f"new.{name}")).otherwise(F.col(f"old.{name}")).alias(name)

    def first_seen(name: str):
        known = F.col("old.file_key").isNotNull()
        return F.when(known, F.col(f"old.{name}")).otherwise(F.col(f"new.{name}")).alias(name)

    count = F.coalesce(F.col("old.load_count"), F.lit(0)) + is_loaded.cast("int")
    stamp = F.when(is_loaded, F.lit(loaded_at).cast("timestamp"))
    return both.select(
        F.coalesce("new.file_key", "old.file_key").alias("file_key"),
        first_seen("file_name"),
        first_seen("file_path"),
        newest("file_hash"),
        newest("file_size_bytes"),
        newest("last_modified_at"),
        F.coalesce(stamp, F.col("old.last_loaded_at")).alias("last_loaded_at"),
        count.cast("int").alias("load_count"),
    )
