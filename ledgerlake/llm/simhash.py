"""Near-duplicates by SimHash, found through deletion-variant signatures.

A fingerprint is cut into two halves. Two fingerprints that differ in at most two bits differ in at
most one bit in one of the halves, so they share that half with one bit taken out. Every fingerprint
is listed under its 64 halves with one bit out; an equality join finds the pairs, and all 64 bits
verify them. A list longer than ``PAIRED`` is not paired up: its members are listed again under
all 64 bits with two taken out. At most four fingerprints share such a key, and any two of them link.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.components import connected_components
from ledgerlake.llm.tables import written

SEED = 42
SHINGLE = 3
PAIRED = 128
_CHUNK = 1 << 16


def fingerprint(text: str | None) -> int:
    """64 bits as a signed integer; a bit is 1 if it is set in over half of the shingles' hashes.

    A-Z are lower-cased, words are cut at ASCII white space, shingles are three words, repeats
    included; a text of one or two words is one shingle, a text of none has fingerprint zero."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return 0
    width = min(SHINGLE, len(words))
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    total = len(words) - width + 1
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(SEED))
    ones = np.zeros(64, np.int64)
    for start in range(0, total, _CHUNK):
        part = np.fromiter(hashes, np.uint64, min(_CHUNK, total - start))
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    set_bits = np.packbits(2 * ones > total, bitorder="little")
    return int(set_bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``fp`` of every row."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            values = np.fromiter((fingerprint(t.as_py()) for t in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, fp long")


_HALF = "(shiftrightunsigned(fp, (j div 32) * 32) & 4294967295)"
_DIFFER = "bit_count(a.fp ^ b.fp) <= 2"


def _listed(prints: DataFrame) -> DataFrame:
    """Each fingerprint under its 64 halves with a bit out; ``j`` is that bit's place."""
    spread = prints.select("fp", F.explode(F.expr("sequence(0, 63)")).alias("j"))
    key = f"({_HALF} & ~shiftleft(1L, j % 32)) | shiftleft(cast(j as bigint), 32)"
    return spread.select("fp", F.expr(key).alias("key"))


def _pairs(lists: DataFrame) -> DataFrame:
    same = F.col("a.key") == F.col("b.key")
    return (
        lists.alias("a")
        .join(lists.alias("b"), same & F.expr("a.fp < b.fp") & F.expr(_DIFFER))
        .select(F.col("a.fp").alias("left"), F.col("b.fp").alias("right"))
    )


def _stars(lists: DataFrame) -> DataFrame:
    """Links of members of long lists, by keys of 62 bits."""
    place = F.shiftright("key", 32).cast("int")
    one = lists.select("fp", place.alias("p"))
    other = "transform(sequence(0, 31), x -> if(p < 32, x + 32, x))"
    across = one.select("fp", "p", F.explode(F.expr(other)).alias("q"))
    within = (
        one.where("p % 32 = 0")
        .select("fp", F.explode(F.expr(other)).alias("p"))
        .select("fp", "p", F.explode(F.expr("sequence(p, p - p % 32 + 31)")).alias("q"))
        .where("p < q")
    )
    keyed = across.unionByName(within).selectExpr(
        "fp",
        "least(p, q) AS p",
        "greatest(p, q) AS q",
        "fp & ~shiftleft(1L, p) & ~shiftleft(1L, q) AS rest",
    )
    met = keyed.groupBy("p", "q", "rest").agg(F.collect_set("fp").alias("met"))
    return met.where("size(met) > 1").selectExpr(
        "array_min(met) AS left", "explode(array_remove(met, array_min(met))) AS right"
    )


def links(prints: DataFrame, paired: int = PAIRED) -> DataFrame:
    """Links that join every two distinct fingerprints (column ``fp``) at two or fewer differing
    bits, directly or through others at that distance."""
    together = F.count("*").over(Window.partitionBy("key"))
    lists = _listed(prints).withColumn("n", together).where("n > 1")
    lists = written(lists, "lists")
    return _pairs(lists.where(F.col("n") <= paired)).unionByName(
        _stars(lists.where(F.col("n") > paired))
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``fingerprint`` (16 hex digits), ``component_id`` (smallest id reachable) per row.

    Copies are put together before anything is joined, so a group of equal fingerprints is one row
    in the search. A NULL or empty text has fingerprint zero. A row without an id takes part in
    linking; its component is the smallest id there, NULL if there is none. Repeated rows stay."""
    signed = written(fingerprints(docs, id_col, text_col), "fingerprints")
    prints = written(signed.groupBy("fp").agg(F.min("id").alias("first_id")), "prints")
    roots = connected_components(links(prints), "left", "right")
    rooted = prints.join(roots, prints.fp == roots.node, "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = written(rooted.join(smallest, "root").select("fp", "component_id"), "components")
    return signed.join(named, "fp").select(
        "id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
    """The documents whose id is their component's smallest.

    Rows that repeat an id count as one document: the least row stays, and none if one of them is
    a copy of a document with a smaller id. Rows without an id stay, equal texts among them once."""
    found = near_duplicates(docs, id_col, text_col)
    copies = found.where("component_id <> id").select(F.col("id").alias(id_col)).distinct()
    kept = docs.join(copies, id_col, "left_anti")
    unnamed = F.when(F.col(id_col).isNull(), F.md5(F.col(text_col).cast("binary")))
    rows = kept.select(F.col(id_col).alias("k"), unnamed.alias("t"), F.struct(*docs.columns).alias("r"))
    return rows.groupBy("k", "t").agg(F.min("r").alias("r")).select("r.*")
