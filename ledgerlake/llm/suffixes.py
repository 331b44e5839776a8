"""Removal of every byte that a string of ``LENGTH`` bytes covers which also starts elsewhere.

Shards are cut by content. Every window of ``LENGTH`` bytes has a key, the smallest hash among its
k-grams; consecutive windows with one key form a run. Equal windows have equal keys, so they always
meet in one shard and nothing is compared across shards. Keys met once are done with. Runs that
are equal as a whole are settled by their hash; only the others travel as text, a few hundred bytes
each, to a shard, where a suffix array (Larsson-Sadakane refinement in numpy) finds the windows that
occur more than once. A key with too many different runs for one shard is settled window by window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.tables import written
from ledgerlake.llm.wordhash import mix

LENGTH = 200
GRAM = 24
#: Bytes of runs in one suffix array, and of all different runs of a key that go to one shard.
SHARD = 4 << 20
#: Windows of a text looked at in one go.
_SLICE = 1 << 20
_ROWS = 1 << 12
_BASE = 0x9E3779B97F4A7C15

RUN = "v long, x long, key long, size int, start int, n int, multi boolean"


def window_hashes(raw: np.ndarray, length: int) -> np.ndarray:
    """64-bit hash of the ``length`` bytes from each place on, put together from powers of two."""
    power = raw.astype(np.uint64) + np.uint64(1)
    size, covered, out = 1, 0, None
    while True:
        shift = np.uint64(pow(_BASE, size, 2**64))
        if length & size:
            count = len(raw) - covered - size + 1
            out = power if out is None else out[:count] * shift + power[covered : covered + count]
            covered += size
        size *= 2
        if size > length:
            return mix(out[: len(raw) - length + 1])
        power = power[: len(power) - size // 2] * shift + power[size // 2 :]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours, by running minima of blocks from both sides."""
    count = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])


def _runs(raw: np.ndarray, length: int, gram: int):
    """(key, first window, last window, key's k-gram occurs more than once) of each run."""
    width = length - gram + 1
    hashes = window_hashes(raw, gram)
    keys = sliding_min(hashes, width)
    turns = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    first = np.concatenate([[0], turns])
    last = np.concatenate([turns - 1, [len(keys) - 1]])
    multi = np.zeros(len(first), bool)
    steps = np.arange(width)
    for i in range(0, len(first), _ROWS):
        a, b = first[i : i + _ROWS], last[i : i + _ROWS]
        leftmost = a + hashes[a[:, None] + steps].argmin(axis=1)
        rightmost = b + width - 1 - hashes[b[:, None] + steps[::-1]].argmin(axis=1)
        multi[i : i + _ROWS] = leftmost != rightmost
    return keys[first], first, last, multi


def runs_of(data: bytes, length: int = LENGTH, gram: int = GRAM):
    """(key, hash of its bytes, first window, number of windows, multi) of each run of a text."""
    whole = np.frombuffer(data, np.uint8)
    for offset in range(0, max(0, len(data) - length + 1), _SLICE):
        part = whole[offset : offset + _SLICE + length - 1]
        keys, first, last, multi = _runs(part, length, gram)
        view = memoryview(data)[offset:]
        for v, a, b, m in zip(keys.view(np.int64).tolist(), first.tolist(), last.tolist(), multi.tolist(), strict=True):
            x = xxhash.xxh64_intdigest(view[a : b + length])
            yield v, x - (1 << 64) if x >> 63 else x, offset + a, b - a + 1, m


def _cut(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """The runs of all texts; ``docs`` has key, size and data."""

    def run(batches):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
        names = ["v", "x", "key", "size", "start", "n", "multi"]
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                out = [[] for _ in names]
                for key, size, data in zip(*(c.to_pylist() for c in batch.slice(i, 256).columns), strict=True):
                    for v, x, start, n, m in runs_of(data, length, gram):
                        for column, value in zip(out, (v, x, key, size, start, n, m), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    return docs.select("key", "size", "data").mapInArrow(run, RUN)


def repeated(strings: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each string, the places where ``length`` bytes start that also start at another place of
    these strings.

    Places are ranked by their first 8 bytes; while places share a rank, they are ranked anew by the
    rank of what follows, which doubles the bytes compared. Places alone in their rank are never
    looked at again. Equal ranks at both ends of a window mean equal windows."""
    text = np.frombuffer(b"".join(strings) + bytes(length + 8), np.uint8)
    size = len(text) - 8
    bounds = np.cumsum([0, *map(len, strings)])
    words = np.zeros(size, np.uint64)
    for i in range(8):
        words = words << np.uint64(8) | text[i : i + size]
    rank = np.zeros(size + 2 * length, np.int64)
    order = np.argsort(words, kind="stable")
    rank[order] = _group_starts(words[order])
    depth, step = 8, 8
    while depth < length:
        step = min(depth, length - depth)
        together = np.bincount(rank[:size], minlength=size)[rank[:size]] > 1
        open_places = np.flatnonzero(together)
        if not len(open_places):
            break
        key, after = rank[open_places], rank[open_places + step]
        order = np.lexsort((after, key))
        key, after, places = key[order], after[order], open_places[order]
        heads = np.concatenate([[True], (key[1:] != key[:-1]) | (after[1:] != after[:-1])])
        groups = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        first = np.maximum.accumulate(np.where(heads, np.arange(len(key)), 0))
        base = groups[np.searchsorted(groups, np.arange(len(key)), side="right") - 1]
        rank[places] = key + first - base
        depth += step
    ends = np.repeat(bounds[1:], np.diff(bounds))
    starts = np.flatnonzero(np.arange(bounds[-1]) + length <= ends)
    values, counts = np.unique(rank[starts], return_counts=True)
    twice = starts[counts[np.searchsorted(values, rank[starts])] > 1]
    cuts = np.searchsorted(twice, bounds)
    return [twice[cuts[i] : cuts[i + 1]] - bounds[i] for i in range(len(strings))]


def _group_starts(ordered: np.ndarray) -> np.ndarray:
    heads = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    return np.maximum.accumulate(np.where(heads, np.arange(len(ordered)), 0))


def _covered(places: np.ndarray, length: int) -> list[dict]:
    """Stretches that windows from ``places`` (in order) cover."""
    if not len(places):
        return []
    breaks = np.flatnonzero(np.diff(places) > length) + 1
    firsts = places[np.concatenate([[0], breaks])]
    lasts = places[np.concatenate([breaks - 1, [len(places) - 1]])]
    return [{"from": int(a), "to": int(b) + length} for a, b in zip(firsts, lasts, strict=True)]


SPANS = "array<struct<from:int,to:int>>"
_SPAN_ARROW = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))


def _by_suffix_array(runs: DataFrame, length: int) -> DataFrame:
    """(v, x, found) for runs (v, x, data); the runs of a key are in one partition, in order."""

    def flush(rows):
        marked = repeated([r[2] for r in rows], length)
        spans = [_covered(p, length) for p in marked]
        keep = [k for k, s in enumerate(spans) if s]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[k][0] for k in keep], pa.int64()),
                pa.array([rows[k][1] for k in keep], pa.int64()),
                pa.array([spans[k] for k in keep], _SPAN_ARROW),
            ],
            ["v", "x", "found"],
        )

    def run(batches):
        rows, held = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held >= SHARD and row[0] != rows[-1][0]:
                    yield flush(rows)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[2])
        if rows:
            yield flush(rows)

    ordered = runs.select("v", "x", "data").repartition("v").sortWithinPartitions("v", "x")
    return ordered.mapInArrow(run, f"v long, x long, found {SPANS}")


def _by_window(runs: DataFrame, length: int) -> DataFrame:
    """The same for keys with many runs: windows are grouped by their hash within the key, with one
    row per key and hash from each task."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                v, x, data = (c[i].as_py() for c in batch.columns)
                hashes = window_hashes(np.frombuffer(data, np.uint8), length)
                same = len(hashes)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(same, v)),
                        pa.array(np.full(same, x)),
                        pa.array(hashes.view(np.int64)),
                        pa.array(np.arange(same, dtype=np.int32)),
                    ],
                    ["v", "x", "h", "place"],
                )

    windows = written(runs.select("v", "x", "data").mapInArrow(run, "v long, x long, h long, place int"), "windows")
    twice = windows.groupBy("v", "h").agg(F.count("*").alias("c")).where("c > 1").select("v", "h")
    span = F.struct(F.col("place").alias("from"), (F.col("place") + length).cast("int").alias("to"))
    met = windows.join(twice, ["v", "h"], "left_semi").groupBy("v", "x")
    return met.agg(F.sort_array(F.collect_list(span)).alias("found")).select("v", "x", F.col("found").cast(SPANS))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, key, size, data. Equal texts have one key and one result, so the key is the text's."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    data = text.cast("binary")
    return docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), F.octet_length(data).alias("size"), data.alias("data")
    )


def spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """(key, size, spans): what is to be removed from the texts (key, size, data) that hold any."""
    runs = written(_cut(texts, length, gram), "runs")
    keys = runs.groupBy("v").agg(F.count("*").alias("total"), F.max("multi").alias("many"))
    runs = written(runs.join(keys.where("total > 1 OR many").select("v"), "v", "left_semi"), "met")
    groups = runs.groupBy("v", "x").agg(
        F.count("*").alias("c"),
        F.max("multi").alias("multi"),
        F.min(F.struct("key", "size", "start", "n")).alias("rep"),
    )
    groups = written(groups, "groups")
    per_key = groups.groupBy("v").agg(
        F.count("*").alias("m"),
        F.sum((F.col("c") == 1).cast("int")).alias("single"),
        F.max(F.col("multi") & (F.col("c") == 1)).alias("inner"),
        F.sum(F.col("rep.n") + length).alias("bytes"),
    )
    unsettled = per_key.where("(m > 1 AND single > 0) OR inner").select("v", "bytes")
    needed = groups.join(unsettled, "v").select("v", "x", "bytes", "rep.*")
    one = F.struct("v", "x", "bytes", "start", "n")
    per_text = needed.groupBy("key", "size").agg(F.collect_list(one).alias("needed"))
    given = texts.join(per_text, ["key", "size"])
    pieces = given.select("data", F.explode("needed").alias("r")).select(
        "r.v", "r.x", "r.bytes", F.expr(f"substring(data, r.start + 1, r.n + {length - 1})").alias("data")
    )
    pieces = written(pieces.dropDuplicates(["v", "x"]), "pieces")
    found = _by_suffix_array(pieces.where(F.col("bytes") <= shard), length).unionByName(
        _by_window(pieces.where(F.col("bytes") > shard), length)
    )
    found = written(found, "found")
    equal = groups.where("c > 1").select("v", "x", F.lit(None).cast(SPANS).alias("found"))
    partly = found.join(groups.where("c > 1"), ["v", "x"], "left_anti")
    marked = runs.join(equal.unionByName(partly), ["v", "x"])
    whole = F.array(F.struct(F.lit(0).alias("from"), (F.col("n") + length - 1).cast("int").alias("to")))
    shifted = F.transform(
        F.coalesce("found", whole),
        lambda s: F.struct((s["from"] + F.col("start")).alias("from"), (s["to"] + F.col("start")).alias("to")),
    )
    flat = marked.select("key", "size", F.explode_outer(shifted).alias("s")).distinct()
    return flat.groupBy("key", "size").agg(F.sort_array(F.collect_list("s")).alias("spans"))


def remaining(data: bytes, found: list | None) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, maximal stretches removed)."""
    kept, end, count, removed = [], 0, 0, 0
    for span in found or []:
        a, b = span["from"], span["to"]
        if a > end or not count:
            kept.append(data[end:a])
            removed += b - a
            count += 1
        else:
            removed += max(0, b - end)
        end = max(end, b)
    kept.append(data[end:])
    return b"".join(kept), removed, count


def without_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
    shard: int = SHARD,
) -> DataFrame:
    """Per row: ``id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (the bytes that are left).

    Texts are UTF-8 bytes, a NULL text is empty. Rows that repeat a text repeat its strings. What is
    left of a character that is cut through stays as it is, so ``kept`` is binary."""
    texts = _keyed(docs, id_col, text_col)
    found = written(spans(texts, length, gram, shard), "spans")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            done = [
                remaining(d.as_py(), s.as_py()) for d, s in zip(batch.column(1), batch.column(2), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(d) for d in batch.column(1).to_pylist()], pa.int64()),
                    pa.array([r for _, r, _ in done], pa.int64()),
                    pa.array([c for _, _, c in done], pa.int64()),
                    pa.array([k for k, _, _ in done], pa.binary()),
                ],
                ["id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    met = texts.join(found, ["key", "size"], "left").select("id", "data", "spans")
    return met.mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
