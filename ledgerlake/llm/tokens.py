"""Token ids in ORC files.

Documents are put in ascending order of their ids and encoded, and each range of ids becomes a shard:
an ORC file whose stripes hold the token ids in ORC's run-length encoding of integers, with row
indexes over every column and a Bloom filter over the document ids. A row knows how many ids stand
before it in its shard, and a small table knows how many stand before each shard: so any stripe can
be read by itself, and every document still knows its place in the whole sequence.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlake.llm.wordhash import together

VOCABULARY = "byte_bpe_50k.json"
#: Closes every document.
END = 2
#: Bytes of text of a shard, and the number of shards that is never passed: beyond it they grow.
SHARD, MOST_SHARDS = 32 << 20, 1 << 16
STRIPE, INDEX_ROWS = 8 << 20, 1000
#: Parts of texts whose ids a process remembers; characters cut into parts at a time; words per text
#: that is made of words.
_KNOWN, _STEP, _LINES = 1_000_000, 1 << 22, 100
#: Ids that go with them at most, per part.
_KNOWN_IDS = 16
#: Bytes of rows that go to a Python process at a time, and the setting that says so.
_BATCH, _BATCH_BYTES = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: Of this kind are the vocabularies whose texts may be cut before a blank, see `Encoder`.
_CUTTABLE = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
_BLANK = re.compile(r" (?<=\S )")
#: How such a vocabulary writes a blank.
_BLANK_BYTE = "\u0120"
#: Latin letters, a sign, and the rest. An apostrophe may go with letters; what else may is left whole.
_WORD = r"(?s)^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<signs>[!\"#$%&()*+,\-./:;<=>?].*)$"
#: A blank that does not cut: at the start, or next to what `str.isspace` knows, or at the end.
_NO_CUT = r"(?s)(?:^|[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]) | $"


def vocabulary_file(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Runs:
    """Runs of ids, by number."""

    def __init__(self, ids: np.ndarray | None = None, sizes: np.ndarray | None = None):
        self.clear()
        if ids is not None:
            self.ids, self.ends = ids, np.concatenate([self.ends, np.cumsum(sizes, dtype=np.int64)])

    def __len__(self) -> int:
        return len(self.ends) - 1

    def clear(self) -> None:
        #: ``ends`` begins with zero, so a run goes from its own to the next.
        self.ids, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def with_more(self, more: _Runs) -> _Runs:
        out = _Runs()
        out.ids = np.concatenate([self.ids, more.ids])
        out.ends = np.concatenate([self.ends, self.ends[-1] + more.ends[1:]])
        return out

    def add(self, more: _Runs) -> None:
        both = self.with_more(more)
        self.ids, self.ends = both.ids, both.ends

    def at(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the runs of these numbers one after the other, number of ids of each)"""
        starts = self.ends[places]
        n = self.ends[places + 1] - starts
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        # Half the memory to go through, where places of ids can be counted so.
        kind = np.int32 if max(total, len(self.ids)) < 1 << 31 else np.int64
        found = np.repeat((starts - ends + n).astype(kind), n)
        found += np.arange(total, dtype=kind)
        return self.ids[found], n


class Encoder:
    """Ids of whole texts. A byte-level vocabulary has no token that goes on from another character
    into white space, or from a letter into a sign, so a text is cut there; each different part is
    encoded once, as long as it is remembered."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_str(definition)
        parts = json.loads(definition)
        kind = parts.get("pre_tokenizer") or {}
        self.cuttable = (
            not parts.get("normalizer")
            and not parts.get("post_processor")
            and all(kind.get(k) == v for k, v in _CUTTABLE.items())
            and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] for t in parts["added_tokens"])
        )
        #: Numbers of runs of remembered ids: of parts that follow a blank, blank included, and of signs after letters.
        self.known: dict[str, int] = {}
        self.signs: dict[str, int] = {}
        self.known_ids, self.signs_ids = _Runs(), _Runs()
        #: Which ids begin with a blank.
        ids = self.library.get_vocab(with_added_tokens=False)
        self.blank = np.zeros(max(self.library.get_vocab().values(), default=0) + 1, bool)
        self.blank[np.array([i for token, i in ids.items() if token.startswith(_BLANK_BYTE)], np.int64)] = True

    def _encoded(self, texts: list[str]) -> _Runs:
        found = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return _Runs(np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64))

    def _words(self, words: list[str]) -> _Runs:
        """Ids of words after a blank. Those of letters alone are encoded many at a time: a blank before
        a letter begins a token, and no other byte of a word is a blank."""
        letters = np.fromiter(map(str.isalpha, words), bool, len(words))
        lines, others = list(compress(words, letters)), list(compress(words, ~letters))
        texts = [" " + " ".join(lines[i : i + _LINES]) for i in range(0, len(lines), _LINES)]
        ids = self._encoded(texts).ids
        starts = np.flatnonzero(self.blank[ids])
        if len(starts) != len(lines):
            return self._encoded([" " + w for w in words])
        own = _Runs(ids, np.diff(starts, append=len(ids)))
        if not others:
            return own
        own.add(self._encoded([" " + w for w in others]))
        places = np.empty(len(words), np.int64)
        places[letters], places[~letters] = np.arange(len(lines)), len(lines) + np.arange(len(others))
        return _Runs(*own.at(places))

    def _known(self, parts: list[str], known: dict[str, int], held: _Runs, encoded) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different parts, of which as many are remembered as there is room for."""
        out = list(map(known.get, parts))
        missing = [p for p, place in zip(parts, out, strict=True) if place is None]
        if 2 * len(missing) > len(parts) and len(known) + len(missing) > _KNOWN:
            # Other text than before.
            known.clear()
            held.clear()
            missing, out = parts, [None] * len(parts)
        places = np.array(out, np.float64)
        if missing:
            n = len(held)
            places[np.isnan(places)] = n + np.arange(len(missing))
            all_ids = held.with_more(encoded(missing))
            if len(known) + len(missing) <= _KNOWN and len(all_ids.ids) <= _KNOWN_IDS * _KNOWN:
                known.update(zip(missing, range(n, n + len(missing)), strict=True))
                held.ids, held.ends = all_ids.ids, all_ids.ends
            held = all_ids
        return held.at(places.astype(np.int64))

    def flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids per text), without ends."""
        if not self.cuttable:
            found = self._encoded([t or "" for t in texts])
            return found.ids, np.diff(found.ends)
        slices = [(i, s) for i, t in enumerate(texts) if t for s in _slices(t)]
        if not slices:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        firsts, begins, kinds = _parted([s for _, s in slices])
        words, signs = (x.dictionary_encode() for x in _cut(kinds.dictionary))
        halves = _Runs(*self._known(_strings(words.dictionary), self.known, self.known_ids, self._words))
        halves.add(_Runs(*self._known(_strings(signs.dictionary), self.signs, self.signs_ids, self._encoded)))
        both = np.stack([words.indices.to_numpy(), signs.indices.to_numpy() + len(words.dictionary)], axis=1)
        ids, n = halves.at(both.ravel())
        own = self._encoded(firsts)
        own.add(_Runs(ids, n.reshape(-1, 2).sum(axis=1)))
        # Places in ``own`` of all parts.
        is_first = np.zeros(len(firsts) + len(kinds), bool)
        is_first[begins] = True
        places = np.empty(len(is_first), np.int64)
        places[is_first], places[~is_first] = np.arange(len(firsts)), kinds.indices.to_numpy() + len(firsts)
        values, n = own.at(places)
        sizes = np.zeros(len(texts), np.int64)
        np.add.at(sizes, [i for i, _ in slices], np.add.reduceat(n, begins))
        return values, sizes

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as unsigned 32-bit integers, without the end."""
        values, sizes = self.flat(texts)
        raw, ends = values.tobytes(), 4 * np.cumsum(sizes)
        return [raw[a:b] for a, b in zip((ends - 4 * sizes).tolist(), ends.tolist(), strict=True)]


def _strings(texts: pa.Array) -> list[str | None]:
    """As `to_pylist`, at a fraction of its time."""
    return texts.to_numpy(zero_copy_only=False).tolist()


def _cut(parts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(letters, sign and what follows it) of each part; one of another form is left whole."""
    found = pc.extract_regex(parts, _WORD)
    return pc.coalesce(pc.struct_field(found, 0), parts), pc.fill_null(pc.struct_field(found, 1), "")


def _parted(slices: list[str]) -> tuple[list[str], np.ndarray, pa.DictionaryArray]:
    """(first part of each slice, its place among all parts, all other parts by kind): slices cut before
    blanks, which the parts do not show."""
    # Blanks next to white space do not cut: such slices are few, but their run is cut anew.
    if pc.any(pc.match_substring_regex(pa.array(slices, pa.large_string()), _NO_CUT)).as_py():
        found = [_BLANK.split(s) for s in slices]
        firsts, others = [f[0] for f in found], np.array([len(f) - 1 for f in found], np.int64)
        kinds = pa.array([p for f in found for p in f[1:]], pa.large_string()).dictionary_encode()
    else:
        halves = [s.split(" ", 1) for s in slices]
        firsts, rests = [h[0] for h in halves], [h[1] for h in halves if len(h) > 1]
        cut = pc.split_pattern(pa.array(rests, pa.large_string()), " ")
        others, kinds = np.zeros(len(slices), np.int64), cut.values.dictionary_encode()
        others[[len(h) > 1 for h in halves]] = np.diff(cut.offsets.to_numpy())
    return firsts, np.cumsum(others + 1) - others - 1, kinds


def _slices(text: str) -> Iterator[str]:
    start = 0
    while len(text) - start > _STEP and (cut := _BLANK.search(text, start + _STEP)):
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


@lru_cache(maxsize=1)
def _encoder(definition: str) -> Encoder:
    """One per Python process, for all its tasks."""
    return Encoder(definition)


@contextmanager
def _small_batches(spark: SparkSession):
    """What is run within hands Python few bytes at a time: ten thousand rows, which Spark counts by itself,
    are tens of megabytes, held several times over by both sides of every task."""
    before = spark.conf.get(_BATCH_BYTES, None)
    spark.conf.set(_BATCH_BYTES, str(_BATCH))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_BATCH_BYTES)
        else:
            spark.conf.set(_BATCH_BYTES, before)


def _shards(size: int, shard: int) -> int:
    return min(MOST_SHARDS, max(1, -(-size // shard)))


def write(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    end: int | None = END,
    shard: int = SHARD,
    stripe: int = STRIPE,
) -> None:
    """Files at ``path``: ``ids`` holds the shards, ``starts`` the number of ids before each.

    The order is that of the ids, NULL first; rows of one id follow the hash of their text. A NULL or
    empty text has the end alone (no id at all if ``end`` is None). Repeated rows stay. An empty table gives
    empty files. The file of the vocabulary is read here and sent along."""
    spark = docs.sparkSession
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    with open(vocabulary or vocabulary_file(), encoding="utf-8") as file:
        definition = file.read()
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    ranged = named.repartitionByRange(_shards(size, shard), *order).sortWithinPartitions(*order, "text")
    placed = ranged.select("id", F.spark_partition_id().alias("shard"), "text")

    def run(batches):
        encoder, before = _encoder(definition), 0
        for batch in batches:
            texts = _strings(batch.column(2))
            for chosen in together(texts, _STEP):
                ids, sizes = encoder.flat([texts[i] for i in chosen])
                if end is not None:
                    ids, sizes = np.insert(ids, np.cumsum(sizes), np.uint32(end)), sizes + 1
                ends = np.cumsum(sizes)
                values = pa.array(ids.view(np.int32))
                offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                part = batch.slice(chosen[0], len(chosen))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array(before + ends - sizes),
                        pa.array(sizes),
                        pa.ListArray.from_arrays(offsets, values),
                    ],
                    ["id", "shard", "place", "n_tokens", "ids"],
                )
                before += int(ends[-1])

    kind = named.schema["id"].dataType.simpleString()
    schema = f"id {kind}, shard int, place long, n_tokens long, ids array<int>"
    options = {
        "orc.bloom.filter.columns": "id",
        "orc.create.index": "true",
        "orc.row.index.stride": str(INDEX_ROWS),
        "orc.stripe.size": str(stripe),
        # A stripe may be full after a few long documents.
        "orc.rows.between.memory.checks": "200",
    }
    with _small_batches(spark):
        placed.mapInArrow(run, schema).write.options(**options).orc(f"{path}/ids")
    held = spark.read.schema(schema).orc(f"{path}/ids")
    totals = held.groupBy("shard").agg(F.max(F.col("place") + F.col("n_tokens")).alias("total"))
    before = F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    starts = totals.select("shard", F.coalesce(before, F.lit(0)).alias("before"))
    starts.coalesce(1).write.orc(f"{path}/starts")


def read(spark: SparkSession, path: str) -> DataFrame:
    """``id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids`` per document.

    The table of starts is sent to every task: it has at most ``MOST_SHARDS`` rows of two numbers."""
    held = spark.read.orc(f"{path}/ids")
    starts = spark.read.schema("shard int, before long").orc(f"{path}/starts")
    start = (F.col("before") + F.col("place")).alias("start")
    return held.join(F.broadcast(starts), "shard").select("id", start, "n_tokens", "ids")


def lookup(spark: SparkSession, path: str, ids: list) -> DataFrame:
    """The rows of some documents. Files, stripes and groups of rows whose statistics or Bloom filter
    rule the ids out are not read."""
    named = F.col("id").isin(*[i for i in ids if i is not None])
    return read(spark, path).where(named | F.col("id").isNull() if None in ids else named)


def digests(rows: DataFrame) -> DataFrame:
    """``id``, ``start``, ``n_tokens`` and ``ids_crc32`` (of the ids as little-endian 32-bit integers)
    of rows with ``ids``."""

    def run(batches):
        # Nothing is encoded any more: what the process remembers for it makes room.
        _encoder.cache_clear()
        for batch in batches:
            found = batch.column(2)
            values = found.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
            at = found.offsets.to_numpy()
            sums = [zlib.crc32(values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(at).astype(np.int64)), pa.array(sums, pa.int64())],
                ["id", "start", "n_tokens", "ids_crc32"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    chosen = rows.select("id", "start", "ids")
    return chosen.mapInArrow(run, f"id {kind}, start long, n_tokens long, ids_crc32 long")


def write_digests(spark: SparkSession, path: str) -> DataFrame:
    """`digests` of all documents at ``path``, written beside them and read from there."""
    with _small_batches(spark):
        digests(read(spark, path)).write.parquet(f"{path}/digests")
    return spark.read.parquet(f"{path}/digests")
