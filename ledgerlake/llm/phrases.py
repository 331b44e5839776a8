"""Phrases that stand out, mined shard by shard.

A shard is part of the text that one task reads, of bounded size. A phrase that is frequent in the
corpus is, in at least one shard, as frequent as that shard's share of the text asks for. So the first
pass mines every shard completely at that lowered support, phrases of k words from those of k - 1, and
unites what it finds as 64-bit keys in a bit table of bounded size. The second pass counts every phrase
whose key is in the table, in every shard, and the counts add up exactly: a key that two phrases
share, or a bit set by others, only adds a phrase to be counted.

Within a shard a word is a number of the shard's own word list, and a phrase of k words is the pair
of the two phrases of k - 1 words in it, so counting there compares no hashes. Across shards phrases
meet as text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.tables import written
from ledgerlake.llm.wordhash import mix
from ledgerlake.operators.joins import hot_keys, join_on_key

LONGEST = 5
SUPPORT = 100
TOP = 2000
#: A phrase goes if a longer one has this share (per cent) of its occurrences.
ABSORBED = 100
#: Bytes of text that tasks are to have, at least if there are fewer than MANY tasks.
TASK, MANY = 24 << 20, 16
#: Bytes of text of a shard: about this share of all text, so that the lowered support stays the same
#: while the text grows, and never more than one task holds in memory. Beyond SHARDS * SHARD it falls.
SHARDS, SHARD = 32, 48 << 20
#: Bits of the table of candidates: at least so many per candidate, and never more than 32 MB of them.
BITS_EACH, MOST_BITS = 16, 1 << 28
_BLOCK = 1 << 15
_RUN = 1 << 21
_STEP = np.uint64(0x9E3779B97F4A7C15)

#: A-Z in lower case; a tab is a blank; what ends a piece is a line end.
_PLAIN = bytes(
    32 if b == 9 else 10 if b in b".,;:!?\x0a\x0b\x0c\x0d" else b + 32 if 65 <= b <= 90 else b for b in range(256)
)
_END, _NONE = -1, -2


class _Words(dict):
    """Numbers of words in the order in which they come."""

    def __init__(self):
        super().__init__()
        self.list: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        number = len(self.list)
        if word in (b"\n", b""):
            number = _END if word else _NONE
        else:
            self.list.append(word)
        self[word] = number
        return number


class _Shard:
    """Word numbers of the texts of each language, with ``_END`` between pieces."""

    def __init__(self):
        self.words, self.size = _Words(), 0
        self.parts: dict[str, list[np.ndarray]] = {}

    def add(self, lang: str, texts: list[bytes]) -> None:
        raw = b"\n".join(texts)
        cut = raw.translate(_PLAIN).replace(b"\n", b" \n ").split(b" ")
        ids = np.fromiter(map(self.words.__getitem__, cut), np.int32, len(cut))
        self.parts.setdefault(lang, []).extend([ids[ids != _NONE], np.array([_END], np.int32)])
        self.size += sum(map(len, texts))

    def absorb(self, other: _Shard) -> None:
        """Take over another shard's texts under this one's numbers."""
        number = np.fromiter(map(self.words.__getitem__, other.words.list), np.int32, len(other.words.list))
        for lang, parts in other.parts.items():
            own = [np.where(ids >= 0, number[np.maximum(ids, 0)], ids) if len(number) else ids for ids in parts]
            self.parts.setdefault(lang, []).extend(own)
        self.size += other.size

    def hashes(self) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh64_intdigest, self.words.list), np.uint64, len(self.words.list))

    def texts(self) -> Iterator[tuple[str, np.ndarray]]:
        for lang, parts in self.parts.items():
            yield lang, np.concatenate(parts)


def _cut(text: bytes) -> Iterator[bytes]:
    """A long text in runs that end where a piece does, so that no list of words grows with it."""
    start = 0
    while len(text) - start > _RUN:
        ends = [p for c in b".\n" if (p := text.find(c, start + _RUN, start + 2 * _RUN)) >= 0]
        if not ends:
            break
        yield text[start : min(ends)]
        start = min(ends)
    yield text[start:] if start else text


def _shards(batches, most: int) -> Iterator[_Shard]:
    """Shards of about ``most`` bytes; a small rest of a task goes to the shard before it, for the lowered
    support of a small shard would be one."""
    before = None
    for shard in _runs(batches, most):
        if before is not None and 2 * shard.size < most:
            before.absorb(shard)
            continue
        if before is not None:
            yield before
        before = shard
    if before is not None:
        yield before


def _runs(batches, most: int) -> Iterator[_Shard]:
    """Batches of (language, text as bytes) in runs of ``most`` bytes or a little more."""
    shard = _Shard()
    for batch in batches:
        waiting: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for run in _cut(text.as_py()):
                waiting.setdefault(lang, []).append(run)
                sizes[lang] = sizes.get(lang, 0) + len(run)
                if sizes[lang] >= _RUN:
                    shard.add(lang, waiting.pop(lang))
                    del sizes[lang]
                    if shard.size >= most:
                        yield shard
                        shard = _Shard()
        for lang, texts in waiting.items():
            shard.add(lang, texts)
        if shard.size >= most:
            yield shard
            shard = _Shard()
    if shard.parts:
        yield shard


def grams(
    ids: np.ndarray,
    hashes: np.ndarray,
    seed: int,
    keep: Callable[[np.ndarray, np.ndarray], np.ndarray],
    longest: int = LONGEST,
) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(number of words, a place, occurrences, key) of the phrases of ``ids`` that ``keep(keys,
    occurrences)`` lets stay. A phrase is only looked at if both phrases of one word less in it stayed."""
    own = ids
    for k in range(1, longest + 1):
        if k == 1:
            at = np.flatnonzero(ids >= 0)
            values = ids[at].astype(np.int64)
        else:
            at = np.flatnonzero((own[:-1] >= 0) & (own[1:] >= 0))
            values = own[at].astype(np.int64) << 32 | own[at + 1]
        if not len(at):
            return
        order = np.argsort(values)
        values, at = values[order], at[order]
        starts = np.flatnonzero(np.diff(values, prepend=-1))
        counts = np.diff(starts, append=len(at))
        place = at[starts]
        key = np.full(len(place), (seed * 31 + k) & (2**64 - 1), np.uint64)
        for j in range(k):
            key = key * _STEP + hashes[ids[place + j]]
        key = mix(key)
        stays = keep(key, counts)
        number = np.where(stays, np.cumsum(stays) - 1, -1).astype(np.int32)
        own = np.full(len(ids), -1, np.int32)
        own[at] = np.repeat(number, counts)
        yield k, place[stays], counts[stays], key[stays]


def _seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode())


def _candidates(rows: DataFrame, total: int, support: int, longest: int, most: int) -> DataFrame:
    """Keys of the phrases that may have the support, each once.

    A shard that does not report a phrase has less than its lowered support of it. So what a shard
    reports is by how much the phrase exceeds that bound, and a phrase has the support only if these
    amounts and the bounds of all shards together reach it. The row without a key sums up the bounds."""

    def run(batches):
        for shard in _shards(batches, most):
            least, hashes = max(1, -(-support * shard.size // max(1, total))), shard.hashes()
            bound = pa.array([least - 1], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), bound], ["key", "over"])
            for lang, ids in shard.texts():
                for _, _, counts, keys in grams(ids, hashes, _seed(lang), lambda _, n, t=least: n >= t, longest):
                    over = pa.array((counts - (least - 1)).astype(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), over], ["key", "over"])

    summed = rows.mapInArrow(run, "key long, over long").groupBy("key").agg(F.sum("over").alias("over"))
    reported = written(summed, "candidates")
    bounds = reported.where("key IS NULL").first()
    return reported.where(F.col("key").isNotNull() & (F.col("over") >= support - (bounds["over"] if bounds else 0)))


def _table(candidates: DataFrame) -> np.ndarray:
    """Two bits set per candidate. Tasks set them; at most ``MOST_BITS`` of them come to the driver."""
    bits = 1 << 16
    while bits < min(MOST_BITS, BITS_EACH * candidates.count()):
        bits *= 2
    places = F.array(*_places(F.col("key"), bits))
    set_bits = candidates.select(F.explode(places).alias("p"))
    blocks = set_bits.groupBy((F.col("p") / _BLOCK).cast("int").alias("b")).agg(
        F.bitmap_construct_agg(F.col("p") % _BLOCK).alias("bits")
    )
    table = np.zeros(bits // 8, np.uint8)
    for block, held in blocks.collect():
        table[block * _BLOCK // 8 : (block + 1) * _BLOCK // 8] = np.frombuffer(held, np.uint8)
    return table


def _places(key: Column, bits: int) -> list[Column]:
    width = bits.bit_length() - 1
    return [key.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(key, 64 - width)]


def _listed(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    width = (8 * len(table)).bit_length() - 1
    found = np.ones(len(keys), bool)
    for place in (keys & np.uint64(8 * len(table) - 1), keys >> np.uint64(64 - width)):
        place = place.astype(np.int64)
        found &= (table[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
    return found


def _counts(rows: DataFrame, table: np.ndarray, support: int, longest: int, most: int) -> DataFrame:
    """(lang, k, phrase, f) of phrases and words with that support; k is 0 for the number of all words."""
    names = ["lang", "k", "phrase", "f"]

    def run(batches):
        for shard in _shards(batches, most):
            hashes, words = shard.hashes(), shard.words.list
            for lang, ids in shard.texts():
                every = int((ids >= 0).sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang]), pa.array([0], pa.int32()), pa.array([""]), pa.array([every])], names
                )
                for k, place, counts, _ in grams(
                    ids, hashes, _seed(lang), lambda keys, _: _listed(table, keys), longest
                ):
                    for start in range(0, len(place), 1 << 16):
                        part = place[start : start + (1 << 16)]
                        own = [[words[i] for i in ids[part + j].tolist()] for j in range(k)]
                        phrases = list(map(b" ".join, zip(*own, strict=True)))
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([lang] * len(part)),
                                pa.array(np.full(len(part), k, np.int32)),
                                pa.array(phrases, pa.binary()).cast(pa.string()),
                                pa.array(counts[start : start + (1 << 16)].astype(np.int64)),
                            ],
                            names,
                        )

    met = rows.mapInArrow(run, "lang string, k int, phrase string, f long")
    summed = met.groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f"))
    return written(summed.where((F.col("k") == 0) | (F.col("f") >= support)), "phrases")


def frequent(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    support: int = SUPPORT,
    longest: int = LONGEST,
    task: int = TASK,
    shard: int = SHARD,
) -> DataFrame:
    """``lang``, ``k`` (number of words), ``phrase`` and ``f`` of all phrases of up to ``longest`` words
    that occur ``support`` times, and per language one row with k = 0 and the number of all words."""
    rows = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"),
    )
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    fewer = rows.coalesce(max(MANY, -(-total // task)))
    size = max(1, min(shard, -(-total // SHARDS)))
    table = _table(_candidates(fewer, total, support, longest, size))
    return _counts(fewer, table, support, longest, size)


def _joined(words: Column, start, size) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def _not_absorbed(found: DataFrame, percent: int) -> DataFrame:
    """Without the phrases that stand inside a longer one almost as often."""
    longer = found.where("k > 2").select("lang", "k", "f", F.split("phrase", " ").alias("w"))
    sized = longer.select("*", F.explode(F.expr("sequence(2, k - 1)")).alias("size"))
    placed = sized.select("*", F.explode(F.expr("sequence(1, k - size + 1)")).alias("start"))
    inner = placed.select("lang", _joined(F.col("w"), F.col("start"), F.col("size")).alias("phrase"), "f")
    most = inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    beaten = F.coalesce(100 * F.col("longer") >= percent * F.col("f"), F.lit(False))
    return found.join(most, ["lang", "phrase"], "left").where(~beaten).drop("longer")


def _looked_up(rows: DataFrame, counts: DataFrame, part: str, name: str) -> DataFrame:
    known = counts.select("lang", F.col("phrase").alias(part), F.col("f").alias(name))
    return join_on_key(rows, known, ["lang", part], hot=hot_keys(rows, ["lang", part]))


def exact_score(a: Column, n: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000 a n / (l r)) of decimals without a fraction, in 38 digits."""
    return F.call_function("div", a * n * F.lit(1000).cast("decimal(4,0)"), l * r)


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    support: int = SUPPORT,
    longest: int = LONGEST,
    top: int = TOP,
    absorbed: int = ABSORBED,
    task: int = TASK,
    shard: int = SHARD,
) -> DataFrame:
    """Per language the ``top`` phrases: ``lang``, ``rank``, ``phrase``, ``a`` (its occurrences), ``l`` and
    ``r`` (those of the two parts of its weakest cut), ``n`` (words of the language) and ``score`` =
    floor(1000 a n / (l r)).

    Cuts that score alike: the one with the shorter first part counts. Phrases that score alike: the one with
    more occurrences, then the one that comes first. A NULL text has no words; a NULL language is `und`. Repeated
    rows count as often as they are there."""
    counts = frequent(docs, text_col, lang_col, support, longest, task, shard)
    words = counts.where("k = 0").select("lang", F.col("f").alias("n"))
    listed = counts.where("k > 0")
    found = _not_absorbed(listed.where("k > 1"), absorbed)
    found = join_on_key(found, words, "lang", hot=hot_keys(found, "lang"))
    cuts = found.select(
        "lang", "phrase", "k", "n", F.col("f").alias("a"), F.explode(F.expr("sequence(1, k - 1)")).alias("c")
    )
    split = F.split("phrase", " ")
    parts = cuts.select(
        "*",
        _joined(split, F.lit(1), F.col("c")).alias("first"),
        _joined(split, F.col("c") + 1, F.col("k")).alias("rest"),
    )
    parts = _looked_up(_looked_up(parts, listed, "first", "l"), listed, "rest", "r")
    whole = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "n", "l", "r")}
    scored = parts.withColumn("score", exact_score(**whole))
    weakest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "c", "l", "r")).alias("cut"))
    ranked = weakest.select("lang", "phrase", "a", "n", "cut.l", "cut.r", "cut.score").withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    )
    best = ranked.where(F.col("rank") <= top)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


_WORD = r"[ \t]+"
#: The same rows as the query gives, for a database.
SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
cut AS (SELECT lang, list_filter(regexp_split_to_array(piece, '{_WORD}'), lambda x: x <> '') AS w FROM pieces),
sizes AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM cut GROUP BY lang),
placed AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i
  FROM cut, (SELECT unnest(range(1, {LONGEST + 1})) AS k) ks),
counts AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM placed GROUP BY ALL HAVING count(*) >= {SUPPORT}),
inner_ones AS (SELECT lang, array_to_string(list_slice(w, i, i + size - 1), ' ') AS phrase, max(f) AS longer
  FROM (SELECT *, unnest(range(1, k - size + 2)) AS i
    FROM (SELECT lang, k, f, string_split(phrase, ' ') AS w, unnest(range(2, k)) AS size FROM counts WHERE k > 2))
  GROUP BY ALL),
found AS (SELECT c.* FROM counts c LEFT JOIN inner_ones i USING (lang, phrase)
  WHERE k > 1 AND NOT coalesce(100 * longer >= {ABSORBED} * f, false)),
parts AS (SELECT lang, phrase, f AS a, c, array_to_string(list_slice(w, 1, c), ' ') AS first_part,
    array_to_string(list_slice(w, c + 1, k), ' ') AS rest
  FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS c FROM found)),
scored AS (SELECT p.lang, p.phrase, a, c, x.f AS l, y.f AS r, n,
    CAST((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM parts p JOIN counts x ON x.lang = p.lang AND x.phrase = first_part
  JOIN counts y ON y.lang = p.lang AND y.phrase = rest JOIN sizes s ON s.lang = p.lang),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM weakest QUALIFY rank <= {TOP}"""
