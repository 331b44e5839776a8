"""Spelling variants: words one edit apart, found by asymmetric chunks.

Of two words one edit apart, the shorter (of two of one length, the smaller) is cut: its first and its
last ``length div 2`` code points are two disjoint chunks, and one edit leaves at least one of them
whole. It stands in the other word too, at most one place further on. So the other word is listed under
its grams of that length, at the places that such a chunk can have within a shift of one. An equality
join of chunks and grams finds the pairs, and the edit distance verifies them.

A chunk that very many words share makes a long list. Its members are listed again, under the chunk
and each variant of the word with one code point out: two words one edit apart share such a variant,
and only as many words as there are letters and places can share one.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.tables import written

SHORTEST = 5
LEAST = 3
#: A word is a form of another if it occurs this many times as often.
TIMES = 2
#: Lists with more pairs than this are cut further.
PAIRED = 1 << 16
#: One in so many runs of a document loses a code point (a check value picks them).
DAMAGED = 97
#: Letters of words, in UTF-8 after A-Z were lower-cased.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
_STEP, _HELD = 1 << 22, 1 << 19


def _slices(raw: bytes):
    """A long text in parts that end where a run does."""
    start = 0
    while len(raw) - start > _STEP:
        end = raw.find(b" ", start + _STEP)
        if end < 0:
            break
        yield raw[start:end]
        start = end
    yield raw[start:] if start else raw


def damaged(run: bytes, check: int) -> bytes:
    """The run, or without one code point where the check value says so."""
    if check % DAMAGED:
        return run
    text = run.decode()
    place = check % len(text)
    return (text[:place] + text[place + 1 :]).encode()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: bool = True) -> DataFrame:
    """``word`` and ``n`` over all texts. Without an id, the id's text in the check value is empty."""
    ids = F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(ids.alias("id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches):
        found: Counter[bytes] = Counter()

        def taken():
            words = pa.array(list(found), pa.binary()).cast(pa.string())
            out = pa.RecordBatch.from_arrays([words, pa.array(list(found.values()), pa.int64())], ["word", "n"])
            found.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                start = zlib.crc32(doc + b":")
                for part in _slices((text.as_py() or b"").lower()):
                    for own, n in Counter(_RUN.findall(part)).items():
                        found[damaged(own, zlib.crc32(own, start)) if damage else own] += n
                    if len(found) > _HELD:
                        yield taken()
        yield taken()

    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _part(word: str, start: Column, size: Column) -> Column:
    return F.substring(F.col(word), start + 1, size)


def _chunks(words: DataFrame) -> DataFrame:
    """Both chunks of each word, under its length."""
    size = F.expr("length(word) div 2").cast("int")
    length = F.length("word")
    first = F.struct(F.lit(0).alias("end"), _part("word", F.lit(0), size).alias("gram"))
    last = F.struct(F.lit(1).alias("end"), _part("word", length - size, size).alias("gram"))
    rows = words.select("word", "n", length.alias("length"), F.explode(F.array(first, last)).alias("c"))
    return rows.select("word", "n", "length", "c.*", F.lit(False).alias("whole"))


def _grams(words: DataFrame, shortest: int) -> DataFrame:
    """The grams of each word at the places of chunks of a word as long or one shorter, shifted by at
    most the difference."""
    shorter = F.explode(F.array(F.lit(0), F.lit(1))).alias("shorter")
    rows = words.select("word", "n", shorter).withColumn("length", F.length("word") - F.col("shorter"))
    rows = rows.where(F.col("length") >= shortest).withColumn("size", F.expr("length div 2").cast("int"))
    ends = rows.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("end"))
    start = F.when(F.col("end") == 0, 0).otherwise(F.col("length") - F.col("size"))
    shifted = F.array(*[_part("word", start + shift, F.col("size")) for shift in (0, 1)])
    own = F.array_distinct(F.slice(shifted, F.lit(1), 1 + F.col("shorter")))
    return ends.select("word", "n", "length", "end", F.explode(own).alias("gram"), F.lit(True).alias("whole"))


_KEY = ["length", "end", "gram"]


def _pairs(rows: DataFrame, key: list[str]) -> DataFrame:
    a = rows.where("NOT whole").select(*key, F.col("word").alias("left"), F.col("n").alias("left_n"))
    b = rows.where("whole").select(*key, F.col("word").alias("right"), F.col("n").alias("right_n"))
    shorter = F.length("left") < F.length("right")
    met = a.join(b, key).where((shorter | (F.col("left") < F.col("right"))) & (F.levenshtein("left", "right", 1) == 1))
    return met.select("left", "left_n", "right", "right_n")


def _varied(rows: DataFrame) -> DataFrame:
    """Each word under its variants with one code point out; the side that is cut under itself too."""
    out = F.expr("transform(sequence(1, length(word)), i -> concat(left(word, i - 1), substr(word, i + 1)))")
    own = F.when(F.col("whole"), out).otherwise(F.concat(F.array("word"), out))
    return rows.select("*", F.explode(F.array_distinct(own)).alias("variant"))


def near_pairs(words: DataFrame, shortest: int = SHORTEST, paired: int = PAIRED) -> DataFrame:
    """``left``, ``left_n``, ``right``, ``right_n`` of every two words (columns word, n; each word once, of at
    least ``shortest`` code points) exactly one edit apart, each pair once."""
    listed = written(_chunks(words).unionByName(_grams(words, shortest)), "listed")
    sizes = listed.groupBy(*_KEY).agg(
        F.count_if(F.col("whole")).alias("g"), F.count_if(~F.col("whole")).alias("c")
    )
    sizes = sizes.where("c > 0 AND g > 0").withColumn("long", F.col("c") * F.col("g") > paired)
    met = written(listed.join(sizes.select(*_KEY, "long"), _KEY), "met")
    short = _pairs(met.where("NOT long"), _KEY)
    long = _pairs(_varied(met.where("long")), [*_KEY, "variant"])
    return short.unionByName(long).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` for words (columns word, form) that have a form. Each round doubles the
    steps gone; a form occurs at least twice as often, so the rounds are few."""
    hops = written(forms.select("word", F.col("form").alias("root")), "hops")
    while True:
        further = hops.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        joined = hops.join(further, "root", "left")
        moved = F.col("beyond").isNotNull().alias("moved")
        now = written(joined.select("word", F.coalesce("beyond", "root").alias("root"), moved), "hops")
        if now.where("moved").isEmpty():
            return now.drop("moved")
        hops = now.drop("moved")


def variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: int = LEAST,
    times: int = TIMES,
    shortest: int = SHORTEST,
    damage: bool = True,
) -> DataFrame:
    """Per word with ``least`` occurrences: ``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n``.

    A word's form is its near word of most occurrences (of those, the first in code-point order) if it
    occurs ``times`` as often as the word, else NULL; ``root`` is the last of the chain of forms. NULL and
    empty texts have no words; repeated rows count as often as they are there."""
    counts = word_counts(docs, id_col, text_col, damage)
    words = written(counts.where((F.length("word") >= shortest) & (F.col("n") >= least)), "words")
    pairs = written(near_pairs(words, shortest), "pairs")
    near = pairs.selectExpr("left AS word", "right AS other", "right_n AS other_n").unionAll(
        pairs.selectExpr("right", "left", "left_n")
    )
    best = near.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), "other")).alias("best")
    )
    joined = words.join(best, "word", "left")
    more = -F.col("best.m") >= times * F.col("n")
    found = joined.select(
        "word",
        F.when(more, F.col("best.other")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(more, -F.col("best.m")).alias("form_n"),
    )
    found = written(found, "forms")
    roots = _roots(found.where("form IS NOT NULL"))
    whole = found.join(roots, "word", "left")
    return whole.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
