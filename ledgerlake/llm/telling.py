"""Words that tell classes of documents apart. DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm import hashed
from ledgerlake.llm.tables import written

#: A word tells nothing unless the documents of a class that have it are this many standard
#: deviations off what all classes together let expect. Classes whose shares of documents with the
#: word differ by less than this factor count as alike in it.
DEVIATIONS = 8.0
FACTOR = 1.5
#: Nor unless it speaks for a class: the log of its odds there is this high.
SPEAKS = 0.7
#: Nor unless it follows this many different words within a class: the words of one much copied
#: document always follow the same.
LEAST_CONTEXTS = 10
#: At most this many words are taken, those that are the most deviations off.
MOST = 400


@dataclass
class Telling:
    """``odds``: per word the log-odds by class; ``marks``: per class the words that speak for it
    most, and the log-odds by class of a document that has none of them."""

    odds: dict[str, list[float]]
    marks: list[tuple[list[str], list[float]]]


def _odds(having: list[int], read: list[int]) -> list[float]:
    """Log of each class's share over that of all; classes alike in the word get the same."""
    pooled = sum(having) / max(1, sum(read))
    shares = [(n + pooled) / (r + 1) for n, r in zip(having, read, strict=True)]
    out = [0.0] * len(shares)
    group: list[int] = []
    for i in sorted(range(len(shares)), key=shares.__getitem__):
        if group and shares[i] > FACTOR * shares[group[0]]:
            group = []
        group.append(i)
        both = sum(having[k] + pooled for k in group) / sum(read[k] + 1 for k in group)
        for k in group:
            out[k] = round(math.log(both / pooled), 9)
    return out


def telling_words(
    docs: DataFrame,
    ids: DataFrame,
    classes: list[str],
    words=hashed.words,
    most: int = MOST,
    deviations: float = DEVIATIONS,
    least_contexts: int = LEAST_CONTEXTS,
) -> Telling:
    """From the documents in ``ids`` (columns doc_id, class), of which there are a bounded number.
    Equal texts are read once per class; NULL texts have no words."""
    met = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    texts = met.select("class", F.xxhash64("text").alias("h"), words(F.col("text")).alias("w"))
    texts = written(texts.dropDuplicates(["class", "h"]), "sample")
    sizes = {r["class"]: r["n"] for r in texts.groupBy("class").agg(F.count("*").alias("n")).collect()}
    read = [sizes.get(c, 0) for c in classes]
    # What stands before the first word is another thing in each text.
    start = F.array(F.concat(F.lit(" "), F.col("h").cast("string")))
    before = F.concat(start, F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))))
    pairs = F.arrays_zip(F.col("w").alias("word"), before.alias("before"))
    contexts = texts.select("class", F.explode_outer(pairs).alias("p")).select("class", "p.*").distinct()
    per_class = contexts.groupBy("class", "word").agg(F.count("*").alias("c"))
    varied = per_class.where(F.col("c") >= least_contexts).select("word").distinct()
    flat = texts.select("class", F.explode_outer(F.array_distinct("w")).alias("word"))
    counts = flat.groupBy("word").agg(
        *[F.count(F.when(F.col("class") == c, 1)).alias(f"n{i}") for i, c in enumerate(classes)]
    )
    share: Column = sum((F.col(f"n{i}") for i in range(len(classes))), F.lit(0)) / max(1, sum(read))
    off = []
    for i in range(len(classes)):
        expected = share * read[i]
        off.append(F.abs(F.col(f"n{i}") - expected) / F.sqrt(expected * (1 - share) + 1))
    judged = counts.join(varied, "word").withColumn("off", F.round(F.array_max(F.array(*off)), 9))
    speaking = F.array_max(F.array(*[F.col(f"n{i}") / max(1, r) for i, r in enumerate(read)])) > 1.9 * share
    chosen = judged.where((F.col("off") > deviations) & speaking).orderBy(F.desc("off"), "word").limit(most)
    found = {r["word"]: _odds([r[f"n{i}"] for i in range(len(classes))], read) for r in chosen.collect()}
    found = {w: o for w, o in found.items() if max(o) >= SPEAKS}
    sets = [sorted(w for w, o in found.items() if o[i] > max([0, *o[:i], *o[i + 1 :]])) for i in range(len(classes))]
    none = [F.sum((~has_any("w", s)).cast("long")).alias(f"m{i}") for i, s in enumerate(sets)]
    lacking = {r["class"]: r for r in texts.groupBy("class").agg(*none).collect()}
    marks = [
        (s, _odds([lacking[c][f"m{i}"] if c in lacking else 0 for c in classes], read))
        for i, s in enumerate(sets)
        if s
    ]
    return Telling(found, marks)


def has_any(words: str, listed: list[str]) -> Column:
    return F.exists(words, lambda w: w.isin(listed)) if listed else F.lit(False)
