"""Toxicity by the nearest labelled examples.

Examples of both labels are TF-IDF vectors over all their words, where words that tell toxic from
other documents weigh more. The exact nearest ones by cosine come from an inverted index in blocks: a block's largest weight per word bounds every
cosine in it, so blocks that cannot reach the nearest found so far are passed over. Their votes,
weighted by distance, make the score.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.hashed import labelled
from ledgerlake.llm.tables import fold, held_out, written
from ledgerlake.llm.telling import telling_words

#: Learned from at most this many documents of each label.
SAMPLE = 2500
#: Choice of the telling words (see `telling`): words of one language are rare among all toxic texts.
WORDS, DEVIATIONS, CONTEXTS = 1000, 4.0, 5
#: Their weight, as a multiple of that of other words.
TELLING = 6.0
NEAREST = 15
BLOCK = 64
#: Words in the matrix; texts that meet it at once.
COMMON, TOGETHER = 512, 64
#: Weight of the base rate against the votes.
PRIOR = 0.05
THRESHOLD = 0.3
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TABLE = bytes(
    32 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256)
)


def words(text: Column) -> Column:
    """Lower-cased, cut at every ASCII character that is no letter or digit."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def plain_words(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_TABLE).split() if text else []


#: Numbers of words, ascending, and their weights.
Vector = tuple[np.ndarray, np.ndarray]
NO_WORDS: Vector = (np.zeros(0, np.int64), np.zeros(0))


@dataclass
class Example:
    id: int
    label: int
    weight: float
    vector: Vector


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places from each start on."""
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


class Index:
    """Postings per word, cut into blocks of examples with the largest weight of each block. Words that
    very many examples have are columns of a matrix instead: many queries meet them at once, and a
    block's bound holds their exact share."""

    def __init__(self, examples: list[Example], size: int, block: int = BLOCK, common: int = COMMON):
        held = [e for e in examples if len(e.vector[0])]
        held.sort(key=lambda e: (e.vector[0][e.vector[1].argmax()], e.id))
        self.ids = np.array([e.id for e in held], np.int64)
        #: Their vectors are in the postings.
        self.examples = [Example(e.id, e.label, e.weight, NO_WORDS) for e in held]
        self.count = -(-len(held) // block)
        self.edges = np.arange(0, len(held), block)
        words, values = (np.concatenate([NO_WORDS[i], *[e.vector[i] for e in held]]) for i in (0, 1))
        places = np.repeat(np.arange(len(held)), [len(e.vector[0]) for e in held])
        often = np.bincount(words, minlength=size)
        top = np.argsort(-often, kind="stable")[:common]
        #: Place of each common word in the matrix, -1 for others.
        self.column = np.full(size, -1, np.int64)
        self.column[top] = np.arange(len(top))
        self.matrix = np.zeros((len(top), len(held)))
        rare = self.column[words] < 0
        self.matrix[self.column[words[~rare]], places[~rare]] = values[~rare]
        words, values, places = words[rare], values[rare], places[rare]
        order = np.lexsort((places, words))
        words, self.places, self.values = words[order], places[order], values[order]
        piece = words * max(1, self.count) + self.places // block
        self.starts = np.flatnonzero(np.diff(piece, prepend=-1))
        self.sizes = np.diff(self.starts, append=len(words))
        self.blocks = self.places[self.starts] // block
        self.largest = np.maximum.reduceat(self.values, self.starts) if len(words) else self.values
        self.bounds = np.searchsorted(words[self.starts], np.arange(size + 1))

    def nearest(self, queries: list[Vector], most: int) -> list[list[tuple[float, int]]]:
        """Per query the (cosine, place) of the ``most`` nearest examples with a cosine over zero,
        nearest first; ties go to the smaller id."""
        if not self.count:
            return [[] for _ in queries]
        shares = np.zeros((len(queries), len(self.matrix)))
        for row, (words, weights) in zip(shares, queries, strict=True):
            column = self.column[words]
            row[column[column >= 0]] = weights[column >= 0]
        return [self._nearest(q, base, most) for q, base in zip(queries, shares @ self.matrix, strict=True)]

    def _nearest(self, query: Vector, base: np.ndarray, most: int) -> list[tuple[float, int]]:
        words, weights = query
        rare = self.column[words] < 0
        words, weights = words[rare], weights[rare]
        pieces = self.bounds[words + 1] - self.bounds[words]
        at, weights = _ranges(self.bounds[words], pieces), np.repeat(weights, pieces)
        blocks = self.blocks[at]
        bounds = np.maximum.reduceat(base, self.edges)
        bounds = bounds + np.bincount(blocks, weights * self.largest[at], minlength=self.count)
        order = np.argsort(-bounds, kind="stable")
        size = self.edges[1] if self.count > 1 else len(base)
        found: list[tuple[float, int, int]] = []
        done, take = 0, 8
        while done < self.count:
            now = order[done : done + take]
            least = max(1e-300, -found[most - 1][0] - 1e-9) if len(found) >= most else 1e-300
            now = now[bounds[now] >= least]
            if not len(now):
                break
            chosen = np.zeros(self.count, bool)
            chosen[now] = True
            mine = chosen[blocks]
            sizes = self.sizes[at[mine]]
            entry = _ranges(self.starts[at[mine]], sizes)
            scores = np.bincount(
                self.places[entry], np.repeat(weights[mine], sizes) * self.values[entry], minlength=len(base)
            )
            met = (now[:, None] * size + np.arange(size)).ravel()
            met = met[met < len(base)]
            near = np.round(scores[met] + base[met], 9)
            met, near = met[near > 0], near[near > 0]
            if len(met) > most:
                enough = near >= np.partition(near, -most)[-most]
                met, near = met[enough], near[enough]
            found += zip((-near).tolist(), self.ids[met].tolist(), met.tolist(), strict=True)
            found.sort()
            del found[most:]
            done, take = done + take, take * 4
        return [(-score, place) for score, _, place in found]


@dataclass
class Model:
    words: dict[bytes, int]
    weights: list[float]
    examples: list[Example]
    rate: float

    def __post_init__(self):
        self.factors = np.array(self.weights)

    def counted(self, own: list[bytes]) -> Vector:
        """Known words and how often each is there."""
        known = Counter(map(self.words.get, own))
        known.pop(None, None)
        words = np.sort(np.fromiter(known, np.int64, len(known)))
        return words, np.fromiter(map(known.__getitem__, words.tolist()), float, len(words))

    def vector(self, counted: Vector) -> Vector:
        """Of length one, or without words."""
        words, counts = counted
        raw = (1 + np.log(counts)) * self.factors[words]
        words, raw = words[raw > 0], raw[raw > 0]
        return words, raw / np.sqrt(raw @ raw) if len(raw) else raw


class Judge:
    def __init__(self, model: Model, most: int = NEAREST):
        self.index = Index(model.examples, len(model.words))
        empty = [e for e in model.examples if not len(e.vector[0])]
        total = sum(e.weight for e in empty)
        self.blank = sum(e.weight * e.label for e in empty) / total if total else model.rate
        self.model, self.most = Model(model.words, model.weights, [], model.rate), most

    def score(self, texts: list[str | None]) -> list[tuple[float, list[int]]]:
        """(chance of label 1, ids of the examples that voted) per text. A text without any known word
        is like the examples without any."""
        queries = [self.model.vector(self.model.counted(plain_words(t))) for t in texts]
        return [self._voted(near) for near in self.index.nearest(queries, self.most)]

    def _voted(self, near: list[tuple[float, int]]) -> tuple[float, list[int]]:
        if not near:
            return round(self.blank, 6), []
        voters = [(self.index.examples[place], cosine) for cosine, place in near]
        votes = [(e.weight * cosine / (1.05 - min(cosine, 1.0)), e.label) for e, cosine in voters]
        total = sum(v for v, _ in votes) + PRIOR
        share = (sum(v * label for v, label in votes) + PRIOR * self.model.rate) / total
        return round(share, 6), [e.id for e, _ in voters]


def _document_frequencies(docs: DataFrame, text_col: str, listed: list[bytes]) -> tuple[list[int], int]:
    """In how many of all documents each listed word occurs; how many documents there are."""
    places = {w: k for k, w in enumerate(listed)}

    def run(batches):
        total = np.zeros(len(places) + 1, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                often: Counter[bytes] = Counter()
                for text in batch.column(0).slice(start, 512):
                    often.update(set(plain_words(text.as_py())))
                for w in places.keys() & often.keys():
                    total[places[w]] += often[w]
            total[-1] += batch.num_rows
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met])], ["k", "n"])

    rows = docs.select(text_col).mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    counts = {r.k: r.n for r in rows.collect()}
    return [counts.get(k, 0) for k in range(len(listed))], counts.get(len(listed), 0)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Examples from at most ``sample`` documents of each label outside the held-out fold, with
    all their words; the inverse document frequencies come from all documents. None without a labelled text."""
    usable = labels.where(fold(F.col("doc_id")).isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {label: usable.where(F.col("toxic") == label).select("doc_id").distinct().count() for label in (0, 1)}
    ids = None
    for label in (0, 1):
        own = labelled(usable, F.col("toxic") == label, sample).withColumn("class", F.lit(str(label)))
        ids = own if ids is None else ids.unionByName(own)
    ids = written(ids, "examples")
    found = telling_words(docs, ids, ["0", "1"], words, WORDS, DEVIATIONS, CONTEXTS)
    telling = {w.encode() for w in found.odds}
    met = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    met = written(met.select("doc_id", F.col("class").cast("int"), "text"), "examples")
    model = Model({}, [], [], sizes[1] / max(1, sizes[0] + sizes[1]))
    rows = []
    for doc, label, text in met.toLocalIterator():
        own = plain_words(text)
        for w in own:
            model.words.setdefault(w, len(model.words))
        known, counts = model.counted(own)
        rows.append((doc, label, known.astype(np.int32), counts.astype(np.float32)))
    if not rows:
        return None
    rows.sort(key=lambda r: (r[0], r[1], r[2].tobytes()))
    often, total = _document_frequencies(docs, "text", list(model.words))
    for w, n in zip(model.words, often, strict=True):
        model.weights.append(math.log((1 + total) / (1 + n)) * (TELLING if w in telling else 1.0))
    taken = {label: max(1, sum(r[1] == label for r in rows)) for label in (0, 1)}
    scale = {label: sizes[label] / taken[label] for label in (0, 1)}
    least = min(s for s in scale.values() if s > 0)
    model.factors = np.array(model.weights)
    for doc, label, known, counts in rows:
        vector = model.vector((known, counts.astype(float)))
        model.examples.append(Example(doc, label, scale[label] / least, vector))
    return model


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``held_out``, ``score``, ``predicted`` and ``nearest`` (the examples that voted) per row.

    NULL and empty texts get the rate of examples without words; without a model every score
    is 0. Repeated rows stay."""
    kind = docs.schema[id_col].dataType.simpleString()
    judge = Judge(model) if model else None

    def run(batches):
        for batch in batches:
            texts, found = batch.column(1), []
            for start in range(0, len(texts), TOGETHER):
                part = texts.slice(start, TOGETHER).to_pylist()
                found += judge.score(part) if judge else [(0.0, [])] * len(part)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([s for s, _ in found], pa.float64()),
                    pa.array([n for _, n in found], pa.list_(pa.int64())),
                ],
                ["id", "score", "nearest"],
            )

    scored = docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, score double, nearest array<long>")
    predicted = (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    return scored.select("id", held_out(F.col("id")).alias("held_out"), "score", predicted, "nearest")
