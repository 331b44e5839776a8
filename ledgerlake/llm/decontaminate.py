"""Benchmark decontamination: word pairs as seeds, local alignment (Smith-Waterman) as the judge.

The benchmark is a query set, taken in blocks of bounded size against all documents. Every pair of
words of an item, neighbours or with one word between, is a seed. An alignment that scores enough
holds so many seeds within so few words that counting them loses none of them (see `Seeds`); only
passages with that many are aligned. Documents never move between machines; what is sent to every
task is one block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm import wordhash

#: An item of fewer words says too little to be a leak.
LEAST = 3
MATCH, MISMATCH, GAP = 2, -1, -1
#: Score of the best alignment as a share of the score of the whole item.
LEAK = 0.4
#: Characters of benchmark text in a block.
BLOCK = 8 << 20
#: Words of items whose seeds are looked up at once: bounds what is found in a run of texts.
_GROUP = 1 << 16
#: Words of passages aligned at once.
_CELLS = 1 << 15
_FILTER_BITS = 20
_SPREAD = np.uint64(0x9E3779B97F4A7C15)

RESULT = "item_id long, score double, first_word long, last_word long, item_words long"


class Lookup:
    """Places of hashes in a sorted list; a bitmap turns most misses away."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.bits = np.zeros(1 << _FILTER_BITS, bool)
        self.bits[self._slot(self.values)] = True

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``h``, places in the list) of all hits."""
        if not len(self.values):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        maybe = np.flatnonzero(self.bits[self._slot(h)])
        at = np.minimum(np.searchsorted(self.values, h[maybe]), len(self.values) - 1)
        hit = self.values[at] == h[maybe]
        return maybe[hit], at[hit]


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: (score, first and last word of it in ``passage``); (0, 0, -1) if none.

    Row by row; a gap along a row is a running maximum. Of equal scores the leftmost end counts."""
    size = len(passage)
    steps = np.arange(size + 1) * -GAP
    row = np.zeros(size + 1, np.int64)
    start = np.arange(size + 1)
    best = (0, 0, -1)
    for word in item:
        diagonal = row[:-1] + np.where(passage == word, MATCH, MISMATCH)
        down = row[1:] + GAP
        value = np.zeros(size + 1, np.int64)
        origin = np.arange(size + 1)
        value[1:] = np.maximum(diagonal, down)
        origin[1:] = np.where(diagonal >= down, start[:-1], start[1:])
        lifted = value + steps
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, np.arange(size + 1), 0))
        value = top - steps
        origin = origin[source]
        dead = value <= 0
        value[dead] = 0
        origin[dead] = np.flatnonzero(dead)
        row, start = value, origin
        end = int(row.argmax())
        if row[end] > best[0]:
            best = (int(row[end]), int(start[end]), end - 1)
    return best


def best_scores(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Score of the best local alignment of each (item, passage), many at a time."""
    sizes = np.array([[len(a), len(b)] for a, b in pairs], np.int64).reshape(-1, 2)
    out = np.zeros(len(pairs), np.int64)
    order = np.argsort(sizes[:, 1], kind="stable")
    at = 0
    while at < len(order):
        take = max(1, int(np.searchsorted(sizes[order[at:], 1] * np.arange(1, len(order) - at + 1), _CELLS)))
        now = order[at : at + take]
        at += take
        length, width = sizes[now].max(axis=0)
        items, passages = np.zeros((take, length), np.uint64), np.zeros((take, width), np.uint64)
        for k, place in enumerate(now.tolist()):
            a, b = pairs[place]
            items[k, : len(a)], passages[k, : len(b)] = a, b
        inside = np.arange(width) < sizes[now, 1:]
        steps = np.arange(width + 1, dtype=np.int32) * -GAP
        row, best = np.zeros((take, width + 1), np.int32), np.zeros(take, np.int32)
        for r in range(length):
            same = (passages == items[:, r : r + 1]) & inside & (r < sizes[now, :1])
            value = np.maximum(row + GAP, 0)
            np.maximum(value[:, 1:], row[:, :-1] + np.where(same, np.int32(MATCH), np.int32(MISMATCH)), out=value[:, 1:])
            row = np.maximum.accumulate(value + steps, axis=1) - steps
            best = np.maximum(best, row.max(axis=1))
        out[now] = best
    return out


def _pairs(hashes: np.ndarray, apart: int) -> np.ndarray:
    """Hash of each word with the word ``apart`` places later."""
    count = max(0, len(hashes) - apart)
    return wordhash.mix(hashes[:count] * _SPREAD + hashes[apart:])


class Seeds:
    """Word pairs of some items, and the passages that hold enough of them.

    An alignment of m matches and c other columns scores 2m - c. Between two matches that follow each
    other lie none of these columns (a pair of neighbours in both texts, worth 2), one (a pair with a
    word between in one text or both, worth 1) or more (worth 0). So the m - 1 steps are worth at
    least 2(m - 1) - c, which is the score less 2. The alignment covers at most m + c words of the
    document, which is 3m less the score, and m is at most the item's size n: an alignment of score s
    has seeds worth s - 2 within 3n - s words. Each step starts at another word of the document."""

    def __init__(self, items: list[np.ndarray], leak: float):
        sizes = np.array([len(own) for own in items], np.int64)
        scores = np.ceil(leak * MATCH * sizes - 1e-9).astype(np.int64)
        self.need, self.span = scores - 2, 3 * sizes - scores
        pairs, owners, worth = [], [], []
        for k, own in enumerate(items):
            for apart in (1, 2):
                pairs.append(np.unique(_pairs(own, apart)))
                owners.append(np.full(len(pairs[-1]), k))
                worth.append(np.full(len(pairs[-1]), 3 - apart))
        hashes = np.concatenate(pairs)
        self.lookup = Lookup(hashes)
        at = np.searchsorted(self.lookup.values, hashes)
        order = np.argsort(at, kind="stable")
        self.owners, self.worth = np.concatenate(owners)[order], np.concatenate(worth)[order]
        self.bounds = np.searchsorted(at[order], np.arange(len(self.lookup.values) + 1))

    def passages(self, hashes: np.ndarray, owners: np.ndarray, ends: np.ndarray):
        """(item, first word, end) of each stretch in which alignments of enough score can lie, from
        the words of texts, their texts and where these end; in order, overlaps merged."""
        size, found = len(hashes), []
        for apart in (1, 2):
            at, slot = self.lookup.find(_pairs(hashes, apart))
            same = owners[at] == owners[at + apart]
            at, slot = at[same], slot[same]
            counts = self.bounds[slot + 1] - self.bounds[slot]
            first = np.cumsum(counts) - counts
            entry = np.arange(counts.sum()) + np.repeat(self.bounds[slot] - first, counts)
            worth = self.worth[entry] if apart == 1 else 1
            found.append((self.owners[entry] * size + np.repeat(at, counts)) * 4 + worth)
        keyed = np.sort(np.concatenate(found))
        keys = keyed >> 2
        last = np.flatnonzero(np.append(keys[1:] != keys[:-1], True)) if len(keys) else keys
        keys, worth = keys[last], keyed[last] & 3
        item, word = np.divmod(keys, max(size, 1))
        end = np.minimum(word + self.span[item], ends[owners[word]])
        total = np.concatenate([[0], np.cumsum(worth)])
        held = total[np.searchsorted(keys, item * size + end)] - total[:-1]
        out: list[list[int]] = []
        for k in np.flatnonzero(held >= self.need[item]).tolist():
            i, start, stop = int(item[k]), int(word[k]), int(end[k])
            if out and out[-1][0] == i and start < out[-1][2] and owners[start] == owners[out[-1][1]]:
                out[-1][2] = max(out[-1][2], stop)
            else:
                out.append([i, start, stop])
        return out


class Judge:
    """Leaks of a block's items in texts: those that aligning every item with every text finds."""

    def __init__(self, items: list[tuple[int, str]], leak: float):
        if leak * MATCH * LEAST <= MATCH:
            raise ValueError("a single word of the shortest items would be a leak")
        self.leak = leak
        self.groups: list[tuple[list[tuple[int, np.ndarray]], Seeds]] = []
        group, size = [], 0
        for item, text in items:
            own = wordhash.words(wordhash.normal(text))[0]
            if len(own) < LEAST:
                continue
            group.append((item, own))
            size += len(own)
            if size >= _GROUP:
                self._add(group)
                group, size = [], 0
        if group:
            self._add(group)

    def _add(self, group: list[tuple[int, np.ndarray]]) -> None:
        self.groups.append((group, Seeds([own for _, own in group], self.leak)))

    def leaks(self, texts: list[str | None]) -> list[tuple]:
        """(text, item, score, first and last word in the text, words of the item)."""
        out = []
        for part in wordhash.together(texts):
            hashes, owners = wordhash.joined_words([texts[i] for i in part])
            first = np.searchsorted(owners, np.arange(len(part) + 1))
            for group, seeds in self.groups:
                best: dict[tuple[int, int], tuple[int, int, int]] = {}
                met = seeds.passages(hashes, owners, first[1:])
                scores = best_scores([(group[k][1], hashes[start:end]) for k, start, end in met])
                for m in np.flatnonzero(scores >= seeds.need[[k for k, _, _ in met]] + 2).tolist():
                    k, start, end = met[m]
                    score, a, b = align(group[k][1], hashes[start:end])
                    key = int(owners[start]), k
                    if score > best.get(key, (0, 0, -1))[0]:
                        shift = start - int(first[key[0]])
                        best[key] = score, a + shift, b + shift
                for (doc, k), (score, a, b) in best.items():
                    item, own = group[k]
                    share = score / (MATCH * len(own))
                    if share >= self.leak:
                        out.append((part[doc], item, share, a, b, len(own)))
        return out


def blocks(benchmark: DataFrame, id_col: str, text_col: str, size: int = BLOCK):
    """The benchmark's items in lists of about ``size`` characters, one list at a time."""
    items = benchmark.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    items = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = -(-total // size)
    for k in range(count):
        rows = items.where(F.pmod(F.xxhash64("id"), F.lit(count)) == k).distinct()
        if found := sorted(map(tuple, rows.collect())):
            yield found


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    leak: float = LEAK,
) -> DataFrame:
    """A row per document and item that it leaks: ``id``, ``item_id``, ``score`` (share of the
    item's own score reached by the best alignment), ``first_word`` and ``last_word`` of the passage
    in the document, ``item_words``.

    Words are runs of letters and digits, lower-cased. NULL and empty texts, and items of fewer than
    three words, leak nothing. Items without an id are left out; equal texts under several ids each
    count; an item listed twice counts once. Rows that repeat a document are judged one by one."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, {RESULT}"

    def with_judge(judge: Judge) -> DataFrame:
        def run(batches):
            for batch in batches:
                rows = judge.leaks(batch.column(1).to_pylist())
                where = pa.array([r[0] for r in rows], pa.int64())
                columns = [batch.column(0).take(where)]
                for k, t in enumerate(("int64", "float64", "int64", "int64", "int64"), 1):
                    columns.append(pa.array([r[k] for r in rows], t))
                names = ["id", "item_id", "score", "first_word", "last_word", "item_words"]
                yield pa.RecordBatch.from_arrays(columns, names)

        return docs.select(id_col, text_col).mapInArrow(run, schema)

    out = docs.sparkSession.createDataFrame([], schema)
    for items in blocks(benchmark, "item_id", "text"):
        judge = Judge(items, leak)
        out = out.unionByName(with_judge(judge))
    return out


def without_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    leak: float = LEAK,
) -> DataFrame:
    """The documents that leak no item, with all their columns, in one pass per block."""
    out = docs
    for items in blocks(benchmark, "item_id", "text"):
        judge = Judge(items, leak)

        def run(batches, judge=judge):
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
                clean = np.ones(len(texts), bool)
                clean[[r[0] for r in judge.leaks(texts)]] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(run, docs.schema)
    return out
