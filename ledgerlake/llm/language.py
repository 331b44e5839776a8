"""Language identification by piece unigrams, with all segmentations of a word summed.

Each language has a probability per piece of a fixed public vocabulary. The probability of a word is
the sum over every way to cut it into pieces of the product of their probabilities (forward
algorithm). A text is lower-cased and cut at ASCII white space, and the words multiply.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.tables import fold, held_out, written

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
UNKNOWN = "und"

#: Pieces of more bytes are not used.
LONGEST = 16
#: Learned from about this many documents per language, those whose id hashes lowest.
SAMPLE = 3000
ROUNDS = 3
#: A stage that keeps documents with a language asks for this chance.
LEAST_CHANCE = 0.5
_ADDED = 1e-7
_CELLS = 1 << 18
_KNOWN = 1 << 20
_TOGETHER = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)


def vocabulary(path: str = VOCABULARY, longest: int = LONGEST) -> list[bytes]:
    """The pieces of up to ``longest`` bytes; every single byte is one."""
    with open(path, "rb") as f:
        pieces = {base64.b64decode(line.split()[0]) for line in f if line.strip()}
    return sorted({p for p in pieces if len(p) <= longest} | {bytes([b]) for b in range(256)})


class Pieces:
    """Finds the pieces that start at each place of many words at once."""

    def __init__(self, pieces: list[bytes]):
        hashes = np.empty(len(pieces), np.uint64)
        for i, piece in enumerate(pieces):
            h = 0
            for b in piece:
                h = (h * int(_BASE) + b + 1) % 2**64
            hashes[i] = h
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.count = len(pieces)
        self.longest = max(map(len, pieces))

    def at(self, cells: np.ndarray, lengths: np.ndarray) -> list[list[np.ndarray]]:
        """[start][length - 1] -> the piece of each word there, ``count`` where there is none."""
        width = cells.shape[1]
        found = []
        for start in range(width):
            h = np.zeros(len(cells), np.uint64)
            row = []
            for end in range(start, min(width, start + self.longest)):
                h = h * _BASE + cells[:, end] + np.uint64(1)
                place = np.minimum(np.searchsorted(self.hashes, h), self.count - 1)
                hit = (self.hashes[place] == h) & (end < lengths)
                row.append(np.where(hit, self.order[place], self.count))
            found.append(row)
        return found


def _batches(words: list[bytes]):
    """Words of similar length together: (their places, bytes as a matrix, lengths)."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    widths = np.maximum(8, 2 ** np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64))
    for width in np.unique(widths):
        places = np.flatnonzero(widths == width)
        step = max(1, _CELLS // int(width))
        for i in range(0, len(places), step):
            part = places[i : i + step]
            size = int(lengths[part].max())
            raw = b"".join(words[p].ljust(size, b"\0") for p in part)
            cells = np.frombuffer(raw, np.uint8).reshape(len(part), size).astype(np.uint64)
            yield part, cells, lengths[part]


def word_scores(words: list[bytes], pieces: Pieces, chances: np.ndarray) -> np.ndarray:
    """log P(word) for each language; ``chances``: a row per piece and one of zeros."""
    out = np.zeros((len(words), chances.shape[1]))
    for places, cells, lengths in _batches(words):
        found = pieces.at(cells, lengths)
        shape = (len(places), chances.shape[1])
        ahead = [np.ones(shape)] + [np.zeros(shape) for _ in range(pieces.longest)]
        scale = np.zeros(shape)
        for start in range(cells.shape[1]):
            here = ahead.pop(0)
            ahead.append(np.zeros(shape))
            for n, ids in enumerate(found[start]):
                ahead[n] += here * chances[ids]
            now = ahead[0]
            ends = lengths == start + 1
            out[places[ends]] = np.log(now[ends]) + scale[ends]
            if start % 8 == 7:
                top = np.maximum(now, 1e-300)
                for a in ahead:
                    a /= top
                scale += np.log(top)
    return out


def _expected(words, languages, counts, pieces: Pieces, chances: np.ndarray) -> np.ndarray:
    """Expected uses of each piece by language over all segmentations (forward, backward)."""
    total = np.zeros(chances.shape[1] * (pieces.count + 1))
    for places, cells, lengths in _batches(words):
        found = pieces.at(cells, lengths)
        own = languages[places]
        width, n = cells.shape[1], len(places)
        p = [[chances[ids, own] for ids in row] for row in found]
        forward = [np.zeros(n) for _ in range(width + 1)]
        forward[0] += 1
        for i in range(width):
            for k, chance in enumerate(p[i]):
                forward[i + k + 1] += forward[i] * chance
        backward = [(lengths == i).astype(float) for i in range(width + 1)]
        for i in reversed(range(width)):
            for k, chance in enumerate(p[i]):
                backward[i] += chance * backward[i + k + 1]
        weight = counts[places] / backward[0]
        uses, ids = [], []
        for i in range(width):
            for k, chance in enumerate(p[i]):
                uses.append(forward[i] * chance * backward[i + k + 1] * weight)
                ids.append(own * (pieces.count + 1) + found[i][k])
        total += np.bincount(np.concatenate(ids), np.concatenate(uses), len(total))
    return total.reshape(chances.shape[1], -1).T


@dataclass
class Model:
    languages: list[str]
    pieces: Pieces
    chances: np.ndarray


def _chances(uses: np.ndarray) -> np.ndarray:
    """Every piece keeps a small chance, so that no word is impossible."""
    share = uses[:-1] / np.maximum(uses[:-1].sum(axis=0), 1e-300)
    share = (share + _ADDED) / (share + _ADDED).sum(axis=0)
    return np.vstack([share, np.zeros((1, uses.shape[1]))])


def _words(text: str) -> list[bytes]:
    return [b" " + w for w in text.lower().encode("utf-8", "replace").split()]


def _word_counts(docs: DataFrame, languages: list[str], text_col: str) -> DataFrame:
    """(language, word, n) of the sample; words longer than 32 bytes count as several."""

    def run(batches):
        from collections import Counter

        for batch in batches:
            found = Counter()
            for language, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for word in _words(text or ""):
                    for i in range(0, len(word), 32):
                        found[language, word[i : i + 32]] += 1
            rows = list(found)
            columns = [pa.array([r[0] for r in rows], pa.string())]
            columns.append(pa.array([r[1] for r in rows], pa.binary()))
            columns.append(pa.array(list(found.values()), pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, ["language", "word", "n"])

    part = docs.select("language", text_col).mapInArrow(run, "language string, word binary, n long")
    number = F.create_map(*[F.lit(x) for i, v in enumerate(languages) for x in (v, i)])
    summed = part.groupBy("language", "word").agg(F.sum("n").alias("n"))
    return summed.select(number[F.col("language")].alias("language"), "word", "n")


def learn(
    docs: DataFrame,
    train: Column,
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
    path: str = VOCABULARY,
    sample: int = SAMPLE,
    rounds: int = ROUNDS,
) -> Model | None:
    """Piece probabilities per language by expectation maximisation, from a sample of about
    ``sample`` documents per language. None if no document has a language and a text."""
    usable = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    usable = usable.select(F.col(lang_col).alias("language"), F.col(id_col).alias("id"), text_col)
    sizes = dict(map(tuple, usable.groupBy("language").count().collect()))
    if not sizes:
        return None
    languages = sorted(sizes)
    below = F.create_map(
        *[F.lit(x) for v in languages for x in (v, min(1.0, sample / sizes[v]) * 2.0**32)]
    )
    chosen = F.pmod(F.xxhash64("id"), F.lit(2**32)) < below[F.col("language")]
    counts = written(_word_counts(usable.where(chosen), languages, text_col), "words")
    pieces = Pieces(vocabulary(path))
    chances = _chances(np.ones((pieces.count + 1, len(languages))))

    for _ in range(rounds):

        def run(batches, chances=chances):
            for batch in batches:
                own, n = (batch.column(i).to_numpy() for i in (0, 2))
                words = batch.column(1).to_pylist()
                uses = _expected(words, own.astype(np.int64), n, pieces, chances)
                piece, language = np.nonzero(uses)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (piece, language, uses[piece, language])],
                    ["piece", "language", "uses"],
                )

        found = counts.mapInArrow(run, "piece long, language long, uses double")
        uses = np.zeros_like(chances)
        for row in found.groupBy("piece", "language").agg(F.sum("uses").alias("uses")).collect():
            uses[row.piece, row.language] = round(row.uses, 6)
        uses[-1] = 0
        chances = _chances(uses)
    return Model(languages, pieces, chances)


class Scorer:
    """Sums of log-probabilities per text; words met before are looked up, up to a bound."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[bytes, int] = {}
        self.scores = np.zeros((0, len(model.languages)))

    def _of(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > _KNOWN:
            self.known, self.scores = {}, self.scores[:0]
        new = list(set(words).difference(self.known))
        if new:
            found = word_scores([b" " + w for w in new], self.model.pieces, self.model.chances)
            self.known.update(zip(new, range(len(self.scores), len(self.scores) + len(new)), strict=True))
            self.scores = np.vstack([self.scores, found])
        return self.scores[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))]

    def texts(self, texts: list[str | None]) -> np.ndarray:
        total = np.zeros((len(texts), len(self.model.languages)))
        words: list[bytes] = []
        owners: list[tuple[int, int]] = []

        def flush():
            if words:
                starts = np.array([s for _, s in owners])
                np.add.at(total, [o for o, _ in owners], np.add.reduceat(self._of(words), starts))
                words.clear()
                owners.clear()

        for i, text in enumerate(texts):
            own = text.lower().encode("utf-8", "replace").split() if text else []
            for start in range(0, len(own), _TOGETHER):
                owners.append((i, len(words)))
                words.extend(own[start : start + _TOGETHER])
                if len(words) >= _TOGETHER:
                    flush()
        flush()
        return total


def _scored(docs: DataFrame, model: Model | None, text_col: str, keep: list[str]) -> DataFrame:
    """Columns ``k0, k1, ...`` (those in ``keep``, or all if that includes the text), ``lang_pred``
    and ``score``."""
    columns = keep if text_col in keep else [*keep, text_col]
    names = [f"k{i}" for i in range(len(columns))]
    kinds = [docs.schema[c].dataType.simpleString() for c in columns]
    where = columns.index(text_col)

    def run(batches):
        scorer = Scorer(model) if model else None
        for batch in batches:
            texts = batch.column(where).to_pylist()
            found, chance = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if scorer:
                total = scorer.texts(texts)
                odds = np.exp(total - total.max(axis=1, keepdims=True))
                best = odds.argmax(axis=1)
                top = odds.max(axis=1) / odds.sum(axis=1)
                for i, text in enumerate(texts):
                    if text and any(map(str.isalpha, text)):
                        found[i], chance[i] = model.languages[best[i]], top[i]
            kept = batch.columns if returned == names else batch.columns[:-1]
            out = [*kept, pa.array(found, pa.string()), pa.array(chance)]
            yield pa.RecordBatch.from_arrays(out, [*returned, "lang_pred", "score"])

    returned = names[: len(keep)]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)])
    fields = [f"{n} {t}" for n, t in zip(returned, kinds, strict=False)]
    return rows.mapInArrow(run, ", ".join([*fields, "lang_pred string", "score double"]))


def _learned(docs: DataFrame) -> Model | None:
    train = F.coalesce(fold(F.col("doc_id")).isNotNull() & ~held_out(F.col("doc_id")), F.lit(False))
    return learn(docs, train)


def predict(docs: DataFrame, model: Model | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns in ``keep``, ``lang_pred`` and ``score``, the posterior chance of that language
    when all are equally likely before.

    ``und`` and 0 for a text that is NULL or has no letter, or when nothing was learned. Ties go to
    the language that sorts first. Rows, repeated ones too, stay as many as they are."""
    scored = _scored(docs, model, text_col, keep)
    return scored.withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})


def identify(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Learn from the documents outside the held-out fold that have a language, predict for all.
    Text alone decides a prediction."""
    return predict(docs, _learned(docs), keep)


def with_language(docs: DataFrame, least: float = LEAST_CHANCE) -> DataFrame:
    """The documents, with their own columns, whose language is known with a chance of ``least``."""
    scored = _scored(docs, _learned(docs), "text", docs.columns)
    sure = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)
    return scored.where(sure).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(docs.columns)])
