"""Mixing sources to target weights by soft membership. DataFrame functions only.

A classifier learned from labelled documents gives every document a chance per domain. Rates (how
often a document is to be used) are fitted so that the expected tokens per domain meet the targets:
nonnegative least squares over all rates by projected gradient steps. One step is one sum over the
documents per domain; a document's rate follows from the steps' few numbers and its own chances, so
no rate is ever stored, moved or joined.
"""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm import hashed
from ledgerlake.llm.tables import written
from ledgerlake.llm.telling import Telling, has_any, telling_words

log = logging.getLogger(__name__)

#: Domains as the labels tell them.
DOMAINS = {
    "good": "quality = 1 AND toxic = 0",
    "low": "quality = 0 AND toxic = 0",
    "toxic": "toxic = 1",
}
#: Shares of the tokens after mixing.
TARGETS = {"good": 0.85, "low": 0.10, "toxic": 0.05}
#: Learned from at most this many labelled documents per domain.
SAMPLE = 3000
#: Choice of the telling words, see `telling`.
DEVIATIONS, CONTEXTS = 4.0, 5
STEPS = 40
TOLERANCE = 1e-6
#: Directions in which documents hardly differ (eigenvalues of the Gram matrix below this share of the
#: largest) are left out: no rates of a sensible size reach a target along them.
_FLAT = 1e-4
_MISSED = 1e-3


@dataclass
class Classifier:
    """``words``: what they tell of the domains; ``priors``: log chance of each domain."""

    words: Telling
    priors: dict[str, float]


def learn(docs: DataFrame, labels: DataFrame, domains: dict[str, str], sample: int = SAMPLE) -> Classifier:
    """Naive Bayes on the telling words that a document has. A domain without labels keeps a small
    prior."""
    ids = None
    sizes = {}
    for name, rule in domains.items():
        sizes[name] = labels.where(rule).count()
        own = hashed.labelled(labels, F.expr(rule), sample).withColumn("class", F.lit(name))
        ids = own if ids is None else ids.unionByName(own)
    total = sum(sizes.values()) + len(sizes)
    found = telling_words(docs, ids, list(domains), deviations=DEVIATIONS, least_contexts=CONTEXTS)
    return Classifier(found, {n: math.log((sizes[n] + 1) / total) for n in domains})


def memberships(docs: DataFrame, found: Classifier, keep: list[str]) -> DataFrame:
    """Columns ``k0, k1, ...`` (those in ``keep``), ``n_tokens`` and ``p``, a chance per domain."""
    named = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col("text").alias("t"))
    cut = named.select("*", hashed.words(F.col("t")).alias("w"))
    odds = found.words.odds
    listed = sorted(odds)
    told = F.array_distinct(F.filter("w", lambda w: w.isin(listed))) if listed else F.slice("w", 1, 0)
    ready = cut.select("*", told.alias("f"))

    def log_odds(place: int, prior: float) -> Column:
        start = F.lit(prior)
        for marks, lacking in found.words.marks:
            start = start + F.when(has_any("f", marks), 0.0).otherwise(lacking[place])
        if not listed:
            return start
        table = F.create_map(*[F.lit(x) for w in listed for x in (w, odds[w][place])])
        return F.aggregate("f", start, lambda a, w: a + F.element_at(table, w))

    logs = [log_odds(i, p) for i, p in enumerate(found.priors.values())]
    logged = ready.select("*", F.size("w").cast("long").alias("n_tokens"), F.array(*logs).alias("l"))
    scaled = logged.withColumn("o", F.transform("l", lambda x: F.exp(x - F.array_max("l"))))
    total = F.aggregate("o", F.lit(0.0), lambda a, x: a + x)
    chances = scaled.withColumn("s", total).withColumn("p", F.transform("o", lambda x: x / F.col("s")))
    return chances.select(*named.columns[:-1], "n_tokens", "p")


def _pseudo_inverse(matrix: list[list[float]]) -> np.ndarray:
    """Of a Gram matrix with a row per domain, without its flat directions."""
    values, directions = np.linalg.eigh(np.array(matrix))
    steep = values > _FLAT * max(values.max(), 1e-300)
    return (directions[:, steep] / values[steep]) @ directions[:, steep].T


def _rate(steps: list[list[float]]) -> Column:
    """The rate after all steps; the expression does not grow with their number."""
    if not steps:
        return F.lit(1.0)

    def after(rate: Column, step: Column) -> Column:
        pull = sum((F.get("p", F.lit(d)) * F.get(step, F.lit(d)) for d in range(len(steps[0]))), F.lit(0.0))
        return F.greatest(F.lit(0.0), rate - pull)

    return F.aggregate(F.array(*[F.array(*map(F.lit, step)) for step in steps]), F.lit(1.0), after)


def fit(members: DataFrame, targets: list[float], most: int = STEPS, close: float = TOLERANCE):
    """Steps of the descent from rate 1, each a number per domain, and the largest distance of a
    domain's expected share from its target after them.

    With n tokens and chances p of a document, the sums are A r = sum(n p r) / N and the Gram matrix
    G = sum(n p p') / N. A step takes p' G+ (A r - t) from each rate and lifts negative ones to zero, G+
    the pseudo-inverse: the gradient of the residual's square in the norm of G+, documents weighted by
    their tokens, for which step length 1 is the inverse of the Lipschitz constant. So the square never
    grows, however alike the chances of two domains are; the descent ends when it hardly shrinks.
    Documents of equal chances have equal rates, so the steps read one row for all of them."""
    size = range(len(targets))
    p = [F.get("p", F.lit(d)) for d in size]
    members = written(members.groupBy("p").agg(F.sum("n_tokens").alias("n_tokens")), "chances")
    gram = [F.sum(F.col("n_tokens") * p[i] * p[j]) for i in size for j in size if j <= i]
    first = members.agg(F.sum("n_tokens"), *gram).first()
    tokens = first[0] or 0
    if not tokens:
        return [], 0.0
    flat = iter([x / tokens for x in first[1:]])
    lower = {(i, j): next(flat) for i in size for j in size if j <= i}
    inverse = _pseudo_inverse([[lower[max(i, j), min(i, j)] for j in size] for i in size])
    steps: list[list[float]] = []
    before = math.inf
    while True:
        rate = _rate(steps)
        now = members.agg(*[F.sum(F.col("n_tokens") * p[d] * rate) for d in size]).first()
        off = np.array([x / tokens - t for x, t in zip(now, targets, strict=True)])
        square = float(off @ inverse @ off)
        if np.abs(off).max() <= close or square > 0.999 * before or len(steps) == most:
            break
        before = square
        steps.append([round(float(x), 12) for x in inverse @ off])
    return steps, float(np.abs(off).max())


def mix(
    docs: DataFrame,
    labels: DataFrame,
    keep: list[str],
    domains: dict[str, str] | None = None,
    targets: dict[str, float] | None = None,
    sample: int = SAMPLE,
) -> DataFrame:
    """The columns in ``keep``, ``n_tokens``, ``p_<domain>``, ``rate`` and ``residual`` per row.

    Targets are shares of all tokens; they are scaled to add up to one. A NULL or empty text has no
    tokens and the chances of the priors. Without any token every rate is 1. Where no nonnegative rates meet
    the targets, as where the labels tell too little of the domains, they are met as nearly as least
    squares can; ``residual``, the same in every row, is the largest distance that is left, and it is
    logged. Repeated rows each have their rate. A column in ``keep`` named like a result gives way to it."""
    domains = domains or DOMAINS
    keep = [c for c in keep if c not in ("n_tokens", "rate", "residual", *(f"p_{n}" for n in domains))]
    targets = targets or TARGETS
    whole = sum(targets.values())
    found = learn(docs, labels, domains, sample)
    members = written(memberships(docs, found, keep), "members")
    steps, residual = fit(members, [targets[n] / whole for n in domains])
    if residual > _MISSED:
        log.warning("mixing: a domain's share is %.4f off its target", residual)
    return members.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)],
        "n_tokens",
        *[F.round(F.get("p", F.lit(d)), 9).alias(f"p_{n}") for d, n in enumerate(domains)],
        F.round(_rate(steps), 9).alias("rate"),
        F.lit(round(residual, 9)).alias("residual"),
    )


def sampled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents to be used, with their rate and ``copies``: the whole part of the rate, and one
    more with the chance of the rest, by a hash that is the same on every run."""
    rated = mix(docs, labels, [c for c in docs.columns if c != "copies"])
    draw = F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 30)) / float(1 << 30)
    more = F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return rated.withColumn("copies", (F.floor("rate") + more).cast("long")).where("copies > 0")
