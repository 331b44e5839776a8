"""Phrases against a plain count of every phrase, and against the SQL."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from oracle import connect, differences
from pyspark.sql import functions as F

from ledgerlake.llm import phrases
from ledgerlake.llm.queries import ORACLE, QUERIES

#: Columns named like those that the operator makes.
DOCS = "doc_id long, text string, lang string, k int, phrase string, f long, n long, key long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, "p", 2, 3, 4) for i, (t, lang) in enumerate(rows)], DOCS)


def plain(rows, support, top, longest=5, absorbed=100):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = lang or "und"
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        frequent = {p: c for p, c in counts.items() if c >= support and len(p) > 1}
        gone = set()
        for p, c in frequent.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    q = p[i:j]
                    if len(q) < len(p) and 100 * c >= absorbed * counts[q]:
                        gone.add(q)
        scored = []
        for p, a in frequent.items():
            if p in gone:
                continue
            cuts = [
                (1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]])
                for k in range(1, len(p))
            ]
            score, _, left, right = min(cuts)
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def found(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def corpus():
    random.seed(7)
    words = [f"w{i}" for i in range(12)] + ["été", "\U0001f600", "New", "YORK", "a\x1fb", " x"]
    marks = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", " !", "\x0b", "?;"]
    rows = []
    for i in range(300):
        text = "".join(random.choice(words) + random.choice(marks) for _ in range(random.randrange(60)))
        rows.append((text, random.choice(["en", "de", None, "und", "en", "en"])))
    rows += [("New York city hall is closed. ", "en")] * 40 + [(None, "en"), ("", "fr"), (" \t.\n", "fr"), ("x", None)]
    return rows


@pytest.mark.parametrize(("support", "top", "absorbed"), [(5, 2000, 100), (12, 7, 100), (8, 50, 60)])
def test_phrases_as_counted_one_by_one(spark, support, top, absorbed):
    rows = corpus()
    got = phrases.collocations(documents(spark, rows).repartition(6), support=support, top=top, absorbed=absorbed)
    want = plain(rows, support, top, absorbed=absorbed)
    assert found(got) == want and len(want) >= 7


def test_small_shards_and_a_hot_language(spark):
    """Shards so small that their lowered support is one, and shards of several languages."""
    rows = corpus() + [("the same words again and again, the same words again " * 30, "en")] * 60
    docs = documents(spark, rows).repartition(5)
    want = plain(rows, 20, 100)
    for shard in (400, 20_000):
        assert found(phrases.collocations(docs, support=20, top=100, shard=shard)) == want


def test_a_long_text_is_cut_at_ends_of_pieces(spark):
    text = "one two three. four five\n" * 200_000
    assert len(text) > 2 * phrases._RUN
    assert b"".join(phrases._cut(text.encode())) == text.encode() and len(list(phrases._cut(text.encode()))) > 1
    unbroken = b"one two " * 800_000
    assert list(phrases._cut(unbroken)) == [unbroken]
    assert found(phrases.collocations(documents(spark, [(text, "en")]))) == plain([(text, "en")], 100, 2000)


def test_products_beyond_64_bits(spark):
    """Scores are exact where a n and l r pass 64 bits."""
    a, n, left, right = 3_000_000_000_007, 15_000_000_000_000_003, 3_000_000_000_100, 3_000_000_000_011
    row = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long")
    whole = {c: F.col(c).cast("decimal(19,0)") for c in row.columns}
    got = phrases.exact_score(**whole)
    assert row.select(got).first()[0] == 1000 * a * n // (left * right)
    assert Fraction(1000 * a * n, left * right) > 1


def test_the_table_of_candidates_forgets_none(spark):
    keys = np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 20_000)
    candidates = spark.createDataFrame([(int(k),) for k in keys], "key long")
    table = phrases._table(candidates)
    assert phrases._listed(table, keys.view(np.uint64)).all()
    others = np.random.default_rng(3).integers(-(2**63), 2**63 - 1, 20_000).view(np.uint64)
    assert phrases._listed(table, others).mean() < 0.05


def test_no_documents(spark):
    assert phrases.collocations(documents(spark, [("a b", "en")]).limit(0)).collect() == []
    assert phrases.collocations(documents(spark, [(None, None), ("", "en")])).collect() == []


def test_the_query_gives_what_its_sql_gives(spark):
    folder = "/root/testdata/sf0.01"
    got = QUERIES["op11_phrase_collocations"](spark, folder).toArrow()
    want = connect(folder).sql(ORACLE["op11_phrase_collocations"]).to_arrow_table()
    assert got.num_rows > 50 and differences(got, want) is None
