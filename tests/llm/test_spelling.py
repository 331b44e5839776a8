"""Spelling variants against comparing every two words."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from ledgerlake.llm import spelling
from ledgerlake.llm.queries import QUERIES

#: Columns named like those that the operator makes.
DOCS = "doc_id long, text string, word string, n long, form string, length int, gram string"


def documents(spark, rows):
    return spark.createDataFrame([(d, t, "w", 1, "f", 2, "g") for d, t in rows], DOCS)


def plain_counts(rows, damage=True):
    found = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if damage and h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return found


def neighbours(words):
    """Words one edit apart, by all variants with one code point out."""
    by_variant = defaultdict(set)
    for w in words:
        by_variant[w].add(w)
        for i in range(len(w)):
            by_variant[w[:i] + w[i + 1 :]].add(w)
    near = defaultdict(set)
    for met in by_variant.values():
        for a in met:
            for b in met:
                if a < b and one_edit(a, b):
                    near[a].add(b)
                    near[b].add(a)
    return near


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows, damage=True):
    n = {w: c for w, c in plain_counts(rows, damage).items() if len(w) >= 5 and c >= 3}
    near, form = neighbours(n), {}
    for w in n:
        best = min(near[w], key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def found(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def corpus(seed=4, alphabet="abcé÷", size=1500):
    random.seed(seed)
    words = ["".join(random.choices(alphabet, k=random.randrange(4, 9))) for _ in range(size)]
    rows = [(i, " ".join(random.choices(words, k=random.randrange(60)))) for i in range(400)]
    rows += [(1000 + i, " ".join([w.upper()] * (1 + i % 40))) for i, w in enumerate(words[:200])]
    return [*rows, (None, "lonely lonely lonely loneli loneli loneli"), (7, None), (8, ""), (9, "1 2-3 中É"), *rows[:3]]


@pytest.mark.parametrize("paired", [0, 30, spelling.PAIRED])
def test_every_pair_is_found_however_long_the_lists(spark, paired):
    n = {w: c for w, c in plain_counts(corpus()).items() if len(w) >= 5}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    near = neighbours(n)
    want = sorted((a, b) for a in near for b in near[a] if (len(a), a) < (len(b), b))
    got = spelling.near_pairs(words, paired=paired).collect()
    assert sorted((r.left, r.right) for r in got) == want and len(want) > 500
    assert all((r.left_n, r.right_n) == (n[r.left], n[r.right]) for r in got)


def test_forms_and_roots(spark):
    rows = corpus()
    want = plain(rows)
    assert found(spelling.variants(documents(spark, rows).repartition(4))) == want
    assert any(r[1] and r[2] != r[1] for r in want)


def test_a_long_chain_of_forms_and_ties(spark):
    chain = ["aaaaaaaa"[:i] + "bbbbbbbb"[i:] for i in range(9)]
    rows = [(1, " ".join([w] * (3 * 2**i))) for i, w in enumerate(chain)]
    rows += [(2, "tieda tieda tieda tieda tieda tieda tiedb tiedb tiedb tiedb tiedb tiedb tiedc tiedc tiedc")]
    got = {r.word: r for r in spelling.variants(documents(spark, rows), damage=False).collect()}
    assert {got[w].root for w in chain} == {"aaaaaaaa"} and got["bbbbbbbb"].form == "abbbbbbb"
    assert (got["tiedc"].form, got["tiedc"].n_near, got["tieda"].form) == ("tieda", 2, None)


def test_a_long_text_and_slices(spark):
    text = "wordy words WORDs " * 400_000
    assert b"".join(spelling._slices(text.encode())) == text.encode() and len(list(spelling._slices(text.encode()))) > 1
    assert found(spelling.variants(documents(spark, [(3, text)]))) == plain([(3, text)])


def test_nothing_to_find(spark):
    assert spelling.variants(documents(spark, [(1, "a")]).limit(0)).collect() == []
    assert spelling.variants(documents(spark, [(1, None), (None, " "), (2, "once word")])).collect() == []


def test_the_query_on_given_documents(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = QUERIES["op13_spelling_variants"](spark, folder)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert found(got) == plain(rows)
