"""Fingerprints and groups against a plain reading of the definition."""

import random

import pytest
import xxhash

from ledgerlake.llm import simhash
from ledgerlake.llm.components import connected_components

SCHEMA = "doc_id long, text string, fp string, id long, component_id long"


def plain_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    words = [w for w in lowered.split(" ") if w]
    if not words:
        return 0
    n = min(3, len(words))
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """rows: (id, fingerprint)."""
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 2:
                parent[find(i)] = find(j)
    out = []
    for i, (doc, fp) in enumerate(rows):
        ids = [r[0] for j, r in enumerate(rows) if find(j) == find(i) and r[0] is not None]
        out.append((doc, f"{fp:016x}", min(ids, default=None)))
    return sorted(out, key=str)


def texts(seed):
    random.seed(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    out = []
    for _ in range(25):
        words = random.choices(vocabulary, k=random.choice([1, 2, 3, 60, 250]))
        out.append(" ".join(words))
        for _ in range(random.randrange(4)):
            copy = list(words)
            copy[random.randrange(len(copy))] = "Changed"
            out.append("\t ".join(copy))
    return out + ["", None, " \n", "A b", "a\xa0B ", "É é", out[0]]


@pytest.mark.parametrize("text", texts(1) + ["x " * 70_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) % 2**64 == plain_fingerprint(text)


@pytest.mark.parametrize("paired", [simhash.PAIRED, 1])
def test_links_lose_no_component(spark, paired):
    random.seed(7)
    prints = {0, 1, 3, 2**63, 2**63 + 2**31, 2**64 - 1}
    for _ in range(60):
        base = random.getrandbits(64)
        prints.add(base)
        for _ in range(5):
            flips = [random.randrange(64) for _ in range(random.choice([1, 2, 2, 3]))]
            for f in flips:
                base ^= 1 << f
            prints.add(base)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    found = simhash.links(df, paired).collect()
    assert all(((a ^ b) % 2**64).bit_count() <= 2 for a, b in found)
    got = connected_components(simhash.links(df, paired), "left", "right").collect()
    groups = {}
    for node, root in got:
        groups.setdefault(root, set()).add(node % 2**64)
    want = {}
    for doc, _, root in plain_components([(p, p) for p in sorted(prints)]):
        want.setdefault(root, set()).add(doc)
    assert sorted(map(sorted, groups.values())) == sorted(
        sorted(g) for g in want.values() if len(g) > 1
    )


def test_every_row_has_its_component(spark):
    rows = [(i * 3, t) for i, t in enumerate(texts(2))]
    rows += [(None, rows[0][1]), (None, "only here once"), rows[4], (9, "another text of nine")]
    df = spark.createDataFrame([(d, t, "x", 1, 2) for d, t in rows], SCHEMA)
    got = simhash.near_duplicates(df)
    assert got.columns == ["id", "fingerprint", "component_id"]
    want = plain_components([(d, plain_fingerprint(t)) for d, t in rows])
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(df).collect() == []
    assert simhash.keep_one_per_component(df).columns == df.columns


def test_one_document_of_each_group_stays(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(5, base), (3, base.upper()), (8, "alone"), (8, "alone"), (None, base), (None, base)]
    df = spark.createDataFrame([(d, t, "x", 1, 2) for d, t in rows], SCHEMA)
    kept = simhash.keep_one_per_component(df)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(3, base.upper()), (8, "alone"), (None, base)], key=str)


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 50)]
    odd = [(5, 5), (None, 3), (7, None), (200, 3)]
    edges = spark.createDataFrame(path + star + odd, "a long, b long")
    got = dict(map(tuple, connected_components(edges, "a", "b").collect()))
    assert got == {i: 0 for i in range(201)} | {i: 1000 for i in range(1000, 1050)}
