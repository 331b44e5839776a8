"""Token ids against the library on whole texts, round trips, and what a reader leaves out."""

import glob
import os
import zlib
from array import array

import pytest
from pyarrow import orc
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlake.llm import tokens
from ledgerlake.llm.queries import QUERIES

#: Columns named like those that the operator makes.
DOCS = "doc_id long, text string, id long, shard int, place long, ids array<int>, start long"
ODD = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\n\n a\n", "don't  we'll  I'm", "x   y", "tab\t one",
    "<|endoftext|> in <|endoftext|>text", "a <|endoftext|>", " wide   blanks ", "\U0001f600 \U0001f600‍",
    "w.\nNext, (in) x's. 'q' e-f é.É a;\n\nb a.\n\n b <a> to.<|endoftext|> c", "12 345  6", "\x1c x \x1f y", "\u0085 next", "été 中文 中", "!!  ?? ..", " 's 's", "\r\n \r\n",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.vocabulary_file())


@pytest.fixture(scope="module")
def encoder():
    with open(tokens.vocabulary_file(), encoding="utf-8") as file:
        return tokens.Encoder(file.read())


def plain(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_ids_are_those_of_the_whole_text(library, encoder, monkeypatch):
    assert encoder.cuttable
    whole = " \n".join(ODD) + "  ".join(ODD) + " ".join(ODD)
    texts = [*ODD, whole, None, " ".join(f"w{i}. x{i}" for i in range(3000)), whole]
    want = [plain(library, text) for text in texts]
    for step, known in ((1, 10), (7, 0), (tokens._STEP, tokens._KNOWN), (50, 2000)):
        monkeypatch.setattr(tokens, "_STEP", step)
        monkeypatch.setattr(tokens, "_KNOWN", known)
        assert [array("I", ids).tolist() for ids in encoder.encode(texts)] == want
        assert [array("I", encoder.encode([text])[0]).tolist() for text in texts] == want


def test_a_part_is_looked_at_and_looked_up_once_per_run(library, monkeypatch):
    with open(tokens.vocabulary_file(), encoding="utf-8") as file:
        encoder = tokens.Encoder(file.read())
    seen, plain_match = [], tokens.pc.match_substring_regex

    def watched(parts, pattern):
        seen.append(len(parts))
        return plain_match(parts, pattern)

    class Counted(dict):
        asked = 0

        def get(self, key):
            self.asked += 1
            return super().get(key)

        def __getitem__(self, key):
            self.asked += 1
            return super().__getitem__(key)

        def __contains__(self, key):
            self.asked += 1
            return super().__contains__(key)

    monkeypatch.setattr(tokens.pc, "match_substring_regex", watched)
    encoder.known = Counted()
    text = "x " + " ".join(["some words, here"] * 5_000)
    assert array("I", encoder.encode([text])[0]).tolist() == plain(library, text)
    assert sum(seen) < 10 and encoder.known.asked == 3


def test_new_words_cost_the_library_one_blank_each(library):
    with open(tokens.vocabulary_file(), encoding="utf-8") as file:
        encoder = tokens.Encoder(file.read())
    handed = []

    class Watched:
        def encode_batch_fast(self, texts, **options):
            handed.extend(texts)
            return library.encode_batch_fast(texts, **options)

    encoder.library = Watched()
    words = [a + b + c for a in "xyzé" for b in "aeiouñ" for c in ("", "ing", "tion", "ß")]
    text = " ".join(["first", *words, "1.5", *words])
    for _ in range(2):
        assert array("I", encoder.encode([text])[0]).tolist() == plain(library, text)
    assert sum(map(len, handed)) == 2 * len("first") + sum(len(" " + w) for w in [*words, "1.5"])


def test_a_vocabulary_that_cannot_be_cut_gets_whole_texts():
    with open(tokens.vocabulary_file("word_bpe_49k.json"), encoding="utf-8") as file:
        definition = file.read()
    encoder, own = tokens.Encoder(definition), Tokenizer.from_str(definition)
    assert not encoder.cuttable
    for text in ("Two  words", " a b", ""):
        assert array("I", encoder.encode([text])[0]).tolist() == own.encode(text, add_special_tokens=False).ids


def documents(spark, rows):
    return spark.createDataFrame([(d, t, 9, 9, 9, [9], 9) for d, t in rows], DOCS)


def test_round_trip_of_odd_rows(spark, library, folder):
    rows = [(i * 3, t) for i, t in enumerate(ODD)] + [(None, "none"), (5, None), (7, "same"), (7, "same")]
    rows += [(8, "long " * 50_000), (2**40, "last")]
    tokens.write(documents(spark, rows).repartition(5), folder + "/t", shard=4_000)
    got = tokens.read(spark, folder + "/t").orderBy("start").collect()
    assert [r.id for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d))
    want = sorted((d or -1, plain(library, t) + [tokens.END]) for d, t in rows)
    assert sorted((r.id or -1, r.ids) for r in got) == want
    before = 0
    for r in got:
        assert (r.start, r.n_tokens) == (before, len(r.ids))
        before += r.n_tokens
    sums = {(r.start, r.n_tokens, r.ids_crc32) for r in tokens.digests(tokens.read(spark, folder + "/t")).collect()}
    assert sums == {(r.start, r.n_tokens, zlib.crc32(array("I", r.ids).tobytes())) for r in got}


def test_files_have_stripes_and_a_reader_skips_what_it_can(spark, folder):
    varied = F.concat_ws(" ", *[F.xxhash64("id", F.lit(i)) for i in range(12)])
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), varied.alias("text"))
    path = folder + "/t"
    tokens.write(docs, path, shard=2 << 20, stripe=1 << 18)
    files = sorted(glob.glob(f"{path}/ids/*.orc"))
    held = [orc.ORCFile(f) for f in files]
    assert len(files) > 1 and max(h.nstripes for h in held) > 1
    highest = -1
    for h in held:
        own = h.read(["id"]).column(0).to_pylist()
        assert own == sorted(own) and own[0] > highest
        highest = own[-1]
    one = tokens.lookup(spark, path, [31_234])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "EqualTo(id,31234)" in plan or "In(id" in plan
    assert [r.id for r in one.collect()] == [31_234]
    assert sorted(r.id for r in tokens.lookup(spark, path, [5, 39_999, 50_000]).collect()) == [5, 39_999]
    # Tasks are dealt stripes, not files.
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(max(map(os.path.getsize, files)) // 3))
    try:
        parts = spark.read.orc(f"{path}/ids").select(F.spark_partition_id().alias("p"), "shard").distinct()
        assert parts.count() > len(files)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_python_is_handed_few_bytes_at_a_time(spark, folder, monkeypatch):
    docs = spark.range(4_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 200).alias("text"))
    seen, kind = spark.sparkContext.accumulator(0), type(docs)
    plain_run = kind.mapInArrow

    def watched(self, run, schema):
        def counted(batches):
            def each():
                for batch in batches:
                    seen.add(batch.nbytes > 2 * tokens._BATCH)
                    yield batch

            yield from run(each())

        return plain_run(self, counted, schema)

    monkeypatch.setattr(kind, "mapInArrow", watched)
    before = spark.conf.get(tokens._BATCH_BYTES)
    tokens.write(docs.coalesce(1), folder + "/t")
    assert tokens.write_digests(spark, folder + "/t").count() == 4_000
    assert seen.value == 0
    assert spark.conf.get(tokens._BATCH_BYTES) == before


def test_no_documents(spark, folder):
    tokens.write(documents(spark, [(1, "a")]).limit(0), folder + "/t")
    assert tokens.digests(tokens.read(spark, folder + "/t")).collect() == []
    tokens.write(documents(spark, [(1, None), (2, "")]), folder + "/u", end=None)
    assert [(r.start, r.ids) for r in tokens.read(spark, folder + "/u").collect()] == [(0, []), (0, [])]


def test_the_query_on_given_documents(spark, library):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    before, want = 0, []
    for doc in sorted(texts):
        ids = plain(library, texts[doc]) + [2]
        want.append((doc, before, len(ids), zlib.crc32(array("I", ids).tobytes())))
        before += len(ids)
    got = QUERIES["op12_token_ids"](spark, folder)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect())) == want
