"""The operators over the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm import (
    decontaminate,
    language,
    mixing,
    phrases,
    quality,
    secrets,
    spelling,
    suffixes,
    tokens,
    toxicity,
    urls,
    warc,
)
from ledgerlake.llm.simhash import near_duplicates
from ledgerlake.llm.tables import given, held_out
from ledgerlake.sources.scratch import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return register


@query("op1_simhash_near_duplicates")
def _(spark, folder):
    return near_duplicates(given(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


@query("op5_benchmark_leaks")
def _(spark, folder):
    docs, items = given(spark, folder, "documents"), given(spark, folder, "benchmark")
    return decontaminate.leaks(docs, items).withColumnRenamed("id", "doc_id")


@query("op6_language")
def _(spark, folder):
    found = language.identify(given(spark, folder, "documents"), keep=["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op2_toxicity")
def _(spark, folder):
    docs = given(spark, folder, "documents")
    model = toxicity.learn(docs, given(spark, folder, "labels"))
    return toxicity.score(docs, model).withColumnRenamed("id", "doc_id")


@query("op3_quality_rules")
def _(spark, folder):
    docs, labels = given(spark, folder, "documents"), given(spark, folder, "labels")
    return quality.judge(docs, labels).withColumnRenamed("id", "doc_id")


@query("op7_mixing")
def _(spark, folder):
    docs, labels = given(spark, folder, "documents"), given(spark, folder, "labels")
    return mixing.mix(docs, labels, keep=["doc_id"])


@query("op10_secrets")
def _(spark, folder):
    return secrets.report(given(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


@query("op4_url_filters", urls.SQL)
def _(spark, folder):
    pages, labels = given(spark, folder, "pages"), given(spark, folder, "labels")
    return urls.judge(pages, labels).withColumnRenamed("id", "page_id")


@query("op8_repeated_strings")
def _(spark, folder):
    left = suffixes.without_repeats(given(spark, folder, "documents"))
    return left.select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


@query("op9_warc", warc.SQL)
def _(spark, folder):
    return warc.round_trip(given(spark, folder, "pages")).withColumnRenamed("id", "page_id")


@query("op11_phrase_collocations", phrases.SQL)
def _(spark, folder):
    return phrases.collocations(given(spark, folder, "documents"))


@query("op12_token_ids")
def _(spark, folder):
    path = new_folder(spark, "tokens")
    tokens.write(given(spark, folder, "documents"), path)
    return tokens.write_digests(spark, path).withColumnRenamed("id", "doc_id")


@query("op13_spelling_variants")
def _(spark, folder):
    return spelling.variants(given(spark, folder, "documents"))
