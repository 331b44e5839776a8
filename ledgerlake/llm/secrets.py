"""Secret scans with linking of the parts of a credential. DataFrame functions only.

Strong parts stand by themselves. Weak ones (an account name, a token of mixed characters, an
address) are everywhere, so they are reported only where complementary parts lie within ``SCOPE``
characters: a name needs a secret, a secret needs a name, an address needs both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.tables import written

#: Characters between two parts of one credential.
SCOPE = 200


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _assigned(names: list[str], value: str) -> str:
    either = "|".join(map(_any_case, names))
    return rf"({either})[\"']?\x20*[:=]\x20*[\"']?({value})"


#: The kinds of strong parts with their pattern, and how many characters a match (of
#: `assign`: its value) must have.
BASE = {
    "assign": (
        _assigned(["password", "passwd", "secret", "token", "api_?key"], "[A-Za-z0-9+/_.=-]+"),
        12,
    ),
    "access": ("AKIA[A-Z0-9]+", 18),
    "hex": ("[0-9a-f]+", 16),
}
#: Weak parts: names of accounts, tokens with a capital, a small letter and a digit, addresses.
WEAK = {
    "name": (
        _assigned(["user_?name", "user", "login", "account", "client_?id", "key_?id"], "[A-Za-z0-9@._-]+"),
        3,
    ),
    "mixed": ("[A-Za-z0-9+/]+", 20),
    "address": (r"[a-z][a-z0-9+.-]{1,15}://[^\x20\x09-\x0D\"'<>]+", 0),
}
KINDS = [*BASE, *WEAK]
NAMES = ["access", "name"]
SECRETS = ["assign", "hex", "mixed"]
SPAN_TYPE = "array<struct<start:int,rank:int,end:int>>"


def _rank(kind: str) -> int:
    return KINDS.index(kind)


def row_key(id_col: str, text_col: str) -> Column:
    """Rows with equal id and text share a key, and have the same parts."""
    number = F.coalesce(F.col(id_col).cast("string"), F.lit("-"))
    return F.concat_ws(":", number, F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))


def _matches(kind: str) -> Column:
    """The matches of a kind in ``text``, and the stretches before, between and after them. Runs of
    one character class that are too short are not matched at all: none of them holds a longer
    one, so the others stay the same."""
    pattern, least = (BASE | WEAK)[kind]
    if kind in ("hex", "mixed"):
        pattern = pattern.removesuffix("+") + f"{{{least},}}"
    hits = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all("text", F.lit(pattern), F.lit(2)) if "(" in pattern else hits
    gaps = F.split("text", pattern, -1)
    found = F.transform(
        F.arrays_zip(hits.alias("hit"), value.alias("value"), F.slice(gaps, 1, F.size(hits)).alias("gap")),
        lambda m: F.struct(
            F.length(m["gap"]).alias("before"),
            F.length(m["hit"]).alias("size"),
            (F.length(m["value"]) >= least).alias("fits"),
            (
                m["value"].rlike("[A-Z]") & m["value"].rlike("[a-z]") & m["value"].rlike("[0-9]")
                if kind == "mixed"
                else F.lit(True)
            ).alias("varied"),
        ),
    )
    some = F.col("text").rlike(pattern)
    return F.when(some, F.struct(F.lit(_rank(kind)).alias("rank"), found.alias("found")))


def parts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``key``, ``rank`` (place in ``KINDS``), ``start``, ``end`` of every part, weak ones too.

    A match begins where the matches and stretches before it end: a running sum over the row's
    matches of one kind."""
    texts = docs.select(row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    # the outer form keeps the planner from matching twice, to leave out rows without a match
    kinds = texts.select("key", F.explode_outer(F.array(*map(_matches, KINDS))).alias("k"))
    hits = kinds.where("k IS NOT NULL").select("key", "k.rank", F.posexplode("k.found").alias("pos", "m"))
    hits = hits.select("key", "rank", "pos", "m.*").repartition("key")
    hits = hits.dropDuplicates(["key", "rank", "pos"])
    so_far = Window.partitionBy("key", "rank").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("before") + F.col("size")).over(so_far)
    placed = hits.withColumn("end", end.cast("int")).where("fits and varied")
    return placed.select("key", "rank", (F.col("end") - F.col("size")).alias("start"), "end")


def _is(kinds: list[str]) -> Column:
    return F.col("rank").isin([_rank(k) for k in kinds])


def _buckets(start: Column, end: Column, scope: int) -> Column:
    return F.explode(F.sequence(F.floor(start / scope), F.floor(end / scope)))


def _near(these: DataFrame, others: DataFrame, scope: int) -> DataFrame:
    """Those of ``these`` with one of ``others`` in the same row at most ``scope`` characters off.

    Interval join: both sides are listed under the stretches of ``scope`` characters they touch,
    the other side widened by ``scope``; rows of ``these`` are found once or not at all."""
    left = these.withColumn("bucket", _buckets(F.col("start"), F.col("end"), scope))
    wide = others.select(
        "key",
        F.col("start").alias("from"),
        F.col("end").alias("to"),
        _buckets(F.col("start") - scope, F.col("end") + scope, scope).alias("bucket"),
    )
    meets = (
        (left.key == wide.key)
        & (left.bucket == wide.bucket)
        & (left.start <= wide["to"] + scope)
        & (wide["from"] <= left.end + scope)
    )
    return left.join(wide, meets, "left_semi").drop("bucket").distinct()


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The strong parts, and the weak ones that complementary parts support."""
    names, secrets = found.where(_is(NAMES)), found.where(_is(SECRETS))
    addresses = found.where(_is(["address"]))
    weak = [
        _near(names.where(_is(["name"])), secrets, scope),
        _near(secrets.where(_is(["mixed"])), names, scope),
        _near(_near(addresses, names, scope), secrets, scope),
    ]
    out = found.where(_is(list(BASE)))
    for more in weak:
        out = out.unionByName(more)
    return out


def scan(docs: DataFrame, id_col: str, text_col: str, scope: int = SCOPE) -> DataFrame:
    """``key`` (see `row_key`) and ``found``: the reported spans (start, rank, end) in order, for
    rows that have any. Places count characters; the end is exclusive."""
    spans = linked(written(parts(docs, id_col, text_col), "parts"), scope)
    span = F.struct("start", "rank", "end")
    return spans.groupBy("key").agg(F.sort_array(F.collect_list(span)).alias("found"))


def _spelled(found: Column) -> Column:
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(
            found,
            lambda s: F.concat_ws(":", F.get(kind, s["rank"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id``, ``n_<kind>`` of each strong kind, ``base_sha256`` of the strong spans and
    ``spans``, all of them.

    A NULL text is empty and holds nothing; rows, repeated ones too, stay as many as they are."""
    found = scan(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("key"))
    all_spans = F.coalesce("found", F.array().cast(SPAN_TYPE))
    met = rows.join(found, "key", "left").select("id", all_spans.alias("found"))
    base = F.filter("found", lambda s: s["rank"] < len(BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["rank"] == _rank(kind))).cast("long")

    counts = [count(k).alias(f"n_{k}") for k in BASE]
    digest = F.sha2(_spelled(base).cast("binary"), 256).alias("base_sha256")
    return met.select("id", *counts, digest, _spelled(F.col("found")).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The documents with every reported span replaced by ``mark``; overlapping ones by one mark."""
    found = scan(docs, id_col, text_col).select(F.col("key").alias("_key"), F.col("found").alias("_found"))
    merged = F.aggregate(
        "_found",
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda out, s: F.when(
            (F.size(out) > 0) & (F.element_at(out, -1)["end"] > s["start"]),
            F.concat(
                F.slice(out, 1, F.size(out) - 1),
                F.array(
                    F.struct(
                        F.element_at(out, -1)["start"].alias("start"),
                        F.greatest(F.element_at(out, -1)["end"], s["end"]).alias("end"),
                    )
                ),
            ),
        ).otherwise(F.concat(out, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))),
    )
    spans = found.select("_key", merged.alias("_spans"))
    text = F.col(text_col)
    before = F.transform(
        "_spans",
        lambda s, i: F.substring(
            text,
            F.when(i == 0, 1).otherwise(F.get("_spans", i - 1)["end"] + 1),
            s["start"] - F.when(i == 0, 0).otherwise(F.get("_spans", i - 1)["end"]),
        ),
    )
    last = F.element_at("_spans", -1)["end"]
    rest = F.substring(text, last + 1, F.length(text))
    clean = F.concat(F.array_join(F.transform(before, lambda t: F.concat(t, F.lit(mark))), ""), rest)
    met = docs.withColumn("_key", row_key(id_col, text_col)).join(spans, "_key", "left")
    columns = [
        F.when(F.col("_spans").isNotNull(), clean).otherwise(text).alias(c) if c == text_col else F.col(c)
        for c in docs.columns
    ]
    return met.select(*columns)
