"""URL filters: given rules, and association rules mined from labels.

Each url is a set of tokens (scheme, host labels, path segments, query keys). FP-growth finds the
sets of tokens that are frequent among labelled pages; those that mostly come with a bad label block
a url. A mined rule is listed under its rarest token, so a url is compared with few rules.
"""

from __future__ import annotations

import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.tables import written

#: Verdict, host, path.
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
#: A mined rule holds for this many bad pages and this share. One of more than ``TOKENS`` tokens is
#: kept if no shorter rule is part of it.
TOKENS = 2
SUPPORT = 30
CONFIDENCE = 0.75
_BAD, _GOOD = "bad", "good"


def host(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def given_rule(host_col: Column, path_col: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits; NULL if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, name, start in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host_col == name) | host_col.endswith(f".{name}")) & path_col.startswith(start)
        rule = F.when(fits, f"{name}{start}").otherwise(rule)
        verdict = F.when(fits, what).otherwise(verdict)
    return rule, verdict


def tokens(url: Column) -> Column:
    """Different tokens of a url; digits count as one sign."""

    def named(kind: str, parts: Column) -> Column:
        return F.transform(F.array_remove(parts, ""), lambda p: F.concat(F.lit(f"{kind}="), p))

    segments = F.split(F.regexp_replace(path(url), "[0-9]+", "#"), "/")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda p: F.substring_index(p, "=", 1))
    scheme = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(.*?)://", 1)
    parts = F.concat(
        named("scheme", F.array(F.lower(scheme))),
        named("host", F.split(host(url), r"\.")),
        named("path", segments),
        named("query", keys),
    )
    return F.array_distinct(parts)


def mine(
    pages: DataFrame,
    labels: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    plain: int = TOKENS,
    support: int = SUPPORT,
    confidence: float = CONFIDENCE,
) -> DataFrame:
    """``rule`` (sorted tokens), ``bad``, ``pages``, ``confidence``, ``under`` (its rarest token).

    All sets of enough support and confidence, whatever their size, but those of more than ``plain``
    tokens that hold a shorter rule. A page is bad if the labels of its id say low quality or toxic; a page labelled twice is bad if
    one of them does."""
    bad = F.coalesce((F.min("quality") == 0) | (F.max("toxic") == 1), F.lit(False))
    marked = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(bad.alias("bad"))
    urls = pages.where(F.col(url_col).isNotNull()).select(F.col(id_col).alias("doc_id"), tokens(F.col(url_col)).alias("t"))
    label = F.when(F.col("bad"), f"label={_BAD}").otherwise(f"label={_GOOD}")
    baskets = urls.join(marked, "doc_id").select(F.concat("t", F.array(label)).alias("items"))
    total = baskets.count()
    schema = "rule array<string>, bad long, pages long, confidence double, under string"
    if total < support:
        return pages.sparkSession.createDataFrame([], schema)
    grown = FPGrowth(itemsCol="items", minSupport=min(1.0, (support - 0.5) / total), minConfidence=1.0)
    sets = grown.fit(baskets).freqItemsets.select(F.sort_array("items").alias("items"), "freq")
    is_bad = F.array_contains("items", f"label={_BAD}")
    with_bad = sets.where(is_bad & (F.size("items") > 1)).select(
        F.array_remove("items", f"label={_BAD}").alias("rule"), F.col("freq").alias("bad")
    )
    bare = sets.select(F.col("items").alias("rule"), F.col("freq").alias("pages"))
    rules = with_bad.join(bare, "rule").withColumn("confidence", F.col("bad") / F.col("pages"))
    rules = written(rules.where(F.col("confidence") >= confidence), "rules")
    single = bare.where(F.size("rule") == 1).select(F.get("rule", F.lit(0)).alias("token"), F.col("pages").alias("often"))
    rarest = (
        rules.select("rule", F.explode("rule").alias("token"))
        .join(single, "token")
        .groupBy("rule")
        .agg(F.min(F.struct("often", "token"))["token"].alias("under"))
    )
    rules = written(rules.join(rarest, "rule"), "rules")
    holds = rules.where(F.size("rule") > plain).select("rule", F.explode("rule").alias("under"))
    part = rules.select(F.col("rule").alias("part"), "under")
    within = (F.size("part") < F.size("rule")) & (F.size(F.array_except("part", "rule")) == 0)
    implied = holds.join(part, "under").where(within).select("rule").distinct()
    return rules.join(implied, "rule", "left_anti")


def matched(pages: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """``url`` and ``mined`` (the first of the mined rules that fit, as text; one of more than
    ``TOKENS`` tokens only if no other fits), for different urls that any fits."""
    urls = pages.where(F.col(url_col).isNotNull()).select(F.col(url_col).alias("url")).distinct()
    listed = urls.select("url", tokens(F.col("url")).alias("t"))
    under = listed.select("url", "t", F.explode_outer("t").alias("under"))
    fits = under.join(rules.select("rule", "under"), "under").where(F.size(F.array_except("rule", "t")) == 0)
    ranked = F.struct(F.greatest(F.size("rule"), F.lit(TOKENS)), F.array_join("rule", " ").alias("mined"))
    return fits.groupBy("url").agg(F.min(ranked)["mined"].alias("mined"))


def judge(
    pages: DataFrame,
    labels: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    support: int = SUPPORT,
    confidence: float = CONFIDENCE,
) -> DataFrame:
    """Per row: ``id``, ``host``, ``path``, ``rule``, ``verdict``, ``mined``.

    A given rule decides; without one, a mined rule blocks; all else is allowed. A NULL url, or one
    without ``://``, has an empty host and path. Repeated rows stay. Without labelled pages nothing is
    mined."""
    rules = mine(pages, labels, id_col, url_col, TOKENS, support, confidence)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    met = rows.join(matched(pages, rules, url_col), "url", "left")
    parted = met.select("id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "mined")
    rule, verdict = given_rule(F.col("host"), F.col("path"))
    mined = F.when(F.col("mined").isNotNull(), "block").otherwise("allow")
    return parted.select("id", "host", "path", rule.alias("rule"), F.coalesce(verdict, mined).alias("verdict"), "mined")


#: The same rows in SQL. Sets of one and two tokens stand for the frequent sets.
SQL = f"""
WITH p AS (SELECT row_number() OVER () AS r, page_id, url, coalesce(url, '') AS u FROM pages),
h AS (SELECT r, page_id, url, u,
    translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1),
        '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
    regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM p),
k AS (
    SELECT DISTINCT r, 'scheme=' || x AS t FROM (
        SELECT r, lower(regexp_extract(u, '(?s)^(.*?)://', 1)) AS x FROM h WHERE url IS NOT NULL) WHERE x <> ''
    UNION SELECT r, 'host=' || x FROM (
        SELECT r, unnest(string_split(host, '.')) AS x FROM h WHERE url IS NOT NULL) WHERE x <> ''
    UNION SELECT r, 'path=' || x FROM (
        SELECT r, unnest(string_split(regexp_replace(path, '[0-9]+', '#', 'g'), '/')) AS x
        FROM h WHERE url IS NOT NULL) WHERE x <> ''
    UNION SELECT r, 'query=' || x FROM (
        SELECT r, string_split(unnest(string_split(
            regexp_extract(u, '(?s)^.*?://[^?#]*\\?([^#]*)', 1), '&')), '=')[1] AS x
        FROM h WHERE url IS NOT NULL) WHERE x <> ''),
l AS (SELECT doc_id, coalesce(min(quality) = 0 OR max(toxic) = 1, false) AS bad
    FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
b AS (SELECT h.r, bad FROM h JOIN l ON l.doc_id = h.page_id WHERE url IS NOT NULL),
one AS (SELECT t AS a, t AS c FROM k JOIN b USING (r)
    GROUP BY t HAVING count(*) FILTER (WHERE bad) >= {SUPPORT}
    AND count(*) FILTER (WHERE bad) / count(*) >= {CONFIDENCE}),
two AS (SELECT x.t AS a, y.t AS c FROM k x JOIN k y ON x.r = y.r AND x.t < y.t JOIN b ON b.r = x.r
    GROUP BY ALL HAVING count(*) FILTER (WHERE bad) >= {SUPPORT}
    AND count(*) FILTER (WHERE bad) / count(*) >= {CONFIDENCE}),
m AS (SELECT r, min(rule) AS mined FROM (
    SELECT k.r, one.a AS rule FROM k JOIN one ON k.t = one.a
    UNION ALL SELECT x.r, two.a || ' ' || two.c FROM two JOIN k x ON x.t = two.a
        JOIN k y ON y.t = two.c AND y.r = x.r) GROUP BY r),
g AS (SELECT r, page_id, host, path, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM h)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN mined IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, mined
FROM g LEFT JOIN m USING (r)
"""
