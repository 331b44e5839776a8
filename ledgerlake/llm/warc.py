"""WARC archives: records written by Spark's text sink, read back, and put together from segments.

A page becomes a response with a chunked HTTP body, cut into records of at most ``SEGMENT`` bytes: the
first of type response, the others continuations that name it. A page with the payload of another
becomes a revisit, which has no body and names that page.
"""

from __future__ import annotations

import base64
import re
import zlib
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.tables import written
from ledgerlake.sources.scratch import new_folder

#: Smaller payloads are always written out.
LEAST_SHARED = 1000
SEGMENT = 64 << 10
CHUNK = 4 << 10
#: Records in a file, so no file is larger than this times a segment.
PER_FILE = 256
DATE = "2026-01-01T00:00:00Z"

#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_END = "\r\n\r\n"
_NUMBER, _SHORT = re.compile("[0-9]{1,18}"), re.compile("[0-9]{1,9}")


def _text(data: Column) -> Column:
    """The bytes as they are; text is joined and written byte by byte, whatever its characters."""
    return data.cast("string")


def _pieces(data: Column, size: Column, step: int) -> Column:
    starts = F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), F.lit(step))
    return F.transform(starts, lambda i: F.substring(data, i + 1, F.lit(step)))


def _chunked(data: Column, size: Column) -> Column:
    framed = F.transform(
        _pieces(data, size, CHUNK),
        lambda c: F.concat(F.hex(F.octet_length(c)), F.lit("\r\n"), _text(c), F.lit("\r\n")),
    )
    body = F.when(size > 0, F.array_join(framed, "")).otherwise(F.lit(""))
    return F.concat(F.lit(HTTP_HEAD), body, F.lit("0\r\n\r\n"))


def _header(*fields: tuple[str, Column]) -> Column:
    """Fields with a NULL value are left out."""
    lines = [F.concat(F.lit(f"{name}: "), value.cast("string")) for name, value in fields]
    return F.concat(F.array_join(F.array_compact(F.array(F.lit(VERSION), *lines)), "\r\n"), F.lit(_END))


def decided(pages: DataFrame, id_col: str, url_col: str, html_col: str, least: int) -> DataFrame:
    """Different rows (name, id, url, data, size, digest) with ``copies``, how many rows are equal to
    it, and ``refers_to`` of those whose payload another page holds. Payloads move once; which row
    refers to which is found on ids and digests alone."""
    data = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), data.alias("data"))
    rows = rows.withColumn("digest", F.sha1("data"))
    number = F.coalesce(F.col("id").cast("string"), F.lit(""))
    place = F.md5(F.coalesce("url", F.lit("")).cast("binary"))
    rows = rows.withColumn("name", F.concat_ws(":", F.lit("urn:page"), number, place, "digest"))
    large = rows.where(F.octet_length("data") >= least).select("name", "id", "digest")
    shared = large.groupBy("digest").agg(F.max("id").alias("holder"), F.count("*").alias("n"))
    other = F.coalesce(F.col("id") < F.col("holder"), F.col("id").isNull() & F.col("holder").isNotNull())
    referring = (
        large.join(shared.where("n > 1").select("digest", "holder"), "digest")
        .where(other)
        .groupBy("name")
        .agg(F.first("holder").alias("refers_to"))
    )
    different = rows.groupBy("name").agg(
        F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("id", "url", "digest", "data")]
    )
    return different.join(referring, "name", "left").withColumn("size", F.octet_length("data"))


def records(pages: DataFrame, id_col: str, url_col: str, html_col: str, least: int = LEAST_SHARED) -> DataFrame:
    """``value``: one WARC record per row, without the empty lines that end it."""
    rows = decided(pages, id_col, url_col, html_col, least)
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    rows = rows.withColumn("name", F.concat_ws(":", "name", "copy"))
    target = F.regexp_replace("url", r"[\x00-\x20\x7F]", "")
    common = [("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", F.when(target != "", target))]
    held = F.concat(F.lit("sha1:"), "digest")
    revisits = rows.where("refers_to IS NOT NULL").select(
        _header(
            ("WARC-Type", F.lit("revisit")),
            ("WARC-Record-ID", F.concat(F.lit("<"), "name", F.lit(">"))),
            *common,
            ("WARC-Profile", F.lit(PROFILE)),
            ("WARC-Payload-Digest", held),
            ("WARC-Refers-To", F.concat(F.lit("<urn:page:"), "refers_to", F.lit(">"))),
            ("Content-Length", F.lit(0)),
        ).alias("value")
    )
    block = _chunked(F.col("data"), F.col("size")).cast("binary")
    blocks = rows.where("refers_to IS NULL").select("name", "url", "digest", block.alias("block"))
    blocks = blocks.withColumn("total", F.octet_length("block"))
    cut = _pieces(F.col("block"), F.col("total"), SEGMENT)
    parts = blocks.select("name", "url", "digest", "total", F.posexplode_outer(cut).alias("at", "part"))
    last = (F.col("total") + SEGMENT - 1) / SEGMENT
    count = F.floor(last)
    several, first = count > 1, F.col("at") == 0
    origin = F.concat(F.lit("<"), "name", F.lit(">"))
    own = F.when(first, origin).otherwise(F.concat(F.lit("<"), "name", F.lit(":"), F.col("at") + 1, F.lit(">")))
    segments = parts.select(
        F.concat(
            _header(
                ("WARC-Type", F.when(first, "response").otherwise("continuation")),
                ("WARC-Record-ID", own),
                *common,
                ("Content-Type", F.when(first, "application/http; msgtype=response")),
                ("WARC-Payload-Digest", F.when(first, held)),
                ("WARC-Segment-Number", F.when(several, F.col("at") + 1)),
                ("WARC-Segment-Origin-ID", F.when(~first, origin)),
                ("WARC-Segment-Total-Length", F.when(several & (F.col("at") + 1 == count), F.col("total"))),
                ("Content-Length", F.octet_length("part")),
            ),
            _text(F.col("part")),
        ).alias("value")
    )
    return revisits.unionByName(segments)


def write(found: DataFrame, path: str) -> None:
    """Records as gzip files; the sink ends each record with two empty lines."""
    sink = found.write.option("lineSep", _END).option("maxRecordsPerFile", PER_FILE)
    sink.option("compression", "gzip").text(path)


def unzipped(content: bytes) -> tuple[bytes, bool]:
    """The bytes of all gzip members, as far as they can be read, and whether that is to the end."""
    out, rest = [], content
    while rest:
        member = zlib.decompressobj(wbits=31)
        try:
            out.append(member.decompress(rest))
        except zlib.error:
            return b"".join(out), False
        if not member.eof:
            return b"".join(out), False
        rest = member.unused_data
    return b"".join(out), True


def parse(content: bytes):
    """(header fields in lower case, block, what is wrong) of each record of a file.

    Of a record that cannot be read, the bytes up to the next line that starts one are the block."""
    at = 0
    while at < len(content):
        end = content.find(_END.encode(), at)
        version, *lines = content[at : max(at, end)].decode("utf-8", "replace").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        size = fields.get("content-length", "")
        start = end + 4
        stop = start + int(size) if _NUMBER.fullmatch(size) else -1
        wrong = None
        if version != VERSION:
            wrong = "version"
        elif stop < 0:
            wrong = "content-length"
        elif "warc-type" not in fields or "warc-record-id" not in fields:
            wrong = "fields"
        elif not _SHORT.fullmatch(fields.get("warc-segment-number", "0")):
            wrong = "segment"
        elif not _NUMBER.fullmatch(fields.get("warc-segment-total-length", "0")):
            wrong = "segment"
        elif content[stop : stop + 4] != _END.encode():
            wrong = "length"
        if not wrong:
            yield fields, content[start:stop], None
            at = stop + 4
            continue
        following = content.find(b"\r\n" + VERSION.encode() + b"\r\n", at + 1)
        following = len(content) if following < 0 else following + 2
        yield fields, content[at:following], wrong
        at = following


def _sha1_of(stated: str) -> str | None:
    """A stated SHA-1 in lower-case hex digits; it may be in base 32. None for other digests."""
    kind, _, value = stated.partition(":")
    if kind.lower() != "sha1":
        return None
    if len(value) == 32:
        try:
            return base64.b32decode(value, casefold=True).hex()
        except ValueError:
            return None
    return value.lower() if len(value) == 40 else None


READ = (
    "type string, name string, origin string, segment int, total long, digest string, refers_to string, "
    "block binary, wrong string"
)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archive files below ``path``, each as a row.

    What cannot be read is a row of type ``broken``, whose ``wrong`` says why (version, content-length,
    fields, segment, length, or gzip for a file that is cut off or damaged); the records around it are
    there."""

    def run(batches):
        kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()]
        names = ["type", "name", "origin", "segment", "total", "digest", "refers_to", "block", "wrong"]
        for batch in batches:
            for packed in batch.column(0):
                out = [[] for _ in names]
                content, complete = unzipped(packed.as_py())
                found = parse(content) if complete else chain(parse(content), [({}, b"", "gzip")])
                for fields, block, wrong in found:
                    name = fields.get("warc-record-id", "").strip("<>")
                    total = None if wrong else fields.get("warc-segment-total-length")
                    row = (
                        "broken" if wrong else fields["warc-type"],
                        name or None,
                        fields.get("warc-segment-origin-id", name).strip("<>") or None,
                        0 if wrong else int(fields.get("warc-segment-number", 0)),
                        int(total) if total else None,
                        _sha1_of(fields.get("warc-payload-digest", "")),
                        fields.get("warc-refers-to", "").strip("<>") or None,
                        block,
                        wrong,
                    )
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, READ)


def reassembled(found: DataFrame) -> DataFrame:
    """``name``, ``digest``, ``block`` of each response, and ``whole``: whether its segments are all
    there, each once, and add up to the total length that the last one states."""
    responses = found.where("type IN ('response', 'continuation')")
    single = responses.where("segment = 0").select("name", "digest", "block", F.lit(True).alias("whole"))
    parts = responses.where("segment > 0").groupBy("origin").agg(
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"),
        F.max("total").alias("total"),
        F.max("digest").alias("digest"),
    )
    joined = F.array_join(F.transform("parts", lambda p: _text(p["block"])), "").cast("binary")
    numbers = F.transform("parts", lambda p: p["segment"])
    complete = (numbers == F.sequence(F.lit(1), F.size("parts"))) & (F.octet_length("block") == F.col("total"))
    several = parts.select(F.col("origin").alias("name"), "digest", joined.alias("block"), "parts", "total")
    return single.unionByName(several.select("name", "digest", "block", F.coalesce(complete, F.lit(False)).alias("whole")))


def dechunked(block: bytes) -> bytes | None:
    """The body of an HTTP response in chunks; None if the framing is broken."""
    head, mark, rest = block.partition(b"\r\n\r\n")
    if not mark:
        return None
    if b"transfer-encoding: chunked" not in head.lower():
        return rest
    out, at = [], 0
    while True:
        end = rest.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            size = int(rest[at:end].split(b";")[0], 16)
        except ValueError:
            return None
        if not size:
            return b"".join(out)
        if rest[end + 2 + size : end + 4 + size] != b"\r\n":
            return None
        out.append(rest[end + 2 : end + 2 + size])
        at = end + 4 + size


def payloads(responses: DataFrame) -> DataFrame:
    """``name``, ``payload`` (NULL where segments or framing are broken, or where its SHA-1 is not the stated
    one) of each response."""

    def run(batches):
        for batch in batches:
            blocks, whole = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            found = [dechunked(b) if w else None for b, w in zip(blocks, whole, strict=True)]
            columns = [batch.column(0), pa.array(found, pa.binary()), batch.column(3)]
            yield pa.RecordBatch.from_arrays(columns, ["name", "payload", "digest"])

    schema = "name string, payload binary, digest string"
    found = responses.select("name", "block", "whole", "digest").mapInArrow(run, schema)
    sound = F.col("digest").isNull() | (F.col("digest") == F.sha1("payload"))
    return found.select("name", F.when(sound, F.col("payload")).alias("payload"))


def round_trip(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least: int = LEAST_SHARED,
    path: str | None = None,
) -> DataFrame:
    """Write the pages as archives, read them, and return per page ``id``, ``payload_bytes``,
    ``payload_digest``, ``record_type``, ``refers_to``; all come from the archives.

    A NULL html is an empty payload. Rows equal to another each have a record. Of pages with one
    payload the largest id holds it; rows without an id refer to it like the others, and hold it only
    if no row has an id."""
    spark = pages.sparkSession
    path = path or new_folder(spark, "archives")
    write(records(pages, id_col, url_col, html_col, least), path)
    found = read(spark, path)
    sizes = payloads(reassembled(found)).select(
        F.split_part("name", F.lit(":"), F.lit(3)).alias("page"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
    )
    sizes = written(sizes, "payloads")
    number = F.when(F.col("page") != "", F.col("page")).cast("long")
    responses = sizes.select(
        number.alias("id"), "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")
    )
    held = sizes.select(F.col("page").alias("holder"), F.col("payload_digest").alias("digest"), "payload_bytes").distinct()
    own = F.split_part("name", F.lit(":"), F.lit(3))
    revisits = (
        found.where("type = 'revisit'")
        .select(own.alias("page"), F.split_part("refers_to", F.lit(":"), F.lit(3)).alias("holder"), "digest")
        .join(held, ["holder", "digest"], "left")
        .select(
            number.alias("id"),
            "payload_bytes",
            F.col("digest").alias("payload_digest"),
            F.lit("revisit").alias("record_type"),
            F.col("holder").cast("long").alias("refers_to"),
        )
    )
    return responses.unionByName(revisits)


#: The same rows in SQL.
SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS payload_digest FROM p),
s AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS holder FROM d)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= {LEAST_SHARED} AND page_id < holder THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= {LEAST_SHARED} AND page_id < holder THEN holder END AS refers_to
FROM s
"""
