"""Archives that are damaged, or that others wrote."""

import base64
import gzip
import hashlib
import os

import pytest

from ledgerlake.llm import warc


def record(name, block=b"", length=None, kind="response", version=warc.VERSION, **fields):
    size = len(block) if length is None else length
    named = {"WARC-Type": kind, "WARC-Record-ID": f"<{name}>", **fields, "Content-Length": size}
    head = "\r\n".join([version, *[f"{k.replace('_', '-')}: {v}" for k, v in named.items() if v is not None]])
    return head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def response(payload):
    return b"HTTP/1.1 200 OK\r\n\r\n" + payload


def stored(folder, *files):
    os.makedirs(f"{folder}/archives")
    for k, content in enumerate(files):
        with open(f"{folder}/archives/{k}.warc.gz", "wb") as file:
            file.write(content)
    return f"{folder}/archives"


GOOD = record("good", response(b"good"))


@pytest.mark.parametrize(
    "bad, wrong",
    [
        (record("x", b"abc", length="many"), "content-length"),
        (record("x", b"abc", length=""), "content-length"),
        (record("x", b"abc", length=2), "length"),
        (record("x", b"abc", length=10**12), "length"),
        (record("x", b"abc", version="WARC/9"), "version"),
        (b"no record at all", "version"),
        (b"\x00\xff\r\n\r\n", "version"),
        (record("x", b"abc", kind=None), "fields"),
        (record("x", b"abc", WARC_Segment_Number="one"), "segment"),
        (record("x", b"abc", WARC_Segment_Number=10**10), "segment"),
        (record("x", b"abc")[:-6], "length"),
    ],
)
def test_a_broken_record_leaves_the_others(spark, folder, bad, wrong):
    bad = bad if bad.endswith(b"\r\n") else bad + b"\r\n"
    path = stored(folder, gzip.compress(GOOD + bad + record("next", response(b"next"))))
    rows = warc.read(spark, path).collect()
    assert [(r.type, r.wrong) for r in rows] == [("response", None), ("broken", wrong), ("response", None)]
    found = warc.payloads(warc.reassembled(warc.read(spark, path))).collect()
    assert sorted((r.name, bytes(r.payload)) for r in found) == [("good", b"good"), ("next", b"next")]


def test_a_file_that_is_cut_off_or_damaged(spark, folder):
    whole = gzip.compress(GOOD) + gzip.compress(record("last", os.urandom(5000)))
    path = stored(folder, whole[:-2000], gzip.compress(GOOD) + b"no gzip", b"", gzip.compress(b""))
    rows = warc.read(spark, path).collect()
    assert sum(r.type == "response" and r.name == "good" for r in rows) == 2
    assert sum(r.wrong == "gzip" for r in rows) == 2
    assert not any(r.name == "last" and r.type == "response" for r in rows)


def test_many_members_of_a_file(spark, folder):
    path = stored(folder, b"".join(gzip.compress(record(f"r{k}", response(b"%d" % k))) for k in range(50)))
    found = warc.payloads(warc.reassembled(warc.read(spark, path))).collect()
    assert {(r.name, bytes(r.payload)) for r in found} == {(f"r{k}", b"%d" % k) for k in range(50)}


def test_payloads_are_held_against_their_digest(spark, folder):
    digest = hashlib.sha1(b"text").digest()
    stated = {
        "hex": "sha1:" + digest.hex(),
        "upper": "SHA1:" + digest.hex().upper(),
        "base32": "sha1:" + base64.b32encode(digest).decode(),
        "other": "md5:00",
        "odd": "sha1:12",
        "false": "sha1:" + "0" * 40,
    }
    records = [record(n, response(b"text"), WARC_Payload_Digest=d) for n, d in stated.items()]
    path = stored(folder, gzip.compress(b"".join(records) + record("none", response(b"text"))))
    found = {r.name: r.payload for r in warc.payloads(warc.reassembled(warc.read(spark, path))).collect()}
    assert {n for n, p in found.items() if p is None} == {"false"}
    assert len(found) == 7
