"""Hashes of the words of a text, many words at a time in numpy."""

from __future__ import annotations

import re

import numpy as np

_STEP = 1 << 21
_BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)

#: Letters, digits and every byte of a character outside ASCII make up words.
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _grow(size: int) -> None:
    global _powers, _inverse
    if len(_powers) <= size:
        size = max(size + 1, 2 * len(_powers))
        for name, base in (("_powers", _BASE), ("_inverse", pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            globals()[name] = np.multiply.accumulate(steps)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _hashed(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = _IN_WORD[raw]
    turns = np.diff(inside)
    starts, ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    _grow(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw + np.uint64(1)) * _powers[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _inverse[starts]), starts


def _cut(data: bytes, limit: int) -> int:
    """Where a word ends at or after ``limit``."""
    return m.start() if (m := re.compile(rb"[^0-9A-Za-z\x80-\xff]").search(data, limit)) else len(data)


def words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, place of the first byte) of each word of ``data``."""
    hashes, places, start = [], [], 0
    while start < len(data):
        end = _cut(data, start + _STEP) if len(data) - start > _STEP else len(data)
        h, s = _hashed(np.frombuffer(data, np.uint8, end - start, start).astype(np.uint64))
        hashes.append(h)
        places.append(s + start)
        start = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(places)


def normal(text: str | None) -> bytes:
    return text.lower().encode("utf-8", "replace") if text else b""


def together(texts: list[str | None], size: int = _STEP):
    """Texts in runs of about ``size`` characters: lists of places in ``texts``."""
    run, chars = [], 0
    for i, text in enumerate(texts):
        run.append(i)
        chars += len(text or "")
        if chars >= size:
            yield run
            run, chars = [], 0
    if run:
        yield run


def joined_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place of its text in ``texts``) of each word of all texts, in order."""
    raws = [normal(t) for t in texts]
    hashes, places = words(b"\n".join(raws))
    bounds = np.cumsum([len(r) + 1 for r in raws])
    return hashes, np.searchsorted(bounds, places, side="right")


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words; one per word that begins such a run."""
    count = max(0, len(hashes) - n + 1)
    out = np.zeros(count, np.uint64)
    for i in range(n):
        out = out * np.uint64(_BASE) + hashes[i : i + count]
    return mix(out)
