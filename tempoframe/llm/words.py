"""Words of texts as 64-bit numbers, hashed all at once.

Words are what the characters of ``SPACE`` separate: as they are written, or ``plain``, in lower case and without
the ASCII marks at their ends (a word of marks alone keeps them).

A number comes from all bytes of a word, eight at a time, each eight mixed in before the next; there is no algebra by
which plain inputs could share one. Where a single match counts, words are compared as such (``plain_words``).
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa

#: Bytes that are hashed at once; longer texts are cut where white space allows.
BLOCK = 1 << 18
_SPACE, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_MARK[[ord(c) for c in MARKS]] = True
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Bytes of a number's last eight that belong to the word, by how many there are.
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M2
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def eights(data: bytes, low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The up to eight bytes from each place, little-endian, zero behind the first ``size``; data ends in eight bytes more."""
    every = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    return every[low] & _KEEP[np.minimum(size, 8)]


def slice_numbers(data: bytes, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A number for each slice of ``data``, which ends in eight bytes more than the slices need."""
    size = high - low
    out = mixed(eights(data, low, size) ^ (size.astype(np.uint64) * _M1))
    todo, at = np.flatnonzero(size > 8), 8
    while len(todo):
        out[todo] = mixed((out[todo] + _M1) ^ eights(data, low[todo] + at, size[todo] - at))
        at += 8
        todo = todo[size[todo] > at]
    return out


def plain_words(text: str | None) -> list[str]:
    """The words themselves, as ``word_numbers`` numbers them by default."""
    return [w.strip(MARKS) or w for w in _WORD.findall((text or "").lower())]


def _hashed(texts: list[bytes], plain: bool) -> tuple[np.ndarray, np.ndarray]:
    """All words' numbers, and how many each text has."""
    raw = b"".join(texts)
    data = np.frombuffer(raw, np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    inner = ~_SPACE[data]
    begins = inner.copy()
    begins[1:] &= ~inner[:-1]
    starts = np.concatenate(([0], ends[:-1]))
    cuts = starts[(starts > 0) & (starts < len(data))]
    begins[cuts] = inner[cuts]
    stops = inner.copy()
    stops[:-1] &= ~inner[1:] | begins[1:]
    low, high = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    counts = np.diff(np.searchsorted(low, np.concatenate((starts, [len(data)]))))
    if plain:
        told = np.flatnonzero(inner & ~_MARK[data])
        first, last = np.searchsorted(told, low), np.searchsorted(told, high) - 1
        some = first <= last
        low[some], high[some] = told[first[some]], told[last[some]] + 1
    return slice_numbers(raw + bytes(8), low, high), counts


def _parts(text: bytes) -> list[bytes]:
    """A long text cut after white space, so that no part is much longer than BLOCK."""
    out, at = [], 0
    while len(text) - at > BLOCK:
        place = max(text.rfind(c, at, at + BLOCK) for c in (b" ", b"\n", b"\t", b"\r"))
        if place < at:
            break
        out.append(text[at : place + 1])
        at = place + 1
    return [*out, text[at:]]


def word_numbers(texts: Iterable[str | None], plain: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """All words' numbers one text after the other, and where each text starts (and the last one ends)."""
    words, counts, owner, some, size, n = [], [], [], [], 0, 0

    def flush() -> None:
        nonlocal some, size
        if some:
            w, c = _hashed(some, plain)
            words.append(w)
            counts.append(c)
        some, size = [], 0

    for n, t in enumerate(texts, 1):  # noqa: B007
        for part in _parts(((t or "").lower() if plain else t or "").encode("utf-8", "surrogatepass")):
            some.append(part)
            owner.append(n - 1)
            size += len(part)
            if size > BLOCK:
                flush()
    flush()
    starts = np.zeros(n + 1, np.int64)
    if counts:
        np.cumsum(np.bincount(owner, weights=np.concatenate(counts), minlength=n).astype(np.int64), out=starts[1:])
    return (np.concatenate(words) if words else np.zeros(0, np.uint64)), starts


def words_as_written(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``word_numbers`` of a column of texts, as they are written."""
    return word_numbers((t.as_py() for t in column), plain=False)
