"""Token ids of whole texts, with the pieces between sure cuts remembered.

A tokenizer that first cuts a text by a pattern gives it the ids of its pieces one after the other, wherever a cut is one
that the pattern makes anyway. Sure cuts here: before a single white-space character, and between an ASCII letter and an
ASCII mark other than the apostrophe. Texts with anything that makes these unsure (runs of white space, special strings,
separators that the patterns see otherwise) are encoded whole.

All pieces of a batch are found and looked up at once in a table of fixed size, which holds their bytes: a piece is never
known by a hash alone. Pieces that are not in it go to the tokenizer, many in one text with a special token between them;
pieces over ``LONGEST`` bytes do so in every batch.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from functools import cache

import numpy as np

from tempoframe.llm.words import eights, mixed

#: Bytes of a remembered piece, eight to a number.
LONGEST = 24
#: Pieces that the table holds; 65 bytes or so for each.
ENTRIES = 1_000_000
#: Characters that are looked up at once.
BLOCK = 125_000
#: A place in a longer text that the patterns cut before, whatever stands further off.
SAFE = re.compile(r"[A-Za-z](?= [A-Za-z])")
_SPACE, _LETTER, _MARK = (np.zeros(256, bool) for _ in range(3))
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = True


def hashed(keys: np.ndarray) -> np.ndarray:
    """Where the search for a piece begins."""
    out = mixed(keys[:, 0] ^ keys[:, -1])
    for k in range(1, keys.shape[1] - 1):
        out = mixed(out + keys[:, k])
    return out


def leaders(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each different row, and for each row which of these it equals."""
    _, lead, back = np.unique(hashed(keys), return_index=True, return_inverse=True)
    if (keys == keys[lead[back]]).all():
        return lead, back
    _, lead, back = np.unique(keys, axis=0, return_index=True, return_inverse=True)  # different rows share a hash
    return lead, back.ravel()


class PieceTable:
    """Ids of pieces by their bytes: open addressing, and no entry ever moves or goes."""

    def __init__(self, entries: int = ENTRIES):
        slots, ids = 1 << (2 * entries - 1).bit_length(), 4 * entries
        self.keys = np.zeros((entries, LONGEST // 8 + 1), np.uint64)
        self.entry = np.full(slots, -1, np.int32)
        self.start, self.size = np.zeros(entries, np.int32), np.zeros(entries, np.int32)
        self.ids, self.most, self.used, self.count = np.zeros(ids, np.uint32), ids, 0, 0
        self.shift, self.wrap = np.uint64(64 - (slots.bit_length() - 1)), slots - 1

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each piece's entry, or -1."""
        out = np.full(len(keys), -1, np.int64)
        at, todo = (hashed(keys) >> self.shift).astype(np.int64), np.arange(len(keys))
        while len(todo):
            e = self.entry[at]
            hit = (e >= 0) & (self.keys[e] == keys[todo]).all(axis=1)
            out[todo[hit]] = e[hit]
            on = (e >= 0) & ~hit
            at, todo = (at[on] + 1) & self.wrap, todo[on]
        return out

    def add(self, keys: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> int:
        """Different new pieces with their ids one after the other; returns how many there was room for."""
        n = min(len(keys), len(self.start) - self.count, int(np.searchsorted(np.cumsum(sizes), self.most - self.used, "right")))
        if n <= 0:
            return 0
        numbers = np.arange(self.count, self.count + n)
        self.size[numbers] = sizes[:n]
        self.start[numbers] = self.used + np.cumsum(sizes[:n]) - sizes[:n]
        self.keys[numbers] = keys[:n]
        total = int(sizes[:n].sum())
        self.ids[self.used : self.used + total] = ids[:total]
        self.used, self.count = self.used + total, self.count + n
        at, todo = (hashed(keys[:n]) >> self.shift).astype(np.int64), np.arange(n)
        while len(todo):
            free = self.entry[at] < 0
            _, lead = np.unique(at, return_index=True)
            take = np.zeros(len(at), bool)
            take[lead] = True
            take &= free
            self.entry[at[take]] = numbers[todo[take]]
            at, todo = (at[~take] + 1) & self.wrap, todo[~take]
        return n


class MemoEncoder:
    """ids of texts as bytes, little-endian unsigned 32-bit.

    ``spaces``: "kept" for byte-level vocabularies, where a space belongs to the piece after it; "dropped" for
    those that ignore white space.
    """

    def __init__(self, path: str, spaces: str, entries: int = ENTRIES):
        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise OSError("ids are kept as they lie in memory, little-endian and of 4 bytes")
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        if spaces not in ("kept", "dropped"):
            raise ValueError(f"spaces: {spaces}")
        self.tokenizer, self.kept = Tokenizer.from_file(path), spaces == "kept"
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = [t.content.encode() for t in added.values()]
        self.mark = next(((t.content, i) for i, t in added.items() if t.special and not t.normalized), None)
        self.table = PieceTable(entries)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each piece, and all ids; the pieces hold no special string."""
        if not self.mark or not pieces:
            found = [np.frombuffer(x, np.uint32) for x in self._whole(pieces)]
            return np.array([len(x) for x in found], np.int64), np.concatenate([*found, np.zeros(0, np.uint32)])
        (mark, mark_id), sizes, ids = self.mark, [], []
        for at in range(0, len(pieces), 2000):
            some = pieces[at : at + 2000]
            found = np.frombuffer(self._whole([mark.join(some)])[0], np.uint32)
            ends = np.append(np.flatnonzero(found == mark_id), len(found))
            if len(ends) != len(some):
                raise ValueError("a special token inside a piece")
            sizes.append(np.diff(ends, prepend=-1) - 1)
            ids.append(found[found != mark_id])
        return np.concatenate(sizes), np.concatenate(ids)

    def _unsure(self, data: np.ndarray, space: np.ndarray, starts: np.ndarray, raw: bytes) -> np.ndarray:
        """Numbers of the texts that need to be encoded whole."""
        doubt = []
        if self.kept:
            doubt.append(np.flatnonzero(space[:-1] & space[1:]))
            last = starts[1:] - 1
            doubt.append(last[(last >= starts[:-1]) & space[np.maximum(last, 0)]])
        else:
            doubt.append(np.flatnonzero((data >= 0x1C) & (data <= 0x1F)))
        wide = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))  # where further white space begins
        a, b, c = data[wide].astype(np.int64), data[np.minimum(wide + 1, len(data) - 1)], data[np.minimum(wide + 2, len(data) - 1)]
        white = (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
        white |= (a == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F))
        doubt.append(wide[white])
        for s in self.special:
            at = raw.find(s)
            while at >= 0:
                doubt.append(np.array([at]))
                at = raw.find(s, at + 1)
        return np.unique(np.searchsorted(starts, np.concatenate(doubt), "right") - 1)

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        size, some = 0, []
        for t in texts:  # blocks of a bounded size: the arrays below take some fifty bytes for each
            if len(t) > BLOCK:
                out += self._encode(some)
                out.append(b"".join(self._encode([part])[0] for part in self._parts(t)))
                size, some = 0, []
                continue
            some.append(t)
            size += len(t)
            if size > BLOCK:
                out += self._encode(some)
                size, some = 0, []
        return out + self._encode(some)

    def _parts(self, text: str) -> list[str]:
        """A long text cut where its ids fall into two as well; one part if special strings could hold a cut."""
        if any(b" " in s for s in self.special):
            return [text]
        parts, at = [], 0
        while len(text) - at > BLOCK and (m := SAFE.search(text, at + BLOCK // 2)):
            parts.append(text[at : m.end()])
            at = m.end()
        return [*parts, text[at:]]

    def _encode(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        parts = [t.encode() for t in texts]
        raw = b"".join(parts)
        starts = np.zeros(len(parts) + 1, np.int64)
        np.cumsum([len(p) for p in parts], out=starts[1:])
        if not raw:
            return [b""] * len(texts)
        data = np.frombuffer(raw, np.uint8)
        space = _SPACE[data]
        unsure = self._unsure(data, space, starts, raw)
        cut = np.zeros(len(data) + 1, bool)
        cut[starts] = True
        cut[1:-1] |= _LETTER[data[:-1]] & _MARK[data[1:]]
        if self.kept:
            cut[:-1] |= space
        else:
            cut[:-1] |= space
            cut[1:-1] |= space[:-1] & ~space[1:]
        edges = np.flatnonzero(cut)
        low, high = edges[:-1], edges[1:]
        if not self.kept:
            word = ~space[low]
            low, high = low[word], high[word]
        text_of = np.searchsorted(starts, low, "right") - 1
        if len(unsure):
            sure = ~np.isin(text_of, unsure)
            low, high, text_of = low[sure], high[sure], text_of[sure]
        length = high - low
        padded = raw + bytes(LONGEST + 8)
        keys = np.empty((len(low), LONGEST // 8 + 1), np.uint64)
        for k in range(LONGEST // 8):
            keys[:, k] = eights(padded, low + 8 * k, np.maximum(length - 8 * k, 0))
        keys[:, -1] = length
        short = length <= LONGEST
        entry = np.full(len(low), -1, np.int64)
        entry[short] = self.table.find(keys[short])
        missing, known = np.flatnonzero(entry < 0), entry >= 0
        at, size = np.empty(len(low), np.int64), np.empty(len(low), np.int64)
        at[known], size[known] = self.table.start[entry[known]], self.table.size[entry[known]]
        if len(missing):
            fresh, far = missing[short[missing]], missing[~short[missing]]
            lead, back = leaders(keys[fresh])
            lead = fresh[lead]
            number: dict[bytes, int] = {}
            far_back = np.array([number.setdefault(raw[i:j], len(number)) for i, j in zip(low[far].tolist(), high[far].tolist(), strict=True)], np.int64)
            sizes, ids = self._new([raw[i:j].decode() for i, j in zip(low[lead].tolist(), high[lead].tolist(), strict=True)] + [x.decode() for x in number])
            table, first = self.table, self.table.count
            put = table.add(keys[lead], sizes[: len(lead)], ids)
            # What there was no room for lies behind the table's ids until the next batch.
            done = int(sizes[:put].sum())
            rest, extra = ids[done:], len(ids) - done
            if table.used + extra > len(table.ids):
                table.ids = np.concatenate((table.ids[: table.used], np.zeros(2 * extra + (len(table.ids) - table.used), np.uint32)))
            table.ids[table.used : table.used + extra] = rest
            begin = np.empty(len(sizes), np.int64)
            begin[:put] = table.start[first : first + put]
            begin[put:] = table.used + np.cumsum(sizes[put:]) - sizes[put:]
            at[fresh], size[fresh] = begin[back], sizes[back]
            at[far], size[far] = begin[len(lead) + far_back], sizes[len(lead) + far_back]
        ends = np.cumsum(size)
        ids = self.table.ids[np.repeat(at - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        upto = np.concatenate(([0], ends))[np.searchsorted(text_of, np.arange(len(texts) + 1))]
        data_out = memoryview(ids.tobytes())
        out = [bytes(data_out[4 * i : 4 * j]) for i, j in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
        for i, ids_of in zip(unsure.tolist(), self._whole([texts[i] for i in unsure.tolist()]), strict=True):
            out[i] = ids_of
        return out


@cache
def memo_encoder(path: str, spaces: str, entries: int = ENTRIES) -> MemoEncoder:
    """One for all tasks of a worker process."""
    return MemoEncoder(path, spaces, entries)
