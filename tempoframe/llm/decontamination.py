"""Benchmark decontamination by spaced-seed hashing.

Fixed masks pick some of the words of a window and ignore the others, so that a substituted word spoils only the
windows that pick it. Hashes of all windows of the benchmark are joined with those of all windows of the documents;
around each hit item and document are laid on each other, and the best run of words in which matches outweigh
substitutions is kept if it is long enough. In texts with such a run the words themselves are compared, not only their
numbers. Repeated words hit as whole runs of places, so that neither side's repeats multiply the other's.

The benchmark's hashes are broadcast in blocks of a bounded number of words, one after the other: a larger benchmark takes
more passes over the documents, never a larger broadcast, and a pass's block is freed before the next.

Defined cases: null text is the empty text; items without words match nothing; an item of fewer words than a mask
spans is found where all its words stand together; an item counts as found from ``least`` matching words, or all of a
shorter one; where words repeat, each way in which item and text lie on each other is an overlap of its own; rows with a
null ``doc_id`` or ``item_id`` keep it; repeated rows give repeated counts; empty tables give
no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempoframe.llm.shared import bounded_batches, staged, text_or_empty, union_all
from tempoframe.llm.words import plain_words, word_numbers

#: Spans of 12 to 14 words, and four words in a row: where LEAST words or more match and SHARE of a run does, the
#: substitutions leave four neighbouring matches somewhere, so that no run which ``overlap`` accepts lacks a seed.
MASKS = ("110110110111", "1101011001011", "11100101001011", "101110011011", "1111")
LEAST, SHARE = 13, 0.8
#: Words of benchmark items in one broadcast, about.
BLOCK_WORDS = 500_000
#: Texts to drop are broadcast up to this number (16 bytes each), joined by shuffling beyond; a single block needs neither.
BROADCAST_IDS = 1_000_000
HIT = "doc_id long, item_id long, start long, end long, matched long"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def masked(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the picked words of each window."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, len(mask), np.uint64)
    for k, c in enumerate(mask):
        if c == "1":
            out *= _MIX
            out += words[k : k + n]
            out ^= out >> np.uint64(29)
    return out


def in_runs(key: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first row, number, step) of the runs of rows with one key and evenly spaced places; sorted by key and place."""
    step = np.where(key[1:] == key[:-1], np.diff(place), 0)
    rows = len(key)
    # A row goes on its run if it has the key and the step of the two before it; the second row of a run sets the step.
    fresh = np.ones(rows, bool)
    fresh[1:] = step == 0
    fresh[2:] |= (step[1:] != step[:-1]) & (step[:-1] != 0)
    first = np.flatnonzero(fresh)
    size = np.diff(np.append(first, rows))
    return first, size, np.where(size > 1, np.append(step, 0)[first], 1) if rows else size


def best_runs(same: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, matched) of the best run of each row; same: 1 for a match, 0 for a substitution, -1 outside the text.

    A match counts 1, a substitution share / (share - 1): a run of non-negative worth has that share of matches.
    """
    rows, n = same.shape
    total, hit = np.zeros((rows, n + 1)), np.zeros((rows, n + 1), np.int64)
    np.cumsum(np.choose(same + 1, [0.0, -share / (1 - share), 1.0]), axis=1, out=total[:, 1:])
    np.cumsum(same == 1, axis=1, out=hit[:, 1:])
    before = np.minimum.accumulate(total, axis=1)
    end, row = np.argmax(total - before, axis=1), np.arange(rows)
    least = (total == before[row, end][:, None]) & (np.arange(n + 1) <= end[:, None])
    start = n - np.argmax(least[:, ::-1], axis=1)
    return start, end, hit[row, end] - hit[row, start]


class SeedIndex:
    """Hashes of a block of items with where they come from."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.ids = [i for i, _ in items]
        self.words, self.starts = word_numbers([t for _, t in items])
        self.known: dict[int, str] = {}
        self.apart: dict[str, int] = {}  # words whose number another word of the block has taken
        for i, (number, word) in enumerate(zip(self.words.tolist(), (w for _, t in items for w in plain_words(t)), strict=True)):
            if self.known.setdefault(number, word) != word:
                self.words[i] = self.apart.setdefault(word, len(self.apart) + 1)
        sizes = np.diff(self.starts)
        self.longest = int(sizes.max(initial=0))
        span = min(map(len, MASKS))
        self.short = ["1" * n for n in sorted({int(n) for n in sizes if 0 < n < span})]
        hashes, owner, place = [], [], []
        for mask in (*MASKS, *self.short):
            for k, n in enumerate(sizes.tolist()):
                if n >= len(mask) if mask in MASKS else n == len(mask):
                    h = masked(self.words[self.starts[k] : self.starts[k + 1]], mask)
                    hashes.append(h)
                    owner.append(np.full(len(h), k))
                    place.append(np.arange(len(h)))
        h, o, p = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((hashes, np.uint64), (owner, np.int64), (place, np.int64)))
        order = np.lexsort((p, o, h))
        h, o, p = h[order], o[order], p[order]
        key = np.cumsum(np.append(0, (h[1:] != h[:-1]) | (o[1:] != o[:-1]))) if len(h) else h
        first, self.number, self.step = in_runs(key, p)
        self.hashes, self.owner, self.place = h[first], o[first], p[first]
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(self.hashes >> np.uint64(42)).astype(np.int64)] = True

    def hits(self, words: np.ndarray, starts: np.ndarray, block: int = 1 << 21) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, place of the item's first word in the text) of each window with a hash of the index; each once."""
        span = self.longest + int(np.diff(starts).max(initial=0)) + 1
        codes = [np.zeros(0, np.int64)]

        def put(first: np.ndarray, step: np.ndarray, number: np.ndarray) -> None:
            codes.append(np.unique(np.repeat(first - step * (np.cumsum(number) - number), number) + np.repeat(step, number) * np.arange(int(number.sum()))))
            if sum(map(len, codes)) > 2 * block:
                codes[:] = [np.unique(np.concatenate(codes))]

        for mask in (*MASKS, *self.short):
            h = masked(words, mask)
            at = np.flatnonzero(self.seen[(h >> np.uint64(42)).astype(np.int64)])
            text = np.searchsorted(starts, at, "right") - 1
            low = np.searchsorted(self.hashes, h[at], "left")
            there = (at + len(mask) <= starts[text + 1]) & (low < len(self.hashes))
            there[there] = self.hashes[low[there]] == h[at[there]]
            at, text, low = at[there], text[there], low[there]
            order = np.lexsort((at, text, low))
            at, text, low = at[order], text[order], low[order]
            first, number, step = in_runs(low * len(starts) + text, at)
            at, text, low = at[first] - starts[text[first]], text[first], low[first]
            high = np.searchsorted(self.hashes, self.hashes[low], "right")
            for i, j in _blocks((high - low) * number, block):
                n = (high - low)[i:j]
                run = np.repeat(np.arange(i, j), n)
                entry = np.repeat(low[i:j] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                # Runs of places with one step on both sides meet in a run of shifts; with two steps the text's is taken apart.
                apart = (number[run] > 1) & (self.number[entry] > 1) & (step[run] != self.step[entry])
                times = np.where(apart, number[run], 1)
                k = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
                run, entry, apart = np.repeat(run, times), np.repeat(entry, times), np.repeat(apart, times)
                own = np.where(number[run] > 1, step[run], self.step[entry])
                own[apart] = self.step[entry[apart]]
                begin = at[run] + k * step[run] - self.place[entry] - (self.number[entry] - 1) * own
                count = self.number[entry] + np.where(apart, 1, number[run]) - 1
                code = (text[run] * len(self.ids) + self.owner[entry]) * span + begin + self.longest
                for a, b in _blocks(count, block):
                    put(code[a:b], own[a:b], count[a:b])
        pair, shift = np.divmod(np.unique(np.concatenate(codes)), span)
        return *np.divmod(pair, max(len(self.ids), 1)), shift - self.longest

    def overlaps(self, item: int, words: np.ndarray, shifts: np.ndarray, least: int, share: float) -> list[tuple[int, int, int]]:
        """(start, end, matched) of the best run at each of the shifts where the item lies; those that are too short are left out."""
        own = self.words[self.starts[item] : self.starts[item + 1]]
        out = []
        for at in range(0, len(shifts), max(1, (1 << 20) // max(len(own), 1))):
            some = shifts[at : at + max(1, (1 << 20) // max(len(own), 1))]
            place = some[:, None] + np.arange(len(own))
            inside = (place >= 0) & (place < len(words))
            same = np.where(inside, words[np.clip(place, 0, len(words) - 1)] == own, -1)
            start, end, matched = best_runs(same, share)
            good = matched >= min(least, len(own))
            out += zip((some + start)[good].tolist(), (some + end)[good].tolist(), matched[good].tolist(), strict=True)
        return out

    def told_apart(self, words: np.ndarray, text: str) -> np.ndarray:
        """The numbers of a text's words, changed where another word has the number of one of the block."""
        out = words
        for i, (number, word) in enumerate(zip(words.tolist(), plain_words(text), strict=True)):
            if self.known.get(number, word) != word:
                out = words.copy() if out is words else out
                out[i] = self.apart.get(word, 0)
        return out

    def found(self, texts: list[str], least: int, share: float) -> list[tuple[int, int | None, int, int, int]]:
        """(number of the text, item_id, start, end, matched) of each overlap."""
        words, starts = word_numbers(texts)
        if self.apart:
            words = np.concatenate([self.told_apart(words[starts[d] : starts[d + 1]], t) for d, t in enumerate(texts)])
        text, item, shift = self.hits(words, starts)
        cut = np.flatnonzero((text[1:] != text[:-1]) | (item[1:] != item[:-1])) + 1
        done: set[tuple] = set()
        exact: dict[int, np.ndarray] = {}
        for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(text)], strict=True):
            if i == j:
                break
            d, k = int(text[i]), int(item[i])
            own = words[starts[d] : starts[d + 1]]
            got = self.overlaps(k, own, shift[i:j], least, share)
            if got:
                if d not in exact:
                    exact[d] = self.told_apart(own, texts[d])
                if exact[d] is not own:
                    got = self.overlaps(k, exact[d], shift[i:j], least, share)
            done |= {(d, k, *best) for best in got}
        return [(d, self.ids[k], *best) for d, k, *best in sorted(done)]


def _blocks(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of rows whose sizes add up to ``most``, about, or of one larger row."""
    if not len(sizes):
        return []
    cut = np.unique(np.searchsorted(np.cumsum(sizes), np.arange(most, int(sizes.sum()), most), "left")) + 1
    edges = np.unique(np.concatenate(([0], cut[cut < len(sizes)], [len(sizes)]))).tolist()
    return list(zip(edges[:-1], edges[1:], strict=True))


def seed_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[tuple]:
    """Broadcast indexes of the benchmark's items, each of about so many words, and how many there are in all."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text"))
    size = items.agg(F.sum(F.size(F.split(F.trim("text"), r"\s+")))).first()[0] or 0
    blocks = max(1, -(-size // block_words))
    for block in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()  # block_words, about
        yield spark.sparkContext.broadcast(SeedIndex([(r["item_id"], r["text"]) for r in own])), blocks


def benchmark_overlaps(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, share: float = SHARE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, start, end (words of the document), matched: each place where an item's words are found."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    passes = []
    for index, blocks in seed_blocks(benchmark, block_words):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids = b.column(0).to_pylist()
                rows = [(ids[d], *rest) for d, *rest in index.value.found(b.column(1).to_pylist(), least, share)]
                columns = list(zip(*rows, strict=True)) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "start", "end", "matched"])

        found = texts.mapInArrow(run, HIT)
        if blocks == 1:
            return found
        passes.append(staged(found))
        index.destroy()
    return union_all(passes)


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, item_id, places, matched (words of the longest): one row per document and item found in it."""
    found = benchmark_overlaps(docs, benchmark, **options)
    return found.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("places"), F.max("matched").alias("matched"))


def without_benchmark(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, share: float = SHARE, block_words: int = BLOCK_WORDS, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """The rows of ``docs`` in which no item is found, unchanged."""
    bounded_batches(docs.sparkSession)
    name, hits = [F.xxhash64(text_or_empty()).alias("_a"), F.xxhash64(F.lit(1), text_or_empty()).alias("_b")], []
    for index, blocks in seed_blocks(benchmark, block_words):
        clean = _clean(index, least, share)(text_or_empty())
        if blocks == 1:
            return docs.filter(clean)
        hits.append(staged(docs.filter(~clean).select(*name).distinct()))
        index.destroy()
    gone = staged(union_all(hits).distinct())
    few = gone.limit(broadcast_ids + 1).count() <= broadcast_ids
    return docs.join(F.broadcast(gone) if few else gone.hint("merge"), (name[0] == F.col("_a")) & (name[1] == F.col("_b")), "left_anti")


def _clean(index, least: int, share: float):
    @F.pandas_udf("boolean")
    def clean(text: pd.Series) -> pd.Series:
        out = np.ones(len(text), bool)
        out[[d for d, *_ in index.value.found(text.tolist(), least, share)]] = False
        return pd.Series(out)

    return clean
