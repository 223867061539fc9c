"""Repeated passages by a sparse suffix array.

Suffixes are retained only where a minimiser stands: among the hashes of ``GRAM`` words that begin in any
``LEAST - GRAM + 1`` neighbouring places the smallest is selected (all of equal ones). What is selected depends on the
words alone, so that two copies of ``LEAST`` words retain suffixes at the same places. Retained suffixes are dealt
by their first ``GRAM`` words; those that stand alone are dropped, after counting them by task.

Of the others, occurrences with the same words around count as one class. The classes of a task are sorted by the words
that follow, and once more by the words before, nearest first. Neighbours are compared word by word, which gives how far each
match extends to the right and to the left; neighbours that share that many words form the intervals of a suffix array. A
window of ``LEAST`` words that begins d words before the minimiser is repeated if two occurrences share the interval of its d words to
the left and that of the others to the right. What is found are exactly the windows of ``LEAST`` words that occur in
two places of the corpus or more; overlapping ones join to spans.

No occurrence of a hot passage needs to meet all others: equal ones are counted before the shuffle, classes of a key
meet in one task only up to ``HOT_CLASSES``, and beyond that each window is hashed and counted by itself.

Words are what the characters of ``SPACE`` separate, as they are written. The ``GRAM`` words of a minimiser are known together by one number of 64 bits, each
of those around it by 48 bits of its own: two windows are taken for the same if these agree in place. An error needs two minimisers that share a number and the same words around them.

Defined cases: null text is the empty text; texts of fewer than ``LEAST`` words have no span; repeats within one text
count; rows with equal ``doc_id`` and different texts are each a text with spans of its own under that id, so are rows without a
``doc_id``; rows that repeat whole give their spans once; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempoframe.llm.shared import bounded_batches, partitions, staged, text_or_empty, union_all
from tempoframe.llm.words import words_as_written

LEAST, GRAM = 50, 26
AROUND = LEAST - GRAM
#: Bytes that are kept of the number of each word around.
WORD_BYTES = 6
#: Repeated keys (8 bytes each) are broadcast up to this number; beyond it documents are joined with theirs.
BROADCAST_KEYS = 4_000_000
HOT_CLASSES = 20_000
_R = 0xD6E8FEB86659FD93
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
CLASS = "key long, ctx long, near binary, left int, right int"


def _sliding(x: np.ndarray, n: int, best) -> np.ndarray:
    """best over n neighbouring values, by doubling."""
    done = 1
    while done * 2 <= n:
        x = best(x[:-done], x[done:])
        done *= 2
    return best(x[: len(x) - (n - done)], x[n - done :]) if n > done else x


def minimisers(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the selected GRAM-word groups; no group or window reaches over the end of a text."""
    width = LEAST - GRAM + 1
    n = len(words) - GRAM + 1
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    power = np.full(len(words), _R, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    back = np.full(n, pow(_R, -1, 1 << 64), np.uint64)
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * power, out=total[1:])
    gram = (total[GRAM:] - total[:-GRAM]) * back
    gram ^= gram >> np.uint64(31)
    gram *= _A
    gram ^= gram >> np.uint64(29)
    least = _sliding(gram, width, np.minimum)
    inside = np.zeros(len(least) + 1, np.int64)  # windows that lie in one text
    low, high = starts[:-1], starts[1:] - LEAST + 1
    full = high > low
    np.add.at(inside, low[full], 1)
    np.add.at(inside, high[full], -1)
    least[np.cumsum(inside[:-1]) == 0] = 0
    padded = np.concatenate((np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)))
    at = np.flatnonzero((_sliding(padded, width, np.maximum) == gram) & (gram != 0))
    return at, gram[at]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("tid", F.xxhash64("text"))


def repeated_keys(texts: DataFrame) -> DataFrame:
    """key of the minimisers that occur more than once; a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, n = np.unique(minimisers(*words_as_written(b.column(0)))[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int32))], ["key", "n"])

    each = texts.select("text").mapInArrow(run, "key long, n int")
    return staged(each.groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1").select("key"))


def surroundings(words: np.ndarray, starts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """AROUND words before (nearest first) and behind each minimiser, and how many the text has of either."""
    text = np.searchsorted(starts, at, "right") - 1
    left, right = np.minimum(at - starts[text], AROUND), np.minimum(starts[text + 1] - at - GRAM, AROUND)
    step = np.arange(AROUND)
    before = np.where(step < left[:, None], words[np.maximum(at[:, None] - 1 - step, 0)], 0)
    behind = np.where(step < right[:, None], words[np.minimum(at[:, None] + GRAM + step, len(words) - 1)], 0)
    return np.concatenate((before, behind), axis=1), left, right


def packed(near: np.ndarray) -> pa.Array:
    """The upper WORD_BYTES bytes of each number, a binary value for each row."""
    data = near.astype("<u8").view(np.uint8).reshape(*near.shape, 8)[:, :, 8 - WORD_BYTES :].tobytes()
    return pa.Array.from_buffers(pa.binary(), len(near), [None, pa.py_buffer((np.arange(len(near) + 1) * near.shape[1] * WORD_BYTES).astype("<i4")), pa.py_buffer(data)])


def unpacked(column: pa.ChunkedArray) -> np.ndarray:
    data = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 2 * AROUND, WORD_BYTES)
    out = np.zeros((len(data), 2 * AROUND, 8), np.uint8)
    out[:, :, 8 - WORD_BYTES :] = data
    return out.view("<u8")[:, :, 0]


def occurrences(texts: DataFrame, keys: DataFrame, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """doc_id, place and class of each repeated minimiser; a written table."""
    spark = texts.sparkSession
    few = keys.count() <= broadcast_keys
    held = spark.sparkContext.broadcast(np.sort(keys.toArrow().column(0).to_numpy()).view(np.int64) if few else None)
    if not few:  # the keys of each document, joined with its text

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                words, starts = words_as_written(b.column(1))
                at, gram = minimisers(words, starts)
                yield pa.RecordBatch.from_arrays([b.column(2).take(pa.array(np.searchsorted(starts, at, "right") - 1)), pa.array(gram.view(np.int64))], ["of", "key"])

        each = texts.mapInArrow(own, "of long, key long").distinct().join(keys, "key").groupBy("of").agg(F.collect_list("key").alias("keys"))
        texts = texts.join(staged(each), F.col("tid") == F.col("of")).select("doc_id", "text", "tid", "keys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, starts = words_as_written(b.column(1))
            at, gram = minimisers(words, starts)
            key, text = gram.view(np.int64), np.searchsorted(starts, at, "right") - 1
            if few:
                all_keys = held.value
                again = all_keys[np.minimum(np.searchsorted(all_keys, key), len(all_keys) - 1)] == key if len(all_keys) else np.zeros(len(key), bool)
            else:
                again = np.zeros(len(key), bool)
                for k, some in enumerate(b.column(3)):
                    mine = slice(*np.searchsorted(text, [k, k + 1]))
                    again[mine] = np.isin(key[mine], some.values.to_numpy())
            at, key, text = at[again], key[again], text[again]
            near, left, right = surroundings(words, starts, at)
            ctx = near @ (_B ** np.arange(1, 2 * AROUND + 1, dtype=np.uint64)) + left.astype(np.uint64) * _A + right.astype(np.uint64)
            columns = [b.column(0).take(pa.array(text)), b.column(2).take(pa.array(text)), pa.array((at - starts[text]).astype(np.int64)), pa.array(key), pa.array(ctx.view(np.int64)), packed(near), pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tid", "place", "key", "ctx", "near", "left", "right"])

    return staged(texts.mapInArrow(run, f"doc_id long, tid long, place long, {CLASS}"))


def window_hashes(key: np.ndarray, near: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the LEAST words that begin d words before the minimiser, a column for each d, and which of them exist."""
    m = len(key)
    sides = []
    for words, base in ((near[:, :AROUND], _A), (near[:, AROUND:], _B)):
        h = np.zeros((m, AROUND + 1), np.uint64)
        for d in range(AROUND):
            h[:, d + 1] = (h[:, d] + words[:, d] + np.uint64(1)) * base
            h[:, d + 1] ^= h[:, d + 1] >> np.uint64(32)
        sides.append(h)
    out = (sides[0] * _B + sides[1][:, ::-1]) ^ key.view(np.uint64)[:, None]
    d = np.arange(AROUND + 1)
    return out, (left[:, None] >= d) & (right[:, None] >= AROUND - d)


def _arrays(table: pa.Table) -> tuple[np.ndarray, ...]:
    key, left, right = (table.column(c).to_numpy() for c in ("key", "left", "right"))
    return key, unpacked(table.column("near")), left, right


def intervals(key: np.ndarray, side: np.ndarray) -> Iterator[np.ndarray]:
    """For 0, 1, ... words: number of the interval of each suffix, in which all share the key and so many words of that side.

    The suffixes are sorted once; neighbours in that order are compared.
    """
    order = np.lexsort((*side.T[::-1], key))
    alike = np.ones((len(key), side.shape[1] + 1), bool)
    alike[1:, 1:] = side[order[1:]] == side[order[:-1]]
    alike[1:, 0], alike[:1] = key[order[1:]] == key[order[:-1]], False
    shared = np.where(alike.all(axis=1), side.shape[1] + 1, np.argmin(alike, axis=1)) - 1  # words, -1 for another key
    for words in range(side.shape[1] + 1):
        number = np.empty(len(key), np.int64)
        number[order] = np.cumsum(shared < words)
        yield number


def _reach(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest and the smallest d of each row that has any."""
    return found.shape[1] - 1 - np.argmax(found[:, ::-1], axis=1), np.argmax(found, axis=1)


def _verdicts(classes: DataFrame) -> DataFrame:
    """key, ctx, most, fewest (d of repeated windows) of classes whose keys lie together in a task."""
    dealt = classes.repartition(partitions(classes.sparkSession), "key").sortWithinPartitions("key")

    def solve(table: pa.Table) -> pa.RecordBatch:
        key, near, left, right = _arrays(table)
        n = table.column("n").to_numpy()
        before, behind = list(intervals(key, near[:, :AROUND])), list(intervals(key, near[:, AROUND:]))
        found = np.zeros((len(key), AROUND + 1), bool)
        for d in range(AROUND + 1):
            rows = np.flatnonzero((left >= d) & (right >= AROUND - d))
            _, same = np.unique(before[d][rows] * (len(key) + 1) + behind[AROUND - d][rows], return_inverse=True)
            found[rows, d] = np.bincount(same, weights=n[rows])[same] > 1 if len(rows) else False
        most, fewest = _reach(found)
        some = found.any(axis=1)
        return pa.RecordBatch.from_arrays([pa.array(key[some]), pa.array(table.column("ctx").to_numpy()[some]), pa.array(most[some]), pa.array(fewest[some])], ["key", "ctx", "most", "fewest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column(b.schema.get_field_index("key")).to_numpy()
            if size > 50_000 and (cut := int(np.searchsorted(key, key[-1]))):
                yield solve(pa.Table.from_batches([*held, b.slice(0, cut)]))
                held, size, b = [], 0, b.slice(cut)
            held.append(b)
            size += b.num_rows
        if held:
            yield solve(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, "key long, ctx long, most long, fewest long")


def _hot_verdicts(classes: DataFrame) -> DataFrame:
    """The same for keys with very many classes: each window is counted by itself, wherever its class lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            table = pa.Table.from_batches([b])
            hashes, there = window_hashes(*_arrays(table))
            row, d = np.nonzero(there)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column("key").take(take), b.column("ctx").take(take), pa.array(d), pa.array(hashes[row, d].view(np.int64)), b.column("n").take(take)], ["key", "ctx", "d", "hash", "n"])

    each = staged(classes.mapInArrow(run, "key long, ctx long, d long, hash long, n long"))
    again = staged(each.groupBy("key", "d", "hash").agg(F.sum("n").alias("n")).filter("n > 1").drop("n"))
    return each.join(again, ["key", "d", "hash"]).groupBy("key", "ctx").agg(F.max("d").alias("most"), F.min("d").alias("fewest"))


def repeated_spans(docs: DataFrame, broadcast_keys: int = BROADCAST_KEYS, hot_classes: int = HOT_CLASSES) -> DataFrame:
    """doc_id, start_word, end_word: the longest spans of which each window of LEAST words occurs elsewhere, too."""
    bounded_batches(docs.sparkSession)
    texts = _texts(docs)
    places = occurrences(texts, repeated_keys(texts), broadcast_keys)
    classes = staged(places.groupBy(*[c.split()[0] for c in CLASS.split(", ")]).agg(F.count(F.lit(1)).alias("n")))
    hot = staged(classes.groupBy("key").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > hot_classes).select("key"))
    parts = [_verdicts(classes.join(hot, "key", "left_anti")), _hot_verdicts(classes.join(hot, "key", "left_semi"))]
    verdicts = staged(union_all(parts if not hot.isEmpty() else parts[:1]))
    found = places.select("doc_id", "tid", "place", "key", "ctx").join(verdicts, ["key", "ctx"])
    found = found.select("doc_id", "tid", (F.col("place") - F.col("most")).alias("start"), (F.col("place") - F.col("fewest") + LEAST).alias("end"))
    # Spans of one text that overlap or touch join.
    widest = found.groupBy("doc_id", "tid", "start").agg(F.max("end").alias("end"))
    order = Window.partitionBy("doc_id", "tid").orderBy("start")
    fresh = widest.withColumn("new", (F.col("start") > F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))).cast("int"))
    numbered = fresh.withColumn("span", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("doc_id", "tid", "span").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word")).drop("span", "tid")
