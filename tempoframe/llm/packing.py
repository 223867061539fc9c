"""Best-fit packing of documents into sequences, certified by dual-feasible functions.

Texts become token ids and an end id; only documents longer than a sequence are cut. A piece of full length is a
sequence of its own. All other pieces are dealt evenly to partitions; each partition packs its pieces by best-fit
decreasing and bounds the number of its sequences from below by dual-feasible functions. A partition that reaches
its bound is certified. As long as the whole is above the bound of the whole, sequences with free places are
opened again, in partitions with a gap all of them and in certified ones the emptiest, and their documents are
exchanged: dealt anew and packed again. An exchange counts only if it saves sequences; one that saves none, or the last of
``rounds``, ends the search. What is left above the bound is said in each row.

Only lengths and places move after the encoding, never texts or ids.

Defined cases: null and empty texts are the end id alone; repeated rows and rows with a null ``doc_id`` are packed
each on its own; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempoframe.llm.memo_tokens import memo_encoder
from tempoframe.llm.shared import bounded_batches, staged, text_or_empty

#: Pieces of one partition in an exchange, at most: some 200 MB.
MOST_PIECES = 1_000_000
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each item and the number of bins. Items go longest first where they leave least room."""
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, count = 0, 0  # bit r: some bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fitting = open_rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                open_rooms &= ~(1 << room)
        else:
            room, b = capacity, count
            count += 1
        bins[i], offsets[i] = b, capacity - room
        left = room - size
        by_room[left].append(b)
        if left:
            open_rooms |= 1 << left
    return bins, offsets, count


def lower_bound(histogram: np.ndarray, capacity: int, parts: int = 64) -> int:
    """The best of three families of dual-feasible functions; histogram[x]: items of length x."""
    x = np.arange(capacity + 1, dtype=np.int64)
    count, total = np.cumsum(histogram), np.cumsum(histogram * x)
    best = -(-int(total[-1]) // capacity)
    # Over half and small: lengths over C - t count as C, those below t as nothing.
    t = np.arange(1, capacity // 2 + 1)
    value = (count[-1] - count[capacity - t]) * capacity + total[capacity - t] - total[t - 1]
    best = max(best, int(-(-value.max(initial=0) // capacity)))
    for k in range(1, parts + 1):
        # Steps of 1 / k: exact multiples of C / (k + 1) keep their share, others round down.
        share, rest = np.divmod((k + 1) * x, capacity)
        best = max(best, -(-int((histogram * np.where(rest == 0, k * x, share * capacity)).sum()) // (k * capacity)))
        # Over half, pairs: a long item takes all that the largest partner of step k leaves.
        if (step := capacity // (k + 1)) > 0:
            low = x // step
            whole = capacity // step
            f = np.where(2 * x > capacity, 2 * (whole - (capacity - x) // step), np.where(2 * x == capacity, whole, 2 * low))
            best = max(best, -(-int((histogram * f).sum()) // (2 * whole)))
    return best


def pieces(docs: DataFrame, vocabulary: str, spaces: str = "dropped", end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: documents as ids with the end id, cut only where they are longer."""
    bounded_batches(docs.sparkSession)
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = memo_encoder(vocabulary, spaces, 400_000)
        for b in batches:
            rows: list[tuple] = []
            for i, ids in zip(b.column(0).to_pylist(), encoder.encode(b.column(1).to_pylist()), strict=True):
                data = ids + end
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    rows.append((i, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, PIECE)


def _packed(rows: DataFrame, capacity: int, per_part: int, number: int) -> DataFrame:
    """rows dealt evenly to partitions and packed there; a written table.

    sequence_id holds the round, the partition and the bin; gap: the partition's sequences above its bound.
    """
    count = rows.count()
    dealt = rows.repartition(max(1, -(-count // per_part)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        lengths = table.column("length").to_numpy()
        bins, offsets, n = best_fit_decreasing(lengths, capacity)
        gap = n - lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        filled = np.bincount(bins, weights=lengths, minlength=n).astype(np.int64)
        table = table.append_column("sequence_id", pa.array(bins + (number << 56) + (TaskContext.get().partitionId() << 28)))
        for name, values in (("offset", offsets), ("free", capacity - filled[bins]), ("gap", np.full(len(bins), gap))):
            table = table.append_column(name, pa.array(values))
        yield from table.to_batches(10_000)

    return staged(dealt.mapInArrow(run, f"{PIECE}, sequence_id long, offset long, free long, gap long"))


def _sequences(packed: DataFrame) -> int:
    return packed.filter("offset = 0").count()


def pack(rows: DataFrame, capacity: int = 4096, per_part: int = 100_000, rounds: int = 4) -> DataFrame:
    """Places each piece (columns of ``pieces``) at sequence_id and offset; gap: how many sequences there are above the lower bound, 0 if certified."""
    spark = rows.sparkSession
    full, rest = rows.filter(F.col("length") == capacity), rows.filter(F.col("length") < capacity)
    histogram = np.zeros(capacity + 1, np.int64)
    for r in rest.groupBy("length").count().collect():  # at most one row for each length
        histogram[r["length"]] = r["count"]
    bound = lower_bound(histogram, capacity)
    settled: list[DataFrame] = []
    opened = _packed(rest, capacity, per_part, 1)
    done, now = 0, _sequences(opened)
    for number in range(2, rounds + 2):
        if done + now <= bound:
            break
        # Of certified partitions the emptiest sequences, of those with a gap all that have room.
        loose = (F.col("free") > capacity // 16) | ((F.col("gap") > 0) & (F.col("free") > 0))
        again, stay = opened.filter(loose), opened.filter(~loose)
        before = _sequences(again)
        # What is exchanged meets in ever fewer partitions, up to what a task can hold.
        packed = _packed(again.select(*[f.split()[0] for f in PIECE.split(", ")]), capacity, max(per_part, min(per_part << 2 * (number - 1), MOST_PIECES)), number)
        after = _sequences(packed)
        if after >= before:
            break
        settled.append(stay)
        done, now, opened = done + now - before, after, packed
    names = [f.split()[0] for f in PIECE.split(", ")] + ["sequence_id", "offset"]
    out = full.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long")).select(names)
    for part in [*settled, opened]:
        out = out.unionByName(part.select(names))
    return out.withColumn("gap", F.lit(done + now - bound).cast("long"))


def best_fit_packing(docs: DataFrame, vocabulary: str, spaces: str = "dropped", end_id: int = 1, capacity: int = 4096, per_part: int = 100_000, rounds: int = 4) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, gap."""
    return pack(staged(pieces(docs, vocabulary, spaces, end_id, capacity)), capacity, per_part, rounds)
