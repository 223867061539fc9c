"""SimHash near-duplicates: 64-bit fingerprints linked within a Hamming radius by sharded BK-trees.

A shard holds the distinct fingerprints that agree in some blocks of bits. With ``blocks`` blocks, fingerprints
that differ in at most ``radius`` bits agree in ``blocks - radius`` of them, so that each link is found in some
shard, whatever the data. Within a shard one BK-tree is built (children keyed by their distance to the parent)
and all members are looked up in it, following only edges within the radius. Shards of more than ``limit``
members are dealt to several trees, and each pair of parts is its own task: nothing is capped.

Trees travel to nowhere: a tree of all fingerprints grows with the corpus, so that it is not broadcast; tree
and queries of a shard meet in one task instead.

Defined cases: null text is the empty text; texts without words have fingerprint zero and link like any other;
a null ``doc_id`` gets a fingerprint and its component's id, but is never that id unless all are null; rows that
repeat keep one row each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempoframe.llm.components import connected_components
from tempoframe.llm.shared import bounded_batches, partitions, staged, text_or_empty

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: str, width: int = 4, seed: int = 42) -> np.ndarray:
    """XXH64 of each ``width``-word shingle, repeats included; of all words where they are fewer."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, hash64 = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < width:
        return np.array([hash64(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1]
    return np.fromiter((hash64(joined[i:j], seed) for i, j in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def majority_bits(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str, width: int = 4, seed: int = 42) -> int:
    """Unsigned SimHash of the ``width``-word shingles of ``text``, repeats included."""
    return majority_bits(shingle_hashes(text, width, seed))


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long)."""
    bounded_batches(docs.sparkSession)
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.fromiter((fingerprint(t.as_py(), width, seed) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return columns.mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Children are keyed by their integer Hamming distance to the parent."""

    def __init__(self, values: list[int]):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []
        for v in values:
            self.add(v)

    def add(self, value: int) -> None:
        new, at = len(self.values), 0
        self.values.append(value)
        self.children.append({})
        while at != new:
            at = self.children[at].setdefault((value ^ self.values[at]).bit_count(), new)

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(node, numbers of the queries within the radius of it), following only edges within the radius."""
        todo = [(0, np.arange(len(queries)))] if self.values else []
        while todo:
            node, alive = todo.pop()
            value, children = self.values[node], self.children[node]
            if len(alive) > 24:
                away = np.bitwise_count(queries[alive] ^ np.uint64(value)).astype(np.int64)
                if len(near := alive[away <= radius]):
                    yield node, near
                for d, child in children.items():
                    if len(go := alive[np.abs(away - d) <= radius]):
                        todo.append((child, go))
            else:
                for i in alive.tolist():
                    q, stack = int(queries[i]), [node]
                    while stack:
                        n = stack.pop()
                        d = (q ^ self.values[n]).bit_count()
                        if d <= radius:
                            yield n, np.array([i])
                        stack += [c for k, c in self.children[n].items() if d - radius <= k <= d + radius]


def shard_links(left: np.ndarray, right: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links between members of ``left`` and ``right`` as a star for each group that they join."""
    members = np.concatenate((left, right)) if right is not left else left
    shift = len(left) if right is not left else 0
    parent = list(range(len(members)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for node, near in BKTree([int(v) for v in left]).within(right, radius):
        a = root(node)
        for i in near.tolist():
            if (b := root(i + shift)) != a:
                parent[b] = a
    return [(int(members[i]), int(members[r])) for i in range(len(members)) if (r := root(i)) != i]


def shard_keys(fp: Column, blocks: int, equal: int) -> Column:
    """One key for each choice of ``equal`` of the blocks: their bits, below the number of the choice."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for n, choice in enumerate(combinations(range(blocks), equal)):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in choice)
        keys.append(F.struct(F.lit(n).alias("n"), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("bits")))
    return F.array(*keys)


def blocks_for(count: int, radius: int, members: int = 64) -> int:
    """So many blocks that random fingerprints leave few members in a shard."""
    blocks = radius + 1
    while blocks < radius + 4 and count > members << int(64 * (blocks - radius) / blocks):
        blocks += 1
    return blocks


def links(distinct: DataFrame, radius: int = 4, blocks: int | None = None, limit: int = 4096) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that together join all that are within the radius."""
    spark = distinct.sparkSession
    blocks = blocks or blocks_for(distinct.count(), radius)
    keyed = distinct.select("fp", F.explode(shard_keys(F.col("fp"), blocks, blocks - radius)).alias("shard"))
    sizes = staged(keyed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("shard", F.ceil(F.col("n") / limit).cast("int").alias("parts")))
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    members = keyed.join(sizes, "shard").withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    members = members.select(F.xxhash64("shard", F.least("part", "other"), F.greatest("part", "other")).alias("task"), (F.col("part") <= F.col("other")).cast("int").alias("first"), (F.col("part") == F.col("other")).cast("int").alias("same"), "shard.n", "shard.bits", "fp")
    dealt = members.repartition(partitions(spark), "task").sortWithinPartitions("task", "n", "bits", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(table: pa.Table) -> pa.RecordBatch:
            task, n, bits = (table.column(c).to_numpy() for c in ("task", "n", "bits"))
            fp, first, same = table.column("fp").to_numpy().view(np.uint64), table.column("first").to_numpy(), table.column("same").to_numpy()
            cut = np.flatnonzero((task[1:] != task[:-1]) | (n[1:] != n[:-1]) | (bits[1:] != bits[:-1])) + 1
            out: list[tuple[int, int]] = []
            for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(task)], strict=True):
                if same[i]:
                    out += shard_links(fp[i:j], fp[i:j], radius)
                else:
                    out += shard_links(fp[i:j][first[i:j] == 1], fp[i:j][first[i:j] == 0], radius)
            pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        held: list[pa.Table] = []
        for b in batches:
            t = pa.Table.from_batches([b])
            task = b.column(0).to_numpy()
            last = int(np.searchsorted(task, task[-1])) if len(task) else 0  # rows of the last task may go on
            if last:
                yield solve(pa.concat_tables([*held, t.slice(0, last)]))
                held = []
            held.append(t.slice(last))
        if held and sum(map(len, held)):
            yield solve(pa.concat_tables(held))

    return dealt.mapInArrow(run, "a long, b long")


def simhash_components(docs: DataFrame, width: int = 4, seed: int = 42, radius: int = 4, blocks: int | None = None, limit: int = 4096) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id that can be reached)."""
    found = staged(fingerprints(docs, width, seed))
    nodes = staged(found.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = staged(connected_components(staged(links(nodes.select("fp"), radius, blocks, limit))))
    least = linked.join(nodes, linked.node == nodes.fp).groupBy("label").agg(F.min("least").alias("component_id"))
    named = linked.join(least, "label").select("node", "component_id")
    of = staged(nodes.join(named, nodes.fp == named.node, "left").select("fp", F.coalesce("component_id", "least").alias("component_id")))
    return found.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

