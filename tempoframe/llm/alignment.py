"""Alignment of two tokenizers over the same texts, as joins and windows over token tables.

Tokens lie at byte ranges of the text with a space before it. Their lengths, summed along the text, say where each begins and what came before it ends.
Tokens of both sides that meet at the same end share a row: an equi-join on text and end, written as a grouping, as both sides come from one exploded table
and lie together (a full join would deal them anew). A row with both is a cut, and the running count of cuts is its group. Two tokens overlap in one stretch
without any end inside, so that each row is one link: of the last token of either side that began here or before. Nothing is compared in pairs, and a group of any length costs its length.

Texts are aligned in parts. Where white space (a space or a line end) follows a visible character, both tokenizers surely cut, whatever stands around: the
pattern of the byte-level one has no piece with white space behind anything else, and the other has no token with a space behind another character and none
with a line end but its byte (both is looked up in the vocabularies). Each different part of the corpus is encoded and aligned once; the counts of
linked ids are its links times its occurrences. Parts come back to the documents by buckets of texts: a bucket's different parts are joined with what was
found for them, and its documents are put together from these.

The bytes of both sides equal the text's unless it has a U+2581, which one side takes for a space; then the whole text is encoded to tell.

Defined cases: texts that are null, empty or differ in their bytes have no tokens: zeros and the empty string; they take no part in the counts. Repeated rows,
equal ids and null ids are aligned row by row and count as often as they occur; very long texts without white space are one part; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempoframe.llm.shared import bounded_batches, partitions, release, staged, text_or_empty, tidy

#: Behind a visible character (none that any of the two takes for white space) and before a space or a line end.
VISIBLE = "!-~¡-ᙿ⁰-▀▂-⿿、-퟿"
CUT, ODD, ENDED = re.compile(f"(?<=[{VISIBLE}])(?=[ \\n])"), re.compile(f"[^ \\n{VISIBLE}]"), re.compile(f"[{VISIBLE}]\\Z")
MARK = "▁"
#: Parts that a task counts before it passes them on, and that a bucket of documents holds, about.
COUNTED, BUCKET = 600_000, 6_000_000
#: Bytes of rows that a task gathers before it deals them to their buckets, about.
BOXED = 32 << 20
#: Parts that are encoded as one text.
TOGETHER = 1000
#: Pairs of ids with their counts are broadcast up to this number; more are joined by shuffling.
BROADCAST_PAIRS = 1_000_000
SUMS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def parts_of(text: str) -> list[str]:
    """The parts of a text with a space before it, by their names: a single space before a visible character goes without saying."""
    if not (ODD.search(text) or text[0] in " \n" or text[-1] in " \n" or any(x in text for x in ("  ", "\n\n", " \n", "\n "))):
        return text.replace("\n", " \n").split(" ")  # what nearly all texts are: one white space between words
    return [p[1:] if len(p) > 1 and p[0] == " " and p[1] not in " \n" else p for p in CUT.split(" " + text)]


def part_text(name: str) -> str:
    return name if name[0] in " \n" else " " + name


# --- the tokenizers ---


class Pair:
    """Both tokenizers: ids of parts and the bytes of each id."""

    def __init__(self, byte_level: str, pieces: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(byte_level), sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.a.encode_special_tokens = True
        names = {i: s for s, i in self.a.get_vocab(with_added_tokens=True).items()}
        plain = self._byte_characters()
        self.a_bytes = [bytes(plain.get(c, 63) for c in names.get(i, "")) for i in range(max(names) + 1)]
        self.b_bytes = [self._piece(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.a_size, self.b_size = (np.array([len(x) for x in side], np.int32) for side in (self.a_bytes, self.b_bytes))
        pieces_of = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("\n" in p or re.search(f"[^{MARK}]{MARK}", p) for p in pieces_of):
            raise ValueError("this vocabulary has tokens across the places where texts are cut")

    @staticmethod
    def _byte_characters() -> dict[str, int]:
        """The character that stands for each byte: itself where it can be seen, else the next one from 256 on."""
        seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(seen)]
        return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(others)}

    @staticmethod
    def _piece(piece: str) -> bytes:
        if m := re.fullmatch(r"<0x([0-9A-F]{2})>", piece):
            return bytes([int(m[1], 16)])
        return piece.replace(MARK, " ").encode()

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_b(self, texts: list[str]) -> list[list[int]]:
        """Of texts that begin with a space, which the tokenizer adds itself, or of parts that begin with a line end."""
        found = self.b.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1)
        space = self.b.piece_to_id(MARK)
        for k, t in enumerate(texts):
            if t[0] != " ":
                if found[k][:1] != [space]:
                    raise ValueError("a space is joined with a line end")
                found[k] = found[k][1:]
            elif len(t) == 1:  # nothing is added to nothing
                found[k] = [space]
        return found

    def agree(self, text: str) -> bool:
        """The bytes of both sides are the text's."""
        whole = (" " + text).encode()
        return all(b"".join(side[i] for i in ids) == whole for side, ids in ((self.a_bytes, self.encode_a([" " + text])[0]), (self.b_bytes, self.b.encode(text, num_threads=1))))


@cache
def pair(byte_level: str, pieces: str) -> Pair:
    """One for all tasks of a worker process."""
    return Pair(byte_level, pieces)


def fair(text: str | None, byte_level: str, pieces: str) -> bool:
    """The text has tokens; the tokenizers are loaded only for one that needs them (they take about 100 MB of a worker)."""
    return bool(text) and (MARK not in text or pair(byte_level, pieces).agree(text))


# --- different parts, their tokens and their groups ---


def counted_parts(texts: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """part and n, its occurrences in the texts that have tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(met), pa.string()), pa.array(list(met.values()), pa.int64())], ["part", "n"])
            met.clear()
            return out

        for b in batches:
            for t in b.column(0).to_pylist():
                if fair(t, byte_level, pieces):
                    met.update(parts_of(t))
                    if len(met) > COUNTED:
                        yield flush()
        if met:
            yield flush()

    return texts.select("text").mapInArrow(run, "part string, n long").groupBy("part").agg(F.sum("n").alias("n"))


def encoded_parts(encode: Callable[[list[str]], list[list[int]]], size: np.ndarray, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the parts, and how many each has. Parts that end in a visible character are encoded many at a time, one behind the other."""
    ids, counts = [], []

    def put(some: list[str]) -> None:
        found = np.array(encode(["".join(some)])[0], np.int64)
        ends, wanted = np.cumsum(size[found]), np.cumsum([len(p.encode()) for p in some])
        at = np.searchsorted(ends, wanted)
        if len(some) > 1 and not (len(ends) and ends[-1] == wanted[-1] and (ends[at] == wanted).all()):
            raise ValueError("a token reaches over a place where texts are cut")
        ids.append(found)
        counts.append(np.diff(at + 1, prepend=0) if len(some) > 1 else np.array([len(found)]))

    some: list[str] = []
    for p in parts:
        if ENDED.search(p):
            some.append(p)
            if len(some) == TOGETHER:
                put(some)
                some = []
        else:
            if some:
                put(some)
                some = []
            put([p])
    if some:
        put(some)
    return np.concatenate([np.zeros(0, np.int64), *ids]), np.concatenate([np.zeros(0, np.int64), *counts])


def tokens(parts: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """part, n and tokens (side, id, size in bytes): those of either side in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(byte_level, pieces)
        for b in batches:
            texts = [part_text(p) for p in b.column(0).to_pylist()]
            sides = [encoded_parts(both.encode_a, both.a_size, texts), encoded_parts(both.encode_b, both.b_size, texts)]
            ids, counts = np.concatenate([s[0] for s in sides]), [s[1] for s in sides]
            side = np.repeat(np.array([0, 1], np.int8), [len(s[0]) for s in sides])
            order = np.argsort(np.concatenate([np.repeat(np.arange(len(texts)), c) for c in counts]), kind="stable")
            ids, side = ids[order], side[order]
            size = np.where(side == 0, both.a_size[np.where(side == 0, ids, 0)], both.b_size[np.where(side == 0, 0, ids)])
            cells = pa.StructArray.from_arrays([pa.array(side), pa.array(ids, pa.int32()), pa.array(size, pa.int32())], ["side", "id", "size"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts[0] + counts[1])), pa.int32()), cells)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], ["part", "n", "tokens"])

    return parts.mapInArrow(run, "part string, n long, tokens array<struct<side:tinyint,id:int,size:int>>")


def aligned(rows: DataFrame) -> DataFrame:
    """rows: key, tokens (dealt by key). key, end (of what came before), a, b (ids of the tokens that begin there), group (from 1), link_a, link_b (those that overlap behind it)."""
    each = rows.select("key", F.posexplode("tokens").alias("pos", "token")).select("key", "pos", "token.*")
    before = Window.partitionBy("key", "side").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select("key", "side", "id", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("end"))
    met = each.groupBy("key", "end").agg(*(F.max(F.when(F.col("side") == k, F.col("id"))).alias(side) for k, side in enumerate("ab")))
    upto = Window.partitionBy("key").orderBy("end").rowsBetween(Window.unboundedPreceding, 0)
    cut = F.col("a").isNotNull() & F.col("b").isNotNull()
    return met.select("*", F.sum(cut.cast("int")).over(upto).alias("group"), *(F.last(side, ignorenulls=True).over(upto).alias(f"link_{side}") for side in "ab"))


def grouped(rows: DataFrame) -> DataFrame:
    """key, groups (its text form), n_a, n_b, n_groups, n_links, links (array of a, b): of each key."""
    mark = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), ";").otherwise(",")  # what stands before an id: a group's first, or a further one
    cell = F.struct("end", *(F.concat(mark, F.col(side).cast("string")).alias(side) for side in "ab"), F.struct(F.col("link_a").alias("a"), F.col("link_b").alias("b")).alias("link"))
    each = aligned(rows).groupBy("key").agg(F.array_sort(F.collect_list(cell)).alias("cells"), F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.max("group").alias("n_groups"))
    sides = [F.split(F.substring(F.array_join(f"cells.{side}", ""), 2, 1 << 30), ";") for side in "ab"]  # nulls are left out
    text = F.array_join(F.zip_with(*sides, lambda a, b: F.concat(a, F.lit("|"), b)), ";")
    return each.select("key", text.alias("groups"), "n_a", "n_b", "n_groups", F.size("cells").cast("long").alias("n_links"), F.col("cells.link").alias("links"))


def short_name(part: Column) -> Column:
    """What a part is joined by: itself, or a digest of a long one, which would stand beside each of its many tokens."""
    return F.when(F.length(part) <= 64, part).otherwise(F.concat(F.lit("\0"), F.sha2(part, 256)))


def link_counts(parts: DataFrame) -> DataFrame:
    """a, b, count (links of the corpus that hold both), best (1 where the count is the highest of its b): from n and links of the parts."""
    each = parts.select("n", F.explode("links").alias("link")).groupBy("link.a", "link.b").agg(F.sum("n").alias("count"))
    return each.withColumn("best", (F.col("count") == F.max("count").over(Window.partitionBy("b"))).cast("int"))


def weighed(parts: DataFrame, counts: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """name, n_best, count_sum of the parts."""
    few = counts.limit(broadcast_pairs + 1).count() <= broadcast_pairs
    each = parts.select("name", F.explode("links").alias("link")).select("name", "link.a", "link.b")
    each = each.join(F.broadcast(counts) if few else counts.hint("merge"), ["a", "b"])
    return each.groupBy("name").agg(F.sum("best").alias("n_best"), F.sum("count").alias("count_sum"))


# --- documents from parts ---


def boxed(rows: DataFrame) -> DataFrame:
    """bucket, rows: the rows of a bucket that a task has, without the bucket, some at once as one compressed Arrow stream. It takes about half the disk of rows dealt singly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            bucket = table.column("bucket").to_numpy()
            order = np.argsort(bucket, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0))
            options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
            for low, high in zip(first, [*first[1:], len(order)], strict=True):
                own, sink = table.take(pa.array(order[low:high])).drop_columns("bucket"), pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, own.schema, options=options) as out:
                    out.write_table(own)
                yield pa.RecordBatch.from_arrays([pa.array([bucket[order[low]]], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["bucket", "rows"])

        for b in batches:
            held.append(b)
            size += b.nbytes
            if size > BOXED:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    return rows.mapInArrow(run, "bucket int, rows binary")


def unboxed(box: pa.BinaryScalar) -> pa.Table:
    return pa.ipc.open_stream(box.as_buffer()).read_all()


class Places:
    """Where each part stands in a list of parts, by hashes: 12 bytes a part, where a dictionary of strings takes some 200. Different parts of one hash go by a dictionary."""

    def __init__(self, parts: pa.ChunkedArray, key: Callable[[str], int] = hash):
        self.key = key
        found = np.concatenate([np.zeros(0, np.int64), *(self._keys(x.to_pylist()) for x in parts.chunks)])
        self.place = np.argsort(found, kind="stable").astype(np.int32)
        self.keys = found[self.place]
        again = np.flatnonzero(self.keys[1:] == self.keys[:-1])  # the same part, or another of its hash
        differ = pc.not_equal(*(parts.take(pa.array(self.place[k])) for k in (again, again + 1))).to_numpy()
        shared = np.isin(self.keys, self.keys[again[differ]]) if differ.any() else np.zeros(0, bool)
        self.others = {parts[int(k)].as_py(): int(k) for k in self.place[np.flatnonzero(shared)]}

    def _keys(self, parts: list[str]) -> np.ndarray:
        return np.fromiter(map(self.key, parts), np.int64, len(parts))

    def of(self, parts: list[str]) -> np.ndarray:
        """The places of parts that are all in the list."""
        keys = self._keys(parts)
        at = np.searchsorted(self.keys, keys)
        if len(at) and (at.max() == len(self.keys) or (self.keys[at] != keys).any()):
            raise KeyError("a part of a text was not found")
        mine = self.place[at]
        if self.others:
            mine = np.array([self.others.get(p, k) for p, k in zip(parts, mine.tolist(), strict=True)], np.int32)
        return mine


def _bucketed(docs: DataFrame, found: DataFrame, buckets: int, byte_level: str, pieces: str) -> DataFrame:
    """found: name, groups and the SUMS. doc_id, the SUMS and groups_sha256 of each row of docs (doc_id, text)."""
    dealt = boxed(docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int").alias("bucket"))).repartition(buckets, "bucket")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for bucket, some in met.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), bucket, np.int32)), pa.array(list(some), pa.string())], ["bucket", "part"])
            met.clear()

        for b in batches:
            for bucket, box in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for t in unboxed(box).column("text").to_pylist():
                    if fair(t, byte_level, pieces):
                        met.setdefault(bucket, set()).update(parts_of(t))
                if sum(map(len, met.values())) > 3 * COUNTED:  # a bucket's parts, mostly once
                    yield from flush()
        yield from flush()

    name = short_name(F.col("part"))
    needed = dealt.mapInArrow(own, "bucket int, part string").select("bucket", F.when(name != F.col("part"), F.col("part")).alias("long"), name.alias("name"))
    needed = needed.join(found.hint("merge"), "name").select("bucket", F.coalesce("long", "name").alias("part"), F.concat("groups", F.lit(";")).alias("groups"), *SUMS)

    def together(left: pa.Table, right: pa.Table) -> pa.Table:
        boxes = [unboxed(box) for box in right.column("rows")]
        sums = np.empty((sum(x.num_rows for x in boxes), len(SUMS)), np.int64)
        for j, c in enumerate(SUMS):
            sums[:, j] = np.concatenate([np.zeros(0, np.int64), *(x.column(c).to_numpy() for x in boxes)])
        groups = pa.concat_arrays([pa.array([], pa.large_string()), *(x.cast(pa.large_string()) for t in boxes for x in t.column("groups").chunks)])
        parts = pa.chunked_array([x for t in boxes for x in t.column("part").chunks], pa.string())
        del boxes
        places = Places(parts)
        ids, out, digests = [], [], []
        for box in left.column("rows"):
            docs = unboxed(box)
            ids += docs.column("doc_id").to_pylist()
            for t in docs.column("text"):
                t = t.as_py()
                if not fair(t, byte_level, pieces):
                    out.append(np.zeros(len(SUMS), np.int64))
                    digests.append("")
                    continue
                mine = places.of(parts_of(t))
                out.append(sums[mine].sum(axis=0))
                text = groups.take(pa.array(mine))
                end = int(np.frombuffer(text.buffers()[1], np.int64)[len(text)])  # one text lies behind the other
                digests.append(hashlib.sha256(memoryview(text.buffers()[2])[: end - 1]).hexdigest())
        rows = np.array(out, np.int64).reshape(len(out), len(SUMS))
        return pa.table([pa.array(ids, pa.int64()), *(pa.array(rows[:, j]) for j in range(len(SUMS))), pa.array(digests, pa.string())], ["doc_id", *SUMS, "groups_sha256"])

    schema = ", ".join(["doc_id long", *(f"{c} long" for c in SUMS), "groups_sha256 string"])
    return dealt.groupBy("bucket").cogroup(boxed(needed).groupBy("bucket")).applyInArrow(together, schema)


def cross_tokenizer_alignment(docs: DataFrame, byte_level: str, pieces: str, bucket: int = BUCKET, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; the two vocabularies as files."""
    spark = docs.sparkSession
    bounded_batches(spark, 20_000)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    encoded = staged(tokens(counted_parts(rows, byte_level, pieces), byte_level, pieces).withColumn("key", F.monotonically_increasing_id()))
    total = encoded.agg(F.sum("n")).first()[0] or 0
    dealt = encoded.select("key", "tokens").repartition(partitions(spark), "key")
    parts = staged(grouped(dealt).join(encoded.select("key", short_name(F.col("part")).alias("name"), "n").hint("merge"), "key").drop("key"))
    release(encoded)
    del encoded, dealt
    counts = staged(link_counts(parts))
    tidy(spark)  # a plan is let go of once another has run
    found = parts.join(weighed(parts, counts, broadcast_pairs).hint("merge"), "name").select("name", "groups", *SUMS)
    return _bucketed(rows, found, max(1, -(-total // bucket)), byte_level, pieces)
