"""Token ids in binary shards, each a wavelet matrix in one compressed file.

Texts are dealt by ranges of ``doc_id`` and encoded in that order; each task writes shards of a bounded number
of tokens. A shard holds its alphabet by falling frequency and one bit-plane for each bit of the codes, cut into
frames that are compressed singly, with the ones before each frame. That gives, without decoding the rest: the
token at a place (``access``), how often a token occurs before a place (``rank``, ``count``) and where its k-th
occurrence is (``select``, ``occurrences``). An opened frame keeps the ones before each of its ``WORD`` bits, so that a rank
costs one count of a word for each plane.

Files are read by the names in the manifest, so that what lost executors and speculative copies wrote besides is not read.

Defined cases: null text is the empty text (just the end id); rows with a null ``doc_id`` come first; rows with
equal ``doc_id`` are ordered by a hash of the text, then the text, repeated rows stay; an empty table writes no file and gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempoframe.llm.files import dealt_files, new_name, read_file, write_file
from tempoframe.llm.memo_tokens import memo_encoder
from tempoframe.llm.shared import bounded_batches, partitions, shared_folder, staged, text_or_empty

MAGIC = b"TFWM0001"
FRAME, WORD = 1 << 16, 64  # bits


class WaveletMatrix:
    """Reads what ``encode`` makes; frames are decompressed as they are needed."""

    @staticmethod
    def encode(tokens: np.ndarray, extra: dict | None = None, arrays: dict[str, np.ndarray] | None = None, level: int = 3) -> bytes:
        tokens = np.ascontiguousarray(tokens, np.uint32)
        n, top = len(tokens), int(tokens.max()) if len(tokens) else 0
        if top < 1 << 24:
            seen = np.bincount(tokens, minlength=top + 1) if n else np.zeros(0, np.int64)
            found = np.flatnonzero(seen)
            alphabet = found[np.argsort(-seen[found], kind="stable")].astype(np.uint32)
            code = np.zeros(top + 1, np.uint32)
            code[alphabet] = np.arange(len(alphabet), dtype=np.uint32)
            now = code[tokens] if n else tokens
        else:
            found, place, seen = np.unique(tokens, return_inverse=True, return_counts=True)
            order = np.argsort(-seen, kind="stable")
            alphabet, back = found[order].astype(np.uint32), np.empty(len(found), np.uint32)
            back[order] = np.arange(len(found), dtype=np.uint32)
            now = back[place]
        planes = max(1, int(len(alphabet) - 1).bit_length()) if n else 0
        now = now.astype(np.uint16) if planes <= 16 else now
        squeeze = zstandard.ZstdCompressor(level=level)
        body: list[bytes] = []
        place, frames, zeros = 0, [], []

        def put(data: bytes) -> tuple[int, int]:
            nonlocal place
            body.append(data)
            place += len(data)
            return place - len(data), len(data)

        for p in reversed(range(planes)):
            one = (now >> p) & 1 == 1
            bits = np.packbits(one, bitorder="little").tobytes()
            starts = np.arange(0, n, FRAME)
            before = np.concatenate(([0], np.cumsum(np.add.reduceat(one, starts, dtype=np.int64))))[:-1]
            frames += [(*put(squeeze.compress(bits[s // 8 : (s + FRAME) // 8])), int(b)) for s, b in zip(starts.tolist(), before, strict=True)]
            zeros.append(n - int(np.count_nonzero(one)))
            now = np.concatenate((now[~one], now[one]))
        held = {"alphabet": alphabet, "frames": np.array(frames, np.uint64).reshape(-1, 3), **(arrays or {})}
        where = {k: (*put(squeeze.compress(np.ascontiguousarray(v).tobytes())), v.dtype.str, v.shape) for k, v in held.items()}
        head = json.dumps({"n": n, "planes": planes, "zeros": zeros, "where": where, **(extra or {})}).encode()
        return MAGIC + struct.pack("<Q", len(head)) + head + b"".join(body)

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a wavelet shard")
        (size,) = struct.unpack_from("<Q", data, 8)
        self.head = json.loads(data[16 : 16 + size])
        self.data, self.base = memoryview(data), 16 + size
        self.n, self.planes, self.zeros = self.head["n"], self.head["planes"], self.head["zeros"]
        self._open = zstandard.ZstdDecompressor()
        self.alphabet, frames = self.array("alphabet"), self.array("frames")
        self.frames = frames.reshape(self.planes, -1, 3).astype(np.int64) if self.planes else frames
        self._codes: dict[int, int] | None = None
        self._kept: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def _part(self, at: int, size: int) -> bytes:
        return self._open.decompress(self.data[self.base + at : self.base + at + size])

    def array(self, name: str) -> np.ndarray:
        at, size, kind, shape = self.head["where"][name]
        return np.frombuffer(self._part(at, size), kind).reshape(shape)

    def _frame(self, plane: int, f: int) -> tuple[np.ndarray, np.ndarray]:
        """The frame's bits in words, and the ones before each word (and in all)."""
        if (plane, f) not in self._kept:
            if len(self._kept) >= 1024:
                self._kept.clear()
            at, size, _ = self.frames[plane, f]
            data = self._part(at, size)
            words = np.frombuffer(data + bytes(-len(data) % 8), "<u8")
            before = np.zeros(len(words) + 1, np.int64)
            np.cumsum(np.bitwise_count(words), out=before[1:])
            self._kept[plane, f] = words, before
        return self._kept[plane, f]

    def _bit(self, plane: int, i: int) -> int:
        f, rest = divmod(i, FRAME)
        return int(self._frame(plane, f)[0][rest // WORD]) >> rest % WORD & 1

    def _ones(self, plane: int, i: int) -> int:
        """Ones of a plane before place i."""
        if i >= self.n:
            return self.n - self.zeros[plane]
        f, rest = divmod(i, FRAME)
        words, before = self._frame(plane, f)
        w, rest = divmod(rest, WORD)
        return int(self.frames[plane, f, 2]) + int(before[w]) + (int(words[w]) & ((1 << rest) - 1)).bit_count()

    def _place(self, plane: int, bit: int, k: int) -> int:
        """Where the k-th (from 0) one or zero of a plane is."""
        ones = self.frames[plane, :, 2]
        before = ones if bit else np.arange(len(ones)) * FRAME - ones
        f = int(np.searchsorted(before, k, side="right")) - 1
        words, inner = self._frame(plane, f)
        inner = inner if bit else np.arange(len(inner)) * WORD - inner
        left = k - int(before[f])
        w = int(np.searchsorted(inner, left, side="right")) - 1
        word, left = int(words[w]) if bit else ~int(words[w]) & ((1 << WORD) - 1), left - int(inner[w])
        for _ in range(left):
            word &= word - 1
        return f * FRAME + w * WORD + (word & -word).bit_length() - 1

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        code = 0
        for p in range(self.planes):
            ones = self._ones(p, i)
            bit = self._bit(p, i)
            code, i = code * 2 + bit, self.zeros[p] + ones if bit else i - ones
        return int(self.alphabet[code])

    def _code(self, token: int) -> int | None:
        if self._codes is None:
            self._codes = {int(t): c for c, t in enumerate(self.alphabet)}
        return self._codes.get(token)

    def _range(self, code: int, i: int) -> tuple[int, int]:
        """Where the token's first i places end up in the last order: its range's start and end."""
        low, high = 0, i
        for p in range(self.planes):
            a, b = self._ones(p, low), self._ones(p, high)
            low, high = (self.zeros[p] + a, self.zeros[p] + b) if code >> (self.planes - 1 - p) & 1 else (low - a, high - b)
        return low, high

    def rank(self, token: int, i: int) -> int:
        """Occurrences of the token before place i."""
        if (code := self._code(token)) is None:
            return 0
        low, high = self._range(code, min(i, self.n))
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """The place of the token's k-th occurrence (from 0)."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        code = self._code(token)
        i = self._range(code, 0)[0] + k
        for p in reversed(range(self.planes)):
            bit = code >> (self.planes - 1 - p) & 1
            i = self._place(p, bit, i - self.zeros[p] if bit else i)
        return i

    def occurrences(self, token: int) -> Iterator[int]:
        return (self.select(token, k) for k in range(self.count(token)))

    def tokens(self) -> np.ndarray:
        """All tokens, from the last plane back to the first."""
        codes = np.zeros(self.n, np.uint32)
        for p in reversed(range(self.planes)):
            bits = b"".join(self._part(at, size) for at, size, _ in self.frames[p].tolist())
            one = np.unpackbits(np.frombuffer(bits, np.uint8), count=self.n, bitorder="little").view(bool)
            up = np.empty(self.n, np.uint32)
            up[~one] = codes[: self.zeros[p]]
            up[one] = codes[self.zeros[p] :] | np.uint32(1 << (self.planes - 1 - p))
            codes = up
        return self.alphabet[codes] if self.n else codes


def write_token_shards(docs: DataFrame, folder: str, vocabulary: str, spaces: str = "kept", end_id: int = 2, shard_tokens: int = 1 << 21) -> DataFrame:
    """Writes shards below ``folder`` (a URI) in order of doc_id; returns their manifest (a written table).

    part, number, name, before (tokens of earlier shards of the part), n_tokens, n_docs
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    # Rows that share an id, or have none, are ranged by their text's hash as well: no id is one task's.
    ranged = ["doc_id", "hash", "text"]
    dealt = rows.withColumn("hash", F.xxhash64("text")).repartitionByRange(partitions(spark), *ranged[:2]).sortWithinPartitions(*ranged).drop("hash")
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = memo_encoder(vocabulary, spaces), TaskContext.get().partitionId()
        ids: list[int | None] = []
        texts: list[bytes] = []
        size = number = before = 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, texts, size, number, before
            lengths = np.array([len(t) // 4 for t in texts], np.int64)
            arrays = {"doc_ids": np.array([i or 0 for i in ids], np.int64), "no_id": np.array([i is None for i in ids], np.uint8), "lengths": lengths}
            name = new_name("shard", number, "twm")
            write_file(folder, name, WaveletMatrix.encode(np.frombuffer(b"".join(texts), "<u4"), {"part": part, "number": number, "before": before}, arrays))
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "number": pa.array([number], pa.int64()), "name": [name], "before": pa.array([before], pa.int64()), "n_tokens": pa.array([size // 4], pa.int64()), "n_docs": pa.array([len(ids)], pa.int64())})
            number, before = number + 1, before + size // 4
            ids, texts, size = [], [], 0
            return row

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), encoder.encode(b.column(1).to_pylist()), strict=True):
                if texts and size + len(t) > 4 * shard_tokens:
                    yield flush()
                ids.append(i)
                texts.append(t + end)
                size += len(t) + 4
        if texts:
            yield flush()

    return staged(dealt.mapInArrow(run, "part long, number long, name string, before long, n_tokens long, n_docs long"))


def read_token_shards(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, shard, place (start in the shard), from the files alone.

    The manifest gives the tokens before each part: one number for each range of doc_id.
    """
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, shard string, place long")
    sums = {r["part"]: r["n"] for r in manifest.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    earlier, total = {}, 0
    for part in sorted(sums):
        earlier[part], total = total, total + sums[part]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, n_docs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                shard = WaveletMatrix(read_file(folder, name))
                ids, none, lengths = shard.array("doc_ids"), shard.array("no_id"), shard.array("lengths")
                if len(ids) != n_docs:
                    raise ValueError(f"{name}: {len(ids)} documents, {n_docs} in the manifest")
                places = np.cumsum(lengths) - lengths
                data = memoryview(shard.tokens().astype("<u4").tobytes())
                crc = [zlib.crc32(data[4 * p : 4 * (p + n)]) for p, n in zip(places.tolist(), lengths.tolist(), strict=True)]
                start = places + shard.head["before"] + earlier[shard.head["part"]]
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=none.astype(bool)), pa.array(start), pa.array(lengths), pa.array(crc, pa.int64()), pa.array([name] * len(ids), pa.string()), pa.array(places)], ["doc_id", "start", "n_tokens", "ids_crc32", "shard", "place"])

    return dealt_files(manifest.select("name", "n_docs")).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, shard string, place long")


def token_shards(docs: DataFrame, vocabulary: str, spaces: str = "kept", end_id: int = 2, shard_tokens: int = 1 << 21, folder: str | None = None) -> DataFrame:
    """Writes the shards and reads them back."""
    folder = folder or shared_folder(docs.sparkSession)
    return read_token_shards(docs.sparkSession, folder, write_token_shards(docs, folder, vocabulary, spaces, end_id, shard_tokens))
