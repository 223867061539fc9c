"""Line deduplication by content-defined chunks of lines.

A rolling hash over the hashes of the last lines ends a chunk wherever its low bits are zero, so that the places depend
on what stands there and not on what came before. Chunks of two lines and more that occur more than once in the corpus
stay where they first occur (smallest doc_id, then hash of the text, then place) and are removed everywhere else. Occurrences are the same
only if their bytes are: chunks are grouped by their text, after reduction to distinct ones in each task, and an
identifier that two texts bear is not used.

A boundary depends on two lines, so that the first lines of a repeated block may go with the differing line before it: of short repeated blocks among
other text (under a dozen lines) most lines stay. Whole copies and long blocks go.

Defined cases: null text is the empty text and comes back empty; texts of one line stay as they are; chunks of white
space alone stay; a text of which all chunks went is empty; rows with equal ``doc_id`` and different texts are documents of their own,
rows that repeat whole are one, and each keeps what it keeps; a null ``doc_id`` comes after all others; an empty table
gives no rows; further columns are carried along, ``n_chars`` is counted anew.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempoframe.llm.shared import bounded_batches, staged, text_or_empty

WINDOW, BITS, LINES = 2, 1, 2
#: The list of removals is broadcast up to this size, so that texts stay where they are; beyond it they are shuffled.
BROADCAST_BYTES = 48 << 20
_BASE, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def line_chunks(text: str, window: int = WINDOW, bits: int = BITS, least: int = LINES) -> list[str]:
    """Chunks whose concatenation with line ends between them is ``text``; all of ``least`` lines or more, if it has so many."""
    lines = text.split("\n")
    out: list[list[str]] = []
    now: list[str] = []
    hashes: list[int] = []
    top, rolled = pow(_BASE, window, 1 << 64), 0
    for i, line in enumerate(lines):
        hashes.append(xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass")))
        rolled = (rolled * _BASE + hashes[i] - (hashes[i - window] * top if i >= window else 0)) & _MASK
        now.append(line)
        if len(now) >= least and (rolled ^ rolled >> 31) & ((1 << bits) - 1) == 0:
            out.append(now)
            now = []
    if now and len(now) < least and out:
        out[-1] += now
    elif now:
        out.append(now)
    return ["\n".join(c) for c in out]


def short_digest(chunk: bytes) -> bytes:
    return xxhash.xxh3_128_digest(chunk)


def long_digest(chunk: bytes) -> bytes:
    return hashlib.sha256(chunk).digest()


def identified(text: str, digest: Callable[[bytes], bytes]) -> Iterator[tuple[int, bytes, str, bool]]:
    """place, identifier, text and whether it came before, of each chunk that may be removed."""
    met = set()
    for place, chunk in enumerate(line_chunks(text)):
        if "\n" in chunk and not chunk.isspace():
            i = digest(chunk.encode("utf-8", "surrogatepass"))
            yield place, i, chunk, i in met
            met.add(i)


def repeated_chunks(texts: DataFrame, digest: Callable[[bytes], bytes]) -> DataFrame:
    """texts: doc_id, tid, text. chunk_id, first (the row that keeps it), texts: of chunks that occur more than once; a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(doc, tid, i, chunk) for doc, tid, text in zip(*(c.to_pylist() for c in b.columns), strict=True) for _, i, chunk, _ in identified(text, digest)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.string()), strict=True)], ["doc_id", "tid", "chunk_id", "chunk"])

    each = texts.mapInArrow(run, "doc_id long, tid long, chunk_id binary, chunk string")
    same = each.groupBy("chunk_id", "chunk").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tid")).alias("first"))
    by_id = same.groupBy("chunk_id").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.count(F.lit(1)).alias("texts"))
    return staged(by_id.filter("n > 1").select("chunk_id", "first", "texts"))


def removals(texts: DataFrame, digests=(short_digest, long_digest)) -> tuple[DataFrame, Callable[[bytes], bytes]]:
    """doc_id, tid, gone, firsts: of each text the chunks to remove and those to keep at their first place only."""
    for digest in digests:
        groups = repeated_chunks(texts, digest)
        if groups.filter("texts > 1").isEmpty():
            break
    else:
        raise ValueError("different chunks share every kind of identifier")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(doc, tid, i, again) for doc, tid, text in zip(*(c.to_pylist() for c in b.columns), strict=True) for _, i, _, again in identified(text, digest)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.bool_()), strict=True)], ["doc_id", "tid", "chunk_id", "again"])

    places = texts.mapInArrow(run, "doc_id long, tid long, chunk_id binary, again boolean")
    first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("tid") == F.col("first.tid"))
    gone = places.join(groups, "chunk_id").filter(~first | F.col("again")).select("doc_id", "tid", "chunk_id", first.alias("first"))
    return staged(gone.groupBy("doc_id", "tid").agg(F.collect_set(F.when(~F.col("first"), F.col("chunk_id"))).alias("gone"), F.collect_set(F.when(F.col("first"), F.col("chunk_id"))).alias("firsts"))), digest


def line_dedup(docs: DataFrame, digests=(short_digest, long_digest), report: bool = False) -> DataFrame:
    """``docs`` with repeated chunks of lines removed from ``text``; ``report`` adds chunks_removed and lines_removed."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("tid"), text_or_empty().alias("text"))
    listed, digest = removals(texts, digests)

    @F.pandas_udf("text string, chunks_removed int, lines_removed int")
    def rebuilt(text: pd.Series, gone: pd.Series, firsts: pd.Series) -> pd.DataFrame:
        out = []
        for t, some, once in zip(text, gone, firsts, strict=True):
            if some is None and once is None:
                out.append((t, 0, 0))
                continue
            some, once, met, kept, chunks, lines = {bytes(x) for x in some}, {bytes(x) for x in once}, set(), [], 0, 0
            for chunk in line_chunks(t):
                i = digest(chunk.encode("utf-8", "surrogatepass"))
                if i in some or (i in once and i in met):
                    chunks, lines = chunks + 1, lines + chunk.count("\n") + 1
                else:
                    kept.append(chunk)
                met.add(i)
            out.append(("\n".join(kept), chunks, lines))
        return pd.DataFrame(out, columns=["text", "chunks_removed", "lines_removed"])

    names = docs.columns
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in names]).alias("row"), F.col("doc_id").cast("long").alias("key"), F.xxhash64(text_or_empty()).alias("key_tid"))
    size = listed.agg(F.coalesce(F.sum(F.lit(64) + 32 * (F.size("gone") + F.size("firsts"))), F.lit(0))).first()[0]
    of = listed.withColumnsRenamed({"doc_id": "key_of", "tid": "tid_of"})
    joined = rows.join(F.broadcast(of) if size <= BROADCAST_BYTES else of.hint("merge"), (F.col("key_tid") == F.col("tid_of")) & F.col("key").eqNullSafe(F.col("key_of")), "left")
    fresh = joined.select("row", rebuilt(F.coalesce(F.col("row.text").cast("string"), F.lit("")), "gone", "firsts").alias("new"))
    count = F.char_length("new.text").cast(docs.schema["n_chars"].dataType) if "n_chars" in names else None
    columns = [F.col("new.text").alias(c) if c == "text" else count.alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in names]
    return fresh.select(*columns, *(["new.chunks_removed", "new.lines_removed"] if report else []))
