"""Exact deduplication by content-defined chunk recipes, with DataFrame functions only.

Each text is normalised (the characters of ``SPACE`` go), cut at content-defined places and described by
its recipe, the ordered list of chunk identifiers. Chunk texts move once, reduced to distinct ones before
the shuffle, so that the grouping can compare them byte by byte: an identifier counts as verified when just
one text bears it. From there on only recipes move, never texts.

Defined cases: null text is the empty text; all empty or all-space texts are one group; a null ``doc_id`` is
never preferred over another row of its group; rows repeated with the same ``doc_id`` and text are one
document and get the same values (each is kept if one is); an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempoframe.llm.shared import SPACE, staged, text_or_empty

#: Chunks of 512 characters and more end at the first vowel pair before a late letter, in other scripts at the first two of their early
#: letters (Cyrillic, Arabic, Devanagari, kana, Han, Hangul), or at 4096: places that depend on what stands there.
CHUNK = r"(?s).{512,4093}?(?:[aeiou]{2}[n-z]|[\x{430}-\x{433}\x{627}-\x{62A}\x{905}-\x{90F}\x{3042}-\x{304B}\x{4E00}-\x{4E7F}\x{AC00}-\x{ACFF}]{2})|.{1,4096}"


def short_identifier(chunk: Column) -> Column:
    return F.struct(F.xxhash64(chunk).alias("a"), F.xxhash64(F.lit(1), chunk).alias("b"))


def long_identifier(chunk: Column) -> Column:
    return F.struct(F.sha2(chunk, 256).alias("a"))


def chunked(docs: DataFrame, pattern: str = CHUNK) -> DataFrame:
    """doc_id, points (code points of the original), text_sha256, chunks."""
    text = text_or_empty()
    normal = docs.select("doc_id", F.char_length(text).cast("long").alias("points"), F.regexp_replace(text, f"{SPACE}+", "").alias("normal"))
    return normal.select("doc_id", "points", F.sha2("normal", 256).alias("text_sha256"), F.regexp_extract_all("normal", F.lit(pattern), F.lit(0)).alias("chunks"))


def unverified(chunks: DataFrame, identifier) -> DataFrame:
    """Identifiers that more than one chunk text bears; texts are compared by the grouping itself."""
    each = chunks.select(F.explode("chunks").alias("chunk")).select(identifier(F.col("chunk")).alias("id"), "chunk")
    return each.groupBy("id", "chunk").agg(F.count(F.lit(1)).alias("n")).groupBy("id").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("id")


def recipes(docs: DataFrame, pattern: str = CHUNK, identifiers=(short_identifier, long_identifier)) -> DataFrame:
    """doc_id, points, text_sha256, recipe; the first kind of identifier that the byte comparison verifies."""
    chunks = chunked(docs, pattern)
    for identifier in identifiers:
        if unverified(chunks, identifier).isEmpty():
            return chunks.select("doc_id", "points", "text_sha256", F.transform("chunks", identifier).alias("recipe"))
    raise ValueError("different chunks share every kind of identifier")


def exact_dedup(docs: DataFrame, pattern: str = CHUNK, identifiers=(short_identifier, long_identifier)) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_chunks: one row per document.

    Of equal texts the row with the most code points in the original text stays, then the smallest doc_id.
    """
    listed = staged(recipes(docs, pattern, identifiers))
    order = F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("doc_id"))
    groups = staged(listed.groupBy("recipe").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("group_size")).select("recipe", F.col("first.doc_id").alias("keep_id"), "group_size"))
    return listed.join(groups, "recipe").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", F.size("recipe").alias("n_chunks"),
    )
