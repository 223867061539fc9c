"""Identity, caching and writers."""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType

from tempoframe.sources.folders import write_file, written

#: Letters of the key that name an entry's folder.
PREFIX = 2
CACHE = "cache_key string, metrical_shift int, beats array<double>"


def reading(detector: str | None = None, search: bool = False) -> str:
    """Which way of reading beats a result belongs to."""
    return f"detector:{detector}" if detector else "search" if search else "peaks"


def cache_key(build: str, path: Column, size: Column, modified: Column, how: str | None = None) -> Column:
    """First 32 hex digits of the SHA-256 over build, reading, and path, size and time of a file (-1 and 0 for a missing one)."""
    parts = [F.lit(build), *([F.lit(how)] if how else []), F.concat_ws("|", path, F.coalesce(size, F.lit(-1)).cast("string"), F.coalesce(modified, F.lit(0)).cast("string"))]
    return F.substring(F.sha2(F.concat(*[x for p in parts for x in (p, F.lit("\n"))]), 256), 1, 32)


def file_keys(spark: SparkSession, folder: str, build: str, how: str | None = None, pattern: str = "*") -> DataFrame:
    """path, cache_key of files, from their metadata alone."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return found.select("path", cache_key(build, F.col("path"), F.col("length"), F.unix_micros("modificationTime"), how).alias("cache_key"))


def _prefix() -> Column:
    return F.substring("cache_key", 1, PREFIX)


def _entries(grids: DataFrame) -> DataFrame:
    return grids.filter(F.size("beats") > 0).select("cache_key", F.col("metrical_shift").cast("int").alias("metrical_shift"), F.transform("beats", lambda b: F.round(b, 3)).alias("beats"))


def store(grids: DataFrame, folder: str) -> None:
    """Puts grids (cache_key, metrical_shift, beats) into a Parquet cache, times to a thousandth; empty ones are not kept.

    The cache lies in folders by the first letters of the key. Those that new entries fall into are written anew, with the entries of other keys as they were, and
    take the place of the old ones: an entry overwrites that of its key, and no folder gathers small files. Of several new entries of a key the largest stays.
    """
    spark = grids.sparkSession
    new = written(_entries(grids).groupBy("cache_key").agg(F.max(F.struct("metrical_shift", "beats")).alias("e")).select("cache_key", "e.*"))
    others = load(spark, folder, new.select("cache_key")).join(new.select("cache_key"), "cache_key", "left_anti")
    rows = written(new.unionByName(others)).withColumn("prefix", _prefix())
    rows.repartition("prefix").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("prefix").parquet(folder)


def load(spark: SparkSession, folder: str, keys: DataFrame | None = None) -> DataFrame:
    """The cache, or only the folders in which ``keys`` (cache_key) may lie; anything that cannot be read is a miss."""
    try:
        rows = spark.read.schema(f"{CACHE}, prefix string").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").parquet(folder)
    except AnalysisException:
        return spark.createDataFrame([], CACHE)
    if keys is not None:
        asked = [r["p"] for r in keys.select(_prefix().alias("p")).distinct().collect()]  # 16 ** PREFIX at most
        rows = rows.filter(F.col("prefix").isin(asked))
    return rows.filter("cache_key IS NOT NULL AND size(beats) > 0").drop("prefix")


def text_entry(lines: Column) -> Column:
    """metrical_shift, beats of an entry of three lines (header, shift, comma list); null if anything is amiss."""
    part = F.split(lines, "\n")
    beats = F.transform(F.split(F.get(part, F.lit(2)), ","), lambda x: x.try_cast("double"))
    shift = F.trim(F.get(part, F.lit(1))).try_cast("int")
    whole = F.get(part, F.lit(0)).rlike(r"^\S+-beatgrid 1$") & shift.isNotNull() & ~F.exists(beats, lambda b: b.isNull())
    return F.when(whole, F.struct(shift.alias("metrical_shift"), beats.alias("beats")))


def entry_text(shift: Column, beats: Column, name: str = "tempoframe") -> Column:
    shown = F.transform(beats, lambda b: F.regexp_replace(F.regexp_replace(F.format_string("%.3f", b), "0+$", ""), r"\.$", ""))
    return F.concat(F.lit(f"{name}-beatgrid 1\n"), shift.cast("string"), F.lit("\n"), F.array_join(shown, ","))


def memoised(keys: DataFrame, folder: str, analyse: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Grids of all keys (path, cache_key): those at hand, and the others analysed once and stored."""
    spark = keys.sparkSession
    held = load(spark, folder, keys)
    missing = keys.join(held.select("cache_key"), "cache_key", "left_anti")
    if not missing.isEmpty():
        store(analyse(missing), folder)
        held = load(spark, folder, keys)
    return keys.join(held, "cache_key", "left")


def write_manifest(rows: DataFrame, folder: str) -> int:
    """Appends rows whose id is not there yet as tab-separated text; returns how many."""
    spark = rows.sparkSession
    try:
        there = spark.read.option("sep", "\t").schema(rows.schema).csv(folder).select("id").distinct()
    except AnalysisException:
        there = spark.createDataFrame([], "id string")
    fresh = rows.join(there, "id", "left_anti").select(rows.columns)
    added = fresh.count()
    if added:
        fresh.write.mode("append").option("sep", "\t").csv(folder)
    return added


def write_curve(curve: DataFrame, folder: str) -> None:
    """time_ms, bpm, confidence as tab-separated text, in order of time."""
    curve.select("time_ms", "bpm", "confidence").orderBy("time_ms").write.mode("overwrite").option("sep", "\t").option("header", "true").csv(folder)


def write_frames(rows: DataFrame, folder: str) -> None:
    """Arrays of floats or small integers, one row for each track, as Parquet by track."""
    rows.write.mode("overwrite").parquet(folder)


def write_files(rows: DataFrame, folder: str) -> int:
    """Writes a file for each row (name, content) below ``folder`` (a URI); returns how many. A repeated task writes the same again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                write_file(folder, name, content.as_buffer().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    return rows.select("name", F.col("content").cast("binary").alias("content")).mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


@F.pandas_udf(BinaryType())
def wav_bytes(samples: pd.Series, channels: pd.Series, rate: pd.Series) -> pd.Series:
    """PCM of 16 bits; values beyond -1..1 are clipped."""
    out = []
    for x, c, r in zip(samples, channels, rate, strict=True):
        data = io.BytesIO()
        with wave.open(data, "wb") as w:
            w.setnchannels(int(c))
            w.setsampwidth(2)
            w.setframerate(int(r))
            w.writeframes(np.clip(np.rint(np.asarray(x, float) * 32768), -32768, 32767).astype("<i2").tobytes())
        out.append(data.getvalue())
    return pd.Series(out)


@F.pandas_udf(BinaryType())
def float_bytes(values: pd.Series) -> pd.Series:
    """Little-endian floats of 32 bits."""
    return pd.Series([np.asarray(x, "<f4").tobytes() for x in values])


@F.pandas_udf(BinaryType())
def small_bytes(values: pd.Series) -> pd.Series:
    """A signed byte for each value, as frame labels and octaves are kept."""
    return pd.Series([np.asarray(x, np.int8).tobytes() for x in values])


@F.pandas_udf(BinaryType())
def matrix_bytes(values: pd.Series, width: pd.Series) -> pd.Series:
    """Rows and columns as integers of 32 bits, then the values row by row, as floats."""
    return pd.Series([np.array([len(x) // w if w else 0, w], "<i4").tobytes() + np.asarray(x, "<f4").tobytes() for x, w in zip(values, width, strict=True)])


@F.pandas_udf(ArrayType(FloatType()))
def marked(samples: pd.Series, beats_ms: pd.Series, rate: pd.Series) -> pd.Series:
    """Samples with an audible mark, half of full scale for ten milliseconds, from each beat on."""
    out = []
    for x, beats, r in zip(samples, beats_ms, rate, strict=True):
        mine, length = np.array(x, np.float32), int(r) // 100
        for at in np.floor(np.asarray(beats, float) * r / 1000).astype(int):
            mine[max(0, at) : max(0, at + length)] = 0.5
        out.append(mine)
    return pd.Series(out)
