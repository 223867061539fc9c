"""Sources. All of them read through Spark, so that any file system that Spark knows will do."""

from __future__ import annotations

import io
import wave
import zipfile
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempoframe.operators.signal import RATE, to_mono
from tempoframe.sources.blocks import pcm
from tempoframe.sources.folders import shared_folder

RAW = "samples array<float>, channels int, sample_rate int"
Decoder = Callable[[bytes], tuple[np.ndarray, int, int]]
MANIFEST = "id string, set string, audio string, labels string, frames int, beats int, period double, lag double, octave int, usable int, separations string"


def decode_wav(data: bytes) -> tuple[np.ndarray, int, int]:
    """Interleaved samples, channels and rate of PCM with 8, 16, 24 or 32 bits."""
    with wave.open(io.BytesIO(data)) as w:
        raw, width, channels, rate = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels(), w.getframerate()
    return pcm(raw, width), channels, rate


def decode_f32(data: bytes, rate: int = RATE) -> tuple[np.ndarray, int, int]:
    """Little-endian mono floats."""
    return np.frombuffer(data[: len(data) // 4 * 4], "<f4"), 1, rate


def decode_any(data: bytes) -> tuple[np.ndarray, int, int]:
    return decode_wav(data) if data[:4] == b"RIFF" else decode_f32(data)


def decoded(files: DataFrame, decoder: Decoder = decode_any) -> DataFrame:
    """path, track_id, samples, channels, sample_rate of rows with path and content; any decoder will do."""

    @F.pandas_udf(RAW)
    def run(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decoder(bytes(c)) for c in content], columns=["samples", "channels", "sample_rate"])

    return files.select("path", F.xxhash64("path").alias("track_id"), run("content").alias("raw")).select("path", "track_id", "raw.*")


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)


def read_audio(spark: SparkSession, folder: str, pattern: str = "*.wav", decoder: Decoder = decode_any) -> DataFrame:
    return decoded(files(spark, folder, pattern), decoder)


def read_mono(spark: SparkSession, folder: str, pattern: str = "*.wav", decoder: Decoder = decode_any, rate: int = RATE) -> DataFrame:
    """track_id, samples at one rate."""
    return to_mono(read_audio(spark, folder, pattern, decoder), rate)


def map_lines(spark: SparkSession, folder: str, pattern: str = "*.osu") -> DataFrame:
    """path, line_no, line, section: the section is the last header at or before a line."""
    text = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return sectioned(text)


def sectioned(texts: DataFrame) -> DataFrame:
    lines = texts.select("path", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line")).withColumn("line", F.trim("line"))
    header = F.when(F.col("line").rlike(r"^\[.*\]$"), F.substring_index(F.substring("line", 2, 1 << 20), "]", 1))
    return lines.withColumn("section", F.last(header, ignorenulls=True).over(Window.partitionBy("path").orderBy("line_no")))


def _field(i: int) -> F.Column:
    return F.expr(f"try_cast(trim(get(split(line, ','), {i})) AS double)")


def timing_points(lines: DataFrame) -> DataFrame:
    """path, time_ms, beat_length_ms of points with a length of their own; rows that cannot be read are left out."""
    rows = lines.filter("section = 'TimingPoints'").select("path", _field(0).alias("time_ms"), _field(1).alias("beat_length_ms"))
    return rows.filter("time_ms IS NOT NULL AND beat_length_ms > 0")


def hit_objects(lines: DataFrame) -> DataFrame:
    """path, t_ms: the third field of each object."""
    return lines.filter("section = 'HitObjects'").select("path", _field(2).alias("t_ms")).filter("t_ms IS NOT NULL")


def archived_maps(spark: SparkSession, folder: str, pattern: str = "*.osz", suffix: str = ".osu") -> DataFrame:
    """path, value: the first map of each zip archive; archives without one are left out."""

    @F.pandas_udf("string")
    def first(content: pd.Series) -> pd.Series:
        out = []
        for c in content:
            with zipfile.ZipFile(io.BytesIO(bytes(c))) as z:
                name = next((n for n in z.namelist() if n.lower().endswith(suffix)), None)
                out.append(z.read(name).decode("utf-8", "replace") if name else None)
        return pd.Series(out)

    return files(spark, folder, pattern).select("path", first("content").alias("value")).filter("value IS NOT NULL")


def csv_timing_points(spark: SparkSession, path: str) -> DataFrame:
    """time_ms, beat_length_ms; comments and lines that are no two numbers are left out."""
    rows = spark.read.option("comment", "#").schema("a string, b string").csv(path)
    return rows.select(F.expr("try_cast(trim(a) AS double)").alias("time_ms"), F.expr("try_cast(trim(b) AS double)").alias("beat_length_ms")).filter("time_ms IS NOT NULL AND beat_length_ms IS NOT NULL")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Rows with at least the first seven fields."""
    return spark.read.option("sep", "\t").option("header", "true").option("mode", "PERMISSIVE").schema(MANIFEST).csv(path).filter("id IS NOT NULL AND period IS NOT NULL")


def corpus(spark: SparkSession, folder: str, audio_suffixes: tuple[str, ...] = (".wav", ".f32", ".mp3", ".ogg")) -> DataFrame:
    """path, audio: each map with the audio file that it names in its folder, else the only one there; others are left out."""
    names = map_lines(spark, folder).filter(F.lower("line").startswith("audiofilename:")).groupBy("path").agg(F.min_by(F.trim(F.substring_index("line", ":", -1)), "line_no").alias("named"))
    there = files(spark, folder).select("path", F.col("path").alias("audio")).filter(F.lower("path").rlike("(" + "|".join(s.replace(".", r"\.") for s in audio_suffixes) + ")$"))
    place = lambda c: F.regexp_replace(F.regexp_replace(c, "^file:/+", "/"), "/[^/]*$", "")
    leaf = lambda c: F.lower(F.substring_index(c, "/", -1))
    audio = there.select("audio", place(F.col("audio")).alias("dir"), leaf(F.col("audio")).alias("leaf"), F.count(F.lit(1)).over(Window.partitionBy(place(F.col("audio")))).alias("n"))
    maps = names.select("path", place(F.col("path")).alias("dir"), F.lower("named").alias("leaf"))
    exact = maps.join(audio.drop("n"), ["dir", "leaf"])
    alone = maps.join(exact.select("path"), "path", "left_anti").join(audio.filter("n = 1").drop("leaf", "n"), "dir")
    return exact.select("path", "audio").unionByName(alone.select("path", "audio"))


def read_fixture(spark: SparkSession, path: str) -> DataFrame:
    """path, frames, bins, mel, samples: two blocks of floats behind three integers."""

    @F.pandas_udf("frames int, bins int, mel array<float>, samples array<float>")
    def run(content: pd.Series) -> pd.DataFrame:
        out = []
        for c in map(bytes, content):
            frames, bins, n = np.frombuffer(c[:12], "<i4")
            values = np.frombuffer(c[12:], "<f4")
            out.append((frames, bins, values[: frames * bins], values[frames * bins : frames * bins + n]))
        return pd.DataFrame(out, columns=["frames", "bins", "mel", "samples"])

    return spark.read.format("binaryFile").load(path).select("path", run("content").alias("f")).select("path", "f.*")


def read_matrix(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, rows, columns, values of dumps as ``sinks.matrix_bytes`` makes them."""

    @F.pandas_udf("rows int, columns int, values array<float>")
    def run(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(*np.frombuffer(c[:8], "<i4").tolist(), np.frombuffer(c[8:], "<f4")) for c in map(bytes, content)], columns=["rows", "columns", "values"])

    return files(spark, path, pattern).select("path", run("content").alias("m")).select("path", "m.*")


def read_small(spark: SparkSession, path: str, pattern: str = "*.i8") -> DataFrame:
    """path, values of files of signed bytes."""

    @F.pandas_udf("array<int>")
    def run(content: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(bytes(c), np.int8).astype(np.int32) for c in content])

    return files(spark, path, pattern).select("path", run("content").alias("values"))


def shard(rows: DataFrame, of: int, index: int, *order: str) -> DataFrame:
    """Every ``of``-th row in ``order``: ranges are numbered by a sorted pass, so that no task holds all rows."""
    spark = rows.sparkSession
    parts = rows.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).select(F.struct(*rows.columns).alias("row"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("id"))
    # Written once: what is counted and what is numbered are the same rows in the same parts.
    folder = shared_folder(spark)
    parts.withColumn("n", F.col("id") - F.shiftleft(F.col("part").cast("long"), 33)).drop("id").write.parquet(folder)
    placed = spark.read.parquet(folder)
    sizes = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}
    start, before = 0, []
    for p in sorted(sizes):
        before.append((p, start))
        start += sizes[p]
    starts = spark.createDataFrame(before, "part int, start long")
    return placed.join(F.broadcast(starts), "part").filter((F.col("start") + F.col("n")) % of == index).select("row.*")
