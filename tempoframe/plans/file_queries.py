"""Queries of sources and sinks: files are made from the tables, written to a shared folder, and read back."""

from __future__ import annotations

import io
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tempoframe.operators.signal import RATE, to_mono
from tempoframe.plans import relations as R
from tempoframe.plans.track_queries import map_texts
from tempoframe.sources import readers, sinks
from tempoframe.sources.blocks import AudioBlocks, content_blocks
from tempoframe.sources.folders import shared_folder

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, oracle: str):
    def put(f):
        QUERIES[name], ORACLE_SQL[name] = f, oracle
        return f

    return put


def number(path="path"):
    """The number that a file name begins with."""
    return F.regexp_extract(path, r"(\d+)[^/]*$", 1).cast("long")


def takes(s, d):
    """track_id, samples (whole numbers in 1 / 32768, interleaved stereo), channels, sample_rate: one for each supplier."""
    key = F.col("s_suppkey").cast("long")
    value = lambda i: (((i * 37 + key * 11) % 2001 - 1000) / F.lit(32768.0)).cast("float")
    return R.table(s, d, "supplier").select(key.alias("track_id"), F.transform(F.sequence(F.lit(0), 199 + 2 * (key % 50)), value).alias("samples"), F.lit(2).alias("channels"), F.lit(RATE).alias("sample_rate"))


_TAKES = "takes AS (SELECT s_suppkey::BIGINT AS track_id, list_transform(range(0, 200 + 2 * (s_suppkey % 50)), lambda i: (i * 37 + s_suppkey * 11) % 2001 - 1000) AS v FROM supplier)"
_SUMS = f"WITH {_TAKES} SELECT track_id, len(v)::INT AS n, {{channels}}::INT AS channels, {RATE}::INT AS sample_rate, list_sum(v)::BIGINT AS total, list_sum(list_transform(range(1, len(v) + 1), lambda i: i * v[i]))::BIGINT AS weighed FROM takes"


def summed(rows, scale=32768.0):
    """Sums that change with any value or its place."""
    whole = F.transform("samples", lambda x: F.rint(x.cast("double") * scale).cast("long"))
    add = lambda a, x: a + x
    return rows.withColumn("v", whole).select("track_id", F.size("v").alias("n"), "channels", "sample_rate", F.aggregate("v", F.lit(0).cast("long"), add).alias("total"), F.aggregate(F.transform("v", lambda x, i: x * (i + 1)), F.lit(0).cast("long"), add).alias("weighed"))


def written_takes(s, d):
    folder = shared_folder(s)
    sinks.write_files(takes(s, d).select(F.concat(F.col("track_id").cast("string"), F.lit(".wav")).alias("name"), sinks.wav_bytes("samples", "channels", "sample_rate").alias("content")), folder)
    return folder


@query("a1_decoded_files", _SUMS.format(channels=2))
def decoded_files(s, d):
    """WAV files, decoded as they are."""
    return summed(readers.read_audio(s, written_takes(s, d)).withColumn("track_id", number()))


@query("a2_decoded_content", _SUMS.format(channels=2))
def decoded_content(s, d):
    """The same bytes as a column, without files."""
    rows = takes(s, d).select(F.col("track_id").cast("string").alias("path"), sinks.wav_bytes("samples", "channels", "sample_rate").alias("content"))
    return summed(readers.decoded(rows).withColumn("track_id", number()))


_BLOCKS = _SUMS.format(channels=2).replace(" FROM takes", ", ceil(len(v) / 64)::BIGINT AS blocks FROM takes")


def summed_blocks(rows):
    """``summed`` of samples that come in blocks."""
    whole = F.transform("samples", lambda x: F.rint(x.cast("double") * 32768).cast("long"))
    add = lambda a, x: a + x
    each = rows.withColumn("v", whole).select(number().alias("track_id"), "block", "channels", "sample_rate", F.size("v").alias("n"), F.aggregate("v", F.lit(0).cast("long"), add).alias("total"), F.aggregate(F.transform("v", lambda x, i: x * (i + 1 + F.col("first_sample"))), F.lit(0).cast("long"), add).alias("weighed"))
    return each.groupBy("track_id", "channels", "sample_rate").agg(F.sum("n").cast("int").alias("n"), F.sum("total").alias("total"), F.sum("weighed").alias("weighed"), F.count(F.lit(1)).alias("blocks"))


@query("a1_block_reads", _BLOCKS)
def block_reads(s, d):
    """WAV files by ranges of 200 bytes, 64 samples at a time; no task sees a whole file."""
    s.dataSource.register(AudioBlocks)
    return summed_blocks(s.read.format("audio_blocks").option("path", written_takes(s, d)).option("pattern", "*.wav").option("block", 64).option("rangeBytes", 200).load())


@query("a2_content_blocks", _BLOCKS)
def content_in_blocks(s, d):
    """The same bytes as a column."""
    rows = takes(s, d).select(F.col("track_id").cast("string").alias("path"), sinks.wav_bytes("samples", "channels", "sample_rate").alias("content"))
    return summed_blocks(content_blocks(rows, 64))


@query("a3_mono", f"WITH {_TAKES} SELECT track_id, list_sum(list_transform(range(1, len(v) // 2 + 1), lambda i: i * (v[2 * i - 1] + v[2 * i])))::BIGINT AS weighed, (len(v) // 2)::INT AS n FROM takes")
def decoded_mono(s, d):
    """WAV files to mono at the target rate; twice the mean is a whole number again."""
    mono = to_mono(readers.read_audio(s, written_takes(s, d)).withColumn("track_id", number()))
    return summed(mono.withColumns({"channels": F.lit(1), "sample_rate": F.lit(RATE)}), 65536.0).select("track_id", "weighed", "n")


@query("a4_other_decoder", _SUMS.format(channels=1).replace("list_sum(v)", "list_sum(list_transform(v, lambda x: floor(x / 8)::BIGINT))").replace("i * v[i]", "i * floor(v[i] / 8)::BIGINT"))
def other_decoder(s, d):
    """Files of signed bytes, which only a decoder of one's own reads."""
    folder = shared_folder(s)
    eighths = F.transform("samples", lambda x: F.floor(F.rint(x.cast("double") * 32768) / 8).cast("int"))
    sinks.write_files(takes(s, d).select(F.concat(F.col("track_id").cast("string"), F.lit(".s8")).alias("name"), sinks.small_bytes(eighths).alias("content")), folder)
    return summed(readers.read_audio(s, folder, "*.s8", lambda data: (np.frombuffer(data, np.int8).astype(np.float32), 1, RATE)).withColumn("track_id", number()), 1.0)


@query("a5_raw_floats", _SUMS.format(channels=1))
def raw_floats(s, d):
    folder = shared_folder(s)
    sinks.write_files(takes(s, d).select(F.concat(F.col("track_id").cast("string"), F.lit(".f32")).alias("name"), sinks.float_bytes("samples").alias("content")), folder)
    return summed(readers.read_audio(s, folder, "*.f32").withColumn("track_id", number()))


@query("a8_archived_maps", R.sql("timing", then="SELECT track_id, round(time_ms, 3) AS time_ms, round(beat_length_ms, 3) AS beat_length_ms FROM timing WHERE floor(beat_length_ms)::BIGINT % 3 <> 0"))
def archived_maps(s, d):
    """Map texts, each in a zip archive behind another file."""

    @F.pandas_udf("binary")
    def zipped(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            data = io.BytesIO()
            with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("readme.txt", "no map")
                z.writestr("one.osu", t)
            out.append(data.getvalue())
        return pd.Series(out)

    folder = shared_folder(s)
    sinks.write_files(map_texts(s, d).select(F.concat("path", F.lit(".osz")).alias("name"), zipped("value").alias("content")), folder)
    return readers.timing_points(readers.sectioned(readers.archived_maps(s, folder))).select(number().alias("track_id"), "time_ms", "beat_length_ms")


@query("a9_csv_timing_points", R.sql("timing", then="SELECT round(time_ms, 3) AS time_ms, round(beat_length_ms, 3) AS beat_length_ms FROM timing"))
def csv_points(s, d):
    """Lines of two numbers between comments and lines that are none."""
    folder = f"{shared_folder(s)}/points"
    points = R.timing(s, d).select(F.array(F.concat_ws(",", F.format_string("%.3f", "time_ms"), F.format_string(" %.3f", "beat_length_ms")), F.lit("# a comment"), F.lit("x,y"), F.lit("5")).alias("l"))
    points.select(F.explode("l")).write.text(folder)
    return readers.csv_timing_points(s, folder)


@query("a10_manifest", "SELECT c_custkey::VARCHAR AS id, c_mktsegment AS \"set\", (c_custkey % 1000)::INT AS frames, c_custkey / 8.0 AS period, (c_custkey % 2)::INT AS usable FROM customer WHERE c_custkey % 5 <> 0")
def manifest(s, d):
    """A manifest with a header, written and read; rows of too few fields are left out."""
    c, folder = F.col("c_custkey"), f"{shared_folder(s)}/manifest"
    whole = c % 5 != 0
    fields = [c.cast("string"), F.col("c_mktsegment"), F.lit("a.wav"), F.lit("a.i8"), (c % 1000).cast("string"), F.lit("7"), (c / 8.0).cast("string"), F.lit("0.5"), F.lit("0"), (c % 2).cast("string"), F.lit("")]
    names = [f.split()[0] for f in readers.MANIFEST.split(", ")]
    R.table(s, d, "customer").select(*(f.alias(n) if i < 2 else F.when(whole, f).alias(n) for i, (n, f) in enumerate(zip(names, fields, strict=True)))).write.option("sep", "\t").option("header", "true").csv(folder)
    return readers.read_manifest(s, folder).select("id", "set", "frames", "period", "usable")


@query("a11_corpus", "SELECT s_suppkey::BIGINT AS track_id, CASE WHEN s_suppkey % 3 = 0 THEN 'named.wav' ELSE 'other.f32' END AS audio FROM supplier WHERE s_suppkey % 3 < 2")
def corpus(s, d):
    """A folder for each supplier with a map: the audio file that it names, another one alone, or two others, which no one can choose from."""
    k, folder = F.col("s_suppkey"), shared_folder(s)
    names = F.when(k % 3 == 0, F.array(F.lit("named.wav"), F.lit("other.f32"))).when(k % 3 == 1, F.array(F.lit("other.f32"))).otherwise(F.array(F.lit("other.f32"), F.lit("more.ogg")))
    each = R.table(s, d, "supplier").select("s_suppkey", F.explode(F.array_append(names, F.lit("map.osu"))).alias("leaf"))
    text = F.when(F.col("leaf") == "map.osu", "[General]\nAudioFilename: named.wav\n").otherwise("x")
    sinks.write_files(each.select(F.concat(F.col("s_suppkey").cast("string"), F.lit("/"), F.col("leaf")).alias("name"), text.alias("content")), folder)
    found = readers.corpus(s, folder)
    return found.select(F.regexp_extract("path", r"/(\d+)/[^/]*$", 1).cast("long").alias("track_id"), F.substring_index("audio", "/", -1).alias("audio"))


@query("a12_fixture", "SELECT vec_id AS track_id, 4::INT AS frames, 8::INT AS bins, round(list_sum(list_transform(embedding[1:32], lambda x: x::DOUBLE)), 6) AS mel, round(list_sum(list_transform(embedding[33:64], lambda x: x::DOUBLE)), 6) AS signal FROM embeddings")
def fixtures(s, d):
    """Two blocks of floats behind three integers: half of each vector is the one, half the other."""

    @F.pandas_udf("binary")
    def packed(vectors: pd.Series) -> pd.Series:
        return pd.Series([np.array([4, 8, len(v) - 32], "<i4").tobytes() + np.asarray(v, "<f4").tobytes() for v in vectors])

    folder = shared_folder(s)
    sinks.write_files(R.table(s, d, "embeddings").select(F.concat(F.col("vec_id").cast("string"), F.lit(".bin")).alias("name"), packed("embedding").alias("content")), folder)
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double")), 6)
    return readers.read_fixture(s, folder).select(number().alias("track_id"), "frames", "bins", total("mel").alias("mel"), total("samples").alias("signal"))


@query("a13_cache_load", "SELECT c_custkey AS track_id, CASE WHEN c_custkey % 6 < 2 THEN (c_custkey % 3 - 1)::INT END AS metrical_shift, CASE WHEN c_custkey % 6 < 2 THEN 2 ELSE 0 END::INT AS beats FROM customer")
def cache_load(s, d):
    """Text entries, of which a third is whole; whatever else there is, or is not, is a miss and no error."""
    k, folder = F.col("c_custkey"), shared_folder(s)
    good = sinks.entry_text((k % 3 - 1).cast("int"), F.array(k / 4.0, k / 2.0 + 1000))
    text = F.when(k % 6 < 2, good).when(k % 6 == 2, F.lit("another-file 1\n0\n1")).when(k % 6 == 3, F.lit("tempoframe-beatgrid 1\nx\n1")).when(k % 6 == 4, F.lit("tempoframe-beatgrid 1\n0\n1,y"))
    entries = R.table(s, d, "customer").select("c_custkey", text.alias("value"))
    entries.filter("value IS NOT NULL").write.parquet(f"{folder}/entries")
    held = s.read.parquet(f"{folder}/entries").select("c_custkey", sinks.text_entry(F.col("value")).alias("e")).filter("e IS NOT NULL")
    return entries.select("c_custkey").join(held, "c_custkey", "left").select(k.alias("track_id"), "e.metrical_shift", F.coalesce(F.size("e.beats"), F.lit(0)).alias("beats"))


@query("i5_raw_writers", "SELECT vec_id AS track_id, list_sum(list_transform(embedding, lambda x: (floor(x * 2)::INT)))::BIGINT AS labels, len(embedding)::INT AS n FROM embeddings")
def raw_writers(s, d):
    """Frame labels of one byte each."""
    folder = shared_folder(s)
    sinks.write_files(R.table(s, d, "embeddings").select(F.concat(F.col("vec_id").cast("string"), F.lit(".i8")).alias("name"), sinks.small_bytes(F.transform("embedding", lambda x: F.floor(x * 2).cast("int"))).alias("content")), folder)
    return readers.read_small(s, folder).select(number().alias("track_id"), F.aggregate("values", F.lit(0).cast("long"), lambda a, x: a + x).alias("labels"), F.size("values").alias("n"))


@query("i6_manifest_append", "SELECT (CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 2 END)::INT AS run, count(*) AS n FROM customer GROUP BY 1")
def manifest_append(s, d):
    """A third of the rows is there; of all rows the others are added, none twice."""
    folder = f"{shared_folder(s)}/manifest"
    rows = lambda run: R.table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.lit(run).alias("run"))
    sinks.write_manifest(rows(1).filter("id % 3 = 0"), folder)
    sinks.write_manifest(rows(2), folder)
    return s.read.option("sep", "\t").schema("id string, run int").csv(folder).groupBy("run").agg(F.count(F.lit(1)).alias("n"))


@query("i7_curve", R.sql("timing", then="SELECT round(time_ms, 3) AS time_ms, round(60000 / beat_length_ms, 3) AS bpm, 0.5 AS confidence FROM timing"))
def curve(s, d):
    folder = f"{shared_folder(s)}/curve"
    points = R.timing(s, d).select(F.round("time_ms", 3).alias("time_ms"), F.round(60000 / F.col("beat_length_ms"), 3).alias("bpm"), F.lit(0.5).alias("confidence"))
    sinks.write_curve(points, folder)
    return s.read.option("sep", "\t").option("header", "true").schema("time_ms double, bpm double, confidence double").csv(folder)


@query("i8_audible_marks", f"SELECT s_suppkey::BIGINT AS track_id, 5000::INT AS n, (len(list_distinct(flatten(list_transform(range(0, 4), lambda j: range(floor((s_suppkey % 40 + 7.0 * j * (1 + s_suppkey % 5)) * {RATE} / 1000)::BIGINT, floor((s_suppkey % 40 + 7.0 * j * (1 + s_suppkey % 5)) * {RATE} / 1000)::BIGINT + {RATE // 100}))))))::INT AS loud FROM supplier")
def audible_marks(s, d):
    """Silence with marks at four beats, written as WAV and read back."""
    k, folder = F.col("s_suppkey"), shared_folder(s)
    beats = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: k % 40 + 7.0 * j * (1 + k % 5))
    made = R.table(s, d, "supplier").select("s_suppkey", sinks.marked(F.array_repeat(F.lit(0.0).cast("float"), 5000), beats, F.lit(RATE)).alias("samples"))
    sinks.write_files(made.select(F.concat(k.cast("string"), F.lit(".wav")).alias("name"), sinks.wav_bytes("samples", F.lit(1), F.lit(RATE)).alias("content")), folder)
    return readers.read_audio(s, folder).select(number().alias("track_id"), F.size("samples").alias("n"), F.size(F.filter("samples", lambda x: x > 0.4)).alias("loud"))


@query("i9_matrix_dump", "SELECT vec_id AS track_id, 8::INT AS rows, 8::INT AS columns, round(list_sum(list_transform(range(1, 65), lambda i: i * embedding[i]::DOUBLE)), 5) AS weighed FROM embeddings")
def matrix_dump(s, d):
    """The vectors as matrices of eight rows."""
    folder = shared_folder(s)
    sinks.write_files(R.table(s, d, "embeddings").select(F.concat(F.col("vec_id").cast("string"), F.lit(".mat")).alias("name"), sinks.matrix_bytes("embedding", F.lit(8)).alias("content")), folder)
    weighed = F.aggregate(F.transform("values", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return readers.read_matrix(s, folder).select(number().alias("track_id"), "rows", "columns", F.round(weighed, 5).alias("weighed"))
