"""Queries of the front end, scoring, kernels, sources and sinks. Those without a SQL twin are held against plain versions in tests."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tempoframe.functions import numeric as N
from tempoframe.operators import beats as B, grids as D, peaks as P, scoring as S, signal as G, tracking as T
from tempoframe.plans import kernel_twins as twins, relations as R
from tempoframe.plans.relations import sql
from tempoframe.sources import readers, sinks
from tempoframe.sources.folders import shared_folder

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return put


def tones(s, d):
    """A tone for each supplier: 0.8 s at 22,050 Hz."""
    i = F.sequence(F.lit(0), F.lit(17_639))
    return R.table(s, d, "supplier").select("s_suppkey").repartition(16, "s_suppkey").select(F.col("s_suppkey").cast("long").alias("track_id"), F.transform(i, lambda k: (0.5 * F.sin(2 * F.pi() * k * (110.0 + F.col("s_suppkey") % 880) / 22050) * (k % 11025 < 2205).cast("double")).cast("float")).alias("samples")).repartition("track_id")  # made once, however often it is named


def mels(s, d):
    return G.mel_frames(tones(s, d), 20)


def curve(s, d):
    """beat_prob, period_frames of the vectors: values shifted into probabilities, a period of eight frames or so."""
    return R.activation(s, d).select("track_id", "frame", (F.col("x") + 0.5).alias("beat_prob"), (F.lit(8.0) + F.col("frame") % 5).alias("period_frames"))


_N = "o_orderkey * 37 % 1000000"


@query(
    "b7_frame_count",
    f"SELECT o_orderkey, CASE WHEN {_N} > 0 THEN 1 + ({_N}) // 441 ELSE 0 END::INT AS frames, CASE WHEN {_N} < 512 THEN 0 ELSE ({_N} - 512) // 441 + 1 END::INT AS complete FROM orders",
)
def b7_frame_count(s, d):
    return (
        R.table(s, d, "orders")
        .select("o_orderkey", N.frame_count(F.col("o_orderkey") * 37 % 1_000_000).alias("frames"), N.complete_frame_count(F.col("o_orderkey") * 37 % 1_000_000).alias("complete"))
    )


@query(
    "b14_frame_times",
    sql("beats", then="SELECT track_id, beat_ms, greatest(0, least(999, floor(beat_ms * 50 / 1000 + 0.5)::INT)) AS frame, greatest(0, least(999, floor(beat_ms * 50 / 1000 + 0.5)::INT)) * 20.0 AS frame_ms FROM beats"),
)
def b14_frame_times(s, d):
    return R.beats(s, d).withColumn("frame", N.nearest_frame(F.col("beat_ms"), F.lit(1000))).withColumn("frame_ms", N.frame_time(F.col("frame")))


@query(
    "c1_chunk_schedule",
    """WITH t AS (SELECT c_custkey, c_custkey * 13 % 9500 AS total FROM customer),
        s AS (SELECT *, unnest(range(-6, total - 6, 1488)) AS start FROM t WHERE total > 0),
        n AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY start) - 1 AS chunk, count(*) OVER (PARTITION BY c_custkey) AS k FROM s)
        SELECT c_custkey, chunk::INT AS chunk, CASE WHEN total > 1488 AND chunk = k - 1 THEN total - 1494 ELSE start END::INT AS start FROM n""",
)
def c1_chunk_schedule(s, d):
    return (
        R.table(s, d, "customer")
        .select("c_custkey", F.posexplode(S.chunk_schedule((F.col("c_custkey") * 13 % 9500).cast("int"))).alias("chunk", "start"))
    )


@query("c9_sigmoid", sql("activation", then="SELECT track_id, frame, round(1 / (1 + exp(-x)), 9) AS p FROM activation"))
def c9_sigmoid(s, d):
    return R.activation(s, d).select("track_id", "frame", F.round(N.sigmoid(F.col("x")), 9).alias("p"))


def vector_samples(s, d, channels, rate):
    return R.table(s, d, "embeddings").select(F.col("vec_id").alias("track_id"), F.col("embedding").alias("samples"), F.lit(channels).alias("channels"), F.lit(rate).alias("sample_rate"))


def each_sample(tracks):
    return tracks.select("track_id", F.posexplode("samples").alias("place", "x"))


@query("b1_mono", twins.B1)
def mono(s, d):
    """The vectors as interleaved stereo at the target rate, mixed down."""
    return each_sample(G.to_mono(vector_samples(s, d, 2, G.RATE)))


@query("b2_resampled")
def resampled(s, d):
    """Tones at 44,100 Hz in stereo, mixed down and resampled."""
    raw = tones(s, d).select("track_id", "samples", F.lit(2).alias("channels"), F.lit(44_100).alias("sample_rate"))
    return G.to_mono(raw).select("track_id", F.size("samples").alias("n"), F.aggregate("samples", F.lit(0.0), lambda a, x: a + x * x).alias("energy"))


@query("b3_upsampled", twins.B3)
def upsampled(s, d):
    """The vectors as samples at half the target rate: every second value lies between two of them."""
    return each_sample(G.to_mono(vector_samples(s, d, 1, G.RATE // 2)))


def line_mels(s, d):
    """Spectra of 40 bands of small whole numbers, the lines of many orders a track: tracks of some chunks, as many as there are orders for."""
    track = F.floor(F.col("l_orderkey") / R.GATHERED_ORDERS)
    order = Window.partitionBy(track).orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    rows = R.table(s, d, "lineitem").select(track.alias("track_id"), (F.row_number().over(order) - 1).alias("frame"), F.col("l_quantity").cast("long").alias("q"), "l_partkey")
    return rows.select("track_id", "frame", bands().alias("mel"), F.count(F.lit(1)).over(Window.partitionBy("track_id")).cast("int").alias("total"))


def bands():
    """40 small whole numbers of a line's q and part."""
    return F.transform(F.sequence(F.lit(0), F.lit(39)), lambda b: ((F.col("q") * (b + 3) + F.col("l_partkey")) % 17).cast("float"))


def long_mels(s, d):
    """Such spectra with a track for each line number: tracks that grow with the table, numbered by ranges."""
    rows = R.table(s, d, "lineitem").select(F.col("l_linenumber").cast("long").alias("track_id"), "l_orderkey", "l_partkey", "l_quantity", F.col("l_quantity").cast("long").alias("q"))
    rows = D.numbered(rows, "track_id", "l_orderkey", "l_partkey", "l_quantity")
    return rows.select("track_id", F.col("frame").cast("int").alias("frame"), bands().alias("mel"), F.col("total").cast("int").alias("total"))


query("b11_log_mel")(mels)


@query("b13_onset_envelope")
def b13_onset_envelope(s, d):
    return P.flux(G.flux_spectra(tones(s, d)))


@query("b13_flux", twins.B13)
def flux(s, d):
    """Onset strength of given spectra: the vectors, dealt to five tracks."""
    spectra = R.table(s, d, "embeddings").select((F.col("vec_id") % 5).alias("track_id"), F.floor(F.col("vec_id") / 5).cast("int").alias("frame"), F.col("embedding").cast("array<double>").alias("mags"))
    return P.flux(spectra).withColumn("flux", F.round("flux", 6))


@query("c2_activations", twins.C2)
def activations(s, d):
    return S.activations(line_mels(s, d)).select("track_id", "frame", *(F.round(F.col(c).cast("double"), 3).alias(c) for c in ("beat", "downbeat")))


@query("c5_predict", twins.C5)
def predict(s, d):
    """Peaks of both outputs of the scored spectra, to a thousandth."""
    return T.predicted(activations(s, d)).select("track_id", "kind", F.round("place", 6).alias("place"), F.round("beat_ms", 5).alias("beat_ms"))


@query("c7_overlap_add", twins.C7)
def overlap_add(s, d):
    """Windows of 1,024 frames every 960; means by second."""
    each = S.overlap_add(long_mels(s, d)).groupBy("track_id", F.floor(F.col("frame") / 50).cast("int").alias("second"))
    return each.agg(F.count(F.lit(1)).alias("frames"), F.round(F.avg(F.col("beat_prob").cast("double")), 3).alias("beat_prob"), F.round(F.avg(F.col("period_frames").cast("double")), 2).alias("period_frames"))


@query("c10_verify", f"WITH {twins._MEL} SELECT count(*) AS frames, 0.5 AS beat, 0.25 AS downbeat FROM level")
def verify(s, d):
    """The largest difference of two scorings of the same spectra, by output: here a model and one that is off by constants."""
    other = lambda mel: tuple(x + np.float32(off) for x, off in zip(S.band_scorer(mel), (0.5, 0.25), strict=True))
    return S.largest_difference(S.activations(line_mels(s, d)), S.activations(line_mels(s, d), other)).select("frames", *(F.round(c, 3).alias(c) for c in ("beat", "downbeat")))


@query("d5_peaks", twins.D5)
def pruned(s, d):
    return T.pruned_peaks(R.activation(s, d)).select("track_id", F.round("place", 6).alias("place"), F.round("beat_ms", 5).alias("beat_ms"))


@query("d9_suppress", twins.D9)
def d9_suppress(s, d):
    return P.suppressed(curve(s, d))


@query("d11_place", twins.D11)
def d11_place(s, d):
    return T.placed(curve(s, d)).withColumn("beat_ms", F.round("beat_ms", 5))


@query("d13_detector_beats", twins.D13)
def d13_detector_beats(s, d):
    return T.detector_beats(curve(s, d)).withColumn("beat_ms", F.round("beat_ms", 5))


@query("d14_searched_path", twins.D14)
def d14_searched_path(s, d):
    return T.searched_path(R.activation(s, d), floor=0.05)


@query("e5_regularised", twins.E5)
def e5_regularised(s, d):
    return T.regularised(R.beats(s, d))


@query("e14_tempo_sections", twins.E14)
def e14_tempo_sections(s, d):
    return T.tempo_sections(R.long_beats(s, d))


@query("e16_even_grid", twins.E16)
def e16_even_grid(s, d):
    return T.even_grid(R.long_beats(s, d))


@query("f3_bpm_at", twins.F3)
def f3_bpm_at(s, d):
    return T.bpm_at(R.clicks(s, d, "click"), R.beats(s, d))


@query("h15_coalesced_sections", twins.H15)
def h15_coalesced_sections(s, d):
    return T.coalesced_sections(R.timing(s, d).withColumn("beat_length_ms", F.rint(F.col("beat_length_ms") / 100) * 100))


@query("h26_tempo_steps", twins.H26)
def h26_tempo_steps(s, d):
    return T.tempo_steps(R.beats(s, d))


@query("h33_phase_snap", twins.H33)
def phase_snap(s, d):
    """Beats that lie up to 40 ms beside the pulses of an onset curve, by the values of events: most go back to the pulses."""
    each = R.signal(s, d)
    beats = each.select("track_id", (60.0 + F.col("frame") * 400.0 + (F.col("x") * 7 % 80 - 40)).alias("beat_ms"))
    frames = each.select("track_id", F.explode(F.sequence(F.col("frame") * 20, F.col("frame") * 20 + 19)).alias("frame"))
    value = F.when(F.col("frame") % 20 == 3, 1.0).otherwise(0.0) + (F.col("frame") * 37 + F.col("track_id") * 11) % 100 / F.lit(333.0)
    return T.snapped(beats, frames.withColumn("x", value)).withColumn("snapped_ms", F.round("snapped_ms", 5))


@query("a14_modulo_shard", "SELECT c_custkey, c_name FROM customer QUALIFY (row_number() OVER (ORDER BY c_custkey) - 1) % 3 = 1")
def a14_modulo_shard(s, d):
    return _shard(s, d)


def _shard(s, d):
    from tempoframe.sources.readers import shard

    return shard(R.table(s, d, "customer").select("c_custkey", "c_name"), 3, 1, "c_custkey")


@query(
    "i1_cache_key",
    "SELECT page_id, substr(sha256('b1' || chr(10) || 'peaks' || chr(10) || url || '|' || page_id || '|' || strlen(html) || chr(10)), 1, 32) AS cache_key FROM pages",
)
def i1_cache_key(s, d):
    return (
        R.table(s, d, "pages")
        .select("page_id", sinks.cache_key("b1", F.col("url"), F.col("page_id"), F.octet_length("html"), "peaks").alias("cache_key"))
    )


@query(
    "i2_cache_entry",
    sql("beats", then=""",
        g AS (SELECT track_id, list(beat_ms ORDER BY beat_ms) AS b FROM beats GROUP BY track_id)
        SELECT track_id, len(b) AS beats, true AS same FROM g"""),
)
def i2_cache_entry(s, d):
    return _entry(s, d)


def _entry(s, d):
    """Grids written as text entries and read back."""
    grids = R.beats(s, d).groupBy("track_id").agg(F.transform(F.array_sort(F.collect_list("beat_ms")), lambda b: F.round(b, 3)).alias("b"))
    back = grids.withColumn("e", sinks.text_entry(sinks.entry_text(F.lit(1), F.col("b"))))
    return back.select("track_id", F.size("e.beats").alias("beats"), ((F.col("e.metrical_shift") == 1) & (F.col("e.beats") == F.col("b"))).alias("same"))


@query(
    "i4_reading",
    "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'detector:m.onnx' WHEN c_custkey % 3 = 1 THEN 'search' ELSE 'peaks' END AS reading FROM customer",
)
def i4_reading(s, d):
    return (
        R.table(s, d, "customer")
        .select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, sinks.reading("m.onnx")).when(F.col("c_custkey") % 3 == 1, sinks.reading(search=True)).otherwise(sinks.reading()).alias("reading"))
    )


def map_texts(s, d):
    """path, value: a map text for each track, made from its timing points and clicks, with lines that no reader should take."""
    points = R.timing(s, d).select("track_id", F.lit(1).alias("part"), F.col("time_ms").alias("t"), F.concat_ws(",", F.format_string("%.3f", "time_ms"), F.format_string("%.3f", F.when(F.floor(F.col("beat_length_ms")) % 3 == 0, -F.col("beat_length_ms")).otherwise(F.col("beat_length_ms"))), F.lit("4")).alias("line"))
    objects = R.clicks(s, d, "click").select("track_id", F.lit(2).alias("part"), F.col("t_ms").alias("t"), F.concat(F.lit("1,2,"), F.format_string("%.3f", "t_ms"), F.lit(",x")).alias("line"))
    per = points.unionByName(objects).groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("part", "t", "line"))).alias("l"))
    lines = lambda k: F.array_join(F.transform(F.filter("l", lambda x: x["part"] == k), lambda x: x["line"]), "\n")
    return per.select(F.col("track_id").cast("string").alias("path"), F.concat(F.lit("[General]\nAudioFilename: a.wav\n[TimingPoints]\nnot,a,point\n"), lines(1), F.lit("\n[HitObjects]\n1,2\n"), lines(2)).alias("value"))


@query(
    "a6_timing_points",
    sql("timing", then="SELECT track_id, round(time_ms, 3) AS time_ms, round(beat_length_ms, 3) AS beat_length_ms FROM timing WHERE floor(beat_length_ms)::BIGINT % 3 <> 0"),
)
def a6_timing_points(s, d):
    return readers.timing_points(readers.sectioned(map_texts(s, d))).select(F.col("path").cast("long").alias("track_id"), "time_ms", "beat_length_ms")


@query("a7_hit_objects", sql("asked", then="SELECT track_id, round(t_ms, 3) AS t_ms FROM asked"))
def a7_hit_objects(s, d):
    return readers.hit_objects(readers.sectioned(map_texts(s, d))).select(F.col("path").cast("long").alias("track_id"), "t_ms")


def streamed_tones(s, d, form):
    """Tones of 65 s, three chunks and more, a track for each region, as a stream of five pieces each; what ``form`` makes of it, read again."""
    s.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder, size = shared_folder(s), 13 * G.RATE
    seq = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("seq")
    k = F.col("seq") * size
    sample = lambda i: (0.5 * F.sin(2 * F.pi() * (i % G.RATE) * (220 + 110 * F.col("track_id")) / G.RATE) * (i % 11025 < 2205).cast("double")).cast("float")
    pieces = R.table(s, d, "region").select(F.col("r_regionkey").cast("long").alias("track_id"), seq).repartition(25, "track_id", "seq")
    pieces = pieces.select("track_id", "seq", F.transform(F.sequence(k, k + size - 1), sample).alias("samples"), (F.col("seq") == 4).alias("is_last"))
    pieces.write.partitionBy("seq").parquet(f"{folder}/by")
    for n in range(5):
        s.read.parquet(f"{folder}/by/seq={n}").withColumn("seq", F.lit(n)).write.mode("append").parquet(f"{folder}/in")
    source = s.readStream.schema("track_id long, samples array<float>, is_last boolean, seq int").option("maxFilesPerTrigger", 8).parquet(f"{folder}/in")
    stream = form(source).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    stream.awaitTermination()
    return s.read.parquet(f"{folder}/out")


@query("g4_stream_beats")
def streamed(s, d):
    """All beats of the tones, each once, as the settled ones come out."""
    from tempoframe.streaming.tracker import stream_beats

    return streamed_tones(s, d, stream_beats).filter("frame IS NOT NULL")


@query("g7_searched_stream")
def searched_stream(s, d):
    """The searched reading of the tones: the stream gives out its curve, and the search runs on what was written."""
    from tempoframe.streaming.tracker import stream_curve

    return T.searched_path(streamed_tones(s, d, stream_curve), downbeat="downbeat", value="beat")


#: What a beat of the tones has to exceed.
PATH_LEVEL = 0.0


@query("g7_settled_path")
def settled_path(s, d):
    """The searched path of the tones over a fixed level, given out while they stream."""
    from tempoframe.streaming.tracker import stream_path

    return streamed_tones(s, d, lambda pieces: stream_path(pieces, PATH_LEVEL))


@query("i3_memoised")
def memoised(s, d):
    """Grids of all tracks: the first half is stored before, only the others are analysed, and all come back."""
    folder = shared_folder(s)
    grids = R.beats(s, d).groupBy("track_id").agg(F.array_sort(F.collect_list("beat_ms")).alias("beats"))
    keys = grids.select(F.col("track_id").cast("string").alias("path"), sinks.cache_key("b", F.col("track_id").cast("string"), F.size("beats"), F.lit(0)).alias("cache_key"))

    def analyse(missing):
        return missing.join(grids, F.col("path") == F.col("track_id")).select("cache_key", F.lit(0).alias("metrical_shift"), "beats")

    sinks.memoised(keys.filter(F.col("path").cast("long") % 2 == 0), folder, analyse)
    return sinks.memoised(keys, folder, analyse).select(F.col("path").cast("long").alias("track_id"), F.size("beats").alias("beats"))


ORACLE_SQL["i3_memoised"] = sql("beats", then="SELECT track_id, count(*) AS beats FROM beats GROUP BY track_id")
