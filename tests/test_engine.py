"""Queries against DuckDB, DataFrame forms against kernels, sources, sinks and the stream."""

import struct
import wave
import zipfile

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tempoframe.functions import numeric as N
from tempoframe.operators import asof, beats as B, grids, kernels as K, peaks as P, scoring as S, search, signal as G, tracking as T
from tempoframe.plans import queries as Q, relations as R
from tempoframe.sources import readers, sinks
from tempoframe.streaming.tracker import stream_beats

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def twin(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    plain = lambda v: None if v is None or v is pd.NA or (isinstance(v, float) and v != v) else (float(f"{v:.7g}") if isinstance(v, (float, np.floating)) else v.item() if isinstance(v, np.generic) else v)
    return sorted((tuple(plain(v) for v in r) for r in frame.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_its_twin(spark, sf, twin, name):
    got, expected = Q.QUERIES[name](spark, sf).toPandas(), twin.execute(Q.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns) and rows(got) == rows(expected)


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE_SQL)))
def test_kernel_queries_run_over_whole_tables(spark, sf, name):
    assert Q.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 15
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def values(spark, items, expr):
    return [r[0] for r in spark.createDataFrame([(float(x),) for x in items], "x double").select(expr(F.col("x"))).collect()]


def test_numeric_conventions(spark):
    assert values(spark, [0.5, 1.5, 2.5, -0.5], N.half_even) == [0, 2, 2, 0]
    assert values(spark, [0.5, 1.5, 2.5, -0.5], N.half_away) == [1, 2, 3, -1]
    assert values(spark, [1.7, -1.7], N.truncated) == [1, -1]
    assert values(spark, [250, 500, 75, 120, 200, 80, 0, 219.9, 220], N.shift_for) == [1, 2, -1, 0, 0, 0, 0, 0, 1]
    one = spark.range(1).select(N.upper_median(F.array(*map(F.lit, (1, 2, 3, 4)))), N.true_median(F.array(*map(F.lit, (1, 2, 3, 4)))), N.percentile_at(F.array(*map(F.lit, (1, 2, 3, 4))), 0.9), N.upper_median(F.array().cast("array<double>")))
    assert tuple(one.first()) == (3, 2.5, 4, None)


def beats_of(spark, *lists):
    return spark.createDataFrame([(t, float(b)) for t, beats in enumerate(lists) for b in beats], "track_id long, beat_ms double")


def test_octave_shifts(spark):
    at = lambda bpm, n=120: np.arange(n) * 60000.0 / bpm
    ramp = np.cumsum([60000 / (150 + 250 * i / 119) for i in range(120)])
    df = beats_of(spark, at(100), at(140), at(179), at(219), at(250), at(50), ramp, at(240, 64), [5.0])
    assert [r["shift"] for r in B.choose_shift(df).orderBy("track_id").collect()] == [0, 0, 0, 0, 1, -1, 0, 1, 0]
    sizes = {r["track_id"]: r["count"] for r in B.normalise(df).groupBy("track_id").count().collect()}
    assert (sizes[4], sizes[5], sizes[7], sizes[8]) == (60, 239, 32, 1)


def test_lookups(spark):
    grid = B.indexed(beats_of(spark, np.arange(20) * 500.0, [1000.0]))
    asked = spark.createDataFrame([(0, 0.0), (0, 250.0), (0, 499.0), (0, 500.0), (1, 500.0), (2, 1.0)], "track_id long, t_ms double")
    got = asof.asof_join(asked, grid, ["beat_idx"]).orderBy("track_id", "t_ms").collect()
    assert [r["beat_idx"] for r in got] == [0, 0, 0, 1, None, None]
    near = {(r["track_id"], r["t_ms"]): r["offset_ms"] for r in asof.nearest(asked, grid).collect()}
    assert near[0, 250.0] == 250.0 and near[0, 499.0] == -1.0 and near[0, 500.0] == 0.0 and near[1, 500.0] == -500.0 and near[2, 1.0] is None


def test_native_forms_equal_kernels(spark, sf):
    own = R.beats(spark, sf)
    lists = {r[0]: np.sort(r[1]) for r in own.groupBy("track_id").agg(F.collect_list("beat_ms")).collect()}
    periods = B.local_periods(own).orderBy("track_id", "beat_ms").toPandas().groupby("track_id").period_ms.apply(list)
    flags = B.change_flags(B.robust_gaps(own)).orderBy("track_id", "gap_idx").toPandas().groupby("track_id")
    dominant = {r[0]: r[1] for r in B.dominant_periods(own).collect()}
    for t, b in lists.items():
        assert periods[t] == K.modal_periods(b).tolist()
        assert dominant[t] == pytest.approx(K.dominant_period(b, K.modal_periods(b)))
        assert flags.get_group(t).robust_ms.tolist() == K.robust(np.diff(b)).tolist()
        assert flags.get_group(t).changed.tolist() == K.flags_of_change(K.robust(np.diff(b))).tolist()


def test_grid_refuses_to_cut(spark):
    timing = spark.createDataFrame([(1, 0.0, 0.001)], "track_id long, time_ms double, beat_length_ms double")
    with pytest.raises(Exception, match="too many beats"):
        grids.grid(timing).count()
    assert grids.grid(timing, shortest_ms=5.0).count() == 0


def tracks(spark, seconds=(0.01, 3.0, 70.0)):
    rng = np.random.default_rng(1)
    out = [rng.normal(size=max(1, int(s * G.RATE))).astype(np.float32) for s in seconds]
    return out, spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(out)], "track_id long, samples array<float>")


def test_front_end_by_chunks_equals_the_whole(spark):
    samples, df = tracks(spark)
    got = G.mel_frames(df, 200).toPandas()
    for i, x in enumerate(samples):
        mine = np.stack(got[got.track_id == i].sort_values("frame").mel)
        assert np.allclose(mine, G.log_mel(x), atol=1e-6)
    mel = G.mel_frames(df)
    found = S.activations(mel).toPandas()
    curve = P.flux(G.flux_spectra(df)).toPandas()
    for i, x in enumerate(samples):
        one = found[found.track_id == i].sort_values("frame")
        a, b = S.scored(G.log_mel(x), S.band_scorer)
        assert np.allclose(one.beat, a, atol=1e-4) and np.allclose(one.downbeat, b, atol=1e-4)
        assert np.allclose(curve[curve.track_id == i].sort_values("frame").flux, G.onset_envelope(x), rtol=1e-4)


def test_stream_equals_batch(spark, tmp_path):
    samples, _ = tracks(spark, (3.0, 33.0))
    pieces = [(t, k, x[a : a + 150_000].tolist(), a + 150_000 >= len(x)) for t, x in enumerate(samples) for k, a in enumerate(range(0, len(x), 150_000))]
    schema = "track_id long, seq long, samples array<float>, is_last boolean"
    for k in range(max(p[1] for p in pieces) + 1):
        spark.createDataFrame([p for p in pieces if p[1] == k], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stream_beats(source).writeStream.format("memory").queryName("beats_out").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.table("beats_out").filter("frame IS NOT NULL").toPandas()
    for t, x in enumerate(samples):
        expected = K.beat_frames(S.scored(G.log_mel(x), S.band_scorer)[0])
        assert np.allclose(sorted(got[got.track_id == t].frame), expected)


def test_detector_and_search_forms(spark):
    x = np.full(200, 0.1)
    x[20::25] = 0.9
    df = spark.createDataFrame([(1, i, float(v), 25.0) for i, v in enumerate(x)], "track_id long, frame int, beat_prob double, period_frames double")
    assert [r["beat_ms"] for r in T.detector_beats(df).orderBy("frame").collect()] == [pytest.approx(i * 20.0) for i in range(20, 200, 25)]
    assert [r["frame"] for r in T.searched_path(df.withColumnRenamed("beat_prob", "x")).orderBy("frame").collect()] == list(range(20, 200, 25))
    assert T.pruned_peaks(df.withColumn("x", F.col("beat_prob") - 0.5)).count() == 8
    assert T.bpm_at(spark.createDataFrame([(9, 1.0)], "track_id long, t_ms double"), beats_of(spark, [1.0, 2.0])).first()["bpm"] == 0


MAP = "osu file format v14\r\n\r\n[General]\r\nAudioFilename: song.wav\r\n[TimingPoints]\r\n1000,500,4\r\n2000,-100,4\r\nbad\r\n500,250\r\n[HitObjects]\r\n1,2,700,x\r\n1,2\r\n"


def test_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.osu").write_text(MAP)
    with wave.open(str(tmp_path / "a" / "song.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(44_100)
        w.writeframes(np.tile(np.array([16384, 0], "<i2"), 4410).tobytes())
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "two.osu").write_text(MAP.replace("song.wav", "gone.wav"))
    np.arange(10, dtype="<f4").tofile(tmp_path / "b" / "only.f32")
    with zipfile.ZipFile(tmp_path / "z.osz", "w") as z:
        z.writestr("readme", "x")
        z.writestr("m.osu", MAP)
    lines = readers.map_lines(spark, str(tmp_path))
    assert [tuple(r) for r in readers.timing_points(lines).filter("path LIKE '%one%'").select("time_ms", "beat_length_ms").orderBy("time_ms").collect()] == [(500.0, 250.0), (1000.0, 500.0)]
    assert [r["t_ms"] for r in readers.hit_objects(lines).filter("path LIKE '%one%'").collect()] == [700.0]
    assert readers.timing_points(readers.sectioned(readers.archived_maps(spark, str(tmp_path)))).count() == 2
    named = {r["path"].rsplit("/", 1)[1]: r["audio"].rsplit("/", 1)[1] for r in readers.corpus(spark, str(tmp_path)).collect()}
    assert named == {"one.osu": "song.wav", "two.osu": "only.f32"}
    mono = readers.read_mono(spark, str(tmp_path), "*.wav").first()["samples"]
    assert len(mono) == 2205 and np.allclose(mono[300:-300], 0.25, atol=1e-3)
    assert readers.read_audio(spark, str(tmp_path), "*.f32").first()["samples"] == list(range(10))
    assert readers.read_audio(spark, str(tmp_path), "*.f32", lambda data: (np.ones(3, np.float32), 1, 8000)).first()["sample_rate"] == 8000
    (tmp_path / "p.csv").write_text("# c\n10,300\nx,y\n 20 , 400 \n5\n")
    assert sorted(map(tuple, readers.csv_timing_points(spark, str(tmp_path / "p.csv")).collect())) == [(10.0, 300.0), (20.0, 400.0)]
    (tmp_path / "f.bin").write_bytes(struct.pack("<3i", 2, 3, 4) + np.arange(10, dtype="<f4").tobytes())
    got = readers.read_fixture(spark, str(tmp_path / "f.bin")).first()
    assert (got["mel"], got["samples"]) == ([0, 1, 2, 3, 4, 5], [6, 7, 8, 9])
    (tmp_path / "m.tsv").write_text("id\tset\taudio\tlabels\tframes\tbeats\tperiod\tlag\toctave\tusable\tseparations\na\ts\tx\ty\t1\t2\t3.5\t0\t0\t1\t\nb\ts\n")
    assert [r["id"] for r in readers.read_manifest(spark, str(tmp_path / "m.tsv")).collect()] == ["a"]


def test_cache(spark, tmp_path):
    folder, data = str(tmp_path / "cache"), tmp_path / "in"
    data.mkdir()
    (data / "t.f32").write_bytes(b"1234")
    calls = []

    def analyse(keys):
        calls.append(keys.count())
        return keys.select("cache_key", F.lit(1).alias("metrical_shift"), F.array(F.lit(1.23456), F.lit(2.0)).alias("beats"))

    keys = sinks.file_keys(spark, str(data), "build", sinks.reading())
    before = keys.first()["cache_key"]
    assert sinks.memoised(keys, folder, analyse).first()["beats"] == [1.235, 2.0]
    assert sinks.memoised(keys, folder, analyse).count() == 1 and calls == [1]
    other = sinks.file_keys(spark, str(data), "build", sinks.reading(search=True)).first()["cache_key"]
    assert len(other) == 32 and other != before
    (data / "t.f32").write_bytes(b"12345")
    assert sinks.file_keys(spark, str(data), "build", sinks.reading()).first()["cache_key"] != before
    entries = spark.createDataFrame([("tempoframe-beatgrid 1\n0\n1,2.5",), ("tempoframe-beatgrid 1\nx\n1",), ("other\n0\n1",), ("tempoframe-beatgrid 1\n0\n1,a",), ("",)], "e string")
    assert [r[0] and tuple(r[0]) for r in entries.select(sinks.text_entry(F.col("e"))).collect()] == [(0, [1.0, 2.5]), None, None, None, None]


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "id string, frames int")
    folder = str(tmp_path / "m")
    assert sinks.write_manifest(rows, folder) == 2 and sinks.write_manifest(rows.unionByName(spark.createDataFrame([("c", 3)], rows.schema)), folder) == 1
    assert spark.read.option("sep", "\t").csv(folder).count() == 3
    sinks.write_curve(spark.createDataFrame([(20.0, 120.0, 1.0), (0.0, 119.0, 0.5)], "time_ms double, bpm double, confidence double"), str(tmp_path / "c"))
    assert [r["bpm"] for r in spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "c")).collect()] == ["119.0", "120.0"]
    sinks.write_frames(spark.createDataFrame([(1, [0, 1, 2])], "track_id long, labels array<tinyint>"), str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).first()["labels"] == [0, 1, 2]


def test_nothing_outside_uses_the_training_data_package():
    from pathlib import Path

    top = Path(__spark_entry__.__file__).parent / "tempoframe"
    assert not [p for p in top.rglob("*.py") if "llm" not in p.parts and "tempoframe.llm" in p.read_text()]


def field(number, *parts):
    """A field of a protocol buffer: numbers as they are, everything else by length."""
    out = b""
    for p in parts:
        if isinstance(p, int):
            out += bytes([number << 3 & 0x7F | 0x80, number >> 4]) + bytes([p]) if number > 15 else bytes([number << 3, p])
        else:
            p = p.encode() if isinstance(p, str) else p
            key = bytes([number << 3 | 2])
            size = bytes([len(p)]) if len(p) < 128 else bytes([len(p) & 0x7F | 0x80, len(p) >> 7])
            out += key + size + p
    return out


def model_file(inputs="spectrogram", outputs=("beat", "downbeat"), axis=2):
    """A model in the exchange format: the mean and the maximum over one axis."""
    attributes = field(5, field(1, "axes") + field(8, axis) + field(20, 7), field(1, "keepdims") + field(3, 0) + field(20, 2))
    nodes = b"".join(field(1, field(1, inputs) + field(2, name) + field(4, op) + attributes) for name, op in zip(outputs, ("ReduceMean", "ReduceMax"), strict=True))

    def value(name, *dims):
        shape = b"".join(field(1, field(1, x) if isinstance(x, int) else field(2, x)) for x in dims)
        return field(1, name) + field(2, field(1, field(1, 1) + field(2, shape)))

    dims = (1, "t", "b")
    graph = nodes + field(2, "g") + field(11, value(inputs, *dims)) + b"".join(field(12, value(name, 1, "t")) for name in outputs)
    return field(1, 8) + field(7, graph) + field(8, field(2, 13))


def test_a_model_file_scores(spark, tmp_path):
    path = tmp_path / "m.onnx"
    path.write_bytes(model_file())
    rng = np.random.default_rng(5)
    mel = rng.random((3000, 40)).astype(np.float32)
    a, b = S.onnx_scorer(str(path))(mel)
    assert np.allclose(a, mel.mean(1), atol=1e-6) and np.allclose(b, mel.max(1))
    df = spark.createDataFrame(pd.DataFrame({"track_id": 1, "frame": np.arange(3000), "mel": mel.tolist()}), "track_id long, frame int, mel array<float>")
    got = S.activations(df, S.onnx_scorer(str(path))).orderBy("frame").toPandas()
    assert np.allclose(got.beat, mel.mean(1), atol=1e-6) and np.allclose(got.downbeat, mel.max(1))
    other = tmp_path / "d.onnx"
    other.write_bytes(model_file("x", ("beat_logit", "period_logit"), 1))
    a, b = S.onnx_scorer(str(other), 2, "x", ("beat_logit", "period_logit"), bands_first=True)(mel)
    assert np.allclose(a, mel.mean(1), atol=1e-6) and np.allclose(b, mel.max(1))


def test_predicted_is_both_outputs(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(2, 500))
    df = spark.createDataFrame(pd.DataFrame({"track_id": 4, "frame": np.arange(500), "beat": a, "downbeat": b}), "track_id long, frame int, beat double, downbeat double")
    got = T.predicted(df).toPandas()
    for kind, curve in (("beat", a), ("downbeat", b)):
        assert np.allclose(sorted(got[got.kind == kind].place), K.beat_frames(curve))


def test_searched_reading_of_a_stream_is_that_of_the_whole(spark, sf):
    got = Q.QUERIES["g7_searched_stream"](spark, sf).toPandas()
    from tempoframe.plans.track_queries import streamed_tones
    from tempoframe.streaming.tracker import stream_curve

    curve = streamed_tones(spark, sf, stream_curve).toPandas()
    for track, rows in curve.groupby("track_id"):
        rows = rows.sort_values("frame")
        assert rows.frame.tolist() == list(range(len(rows))) and len(rows) > 3000
        assert sorted(got[got.track_id == track].frame) == search.best_path(rows.beat.to_numpy(), rows.downbeat.to_numpy()).tolist()


def test_groups_that_span_batches(spark):
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        data = [(t, None if t == 3 else k % 2, i) for k, (t, n) in enumerate([(0, 1), (1, 40), (2, 7), (None, 9), (3, 14), (4, 3)]) for i in range(n)]
        df = spark.createDataFrame(data, "track_id long, part int, i int").repartition(3)
        out = K.per_group(df, ("track_id", "part"), lambda f: {"n": np.array([len(f["i"])]), "ok": np.array([(np.diff(f["i"]) == 1).all()])}, "track_id long, part int, n long, ok boolean", "i")
        assert sorted(map(tuple, out.collect()), key=str) == sorted([(0, 0, 1, True), (1, 1, 40, True), (2, 0, 7, True), (None, 1, 9, True), (3, None, 14, True), (4, 1, 3, True)], key=str)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
