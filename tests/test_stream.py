"""The stream's state: what it holds while a track goes on, and what is left when it has ended."""

import time

import numpy as np
import pytest

from tempoframe.operators import search, signal as G
from tempoframe.streaming import tracker
from tempoframe.streaming.tracker import TrackState
from tests.test_search import pulses

SCHEMA = "track_id long, seq int, samples array<float>, is_last boolean"


@pytest.mark.parametrize("seed", range(4))
def test_settled_frames_are_those_of_the_whole(seed):
    rng = np.random.default_rng(seed)
    x, down = pulses(rng, 9000, (25, 12, 40, 31)[seed]), (np.random.default_rng(9).random(9000) < 0.03) * 0.5
    path, found, at, seen = search.PathState(), [], 0, 0
    while at < len(x):
        n = int(rng.integers(1, 800))
        new = path.add(search.rewards(x[at : at + n], down[at : at + n], 0.02, 0.2))
        seen += bool(new)
        found += new
        at += n
    assert seen > 3 and found + path.finish() == search.best_path(x, down, floor=0.02, level=0.2).tolist()


def test_nothing_is_settled_while_a_beat_may_start_anew():
    rng = np.random.default_rng(1)
    x = rng.normal(size=3000)
    path, found = search.PathState(), []
    for at in range(0, 3000, 100):
        found += path.add(search.rewards(x[at : at + 100], level=1.5))
    assert found + path.finish() == search.best_path(x, level=1.5).tolist()
    assert search.PathState().finish() == [] and search.PathState().add(np.zeros(0, np.int64)) == []
    short = search.PathState()
    assert short.add(search.rewards(np.ones(8), level=0.0)) + short.finish() == []


def test_what_is_kept_of_an_hour_stays_short():
    rng = np.random.default_rng(5)
    x = pulses(rng, 180_000, 24)
    path, found, most = search.PathState(), [], []
    for at in range(0, len(x), 1488):
        found += path.add(search.rewards(x[at : at + 1488], level=0.15))
        most.append(len(path.came))
    assert max(most[5:]) < 6000 and max(most[60:]) <= max(most[5:60]) * 1.5
    assert found + path.finish() == search.best_path(x, level=0.15).tolist()


def stream(spark, tmp_path, batches, form):
    """Each batch of rows is a micro-batch of its own; what came out of all."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = form(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out")).toPandas()


def state_rows(spark, tmp_path, name):
    return spark.read.format("statestore").option("path", str(tmp_path / "state")).option("stateVarName", name).load().count()


def clicks(rng, seconds, step=11025):
    x = np.zeros(int(seconds * G.RATE), np.float32)
    for at in range(500, len(x) - 400, step):
        x[at : at + 400] = rng.normal(size=400)
    return x


def test_ended_tracks_leave_a_mark_and_open_ones_their_tail(spark, tmp_path):
    rng = np.random.default_rng(2)
    sound = clicks(rng, 1.2)
    half = len(sound) // 2
    ended = [(t, 0, sound[:half].tolist(), False) for t in range(20)], [(t, 1, sound[half:].tolist(), True) for t in range(20)]
    open_one = [(500, 0, sound[:half].tolist(), False)]
    got = stream(spark, tmp_path, [ended[0] + open_one, ended[1]], tracker.stream_beats)
    alone = TrackState()
    want = alone.add(sound) + alone.flush()
    assert want and all(sorted(g.frame.dropna()) == want for _, g in got[got.track_id < 20].groupby("track_id")) and got[got.track_id < 20].track_id.nunique() == 20
    assert [state_rows(spark, tmp_path, name) for name in ("progress", "tail", "pieces", "mark")] == [1, 1, 1, 20]


def test_a_track_without_rows_ends_by_itself(spark, tmp_path):
    sound = clicks(np.random.default_rng(3), 1.5)
    spark.createDataFrame([(1, 0, sound.tolist(), False), (2, 0, sound.tolist(), True)], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    # A stream with timers has always another batch to come, so that it is stopped once the track has ended.
    form = tracker.stream_beats(source, idle_ms=1).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
    q, until, out = form.trigger(processingTime="200 milliseconds").start(), time.time() + 60, None
    try:
        while time.time() < until and q.isActive and (out is None or not out[out.track_id == 1].final.any()):
            time.sleep(2)
            if len(list((tmp_path / "out").glob("_spark_metadata/*"))) > 1:
                out = spark.read.parquet(str(tmp_path / "out")).toPandas()
    finally:
        q.stop()
    alone = TrackState()
    want = alone.add(sound) + alone.flush()
    one = out[out.track_id == 1]
    assert sorted(one.frame.dropna()) == want and one.final.any()


def test_rows_after_the_end(spark, tmp_path):
    sound = clicks(np.random.default_rng(3), 1.0).tolist()
    got = stream(spark, tmp_path / "a", [[(1, 0, sound, True)], [(1, 1, None, True)]], tracker.stream_beats)
    assert got.final.all()
    with pytest.raises(Exception, match="the track has ended"):
        stream(spark, tmp_path / "b", [[(1, 0, sound, True)], [(1, 1, sound, False)]], tracker.stream_beats)


def test_the_settled_path_of_a_stream_is_the_searched_path_of_its_curve(spark, sf):
    from tempoframe.operators import tracking as T
    from tempoframe.plans.track_queries import PATH_LEVEL, streamed_tones
    from tempoframe.streaming.tracker import stream_curve

    curve = streamed_tones(spark, sf, stream_curve)
    want = T.searched_path(curve, downbeat="downbeat", value="beat", level=PATH_LEVEL)
    got = streamed_tones(spark, sf, lambda s: tracker.stream_path(s, PATH_LEVEL))
    assert got.count() > 100 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert curve.select("track_id").distinct().count() == 5
