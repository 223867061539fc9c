"""From curves to beats and grids: compositions of native steps with the order-dependent kernels.

Where a kernel needs two relations of a track, they go to it as one tagged union: one exchange, each row once.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempoframe.operators import kernels as K, peaks as P
from tempoframe.operators.kernels import Arrays, per_track
from tempoframe.operators.search import searched_path  # noqa: F401


def _tagged(first: DataFrame, at: str, second: DataFrame, then: str, value: str | None = None) -> DataFrame:
    """track_id, at, second (false or true), x: the rows of both by place, x of the second."""
    one = first.select("track_id", F.col(at).cast("double").alias("at"), F.lit(False).alias("second"), F.lit(None).cast("double").alias("x"))
    return one.unionByName(second.select("track_id", F.col(then).cast("double").alias("at"), F.lit(True).alias("second"), (F.col(value) if value else F.lit(None)).cast("double").alias("x")))


def pruned_peaks(activation: DataFrame, radius: int = 3, ratio: float = 0.7, value: str = "x") -> DataFrame:
    """track_id, place, beat_ms: raw peaks without those that come much too early; the curve has a value for each frame."""

    def kernel(f: Arrays) -> Arrays:
        places = K.beat_frames(f["x"], radius, ratio)
        return {"place": places, "beat_ms": places * 20.0}

    return per_track(activation.select("track_id", "frame", F.col(value).cast("double").alias("x")), kernel, "place double, beat_ms double", "frame")


def predicted(curve: DataFrame) -> DataFrame:
    """track_id, kind (beat or downbeat), place, beat_ms: the peaks of both scored outputs (beat, downbeat)."""
    kinds = ("beat", "downbeat")

    def kernel(f: Arrays) -> Arrays:
        found = [K.beat_frames(f[c]) for c in kinds]
        places = np.concatenate(found)
        return {"kind": np.repeat(kinds, [len(x) for x in found]), "place": places, "beat_ms": places * 20.0}

    # Both outputs of a track at once, so that the curve is made and dealt once.
    return per_track(curve.select("track_id", "frame", *(F.col(c).cast("double").alias(c) for c in kinds)), kernel, "kind string, place double, beat_ms double", "frame")


def suppressed(curve: DataFrame, share: float = 0.6) -> DataFrame:
    """track_id, frame: beats of a curve of beat_prob and period_frames."""
    return per_track(curve.select("track_id", "frame", "beat_prob", "period_frames"), lambda f: {"frame": f["frame"][K.suppress(f["beat_prob"], f["period_frames"], share)]}, "frame int", "frame")


def placed(curve: DataFrame, share: float = 0.6) -> DataFrame:
    """track_id, frame, beat_ms: suppressed frames, moved to the centroid around them."""
    exact = P.centroids(curve.select("track_id", "frame", F.col("beat_prob").cast("double").alias("x"))).select("track_id", "frame", "place")
    return suppressed(curve, share).join(exact, ["track_id", "frame"]).select("track_id", "frame", (F.col("place") * 20.0).alias("beat_ms"))


def detector_beats(curve: DataFrame, share: float = 0.6, smoothing_seconds: float = 1.0) -> DataFrame:
    return placed(P.smoothed_periods(curve, smoothing_seconds) if smoothing_seconds > 0 else curve, share)


def regularised(beats: DataFrame) -> DataFrame:
    return per_track(beats.select("track_id", "beat_ms"), lambda f: {"beat_ms": K.regularised(f["beat_ms"])}, "beat_ms double", "beat_ms")


def tempo_sections(beats: DataFrame, window: int = 16, share: float = 0.06, persistence: int = 20, shortest: int = 16) -> DataFrame:
    """track_id, section_idx, start_ms, end_ms, period_ms, bpm, duration_ms."""

    def kernel(f: Arrays) -> Arrays:
        found = np.array(K.tempo_sections(f["beat_ms"], window, share, persistence, shortest), float).reshape(-1, 3)
        return {"section_idx": np.arange(len(found)), "start_ms": found[:, 0], "end_ms": found[:, 1], "period_ms": found[:, 2]}

    rows = per_track(beats.select("track_id", "beat_ms"), kernel, "section_idx int, start_ms double, end_ms double, period_ms double", "beat_ms")
    return rows.withColumns({"bpm": F.when(F.col("period_ms") > 0, 60000 / F.col("period_ms")).otherwise(0.0), "duration_ms": F.col("end_ms") - F.col("start_ms")})


def even_grid(beats: DataFrame) -> DataFrame:
    """track_id, beat_ms, even: evenly laid beats, or the track's own where there are too few."""

    def kernel(f: Arrays) -> Arrays:
        laid = K.even_beats(f["beat_ms"])
        out = f["beat_ms"] if laid is None else laid
        return {"beat_ms": out, "even": np.full(len(out), laid is not None)}

    return per_track(beats.select("track_id", "beat_ms"), kernel, "beat_ms double, even boolean", "beat_ms")


def bpm_at(points: DataFrame, beats: DataFrame, window: int = 6) -> DataFrame:
    """Points (track_id, t_ms) with the tempo of the beats around them; 0 for a track without two beats."""

    def kernel(f: Arrays) -> Arrays:
        asked = f["at"][f["second"]]
        return {"t_ms": asked, "bpm": K.bpm_at(f["at"][~f["second"]], asked, window)}

    return per_track(_tagged(beats, "beat_ms", points, "t_ms"), kernel, "t_ms double, bpm double", "at", union=True)


def coalesced_sections(timing: DataFrame, until_ms: float = 0.0) -> DataFrame:
    def kernel(f: Arrays) -> Arrays:
        found = np.array(K.coalesced(f["time_ms"], f["beat_length_ms"], until_ms), float).reshape(-1, 3)
        return {"start_ms": found[:, 0], "end_ms": found[:, 1], "period_ms": found[:, 2]}

    return per_track(timing.select("track_id", "time_ms", "beat_length_ms"), kernel, "start_ms double, end_ms double, period_ms double", "time_ms")


def snapped(beats: DataFrame, curve: DataFrame) -> DataFrame:
    """track_id, beat_ms, snapped_ms: beats on the phase of their run, by an onset curve (frame, x)."""

    def kernel(f: Arrays) -> Arrays:
        own = f["at"][~f["second"]]
        return {"beat_ms": own, "snapped_ms": K.snapped(own, f["x"][f["second"]])}

    return per_track(_tagged(beats, "beat_ms", curve, "frame", "x"), kernel, "beat_ms double, snapped_ms double", "at", union=True)


def tempo_steps(beats: DataFrame, step_ms: float = 1000.0) -> DataFrame:
    """track_id, t_ms, bpm, step: the tempo each second and its change; ``jump`` counts the seconds since the last large one."""
    from pyspark.sql import Window

    spans = beats.groupBy("track_id").agg(F.max("beat_ms").alias("end"))
    points = spans.select("track_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("end") / step_ms).cast("int"))).alias("k")).select("track_id", (F.col("k") * step_ms).alias("t_ms"))
    w = Window.partitionBy("track_id").orderBy("t_ms")
    rows = bpm_at(points, beats).withColumn("step", F.abs(F.col("bpm") / F.lag("bpm").over(w) - 1))
    run = F.sum(F.when(F.col("step") > 0.25, 1).otherwise(0)).over(w)
    return rows.withColumn("run", run).withColumn("held", F.count(F.lit(1)).over(Window.partitionBy("track_id", "run")))
