"""Peaks of activation curves (track_id, frame, x)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempoframe.functions import numeric as N
from tempoframe.sources.folders import written


def _frames():
    return Window.partitionBy("track_id").orderBy("frame")



def frame_peaks(activation: DataFrame, radius: int = 3) -> DataFrame:
    """Positive frames that nothing near exceeds; all members of a plateau stay."""
    return activation.withColumn("_m", F.max("x").over(_frames().rowsBetween(-radius, radius))).filter("x > 0 AND x >= _m").drop("_m")


def merged_peaks(peaks: DataFrame) -> DataFrame:
    """track_id, centre, width: neighbouring peaks pair by pair within each run of consecutive frames."""
    run = peaks.withColumn("_run", F.col("frame") - F.row_number().over(_frames()))
    pair = run.withColumn("_pair", F.floor((F.row_number().over(Window.partitionBy("track_id", "_run").orderBy("frame")) - 1) / 2))
    return pair.groupBy("track_id", "_run", "_pair").agg(F.avg("frame").alias("centre"), F.count(F.lit(1)).cast("int").alias("width")).drop("_run", "_pair")


def refined(activation: DataFrame) -> DataFrame:
    """place: the vertex of the parabola through a frame and its neighbours, at most half a frame away."""
    rows = activation.withColumns({"_b": F.lag("x").over(_frames()), "_a": F.lead("x").over(_frames())})
    bend = F.col("_b") - 2 * F.col("x") + F.col("_a")
    move = N.clamped(0.5 * (F.col("_b") - F.col("_a")) / F.when(F.abs(bend) >= 1e-9, bend), -0.5, 0.5)
    usable = F.col("_b").isNotNull() & F.col("_a").isNotNull() & (F.abs(bend) >= 1e-9)
    return rows.withColumn("place", F.when(usable, F.col("frame") + move).otherwise(F.col("frame").cast("double"))).drop("_b", "_a")


def raw_peaks(activation: DataFrame, radius: int = 3) -> DataFrame:
    """track_id, place, width: merged peaks, refined where a single frame stands alone."""
    groups = merged_peaks(frame_peaks(activation, radius))
    exact = refined(activation).select(F.col("track_id").alias("_t"), F.col("frame").alias("_f"), F.col("place").alias("_p"))
    joined = groups.join(exact, (F.col("track_id") == F.col("_t")) & (F.col("width") == 1) & (F.col("centre") == F.col("_f")), "left")
    return joined.select("track_id", F.coalesce("_p", "centre").alias("place"), "width")


def centroids(activation: DataFrame, radius: int = 2) -> DataFrame:
    """place: centroid of what rises above the lowest value near, over the connected frames around each frame."""
    near = {k: F.lead("x", k).over(_frames()) if k > 0 else F.lag("x", -k).over(_frames()) for k in range(-radius, radius + 1) if k}
    rows = activation.withColumns({f"_n{k + radius}": c for k, c in near.items()})
    value = {k: F.col("x") if k == 0 else F.col(f"_n{k + radius}") for k in range(-radius, radius + 1)}
    floor = F.least(*[F.coalesce(v, F.col("x")) for v in value.values()])
    reached = {0: F.lit(True)}
    for side in (-1, 1):
        for k in range(1, radius + 1):
            reached[side * k] = reached[side * (k - 1)] & F.coalesce(value[side * k] > floor, F.lit(False))
    weight = {k: F.when(reached[k], F.coalesce(v, F.lit(0.0)) - floor).otherwise(0.0) for k, v in value.items()}
    total = sum((weight[k] for k in sorted(weight)), F.lit(0.0))
    moment = sum((weight[k] * (F.col("frame") + k) for k in sorted(weight)), F.lit(0.0))
    return rows.withColumn("place", F.when(total > 1e-9, moment / total).otherwise(F.col("frame").cast("double"))).drop(*[f"_n{k + radius}" for k in near])


def smoothed_periods(curve: DataFrame, seconds: float = 1.0, fps: int = 50, value: str = "period_frames") -> DataFrame:
    """The upper median of the positive periods around each frame; tracks of under three frames stay as they are."""
    half = max(1, round(seconds * fps))
    near = F.collect_list(F.when(F.col(value) > 0, F.col(value))).over(_frames().rowsBetween(-half, half))
    few = F.count(F.lit(1)).over(Window.partitionBy("track_id")) < 3
    return curve.withColumn(value, F.when(few, F.col(value)).otherwise(F.coalesce(N.upper_median(near), F.col(value))))


def suppressed(curve: DataFrame, share: float = 0.6, threshold: float = 0.5, strength: str = "beat_prob", period: str = "period_frames") -> DataFrame:
    """track_id, frame: frames chosen strongest first (earlier on ties), each silencing those nearer than its share of the period.

    In rounds: a frame that nothing stronger reaches is chosen, and with all such frames go the weaker ones that they reach. A frame waits only for stronger ones
    near it, so that few rounds decide all tracks at once, in parts as small as one pleases; each is a grouping by the frames that are reached, and a written table.
    """
    reach = F.greatest(F.lit(1.0), share * F.col(period).cast("double")).cast("int")
    left = written(curve.filter(F.col(strength) >= threshold).select("track_id", "frame", F.col(strength).cast("double").alias("s"), reach.alias("r")))
    chosen = []
    while not left.isEmpty():
        over = F.explode(F.sequence(F.col("frame") - F.col("r") + 1, F.col("frame") + F.col("r") - 1)).alias("at")
        first = left.select("track_id", over, F.struct("s", (-F.col("frame")).alias("f")).alias("by")).groupBy("track_id", "at").agg(F.max("by").alias("by"))
        told = left.join(first.withColumnRenamed("at", "frame"), ["track_id", "frame"]).withColumn("first", -F.col("by.f") == F.col("frame")).drop("by")
        told = written(told)
        now = told.filter("first")
        # Only what is weaker is silenced: a stronger one came before it in the queue, reached or not.
        silent = now.select("track_id", over, F.struct("s", (-F.col("frame")).alias("f")).alias("by")).groupBy("track_id", "at").agg(F.max("by").alias("by")).withColumnRenamed("at", "frame")
        rest = told.filter("NOT first").drop("first").join(silent, ["track_id", "frame"], "left")
        left = written(rest.filter(F.col("by").isNull() | (F.col("by") < F.struct("s", (-F.col("frame")).alias("f")))).drop("by"))
        chosen.append(now.select("track_id", "frame"))
    return reduce(DataFrame.unionByName, chosen) if chosen else left.select("track_id", "frame")


def max_near(frames: DataFrame, radius: int, value: str = "x", name: str = "top", floor: float | None = None) -> DataFrame:
    """The largest value within ``radius`` frames, not below ``floor``."""
    best = F.max(value).over(_frames().rowsBetween(-radius, radius))
    return frames.withColumn(name, best if floor is None else F.greatest(best, F.lit(floor)))


def flux(spectra: DataFrame) -> DataFrame:
    """track_id, frame, flux: what each bin of ``mags`` gained over the frame before (zeros before the first), over the track's mean."""
    gained = F.zip_with("mags", F.coalesce("_p", F.transform("mags", lambda _: F.lit(0.0))), lambda a, b: F.greatest(a - b, F.lit(0.0)))
    raw = spectra.withColumn("_p", F.lag("mags").over(_frames())).select("track_id", "frame", F.aggregate(gained, F.lit(0.0), lambda a, x: a + x).alias("flux"))
    mean = F.avg("flux").over(Window.partitionBy("track_id"))
    return raw.withColumn("flux", F.when(mean > 0, F.col("flux") / mean).otherwise(F.col("flux")))
