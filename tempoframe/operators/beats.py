"""Gaps, tempo and octave analytics of beat lists (track_id, beat_ms)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempoframe.functions import numeric as N

MIN_BPM, MAX_BPM, MAJORITY, MAX_SHIFT = 80.0, 220.0, 0.8, 4


def _track():
    return Window.partitionBy("track_id").orderBy("beat_ms")


def indexed(beats: DataFrame) -> DataFrame:
    return beats.withColumn("beat_idx", F.row_number().over(_track()) - 1)


def intervals(beats: DataFrame, positive: bool = False) -> DataFrame:
    """gap_ms between each beat and the one before it."""
    out = beats.withColumn("gap_ms", F.col("beat_ms") - F.lag("beat_ms").over(_track())).filter("gap_ms IS NOT NULL")
    return out.filter("gap_ms > 0") if positive else out


def beat_lengths(beats: DataFrame) -> DataFrame:
    """length_ms: the gap to the next beat; the last beat repeats the gap before it; 0 for a beat alone."""
    return beats.withColumn("length_ms", F.coalesce(F.lead("beat_ms").over(_track()) - F.col("beat_ms"), F.col("beat_ms") - F.lag("beat_ms").over(_track()), F.lit(0.0)))


def _gap_ahead() -> Column:
    return F.lead("beat_ms").over(_track()) - F.col("beat_ms")


def local_periods(beats: DataFrame, window: int = 16) -> DataFrame:
    """track_id, beat_ms, period_ms: the gap around each beat that most gaps are within a quarter of, the smallest of equals; 0 below 3 gaps."""
    near = F.collect_list(_gap_ahead_of("_next")).over(_track().rowsBetween(-window, window - 1))
    votes = F.transform("_near", lambda c: F.struct(F.size(F.filter("_near", lambda x: (x >= c * 0.75) & (x <= c * 1.25))).alias("n"), (-c).alias("m")))
    rows = beats.select("track_id", "beat_ms", F.lead("beat_ms").over(_track()).alias("_next")).withColumn("_near", near)
    return rows.select("track_id", "beat_ms", F.when(F.size("_near") >= 3, -F.array_max(votes)["m"]).otherwise(0.0).alias("period_ms"))


def _gap_ahead_of(name: str) -> Column:
    return F.col(name) - F.col("beat_ms")


def dominant_periods(beats: DataFrame, window: int = 16) -> DataFrame:
    """track_id, dominant_ms: the local period that accounts for most time (to a millionth), the earliest of equals; 0 below 4 beats.

    The time of all periods within a quarter of one is the difference of two running sums over the periods in order: values and both
    ends of each range are one tagged union, sorted once.
    """
    rows = local_periods(beats, window).withColumns({"gap": _gap_ahead(), "count": F.count(F.lit(1)).over(Window.partitionBy("track_id"))})
    kinds = F.array(F.struct((F.col("period_ms") * 0.75).alias("at"), F.lit(0).alias("kind")), F.struct(F.col("period_ms").alias("at"), F.lit(1).alias("kind")), F.struct((F.col("period_ms") * 1.25).alias("at"), F.lit(2).alias("kind")))
    each = rows.filter("gap IS NOT NULL").select("track_id", "beat_ms", "period_ms", "gap", "count", F.explode(kinds).alias("p")).select("track_id", "beat_ms", "period_ms", "gap", "count", "p.*")
    upto = Window.partitionBy("track_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    summed = each.withColumn("sum", F.sum(F.when(F.col("kind") == 1, F.col("gap")).otherwise(0.0)).over(upto))
    ends = [F.max(F.when(F.col("kind") == k, F.col("sum"))) for k in (2, 0)]
    # Beats of one place are told apart by their period only; their weights are equal.
    weight = summed.groupBy("track_id", "beat_ms", "period_ms", "count").agg(F.round(ends[0] - ends[1], 6).alias("weight"))
    best = weight.groupBy("track_id", "count").agg(F.max_by("period_ms", F.struct(F.when(F.col("period_ms") > 0, F.col("weight")).otherwise(0.0).alias("w"), (-F.col("beat_ms")).alias("b"))).alias("p"))
    return beats.select("track_id").distinct().join(best, "track_id", "left").select("track_id", F.when(F.col("count") >= 4, F.col("p")).otherwise(0.0).alias("dominant_ms"))


def share_in_range(gaps: DataFrame, shift: int = 0, low: float = MIN_BPM, high: float = MAX_BPM) -> DataFrame:
    return gaps.groupBy("track_id").agg(F.avg(F.when(N.in_range(60000 / F.col("gap_ms") / F.lit(2.0**shift), low, high), 1.0).otherwise(0.0)).alias("share"))


def choose_shift(beats: DataFrame, low: float = MIN_BPM, high: float = MAX_BPM, majority: float = MAJORITY) -> DataFrame:
    """track_id, shift: octaves to move a track whose tempo lies out of range; one pass over the gaps, no expansion."""
    bpm = 60000 / F.col("gap_ms")
    order = [0] + [s for k in range(1, MAX_SHIFT + 1) for s in (k, -k)]
    inside = [F.count_if(N.in_range(bpm / F.lit(2.0**s), low, high)).alias(f"s{i}") for i, s in enumerate(order)]
    per = intervals(beats, positive=True).groupBy("track_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(bpm < low).alias("below"), F.count_if(bpm >= high).alias("above"), *inside)
    ranked = F.array_max(F.array(*[F.struct(F.col(f"s{i}").alias("n"), F.lit(-i).alias("first"), F.lit(s).alias("shift")) for i, s in enumerate(order)]))
    needed = F.lit(majority) * F.col("n")
    chosen = F.when((F.col("below") < needed) & (F.col("above") < needed), 0).when(ranked["n"] / F.col("n") >= majority, ranked["shift"]).otherwise(0)
    return beats.select("track_id").distinct().join(per.select("track_id", chosen.alias("_s")), "track_id", "left").select("track_id", F.coalesce("_s", F.lit(0)).alias("shift"))


def apply_shift(beats: DataFrame, shifts: DataFrame) -> DataFrame:
    """track_id, shift, beat_ms: every 2^s-th beat for s > 0, each gap in 2^-s parts for s < 0."""
    rows = indexed(beats).withColumn("_next", F.lead("beat_ms").over(_track())).join(shifts, "track_id")
    s = F.col("shift")
    step = F.pow(F.lit(2.0), F.least(s, F.lit(MAX_SHIFT))).cast("int")
    parts = F.pow(F.lit(2.0), F.least(-s, F.lit(MAX_SHIFT))).cast("int")
    places = F.when(s >= 0, F.when((s == 0) | (F.col("beat_idx") % step == 0), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))).otherwise(F.when(F.col("_next").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), parts - 1)))
    each = rows.withColumn("_k", F.explode(places))
    return each.select("track_id", "shift", F.when(F.col("_k") == 0, F.col("beat_ms")).otherwise(F.col("beat_ms") + (F.col("_next") - F.col("beat_ms")) * F.col("_k") / parts).alias("beat_ms"))


def normalise(beats: DataFrame, low: float = MIN_BPM, high: float = MAX_BPM, majority: float = MAJORITY) -> DataFrame:
    return apply_shift(beats, choose_shift(beats, low, high, majority))


def grid_from_beats(beats: DataFrame, low: float = MIN_BPM, high: float = MAX_BPM, majority: float = MAJORITY) -> DataFrame:
    """A grid: normalised beats with their index and metrical_shift."""
    return indexed(normalise(beats, low, high, majority).withColumnRenamed("shift", "metrical_shift"))


def grid_from_stored(beats: DataFrame, shift: int = 0) -> DataFrame:
    return indexed(beats.select("track_id", "beat_ms", F.lit(shift).alias("metrical_shift")))


def with_offset(beats: DataFrame, ms: float) -> DataFrame:
    return beats.withColumn("beat_ms", F.col("beat_ms") + F.lit(ms))


def indexed_gaps(beats: DataFrame) -> DataFrame:
    """track_id, gap_idx, beat_ms (its start), gap_ms: the gap to the next beat."""
    return indexed(beats).withColumn("gap_ms", _gap_ahead()).filter("gap_ms IS NOT NULL").select("track_id", F.col("beat_idx").alias("gap_idx"), "beat_ms", "gap_ms")


def robust_gaps(beats: DataFrame) -> DataFrame:
    """robust_ms: gaps that are a whole multiple of their neighbours' median, or merely far from it, become that median."""
    w = Window.partitionBy("track_id").orderBy("gap_idx")
    around = F.concat(F.collect_list("gap_ms").over(w.rowsBetween(-8, -1)), F.collect_list("gap_ms").over(w.rowsBetween(1, 8)))
    rows = indexed_gaps(beats).withColumn("_around", around).withColumn("_local", N.upper_median(F.col("_around")))
    local, gap = F.col("_local"), F.col("gap_ms")
    multiple = F.greatest(F.lit(1.0), F.rint(gap / local))
    out = ((multiple >= 2) & (F.abs(gap - multiple * local) <= 0.25 * local)) | (F.abs(gap - local) > 0.25 * local)
    return rows.withColumn("robust_ms", F.when((F.size("_around") < 3) | (local <= 0), gap).when(out, local).otherwise(gap)).drop("_around", "_local")


def change_flags(gaps: DataFrame, window: int = 16, share: float = 0.06, value: str = "robust_ms") -> DataFrame:
    """changed: the median gap from here on differs from that before; both windows are clipped to the track."""
    w = Window.partitionBy("track_id").orderBy("gap_idx")
    near = N.upper_median(F.collect_list(value).over(w.rowsBetween(-window, window - 1)))
    far = N.upper_median(F.collect_list(value).over(w.rowsBetween(-2 * window - 1, -window - 1)))
    return gaps.withColumns({"near_ms": F.coalesce(near, F.lit(0.0)), "far_ms": F.coalesce(far, F.lit(0.0))}).withColumn("changed", (F.col("near_ms") > 0) & (F.col("far_ms") > 0) & (F.when(F.col("far_ms") > 0, F.abs(F.col("near_ms") - F.col("far_ms")) / F.col("far_ms")).otherwise(0.0) >= share))


def track_tempo(beats: DataFrame) -> DataFrame:
    """track_id, beats, median_gap_ms, mad_gap_ms, bpm: upper medians of gaps and of their distances from it."""
    per = intervals(beats, positive=True).groupBy("track_id").agg(F.collect_list("gap_ms").alias("g"))
    per = per.withColumn("median_gap_ms", N.upper_median(F.col("g")))
    return per.select("track_id", F.size("g").alias("gaps"), "median_gap_ms", N.upper_median(F.transform("g", lambda x: F.abs(x - F.col("median_gap_ms")))).alias("mad_gap_ms"), (60000 / F.col("median_gap_ms")).alias("bpm"))


def steadiness(beats: DataFrame) -> DataFrame:
    """track_id, steadiness_ms: upper median of the change from gap to gap."""
    rows = intervals(beats).withColumn("d", F.abs(F.col("gap_ms") - F.lag("gap_ms").over(_track()))).filter("d IS NOT NULL")
    return rows.groupBy("track_id").agg(N.median_of(F.col("d")).alias("steadiness_ms"))


def evenness(beats: DataFrame, half: int = 8) -> DataFrame:
    """track_id, evenness: share of gaps within a quarter of the upper median of the gaps [i - half, i + half)."""
    w = Window.partitionBy("track_id").orderBy("gap_idx").rowsBetween(-half, half - 1)
    rows = indexed_gaps(beats).withColumn("m", N.upper_median(F.collect_list("gap_ms").over(w)))
    return rows.groupBy("track_id").agg(F.avg(F.when(F.abs(F.col("gap_ms") - F.col("m")) <= 0.25 * F.col("m"), 1.0).otherwise(0.0)).alias("evenness"))


def octave_class(ratio: Column, tolerance: float = 0.10) -> Column:
    """Whole octaves of a tempo ratio; null if it is too far from one."""
    off = F.log2(ratio)
    return F.when(F.abs(off - F.rint(off)) <= tolerance, F.rint(off).cast("int"))
