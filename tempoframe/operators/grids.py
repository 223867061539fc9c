"""Grids from timing points, and comparisons of beats with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempoframe.functions import numeric as N
from tempoframe.sources.folders import written


def _points():
    return Window.partitionBy("track_id").orderBy("time_ms")



def grid(timing: DataFrame, tail_ms: float = 60_000.0, scale: Column | float = 1.0, until: Column | None = None, shortest_ms: float = 0.0, most: int = 500_000, by: tuple[str, ...] = ("track_id",), keep_length: bool = False) -> DataFrame:
    """``by``, beat_ms: time, time + length, ... before the next timing point; the last one goes on for ``tail_ms`` or to ``until``.

    ``most`` bounds the beats of one point: a point that needs more is an error, not a cut. ``keep_length`` adds length_ms.
    """
    length = F.col("beat_length_ms") * scale
    end = F.greatest(until, F.col("time_ms")) if until is not None else F.col("time_ms") + tail_ms
    points = Window.partitionBy(*by).orderBy("time_ms")
    rows = timing.withColumns({"_stop": F.coalesce(F.lead("time_ms").over(points), end), "_len": length}).filter(F.col("_len") > shortest_ms)
    steps = F.ceil((F.col("_stop") - F.col("time_ms")) / F.col("_len")).cast("int")
    steps = F.when(steps > most, F.raise_error(F.lit("too many beats after one timing point")).cast("int")).otherwise(F.greatest(steps, F.lit(0)))
    each = rows.withColumn("_k", F.explode(F.sequence(F.lit(0), steps)))
    out = each.withColumn("beat_ms", F.col("time_ms") + F.col("_k") * F.col("_len")).filter("beat_ms < _stop")
    return out.select(*by, "beat_ms", *([F.col("_len").alias("length_ms")] if keep_length else []))


def weighted_mode(timing: DataFrame) -> DataFrame:
    """track_id, length_ms, held_ms: the rounded beat length that holds longest, the smaller of equals; the last point weighs nothing."""
    rows = timing.select("track_id", F.rint("beat_length_ms").alias("length_ms"), (F.lead("time_ms").over(_points()) - F.col("time_ms")).alias("w"))
    per = rows.groupBy("track_id", "length_ms").agg(F.round(F.sum(F.coalesce("w", F.lit(0.0))), 6).alias("held_ms"))
    best = F.row_number().over(Window.partitionBy("track_id").orderBy(F.desc("held_ms"), "length_ms"))
    return per.withColumn("_r", best).filter("_r = 1").drop("_r")


def sections(timing: DataFrame) -> DataFrame:
    """track_id, start_ms, end_ms, period_ms between neighbouring timing points; the last point has no end and is left out."""
    return timing.select("track_id", F.col("time_ms").alias("start_ms"), F.lead("time_ms").over(_points()).alias("end_ms"), F.col("beat_length_ms").alias("period_ms")).filter("end_ms IS NOT NULL")


def labels(grid_beats: DataFrame, per_bar: int = 4, fps: int = 50) -> DataFrame:
    """track_id, frame, label: 2 on each ``per_bar``-th written beat, 1 on the others; the first beat of a frame writes it."""
    rows = grid_beats.withColumn("frame", F.rint(F.col("beat_ms") * fps / 1000).cast("int"))
    written = rows.groupBy("track_id", "frame").agg(F.min("beat_ms").alias("beat_ms"))
    place = F.row_number().over(Window.partitionBy("track_id").orderBy("beat_ms")) - 1
    return written.select("track_id", "frame", F.when(place % per_bar == 0, 2).otherwise(1).alias("label"))


def percentiles(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """n, p10, p25, p50, p75, p90, top: truncating percentiles by key."""
    per = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("_v"))
    at = {f"p{int(p * 100)}": N.percentile_at(F.col("_v"), p) for p in (0.1, 0.25, 0.5, 0.75, 0.9)}
    return per.select(*keys, F.size("_v").alias("n"), *[c.alias(k) for k, c in at.items()], F.array_max("_v").alias("top"))


def histogram(rows: DataFrame, value: Column, width: float, *keys: str) -> DataFrame:
    """bucket, n: values rounded half to even to multiples of ``width``."""
    return rows.groupBy(*keys, (F.rint(value / width) * width).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def modes(rows: DataFrame, bucket: str, k: int, *keys: str) -> DataFrame:
    """The k most frequent buckets of each key, the smaller of equals first."""
    counts = rows.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("n"))
    if not keys:  # each task passes on its first k
        counts = counts.orderBy(F.desc("n"), bucket).limit(k)
    order = Window.partitionBy(*(keys or [F.lit(1)])).orderBy(F.desc("n"), bucket)
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def ranks(rows: DataFrame, key: str, value: str, name: str = "place") -> DataFrame:
    """``rows`` with the rank of their value among all of the same key: 1 and how many are smaller.

    Different values are dealt by ranges and counted in each; no task holds a key's rows, however few keys there are.
    """
    counts = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    placed = written(counts.repartitionByRange(key, value).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy(key, "_part").agg(F.sum("_n").alias("_all"))  # a row for each key and range
    before = sizes.select(key, "_part", F.coalesce(F.sum("_all").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.coalesce(F.sum("_n").over(Window.partitionBy("_part", key).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    of = placed.withColumn("_own", own).join(before, [key, "_part"]).select(key, value, (F.col("_before") + F.col("_own") + 1).alias(name))
    return rows.join(of, [key, value])


def numbered(rows: DataFrame, key: str, *order: str, name: str = "frame") -> DataFrame:
    """``rows`` with their number among all of the same key, from 0, in ``order`` (nulls last), and ``total``, how many these are. Rows without a key are left out.

    Rows are dealt by ranges and numbered in each; no task holds a key's rows, however few keys there are.
    """
    ordered = [F.col(c).asc_nulls_last() for c in order]
    placed = written(rows.filter(F.col(key).isNotNull()).repartitionByRange(F.col(key), *ordered).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_all"))  # a row for each key and range
    of = Window.partitionBy(key)
    before = F.coalesce(F.sum("_all").over(of.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(key, "_part", before.alias("_before"), F.sum("_all").over(of).alias("total"))
    own = F.row_number().over(Window.partitionBy("_part", key).orderBy(*ordered)) - 1
    return placed.withColumn("_own", own).join(F.broadcast(sizes), [key, "_part"]).withColumn(name, F.col("_before") + F.col("_own")).drop("_part", "_own", "_before")


def downsampled(curve: DataFrame, period: str, confidence: str, frames: int = 5, fps: int = 50) -> DataFrame:
    """track_id, time_ms, bpm, confidence: means over runs of frames."""
    per = curve.groupBy("track_id", F.floor(F.col("frame") / frames).cast("int").alias("_b")).agg(F.avg(period).alias("_p"), F.avg(confidence).alias("confidence"))
    return per.select("track_id", (F.col("_b") * F.lit(frames * 1000.0 / fps)).alias("time_ms"), (60.0 * fps / F.when(F.col("_p") > 0, F.col("_p"))).alias("bpm"), "confidence")


def decile_profile(activation: DataFrame) -> DataFrame:
    """track_id, tenth, positive, top: frames from t * n div 10 to (t + 1) * n div 10."""
    n = F.count(F.lit(1)).over(Window.partitionBy("track_id"))
    tenth = F.floor(((F.col("frame") + 1) * 10 - 1) / F.col("_n")).cast("int")
    return activation.withColumn("_n", n).groupBy("track_id", tenth.alias("tenth")).agg(F.count_if(F.col("x") > 0).alias("positive"), F.max("x").alias("top"), F.count(F.lit(1)).alias("frames"))


def rolling_line(beats: DataFrame, half: int) -> DataFrame:
    """slope, level: least squares of beat time over index, evaluated at each beat, over ``half`` beats to either side."""
    track = Window.partitionBy("track_id").orderBy("beat_ms")
    rows = beats.withColumn("i", (F.row_number().over(track) - 1).cast("double"))
    w = track.rowsBetween(-half, half)
    return rows.withColumns({"slope": F.regr_slope("beat_ms", "i").over(w), "level": F.regr_intercept("beat_ms", "i").over(w) + F.regr_slope("beat_ms", "i").over(w) * F.col("i")})


def prediction_errors(beats: DataFrame, back: int = 12) -> DataFrame:
    """line_error, gap_error: the next beat from a line through the last ``back`` beats, and from the last gap alone."""
    track = Window.partitionBy("track_id").orderBy("beat_ms")
    rows = beats.withColumn("i", (F.row_number().over(track) - 1).cast("double"))
    w = track.rowsBetween(-back, -1)
    told = F.regr_intercept("beat_ms", "i").over(w) + F.regr_slope("beat_ms", "i").over(w) * F.col("i")
    last = 2 * F.lag("beat_ms", 1).over(track) - F.lag("beat_ms", 2).over(track)
    out = rows.withColumns({"_n": F.count(F.lit(1)).over(w), "_told": told, "_last": last}).filter(F.col("_n") == back)
    return out.select("track_id", "beat_ms", F.abs(F.col("beat_ms") - F.col("_told")).alias("line_error"), F.abs(F.col("beat_ms") - F.col("_last")).alias("gap_error"))


#: Frames of a track that are summed in one place; neighbouring slices share what lags reach.
SLICE_FRAMES = 16_384


def lag_sums(curves: DataFrame, lags, first: str = "x", second: str = "x", slice_frames: int = SLICE_FRAMES) -> DataFrame:
    """track_id, lag, n, a, b, aa, bb, ab: numbers and sums of the pairs of ``first`` at a frame and ``second`` so many frames later (earlier below zero).

    Frames of a track follow each other without gaps. A slice of it and what lags reach beyond is sorted once and looked at by ``lead`` and ``lag``; sums of slices add up.
    """
    lags = [int(k) for k in lags]
    most = max((abs(k) for k in lags), default=0)
    if slice_frames <= 2 * most:
        raise ValueError("slices have to be longer than lags reach")
    own = lambda shift: F.floor((F.col("frame") + shift) / slice_frames)
    near = F.filter(F.array_distinct(F.array(own(-most), own(0), own(most))), lambda k: k >= 0)
    rows = curves.select("track_id", F.col("frame").cast("long").alias("frame"), F.col(first).cast("double").alias("a"), F.col(second).cast("double").alias("b")).withColumn("slice", F.explode(near))
    w = Window.partitionBy("track_id", "slice").orderBy("frame")
    pairs = F.array(*(F.struct(F.lit(k).alias("lag"), (F.col("b") if k == 0 else F.lead("b", k).over(w) if k > 0 else F.lag("b", -k).over(w)).alias("b")) for k in lags))
    each = rows.withColumn("pairs", pairs).filter(F.col("slice") == own(0)).select("track_id", "a", F.explode("pairs").alias("p")).select("track_id", "a", "p.*").filter("a IS NOT NULL AND b IS NOT NULL")
    a, b = F.col("a"), F.col("b")
    return each.groupBy("track_id", "lag").agg(F.count(F.lit(1)).alias("n"), F.sum(a).alias("a"), F.sum(b).alias("b"), F.sum(a * a).alias("aa"), F.sum(b * b).alias("bb"), F.sum(a * b).alias("ab"))


def autocorrelation(curve: DataFrame, lags, value: str = "x", slice_frames: int = SLICE_FRAMES) -> DataFrame:
    """track_id, lag, r: covariance of the whole curve, about its mean, with itself shifted, over the variance of the unshifted side."""
    mean = curve.groupBy("track_id").agg(F.avg(F.col(value).cast("double")).alias("m"))
    n, m = F.col("n"), F.col("m")
    cov, var = F.col("ab") - m * (F.col("a") + F.col("b")) + n * m * m, F.col("aa") - 2 * m * F.col("a") + n * m * m
    return lag_sums(curve, lags, value, value, slice_frames).join(mean, "track_id").select("track_id", "lag", F.when(var > 1e-9, cov / var).otherwise(0.0).alias("r"))


def cross_correlation(curves: DataFrame, lags, first: str = "a", second: str = "b", least: int = 100, slice_frames: int = SLICE_FRAMES) -> DataFrame:
    """track_id, lag, n, r: correlation of one curve with another so many frames later; 0 where either is flat, minus infinity where fewer than ``least`` frames overlap."""
    n, spread = F.col("n"), lambda xx, x: F.greatest(xx - x * x / F.col("n"), F.lit(0.0))
    under = F.sqrt(spread(F.col("aa"), F.col("a")) * spread(F.col("bb"), F.col("b")))
    r = F.when(n < least, F.lit(float("-inf"))).when(under < 1e-9, 0.0).otherwise((F.col("ab") - F.col("a") * F.col("b") / n) / under)
    return lag_sums(curves, lags, first, second, slice_frames).select("track_id", "lag", "n", r.alias("r"))


def local_autocorrelation(curve: DataFrame, points: DataFrame, lags, half: int = 50, value: str = "x") -> DataFrame:
    """points (track_id, centre frame, further columns) with lag, r: as ``autocorrelation``, over the frames around each centre, about their mean; 0 where they are fewer than four lags.

    The frames around are a list of bounded length for each centre; nothing else of a track is needed.
    """
    lags = [int(k) for k in lags]
    w = Window.partitionBy("track_id").orderBy("frame")
    around = F.collect_list("x").over(w.rowsBetween(-half, half + max(lags)))
    rows = curve.select("track_id", F.col("frame").cast("long").alias("frame"), F.col(value).cast("double").alias("x"), F.count(F.lit(1)).over(Window.partitionBy("track_id")).alias("_n")).withColumn("_near", around)
    asked = points.withColumnRenamed("track_id", "_t").withColumn("_c", F.col("centre").cast("long"))
    each = rows.join(asked, (F.col("track_id") == F.col("_t")) & (F.col("frame") == F.col("_c"))).drop("_t", "_c", "x")
    each = each.withColumn("lag", F.explode(F.array(*map(F.lit, lags))))
    size = F.least(F.col("frame") + half, F.col("_n") - 1 - F.col("lag")) - F.greatest(F.col("frame") - half, F.lit(0))
    each = each.withColumn("_m", F.when(size >= 4 * F.col("lag"), size).cast("int"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    each = each.withColumns({"_a": F.slice("_near", F.lit(1), F.col("_m")), "_b": F.slice("_near", F.col("lag") + 1, F.col("_m"))})
    mean = total("_a") / F.col("_m")
    each = each.withColumn("_mean", mean)
    cov = total(F.zip_with("_a", "_b", lambda a, b: (a - F.col("_mean")) * (b - F.col("_mean"))))
    var = total(F.transform("_a", lambda a: (a - F.col("_mean")) * (a - F.col("_mean"))))
    return each.withColumns({"_cov": cov, "_var": var}).select(*points.columns, "lag", F.when(F.col("_var") > 0, F.col("_cov") / F.col("_var")).otherwise(0.0).alias("r"))


def nearest_high_peak(correlation: DataFrame, keys: list[str], low: int, high: int, share: float = 0.75, expected: str = "expected") -> DataFrame:
    """``keys`` (track_id, centre, ``expected`` in frames among them) with lag, r: of the peaks over lag not below ``share`` of the highest the one nearest to what is expected; 0, 0.0 without any.

    ``correlation``: r of each lag from ``low`` - 1 to ``high`` + 1.
    """
    whole = Window.partitionBy("track_id", "centre")
    own = whole.orderBy("lag")
    top = (F.col("r") > 0) & (F.col("r") >= F.lag("r").over(own)) & (F.col("r") >= F.lead("r").over(own))
    rows = correlation.withColumn("_top", F.coalesce(top & F.col("lag").between(low, high), F.lit(False)))
    rows = rows.withColumn("_best", F.max(F.when(F.col("_top"), F.col("r"))).over(whole))
    far = F.when(F.col(expected) > 0, F.abs(F.col("lag") - F.col(expected))).otherwise(0.0)
    fair = F.when(F.col("_top") & (F.col("r") >= share * F.col("_best")), F.struct(far.alias("far"), "lag", "r"))
    found = rows.groupBy(*keys).agg(F.min(fair).alias("f"))
    return found.select(*keys, F.coalesce("f.lag", F.lit(0)).alias("lag"), F.coalesce("f.r", F.lit(0.0)).alias("r"))


def envelope_periods(curve: DataFrame, points: DataFrame, low: int = 10, high: int = 50, half: int = 50) -> DataFrame:
    """points (track_id, centre, expected in frames) with lag, r: the period of a curve around each centre, by its local autocorrelation."""
    return nearest_high_peak(local_autocorrelation(curve, points, range(low - 1, high + 2), half), points.columns, low, high)


def periodicity_peaks(correlation: DataFrame, k: int = 3) -> DataFrame:
    """The k highest local maxima over lag of each track."""
    w = Window.partitionBy("track_id").orderBy("lag")
    rows = correlation.withColumns({"_b": F.lag("r").over(w), "_a": F.lead("r").over(w)}).filter("r > _b AND r >= _a")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("track_id").orderBy(F.desc("r"), "lag"))).filter(F.col("rank") <= k).select("track_id", "lag", "r", "rank")


def best_lag(points: DataFrame, curve: DataFrame, most: int = 8, fps: int = 50, value: str = "x") -> DataFrame:
    """track_id, lag, score: the shift of -most..most frames at which the grid's frames carry most above the mean, to a millionth; the first of equals."""
    x = F.col(value).cast("double")
    asked = points.select("track_id", F.rint(F.col("beat_ms") * fps / 1000).cast("long").alias("frame"), F.lit(True).alias("asked"), F.lit(None).cast("double").alias("c"))
    above = curve.select("track_id", F.col("frame").cast("long").alias("frame"), F.lit(False).alias("asked"), (x - F.avg(x).over(Window.partitionBy("track_id"))).alias("c"))
    both = asked.unionByName(above).filter("track_id IS NOT NULL AND frame IS NOT NULL")
    # A frame at each lag is looked up in one sort of both; nothing is expanded or joined.
    at = Window.partitionBy("track_id").orderBy("frame")
    lags = range(-most, most + 1)
    found = both.select("track_id", "asked", *(F.sum("c").over(at.rangeBetween(k, k)).alias(f"c{k + most}") for k in lags)).filter("asked")
    per = found.groupBy("track_id").agg(F.array(*(F.struct(F.round(F.sum(f"c{k + most}"), 6).alias("score"), F.lit(-k).alias("m")) for k in lags)).alias("all"))
    best = per.select("track_id", F.array_max(F.filter("all", lambda e: e["score"].isNotNull())).alias("b")).filter("b IS NOT NULL")
    return best.select("track_id", (-F.col("b.m")).alias("lag"), F.col("b.score").alias("score"))


def comb_scan(strength: DataFrame, periods, value: str = "x") -> DataFrame:
    """track_id, period, phase, score: mean of the strengths within a frame of a comb's teeth, the best phase of each period.

    Every frame belongs to one phase of each period, so that the scan is one grouping, not a join.
    """
    w = Window.partitionBy("track_id").orderBy("frame").rowsBetween(-1, 1)
    near = strength.withColumn("_s", F.max(value).over(w))
    each = near.select("track_id", "frame", "_s", F.explode(F.array(*[F.lit(p) for p in periods])).alias("period"))
    per = each.groupBy("track_id", "period", (F.col("frame") % F.col("period")).alias("phase")).agg(F.round(F.avg("_s"), 6).alias("score"))
    return per.withColumn("_r", F.row_number().over(Window.partitionBy("track_id", "period").orderBy(F.desc("score"), "phase"))).filter("_r = 1").drop("_r")
