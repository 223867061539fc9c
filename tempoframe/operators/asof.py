"""Point-in-time lookups and nearest-neighbour, tolerance and interval joins.

As-of and nearest lookups are a tagged union and one sort per key, never a range join: the cost is that of sorting both
sides once, whatever the density. Tolerance joins on large sides can take the same way (nearest within the tolerance).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _tagged(left: DataFrame, right: DataFrame, on: str, time: str, right_time: str, columns: list[str]) -> DataFrame:
    held = F.struct(F.col(right_time).alias("_time"), *[F.col(c) for c in columns])
    kind = right.select(held.alias("_r")).schema["_r"].dataType
    a = left.select(F.col(on).alias("_on"), F.col(time).alias("_at"), F.lit(1).alias("_side"), F.struct("*").alias("_l"), F.lit(None).cast(kind).alias("_r"))
    b = right.select(F.col(on).alias("_on"), F.col(right_time).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(left.schema).alias("_l"), held.alias("_r"))
    return a.unionByName(b)


def asof_join(left: DataFrame, right: DataFrame, columns: list[str], on: str = "track_id", time: str = "t_ms", right_time: str = "beat_ms", fallback: str | None = None) -> DataFrame:
    """All left rows with the columns of the last right row at or before their time (null where there is none).

    ``fallback="first"`` takes the key's first right row instead of null.
    """
    order = Window.partitionBy("_on").orderBy("_at", "_side")
    found = F.last("_r", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    if fallback == "first":
        found = F.coalesce(found, F.first("_r", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return _tagged(left, right, on, time, right_time, columns).withColumn("_f", found).filter("_side = 1").select("_l.*", *[F.col(f"_f.{c}").alias(c) for c in columns])


def nearest(left: DataFrame, right: DataFrame, on: str = "track_id", time: str = "t_ms", right_time: str = "beat_ms", name: str = "offset_ms") -> DataFrame:
    """Left rows with the signed distance to the nearest right row (left - right); the earlier one wins a tie."""
    # Looking ahead is looking back in the other order: a frame that runs to the end would be quadratic.
    past = Window.partitionBy("_on").rowsBetween(Window.unboundedPreceding, 0)
    both = _tagged(left, right, on, time, right_time, []).withColumns({
        "_before": F.last("_r._time", ignorenulls=True).over(past.orderBy("_at", "_side")),
        "_after": F.last("_r._time", ignorenulls=True).over(past.orderBy(F.desc("_at"), "_side")),
    })
    back, ahead = F.col("_at") - F.col("_before"), F.col("_at") - F.col("_after")
    best = F.when(F.col("_before").isNull(), ahead).when(F.col("_after").isNull(), back).when(back <= -ahead, back).otherwise(ahead)
    return both.filter("_side = 1").select("_l.*", best.alias(name))


def within(left: DataFrame, right: DataFrame, tolerance: float, anti: bool = False, **names) -> DataFrame:
    """Left rows with (``anti``: without) a right row at most ``tolerance`` away."""
    near = nearest(left, right, name="_offset", **names)
    hit = F.coalesce(F.abs("_offset") <= tolerance, F.lit(False))
    return near.filter(~hit if anti else hit).drop("_offset")


def containing_interval(points: DataFrame, intervals: DataFrame, columns: list[str], time: str = "t_ms", start: str = "start_ms", end: str = "end_ms", on: str = "track_id") -> DataFrame:
    """Points with the columns of the interval [start, end) around them; intervals of a key do not overlap."""
    kept = [c for c in columns if c != end]
    found = asof_join(points, intervals.withColumn("_end", F.col(end)), [*kept, "_end"], on, time, start)
    inside = F.col(time) < F.col("_end")
    out = found.select(*points.columns, *[F.when(inside, F.col(c)).alias(c) for c in kept], F.when(inside, F.col("_end")).alias("_end"))
    return out.withColumnRenamed("_end", end) if end in columns else out.drop("_end")


def overlapping(left: DataFrame, right: DataFrame, on: str = "track_id", start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Left intervals that some right interval overlaps."""
    r = right.select(F.col(on).alias("_on"), F.col(start).alias("_start"), F.col(end).alias("_end"))
    return left.join(r, (F.col(on) == F.col("_on")) & (F.col("_start") < F.col(end)) & (F.col("_end") > F.col(start)), "left_semi")


def ordered_merge(left: DataFrame, right: DataFrame, low: float, high: float, left_time: str, right_time: str, on: str = "track_id") -> DataFrame:
    """on, t_ms, side, position: both lists in [low, high) in one order, left first on equal times."""
    parts = [d.filter((F.col(t) >= low) & (F.col(t) < high)).select(on, F.col(t).alias("t_ms"), F.lit(s).alias("side")) for d, t, s in ((left, left_time, 0), (right, right_time, 1))]
    return parts[0].unionByName(parts[1]).withColumn("position", F.row_number().over(Window.partitionBy(on).orderBy("t_ms", "side")) - 1)


def positional_zip(left: DataFrame, right: DataFrame, left_value: str, right_value: str, on: str = "track_id") -> DataFrame:
    """on, position, difference: |left - right| by rank, of keys with as many rows on either side."""

    def ranked(d: DataFrame, value: str, name: str) -> DataFrame:
        w = Window.partitionBy(on)
        return d.select(on, F.col(value).alias(name), F.row_number().over(w.orderBy(value)).alias("position"), F.count(F.lit(1)).over(w).alias("n"))

    return ranked(left, left_value, "a").join(ranked(right, right_value, "b"), [on, "position", "n"]).select(on, (F.col("position") - 1).alias("position"), F.abs(F.col("a") - F.col("b")).alias("difference"))


def value_at_frame(points: DataFrame, frames: DataFrame, value: str, frame: Column, on: str = "track_id", default: float = 0.0) -> DataFrame:
    """Points with the value of their frame, ``default`` outside the track."""
    at = points.withColumn("_frame", frame.cast("int"))
    return at.join(frames.select(F.col(on).alias("_on"), F.col("frame").alias("_f"), F.col(value).alias("_v")), (F.col(on) == F.col("_on")) & (F.col("_frame") == F.col("_f")), "left").select(*points.columns, F.coalesce("_v", F.lit(default)).alias(value))
