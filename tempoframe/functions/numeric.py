"""Numeric conventions as Column expressions.

Medians are *upper* medians (the element at n / 2 of the sorted values, never an average) unless a function says
otherwise; percentiles are the element at int(n * p). Both work on arrays, so that they serve aggregates
(``collect_list``) and row frames alike, stay exact and never interpolate.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def upper_median(values: Column) -> Column:
    """Element n / 2 of the sorted array; null for an empty one."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def true_median(values: Column) -> Column:
    """Mean of the two middle elements for an even count."""
    ordered, n = F.array_sort(values), F.size(values)
    return (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2


def percentile_at(values: Column, p: float) -> Column:
    """Element int(n * p) of the sorted array, the last one at most."""
    n = F.size(values)
    return F.get(F.array_sort(values), F.least(n - 1, F.floor(n * F.lit(p)).cast("int")))


def median_of(column: Column) -> Column:
    """Upper median as an aggregate."""
    return upper_median(F.collect_list(column))


def mean_in_order(value: Column, order: Column) -> Column:
    """Mean as an aggregate, summed in an order, so that it does not depend on how rows were dealt; null without values."""
    values = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("at"), value.alias("x")))))
    return F.aggregate(values, F.lit(0.0), lambda a, e: a + e["x"]) / F.nullif(F.count(value), F.lit(0))


def half_even(x: Column) -> Column:
    return F.rint(x)


def half_away(x: Column) -> Column:
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


def truncated(x: Column) -> Column:
    """Toward zero, as an int."""
    return F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("int")


def clamped(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low) if not isinstance(low, Column) else low, F.least(F.lit(high) if not isinstance(high, Column) else high, x))


def in_range(x: Column, low, high) -> Column:
    """Half-open: low <= x < high."""
    return (x >= low) & (x < high)


def wrapped(x: Column, period) -> Column:
    """x modulo period around zero, with the sign rule of a truncating remainder."""
    return (x + 1.5 * period) % period - 0.5 * period


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def frame_time(frame: Column, fps: float = 50.0) -> Column:
    """Milliseconds of a frame."""
    return frame * F.lit(1000.0) / F.lit(fps)


def nearest_frame(ms: Column, length: Column, fps: float = 50.0) -> Column:
    """Frame nearest to a time, half away from zero, within the track."""
    return F.greatest(F.lit(0), F.least(length - 1, half_away(ms * fps / 1000).cast("int")))


def frame_count(samples: Column, hop: int = 441) -> Column:
    """Frames of a padded front end: 1 + n / hop, 0 without samples."""
    return F.when(samples > 0, 1 + F.floor(samples / hop)).otherwise(0).cast("int")


def complete_frame_count(samples: Column, window: int = 1024, hop: int = 441) -> Column:
    """Frames that need no sample beyond the end."""
    half = window // 2
    return F.when(samples < half, 0).otherwise(F.floor((samples - window + half) / hop) + 1).cast("int")


def shift_for(bpm: Column, low: float = 80.0, high: float = 220.0, most: int = 4) -> Column:
    """The smallest number of octaves that brings a tempo into range, halving tried first; 0 if none does."""
    out = F.when((bpm <= 0) | in_range(bpm, low, high), 0)
    for k in range(1, most + 1):
        out = out.when(in_range(bpm / 2**k, low, high), k).when(in_range(bpm * 2**k, low, high), -k)
    return out.otherwise(0)
