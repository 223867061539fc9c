"""Order-dependent steps, one track at a time, as NumPy kernels behind ``mapInArrow``.

Each kernel is a function of arrays (testable by itself); ``per_track`` runs one over the rows of each track. A track is
the unit of parallelism: its rows fit a task, the number of tracks is unbounded, and short tracks share a batch.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Arrays = dict[str, np.ndarray]


def per_group(rows: DataFrame, keys: tuple[str, ...], kernel: Callable[[Arrays], Arrays], schema: str, order: str, union: bool = False) -> DataFrame:
    """``kernel`` gets the columns of each group's rows in ``order`` (lists as rows of an array) and returns new ones; one exchange.

    ``schema``: the keys, then the kernel's columns. ``union``: rows are a union. Spark takes one of relations that were dealt by the keys
    for dealt and leaves the exchange out, although their partitions may have been coalesced apart; a hash of the keys keeps it.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = to_arrow_schema(StructType.fromDDL(schema)).types
    dealt = rows.repartition(*([F.xxhash64(*keys)] if union else keys)).sortWithinPartitions(*keys, order)

    def values(column: pa.ChunkedArray) -> np.ndarray:
        if pa.types.is_list(column.type):
            column = column.combine_chunks()
            return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
        return column.to_numpy()

    def edges(table: pa.Table) -> np.ndarray:
        """Where groups begin."""
        fresh = np.zeros(len(table), bool)
        fresh[:1] = True
        for k in keys:
            c = table.column(k)
            same = pc.or_kleene(pc.equal(c.slice(1), c.slice(0, len(c) - 1)), pc.and_(pc.is_null(c.slice(1)), pc.is_null(c.slice(0, len(c) - 1))))
            fresh[1:] |= ~pc.fill_null(same, False).to_numpy()
        return np.flatnonzero(fresh)

    def solve(table: pa.Table) -> pa.RecordBatch:
        first = edges(table)
        columns = {c: values(table.column(c)) for c in table.column_names}
        found = [kernel({c: v[i:j] for c, v in columns.items()}) for i, j in zip(first, [*first[1:], len(table)], strict=True)]
        sizes = [len(f[names[-1]]) for f in found]
        own = pa.array(np.repeat(first, sizes))
        new = [pa.array(np.concatenate([np.asarray(f[c]) for f in found])).cast(kind) for c, kind in zip(names[len(keys) :], kinds[len(keys) :], strict=True)]
        held = [table.column(k).combine_chunks().take(own).cast(kind) for k, kind in zip(keys, kinds, strict=False)]
        return pa.RecordBatch.from_arrays([*held, *new], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # the rows of the last group so far
        for b in batches:
            if not b.num_rows:
                continue
            table = pa.Table.from_batches([b])
            first = edges(pa.concat_tables([held[-1].slice(len(held[-1]) - 1), table])) - 1 if held else edges(table)
            first = first[first >= 0]
            if not len(first):  # all of one group, which has begun before
                held.append(table)
                continue
            done = [*held, table.slice(0, int(first[-1]))]
            if sum(map(len, done)):
                yield solve(pa.concat_tables(done))
            held = [table.slice(int(first[-1]))]
        if held:
            yield solve(pa.concat_tables(held))

    return dealt.mapInArrow(run, schema)


def per_track(rows: DataFrame, kernel: Callable[[Arrays], Arrays], schema: str, order: str, union: bool = False) -> DataFrame:
    """``per_group`` by track_id, which ``schema`` leaves out."""
    return per_group(rows, ("track_id",), kernel, f"track_id long, {schema}", order, union)


def frame_of(place: float, length: int) -> int:
    """Nearest frame, half away from zero, within the track."""
    return min(max(int(math.copysign(math.floor(abs(place) + 0.5), place)), 0), length - 1)


def cluster_period(gaps: np.ndarray) -> float:
    """Upper median of the largest set of gaps within a quarter of one of them; larger candidates win ties; few gaps give their own median."""
    ordered = np.sort(gaps)
    if len(gaps) < 3:
        return float(ordered[len(gaps) // 2]) if len(gaps) else 0.0
    low = np.searchsorted(ordered, gaps * 0.75, "left")
    size = np.searchsorted(ordered, gaps * 1.25, "right") - low
    most, best = size.max(), 0.0
    if most > 0:
        for k in np.flatnonzero(size == most).tolist():
            if best == 0.0 or gaps[k] > best:
                best = float(ordered[low[k] + most // 2])
    return best


def local_period(places: np.ndarray, keep: np.ndarray, i: int, window: int = 32) -> float:
    low, high = max(0, i - window), min(len(places) - 1, i + window)
    both = keep[low:high] & keep[low + 1 : high + 1]
    return cluster_period(np.diff(places[low : high + 1])[both])


def frame_peaks(curve: np.ndarray, radius: int = 3) -> np.ndarray:
    padded = np.pad(curve, radius, constant_values=-np.inf)
    top = np.max([padded[k : k + len(curve)] for k in range(2 * radius + 1)], axis=0) if len(curve) else curve
    return np.flatnonzero((curve > 0) & (curve >= top))


def raw_peaks(curve: np.ndarray, radius: int = 3) -> np.ndarray:
    """Peaks paired within runs of consecutive frames; single ones moved to the vertex of their parabola."""
    curve = np.asarray(curve, float)
    peaks = frame_peaks(curve, radius)
    if not len(peaks):
        return np.zeros(0)
    at = np.arange(len(peaks))
    begins = np.append(True, np.diff(peaks) != 1)
    in_run = at - np.maximum.accumulate(np.where(begins, at, 0))
    paired = np.append(~begins[1:], False)  # the next peak is of the same run
    first = in_run % 2 == 0
    f, paired = peaks[first], paired[first]
    near = curve[np.clip(f[:, None] + np.arange(-1, 2), 0, len(curve) - 1)]
    before, after = near[:, 0], near[:, 2]
    bend = before - 2 * near[:, 1] + after
    usable = (f > 0) & (f < len(curve) - 1) & (np.abs(bend) >= 1e-9)
    move = np.where(usable, np.clip(0.5 * (before - after) / np.where(usable, bend, 1.0), -0.5, 0.5), 0.0)
    return f + np.where(paired, 0.5, move)


def beat_frames(curve: np.ndarray, radius: int = 3, ratio: float = 0.7) -> np.ndarray:
    """Pruned peaks of a whole curve."""
    places = raw_peaks(np.asarray(curve, float), radius)
    return places[prune(places, curve, ratio)] if len(places) else places


def values_at(places: np.ndarray, curve: np.ndarray) -> np.ndarray:
    """The curve at the frame nearest to each place."""
    nearest = np.copysign(np.floor(np.abs(places) + 0.5), places).astype(int)
    return np.asarray(curve, float)[np.clip(nearest, 0, len(curve) - 1)] if len(places) else np.zeros(0)


def prune(places: np.ndarray, curve: np.ndarray, ratio: float = 0.7, passes: int = 8) -> np.ndarray:
    """Which peaks of a curve stay; see ``prune_by``."""
    return prune_by(places, values_at(places, curve), ratio, passes)


def prune_by(places: np.ndarray, values: np.ndarray, ratio: float = 0.7, passes: int = 8) -> np.ndarray:
    """Keeps, of two peaks much closer than the period around them, the one with the higher value; the first wins a tie."""
    keep = np.ones(len(places), bool)
    if len(places) < 3:
        return keep
    # A pair that stayed is looked at again only after something left the periods around it.
    fresh = np.ones(len(places), bool)
    for _ in range(passes):
        before = keep.copy()
        for i in range(len(places) - 1):
            if not fresh[i]:
                continue
            fresh[i] = False
            if keep[i] and keep[i + 1] and (period := local_period(places, keep, i)) > 0 and (places[i + 1] - places[i]) / period < ratio:
                gone = i + 1 if values[i] >= values[i + 1] else i
                keep[gone] = False
                fresh[max(0, gone - 33) : gone + 34] = True
        if (keep == before).all():
            break
    return keep


def suppress(strength: np.ndarray, periods: np.ndarray, share: float = 0.6, threshold: float = 0.5) -> np.ndarray:
    """Frames chosen strongest first (earlier on ties), each silencing those nearer than its share of the period."""
    order = np.argsort(-strength, kind="stable")
    free, chosen = np.ones(len(strength), bool), []
    for i in order[strength[order] >= threshold]:
        if free[i]:
            chosen.append(int(i))
            r = int(max(1.0, share * float(periods[i])))
            free[max(0, i - r + 1) : i + r] = False
    return np.array(sorted(chosen), int)


def modal_periods(beats: np.ndarray, window: int = 16) -> np.ndarray:
    """At each beat the gap that most gaps around agree with, the smallest of equals; 0 below three gaps."""
    n = len(beats)
    out, edge = np.zeros(n), np.full(window, np.nan)
    padded = np.concatenate((edge, np.diff(beats), edge, edge))
    for at in range(0, n, 256):
        near = np.sort(np.lib.stride_tricks.sliding_window_view(padded[at : at + 256 + 2 * window], 2 * window)[: min(256, n - at)], axis=1)  # what is not there comes last
        votes = ((near[:, None, :] >= near[:, :, None] * 0.75) & (near[:, None, :] <= near[:, :, None] * 1.25)).sum(2)
        best = near[np.arange(len(near)), np.argmax(votes, axis=1)]
        out[at : at + 256] = np.where((~np.isnan(near)).sum(1) >= 3, best, 0.0)
    return out


def dominant_period(beats: np.ndarray, periods: np.ndarray) -> float:
    """The period that accounts for most time (to a millionth), the first of equals; sorted periods and prefix sums."""
    gaps, own = np.diff(beats), periods[:-1]
    if not len(gaps):
        return 0.0
    order = np.argsort(own, kind="stable")
    upto = np.concatenate(([0.0], np.cumsum(gaps[order])))
    low, high = np.searchsorted(own[order], own * 0.75, "left"), np.searchsorted(own[order], own * 1.25, "right")
    weight = np.where(own > 0, np.round(upto[high] - upto[low], 6), 0.0)
    return float(own[int(np.argmax(weight))]) if weight.max() > 0 else 0.0


def regularised(beats: np.ndarray) -> np.ndarray:
    """Drops beats that come early, fills gaps of a few periods evenly, and leaves longer breaks."""
    if len(beats) < 4:
        return np.array(beats, float)
    periods = modal_periods(beats)
    dominant = dominant_period(beats, periods)
    out, anchor = [float(beats[0])], float(beats[0])
    for beat, p in zip(beats[1:].tolist(), periods[1:].tolist(), strict=True):
        if p > 0:
            for _ in range(8 if dominant > 0 else 0):
                if p / dominant >= 1.5:
                    p /= 2
                elif p / dominant <= 0.59:
                    p *= 2
                else:
                    break
            gap = beat - anchor
            if gap / p < 0.85:
                continue
            if 1.45 < gap / p <= 5.0:
                parts = round(gap / p)
                out += [anchor + k * (gap / parts) for k in range(1, parts)]
        out.append(beat)
        anchor = beat
    return np.array(out)


def _upper(values: np.ndarray) -> float:
    return float(np.sort(values)[len(values) // 2]) if len(values) else 0.0


def robust(gaps: np.ndarray) -> np.ndarray:
    out = np.array(gaps, float)
    for i, gap in enumerate(gaps):
        near = np.concatenate((gaps[max(0, i - 8) : i], gaps[i + 1 : i + 9]))
        local = _upper(near)
        if len(near) >= 3 and local > 0:
            times = max(1, round(gap / local))
            if abs(gap - local) > 0.25 * local or (times >= 2 and abs(gap - times * local) <= 0.25 * local):
                out[i] = local
    return out


def flags_of_change(gaps: np.ndarray, window: int = 16, share: float = 0.06) -> np.ndarray:
    near = np.array([_upper(gaps[max(0, i - window) : i + window]) for i in range(len(gaps))])
    far = np.array([_upper(gaps[max(0, i - 2 * window - 1) : max(0, i - window)]) for i in range(len(gaps))])
    with np.errstate(divide="ignore", invalid="ignore"):
        return (near > 0) & (far > 0) & (np.abs(near - far) / far >= share)


def boundaries(changed: np.ndarray, persistence: int = 20, shortest: int = 16) -> list[int]:
    """Where sections begin: at the first gap of a lasting run of changes, looked for anew from each such place.

    ``changed`` does not depend on the section, only which of it is far enough from the start does.
    """
    starts, n = [0], len(changed)
    while True:
        begin, runs = starts[-1], []
        for i in (np.flatnonzero(changed[begin + shortest :]) + begin + shortest).tolist():
            if runs and i - runs[-1][1] <= 2:
                runs[-1][1] = i
            else:
                runs.append([i, i])
        found = next((a for a, b in runs if b - a + 1 >= persistence and a - begin >= shortest), n)
        if found >= n:
            return starts
        starts.append(found)


def tempo_sections(beats: np.ndarray, window: int = 16, share: float = 0.06, persistence: int = 20, shortest: int = 16) -> list[tuple[float, float, float]]:
    """(start_ms, end_ms, period_ms), end to end."""
    if len(beats) < 3 or window < 1 or persistence < 1:
        return []
    gaps = robust(np.diff(beats))
    starts = boundaries(flags_of_change(gaps, window, share), persistence, shortest)
    return [(float(beats[a]), float(beats[min(len(beats) - 1, b)]), _upper(gaps[a:b])) for a, b in zip(starts, [*starts[1:], len(gaps)], strict=True)]


def even_beats(beats: np.ndarray) -> np.ndarray | None:
    """Beats laid evenly over each section from its first beat; None where there are too few."""
    if len(beats) < 8:
        return None
    out: list[float] = []
    for start, end, period in tempo_sections(beats):
        first = np.flatnonzero(beats >= start - 0.5)
        if period <= 0 or not len(first):
            continue
        at = float(beats[first[0]])
        while at < end:
            if (not out or at > out[-1] + period * 0.5) and at >= beats[0] - period * 0.5:
                out.append(at)
            at += period
    return np.array(out) if len(out) >= 4 else None


def bpm_around(beats: np.ndarray, centre: int, window: int = 6, span_ms: float = 2000.0, wide: int = 8) -> float:
    """Tempo around a beat: the true median of near gaps if they agree or move steadily, else that of a wider range."""
    last = len(beats) - 1
    if last < 1:
        return 0.0
    low, high = max(0, centre - window), min(last, centre + window)
    while beats[high] - beats[low] < span_ms and (low > 0 or high < last):
        low, high = max(0, low - 1), min(last, high + 1)
    gaps = np.diff(beats[low : high + 1])
    if not len(gaps):
        return 0.0
    turns = np.diff(gaps)
    steady = len(gaps) > 3 and max((turns > 0).sum(), (turns < 0).sum()) * 10 >= len(turns) * 7
    period = float(np.median(gaps))
    if period <= 0:
        return 0.0
    agree = ((gaps >= period * 0.85) & (gaps <= period * 1.15)).sum()
    if not steady and agree * 3 < len(gaps) * 2:
        more = np.diff(beats[max(0, centre - window * wide) : min(last, centre + window * wide) + 1])
        if len(more) > len(gaps) and (other := _upper(more)) > 0:
            period = other
    return 60000 / period


def bpm_at(beats: np.ndarray, times: np.ndarray, window: int = 6) -> np.ndarray:
    """Tempo around each time: that of the last beat before it, worked out once for each such beat."""
    centre, of = np.unique(np.maximum(np.searchsorted(beats, times, "right") - 1, 0), return_inverse=True)
    return np.array([bpm_around(beats, c, window) for c in centre.tolist()], float)[of]


def coalesced(times: np.ndarray, lengths: np.ndarray, until: float) -> list[tuple[float, float, float]]:
    """Timing points of the same length (a thousandth) as the section they follow belong to it."""
    out: list[list[float]] = []
    ends = [*times[1:].tolist(), max(until, float(times[-1]))] if len(times) else []
    for t, length, end in zip(times.tolist(), lengths.tolist(), ends, strict=True):
        if out and abs(length - out[-1][2]) <= 0.001 * out[-1][2]:
            out[-1][1] = end
        else:
            out.append([t, end, length])
    return [tuple(x) for x in out]


def periods_around(curve: np.ndarray, centres: np.ndarray, expected: float, lags: tuple[int, int] = (10, 50), half: int = 50, share: float = 0.75) -> tuple[np.ndarray, np.ndarray]:
    """For each centre the lag, of the high peaks of the curve's correlation with itself around it, that is nearest to what is expected, and its height; zeros without any.

    All centres and lags at once, from running sums.
    """
    n, every = len(curve), np.arange(lags[0] - 1, lags[1] + 2)
    low = np.maximum(centres - half, 0)[:, None]
    high = np.maximum(np.minimum(centres[:, None] + half, n - 1 - every), low)
    upto = lambda x: np.append(0.0, np.cumsum(x))
    plain, squares = upto(curve), upto(curve * curve)
    products = np.zeros((len(every), n + 1))
    for row, k in zip(products, every, strict=True):
        if k < n:
            row[1 : n - k + 1] = np.cumsum(curve[: n - k] * curve[k:])
    size, at = high - low, np.arange(len(every))
    own, later = plain[high] - plain[low], plain[np.minimum(high + every, n)] - plain[np.minimum(low + every, n)]
    mean = own / np.maximum(size, 1)
    spread = squares[high] - squares[low] - size * mean * mean
    together = products[at, high] - products[at, low] - mean * (own + later) + size * mean * mean
    r = np.where((size >= 4 * every) & (spread > 1e-9), together / np.where(spread > 1e-9, spread, 1.0), 0.0)
    inner = r[:, 1:-1]
    top = (inner > 0) & (inner >= r[:, :-2]) & (inner >= r[:, 2:])
    fair = top & (inner >= share * np.where(top, inner, 0.0).max(axis=1, keepdims=True))
    far = np.where(fair, np.abs(every[1:-1] - expected) if expected > 0 else 0.0, np.inf)
    best = far.argmin(axis=1)
    some, rows = fair.any(axis=1), np.arange(len(centres))
    return np.where(some, every[1:-1][best], 0), np.where(some, inner[rows, best], 0.0)


def wrap(x: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Into half a period on either side of zero."""
    return np.fmod(np.fmod(x, period) + 1.5 * period, period) - 0.5 * period


def snapped(beats: np.ndarray, curve: np.ndarray, confidence: float = 0.05, support: float = 0.55, run: int = 6, bins: int = 12, most: float = 0.35, frame_ms: float = 20.0) -> np.ndarray:
    """Moves beats of long trusted runs onto the phase that most of the run shares; all runs at once."""
    out = np.array(beats, float)
    usual = dominant_period(out, modal_periods(out)) if len(out) >= max(run, 4) and len(curve) >= 200 else 0.0
    if usual <= 0:
        return out
    lag, height = periods_around(np.asarray(curve, float), np.rint(out / frame_ms).astype(int), usual / frame_ms)
    period = lag * frame_ms
    trusted = (lag > 0) & (height >= confidence) & (period >= 0.75 * usual) & (period <= 1.35 * usual)
    number = np.cumsum(trusted & ~np.append(False, trusted[:-1])) - 1
    length = np.bincount(number[trusted], minlength=int(number[-1]) + 1) if trusted.any() else np.zeros(0, int)
    rows = np.flatnonzero(trusted & (length[np.maximum(number, 0)] >= run)) if len(length) else np.zeros(0, int)
    if not len(rows):
        return out
    _, of = np.unique(number[rows], return_inverse=True)
    size = np.bincount(of)
    in_order = period[rows][np.lexsort((period[rows], of))]
    own = in_order[np.cumsum(size) - size + size // 2]  # upper median of each run
    cell = own / bins
    place = wrap(out[rows], own[of])
    votes = np.zeros((len(size), bins), int)
    np.add.at(votes, (of, np.clip(np.floor((place + own[of] / 2) / cell[of]).astype(int), 0, bins - 1)), 1)
    winner = votes.argmax(axis=1)
    middle = (winner + 0.5) * cell - own / 2
    beside = wrap(place - middle[of], own[of])
    close = np.abs(beside) <= cell[of]
    shared = middle + np.bincount(of, weights=beside * close) / np.maximum(np.bincount(of, weights=close), 1)
    move = wrap(out[rows] - wrap(shared, own)[of], own[of])
    moved = (votes.max(axis=1) >= support * size)[of] & (np.abs(move) <= most * own[of])
    out[rows[moved]] -= move[moved]
    return out
