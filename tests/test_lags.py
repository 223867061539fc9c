"""Sums over lags, local autocorrelations and periods as expressions, against plain loops and the kernels that fixed tracks use."""

import numpy as np
import pandas as pd
import pytest

from tempoframe.operators import beats as B, grids as G, kernels as K


def plain_correlation(x, centre, lag, half=50):
    """Pair by pair."""
    pairs = [(x[i], x[i + lag]) for i in range(max(centre - half, 0), min(centre + half, len(x) - 1 - lag))]
    if len(pairs) < 4 * lag:
        return 0.0
    mean = sum(a for a, _ in pairs) / len(pairs)
    under = sum((a - mean) ** 2 for a, _ in pairs)
    return sum((a - mean) * (b - mean) for a, b in pairs) / under if under > 0 else 0.0


def plain_period(x, centre, expected):
    r = {k: plain_correlation(x, centre, k) for k in range(9, 52)}
    tops = [k for k in range(10, 51) if r[k] > 0 and r[k] >= r[k - 1] and r[k] >= r[k + 1]]
    high = [k for k in tops if r[k] >= 0.75 * max(r[t] for t in tops)]
    best = min(high, key=lambda k: (abs(k - expected) if expected > 0 else 0, k), default=0)
    return best, r.get(best, 0.0)


def curves(rng, sizes=(40, 300, 301)):
    return {k: (rng.normal(size=n), rng.normal(size=n)) for k, n in enumerate(sizes)} | {9: (np.ones(150), rng.normal(size=150))}


def table(spark, tracks):
    return spark.createDataFrame(pd.concat([pd.DataFrame({"track_id": k, "frame": np.arange(len(a)), "a": a, "b": b}) for k, (a, b) in tracks.items()]), "track_id long, frame int, a double, b double").repartition(4)


@pytest.mark.parametrize("size", [17, 64, 10_000])
def test_cross_correlation_of_two_curves(spark, size):
    tracks = curves(np.random.default_rng(1))
    got = {(r["track_id"], r["lag"]): (r["n"], r["r"]) for r in G.cross_correlation(table(spark, tracks), range(-8, 9), slice_frames=size).collect()}
    for t, (a, b) in tracks.items():
        for lag in range(-8, 9):
            low, high = max(0, -lag), min(len(a), len(b) - lag)
            x, y = a[low:high], b[low + lag : high + lag]
            n, r = got[t, lag]
            assert n == high - low
            if n < 100:
                assert r == -np.inf
            elif x.std() == 0:
                assert r == 0
            else:
                assert np.isclose(r, np.corrcoef(x, y)[0, 1], atol=1e-9)
    with pytest.raises(ValueError, match="longer"):
        G.lag_sums(table(spark, tracks), [9], "a", "b", slice_frames=18)


def test_autocorrelation_of_the_whole(spark):
    tracks = curves(np.random.default_rng(2))
    got = {(r["track_id"], r["lag"]): r["r"] for r in G.autocorrelation(table(spark, tracks), (3, 12), "a", slice_frames=50).collect()}
    for t, (a, _) in tracks.items():
        c = a - a.mean()
        for lag in (3, 12):
            var = (c[:-lag] ** 2).sum()
            assert np.isclose(got[t, lag], (c[:-lag] * c[lag:]).sum() / var if var > 0 else 0, atol=1e-9)


def test_local_autocorrelation_and_period(spark):
    rng = np.random.default_rng(3)
    tracks = {k: (np.sin(np.arange(n) * 2 * np.pi / (18 + k)) + rng.normal(size=n) * 0.4, np.zeros(n)) for k, n in enumerate((400, 90, 230))} | {5: (np.zeros(200), np.zeros(200))}
    centres = [(t, c, e) for t, (a, _) in tracks.items() for c, e in ((0, 20.0), (7, 0.0), (60, 40.0), (len(a) // 2, 20.0), (len(a) - 1, 20.0), (len(a) - 30, 10.0))]
    points = spark.createDataFrame(centres, "track_id long, centre int, expected double")
    curve = table(spark, tracks).withColumnRenamed("a", "x")
    got = {(r["track_id"], r["centre"], r["lag"]): r["r"] for r in G.local_autocorrelation(curve, points, range(9, 52)).collect()}
    for t, c, _ in centres:
        for lag in range(9, 52):
            assert np.isclose(got[t, c, lag], plain_correlation(tracks[t][0], c, lag), atol=1e-9), (t, c, lag)
    periods = {(r["track_id"], r["centre"]): (r["lag"], r["r"]) for r in G.envelope_periods(curve, points).collect()}
    for t, c, e in centres:
        lag, r = plain_period(tracks[t][0], c, e)
        assert periods[t, c][0] == lag and np.isclose(periods[t, c][1], r, atol=1e-9)
        one = K.periods_around(tracks[t][0], np.array([c]), e)
        assert one[0][0] == lag and np.isclose(one[1][0], r, atol=1e-9)


def test_periods_are_those_of_the_kernels(spark):
    rng = np.random.default_rng(4)
    tracks = {k: np.cumsum(rng.choice([250.0, 251.5, 500.0, 380.0, 20.0], n, p=[0.4, 0.2, 0.2, 0.1, 0.1])) for k, n in enumerate((1, 2, 3, 4, 5, 40, 300))}
    df = spark.createDataFrame(pd.concat([pd.DataFrame({"track_id": k, "beat_ms": b}) for k, b in tracks.items()]), "track_id long, beat_ms double").repartition(3)
    local, dominant = B.local_periods(df).toPandas(), {r["track_id"]: r["dominant_ms"] for r in B.dominant_periods(df).collect()}
    for k, b in tracks.items():
        own = K.modal_periods(b)
        assert local[local.track_id == k].sort_values("beat_ms").period_ms.tolist() == own.tolist()
        assert dominant[k] == (K.dominant_period(b, own) if len(b) >= 4 else 0)
