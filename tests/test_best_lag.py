"""The best lag of a grid is looked up without a copy of each beat for each lag, and without a broadcast of these."""

import numpy as np
import pandas as pd

from tempoframe.operators import grids as G


def test_best_lag_in_one_sort(spark):
    rng = np.random.default_rng(6)
    curves = {k: np.round(rng.random(int(rng.integers(1, 60))) * 8) for k in range(30)} | {40: np.ones(5)}
    beats = {k: rng.integers(-6, len(x) + 12, 20) * 20.0 for k, x in curves.items()} | {41: np.array([20.0])}
    beats[29] = np.array([20.0 * (len(curves[29]) + 9)])  # too far from all frames
    points = spark.createDataFrame(pd.concat([pd.DataFrame({"track_id": k, "beat_ms": b}) for k, b in beats.items()]), "track_id long, beat_ms double").repartition(3)
    curve = spark.createDataFrame(pd.concat([pd.DataFrame({"track_id": k, "frame": np.arange(len(x)), "x": x}) for k, x in curves.items()]), "track_id long, frame int, x double").repartition(2)
    found = G.best_lag(points, curve)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Generate" not in plan
    want = {}
    for k, x in curves.items():
        at = np.rint(beats[k] / 20).astype(int)
        for lag in range(-8, 9):
            own = at[(at + lag >= 0) & (at + lag < len(x))] + lag
            if len(own):
                score = (x[own] - x.mean()).sum()
                if k not in want or score > want[k][1] + 1e-9:
                    want[k] = (lag, score)
    got = {r["track_id"]: (r["lag"], r["score"]) for r in found.collect()}
    assert got.keys() == want.keys() and 29 not in got and 41 not in got
    for k, (lag, score) in want.items():
        assert got[k][0] == lag and abs(got[k][1] - score) < 2e-6
