"""Both outputs of a curve are pruned in one pass over it; the sorted search for the period around a peak is the plain one."""

import numpy as np
import pandas as pd

from tempoframe.operators import kernels as K, tracking as T


def plain_period(gaps):
    if len(gaps) < 3:
        return float(np.sort(gaps)[len(gaps) // 2]) if len(gaps) else 0.0
    best, most = 0.0, 0
    for c in gaps:
        near = gaps[(gaps >= c * 0.75) & (gaps <= c * 1.25)]
        if len(near) > most or (len(near) == most and c > best):
            most, best = len(near), float(np.sort(near)[len(near) // 2])
    return best


def test_period_around_a_peak():
    rng = np.random.default_rng(8)
    for n in (0, 1, 2, 3, 7, 64):
        for _ in range(200):
            gaps = rng.choice([0.0, 1.0, 2.0, 3.0, 4.0, 5.5, 7.5, 10.0], n)
            assert K.cluster_period(gaps) == plain_period(gaps)


def test_both_outputs_in_one_pass(spark):
    rng = np.random.default_rng(9)
    tracks = {k: np.round(rng.normal(size=(int(rng.integers(1, 300)), 2)), 2) for k in range(12)} | {20: np.full((9, 2), -1.0)}
    df = spark.createDataFrame(pd.concat([pd.DataFrame({"track_id": k, "frame": np.arange(len(x)), "beat": x[:, 0], "downbeat": x[:, 1]}) for k, x in tracks.items()]), "track_id long, frame int, beat double, downbeat double").repartition(3)
    found = T.predicted(df)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    got = found.toPandas()
    for k, x in tracks.items():
        for i, kind in enumerate(("beat", "downbeat")):
            own = got[(got.track_id == k) & (got.kind == kind)].sort_values("place")
            assert own.place.tolist() == K.beat_frames(x[:, i]).tolist() and own.beat_ms.tolist() == (own.place * 20.0).tolist()
