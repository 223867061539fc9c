"""The search in blocks is the search of the whole."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tempoframe.operators import search

SCHEMA = "track_id long, frame int, x double, down double"


def pulses(rng, n, interval):
    """Beats at a wandering interval, with noise; a silence in the middle."""
    x = rng.random(n) * 0.2
    at = 3.0
    while at < n:
        x[int(at)] = 0.7 + 0.3 * rng.random()
        at += interval * (1 + 0.05 * rng.normal())
    x[n // 2 : n // 2 + 90] = 0
    return x


def curves(seed=1):
    rng = np.random.default_rng(seed)
    out = {0: pulses(rng, 900, 25), 1: rng.normal(size=700), 2: pulses(rng, 450, 12), 3: rng.random(70), 4: rng.random(8), 5: -rng.random(300), 6: np.round(pulses(rng, 640, 40), 1), 7: np.zeros(200)}
    return {k: (x, rng.random(len(x)) * (rng.random(len(x)) < 0.05)) for k, x in out.items()}


def frame_of(spark, tracks):
    rows = [pd.DataFrame({"track_id": k, "frame": np.arange(len(x)), "x": x, "down": d}) for k, (x, d) in tracks.items()]
    return spark.createDataFrame(pd.concat(rows), SCHEMA).repartition(5)


@pytest.mark.parametrize(("block", "warm"), [(10_000, 100), (450, 400), (64, 40), (128, 0), (100, 700)])
def test_blocks_of_any_size_find_the_same_path(spark, block, warm):
    tracks = curves()
    rows = search.reward_rows(frame_of(spark, tracks), 0.02, "down")
    got, rounds = search.blocked_path(rows, block_frames=block, warm=warm)
    got = got.toPandas()
    for k, (x, d) in tracks.items():
        assert sorted(got[got.track_id == k].frame) == search.best_path(x, d, floor=0.02).tolist(), k
    assert (rounds == 1) == (block == 10_000) or warm >= 400
    assert not got.duplicated().any()


def test_a_good_guess_needs_no_second_round(spark):
    rng = np.random.default_rng(3)
    x = pulses(rng, 12_000, 20)
    x[6000:6090] = pulses(rng, 90, 20)
    rows = search.reward_rows(frame_of(spark, {9: (x, x * 0)}))
    got, rounds = search.blocked_path(rows, block_frames=3000, warm=2900)
    assert rounds == 1 and sorted(r["frame"] for r in got.collect()) == search.best_path(x, x * 0).tolist()


def test_rewards_as_columns(spark):
    tracks = curves(4)
    for level in (None, 0.25):
        got = search.reward_rows(frame_of(spark, tracks), 0.1, "down", level=level).toPandas().sort_values(["track_id", "place"])
        for k, (x, d) in tracks.items():
            assert got[got.track_id == k].reward.tolist() == search.rewards(x, d, 0.1, level).tolist()


def test_frames_need_not_be_numbered_from_zero(spark):
    x, d = curves()[0]
    rows = frame_of(spark, {2: (x, d)}).withColumn("frame", F.col("frame") * 3 + 7)
    got = search.searched_path(rows, downbeat="down", block_frames=300, warm=250)
    assert sorted(r["frame"] for r in got.collect()) == (search.best_path(x, d) * 3 + 7).tolist()


def test_no_curves(spark):
    assert search.searched_path(spark.createDataFrame([], SCHEMA)).count() == 0
