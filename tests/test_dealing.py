"""Kernels of two relations of a track get both, also where each was dealt by tracks before."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tempoframe.operators import kernels as K, tracking as T


@pytest.fixture
def coalesced(spark):
    """Partitions are put together up to 64 KB: all of a small relation, none or few of a large one."""
    new = {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    old = {k: spark.conf.get(k) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_unions_of_relations_dealt_by_tracks(spark, coalesced):
    rng, tracks = np.random.default_rng(5), {}
    for k in range(40):
        n = int(rng.integers(30, 60))
        curve = np.where(np.arange(20 * n) % 20 == 3, 1.0, 0.0) + rng.random(20 * n) * 0.2
        tracks[k] = (60.0 + np.arange(n) * 400.0 + rng.integers(-30, 31, n), curve)
    beats = spark.createDataFrame(pd.concat([pd.DataFrame({"track_id": k, "beat_ms": b}) for k, (b, _) in tracks.items()]), "track_id long, beat_ms double")
    curves = spark.createDataFrame(pd.concat([pd.DataFrame({"track_id": k, "frame": np.arange(len(c)), "x": c}) for k, (_, c) in tracks.items()]), "track_id long, frame int, x double")
    each = Window.partitionBy("track_id")
    beats = beats.withColumn("n", F.row_number().over(each.orderBy("beat_ms"))).filter("n > 0")
    curves = curves.withColumn("n", F.row_number().over(each.orderBy("frame"))).filter("n > 0")
    got = T.snapped(beats, curves).toPandas()
    want = {k: K.snapped(b, c) for k, (b, c) in tracks.items()}
    assert sum(np.abs(want[k] - b).max() > 1 for k, (b, _) in tracks.items()) >= 10
    for k in tracks:
        assert np.allclose(got[got.track_id == k].sort_values("beat_ms").snapped_ms, want[k])
    points = beats.select("track_id", (F.col("beat_ms") + 1).alias("t_ms"), F.row_number().over(each.orderBy("beat_ms")).alias("n")).filter("n > 0")
    assert T.bpm_at(points, beats).filter("bpm = 0").count() == 0
