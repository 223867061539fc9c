"""Suppression in rounds is that of the queue; ranks by ranges are those of a window."""

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tempoframe.operators import grids as G, kernels as K, peaks as P

SCHEMA = "track_id long, frame int, beat_prob double, period_frames double"


def test_rounds_choose_what_the_queue_chooses(spark):
    rng, tracks = np.random.default_rng(1), {}
    for k in range(40):
        n = int(rng.integers(1, 150))
        x = np.round(rng.random(n), 1 if k % 3 else 6)  # many equal ones
        tracks[k] = (np.sort(x) if k == 7 else x, rng.choice([0.0, 4.0, 9.5, 40.0] if k % 2 else [8.0, 9.0, 10.0, 11.0, 12.0], n))
    df = spark.createDataFrame(pd.concat([pd.DataFrame({"track_id": k, "frame": np.arange(len(x)), "beat_prob": x, "period_frames": p}) for k, (x, p) in tracks.items()]), SCHEMA).repartition(3)
    got = P.suppressed(df, 0.75).toPandas()
    for k, (x, p) in tracks.items():
        assert sorted(got[got.track_id == k].frame) == K.suppress(x, p, 0.75).tolist()
    assert P.suppressed(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ranks_by_ranges(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(3000), "metric": rng.choice(["a", "b", "c"], 3000), "value": np.round(rng.random(3000), 2)})).repartition(7)
    want = df.withColumn("place", F.rank().over(Window.partitionBy("metric").orderBy("value")))
    got = G.ranks(df, "metric", "value").select(want.columns)
    assert got.exceptAll(want.withColumn("place", F.col("place").cast("long"))).isEmpty() and got.count() == 3000
    top = G.modes(df, "value", 5).orderBy("rank").collect()
    counts = df.groupBy("value").count().toPandas().sort_values(["count", "value"], ascending=[False, True])
    assert [(r["value"], r["n"]) for r in top] == list(zip(counts.value[:5].tolist(), counts["count"][:5].tolist(), strict=True))
