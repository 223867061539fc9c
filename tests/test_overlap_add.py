"""Overlap-add over tracks that grow with the table: all windows of a line number, numbered by ranges."""

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tempoframe.operators import grids as D, scoring as S
from tempoframe.plans.queries import QUERIES


def test_all_windows_of_a_line_number_overlap(spark, tmp_path):
    rng, n = np.random.default_rng(4), 2950
    order = np.tile(rng.permutation(n) * 7, 2)  # an order key in each seventh place: few lines to a range of keys
    rows = pd.DataFrame({"l_orderkey": order, "l_linenumber": np.repeat([1, 2], n), "l_partkey": rng.integers(1, 2000, 2 * n), "l_quantity": rng.integers(1, 51, 2 * n).astype(float)})
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double").repartition(5).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = QUERIES["c7_overlap_add"](spark, str(tmp_path)).toPandas().set_index(["track_id", "second"])
    want = {}
    for track, own in rows.sort_values("l_orderkey").groupby("l_linenumber"):
        mel = ((own.l_quantity.to_numpy(np.int64)[:, None] * (np.arange(40) + 3) + own.l_partkey.to_numpy()[:, None]) % 17).astype(np.float32)
        p, logs, times = np.zeros(n), np.zeros(n), np.zeros(n)
        for start in range(0, n, 960):
            a, b = S.band_scorer(mel[start : start + 1024])
            if len(a) >= 64:
                p[start : start + 1024] += 1 / (1 + np.exp(-a))
                logs[start : start + 1024] += b
                times[start : start + 1024] += 1
        assert (times == 2).sum() >= 128  # two overlaps inside the track, not one
        for second in range(n // 50):
            at = slice(second * 50, second * 50 + 50)
            want[track, second] = (50, (p[at] / times[at]).mean(), np.exp(logs[at] / times[at]).mean())
    assert sorted(got.index) == sorted(want) and (got.frames == 50).all()
    assert all(abs(got.beat_prob[k] - w[1]) < 0.0011 and abs(got.period_frames[k] - w[2]) < 0.011 for k, w in want.items())


def test_numbers_by_ranges(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(3000), "k": rng.choice([1, 2, 3], 3000, p=[0.9, 0.09, 0.01]), "a": rng.integers(0, 20, 3000)}), "id long, k long, a long").repartition(7)
    df = df.unionByName(spark.sql("SELECT 5000L AS id, NULL AS k, 1L AS a UNION ALL SELECT 5001L, 1L, NULL"))
    of = Window.partitionBy("k")
    want = df.filter("k IS NOT NULL").withColumn("frame", F.row_number().over(of.orderBy(F.col("a").asc_nulls_last(), "id")) - 1).withColumn("total", F.count(F.lit(1)).over(of))
    got = D.numbered(df, "k", "a", "id").select(want.columns)
    assert got.exceptAll(want).isEmpty() and got.count() == 3001
    assert D.numbered(df.limit(0), "k", "a").count() == 0
