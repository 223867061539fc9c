"""Means that decide a comparison are summed in the order of frames, whatever the order of rows."""

import datetime as dt

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tempoframe.functions import numeric as N
from tempoframe.plans.queries import ORACLE_SQL, QUERIES

#: Their mean is the second one if summed from the first on, and less if summed from the last on.
VALUES = [34.46, 55.21, 82.2, 90.94, 23.01, 42.91, 57.74]


def test_strengths_that_equal_the_mean(spark, tmp_path):
    n = len(VALUES)
    ts = [dt.datetime(2024, 1, 1) + dt.timedelta(seconds=k + 1) for k in range(n)]
    rows = pa.table({"event_id": range(n), "ts": ts, "user_id": [1] * n, "event_type": ["view"] * n, "value": VALUES})
    pq.write_table(rows.take(list(range(n))[::-1]), tmp_path / "events.parquet")
    got = [tuple(r) for r in QUERIES["h40_hit_rate"](spark, str(tmp_path)).collect()]
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
        assert got == c.execute(ORACLE_SQL["h40_hit_rate"]).fetchall() == [(1, 1.0, 0.0)]


def test_mean_in_order(spark):
    rows = [(k, i, x) for k in (1, 2) for i, x in enumerate([*VALUES, None])] + [(3, 0, None)]
    df = spark.createDataFrame(rows[::-1], "track_id long, frame int, x double").repartition(5)
    got = dict(map(tuple, df.groupBy("track_id").agg(N.mean_in_order(F.col("x"), F.col("frame"))).collect()))
    assert got == {1: 55.21, 2: 55.21, 3: None}
