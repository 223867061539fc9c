"""The domain's relations made from the general-purpose test tables, and the same as SQL common table expressions.

Times are event times in milliseconds since 2024, shortened a hundred thousand times, so that gaps are a beat's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Users whose events make one long track.
GATHERED = 16
#: Orders whose lines make one track of spectra.
GATHERED_ORDERS = 384
START_US, SHORTEN = 1_704_067_200_000_000, 100_000.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ms() -> Column:
    return (F.unix_micros(F.col("ts").cast("timestamp")) - START_US).cast("double") / 1000.0 / SHORTEN


def _events(spark: SparkSession, sf_dir: str, kind: str | None, time: str, *columns: Column) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    rows = rows.filter(F.col("event_type") != "purchase") if kind is None else rows.filter(F.col("event_type") == kind)
    return rows.select(F.col("user_id").alias("track_id"), _ms().alias(time), *columns)


def beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track_id, beat_ms."""
    return _events(spark, sf_dir, None, "beat_ms")


def long_beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track_id, beat_ms: the events of ``GATHERED`` users in a track, of as many beats as a recording has; more users are more tracks."""
    return beats(spark, sf_dir).withColumn("track_id", gathered(F.col("track_id")))


def gathered(user: Column) -> Column:
    return F.floor(user / GATHERED)


def clicks(spark: SparkSession, sf_dir: str, kind: str = "click") -> DataFrame:
    """track_id, t_ms: times at which something is asked."""
    return _events(spark, sf_dir, kind, "t_ms")


def timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track_id, time_ms, beat_length_ms."""
    return _events(spark, sf_dir, "purchase", "time_ms", (F.lit(250.0) + F.col("value")).alias("beat_length_ms"))


def activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track_id, frame, x."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("track_id"), F.posexplode("embedding").alias("frame", "v")).select("track_id", "frame", F.col("v").cast("double").alias("x"))


def signal(spark: SparkSession, sf_dir: str, long: bool = False) -> DataFrame:
    """track_id, frame, x: event values in order of time, by user or, if ``long``, by as many as a long track gathers."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "events").withColumn("track_id", gathered(F.col("user_id")) if long else F.col("user_id"))
    return rows.select("track_id", (F.row_number().over(Window.partitionBy("track_id").orderBy("ts", "event_id")) - 1).alias("frame"), F.col("value").alias("x"))


_T = f"(epoch_us(ts) - {START_US})::DOUBLE / 1000.0 / {SHORTEN}"
CTE = {
    "beats": f"beats AS (SELECT user_id AS track_id, {_T} AS beat_ms FROM events WHERE event_type <> 'purchase')",
    "asked": f"asked AS (SELECT user_id AS track_id, {_T} AS t_ms FROM events WHERE event_type = 'click')",
    "views": f"views AS (SELECT user_id AS track_id, {_T} AS t_ms FROM events WHERE event_type = 'view')",
    "timing": f"timing AS (SELECT user_id AS track_id, {_T} AS time_ms, 250.0 + value AS beat_length_ms FROM events WHERE event_type = 'purchase')",
    "activation": "activation AS (SELECT vec_id AS track_id, i::INT AS frame, embedding[i + 1]::DOUBLE AS x FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS i FROM embeddings))",
    "signal": "signal AS (SELECT user_id AS track_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS frame, value AS x FROM events)",
    "gaps": "gaps AS (SELECT track_id, beat_ms, beat_ms - lag(beat_ms) OVER (PARTITION BY track_id ORDER BY beat_ms) AS gap_ms FROM beats QUALIFY gap_ms IS NOT NULL)",
    "idx": "idx AS (SELECT track_id, beat_ms, row_number() OVER w - 1 AS i, lead(beat_ms) OVER w - beat_ms AS gap_ms, count(*) OVER (PARTITION BY track_id) AS n FROM beats WINDOW w AS (PARTITION BY track_id ORDER BY beat_ms))",
    "grid": """grid AS (SELECT track_id, beat_ms FROM (SELECT track_id, time_ms + k * beat_length_ms AS beat_ms, stop FROM (SELECT *, unnest(range(0, ceil((stop - time_ms) / beat_length_ms)::BIGINT + 1)) AS k FROM
        (SELECT *, coalesce(lead(time_ms) OVER (PARTITION BY track_id ORDER BY time_ms), time_ms + 2000.0) AS stop FROM timing))) WHERE beat_ms < stop)""",
}


def sql(*names: str, then: str) -> str:
    """A query over the named relations, in their order of dependence."""
    return f"WITH {', '.join(CTE[n] for n in names)} {then}"


#: Upper median of a list.
def upper(x: str) -> str:
    return f"list_sort({x})[len({x}) // 2 + 1]"
