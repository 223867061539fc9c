"""Written tables that later steps read, and small helpers of the operators."""

from __future__ import annotations

import gc
import time
from collections.abc import Callable
from functools import reduce
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempoframe.sources.folders import keep_only, marked, remove, shared_folder

#: What the contracts call white space, as a Java and Python character class.
SPACE = r"[\x20\x09-\x0D]"


_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def staged(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet and read again: later steps survive lost executors and repeat nothing."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for t in tables:
        if path := _paths.pop(t, None):
            remove(t.sparkSession, path)


def tidy(spark: SparkSession) -> None:
    """Asks the driver to collect its garbage: only then do files go that shuffles of earlier steps left on the executors' disks."""
    gc.collect()
    time.sleep(1)  # until the driver's other half has let go of what Python no longer names
    spark.sparkContext._jvm.System.gc()


def staged_alone(make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives, staged; all tables that were written on the way are deleted."""
    mark = marked()
    out = staged(make())
    keep_only(mark, _paths[out])
    return out


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def bounded_batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches of few rows, so that very long texts do not meet in one batch by the thousand."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
