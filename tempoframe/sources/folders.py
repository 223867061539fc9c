"""Folders that the driver and all executors see."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """URI of a new folder below ``spark.checkpoint.dir``, as the cluster's default file system reads it.

    Where that is unset, a local session gets a temporary folder; any other fails, as its machines share no such folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        base = tempfile.mkdtemp(prefix="tempoframe-")
        spark.conf.set("spark.checkpoint.dir", base)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    full = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()
    path = f"{re.sub('^file:/+', 'file:///', full).rstrip('/')}/tempoframe/{uuid.uuid4().hex}"
    if not _made:
        atexit.register(clean)
    _made.append((spark, path))
    return path


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table of files that later steps read; a lost executor costs no more than the step since."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def marked() -> int:
    """A mark for ``keep_only``."""
    return len(_made)


def keep_only(mark: int, path: str) -> None:
    """Deletes what was made since the mark, but for ``path``."""
    gone, _made[mark:] = [x for x in _made[mark:] if x[1] != path], [x for x in _made[mark:] if x[1] == path]
    for spark, other in gone:
        remove(spark, other)


def clean() -> None:
    """Deletes what this process wrote with ``shared_folder``."""
    while _made:
        spark, path = _made.pop()
        try:
            remove(spark, path)
        except Exception:  # the session may have gone already
            pass


def write_file(folder: str, name: str, data: bytes) -> None:
    """From a task; ``folder``: a URI. Under another name first, then moved, so that no reader meets half a file."""
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(f"{path}/{name}".rpartition("/")[0], recursive=True)
    part = f"{path}/.{uuid.uuid4().hex}"
    with system.open_output_stream(part, compression=None) as out:
        out.write(data)
    system.move(part, f"{path}/{name}")
