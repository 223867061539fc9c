"""Files that tasks write to a folder that all machines share, and a manifest of them.

Every attempt of a task writes files of its own names; the manifest, a written table, names those of the attempts that counted.
Reading starts from the manifest, so that what a lost or repeated attempt left behind is never read.
"""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame


def new_name(kind: str, number: int, ending: str) -> str:
    """A name that no other task and no other attempt gives."""
    return f"{kind}-{TaskContext.get().partitionId():06d}-{number:06d}-{uuid.uuid4().hex[:12]}.{ending}"


def write_file(folder: str, name: str, data: bytes) -> None:
    """``folder``: a URI."""
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/{name}", compression=None) as out:
        out.write(data)


def read_file(folder: str, name: str) -> bytes:
    system, path = fs.FileSystem.from_uri(folder)
    with system.open_input_stream(f"{path}/{name}", compression=None) as source:
        return source.read()


def dealt_files(manifest: DataFrame) -> DataFrame:
    """The manifest with a file or few to each task."""
    return manifest.repartition(max(1, min(manifest.count(), 100_000)))
