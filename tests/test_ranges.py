"""Many small ranges of files share tasks; each is read once, and those of a file are dealt among tasks."""

import numpy as np

from tempoframe.sources import blocks


def test_small_ranges_share_tasks(spark, tmp_path):
    for k in range(150):
        (np.arange(100) + k).astype("<f4").tofile(tmp_path / f"{k}.f32")
    options = {"path": str(tmp_path), "block": "10", "rangebytes": "100"}
    parts = blocks.BlockReader(options).partitions()
    every = [(r.path, r.part, r.parts) for p in parts for r in p.ranges]
    assert len(parts) == blocks.TASKS < len(every) == len(set(every)) == 600
    assert all(len({r.path for r in p.ranges}) == len(p.ranges) for p in parts)
    spark.dataSource.register(blocks.AudioBlocks)
    df = spark.read.format("audio_blocks").options(path=str(tmp_path), block=10, rangeBytes=100).load()
    got = {}
    for r in df.orderBy("path", "block").collect():
        got.setdefault(int(r["path"].rpartition("/")[2][:-4]), []).extend(r["samples"])
    assert got == {k: (np.arange(100.0) + k).tolist() for k in range(150)}
