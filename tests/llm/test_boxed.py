"""Rows that are dealt to buckets in compressed boxes come back whole, and take less room."""

import random
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from tempoframe.llm import alignment
from tests.llm.conftest import prose


def test_boxes_hold_all_rows_in_less_room(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i % 5, None if i == 7 else i // 2, prose(rng, 150, 5000) if i % 50 else "") for i in range(2000)]
    df = spark.createDataFrame(rows, "bucket int, doc_id long, text string").repartition(3)
    for most in (alignment.BOXED, 1):  # all at once, and every batch by itself
        monkeypatch.setattr(alignment, "BOXED", most)
        got = Counter()
        boxes = alignment.boxed(df.select("doc_id", "text", "bucket")).collect()
        for bucket, box in boxes:
            got.update((bucket, *r.values()) for r in alignment.unboxed(pa.scalar(bytes(box), pa.binary())).to_pylist())
        assert got == Counter(rows)
        if most > 1:
            assert sum(len(b) for _, b in boxes) < 0.55 * sum(len(t) for _, _, t in rows)
    assert alignment.boxed(df.limit(0).select("doc_id", "text", F.col("bucket"))).count() == 0
