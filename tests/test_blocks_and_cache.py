"""Files by blocks, and a cache whose entries are overwritten and found by their keys."""

import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempoframe.sources import blocks, readers, sinks


def wav(path, values, width, channels=2, rate=44_100):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(values.tobytes() if width != 3 else b"".join(int(v).to_bytes(3, "little", signed=True) for v in values))


def gathered(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["path"], r["block"])):
        own = out.setdefault(r["path"].rsplit("/", 1)[1], [])
        assert r["first_sample"] == len(own) and r["channels"] and r["sample_rate"]
        own += r["samples"]
    return out


def test_blocks_are_the_whole(spark, tmp_path):
    rng = np.random.default_rng(1)
    for width, kind in ((1, "u1"), (2, "<i2"), (3, "<i4"), (4, "<i4")):
        low, high = (0, 256) if width == 1 else (-(1 << 22), 1 << 22) if width > 2 else (-30_000, 30_000)
        wav(tmp_path / f"{width}.wav", rng.integers(low, high, 5000).astype(kind), width)
    rng.random(777).astype("<f4").tofile(tmp_path / "raw.f32")
    wav(tmp_path / "none.wav", np.zeros(0, "<i2"), 2)
    data = (tmp_path / "2.wav").read_bytes()
    (tmp_path / "odd.wav").write_bytes(data[:36] + b"LIST" + (5).to_bytes(4, "little") + b"abcde\0" + b"data" + (1 << 31).to_bytes(4, "little") + data[44:])
    spark.dataSource.register(blocks.AudioBlocks)
    for block, size in ((64, 500), (65_536, 1 << 20), (7, 3000)):
        df = spark.read.format("audio_blocks").option("path", str(tmp_path)).option("block", block).option("rangeBytes", size).load()
        assert df.rdd.getNumPartitions() == sum(max(1, -(-p.stat().st_size // size)) for p in tmp_path.iterdir())
        got = gathered(df.collect())
        assert set(got) == {p.name for p in tmp_path.iterdir()} - {"none.wav"}
        for name, samples in got.items():
            whole = readers.decode_any((tmp_path / name).read_bytes())[0] if name != "odd.wav" else readers.decode_any(data)[0]
            assert np.array_equal(np.array(samples, np.float32), whole), name
        content = blocks.content_blocks(readers.files(spark, str(tmp_path)), block)
        assert gathered(content.collect()) == got
    (tmp_path / "bad.wav").write_bytes(b"RIFF0000WAVE")
    with pytest.raises(Exception, match="no samples"):
        spark.read.format("audio_blocks").option("path", str(tmp_path / "bad.wav")).load().collect()


def entries(spark, rows):
    return spark.createDataFrame(rows, "cache_key string, metrical_shift int, beats array<double>")


def test_entries_are_overwritten_by_key(spark, tmp_path):
    folder = str(tmp_path / "cache")
    first = [(f"{k:02x}{'0' * 30}", 0, [float(k), 2.0]) for k in range(40)] + [(f"05{'1' * 30}", 0, [7.0])]
    sinks.store(entries(spark, first), folder)
    sinks.store(entries(spark, [(f"05{'0' * 30}", 1, [9.0004]), (f"fe{'0' * 30}", 0, []), (f"ff{'0' * 30}", 0, [1.0]), (f"ff{'0' * 30}", 2, [1.0])]), folder)
    got = {r["cache_key"]: (r["metrical_shift"], r["beats"]) for r in sinks.load(spark, folder).collect()}
    assert sinks.load(spark, folder).count() == len(got) == 42
    assert got[f"05{'0' * 30}"] == (1, [9.0]) and got[f"05{'1' * 30}"] == (0, [7.0]) and got[f"ff{'0' * 30}"] == (2, [1.0]) and got[f"07{'0' * 30}"] == (0, [7.0, 2.0])
    assert len(list((tmp_path / "cache" / "prefix=05").glob("*.parquet"))) == 1


def test_a_lookup_reads_only_the_folders_of_its_keys(spark, tmp_path):
    folder = str(tmp_path / "cache")
    sinks.store(entries(spark, [(f"{k:02x}{'a' * 30}", 0, [1.0]) for k in range(64)]), folder)
    keys = spark.createDataFrame([(f"{k:02x}{'a' * 30}",) for k in (3, 9, 200)], "cache_key string")
    held = sinks.load(spark, folder, keys)
    assert {f.split("prefix=")[1][:2] for f in held.inputFiles()} >= {"03", "09"}
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "prefix" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert sorted(r["cache_key"][:2] for r in held.collect()) == ["03", "09"]
    calls = []

    def analyse(missing):
        calls.append(sorted(r["cache_key"][:2] for r in missing.collect()))
        return missing.select("cache_key", F.lit(0).alias("metrical_shift"), F.array(F.lit(5.0)).alias("beats"))

    asked = keys.withColumn("path", F.col("cache_key"))
    for _ in range(2):
        assert {r["path"][:2]: r["beats"] for r in sinks.memoised(asked, folder, analyse).collect()} == {"03": [1.0], "09": [1.0], "c8": [5.0]}
    assert calls == [["c8"]] and sinks.load(spark, folder).count() == 65
