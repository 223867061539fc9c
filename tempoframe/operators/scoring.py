"""Windowed scoring of spectrograms with a pluggable model.

A scorer maps frames x bands to one value per frame and output. Chunks overlap by a border that is scored and thrown away;
where chunks overlap in what they own, the earliest one counts. An overlap-add form averages windows instead.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempoframe.operators.kernels import per_group

CHUNK, BORDER = 1500, 6
STRIDE = CHUNK - 2 * BORDER
UNSCORED = -1000.0
Scorer = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


def band_scorer(mel: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A model that needs no file: energy against its surroundings, in all bands and in the low ones."""
    out = []
    for part in (mel, mel[:, :32]):
        level = part.mean(axis=1) if len(part) else np.zeros(0)
        around = np.convolve(level, np.ones(9) / 9, mode="same")
        out.append((level - around).astype(np.float32))
    return out[0], out[1]


@cache
def _session(path: str, threads: int):
    import onnxruntime

    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads, options.inter_op_num_threads = max(1, threads), 1
    return onnxruntime.InferenceSession(path, options, providers=["CPUExecutionProvider"])


def onnx_scorer(path: str, threads: int = 1, inputs: str = "spectrogram", outputs: tuple[str, str] = ("beat", "downbeat"), bands_first: bool = False) -> Scorer:
    """A model file; its session is opened once for each worker process. Few threads: tasks run side by side."""

    def score(mel: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        batch = np.ascontiguousarray(mel.T if bands_first else mel, np.float32)[None]
        found = _session(path, threads).run(list(outputs), {inputs: batch})
        return tuple(np.asarray(x, np.float32).reshape(-1) for x in found)

    return score


def chunk_starts(total: int) -> list[int]:
    starts = list(range(-BORDER, total - BORDER, STRIDE))
    if starts and total > STRIDE:
        starts[-1] = total - (CHUNK - BORDER)
    return starts


def chunk_schedule(total: Column) -> Column:
    """The same as an array column."""
    starts = F.when(total > 0, F.sequence(F.lit(-BORDER), total - BORDER - 1, F.lit(STRIDE))).otherwise(F.array().cast("array<int>"))
    last = F.array(total - (CHUNK - BORDER))
    return F.when(total > STRIDE, F.concat(F.slice(starts, 1, F.size(starts) - 1), last)).otherwise(starts)


def score_chunk(mel: np.ndarray, start: int, total: int, scorer: Scorer, base: int = 0) -> tuple[int, np.ndarray, np.ndarray] | None:
    """(first owned frame, values, values) of the chunk at ``start``; ``mel`` begins at frame ``base``. None for too short ones."""
    low, high = max(start, 0), min(start + CHUNK, total)
    left, right = max(0, -start), max(0, min(BORDER, start + CHUNK - total))
    if left + high - low + right <= 2 * BORDER:
        return None
    a, b = scorer(np.pad(mel[low - base : high - base], ((left, right), (0, 0))))
    return start + BORDER, a[BORDER : len(a) - BORDER], b[BORDER : len(b) - BORDER]


def scored(mel: np.ndarray, scorer: Scorer) -> tuple[np.ndarray, np.ndarray]:
    """Both outputs for all frames; UNSCORED where no chunk owns a frame."""
    total = len(mel)
    out = np.full((2, total), UNSCORED, np.float32)
    for start in reversed(chunk_starts(total)):
        if found := score_chunk(mel, start, total, scorer):
            first, *values = found
            low, high = max(first, 0), min(first + len(values[0]), total)
            for row, v in zip(out, values, strict=True):
                row[low:high] = v[low - first : high - first]
    return out[0], out[1]


def _with_total(mel: DataFrame) -> DataFrame:
    """track_id, frame, mel, total (frames of the track); ``mel_frames`` can give it without a second look at the track."""
    if "total" in mel.columns:
        return mel.select("track_id", "frame", "mel", "total")
    return mel.select("track_id", "frame", "mel").join(mel.groupBy("track_id").agg((F.max("frame") + 1).alias("total")), "track_id")


def activations(mel: DataFrame, scorer: Scorer = band_scorer) -> DataFrame:
    """track_id, frame, beat, downbeat from track_id, frame, mel: each chunk of each track is a group, with one exchange.

    Chunk k gives the frames from k * STRIDE on, the last one all that are left: of chunks that overlap the earliest counts.
    """
    total, frame = F.col("total"), F.col("frame")
    last = F.ceil(total / STRIDE).cast("int") - 1
    begin = lambda k: F.when((k == last) & (total > STRIDE), total - (CHUNK - BORDER)).otherwise(k * STRIDE - BORDER)
    own = F.floor(frame / STRIDE).cast("int")
    # A frame lies in at most three chunks: its own, a neighbour, and the last, which is pulled back.
    near = F.filter(F.array_distinct(F.array(own - 1, own, own + 1, last)), lambda k: (k >= 0) & (k <= last) & (frame >= begin(k)) & (frame < begin(k) + CHUNK))
    frames = _with_total(mel).withColumn("chunk", F.explode(near))

    def kernel(f: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        total, k = int(f["total"][0]), int(f["chunk"][0])
        first, end = k * STRIDE, min((k + 1) * STRIDE, total)
        out = np.full((2, max(0, end - first)), UNSCORED, np.float32)
        if found := score_chunk(f["mel"], chunk_starts(total)[k], total, scorer, int(f["frame"][0])):
            at, *values = found
            low, high = max(at, first), min(at + len(values[0]), end)
            for row, v in zip(out, values, strict=True):
                row[low - first : high - first] = v[low - at : high - at]
        return {"frame": np.arange(first, end), "beat": out[0], "downbeat": out[1]}

    return per_group(frames, ("track_id", "chunk"), kernel, "track_id long, chunk int, frame int, beat float, downbeat float", "frame").drop("chunk")


def overlap_add(mel: DataFrame, scorer: Scorer = band_scorer, window: int = 1024, hop: int = 960, shortest: int = 64) -> DataFrame:
    """track_id, frame, beat_prob, period_frames: means over windows of the first output's sigmoid and of the log period."""
    frame = F.col("frame")
    own = F.floor(frame / hop).cast("int")
    near = F.filter(F.sequence(F.greatest(F.lit(0), own - (window - 1) // hop), own), lambda k: frame < k * hop + window)
    frames = _with_total(mel).withColumn("window", F.explode(near))

    def kernel(f: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        n = len(f["frame"])
        if min(window, int(f["total"][0]) - int(f["window"][0]) * hop) < shortest:  # its frames stay without a value of it
            return {"frame": f["frame"], "p": np.zeros(n), "log_period": np.zeros(n), "scored": np.zeros(n, bool)}
        a, b = scorer(f["mel"])
        return {"frame": f["frame"], "p": 1 / (1 + np.exp(-a.astype(np.float32))), "log_period": b, "scored": np.ones(n, bool)}

    each = per_group(frames, ("track_id", "window"), kernel, "track_id long, window int, frame int, p float, log_period float, scored boolean", "frame")
    means = each.groupBy("track_id", "frame").agg(*(F.avg(F.when(F.col("scored"), F.col(c))).alias(c) for c in ("p", "log_period")))
    return means.select("track_id", "frame", F.coalesce("p", F.lit(0.0)).cast("float").alias("beat_prob"), F.coalesce(F.exp("log_period"), F.lit(1.0)).cast("float").alias("period_frames"))


def largest_difference(one: DataFrame, other: DataFrame) -> DataFrame:
    """frames, beat, downbeat: the largest absolute difference of two scorings (track_id, frame, beat, downbeat) of the same spectra."""
    names = ("beat", "downbeat")
    both = one.join(other.select("track_id", "frame", *(F.col(c).alias(f"_{c}") for c in names)), ["track_id", "frame"])
    return both.agg(F.count(F.lit(1)).alias("frames"), *(F.max(F.abs(F.col(c).cast("double") - F.col(f"_{c}"))).alias(c) for c in names))
