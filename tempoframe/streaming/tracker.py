"""Beats of tracks whose samples arrive in pieces, as a stateful stream.

A track's state is a tail, however long the track and however few its peaks: samples for one chunk of frames and its margin, the
curve of the frames that are not settled, and of what came before the last ``HELD_PEAKS`` peaks with their values. Chunks are
scored where the batch schedule has them, so that the curve is the batch curve; beats are given out once ``SETTLE`` frames
have passed them, each once, and the rest at the track's end. The curve itself can be given out, too, and so can the searched path: over a given
level, as the mean of the whole is not known before the end, frames are settled once all ways that may still win lead through them.

The state has columns of its own types: numbers and the unsettled tail as values, the pieces of samples as a list, so that a new piece is put behind the others.
At its end a track's state is cleared but for a mark, which lets later rows fail. With ``idle_ms`` a track without rows for so long ends by itself, and marks expire after ``MARK_MS``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tempoframe.operators import kernels
from tempoframe.operators.kernels import frame_peaks, raw_peaks
from tempoframe.operators.scoring import BORDER, CHUNK, STRIDE, UNSCORED, Scorer, band_scorer, chunk_starts, score_chunk
from tempoframe.operators.search import HIGH, RIGIDITY, K, PathState, rewards
from tempoframe.operators.signal import FFT, HOP, complete_frames, frame_count, log_mel

SETTLE, HELD_PEAKS = 64, 256
#: How long the mark of an ended track is kept where marks expire.
MARK_MS = 24 * 3600 * 1000
CURVE = "track_id long, frame int, beat float, downbeat float"
BEATS = "track_id long, frame double, beat_ms double, beats_through_ms double, samples long, final boolean"


class TrackState:
    """One track's tail; usable without Spark."""

    def __init__(self, scorer: Scorer = band_scorer):
        self.scorer = scorer
        self.samples, self.base, self.total = np.zeros(0, np.float32), 0, 0
        self.next_frame, self.emitted, self.done = 0, 0, False
        self.curve, self.curve_base, self.cut = np.zeros(0, np.float32), 0, 0
        self.places, self.values = np.zeros(0), np.zeros(0)  # peaks before ``cut``
        self.fresh: list[tuple[int, np.ndarray, np.ndarray]] = []

    def add(self, samples: np.ndarray) -> list[float]:
        """Beats (in frames) that are settled now."""
        if self.done:
            raise ValueError("the track has ended")
        self.samples = np.concatenate((self.samples, np.asarray(samples, np.float32)))
        self.total += len(samples)
        while complete_frames(self.total) >= self.next_frame + CHUNK - BORDER:
            self._score(self.next_frame - BORDER, frame_count(self.total))
        self._forget_samples()
        return self._settled(False)

    def flush(self) -> list[float]:
        if self.done:
            return []
        total = frame_count(self.total)
        for start in chunk_starts(total):
            if min(start + BORDER + STRIDE, total) > self.next_frame or start == -BORDER and not self.next_frame:
                self._score(start, total, last=True)
        self._write(total, np.zeros(0), np.zeros(0))
        self.done = True
        return self._settled(True)

    def _score(self, start: int, total: int, last: bool = False) -> None:
        low, high = max(start, 0), min(start + CHUNK, total)
        # Before the end is known a chunk is scored only if it is complete: nothing of it can be padding on the right.
        size = self.total if last else max(self.total, (high - 1) * HOP + FFT)
        mel = log_mel(self.samples, low, high - low, self.base, size)
        found = score_chunk(mel, start, total if last else start + CHUNK, self.scorer, low)
        if found:
            first, beat, downbeat = found
            skip = self.next_frame - first
            keep = slice(max(skip, 0), max(0, min(len(beat), total - first)))
            self._write(max(first, self.next_frame), beat[keep], downbeat[keep])

    def _write(self, first: int, beat: np.ndarray, downbeat: np.ndarray) -> None:
        gap = np.full(max(0, first - self.next_frame), UNSCORED, np.float32)
        new = [np.concatenate((gap, x)).astype(np.float32) for x in (beat, downbeat)]
        self.fresh.append((self.next_frame, *new))
        self.curve = np.concatenate((self.curve, new[0]))
        self.next_frame = max(first, self.next_frame) + len(beat)

    def scored(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Frames that were scored since this was asked last, and both their values."""
        parts, self.fresh = self.fresh, []
        each = [(np.arange(first, first + len(a)), a, b) for first, a, b in parts] or [(np.zeros(0, int), np.zeros(0, np.float32), np.zeros(0, np.float32))]
        return tuple(np.concatenate(x) for x in zip(*each, strict=True))

    def _forget_samples(self) -> None:
        need = max(0, (self.next_frame - CHUNK) * HOP - 2 * FFT)
        if need > self.base:
            self.samples, self.base = self.samples[need - self.base :], need

    def _settled(self, final: bool) -> list[float]:
        limit = self.next_frame if final else self.next_frame - SETTLE
        if limit <= self.emitted:
            return []
        tail = raw_peaks(self.curve.astype(float))
        tail = tail[tail + self.curve_base >= self.cut]
        values = np.concatenate((self.values, kernels.values_at(tail, self.curve)))
        places = np.concatenate((self.places, tail + self.curve_base))
        kept = places[kernels.prune_by(places, values)]
        out = kept[(kept >= self.emitted) & (kept < limit)].tolist()
        self.emitted = limit
        # What is settled up to a frame that is no peak is known by its peaks from now on; four frames before it bear on those behind.
        peaks = np.zeros(len(self.curve), bool)
        peaks[frame_peaks(self.curve)] = True
        plain = np.flatnonzero(~peaks[: max(0, limit - self.curve_base)])
        if len(plain) and plain[-1] > 4:
            self.cut = int(plain[-1]) + self.curve_base
            old = places < self.cut
            self.places, self.values = places[old][-HELD_PEAKS:], values[old][-HELD_PEAKS:]
            self.curve, self.curve_base = self.curve[plain[-1] - 4 :], self.cut - 4
        return out


class BeatTracker(StatefulProcessor):
    """Rows of track_id, seq, samples, is_last in; settled beats out."""

    def __init__(self, scorer: Scorer = band_scorer, idle_ms: int | None = None):
        self.scorer, self.idle_ms = scorer, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", "base long, total long, next_frame int, emitted int, curve_base int, cut int")
        self.tail = handle.getValueState("tail", "curve array<float>, places array<double>, values array<double>")
        self.pieces = handle.getListState("pieces", "samples binary")
        self.mark = handle.getValueState("mark", "samples long", *([MARK_MS] if self.idle_ms else []))

    def loaded(self) -> TrackState:
        track = TrackState(self.scorer)
        if self.progress.exists():
            track.base, track.total, track.next_frame, track.emitted, track.curve_base, track.cut = self.progress.get()
            curve, places, values = self.tail.get()
            track.curve, track.places, track.values = np.array(curve, np.float32), np.array(places, float), np.array(values, float)
            track.samples = np.concatenate([np.zeros(0, np.float32), *(np.frombuffer(x[0], np.float32) for x in self.pieces.get())])
        return track

    def store(self, track: TrackState, new: list[np.ndarray], forgot: bool) -> None:
        self.progress.update((track.base, track.total, track.next_frame, track.emitted, track.curve_base, track.cut))
        self.tail.update((track.curve.tolist(), track.places.tolist(), track.values.tolist()))
        if forgot:
            self.pieces.put([(track.samples.tobytes(),)])
        elif new:
            self.pieces.appendList([(x.tobytes(),) for x in new])

    def forget(self, track: TrackState) -> None:
        for state in (self.progress, self.tail, self.pieces):
            state.clear()
        self.mark.update((track.total,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        parts = pd.concat(list(rows)).sort_values("seq")
        if self.mark.exists():
            if any(x is not None and len(x) for x in parts.samples):
                raise ValueError("the track has ended")
            return
        track, found, new = self.loaded(), [], []
        base = track.base
        for samples, last in zip(parts.samples, parts.is_last, strict=True):
            if samples is not None and len(samples):
                new.append(np.asarray(samples, np.float32))
                found += track.add(new[-1])
            if last:
                found += track.flush()
        yield self.given_out(key[0], track, found)
        self.wait(timerValues, track.done)
        if track.done:
            self.forget(track)
        else:
            self.store(track, new, track.base != base)

    def wait(self, timer_values, done: bool) -> None:
        if self.idle_ms:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            if not done:
                self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """A track that sent nothing for long ends where it is."""
        if self.progress.exists():
            track = self.loaded()
            yield self.given_out(key[0], track, track.flush())
            self.forget(track)

    def given_out(self, track_id: int, track: TrackState, found: list[float]) -> pd.DataFrame:
        track.scored()
        through = track.emitted * 1000.0 / 50
        return pd.DataFrame({"track_id": track_id, "frame": found, "beat_ms": [f * 20.0 for f in found], "beats_through_ms": through, "samples": track.total, "final": track.done}).astype({"track_id": "int64", "frame": "float64", "beat_ms": "float64", "beats_through_ms": "float64", "samples": "int64", "final": "bool"})

    def close(self) -> None:
        pass


class CurveTracker(BeatTracker):
    """The same rows in; the scored frames out, each once."""

    def given_out(self, track_id: int, track: TrackState, found: list[float]) -> pd.DataFrame:
        frame, beat, downbeat = track.scored()
        return pd.DataFrame({"track_id": np.full(len(frame), track_id, np.int64), "frame": frame.astype(np.int32), "beat": beat, "downbeat": downbeat})


class PathTracker(BeatTracker):
    """The same rows in; the frames of the searched path out, each once, as they are settled."""

    def __init__(self, level: float, scorer: Scorer = band_scorer, rigidity: float = RIGIDITY, floor: float = 0.0, idle_ms: int | None = None):
        super().__init__(scorer, idle_ms)
        self.level, self.rigidity, self.floor = level, rigidity, floor

    def init(self, handle) -> None:
        super().init(handle)
        self.ways = handle.getValueState("ways", "worth binary, came binary, base int, root array<long>, best array<long>")

    def forget(self, track: TrackState) -> None:
        super().forget(track)
        self.ways.clear()

    def given_out(self, track_id: int, track: TrackState, found: list[float]) -> pd.DataFrame:
        path = PathState(self.rigidity)
        if self.ways.exists():
            worth, came, path.base, root, best = self.ways.get()
            path.worth, path.came = np.frombuffer(worth, np.int64).reshape(HIGH, K), np.frombuffer(came, np.uint8).reshape(-1, K)
            path.root, path.best = (tuple(x) if x is not None else None for x in (root, best))
        _, beat, downbeat = track.scored()
        out = path.add(rewards(beat, downbeat, self.floor, self.level))
        if track.done:
            out += path.finish()
        else:
            self.ways.update((path.worth.tobytes(), path.came.tobytes(), path.base, list(path.root) if path.root else None, list(path.best) if path.best else None))
        return pd.DataFrame({"track_id": np.full(len(out), track_id, np.int64), "frame": np.array(out, np.int32)})


def _streamed(pieces: DataFrame, processor: BeatTracker, schema: str) -> DataFrame:
    return pieces.groupBy("track_id").transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="ProcessingTime" if processor.idle_ms else "None")


def stream_beats(pieces: DataFrame, scorer: Scorer = band_scorer, idle_ms: int | None = None) -> DataFrame:
    """Settled beats of a stream of pieces; needs the RocksDB state store."""
    return _streamed(pieces, BeatTracker(scorer, idle_ms), BEATS)


def stream_curve(pieces: DataFrame, scorer: Scorer = band_scorer, idle_ms: int | None = None) -> DataFrame:
    """The scored curve of a stream of pieces; written out, it is what ``tracking.searched_path`` reads when a track has ended."""
    return _streamed(pieces, CurveTracker(scorer, idle_ms), CURVE)


def stream_path(pieces: DataFrame, level: float, scorer: Scorer = band_scorer, rigidity: float = RIGIDITY, floor: float = 0.0, idle_ms: int | None = None) -> DataFrame:
    """Frames of the searched path of a stream of pieces, over a given level: those of ``tracking.searched_path`` with that level."""
    return _streamed(pieces, PathTracker(level, scorer, rigidity, floor, idle_ms), "track_id long, frame int")
