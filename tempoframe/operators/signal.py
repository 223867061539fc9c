"""Array signal processing: mixdown, resampling, spectra. NumPy kernels, and DataFrame forms around them.

A track's spectrogram is computed in chunks of frames from slices of its samples with a margin, so that one long track
spreads over many tasks; a chunk's frames equal the same frames of the whole.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE, HOP, FFT, MELS, FPS = 22_050, 441, 1024, 128, 50
TAPS, PHASES, BETA, CUTOFF = 256, 128, 8.0, 0.495
LOW_HZ, HIGH_HZ = 30.0, 11_000.0


def mixed_down(samples: np.ndarray, channels: int) -> np.ndarray:
    """Mean over interleaved channels; an incomplete last frame is dropped."""
    channels = max(1, channels)
    frames = len(samples) // channels
    return np.asarray(samples[: frames * channels], np.float32).reshape(frames, channels).mean(axis=1, dtype=np.float32)


def bessel_i0(x: np.ndarray) -> np.ndarray:
    k = np.arange(1, 32)
    terms = np.cumprod((np.asarray(x, float)[..., None] / 2 / k) ** 2, axis=-1)
    return 1 + terms.sum(-1)


@cache
def filter_phases(cutoff: float) -> np.ndarray:
    """A Kaiser-windowed sinc for each of PHASES + 1 fractions of a sample, each of unit sum."""
    half = TAPS // 2
    offset = np.arange(TAPS)[None, :] - (half - 1) - np.arange(PHASES + 1)[:, None] / PHASES
    inside = np.clip(1 - (offset / half) ** 2, 0, None)
    window = np.where(np.abs(offset / half) < 1, bessel_i0(BETA * np.sqrt(inside)) / bessel_i0(np.array(BETA)), 0.0)
    taps = 2 * cutoff * np.sinc(2 * cutoff * offset) * window
    return taps / taps.sum(1, keepdims=True)


def resampled(samples: np.ndarray, source: int, target: int = RATE) -> np.ndarray:
    """Windowed-sinc resampling downwards, linear upwards; the length is n * target div source."""
    samples = np.asarray(samples, np.float32)
    n = len(samples) * target // source
    if source == target:
        return samples
    if n == 0 or len(samples) < 2:
        return np.zeros(n, np.float32)
    place = np.arange(n) * (source / target)
    cutoff = CUTOFF * target / source
    if source <= target or cutoff >= 0.5:
        return np.interp(place, np.arange(len(samples)), samples.astype(float)).astype(np.float32)
    phases, out, reach = filter_phases(cutoff), np.empty(n, np.float32), np.arange(TAPS) - TAPS // 2 + 1
    for at in range(0, n, 4096):
        p = place[at : at + 4096]
        centre = p.astype(int)
        scaled = (p - centre) * PHASES
        phase = scaled.astype(int)
        taps = phases[phase] + (phases[phase + 1] - phases[phase]) * (scaled - phase)[:, None]
        out[at : at + 4096] = (taps * samples[np.clip(centre[:, None] + reach, 0, len(samples) - 1)]).sum(1)
    return out


def hann() -> np.ndarray:
    """Periodic."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(FFT) / FFT)


def magnitudes(frames: np.ndarray, bins: int = FFT // 2) -> np.ndarray:
    """Windowed spectra of rows of at most FFT samples (zero-padded)."""
    frames = np.asarray(frames, float)
    if frames.shape[-1] < FFT:
        frames = np.pad(frames, [(0, 0)] * (frames.ndim - 1) + [(0, FFT - frames.shape[-1])])
    return np.abs(np.fft.rfft(frames * hann(), axis=-1))[..., :bins]


def reflected(index: np.ndarray, n: int) -> np.ndarray:
    """Places outside a track mirrored at its ends, which are not repeated."""
    if n <= 1:
        return np.zeros_like(index)
    period = 2 * (n - 1)
    index = np.mod(index, period)
    return np.where(index < n, index, period - index)


@cache
def mel_filterbank(bins: int = FFT // 2) -> np.ndarray:
    """MELS triangles between LOW_HZ and HIGH_HZ on the Slaney scale, not normalised by area."""
    step = np.log(6.4) / 27
    to_mel = lambda f: 3 * f / 200 if f < 1000 else 15 + np.log(f / 1000) / step
    mels = np.linspace(to_mel(LOW_HZ), to_mel(HIGH_HZ), MELS + 2)
    edges = np.where(mels < 15, 200 * mels / 3, 1000 * np.exp((mels - 15) * step))
    f = np.arange(bins) * RATE / FFT
    left, centre, right = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    rising, falling = (f - left) / np.maximum(1e-9, centre - left), (right - f) / np.maximum(1e-9, right - centre)
    return np.where((f >= left) & (f <= centre), rising, np.where((f > centre) & (f <= right), falling, 0.0))


def frame_count(samples: int) -> int:
    return 1 + samples // HOP if samples > 0 else 0


def complete_frames(samples: int) -> int:
    return 0 if samples < FFT // 2 else (samples - FFT + FFT // 2) // HOP + 1


def log_mel(samples: np.ndarray, first: int = 0, count: int | None = None, base: int = 0, total: int | None = None) -> np.ndarray:
    """Rows of log(1 + 1000 mel) for frames first .. first + count, centred on frame * HOP.

    ``samples`` may be a slice that begins at sample ``base`` of a track of ``total`` samples.
    """
    samples = np.asarray(samples, np.float32)
    total = base + len(samples) if total is None else total
    count = frame_count(total) - first if count is None else count
    if count <= 0 or total == 0:
        return np.zeros((0, MELS), np.float32)
    out = np.empty((count, MELS), np.float32)
    for at in range(0, count, 256):
        n = min(256, count - at)
        place = (first + at + np.arange(n))[:, None] * HOP - FFT // 2 + np.arange(FFT)
        spectra = magnitudes(samples[reflected(place, total) - base]) / np.sqrt(FFT)
        out[at : at + n] = np.log(1 + 1000 * (spectra @ mel_filterbank().T))
    return out


def spectra_for_flux(samples: np.ndarray) -> np.ndarray:
    """Magnitudes of frames on zero padding, as an onset envelope takes them; none below half a window."""
    samples = np.asarray(samples, np.float32)
    frames = 1 + len(samples) // HOP if len(samples) >= FFT // 2 else 0
    padded = np.pad(samples, (FFT // 2, FFT))
    return magnitudes(padded[(np.arange(frames) * HOP)[:, None] + np.arange(FFT)])


def onset_envelope(samples: np.ndarray) -> np.ndarray:
    mags = spectra_for_flux(samples).astype(np.float32).astype(float)
    flux = np.maximum(np.diff(mags, axis=0, prepend=np.zeros((1, mags.shape[1]))), 0).sum(1) if len(mags) else np.zeros(0)
    return flux / flux.mean() if len(flux) and flux.mean() > 0 else flux


def to_mono(raw: DataFrame, rate: int = RATE) -> DataFrame:
    """track_id, samples at ``rate`` from track_id, samples, channels, sample_rate."""

    @F.pandas_udf("array<float>")
    def mono(samples: pd.Series, channels: pd.Series, source: pd.Series) -> pd.Series:
        return pd.Series([resampled(mixed_down(np.asarray(x, np.float32), c), s, rate) for x, c, s in zip(samples, channels, source, strict=True)])

    return raw.select("track_id", mono("samples", "channels", "sample_rate").alias("samples"))


def mel_frames(tracks: DataFrame, chunk: int = 1500, with_total: bool = False) -> DataFrame:
    """track_id, frame, mel: a row for each frame, from slices of ``chunk`` frames and a margin of half a window.

    ``with_total`` adds total, the number of the track's frames.
    """
    n = F.size("samples")
    last = F.floor(n / HOP).cast("int")
    each = tracks.filter(n > 0).select("track_id", "samples", n.alias("total"), F.explode(F.sequence(F.lit(0), last, F.lit(chunk))).alias("first"))
    # At the ends the mirrored samples lie within the slice, too.
    low = F.greatest(F.lit(0), F.least(F.col("first") * HOP - FFT, F.col("total") - 2 * FFT))
    high = F.least(F.col("total"), F.greatest((F.col("first") + chunk) * HOP + FFT, F.lit(2 * FFT)))
    parts = each.select("track_id", "first", "total", low.alias("base"), F.slice("samples", low + 1, high - low).alias("samples"))

    def run(batches):
        for b in batches:
            track, first, total, base = (b.column(c).to_pylist() for c in ("track_id", "first", "total", "base"))
            for i, samples in enumerate(b.column("samples")):
                count = min(chunk, frame_count(total[i]) - first[i])
                mel = log_mel(samples.values.to_numpy(zero_copy_only=False), first[i], count, base[i], total[i])
                rows = framed(track[i], first[i], mel, "mel")
                yield rows.append_column("total", pa.array(np.full(rows.num_rows, frame_count(total[i]), np.int32))) if with_total else rows

    return parts.repartition("track_id", "first").mapInArrow(run, "track_id long, frame int, mel array<float>" + (", total int" if with_total else ""))


def framed(track_id: int, first: int, rows: np.ndarray, name: str) -> pa.RecordBatch:
    """A row for each frame: track_id, frame and the row's values."""
    n, width = rows.shape
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(rows.ravel()))
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, track_id, np.int64)), pa.array(np.arange(first, first + n, dtype=np.int32)), lists], ["track_id", "frame", name])


def flux_spectra(tracks: DataFrame) -> DataFrame:
    """track_id, frame, mags for ``peaks.flux``."""

    def run(batches):
        for b in batches:
            for track, samples in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                mags = spectra_for_flux(samples.values.to_numpy(zero_copy_only=False) if samples.is_valid else np.zeros(0))
                yield framed(track, 0, mags.reshape(-1, FFT // 2), "mags")

    return tracks.select("track_id", "samples").mapInArrow(run, "track_id long, frame int, mags array<double>")
