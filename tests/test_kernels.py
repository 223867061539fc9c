"""Order-dependent kernels and the front end, on synthetic tracks with known answers."""

import math
import random

import numpy as np
import pytest

from tempoframe.operators import kernels as K, scoring as S, search, signal as G
from tempoframe.operators.kernels import beat_frames, raw_peaks
from tempoframe.streaming.tracker import TrackState


def steady(n, step=300.0, start=0.0):
    return start + step * np.arange(n)


def test_merge_pairs_and_plateaus():
    curve = np.full(64, -1.0)
    curve[10:13], curve[20], curve[30:32] = 2.0, 3.0, 1.5
    assert raw_peaks(curve).tolist() == [pytest.approx(x, abs=0.5) for x in (10.5, 12.0, 20.0, 30.5)]
    for values, place in (((4, 1), (5, 2), (6, 1.5)), 5 + 0.5 * (1 - 1.5) / (1 - 4 + 1.5)), (((4, 1.5), (5, 2), (6, 1)), 5 + 0.5 * (1.5 - 1) / (1.5 - 4 + 1)), (((5, 2), (6, 2)), 5.5), (((7, 2),), 7.0):
        curve = np.zeros(16)
        for i, v in values:
            curve[i] = v
        assert raw_peaks(curve).tolist() == [pytest.approx(place)]
    assert len(raw_peaks(np.full(20, -1.0))) == 0


def running_mean_groups(peaks):
    out, place, count = [], None, 0
    for p in peaks:
        if count and p - place <= 1:
            count += 1
            place += (p - place) / count
        else:
            if count:
                out.append((place, count))
            place, count = float(p), 1
    return out + ([(place, count)] if count else [])


def test_pairing_equals_the_running_mean():
    rng = random.Random(1)
    for _ in range(500):
        peaks = sorted(rng.sample(range(60), rng.randrange(0, 40)))
        pairs, i = [], 0
        while i < len(peaks):
            two = i + 1 < len(peaks) and peaks[i + 1] == peaks[i] + 1
            pairs.append((peaks[i] + 0.5, 2) if two else (float(peaks[i]), 1))
            i += 2 if two else 1
        assert pairs == running_mean_groups(peaks)


def test_suppression():
    beats = np.zeros(64)
    beats[20], beats[22] = 0.9, 0.4
    assert K.suppress(beats, np.full(64, 25.0)).tolist() == [20]
    beats[22], beats[40] = 0.9, 0.5
    assert K.suppress(beats, np.full(64, 25.0)).tolist() == [20, 40]


def plain_path(beats, rigidity=12.0, floor=0.0, low=8, high=60):
    """All states one after the other, forwards."""
    n, steps = len(beats), range(low, high + 1)
    reward = [b - sum(beats) / n - floor for b in beats]
    score = {(t, s): reward[t] for t in range(n) for s in steps}
    origin = {}
    for t in range(n):
        for s in steps:
            for to in steps:
                if t + to < n:
                    value = score[t, s] + reward[t + to] - rigidity * abs(math.log(to / s))
                    if value > score[t + to, to]:
                        score[t + to, to], origin[t + to, to] = value, (t, s)
    best = max(score.values())
    at = min(k for k, v in score.items() if v == best)
    path = [at[0]]
    while at in origin:
        at = origin[at]
        path.append(at[0])
    return path[::-1]


def test_best_path():
    rng = np.random.default_rng(2)
    for n in (9, 40, 90):
        curve = rng.normal(size=n)
        assert search.best_path(curve).tolist() == plain_path(curve.tolist())
    curve = np.full(400, -1.0)
    curve[5::20] = 3.0
    assert search.best_path(curve).tolist() == list(range(5, 400, 20))
    assert len(search.best_path(np.ones(8))) == 0


def test_regularising():
    assert len(K.regularised(steady(40))) == 40
    assert len(K.regularised(np.sort(np.append(steady(40), 6150.0)))) == 40
    assert len(K.regularised(np.delete(steady(52), np.arange(3, 50, 4)))) >= 50
    broken = np.concatenate((steady(20), steady(20, start=10_000.0)))
    out = K.regularised(broken)
    assert len(out) == 40 and not ((out > 5900) & (out < 9900)).any()
    change = np.concatenate((steady(40), 11_700 + 200.0 * np.arange(1, 41)))
    assert len(K.regularised(change)) >= len(change) - 2
    assert K.regularised(steady(3)).tolist() == steady(3).tolist()


def test_sections():
    assert [s[2] for s in K.tempo_sections(steady(401))] == [300.0]
    two = np.concatenate(([0.0], np.cumsum([300.0] * 200 + [400.0] * 200)))
    found = K.tempo_sections(two)
    assert [s[2] for s in found] == [300.0, 400.0] and 60_000 <= found[1][0] + 16 * 300 and found[1][0] <= 60_000 + 16 * 300
    for i, gap in ((100, 600.0), (100, 900.0), (100, 400.0)):
        gaps = np.full(300, 300.0)
        gaps[i : i + (3 if gap == 900.0 else 1)] = gap
        assert len(K.tempo_sections(np.concatenate(([0.0], np.cumsum(gaps))))) == 1
    spans = K.tempo_sections(np.concatenate(([0.0], np.cumsum([300.0] * 100 + [600.0] + [300.0] * 100))))
    assert all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False)) and K.tempo_sections(steady(2)) == []


def test_even_beats():
    def laid(extra):
        gaps = np.full(239, 417.0)
        gaps[100 : 100 + len(extra)] = extra
        return K.even_beats(np.concatenate(([0.0], np.cumsum(gaps))))

    assert abs(len(laid([200.0, 217.0])) - 239) <= 1 and abs(len(laid([834.0])) - 241) <= 1
    assert np.allclose(np.diff(laid([])), 417.0) and K.even_beats(steady(5)) is None


def test_tempo_at():
    beats = steady(60, 500.0)
    beats = np.concatenate((beats[:30], beats[30:] + 500.0))
    assert abs(K.bpm_at(beats, np.array([15_000.0]))[0] - 120) < 1 and K.bpm_at(beats[:1], np.zeros(1))[0] == 0
    two = np.concatenate((steady(60, 500.0), 30_000 + 250.0 * np.arange(60)))
    assert K.bpm_at(two, np.array([10_000.0, 40_000.0])).tolist() == [120.0, 240.0]


def test_pruning_and_coalescing():
    places = np.sort(np.append(np.arange(20) * 20.0, 105.0))
    curve = np.ones(400)
    curve[100] = 2.0
    assert K.prune(places, curve).sum() == 20
    found = K.coalesced(np.array([0.0, 10.0, 20.0]), np.array([300.0, 300.2, 310.0]), 50.0)
    assert found == [(0.0, 20.0, 300.0), (20.0, 50.0, 310.0)]


def test_phase_snap():
    curve = np.zeros(2000)
    curve[::20] = 5.0
    beats = 400.0 * np.arange(60)
    moved = beats.copy()
    moved[30] += 60.0
    out = K.snapped(moved, curve)
    assert abs(out[30] - beats[30]) < abs(moved[30] - beats[30]) and np.abs(np.delete(out - beats, 30)).max() < 20
    assert K.snapped(beats[:3], curve).tolist() == beats[:3].tolist()


def test_resampling():
    t = np.arange(44_100) / 44_100
    high = G.resampled(np.sin(2 * np.pi * 16_000 * t), 44_100)
    assert np.sqrt(np.mean(high[200:-200] ** 2)) < 0.01 * np.sqrt(0.5)
    for hz, db in ((440, 0.3), (8000, 1.0)):
        kept = G.resampled(np.sin(2 * np.pi * hz * t), 44_100)[500:-500]
        assert abs(20 * math.log10(np.sqrt(np.mean(kept**2)) / np.sqrt(0.5))) < db
    opposite = np.stack((np.sin(2 * np.pi * 440 * t), -np.sin(2 * np.pi * 440 * t)), axis=1).ravel()
    assert np.abs(G.mixed_down(opposite, 2)).max() < 1e-6
    assert len(G.resampled(np.zeros(44_101), 44_100)) == 22_050 and len(G.resampled(np.arange(10), 11_025)) == 20


def test_spectra():
    tone = np.sin(2 * np.pi * 1000 * np.arange(22_050) / G.RATE).astype(np.float32)
    mel = G.log_mel(tone)
    assert mel.shape == (51, 128)
    centre = np.argmax(G.mel_filterbank() @ np.eye(512)[round(1000 * 1024 / G.RATE)])
    assert abs(int(np.argmax(mel[20])) - centre) <= 1
    part = G.log_mel(tone[9 * G.HOP :], 12, 20, 9 * G.HOP, len(tone))
    assert np.array_equal(part, mel[12:32])
    assert np.array_equal(G.magnitudes(np.ones(16)), G.magnitudes(np.pad(np.ones(16), (0, 1008))))
    assert [G.frame_count(n) for n in (0, 1, 441, 882)] == [0, 1, 2, 3] and G.complete_frames(511) == 0 and G.complete_frames(512) == 1
    clicks = np.zeros(44_100, np.float32)
    clicks[::11_025] = 1.0
    envelope = G.onset_envelope(clicks)
    assert abs(envelope.mean() - 1) < 1e-9 and len(G.onset_envelope(clicks[:100])) == 0
    assert set(np.argsort(-envelope)[:4] // 25) <= {0, 1, 2, 3, 4}


def test_chunks_own_every_frame():
    for total in [1, 5, 13, 1487, 1488, 1489, 1494, 1500, 2976, 2977, 2981, 4470]:
        mel = np.random.default_rng(total).normal(size=(total, 4)).astype(np.float32)
        own = lambda m: (m[:, 0], m[:, 1])
        a, b = S.scored(mel, own)
        assert np.array_equal(a, mel[:, 0]) and np.array_equal(b, mel[:, 1])


@pytest.mark.parametrize("seconds", [0.3, 12.0, 29.9, 31.0, 75.0])
def test_streaming_equals_batch(seconds):
    rng = np.random.default_rng(int(seconds * 10))
    samples = rng.normal(size=int(seconds * G.RATE)).astype(np.float32) * 0.01
    samples[:: G.RATE // 2] += 1.0
    mel = G.log_mel(samples)
    curve, downbeats = S.scored(mel, S.band_scorer)
    track, found, at, given = TrackState(), [], 0, []
    while at < len(samples):
        n = int(rng.integers(1000, 60_000))
        found += track.add(samples[at : at + n])
        given.append(track.scored())
        at += n
    assert len(track.samples) < 2 * S.CHUNK * G.HOP + 100_000
    found += track.flush()
    frames, beat, downbeat = (np.concatenate(x) for x in zip(*given, track.scored(), strict=True))
    assert track.flush() == [] and frames.tolist() == list(range(len(curve))) and np.allclose(beat, curve) and np.allclose(downbeat, downbeats)
    batch = beat_frames(curve)
    assert len(found) == len(batch) and np.allclose(found, batch)
    with pytest.raises(ValueError):
        track.add(samples[:10])


def test_a_stream_of_silence_keeps_a_short_tail():
    rng, track = np.random.default_rng(3), TrackState()
    size = 0
    for minute in range(10):
        piece = np.zeros(60 * G.RATE, np.float32)
        if minute in (1, 7):
            piece[:: G.RATE // 2] = 1.0
        track.add(piece)
        track.scored()
        size = max(size, len(track.curve), len(track.places))
    assert size < 3 * S.CHUNK and len(track.samples) < 4 * S.CHUNK * G.HOP


def test_a_stream_in_any_pieces_gives_the_beats_of_the_whole():
    rng = np.random.default_rng(9)
    curve = np.full(9000, -1.0, np.float32)
    places = np.cumsum(rng.integers(21, 26, 350))
    curve[places] = 2.0
    curve[places[::9] + 6] = 1.0  # early ones, which go
    curve[4000:6500] = -1.0
    track, found, at = TrackState(), [], 0
    while at < len(curve):
        n = int(rng.integers(1, 700))
        part = curve[at : at + n]
        track._write(at, part, part)
        found += track._settled(False)
        at += n
    found += track._settled(True)
    assert np.allclose(found, beat_frames(curve))


# Slow versions of the kernels, loop by loop.
def upper(values):
    return sorted(values)[len(values) // 2] if values else 0.0


def slow_cluster(gaps):
    if len(gaps) < 3:
        return upper(gaps)
    best, most = 0.0, 0
    for c in gaps:
        near = [g for g in gaps if 0.75 * c <= g <= 1.25 * c]
        if len(near) > most or len(near) == most and c > best:
            best, most = upper(near), len(near)
    return best


def slow_prune(places, curve):
    keep = [True] * len(places)
    value = lambda p: curve[min(len(curve) - 1, max(0, math.floor(p + 0.5)))]
    for _ in range(8):
        for i in range(len(places) - 1):
            if len(places) < 3 or not (keep[i] and keep[i + 1]):
                continue
            gaps = [places[j + 1] - places[j] for j in range(max(0, i - 32), min(len(places) - 1, i + 32)) if keep[j] and keep[j + 1]]
            period = slow_cluster(gaps)
            if period > 0 and (places[i + 1] - places[i]) / period < 0.7:
                keep[i + 1 if value(places[i]) >= value(places[i + 1]) else i] = False
    return keep


def slow_suppress(strength, periods, share):
    left, out = sorted(range(len(strength)), key=lambda i: (-strength[i], i)), []
    for i in left:
        if strength[i] >= 0.5 and all(abs(i - j) >= int(max(1.0, share * periods[j])) for j in out):
            out.append(i)
    return sorted(out)


def slow_modal(beats, window=16):
    gaps, out = [b - a for a, b in zip(beats, beats[1:], strict=False)], []
    for i in range(len(beats)):
        near = sorted(gaps[max(0, i - window) : min(len(beats) - 1, i + window)])
        votes = [(sum(0.75 * c <= g <= 1.25 * c for g in near), -c) for c in near]
        out.append(-max(votes)[1] if len(near) >= 3 else 0.0)
    return out


def slow_dominant(beats, periods):
    best, most = 0.0, 0.0
    for i in range(len(beats) - 1):
        held = round(sum(beats[j + 1] - beats[j] for j in range(len(beats) - 1) if 0.75 * periods[i] <= periods[j] <= 1.25 * periods[i]), 6) if periods[i] > 0 else 0.0
        if held > most:
            best, most = periods[i], held
    return best


def slow_regularised(beats):
    if len(beats) < 4:
        return list(beats)
    periods = slow_modal(beats)
    dominant, out, anchor = slow_dominant(beats, periods), [beats[0]], beats[0]
    for b, p in zip(beats[1:], periods[1:], strict=True):
        for _ in range(8 if p > 0 and dominant > 0 else 0):
            p = p / 2 if p / dominant >= 1.5 else p * 2 if p / dominant <= 0.59 else p
        if p > 0 and (b - anchor) / p < 0.85:
            continue
        if p > 0 and 1.45 < (b - anchor) / p <= 5:
            n = round((b - anchor) / p)
            out += [anchor + k * ((b - anchor) / n) for k in range(1, n)]
        out.append(b)
        anchor = b
    return out


def slow_bpm(beats, t):
    if len(beats) < 2:
        return 0.0
    c, last = max(0, sum(b <= t for b in beats) - 1), len(beats) - 1
    low, high = max(0, c - 6), min(last, c + 6)
    while beats[high] - beats[low] < 2000 and (low > 0 or high < last):
        low, high = max(0, low - 1), min(last, high + 1)
    gaps = [beats[j + 1] - beats[j] for j in range(low, high)]
    turns = [b - a for a, b in zip(gaps, gaps[1:], strict=False)]
    steady = len(gaps) > 3 and 10 * max(sum(x > 0 for x in turns), sum(x < 0 for x in turns)) >= 7 * len(turns)
    s = sorted(gaps)
    period = (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2
    if period <= 0:
        return 0.0
    if not steady and 3 * sum(0.85 * period <= g <= 1.15 * period for g in gaps) < 2 * len(gaps):
        more = [beats[j + 1] - beats[j] for j in range(max(0, c - 48), min(last, c + 48))]
        if len(more) > len(gaps) and upper(more) > 0:
            period = upper(more)
    return 60000 / period


def slow_sections(gaps, changed, persistence, shortest):
    """Start of each section: gap by gap, with the run of changes that is under way."""
    starts, begin = [0], 0
    while begin is not None:
        first = last = found = None
        for i in range(begin + shortest, len(gaps)):
            if not changed[i]:
                continue
            if first is None or i - last > 2:
                if first is not None and last - first + 1 >= persistence:
                    break
                first = i
            last = i
        if first is not None and last - first + 1 >= persistence:
            found = first
            starts.append(found)
        begin = found
    return starts


def slow_coalesced(times, lengths, until):
    out = []
    for i, (t, x) in enumerate(zip(times, lengths, strict=True)):
        end = times[i + 1] if i + 1 < len(times) else max(until, t)
        if out and abs(x - out[-1][2]) <= 0.001 * out[-1][2]:
            out[-1] = (out[-1][0], end, out[-1][2])
        else:
            out.append((t, end, x))
    return out


def random_beats(rng):
    n, period = rng.randrange(0, 160), rng.choice([120.0, 300.0, 470.0])
    out, t = [], rng.uniform(0, 900)
    for i in range(n):
        if rng.random() < 0.04:
            period *= rng.choice([0.5, 0.8, 1.1, 1.3, 2.0])
        out.append(t)
        t += period * rng.choice([1, 1, 1, 1, 1, 0.4, 2, 3, 7]) * rng.uniform(0.95, 1.05)
    return out


def test_kernels_equal_their_slow_versions():
    rng = random.Random(23)
    for _ in range(80):
        curve = np.array([rng.uniform(-1, 1) for _ in range(rng.randrange(4, 400))])
        places = raw_peaks(curve)
        assert K.prune(places, curve).tolist() == slow_prune(places.tolist(), curve)
        strength, periods = np.abs(curve).round(2), np.array([rng.uniform(0, 40) for _ in curve])
        assert K.suppress(strength, periods, 0.6).tolist() == slow_suppress(strength.tolist(), periods.tolist(), 0.6)
        own = random_beats(rng)
        beats = np.array(own)
        assert K.modal_periods(beats).tolist() == slow_modal(own)
        assert K.dominant_period(beats, K.modal_periods(beats)) == (slow_dominant(own, slow_modal(own)) if len(own) > 1 else 0.0)
        assert K.regularised(beats).tolist() == slow_regularised(own)
        times = np.array(sorted(rng.uniform(-500, 60_000) for _ in range(20)))
        assert K.bpm_at(beats, times).tolist() == pytest.approx([slow_bpm(own, t) for t in times])
        gaps = K.robust(np.diff(beats)) if len(own) > 1 else np.zeros(0)
        changed = K.flags_of_change(gaps, 8, 0.06) if len(gaps) else np.zeros(0, bool)
        for persistence, shortest in ((3, 4), (6, 6), (12, 16)):
            assert K.boundaries(changed, persistence, shortest) == slow_sections(gaps, changed, persistence, shortest)
        lengths = [rng.choice([300.0, 300.1, 300.4, 450.0]) for _ in times]
        assert K.coalesced(times, np.array(lengths), 30_000.0) == slow_coalesced(times.tolist(), lengths, 30_000.0)


def test_even_beats_by_a_slow_version():
    rng = random.Random(29)
    for _ in range(60):
        own = random_beats(rng)
        beats, out = np.array(own), []
        for start, end, period in K.tempo_sections(beats):
            at = next(b for b in own if b >= start - 0.5)
            while period > 0 and at < end:
                if (not out or at > out[-1] + period / 2) and at >= own[0] - period / 2:
                    out.append(at)
                at += period
        laid = K.even_beats(beats)
        assert (None if laid is None else laid.tolist()) == (out if len(own) >= 8 and len(out) >= 4 else None)


def slow_snapped(beats, curve):
    """Beat by beat and lag by lag, on plain lists."""
    out = list(beats)
    dominant = slow_dominant(beats, slow_modal(beats)) if len(beats) >= 4 else 0.0
    if len(beats) < 6 or len(curve) < 200 or dominant <= 0:
        return out

    def correlation(centre, lag):
        low, high = max(centre - 50, 0), min(centre + 50, len(curve) - 1 - lag)
        if high - low < 4 * lag:
            return 0.0
        mean = sum(curve[low:high]) / (high - low)
        var = sum((curve[i] - mean) ** 2 for i in range(low, high))
        return sum((curve[i] - mean) * (curve[i + lag] - mean) for i in range(low, high)) / var if var > 0 else 0.0

    told = []
    for t in beats:
        r = [correlation(round(t / 20.0), lag) for lag in range(9, 52)]
        tops = [((i + 9) * 20.0, r[i]) for i in range(1, 42) if r[i] > 0 and r[i] >= r[i - 1] and r[i] >= r[i + 1]]
        most = max((v for _, v in tops), default=0.0)
        told.append(min(((abs(p - dominant), k, p, v) for k, (p, v) in enumerate(tops) if v >= 0.75 * most), default=(0, 0, 0.0, 0.0))[2:])
    trusted = [p > 0 and v >= 0.05 and 0.75 <= p / dominant <= 1.35 for p, v in told]
    i = 0
    while i < len(beats):
        j = i
        while j < len(beats) and trusted[j]:
            j += 1
        if j - i >= 6:
            q = upper([told[k][0] for k in range(i, j)])
            turn = lambda x, q=q: math.fmod(math.fmod(x, q) + 1.5 * q, q) - q / 2
            places = [min(11, max(0, math.floor((turn(out[k]) + q / 2) / (q / 12)))) for k in range(i, j)]
            counts = [places.count(b) for b in range(12)]
            modal = counts.index(max(counts))
            if counts[modal] >= 0.55 * (j - i):
                centre = -q / 2 + (modal + 0.5) * q / 12
                near = [d for d in (turn(turn(out[k]) - centre) for k in range(i, j)) if abs(d) <= q / 12]
                phase = turn(centre + sum(near) / len(near)) if near else centre
                for k in range(i, j):
                    move = turn(out[k] - phase)
                    out[k] -= move if abs(move) <= 0.35 * q else 0
        i = max(j, i + 1)
    return out


def test_phase_snapping_by_a_slow_version():
    rng, moved = random.Random(31), 0
    for _ in range(12):
        frames, period = 900, rng.choice([20, 25, 31])
        curve = [rng.random() * 0.3 + (i % period == 3) for i in range(frames)]
        beats = [t for k in range(2, frames // period - 1) if (t := (k * period + 3) * 20.0 + rng.uniform(-40, 40)) and rng.random() > 0.1]
        got = K.snapped(np.array(beats), np.array(curve))
        assert got.tolist() == pytest.approx(slow_snapped(beats, curve))
        moved += int((np.abs(got - beats) > 1).sum())
    assert moved > 50
