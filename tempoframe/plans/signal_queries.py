"""Queries of the front end's parts, each against the formula in SQL: filter, resampling, spectra, padding, mel bands."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tempoframe.operators import peaks as P, signal as G
from tempoframe.plans import relations as R

QUERIES, ORACLE_SQL = {}, {}
SOURCE = 32_000


def query(name: str, oracle: str):
    def put(f):
        QUERIES[name], ORACLE_SQL[name] = f, oracle
        return f

    return put


def _bessel(x: str) -> str:
    return f"list_sum(list_transform(range(0, 32), lambda k: pow(pow(({x}) / 2, k) / gamma(k + 1), 2)))"


_CUTOFF = f"(0.495 * {G.RATE} / {SOURCE})"
#: Taps of each phase: a sinc under a Kaiser window, of unit sum.
_FILTER = f"""taps AS (SELECT phase, tap, CASE WHEN abs(o / 128.0) < 1 THEN {_bessel('8.0 * sqrt(greatest(0, 1 - pow(o / 128.0, 2)))')} / {_bessel('8.0')} ELSE 0.0 END * CASE WHEN o = 0 THEN 1.0 ELSE sin(pi() * 2 * {_CUTOFF} * o) / (pi() * 2 * {_CUTOFF} * o) END AS w
        FROM (SELECT phase, tap, tap - 127 - phase / 128.0 AS o FROM (SELECT unnest(range(0, 129)) AS phase), (SELECT unnest(range(0, 256)) AS tap))),
    filter AS (SELECT phase, tap, w / sum(w) OVER (PARTITION BY phase) AS w FROM taps)"""


@query("b4_filter", f"WITH {_FILTER} SELECT s_suppkey, phase::INT AS phase, tap::INT AS tap, round(w, 9) + 0.0 AS w FROM supplier JOIN filter ON phase = s_suppkey * 37 % 129")
def filter_table(s, d):
    """The taps of the filter from 32,000 to 22,050 Hz, at the phase that each supplier asks for."""
    taps = G.filter_phases(G.CUTOFF * G.RATE / SOURCE)

    @F.pandas_udf("array<double>")
    def of(phase: pd.Series) -> pd.Series:
        return pd.Series([taps[p] for p in phase])

    asked = R.table(s, d, "supplier").select("s_suppkey", (F.col("s_suppkey") * 37 % (G.PHASES + 1)).cast("int").alias("phase"))
    rows = asked.select("s_suppkey", "phase", F.posexplode(of("phase")).alias("tap", "w"))
    return rows.withColumn("w", F.round("w", 9) + 0.0)


@query(
    "b2_downsampled",
    f"""WITH {_FILTER}, place AS (SELECT vec_id AS track_id, embedding AS e, k, k * ({SOURCE}.0 / {G.RATE}) AS p FROM (SELECT *, unnest(range(0, len(embedding) * {G.RATE} // {SOURCE})) AS k FROM embeddings)),
    split AS (SELECT *, floor(p)::INT AS c, floor((p - floor(p)) * 128)::INT AS phase, (p - floor(p)) * 128 - floor((p - floor(p)) * 128) AS rest FROM place)
    SELECT track_id, k::INT AS place, round(sum((a.w + (b.w - a.w) * rest) * e[least(greatest(c + a.tap - 127, 0), len(e) - 1) + 1]), 4) + 0.0 AS x
    FROM split JOIN filter a ON a.phase = split.phase JOIN filter b ON b.phase = split.phase + 1 AND b.tap = a.tap GROUP BY track_id, k""",
)
def downsampled(s, d):
    """The vectors as samples at 32,000 Hz."""
    raw = R.table(s, d, "embeddings").select(F.col("vec_id").alias("track_id"), F.col("embedding").alias("samples"), F.lit(1).alias("channels"), F.lit(SOURCE).alias("sample_rate"))
    return G.to_mono(raw).select("track_id", F.posexplode("samples").alias("place", "x")).withColumn("x", F.round(F.col("x").cast("double"), 4) + 0.0)


_HANN = "(0.5 - 0.5 * cos(2 * pi() * i / 1024))"
_BINS = "(SELECT unnest(range(0, 512)) AS bin)"


def _spectrum(frames: str, keys: str) -> str:
    """Magnitudes of frames (keys, i, x)."""
    return f"SELECT {keys}, bin, sqrt(pow(sum({_HANN} * x * cos(2 * pi() * ((bin * i) % 1024) / 1024)), 2) + pow(sum({_HANN} * x * sin(2 * pi() * ((bin * i) % 1024) / 1024)), 2)) AS m FROM {frames} CROSS JOIN {_BINS} GROUP BY {keys}, bin"


@query("b6_spectrum", f"WITH f AS (SELECT vec_id, (i - 1) AS i, embedding[i]::DOUBLE AS x FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)), s AS ({_spectrum('f', 'vec_id')}) SELECT vec_id AS track_id, count(*) AS bins, round(sum(m), 4) AS total, round(sum(m * bin), 2) AS weighed FROM s GROUP BY vec_id")
def spectrum(s, d):
    """Windowed spectra of the vectors, padded with zeros; sums that change with any bin or its place."""

    @F.pandas_udf("bins long, total double, weighed double")
    def of(vectors: pd.Series) -> pd.DataFrame:
        m = G.magnitudes(np.stack([np.asarray(v, float) for v in vectors])) if len(vectors) else np.zeros((0, 512))
        return pd.DataFrame({"bins": np.full(len(m), m.shape[1]), "total": m.sum(1), "weighed": m @ np.arange(m.shape[1])})

    return R.table(s, d, "embeddings").select(F.col("vec_id").alias("track_id"), of("embedding").alias("m")).select("track_id", "m.bins", F.round("m.total", 4).alias("total"), F.round("m.weighed", 2).alias("weighed"))


@query("b9_reflected", "SELECT c_custkey AS track_id, (CASE WHEN n <= 1 THEN 0 ELSE CASE WHEN r < n THEN r ELSE 2 * (n - 1) - r END END)::BIGINT AS place FROM (SELECT c_custkey, n, CASE WHEN n <= 1 THEN 0 ELSE (((c_custkey * 7 - 5000) % (2 * (n - 1))) + 2 * (n - 1)) % (2 * (n - 1)) END AS r FROM (SELECT c_custkey, c_custkey % 97 + 1 AS n FROM customer))")
def reflected(s, d):
    """Where places before, in and behind tracks of many lengths are mirrored to."""

    @F.pandas_udf("long")
    def of(place: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([int(G.reflected(np.array([p]), k)[0]) for p, k in zip(place, n, strict=True)])

    return R.table(s, d, "customer").select(F.col("c_custkey").alias("track_id"), of(F.col("c_custkey") * 7 - 5000, F.col("c_custkey") % 97 + 1).alias("place"))


_MEL = "CASE WHEN {f} < 1000 THEN 3 * {f} / 200.0 ELSE 15 + ln({f} / 1000.0) / (ln(6.4) / 27) END"
_EDGE = "CASE WHEN {m} < 15 THEN 200 * ({m}) / 3 ELSE 1000 * exp((({m}) - 15) * (ln(6.4) / 27)) END"
_LOW, _HIGH = _MEL.format(f="30.0"), _MEL.format(f="11000.0")
_BANK = f"""edges AS (SELECT k, {_EDGE.format(m='m')} AS f FROM (SELECT k, ({_LOW}) + (({_HIGH}) - ({_LOW})) * k / 129.0 AS m FROM (SELECT unnest(range(0, 130)) AS k))),
    bank AS (SELECT band, bin, CASE WHEN f >= l AND f <= c THEN (f - l) / greatest(1e-9, c - l) WHEN f > c AND f <= r THEN (r - f) / greatest(1e-9, r - c) ELSE 0.0 END AS w
        FROM (SELECT a.k AS band, a.f AS l, b.f AS c, e.f AS r, bin, bin * {G.RATE} / 1024.0 AS f FROM edges a JOIN edges b ON b.k = a.k + 1 JOIN edges e ON e.k = a.k + 2 CROSS JOIN {_BINS}))"""


@query("b10_mel_bands", f"WITH {_BANK} SELECT s_suppkey, band::INT AS band, bin::INT AS bin, round(w, 9) AS w FROM supplier JOIN bank ON band = s_suppkey * 37 % 128")
def mel_bands(s, d):
    """The weight of each bin in the band that each supplier asks for."""

    @F.pandas_udf("array<double>")
    def of(band: pd.Series) -> pd.Series:
        return pd.Series([G.mel_filterbank()[b] for b in band])

    asked = R.table(s, d, "supplier").select("s_suppkey", (F.col("s_suppkey") * 37 % G.MELS).cast("int").alias("band"))
    rows = asked.select("s_suppkey", "band", F.posexplode(of("band")).alias("bin", "w"))
    return rows.withColumn("w", F.round("w", 9))


def short_tones(s, d):
    """For each region 1,200 samples that repeat: three frames."""
    value = lambda i: (((i * (7 + F.col("r_regionkey"))) % 64 - 32) / F.lit(64.0)).cast("float")
    return R.table(s, d, "region").select(F.col("r_regionkey").cast("long").alias("track_id"), F.transform(F.sequence(F.lit(0), F.lit(1199)), value).alias("samples"))


def _tone(i: str) -> str:
    return f"((({i}) * (7 + track_id)) % 64 - 32) / 64.0"


_FRAMES = "(SELECT r_regionkey::BIGINT AS track_id, unnest(range(0, 3)) AS frame FROM region) CROSS JOIN (SELECT unnest(range(0, 1024)) AS i)"
_MIRROR = "(((frame * 441 - 512 + i) % 2398) + 2398) % 2398"


@query(
    "b12_log_mel",
    f"WITH {_BANK}, f AS (SELECT track_id, frame, i, {_tone('CASE WHEN r < 1200 THEN r ELSE 2398 - r END')} AS x FROM (SELECT *, {_MIRROR} AS r FROM {_FRAMES})), s AS ({_spectrum('f', 'track_id, frame')})"
    " SELECT track_id, frame::INT AS frame, band::INT AS band, round(ln(1 + 1000 * sum(m / 32 * w)), 3) + 0.0 AS x FROM s JOIN bank USING (bin) GROUP BY track_id, frame, band",
)
def log_mel(s, d):
    """Log-mel spectra of short tracks, mirrored at both ends."""
    return G.mel_frames(short_tones(s, d)).select("track_id", "frame", F.posexplode("mel").alias("band", "x")).withColumn("x", F.round(F.col("x").cast("double"), 3) + 0.0)


@query(
    "b13_onsets",
    f"WITH f AS (SELECT track_id, frame, i, CASE WHEN p BETWEEN 0 AND 1199 THEN {_tone('p')} ELSE 0.0 END AS x FROM (SELECT *, frame * 441 - 512 + i AS p FROM {_FRAMES})), s AS ({_spectrum('f', 'track_id, frame')}),"
    " g AS (SELECT track_id, frame, greatest(0, m - coalesce(lag(m) OVER (PARTITION BY track_id, bin ORDER BY frame), 0)) AS up FROM s), u AS (SELECT track_id, frame, sum(up) AS flux FROM g GROUP BY track_id, frame)"
    " SELECT track_id, frame::INT AS frame, round(flux / avg(flux) OVER (PARTITION BY track_id), 5) AS flux FROM u",
)
def onsets(s, d):
    """Onset strength of short tracks, padded with zeros."""
    return P.flux(G.flux_spectra(short_tones(s, d))).withColumn("flux", F.round("flux", 5))
