"""Queries of gap, tempo and octave operators (E), lookups (F) and peaks (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempoframe.functions import numeric as N
from tempoframe.operators import asof, beats as B, peaks as P
from tempoframe.plans import relations as R
from tempoframe.plans.relations import sql, upper

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return put


E1 = sql("beats", "gaps", then="SELECT track_id, beat_ms, gap_ms FROM gaps")


@query("e1_intervals", E1)
def e1_intervals(s, d):
    return B.intervals(R.beats(s, d))


@query(
    "e1_track_tempo",
    sql("beats", "gaps", then=f"""
    , t AS (SELECT track_id, list(gap_ms) AS g FROM gaps WHERE gap_ms > 0 GROUP BY track_id), m AS (SELECT track_id, g, {upper('g')} AS median_gap_ms FROM t)
    SELECT track_id, len(g) AS gaps, median_gap_ms, {upper('list_transform(g, lambda x: abs(x - median_gap_ms))')} AS mad_gap_ms, 60000 / median_gap_ms AS bpm FROM m"""),
)
def e1_track_tempo(s, d):
    return B.track_tempo(R.beats(s, d))


@query(
    "e2_beat_lengths",
    sql("beats", then="""SELECT track_id, beat_ms, coalesce(lead(beat_ms) OVER w - beat_ms, beat_ms - lag(beat_ms) OVER w, 0.0) AS length_ms FROM beats WINDOW w AS (PARTITION BY track_id ORDER BY beat_ms)"""),
)
def e2_beat_lengths(s, d):
    return B.beat_lengths(R.beats(s, d))


_PERIOD = """, around AS (SELECT a.track_id, a.i, a.beat_ms, b.i AS j, b.gap_ms AS g FROM idx a JOIN idx b ON a.track_id = b.track_id AND b.i BETWEEN a.i - 16 AND a.i + 15 WHERE b.gap_ms IS NOT NULL),
    votes AS (SELECT c.track_id, c.i, c.g, count(*) AS n FROM around c JOIN around o ON c.track_id = o.track_id AND c.i = o.i AND o.g >= c.g * 0.75 AND o.g <= c.g * 1.25 GROUP BY c.track_id, c.i, c.j, c.g),
    best AS (SELECT track_id, i, g FROM votes QUALIFY row_number() OVER (PARTITION BY track_id, i ORDER BY n DESC, g) = 1),
    many AS (SELECT track_id, i, count(*) AS k FROM around GROUP BY ALL),
    periods AS (SELECT x.track_id, x.beat_ms, x.i, x.n, x.gap_ms, CASE WHEN coalesce(k, 0) < 3 THEN 0.0 ELSE g END AS period_ms FROM idx x LEFT JOIN best USING (track_id, i) LEFT JOIN many USING (track_id, i))"""


@query("e3_local_period", sql("beats", "idx", then=_PERIOD + " SELECT track_id, beat_ms, period_ms FROM periods"))
def e3_local_period(s, d):
    return B.local_periods(R.beats(s, d))


@query(
    "e4_dominant_period",
    sql("beats", "idx", then=_PERIOD + """, w AS (SELECT c.track_id, c.i, c.period_ms, round(sum(o.gap_ms), 6) AS w FROM periods c JOIN periods o ON c.track_id = o.track_id AND o.gap_ms IS NOT NULL AND o.period_ms >= c.period_ms * 0.75 AND o.period_ms <= c.period_ms * 1.25
        WHERE c.gap_ms IS NOT NULL AND c.period_ms > 0 AND c.n >= 4 GROUP BY ALL),
    top AS (SELECT track_id, period_ms FROM w QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY w DESC, i) = 1)
    SELECT track_id, coalesce(period_ms, 0.0) AS dominant_ms FROM (SELECT DISTINCT track_id FROM beats) LEFT JOIN top USING (track_id)"""),
)
def e4_dominant_period(s, d):
    return B.dominant_periods(R.beats(s, d))


@query(
    "e6_share_in_range",
    sql("beats", "gaps", then="SELECT track_id, avg(CASE WHEN 60000 / gap_ms / 2.0 >= 80 AND 60000 / gap_ms / 2.0 < 220 THEN 1.0 ELSE 0.0 END) AS share FROM gaps WHERE gap_ms > 0 GROUP BY track_id"),
)
def e6_share_in_range(s, d):
    return B.share_in_range(B.intervals(R.beats(s, d), positive=True), 1)


_SHIFT = """, s AS (SELECT * FROM (VALUES (0, 0), (1, 1), (2, -1), (3, 2), (4, -2), (5, 3), (6, -3), (7, 4), (8, -4)) AS t(place, shift)),
    c AS (SELECT track_id, place, shift, count(*) FILTER (WHERE 60000 / gap_ms / pow(2.0, shift) >= 80 AND 60000 / gap_ms / pow(2.0, shift) < 220) AS inside, count(*) AS n,
          count(*) FILTER (WHERE 60000 / gap_ms < 80) AS below, count(*) FILTER (WHERE 60000 / gap_ms >= 220) AS above FROM gaps CROSS JOIN s WHERE gap_ms > 0 GROUP BY ALL),
    b AS (SELECT track_id, CASE WHEN below < {m} * n AND above < {m} * n THEN 0 WHEN inside / n >= {m} THEN shift ELSE 0 END AS shift FROM c QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY inside DESC, place) = 1),
    shifts AS (SELECT track_id, coalesce(shift, 0) AS shift FROM (SELECT DISTINCT track_id FROM beats) LEFT JOIN b USING (track_id))"""


@query("e7_choose_shift", sql("beats", "gaps", then=_SHIFT.format(m=0.5) + " SELECT track_id, shift FROM shifts"))
def e7_choose_shift(s, d):
    return B.choose_shift(R.beats(s, d), majority=0.5)


_BPMS = "60000 / gap_ms"


@query(
    "e8_shift_for",
    sql("beats", "gaps", then=f"SELECT track_id, beat_ms, CASE WHEN {_BPMS} <= 0 OR ({_BPMS} >= 80 AND {_BPMS} < 220) THEN 0 " + " ".join(f"WHEN {_BPMS} / {2**k} >= 80 AND {_BPMS} / {2**k} < 220 THEN {k} WHEN {_BPMS} * {2**k} >= 80 AND {_BPMS} * {2**k} < 220 THEN {-k}" for k in range(1, 5)) + " ELSE 0 END AS shift FROM gaps WHERE gap_ms > 0"),
)
def e8_shift_for(s, d):
    return B.intervals(R.beats(s, d), positive=True).select("track_id", "beat_ms", N.shift_for(60000 / F.col("gap_ms")).alias("shift"))


_APPLY = """, moved AS (SELECT x.track_id, s.shift, x.beat_ms, x.gap_ms, x.i, unnest(CASE WHEN s.shift >= 0 THEN CASE WHEN x.i % (1 << greatest(s.shift, 0)) = 0 THEN [0] ELSE []::BIGINT[] END WHEN x.gap_ms IS NULL THEN [0] ELSE range(1 << greatest(-s.shift, 0)) END) AS k FROM idx x JOIN shifts s USING (track_id))
    SELECT track_id, {shift}, {index} CASE WHEN k = 0 THEN beat_ms ELSE beat_ms + gap_ms * k / (1 << greatest(-shift, 0)) END AS beat_ms FROM moved"""


@query(
    "e9_apply_shift",
    sql("beats", "idx", then=", shifts AS (SELECT DISTINCT track_id, (track_id % 5 - 2)::INT AS shift FROM beats)" + _APPLY.format(shift="shift", index="")),
)
def e9_apply_shift(s, d):
    return B.apply_shift(R.beats(s, d), R.beats(s, d).select("track_id").distinct().withColumn("shift", (F.col("track_id") % 5 - 2).cast("int")))


@query("e10_normalise", sql("beats", "gaps", "idx", then=_SHIFT.format(m=0.5) + _APPLY.format(shift="shift", index="")))
def e10_normalise(s, d):
    return B.normalise(R.beats(s, d), majority=0.5)


@query(
    "e17_grid_from_beats",
    sql("beats", "gaps", "idx", then=_SHIFT.format(m=0.8) + _APPLY.format(shift="shift AS metrical_shift", index="row_number() OVER (PARTITION BY track_id ORDER BY i, k) - 1 AS beat_idx,")),
)
def e17_grid_from_beats(s, d):
    return B.grid_from_beats(R.beats(s, d))


@query("e18_grid_from_stored", sql("beats", "idx", then="SELECT track_id, beat_ms, 1 AS metrical_shift, i AS beat_idx FROM idx"))
def e18_grid_from_stored(s, d):
    return B.grid_from_stored(R.beats(s, d), 1)


@query("e19_offset", sql("beats", then="SELECT track_id, beat_ms + 12.5 AS beat_ms FROM beats"))
def e19_offset(s, d):
    return B.with_offset(R.beats(s, d), 12.5)


_ROBUST = """, g AS (SELECT track_id, i AS gap_idx, beat_ms, gap_ms FROM idx WHERE gap_ms IS NOT NULL),
    a AS (SELECT *, list_concat(coalesce(list(gap_ms) OVER (w ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), []), coalesce(list(gap_ms) OVER (w ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING), [])) AS near FROM g WINDOW w AS (PARTITION BY track_id ORDER BY gap_idx)),
    l AS (SELECT *, list_sort(near)[len(near) // 2 + 1] AS m FROM a),
    r AS (SELECT track_id, gap_idx, beat_ms, gap_ms, CASE WHEN len(near) < 3 OR m <= 0 THEN gap_ms WHEN (greatest(1, round_even(gap_ms / m, 0)) >= 2 AND abs(gap_ms - greatest(1, round_even(gap_ms / m, 0)) * m) <= 0.25 * m) OR abs(gap_ms - m) > 0.25 * m THEN m ELSE gap_ms END AS robust_ms FROM l)"""


@query("e11_robust_gaps", sql("beats", "idx", then=_ROBUST + " SELECT track_id, gap_idx, beat_ms, gap_ms, robust_ms FROM r"))
def e11_robust_gaps(s, d):
    return B.robust_gaps(R.beats(s, d))


@query(
    "e12_change_flags",
    sql("beats", "idx", then=_ROBUST + f""", nf AS (SELECT *, list(robust_ms) OVER (w ROWS BETWEEN 16 PRECEDING AND 15 FOLLOWING) AS nl, list(robust_ms) OVER (w ROWS BETWEEN 33 PRECEDING AND 17 PRECEDING) AS fl FROM r WINDOW w AS (PARTITION BY track_id ORDER BY gap_idx)),
    v AS (SELECT *, coalesce({upper('nl')}, 0.0) AS near_ms, coalesce({upper('fl')}, 0.0) AS far_ms FROM nf)
    SELECT track_id, gap_idx, beat_ms, gap_ms, robust_ms, near_ms, far_ms, near_ms > 0 AND far_ms > 0 AND CASE WHEN far_ms > 0 THEN abs(near_ms - far_ms) / far_ms ELSE 0.0 END >= 0.06 AS changed FROM v"""),
)
def e12_change_flags(s, d):
    return B.change_flags(B.robust_gaps(R.beats(s, d)))


# Lookups


@query(
    "f1_index_at",
    sql("beats", "asked", "idx", then="SELECT a.track_id, a.t_ms, coalesce(i, -1) AS beat_idx FROM asked a ASOF LEFT JOIN idx b ON a.track_id = b.track_id AND a.t_ms >= b.beat_ms"),
)
def f1_index_at(s, d):
    return asof.asof_join(R.clicks(s, d, "click"), B.indexed(R.beats(s, d)), ["beat_idx"]).withColumn("beat_idx", F.coalesce("beat_idx", F.lit(-1)))


@query(
    "f2_phase_at",
    sql("beats", "views", "idx", then="SELECT a.track_id, a.t_ms, CASE WHEN gap_ms > 0 THEN (a.t_ms - b.beat_ms) / gap_ms ELSE 0.0 END AS phase FROM views a ASOF LEFT JOIN idx b ON a.track_id = b.track_id AND a.t_ms >= b.beat_ms"),
)
def f2_phase_at(s, d):
    return (
        asof.asof_join(R.clicks(s, d, "view"), R.beats(s, d).withColumns({"at_ms": F.col("beat_ms"), "gap_ms": B._gap_ahead()}), ["at_ms", "gap_ms"])
        .select("track_id", "t_ms", F.when(F.col("gap_ms") > 0, (F.col("t_ms") - F.col("at_ms")) / F.col("gap_ms")).otherwise(0.0).alias("phase"))
    )


_FIRST = ", f AS (SELECT track_id, arg_min(beat_length_ms, time_ms) AS first FROM timing GROUP BY track_id)"


@query(
    "f4_beat_length_at",
    sql("asked", "timing", then=_FIRST + " SELECT a.track_id, a.t_ms, coalesce(b.beat_length_ms, first, 1000.0) AS beat_length_ms, 60000 / coalesce(b.beat_length_ms, first, 1000.0) AS bpm FROM asked a ASOF LEFT JOIN timing b ON a.track_id = b.track_id AND a.t_ms >= b.time_ms LEFT JOIN f ON f.track_id = a.track_id"),
)
def f4_beat_length_at(s, d):
    return (
        asof.asof_join(R.clicks(s, d, "click"), R.timing(s, d), ["beat_length_ms"], right_time="time_ms", fallback="first")
        .withColumn("beat_length_ms", F.coalesce("beat_length_ms", F.lit(1000.0)))
        .withColumn("bpm", 60000 / F.col("beat_length_ms"))
    )


@query(
    "f5_keyframe_upsert",
    sql("timing", then="SELECT track_id, floor(time_ms / 1000) * 1000 AS time_ms, arg_max(60000 / beat_length_ms, time_ms) AS bpm FROM timing GROUP BY track_id, floor(timing.time_ms / 1000)"),
)
def f5_keyframe_upsert(s, d):
    return keyframes(R.timing(s, d).select("track_id", (F.floor(F.col("time_ms") / 1000) * 1000.0).alias("time_ms"), (60000 / F.col("beat_length_ms")).alias("bpm"), F.col("time_ms").alias("seq")))


def keyframes(changes):
    """track_id, time_ms, bpm: the last change of each time; a tempo that is not finite and positive is an error."""
    usable = (F.col("bpm") > 0) & (F.col("bpm") < float("inf"))
    checked = changes.filter(F.when(usable, F.lit(True)).otherwise(F.raise_error(F.lit("a tempo must be finite and positive")).cast("boolean")))
    return checked.groupBy("track_id", "time_ms").agg(F.max_by("bpm", "seq").alias("bpm"))


@query(
    "f6_bpm_range",
    sql("timing", then="SELECT track_id, min(60000 / beat_length_ms) AS low, max(60000 / beat_length_ms) AS high, count(*) AS keyframes FROM timing GROUP BY track_id"),
)
def f6_bpm_range(s, d):
    return (
        R.timing(s, d)
        .groupBy("track_id")
        .agg(F.min(60000 / F.col("beat_length_ms")).alias("low"), F.max(60000 / F.col("beat_length_ms")).alias("high"), F.count(F.lit(1)).alias("keyframes"))
    )


@query(
    "f7_duration",
    "WITH " + R.CTE["beats"] + " SELECT user_id AS track_id, coalesce(max(beat_ms), 0.0) AS duration_ms, count(beat_ms) = 0 AS is_empty FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN beats ON track_id = user_id GROUP BY user_id",
)
def f7_duration(s, d):
    return (
        R.table(s, d, "events")
        .select(F.col("user_id").alias("track_id"))
        .distinct()
        .join(R.beats(s, d), "track_id", "left")
        .groupBy("track_id")
        .agg(F.coalesce(F.max("beat_ms"), F.lit(0.0)).alias("duration_ms"), (F.count("beat_ms") == 0).alias("is_empty"))
    )


@query(
    "f8_tempo_at",
    sql("asked", "timing", then="SELECT a.track_id, a.t_ms, coalesce(60000 / b.beat_length_ms, 0.0) AS bpm FROM asked a ASOF LEFT JOIN timing b ON a.track_id = b.track_id AND a.t_ms >= b.time_ms"),
)
def f8_tempo_at(s, d):
    return (
        asof.asof_join(R.clicks(s, d, "click"), R.timing(s, d), ["beat_length_ms"], right_time="time_ms")
        .select("track_id", "t_ms", F.coalesce(60000 / F.col("beat_length_ms"), F.lit(0.0)).alias("bpm"))
    )


@query(
    "f9_stable",
    sql("views", "timing", then=""",
        n AS (SELECT track_id, time_ms, lead(time_ms) OVER (PARTITION BY track_id ORDER BY time_ms) AS next_ms FROM timing)
        SELECT a.track_id, a.t_ms FROM views a ASOF JOIN n ON a.track_id = n.track_id AND a.t_ms >= n.time_ms WHERE a.t_ms - n.time_ms >= 300 AND (next_ms IS NULL OR next_ms - a.t_ms >= 300)"""),
)
def f9_stable(s, d):
    return stable(R.clicks(s, d, "view"), R.timing(s, d), 300.0)


def stable(points, timing, margin: float):
    """Points at least ``margin`` after their change of tempo and before the next."""
    from pyspark.sql import Window

    marks = timing.select("track_id", "time_ms", F.col("time_ms").alias("from_ms"), F.lead("time_ms").over(Window.partitionBy("track_id").orderBy("time_ms")).alias("next_ms"))
    found = asof.asof_join(points, marks, ["from_ms", "next_ms"], right_time="time_ms")
    return found.filter((F.col("t_ms") - F.col("from_ms") >= margin) & (F.col("next_ms").isNull() | (F.col("next_ms") - F.col("t_ms") >= margin))).select(points.columns)


@query(
    "f10_activation_at",
    sql("asked", "signal", then="SELECT a.track_id, a.t_ms, coalesce(x, 0.0) AS x FROM asked a LEFT JOIN signal s ON s.track_id = a.track_id AND s.frame = round_even(a.t_ms / 400, 0) + 2"),
)
def f10_activation_at(s, d):
    return asof.value_at_frame(R.clicks(s, d, "click"), R.signal(s, d), "x", F.rint(F.col("t_ms") / 400) + 2)


# Peaks
_PEAKS = """,
        p AS (SELECT *, max(x) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS m FROM {of}),
        peaks AS (SELECT track_id, frame, x FROM p WHERE x > 0 AND x >= m)"""
_MERGE = """,
        runs AS (SELECT *, frame - row_number() OVER (PARTITION BY track_id ORDER BY frame) AS run FROM peaks),
        pairs AS (SELECT *, (row_number() OVER (PARTITION BY track_id, run ORDER BY frame) - 1) // 2 AS pair FROM runs),
        merged AS (SELECT track_id, avg(frame) AS centre, count(*)::INT AS width FROM pairs GROUP BY track_id, run, pair)"""
_REFINE = """,
        nb AS (SELECT track_id, frame, x, lag(x) OVER w AS b, lead(x) OVER w AS a FROM {of} WINDOW w AS (PARTITION BY track_id ORDER BY frame)),
        fine AS (SELECT track_id, frame, x, CASE WHEN b IS NULL OR a IS NULL OR abs(b - 2 * x + a) < 1e-9 THEN frame::DOUBLE ELSE frame + greatest(-0.5, least(0.5, 0.5 * (b - a) / (b - 2 * x + a))) END AS place FROM nb)"""
#: Plateaus do not occur in the vectors: coarse values make some.
_COARSE = ", coarse AS (SELECT track_id, frame, floor(x * 8) / 8 AS x FROM activation)"


def coarse(s, d):
    return R.activation(s, d).withColumn("x", F.floor(F.col("x") * 8) / 8)


@query("d1_frame_peaks", sql("activation", then=_PEAKS.format(of="activation") + " SELECT track_id, frame, x FROM peaks"))
def d1_frame_peaks(s, d):
    return P.frame_peaks(R.activation(s, d))


@query("d2_merged_peaks", sql("activation", then=_COARSE + _PEAKS.format(of="coarse") + _MERGE + " SELECT track_id, centre, width FROM merged"))
def d2_merged_peaks(s, d):
    return P.merged_peaks(P.frame_peaks(coarse(s, d)))


@query("d3_refined", sql("activation", then=_REFINE.format(of="activation") + " SELECT track_id, frame, x, place FROM fine"))
def d3_refined(s, d):
    return P.refined(R.activation(s, d))


@query(
    "d4_raw_peaks",
    sql("activation", then=_COARSE + _PEAKS.format(of="coarse") + _MERGE + _REFINE.format(of="coarse") + " SELECT m.track_id, coalesce(f.place, centre) AS place, width FROM merged m LEFT JOIN fine f ON f.track_id = m.track_id AND width = 1 AND f.frame = centre"),
)
def d4_raw_peaks(s, d):
    return P.raw_peaks(coarse(s, d))


@query(
    "d6_peak_widths",
    sql("activation", then=_COARSE + _PEAKS.format(of="coarse") + _MERGE + " SELECT width, count(*) AS peaks, sum(centre) AS centres FROM merged GROUP BY width"),
)
def d6_peak_widths(s, d):
    return P.merged_peaks(P.frame_peaks(coarse(s, d))).groupBy("width").agg(F.count(F.lit(1)).alias("peaks"), F.sum("centre").alias("centres"))


_LL, _L, _R, _RR = (f"lag(x, {k}) OVER w" if k > 0 else f"lead(x, {-k}) OVER w" for k in (2, 1, -1, -2))


@query(
    "d10_centroids",
    sql("activation", then=f""", v AS (SELECT track_id, frame, x, {_LL} AS ll, {_L} AS l, {_R} AS r, {_RR} AS rr FROM activation WINDOW w AS (PARTITION BY track_id ORDER BY frame)),
    f AS (SELECT *, least(x, coalesce(ll, x), coalesce(l, x), coalesce(r, x), coalesce(rr, x)) AS lo FROM v),
    k AS (SELECT *, CASE WHEN l > lo AND ll > lo THEN ll - lo ELSE 0 END AS wll, CASE WHEN l > lo THEN l - lo ELSE 0 END AS wl, x - lo AS wx, CASE WHEN r > lo THEN r - lo ELSE 0 END AS wr, CASE WHEN r > lo AND rr > lo THEN rr - lo ELSE 0 END AS wrr FROM f)
    SELECT track_id, frame, x, round(CASE WHEN wll + wl + wx + wr + wrr > 1e-9 THEN (wll * (frame - 2) + wl * (frame - 1) + wx * frame + wr * (frame + 1) + wrr * (frame + 2)) / (wll + wl + wx + wr + wrr) ELSE frame END, 6) AS place FROM k"""),
)
def d10_centroids(s, d):
    return P.centroids(R.activation(s, d)).withColumn("place", F.round("place", 6))


@query(
    "d12_smoothed_periods",
    sql("signal", then=f""",
        n AS (SELECT track_id, frame, x, list(x) FILTER (WHERE x > 0) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS near, count(*) OVER (PARTITION BY track_id) AS k FROM signal)
        SELECT track_id, frame, CASE WHEN k < 3 THEN x ELSE coalesce({upper('near')}, x) END AS x FROM n"""),
)
def d12_smoothed_periods(s, d):
    return P.smoothed_periods(R.signal(s, d), 0.2, value="x")

