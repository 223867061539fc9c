"""SQL for the order-dependent kernels: recursive common table expressions over lists, one step for each decision."""

from __future__ import annotations

from tempoframe.plans import relations as R
from tempoframe.plans.beat_queries import _MERGE, _PEAKS, _PERIOD, _REFINE, _ROBUST
from tempoframe.plans.relations import CTE, upper


def recursive(*names: str, then: str) -> str:
    return R.sql(*names, then=then).replace("WITH ", "WITH RECURSIVE ", 1)


#: Suppression: of the frames that are left the strongest is chosen and silences those near it.
def _suppressed(curve: str) -> str:
    return f""", queue AS (SELECT track_id, list(struct_pack(f := frame, r := greatest(1, trunc(0.6 * period_frames))::INT) ORDER BY beat_prob DESC, frame) AS rest FROM {curve} WHERE beat_prob >= 0.5 GROUP BY track_id),
    chosen AS (SELECT track_id, NULL::INT AS frame, rest FROM queue
        UNION ALL SELECT track_id, rest[1].f, list_filter(rest[2:], lambda e: abs(e.f - rest[1].f) >= rest[1].r) FROM chosen WHERE len(rest) > 0)"""


_CURVE = ", curve AS (SELECT track_id, frame, x + 0.5 AS beat_prob, 8.0 + frame % 5 AS period_frames FROM activation)"
_SMOOTH = f""", around AS (SELECT *, list(period_frames) FILTER (WHERE period_frames > 0) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN 50 PRECEDING AND 50 FOLLOWING) AS near FROM curve),
    smooth AS (SELECT track_id, frame, beat_prob, coalesce({upper('near')}, period_frames) AS period_frames FROM around)"""
_CENTRE = """, v AS (SELECT track_id, frame, beat_prob AS x, lag(beat_prob, 2) OVER w AS ll, lag(beat_prob, 1) OVER w AS l, lead(beat_prob, 1) OVER w AS r, lead(beat_prob, 2) OVER w AS rr FROM curve WINDOW w AS (PARTITION BY track_id ORDER BY frame)),
    lows AS (SELECT *, least(x, coalesce(ll, x), coalesce(l, x), coalesce(r, x), coalesce(rr, x)) AS lo FROM v),
    k AS (SELECT *, CASE WHEN l > lo AND ll > lo THEN ll - lo ELSE 0 END AS wll, CASE WHEN l > lo THEN l - lo ELSE 0 END AS wl, x - lo AS wx, CASE WHEN r > lo THEN r - lo ELSE 0 END AS wr, CASE WHEN r > lo AND rr > lo THEN rr - lo ELSE 0 END AS wrr FROM lows),
    centre AS (SELECT track_id, frame, CASE WHEN wll + wl + wx + wr + wrr > 1e-9 THEN (wll * (frame - 2) + wl * (frame - 1) + wx * frame + wr * (frame + 1) + wrr * (frame + 2)) / (wll + wl + wx + wr + wrr) ELSE frame END AS place FROM k)"""
_PLACED = " SELECT track_id, frame, round(place * 20.0, 5) AS beat_ms FROM chosen JOIN centre USING (track_id, frame)"

D9 = recursive("activation", then=_CURVE + _suppressed("curve") + " SELECT track_id, frame FROM chosen WHERE frame IS NOT NULL")
D11 = recursive("activation", then=_CURVE + _suppressed("curve") + _CENTRE + _PLACED)
D13 = recursive("activation", then=_CURVE + _SMOOTH + _suppressed("smooth") + _CENTRE + _PLACED)

#: Pruning: each peak and the next are looked at in turn, in eight passes; the period around them is that of the gaps between peaks that are left.
_KEPT_GAPS = "list_transform(list_filter(range(greatest(1, i - 32), least(n, i + 32)), lambda j: keep[j] AND keep[j + 1]), lambda j: p[j + 1] - p[j])"
_BEST_GAP = """list_reduce(list_prepend(struct_pack(c := 0.0::DOUBLE, n := 0::BIGINT, m := 0.0::DOUBLE), list_transform(g, lambda c: struct_pack(c := c, n := len(list_filter(g, lambda x: x >= c * 0.75 AND x <= c * 1.25))::BIGINT,
        m := list_sort(list_filter(g, lambda x: x >= c * 0.75 AND x <= c * 1.25))[len(list_filter(g, lambda x: x >= c * 0.75 AND x <= c * 1.25)) // 2 + 1]))),
        lambda a, e: CASE WHEN e.n > a.n OR (e.n = a.n AND e.c > a.m) THEN e ELSE a END).m"""
_PRUNED = (_PEAKS.format(of="activation") + _MERGE + _REFINE.format(of="activation") + f""",
    raw AS (SELECT m.track_id, coalesce(f.place, centre) AS place FROM merged m LEFT JOIN fine f ON f.track_id = m.track_id AND width = 1 AND f.frame = centre),
    valued AS (SELECT r.track_id, r.place, a.x FROM raw r JOIN activation a ON a.track_id = r.track_id AND a.frame = floor(r.place + 0.5)),
    tracks AS (SELECT track_id, list(place ORDER BY place) AS p, list(x ORDER BY place) AS v, count(*) AS n FROM valued GROUP BY track_id),
    walk AS (SELECT track_id, p, v, n, 0::BIGINT AS step, list_transform(p, lambda x: true) AS keep FROM tracks
        UNION ALL SELECT track_id, p, v, n, step + 1, CASE WHEN keep[i] AND keep[i + 1] AND period > 0 AND (p[i + 1] - p[i]) / period < 0.7
            THEN list_transform(range(1, n + 1), lambda j: keep[j] AND j <> CASE WHEN v[i] >= v[i + 1] THEN i + 1 ELSE i END) ELSE keep END
        FROM (SELECT *, CASE WHEN len(g) = 0 THEN 0.0 WHEN len(g) < 3 THEN {upper('g')} ELSE {_BEST_GAP} END AS period
            FROM (SELECT *, {_KEPT_GAPS} AS g FROM (SELECT *, step % (n - 1) + 1 AS i FROM walk WHERE n >= 3 AND step < 8 * (n - 1))))),
    last AS (SELECT track_id, p, keep, n FROM walk WHERE n < 3 OR step = 8 * (n - 1)),
    kept AS (SELECT track_id, round(p[j], 6) AS place, round(p[j] * 20.0, 5) AS beat_ms FROM (SELECT track_id, p, keep, unnest(range(1, n + 1)) AS j FROM last) WHERE keep[j])""")
D5 = recursive("activation", then=_PRUNED + " SELECT track_id, place, beat_ms FROM kept")

#: Regularising: beats in order, each left out, taken, or taken with the ones that lack before it.
E5 = recursive("beats", "idx", then=_PERIOD + """, w AS (SELECT c.track_id, c.i, c.period_ms, round(sum(o.gap_ms), 6) AS w FROM periods c JOIN periods o ON c.track_id = o.track_id AND o.gap_ms IS NOT NULL AND o.period_ms >= c.period_ms * 0.75 AND o.period_ms <= c.period_ms * 1.25
        WHERE c.gap_ms IS NOT NULL AND c.period_ms > 0 GROUP BY ALL),
    top AS (SELECT track_id, period_ms AS d FROM w QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY w DESC, i) = 1),
    folded AS (SELECT track_id, list(beat_ms ORDER BY i) AS b, list(CASE WHEN d > 0 AND period_ms > 0 THEN list_reduce(list_prepend(period_ms, [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]::DOUBLE[]),
            lambda q, x: CASE WHEN q / d >= 1.5 THEN q / 2 WHEN q / d <= 0.59 THEN q * 2 ELSE q END) ELSE period_ms END ORDER BY i) AS p FROM periods LEFT JOIN top USING (track_id) GROUP BY track_id),
    walk AS (SELECT track_id, b, p, 1::BIGINT AS k, b[1] AS anchor, [b[1]] AS put FROM folded WHERE len(b) >= 4
        UNION ALL SELECT track_id, b, p, k + 1, CASE WHEN early THEN anchor ELSE b[k + 1] END,
            CASE WHEN early THEN []::DOUBLE[] WHEN q > 0 AND gap / q > 1.45 AND gap / q <= 5.0 THEN list_append(list_transform(range(1, round_even(gap / q, 0)::BIGINT), lambda j: anchor + j * (gap / round_even(gap / q, 0))), b[k + 1]) ELSE [b[k + 1]] END
        FROM (SELECT *, p[k + 1] AS q, b[k + 1] - anchor AS gap, p[k + 1] > 0 AND (b[k + 1] - anchor) / p[k + 1] < 0.85 AS early FROM walk WHERE k < len(b)))
    SELECT track_id, unnest(put) AS beat_ms FROM walk UNION ALL SELECT track_id, unnest(b) FROM folded WHERE len(b) < 4""")

#: Sections: from each boundary on the first lasting run of changes is the next boundary.
_LONG = R.CTE["beats"].replace("user_id AS track_id", f"user_id // {R.GATHERED} AS track_id")
_SECTIONS = _ROBUST + f""", nf AS (SELECT *, list(robust_ms) OVER (w ROWS BETWEEN 16 PRECEDING AND 15 FOLLOWING) AS nl, list(robust_ms) OVER (w ROWS BETWEEN 33 PRECEDING AND 17 PRECEDING) AS fl FROM r WINDOW w AS (PARTITION BY track_id ORDER BY gap_idx)),
    near AS (SELECT *, coalesce({upper('nl')}, 0.0) AS n_ms, coalesce({upper('fl')}, 0.0) AS f_ms FROM nf),
    tracks AS (SELECT track_id, list(robust_ms ORDER BY gap_idx) AS g, coalesce(list(gap_idx ORDER BY gap_idx) FILTER (WHERE n_ms > 0 AND f_ms > 0 AND abs(n_ms - f_ms) / f_ms >= 0.06), []) AS c FROM near GROUP BY track_id),
    lists AS (SELECT track_id, list(beat_ms ORDER BY i) AS b FROM idx GROUP BY track_id),
    cuts AS (SELECT track_id, 0::BIGINT AS start FROM lists WHERE len(b) >= 3
        UNION ALL SELECT track_id, s[found] FROM (SELECT track_id, s, list_filter(range(1, len(p) + 1), lambda j: s[CASE WHEN j < len(p) THEN p[j + 1] - 1 ELSE len(s) END] - s[p[j]] + 1 >= 20)[1] AS j, p[j] AS found
            FROM (SELECT *, list_filter(range(1, len(s) + 1), lambda k: k = 1 OR s[k] - s[k - 1] > 2) AS p
                FROM (SELECT track_id, list_filter(c, lambda x: x >= start + 16) AS s FROM cuts JOIN tracks USING (track_id)))) WHERE found IS NOT NULL),
    parts AS (SELECT track_id, start, lead(start) OVER (PARTITION BY track_id ORDER BY start) AS next, row_number() OVER (PARTITION BY track_id ORDER BY start) - 1 AS section_idx FROM cuts),
    ends AS (SELECT track_id, section_idx::INT AS section_idx, b[start + 1] AS start_ms, b[least(len(b), coalesce(next, len(g)) + 1)] AS end_ms, g[start + 1 : coalesce(next, len(g))] AS own FROM parts JOIN lists USING (track_id) JOIN tracks USING (track_id)),
    sections AS (SELECT track_id, section_idx, start_ms, end_ms, {upper('own')} AS period_ms FROM ends)"""
E14 = "WITH RECURSIVE " + _LONG + ", " + R.CTE["idx"] + _SECTIONS + " SELECT *, CASE WHEN period_ms > 0 THEN 60000 / period_ms ELSE 0.0 END AS bpm, end_ms - start_ms AS duration_ms FROM sections"
#: Even beats: from a section's first beat on, period by period.
E16 = "WITH RECURSIVE " + _LONG + ", " + R.CTE["idx"] + _SECTIONS + """, plans AS (SELECT track_id, list(struct_pack(s := start_ms, e := end_ms, p := period_ms) ORDER BY section_idx) AS q FROM sections GROUP BY track_id),
    walk AS (SELECT track_id, b, q, 1::BIGINT AS k, list_filter(b, lambda x: x >= q[1].s - 0.5)[1] AS place, NULL::DOUBLE AS last, NULL::DOUBLE AS put FROM plans JOIN lists USING (track_id) WHERE len(b) >= 8
        UNION ALL SELECT track_id, b, q, CASE WHEN over THEN k + 1 ELSE k END, CASE WHEN over THEN list_filter(b, lambda x: x >= q[k + 1].s - 0.5)[1] ELSE place + q[k].p END,
            CASE WHEN takes THEN place ELSE last END, CASE WHEN takes THEN place END
        FROM (SELECT *, NOT over AND (last IS NULL OR place > last + q[k].p * 0.5) AND place >= b[1] - q[k].p * 0.5 AS takes FROM (SELECT *, q[k].p <= 0 OR place >= q[k].e AS over FROM walk WHERE k <= len(q)))),
    laid AS (SELECT track_id, put FROM walk WHERE put IS NOT NULL), enough AS (SELECT track_id FROM laid GROUP BY track_id HAVING count(*) >= 4)
    SELECT track_id, put AS beat_ms, true AS even FROM laid SEMI JOIN enough USING (track_id) UNION ALL SELECT track_id, beat_ms, false FROM beats ANTI JOIN enough USING (track_id)"""


#: Tempo at a time, for a relation of points.
def _bpm(points: str) -> str:
    return f""", lists AS (SELECT track_id, list(beat_ms ORDER BY i) AS b FROM idx GROUP BY track_id),
    met AS (SELECT a.track_id, a.t_ms, coalesce(i, 0) AS c FROM {points} a ASOF LEFT JOIN idx o ON a.track_id = o.track_id AND a.t_ms >= o.beat_ms),
    centres AS (SELECT DISTINCT track_id, c, b, len(b) - 1 AS top FROM met JOIN lists USING (track_id) WHERE len(b) >= 2),
    wide AS (SELECT *, list_filter(range(0, top + 1), lambda k: b[least(top, c + 6 + k) + 1] - b[greatest(0, c - 6 - k) + 1] >= 2000 OR (c - 6 - k <= 0 AND c + 6 + k >= top))[1] AS k FROM centres),
    gapped AS (SELECT *, list_transform(range(greatest(0, c - 6 - k) + 2, least(top, c + 6 + k) + 2), lambda j: b[j] - b[j - 1]) AS g, list_transform(range(greatest(0, c - 48) + 2, least(top, c + 48) + 2), lambda j: b[j] - b[j - 1]) AS more FROM wide),
    told AS (SELECT *, (list_sort(g)[(len(g) + 1) // 2] + list_sort(g)[len(g) // 2 + 1]) / 2 AS period, len(list_filter(range(2, len(g) + 1), lambda j: g[j] - g[j - 1] > 0)) AS up, len(list_filter(range(2, len(g) + 1), lambda j: g[j] - g[j - 1] < 0)) AS down FROM gapped),
    agreed AS (SELECT *, len(list_filter(g, lambda x: x >= period * 0.85 AND x <= period * 1.15)) AS agree, len(g) > 3 AND greatest(up, down) * 10 >= (len(g) - 1) * 7 AS steady FROM told),
    tempo AS (SELECT track_id, c, CASE WHEN period <= 0 THEN 0.0 WHEN NOT steady AND agree * 3 < len(g) * 2 AND len(more) > len(g) AND {upper('more')} > 0 THEN 60000 / {upper('more')} ELSE 60000 / period END AS bpm FROM agreed),
    bpms AS (SELECT track_id, t_ms, coalesce(bpm, 0.0) AS bpm FROM met LEFT JOIN tempo USING (track_id, c))"""


F3 = R.sql("beats", "asked", "idx", then=_bpm("asked") + " SELECT track_id, t_ms, bpm FROM bpms")
H26 = R.sql("beats", "idx", then=", seconds AS (SELECT track_id, unnest(range(0, floor(max(beat_ms) / 1000)::BIGINT + 1)) * 1000.0 AS t_ms FROM beats GROUP BY track_id)" + _bpm("seconds") + """,
    stepped AS (SELECT *, abs(bpm / lag(bpm) OVER (PARTITION BY track_id ORDER BY t_ms) - 1) AS step FROM bpms),
    runs AS (SELECT *, sum(CASE WHEN step > 0.25 THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY t_ms)::BIGINT AS run FROM stepped)
    SELECT track_id, t_ms, bpm, step, run, count(*) OVER (PARTITION BY track_id, run) AS held FROM runs""")

#: Coalescing: a timing point goes on the section before it if it has that section's length.
H15 = recursive("timing", then=""", points AS (SELECT track_id, time_ms, round_even(beat_length_ms / 100, 0) * 100 AS l, lead(time_ms) OVER w AS next, row_number() OVER w AS i FROM timing WINDOW w AS (PARTITION BY track_id ORDER BY time_ms)),
    walk AS (SELECT track_id, time_ms, coalesce(next, greatest(0.0, time_ms)) AS stop, l, i, 1::BIGINT AS section FROM points WHERE i = 1
        UNION ALL SELECT p.track_id, p.time_ms, coalesce(p.next, greatest(0.0, p.time_ms)), CASE WHEN abs(p.l - w.l) <= 0.001 * w.l THEN w.l ELSE p.l END, p.i, CASE WHEN abs(p.l - w.l) <= 0.001 * w.l THEN section ELSE section + 1 END FROM walk w JOIN points p ON p.track_id = w.track_id AND p.i = w.i + 1)
    SELECT track_id, min(time_ms) AS start_ms, arg_max(stop, i) AS end_ms, min(l) AS period_ms FROM walk GROUP BY track_id, section""")

#: Scoring: a model of energy against its surroundings, as a window function. Bands are small whole numbers, so that values are exact to a thousandth.
_MEL = f"""mel AS (SELECT l_orderkey // {R.GATHERED_ORDERS} AS track_id, row_number() OVER (PARTITION BY l_orderkey // {R.GATHERED_ORDERS} ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) - 1 AS frame, list_transform(range(0, 40), lambda b: (l_quantity::BIGINT * (b + 3) + l_partkey) % 17) AS m FROM lineitem),
    level AS (SELECT track_id, frame, list_sum(m) / 40 AS a, list_sum(m[1:32]) / 32 AS b FROM mel)"""
C2 = f"""WITH {_MEL}, t AS (SELECT *, sum(a) OVER w AS sa, sum(b) OVER w AS sb FROM level WINDOW w AS (PARTITION BY track_id ORDER BY frame ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING))
    SELECT track_id, frame::INT AS frame, round(a - sa / 9, 3) + 0.0 AS beat, round(b - sb / 9, 3) + 0.0 AS downbeat FROM t"""
#: Both curves as tracks of their own.
C5 = "WITH RECURSIVE " + C2.removeprefix("WITH ").replace("    SELECT track_id, frame::INT", ", both_curves AS (SELECT track_id, frame::INT", 1) + """),
    activation AS (SELECT track_id * 2 AS track_id, frame, beat AS x FROM both_curves UNION ALL SELECT track_id * 2 + 1, frame, downbeat FROM both_curves)""" + _PRUNED + " SELECT track_id // 2 AS track_id, CASE WHEN track_id % 2 = 0 THEN 'beat' ELSE 'downbeat' END AS kind, place, beat_ms FROM kept"
#: The same in a track for each line number: tracks that grow with the table, of as many windows as that gives.
_LONG_MEL = """mel AS (SELECT l_linenumber::BIGINT AS track_id, row_number() OVER (PARTITION BY l_linenumber ORDER BY l_orderkey, l_partkey, l_quantity) - 1 AS frame, list_transform(range(0, 40), lambda b: (l_quantity::BIGINT * (b + 3) + l_partkey) % 17) AS m FROM lineitem),
    level AS (SELECT track_id, frame, list_sum(m) / 40 AS a, list_sum(m[1:32]) / 32 AS b FROM mel)"""
C7 = f"""WITH {_LONG_MEL}, n AS (SELECT track_id, count(*) AS total FROM level GROUP BY track_id),
    each AS (SELECT track_id, frame, k, a, b, total FROM (SELECT l.*, total, unnest(range(greatest(0, frame // 960 - 1), frame // 960 + 1)) AS k FROM level l JOIN n USING (track_id)) WHERE frame < k * 960 + 1024),
    w AS (SELECT *, a - sum(a) OVER w / 9 AS va, b - sum(b) OVER w / 9 AS vb, least(1024, total - k * 960) >= 64 AS scored FROM each WINDOW w AS (PARTITION BY track_id, k ORDER BY frame ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)),
    means AS (SELECT track_id, frame, coalesce(avg(1 / (1 + exp(-va))) FILTER (WHERE scored), 0.0) AS p, coalesce(exp(avg(vb) FILTER (WHERE scored)), 1.0) AS q FROM w GROUP BY track_id, frame)
    SELECT track_id, (frame // 50)::INT AS second, count(*) AS frames, round(avg(p), 3) AS beat_prob, round(avg(q), 2) AS period_frames FROM means GROUP BY ALL"""

#: Onset strength: what the bins of a spectrum gained over the frame before, over the track's mean.
B13 = """WITH s AS (SELECT vec_id % 5 AS track_id, (vec_id // 5)::INT AS frame, embedding AS m, lag(embedding) OVER (PARTITION BY vec_id % 5 ORDER BY vec_id) AS p FROM embeddings),
    f AS (SELECT track_id, frame, list_sum(list_transform(range(1, len(m) + 1), lambda i: greatest(m[i]::DOUBLE - coalesce(p[i]::DOUBLE, 0.0), 0.0))) AS flux FROM s)
    SELECT track_id, frame, round(CASE WHEN avg(flux) OVER w > 0 THEN flux / avg(flux) OVER w ELSE flux END, 6) AS flux FROM f WINDOW w AS (PARTITION BY track_id)"""
B1 = "SELECT vec_id AS track_id, (i - 1)::INT AS place, ((embedding[2 * i - 1] + embedding[2 * i])::FLOAT / 2)::FLOAT AS x FROM (SELECT *, unnest(range(1, len(embedding) // 2 + 1)) AS i FROM embeddings)"
B3 = """SELECT vec_id AS track_id, k::INT AS place, (CASE WHEN k % 2 = 0 OR k // 2 + 2 > len(embedding) THEN embedding[k // 2 + 1]::DOUBLE ELSE embedding[k // 2 + 1]::DOUBLE + (embedding[k // 2 + 2]::DOUBLE - embedding[k // 2 + 1]::DOUBLE) * 0.5 END)::FLOAT AS x
    FROM (SELECT *, unnest(range(0, 2 * len(embedding))) AS k FROM embeddings)"""

#: Phase snapping: the period at each beat by the correlation of the onset curve around it with itself, then the phase that most of a trusted run shares.
_TURN = "(fmod(fmod({x}, q) + 1.5 * q, q) - 0.5 * q)"
_PACED = "beats AS (SELECT track_id, 60.0 + frame * 400.0 + (fmod(x * 7, 80) - 40) AS beat_ms FROM signal)"
H33 = "WITH " + ", ".join((R.CTE["signal"], _PACED, R.CTE["idx"])) + (_PERIOD + f""", w AS (SELECT c.track_id, c.i, c.period_ms, round(sum(o.gap_ms), 6) AS w FROM periods c JOIN periods o ON c.track_id = o.track_id AND o.gap_ms IS NOT NULL AND o.period_ms >= c.period_ms * 0.75 AND o.period_ms <= c.period_ms * 1.25
        WHERE c.gap_ms IS NOT NULL AND c.period_ms > 0 GROUP BY ALL),
    top AS (SELECT track_id, period_ms AS d FROM w QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY w DESC, i) = 1),
    curves AS (SELECT track_id, list_transform(range(0, 20 * count(*)), lambda f: CASE WHEN f % 20 = 3 THEN 1.0 ELSE 0.0 END + (f * 37 + track_id * 11) % 100 / 333.0) AS v, 20 * count(*) AS n FROM signal GROUP BY track_id),
    able AS (SELECT b.track_id, b.i, b.beat_ms, d, v, c.n, round_even(b.beat_ms / 20.0, 0)::BIGINT AS centre FROM idx b JOIN top USING (track_id) JOIN curves c USING (track_id) WHERE b.n >= 6 AND c.n >= 200 AND d > 0),
    lagged AS (SELECT track_id, i, lag, v, greatest(centre - 50, 0) AS low, least(centre + 50, n - 1 - lag) AS high FROM (SELECT *, unnest(range(9, 52)) AS lag FROM able)),
    sliced AS (SELECT track_id, i, lag, low, high, v[low + 1 : high] AS a, v[low + lag + 1 : high + lag] AS b FROM lagged),
    centred AS (SELECT *, list_avg(a) AS m FROM sliced),
    summed AS (SELECT track_id, i, lag, CASE WHEN high - low < 4 * lag THEN 0.0 ELSE list_sum(list_transform(a, lambda x: (x - m) * (x - m))) END AS var,
        CASE WHEN high - low < 4 * lag THEN 0.0 ELSE list_sum(list_transform(list_zip(a, b), lambda z: (z[1] - m) * (z[2] - m))) END AS cov FROM centred),
    told AS (SELECT track_id, i, lag, CASE WHEN var > 0 THEN round(cov / var, 9) ELSE 0.0 END AS r FROM summed),
    sides AS (SELECT *, lag(r) OVER w AS b, lead(r) OVER w AS a FROM told WINDOW w AS (PARTITION BY track_id, i ORDER BY lag)),
    tops AS (SELECT *, max(r) OVER (PARTITION BY track_id, i) AS most FROM sides WHERE lag BETWEEN 10 AND 50 AND r > 0 AND r >= b AND r >= a),
    chosen AS (SELECT track_id, i, lag * 20.0 AS p, r FROM tops JOIN top USING (track_id) WHERE r >= 0.75 * most QUALIFY row_number() OVER (PARTITION BY track_id, i ORDER BY abs(lag * 20.0 - d), lag) = 1),
    marked AS (SELECT able.track_id, able.i, beat_ms, p, coalesce(p > 0 AND r >= 0.05 AND p / d >= 0.75 AND p / d <= 1.35, false) AS trusted FROM able LEFT JOIN chosen USING (track_id, i)),
    runs AS (SELECT *, i - row_number() OVER (PARTITION BY track_id ORDER BY i) AS run FROM marked WHERE trusted),
    periods_of AS (SELECT track_id, run, count(*) AS k, {upper('list(p)')} AS q FROM runs GROUP BY track_id, run HAVING count(*) >= 6),
    turned AS (SELECT runs.*, k, q, {_TURN.format(x='beat_ms')} AS residue FROM runs JOIN periods_of USING (track_id, run)),
    binned AS (SELECT *, greatest(0, least(11, floor((residue + q / 2) / (q / 12))))::INT AS bin FROM turned),
    modal AS (SELECT track_id, run, bin, count(*) AS c FROM binned GROUP BY track_id, run, bin QUALIFY row_number() OVER (PARTITION BY track_id, run ORDER BY c DESC, bin) = 1),
    aimed AS (SELECT b.*, -q / 2 + (m.bin + 0.5) * (q / 12) AS centre FROM binned b JOIN modal m USING (track_id, run) WHERE m.c >= 0.55 * k),
    near AS (SELECT *, {_TURN.format(x='residue - centre')} AS delta FROM aimed),
    phased AS (SELECT *, avg(delta) FILTER (WHERE abs(delta) <= q / 12) OVER (PARTITION BY track_id, run) AS mean FROM near),
    moved AS (SELECT *, {_TURN.format(x='beat_ms - CASE WHEN mean IS NULL THEN centre ELSE ' + _TURN.format(x='centre + mean') + ' END')} AS move FROM phased)
    SELECT beats.track_id, beats.beat_ms, round(CASE WHEN abs(move) <= 0.35 * q THEN beats.beat_ms - move ELSE beats.beat_ms END, 5) AS snapped_ms FROM beats SEMI JOIN curves USING (track_id) LEFT JOIN moved ON moved.track_id = beats.track_id AND moved.beat_ms = beats.beat_ms""")

#: All states forwards, a frame a step; scores are whole numbers of 2**-40. ``sc`` and ``pa``: of each frame so far, by the interval that led to it, the best score and its frames.
D14 = f"""WITH RECURSIVE {CTE["activation"]},
    u AS (SELECT track_id, frame, round_even(x * 1099511627776, 0)::BIGINT AS x FROM activation),
    m AS (SELECT track_id, round_even(sum(x)::DOUBLE / count(*), 0)::BIGINT AS mean, count(*) AS n FROM u GROUP BY track_id),
    r AS (SELECT track_id, any_value(n) AS n, list(x - mean - round_even(0.05::DOUBLE * 1099511627776, 0)::BIGINT ORDER BY frame) AS w FROM u JOIN m USING (track_id) GROUP BY track_id HAVING any_value(n) > 8),
    c AS (SELECT [[round_even(12.0::DOUBLE * abs(ln((8 + i)::DOUBLE / (8 + j))) * 1099511627776, 0)::BIGINT FOR j IN range(53)] FOR i IN range(53)] AS cost),
    s AS (SELECT track_id, 0 AS t, CAST([] AS BIGINT[][]) AS sc, CAST([] AS VARCHAR[][]) AS pa FROM r
        UNION ALL
        SELECT track_id, t + 1, list_append(sc, [w[t + 1] + greatest(0, coalesce(x.best, 0)) FOR x IN ways]), list_append(pa, [CASE WHEN x.best > 0 THEN pa[x.at][x.k] || ',' || t ELSE t::VARCHAR END FOR x IN ways])
        FROM (SELECT track_id, t, sc, pa, w, [{{'at': x.at, 'best': list_max(x.all), 'k': list_position(x.all, list_max(x.all))}} FOR x IN
                [{{'at': t - 7 - i, 'all': CASE WHEN t - 8 - i >= 0 THEN [sc[t - 7 - i][f + 1] - cost[i + 1][f + 1] FOR f IN range(53)] END}} FOR i IN range(53)]] AS ways
            FROM s JOIN r USING (track_id), c WHERE t < n)),
    e AS (SELECT track_id, flatten(sc) AS sc, flatten(pa) AS pa FROM s JOIN r USING (track_id) WHERE t = n)
    SELECT track_id, unnest(string_split(pa[list_position(sc, list_max(sc))], ','))::INT AS frame FROM e"""
