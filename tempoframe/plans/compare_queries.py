"""Queries of the relational operators (H): grids, matches, buckets, percentiles, diagnostics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tempoframe.functions import numeric as N
from tempoframe.operators import asof, beats as B, grids as G, peaks as P
from tempoframe.plans import relations as R
from tempoframe.plans.beat_queries import _PERIOD
from tempoframe.plans.relations import sql, upper

QUERIES, ORACLE_SQL = {}, {}


def _track():
    return Window.partitionBy("track_id")


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return put


def grid(s, d):
    return G.grid(R.timing(s, d), tail_ms=2000.0)


def offsets(s, d, name="offset_ms"):
    """Beats with their signed distance to the nearest grid beat."""
    return asof.nearest(R.beats(s, d).withColumnRenamed("beat_ms", "t_ms"), grid(s, d), name=name)


def grid_offsets(s, d):
    return asof.nearest(grid(s, d).withColumnRenamed("beat_ms", "t_ms"), R.beats(s, d))


#: The nearest of the rows before and after, the earlier one on a tie.
_NEAR = """, {out} AS (SELECT p.track_id, p.t_ms, CASE WHEN b.beat_ms IS NULL THEN p.t_ms - a.beat_ms WHEN a.beat_ms IS NULL THEN p.t_ms - b.beat_ms WHEN p.t_ms - b.beat_ms <= a.beat_ms - p.t_ms THEN p.t_ms - b.beat_ms ELSE p.t_ms - a.beat_ms END AS offset_ms
    FROM {left} p ASOF LEFT JOIN {right} b ON p.track_id = b.track_id AND p.t_ms >= b.beat_ms ASOF LEFT JOIN {right} a ON p.track_id = a.track_id AND p.t_ms <= a.beat_ms)"""
_BT = ", bt AS (SELECT track_id, beat_ms AS t_ms FROM beats), gt AS (SELECT track_id, beat_ms AS t_ms FROM grid)"
OFF = _BT + _NEAR.format(out="off", left="bt", right="grid")
BACK = _BT + _NEAR.format(out="back", left="gt", right="beats")
BG = ("beats", "timing", "grid")

query("h1_grid", sql("timing", "grid", then="SELECT track_id, beat_ms FROM grid"))(grid)
query("h2_nearest_signed", sql(*BG, then=OFF + " SELECT track_id, t_ms, offset_ms FROM off"))(offsets)


@query("h3_nearest_absolute", sql(*BG, then=OFF + " SELECT track_id, t_ms, abs(offset_ms) AS distance_ms FROM off"))
def h3_nearest_absolute(s, d):
    return offsets(s, d).select("track_id", "t_ms", F.abs("offset_ms").alias("distance_ms"))


@query("h4_coverage", sql(*BG, then=BACK + " SELECT track_id, avg(CASE WHEN abs(offset_ms) <= 60 THEN 1.0 ELSE 0.0 END) AS coverage FROM back GROUP BY track_id"))
def h4_coverage(s, d):
    return grid_offsets(s, d).groupBy("track_id").agg(F.avg(F.when(F.abs("offset_ms") <= 60, 1.0).otherwise(0.0)).alias("coverage"))


@query("h5_precision", sql(*BG, then=OFF + " SELECT track_id, avg(CASE WHEN abs(offset_ms) <= 60 THEN 1.0 ELSE 0.0 END) AS share FROM off GROUP BY track_id"))
def h5_precision(s, d):
    return offsets(s, d).groupBy("track_id").agg(F.avg(F.when(F.abs("offset_ms") <= 60, 1.0).otherwise(0.0)).alias("share"))


@query("h6_unmatched", sql(*BG, then=_BT + """ SELECT 'beat' AS side, track_id, t_ms FROM bt WHERE NOT EXISTS (SELECT 1 FROM grid g WHERE g.track_id = bt.track_id AND abs(g.beat_ms - bt.t_ms) <= 60)
    UNION ALL SELECT 'grid', track_id, t_ms FROM gt WHERE NOT EXISTS (SELECT 1 FROM beats b WHERE b.track_id = gt.track_id AND abs(b.beat_ms - gt.t_ms) <= 60)"""))  # fmt: skip
def unmatched(s, d):
    one, two = R.beats(s, d), grid(s, d)
    parts = [asof.within(x.withColumnRenamed("beat_ms", "t_ms"), y, 60.0, anti=True).select(F.lit(n).alias("side"), "track_id", "t_ms") for x, y, n in ((one, two, "beat"), (two, one, "grid"))]
    return parts[0].unionByName(parts[1])


@query(
    "h7_positional_zip",
    sql("asked", "views", then=""", a AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY t_ms) AS r, count(*) OVER (PARTITION BY track_id) AS n FROM asked), b AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY t_ms) AS r, count(*) OVER (PARTITION BY track_id) AS n FROM views)
    SELECT track_id, r - 1 AS position, abs(a.t_ms - b.t_ms) AS difference FROM a JOIN b USING (track_id, r, n)"""),
)
def h7_positional_zip(s, d):
    return asof.positional_zip(R.clicks(s, d, "click"), R.clicks(s, d, "view"), "t_ms", "t_ms")


@query(
    "h8_tumbling",
    sql(*BG, then=OFF + f""",
        l AS (SELECT track_id, floor(t_ms / 10000)::BIGINT AS bucket, list_sort(list(abs(offset_ms))) AS v FROM off WHERE offset_ms IS NOT NULL GROUP BY ALL)
        SELECT track_id, bucket, len(v) AS n, v[len(v) // 2 + 1] AS median_ms, v[least(len(v) - 1, floor(len(v) * 0.9)::INT) + 1] AS p90_ms, list_max(v) AS top_ms, len(list_filter(v, lambda x: x > 60)) AS over FROM l"""),
)
def h8_tumbling(s, d):
    return (
        offsets(s, d)
        .filter("offset_ms IS NOT NULL")
        .groupBy("track_id", F.floor(F.col("t_ms") / 10000).alias("bucket"))
        .agg(F.collect_list(F.abs("offset_ms")).alias("v"))
        .select("track_id", "bucket", F.size("v").alias("n"), N.upper_median(F.col("v")).alias("median_ms"), N.percentile_at(F.col("v"), 0.9).alias("p90_ms"), F.array_max("v").alias("top_ms"), F.size(F.filter("v", lambda x: x > 60)).alias("over"))
    )


@query("h9_sliding", sql("beats", "gaps", then="""
    , w AS (SELECT track_id, gap_ms, unnest(range(greatest(0, floor((beat_ms - 8000) / 4000)::BIGINT + 1), floor(beat_ms / 4000)::BIGINT + 1)) AS k FROM gaps),
    v AS (SELECT track_id, k, list_sort(list(gap_ms)) AS g FROM w GROUP BY ALL HAVING count(*) >= 5),
    m AS (SELECT track_id, k * 4000.0 AS start_ms, len(g) AS n, g[len(g) // 2 + 1] AS median_ms, (g[least(len(g) - 1, floor(len(g) * 0.75)::INT) + 1] - g[floor(len(g) * 0.25)::INT + 1]) / g[len(g) // 2 + 1] AS spread, g FROM v)
    SELECT track_id, start_ms, n, median_ms, spread, len(list_filter(g, lambda x: x >= 1.6 * median_ms)) AS holes FROM m ORDER BY spread DESC, track_id, start_ms LIMIT 10"""))  # fmt: skip
def sliding(s, d):
    """The ten windows of 8 s, every 4 s, whose gaps spread most: a report of the top ten."""
    first = F.greatest(F.lit(0), F.floor((F.col("beat_ms") - 8000) / 4000) + 1)
    each = B.intervals(R.beats(s, d)).withColumn("k", F.explode(F.sequence(first, F.floor(F.col("beat_ms") / 4000))))
    per = each.groupBy("track_id", "k").agg(F.collect_list("gap_ms").alias("g")).filter(F.size("g") >= 5).withColumn("median_ms", N.upper_median(F.col("g")))
    spread = (N.percentile_at(F.col("g"), 0.75) - N.percentile_at(F.col("g"), 0.25)) / F.col("median_ms")
    rows = per.select("track_id", (F.col("k") * 4000.0).alias("start_ms"), F.size("g").alias("n"), "median_ms", spread.alias("spread"), F.size(F.filter("g", lambda x: x >= 1.6 * F.col("median_ms"))).alias("holes"))
    return rows.orderBy(F.desc("spread"), "track_id", "start_ms").limit(10)


_SECT = """,
        sections AS (SELECT track_id, time_ms AS start_ms, lead(time_ms) OVER (PARTITION BY track_id ORDER BY time_ms) AS end_ms, beat_length_ms AS period_ms FROM timing QUALIFY end_ms IS NOT NULL)"""


@query(
    "h10_containment",
    sql("asked", "timing", then=_SECT + " SELECT a.track_id, a.t_ms, start_ms, end_ms, period_ms FROM asked a LEFT JOIN sections s ON s.track_id = a.track_id AND a.t_ms >= start_ms AND a.t_ms < end_ms"),
)
def h10_containment(s, d):
    return asof.containing_interval(R.clicks(s, d, "click"), G.sections(R.timing(s, d)), ["start_ms", "end_ms", "period_ms"])


_FOUND = ", found AS (SELECT track_id, t_ms AS start_ms, t_ms + 150.0 AS end_ms FROM asked)"


@query(
    "h11_overlap",
    sql("asked", "timing", then=_SECT + _FOUND + " SELECT * FROM sections s WHERE EXISTS (SELECT 1 FROM found f WHERE f.track_id = s.track_id AND f.start_ms < s.end_ms AND f.end_ms > s.start_ms)"),
)
def h11_overlap(s, d):
    return asof.overlapping(G.sections(R.timing(s, d)), R.clicks(s, d, "click").select("track_id", F.col("t_ms").alias("start_ms"), (F.col("t_ms") + 150.0).alias("end_ms")))


@query(
    "h12_equi_join",
    """WITH m AS (SELECT doc_id, source, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n_chars DESC) = 1)
        SELECT m.doc_id, source, n_chars, quality FROM m JOIN labels l ON l.doc_id = m.doc_id WHERE EXISTS (SELECT 1 FROM pages p WHERE p.page_id = m.doc_id)""",
)
def h12_equi_join(s, d):
    return (
        R.table(s, d, "documents")
        .groupBy("doc_id")
        .agg(F.max_by(F.struct("source", "n_chars"), "n_chars").alias("m"))
        .select("doc_id", "m.*")
        .join(R.table(s, d, "labels").select("doc_id", "quality"), "doc_id")
        .join(R.table(s, d, "pages").select(F.col("page_id").alias("doc_id")), "doc_id", "left_semi")
    )


@query(
    "h13_parameters",
    sql("beats", "gaps", then=""",
        p AS (SELECT * FROM (VALUES (0.25), (0.5), (1.0)) a(share) CROSS JOIN (VALUES (100.0), (400.0)) b(floor_ms))
        SELECT track_id, share, floor_ms, count(*) FILTER (WHERE gap_ms * share >= floor_ms) AS over FROM gaps CROSS JOIN p GROUP BY ALL"""),
)
def h13_parameters(s, d):
    return (
        B.intervals(R.beats(s, d))
        .withColumn("p", F.explode(F.array(*[F.struct(F.lit(a).alias("share"), F.lit(b).alias("floor_ms")) for a in (0.25, 0.5, 1.0) for b in (100.0, 400.0)])))
        .select("track_id", "gap_ms", "p.*")
        .groupBy("track_id", "share", "floor_ms")
        .agg(F.count_if(F.col("gap_ms") * F.col("share") >= F.col("floor_ms")).alias("over"))
    )


@query(
    "h14_ordered_merge",
    sql("beats", "asked", then=""",
        u AS (SELECT track_id, beat_ms AS t_ms, 0 AS side FROM beats UNION ALL SELECT track_id, t_ms, 1 FROM asked)
        SELECT track_id, t_ms, side, row_number() OVER (PARTITION BY track_id ORDER BY t_ms, side) - 1 AS position FROM u WHERE t_ms >= 2000 AND t_ms < 20000"""),
)
def h14_ordered_merge(s, d):
    return asof.ordered_merge(R.beats(s, d), R.clicks(s, d, "click"), 2000.0, 20000.0, "beat_ms", "t_ms")


@query("h16_histogram", sql("beats", "gaps", then="SELECT round_even(gap_ms / 20, 0) * 20 AS bucket, count(*) AS n FROM gaps GROUP BY 1"))
def h16_histogram(s, d):
    return G.histogram(B.intervals(R.beats(s, d)), F.col("gap_ms"), 20.0)


@query(
    "h17_modes",
    sql("beats", "gaps", then=""",
        b AS (SELECT track_id, round_even(gap_ms / 25, 0) * 25 AS bucket, count(*) AS n FROM gaps GROUP BY ALL)
        SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY n DESC, bucket) AS rank FROM b QUALIFY rank <= 6"""),
)
def h17_modes(s, d):
    return G.modes(B.intervals(R.beats(s, d)).withColumn("bucket", F.rint(F.col("gap_ms") / 25) * 25), "bucket", 6, "track_id")


@query(
    "h18_weighted_mode",
    sql("timing", then=""",
        l AS (SELECT track_id, round_even(beat_length_ms, 0) AS length_ms, lead(time_ms) OVER (PARTITION BY track_id ORDER BY time_ms) - time_ms AS w FROM timing),
        g AS (SELECT track_id, length_ms, round(sum(coalesce(w, 0.0)), 6) AS held_ms FROM l GROUP BY ALL)
        SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY held_ms DESC, length_ms) = 1"""),
)
def h18_weighted_mode(s, d):
    return G.weighted_mode(R.timing(s, d))


_PCT = ", ".join(f"v[least(len(v) - 1, floor(len(v) * {p / 100})::INT) + 1] AS p{p}" for p in (10, 25, 50, 75, 90))


@query(
    "h19_percentiles",
    sql(*BG, then=OFF + f""",
        l AS (SELECT track_id, list_sort(list(abs(offset_ms))) AS v FROM off WHERE offset_ms IS NOT NULL GROUP BY track_id)
        SELECT track_id, len(v) AS n, {_PCT}, list_max(v) AS top FROM l"""),
)
def h19_percentiles(s, d):
    return G.percentiles(offsets(s, d).filter("offset_ms IS NOT NULL").withColumn("a", F.abs("offset_ms")), "a", "track_id")


@query("h20_min_max_mean", sql("activation", then="SELECT track_id, min(x) AS low, max(x) AS high, round(avg(x), 6) AS mean FROM activation GROUP BY track_id"))
def h20_min_max_mean(s, d):
    return R.activation(s, d).groupBy("track_id").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.round(F.avg("x"), 6).alias("mean"))


@query(
    "h21_conditional_share",
    sql("activation", then="SELECT track_id, count(*) FILTER (WHERE x > 0) AS positive, avg(CASE WHEN x > 0.1 THEN 1.0 ELSE 0.0 END) AS strong FROM activation GROUP BY track_id"),
)
def h21_conditional_share(s, d):
    return (
        R.activation(s, d)
        .groupBy("track_id")
        .agg(F.count_if(F.col("x") > 0).alias("positive"), F.avg(F.when(F.col("x") > 0.1, 1.0).otherwise(0.0)).alias("strong"))
    )


@query(
    "h22_median_gap",
    sql("beats", "gaps", then=f""",
        t AS (SELECT track_id, list(gap_ms) AS g FROM gaps WHERE gap_ms > 0 GROUP BY track_id),
        m AS (SELECT *, {upper('g')} AS m FROM t)
        SELECT track_id, m AS median_gap_ms, {upper('list_transform(g, lambda x: abs(x - m))')} AS mad_gap_ms FROM m"""),
)
def h22_median_gap(s, d):
    return B.track_tempo(R.beats(s, d)).select("track_id", "median_gap_ms", "mad_gap_ms")


@query(
    "h23_steadiness",
    sql("beats", "gaps", then=f""",
        c AS (SELECT track_id, abs(gap_ms - lag(gap_ms) OVER (PARTITION BY track_id ORDER BY beat_ms)) AS d FROM gaps),
        l AS (SELECT track_id, list(d) AS v FROM c WHERE d IS NOT NULL GROUP BY track_id)
        SELECT track_id, {upper('v')} AS steadiness_ms FROM l"""),
)
def h23_steadiness(s, d):
    return B.steadiness(R.beats(s, d))


@query("h24_rate_ratio", sql(*BG, then=""", b AS (SELECT track_id, count(*) AS n, max(beat_ms) - min(beat_ms) AS span FROM beats GROUP BY track_id HAVING span > 0), g AS (SELECT track_id, count(*) AS m, max(beat_ms) - min(beat_ms) AS gspan FROM grid GROUP BY track_id HAVING gspan > 0)
    SELECT track_id, (n / span) / (m / gspan) AS ratio, (n / span) / (m / gspan) > 0.75 AND (n / span) / (m / gspan) < 1.33 AS on_level FROM b JOIN g USING (track_id)"""))  # fmt: skip
def rate_ratio(s, d):
    rate = [x.groupBy("track_id").agg((F.count(F.lit(1)) / (F.max("beat_ms") - F.min("beat_ms"))).alias(n), (F.max("beat_ms") - F.min("beat_ms")).alias(f"{n}s")).filter(f"{n}s > 0").select("track_id", n) for x, n in ((R.beats(s, d), "a"), (grid(s, d), "b"))]
    ratio = F.col("a") / F.col("b")
    return rate[0].join(rate[1], "track_id").select("track_id", ratio.alias("ratio"), ((ratio > 0.75) & (ratio < 1.33)).alias("on_level"))


@query(
    "h25_octave_class",
    sql("beats", "timing", "gaps", then=f""",
        m AS (SELECT track_id, list(gap_ms) AS g FROM gaps WHERE gap_ms > 0 GROUP BY track_id),
        t AS (SELECT track_id, list(beat_length_ms) AS b FROM timing GROUP BY track_id),
        r AS (SELECT track_id, log2({upper('g')} / {upper('b')}) AS l FROM m JOIN t USING (track_id))
        SELECT track_id, CASE WHEN abs(l - round_even(l, 0)) <= 0.25 THEN round_even(l, 0)::INT END AS octaves, abs(abs(l) - 1) < 0.15 AS octave_out FROM r"""),
)
def h25_octave_class(s, d):
    return (
        B.track_tempo(R.beats(s, d))
        .join(R.timing(s, d).groupBy("track_id").agg(N.median_of(F.col("beat_length_ms")).alias("b")), "track_id")
        .withColumn("r", F.col("median_gap_ms") / F.col("b"))
        .select("track_id", B.octave_class(F.col("r"), 0.25).alias("octaves"), (F.abs(F.abs(F.log2("r")) - 1) < 0.15).alias("octave_out"))
    )


_CENTRED = ", centred AS (SELECT track_id, frame, x, x - avg(x) OVER (PARTITION BY track_id) AS c FROM signal)"


@query(
    "h27_best_lag",
    sql("beats", "timing", "grid", "signal", then=_CENTRED + """,
        a AS (SELECT track_id, round_even(beat_ms * 2 / 1000, 0)::INT AS place, unnest(range(-8, 9)) AS lag FROM grid),
        p AS (SELECT a.track_id, lag, round(sum(c), 6) AS score FROM a JOIN centred s ON s.track_id = a.track_id AND s.frame = a.place + a.lag GROUP BY ALL)
        SELECT track_id, lag, score FROM p QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY score DESC, lag) = 1"""),
)
def h27_best_lag(s, d):
    return G.best_lag(grid(s, d), R.signal(s, d), fps=2)


@query("h28_octave_choice", sql("timing", "signal", then=f""", sc AS (SELECT * FROM (VALUES (0.25), (0.5), (1.0), (2.0), (4.0)) v(scale)),
    st AS (SELECT *, coalesce(lead(time_ms) OVER (PARTITION BY track_id ORDER BY time_ms), time_ms + 2000.0) AS stop FROM timing),
    g AS (SELECT track_id, scale, time_ms + k * (beat_length_ms * scale) AS beat_ms, beat_length_ms * scale AS len, stop FROM (SELECT *, unnest(range(0, ceil((stop - time_ms) / (beat_length_ms * scale))::BIGINT + 1)) AS k FROM st CROSS JOIN sc)),
    v AS (SELECT g.track_id, scale, coalesce(a.x, 0.0) AS on_beat, coalesce(b.x, 0.0) AS between FROM g LEFT JOIN signal a ON a.track_id = g.track_id AND a.frame = round_even(beat_ms / 400, 0) LEFT JOIN signal b ON b.track_id = g.track_id AND b.frame = round_even((beat_ms + len / 2) / 400, 0) WHERE beat_ms < stop),
    p AS (SELECT track_id, scale, list(on_beat) AS o, list(between) AS w FROM v GROUP BY ALL),
    z AS (SELECT track_id, scale, {upper('o')} - {upper('w')} AS separation FROM p), own AS (SELECT track_id, separation AS own FROM z WHERE scale = 1.0),
    r AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY separation DESC, scale) = 1)
    SELECT track_id, CASE WHEN separation > 1.25 * own THEN scale ELSE 1.0 END AS scale, own AS own_separation, separation AS best_separation FROM r JOIN own USING (track_id)"""))  # fmt: skip
def octave_choice(s, d):
    """The scale of a grid at which beats stand out most against midpoints; another than 1 only if it is clearly better."""
    scaled = R.timing(s, d).withColumn("scale", F.explode(F.array(*map(F.lit, (0.25, 0.5, 1.0, 2.0, 4.0)))))
    beats = G.grid(scaled, 2000.0, F.col("scale"), by=("track_id", "scale"), keep_length=True)
    # On a beat and halfway to the next: one lookup for both.
    places = F.array(F.struct(F.lit(True).alias("on"), F.col("beat_ms").alias("t_ms")), F.struct(F.lit(False).alias("on"), (F.col("beat_ms") + F.col("length_ms") / 2).alias("t_ms")))
    each = beats.select("track_id", "scale", F.explode(places).alias("p")).select("track_id", "scale", "p.*")
    found = asof.value_at_frame(each, R.signal(s, d), "x", F.rint(F.col("t_ms") / 400))
    value = lambda on: N.upper_median(F.collect_list(F.when(F.col("on") == on, F.col("x"))))
    rows = found.groupBy("track_id", "scale").agg((value(True) - value(False)).alias("separation"))
    best = F.array_max(F.collect_list(F.struct("separation", (-F.col("scale")).alias("m"))))
    per = rows.groupBy("track_id").agg(best.alias("b"), F.max(F.when(F.col("scale") == 1.0, F.col("separation"))).alias("own"))
    return per.select("track_id", F.when(F.col("b.separation") > 1.25 * F.col("own"), -F.col("b.m")).otherwise(1.0).alias("scale"), F.col("own").alias("own_separation"), F.col("b.separation").alias("best_separation"))


@query(
    "h29_labels",
    sql("timing", "grid", then=""",
        f AS (SELECT track_id, round_even(beat_ms * 50 / 1000, 0)::INT AS frame, min(beat_ms) AS b FROM grid GROUP BY ALL)
        SELECT track_id, frame, CASE WHEN (row_number() OVER (PARTITION BY track_id ORDER BY b) - 1) % 4 = 0 THEN 2 ELSE 1 END AS label FROM f"""),
)
def h29_labels(s, d):
    return G.labels(grid(s, d))


def _long_signal(then: str) -> str:
    """As ``sql`` over the values of events, the users of a long track together."""
    return "WITH " + R.CTE["signal"].replace("user_id AS track_id", f"user_id // {R.GATHERED} AS track_id").replace("PARTITION BY user_id", f"PARTITION BY user_id // {R.GATHERED}") + " " + then


_AUTO = _CENTRED + """,
        l AS (SELECT a.track_id, k.lag, sum(a.c * b.c) AS cov, sum(a.c * a.c) AS var FROM centred a CROSS JOIN (SELECT unnest(range(8, 61)) AS lag) k JOIN centred b ON b.track_id = a.track_id AND b.frame = a.frame + k.lag GROUP BY ALL),
        ac AS (SELECT track_id, lag::INT AS lag, CASE WHEN var > 0 THEN cov / var ELSE 0.0 END AS r FROM l)"""

_TOPS = """,
        nb AS (SELECT track_id, lag, r, lag(r) OVER w AS b, lead(r) OVER w AS a FROM (SELECT track_id, lag, round(r, 6) AS r FROM ac) WINDOW w AS (PARTITION BY track_id ORDER BY lag)),
        tops AS (SELECT track_id, lag, r, row_number() OVER (PARTITION BY track_id ORDER BY r DESC, lag) AS rank FROM nb WHERE r > b AND r >= a)"""


@query("h31_periodicity_peaks", _long_signal(_AUTO + _TOPS + " SELECT track_id, lag, r, rank FROM tops WHERE rank <= 3"))
def h31_periodicity_peaks(s, d):
    return G.periodicity_peaks(G.autocorrelation(R.signal(s, d, True), range(8, 61)).withColumn("r", F.round("r", 6)))


def _local(low: int, high: int, centres: str) -> str:
    """Self-correlation around centres (track_id, centre): as ``G.local_autocorrelation``, pair by pair."""
    return f"""c AS ({centres}), n AS (SELECT track_id, count(*) AS n FROM signal GROUP BY track_id),
        w AS (SELECT c.*, lag, greatest(centre - 50, 0) AS low, least(centre + 50, n - 1 - lag) AS high FROM c JOIN n USING (track_id) CROSS JOIN (SELECT unnest(range({low}, {high + 1})) AS lag)),
        p AS (SELECT w.track_id, w.centre, w.lag, a.x AS a, b.x AS b, avg(a.x) OVER (PARTITION BY w.track_id, w.centre, w.lag) AS m FROM w JOIN signal a ON a.track_id = w.track_id AND a.frame >= w.low AND a.frame < w.high JOIN signal b ON b.track_id = a.track_id AND b.frame = a.frame + w.lag WHERE high - low >= 4 * lag),
        v AS (SELECT track_id, centre, lag, sum((a - m) * (b - m)) / nullif(sum((a - m) * (a - m)), 0) AS r FROM p GROUP BY ALL),
        ac AS (SELECT w.* EXCLUDE (low, high), round(coalesce(r, 0.0), 6) AS r FROM w LEFT JOIN v USING (track_id, centre, lag))"""


_CENTRES = "SELECT track_id, frame AS centre FROM signal WHERE frame % 64 = 5"


@query("h30_autocorrelation", _long_signal(", " + _local(8, 20, _CENTRES) + " SELECT track_id, centre, lag::INT AS lag, r FROM ac"))
def h30_autocorrelation(s, d):
    """Around every 64th frame or so, over 50 frames on either side."""
    curve = R.signal(s, d, True)
    points = curve.filter(F.col("frame") % 64 == 5).select("track_id", F.col("frame").alias("centre"))
    return G.local_autocorrelation(curve, points, range(8, 21)).withColumn("r", F.round("r", 6))


_EXPECTED = "SELECT track_id, i AS centre, period_ms / 4 AS expected FROM periods WHERE i % 64 = 5"


@query(
    "h32_envelope_period",
    _long_signal(", " + R.CTE["beats"].replace("user_id AS track_id", f"user_id // {R.GATHERED} AS track_id") + ", " + R.CTE["idx"] + _PERIOD + ", " + _local(9, 26, _EXPECTED) + """,
        t AS (SELECT *, lag(r) OVER o AS b, lead(r) OVER o AS f FROM ac WINDOW o AS (PARTITION BY track_id, centre ORDER BY lag)),
        tops AS (SELECT *, max(r) OVER (PARTITION BY track_id, centre) AS best FROM t WHERE r > 0 AND r >= b AND r >= f AND lag BETWEEN 10 AND 25),
        h AS (SELECT * FROM tops WHERE r >= 0.75 * best QUALIFY row_number() OVER (PARTITION BY track_id, centre ORDER BY CASE WHEN expected > 0 THEN abs(lag - expected) ELSE 0 END, lag) = 1)
        SELECT c.track_id, c.centre, c.expected, coalesce(h.lag, 0)::INT AS lag, coalesce(h.r, 0.0) AS r FROM c LEFT JOIN h USING (track_id, centre) WHERE EXISTS (SELECT 1 FROM signal s WHERE s.track_id = c.track_id AND s.frame = c.centre)"""),
)
def envelope_period(s, d):
    """Around the frame of each 64th beat: of the high peaks of the curve's autocorrelation the one nearest to the local period of the beats."""
    place = (F.row_number().over(_track().orderBy("beat_ms")) - 1).alias("centre")
    points = B.local_periods(R.long_beats(s, d)).select("track_id", place, (F.col("period_ms") / 4).alias("expected")).filter(F.col("centre") % 64 == 5)
    rounded = G.local_autocorrelation(R.signal(s, d, True), points, range(9, 27)).withColumn("r", F.round("r", 6))
    return G.nearest_high_peak(rounded, points.columns, 10, 25)


_FLUX = "u AS (SELECT track_id, frame, x AS a, greatest(x - coalesce(lag(x) OVER (PARTITION BY track_id ORDER BY frame), x), 0.0) AS b FROM signal)"


@query(
    "h34_cross_correlation",
    _long_signal(", " + _FLUX + """,
        l AS (SELECT a.track_id, k.lag::INT AS lag, count(*) AS n, corr(a.a, b.b) AS r FROM u a CROSS JOIN (SELECT unnest(range(-8, 9)) AS lag) k JOIN u b ON b.track_id = a.track_id AND b.frame = a.frame + k.lag GROUP BY ALL)
        SELECT track_id, lag, n, CASE WHEN n < 100 THEN '-infinity'::DOUBLE ELSE coalesce(round(r, 6), 0.0) END AS r FROM l"""),
)
def h34_cross_correlation(s, d):
    """A curve against what it gains from frame to frame, up to eight frames before and behind."""
    gained = F.greatest(F.col("x") - F.coalesce(F.lag("x").over(_track().orderBy("frame")), "x"), F.lit(0.0))
    curves = R.signal(s, d, True).select("track_id", "frame", F.col("x").alias("a"), gained.alias("b"))
    return G.cross_correlation(curves, range(-8, 9)).withColumn("r", F.round("r", 6))


@query(
    "h35_comb_scan",
    sql("signal", then=""",
        n AS (SELECT track_id, frame, max(x) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s FROM signal),
        c AS (SELECT track_id, period::INT AS period, (frame % period)::INT AS phase, round(avg(s), 6) AS score FROM n CROSS JOIN (SELECT unnest([5, 6, 7, 8]) AS period) GROUP BY ALL)
        SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY track_id, period ORDER BY score DESC, phase) = 1"""),
)
def h35_comb_scan(s, d):
    return G.comb_scan(R.signal(s, d), (5, 6, 7, 8))


@query(
    "h36_rolling_line",
    sql("beats", "idx", then="SELECT track_id, beat_ms, round(regr_slope(beat_ms, i) OVER w, 4) AS slope, round(regr_intercept(beat_ms, i) OVER w + regr_slope(beat_ms, i) OVER w * i, 3) AS level FROM idx WINDOW w AS (PARTITION BY track_id ORDER BY beat_ms ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)"),
)
def h36_rolling_line(s, d):
    return G.rolling_line(R.beats(s, d), 4).select("track_id", "beat_ms", F.round("slope", 4).alias("slope"), F.round("level", 3).alias("level"))


@query(
    "h37_prediction_errors",
    sql("beats", "idx", then=""",
        f AS (SELECT track_id, beat_ms, count(*) OVER w AS k, regr_intercept(beat_ms, i) OVER w + regr_slope(beat_ms, i) OVER w * i AS told, 2 * lag(beat_ms, 1) OVER t - lag(beat_ms, 2) OVER t AS last FROM idx WINDOW w AS (PARTITION BY track_id ORDER BY beat_ms ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING),
        t AS (PARTITION BY track_id ORDER BY beat_ms))
        SELECT track_id, beat_ms, round(abs(beat_ms - told), 3) AS line_error, abs(beat_ms - last) AS gap_error FROM f WHERE k = 12"""),
)
def h37_prediction_errors(s, d):
    return G.prediction_errors(R.beats(s, d)).withColumn("line_error", F.round("line_error", 3))


@query(
    "h38_downsampled",
    sql("signal", then="SELECT track_id, (frame // 5) * 100.0 AS time_ms, round(60.0 * 50 / CASE WHEN avg(x) > 0 THEN avg(x) END, 6) AS bpm, round(avg(x * x), 6) AS confidence FROM signal GROUP BY track_id, frame // 5"),
)
def h38_downsampled(s, d):
    return (
        G.downsampled(R.signal(s, d).withColumn("c", F.col("x") * F.col("x")), "x", "c")
        .withColumns({"bpm": F.round("bpm", 6), "confidence": F.round("confidence", 6)})
    )


@query(
    "h39_decile_profile",
    sql("activation", then=""",
        n AS (SELECT *, count(*) OVER (PARTITION BY track_id) AS n FROM activation),
        t AS (SELECT n.*, k FROM n CROSS JOIN (SELECT unnest(range(0, 10)) AS k) WHERE frame >= (k * n) // 10 AND frame < ((k + 1) * n) // 10)
        SELECT track_id, k::INT AS tenth, count(*) FILTER (WHERE x > 0) AS positive, max(x) AS top, count(*) AS frames FROM t GROUP BY ALL"""),
)
def h39_decile_profile(s, d):
    return G.decile_profile(R.activation(s, d))


def strength_at(s, d, points, radius=1, name="top"):
    """Points with the largest signal value within ``radius`` frames of 400 ms, 0 outside the track."""
    return asof.value_at_frame(points, P.max_near(R.signal(s, d), radius, name=name).select("track_id", "frame", name), name, F.rint(F.col("t_ms") / 400))


_TOP = """,
        near AS (SELECT track_id, frame, max(x) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING) AS top FROM signal)"""


@query(
    "h40_hit_rate",
    sql("beats", "signal", then=_TOP.format(r=1) + """,
        m AS (SELECT track_id, avg(x) AS mean FROM signal GROUP BY track_id),
        h AS (SELECT b.track_id, coalesce(top, 0.0) AS top, mean FROM beats b LEFT JOIN near n ON n.track_id = b.track_id AND n.frame = round_even(beat_ms / 400, 0) JOIN m ON m.track_id = b.track_id)
        SELECT track_id, round(avg(top) / any_value(mean), 6) AS gain, avg(CASE WHEN top > mean THEN 1.0 ELSE 0.0 END) AS above FROM h GROUP BY track_id"""),
)
def h40_hit_rate(s, d):
    return (
        strength_at(s, d, R.beats(s, d).withColumnRenamed("beat_ms", "t_ms"))
        .join(R.signal(s, d).groupBy("track_id").agg(N.mean_in_order(F.col("x"), F.col("frame")).alias("mean")), "track_id")
        .groupBy("track_id")
        .agg(F.round(F.avg("top") / F.first("mean"), 6).alias("gain"), F.avg(F.when(F.col("top") > F.col("mean"), 1.0).otherwise(0.0)).alias("above"))
    )


@query(
    "h41_summaries",
    sql(*BG, "gaps", then=OFF + f""", a AS (SELECT track_id, list(abs(offset_ms)) AS v FROM off WHERE offset_ms IS NOT NULL GROUP BY track_id), b AS (SELECT track_id, list(gap_ms) AS g FROM gaps GROUP BY track_id), r AS (SELECT track_id, {upper('v')} AS error_ms, {upper('g')} AS gap_ms FROM a JOIN b USING (track_id))
    SELECT track_id, 'error_ms' AS metric, error_ms AS value, rank() OVER (ORDER BY error_ms) AS place FROM r UNION ALL SELECT track_id, 'gap_ms', gap_ms, rank() OVER (ORDER BY gap_ms) FROM r"""),
)
def h41_summaries(s, d):
    return summaries(s, d)


def summaries(s, d):
    """Medians of each track, unpivoted, with their place among the tracks (one row for each track)."""
    a = offsets(s, d).filter("offset_ms IS NOT NULL").groupBy("track_id").agg(N.median_of(F.abs("offset_ms")).alias("error_ms"))
    b = B.intervals(R.beats(s, d)).groupBy("track_id").agg(N.median_of(F.col("gap_ms")).alias("gap_ms"))
    rows = a.join(b, "track_id").unpivot("track_id", ["error_ms", "gap_ms"], "metric", "value")
    return G.ranks(rows, "metric", "value")


_CLASS = """,
        c AS (SELECT g.track_id, g.beat_ms, round_even(g.gap_ms / t.beat_length_ms, 0)::INT AS times FROM gaps g ASOF JOIN timing t ON g.track_id = t.track_id AND g.beat_ms >= t.time_ms)"""


def gap_classes(s, d):
    held = asof.asof_join(B.intervals(R.beats(s, d)).withColumnRenamed("beat_ms", "t_ms"), R.timing(s, d), ["beat_length_ms"], right_time="time_ms").filter("beat_length_ms IS NOT NULL")
    return held.select("track_id", "t_ms", F.rint(F.col("gap_ms") / F.col("beat_length_ms")).cast("int").alias("times"))


@query("h42_gap_class_runs", sql("beats", "timing", "gaps", then=_CLASS + ", r AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY beat_ms) - row_number() OVER (PARTITION BY track_id, times ORDER BY beat_ms) AS run FROM c WHERE times BETWEEN 1 AND 9), l AS (SELECT track_id, times, run, count(*) AS n FROM r GROUP BY ALL) SELECT times, n AS length, count(*) AS runs FROM l GROUP BY ALL"))
def gap_class_runs(s, d):
    rows = gap_classes(s, d).filter("times BETWEEN 1 AND 9")
    run = F.row_number().over(_track().orderBy("t_ms")) - F.row_number().over(Window.partitionBy("track_id", "times").orderBy("t_ms"))
    return rows.withColumn("run", run).groupBy("track_id", "times", "run").agg(F.count(F.lit(1)).alias("length")).groupBy("times", "length").agg(F.count(F.lit(1)).alias("runs"))


@query(
    "h43_nearest_object",
    sql("asked", "views", then=", bv AS (SELECT track_id, t_ms AS beat_ms FROM views)" + _NEAR.format(out="o", left="asked", right="bv") + " SELECT track_id, t_ms, offset_ms FROM o"),
)
def h43_nearest_object(s, d):
    return asof.nearest(R.clicks(s, d, "click"), R.clicks(s, d, "view").withColumnRenamed("t_ms", "beat_ms"))


@query(
    "h44_range_count",
    sql("beats", "timing", then="SELECT track_id, count(*) AS beats, (SELECT count(*) FROM timing t WHERE t.track_id = b.track_id AND time_ms >= 5000 AND time_ms < 15000) AS points FROM beats b WHERE beat_ms >= 5000 AND beat_ms < 15000 GROUP BY track_id"),
)
def h44_range_count(s, d):
    return (
        R.beats(s, d)
        .filter(N.in_range(F.col("beat_ms"), 5000, 15000))
        .groupBy("track_id")
        .agg(F.count(F.lit(1)).alias("beats"))
        .join(R.timing(s, d).filter(N.in_range(F.col("time_ms"), 5000, 15000)).groupBy("track_id").agg(F.count(F.lit(1)).alias("points")), "track_id", "left")
        .fillna({"points": 0})
    )


_PARTS = ((0.0, 6000.0), (6000.0, 14000.0), (14000.0, 26000.0))


@query(
    "h45_section_metrics",
    sql(*BG, then=OFF + f""",
        l AS (SELECT p.start_ms, p.end_ms, list(abs(offset_ms)) AS v FROM off JOIN (VALUES {', '.join(map(str, _PARTS))}) p(start_ms, end_ms) ON t_ms >= p.start_ms AND t_ms < p.end_ms WHERE offset_ms IS NOT NULL GROUP BY ALL)
        SELECT start_ms, end_ms, len(v) AS n, {upper('v')} AS median_ms, len(list_filter(v, lambda x: x <= 60)) / len(v) AS hits FROM l"""),
)
def h45_section_metrics(s, d):
    return section_metrics(s, d)


def section_metrics(s, d):
    """Error medians over a literal list of sections: the list is a column expression, so that nothing is joined."""
    part = F.filter(F.array(*[F.struct(F.lit(a).alias("start_ms"), F.lit(b).alias("end_ms")) for a, b in _PARTS]), lambda p: (F.col("t_ms") >= p["start_ms"]) & (F.col("t_ms") < p["end_ms"]))
    rows = offsets(s, d).filter("offset_ms IS NOT NULL").withColumn("p", F.explode(part))
    per = rows.groupBy("p.start_ms", "p.end_ms").agg(F.collect_list(F.abs("offset_ms")).alias("v"))
    return per.select("start_ms", "end_ms", F.size("v").alias("n"), N.upper_median(F.col("v")).alias("median_ms"), (F.size(F.filter("v", lambda x: x <= 60)) / F.size("v")).alias("hits"))


@query(
    "h46_positive_share",
    sql("timing", "grid", "signal", then="SELECT g.track_id, avg(CASE WHEN coalesce(x, 0.0) > 30 THEN 1.0 ELSE 0.0 END) AS share FROM grid g LEFT JOIN signal s ON s.track_id = g.track_id AND s.frame = round_even(beat_ms / 400, 0) GROUP BY g.track_id"),
)
def h46_positive_share(s, d):
    return (
        asof.value_at_frame(grid(s, d), R.signal(s, d), "x", F.rint(F.col("beat_ms") / 400))
        .groupBy("track_id")
        .agg(F.avg(F.when(F.col("x") > 30, 1.0).otherwise(0.0)).alias("share"))
    )


@query(
    "h47_max_near",
    sql("asked", "signal", then=_TOP.format(r=2) + " SELECT a.track_id, a.t_ms, coalesce(top, 0.0) AS top FROM asked a LEFT JOIN near n ON n.track_id = a.track_id AND n.frame = round_even(t_ms / 400, 0)"),
)
def h47_max_near(s, d):
    return strength_at(s, d, R.clicks(s, d, "click"), 2)


@query(
    "h48_residues",
    sql(*BG, then=OFF + """,
        w AS (SELECT (offset_ms + 1.5 * 300.0) % 300.0 - 0.5 * 300.0 AS r FROM off WHERE offset_ms IS NOT NULL)
        SELECT floor((r + 150) / 25)::BIGINT AS bin, count(*) AS n FROM w GROUP BY 1"""),
)
def h48_residues(s, d):
    return (
        offsets(s, d)
        .filter("offset_ms IS NOT NULL")
        .select(N.wrapped(F.col("offset_ms"), F.lit(300.0)).alias("r"))
        .groupBy(F.floor((F.col("r") + 150) / 25).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "h49_on_off_grid",
    sql(*BG, "signal", then=OFF + _TOP.format(r=1) + " SELECT abs(offset_ms) <= 60 AS on_grid, count(*) AS n, round(avg(coalesce(top, 0.0)), 6) AS mean FROM off o LEFT JOIN near n ON n.track_id = o.track_id AND n.frame = round_even(t_ms / 400, 0) WHERE offset_ms IS NOT NULL GROUP BY 1"),
)
def h49_on_off_grid(s, d):
    return (
        strength_at(s, d, offsets(s, d).filter("offset_ms IS NOT NULL"))
        .groupBy((F.abs("offset_ms") <= 60).alias("on_grid"))
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("top"), 6).alias("mean"))
    )


@query(
    "h50_evenness",
    sql("beats", "idx", then=f""",
        g AS (SELECT track_id, gap_ms, list(gap_ms) OVER (PARTITION BY track_id ORDER BY i ROWS BETWEEN 8 PRECEDING AND 7 FOLLOWING) AS l FROM idx WHERE gap_ms IS NOT NULL)
        SELECT track_id, avg(CASE WHEN abs(gap_ms - {upper('l')}) <= 0.25 * {upper('l')} THEN 1.0 ELSE 0.0 END) AS evenness FROM g GROUP BY track_id"""),
)
def h50_evenness(s, d):
    return B.evenness(R.beats(s, d))


@query(
    "h51_rms_tone",
    sql("activation", then="SELECT track_id, round(sqrt(avg(x * x)), 6) AS rms, round(2 * sqrt(pow(sum(x * cos(2 * pi() * 5 * frame / 64)), 2) + pow(sum(x * sin(2 * pi() * 5 * frame / 64)), 2)) / count(*), 6) AS tone FROM activation GROUP BY track_id"),
)
def h51_rms_tone(s, d):
    return rms_tone(R.activation(s, d), 5, 64)


def rms_tone(curve, cycles: float, length: float):
    """track_id, rms, tone: root mean square, and the amplitude of one frequency."""
    angle = 2 * F.pi() * cycles * F.col("frame") / length
    c, q = F.sum(F.col("x") * F.cos(angle)), F.sum(F.col("x") * F.sin(angle))
    return curve.groupBy("track_id").agg(F.round(F.sqrt(F.avg(F.col("x") * F.col("x"))), 6).alias("rms"), F.round(2 * F.sqrt(F.pow(c, 2) + F.pow(q, 2)) / F.count(F.lit(1)), 6).alias("tone"))


@query("h52_beats_vs_midpoints", sql("beats", "gaps", "signal", then=_TOP.format(r=3) + """, m AS (SELECT track_id, beat_ms, trunc(round_even(beat_ms / 400, 0) - (round_even(beat_ms / 400, 0) - round_even((beat_ms - gap_ms) / 400, 0)) / 2)::INT AS mid FROM gaps)
    SELECT m.track_id, round(avg(coalesce(a.x, 0.0)), 6) AS at_beat, round(avg(coalesce(b.x, 0.0)), 6) AS at_mid, round(avg(coalesce(n.top, 0.0)), 6) AS near_mid, avg(CASE WHEN coalesce(b.x, 0.0) > 30 THEN 1.0 ELSE 0.0 END) AS strong_mid FROM m
    LEFT JOIN signal a ON a.track_id = m.track_id AND a.frame = round_even(beat_ms / 400, 0) LEFT JOIN signal b ON b.track_id = m.track_id AND b.frame = mid LEFT JOIN near n ON n.track_id = m.track_id AND n.frame = mid GROUP BY m.track_id"""))  # fmt: skip
def beats_vs_midpoints(s, d):
    curve = R.signal(s, d)
    at = F.rint(F.col("beat_ms") / 400)
    rows = B.intervals(R.beats(s, d)).withColumns({"at": at, "mid": N.truncated(at - (at - F.rint((F.col("beat_ms") - F.col("gap_ms")) / 400)) / 2)})
    rows = asof.value_at_frame(rows, curve, "x", F.col("at")).withColumnRenamed("x", "a")
    rows = asof.value_at_frame(rows, curve, "x", F.col("mid")).withColumnRenamed("x", "b")
    rows = asof.value_at_frame(rows, P.max_near(curve, 3).select("track_id", "frame", "top"), "top", F.col("mid"))
    return rows.groupBy("track_id").agg(*[F.round(F.avg(c), 6).alias(n) for c, n in (("a", "at_beat"), ("b", "at_mid"), ("top", "near_mid"))], F.avg(F.when(F.col("b") > 30, 1.0).otherwise(0.0)).alias("strong_mid"))


@query(
    "h53_displacement",
    sql("beats", then=""",
        a AS (SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY beat_ms) AS r, beat_ms FROM beats),
        b AS (SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY m) AS r, m FROM (SELECT track_id, round_even(beat_ms / 5, 0) * 5 AS m FROM beats))
        SELECT track_id, count(*) FILTER (WHERE abs(beat_ms - m) > 0.5) AS moved, round(avg(abs(beat_ms - m)) FILTER (WHERE abs(beat_ms - m) > 0.5), 6) AS mean_ms FROM a JOIN b USING (track_id, r) GROUP BY track_id"""),
)
def h53_displacement(s, d):
    return (
        asof.positional_zip(R.beats(s, d), R.beats(s, d).select("track_id", (F.rint(F.col("beat_ms") / 5) * 5).alias("m")), "beat_ms", "m")
        .groupBy("track_id")
        .agg(F.count_if(F.col("difference") > 0.5).alias("moved"), F.round(F.avg(F.when(F.col("difference") > 0.5, F.col("difference"))), 6).alias("mean_ms"))
    )


@query("h54_section_errors", sql("asked", "timing", then=_SECT + """, f AS (SELECT track_id, t_ms AS start_ms, lead(t_ms) OVER (PARTITION BY track_id ORDER BY t_ms) AS end_ms FROM asked QUALIFY end_ms IS NOT NULL), g AS (SELECT *, (start_ms + end_ms) / 2 AS mid_ms, (end_ms - start_ms) / 6 AS found_ms FROM f),
    j AS (SELECT g.*, s.period_ms, abs(g.found_ms - s.period_ms) / s.period_ms AS error, log2(g.found_ms / s.period_ms) AS l FROM g JOIN sections s ON s.track_id = g.track_id AND g.mid_ms >= s.start_ms AND g.mid_ms < s.end_ms)
    SELECT track_id, count(*) AS sections, count(*) FILTER (WHERE abs(abs(l) - 1) < 0.15) AS octave_out, round(avg(error) FILTER (WHERE NOT abs(abs(l) - 1) < 0.15), 6) AS error, round(sum(error * (end_ms - start_ms)), 4) AS drift_ms, avg(CASE WHEN error <= 0.02 THEN 1.0 ELSE 0.0 END) AS within_2 FROM j GROUP BY track_id"""))  # fmt: skip
def section_errors(s, d):
    w = _track().orderBy("t_ms")
    found = R.clicks(s, d, "click").select("track_id", F.col("t_ms").alias("from_ms"), F.lead("t_ms").over(w).alias("to_ms")).filter("to_ms IS NOT NULL")
    found = found.withColumns({"t_ms": (F.col("from_ms") + F.col("to_ms")) / 2, "found_ms": (F.col("to_ms") - F.col("from_ms")) / 6})
    rows = asof.containing_interval(found, G.sections(R.timing(s, d)), ["start_ms", "period_ms"]).filter("period_ms IS NOT NULL")
    rows = rows.withColumns({"error": F.abs(F.col("found_ms") - F.col("period_ms")) / F.col("period_ms"), "out": F.abs(F.abs(F.log2(F.col("found_ms") / F.col("period_ms"))) - 1) < 0.15})
    return rows.groupBy("track_id").agg(F.count(F.lit(1)).alias("sections"), F.count_if("out").alias("octave_out"), F.round(F.avg(F.when(~F.col("out"), F.col("error"))), 6).alias("error"), F.round(F.sum(F.col("error") * (F.col("to_ms") - F.col("from_ms"))), 4).alias("drift_ms"), F.avg(F.when(F.col("error") <= 0.02, 1.0).otherwise(0.0)).alias("within_2"))


@query(
    "h55_gap_class_evidence",
    sql("beats", "timing", "gaps", "signal", then=_CLASS + " SELECT times, count(*) AS n, round(avg(coalesce(x, 0.0)), 6) AS mean FROM c LEFT JOIN signal s ON s.track_id = c.track_id AND s.frame = round_even(beat_ms / 400, 0) WHERE times BETWEEN 1 AND 6 GROUP BY times"),
)
def h55_gap_class_evidence(s, d):
    return (
        asof.value_at_frame(gap_classes(s, d).filter("times BETWEEN 1 AND 6"), R.signal(s, d), "x", F.rint(F.col("t_ms") / 400))
        .groupBy("times")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), 6).alias("mean"))
    )


@query(
    "e20_onset_compare",
    sql("beats", "gaps", "signal", then=_TOP.format(r=1) + """, k AS (SELECT track_id, count(*) AS k FROM beats GROUP BY track_id), v AS (SELECT g.track_id, coalesce(a.top, 0.0) AS a, coalesce(b.top, 0.0) AS m FROM gaps g LEFT JOIN near a ON a.track_id = g.track_id AND a.frame = round_even(beat_ms / 400, 0) LEFT JOIN near b ON b.track_id = g.track_id AND b.frame = round_even((beat_ms - gap_ms / 2) / 400, 0))
    SELECT v.track_id, CASE WHEN k < 4 THEN 0.0 ELSE round(avg(a), 6) END AS at_beats, CASE WHEN k < 4 THEN 0.0 ELSE round(avg(m), 6) END AS at_midpoints, k >= 4 AND avg(a) > 0 AND avg(m) >= 0.6 * avg(a) AS looks_halved FROM v JOIN k USING (track_id) GROUP BY v.track_id, k"""),
)
def e20_onset_compare(s, d):
    return onset_compare(s, d)


def onset_compare(s, d):
    """track_id, at_beats, at_midpoints, looks_halved: flux near beats against flux halfway to the beat before."""
    tops = P.max_near(R.signal(s, d), 1).select("track_id", "frame", "top")
    rows = B.intervals(R.beats(s, d))
    rows = asof.value_at_frame(rows, tops, "top", F.rint(F.col("beat_ms") / 400)).withColumnRenamed("top", "a")
    rows = asof.value_at_frame(rows, tops, "top", F.rint((F.col("beat_ms") - F.col("gap_ms") / 2) / 400))
    per = rows.groupBy("track_id").agg(F.avg("a").alias("a"), F.avg("top").alias("m"), (F.count(F.lit(1)) + 1).alias("k"))
    few = F.col("k") < 4
    return per.select("track_id", F.when(few, 0.0).otherwise(F.round("a", 6)).alias("at_beats"), F.when(few, 0.0).otherwise(F.round("m", 6)).alias("at_midpoints"), (~few & (F.col("a") > 0) & (F.col("m") >= 0.6 * F.col("a"))).alias("looks_halved"))
