"""Queries on event trains: a user's events are a train, the event types are its markers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions.tiers import profile_tier
from pulsegrid.operators import bands, event_windows, matching, sequence
from pulsegrid.operators import statistics as st
from pulsegrid.plans.base import register, rounded
from pulsegrid.session import table

S = 1_000_000
MIN, HOUR, DAY = 60 * S, 3600 * S, 86400 * S

TRAIN = "tr AS (SELECT user_id AS unit, event_id, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) AS t, event_type AS kind, value AS amp FROM events)"
ISI = TRAIN + ", isi AS (SELECT *, t - lag(t) OVER (PARTITION BY unit ORDER BY t, event_id) AS isi FROM tr), isi2 AS (SELECT *, lag(isi) OVER (PARTITION BY unit ORDER BY t, event_id) AS prev FROM isi)"


def train(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    t = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    return e.select(F.col("user_id").alias("unit"), "event_id", t.alias("t"), F.col("event_type").alias("kind"), F.col("value").alias("amp"))


def of_kind(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return train(spark, sf_dir).filter(F.col("kind") == kind)


STATS_SQL = """count(*) AS n_events, avg(isi) / 1e6 AS mean_interval, CASE WHEN count(*) >= 3 THEN stddev_pop(isi / 1e6) / (avg(isi / 1e6) + 1e-12) END AS cv,
CASE WHEN count(*) >= 3 THEN 3 * avg(pow((prev - isi) / (prev + isi + 1e-6), 2)) END AS lv, coalesce(avg(CASE WHEN isi < 600000000 THEN 1.0 WHEN isi IS NOT NULL THEN 0.0 END), 0.0) AS refractory_rate"""


@register(f"WITH {ISI} SELECT unit, n_events, round(mean_interval, 6) AS mean_interval, round(cv, 6) AS cv, round(lv, 6) AS lv, round(refractory_rate, 6) AS refractory_rate FROM (SELECT unit, {STATS_SQL} FROM isi2 GROUP BY unit)")
def isi_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sequence.interval_statistics(train(spark, sf_dir), "unit", "t", 10 * MIN, S))


@register(f"""WITH {ISI}, s AS (SELECT unit, {STATS_SQL} FROM isi2 GROUP BY unit),
c AS (SELECT unit, least(floor(t / 86400000000.0), 29) AS w, count(*) AS n FROM tr GROUP BY ALL),
r AS (SELECT unit, sum(n) / 2592000.0 AS mean_rate, sqrt(greatest(sum(n * n) / 30 / pow(86400.0, 2) - pow(sum(n) / 30 / 86400.0, 2), 0)) / (sum(n) / 30 / 86400.0 + 1e-9) AS rate_cv, sum(n) AS total FROM c GROUP BY unit)
SELECT unit, n_events, round(mean_rate * 86400, 6) AS events_per_day, round(CASE WHEN total >= 2 THEN rate_cv END, 6) AS rate_cv, round(cv, 6) AS cv, round(lv, 6) AS lv, round(refractory_rate, 6) AS refractory_rate,
CASE WHEN n_events < 30 THEN 'too_few' WHEN refractory_rate > 0.05 THEN 'contaminated' WHEN lv > 1.2 THEN 'bursty' WHEN lv < 0.8 THEN 'regular' ELSE 'irregular' END AS tier
FROM s JOIN r USING (unit)""")
def unit_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = train(spark, sf_dir)
    s = sequence.interval_statistics(events, "unit", "t", 10 * MIN, S)
    r = sequence.window_rates(events, "unit", "t", DAY, 30 * DAY, S).drop("n_events")
    out = s.join(r, "unit").withColumn("events_per_day", F.col("mean_rate") * 86400)
    tier = profile_tier(F.col("n_events"), F.col("refractory_rate"), F.col("lv"))
    return rounded(out.withColumn("tier", tier).select("unit", "n_events", "events_per_day", "rate_cv", "cv", "lv", "refractory_rate", "tier"))


@register(f"""WITH {TRAIN}, c AS (SELECT unit, least(floor(t / 43200000000.0), 59) AS w, count(*) AS n FROM tr GROUP BY ALL)
SELECT unit, CAST(sum(n) AS BIGINT) AS n_events, round(sum(n) / 2592000.0 * 1e3, 6) AS mean_rate_mhz,
round(CASE WHEN sum(n) >= 2 THEN sqrt(greatest(sum(n * n) / 60 / pow(43200.0, 2) - pow(sum(n) / 60 / 43200.0, 2), 0)) / (sum(n) / 60 / 43200.0 + 1e-9) END, 6) AS rate_cv FROM c GROUP BY unit""")
def rate_cv_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sequence.window_rates(train(spark, sf_dir), "unit", "t", DAY // 2, 30 * DAY, S)
    return rounded(out.select("unit", "n_events", (F.col("mean_rate") * 1e3).alias("mean_rate_mhz"), "rate_cv"))


@register(f"WITH {ISI} SELECT unit, t - isi AS t0, t AS t1, isi AS missing FROM isi WHERE isi > 172800000000")
def recording_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.gaps(train(spark, sf_dir), "unit", "t", 2 * DAY)


@register(f"""WITH {ISI}, s AS (SELECT *, sum(CASE WHEN isi > 43200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY unit ORDER BY t, event_id) AS session FROM isi)
SELECT unit, CAST(session AS BIGINT) AS session, min(t) AS t0, max(t) AS t1, count(*) AS n_events FROM s GROUP BY unit, session""")
def state_sessionise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.sessions(train(spark, sf_dir), "unit", "t", DAY // 2)


@register(f"WITH {TRAIN}, c AS (SELECT unit, t, lag(kind) OVER (PARTITION BY unit ORDER BY t, event_id) AS was, kind AS now FROM tr) SELECT * FROM c WHERE was IS NOT NULL AND was <> now")
def change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.changes(train(spark, sf_dir), "unit", "t", "kind", "event_id")


@register(f"WITH {ISI} SELECT unit, event_id, round(quantile_cont(amp, 0.5) OVER (PARTITION BY unit ORDER BY t, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS local_median FROM isi")
def rolling_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sequence.rolling_median(train(spark, sf_dir), "unit", ["t", "event_id"], "amp", 7).select("unit", "event_id", "local_median"))


@register(f"""WITH {ISI}, m AS (SELECT *, quantile_cont(isi, 0.5) OVER (PARTITION BY unit ORDER BY t, event_id ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS med,
 count(*) OVER (PARTITION BY unit ORDER BY t RANGE BETWEEN 1 FOLLOWING AND 43200000000 FOLLOWING) AS n_rebound FROM isi),
k AS (SELECT *, t - isi AS t0 FROM isi WHERE isi IS NOT NULL),
med AS (SELECT k.unit, k.event_id, quantile_cont(k.isi, 0.5) OVER (PARTITION BY k.unit ORDER BY k.t, k.event_id ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS local_median FROM k)
SELECT k.unit, k.t0, k.t AS t1, m.n_rebound FROM k JOIN med USING (event_id) JOIN m USING (event_id) WHERE k.isi > 3 * (med.local_median + 1e-12)""")
def pause_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.pauses(train(spark, sf_dir), "unit", "t", 11, 3.0, DAY // 2, "event_id")


@register(f"""WITH RECURSIVE {TRAIN}, o AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY t, event_id) AS rn FROM tr),
k AS (SELECT unit, event_id, rn, t, t AS last, true AS kept FROM o WHERE rn = 1
 UNION ALL SELECT o.unit, o.event_id, o.rn, o.t, CASE WHEN o.t - k.last >= 43200000000 THEN o.t ELSE k.last END, o.t - k.last >= 43200000000 FROM k JOIN o ON o.unit = k.unit AND o.rn = k.rn + 1)
SELECT unit, event_id, t FROM k WHERE kept""")
def dead_time_thin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.thin(train(spark, sf_dir).select("unit", "event_id", "t"), "unit", "t", DAY // 2)


@register()
def burst_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.bursts(train(spark, sf_dir), "unit", "t", 2 * HOUR, S)


PAIRS = TRAIN + ", p AS (SELECT a.unit, b.t - a.t AS lag FROM tr a JOIN tr b ON a.unit = b.unit AND b.t - a.t BETWEEN 0 AND 21600000000 AND (b.t > a.t OR (b.t = a.t AND b.event_id > a.event_id))), m AS (SELECT unit, lag FROM p UNION ALL SELECT unit, -lag FROM p), h AS (SELECT unit, CAST(least(floor(lag / 600000000.0), 35) AS BIGINT) AS bin, count(*) AS n FROM m GROUP BY ALL)"


@register(f"WITH {PAIRS} SELECT unit, bin, n FROM h")
def acg_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bands.autocorrelogram(train(spark, sf_dir), "unit", "t", "event_id", 6 * HOUR, 10 * MIN)


@register(f"""WITH {PAIRS}, s AS (SELECT unit, CAST(sum(CASE WHEN abs(bin + 0.5) <= 3 THEN n ELSE 0 END) AS BIGINT) AS n_refractory, sum(CASE WHEN abs(bin + 0.5) BETWEEN 6 AND 30 THEN n ELSE 0 END) / 48 * 6 AS expected FROM h GROUP BY unit)
SELECT unit, n_refractory, round(expected, 6) AS expected, CASE WHEN expected > 0 THEN round(n_refractory / expected, 6) WHEN n_refractory > 0 THEN 'Infinity'::DOUBLE ELSE 0.0 END AS ratio FROM s""")
def acg_violation_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = bands.autocorrelogram(train(spark, sf_dir), "unit", "t", "event_id", 6 * HOUR, 10 * MIN)
    return rounded(bands.violation_ratio(h, "unit", 10 * MIN, 30 * MIN, (HOUR, 5 * HOUR)))


CROSS = TRAIN + ", h AS (SELECT a.unit, CAST(least(floor((b.t - a.t) / 3600000000.0), 47) AS BIGINT) AS bin, count(*) AS n FROM tr a JOIN tr b ON a.unit = b.unit AND a.kind = 'click' AND b.kind = 'view' AND b.t - a.t BETWEEN -172800000000 AND 172800000000 GROUP BY ALL)"


@register(f"WITH {CROSS} SELECT unit, bin, n FROM h")
def ccg_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bands.crosscorrelogram(of_kind(spark, sf_dir, "click").select("unit", "t"), of_kind(spark, sf_dir, "view").select("unit", "t"), "t", ["unit"], 2 * DAY, HOUR)


@register(f"""WITH {CROSS}, s AS (SELECT unit, CAST(sum(CASE WHEN abs(bin + 0.5) <= 3 THEN n ELSE 0 END) AS BIGINT) AS n_refractory, CAST(sum(n) AS BIGINT) AS n_total, sum(CASE WHEN abs(bin + 0.5) >= 12 THEN n ELSE 0 END) / 72 AS flank,
 arg_max((bin + 0.5) * 3600000000.0, n * 1000 - bin) AS peak_lag FROM h GROUP BY unit)
SELECT unit, n_refractory, n_total, round(flank, 6) AS flank_per_bin, peak_lag, round(flank * 6, 6) AS expected, CASE WHEN flank > 0 THEN round(n_refractory / (flank * 6), 6) END AS dip_ratio FROM s""")
def ccg_dip_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bands.dip_metrics(ccg_histogram(spark, sf_dir), "unit", HOUR, 2 * DAY, 3 * HOUR, 12 * HOUR))


@register(f"""WITH {TRAIN}, a AS (SELECT * FROM tr WHERE kind = 'click'), b AS (SELECT * FROM tr WHERE kind = 'view'),
hits AS (SELECT a.unit, count(*) AS n FROM a JOIN b ON a.unit = b.unit AND b.t >= a.t - 7200000000 AND b.t < a.t + 7200000000 GROUP BY 1),
sa AS (SELECT unit, count(*) AS n1, min(t) AS a1, max(t) AS b1 FROM a GROUP BY 1), sb AS (SELECT unit, count(*) AS n2, min(t) AS a2, max(t) AS b2 FROM b GROUP BY 1)
SELECT unit, coalesce(n, 0) AS n_coincident, round(coalesce(n, 0) / (n1 * (CASE WHEN greatest(b1, b2) > least(a1, a2) THEN n2 / ((greatest(b1, b2) - least(a1, a2)) / 1e6) ELSE 0 END) * 14400 + 1e-9), 6) AS excess
FROM sa JOIN sb USING (unit) LEFT JOIN hits USING (unit)""")
def synchrony_excess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bands.synchrony_excess(of_kind(spark, sf_dir, "click"), of_kind(spark, sf_dir, "view"), "unit", "t", 2 * HOUR, S))


@register(f"WITH {TRAIN} SELECT a.unit, a.event_id, a.t - max(b.t) AS preceding FROM tr a LEFT JOIN tr b ON a.unit = b.unit AND b.kind = 'click' AND b.t < a.t WHERE a.kind = 'purchase' GROUP BY a.unit, a.event_id, a.t")
def asof_preceding(spark: SparkSession, sf_dir: str) -> DataFrame:
    markers = of_kind(spark, sf_dir, "purchase").select("unit", "event_id", "t")
    return event_windows.with_preceding(markers, of_kind(spark, sf_dir, "click"), "unit", "t").select("unit", "event_id", "preceding")


@register(f"WITH {TRAIN} SELECT a.unit, a.event_id, min(b.t) AS found FROM tr a LEFT JOIN tr b ON a.unit = b.unit AND b.kind = 'purchase' AND b.t >= a.t - 1 WHERE a.kind = 'signup' GROUP BY a.unit, a.event_id")
def first_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    markers = of_kind(spark, sf_dir, "signup").select("unit", "event_id", "t")
    return event_windows.first_after(markers, of_kind(spark, sf_dir, "purchase"), "unit", "t", "t", slack=1).select("unit", "event_id", "found")


@register(f"WITH {TRAIN} SELECT a.unit, a.event_id, max(b.t) AS found FROM tr a LEFT JOIN tr b ON a.unit = b.unit AND b.kind = 'view' AND b.t < a.t WHERE a.kind = 'error' GROUP BY a.unit, a.event_id")
def last_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    markers = of_kind(spark, sf_dir, "error").select("unit", "event_id", "t")
    return event_windows.last_before(markers, of_kind(spark, sf_dir, "view"), "unit", "t", "t").select("unit", "event_id", "found")


WINDOWS = {"base": (-DAY, 0), "resp": (0, DAY), "late": (DAY, 3 * DAY)}
COUNTS = TRAIN + """, w AS (SELECT a.unit, a.event_id AS marker, a.t AS tm, coalesce(sum(CASE WHEN b.t - a.t >= -86400000000 AND b.t < a.t THEN 1 ELSE 0 END), 0) AS base,
 coalesce(sum(CASE WHEN b.t >= a.t AND b.t - a.t < 86400000000 THEN 1 ELSE 0 END), 0) AS resp, coalesce(sum(CASE WHEN b.t - a.t >= 86400000000 AND b.t - a.t < 259200000000 THEN 1 ELSE 0 END), 0) AS late
 FROM tr a LEFT JOIN tr b ON a.unit = b.unit AND b.kind IN ('click', 'view') WHERE a.kind = 'signup' GROUP BY 1, 2, 3)"""


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    markers = of_kind(spark, sf_dir, "signup").select("unit", F.col("event_id").alias("marker"), F.col("t").alias("tm"))
    events = train(spark, sf_dir).filter("kind in ('click', 'view')").select("unit", F.col("t").alias("te"))
    return event_windows.window_counts(markers, events, ["unit"], "marker", "tm", "te", WINDOWS)


@register(f"WITH {COUNTS} SELECT unit, marker, tm, CAST(base AS BIGINT) AS base, CAST(resp AS BIGINT) AS resp, CAST(late AS BIGINT) AS late FROM w")
def event_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir)


PSTH = TRAIN + ", h AS (SELECT b.kind, CAST(floor((b.t - a.t + 86400000000) / 7200000000.0) AS BIGINT) AS bin, count(*) AS n FROM tr a JOIN tr b ON a.unit = b.unit AND b.t - a.t >= -86400000000 AND b.t - a.t < 86400000000 WHERE a.kind = 'signup' AND b.kind <> 'signup' GROUP BY ALL)"


@register(f"WITH {PSTH} SELECT kind, bin, n FROM h")
def psth(spark: SparkSession, sf_dir: str) -> DataFrame:
    markers = of_kind(spark, sf_dir, "signup").select("unit", F.col("t").alias("tm"))
    events = train(spark, sf_dir).filter("kind <> 'signup'").select("unit", "kind", F.col("t").alias("te"))
    return event_windows.peristimulus(markers, events, ["unit"], "tm", "te", -DAY, DAY, 2 * HOUR, ["kind"])


@register(f"""WITH {PSTH}, k AS (SELECT d, exp(-0.5 * pow(d / 2.0, 2)) AS g FROM generate_series(-8, 8) AS s(d)), g AS (SELECT d, g / (SELECT sum(g) FROM k) AS w FROM k),
full_h AS (SELECT kind, b AS bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT kind FROM h) CROSS JOIN generate_series(0, 23) AS s(b) LEFT JOIN h USING (kind, bin)) 
SELECT x.kind, CAST(x.bin AS INTEGER) AS bin, round(sum(y.n * g.w), 6) AS smooth FROM full_h x CROSS JOIN g JOIN full_h y ON y.kind = x.kind AND y.bin = greatest(least(x.bin + g.d, 23), 0) GROUP BY 1, 2""".replace("b AS bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT kind FROM h) CROSS JOIN generate_series(0, 23) AS s(b) LEFT JOIN h USING (kind, bin)", "bin, coalesce(n, 0) AS n FROM (SELECT kind, bin FROM (SELECT DISTINCT kind FROM h) CROSS JOIN generate_series(0, 23) AS s(bin)) LEFT JOIN h USING (kind, bin)"))
def psth_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(event_windows.gaussian_smoothed(psth(spark, sf_dir), ["kind"], 24, 2.0))


@register(f"WITH {COUNTS} SELECT unit, count(*) AS n_markers, round(avg(base), 6) AS mean_base, round(avg(resp), 6) AS mean_response, round(avg(resp - base), 6) AS mean_diff, round(stddev_samp(resp - base), 6) AS sd_diff, round(CASE WHEN stddev_samp(resp - base) > 0 THEN avg(resp - base) / (stddev_samp(resp - base) / sqrt(count(*))) END, 6) AS t FROM w GROUP BY unit")
def paired_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(event_windows.paired_response(_counts(spark, sf_dir), ["unit"], "base", "resp"))


@register(f"""WITH {COUNTS}, r AS (SELECT unit, late, row_number() OVER (PARTITION BY unit ORDER BY late DESC) AS k FROM w),
s AS (SELECT unit, CAST(sum(late) AS BIGINT) AS total, count(*) FILTER (WHERE late > 0) AS n_active, sum(CASE WHEN k <= 2 THEN late ELSE 0 END) AS top FROM r GROUP BY unit)
SELECT unit, total, n_active, round(CASE WHEN total > 0 THEN top / total ELSE 0 END, 6) AS top2_share, total >= 10 AND n_active >= 5 AND (CASE WHEN total > 0 THEN top / total ELSE 0 END) <= 0.5 AS consistent FROM s""")
def trial_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(event_windows.trial_consistency(_counts(spark, sf_dir), ["unit"], "late", 10, 5, 0.5))


NEAR = TRAIN + ", c AS (SELECT a.event_id AS ref_id, b.event_id AS test_id, a.unit, a.t AS ta, b.t AS tb, b.t - a.t AS dt FROM tr a JOIN tr b ON a.unit = b.unit AND a.kind = 'click' AND b.kind = 'view' AND abs(b.t - a.t) <= 21600000000)"


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return of_kind(spark, sf_dir, "click").withColumnRenamed("event_id", "ref_id"), of_kind(spark, sf_dir, "view").withColumnRenamed("event_id", "test_id")


@register(f"WITH {NEAR}, r AS (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY abs(dt), tb, test_id) AS k FROM c) SELECT ref_id, test_id, dt FROM r WHERE k = 1")
def nearest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, test = _sides(spark, sf_dir)
    return matching.nearest_match(ref, test, ["unit"], "t", 6 * HOUR, "ref_id", "test_id")


@register(f"WITH {TRAIN} SELECT a.kind AS ref_kind, b.kind AS test_kind, count(*) AS n FROM tr a JOIN tr b ON a.unit = b.unit AND abs(a.t - b.t) <= 21600000000 AND a.event_id <> b.event_id WHERE a.kind < b.kind GROUP BY ALL")
def any_match_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = train(spark, sf_dir)
    hits = matching.any_match(events.withColumnRenamed("kind", "ref_kind"), events.withColumnRenamed("kind", "test_kind"), ["unit"], "t", 6 * HOUR, "ref_kind", "test_kind")
    return hits.filter("ref_kind < test_kind").groupBy("ref_kind", "test_kind").agg(F.sum("n").alias("n"))


#: Recursive SQL of the one-to-one matching: each step takes the least (distance, time, place) that is free.
PAIRED = TRAIN + """, rf AS (SELECT unit, t, row_number() OVER (PARTITION BY unit ORDER BY t) AS rn FROM tr WHERE kind = 'click'),
te AS (SELECT unit, t, row_number() OVER (PARTITION BY unit ORDER BY t) AS i FROM tr WHERE kind = 'view'),
c AS (SELECT rf.unit, rn, rf.t, coalesce(list(struct_pack(d := abs(te.t - rf.t), t := te.t, i := te.i) ORDER BY abs(te.t - rf.t), te.t, te.i) FILTER (WHERE te.i IS NOT NULL), []) AS near
 FROM rf LEFT JOIN te ON te.unit = rf.unit AND abs(te.t - rf.t) <= 21600000000 GROUP BY ALL),
k AS (SELECT unit, 0::BIGINT AS rn, NULL::BIGINT AS t_ref, NULL::BIGINT AS t_test, []::BIGINT[] AS used FROM rf WHERE rn = 1
 UNION ALL SELECT unit, rn, t, best.t, CASE WHEN best IS NULL THEN used ELSE list_append(used, best.i) END
 FROM (SELECT c.unit, c.rn, c.t, k.used, list_filter(c.near, lambda x: NOT list_contains(k.used, x.i))[1] AS best FROM k JOIN c ON c.unit = k.unit AND c.rn = k.rn + 1)),
pairs AS (SELECT unit, t_ref, t_test FROM k WHERE t_test IS NOT NULL)"""


@register(f"WITH RECURSIVE {PAIRED} SELECT * FROM pairs")
def one_to_one_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, test = _sides(spark, sf_dir)
    return matching.one_to_one(ref, test, "unit", "t", 6 * HOUR)


@register(f"""WITH RECURSIVE {PAIRED}, n AS (SELECT unit, count(*) FILTER (WHERE kind = 'click') AS n_ref, count(*) FILTER (WHERE kind = 'view') AS n_test FROM tr WHERE kind IN ('click', 'view') GROUP BY unit),
h AS (SELECT unit, count(*) AS n_hit FROM pairs GROUP BY unit)
SELECT unit, n_ref, n_test, coalesce(n_hit, 0) AS n_hit, round(coalesce(n_hit, 0) / nullif(n_ref, 0), 6) AS recall, round(coalesce(n_hit, 0) / nullif(n_test, 0), 6) AS precision FROM n LEFT JOIN h USING (unit)""")
def match_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, test = _sides(spark, sf_dir)
    return rounded(matching.match_scores(ref, test, matching.one_to_one(ref, test, "unit", "t", 6 * HOUR), "unit"))


@register(f"""WITH {TRAIN}, c AS (SELECT a.unit AS ref, b.kind AS test, count(DISTINCT a.event_id) AS n FROM tr a JOIN tr b ON a.unit = b.unit AND a.kind = 'click' AND b.kind <> 'click' AND abs(b.t - a.t) <= 21600000000 GROUP BY 1, 2),
nr AS (SELECT unit AS ref, count(*) AS n_ref FROM tr WHERE kind = 'click' GROUP BY 1), nt AS (SELECT kind AS test, count(*) AS n_test FROM tr WHERE kind <> 'click' GROUP BY 1),
r AS (SELECT *, n / n_ref AS recall, n / n_test AS precision, row_number() OVER (PARTITION BY ref ORDER BY n DESC, n / n_test DESC, test) AS k FROM c JOIN nr USING (ref) JOIN nt USING (test))
SELECT ref, test, n, round(recall, 6) AS recall, round(precision, 6) AS precision FROM r WHERE k = 1""")
def sort_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = train(spark, sf_dir)
    ref, test = events.filter("kind = 'click'"), events.filter("kind <> 'click'")
    near = bands.band_join(ref.select("unit", F.col("event_id").alias("i"), F.col("t").alias("t1")), test.select("unit", F.col("kind").alias("test"), F.col("t").alias("t2")), "t1", "t2", -6 * HOUR, 6 * HOUR, ["unit"])
    overlaps = near.groupBy(F.col("unit").alias("ref"), "test").agg(F.countDistinct("i").alias("n"))
    n_ref, n_test = ref.groupBy(F.col("unit").alias("ref")).agg(F.count("*").alias("n_ref")), test.groupBy(F.col("kind").alias("test")).agg(F.count("*").alias("n_test"))
    return rounded(matching.best_partner(overlaps, n_ref, n_test, "ref", "test"))


@register(f"WITH {TRAIN}, d AS (SELECT kind, floor(t / 86400000000.0) AS day, count(*) AS n FROM tr GROUP BY ALL) SELECT kind, count(*) AS n, round(regr_slope(n, day), 6) AS slope, round(regr_intercept(n, day), 6) AS intercept, round(regr_r2(n, day), 6) AS r2, round(regr_slope(n, day) / sqrt(greatest(regr_syy(n, day) - pow(regr_slope(n, day), 2) * regr_sxx(n, day), 0) / (count(*) - 2) / regr_sxx(n, day)), 6) AS t FROM d GROUP BY kind")
def drift_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = train(spark, sf_dir).groupBy("kind", F.floor(F.col("t") / DAY).cast("double").alias("day")).agg(F.count("*").cast("double").alias("n"))
    return rounded(st.line_fit(days, ["kind"], "day", "n"))


@register(f"WITH {TRAIN}, h AS (SELECT *, ntile(2) OVER (PARTITION BY unit ORDER BY t, event_id) AS half FROM tr) SELECT unit, CAST(half AS INTEGER) AS half, count(*) AS n, round(avg(amp), 6) AS mean_amp FROM h GROUP BY ALL")
def split_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = train(spark, sf_dir).withColumn("half", F.ntile(2).over(sequence.ordered("unit", "t", "event_id")))
    return rounded(half.groupBy("unit", "half").agg(F.count("*").alias("n"), F.avg("amp").alias("mean_amp")))


@register(f"WITH {TRAIN}, r AS (SELECT *, row_number() OVER (PARTITION BY unit, kind ORDER BY t, event_id) AS k FROM tr) SELECT unit, kind, event_id, t FROM r WHERE k = 1")
def first_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = train(spark, sf_dir).withColumn("both", F.struct("unit", "kind"))
    return sequence.first_per(keyed, "both", ["t", "event_id"]).select("unit", "kind", "event_id", "t")
