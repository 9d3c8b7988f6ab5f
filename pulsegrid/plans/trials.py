"""Queries on trials, intervals, partners and selections over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.operators import statistics as st
from pulsegrid.operators import trials as tr
from pulsegrid.operators.bands import band_join
from pulsegrid.operators.sequence import ordered
from pulsegrid.plans.base import register, rounded
from pulsegrid.plans.trains import DAY, HOUR, ISI, TRAIN, of_kind, train
from pulsegrid.session import table

TRIALS = TRAIN + """, st AS (SELECT *, sum(CASE WHEN kind = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY unit ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS trial FROM tr),
g AS (SELECT unit, trial, min(t) AS t0, min(t) FILTER (WHERE kind = 'purchase') AS t_end, min(t) FILTER (WHERE kind = 'click') AS t_click, min(t) FILTER (WHERE kind = 'view') AS t_view, min(t) FILTER (WHERE kind = 'error') AS t_error,
count(*) AS n_events FROM st WHERE trial > 0 GROUP BY ALL), trials AS (SELECT unit, CAST(trial AS BIGINT) AS trial, t0, t_end, t_click, t_view, t_error, n_events, lead(t0) OVER (PARTITION BY unit ORDER BY trial) AS next_t0 FROM g)"""


def _trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tr.with_trial(train(spark, sf_dir), "unit", "t", "kind", "signup", "event_id")
    return tr.trial_table(events, "unit", "t", "kind", "purchase", {"t_click": "click", "t_view": "view", "t_error": "error"})


@register(f"WITH {TRIALS} SELECT unit, trial, t0, t_end, n_events, next_t0 FROM trials")
def coded_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trials(spark, sf_dir).select("unit", "trial", "t0", "t_end", "n_events", "next_t0")


MASK = "t_end IS NOT NULL AND coalesce(t_error IS NULL, false) AND next_t0 IS NOT NULL AND next_t0 - t0 < 864000000000"


@register(f"WITH {TRIALS} SELECT unit, count(*) AS total, count(*) FILTER (WHERE {MASK}) AS kept, count(t_end) AS completed, round(count(*) FILTER (WHERE {MASK}) / count(*), 6) AS kept_share FROM trials GROUP BY unit")
def trial_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = F.col("t_end").isNotNull() & F.coalesce(F.col("t_error").isNull(), F.lit(False)) & F.col("next_t0").isNotNull() & F.coalesce(F.col("next_t0") - F.col("t0") < 10 * DAY, F.lit(False))
    kept = F.sum(valid.cast("long"))
    return rounded(_trials(spark, sf_dir).groupBy("unit").agg(F.count("*").alias("total"), kept.alias("kept"), F.count("t_end").alias("completed"), (kept / F.count("*")).alias("kept_share")))


@register(f"""WITH {TRIALS}, e AS (SELECT unit, CAST(trial AS BIGINT) AS trial, count(*) AS n_errors, round(max(amp), 6) AS worst FROM st WHERE kind = 'error' GROUP BY ALL), v AS (SELECT unit, CAST(trial AS BIGINT) AS trial, max(t) AS last_view FROM st WHERE kind = 'view' GROUP BY ALL)
SELECT unit, trial, t_click - t0 AS click_latency, last_view - t0 AS last_view_latency, coalesce(n_errors, 0) AS n_errors, worst FROM trials LEFT JOIN e USING (unit, trial) LEFT JOIN v USING (unit, trial)""")
def trial_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tr.with_trial(train(spark, sf_dir), "unit", "t", "kind", "signup", "event_id")
    errors = events.filter("kind = 'error'").groupBy("unit", "trial").agg(F.count("*").alias("n_errors"), F.round(F.max("amp"), 6).alias("worst"))
    views = events.filter("kind = 'view'").groupBy("unit", "trial").agg(F.max("t").alias("last_view"))
    out = _trials(spark, sf_dir).join(errors, ["unit", "trial"], "left").join(views, ["unit", "trial"], "left")
    return out.select("unit", "trial", (F.col("t_click") - F.col("t0")).alias("click_latency"), (F.col("last_view") - F.col("t0")).alias("last_view_latency"), F.coalesce("n_errors", F.lit(0)).alias("n_errors"), "worst")


@register(f"WITH {TRAIN} SELECT kind, count(*) AS n FROM tr WHERE unit IN (SELECT unit FROM tr WHERE kind = 'purchase' AND amp > 150) GROUP BY kind")
def semi_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = of_kind(spark, sf_dir, "purchase").filter("amp > 150").select("unit")
    return train(spark, sf_dir).join(big, "unit", "left_semi").groupBy("kind").agg(F.count("*").alias("n"))


INSIDE = f"{TRIALS}, iv AS (SELECT unit, t0 - 3600000000 AS lo, t_end + 3600000000 AS hi FROM trials WHERE t_end IS NOT NULL), f AS (SELECT tr.*, EXISTS (SELECT 1 FROM iv WHERE iv.unit = tr.unit AND tr.t BETWEEN lo AND hi) AS inside FROM tr)"


@register(f"WITH {INSIDE} SELECT inside, kind, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM f GROUP BY ALL")
def interval_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _trials(spark, sf_dir).filter("t_end is not null")
    events = train(spark, sf_dir)
    parts = [tr.in_intervals(events, spans, "unit", "t", "t0", "t_end", HOUR, DAY, inside).withColumn("inside", F.lit(inside)) for inside in (True, False)]
    return parts[0].unionByName(parts[1]).groupBy("inside", "kind").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@register(f"""WITH {TRAIN} SELECT source, count(*) AS n FROM (SELECT CASE WHEN EXISTS (SELECT 1 FROM tr b WHERE b.unit = a.unit AND b.kind = 'view' AND abs(b.t - a.t) <= 7200000000) THEN 'own'
WHEN EXISTS (SELECT 1 FROM tr b WHERE b.unit = a.unit AND b.kind = 'error' AND abs(b.t - a.t) <= 7200000000) THEN 'other' END AS source FROM tr a WHERE kind = 'click') GROUP BY source""")
def priority_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = {name: of_kind(spark, sf_dir, kind) for name, kind in (("own", "view"), ("other", "error"))}
    return tr.priority_match(of_kind(spark, sf_dir, "click"), sides, ["unit"], "event_id", "t", 2 * HOUR).groupBy("source").agg(F.count("*").alias("n"))


@register(f"""WITH {TRAIN}, h AS (SELECT unit, CAST(floor(t / 259200000000.0) AS BIGINT) AS bin, count(*) AS n FROM tr GROUP BY ALL), r AS (SELECT *, min(n) OVER (PARTITION BY unit ORDER BY bin DESC ROWS UNBOUNDED PRECEDING) AS low FROM h)
SELECT unit, min(bin) FILTER (WHERE low >= 5) AS onset FROM r GROUP BY unit""")
def onset_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = train(spark, sf_dir).groupBy("unit", F.floor(F.col("t") / (3 * DAY)).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    return tr.onset(bins, ["unit"], "bin", "n", 5)


RUNS = ISI + """, n AS (SELECT *, CASE WHEN isi <= 7200000000 THEN 0 ELSE 1 END AS new FROM isi), ru AS (SELECT *, sum(new) OVER (PARTITION BY unit ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM n),
po AS (SELECT *, row_number() OVER (PARTITION BY unit, run ORDER BY t, event_id) AS position, count(*) OVER (PARTITION BY unit, run) AS size FROM ru)"""


@register(f"WITH {RUNS} SELECT kind, CAST(position AS INTEGER) AS position, count(amp) AS n, round(avg(amp), 6) AS mean, round(stddev_samp(amp) / sqrt(count(amp)), 6) AS sem FROM (SELECT *, 'all' AS k FROM po WHERE size >= 2 AND position <= 4) GROUP BY kind, position".replace("kind, CAST", "k AS kind, CAST").replace("GROUP BY kind", "GROUP BY k"))
def burst_position_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = tr.gap_bursts(train(spark, sf_dir), "unit", "t", 2 * HOUR, "event_id")
    size = F.count("*").over(Window.partitionBy("unit", "run"))
    pooled = runs.withColumn("size", size).filter("size >= 2").select(F.lit("all").alias("kind"), F.struct("unit", "run").alias("run"), "position", "amp")
    return rounded(tr.position_curve(pooled, "kind", "amp", 2, 4))


@register(f"WITH {RUNS} SELECT kind, count(*) AS n, round(corr(isi / 1e6, amp), 6) AS r FROM po WHERE position > 1 GROUP BY kind")
def burst_interval_amplitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = train(spark, sf_dir).withColumn("isi", F.col("t") - F.lag("t").over(ordered("unit", "t", "event_id")))
    runs = tr.gap_bursts(events, "unit", "t", 2 * HOUR, "event_id").filter("position > 1")
    return rounded(runs.groupBy("kind").agg(F.count("*").alias("n"), F.corr(F.col("isi") / 1e6, "amp").alias("r")))


#: References are users, tests are a partition of the other side's events: 24 clusters.
OVER = TRAIN + ", ov AS (SELECT a.unit AS ref, b.event_id % 24 AS test, count(DISTINCT a.event_id) AS n FROM tr a JOIN tr b ON a.unit = b.unit AND a.kind = 'click' AND b.kind <> 'click' AND abs(b.t - a.t) <= 43200000000 GROUP BY 1, 2), nr AS (SELECT unit AS ref, count(*) AS n_ref FROM tr WHERE kind = 'click' GROUP BY 1)"


def _overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = train(spark, sf_dir)
    clicks, others = events.filter("kind = 'click'"), events.filter("kind <> 'click'")
    near = band_join(clicks.select("unit", F.col("event_id").alias("i"), F.col("t").alias("t1")), others.select("unit", (F.col("event_id") % 24).alias("test"), F.col("t").alias("t2")), "t1", "t2", -DAY // 2, DAY // 2, ["unit"])
    sizes = clicks.groupBy(F.col("unit").alias("ref")).agg(F.count("*").alias("n_ref"))
    return near.groupBy(F.col("unit").alias("ref"), "test").agg(F.countDistinct("i").alias("n")).join(sizes, "ref")


@register(f"""WITH {OVER}, o AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY n DESC, test) AS k FROM ov JOIN nr USING (ref)),
s AS (SELECT ref, count(*) FILTER (WHERE n / n_ref >= 0.2) AS fragments, max(test) FILTER (WHERE k = 1) AS best, max(n / n_ref) AS recall FROM o GROUP BY ref), m AS (SELECT *, count(*) OVER (PARTITION BY best) > 1 AS merged FROM s)
SELECT ref, fragments, best, round(recall, 6) AS recall, merged, CASE WHEN fragments = 0 THEN 'none' WHEN fragments > 1 THEN CASE WHEN merged THEN 'split and merged' ELSE 'split' END WHEN merged THEN 'merged' ELSE 'match' END AS verdict FROM m""")
def split_merge_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tr.split_merge(_overlaps(spark, sf_dir), "ref", "test", "n", "n_ref", 0.2))


@register(f"""WITH {OVER}, v AS (SELECT test, count(*) AS n_refs, CAST(sum(n) AS BIGINT) AS mass FROM ov JOIN nr USING (ref) WHERE n / n_ref >= 0.2 GROUP BY test HAVING count(*) > 1) SELECT * FROM v""")
def merge_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _overlaps(spark, sf_dir).filter(F.col("n") / F.col("n_ref") >= 0.2)
    return held.groupBy("test").agg(F.count("*").alias("n_refs"), F.sum("n").alias("mass")).filter("n_refs > 1")


@register(f"WITH {OVER}, k AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY n DESC, test) AS k FROM ov) SELECT ref, test, n, CAST(k AS INTEGER) AS rank FROM k WHERE k <= 12")
def bound_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("ref").orderBy(F.desc("n"), "test"))
    return _overlaps(spark, sf_dir).withColumn("rank", rank).filter("rank <= 12").select("ref", "test", "n", "rank")


@register(f"""WITH RECURSIVE {OVER}, o AS (SELECT ref, test, n, n_ref FROM ov JOIN nr USING (ref)), sized AS (SELECT ref, row_number() OVER (ORDER BY n_ref DESC, ref) AS i FROM (SELECT DISTINCT ref, n_ref FROM o)),
c(i, taken, ref, test, n) AS (SELECT CAST(0 AS BIGINT), []::BIGINT[], NULL::BIGINT, NULL::BIGINT, NULL::BIGINT UNION ALL
SELECT s.i, CASE WHEN b.test IS NULL THEN c.taken ELSE list_append(c.taken, b.test) END, s.ref, b.test, b.n FROM c JOIN sized s ON s.i = c.i + 1 LEFT JOIN LATERAL (SELECT test, n FROM o WHERE o.ref = s.ref AND NOT list_contains(c.taken, o.test) ORDER BY n DESC, test LIMIT 1) b ON true)
SELECT ref, test, n FROM c WHERE test IS NOT NULL""")
def exclusive_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.exclusive_claims(_overlaps(spark, sf_dir), "ref", "test", "n", "n_ref")


@register(f"""WITH {OVER}, r AS (SELECT ref, test, n, CASE WHEN n_ref >= 10 THEN n / n_ref END AS dip FROM ov JOIN nr USING (ref)), k AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN dip IS NULL THEN 1 ELSE 0 END, round(dip, 9) DESC, n DESC, ref, test) AS place FROM r)
SELECT ref, test, n, round(dip, 6) AS dip, CAST(place AS INTEGER) AS place FROM k WHERE place <= 50""")
def pair_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _overlaps(spark, sf_dir).withColumn("dip", F.when(F.col("n_ref") >= 10, F.col("n") / F.col("n_ref")))
    order = [F.col("dip").isNull().cast("int"), F.desc(F.round("dip", 9)), F.desc("n"), F.col("ref"), F.col("test")]
    top = rows.orderBy(*order).limit(50)  # the report's length
    return rounded(top.withColumn("place", F.row_number().over(Window.orderBy(*order))).select("ref", "test", "n", "dip", "place"))


@register(f"WITH {TRAIN}, d AS (SELECT unit, avg(amp) FILTER (WHERE kind = 'error') - avg(amp) FILTER (WHERE kind = 'view') AS delta FROM tr GROUP BY unit) SELECT unit, round(delta, 6) AS delta FROM d WHERE delta IS NOT NULL ORDER BY abs(delta) DESC, unit LIMIT 15")
def strongest_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda k: F.avg(F.when(F.col("kind") == k, F.col("amp")))
    delta = train(spark, sf_dir).groupBy("unit").agg((of("error") - of("view")).alias("delta")).filter("delta is not null")
    return rounded(delta.orderBy(F.desc(F.abs("delta")), "unit").limit(15))  # the report's length


@register(f"""WITH {TRAIN}, c AS (SELECT unit, cut, count(*) AS n, count(*) FILTER (WHERE kind = 'purchase') AS hit FROM tr, (SELECT unnest([0, 10, 20, 40, 80]) AS cut) WHERE amp >= cut GROUP BY ALL), a AS (SELECT unit, count(*) AS total FROM tr WHERE kind = 'purchase' GROUP BY unit),
k AS (SELECT unit, cut, hit / total AS recall, hit / n AS precision, row_number() OVER (PARTITION BY unit ORDER BY hit / total DESC, cut) AS k FROM c JOIN a USING (unit) WHERE hit / n >= 0.25) SELECT unit, cut, round(recall, 6) AS recall, round(precision, 6) AS precision FROM k WHERE k = 1""")
def precision_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = F.explode(F.filter(F.array(*map(F.lit, (0, 10, 20, 40, 80))), lambda c: F.col("amp") >= c))
    events = train(spark, sf_dir)
    hit = F.sum((F.col("kind") == "purchase").cast("long"))
    counts = events.select("unit", "kind", cuts.alias("cut")).groupBy("unit", "cut").agg(F.count("*").alias("n"), hit.alias("hit"))
    total = events.filter("kind = 'purchase'").groupBy("unit").agg(F.count("*").alias("total"))
    rows = counts.join(total, "unit").select("unit", "cut", (F.col("hit") / F.col("total")).alias("recall"), (F.col("hit") / F.col("n")).alias("precision")).filter("precision >= 0.25")
    return rounded(rows.withColumn("k", F.row_number().over(Window.partitionBy("unit").orderBy(F.desc("recall"), "cut"))).filter("k = 1").drop("k"))


@register(f"WITH {TRAIN}, k AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY md5(CAST(event_id AS VARCHAR) || ':7')) AS k FROM tr) SELECT unit, event_id FROM k WHERE k <= 5")
def capped_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.md5(F.concat(F.col("event_id").cast("string"), F.lit(":7")).cast("binary"))
    return train(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("unit").orderBy(order))).filter("k <= 5").select("unit", "event_id")


@register(f"WITH {TRAIN}, u AS (SELECT unit, t FROM tr WHERE kind = 'click' UNION ALL SELECT unit, t FROM tr WHERE kind = 'view'), d AS (SELECT *, t - lag(t) OVER (PARTITION BY unit ORDER BY t) AS isi FROM u) SELECT unit, count(*) AS n, min(isi) AS shortest, max(t) AS last FROM d GROUP BY unit")
def train_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = of_kind(spark, sf_dir, "click").select("unit", "t").unionByName(of_kind(spark, sf_dir, "view").select("unit", "t"))
    isi = both.withColumn("isi", F.col("t") - F.lag("t").over(ordered("unit", "t")))
    return isi.groupBy("unit").agg(F.count("*").alias("n"), F.min("isi").alias("shortest"), F.max("t").alias("last"))


@register(f"WITH {TRAIN} SELECT unit FROM tr WHERE kind = 'click' AND amp > 60 INTERSECT SELECT unit FROM tr WHERE kind = 'error' AND amp > 60")
def shared_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_kind(spark, sf_dir, "click").filter("amp > 60").select("unit").intersect(of_kind(spark, sf_dir, "error").filter("amp > 60").select("unit"))


@register(f"WITH {TRAIN}, k AS (SELECT unit, amp, row_number() OVER (PARTITION BY unit ORDER BY amp) AS k, count(*) OVER (PARTITION BY unit) AS n FROM tr) SELECT unit, n, round(min(amp), 6) AS low, round(max(amp) FILTER (WHERE k = n // 2 + 1), 6) AS upper_median, round(max(amp), 6) AS high FROM k GROUP BY unit, n")
def unit_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("unit")
    rows = train(spark, sf_dir).select("unit", "amp", F.row_number().over(w.orderBy("amp")).alias("k"), F.count("*").over(w).alias("n"))
    middle = F.max(F.when(F.col("k") == F.floor(F.col("n") / 2) + 1, F.col("amp")))
    return rounded(rows.groupBy("unit", "n").agg(F.min("amp").alias("low"), middle.alias("upper_median"), F.max("amp").alias("high")))


@register(f"""WITH {TRAIN}, a AS (SELECT unit, median(amp) FILTER (WHERE kind = 'error') AS caught, median(amp) FILTER (WHERE kind <> 'error') AS rest, 100.0 * count(*) FILTER (WHERE kind = 'error') / count(*) AS pct FROM tr GROUP BY unit)
SELECT unit, round(caught, 6) AS caught, round(rest, 6) AS rest, round(pct, 6) AS pct, CASE WHEN caught IS NULL THEN 'no catch trials' WHEN pct < 10 THEN 'too few' WHEN caught > rest THEN 'waits longer' ELSE 'no difference' END AS verdict FROM a""")
def catch_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = F.col("kind") == "error"
    a = train(spark, sf_dir).groupBy("unit").agg(F.median(F.when(error, F.col("amp"))).alias("caught"), F.median(F.when(~error, F.col("amp"))).alias("rest"), (100.0 * F.count_if(error) / F.count("*")).alias("pct"))
    verdict = F.when(F.col("caught").isNull(), "no catch trials").when(F.col("pct") < 10, "too few").when(F.col("caught") > F.col("rest"), "waits longer").otherwise("no difference")
    return rounded(a.withColumn("verdict", verdict))


@register(f"""WITH {TRAIN}, s AS (SELECT unit, regr_slope(amp, t / 86400000000.0) AS b, count(*) AS n, regr_sxx(amp, t / 86400000000.0) AS xx, regr_syy(amp, t / 86400000000.0) AS yy FROM tr GROUP BY unit)
SELECT unit % 5 AS bin, count(*) AS n, round(avg(CASE WHEN abs(b / sqrt(greatest(yy - b * b * xx, 0) / (n - 2) / xx)) > 1 THEN 1.0 ELSE 0.0 END), 6) AS share FROM s WHERE n > 2 GROUP BY 1""")
def significant_by_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = st.line_fit(train(spark, sf_dir).select("unit", (F.col("t") / DAY).alias("day"), "amp"), ["unit"], "day", "amp").filter("n > 2")
    return rounded(fits.groupBy((F.col("unit") % 5).alias("bin")).agg(F.count("*").alias("n"), F.avg(F.coalesce((F.abs("t") > 1).cast("double"), F.lit(0.0))).alias("share")))


@register("""WITH c AS (SELECT p_partkey, list_filter([CASE WHEN p_size < 5 THEN 'narrow' END, CASE WHEN p_retailprice > 1500 THEN 'loud' END, CASE WHEN p_type LIKE 'ECONOMY%' THEN 'flat' END], lambda x: x IS NOT NULL) AS met FROM part)
SELECT p_partkey, array_to_string(met, '|') AS met, len(list_filter(met, lambda x: x IN ('narrow', 'loud'))) >= 1 AS noise, len(list_filter(met, lambda x: x NOT IN ('narrow', 'loud'))) >= 1 AS non_soma FROM c""")
def noise_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rules = {"narrow": c("p_size") < 5, "loud": c("p_retailprice") > 1500, "flat": c("p_type").startswith("ECONOMY")}
    met = F.filter(F.array(*[F.when(v, n) for n, v in rules.items()]), lambda x: x.isNotNull())
    raw = F.array(F.lit("narrow"), F.lit("loud"))
    rows = table(spark, sf_dir, "part").select("p_partkey", met.alias("met"))
    return rows.select("p_partkey", F.array_join("met", "|").alias("met"), (F.size(F.array_intersect("met", raw)) >= 1).alias("noise"), (F.size(F.array_except("met", raw)) >= 1).alias("non_soma"))


@register(f"WITH {TRAIN}, g AS (SELECT unit, count(*) AS n, count(DISTINCT CAST(floor(t / 86400000000.0) AS BIGINT)) / 30 AS coverage FROM tr GROUP BY unit) SELECT unit, n, round(coverage, 6) AS coverage, n >= 20 AND coverage >= 0.5 AS passes, CASE WHEN n < 20 THEN 'too few events' WHEN coverage < 0.5 THEN 'covers too little' END AS reason FROM g")
def coverage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = train(spark, sf_dir).groupBy("unit").agg(F.count("*").alias("n"), (F.countDistinct(F.floor(F.col("t") / DAY)) / 30).alias("coverage"))
    reason = F.when(F.col("n") < 20, "too few events").when(F.col("coverage") < 0.5, "covers too little")
    return rounded(g.withColumn("passes", reason.isNull()).withColumn("reason", reason))


@register(f"""WITH {TRIALS}, d AS (SELECT unit, trial, count(*) FILTER (WHERE kind = 'click') - count(*) FILTER (WHERE kind = 'view') AS d FROM st WHERE trial > 0 GROUP BY ALL)
SELECT unit, CAST(sum(abs(d)) AS BIGINT) AS moved, count(*) FILTER (WHERE d <> 0) AS n_active, sum(abs(d)) >= 10 AND count(*) FILTER (WHERE d <> 0) >= 8 AS consistent FROM d GROUP BY unit""")
def paired_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tr.with_trial(train(spark, sf_dir), "unit", "t", "kind", "signup", "event_id").filter("trial > 0")
    d = events.groupBy("unit", "trial").agg((F.count_if(F.col("kind") == "click") - F.count_if(F.col("kind") == "view")).alias("d"))
    out = d.groupBy("unit").agg(F.sum(F.abs("d")).alias("moved"), F.count_if(F.col("d") != 0).alias("n_active"))
    return out.withColumn("consistent", (F.col("moved") >= 10) & (F.col("n_active") >= 8))


@register(f"""WITH {TRAIN}, a AS (SELECT unit, count(*) AS n, avg(amp) AS amp FROM tr GROUP BY unit), b AS (SELECT unit, count(*) AS n_click FROM tr WHERE kind = 'click' GROUP BY unit), j AS (SELECT a.*, n_click, c_acctbal FROM a JOIN b USING (unit) JOIN customer ON c_custkey = unit WHERE n >= 10),
m AS (SELECT *, median(amp) OVER () AS cut FROM j) SELECT unit, n, n_click, round(amp, 6) AS amp FROM m WHERE amp >= cut AND c_acctbal > 0 ORDER BY n_click DESC, unit LIMIT 10""")
def select_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = train(spark, sf_dir)
    a = events.groupBy("unit").agg(F.count("*").alias("n"), F.avg("amp").alias("amp")).filter("n >= 10")
    b = events.filter("kind = 'click'").groupBy("unit").agg(F.count("*").alias("n_click"))
    j = a.join(b, "unit").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("unit"), "c_acctbal"), "unit")
    cut = j.agg(F.median("amp")).first()[0]
    return rounded(j.filter((F.col("amp") >= F.lit(cut)) & (F.col("c_acctbal") > 0)).orderBy(F.desc("n_click"), "unit").limit(10).select("unit", "n", "n_click", "amp"))  # the selection's size


@register(f"WITH {TRAIN} SELECT coalesce(CAST(c_custkey AS VARCHAR), 'NOISE') AS owner, count(*) AS n FROM tr LEFT JOIN customer ON c_custkey = unit AND c_mktsegment = 'BUILDING' GROUP BY 1")
def owner_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("unit"), F.col("c_custkey").cast("string").alias("owner"))
    return train(spark, sf_dir).join(owners, "unit", "left").groupBy(F.coalesce("owner", F.lit("NOISE")).alias("owner")).agg(F.count("*").alias("n"))


@register("WITH q AS (SELECT quantile_cont(s_acctbal, 0.25) AS lo, quantile_cont(s_acctbal, 0.9) AS hi FROM supplier) SELECT s_suppkey, s_acctbal <= lo AS quiet, s_acctbal >= hi AS hard FROM supplier, q")
def site_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    lo, hi = s.agg(F.percentile("s_acctbal", F.lit(0.25)), F.percentile("s_acctbal", F.lit(0.9))).first()
    return s.select("s_suppkey", (F.col("s_acctbal") <= F.lit(lo)).alias("quiet"), (F.col("s_acctbal") >= F.lit(hi)).alias("hard"))


@register("WITH p AS (SELECT regexp_replace(p_type, '(?i)(_with_unit_\\d+|[ ].*)$', '') AS label, p_retailprice FROM part) SELECT label, CASE WHEN label IN ('ECONOMY', 'SMALL') THEN 'good' WHEN label = 'STANDARD' THEN 'mua' ELSE 'noise' END AS grp, count(*) AS n FROM p GROUP BY ALL")
def label_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.regexp_replace("p_type", r"(?i)(_with_unit_\d+|[ ].*)$", "")
    rows = table(spark, sf_dir, "part").select(label.alias("label"))
    group = F.when(F.col("label").isin("ECONOMY", "SMALL"), "good").when(F.col("label") == "STANDARD", "mua").otherwise("noise")
    return rows.groupBy("label", group.alias("grp")).agg(F.count("*").alias("n"))


@register("SELECT c_custkey, round(1 / (1 + exp(-0.001 * (c_acctbal - 4000))), 6) AS confidence, round(c_acctbal / max(abs(c_acctbal)) OVER (), 6) AS relative, c_acctbal < 0 AS given_up FROM customer")
def derived_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    top = c.agg(F.max(F.abs("c_acctbal"))).first()[0]
    return rounded(c.select("c_custkey", st.logistic(F.col("c_acctbal"), 0.001, 4000.0).alias("confidence"), (F.col("c_acctbal") / F.lit(top)).alias("relative"), (F.col("c_acctbal") < 0).alias("given_up")))


@register("""WITH o AS (SELECT o_custkey AS c_custkey, count(*) AS n_orders FROM orders GROUP BY 1), e AS (SELECT user_id AS c_custkey, count(*) AS n_events FROM events GROUP BY 1), s AS (SELECT n_nationkey AS c_nationkey, n_name FROM nation WHERE n_nationkey < 20),
l AS (SELECT doc_id AS c_custkey, max(quality) AS quality FROM labels GROUP BY 1) SELECT c_custkey, n_orders, n_events, n_name, quality, (n_orders IS NULL)::INTEGER + (n_events IS NULL)::INTEGER + (n_name IS NULL)::INTEGER + (quality IS NULL)::INTEGER AS missing
FROM customer LEFT JOIN o USING (c_custkey) LEFT JOIN e USING (c_custkey) LEFT JOIN s USING (c_nationkey) LEFT JOIN l USING (c_custkey)""")
def merged_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count("*").alias("n_events"))
    n = table(spark, sf_dir, "nation").filter("n_nationkey < 20").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    q = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("c_custkey")).agg(F.max("quality").alias("quality"))
    out = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(o, "c_custkey", "left").join(e, "c_custkey", "left").join(n, "c_nationkey", "left").join(q, "c_custkey", "left")
    columns = ["n_orders", "n_events", "n_name", "quality"]
    return out.select("c_custkey", *columns, sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0)).alias("missing"))


@register(f"WITH {ISI}, c AS (SELECT unit, event_id, CAST(sum(CASE WHEN isi > 172800000000 THEN 0 ELSE coalesce(isi, 0) END) OVER (PARTITION BY unit ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS clock FROM isi) SELECT unit, event_id, clock FROM c")
def recorded_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.recorded_clock(train(spark, sf_dir), "unit", "t", 2 * DAY, "event_id").select("unit", "event_id", "clock")


@register(f"WITH {TRAIN}, a AS (SELECT DISTINCT unit FROM tr WHERE kind = 'click' AND amp > 80), b AS (SELECT DISTINCT unit FROM tr WHERE kind = 'error' AND amp > 80) SELECT CASE WHEN a.unit IS NULL THEN 'second' WHEN b.unit IS NULL THEN 'first' ELSE 'both' END AS responsive, count(*) AS n FROM a FULL JOIN b USING (unit) GROUP BY 1")
def responsive_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (of_kind(spark, sf_dir, k).filter("amp > 80").select("unit").distinct().withColumn(n, F.lit(True)) for k, n in (("click", "first"), ("error", "second")))
    side = F.when(F.col("first").isNull(), "second").when(F.col("second").isNull(), "first").otherwise("both")
    return a.join(b, "unit", "full").groupBy(side.alias("responsive")).agg(F.count("*").alias("n"))


@register(f"WITH {TRAIN}, w AS (SELECT kind, k * 43200000000 AS window_start FROM tr, generate_series(-4, 62) AS s(k) WHERE k * 43200000000 <= t AND t < k * 43200000000 + 172800000000) SELECT kind, window_start, count(*) AS n FROM w GROUP BY ALL")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.sliding_windows(train(spark, sf_dir), "t", 2 * DAY, DAY // 2).groupBy("kind", "window_start").agg(F.count("*").alias("n"))


@register(f"WITH {TRAIN}, r AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY t, event_id) - 1 AS k, count(*) OVER (PARTITION BY unit) AS n FROM tr) SELECT unit, CAST(k % 2 AS INTEGER) AS odd, count(*) AS n_events, round(avg(amp), 6) AS mean, count(*) FILTER (WHERE k = 0 OR (k * 9) // greatest(n - 1, 1) > ((k - 1) * 9) // greatest(n - 1, 1)) AS n_spaced FROM r GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY unit, k % 2"))
def even_odd_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("unit")
    rows = train(spark, sf_dir).select("unit", "amp", (F.row_number().over(w.orderBy("t", "event_id")) - 1).alias("k"), F.count("*").over(w).alias("n"))
    place = lambda k: F.floor(k * 9 / F.greatest(F.col("n") - 1, F.lit(1)))
    spaced = (F.col("k") == 0) | (place(F.col("k")) > place(F.col("k") - 1))
    return rounded(rows.groupBy("unit", (F.col("k") % 2).alias("odd")).agg(F.count("*").alias("n_events"), F.avg("amp").alias("mean"), F.count_if(spaced).alias("n_spaced")))


@register("""WITH s AS (SELECT *, s_suppkey % 10 AS grp, s_acctbal BETWEEN 5000 AND 6000 AS inside FROM supplier), f AS (SELECT *, max(inside::INTEGER) OVER (PARTITION BY grp) = 1 AS found FROM s),
k AS (SELECT grp, s_suppkey, row_number() OVER (PARTITION BY grp ORDER BY s_acctbal DESC, s_suppkey) AS rank FROM f WHERE inside OR NOT found) SELECT grp, s_suppkey, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 3""")
def top_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = table(spark, sf_dir, "supplier").withColumn("grp", F.col("s_suppkey") % 10)
    return tr.in_radius_or_all(sites, "grp", F.col("s_acctbal").between(5000, 6000), [F.desc("s_acctbal"), "s_suppkey"], 3).select("grp", "s_suppkey", "rank")


@register("SELECT event_id, CAST(regexp_extract(props, '\"k\": (\\d+)', 1) AS INTEGER) AS k, strptime(regexp_extract('session_' || strftime(ts, '%Y%m%d') || '_122553.mat', '_(\\d{8})_', 1), '%Y%m%d')::DATE::VARCHAR AS day FROM events")
def header_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("session_"), F.date_format("ts", "yyyyMMdd"), F.lit("_122553.mat"))
    day = F.to_date(F.regexp_extract(name, r"_(\d{8})_", 1), "yyyyMMdd")
    return table(spark, sf_dir, "events").select("event_id", F.regexp_extract("props", r'"k": (\d+)', 1).cast("int").alias("k"), day.cast("string").alias("day"))


@register(f"""WITH {TRAIN}, h AS (SELECT unit, kind, t < 1296000000000 AS early, max(event_id) AS last FROM tr GROUP BY ALL) SELECT coalesce(a.unit, b.unit) AS unit, coalesce(a.kind, b.kind) AS kind, coalesce(b.last, a.last) AS last
FROM (SELECT * FROM h WHERE early) a FULL JOIN (SELECT * FROM h WHERE NOT early) b ON a.unit = b.unit AND a.kind = b.kind""")
def map_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = train(spark, sf_dir).groupBy("unit", "kind", (F.col("t") < 15 * DAY).alias("early")).agg(F.max("event_id").alias("last"))
    maps = h.groupBy("unit").agg(*[F.map_from_entries(F.filter(F.collect_list(F.when(F.col("early") == early, F.struct("kind", "last"))), lambda x: x.isNotNull())).alias(n) for n, early in (("a", True), ("b", False))])
    merged = F.map_zip_with("a", "b", lambda _, old, new: F.coalesce(new, old))  # the later map wins
    return maps.select("unit", F.explode(merged).alias("kind", "last"))


@register("SELECT event_id, event_id % 65536 AS low, CAST(floor(value) AS BIGINT) AS high FROM events")
def packed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    swapped = lambda h: F.concat(F.substring(h, 3, 2), F.substring(h, 1, 2))
    word = lambda c: swapped(F.lpad(F.hex(c), 4, "0"))
    packed = F.base64(F.unhex(F.concat(word(F.col("event_id") % 65536), word(F.floor("value").cast("long")))))
    back = F.hex(F.unbase64("packed"))
    number = lambda at: F.conv(swapped(F.substring(back, at, 4)), 16, 10).cast("long")
    return table(spark, sf_dir, "events").select("event_id", packed.alias("packed")).select("event_id", number(1).alias("low"), number(5).alias("high"))


@register(f"WITH {TRAIN}, s AS (SELECT unit, avg(amp) FILTER (WHERE kind = 'error') AS a, avg(amp) FILTER (WHERE kind <> 'error') AS b, var_samp(amp) FILTER (WHERE kind = 'error') + var_samp(amp) FILTER (WHERE kind <> 'error') AS v FROM tr GROUP BY unit) SELECT unit, round(CASE WHEN v > 0 THEN pow(a - b, 2) / v END, 6) AS fisher FROM s")
def fisher_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(train(spark, sf_dir).groupBy("unit").agg(tr.fisher_score(F.col("amp"), F.col("kind") == "error").alias("fisher")))


@register("WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS w FROM embeddings), a AS (SELECT *, list_transform(w, lambda x: abs(x)) AS m FROM e) SELECT vec_id, round(list_max(w) - list_min(w), 6) AS ptp, CAST(list_position(m, list_max(m)) - 1 AS BIGINT) AS peak FROM a")
def peak_to_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("w"))
    size = F.transform("w", lambda x: F.abs(x))
    return rounded(e.select("vec_id", (F.array_max("w") - F.array_min("w")).alias("ptp"), (F.array_position(size, F.array_max(size)) - 1).alias("peak")))


@register(f"WITH {TRIALS} SELECT unit, count(DISTINCT n_events) AS kinds, count(DISTINCT n_events) = 1 AS consistent FROM trials GROUP BY unit")
def window_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.countDistinct("n_events")
    return _trials(spark, sf_dir).groupBy("unit").agg(kinds.alias("kinds"), (kinds == 1).alias("consistent"))


@register("SELECT doc_id, coalesce(new.score, old.score) AS score, CASE WHEN new.score IS NULL THEN 'kept' WHEN old.score IS NULL THEN 'added' ELSE 'updated' END AS change FROM (SELECT doc_id, quality AS score FROM labels WHERE doc_id % 3 <> 0) old FULL JOIN (SELECT doc_id, toxic AS score FROM labels WHERE doc_id % 2 = 0) new USING (doc_id)")
def updated_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    old, new = labels.filter("doc_id % 3 <> 0").select("doc_id", F.col("quality").alias("old")), labels.filter("doc_id % 2 = 0").select("doc_id", F.col("toxic").alias("new"))
    change = F.when(F.col("new").isNull(), "kept").when(F.col("old").isNull(), "added").otherwise("updated")
    return old.join(new, "doc_id", "full").select("doc_id", F.coalesce("new", "old").alias("score"), change.alias("change"))
