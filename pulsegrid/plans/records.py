"""Queries on merge records, attribution, dataset checks, lineages, ladders and rules over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions import tiers
from pulsegrid.operators import lineage, pairs, records, sequence, waveforms
from pulsegrid.operators import statistics as st
from pulsegrid.plans.base import register, rounded, thinned_sql
from pulsegrid.plans.models import SWEEP, WAVES, _sweep, sequence_match
from pulsegrid.plans.trains import DAY, HOUR, MIN, TRAIN, of_kind, train
from pulsegrid.session import table
from pulsegrid.sources import recordings

#: Users lie on a grid ten wide; pairs are neighbours within 1.5, and the embedding with a user's number is the user's template.
PLACES = TRAIN + """, pl AS (SELECT DISTINCT unit, unit % 10 AS x, unit // 10 AS y FROM tr), pr AS (SELECT a.unit AS a, b.unit AS b, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS distance FROM pl a JOIN pl b ON a.unit < b.unit AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 2.25),
sim AS (SELECT a, b, distance, list_cosine_similarity(ea.embedding::DOUBLE[], eb.embedding::DOUBLE[]) AS similarity FROM pr JOIN embeddings ea ON ea.vec_id = a JOIN embeddings eb ON eb.vec_id = b)"""


def _neighbours(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pairs of neighbouring users and the users' templates."""
    places = train(spark, sf_dir).select("unit").distinct().select("unit", (F.col("unit") % 10).alias("x"), F.floor(F.col("unit") / 10).alias("y"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("unit"), F.col("embedding").alias("vector"))
    return pairs.spatial_pairs(places, "unit", "x", "y", 1.5), vectors


@register(f"""WITH {PLACES}, l AS (SELECT p.a, p.b, count(*) FILTER (WHERE abs(eb.t - ea.t) <= 3600000000) AS n_near, count(*) AS n_wide FROM pr p JOIN tr ea ON ea.unit = p.a JOIN tr eb ON eb.unit = p.b AND abs(eb.t - ea.t) <= 43200000000 GROUP BY ALL),
u AS (SELECT p.a, p.b, t - lag(t) OVER (PARTITION BY p.a, p.b ORDER BY t, event_id) AS isi FROM pr p JOIN tr ON tr.unit IN (p.a, p.b)), s AS (SELECT a, b, count(*) AS n_events, coalesce(avg(CASE WHEN isi < 600000000 THEN 1.0 WHEN isi IS NOT NULL THEN 0.0 END), 0) AS refractory_share FROM u GROUP BY ALL),
r AS (SELECT sim.*, n_events, coalesce(n_near, 0) AS n_near, coalesce(n_wide, 0) AS n_wide, refractory_share, CASE WHEN n_wide > 0 THEN n_near * 12.0 / n_wide ELSE 1 END AS dip FROM sim JOIN s USING (a, b) LEFT JOIN l USING (a, b)),
k AS (SELECT *, round(greatest(similarity, 0) * 0.5 + (1 - least(dip, 1)) * 0.3 + (1 - refractory_share) * 0.2, 9) AS score FROM r)
SELECT a, b, round(distance, 6) AS distance, round(similarity, 6) AS similarity, n_events, n_near, n_wide, round(refractory_share, 6) AS refractory_share, round(dip, 6) AS dip, round(score, 6) AS score,
CASE WHEN score >= 0.85 THEN 'tier1_auto_applied' WHEN score >= 0.5 THEN 'tier2_scored_logged' ELSE 'not_surfaced' END AS tier, CAST(row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS INTEGER) AS rank FROM k""")
def merge_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    near, vectors = _neighbours(spark, sf_dir)
    return rounded(records.merge_records(near, vectors, train(spark, sf_dir), "unit", "t", "event_id", HOUR, 12 * HOUR, 10 * MIN))


@register(f"""WITH {PLACES}, bw AS (SELECT a, b, similarity FROM sim UNION ALL SELECT b, a, similarity FROM sim),
m AS (SELECT c.event_id, bw.b, e.t - c.t AS dt, similarity, row_number() OVER (PARTITION BY c.event_id ORDER BY similarity DESC, abs(e.t - c.t), bw.b, e.t) AS k FROM tr c JOIN bw ON bw.a = c.unit JOIN tr e ON e.unit = bw.b AND abs(e.t - c.t) <= 3600000000 WHERE c.kind = 'click')
SELECT event_id, b AS owner, dt, round(similarity, 6) AS similarity FROM m WHERE k = 1""")
def event_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    near, vectors = _neighbours(spark, sf_dir)
    both = records.both_ways(pairs.described(near, vectors, "unit", "vector"))
    return rounded(records.attribution(of_kind(spark, sf_dir, "click"), train(spark, sf_dir), both, "unit", "event_id", "t", HOUR))


@register("""WITH u AS (SELECT c_custkey AS unit, CASE WHEN c_custkey % 11 = 0 THEN 'MACHINERY' ELSE c_mktsegment END AS label FROM customer WHERE c_acctbal >= 0), au AS (SELECT c_custkey AS unit, c_mktsegment AS label FROM customer),
v AS (SELECT c_custkey AS unit, CASE c_custkey % 3 WHEN 0 THEN 'noise' WHEN 1 THEN 'BUILDING' ELSE c_mktsegment END AS verdict FROM customer WHERE c_custkey % 7 = 0 UNION ALL SELECT s_suppkey + 1000000, 'BUILDING' FROM supplier),
m AS (SELECT c_custkey + 1 AS merged, c_custkey AS parent FROM customer WHERE c_custkey % 10 = 1), w AS (SELECT c_custkey AS unit, 0 AS t0, 3000 AS t1 FROM customer WHERE c_custkey % 5 = 0), e AS (SELECT o_custkey AS unit, o_orderkey AS t FROM orders)
SELECT 'label' AS "check", unit, 1::BIGINT AS n FROM u JOIN v USING (unit) WHERE verdict <> 'noise' AND label <> verdict UNION ALL SELECT 'noise', unit, 1 FROM u JOIN v USING (unit) WHERE verdict = 'noise'
UNION ALL SELECT 'untouched', unit, 1 FROM u JOIN au USING (unit) WHERE unit NOT IN (SELECT unit FROM v) AND u.label IS DISTINCT FROM au.label UNION ALL SELECT 'parent_kept', unit, 1 FROM u WHERE unit IN (SELECT parent FROM m)
UNION ALL SELECT 'merged_missing', merged, 1 FROM m WHERE merged NOT IN (SELECT unit FROM u) UNION ALL SELECT DISTINCT 'unaccounted', unit, 1 FROM v WHERE verdict <> 'noise' AND unit NOT IN (SELECT unit FROM u) AND unit NOT IN (SELECT parent FROM m)
UNION ALL SELECT 'orphan', unit, count(*) FROM e WHERE unit NOT IN (SELECT unit FROM u) GROUP BY unit UNION ALL SELECT 'window', unit, count(*) FROM e JOIN w USING (unit) WHERE t NOT BETWEEN t0 AND t1 GROUP BY unit""")
def dataset_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("unit"), F.col("c_mktsegment").alias("label"), "c_acctbal")
    units = c.filter("c_acctbal >= 0").select("unit", F.when(F.col("unit") % 11 == 0, "MACHINERY").otherwise(F.col("label")).alias("label"))
    verdict = F.when(F.col("unit") % 3 == 0, "noise").when(F.col("unit") % 3 == 1, "BUILDING").otherwise(F.col("label"))
    strangers = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1000000).alias("unit"), F.lit("BUILDING").alias("verdict"))
    verdicts = c.filter("unit % 7 = 0").select("unit", verdict.alias("verdict")).unionByName(strangers)
    merges = c.filter("unit % 10 = 1").select((F.col("unit") + 1).alias("merged"), F.col("unit").alias("parent"))
    windows = c.filter("unit % 5 = 0").select("unit", F.lit(0).alias("t0"), F.lit(3000).alias("t1"))
    events = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("unit"), F.col("o_orderkey").alias("t"))
    return records.verification(units, c.select("unit", "label"), verdicts, merges, windows, events, "unit", "t")


LEADS = "l AS (SELECT p_partkey AS unit, p_partkey + 1 + p_size % 3 AS merged FROM part WHERE p_partkey % 4 <> 0)"


@register(f"WITH RECURSIVE {LEADS}, r AS (SELECT unit, merged AS final, 1::BIGINT AS depth FROM l UNION ALL SELECT r.unit, l.merged, r.depth + 1 FROM r JOIN l ON l.unit = r.final) SELECT unit, arg_max(final, depth) AS final, max(depth) AS depth FROM r GROUP BY unit")
def merge_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merges of merges; those that were undone (every fourth) lead nowhere."""
    p = table(spark, sf_dir, "part").filter("p_partkey % 4 <> 0")
    return records.final_units(p.select(F.col("p_partkey").alias("unit"), (F.col("p_partkey") + 1 + F.col("p_size") % 3).alias("merged")))


@register("""WITH r AS (SELECT p_brand, p_partkey, p_size - 25 AS s, p_retailprice / 100 AS e FROM part), z AS (SELECT p_brand, s AS s0, e AS e0 FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY abs(s), p_partkey) AS k FROM r) WHERE k = 1)
SELECT p_brand, count(*) AS n, CASE WHEN count(*) >= 2 THEN round(sqrt(avg(pow(e - e0 - (s - s0), 2))), 6) END AS rms, CASE WHEN count(*) >= 2 THEN round(max(abs(e - e0 - (s - s0))), 6) END AS max_abs,
CASE WHEN count(*) >= 2 THEN round(regr_slope(e, s), 6) END AS slope, CASE WHEN count(*) >= 2 THEN round(avg(e - s), 6) END AS implied_bias FROM r JOIN z USING (p_brand) GROUP BY p_brand""")
def shift_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rungs = table(spark, sf_dir, "part").select("p_brand", "p_partkey", (F.col("p_size") - 25).alias("s"), (F.col("p_retailprice") / 100).alias("e"))
    return rounded(records.shift_ladder(rungs, ["p_brand"], "p_partkey", "s", "e"))


@register("""WITH r AS (SELECT l_suppkey, l_extendedprice / l_quantity AS r FROM lineitem WHERE l_quantity > 0), k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY r) - 1 AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM r)
SELECT l_suppkey, round(max(r) FILTER (WHERE i = n // 2), 6) AS middle, round(min(r), 6) AS least, round(max(r), 6) AS most, max(n) AS n FROM k GROUP BY l_suppkey""")
def ratio_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = F.when(F.col("l_quantity") > 0, F.col("l_extendedprice") / F.col("l_quantity"))
    return rounded(records.ratio_range(table(spark, sf_dir, "lineitem"), ["l_suppkey"], ratio))


@register(f"WITH {TRAIN}, p AS (SELECT unit, CAST(place AS BIGINT) AS place FROM (SELECT DISTINCT unit FROM tr), range(0, 2592000000000, 43200000000) r(place)) SELECT unit, place FROM p WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.unit = p.unit AND abs(tr.t - p.place) <= 21600000000)")
def quiet_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = train(spark, sf_dir)
    grid = events.select("unit").distinct().select("unit", F.explode(F.sequence(F.lit(0), F.lit(30 * DAY - DAY // 2), F.lit(DAY // 2))).alias("place"))
    return records.quiet_positions(grid, events, "unit", "place", "t", 6 * HOUR)


MATCHED = """s AS (SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles, count(*) AS n, sum(length(text)) AS size FROM conversations GROUP BY conv_id),
mt AS (SELECT a.conv_id AS a, b.conv_id AS b, a.n, abs(a.size - b.size) AS spread, b.conv_id - a.conv_id AS lead FROM s a JOIN s b ON a.roles = b.roles AND a.n = b.n AND a.conv_id < b.conv_id WHERE abs(a.size - b.size) <= 20)"""


@register(f"WITH {MATCHED}, c AS (SELECT n, lead, count(*) AS k FROM mt GROUP BY ALL), g AS (SELECT n, CAST(sum(k) AS BIGINT) AS n_pairs, max(k) AS n_agree, arg_max(lead, (k, -lead)) AS lead FROM c GROUP BY n) SELECT a, b, n, spread, lead, n_pairs, n_agree FROM mt JOIN g USING (n, lead)")
def consensus_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.consensus(sequence_match(spark, sf_dir).withColumn("lead", F.col("b") - F.col("a")), ["n"], "lead")


@register(f"WITH {SWEEP}, g AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY cut) AS k FROM sw WHERE ratio <= 1.5 AND n_events >= 10) SELECT unit, cut, n_events, round(ratio, 6) AS ratio FROM g WHERE k = 1")
def selected_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(records.select_cut(_sweep(spark, sf_dir), "unit", "cut", "n_events", "ratio", 1.5, 10))


@register(f"WITH RECURSIVE {TRAIN}, {thinned_sql('tr', 'unit', 'event_id', 't', '-amp', 43200000000)} SELECT unit, event_id, t, round(amp, 6) AS amp FROM thinned JOIN tr USING (unit, event_id)")
def quality_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of events within the dead time the one of best quality stays."""
    events = train(spark, sf_dir).select("unit", "event_id", "t", "amp", (-F.col("amp")).alias("depth"))
    return rounded(sequence.thin(events, "unit", "t", DAY // 2, "depth").drop("depth"))


BINS = ", ".join(f"count(*) FILTER (WHERE t // 432000000000 = {i})::DOUBLE AS c{i}" for i in range(6))


@register(f"""WITH {TRAIN}, c AS (SELECT unit, {BINS} FROM tr GROUP BY unit), d AS (SELECT unit, c0, c5, least(c1, c2, c3, c4) AS lo, greatest(c1, c2, c3, c4) AS hi FROM c)
SELECT unit, CASE WHEN lo < least(c0, c5) * 0.95 THEN 'dip_then_rise' WHEN hi > greatest(c0, c5) * 1.05 THEN 'rise_then_dip' WHEN c5 < c0 * 0.95 THEN 'decay' WHEN c5 > c0 * 1.05 THEN 'facilitation' ELSE 'flat' END AS shape FROM d""")
def shape_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = [F.count_if(F.floor(F.col("t") / (5 * DAY)) == i).cast("double").alias(f"c{i}") for i in range(6)]
    curve = train(spark, sf_dir).groupBy("unit").agg(*n)
    inner = ["c1", "c2", "c3", "c4"]
    return curve.select("unit", tiers.shape_label(F.col("c0"), F.least(*inner), F.greatest(*inner), F.col("c5")).alias("shape"))


@register("""WITH o AS (SELECT l_orderkey, round(avg(l_quantity) / 50, 9) AS score, round(avg(l_tax), 9) AS before, round(avg(l_discount), 9) AS after, count(*) >= 2 AS found FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN found AND score >= 0.85 AND round(after - before, 9) <= 0.02 THEN 'tier1_auto_applied' ELSE 'tier2_scored_logged' END AS recovery, CASE WHEN score >= 0.85 THEN 'tier1_auto_applied' WHEN score >= 0.5 THEN 'tier2_scored_logged' ELSE 'not_surfaced' END AS merge FROM o""")
def recovery_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = lambda c: F.round(F.avg(c), 9)
    o = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(F.avg("l_quantity") / 50, 9).alias("score"), mean("l_tax").alias("before"), mean("l_discount").alias("after"), F.count("*").alias("n"))
    worse = F.round(F.col("after") - F.col("before"), 9)
    return o.select("l_orderkey", tiers.recovery_tier(F.col("score"), F.lit(0.0), worse, F.col("n") >= 2).alias("recovery"), tiers.merge_tier(F.col("score")).alias("merge"))


@register(f"""WITH {WAVES}, m AS (SELECT label, pos, avg(x) AS m FROM sm GROUP BY ALL), f AS (SELECT vec_id, label, sum(x * m) / sum(m * m) AS scale, sum(x * x) AS ww, sum(x * m) AS wm FROM sm JOIN m USING (label, pos) GROUP BY ALL)
SELECT vec_id, label, round(scale, 6) AS scale, round((ww - wm * scale) / ww, 6) AS residual FROM f""")
def template_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    rows = v.join(waveforms.mean_waveforms(v, ["label"], "embedding").select("label", "wave"), "label")
    return rounded(rows.select("vec_id", "label", pairs.fit_scale(F.col("embedding"), F.col("wave")).alias("scale"), pairs.residual_share(F.col("embedding"), F.col("wave")).alias("residual")))


@register(f"""WITH {WAVES}, d AS (SELECT *, x * x - lag(x) OVER (PARTITION BY vec_id ORDER BY pos) * lead(x) OVER (PARTITION BY vec_id ORDER BY pos) AS teo FROM sm)
SELECT vec_id, round(max(x) - min(x), 6) AS ptp, round(max(teo), 6) AS teo_max, round(arg_min(coalesce(teo, 'NaN'::DOUBLE), (x, pos)), 6) AS teo_trough FROM d GROUP BY vec_id""".replace("round(arg_min(coalesce(teo, 'NaN'::DOUBLE), (x, pos)), 6)", "round((arg_min({'teo': teo}, (x, pos))).teo, 6)"))
def wave_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peak to peak, the greatest Teager energy, and that at the first lowest sample (null at an end)."""
    wave = F.transform("embedding", lambda x: x.cast("double"))
    v = table(spark, sf_dir, "embeddings").select("vec_id", wave.alias("wave")).withColumn("teo", waveforms.teager(F.col("wave")))
    at = F.array_position("wave", F.array_min("wave")).cast("int") - 2
    return rounded(v.select("vec_id", (F.array_max("wave") - F.array_min("wave")).alias("ptp"), F.array_max("teo").alias("teo_max"), F.when(at >= 0, F.get("teo", at)).alias("teo_trough")))


@register(f"""WITH {WAVES}, md AS (SELECT vec_id, median(x) AS md FROM sm GROUP BY vec_id), n AS (SELECT vec_id, -2 * 1.4826 * median(abs(x - md)) AS lim FROM sm JOIN md USING (vec_id) GROUP BY vec_id),
b AS (SELECT vec_id, pos, x, pos - row_number() OVER (PARTITION BY vec_id ORDER BY pos) AS run FROM sm JOIN n USING (vec_id) WHERE x < lim), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id, run ORDER BY x, pos) AS k FROM b) SELECT vec_id, pos, round(x, 6) AS x FROM k WHERE k = 1""")
def noise_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Troughs below two noise levels of their own trace."""
    trace = waveforms.samples(table(spark, sf_dir, "embeddings"), ["vec_id"], "embedding")
    noise = st.mad(trace, ["vec_id"], "x").select("vec_id", (-2 * F.col("mad")).alias("limit"))
    return rounded(waveforms.troughs(trace.join(noise, "vec_id"), "vec_id", "pos", "x", F.col("limit")))


def _tail(z: str) -> str:
    fit = f"{st.ERFC[-1]!r}::DOUBLE"
    for c in st.ERFC[-2::-1]:
        fit = f"({fit} * u + ({c!r}::DOUBLE))"
    return f"(SELECT u * exp({fit} - y * y) FROM (SELECT y, 1 / (1 + 0.5 * y) AS u FROM (SELECT abs({z}) / sqrt(2.0::DOUBLE) AS y)))"


@register(f"""WITH s AS (SELECT l_returnflag AS g, round(l_quantity - 25, 2) AS d, abs(round(l_quantity - 25, 2)) AS v FROM lineitem),
k AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY v) + (count(*) OVER (PARTITION BY g, v) - 1) / 2.0 AS r FROM s), ti AS (SELECT g, sum(pow(k, 3) - k) AS ties FROM (SELECT g, v, count(*) AS k FROM s GROUP BY g, v) GROUP BY g),
m AS (SELECT g, count(*) AS n, sum(CASE WHEN d > 0 THEN r WHEN d = 0 THEN r / 2 ELSE 0 END) AS w FROM k GROUP BY g), z AS (SELECT g, n, w, (w - n * (n + 1) / 4.0) / sqrt(n * (n + 1.0) * (2 * n + 1) / 24 - ties / 48) AS z FROM m JOIN ti USING (g))
SELECT g AS l_returnflag, n, round(w, 6) AS w, round(z, 6) AS z, round({_tail("z")}, 6) AS p FROM z""")
def wilcoxon_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.round(F.col("l_quantity") - 25, 2)
    return rounded(st.wilcoxon(table(spark, sf_dir, "lineitem").select("l_returnflag", d.alias("d")), ["l_returnflag"], "d", "split"))


@register("""WITH m AS (SELECT l_returnflag AS g, count(*) AS n, covar_pop(l_quantity, l_quantity) AS aa, covar_pop(l_quantity, l_tax) AS ab, covar_pop(l_tax, l_tax) AS bb, covar_pop(l_quantity, l_extendedprice) AS ay, covar_pop(l_tax, l_extendedprice) AS by_, covar_pop(l_extendedprice, l_extendedprice) AS yy FROM lineitem GROUP BY 1),
b AS (SELECT *, aa * bb - ab * ab AS det, (bb * ay - ab * by_) / (aa * bb - ab * ab) AS b1, (aa * by_ - ab * ay) / (aa * bb - ab * ab) AS b2 FROM m), e AS (SELECT *, b1 * ay + b2 * by_ AS fit, (yy - (b1 * ay + b2 * by_)) / (n - 3) AS s2 FROM b)
SELECT g AS l_returnflag, n, round(fit / yy, 6) AS r2, 'l_quantity' AS term, round(b1, 4) AS coef, round(b1 / sqrt(s2 * bb / det), 6) AS t FROM e UNION ALL SELECT g, n, round(fit / yy, 6), 'l_tax', round(b2, 4), round(b2 / sqrt(s2 * aa / det), 6) FROM e""")
def ols_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(st.ols(table(spark, sf_dir, "lineitem"), ["l_returnflag"], ["l_quantity", "l_tax"], "l_extendedprice")).withColumn("coef", F.round("coef", 4))


@register("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1")
def first_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.keep_first(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@register(f"""WITH {TRAIN}, u AS (SELECT unit, t FROM tr WHERE kind <> 'error' UNION ALL SELECT unit + 1000, t FROM tr WHERE kind = 'error' AND unit IS NOT NULL)
SELECT unit, count(*) AS n, min(t) AS t0, max(t) AS t1 FROM u GROUP BY unit""")
def child_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = train(spark, sf_dir).select("unit", "t", "kind")
    children = recordings.with_children(events.filter("kind <> 'error'"), events.filter("kind = 'error'"), "unit")
    return children.groupBy("unit").agg(F.count("*").alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"))


@register(f"WITH {TRAIN} SELECT CAST(floor(unit / 25) AS BIGINT) AS shard, count(DISTINCT unit) AS n_units, count(*) AS n_events FROM tr GROUP BY 1")
def unit_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train(spark, sf_dir).groupBy(recordings.shard_of("unit").alias("shard")).agg(F.countDistinct("unit").alias("n_units"), F.count("*").alias("n_events"))


@register("""WITH l AS (SELECT doc_id, max(CASE WHEN toxic = 1 THEN 'toxic' END) AS a, max(CASE quality WHEN 1 THEN 'high' WHEN 0 THEN 'low' END) AS b FROM labels GROUP BY 1)
SELECT doc_id, coalesce(a, b, lang) AS label, CASE WHEN a IS NOT NULL THEN 'checked' WHEN b IS NOT NULL THEN 'manual' ELSE 'auto' END AS label_source FROM documents LEFT JOIN l USING (doc_id)""")
def label_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three levels of labels, the first that there is."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("label")), table(spark, sf_dir, "labels")
    checked = labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").alias("label"))
    manual = labels.select("doc_id", F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low").alias("label"))
    return lineage.by_precedence(docs, "doc_id", "label", [("checked", checked), ("manual", manual)])


LATE = "SELECT l_orderkey, avg(CASE WHEN l_quantity > 1 THEN 1.0 ELSE 0.0 END) AS matched, max(l_discount) * 600 AS worst, count(*) AS n, count(*) FILTER (WHERE l_linestatus = 'F') AS nf FROM lineitem GROUP BY 1"


@register(f"""WITH s AS ({LATE}), v AS (SELECT CASE WHEN matched IS NULL THEN 'unknown' WHEN matched >= 1 AND coalesce(worst, 0) <> 0 AND worst < 50 AND nf = n THEN 'pass' WHEN matched >= 0.99 THEN 'check' ELSE 'FAIL' END AS verdict, o_orderpriority
 FROM orders LEFT JOIN s ON l_orderkey = o_orderkey) SELECT o_orderpriority, verdict, count(*) AS n FROM v GROUP BY ALL""")
def sync_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sessions, their lines as matched events: verdicts of each priority."""
    hit = F.when(F.col("l_quantity") > 1, 1.0).otherwise(0.0)
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.avg(hit).alias("matched"), (F.max("l_discount") * 600).alias("worst"), F.count("*").alias("n"), F.count_if(F.col("l_linestatus") == "F").alias("nf")
    )
    joined = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.groupBy("o_orderpriority", tiers.sync_verdict(F.col("matched"), F.col("worst"), F.col("nf"), F.col("n")).alias("verdict")).agg(F.count("*").alias("n"))


@register("""WITH o AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS live, count(*) FILTER (WHERE o_orderstatus <> 'O') AS units, count(*) FILTER (WHERE o_orderpriority < '3') AS saved FROM orders GROUP BY 1),
s AS (SELECT c_custkey, CASE WHEN c_acctbal < -900 THEN 'HALF OF A JOIN' WHEN c_nationkey = 3 AND coalesce(saved, 0) = 0 AND coalesce(live, 0) = 0 THEN 'SUPERSEDED' WHEN coalesce(saved, 0) = 0 AND coalesce(live, 0) = 0 THEN 'NOT REVIEWED'
 WHEN live IS NULL THEN 'ON Z' WHEN live > saved THEN 'DRIFTED' WHEN live < saved THEN 'CHECK' WHEN (units = 0 OR live < units) AND c_mktsegment = 'BUILDING' THEN 'SAVED, REVIEW CLOSED' WHEN units = 0 OR live < units THEN 'SAVED, PARTIAL' ELSE 'SAVED, COMPLETE' END AS state
 FROM customer LEFT JOIN o ON o_custkey = c_custkey) SELECT state, count(*) AS n, min(c_custkey) AS first FROM s GROUP BY state""")
def review_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as sessions, their orders as decisions: how many stand in each state."""
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("live"), F.count_if(F.col("o_orderstatus") != "O").alias("units"), F.count_if(F.col("o_orderpriority") < "3").alias("saved")
    )
    rows = table(spark, sf_dir, "customer").join(counts, F.col("c_custkey") == F.col("o_custkey"), "left")
    state = tiers.review_state(F.col("c_acctbal") < -900, F.col("c_nationkey") == 3, F.col("saved"), F.col("live"), F.col("units"), F.col("c_mktsegment") == "BUILDING")
    return rows.groupBy(state.alias("state")).agg(F.count("*").alias("n"), F.min("c_custkey").alias("first"))
