"""Queries on waveforms, sweeps and models over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators import bands, decoding, models, waveforms
from pulsegrid.plans.base import register, rounded, thinned_sql
from pulsegrid.plans.trains import DAY, HOUR, MIN, PAIRS, TRAIN, train
from pulsegrid.session import table

WAVES = "sm AS (SELECT vec_id, label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)"


@register(f"WITH {WAVES} SELECT label, CAST(pos AS INTEGER) AS pos, count(*) AS n, round(avg(x), 6) AS x FROM sm GROUP BY ALL")
def mean_waveforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = waveforms.mean_waveforms(table(spark, sf_dir, "embeddings"), ["label"], "embedding")
    return rounded(means.select("label", "n", F.posexplode("wave").alias("pos", "x")))


@register(f"""WITH {WAVES}, m AS (SELECT label, vec_id % 4 AS segment, pos, avg(x) AS x FROM sm GROUP BY ALL), w AS (SELECT label, segment, list(x ORDER BY pos) AS w FROM m GROUP BY ALL),
s AS (SELECT a.label, avg(list_cosine_similarity(a.w, b.w)) AS score FROM w a JOIN w b ON a.label = b.label AND a.segment < b.segment GROUP BY 1)
SELECT w.label, count(*) AS n_segments, round(any_value(score), 6) AS score FROM w LEFT JOIN s USING (label) GROUP BY w.label""")
def footprint_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").withColumn("segment", F.col("vec_id") % 4)
    return rounded(waveforms.stability(v, "label", "segment", "embedding"))


@register(f"""WITH {WAVES}, m AS (SELECT label, list(x ORDER BY pos) AS m FROM (SELECT label, pos, avg(x) AS x FROM sm GROUP BY ALL) GROUP BY label)
SELECT label, count(*) AS n, round(CASE WHEN count(*) >= 5 THEN least(greatest(avg(list_cosine_similarity(embedding::DOUBLE[], m)), 0), 1) END, 6) AS score FROM embeddings JOIN m USING (label) GROUP BY label""")
def shape_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(waveforms.consistency(table(spark, sf_dir, "embeddings"), ["label"], "embedding"))


@register(f"""WITH {WAVES}, b AS (SELECT *, pos - row_number() OVER (PARTITION BY vec_id ORDER BY pos) AS run FROM sm WHERE x < -0.15),
k AS (SELECT vec_id, pos, x, row_number() OVER (PARTITION BY vec_id, run ORDER BY x, pos) AS k FROM b) SELECT vec_id, pos, round(x, 6) AS x FROM k WHERE k = 1""")
def trough_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    trace = waveforms.samples(table(spark, sf_dir, "embeddings"), ["vec_id"], "embedding")
    return rounded(waveforms.troughs(trace, "vec_id", "pos", "x", -0.15))


@register(f"""WITH RECURSIVE {WAVES}, b AS (SELECT *, pos - row_number() OVER (PARTITION BY vec_id ORDER BY pos) AS run FROM sm WHERE x < -0.15),
r AS (SELECT vec_id, pos, x FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, run ORDER BY x, pos) AS i FROM b) WHERE i = 1), {thinned_sql("r", "vec_id", "pos", "pos", "x", 10)}
SELECT vec_id, pos, round(x, 6) AS x FROM thinned JOIN r USING (vec_id, pos)""")
def trough_detect_dead_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    trace = waveforms.samples(table(spark, sf_dir, "embeddings"), ["vec_id"], "embedding")
    return rounded(waveforms.troughs(trace, "vec_id", "pos", "x", -0.15, dead=10))


CUTS = [50.0, 20.0, 10.0, 5.0, 0.0]
SWEEP = TRAIN + f""", e AS (SELECT tr.*, c.cut FROM tr JOIN (SELECT unnest({CUTS}::DOUBLE[]) AS cut) c ON amp >= cut), n AS (SELECT unit, cut, count(*) AS n_events FROM e GROUP BY ALL),
p AS (SELECT a.unit, a.cut, b.t - a.t AS lag FROM e a JOIN e b ON a.unit = b.unit AND a.cut = b.cut AND b.t - a.t BETWEEN 0 AND 88200000000 AND (b.t > a.t OR (b.t = a.t AND b.event_id > a.event_id))),
h AS (SELECT unit, cut, least(floor(lag / 1800000000.0), 48) AS bin, 2 * count(*) AS n FROM p GROUP BY ALL),
s AS (SELECT unit, cut, sum(CASE WHEN bin + 0.5 <= 2 THEN n ELSE 0 END) AS r, sum(CASE WHEN bin + 0.5 BETWEEN 12 AND 48 THEN n ELSE 0 END) / 72 * 4 AS expected FROM h GROUP BY ALL),
sw AS (SELECT unit, cut, n_events, coalesce(CASE WHEN expected > 0 THEN r / expected WHEN r > 0 THEN 'Infinity'::DOUBLE ELSE 0 END, 0) AS ratio FROM n LEFT JOIN s USING (unit, cut))"""


def _sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return waveforms.sweep(train(spark, sf_dir), "unit", "t", "event_id", "amp", CUTS, 30 * MIN, HOUR, (6 * HOUR, DAY))


@register(f"WITH {SWEEP} SELECT unit, cut, n_events, round(ratio, 6) AS ratio FROM sw")
def cutoff_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_sweep(spark, sf_dir))


@register(f"""WITH {SWEEP}, d AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY cut DESC) - 1 AS i, lead(ratio) OVER (PARTITION BY unit ORDER BY cut DESC) - ratio AS d, count(*) OVER (PARTITION BY unit) AS n FROM sw),
m AS (SELECT unit, median(abs(d)) + 1e-9 AS m FROM d WHERE d IS NOT NULL AND i < greatest(1, floor((n - 1) / 2.0)) GROUP BY unit),
c AS (SELECT unit, arg_min(cut, i) AS first FROM d JOIN m USING (unit) WHERE n >= 3 AND i >= 1 AND d > 4 * m AND d > 0.005 GROUP BY unit)
SELECT unit, coalesce(any_value(first), max(cut)) AS cut, any_value(first) IS NOT NULL AS found FROM d LEFT JOIN c USING (unit) GROUP BY unit""")
def inflection_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return waveforms.inflection(_sweep(spark, sf_dir), "unit", "cut", "ratio")


@register(f"""WITH {PAIRS}, s AS (SELECT unit, sum(n) AS s, sum(n * n) AS q FROM h GROUP BY unit), xy AS (SELECT a.unit AS a, b.unit AS b, sum(a.n * b.n) AS xy FROM h a JOIN h b USING (bin) WHERE a.unit <> b.unit GROUP BY ALL),
r AS (SELECT a, b, (xy * 72 - sa.s * sb.s) / (sqrt(sa.q * 72 - sa.s * sa.s) * sqrt(sb.q * 72 - sb.s * sb.s)) AS r FROM xy JOIN s sa ON sa.unit = a JOIN s sb ON sb.unit = b),
k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(r, 9) DESC, b) AS k FROM r) SELECT a AS unit, b AS other, round(r, 6) AS r FROM k WHERE k = 1""")
def acg_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = bands.autocorrelogram(train(spark, sf_dir), "unit", "t", "event_id", 6 * HOUR, 10 * MIN)
    return rounded(waveforms.best_correlated(h, "unit", 72))


GRID = ([0.02, 0.05, 0.1, 0.2], [10.0, 20.0, 25.0, 30.0, 40.0], [0.0, 0.05, 0.1])


@register(f"""WITH c AS (SELECT l_returnflag AS g, l_quantity AS x, count(*) FILTER (WHERE l_extendedprice > 38000) AS k, count(*) AS n FROM lineitem GROUP BY ALL),
g AS (SELECT s.v AS slope, b.v AS bias, p.v AS lapse FROM (SELECT unnest({GRID[0]}::DOUBLE[]) AS v) s, (SELECT unnest({GRID[1]}::DOUBLE[]) AS v) b, (SELECT unnest({GRID[2]}::DOUBLE[]) AS v) p),
l AS (SELECT c.g, slope, bias, lapse, k, n, least(greatest(lapse + (1 - 2 * lapse) / (1 + exp(-slope * (x - bias))), 1e-9), 1 - 1e-9) AS p FROM c, g),
f AS (SELECT g, slope, bias, lapse, round(sum(k * ln(p) + (n - k) * ln(1 - p)), 9) AS loglik FROM l GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY loglik DESC, slope, bias, lapse) AS i FROM f)
SELECT g AS l_returnflag, slope, bias, lapse, round(loglik, 4) AS loglik FROM r WHERE i = 1""")
def psychometric_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("dear", F.col("l_extendedprice") > 38000)
    return rounded(models.psychometric(rows, ["l_returnflag"], "l_quantity", "dear", *GRID), 4)


@register(f"WITH {TRAIN} SELECT unit, count(*) FILTER (WHERE kind = 'click') AS click, count(*) FILTER (WHERE kind = 'error') AS error, count(*) FILTER (WHERE kind = 'purchase') AS purchase, count(*) FILTER (WHERE kind = 'signup') AS signup, count(*) FILTER (WHERE kind = 'view') AS view FROM tr GROUP BY unit")
def design_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["click", "error", "purchase", "signup", "view"]
    return train(spark, sf_dir).groupBy("unit").pivot("kind", kinds).count().fillna(0, kinds)


@register(f"WITH {TRAIN}, i AS (SELECT *, t - lag(t) OVER (PARTITION BY unit ORDER BY t, event_id) AS isi FROM tr) SELECT unit, count(isi) AS n, round(CASE WHEN count(isi) >= 10 THEN corr(isi / 1e6, amp) END, 6) AS r FROM i GROUP BY unit")
def interval_amplitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.operators.sequence import with_interval

    rows = with_interval(train(spark, sf_dir), "unit", "t", "event_id")
    return rounded(rows.groupBy("unit").agg(F.count("isi").alias("n"), F.when(F.count("isi") >= 10, F.corr(F.col("isi") / 1e6, "amp")).alias("r")))


@register("""WITH s AS (SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles, count(*) AS n, sum(length(text)) AS size FROM conversations GROUP BY conv_id)
SELECT a.conv_id AS a, b.conv_id AS b, a.n, abs(a.size - b.size) AS spread FROM s a JOIN s b ON a.roles = b.roles AND a.n = b.n AND a.conv_id < b.conv_id WHERE abs(a.size - b.size) <= 20""")
def sequence_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences equal in every step whose sizes differ little, as an equi-join on the sequence and a bucket of the size."""
    turns = F.sort_array(F.collect_list(F.struct("turn", "role")))
    s = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(turns, lambda x: x["role"]).alias("roles"), F.count("*").alias("n"), F.sum(F.length("text")).alias("size"))
    a = s.select(F.col("conv_id").alias("a"), "roles", "n", F.col("size").alias("sa"))
    b = s.select(F.col("conv_id").alias("b"), "roles", F.col("size").alias("sb"))
    near = bands.band_join(a, b, "sa", "sb", -20, 20, ["roles"]).filter("a < b")
    return near.select("a", "b", "n", F.abs(F.col("sa") - F.col("sb")).alias("spread"))


@register("SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL")
def label_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tallies as a map per source, opened again to rows."""
    counts = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    tallies = counts.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("tally"))
    return tallies.select("source", F.explode("tally").alias("lang", "n"))


@register("SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d_%H%M%S') AS session, dayofyear(o_orderdate) AS day, date_diff('day', lag(o_orderdate::DATE) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), o_orderdate::DATE) AS since FROM orders".replace("dayofyear(o_orderdate) AS day", "CAST(dayofyear(o_orderdate) AS INTEGER) AS day"))
def session_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders")
    text = F.date_format("o_orderdate", "yyyyMMdd_HHmmss")
    day = F.to_date(F.to_timestamp(text, "yyyyMMdd_HHmmss"))
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.select("o_orderkey", text.alias("session"), F.dayofyear("o_orderdate").alias("day"), F.datediff(day, F.lag(day).over(w)).alias("since"))


@register()
def ridge_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    return rounded(models.ridge_cv(rows, "l_orderkey", ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", [0.0, 1.0], k=3), 4)


@register()
def permutation_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").withColumn("g", F.col("c_mktsegment") == "BUILDING")
    return rounded(decoding.permutation_p(rows, "c_custkey", "g", "c_acctbal", 99))


@register()
def mixture_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(models.mixture_by_bic(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"], 3), 2)


# the pooled covariance of three features with its ridge, solved by cofactors
@register("""WITH v AS (SELECT l_returnflag = 'R' AS g, l_quantity::DOUBLE AS a, l_extendedprice::DOUBLE AS b, l_tax::DOUBLE AS c FROM lineitem),
m AS (SELECT g, count(*) AS n, avg(a) AS a, avg(b) AS b, avg(c) AS c, (count(*) - 1) * covar_samp(a, a) AS aa, (count(*) - 1) * covar_samp(a, b) AS ab, (count(*) - 1) * covar_samp(a, c) AS ac,
 (count(*) - 1) * covar_samp(b, b) AS bb, (count(*) - 1) * covar_samp(b, c) AS bc, (count(*) - 1) * covar_samp(c, c) AS cc FROM v GROUP BY g),
s AS (SELECT x.n AS n0, y.n AS n1, y.a - x.a AS a, y.b - x.b AS b, y.c - x.c AS c, (x.aa + y.aa) / (x.n + y.n - 2) AS aa, (x.ab + y.ab) / (x.n + y.n - 2) AS ab, (x.ac + y.ac) / (x.n + y.n - 2) AS ac,
 (x.bb + y.bb) / (x.n + y.n - 2) AS bb, (x.bc + y.bc) / (x.n + y.n - 2) AS bc, (x.cc + y.cc) / (x.n + y.n - 2) AS cc FROM m x JOIN m y ON NOT x.g AND y.g),
r AS (SELECT n0, n1, a, b, c, ab, ac, bc, aa + 1e-9 * (aa + bb + cc) / 3 AS aa, bb + 1e-9 * (aa + bb + cc) / 3 AS bb, cc + 1e-9 * (aa + bb + cc) / 3 AS cc FROM s)
SELECT n0, n1, round((a * a * (bb * cc - bc * bc) + b * b * (aa * cc - ac * ac) + c * c * (aa * bb - ab * ab) + 2 * a * b * (ac * bc - ab * cc) + 2 * a * c * (ab * bc - ac * bb) + 2 * b * c * (ab * ac - aa * bc))
 / (aa * (bb * cc - bc * bc) - ab * (ab * cc - ac * bc) + ac * (ab * bc - ac * bb)), 8) AS distance2 FROM r""")
def mahalanobis_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("returned", F.col("l_returnflag") == "R")
    return rounded(models.separation(rows, "returned", ["l_quantity", "l_extendedprice", "l_tax"]).drop("weights"), 8)
