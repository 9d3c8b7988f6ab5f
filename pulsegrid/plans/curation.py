"""Queries on lineage, selections, verdicts, pairs and reports over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions import tiers
from pulsegrid.operators import lineage, pairs
from pulsegrid.operators import statistics as st
from pulsegrid.operators.trials import selected_events
from pulsegrid.plans.base import register, rounded
from pulsegrid.plans.trains import DAY, HOUR, TRAIN, train
from pulsegrid.session import table


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A closed range per event: the user is active for some minutes of its value after it."""
    e = train(spark, sf_dir)
    return e.select("unit", F.col("t").alias("t0"), (F.col("t") + F.floor(F.col("amp") * 600_000_000)).alias("t1"))


RANGES = TRAIN + ", ra AS (SELECT unit, t AS t0, t + CAST(floor(amp * 600000000) AS BIGINT) AS t1 FROM tr)"
UNION = """o AS (SELECT *, max(t1) OVER (PARTITION BY unit ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ra),
i AS (SELECT *, sum(CASE WHEN reach >= t0 THEN 0 ELSE 1 END) OVER (PARTITION BY unit ORDER BY t0, t1) AS island FROM o), u AS (SELECT unit, min(t0) AS t0, max(t1) AS t1 FROM i GROUP BY unit, island)"""


@register(f"WITH {RANGES}, {UNION} SELECT * FROM u")
def range_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.range_union(_ranges(spark, sf_dir), "unit")


@register(f"""WITH {RANGES}, p AS (SELECT unit, t0, t1 FROM ra WHERE t1 - t0 > 50400000000), m AS (SELECT DISTINCT CAST(floor(unit / 3) AS BIGINT) AS merged, unit AS parent FROM tr),
w AS (SELECT merged AS unit, coalesce(t0, 0) AS t0, coalesce(t1, 2592000000000) AS t1 FROM m LEFT JOIN p ON p.unit = m.parent), {UNION.replace('FROM ra', 'FROM w')} SELECT unit AS merged, t0, t1 FROM u""")
def freeze_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    merges = train(spark, sf_dir).select(F.floor(F.col("unit") / 3).alias("merged"), F.col("unit").alias("parent")).distinct()
    restrictions = _ranges(spark, sf_dir).filter(F.col("t1") - F.col("t0") > 14 * HOUR).withColumnRenamed("unit", "parent")
    return lineage.merged_windows(merges, restrictions, (0, 30 * DAY))


@register(f"""WITH {TRAIN}, r AS (SELECT event_id AS range_id, t AS t0, t + 172800000000 AS t1 FROM tr), p AS (SELECT * FROM (VALUES (0, 0, 864000000000), (1, 864000000000, 1728000000000), (2, 1728000000000, 2592000000000)) AS v(part, start, stop))
SELECT range_id, part, greatest(t0, start) - start AS t0, least(t1, stop) - start AS t1 FROM r JOIN p ON t1 > start AND t0 < stop""")
def clip_and_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = train(spark, sf_dir).select(F.col("event_id").alias("range_id"), F.col("t").alias("t0"), (F.col("t") + 2 * DAY).alias("t1"))
    parts = spark.createDataFrame([(k, 10 * k * DAY, 10 * (k + 1) * DAY) for k in range(3)], "part int, start long, stop long")
    return lineage.clip_ranges(ranges, parts)


@register("""WITH RECURSIVE e AS (SELECT x.vec_id AS a, y.vec_id AS b FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1 AND y.label = x.label), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS node, least(a, b) AS root FROM s UNION SELECT s.b, r.root FROM r JOIN s ON s.a = r.node) SELECT node, min(root) AS root FROM r GROUP BY node""")
def merge_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    following = v.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), "label")
    return lineage.merge_groups(v.withColumnRenamed("vec_id", "a").join(following, ["a", "label"]).select("a", "b"))


@register("""SELECT doc_id, CASE WHEN v IS NOT NULL THEN v WHEN n_chars < 500 THEN 'short' ELSE 'long' END AS label, CASE WHEN v IS NOT NULL THEN 'verdict' ELSE 'automatic' END AS label_source
FROM documents LEFT JOIN (SELECT doc_id, max(CASE WHEN toxic = 1 THEN 'noise' WHEN quality = 1 THEN 'good' ELSE 'mua' END) AS v FROM labels GROUP BY doc_id) USING (doc_id)""")
def verdict_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") < 500, "short").otherwise("long").alias("label"))
    verdict = F.when(F.col("toxic") == 1, "noise").when(F.col("quality") == 1, "good").otherwise("mua")
    return lineage.overlay(rows, table(spark, sf_dir, "labels").select("doc_id", verdict.alias("v")), "doc_id", "label", "v")


SELECTION = f"""{RANGES}, w AS (SELECT unit, t0, t1 FROM ra WHERE t1 - t0 > 50400000000), trials AS (SELECT DISTINCT CAST(floor(t / 86400000000.0) AS BIGINT) AS trial, CAST(floor(t / 86400000000.0) AS BIGINT) * 86400000000 AS t FROM tr), units AS (SELECT DISTINCT unit FROM tr),
sel AS (SELECT u.unit, x.trial, max(CASE WHEN w.unit IS NULL THEN true ELSE x.t BETWEEN w.t0 AND w.t1 END) AS selected FROM units u CROSS JOIN trials x LEFT JOIN w ON w.unit = u.unit GROUP BY 1, 2)"""


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranges(spark, sf_dir).filter(F.col("t1") - F.col("t0") > 14 * HOUR)


def _selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = train(spark, sf_dir)
    day = F.floor(F.col("t") / DAY)
    trials = e.select(day.alias("trial"), (day * DAY).alias("t")).distinct()
    return lineage.dense_selection(e.select("unit").distinct(), trials, _windows(spark, sf_dir), "unit", "trial", "t")


@register(f"WITH {SELECTION} SELECT unit, trial, selected FROM sel")
def dense_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selection(spark, sf_dir)


@register(f"WITH {SELECTION}, ev AS (SELECT unit, event_id, CAST(floor(t / 86400000000.0) AS BIGINT) AS trial FROM tr) SELECT unit, event_id, trial FROM ev WHERE NOT EXISTS (SELECT 1 FROM sel WHERE sel.unit = ev.unit AND sel.trial = ev.trial AND NOT sel.selected)")
def anti_join_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.floor(F.col("t") / DAY).cast("long")
    e = train(spark, sf_dir).select("unit", "event_id", day.alias("trial"), (day * DAY).alias("t"))
    return selected_events(e, _windows(spark, sf_dir), "unit", "t", 7 * DAY).drop("t")


@register("""WITH n AS (SELECT o_custkey AS parent, CAST(floor(o_custkey / 4) AS BIGINT) AS merged, count(*) AS n FROM orders GROUP BY ALL)
SELECT merged, parent, n, round(n / sum(n) OVER (PARTITION BY merged), 6) AS share, n / sum(n) OVER (PARTITION BY merged) > 0.5 AS dominant FROM n""")
def merge_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").groupBy(F.floor(F.col("o_custkey") / 4).alias("merged"), F.col("o_custkey").alias("parent")).agg(F.count("*").alias("n"))
    return rounded(lineage.shares(n, "merged", "n", 0.5))


@register("""SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN d.doc_id IS NULL THEN 'extra' ELSE 'duplicated' END AS problem
FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT doc_id, count(*) AS n FROM labels GROUP BY doc_id) l USING (doc_id) WHERE l.doc_id IS NULL OR d.doc_id IS NULL OR n > 1""")
def coverage_assert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.coverage(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


GRID = "pts AS (SELECT vec_id, embedding, (vec_id % 40) * 20.0 AS x, floor(vec_id / 40) * 25.0 AS y FROM embeddings)"
PAIRED = GRID + ", pr AS (SELECT a.vec_id AS a, b.vec_id AS b, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS distance, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS similarity FROM pts a JOIN pts b ON a.vec_id < b.vec_id AND abs(a.x - b.x) <= 100 AND abs(a.y - b.y) <= 100 WHERE sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 100)"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return v.select("vec_id", "embedding", ((F.col("vec_id") % 40) * 20.0).alias("x"), (F.floor(F.col("vec_id") / 40) * 25.0).alias("y"))


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir)
    return pairs.described(pairs.spatial_pairs(p, "vec_id", "x", "y", 100.0), p, "vec_id", "embedding")


@register(f"WITH {PAIRED} SELECT a, b, round(distance, 6) AS distance FROM pr")
def spatial_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pairs.spatial_pairs(_points(spark, sf_dir), "vec_id", "x", "y", 100.0))


@register(f"WITH {PAIRED} SELECT a, b, round(similarity, 6) AS similarity FROM pr")
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_near(spark, sf_dir).drop("distance"))


BOTH = PAIRED + ", bo AS (SELECT a AS unit, b AS other, similarity FROM pr UNION ALL SELECT b, a, similarity FROM pr)"


@register(f"WITH {BOTH}, r AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY similarity DESC, other) AS rank FROM bo) SELECT unit, other, round(similarity, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def topk_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pairs.top_similar(_near(spark, sf_dir), 5))


@register(f"WITH {BOTH}, r AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY similarity DESC, other) AS k, row_number() OVER (PARTITION BY other ORDER BY similarity DESC, unit) AS j FROM bo) SELECT unit, other, round(similarity, 6) AS similarity FROM r WHERE k = 1 AND j = 1 AND similarity >= 0.1")
def mutual_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _near(spark, sf_dir)
    both = p.select(F.col("a").alias("unit"), F.col("b").alias("other"), "similarity").unionByName(p.select(F.col("b").alias("unit"), F.col("a").alias("other"), "similarity"))
    return rounded(pairs.mutual_best(both, "unit", "other", "similarity", 0.1))


@register("""WITH s AS (SELECT vec_id, list_reverse_sort(list_transform(embedding::DOUBLE[], lambda x: abs(x))) AS s, embedding::DOUBLE[] AS e FROM embeddings)
SELECT vec_id, round(s[2] / s[1], 6) AS concentration, round((s[4] + s[5]) / 2 / s[1], 6) AS flatness, round(abs(list_position(e, list_max(e)) - list_position(e, list_min(e))) / 30.0, 6) AS width_ms FROM s""")
def footprint_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    size = F.transform("e", F.abs)
    return rounded(v.select("vec_id", pairs.concentration(size).alias("concentration"), pairs.flatness(size).alias("flatness"), pairs.peak_trough_width(F.col("e"), 30.0).alias("width_ms")))


POLYGON = [(50.0, 10.0), (400.0, 60.0), (700.0, 20.0), (600.0, 250.0), (300.0, 130.0), (90.0, 260.0)]


def _polygon_sql() -> str:
    edges = zip(POLYGON, POLYGON[1:] + POLYGON[:1])
    return " + ".join(f"CASE WHEN ({y1} > y) <> ({y2} > y) AND x < ({x2} - {x1}) * (y - {y1}) / ({y2} - {y1}) + {x1} THEN 1 ELSE 0 END" for (x1, y1), (x2, y2) in edges)


@register(f"WITH {GRID} SELECT vec_id, ({_polygon_sql()}) % 2 = 1 AS inside FROM pts")
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir).select("vec_id", pairs.inside_polygon(F.col("x"), F.col("y"), POLYGON).alias("inside"))




@register("""WITH te AS (SELECT p_type || '/' || p_size AS test, CASE WHEN count(*) > 1 THEN least(abs(avg(p_retailprice) - 1400) / 1500, 1.0) END AS p FROM part GROUP BY 1),
r AS (SELECT test, p, p * count(*) OVER () / row_number() OVER (ORDER BY p) AS raw, row_number() OVER (ORDER BY p) AS k FROM te WHERE p IS NOT NULL),
a AS (SELECT test, p, least(min(raw) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0) AS p_adjusted FROM r)
SELECT test, round(p, 6) AS p, round(p_adjusted, 6) AS p_adjusted, p_adjusted <= 0.3 AS rejected FROM a UNION ALL SELECT test, NULL, NULL, NULL FROM te WHERE p IS NULL""")
def bh_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat_ws("/", "p_type", F.col("p_size").cast("string")).alias("test")
    p = F.when(F.count("*") > 1, F.least(F.abs(F.avg("p_retailprice") - 1400) / 1500, F.lit(1.0))).alias("p")
    return rounded(st.false_discovery(table(spark, sf_dir, "part").groupBy(name).agg(p), "p", 0.3))



@register("""WITH r AS (SELECT l_returnflag AS g, l_quantity AS x, l_extendedprice AS y FROM lineitem),
k AS (SELECT g, rank() OVER (PARTITION BY g ORDER BY x) + (count(*) OVER (PARTITION BY g, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY g ORDER BY y) + (count(*) OVER (PARTITION BY g, y) - 1) / 2.0 AS ry FROM r)
SELECT g AS l_returnflag, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM k GROUP BY g""")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(st.spearman(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice"))


RANK1 = "k AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY v) + (count(*) OVER (PARTITION BY g, v) - 1) / 2.0 AS r FROM s), ti AS (SELECT g, sum(pow(k, 3) - k) AS ties FROM (SELECT g, v, count(*) AS k FROM s GROUP BY g, v) GROUP BY g)"
SCORED = "s AS (SELECT o_orderpriority AS g, o_totalprice AS v, o_orderstatus = 'F' AS pos FROM orders)"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderpriority", "o_totalprice", (F.col("o_orderstatus") == "F").alias("pos"))


@register(f"WITH {SCORED}, {RANK1}, m AS (SELECT g, count(*) FILTER (WHERE pos) AS n1, count(*) FILTER (WHERE NOT pos) AS n0, sum(CASE WHEN pos THEN r END) AS s FROM k GROUP BY g) SELECT g AS o_orderpriority, n1, n0, round((s - n1 * (n1 + 1) / 2) / (n1 * n0), 6) AS auc FROM m")
def rank_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(st.rank_auc(_scored(spark, sf_dir), ["o_orderpriority"], "o_totalprice", "pos"))


@register(f"""WITH {SCORED}, {RANK1}, m AS (SELECT g, count(*) FILTER (WHERE pos) AS n1, count(*) FILTER (WHERE NOT pos) AS n0, sum(CASE WHEN pos THEN r END) AS s FROM k GROUP BY g),
u AS (SELECT m.*, ties, s - n1 * (n1 + 1) / 2 AS u, CAST(n1 + n0 AS DOUBLE) AS n FROM m JOIN ti USING (g)), sd AS (SELECT *, sqrt(n1 * n0 / 12.0 * ((n + 1) - ties / (n * (n - 1)))) AS sd, n1 * n0 / 2.0 AS mu FROM u)
SELECT g AS o_orderpriority, n1, n0, round(u, 6) AS u, round(sign(u - mu) * greatest(abs(u - mu) - 0.5, 0) / sd, 6) AS z FROM sd""")
def mann_whitney_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(st.mann_whitney(_scored(spark, sf_dir), ["o_orderpriority"], "o_totalprice", "pos").drop("p"))


@register("""WITH d AS (SELECT l_returnflag AS g, round(l_quantity - 25 + l_discount * 10, 2) AS d FROM lineitem), s AS (SELECT g, d, abs(d) AS v FROM d WHERE d <> 0),
k AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY v) + (count(*) OVER (PARTITION BY g, v) - 1) / 2.0 AS r FROM s), ti AS (SELECT g, sum(pow(k, 3) - k) AS ties FROM (SELECT g, v, count(*) AS k FROM s GROUP BY g, v) GROUP BY g),
m AS (SELECT g, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w FROM k GROUP BY g)
SELECT g AS l_returnflag, n, round(w, 6) AS w, round((w - n * (n + 1) / 4.0) / sqrt(n * (n + 1.0) * (2 * n + 1) / 24 - ties / 48), 6) AS z FROM m JOIN ti USING (g)""")
def wilcoxon_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.round(F.col("l_quantity") - 25 + F.col("l_discount") * 10, 2)
    return rounded(st.wilcoxon(table(spark, sf_dir, "lineitem").select("l_returnflag", d.alias("d")), ["l_returnflag"], "d").drop("p"))


@register("""SELECT l_returnflag, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 6) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2,
round(regr_slope(l_extendedprice, l_quantity) / sqrt((regr_syy(l_extendedprice, l_quantity) - pow(regr_slope(l_extendedprice, l_quantity), 2) * regr_sxx(l_extendedprice, l_quantity)) / (count(*) - 2) / regr_sxx(l_extendedprice, l_quantity)), 6) AS t FROM lineitem GROUP BY l_returnflag""")
def ols_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(st.line_fit(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice"))


@register("WITH m AS (SELECT p_brand, median(p_retailprice) AS med FROM part GROUP BY 1) SELECT p_brand, round(any_value(med), 6) AS median, round(median(abs(p_retailprice - med)) * 1.4826, 6) AS mad FROM part JOIN m USING (p_brand) GROUP BY p_brand")
def mad_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(st.mad(table(spark, sf_dir, "part"), ["p_brand"], "p_retailprice"))


@register("""WITH b AS (SELECT o_orderstatus, CASE WHEN o_totalprice < 50000 THEN 0 WHEN o_totalprice < 150000 THEN 1 WHEN o_totalprice < 400000 THEN 2 END AS bin, CAST(o_custkey AS DOUBLE) AS y FROM orders WHERE o_totalprice >= 0 AND o_totalprice < 400000)
SELECT o_orderstatus, bin, count(*) AS n, round(avg(y), 6) AS mean, round(stddev_samp(y) / sqrt(count(*)), 6) AS sem, round(median(y), 6) AS median FROM b GROUP BY ALL""")
def binned_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("y", F.col("o_custkey").cast("double"))
    return rounded(st.binned_summary(rows, ["o_orderstatus"], "o_totalprice", "y", [0.0, 50000.0, 150000.0, 400000.0]))


@register("""WITH c AS (SELECT quantile_cont(c_acctbal, 1.0 / 3) AS a, quantile_cont(c_acctbal, 2.0 / 3) AS b FROM customer) SELECT c_custkey, CAST((c_acctbal > a)::INT + (c_acctbal > b)::INT AS INTEGER) AS class FROM customer CROSS JOIN c""")
def qcut_tertiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.quantile_class(table(spark, sf_dir, "customer"), "c_acctbal", 3).select("c_custkey", "class")


@register("SELECT l_returnflag, round(avg(CASE WHEN l_linestatus = 'F' THEN l_quantity END), 6) AS F, round(avg(CASE WHEN l_linestatus = 'O' THEN l_quantity END), 6) AS O FROM lineitem GROUP BY l_returnflag")
def pivot_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(table(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.avg("l_quantity")))


@register("WITH r AS (SELECT l_suppkey, l_returnflag, avg(l_quantity) AS m FROM lineitem GROUP BY ALL) SELECT l_returnflag, count(*) AS n, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS spread FROM r GROUP BY l_returnflag")
def replicate_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.avg("l_quantity").alias("m"))
    return rounded(means.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("spread")))


@register("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@register("""WITH c AS (SELECT n_nationkey AS nation, o_orderpriority AS bin, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
a AS (SELECT nation, bin FROM (SELECT *, max(n) OVER (PARTITION BY nation) AS m FROM c) WHERE n > 0.8 * m), s AS (SELECT nation, count(*) AS n FROM a GROUP BY 1)
SELECT x.nation AS a, y.nation AS b, round(count(*) / (any_value(sx.n) + any_value(sy.n) - count(*)), 6) AS jaccard FROM a x JOIN a y ON x.bin = y.bin AND x.nation < y.nation JOIN s sx ON sx.nation = x.nation JOIN s sy ON sy.nation = y.nation GROUP BY 1, 2""")
def jaccard_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    c = o.groupBy(F.col("c_nationkey").alias("nation"), F.col("o_orderpriority").alias("bin")).agg(F.count("*").alias("n"))
    a = c.withColumn("m", F.max("n").over(Window.partitionBy("nation"))).filter("n > 0.8 * m").select("nation", "bin")
    s = a.groupBy("nation").agg(F.count("*").alias("size"))
    left = a.join(s, "nation").select(F.col("nation").alias("a"), "bin", F.col("size").alias("sa"))
    right = a.join(s, "nation").select(F.col("nation").alias("b"), "bin", F.col("size").alias("sb"))
    both = left.join(right, "bin").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.first("sa").alias("sa"), F.first("sb").alias("sb"))
    return rounded(both.select("a", "b", (F.col("n") / (F.col("sa") + F.col("sb") - F.col("n"))).alias("jaccard")))


@register("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 45 THEN 'large' ELSE NULL END IS NOT NULL OR l_discount >= 0.09 OR l_tax >= 0.08 AS flagged,
array_to_string(list_filter([CASE WHEN l_quantity >= 45 THEN 'large' END, CASE WHEN l_discount >= 0.09 THEN 'discounted' END, CASE WHEN l_tax >= 0.08 THEN 'taxed' END], lambda x: x IS NOT NULL), ',') AS reasons FROM lineitem""")
def reason_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"large": F.col("l_quantity") >= 45, "discounted": F.col("l_discount") >= 0.09, "taxed": F.col("l_tax") >= 0.08}
    r = tiers.reasons(rules)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.size(r) > 0).alias("flagged"), F.array_join(r, ",").alias("reasons"))


@register("""SELECT s_suppkey, round(least(0.4 * (s_acctbal + 1000) / 11000 + 0.35 * (s_nationkey / 25.0) + 0.25 * (s_suppkey % 7) / 7.0, CASE WHEN s_acctbal < 0 THEN 0.15 ELSE 9 END), 6) AS score,
CASE WHEN least(0.4 * (s_acctbal + 1000) / 11000 + 0.35 * (s_nationkey / 25.0) + 0.25 * (s_suppkey % 7) / 7.0, CASE WHEN s_acctbal < 0 THEN 0.15 ELSE 9 END) >= 0.85 THEN 'tier1_auto_applied'
WHEN least(0.4 * (s_acctbal + 1000) / 11000 + 0.35 * (s_nationkey / 25.0) + 0.25 * (s_suppkey % 7) / 7.0, CASE WHEN s_acctbal < 0 THEN 0.15 ELSE 9 END) >= 0.5 THEN 'tier2_scored_logged' ELSE 'not_surfaced' END AS tier FROM supplier""")
def tier_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {"structure": ((F.col("s_acctbal") + 1000) / 11000, 0.4), "ccg": (F.col("s_nationkey") / 25.0, 0.35), "amplitude": ((F.col("s_suppkey") % 7) / 7.0, 0.25)}
    s = table(spark, sf_dir, "supplier").withColumn("score", tiers.weighted_score(parts, F.when(F.col("s_acctbal") < 0, 0.15)))
    return rounded(s.select("s_suppkey", "score", tiers.merge_tier(F.col("score")).alias("tier")))


@register("""SELECT count(*) AS n, round(median(o_totalprice), 6) AS median, round(avg(o_totalprice), 6) AS mean, round(quantile_cont(o_totalprice, 0.25), 6) AS p25, round(quantile_cont(o_totalprice, 0.75), 6) AS p75, min(o_totalprice) AS low, max(o_totalprice) AS high,
count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f, count(*) || ' orders, ' || count(*) FILTER (WHERE o_orderstatus = 'F') || ' finished' AS headline FROM orders""")
def session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = "o_totalprice"
    orders = table(spark, sf_dir, "orders")
    done = F.count_if(F.col("o_orderstatus") == "F")
    sums = orders.agg(F.count("*").alias("n"), F.avg(p).alias("mean"), F.min(p).alias("low"), F.max(p).alias("high"), done.alias("n_f"), F.format_string("%d orders, %d finished", F.count("*"), done).alias("headline"))
    quarters = st.quantiles(orders, [], p, [0.25, 0.5, 0.75])  # one row each
    q = [F.col("quantiles")[i].alias(name) for i, name in enumerate(("p25", "median", "p75"))]
    return rounded(sums.join(F.broadcast(quarters), F.lit(True), "left").select("*", *q).drop("quantiles"))


@register("SELECT conv_id, sha1(string_agg(role || ':' || text, '|' ORDER BY turn)) AS fingerprint, count(*) AS n FROM conversations GROUP BY conv_id")
def sha1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = F.sort_array(F.collect_list(F.struct("turn", F.concat_ws(":", "role", "text").alias("s"))))
    joined = F.array_join(F.transform(turns, lambda x: x["s"]), "|")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sha1(F.encode(joined, "UTF-8")).alias("fingerprint"), F.count("*").alias("n"))


@register("SELECT user_id, sum(event_id & 1) AS bit0, sum((event_id >> 1) & 1) AS bit1, sum((event_id >> 2) & 1) AS bit2, bit_or(event_id & 7) AS seen FROM events GROUP BY user_id".replace("sum(event_id & 1)", "CAST(sum(event_id & 1) AS BIGINT)").replace("sum((event_id >> 1) & 1)", "CAST(sum((event_id >> 1) & 1) AS BIGINT)").replace("sum((event_id >> 2) & 1)", "CAST(sum((event_id >> 2) & 1) AS BIGINT)"))
def bit_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    bit = lambda k: F.sum(F.shiftright("event_id", k).bitwiseAND(1)).alias(f"bit{k}")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(bit(0), bit(1), bit(2), F.bit_or(F.col("event_id").bitwiseAND(7)).alias("seen"))


@register("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) // 10 AS decade, count(*) AS n FROM events GROUP BY ALL")
def json_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type", F.expr("from_json(props, 'k long').k div 10").alias("decade")).agg(F.count("*").alias("n"))


@register("SELECT n_nationkey AS id, 'name' AS field, n_name AS value FROM nation UNION ALL SELECT n_nationkey, 'region', r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def unpivot_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("r_name").alias("region")).unpivot("id", ["name", "region"], "field", "value")


@register("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price, count(*) AS n FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-09-02' GROUP BY ALL")
def scan_pushdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") < F.lit("1998-09-02").cast("timestamp_ntz"))
    return rounded(rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.avg("l_extendedprice").alias("avg_price"), F.count("*").alias("n")), 4)
