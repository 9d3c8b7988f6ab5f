"""Queries on tracks over windows, matching across sessions, equal acceptance, matched draws and hazards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators import decoding, statistics, tracks, waveforms
from pulsegrid.operators.pairs import mutual_best
from pulsegrid.plans.base import register, rounded
from pulsegrid.plans.trains import DAY, HOUR, TRAIN, train
from pulsegrid.session import table

WINDOWS, LEAST, SESSIONS = 8, 0.1, 3


def means(spark: SparkSession, sf_dir: str, parts: int) -> DataFrame:
    """``(part, label, node, n, wave)``: the mean vectors of each label in ``parts`` parts of the table."""
    v = table(spark, sf_dir, "embeddings").withColumn("part", (F.col("vec_id") % parts).cast("int"))
    m = waveforms.mean_waveforms(v, ["part", "label"], "embedding")
    return m.withColumn("node", (F.col("part") * 1000 + F.col("label")).cast("long"))


def means_sql(parts: int) -> str:
    """``m(part, node, label, n, wave)``, waves less their mean."""
    return f"""x AS (SELECT CAST(vec_id % {parts} AS INTEGER) AS part, label, generate_subscripts(embedding, 1) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings), a AS (SELECT part, label, i, avg(x) AS x, count(*) AS n FROM x GROUP BY ALL),
m AS (SELECT part, part * 1000 + label AS node, label, max(n) AS n, list(x - avg_x ORDER BY i) AS wave FROM (SELECT *, avg(x) OVER (PARTITION BY part, label) AS avg_x FROM a) GROUP BY ALL)"""


def best_sql(name: str, left: str, right: str, step: int) -> str:
    """Mutual best pairs ``name(a, b, r)`` of the nodes of two tables, ``step`` parts apart, at LEAST or above."""
    return f"""{name}p AS (SELECT a.node AS a, b.node AS b, list_cosine_similarity(a.wave, b.wave) AS r FROM {left} a JOIN {right} b ON b.part = a.part + {step}),
{name} AS (SELECT a, b, r FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(r, 9) DESC, b) AS i, row_number() OVER (PARTITION BY b ORDER BY round(r, 9) DESC, a) AS j FROM {name}p) WHERE i = 1 AND j = 1 AND round(r, 9) >= {LEAST})"""


LINKS = f"""{means_sql(WINDOWS)}, {best_sql("one", "m", "m", 1)}, ends AS (SELECT * FROM m WHERE node NOT IN (SELECT a FROM one)), begins AS (SELECT * FROM m WHERE node NOT IN (SELECT b FROM one)), {best_sql("two", "ends", "begins", 2)},
links AS (SELECT a, b, 1 AS step, r FROM one UNION ALL SELECT a, b, 2, r FROM two)"""


@register(f"WITH {LINKS} SELECT a, b, step, round(r, 6) AS r FROM links")
def window_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of labels' mean vectors over the parts of the table, one part may be missing between."""
    return rounded(tracks.window_links(means(spark, sf_dir, WINDOWS), "part", "node", "wave", LEAST, gaps=1))


@register(f"""WITH RECURSIVE {LINKS}, t AS (SELECT node, node AS track FROM m WHERE node NOT IN (SELECT b FROM links) UNION ALL SELECT links.b, t.track FROM t JOIN links ON links.a = t.node)
SELECT track, count(*) AS n_windows, min(part) AS first, max(part) AS last, CAST(max(part) - min(part) + 1 - count(*) AS BIGINT) AS n_missing, CAST(sum(n) AS BIGINT) AS total, count(*) >= 0.7 * {WINDOWS} AS long_lived FROM t JOIN m USING (node) GROUP BY track""")
def track_lifetimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = means(spark, sf_dir, WINDOWS)
    links = tracks.window_links(nodes, "part", "node", "wave", LEAST, gaps=1)
    return tracks.lifetimes(tracks.tracks(nodes, links, "node"), "part", WINDOWS, "n")


THRESHOLDS = [-1.0, 0.0, 0.2, 0.4, 0.6, 0.8]
ORPHAN = "('0x' || md5({}::VARCHAR)[1:8])::BIGINT % 2 = 0"
BEST = "SELECT a, b, r, {} AS kind FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY r DESC, b) AS i, row_number() OVER (PARTITION BY b ORDER BY r DESC, a) AS j FROM {}) WHERE i = 1 AND j = 1"


def _halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = means(spark, sf_dir, 2)
    a, b = (m.filter(F.col("part") == i).select(F.col("label").alias(n), F.col("wave").alias(f"w{n}")) for i, n in ((0, "a"), (1, "b")))
    # labels are a handful and stand for the units near one another
    return a.withColumn("near", F.lit(0)).join(b.withColumn("near", F.lit(0)), "near").select("a", "b", F.round(tracks.correlation(F.col("wa"), F.col("wb")), 9).alias("score"))


@register(f"""WITH {means_sql(2)}, p AS (SELECT a.label AS a, b.label AS b, round(list_cosine_similarity(a.wave, b.wave), 9) AS r FROM m a JOIN m b ON a.part = 0 AND b.part = 1), q AS (SELECT * FROM p WHERE NOT ({ORPHAN.format("b")})),
f AS ({BEST.format("'all'", "p")} UNION ALL SELECT * FROM ({BEST.format("'orphan'", "q")}) WHERE {ORPHAN.format("a")}), u AS (SELECT DISTINCT label FROM m), c AS (SELECT unnest({THRESHOLDS}::DOUBLE[]) AS threshold),
n AS (SELECT threshold, count(*) FILTER (WHERE kind = 'all') AS n_matched, count(*) FILTER (WHERE kind = 'all' AND a = b) AS n_right, count(*) FILTER (WHERE kind = 'orphan') AS n_orphans_matched FROM c LEFT JOIN f ON r >= threshold GROUP BY threshold),
k AS (SELECT count(*) AS n_units, count(*) FILTER (WHERE {ORPHAN.format("label")}) AS n_orphans FROM u)
SELECT threshold, n_units, n_matched, n_right, round(n_right / n_units::DOUBLE, 6) AS recall, round(CASE WHEN n_matched > 0 THEN n_right / n_matched::DOUBLE END, 6) AS precision, n_orphans, n_orphans_matched,
round(CASE WHEN n_orphans > 0 THEN n_orphans_matched / n_orphans::DOUBLE END, 6) AS orphan_rate FROM n, k""")
def match_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often labels find themselves in the table's other half, and how often those without themselves there find another."""
    pairs = _halves(spark, sf_dir)
    return rounded(tracks.calibration(pairs, pairs.select(F.col("a").alias("unit")).distinct(), THRESHOLDS))


@register(f"""WITH {means_sql(SESSIONS)}, p AS (SELECT x.part AS s, y.part AS z, x.label AS a, y.label AS b, round(list_cosine_similarity(x.wave, y.wave), 9) AS r FROM m x JOIN m y ON x.part < y.part),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s, z, a ORDER BY r DESC, b) AS i, row_number() OVER (PARTITION BY s, z, b ORDER BY r DESC, a) AS j FROM p) WHERE i = 1 AND j = 1 AND r >= 0)
SELECT ab.a, ab.b AS via, bc.b AS chain, ac.b AS direct, bc.b = ac.b AS agrees FROM f ab JOIN f bc ON ab.s = 0 AND ab.z = 1 AND bc.s = 1 AND bc.z = 2 AND bc.a = ab.b LEFT JOIN (SELECT * FROM f WHERE s = 0 AND z = 2) ac ON ac.a = ab.a""")
def session_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two steps of matching lead where the direct match does."""
    m = means(spark, sf_dir, SESSIONS)

    def matched(s: int, z: int) -> DataFrame:
        a, b = (m.filter(F.col("part") == i).select(F.lit(0).alias("near"), F.col("label").alias(n), F.col("wave").alias(f"w{n}")) for i, n in ((s, "a"), (z, "b")))
        pairs = a.join(b, "near").select("a", "b", F.round(tracks.correlation(F.col("wa"), F.col("wb")), 9).alias("r"))
        return mutual_best(pairs, "a", "b", "r", 0.0)

    return tracks.chain_check(matched(0, 1), matched(1, 2).toDF("b", "c", "r"), matched(0, 2).toDF("a", "c", "r"))


@register("""WITH x AS (SELECT l_shipmode_ AS g, q AS quantity, p AS price, gate, ok, id FROM (SELECT l_linestatus AS l_shipmode_, l_quantity AS q, l_extendedprice AS p, l_tax < 0.02 AS gate, l_discount > 0.05 AS ok, l_orderkey * 10 + l_linenumber AS id FROM lineitem)),
k AS (SELECT g, count(*) FILTER (WHERE gate) AS k, count(*) FILTER (WHERE gate AND ok) AS t FROM x GROUP BY g),
s AS (SELECT g, 'quantity' AS scorer, quantity AS s, ok, id FROM x UNION ALL SELECT g, 'price', price, ok, id FROM x), r AS (SELECT *, row_number() OVER (PARTITION BY g, scorer ORDER BY s DESC NULLS LAST, id) AS r FROM s),
o AS (SELECT g, scorer, count(*) AS n, count(*) FILTER (WHERE ok) AS t FROM r JOIN k USING (g) WHERE r <= k.k GROUP BY ALL UNION ALL SELECT g, 'gate', k, t FROM k)
SELECT g AS l_linestatus, scorer, n AS n_accepted, t AS n_true, round(t / n::DOUBLE, 6) AS precision FROM o""")
def equal_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision of scorers at as many rows as a gate accepts."""
    x = table(spark, sf_dir, "lineitem").select("l_linestatus", F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), (F.col("l_tax") < 0.02).alias("gate"), (F.col("l_discount") > 0.05).alias("ok"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    return rounded(tracks.accepted_equally(x, ["l_linestatus"], ["quantity", "price"], "gate", "ok", "id"))


@register("""WITH s AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL), k AS (SELECT o_orderpriority, min(n) AS k FROM s GROUP BY 1 HAVING count(*) > 1),
h AS (SELECT o_orderpriority, o_orderstatus, o_orderkey, draw, k, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus, draw ORDER BY md5('3|' || draw || '|' || o_orderkey), o_orderkey) AS r FROM orders JOIN k USING (o_orderpriority), (SELECT unnest(range(1, 4)) AS draw))
SELECT o_orderpriority, CAST(draw AS INTEGER) AS draw, o_orderstatus, o_orderkey FROM h WHERE r <= k""")
def matched_subsamples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In each draw as many orders of every status as the rarest has."""
    return tracks.matched_draws(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderstatus", "o_orderkey", 3, seed=3)


def _periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = train(spark, sf_dir)
    purchase = F.min(F.when((F.col("kind") == "purchase") & (F.col("amp") > 20), F.col("t")))
    trials = e.groupBy("unit").agg(F.min("t").alias("t0"), purchase.alias("event"), F.max("t").alias("end"))
    return tracks.person_periods(trials, ["unit"], "t0", "event", "end", 6 * HOUR, DAY)


PERIODS = f"""{TRAIN}, tri AS (SELECT unit, min(t) AS t0, min(t) FILTER (WHERE kind = 'purchase' AND amp > 20) AS ev, max(t) AS fin FROM tr GROUP BY unit),
per AS (SELECT unit, t0, ev, fin, unnest(range(0, CAST(floor((least(coalesce(ev, fin), fin) - t0) / 21600000000.0) AS BIGINT))) AS bin FROM tri)"""


@register(f"WITH {PERIODS} SELECT unit, CAST(bin AS INTEGER) AS bin, CAST(t0 + (bin + 1) * 21600000000 AS BIGINT) AS at, coalesce(ev - (t0 + (bin + 1) * 21600000000) <= 86400000000 AND ev <= fin, false) AS imminent FROM per")
def imminent_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each quarter of a day until a unit's first large purchase, and whether it comes within a day."""
    return _periods(spark, sf_dir)


@register()
def hazard_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well events of the last bin and the time waited tell that the purchase is near; units are whole in folds."""
    periods = _periods(spark, sf_dir).withColumn("at_bin", F.expr(f"at div {6 * HOUR}"))
    counts = train(spark, sf_dir).groupBy("unit", F.expr(f"t div {6 * HOUR}").alias("at_bin")).agg(F.count("*").alias("n"), F.sum("amp").alias("amp"))
    rows = periods.join(counts, ["unit", "at_bin"], "left").fillna(0, ["n", "amp"]).withColumn("y", F.col("imminent").cast("double")).withColumn("all", F.lit(1))
    fold = F.pmod(F.xxhash64("unit"), F.lit(5))
    predicted = decoding.predictions(rows, ["all"], ["bin", "n", "amp"], "y", 100.0, fold)
    return rounded(statistics.rank_auc(predicted, ["all"], "predicted", "imminent").drop("all"), 4)


SMALL = """n AS (SELECT g, count(*) AS n FROM x GROUP BY g HAVING count(*) <= 8), r AS (SELECT g, v, pos, 2 * rank() OVER (PARTITION BY g ORDER BY v) + count(*) OVER (PARTITION BY g, v) - 1 AS r, row_number() OVER (PARTITION BY g ORDER BY v) - 1 AS i, n FROM x JOIN n USING (g)),
o AS (SELECT g, any_value(n) AS n, count(*) FILTER (WHERE pos) AS n1, coalesce(sum(r) FILTER (WHERE pos), 0) AS s FROM r GROUP BY g),
e AS (SELECT r.g, mask, sum(CASE WHEN (mask >> i) & 1 = 1 THEN r ELSE 0 END) AS s FROM r JOIN (SELECT unnest(range(256)) AS mask) m ON mask < (1 << n) GROUP BY ALL)"""


@register(f"""WITH x AS (SELECT o_custkey AS g, o_totalprice AS v, o_orderstatus = 'F' AS pos FROM orders), {SMALL}, k AS (SELECT o.*, n - n1 AS n0, n1 * (n + 1) AS mid FROM o WHERE n1 > 0 AND n1 < n)
SELECT k.g AS o_custkey, CAST(any_value(n1) AS INTEGER) AS n1, CAST(any_value(n0) AS INTEGER) AS n0, round(any_value(k.s) / 2.0 - any_value(n1 * (n1 + 1)) / 2.0, 6)::DOUBLE AS u,
round(count(*) FILTER (WHERE abs(e.s - mid) >= abs(k.s - mid)) / count(*)::DOUBLE, 6) AS p FROM k JOIN e ON e.g = k.g AND bit_count(e.mask) = n1 GROUP BY k.g""")
def mann_whitney_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact rank tests of customers with few orders."""
    x = table(spark, sf_dir, "orders").withColumn("pos", F.col("o_orderstatus") == "F")
    return rounded(statistics.exact_mann_whitney(x, ["o_custkey"], "o_totalprice", "pos", most=8))


@register(f"""WITH x AS (SELECT o_custkey AS g, abs(o_totalprice::BIGINT - 150000) AS v, o_totalprice::BIGINT > 150000 AS pos FROM orders WHERE o_totalprice::BIGINT <> 150000), {SMALL}
SELECT o.g AS o_custkey, CAST(any_value(n) AS BIGINT) AS n, round(any_value(o.s) / 2.0, 6)::DOUBLE AS w, round(count(*) FILTER (WHERE abs(2 * e.s - n * (n + 1)) >= abs(2 * o.s - n * (n + 1))) / count(*)::DOUBLE, 6) AS p FROM o JOIN e ON e.g = o.g GROUP BY o.g""")
def wilcoxon_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact signed-rank tests of customers with few orders."""
    # a half goes to the even number, as in SQL's cast
    x = table(spark, sf_dir, "orders").withColumn("d", F.rint("o_totalprice").cast("long") - 150_000)
    return rounded(statistics.exact_wilcoxon(x, ["o_custkey"], "d", most=8))
