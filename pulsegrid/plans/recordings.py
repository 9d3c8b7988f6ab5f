"""Queries on recordings kept as blocks, on waveform bases and on decoding: the vectors of ``embeddings`` are traces, dealt to blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators import decoding, halos, sequence, waveforms
from pulsegrid.plans.base import register, rounded
from pulsegrid.plans.trains import HOUR, TRAIN, train
from pulsegrid.session import table

#: Samples of a block, and the template that is slid along the traces.
BLOCK, TEMPLATE = 16, [-0.25, 1.0, -0.5, -0.25]
UNIT = [float(v) for v in np.array(TEMPLATE) / (np.linalg.norm(TEMPLATE) + 1e-9)]
NEAR, DISTANCE, SHARE = 2, 6, 0.5


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as blocks ``(vec_id, t0, x)`` of BLOCK samples."""
    v = table(spark, sf_dir, "embeddings").withColumn("t0", F.explode(F.sequence(F.lit(0), F.size("embedding") - 1, F.lit(BLOCK))))
    return v.select("vec_id", F.col("t0").cast("long").alias("t0"), F.slice("embedding", F.col("t0") + 1, BLOCK).cast("array<double>").alias("x"))


def troughs(spark: SparkSession, sf_dir: str) -> DataFrame:
    trace = waveforms.samples(table(spark, sf_dir, "embeddings"), ["vec_id"], "embedding")
    return waveforms.troughs(trace, "vec_id", "pos", "x", -0.15).select("vec_id", "pos")


SAMPLES = "x AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS pos, len(embedding) AS n FROM embeddings)"
TROUGHS = """below AS (SELECT *, pos - row_number() OVER (PARTITION BY vec_id ORDER BY pos) AS run FROM x WHERE x < -0.15),
tr AS (SELECT vec_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, run ORDER BY x, pos) AS k FROM below) WHERE k = 1)"""
SCORES = f"tmpl AS (SELECT unnest({UNIT}::DOUBLE[]) AS w, unnest(range({len(UNIT)})) AS k), s AS (SELECT x.vec_id, x.pos - k AS pos, sum(x * w) AS score FROM x JOIN tmpl ON x.pos - k BETWEEN 0 AND n - {len(UNIT)} GROUP BY ALL)"
PEAKS = "p AS (SELECT vec_id, pos, score FROM (SELECT *, lag(score) OVER w AS a, lead(score) OVER w AS z FROM s WINDOW w AS (PARTITION BY vec_id ORDER BY pos)) WHERE a < score AND score >= z)"
#: Highest first: peaks in the order of their score, each kept where no kept one is near; the recursion carries the kept places.
SEPARATED = f"""o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, pos) AS rn FROM p),
r AS (SELECT vec_id, rn, [pos] AS kept, pos, true AS taken FROM o WHERE rn = 1 UNION ALL
SELECT o.vec_id, o.rn, CASE WHEN len([q FOR q IN r.kept IF abs(q - o.pos) < {DISTANCE}]) = 0 THEN list_append(r.kept, o.pos) ELSE r.kept END, o.pos, len([q FOR q IN r.kept IF abs(q - o.pos) < {DISTANCE}]) = 0 FROM r JOIN o ON o.vec_id = r.vec_id AND o.rn = r.rn + 1),
far AS (SELECT vec_id, pos, score FROM r JOIN p USING (vec_id, pos) WHERE taken)"""


@register(f"WITH {SAMPLES}, {SCORES}, {PEAKS} SELECT vec_id, pos, round(score, 6) AS score FROM p")
def filter_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local peaks of a template slid along the traces, over their blocks' seams."""
    scores = halos.filter_scores(blocks(spark, sf_dir), ["vec_id"], "t0", "x", BLOCK, np.array(TEMPLATE))
    return rounded(halos.local_peaks(scores, ["vec_id"], BLOCK))


@register(f"WITH RECURSIVE {SAMPLES}, {SCORES}, {PEAKS}, {SEPARATED} SELECT vec_id, pos, round(score, 6) AS score FROM far")
def separated_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks at a least distance, the highest first."""
    scores = halos.filter_scores(blocks(spark, sf_dir), ["vec_id"], "t0", "x", BLOCK, np.array(TEMPLATE))
    return rounded(halos.separated(halos.local_peaks(scores, ["vec_id"], BLOCK), ["vec_id"], DISTANCE))


@register(f"""WITH RECURSIVE {SAMPLES}, {TROUGHS}, {SCORES}, {PEAKS}, {SEPARATED},
c AS (SELECT tr.vec_id, tr.pos AS t, s.pos AS place, s.score, row_number() OVER (PARTITION BY tr.vec_id, tr.pos ORDER BY s.score DESC, s.pos) AS k FROM tr JOIN s ON s.vec_id = tr.vec_id AND s.pos BETWEEN tr.pos - 1 - {NEAR} AND tr.pos - 1 + {NEAR}),
a AS (SELECT vec_id, t, place, score FROM c WHERE k = 1), f AS (SELECT vec_id, CASE WHEN count(*) >= 3 THEN {SHARE} * avg(score) END AS least FROM a GROUP BY vec_id),
free AS (SELECT far.* FROM far LEFT JOIN f USING (vec_id) WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.vec_id = far.vec_id AND abs(a.place - far.pos) <= {NEAR}) AND (least IS NULL OR score >= least))
SELECT vec_id, 'accepted' AS kind, CAST(t - 1 AS BIGINT) AS t, CAST(place AS BIGINT) AS pos, round(score, 6) AS score FROM a UNION ALL SELECT vec_id, 'candidate', NULL, CAST(pos AS BIGINT), round(score, 6) FROM free""")
def matched_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the template finds at known events and what it proposes beside them."""
    scores = halos.filter_scores(blocks(spark, sf_dir), ["vec_id"], "t0", "x", BLOCK, np.array(TEMPLATE))
    events = troughs(spark, sf_dir).select("vec_id", (F.col("pos") - 1).alias("t"))
    accepted, free = halos.matched_candidates(scores, events, ["vec_id"], "t", BLOCK, NEAR, DISTANCE, SHARE, least=3)
    a = accepted.select("vec_id", F.lit("accepted").alias("kind"), "t", F.col("at").cast("long").alias("pos"), "score")
    return rounded(a.unionByName(free.select("vec_id", F.lit("candidate").alias("kind"), F.lit(None).cast("long").alias("t"), "pos", "score")))


@register(f"""WITH {SAMPLES}, {TROUGHS}, w AS (SELECT tr.vec_id, tr.pos, list(x.x ORDER BY x.pos) AS w FROM tr JOIN x ON x.vec_id = tr.vec_id AND x.pos >= tr.pos - 5 AND x.pos < tr.pos + 9 GROUP BY ALL HAVING count(*) = 14),
b AS (SELECT vec_id, pos, [y - list_avg(w[1:3]) FOR y IN w] AS w FROM w), l AS (SELECT *, list_min(w) AS trough, list_position(w, list_min(w)) AS i FROM b), k AS (SELECT *, list_max(w[i:]) AS peak FROM l)
SELECT vec_id, CAST(pos AS BIGINT) AS pos, round(trough, 6) AS trough, round(peak - trough, 6) AS p2t, round(list_sum([y * y FOR y IN w]), 6) AS energy, CAST(list_position(w[i:], peak) - 1 AS BIGINT) AS width FROM k""")
def cut_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of windows around troughs, cut whole over blocks' seams and taken from their own baseline."""
    cuts = halos.cut_windows(blocks(spark, sf_dir), troughs(spark, sf_dir), ["vec_id"], "t0", "x", "pos", BLOCK, 5, 9, base=3)
    return rounded(halos.window_features(cuts.filter("window is not null")).drop("window"))


@register(f"""WITH {TRAIN}, g AS (SELECT *, coalesce(CASE WHEN t - lag(t) OVER o > {HOUR} THEN 1 ELSE 0 END, 0) AS new FROM tr WINDOW o AS (PARTITION BY unit ORDER BY t, event_id)),
s AS (SELECT unit, min(t) AS t0, max(t) AS t1 FROM (SELECT *, sum(new) OVER (PARTITION BY unit ORDER BY t, event_id) AS session FROM g) GROUP BY unit, session HAVING count(*) >= 3),
l AS (SELECT unit, max(t) + 1 AS total FROM tr GROUP BY unit)
SELECT unit, CAST(greatest(t0 - 1000000, 0) AS BIGINT) AS t0, CAST(least(t1 + 1000000, total) AS BIGINT) AS t1, 'burst' AS kind FROM s JOIN l USING (unit) UNION ALL
SELECT unit, t0, CAST(least(t0 + 60000000, total) AS BIGINT), 'drawn' FROM (SELECT unit, total, CAST(('0x' || md5('7|' || unit || '|' || i)[1:12])::BIGINT % greatest(total - 60000000, 1) AS BIGINT) AS t0 FROM l, (SELECT unnest(range(1, 5)) AS i))""")
def scan_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a detector looks: around dense stretches and at places drawn by hash."""
    events = train(spark, sf_dir)
    dense = sequence.sessions(events, "unit", "t", HOUR).filter("n_events >= 3").select("unit", "t0", "t1")
    lengths = events.groupBy("unit").agg((F.max("t") + 1).alias("total"))
    return halos.scan_windows(dense, "unit", 1_000_000, lengths, 4, 60_000_000, seed=7)


@register()
def waveform_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector along the two directions of most variance of all."""
    v = table(spark, sf_dir, "embeddings")
    mean, components = halos.basis(v, "embedding")
    return rounded(halos.project(v.select("vec_id", "embedding"), "embedding", mean, components).drop("embedding"), 5)


ALPHAS = [0.0, 100.0, 10000.0]


@register(f"""WITH x AS (SELECT l_returnflag, l_orderkey % 3 AS fold, l_quantity AS x, l_extendedprice AS y FROM lineitem),
f AS (SELECT l_returnflag, fold, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy FROM x GROUP BY ALL),
t AS (SELECT l_returnflag, sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy, sum(syy) AS syy FROM f GROUP BY 1),
r AS (SELECT f.*, t.n - f.n AS m, (t.sx - f.sx) / (t.n - f.n) AS mx, (t.sy - f.sy) / (t.n - f.n) AS my, t.sxx - f.sxx AS rxx, t.sxy - f.sxy AS rxy FROM f JOIN t USING (l_returnflag)),
d AS (SELECT *, sqrt(rxx / m - mx * mx) + 1e-9 AS sd FROM r), w AS (SELECT d.*, alpha, (rxy - m * mx * my) / sd / ((rxx - m * mx * mx) / sd / sd + alpha) / sd AS w FROM d, (SELECT unnest({ALPHAS}::DOUBLE[]) AS alpha)),
e AS (SELECT l_returnflag, alpha, sum(syy - 2 * ((my - w * mx) * sy + w * sxy) + n * (my - w * mx) * (my - w * mx) + 2 * (my - w * mx) * w * sx + w * w * sxx) AS sse FROM w GROUP BY ALL)
SELECT l_returnflag, alpha, CAST(n AS BIGINT) AS n, round(1 - sse / (syy - sy * sy / n), 6) AS r2 FROM e JOIN t USING (l_returnflag)""")
def ridge_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge regression out of fold for each group and penalty, from one scan's sums."""
    rows = table(spark, sf_dir, "lineitem")
    return rounded(decoding.ridge_scores(rows, ["l_returnflag"], ["l_quantity"], "l_extendedprice", ALPHAS, F.pmod("l_orderkey", F.lit(3))))


@register()
def decoding_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoding with nested penalties against permuted and circularly shifted targets."""
    rows = table(spark, sf_dir, "lineitem")
    order = ["l_shipdate", "l_orderkey", "l_linenumber"]
    return rounded(decoding.decode(rows, ["l_returnflag"], order, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", [1.0, 100.0, 10000.0], F.pmod("l_orderkey", F.lit(5)), 49, 49), 5)
