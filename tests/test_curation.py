"""Small cases of the lineage, pair, statistics and label operators with known answers."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import tiers
from pulsegrid.operators import lineage, pairs
from pulsegrid.operators import statistics as st
from pulsegrid.sources import documents
from pulsegrid.sources.raw_blocks import RawBlocks
from pulsegrid.streaming import trains as streams


def ranges(spark, rows):
    return spark.createDataFrame(rows, "key int, t0 double, t1 double")


def test_touching_ranges_merge(spark):
    got = lineage.range_union(ranges(spark, [(1, 0.0, 5.0), (1, 5.0, 8.0), (1, 10.0, 12.0), (2, 0.0, 9.0), (2, 1.0, 2.0), (2, 8.0, 9.5)]), "key").collect()
    assert sorted(map(tuple, got)) == [(1, 0.0, 8.0), (1, 10.0, 12.0), (2, 0.0, 9.5)]


def test_an_unrestricted_parent_frees_the_merge(spark):
    merges = spark.createDataFrame([(10, 1), (10, 2), (11, 1)], "merged int, parent int")
    limits = spark.createDataFrame([(1, 3.0, 4.0)], "parent int, t0 double, t1 double")
    assert sorted(map(tuple, lineage.merged_windows(merges, limits, (0.0, 100.0)).collect())) == [(10, 0.0, 100.0), (11, 3.0, 4.0)]


def test_groups_and_vetoes(spark):
    edges = spark.createDataFrame([(38, 163), (163, 204), (260, 262), (261, 262)], "a int, b int")
    groups = lineage.merge_groups(edges)
    assert {r.node: r.root for r in groups.collect()} == {38: 38, 163: 38, 204: 38, 260: 260, 261: 260, 262: 260}
    verdicts = spark.createDataFrame([(260, 261, "unsure"), (38, 204, "separate"), (38, 260, "separate")], "a int, b int, verdict string")
    assert [tuple(r) for r in lineage.vetoed(groups, verdicts).collect()] == [(38, 38, 204)]


def test_a_range_over_the_seam_is_cut(spark):
    r = spark.createDataFrame([(1, 8, 15)], "range_id int, t0 int, t1 int")
    p = spark.createDataFrame([(0, 0, 10), (1, 10, 20)], "part int, start int, stop int")
    assert sorted(map(tuple, lineage.clip_ranges(r, p).collect())) == [(1, 0, 8, 10), (1, 1, 0, 5)]


def test_overlay_coverage_and_selection(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, label string")
    verdicts = spark.createDataFrame([(2, "good"), (3, "noise")], "id int, v string")
    assert {tuple(r) for r in lineage.overlay(rows, verdicts, "id", "label", "v").select("id", "label", "label_source").collect()} == {(1, "a", "automatic"), (2, "good", "verdict")}
    assert [r.id for r in lineage.unknown_verdicts(rows, verdicts, "id").collect()] == [3]
    got = spark.createDataFrame([(1,), (1,), (4,)], "id int")
    assert {tuple(r) for r in lineage.coverage(rows, got, "id").collect()} == {(1, "duplicated"), (2, "missing"), (4, "extra")}


def test_verdict_shapes(spark):
    texts = ['[{"id": "7", "verdict": "good", "ts": 1}]', '[{"id": "8", "data": {"verdict": "mua", "ts": 2}}]', '{"9": {"verdict": "noise", "ts": 3}, "7": {"verdict": "mua", "ts": 5}}']
    rows = documents.verdict_rows(spark.createDataFrame([(t,) for t in texts], "value string"))
    assert {tuple(r) for r in documents.latest(rows).collect()} == {("7", "mua"), ("8", "mua"), ("9", "noise")}
    with pytest.raises(Exception, match="unknown verdict"):
        documents.verdict_rows(spark.createDataFrame([('{"1": {"verdict": "great"}}',)], "value string")).collect()


def test_cosine_radius_and_polygon(spark):
    v = spark.createDataFrame([([1.0, 2.0], [3.7, 7.4])], "a array<double>, b array<double>")
    assert v.select(pairs.cosine(F.col("a"), F.col("b"))).first()[0] == pytest.approx(1.0)
    line = spark.createDataFrame([(i, 30.0 * i, 0.0) for i in range(9)], "c int, x double, y double")
    near = pairs.spatial_pairs(line, "c", "x", "y", 65.0).filter("a = 4 or b = 4").collect()
    assert {r.a if r.b == 4 else r.b for r in near} == {2, 3, 5, 6}
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    inside = line.select("c", pairs.inside_polygon(F.col("x") / 10, F.lit(5.0), square).alias("i")).collect()
    assert [r.c for r in inside if r.i] == [0, 1, 2, 3]
    one = spark.createDataFrame([([4.0, 2.0, 1.0, 1.0, 1.0],), ([1.0],), ([],)], "a array<double>")
    assert [tuple(r) for r in one.select(pairs.concentration(F.col("a")), pairs.flatness(F.col("a"))).collect()] == [(0.5, 0.25), (0.0, 0.0), (0.0, 0.0)]
    fit = v.select(pairs.fit_scale(F.col("b"), F.col("a")), pairs.residual_share(F.col("b"), F.col("a"))).first()
    assert fit[0] == pytest.approx(3.7) and fit[1] == pytest.approx(0, abs=1e-12)


def test_false_discovery_leaves_nulls_out(spark):
    p = [0.01, 0.02, 0.03, 0.5, None]
    rows = {r.i: r for r in st.false_discovery(spark.createDataFrame(list(enumerate(p)), "i int, p double"), "p", 0.05).collect()}
    assert [rows[i].p_adjusted for i in range(4)] == pytest.approx([0.04, 0.04, 0.04, 0.5]) and [rows[i].rejected for i in range(5)] == [True, True, True, False, None]


def test_ranks_tests_and_p(spark):
    df = spark.createDataFrame([(0, 1.0, True), (0, 2.0, True), (0, 2.0, False), (0, 3.0, False)], "g int, v double, pos boolean")
    assert st.rank_auc(df, ["g"], "v", "pos").first().auc == 0.125
    assert st.mann_whitney(df, ["g"], "v", "pos").first().u == 0.5
    d = spark.createDataFrame([(0, x) for x in (1.0, -2.0, 3.0, 0.0, None)], "g int, d double")
    w = st.wilcoxon(d, ["g"], "d").first()
    assert (w.n, w.w) == (3, 4.0)
    z = spark.createDataFrame([(1.96,), (None,)], "z double").select(st.two_sided_p("z").alias("p")).collect()
    assert z[0].p == pytest.approx(0.05, abs=1e-4) and z[1].p is None


def test_percentile_rule(spark):
    x = [0.686, 0.900, 1.481, 0.772, 1.049, 1.227, 1.203, 0.429, 0.737, 1.019]
    assert spark.createDataFrame([(v,) for v in x], "x double").select(F.percentile("x", F.lit(0.8))).first()[0] == pytest.approx(float(np.percentile(x, 80)))


def test_labels(spark):
    curves = [(10.0, 9.0, 8.0), (8.0, 9.0, 10.0), (10.0, 5.0, 10.0), (8.0, 12.0, 8.0), (10.0, 10.1, 10.0)]
    rows = spark.createDataFrame(curves, "a double, m double, z double").select(tiers.shape_label(F.col("a"), F.col("m"), F.col("m"), F.col("z"))).collect()
    assert [r[0] for r in rows] == ["decay", "facilitation", "dip_then_rise", "rise_then_dip", "flat"]
    odd = spark.createDataFrame([(math.nan,), (math.inf,), (1.0,)], "x double").select(tiers.finite(F.col("x"))).collect()
    assert [r[0] for r in odd] == [None, None, 1.0]


def test_recordings_join_at_the_seam(spark, tmp_path):
    a, b = np.arange(50 * 4, dtype="<i2").reshape(50, 4), (1000 + np.arange(60 * 4)).astype("<i2").reshape(60, 4)
    for n, x in (("a", a), ("b", b)):
        x.tofile(tmp_path / n)
    spark.dataSource.register(RawBlocks)
    load = lambda **o: spark.read.format("raw_blocks").options(n_chan=4, block=16, **o).load(f"{tmp_path}/a,{tmp_path}/b")
    rows = load(used="40,60", chans="1,3", gain=0.5).orderBy("chan", "t0").collect()
    joined = np.concatenate([a[:40], b]) * 0.5
    for c in (1, 3):
        assert np.concatenate([r.samples for r in rows if r.chan == c]).tolist() == joined[:, c].tolist()
    window = load(used="40,60", start=20, stop=60, chans="0").orderBy("t0").collect()
    assert np.concatenate([r.samples for r in window]).tolist() == np.concatenate([a[20:40, 0], b[:20, 0]]).tolist() and window[0].t0 == 20
    (tmp_path / "c").write_bytes(b"123")
    with pytest.raises(Exception, match="multiple"):
        spark.read.format("raw_blocks").options(n_chan=4).load(str(tmp_path / "c")).collect()


def test_streams(spark, tmp_path):
    rows = [(1, t, f"2024-01-01 00:{t // 60:02d}:{t % 60:02d}") for t in (0, 5, 12, 13, 400)]
    spark.createDataFrame(rows, "unit int, t long, s string").selectExpr("unit", "t", "cast(s as timestamp) as ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("unit int, t long, ts timestamp").parquet(str(tmp_path / "in"))

    def out(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    assert sorted(r.t for r in out(streams.thinned(source, "unit", "t", 10), "thin")) == [0, 12, 400]
    assert sorted(r.n_events for r in out(streams.rates(source, "unit", "ts", "1 minute", "0 seconds"), "rates", "complete")) == [1, 4]
    assert sorted(r.n_events for r in out(streams.sessions(source, "unit", "ts", "2 minutes", "0 seconds"), "sess", "complete")) == [1, 4]


def test_ranks_and_quantiles_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(st, "WHOLE", 50)
    monkeypatch.setattr(st, "PIECES", 8)
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"g": rng.choice(["a", "b", None], 3000, p=[0.7, 0.25, 0.05]), "x": np.round(rng.exponential(100, 3000), 1)})
    frame.loc[::97, "x"] = None
    rows = spark.createDataFrame([(g, None if np.isnan(x) else float(x)) for g, x in frame.values.tolist()], "g string, x double")
    ranked = st.average_rank(rows.filter("g is not null"), ["g"], "x", "r").toPandas()
    want = ranked.groupby("g").x.rank()
    assert np.allclose(ranked.r, want, equal_nan=True) and ranked.r.isna().sum() == ranked.x.isna().sum()
    shares = [0.0, 0.1, 1 / 3, 0.5, 0.9, 1.0]
    for by in (["g"], []):
        got = {r[0] if by else "all": r.quantiles for r in st.quantiles(rows, by, "x", shares).collect()}
        groups = {k if isinstance(k, str) else None: v for k, v in frame.groupby("g", dropna=False)} if by else {"all": frame}
        assert got.keys() == groups.keys()
        for k, v in groups.items():
            assert np.allclose(got[k], np.nanquantile(v.x, shares))
    spread = {r.g: (r.median, r.mad) for r in st.mad(rows, ["g"], "x").collect()}
    for k, v in frame.groupby("g"):
        middle = v.x.median()
        assert np.allclose(spread[k], (middle, 1.4826 * (v.x - middle).abs().median()))


def test_quantiles_of_nothing(spark):
    rows = spark.createDataFrame([(1, None), (2, None)], "k int, x double")
    assert st.quantiles(rows, [], "x", [0.5]).count() == 0
    assert [r["class"] for r in st.quantile_class(rows, "x", 3).collect()] == [None, None]
