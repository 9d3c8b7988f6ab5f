"""Records operators on small cases: ties, nulls, empty tables, circles."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import records
from pulsegrid.operators import statistics as st


def test_lineage_of_merges_and_circles(spark):
    merges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8), (None, 5)], "unit long, merged long")
    got = {r.unit: (r.final, r.depth) for r in records.final_units(merges).collect()}
    assert got == {1: (4, 3), 2: (4, 2), 3: (4, 1), 9: (8, 1)}
    chain = spark.range(100).select(F.col("id").alias("unit"), (F.col("id") + 1).alias("merged"))
    assert {(r.final, r.depth + r.unit) for r in records.final_units(chain).collect()} == {(100, 100)}
    assert records.final_units(merges.filter("false")).count() == 0
    with pytest.raises(RuntimeError):
        records.final_units(spark.createDataFrame([(1, 2), (2, 1)], "unit long, merged long"), rounds=3)


def test_upper_median_with_repeats_and_nulls(spark):
    rows = spark.createDataFrame([("a", v) for v in (1.0, 1.0, 2.0, 5.0)] + [("b", 3.0), ("b", None), ("c", None)], "g string, r double")
    got = {r.g: tuple(r)[1:] for r in records.ratio_range(rows, ["g"], F.col("r")).collect()}
    assert got == {"a": (2.0, 1.0, 5.0, 4), "b": (3.0, 3.0, 3.0, 1)}


def test_ladder_cancels_the_offset(spark):
    rows = spark.createDataFrame([("a", i, float(s), 7.0 + 0.5 * s) for i, s in enumerate((-4, -1, 1, 4))] + [("b", 0, 1.0, 2.0), ("a", 9, None, 1.0)], "g string, i int, s double, e double")
    got = {r.g: r for r in records.shift_ladder(rows, ["g"], "i", "s", "e").collect()}
    assert got["b"].n == 1 and got["b"].rms is None and got["b"].slope is None
    errors = np.array([0.5 * (s + 1) - (s + 1) for s in (-4, -1, 1, 4)])
    assert got["a"].n == 4 and math.isclose(got["a"].slope, 0.5) and math.isclose(got["a"].rms, math.sqrt((errors**2).mean())) and math.isclose(got["a"].max_abs, 2.5)


def test_attribution_prefers_similar_then_near_then_lesser(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.9), (1, 4, 0.5)], "a long, b long, similarity double")
    samples = spark.createDataFrame([(1, 10, 100), (1, 11, 1000), (1, 12, 5000), (7, 13, 100)], "u long, e long, t long")
    events = spark.createDataFrame([(2, 108), (3, 95), (4, 100), (2, 995), (3, 1005), (4, 5001), (1, 100)], "u long, t long")
    got = {r.e: (r.owner, r.dt, r.similarity) for r in records.attribution(samples, events, pairs, "u", "e", "t", 10).collect()}
    assert got == {10: (3, -5, 0.9), 11: (2, -5, 0.9), 12: (4, 1, 0.5)}


def test_records_of_pairs_without_events(spark):
    pairs = spark.createDataFrame([(1, 2, 1.0), (1, 3, 1.0)], "a long, b long, distance double")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0])], "u long, vector array<double>")
    events = spark.createDataFrame([(1, i, 100 * i) for i in range(5)] + [(2, 9, 50)], "u long, i long, t long")
    got = {r.b: r for r in records.merge_records(pairs, vectors, events, "u", "t", "i", 60, 600, 60).collect()}
    assert (got[2].n_events, got[2].n_near, got[2].n_wide, got[2]["rank"]) == (6, 2, 5, 1)
    assert math.isclose(got[2].refractory_share, 2 / 5) and got[2].tier == "tier2_scored_logged"
    # a zero vector has no similarity, a pair without differences no dip
    assert (got[3].n_events, got[3].n_wide, got[3].dip, got[3].tier, got[3]["rank"]) == (5, 0, 1.0, "not_surfaced", 2)


def test_quiet_positions_and_consensus(spark):
    places = spark.createDataFrame([("a", 0), ("a", 10), ("a", 20), ("b", 10)], "k string, at long")
    events = spark.createDataFrame([("a", 12), ("a", None), ("c", 10)], "k string, t long")
    assert sorted(map(tuple, records.quiet_positions(places, events, "k", "at", "t", 2).collect())) == [("a", 0), ("a", 20), ("b", 10)]
    pairs = spark.createDataFrame([("x", 1, 5), ("x", 2, 5), ("x", 3, 7), ("x", 4, 7), ("y", 5, 1)], "g string, i long, d long")
    assert sorted((r.i, r.n_pairs, r.n_agree) for r in records.consensus(pairs, ["g"], "d").collect()) == [(1, 4, 2), (2, 4, 2), (5, 1, 1)]


def test_sound_dataset_has_no_findings(spark):
    units = spark.createDataFrame([(1, "good"), (2, "mua"), (5, "good")], "u long, label string")
    verdicts = spark.createDataFrame([(1, "good"), (3, "noise"), (4, "good")], "u long, verdict string")
    merges = spark.createDataFrame([(5, 4), (5, 6)], "merged long, parent long")
    windows = spark.createDataFrame([(1, 0, 10), (1, 20, 30)], "u long, t0 long, t1 long")
    events = spark.createDataFrame([(1, 10), (1, 20), (2, 99)], "u long, t long")
    automatic = spark.createDataFrame([(1, "mua"), (2, "mua"), (5, "good"), (3, "mua")], "u long, label string")
    assert records.verification(units, automatic, verdicts, merges, windows, events, "u", "t").count() == 0
    bad = events.union(spark.createDataFrame([(1, 15), (1, 15), (8, 1)], "u long, t long"))
    got = sorted(map(tuple, records.verification(units, automatic.filter("u <> 2").union(spark.createDataFrame([(2, "good")], "u long, label string")), verdicts, merges, windows, bad, "u", "t").collect()))
    assert got == [("orphan", 8, 1), ("untouched", 2, 1), ("window", 1, 2)]


def test_regression_with_several_regressors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 3))
    y = 2 + x @ [1.0, -3.0, 0.0] + rng.normal(size=40)
    rows = [("a", *map(float, r), float(v)) for r, v in zip(x, y)] + [("b", 1.0, 2.0, 3.0, 4.0), ("a", None, 1.0, 1.0, 1.0)] + [("c", float(i), 2.0 * i, float(i * i), float(i)) for i in range(9)]
    got = {(r.g, r.term): r for r in st.ols(spark.createDataFrame(rows, "g string, p double, q double, r double, y double"), ["g"], ["p", "q", "r"], "y").collect()}
    design = np.column_stack([np.ones(40), x])
    beta, rest = np.linalg.lstsq(design, y, rcond=None)[:2]
    error = np.sqrt(rest[0] / 36 * np.diag(np.linalg.inv(design.T @ design)))
    for i, term in enumerate("pqr", 1):
        assert math.isclose(got["a", term].coef, beta[i], abs_tol=1e-9) and math.isclose(got["a", term].t, (beta / error)[i], abs_tol=1e-7)
        # too few rows, and dependent regressors
        assert got["b", term].coef is None and got["c", term].coef is None
    assert got["a", "p"].n == 40


def test_tail_against_the_error_function(spark):
    z = [0.0, 0.3, -1.96, 4.0, 9.0, 30.0]
    got = [r.p for r in spark.createDataFrame([(v,) for v in z], "z double").select(st.two_sided_p("z").alias("p")).collect()]
    assert all(math.isclose(g, math.erfc(abs(v) / math.sqrt(2)), rel_tol=2e-7) for g, v in zip(got, z))
