"""Decoding from sums against numpy fits of every fold, and nulls against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import decoding, statistics


def data(n=90, sessions=("a", "b", None)):
    rng = np.random.default_rng(8)
    out = []
    for s in sessions:
        x = rng.normal(size=(n, 3)) * [1, 50, 0.1] + [0, 1000, 3]
        y = (0 if s == "b" else 1) * (x[:, 0] - 0.02 * x[:, 1]) + rng.normal(size=n)
        out += [(s, i, *map(float, x[i]), float(y[i])) for i in range(n)]
    return out


SCHEMA = "s string, i long, a double, b double, c double, y double"


def ridge(x, y, alpha):
    mu, sd = x.mean(0), x.std(0) + 1e-9
    z = (x - mu) / sd
    w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean()))
    return lambda v: (v - mu) / sd @ w + y.mean()


def out_of_fold(x, y, folds, alphas, nested):
    pred = np.zeros(len(y))
    for f in np.unique(folds):
        rest = folds != f
        best = alphas[0]
        if nested:
            cost = [sum(((y[folds == g] - ridge(x[rest & (folds != g)], y[rest & (folds != g)], a)(x[folds == g])) ** 2).sum() for g in np.unique(folds) if g != f) for a in alphas]
            best = alphas[int(np.argmin(cost))]
        pred[~rest] = ridge(x[rest], y[rest], best)(x[~rest])
    return pred, 1 - ((y - pred) ** 2).sum() / ((y - y.mean()) ** 2).sum()


def test_scores_of_each_penalty_are_those_of_fits(spark):
    rows = data()
    df = spark.createDataFrame(rows + [("a", 500, None, 1.0, 1.0, 1.0), ("a", 501, float("nan"), 1.0, 1.0, 1.0), ("one", 1, 1.0, 1.0, 1.0, 1.0)], SCHEMA)
    got = {(r.s, r.alpha): r for r in decoding.ridge_scores(df, ["s"], ["a", "b", "c"], "y", [0.0, 10.0, 1000.0], F.col("i") % 4).collect()}
    for s in ("a", "b", None):
        v = np.array([r[2:] for r in rows if r[0] == s])
        folds = np.arange(len(v)) % 4
        for alpha in (0.0, 10.0, 1000.0):
            assert got[s, alpha].n == 90 and math.isclose(got[s, alpha].r2, out_of_fold(v[:, :3], v[:, 3], folds, [alpha], False)[1], abs_tol=1e-7)
    assert got["one", 0.0].r2 is None
    plan = decoding.fold_sums(df, ["s"], [], ["a", "b", "c"], "y", F.col("i") % 4)._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("Exchange") == 1 and "Python" not in plan and "Pandas" not in plan


def test_nested_penalty_and_nulls(spark):
    rows, alphas = data(), [0.1, 30.0, 3000.0]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r.s: r for r in decoding.decode(df, ["s"], ["i"], ["a", "b", "c"], "y", alphas, F.col("i") % 4, 19, 19, seed=3).collect()}
    for s in ("a", "b", None):
        v = np.array([r[2:] for r in rows if r[0] == s])
        x, y, folds = v[:, :3], v[:, 3], np.arange(len(v)) % 4
        obs = out_of_fold(x, y, folds, alphas, True)[1]
        assert math.isclose(got[s].r2, obs, abs_tol=1e-7)
        targets = decoding._columns(y, f"{[str(s)]}0", 19, 19, 3)
        null = [out_of_fold(x, targets[:, k], folds, alphas, True)[1] for k in range(1, 39)]
        assert all(sorted(targets[:, k]) == sorted(y) for k in range(39)) and (targets[:, 20] == np.roll(y, int(np.flatnonzero(targets[:, 20] == y[0])[0]))).all()
        assert math.isclose(got[s].p_mixed, (1 + sum(v >= obs for v in null[:19])) / 20) and math.isclose(got[s].p_shifted, (1 + sum(v >= obs for v in null[19:])) / 20)
        assert math.isclose(got[s].mixed_median, np.median(null[:19]), abs_tol=1e-7)
    assert got["a"].p_mixed == 1 / 20 and got["b"].p_mixed > 1 / 20


def test_a_large_group_is_read_in_runs(spark):
    df = spark.createDataFrame(data(sessions=("a",)), SCHEMA)
    whole = decoding.fold_sums(df, ["s"], ["i"], ["a", "b", "c"], "y", F.col("i") % 3, 2, 2)
    runs = decoding.fold_sums(df, ["s"], ["i"], ["a", "b", "c"], "y", F.col("i") % 3, 2, 2, run=16)
    for a, b in zip(whole.orderBy("fold").collect(), runs.orderBy("fold").collect()):
        assert np.allclose(np.array(a.sums)[[*range(17), 21]], np.array(b.sums)[[*range(17), 21]])  # the true target's sums


def test_a_large_group_is_numbered_in_pieces(spark, monkeypatch):
    df = spark.createDataFrame(data(200), SCHEMA).repartition(5)
    sums = lambda: [(r.s, r.fold, r.sums) for r in decoding.fold_sums(df, ["s"], ["y", "i"], ["a", "b", "c"], "y", F.col("i") % 3, 2, 2, run=16).orderBy("s", "fold").collect()]
    whole = sums()
    monkeypatch.setattr(statistics, "WHOLE", 50)
    monkeypatch.setattr(statistics, "PIECES", 8)
    placed = statistics._in_pieces(df.select(statistics._group(["s"]), "y"), df.select(statistics._group(["s"]), "y"), "y")
    assert placed.groupBy("__g", "__piece").count().agg(F.max("count")).first()[0] < 150
    pieces = sums()
    assert len(whole) == 9 and all(a[:2] == b[:2] and np.allclose(a[2], b[2]) for a, b in zip(whole, pieces))
    plan = decoding.fold_sums(df, ["s"], ["y", "i"], ["a"], "y", F.col("i") % 3, 2, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "__piece" in plan.split("row_number")[1].split("\n")[0]


@pytest.mark.parametrize("n", [17, 90, 1000])
def test_places_of_a_group_are_moved_one_to_one(n):
    every = np.arange(n)
    source, to = (decoding._moved(every, n, "x", 5, 5, 2, back) for back in (False, True))
    assert all(sorted(x) == every.tolist() for x in [*source, *to]) and all((t[s] == every).all() for s, t in zip(source, to))
    assert all((every[s] == np.roll(every, t[0])).all() for s, t in zip(source[5:], to[5:])) and len({tuple(x) for x in source}) > 5


def test_permutations_have_no_favourite_places():
    count = np.zeros((20, 20))
    for seed in range(2000):
        count[np.arange(20), decoding._moved(np.arange(20), 20, "x", 1, 0, seed)[0]] += 1
    # chi square of 19 x 19 degrees of freedom
    assert 361 - 5 * math.sqrt(2 * 361) < ((count - 100) ** 2 / 100).sum() < 361 + 5 * math.sqrt(2 * 361)


def test_nulls_of_a_large_group_are_of_the_whole_group(spark, monkeypatch):
    n, d, run = 90, 3, 16
    # within a run targets are equal: mixed or shifted inside runs they would stay as they are
    rows = [(s, i, a, b, c, float(i // run)) for s, i, a, b, c, _ in data(n)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for runs in (decoding.RUNS, 4):
        monkeypatch.setattr(decoding, "RUNS", runs)
        got = {(r.s, r.fold): np.array(r.sums) for r in decoding.fold_sums(df, ["s"], ["i"], ["a", "b", "c"], "y", F.col("i") % 3, 4, 4, seed=1, run=run).collect()}
        for s in ("a", "b", None):
            v = np.array([r[2:] for r in rows if r[0] == s])
            x, y, folds = v[:, :3], v[:, 3], np.arange(n) % 3
            targets = np.column_stack([y, *[y[m] for m in decoding._moved(np.arange(n), n, str([str(s)]), 4, 4, 1)]])
            assert all(sorted(t) == sorted(y) and (t != y).any() for t in targets.T[1:]) and all(any((t == np.roll(y, k)).all() for k in range(1, n)) for t in targets.T[5:])
            for f in range(3):
                assert np.allclose(got[s, f], decoding._flat(x[folds == f], targets[folds == f]))


def test_few_rows_and_constant_targets_give_nulls(spark):
    df = spark.createDataFrame([("few", i, float(i), 1.0, 2.0, float(i)) for i in range(9)] + [("flat", i, float(i), 1.0, 2.0, 5.0) for i in range(40)], SCHEMA)
    got = decoding.decode(df, ["s"], ["i"], ["a", "b"], "y", [1.0], F.col("i") % 3, 3, 3).collect()
    assert sorted((r.s, r.n, r.r2, r.p_mixed) for r in got) == [("few", 9, None, None), ("flat", 40, None, None)]
    assert decoding.decode(df.limit(0), ["s"], ["i"], ["a"], "y", [1.0], F.col("i") % 3, 3, 3).count() == 0


def test_predictions_are_out_of_fold(spark):
    rows = data()
    got = {(r.s, r.i): r.p for r in decoding.predictions(spark.createDataFrame(rows, SCHEMA), ["s"], ["a", "b", "c"], "y", 5.0, F.col("i") % 4, "p").collect()}
    for s in ("a", None):
        v = np.array([r[2:] for r in rows if r[0] == s])
        want = out_of_fold(v[:, :3], v[:, 3], np.arange(len(v)) % 4, [5.0], False)[0]
        assert np.allclose([got[s, i] for i in range(len(v))], want, atol=1e-8)


@pytest.mark.parametrize("ones", [1, 13, 39])
def test_permutations_take_the_least_hashes(spark, ones):
    rng = np.random.default_rng(ones)
    rows = [(i, i < ones, float(v)) for i, v in enumerate(rng.normal(size=40).round(2))]
    df = spark.createDataFrame(rows, "k long, g boolean, v double").repartition(3)
    got = decoding.permutation_p(df, "k", "g", "v", 29, seed=4).first()
    v = np.array([r[2] for r in rows])
    gap = lambda held: v[held].mean() - v[~held].mean()
    obs = gap(np.arange(40) < ones)
    hashed = df.select("k", F.explode(F.sequence(F.lit(1), F.lit(29))).alias("i")).select("k", "i", F.pmod(F.xxhash64(F.lit(4), "i", "k"), F.lit(1 << 40)).alias("h")).collect()
    far = 0
    for i in range(1, 30):
        held = np.zeros(40, bool)
        held[[k for _, k in sorted((r.h, r.k) for r in hashed if r.i == i)[:ones]]] = True
        far += abs(gap(held)) >= abs(obs) - 1e-9
    assert math.isclose(got.difference, obs, abs_tol=1e-12) and math.isclose(got.p, (far + 1) / 30)
