"""Models against plain numpy, and best correlated histograms in several blocks."""

import math

import numpy as np
from pyspark.sql import functions as F

from pulsegrid.operators import decoding, models, waveforms


def test_ridge_without_penalty_is_least_squares_out_of_fold(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 2))
    y = 1 + x @ [2.0, -1.0] + rng.normal(size=60)
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "k long, a double, b double, y double")
    folds = np.array([r.f for r in df.orderBy("k").select(models.fold("k", 3).alias("f")).collect()])
    design, rest = np.column_stack([np.ones(60), x]), 0.0
    for f in range(3):
        beta = np.linalg.lstsq(design[folds != f], y[folds != f], rcond=None)[0]
        rest += ((y[folds == f] - design[folds == f] @ beta) ** 2).sum()
    want = 1 - rest / ((y - y.mean()) ** 2).sum()
    got = {r.alpha: r.r2 for r in models.ridge_cv(df, "k", ["a", "b"], "y", [0.0, 100.0], k=3).collect()}
    assert math.isclose(got[0.0], want, abs_tol=1e-6) and got[100.0] < got[0.0]


def test_permutations_tell_a_difference_from_none(spark):
    rows = [(i, i % 2 == 0, float(i % 7 + (50 if i % 2 == 0 else 0))) for i in range(40)]
    df = spark.createDataFrame(rows, "k long, g boolean, v double")
    got = decoding.permutation_p(df, "k", "g", "v", 49).first()
    means = [np.mean([v for _, g, v in rows if g == side]) for side in (True, False)]
    assert math.isclose(got.difference, means[0] - means[1]) and math.isclose(got.p, 1 / 50)
    same = decoding.permutation_p(df.withColumn("v", F.col("k") % 2 * 0.0 + F.floor(F.col("k") / 2) % 5), "k", "g", "v", 49).first()
    assert abs(same.difference) < 1e-12 and same.p == 1.0


def test_mixture_finds_two_clouds(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 1, (150, 2)), rng.normal(12, 1, (150, 2))])
    got = {r.k: r for r in models.mixture_by_bic(spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double"), ["a", "b"], 3).collect()}
    sign, logdet = np.linalg.slogdet(np.cov(x.T, bias=True))
    assert math.isclose(got[1].bic, 300 * (2 * math.log(2 * math.pi) + logdet + 2) + 5 * math.log(300), rel_tol=1e-9)
    assert [k for k in got if got[k].best] == [2]


def test_separation_is_the_pooled_mahalanobis_distance(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(0, 1, (30, 3)), rng.normal(1, 2, (50, 3))
    df = spark.createDataFrame([("a", *map(float, r)) for r in a] + [("b", *map(float, r)) for r in b], "g string, x double, y double, z double")
    got = models.separation(df, "g", ["x", "y", "z"]).first()
    pooled = (29 * np.cov(a.T) + 49 * np.cov(b.T)) / 78
    gap = b.mean(0) - a.mean(0)
    assert (got.n0, got.n1) == (30, 50) and math.isclose(got.distance2, gap @ np.linalg.solve(pooled, gap), rel_tol=1e-6)


def test_best_correlated_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(waveforms, "BLOCK", 8)
    rng = np.random.default_rng(4)
    h = rng.poisson(0.7, (30, 12)) * (rng.random((30, 1)) < 0.9)
    h[3] = h[7]  # a tie
    h[11] = 2  # flat: no correlation
    rows = [(int(u), int(i), int(n)) for u in range(30) for i, n in enumerate(h[u]) if n]
    got = {r.u: (r.other, r.r) for r in waveforms.best_correlated(spark.createDataFrame(rows, "u long, bin int, n long"), "u", 12).collect()}
    want = {}
    for u in range(30):
        for o in range(30):
            if u != o and ((h[u] > 0) & (h[o] > 0)).any() and h[u].std() > 0 and h[o].std() > 0:
                r = round(float(np.corrcoef(h[u], h[o])[0, 1]), 9)
                if u not in want or r > want[u][1]:
                    want[u] = (o, r)
    assert {u: v[0] for u, v in got.items()} == {u: v[0] for u, v in want.items()}
    assert all(math.isclose(got[u][1], want[u][1], abs_tol=1e-8) for u in want)


def test_best_correlated_in_few_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(u, int(b), int(rng.integers(1, 4))) for u in range(40) for b in rng.choice(10, 4, replace=False)]
    df = spark.createDataFrame(rows, "u long, bin int, n long").repartition(3)
    found = lambda: sorted((r.u, r.other, round(r.r, 9)) for r in waveforms.best_correlated(df, "u", 10).collect())
    whole = found()
    for block, blocks, part in ((2, 3, 8), (5, 64, 1 << 20), (1, 2, 1)):
        for name, value in (("BLOCK", block), ("BLOCKS", blocks), ("SLICE", part)):
            monkeypatch.setattr(waveforms, name, value)
        assert found() == whole and len(whole) == 40
