"""Models: decoding with folds and permutations, mixtures, psychometric curves, discriminants."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.decoding import ridge_scores


def fold(key: str, k: int, seed: int = 0) -> Column:
    """Fold 0 to k - 1 by a hash of the key, so that rows of one trial stay together."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(k)).cast("int")


def _assembled(rows: DataFrame, features: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=features, outputCol="features").transform(rows)


def ridge_cv(rows: DataFrame, key: str, features: list[str], target: str, alphas: list[float], k: int = 5) -> DataFrame:
    """``(alpha, r2)``: out-of-fold share of the target's variance explained by ridge regression; folds by the key's hash."""
    return ridge_scores(rows, [], features, target, alphas, fold(key, k)).select("alpha", "r2")


def mixture_by_bic(rows: DataFrame, features: list[str], most: int, seed: int = 0) -> DataFrame:
    """``(k, bic, best)`` of Gaussian mixtures with 1 to ``most`` components."""
    from pyspark.ml.clustering import GaussianMixture

    data = _assembled(rows, features).select("features").cache()
    n, d = data.count(), len(features)
    import numpy as np

    # one component has a closed form
    pairs = [F.covar_pop(a, b) for a in features for b in features]
    cov = np.array([float(v) for v in rows.agg(*pairs).first()]).reshape(d, d)
    out = [(1, n * (d * math.log(2 * math.pi) + float(np.linalg.slogdet(cov)[1]) + d) + (d + d * (d + 1) // 2) * math.log(n))]
    for k in range(2, most + 1):
        model = GaussianMixture(k=k, seed=seed, maxIter=60).fit(data)
        free = k - 1 + k * d + k * d * (d + 1) // 2
        out.append((k, -2 * model.summary.logLikelihood + free * math.log(n)))
    data.unpersist()
    best = min(out, key=lambda r: r[1])[0]
    return rows.sparkSession.createDataFrame([(k, b, k == best) for k, b in out], "k int, bic double, best boolean")


def psychometric(rows: DataFrame, by: list[str], x: str, choice: str, slopes: list[float], biases: list[float], lapses: list[float]) -> DataFrame:
    """The grid point of greatest likelihood of lapse + (1 - 2 lapse) / (1 + exp(-slope (x - bias))), per group.

    Trials are counted by stimulus first, so the grid meets the distinct stimuli, not the trials.
    """
    counts = rows.groupBy(*by, F.col(x).cast("double").alias("__x")).agg(F.count_if(F.col(choice)).alias("__k"), F.count("*").alias("__n"))
    array = lambda v: F.array(*map(F.lit, v))
    grid = counts.withColumn("slope", F.explode(array(slopes))).withColumn("bias", F.explode(array(biases))).withColumn("lapse", F.explode(array(lapses)))
    p = F.col("lapse") + (1 - 2 * F.col("lapse")) / (1 + F.exp(-F.col("slope") * (F.col("__x") - F.col("bias"))))
    p = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    fit = grid.groupBy(*by, "slope", "bias", "lapse").agg(F.sum(F.col("__k") * F.log(p) + (F.col("__n") - F.col("__k")) * F.log(1 - p)).alias("loglik"))
    best = fit.groupBy(*by).agg(F.max(F.struct(F.round("loglik", 9).alias("loglik"), -F.col("slope"), -F.col("bias"), -F.col("lapse"))).alias("m"))
    return best.select(*by, (-F.col("m.col2")).alias("slope"), (-F.col("m.col3")).alias("bias"), (-F.col("m.col4")).alias("lapse"), F.col("m.loglik").alias("loglik"))


def separation(rows: DataFrame, group: str, features: list[str]) -> DataFrame:
    """Squared Mahalanobis distance between the two groups' means under their pooled covariance, one row.

    Moments are one aggregation; only a matrix of the features' size is solved on the driver.
    """
    import numpy as np

    d = len(features)
    moments = [F.avg(f).alias(f"m{i}") for i, f in enumerate(features)] + [F.covar_samp(a, b).alias(f"c{i}_{j}") for i, a in enumerate(features) for j, b in enumerate(features)]
    two = rows.groupBy(group).agg(F.count("*").alias("n"), *moments).orderBy(group).limit(3).collect()
    if len(two) != 2:
        raise ValueError("two groups are needed")
    mean = [np.array([r[f"m{i}"] for i in range(d)]) for r in two]
    cov = [np.array([[r[f"c{i}_{j}"] for j in range(d)] for i in range(d)]) for r in two]
    n = [r.n for r in two]
    pooled = sum((k - 1) * c for k, c in zip(n, cov)) / (sum(n) - 2)
    gap = mean[1] - mean[0]
    weights = np.linalg.solve(pooled + 1e-9 * np.trace(pooled) / d * np.eye(d), gap)
    return rows.sparkSession.createDataFrame([(n[0], n[1], float(gap @ weights), [float(w) for w in weights])], "n0 long, n1 long, distance2 double, weights array<double>")
