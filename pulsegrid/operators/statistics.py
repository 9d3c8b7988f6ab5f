"""Ranks, rank tests, false discovery rates, robust spread, binned summaries, one-regressor fits."""

from __future__ import annotations

from collections.abc import Callable

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


#: Coefficients of the published Chebyshev fit of erfc, with a relative error under 1.2e-7.
ERFC = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]


def two_sided_p(z: str | Column) -> Column:
    """Two-sided normal tail of a statistic; null stays null."""
    x = F.abs(F.col(z) if isinstance(z, str) else z) / math.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    fit = F.lit(ERFC[-1])
    for c in ERFC[-2::-1]:
        fit = fit * t + c
    return t * F.exp(fit - x * x)


#: A group of more distinct values than this is ordered in about so many pieces, each a task's work.
WHOLE, PIECES = 100_000, 256


def _group(by: list[str]) -> Column:
    """The group as one value, so that null keys are equal and no key is a group too."""
    return F.struct(*by, F.lit(0).alias("__all")).alias("__g")


def _fields(by: list[str]) -> list[Column]:
    return [F.col("__g").getField(c).alias(c) for c in by]


def _before(over: WindowSpec, n: str) -> Column:
    return F.coalesce(F.sum(n).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _in_pieces(values: DataFrame, every: DataFrame, v: str = "__v") -> DataFrame:
    """``values(__g, v, ...)`` with ``__piece``: the order of a group of over WHOLE rows in ``every`` is cut at values drawn by their hash, about PIECES of them.

    At most one value in WHOLE / PIECES is a cut, so the cuts go to every task.
    """
    large = every.groupBy("__g").agg(F.count("*").alias("__d")).filter(F.col("__d") > WHOLE)
    drawn = F.pmod(F.xxhash64(v), F.lit(1 << 40)) / (1 << 40) * F.col("__d") < PIECES
    cuts = every.select("__g", v).join(F.broadcast(large), "__g").filter(drawn).select("__g", v).distinct()
    cuts = cuts.groupBy("__g").agg(F.sort_array(F.collect_list(v)).alias("__cuts"))
    # the cuts up to the value, by halving steps
    further = lambda at, step: F.when(F.get("__cuts", at + step - 1) <= F.col(v), at + step).otherwise(at)
    below = F.when(F.col("__cuts").isNull(), 0).otherwise(F.aggregate(F.array(*[F.lit(2 * PIECES >> k) for k in range((2 * PIECES).bit_length())]), F.lit(0), further))
    return values.join(F.broadcast(cuts), "__g", "left").select(*values.columns, below.alias("__piece"))


def running_counts(rows: DataFrame, by: list[str], value: str, **sums: str) -> DataFrame:
    """``(__g, __v, __n, __before, __total)``: for each distinct value of a group its rows, those below it and all; with ``sums`` the sums of columns over its rows.

    Copies of a value are one row of it. A large group is counted piece by piece, so no task sorts a whole group; nulls are left out.
    """
    more = [F.sum(c).alias(name) for name, c in sums.items()]
    counts = rows.filter(F.col(value).isNotNull()).groupBy(_group(by), F.col(value).alias("__v")).agg(F.count("*").alias("__n"), *more)
    placed = _in_pieces(counts, counts)
    group = Window.partitionBy("__g")
    pieces = placed.groupBy("__g", "__piece").agg(F.sum("__n").alias("__k"))
    pieces = pieces.select("__g", "__piece", _before(group.orderBy("__piece"), "__k").alias("__first"), F.sum("__k").over(group).alias("__total"))
    inside = _before(Window.partitionBy("__g", "__piece").orderBy("__v"), "__n")
    return placed.withColumn("__inside", inside).join(pieces, ["__g", "__piece"]).select("__g", "__v", "__n", (F.col("__first") + F.col("__inside")).alias("__before"), "__total", *sums)


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with their number from 0 in the order of their group, rows of equal order in any.

    A large group is numbered piece by piece, so no task sorts a whole group, but all rows of equal order.
    """
    held = rows.withColumn("__g", _group(by)).withColumn("__order", F.struct(*order))
    placed = _in_pieces(held, held.select("__g", "__order"), "__order")
    # a group's first piece begins at 0 and is not sent; of the others there are about PIECES for WHOLE rows or more
    pieces = placed.groupBy("__g", "__piece").agg(F.count("*").alias("__k"))
    first = pieces.select("__g", "__piece", _before(Window.partitionBy("__g").orderBy("__piece"), "__k").alias("__first")).filter("__first > 0")
    inside = F.row_number().over(Window.partitionBy("__g", "__piece").orderBy("__order")) - 1
    joined = placed.withColumn("__inside", inside).join(F.broadcast(first), ["__g", "__piece"], "left")
    return joined.select(*rows.columns, (F.coalesce("__first", F.lit(0)) + F.col("__inside")).alias(name))


def _quantiles(rows: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    counts = running_counts(rows, by, value)
    place = [F.lit(float(q)) * (F.col("__total") - 1) for q in shares]
    at = lambda i: F.max(F.when((F.col("__before") <= i) & (i < F.col("__before") + F.col("__n")), F.col("__v").cast("double")))
    ends = counts.groupBy("__g", "__total").agg(*[at(f(p)).alias(f"__{n}{k}") for k, p in enumerate(place) for n, f in (("low", F.floor), ("high", F.ceil))])
    mixed = [F.when(F.floor(p) == F.ceil(p), F.col(f"__low{k}")).otherwise((F.ceil(p) - p) * F.col(f"__low{k}") + (p - F.floor(p)) * F.col(f"__high{k}")) for k, p in enumerate(place)]
    return ends.select("__g", F.array(*mixed).alias("quantiles"))


def quantiles(rows: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """``(by..., quantiles)``: the exact quantiles of each group, interpolated between the two nearest values.

    A null key is a group like any other; nulls are left out, and a group without values has no row.
    """
    return _quantiles(rows, by, value, shares).select(*_fields(by), "quantiles")


def average_rank(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Adds ranks from 1 in the order of the value, tied rows sharing the mean of theirs; nulls have none."""
    return rows.join(_ranks(rows, by, value, name), [*by, value], "left")


def _ranks(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    return running_counts(rows, by, value).select(*_fields(by), F.col("__v").alias(value), (F.col("__before") + (F.col("__n") + 1) / 2).alias(name))


def spearman(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation of each group, over rows that have both values; null without variance.

    Ranks of x come to the rows and are added up for each y, so only these sums meet the ranks of y; the variances follow from the counts of the distinct values.
    """
    both = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, _group(by), F.col(x).alias("__x"), F.col(y).alias("__y"))
    away = F.col("__before") + F.col("__n") / 2 - F.col("__total") / 2  # from the mean rank
    rx, ry = (running_counts(both, by, c).select("__g", F.col("__v").alias(c), "__n", away.alias(f"{c}_r")) for c in ("__x", "__y"))
    square = lambda r: F.sum(F.col("__n") * F.col(r) * F.col(r))
    sums = both.select("__g", "__x", "__y").join(rx.drop("__n"), ["__g", "__x"]).groupBy("__g", "__y").agg(F.sum("__x_r").alias("__s"))
    ofy = sums.join(ry, ["__g", "__y"]).groupBy("__g").agg(F.sum("__n").alias("n"), F.sum(F.col("__s") * F.col("__y_r")).alias("__xy"), square("__y_r").alias("__yy"))
    every = ofy.join(rx.groupBy("__g").agg(square("__x_r").alias("__xx")), "__g")
    spread = F.sqrt(F.col("__xx")) * F.sqrt(F.col("__yy"))
    return every.select(*_fields(by), "n", F.when(spread > 0, F.col("__xy") / spread).alias("rho"))


def rank_auc(rows: DataFrame, by: list[str], score: str, positive: str) -> DataFrame:
    """Area under the ROC curve, ties counting half; null without both classes."""
    ranked = average_rank(rows.filter(F.col(score).isNotNull() & F.col(positive).isNotNull()), by, score, "__r")
    out = ranked.groupBy(*by).agg(F.count_if(F.col(positive)).alias("n1"), F.count_if(~F.col(positive)).alias("n0"), F.sum(F.when(F.col(positive), F.col("__r"))).alias("s"))
    auc = (F.col("s") - F.col("n1") * (F.col("n1") + 1) / 2) / (F.col("n1") * F.col("n0"))
    return out.select(*by, "n1", "n0", F.when((F.col("n1") > 0) & (F.col("n0") > 0), auc).alias("auc"))


def mann_whitney(rows: DataFrame, by: list[str], value: str, positive: str) -> DataFrame:
    """U of the positive rows, its tie-corrected z and two-sided p by the normal approximation with continuity correction."""
    kept = rows.filter(F.col(value).isNotNull() & F.col(positive).isNotNull())
    ranked = average_rank(kept, by, value, "__r")
    sums = ranked.groupBy(*by).agg(F.count_if(F.col(positive)).alias("n1"), F.count_if(~F.col(positive)).alias("n0"), F.sum(F.when(F.col(positive), F.col("__r"))).alias("s"))
    ties = kept.groupBy(*by, value).agg(F.count("*").cast("double").alias("k")).groupBy(*by).agg(F.sum(F.pow("k", 3.0) - F.col("k")).alias("ties"))
    n = (F.col("n1") + F.col("n0")).cast("double")
    u = F.col("s") - F.col("n1") * (F.col("n1") + 1) / 2
    mean = F.col("n1") * F.col("n0") / 2
    sd = F.sqrt(F.col("n1") * F.col("n0") / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    z = F.when(sd > 0, F.signum(u - mean) * F.greatest(F.abs(u - mean) - 0.5, F.lit(0.0)) / sd)
    joined = sums.join(ties, by) if by else sums.join(F.broadcast(ties))
    return joined.filter("n1 > 0 and n0 > 0").select(*by, "n1", "n0", u.alias("u"), z.alias("z"), two_sided_p(z).alias("p"))


def wilcoxon(rows: DataFrame, by: list[str], difference: str, zeros: str = "drop") -> DataFrame:
    """Signed-rank sum of the positive differences, its tie-corrected z and two-sided p (normal approximation).

    Zeros are left out, or with ``zeros="split"`` ranked like any other, half of their ranks counting as positive.
    """
    kept = rows.filter(F.col(difference).isNotNull()).select(*by, F.col(difference).alias("d"), F.abs(difference).alias("m"))
    if zeros == "drop":
        kept = kept.filter("d <> 0")
    ranked = average_rank(kept, by, "m", "__r")
    share = F.when(F.col("d") > 0, F.col("__r")).when(F.col("d") == 0, F.col("__r") / 2)
    sums = ranked.groupBy(*by).agg(F.count("*").cast("double").alias("n"), F.coalesce(F.sum(share), F.lit(0.0)).alias("w"))
    ties = kept.groupBy(*by, "m").agg(F.count("*").cast("double").alias("k")).groupBy(*by).agg(F.sum(F.pow("k", 3.0) - F.col("k")).alias("ties"))
    n = F.col("n")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    z = F.when(sd > 0, (F.col("w") - n * (n + 1) / 4) / sd)
    return sums.join(ties, by).select(*by, n.cast("long").alias("n"), "w", z.alias("z"), two_sided_p(z).alias("p"))


def false_discovery(tests: DataFrame, p: str, q: float, by: list[str] | None = None) -> DataFrame:
    """Adds Benjamini-Hochberg ``p_adjusted`` and ``rejected`` within each family; null p stays out and has neither.

    Ranks and running minima are taken over the distinct p values of a family, in two linear windows.
    """
    by = by or []
    counts = tests.filter(F.col(p).isNotNull()).groupBy(*[F.col(c).alias(f"__{c}") for c in by], F.col(p).alias("__p")).agg(F.count("*").alias("__k"))
    family = Window.partitionBy(*[f"__{c}" for c in by])
    up, down = (family.orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc("__p"), F.desc("__p")))
    raw = counts.withColumn("__raw", F.col("__p") * F.sum("__k").over(family) / F.sum("__k").over(up))
    adjusted = raw.withColumn("p_adjusted", F.least(F.min("__raw").over(down), F.lit(1.0))).drop("__k", "__raw")
    same = F.col(p) == F.col("__p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return tests.join(adjusted, same, "left").drop("__p", *[f"__{c}" for c in by]).withColumn("rejected", F.col("p_adjusted") <= q)


def mad(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """``(by..., median, mad)``: the median and the median absolute deviation, scaled to a normal's standard deviation."""
    half = lambda df, v, name: _quantiles(df, by, v, [0.5]).select("__g", F.col("quantiles")[0].alias(name))
    middle = half(rows, value, "median")
    away = rows.select(*by, _group(by), F.col(value).alias("__x")).join(middle, "__g").select(*by, F.abs(F.col("__x") - F.col("median")).alias("__away"))
    return middle.join(half(away, "__away", "mad"), "__g").select(*_fields(by), "median", (F.col("mad") * 1.4826).alias("mad"))


def line_fit(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Least-squares line of each group: n, slope, intercept, R squared and the slope's t."""
    out = rows.groupBy(*by).agg(F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"))
    rest = F.greatest(F.col("syy") - F.col("slope") * F.col("slope") * F.col("sxx"), F.lit(0.0))
    error = F.sqrt(rest / (F.col("n") - 2) / F.col("sxx"))
    return out.withColumn("t", F.when((F.col("n") > 2) & (error > 0), F.col("slope") / error)).drop("sxx", "syy")


def ols(rows: DataFrame, by: list[str], xs: list[str], y: str) -> DataFrame:
    """Least squares with an intercept and a few regressors: ``(by..., n, r2, term, coef, t)``, a row for each regressor.

    Moments are one aggregation; a worker solves one matrix of the regressors' number for each group. Rows with a null are
    left out; groups of no more rows than coefficients, or with dependent regressors, give nulls.
    """
    k = len(xs)
    full = rows.dropna(subset=[*xs, y])
    pairs = [F.covar_pop(F.col(a).cast("double"), F.col(b).cast("double")) for a in [*xs, y] for b in [*xs, y]]
    moments = full.groupBy(*by).agg(F.count("*").alias("n"), F.array(*pairs).alias("c"))

    @F.pandas_udf("array<double>")
    def solved(n: pd.Series, c: pd.Series) -> pd.Series:
        out = []
        for rows_n, flat in zip(n, c):
            m = np.array(flat, float).reshape(k + 1, k + 1)
            free = rows_n - k - 1
            if free <= 0 or np.linalg.matrix_rank(m[:k, :k]) < k or m[k, k] <= 0:
                out.append([None] * (2 * k + 1))
                continue
            inverse = np.linalg.inv(m[:k, :k])
            beta = inverse @ m[:k, k]
            rest = max(m[k, k] - beta @ m[:k, k], 0.0)
            error = np.sqrt(np.maximum(rest / free * np.diag(inverse), 1e-300))
            out.append([1 - rest / m[k, k], *beta, *(beta / error)])
        return pd.Series(out)

    fits = moments.withColumn("s", solved("n", "c"))
    terms = F.explode(F.array(*[F.struct(F.lit(x).alias("term"), F.col("s")[1 + i].alias("coef"), F.col("s")[1 + k + i].alias("t")) for i, x in enumerate(xs)]))
    return fits.select(*by, "n", F.col("s")[0].alias("r2"), terms.alias("f")).select(*by, "n", "r2", "f.term", "f.coef", "f.t")


def binned_summary(rows: DataFrame, by: list[str], x: str, y: str, edges: list[float]) -> DataFrame:
    """Count, mean, sample error of the mean and median of y in left-closed bins of x; rows outside are left out."""
    b = F.lit(None).cast("int")
    for i in range(len(edges) - 2, -1, -1):
        b = F.when((F.col(x) >= edges[i]) & (F.col(x) < edges[i + 1]), i).otherwise(b)
    binned = rows.withColumn("bin", b).filter("bin is not null")
    sums = binned.groupBy(_group([*by, "bin"])).agg(F.count(y).alias("n"), F.avg(y).alias("mean"), (F.stddev_samp(y) / F.sqrt(F.count(y))).alias("sem"))
    middle = _quantiles(binned, [*by, "bin"], y, [0.5])
    return sums.join(middle, "__g", "left").select(*_fields([*by, "bin"]), "n", "mean", "sem", F.col("quantiles")[0].alias("median"))


def quantile_class(rows: DataFrame, x: str, k: int) -> DataFrame:
    """Adds ``class`` 0 to k - 1 by the value's quantile cut points, a cut point belonging to the class below."""
    cuts = quantiles(rows, [], x, [i / k for i in range(1, k)]).withColumnRenamed("quantiles", "__cuts")
    c = F.aggregate("__cuts", F.lit(0), lambda n, v: n + (F.col(x) > v).cast("int"))
    # one row of cut points
    return rows.join(F.broadcast(cuts), F.lit(True), "left").withColumn("class", c).drop("__cuts")


def logistic(x: Column, slope: float, bias: float) -> Column:
    """1 / (1 + exp(-slope * (x - bias)))."""
    return 1 / (1 + F.exp(-slope * (x - bias)))


def _small(rows: DataFrame, by: list[str], value: str, most: int) -> DataFrame:
    """The rows of groups of at most ``most``, with ``__r``, twice their average rank; larger groups are told by counts alone and never gathered."""
    few = rows.groupBy(*by).agg(F.count("*").alias("__n")).filter(F.col("__n") <= most).select(*[F.col(c).alias(f"__b{i}") for i, c in enumerate(by)])
    same = F.lit(True)
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"__b{i}"))
    twice = 2 * F.rank().over(Window.partitionBy(*by).orderBy(value)) + F.count("*").over(Window.partitionBy(*by, value)) - 1
    return rows.join(few, same, "left_semi").withColumn("__r", twice.cast("int"))


def _sums(ranks: Column, length: Column, shift: Callable[[Column], Column], fits: Callable[[Column, Column], Column]) -> Column:
    """How many choices of ranks lead to each place of an array: a rank that is taken moves a choice by ``shift``."""
    start = F.transform(F.sequence(F.lit(1), length), lambda i: F.when(i == 1, 1.0).otherwise(0.0))
    return F.aggregate(ranks, start, lambda acc, r: F.transform(acc, lambda v, i: v + F.when((i >= shift(r)) & fits(i, r), F.get(acc, (i - shift(r)).cast("int"))).otherwise(0.0)))


def exact_mann_whitney(rows: DataFrame, by: list[str], value: str, positive: str, most: int = 20) -> DataFrame:
    """``(by..., n1, n0, u, p)`` of groups of at most ``most`` rows: the exact two-sided p, ties included.

    p is the share of all choices of n1 rows whose sum of average ranks is at least as far from its mean. The choices are counted by adding one rank after the other to an array of
    counts by size and sum, in the JVM. Nulls are left out; groups without both sides, and larger ones, have no row.
    """
    kept = rows.filter(F.col(value).isNotNull() & F.col(positive).isNotNull())
    small = _small(kept, by, value, most)
    each = small.groupBy(*by).agg(F.collect_list("__r").alias("r"), F.count_if(F.col(positive)).cast("int").alias("n1"), F.count_if(~F.col(positive)).cast("int").alias("n0"), F.sum(F.when(F.col(positive), F.col("__r"))).cast("int").alias("s"))
    n = F.col("n1") + F.col("n0")
    each = each.filter("n1 > 0 and n0 > 0").withColumn("w", n * (n + 1) + 1)
    counts = _sums(F.col("r"), F.col("w") * (F.col("n1") + 1), lambda r: F.col("w") + r, lambda i, r: i % F.col("w") >= r)
    mean = F.col("n1") * (n + 1)
    row = F.slice(counts, F.col("n1") * F.col("w") + 1, F.col("w"))
    far = F.aggregate(F.transform("c", lambda v, i: F.when(F.abs(i - mean) >= F.abs(F.col("s") - mean), v).otherwise(0.0)), F.lit(0.0), lambda s, v: s + v)
    out = each.withColumn("c", row).withColumn("p", far / F.aggregate("c", F.lit(0.0), lambda s, v: s + v))
    return out.select(*by, "n1", "n0", (F.col("s") / 2 - F.col("n1") * (F.col("n1") + 1) / 2).alias("u"), "p")


def exact_wilcoxon(rows: DataFrame, by: list[str], difference: str, most: int = 20) -> DataFrame:
    """``(by..., n, w, p)`` of groups of at most ``most`` differences other than 0: the exact two-sided p of the signed ranks, ties included.

    p is the share of all signs whose positive rank sum is at least as far from its mean. Nulls and zeros are left out; larger groups have no row.
    """
    kept = rows.filter(F.col(difference).isNotNull() & (F.col(difference) != 0)).withColumn("__m", F.abs(difference))
    each = _small(kept, by, "__m", most).groupBy(*by).agg(F.collect_list("__r").alias("r"), F.count("*").cast("int").alias("n"), F.coalesce(F.sum(F.when(F.col(difference) > 0, F.col("__r"))), F.lit(0)).cast("int").alias("s"))
    total = F.col("n") * (F.col("n") + 1)
    far = F.aggregate(F.transform("c", lambda v, i: F.when(F.abs(2 * i - total) >= F.abs(2 * F.col("s") - total), v).otherwise(0.0)), F.lit(0.0), lambda s, v: s + v)
    out = each.withColumn("c", _sums(F.col("r"), total + 1, lambda r: r, lambda i, r: F.lit(True))).withColumn("p", far / F.pow(F.lit(2.0), F.col("n")))
    return out.select(*by, F.col("n").cast("long").alias("n"), (F.col("s") / 2).alias("w"), "p")
