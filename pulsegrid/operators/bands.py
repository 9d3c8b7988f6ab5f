"""Joins of events within a band of time differences, as equi-joins on time buckets.

A left event looks into the one or two buckets that its band touches; a right event lies in one. So a band join
is a hash join whose keys are spread over time, and a busy train is many keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def band_join(left: DataFrame, right: DataFrame, t_left: str, t_right: str, lo: int, hi: int, on: list[str] | None = None, how: str = "inner") -> DataFrame:
    """Rows of both sides with lo <= t_right - t_left <= hi and equal ``on`` columns; other names must differ."""
    width = max(hi - lo, 1)
    on = on or []
    bucket = lambda x: F.floor(x / width).cast("long")
    probes = F.array_distinct(F.array(bucket(F.col(t_left) + lo), bucket(F.col(t_left) + hi)))
    a = left.withColumn("__b", F.explode(probes))
    b = right.withColumn("__b", bucket(F.col(t_right)))
    d = F.col(t_right) - F.col(t_left)
    return a.join(b, [*on, "__b"], how).filter((d >= lo) & (d <= hi)).drop("__b")


def forward_lags(events: DataFrame, key: str, t: str, event_id: str, max_lag: int) -> DataFrame:
    """``(key, lag)`` of all pairs of a train's events, the later minus the earlier, up to ``max_lag``."""
    later = events.select(key, F.col(t).alias("__t2"), F.col(event_id).alias("__i2"))
    earlier = events.select(key, F.col(t).alias("__t1"), F.col(event_id).alias("__i1"))
    pairs = band_join(earlier, later, "__t1", "__t2", 0, max_lag, [key])
    ahead = (F.col("__t2") > F.col("__t1")) | ((F.col("__t2") == F.col("__t1")) & (F.col("__i2") > F.col("__i1")))
    return pairs.filter(ahead).select(key, (F.col("__t2") - F.col("__t1")).alias("lag"))


def autocorrelogram(events: DataFrame, key: str, t: str, event_id: str, max_lag: int, bin_width: int) -> DataFrame:
    """``(key, bin, n)`` over the bins [b * w, (b + 1) * w) of -max_lag..max_lag, mirrored; empty bins have no row.

    The last bin is closed, as histograms are.
    """
    lags = forward_lags(events, key, t, event_id, max_lag)
    both = lags.select(key, F.explode(F.array(F.col("lag"), -F.col("lag"))).alias("lag"))
    return _binned(both, [key], max_lag, bin_width)


def _binned(lags: DataFrame, by: list[str], max_lag: int, bin_width: int) -> DataFrame:
    b = F.least(F.floor(F.col("lag") / bin_width), F.lit(max_lag // bin_width - 1)).cast("long")
    return lags.groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"))


def violation_ratio(histogram: DataFrame, key: str, bin_width: int, refractory: int, shoulder: tuple[int, int]) -> DataFrame:
    """Counts of the bins whose centres are within ``refractory``, against what the shoulder's bins predict.

    Without expectation the ratio is infinite if there is any count, else 0.
    """
    centre = (F.col("bin") + 0.5) * bin_width
    centres = [(b + 0.5) * bin_width for b in range(shoulder[1] // bin_width + 2)]
    n_refractory = 2 * sum(c <= refractory for c in centres)
    n_shoulder = 2 * sum(shoulder[0] <= c <= shoulder[1] for c in centres)
    near = F.abs(centre)
    sums = histogram.groupBy(key).agg(
        F.sum(F.when(near <= refractory, F.col("n")).otherwise(0)).alias("n_refractory"), F.sum(F.when((near >= shoulder[0]) & (near <= shoulder[1]), F.col("n")).otherwise(0)).alias("__s")
    )
    expected = F.col("__s") / max(n_shoulder, 1) * n_refractory
    ratio = F.when(expected > 0, F.col("n_refractory") / expected).when(F.col("n_refractory") > 0, F.lit(float("inf"))).otherwise(0.0)
    return sums.select(key, "n_refractory", expected.alias("expected"), ratio.alias("ratio"))


def crosscorrelogram(a: DataFrame, b: DataFrame, t: str, on: list[str], max_lag: int, bin_width: int, by: list[str] | None = None) -> DataFrame:
    """``(by..., bin, n)`` of the differences b - a within -max_lag..max_lag."""
    left, right = a.withColumnRenamed(t, "__t1"), b.withColumnRenamed(t, "__t2")
    lags = band_join(left, right, "__t1", "__t2", -max_lag, max_lag, on).withColumn("lag", F.col("__t2") - F.col("__t1"))
    return _binned(lags, by or on, max_lag, bin_width)


def dip_metrics(histogram: DataFrame, key: str, bin_width: int, max_lag: int, refractory: int, flank_from: int) -> DataFrame:
    """Refractory counts, total, flank counts a bin, the expectation from the flanks, dip ratio and peak lag of each key."""
    centre = (F.col("bin") + 0.5) * bin_width
    half = [(b + 0.5) * bin_width for b in range(max_lag // bin_width)]
    n_refractory, n_flank = 2 * sum(c <= refractory for c in half), 2 * sum(c >= flank_from for c in half)
    sums = histogram.groupBy(key).agg(
        F.sum(F.when(F.abs(centre) <= refractory, F.col("n")).otherwise(0)).alias("n_refractory"), F.sum("n").alias("n_total"),
        (F.sum(F.when(F.abs(centre) >= flank_from, F.col("n")).otherwise(0)) / max(n_flank, 1)).alias("flank_per_bin"),
        F.max_by(centre, F.struct(F.col("n"), -F.col("bin"))).alias("peak_lag"),
    )
    expected = F.col("flank_per_bin") * n_refractory
    return sums.withColumn("expected", expected).withColumn("dip_ratio", F.when(expected > 0, F.col("n_refractory") / expected))


def synchrony_excess(a: DataFrame, b: DataFrame, key: str, t: str, window: int, ticks_per_s: float) -> DataFrame:
    """Coincidences of b in [t - w, t + w) of events of a, over what b's mean rate predicts, per key; 0 without both."""
    left, right = a.select(key, F.col(t).alias("__t1")), b.select(key, F.col(t).alias("__t2"))
    hits = band_join(left, right, "__t1", "__t2", -window, window - 1, [key]).groupBy(key).agg(F.count("*").alias("n"))
    span = lambda df, n: df.groupBy(key).agg(F.count("*").alias(f"n{n}"), F.min(t).alias(f"a{n}"), F.max(t).alias(f"b{n}"))
    both = span(a, 1).join(span(b, 2), key).join(hits, key, "left")
    duration = (F.greatest("b1", "b2") - F.least("a1", "a2")) / ticks_per_s
    rate = F.when(duration > 0, F.col("n2") / duration).otherwise(0.0)
    expected = F.col("n1") * rate * (2 * window / ticks_per_s)
    return both.select(key, F.coalesce("n", F.lit(0)).alias("n_coincident"), (F.coalesce("n", F.lit(0)) / (expected + 1e-9)).alias("excess"))
