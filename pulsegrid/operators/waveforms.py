"""Waveforms and sampled traces as rows of samples: averages, stability, threshold crossings, sweeps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.operators import bands
from pulsegrid.operators.lineage import shared_root
from pulsegrid.operators.pairs import cosine
from pulsegrid.operators.sequence import thin


def samples(waves: DataFrame, keys: list[str], wave: str) -> DataFrame:
    """One row per sample: ``(keys..., pos, x)``."""
    return waves.select(*keys, F.posexplode(wave).alias("pos", "x")).withColumn("x", F.col("x").cast("double"))


def mean_waveforms(waves: DataFrame, by: list[str], wave: str) -> DataFrame:
    """``(by..., n, wave)``: the mean of each sample over the waves of a group."""
    means = samples(waves, by, wave).groupBy(*by, "pos").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    return means.groupBy(*by).agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("wave"))


def stability(waves: DataFrame, key: str, segment: str, wave: str) -> DataFrame:
    """``(key, n_segments, score)``: mean cosine between the mean waveforms of a key's segments, null for fewer than two."""
    means = mean_waveforms(waves, [key, segment], wave)
    a = means.select(key, F.col(segment).alias("__s"), F.col("wave").alias("__w"))
    b = means.select(key, F.col(segment).alias("__s2"), F.col("wave").alias("__w2"))
    scores = a.join(b, key).filter("__s < __s2").groupBy(key).agg(F.avg(cosine(F.col("__w"), F.col("__w2"))).alias("score"))
    return means.groupBy(key).agg(F.count("*").alias("n_segments")).join(scores, key, "left")


def consistency(waves: DataFrame, by: list[str], wave: str, least: int = 5) -> DataFrame:
    """``(by..., n, score)``: mean cosine of a group's waves with their mean, cut to 0 to 1; null for fewer than ``least`` waves.

    Null waves are left out; a group without any has no row.
    """
    held = waves.filter(F.col(wave).isNotNull()).select(*by, F.col(wave).alias("__w"))
    middle = mean_waveforms(held, by, "__w").select(*by, F.col("wave").alias("__m"))
    scores = held.join(middle, by).groupBy(*by).agg(F.count("*").alias("n"), F.avg(cosine(F.col("__w").cast("array<double>"), F.col("__m"))).alias("__c"))
    return scores.select(*by, "n", F.when(F.col("n") >= least, F.least(F.greatest("__c", F.lit(0.0)), F.lit(1.0))).alias("score"))


def troughs(trace: DataFrame, key: str, pos: str, x: str, threshold: float, dead: int = 0) -> DataFrame:
    """``(key, pos, x)`` of the first lowest sample of each run below a threshold.

    Of troughs closer than ``dead`` samples the deeper stays. A run at either end of a trace counts like any other.
    """
    below = trace.filter(F.col(x) < threshold)
    # consecutive positions less their row number are one value along a run
    run = F.col(pos) - F.row_number().over(Window.partitionBy(key).orderBy(pos))
    lowest = below.withColumn("__run", run).groupBy(key, "__run").agg(F.min(F.struct(F.col(x).alias("x"), F.col(pos).alias("pos"))).alias("m"))
    found = lowest.select(key, F.col("m.pos").cast("long").alias("pos"), F.col("m.x").alias("x"))
    return thin(found, key, "pos", dead, "x") if dead else found


def teager(wave: Column) -> Column:
    """x[i]^2 - x[i-1] x[i+1] of the inner samples."""
    inner = F.sequence(F.lit(1), F.size(wave) - 2)
    at = lambda i: F.get(wave, i)
    return F.when(F.size(wave) >= 3, F.transform(inner, lambda i: at(i) * at(i) - at(i - 1) * at(i + 1))).otherwise(F.array().cast("array<double>"))


def sweep(scored: DataFrame, key: str, t: str, event_id: str, score: str, cuts: list[float], bin_width: int, refractory: int, shoulder: tuple[int, int]) -> DataFrame:
    """Violation ratio of each key's events at or above each of a few score cuts: ``(key, cut, n_events, ratio)``."""
    each = scored.select(key, t, event_id, F.explode(F.filter(F.array(*map(F.lit, cuts)), lambda c: F.col(score) >= c)).alias("cut"))
    each = each.withColumn("__train", F.struct(key, "cut"))
    h = bands.autocorrelogram(each, "__train", t, event_id, -(-shoulder[1] // bin_width) * bin_width + bin_width, bin_width)
    ratio = bands.violation_ratio(h, "__train", bin_width, refractory, shoulder).select("__train", "ratio")
    n = each.groupBy("__train").agg(F.count("*").alias("n_events"))
    rows = n.join(ratio, "__train", "left").select(F.col("__train")[key].alias(key), F.col("__train.cut").alias("cut"), "n_events", F.coalesce("ratio", F.lit(0.0)).alias("ratio"))
    return rows


def inflection(curve: DataFrame, key: str, cut: str, value: str, factor: float = 4.0, least_step: float = 0.005) -> DataFrame:
    """The cut just before a value begins to climb as the cuts are lowered: ``(key, cut, found)``.

    A climb is a step over ``factor`` medians of the first half of the steps and over ``least_step``. Without one, or with
    fewer than three cuts, the strictest cut is given and ``found`` is false.
    """
    w = Window.partitionBy(key).orderBy(F.desc(cut))
    whole = Window.partitionBy(key)
    steps = curve.withColumn("__i", F.row_number().over(w) - 1).withColumn("__d", F.lead(value).over(w) - F.col(value)).withColumn("__n", F.count("*").over(whole))
    half = F.greatest(F.lit(1), F.floor((F.col("__n") - 1) / 2))
    medians = steps.filter(F.col("__d").isNotNull() & (F.col("__i") < half)).groupBy(key).agg((F.median(F.abs("__d")) + 1e-9).alias("__m"))
    judged = steps.join(medians, key, "left")
    climb = (F.col("__n") >= 3) & (F.col("__i") >= 1) & (F.col("__d") > factor * F.col("__m")) & (F.col("__d") > least_step)
    first = judged.groupBy(key).agg(F.min_by(F.when(climb, F.col(cut)), F.when(climb, F.col("__i"))).alias("__c"), F.max(cut).alias("__top"))
    return first.select(key, F.coalesce("__c", "__top").alias("cut"), F.col("__c").isNotNull().alias("found"))


#: Least histograms of a block and most blocks; rows of a block that are multiplied at once. A task holds two blocks and the product of such a slice.
BLOCK, BLOCKS, SLICE = 1024, 64, 1 << 22


def best_correlated(histogram: DataFrame, key: str, n_bins: int) -> DataFrame:
    """Each key with the other whose histogram correlates most with its own: ``(key, other, r)``; ties to the lesser.

    Only keys that share a bin are compared; bins without a row are zeros; bins further apart than ``n_bins`` are an error. A flat histogram
    has no correlation. Histograms become vectors, which meet in at most BLOCKS blocks, so what is shuffled grows with the keys and not with their square; a pair of
    blocks gives each key its best, not all pairs.
    """
    kind = histogram.schema[key].dataType.simpleString()
    counts = F.map_from_entries(F.collect_list(F.struct("bin", F.col("n").cast("double"))))
    shared_root(histogram.sparkSession)
    packed = histogram.groupBy(key).agg(counts.alias("__m"), F.min("bin").alias("lo"), F.max("bin").alias("hi")).checkpoint()
    lo, hi, n = packed.agg(F.min("lo"), F.max("hi"), F.count("*")).first()
    if lo is not None and hi - lo >= n_bins:
        raise ValueError(f"bins from {lo} to {hi} are more than {n_bins}")
    places = F.sequence(F.lit(lo or 0), F.lit((lo or 0) + n_bins - 1)).cast(T.ArrayType(histogram.schema["bin"].dataType))
    dense = F.transform(places, lambda i: F.coalesce(F.col("__m")[i], F.lit(0.0)))
    waves = packed.select(F.col(key).alias("key"), dense.alias("wave"))
    blocks = min(1 + n // BLOCK, BLOCKS)
    own = F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")
    # a pair of blocks meets once and gives the best of both sides
    left = waves.withColumn("i", own).withColumn("j", F.explode(F.sequence(F.col("i"), F.lit(blocks - 1))))
    right = waves.withColumn("j", own).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("j")))).select(F.col("key").alias("other"), F.col("wave").alias("shape"), "i", "j")

    def unit(v: np.ndarray) -> np.ndarray:
        v = v - v.mean(axis=1, keepdims=True)
        norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
        return np.divide(v, norm, out=np.full_like(v, np.nan), where=norm > 0)

    def one_way(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> pd.DataFrame:
        """The best of b for each of a; b is in order."""
        ux, uy, hx, hy = unit(x), unit(y), (x > 0).astype(np.float32), (y > 0).astype(np.float32)
        out = []
        step = max(1, SLICE // len(b))
        for s in range(0, len(a), step):
            met = (hx[s : s + step] @ hy.T > 0) & (a[s : s + step, None] != b[None, :])
            r = ux[s : s + step] @ uy.T
            r = np.where(met & np.isfinite(r), r, -np.inf)
            at = np.round(r, 9).argmax(axis=1)
            best = r[np.arange(len(r)), at]
            found = np.isfinite(best)
            out.append(pd.DataFrame({"key": a[s : s + step][found], "other": b[at[found]], "r": best[found]}))
        return pd.concat(out)

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"key": a["key"][:0], "other": b["other"][:0], "r": np.array([], float)})
        a, b = a.sort_values("key"), b.sort_values("other")
        (k, x), (o, y) = ((v.to_numpy(), np.stack(w.to_list()).astype(float)) for v, w in ((a["key"], a["wave"]), (b["other"], b["shape"])))
        there = one_way(k, x, o, y)
        return there if a["i"].iat[0] == a["j"].iat[0] else pd.concat([there, one_way(o, y, k, x)])

    met = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(compare, f"key {kind}, other {kind}, r double")
    best = met.groupBy("key").agg(F.min(F.struct((-F.round("r", 9)).alias("s"), "other", "r")).alias("m"))
    return best.select(F.col("key").alias(key), F.col("m.other").alias("other"), F.col("m.r").alias("r"))
