"""Pairs of placed or described things: within a radius, most similar, mutually best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; null where a vector is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def spatial_pairs(points: DataFrame, point: str, x: str, y: str, radius: float) -> DataFrame:
    """``(a, b, distance)`` with a < b for points within a radius, as an equi-join on grid cells of that size.

    A point posts itself to its cell and looks into it and the 8 around.
    """
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    right = points.select(F.col(point).alias("b"), F.col(x).alias("xb"), F.col(y).alias("yb"), cell(x).alias("cx"), cell(y).alias("cy"))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    left = points.select(F.col(point).alias("a"), F.col(x).alias("xa"), F.col(y).alias("ya"), cell(x).alias("cx0"), cell(y).alias("cy0"), around.alias("o"))
    left = left.select("a", "xa", "ya", (F.col("cx0") + F.col("o.i")).alias("cx"), (F.col("cy0") + F.col("o.j")).alias("cy"))
    distance = F.hypot(F.col("xa") - F.col("xb"), F.col("ya") - F.col("yb"))
    return left.join(right, ["cx", "cy"]).filter(F.col("a") < F.col("b")).withColumn("distance", distance).filter(F.col("distance") <= radius).select("a", "b", "distance")


def described(pairs: DataFrame, vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Pairs (a, b, ...) with the cosine of their vectors."""
    va = vectors.select(F.col(key).alias("a"), F.col(vector).alias("va"))
    vb = vectors.select(F.col(key).alias("b"), F.col(vector).alias("vb"))
    return pairs.join(va, "a").join(vb, "b").withColumn("similarity", cosine(F.col("va"), F.col("vb"))).drop("va", "vb")


def top_similar(pairs: DataFrame, k: int) -> DataFrame:
    """The k most similar partners of each end of the pairs, ranked; ties go to the lesser partner."""
    both = pairs.select(F.col("a").alias("unit"), F.col("b").alias("other"), "similarity").unionByName(pairs.select(F.col("b").alias("unit"), F.col("a").alias("other"), "similarity"))
    w = Window.partitionBy("unit").orderBy(F.desc("similarity"), "other")
    return both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def mutual_best(pairs: DataFrame, left: str, right: str, score: str, least: float) -> DataFrame:
    """Pairs that are each other's best above a threshold; ties go to the lesser partner."""
    ranked = pairs.withColumn("__l", F.row_number().over(Window.partitionBy(left).orderBy(F.desc(score), right)))
    ranked = ranked.withColumn("__r", F.row_number().over(Window.partitionBy(right).orderBy(F.desc(score), left)))
    return ranked.filter((F.col("__l") == 1) & (F.col("__r") == 1) & (F.col(score) >= least)).drop("__l", "__r")


def inside_polygon(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    """Even-odd rule: whether a ray to the right crosses the outline an odd number of times."""
    crossed = F.lit(False)
    for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1]):
        if y1 != y2:
            spans = (F.lit(y1) > y) != (F.lit(y2) > y)
            hit = spans & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
            crossed = crossed != hit
    return crossed


def concentration(amplitudes: Column) -> Column:
    """Second largest amplitude over the largest; 0 for fewer than two or none positive."""
    s = F.sort_array(amplitudes, asc=False)
    return F.when((F.size(s) >= 2) & (F.get(s, F.lit(0)) > 0), F.get(s, F.lit(1)) / F.get(s, F.lit(0))).otherwise(0.0)


def flatness(amplitudes: Column) -> Column:
    """Mean of the fourth and fifth largest amplitude over the largest; 0 for fewer than five or none positive."""
    s = F.sort_array(amplitudes, asc=False)
    return F.when((F.size(s) >= 5) & (F.get(s, F.lit(0)) > 0), (F.get(s, F.lit(3)) + F.get(s, F.lit(4))) / 2 / F.get(s, F.lit(0))).otherwise(0.0)


def peak_trough_width(wave: Column, samples_per_ms: float) -> Column:
    """Milliseconds from the lowest sample to the highest, the first of equals."""
    at = lambda m: F.array_position(wave, m)
    return F.abs(at(F.array_max(wave)) - at(F.array_min(wave))) / samples_per_ms


def fit_scale(wave: Column, template: Column) -> Column:
    """Scale of the template that leaves the least residual."""
    energy = dot(template, template)
    return F.when(energy > 0, dot(wave, template) / energy).otherwise(0.0)


def residual_share(wave: Column, template: Column) -> Column:
    """Energy left after subtracting the scaled template, over the wave's."""
    scale, energy = fit_scale(wave, template), dot(wave, wave)
    rest = F.zip_with(wave, template, lambda a, b: a.cast("double") - scale * b.cast("double"))
    return F.when(energy > 0, dot(rest, rest) / energy).otherwise(0.0)
