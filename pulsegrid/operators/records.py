"""Records of candidate merges, attribution of events, checks of a curated dataset, lineages of merges, graded ladders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.tiers import merge_tier, weighted_score
from pulsegrid.operators.bands import band_join
from pulsegrid.operators.lineage import shared_root
from pulsegrid.operators.pairs import described


def both_ways(pairs: DataFrame) -> DataFrame:
    """``pairs(a, b, ...)`` with each pair in both orders."""
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    return pairs.select("a", "b", *rest).unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), *rest))


def merge_records(pairs: DataFrame, vectors: DataFrame, events: DataFrame, unit: str, t: str, event_id: str, near: int, wide: int, refractory: int) -> DataFrame:
    """What speaks for merging each of ``pairs(a, b, distance)``, and its rank among the pairs of ``a``.

    ``vectors(unit, vector)`` give the similarity. ``dip`` is the rate of differences up to ``near`` over that up to ``wide`` (1 without
    any), ``refractory_share`` the share of the joined train's intervals under ``refractory``. The pairs are neighbours, so a train is
    repeated as often as it has neighbours.
    """
    trains = events.select(F.col(unit).alias("u"), F.col(t).alias("t"), F.col(event_id).alias("i"))
    sides = [pairs.select("a", "b").join(trains.withColumnRenamed("u", s), s) for s in ("a", "b")]
    lags = band_join(sides[0].select("a", "b", F.col("t").alias("t1")), sides[1].select("a", "b", F.col("t").alias("t2")), "t1", "t2", -wide, wide, ["a", "b"])
    counts = lags.groupBy("a", "b").agg(F.count_if(F.abs(F.col("t2") - F.col("t1")) <= near).alias("n_near"), F.count("*").alias("n_wide"))
    joined = sides[0].unionByName(sides[1])
    isi = F.col("t") - F.lag("t").over(Window.partitionBy("a", "b").orderBy("t", "i"))
    shares = joined.withColumn("isi", isi).groupBy("a", "b").agg(F.count("*").alias("n_events"), F.avg((F.col("isi") < refractory).cast("double")).alias("refractory_share"))
    rows = described(pairs, vectors, unit, "vector").join(shares, ["a", "b"], "left").join(counts, ["a", "b"], "left").fillna(0, ["n_events", "n_near", "n_wide"])
    rows = rows.withColumn("refractory_share", F.coalesce("refractory_share", F.lit(0.0)))
    dip = F.when(F.col("n_wide") > 0, F.col("n_near") * (wide / near) / F.col("n_wide")).otherwise(1.0)
    parts = {"similarity": (F.greatest("similarity", F.lit(0.0)), 0.5), "dip": (1 - F.least("dip", F.lit(1.0)), 0.3), "clean": (1 - F.col("refractory_share"), 0.2)}
    rows = rows.withColumn("dip", dip).withColumn("score", F.round(weighted_score(parts), 9)).withColumn("tier", merge_tier(F.col("score")))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b")))


def attribution(samples: DataFrame, events: DataFrame, pairs: DataFrame, unit: str, event_id: str, t: str, tolerance: int) -> DataFrame:
    """``(event_id, owner, dt, similarity)``: of the neighbours of a sample's unit with an event within the tolerance, the most similar one.

    ``pairs(a, b, similarity)`` are the neighbours in both orders. Ties go to the nearer event, then the lesser unit, then the earlier event.
    """
    asked = samples.select(F.col(unit).alias("a"), event_id, F.col(t).alias("t1")).join(pairs.select("a", "b", "similarity"), "a")
    given = events.select(F.col(unit).alias("b"), F.col(t).alias("t2"))
    met = band_join(asked, given, "t1", "t2", -tolerance, tolerance, ["b"])
    dt = F.col("t2") - F.col("t1")
    best = met.groupBy(event_id).agg(F.min(F.struct((-F.col("similarity")).alias("s"), F.abs(dt).alias("d"), F.col("b").alias("b"), dt.alias("dt"))).alias("m"))
    return best.select(event_id, F.col("m.b").alias("owner"), F.col("m.dt").alias("dt"), (-F.col("m.s")).alias("similarity"))


def verification(units: DataFrame, automatic: DataFrame, verdicts: DataFrame, merges: DataFrame, windows: DataFrame, events: DataFrame, unit: str, t: str) -> DataFrame:
    """``(check, unit, n)`` of what a curated dataset breaks; no row means that all is well.

    ``units(unit, label)`` are what the dataset holds, ``automatic(unit, label)`` what it was made from, ``verdicts(unit, verdict)`` the
    decisions on it, ``merges(merged, parent)``, ``windows(unit, t0, t1)`` and ``events(unit, t)``. Every check is an anti or an equi-join.
    """
    parents = merges.select(F.col("parent").alias(unit)).distinct()
    judged = units.join(verdicts, unit)
    one = lambda df, name: df.select(F.lit(name).alias("check"), unit, F.lit(1).cast("long").alias("n"))
    labels = one(judged.filter("verdict <> 'noise' and label <> verdict"), "label")
    noise = one(judged.filter("verdict = 'noise'"), "noise")
    before = automatic.select(unit, F.col("label").alias("__was"))
    untouched = one(units.join(verdicts.select(unit), unit, "left_anti").join(before, unit).filter(~F.col("label").eqNullSafe(F.col("__was"))), "untouched")
    kept_parents = one(units.join(parents, unit, "left_semi"), "parent_kept")
    lost = one(merges.select(F.col("merged").alias(unit)).distinct().join(units, unit, "left_anti"), "merged_missing")
    accounted = one(verdicts.filter("verdict <> 'noise'").select(unit).distinct().join(units, unit, "left_anti").join(parents, unit, "left_anti"), "unaccounted")
    orphans = events.join(units, unit, "left_anti").groupBy(unit).agg(F.count("*").alias("n")).select(F.lit("orphan").alias("check"), unit, "n")
    keyed = events.select(unit, t).distinct()
    inside = keyed.join(windows, unit).filter(F.col(t).between(F.col("t0"), F.col("t1"))).select(unit, t)
    bounded = events.select(unit, t).join(windows.select(unit).distinct(), unit, "left_semi")
    outside = bounded.join(inside, [unit, t], "left_anti").groupBy(unit).agg(F.count("*").alias("n")).select(F.lit("window").alias("check"), unit, "n")
    out = labels
    for check in (noise, untouched, kept_parents, lost, accounted, orphans, outside):
        out = out.unionByName(check)
    return out


def final_units(merges: DataFrame, rounds: int = 40) -> DataFrame:
    """``(unit, final, depth)``: where ``merges(unit, merged)``, one row a unit, lead in the end, through merges of merges.

    Pointers are doubled, so a chain of length n takes log2(n) joins, each checkpointed; a circle is an error.
    """
    shared_root(merges.sparkSession)
    now = merges.select("unit", F.col("merged").alias("final"), F.lit(1).cast("long").alias("depth")).filter("unit is not null and final is not null").checkpoint()
    for _ in range(rounds):
        ahead = now.select(F.col("unit").alias("final"), F.col("final").alias("__next"), F.col("depth").alias("__more"))
        stepped = now.join(ahead, "final", "left")
        moved = stepped.filter("__next is not null").isEmpty()
        if moved:
            return now
        now = stepped.select("unit", F.coalesce("__next", "final").alias("final"), (F.col("depth") + F.coalesce("__more", F.lit(0))).alias("depth")).checkpoint()
    raise RuntimeError("the merges lead in a circle")


def shift_ladder(rungs: DataFrame, by: list[str], rung: str, true: str, estimate: str) -> DataFrame:
    """Errors of estimates of known shifts per group, measured from the rung whose true shift is nearest to zero (then the least rung).

    ``(by..., n, rms, max_abs, slope, implied_bias)``; rungs without both values are left out, groups of fewer than two have only n.
    """
    both = rungs.filter(F.col(true).isNotNull() & F.col(estimate).isNotNull() & ~F.isnan(F.col(true).cast("double")) & ~F.isnan(F.col(estimate).cast("double")))
    base = both.groupBy(*by).agg(F.min(F.struct(F.abs(true), F.col(rung), F.col(estimate).alias("e"), F.col(true).alias("s"))).alias("__z"))
    error = (F.col(estimate) - F.col("__z.e")) - (F.col(true) - F.col("__z.s"))
    rows = both.join(base, by).withColumn("__d", error)
    enough = F.count("*") >= 2
    measures = {"rms": F.sqrt(F.avg(F.col("__d") * F.col("__d"))), "max_abs": F.max(F.abs("__d")), "slope": F.regr_slope(estimate, true), "implied_bias": F.avg(F.col(estimate) - F.col(true))}
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.when(enough, m).alias(name) for name, m in measures.items()])


def ratio_range(rows: DataFrame, by: list[str], ratio: Column) -> DataFrame:
    """``(by..., middle, least, most, n)`` of a ratio; of an even number the upper of the two middle values. Nulls are left out.

    The middle is found in the cumulated counts of distinct values, not in a buffer of values.
    """
    counts = rows.select(*by, ratio.alias("__r")).filter("__r is not null").groupBy(*by, "__r").agg(F.count("*").alias("__k"))
    before = F.coalesce(F.sum("__k").over(Window.partitionBy(*by).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = counts.withColumn("__before", before)
    sizes = counts.groupBy(*by).agg(F.sum("__k").alias("n"), F.min("__r").alias("least"), F.max("__r").alias("most"))
    place = F.floor(F.col("n") / 2)
    middle = ranked.join(sizes, by).filter((F.col("__before") <= place) & (place < F.col("__before") + F.col("__k")))
    return middle.select(*by, F.col("__r").alias("middle"), "least", "most", "n")


def quiet_positions(positions: DataFrame, events: DataFrame, on: str, at: str, t: str, guard: int) -> DataFrame:
    """The positions without an event of their key within ``guard`` ticks."""
    near = band_join(positions.select(on, at).distinct(), events.select(on, F.col(t).alias("__t")), at, "__t", -guard, guard, [on]).select(on, at)
    return positions.join(near, [on, at], "left_anti")


def consensus(pairs: DataFrame, by: list[str], offset: str) -> DataFrame:
    """Pairs whose offset is the commonest of their group (the least of equally common ones), with ``n_pairs`` and ``n_agree`` of the group."""
    counts = pairs.groupBy(*by, offset).agg(F.count("*").alias("__k"))
    best = counts.groupBy(*by).agg(F.sum("__k").alias("n_pairs"), F.max(F.struct(F.col("__k"), (-F.col(offset)).alias("__o"))).alias("__m"))
    agreed = best.select(*by, "n_pairs", F.col("__m.__k").alias("n_agree"), (-F.col("__m.__o")).alias(offset))
    return pairs.join(agreed, [*by, offset])


def select_cut(curve: DataFrame, key: str, cut: str, n: str, ratio: str, most: float, least: int) -> DataFrame:
    """Of a key's cuts with a ratio of at most ``most`` and at least ``least`` events the lowest: ``(key, cut, n, ratio)``."""
    good = curve.filter((F.col(ratio) <= most) & (F.col(n) >= least))
    return good.groupBy(key).agg(F.min(F.struct(cut, n, ratio)).alias("m")).select(key, f"m.{cut}", f"m.{n}", f"m.{ratio}")
