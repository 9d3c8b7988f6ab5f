"""Trials cut from coded events, events inside intervals, onsets, bursts by gaps, exclusive claims of partners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.bands import band_join
from pulsegrid.operators.lineage import shared_root
from pulsegrid.operators.sequence import ordered


def with_trial(events: DataFrame, key: str, t: str, kind: str, start: str, *ties: str) -> DataFrame:
    """Adds ``trial``: how often the start code has come along the key; 0 before the first."""
    w = ordered(key, t, *ties).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("trial", F.sum((F.col(kind) == start).cast("long")).over(w))


def trial_table(events: DataFrame, key: str, t: str, kind: str, end: str, codes: dict[str, str], *ties: str) -> DataFrame:
    """One row per trial of ``events`` (with ``trial``): start, first end code, first time of each other code, events, start of the next trial."""
    first = lambda code: F.min(F.when(F.col(kind) == code, F.col(t)))
    rows = events.filter("trial > 0").groupBy(key, "trial").agg(F.min(t).alias("t0"), first(end).alias("t_end"), *[first(c).alias(n) for n, c in codes.items()], F.count("*").alias("n_events"))
    return rows.withColumn("next_t0", F.lead("t0").over(Window.partitionBy(key).orderBy("trial")))


def in_intervals(events: DataFrame, intervals: DataFrame, on: str, t: str, t0: str, t1: str, margin: int = 0, width: int = 1, inside: bool = True) -> DataFrame:
    """Events within an interval of their key, widened by ``margin`` on both sides, or with ``inside`` false all others.

    Intervals are looked up by the time buckets of ``width`` that they touch, so a busy key is many keys and intervals may overlap;
    events with a null time are outside.
    """
    lo, hi = F.col(t0) - margin, F.col(t1) + margin
    places = F.sequence(F.floor(lo / width).cast("long"), F.floor(hi / width).cast("long"))
    wanted = intervals.filter(lo <= hi).select(F.col(on).alias("__on"), lo.alias("__lo"), hi.alias("__hi"), F.explode(places).alias("__b"))
    at = F.col(t)
    same = (F.col(on) == F.col("__on")) & (F.floor(at / width).cast("long") == F.col("__b")) & (at >= F.col("__lo")) & (at <= F.col("__hi"))
    return events.join(wanted, same, "left_semi" if inside else "left_anti")


def selected_events(events: DataFrame, windows: DataFrame, unit: str, t: str, width: int) -> DataFrame:
    """Events that a unit's closed windows ``(unit, t0, t1)`` select by ``t``; a unit without windows keeps all of its events.

    Only the windows decide, so no table of units times trials is built.
    """
    free = events.join(windows.select(unit).distinct(), unit, "left_anti")
    return free.unionByName(in_intervals(events, windows, unit, t, "t0", "t1", 0, width))


def priority_match(events: DataFrame, sources: dict[str, DataFrame], on: list[str], event_id: str, t: str, tolerance: int) -> DataFrame:
    """``(event_id, source)``: the first of the named sources, in their order, that has an event of the key within the tolerance; null if none has."""
    out = events.select(event_id)
    for name, other in sources.items():
        near = band_join(events.select(*on, event_id, F.col(t).alias("__t1")), other.select(*on, F.col(t).alias("__t2")), "__t1", "__t2", -tolerance, tolerance, on)
        out = out.join(near.select(event_id).distinct().withColumn(f"__{name}", F.lit(name)), event_id, "left")
    return out.select(event_id, F.coalesce(*[F.col(f"__{n}") for n in sources]).alias("source"))


def onset(bins: DataFrame, by: list[str], bin_col: str, value: str, threshold: float) -> DataFrame:
    """The first bin of each group from which on all values reach the threshold; null if the last does not."""
    later = Window.partitionBy(*by).orderBy(F.desc(bin_col)).rowsBetween(Window.unboundedPreceding, 0)
    holds = F.min(value).over(later) >= threshold
    return bins.withColumn("__h", holds).groupBy(*by).agg(F.min(F.when(F.col("__h"), F.col(bin_col))).alias("onset"))


def gap_bursts(events: DataFrame, key: str, t: str, longest_gap: int, *ties: str) -> DataFrame:
    """Adds ``run`` and ``position`` (from 1): events that follow each other within the gap are a run."""
    w = ordered(key, t, *ties)
    new = F.coalesce((F.col(t) - F.lag(t).over(w) > longest_gap).cast("long"), F.lit(1))
    rows = events.withColumn("__new", new).withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(key, "run").orderBy(t, *ties)))


def position_curve(runs: DataFrame, key: str, value: str, least: int, longest: int) -> DataFrame:
    """Mean, standard error and number of a value by position in runs of ``least`` events or more, up to position ``longest``."""
    size = F.count("*").over(Window.partitionBy(key, "run"))
    rows = runs.withColumn("__n", size).filter((F.col("__n") >= least) & (F.col("position") <= longest))
    return rows.groupBy(key, "position").agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("sem"))


def exclusive_claims(overlaps: DataFrame, ref: str, test: str, n: str, size: str, max_rounds: int = 1000) -> DataFrame:
    """``(ref, test, n)``: refs from the largest on each claim the unclaimed test that they overlap most.

    ``overlaps`` has a row for each pair with an overlap, and the ref's ``size``; ties go to the lesser name. Instead of one ref after another, all ask
    for the best test that has not refused them, and a test refuses all but the largest that asks: the outcome is the same, and
    the rounds are as many as refusals follow each other, not as many as refs.
    """
    open_pairs = overlaps.select(ref, test, n, size)
    shared_root(overlaps.sparkSession)
    wish = Window.partitionBy(ref).orderBy(F.desc(n), test)
    favour = Window.partitionBy(test).orderBy(F.desc(size), ref)
    for _ in range(max_rounds):
        asked = open_pairs.withColumn("__w", F.row_number().over(wish)).filter("__w = 1").drop("__w").withColumn("__f", F.row_number().over(favour)).checkpoint()
        refused = asked.filter("__f > 1").select(ref, test)
        if refused.isEmpty():
            return asked.select(ref, test, n)
        open_pairs = open_pairs.join(refused, [ref, test], "left_anti").checkpoint()
    raise RuntimeError("claims did not settle")


def split_merge(overlaps: DataFrame, ref: str, test: str, n: str, n_ref: str, part: float) -> DataFrame:
    """One row per ref: ``fragments`` (tests with at least ``part`` of it), the best test's ``recall``, whether that test is the best of another ref too, and a verdict."""
    share = F.col(n) / F.col(n_ref)
    best = Window.partitionBy(ref).orderBy(F.desc(n), test)
    rows = overlaps.withColumn("__s", share).withColumn("__r", F.row_number().over(best))
    out = rows.groupBy(ref).agg(F.count_if(F.col("__s") >= part).alias("fragments"), F.max(F.when(F.col("__r") == 1, F.col(test))).alias("best"), F.max("__s").alias("recall"))
    out = out.withColumn("merged", F.count("*").over(Window.partitionBy("best")) > 1)
    verdict = F.when(F.col("fragments") == 0, "none").when(F.col("fragments") > 1, F.when(F.col("merged"), "split and merged").otherwise("split")).when(F.col("merged"), "merged").otherwise("match")
    return out.withColumn("verdict", verdict)


def recorded_clock(events: DataFrame, key: str, t: str, longest_gap: int, *ties: str) -> DataFrame:
    """Adds ``clock``: the time since the key's first event without the gaps, a piecewise affine map of the time."""
    w = ordered(key, t, *ties)
    step = F.coalesce(F.col(t) - F.lag(t).over(w), F.lit(0))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("__s", F.when(step > longest_gap, 0).otherwise(step)).withColumn("clock", F.sum("__s").over(run)).drop("__s")


def sliding_windows(events: DataFrame, t: str, width: int, step: int) -> DataFrame:
    """Each event once for each window [start, start + width) that holds it, ``start`` being a multiple of ``step``."""
    last = F.floor(F.col(t) / step).cast("long")
    first = (F.floor((F.col(t) - width) / step) + 1).cast("long")
    return events.withColumn("window_start", F.explode(F.transform(F.sequence(first, last), lambda k: k * step)))


def fisher_score(values: Column, positive: Column) -> Column:
    """Squared distance of two classes' means over the sum of their variances; null where that is not positive."""
    of = lambda f, c: f(F.when(c, values))
    spread = of(F.var_samp, positive) + of(F.var_samp, ~positive)
    return F.when(spread > 0, F.pow(of(F.avg, positive) - of(F.avg, ~positive), 2) / spread)


def in_radius_or_all(sites: DataFrame, by: str, inside: Column, order: list[Column | str], n: int) -> DataFrame:
    """The first ``n`` rows of each group among those ``inside``, or among all of a group that has none inside."""
    some = F.max(inside.cast("int")).over(Window.partitionBy(by)) == 1
    rows = sites.withColumn("__keep", inside | ~some).filter("__keep").drop("__keep")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= n)
