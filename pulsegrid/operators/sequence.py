"""Per-key ordered event trains: intervals, regularity, gaps, sessions, pauses, thinning, bursts.

Times are whole numbers (ticks); ``key`` names the column of the train, ``t`` that of the time.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Neighbouring islands that are dealt together.
ISLANDS = 4096


def ordered(key: str, t: str, *ties: str) -> Window:
    return Window.partitionBy(key).orderBy(t, *ties)


def with_interval(events: DataFrame, key: str, t: str, *ties: str) -> DataFrame:
    """Adds ``isi``, the ticks since the previous event of the key (null for the first)."""
    return events.withColumn("isi", F.col(t) - F.lag(t).over(ordered(key, t, *ties)))


def interval_statistics(events: DataFrame, key: str, t: str, refractory: int, ticks_per_s: float) -> DataFrame:
    """One row per key: events, mean interval, CV (population), LV, share of intervals below ``refractory``.

    CV and LV are null below 3 events; the share is 0 below 2.
    """
    w = ordered(key, t)
    isi = with_interval(events, key, t).withColumn("before", F.lag("isi").over(w))
    s = F.col("isi") / ticks_per_s
    step = F.pow((F.col("before") - F.col("isi")) / (F.col("before") + F.col("isi") + 1e-12 * ticks_per_s), 2)
    out = isi.groupBy(key).agg(
        F.count("*").alias("n_events"), F.avg(s).alias("mean_interval"), (F.stddev_pop(s) / (F.avg(s) + 1e-12)).alias("cv"), (3 * F.avg(step)).alias("lv"),
        F.coalesce(F.avg((F.col("isi") < refractory).cast("double")), F.lit(0.0)).alias("refractory_rate"),
    )
    few = F.col("n_events") < 3
    return out.withColumn("cv", F.when(~few, F.col("cv"))).withColumn("lv", F.when(~few, F.col("lv")))


def window_rates(events: DataFrame, key: str, t: str, width: int, duration: int, ticks_per_s: float) -> DataFrame:
    """Mean rate over ``duration`` ticks and CV of the rate over all windows of ``width``, empty ones included.

    Nothing is filled in: the moments of the empty windows follow from their number.
    """
    n_windows = -(-duration // width)
    last = F.least(F.floor(F.col(t) / width), F.lit(n_windows - 1))
    counts = events.groupBy(key, last.alias("window")).agg(F.count("*").alias("n"))
    sums = counts.groupBy(key).agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    seconds = width / ticks_per_s
    mean = F.col("total") / n_windows / seconds
    var = F.greatest(F.col("squares") / n_windows / seconds**2 - mean * mean, F.lit(0.0))
    return sums.select(key, F.col("total").alias("n_events"), (F.col("total") / (duration / ticks_per_s)).alias("mean_rate"), F.when(F.col("total") >= 2, F.sqrt(var) / (mean + 1e-9)).alias("rate_cv"))


def gaps(events: DataFrame, key: str, t: str, longer_than: int) -> DataFrame:
    """Intervals longer than a limit: ``(key, t0, t1, missing)``."""
    w = ordered(key, t)
    return events.select(key, F.lag(t).over(w).alias("t0"), F.col(t).alias("t1")).filter(F.col("t1") - F.col("t0") > longer_than).withColumn("missing", F.col("t1") - F.col("t0"))


def with_session(events: DataFrame, key: str, t: str, gap: int, *ties: str) -> DataFrame:
    """Adds ``session``: 0, 1, ... along each key, a new one after every interval longer than ``gap``."""
    w = ordered(key, t, *ties)
    new = F.coalesce((F.col(t) - F.lag(t).over(w) > gap).cast("int"), F.lit(0))
    return events.withColumn("__new", new).withColumn("session", F.sum("__new").over(w)).drop("__new")


def sessions(events: DataFrame, key: str, t: str, gap: int) -> DataFrame:
    return with_session(events, key, t, gap).groupBy(key, "session").agg(F.min(t).alias("t0"), F.max(t).alias("t1"), F.count("*").alias("n_events"))


def changes(events: DataFrame, key: str, t: str, value: str, *ties: str) -> DataFrame:
    """Events whose value differs from the previous one of the key: ``(key, t, was, now)``."""
    was = F.lag(value).over(ordered(key, t, *ties))
    return events.select(key, t, was.alias("was"), F.col(value).alias("now")).filter("was is not null and was <> now")


def rolling_median(rows: DataFrame, key: str, order: list[str], value: str, width: int, name: str = "local_median") -> DataFrame:
    """Median of ``width`` rows around each row, fewer at the ends; an even width leans to the past."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-(width // 2), (width - 1) // 2)
    return rows.withColumn(name, F.percentile(value, F.lit(0.5)).over(w))


def pauses(events: DataFrame, key: str, t: str, width: int, factor: float, rebound: int, *ties: str) -> DataFrame:
    """Intervals longer than ``factor`` local medians: ``(key, t0, t1, n_rebound)``.

    ``n_rebound`` counts the events in (t1, t1 + rebound], by a window over the same order, not a join.
    """
    rows = with_interval(events, key, t, *ties).withColumn("t0", F.lag(t).over(ordered(key, t, *ties)))
    after = Window.partitionBy(key).orderBy(t).rangeBetween(1, rebound)
    rows = rows.withColumn("n_rebound", F.count("*").over(after)).filter("isi is not null")
    rows = rolling_median(rows, key, [t, *ties], "isi", width)
    return rows.filter(F.col("isi") > factor * (F.col("local_median") + 1e-12)).select(key, "t0", F.col(t).alias("t1"), "n_rebound")


def thin(events: DataFrame, key: str, t: str, dead: int, depth: str | None = None) -> DataFrame:
    """Events left when those less than ``dead`` ticks after a kept one go; events without a time are left out.

    With ``depth`` the lower of two close events stays instead, in the place of the kept one; no depth is the greatest. Islands
    of events closer than ``dead`` do not influence each other, so a long train is dealt to many tasks; these read
    their islands in order and hold one batch and the event kept last, however long an island is.
    """
    order = [F.col(t)] + ([F.col(depth).asc_nulls_last()] if depth else [])
    timed = with_session(events.filter(F.col(t).isNotNull()), key, t, dead - 1).withColumnRenamed("session", "__island")
    dealt = timed.withColumn("__deal", F.expr(f"__island div {ISLANDS}"))
    dealt = dealt.repartition(key, "__deal").sortWithinPartitions(key, "__deal", *order)
    columns = events.columns

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            if not rows.num_rows:
                continue
            islands = list(zip(rows[key].to_pylist(), rows["__island"].to_pylist()))
            times, depths = rows[t].to_pylist(), [math.inf if d is None else d for d in rows[depth].to_pylist()] if depth else None
            kept = [0]
            for i in range(1, len(times)):
                if islands[i] != islands[kept[-1]] or times[i] - times[kept[-1]] >= dead:
                    kept.append(i)
                elif depth and depths[i] < depths[kept[-1]]:
                    kept[-1] = i
            yield from rows.take(pa.array(kept[:-1], pa.int64())).select(columns).to_batches()
            held = rows.slice(kept[-1], 1).combine_chunks().to_batches()[0]
        if held is not None:
            yield held.select(columns)

    return dealt.mapInArrow(scan, events.schema)


#: Events that a run grows over.
REACH = 200
#: Events by which it grows at a time.
GROWTH = 16
_LOG_FACTORIAL = np.array([math.lgamma(i + 1) for i in range(2 * REACH)])


def surprises(k: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """-log10 P(N >= k) of Poisson counts, at most 300; k is at most REACH + 1, and 0 where the mean is not positive."""
    k, mean = np.broadcast_arrays(np.asarray(k, np.int64), np.asarray(mean, float))
    out = np.zeros(k.shape)
    some = (mean > 0) & (k > 0)
    k, mean = k[some], mean[some]
    if not len(k):
        return out
    log_mean = np.log(mean)[:, None]
    terms = np.arange(k.max() + 1)[None]
    below = np.exp(terms * log_mean - mean[:, None] - _LOG_FACTORIAL[terms])
    head = np.where(terms < k[:, None], below, 0.0).sum(axis=1)
    # where k exceeds the mean the terms from k on fall at least like a geometric series
    # from where the largest ratio falls below 1e-17 nothing is added to its sum
    largest = float(np.max(mean / (k + 1), where=k > mean, initial=0.0))
    steps = np.arange(1, 4 * REACH if largest > 0.95 else 2 + int(40 / -math.log(max(largest, 1e-17))))[None]
    ratios = np.where(k[:, None] > mean[:, None], mean[:, None] / (k[:, None] + steps), 0.0)
    tail = k * log_mean[:, 0] - mean - _LOG_FACTORIAL[k] + np.log1p(np.cumprod(ratios, axis=1).sum(axis=1))
    log10 = np.where(k > mean, tail / math.log(10), np.log10(np.maximum(1.0 - head, 1e-300)))
    out[some] = np.minimum(-log10, 300.0)
    return out


def surprise(k: int, rate: float, span: float) -> float:
    """Poisson surprise of k events within ``span`` seconds at ``rate`` a second."""
    return float(surprises(np.array([k]), np.array([rate * span]))[0])


def grown_run(times: np.ndarray, rate: float, seed: int, least: int) -> tuple[int, int, float]:
    """(first, last, surprise) of the run that grows from the first two of ``times``, at most REACH + 1 of them.

    Growth ends before the first interval of over three seeds that brings no new maximum, and the surprises of later beginnings are not looked at; the
    run ends at the first maximum so far, and begins at the first event whose loss would lower the surprise below it.
    """
    gaps, level = np.diff(times), np.zeros(0)
    for lo in range(0, len(gaps), GROWTH):
        n = np.arange(lo + 1, min(lo + GROWTH, len(gaps)) + 1)
        level = np.append(level, surprises(n + 1, rate * (times[n] - times[0])))
        before = np.append(-np.inf, np.maximum.accumulate(level)[:-1])
        stops = np.flatnonzero((level <= before) & (gaps[: len(level)] > 3 * seed))
        if len(stops):
            level = level[: stops[0]]
            break
    last = int(np.argmax(level)) + 1
    best = float(level[last - 1])
    first = np.arange(1, max(last - least + 2, 1))
    shorter = surprises(last - first + 1, rate * (times[last] - times[first])) >= best
    return int(len(shorter) if shorter.all() else np.argmin(shorter)), last, best


def bursts(events: DataFrame, key: str, t: str, seed: int, ticks_per_s: float, least: int = 3, least_surprise: float = 2.0) -> DataFrame:
    """Runs of short intervals grown to the greatest Poisson surprise: ``(key, t0, t1, n_events, surprise)``.

    A seed interval is shorter than ``seed`` ticks; a run grows as ``grown_run`` says, over at most REACH events after its first, and the next seed
    is looked for after it. Trains are read in order of time; a worker holds one batch and the REACH events that a run may still
    need, however long the train is.
    """
    rates = events.groupBy(key).agg(F.count("*").alias("__n"), F.min(t).alias("__a"), F.max(t).alias("__b"))
    rates = rates.filter((F.col("__b") > F.col("__a")) & (F.col("__n") > least)).select(F.col(key).alias("__key"), (F.col("__n") * ticks_per_s / (F.col("__b") - F.col("__a"))).alias("rate"))
    rows = events.select(key, t).filter(F.col(t).isNotNull()).join(rates, F.col(key) == F.col("__key")).select(key, t, "rate")
    names = [key, "t0", "t1", "n_events", "surprise"]

    def taken(unit, times: np.ndarray, rate: float, ended: bool) -> tuple[list[tuple], np.ndarray]:
        """Runs whose growth cannot be changed by later events, and the events that are left."""
        found, at = [], 0
        seeds = np.flatnonzero(np.diff(times) < seed)
        limit = len(times) if ended else len(times) - REACH - 1
        while (k := np.searchsorted(seeds, at)) < len(seeds) and seeds[k] < limit:
            at = int(seeds[k])
            first, last, best = grown_run(times[at : at + REACH + 1], rate / ticks_per_s, seed, least)
            if last - first + 1 >= least and best >= least_surprise:
                found.append((unit, int(times[at + first]), int(times[at + last]), last - first + 1, best))
            at += last + 1
        return found, times[max(at, min(limit, len(times))) if not ended else len(times) :] if len(times) > REACH or ended else times[at:]

    def scan(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        unit, held, rate = None, np.zeros(0, np.int64), 0.0
        for batch in batches:
            found = []
            for name, part in batch.groupby(key, sort=False):
                if name != unit:
                    found += taken(unit, held, rate, True)[0]
                    unit, held, rate = name, np.zeros(0, np.int64), float(part["rate"].iloc[0])
                more, held = taken(unit, np.concatenate([held, part[t].to_numpy(np.int64)]), rate, False)
                found += more
            yield pd.DataFrame(found, columns=names)
        yield pd.DataFrame(taken(unit, held, rate, True)[0], columns=names)

    dealt = rows.repartition(key).sortWithinPartitions(key, t)
    return dealt.mapInPandas(scan, f"{key} {events.schema[key].dataType.simpleString()}, t0 long, t1 long, n_events long, surprise double")


def first_per(rows: DataFrame, key: str, order: list[str | Column]) -> DataFrame:
    """The first row of each key, nulls kept."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")
