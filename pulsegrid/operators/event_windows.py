"""Events around markers: first after, last before, counts in windows, responses against a base window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.bands import band_join


def first_after(markers: DataFrame, events: DataFrame, on: str, t_marker: str, t_event: str, slack: int = 0) -> DataFrame:
    """Each marker with ``found``, the time of the first event of the same key at or after it (less ``slack``); null if none.

    One pass over both tables in falling order of time instead of a range join: a running window keeps the nearest event.
    """
    a = markers.select("*", (F.col(t_marker) - slack).alias("__t"), F.lit(0).alias("__event"))
    b = events.select(F.col(on), F.col(t_event).alias("__t"), F.lit(1).alias("__event"))
    ahead = Window.partitionBy(on).orderBy(F.desc("__t"), F.desc("__event")).rowsBetween(Window.unboundedPreceding, -1)
    both = a.unionByName(b, allowMissingColumns=True)
    found = F.last(F.when(F.col("__event") == 1, F.col("__t")), ignorenulls=True).over(ahead)
    return both.withColumn("found", found).filter("__event = 0").drop("__t", "__event")


def last_before(markers: DataFrame, events: DataFrame, on: str, t_marker: str, t_event: str) -> DataFrame:
    """Each marker with ``found``, the time of the last event of the same key strictly before it; null if none."""
    a = markers.select("*", F.col(t_marker).alias("__t"), F.lit(0).alias("__event"))
    b = events.select(F.col(on), F.col(t_event).alias("__t"), F.lit(1).alias("__event"))
    behind = Window.partitionBy(on).orderBy("__t", "__event").rowsBetween(Window.unboundedPreceding, -1)
    both = a.unionByName(b, allowMissingColumns=True)
    found = F.last(F.when(F.col("__event") == 1, F.col("__t")), ignorenulls=True).over(behind)
    return both.withColumn("found", found).filter("__event = 0").drop("__t", "__event")


def window_counts(markers: DataFrame, events: DataFrame, on: list[str], marker: str, t_marker: str, t_event: str, windows: dict[str, tuple[int, int]]) -> DataFrame:
    """One row per marker: events in each half-open window [lo, hi) around it, all windows in one pass, zeros kept."""
    lo, hi = min(a for a, _ in windows.values()), max(b for _, b in windows.values())
    d = F.col(t_event) - F.col(t_marker)
    inside = lambda w: F.sum(((d >= w[0]) & (d < w[1])).cast("long"))
    near = band_join(markers.select(*on, marker, t_marker), events.select(*on, t_event), t_marker, t_event, lo, hi - 1, on)
    counts = near.groupBy(marker).agg(*[inside(w).alias(name) for name, w in windows.items()])
    return markers.select(*on, marker, t_marker).join(counts, marker, "left").fillna(0, list(windows))


def peristimulus(markers: DataFrame, events: DataFrame, on: list[str], t_marker: str, t_event: str, lo: int, hi: int, bin_width: int, by: list[str]) -> DataFrame:
    """``(by..., bin, n)``: events in each bin of [lo, hi) relative to their marker."""
    near = band_join(markers, events, t_marker, t_event, lo, hi - 1, on)
    b = F.floor((F.col(t_event) - F.col(t_marker) - lo) / bin_width).cast("long")
    return near.groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"))


def gaussian_smoothed(histogram: DataFrame, by: list[str], n_bins: int, sigma: float, value: str = "n") -> DataFrame:
    """``(by..., bin, smooth)``: a histogram smoothed over bins, the outer bins repeated beyond the ends."""
    import math

    reach = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    weights = [x / sum(raw) for x in raw]
    dense = histogram.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("bin", F.col(value).cast("double")))).alias("m"))
    dense = dense.withColumn("v", F.transform(F.sequence(F.lit(0), F.lit(n_bins - 1)), lambda i: F.coalesce(F.element_at("m", i.cast("long")), F.lit(0.0))))
    clamp = lambda i: F.greatest(F.least(i, F.lit(n_bins - 1)), F.lit(0))
    term = lambda i, k: F.get("v", clamp(i + (k - reach))) * weights[k]
    smooth = F.transform(F.sequence(F.lit(0), F.lit(n_bins - 1)), lambda i: sum((term(i, k) for k in range(1, len(weights))), term(i, 0)))
    return dense.select(*by, F.posexplode(smooth).alias("bin", "smooth"))


def paired_response(counts: DataFrame, by: list[str], base: str, response: str) -> DataFrame:
    """Per group: markers, mean base and response counts, mean difference, its sample deviation and paired t."""
    d = F.col(response) - F.col(base)
    out = counts.groupBy(*by).agg(F.count("*").alias("n_markers"), F.avg(base).alias("mean_base"), F.avg(response).alias("mean_response"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("sd_diff"))
    return out.withColumn("t", F.when(F.col("sd_diff") > 0, F.col("mean_diff") / (F.col("sd_diff") / F.sqrt("n_markers"))))


def trial_consistency(counts: DataFrame, by: list[str], value: str, least_total: int, least_active: int, most_top2: float) -> DataFrame:
    """Whether a group's counts come from enough trials: total, active trials, share of its two largest, and the verdict."""
    ranked = counts.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value))))
    out = ranked.groupBy(*by).agg(F.sum(value).alias("total"), F.count_if(F.col(value) > 0).alias("n_active"), F.sum(F.when(F.col("__r") <= 2, F.col(value)).otherwise(0)).alias("top"))
    share = F.when(F.col("total") > 0, F.col("top") / F.col("total")).otherwise(0.0)
    out = out.withColumn("top2_share", share).drop("top")
    ok = (F.col("total") >= least_total) & (F.col("n_active") >= least_active) & (F.col("top2_share") <= most_top2)
    return out.withColumn("consistent", ok)


def with_preceding(events: DataFrame, reference: DataFrame, on: str, t: str) -> DataFrame:
    """Adds ``preceding``, ticks since the last strictly earlier reference event of the key (null if none)."""
    return last_before(events, reference, on, t, t).withColumn("preceding", F.col(t) - F.col("found")).drop("found")

