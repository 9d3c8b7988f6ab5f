"""Identity over time: clusters of consecutive windows linked to tracks, and units of sessions matched with measured errors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.lineage import shared_root
from pulsegrid.operators.models import separation
from pulsegrid.operators.pairs import cosine, mutual_best
from pulsegrid.operators.records import final_units
from pulsegrid.operators.statistics import numbered, running_counts


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of two arrays of one length; null where one is flat."""
    centred = lambda v: F.transform(v, lambda x: x.cast("double") - F.aggregate(v, F.lit(0.0), lambda s, y: s + y.cast("double")) / F.size(v))
    return cosine(centred(a), centred(b))


def window_links(nodes: DataFrame, window: str, node: str, wave: str, least: float, gaps: int = 0, by: list[str] | None = None) -> DataFrame:
    """``(a, b, step, r)``: links between clusters of windows ``step`` apart, by the correlation of their waveforms.

    Clusters of consecutive windows are linked where each is the other's best (of equal ones the lesser node) and the correlation is at least ``least``. Then those
    that still have no successor are tried with those without predecessor one window further on, up to ``gaps`` windows between. So a node has at most
    one link to each side, and a track has at most one member of a window. Only nodes with the same ``by`` columns (a channel, a cell of a grid) meet; nodes without a wave
    have no link.
    """
    by = by or []
    shared_root(nodes.sparkSession)
    held = nodes.select(*by, F.col(window).alias("w"), F.col(node).alias("n"), F.col(wave).alias("v")).filter("v is not null and w is not null").checkpoint()
    links = None
    for step in range(1, gaps + 2):
        left, right = held.toDF(*by, "w", "a", "va"), held.select(*by, (F.col("w") - step).alias("w"), F.col("n").alias("b"), F.col("v").alias("vb"))
        if links is not None:
            left, right = left.join(links.select("a"), "a", "left_anti"), right.join(links.select("b"), "b", "left_anti")
        pairs = left.join(right, [*by, "w"]).select("a", "b", F.lit(step).alias("step"), correlation(F.col("va"), F.col("vb")).alias("r")).filter("r is not null")
        found = mutual_best(pairs.withColumn("__q", F.round("r", 9)), "a", "b", "__q", least).drop("__q")
        links = (found if links is None else links.unionByName(found)).checkpoint()
    return links


def tracks(nodes: DataFrame, links: DataFrame, node: str) -> DataFrame:
    """``nodes`` with ``track``, the first node of its chain of ``links(a, b)``, and ``place``, how many links it is from there; by pointer doubling."""
    first = final_units(links.select(F.col("b").alias("unit"), F.col("a").alias("merged"))).select(F.col("unit").alias("__n"), "final", "depth")
    return nodes.join(first, F.col(node) == F.col("__n"), "left").select(*nodes.columns, F.coalesce("final", node).alias("track"), F.coalesce("depth", F.lit(0)).alias("place"))


def lifetimes(tracked: DataFrame, window: str, n_windows: int, size: str, share: float = 0.7) -> DataFrame:
    """``(track, n_windows, first, last, n_missing, total, long_lived)``: how many windows a track is in, of which it misses some between, and whether that is at least ``share`` of all."""
    n = F.count("*")
    return tracked.groupBy("track").agg(
        n.alias("n_windows"), F.min(window).alias("first"), F.max(window).alias("last"), (F.max(window) - F.min(window) + 1 - n).alias("n_missing"), F.sum(size).alias("total"), (n >= share * n_windows).alias("long_lived")
    )


def pair_score(pairs: DataFrame, features: list[str], true: str) -> tuple[DataFrame, np.ndarray]:
    """``pairs`` with ``score``, the projection on the unit direction that best tells true pairs from others (Fisher), and that direction."""
    weights = np.array(separation(pairs.select(F.col(true).cast("int").alias("__true"), *features), "__true", features).first().weights)
    weights = weights / np.sqrt(weights @ weights)
    score = sum((float(w) * F.col(f) for w, f in zip(weights, features)), F.lit(0.0))
    return pairs.withColumn("score", score), weights


def orphan(unit: str | Column, share: int = 2) -> Column:
    """Whether a unit's partner is withheld in calibration: one in ``share``, by the md5 of its name."""
    c = F.col(unit) if isinstance(unit, str) else unit
    return F.conv(F.substring(F.md5(c.cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % share == 0


def calibration(pairs: DataFrame, units: DataFrame, thresholds: list[float], share: int = 2) -> DataFrame:
    """``(threshold, n_units, n_matched, n_right, recall, precision, n_orphans, n_orphans_matched, orphan_rate)`` of matching a session's halves.

    ``pairs(a, b, score)`` are candidate pairs of units of the first and second half, where the truth is a = b, and ``units(unit)`` all units with both halves. Recall and precision are those
    of mutual best pairs at or above a threshold. As a control one unit in ``share`` loses its partner in the second half: an orphan that is matched all the same
    is matched to another unit, which precision alone does not show, since there its partner could take it.
    """
    found = mutual_best(pairs, "a", "b", "score", float("-inf")).select("a", "b", "score", F.lit("all").alias("kind"))
    bereft = mutual_best(pairs.filter(~orphan("b", share)), "a", "b", "score", float("-inf")).filter(orphan("a", share)).select("a", "b", "score", F.lit("orphan").alias("kind"))
    cuts = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    each = found.unionByName(bereft).select("*", cuts).filter("score >= threshold")
    counts = each.groupBy("threshold").agg(
        F.count_if(F.col("kind") == "all").alias("n_matched"), F.count_if((F.col("kind") == "all") & (F.col("a") == F.col("b"))).alias("n_right"), F.count_if(F.col("kind") == "orphan").alias("n_orphans_matched")
    )
    totals = units.agg(F.count("*").alias("n_units"), F.count_if(orphan("unit", share)).alias("n_orphans")).select("*", cuts)
    out = totals.join(counts, "threshold", "left").fillna(0, ["n_matched", "n_right", "n_orphans_matched"])
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return out.select(
        "threshold", "n_units", "n_matched", "n_right", ratio("n_right", "n_units").alias("recall"), ratio("n_right", "n_matched").alias("precision"), "n_orphans", "n_orphans_matched", ratio("n_orphans_matched", "n_orphans").alias("orphan_rate")
    )


def least_threshold(calibrated: DataFrame, most_orphans: float) -> DataFrame:
    """The row of ``calibrated`` with the lowest threshold from which on no higher one matches more than a share of the orphans; none if there is none."""
    bad = calibrated.agg(F.max(F.when(F.col("orphan_rate") > most_orphans, F.col("threshold"))).alias("__bad"))
    ok = calibrated.join(F.broadcast(bad)).filter(F.col("__bad").isNull() | (F.col("threshold") > F.col("__bad"))).drop("__bad")  # one row is broadcast
    return ok.orderBy("threshold").limit(1)


def chain_check(ab: DataFrame, bc: DataFrame, ac: DataFrame) -> DataFrame:
    """``(a, via, chain, direct, agrees)`` for each ``ab(a, b)`` that goes on in ``bc(b, c)``: where the two steps lead and where the direct match ``ac(a, c)`` does.

    ``direct`` and ``agrees`` are null where there is no direct match.
    """
    two = ab.select("a", F.col("b").alias("via")).join(bc.select(F.col("b").alias("via"), F.col("c").alias("chain")), "via")
    return two.join(ac.select("a", F.col("c").alias("direct")), "a", "left").select("a", "via", "chain", "direct", (F.col("chain") == F.col("direct")).alias("agrees"))


def chain_summary(checked: DataFrame) -> DataFrame:
    """``(n_chains, n_direct, n_agree, share)``, one row."""
    n = F.count("direct")
    return checked.agg(F.count("*").alias("n_chains"), n.alias("n_direct"), F.count_if("agrees").alias("n_agree"), F.when(n > 0, F.count_if("agrees") / n).alias("share"))


def accepted_equally(rows: DataFrame, by: list[str], scores: list[str], gate: str, true: str, tie: str) -> DataFrame:
    """``(by..., scorer, n_accepted, n_true, precision)``: scorers at as many accepted rows as a gate accepts, the only fair comparison.

    A scorer takes its highest rows; of equal scores the least ``tie``; missing scores come last. ``gate`` is a row of its own. Which rows are taken follows from counts of the
    distinct scores: only the rows of the score at which the number is reached are put in order. Both are done in pieces of a large group.
    """
    key = F.struct(*by, F.lit(0).alias("__all"))
    held = rows.select(key.alias("__g"), *scores, F.col(gate).alias("__gate"), F.col(true).cast("int").alias("__true"), F.col(tie).alias("__tie"))
    n = held.groupBy("__g").agg(F.count_if("__gate").alias("__k"), F.sum(F.when(F.col("__gate"), F.col("__true")).otherwise(0)).alias("__t"))
    value = lambda c: F.coalesce(F.when(F.isnan(F.col(c).cast("double")), None).otherwise(F.col(c).cast("double")), F.lit(float("-inf")))
    each = held.select("__g", "__true", "__tie", F.explode(F.array(*[F.struct(F.lit(c).alias("scorer"), value(c).alias("s")) for c in scores])).alias("x")).select("__g", "__true", "__tie", "x.*")
    counts = running_counts(each.withColumnRenamed("__g", "__key"), ["__key", "scorer"], "s", t="__true")
    above = (F.col("__total") - F.col("__before") - F.col("__n")).alias("before")
    placed = counts.select(F.col("__g.__key").alias("__g"), F.col("__g.scorer").alias("scorer"), F.col("__v").alias("s"), F.col("__n").alias("c"), "t", above).join(n, "__g").filter(F.col("before") < F.col("__k"))
    shared_root(rows.sparkSession)
    placed = placed.checkpoint()
    whole = placed.filter(F.col("before") + F.col("c") <= F.col("__k")).groupBy("__g", "scorer").agg(F.sum("c").alias("n"), F.sum("t").alias("t"))
    part = placed.filter(F.col("before") + F.col("c") > F.col("__k")).select("__g", "scorer", "s", (F.col("__k") - F.col("before")).alias("take"))
    level = each.join(part, ["__g", "scorer", "s"]).select(F.col("__g").alias("__key"), "scorer", "__true", "__tie", "take")
    last = numbered(level, ["__key", "scorer"], ["__tie"], "r").filter(F.col("r") < F.col("take")).withColumnRenamed("__key", "__g")
    last = last.groupBy("__g", "scorer").agg(F.count("*").alias("n"), F.sum("__true").alias("t"))
    own = n.select("__g", F.lit("gate").alias("scorer"), F.col("__k").alias("n"), F.col("__t").alias("t"))
    total = whole.unionByName(last).unionByName(own).groupBy("__g", "scorer").agg(F.sum("n").alias("n_accepted"), F.sum("t").alias("n_true"))
    return total.select(*[F.col("__g").getField(c).alias(c) for c in by], "scorer", "n_accepted", "n_true", F.when(F.col("n_accepted") > 0, F.col("n_true") / F.col("n_accepted")).alias("precision"))


def matched_draws(rows: DataFrame, by: list[str], stratum: str, key: str, draws: int, seed: int = 0, least: int = 1) -> DataFrame:
    """``(by..., draw, stratum, key)``: in each draw as many rows of every stratum as the smallest of its group has, by seeded md5 of the key.

    Groups whose smallest stratum has fewer than ``least`` rows, and groups of one stratum, have no rows. Only rows whose hash is low enough to be drawn are put in order: twice the
    share that is needed and a margin, and all of them where that is not enough.
    """
    sizes = rows.groupBy(*by, stratum).agg(F.count("*").alias("__size"))
    smallest = sizes.groupBy(*by).agg(F.min("__size").alias("__k"), F.count("*").alias("__strata")).filter((F.col("__strata") > 1) & (F.col("__k") >= least))
    need = sizes.join(smallest, by).select(*[F.col(c).alias(f"__b{i}") for i, c in enumerate(by)], F.col(stratum).alias("__st"), "__size", "__k")
    same = F.col(stratum) == F.col("__st")
    for i, c in enumerate(by):
        same &= F.col(c) == F.col(f"__b{i}")
    each = rows.select(*by, stratum, key).join(need, same).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    name = F.concat_ws("|", F.lit(str(seed)), F.col("draw").cast("string"), F.col(key).cast("string"))
    hashed = each.withColumn("__h", F.md5(name.cast("binary")))
    share = F.least(F.lit(1.0), 2 * F.col("__k") / F.col("__size") + 64 / F.col("__size"))
    low = F.conv(F.substring("__h", 1, 8), 16, 10).cast("long") < share * (1 << 32)
    w = [*by, "draw", stratum]
    near = hashed.filter(low)
    place = F.row_number().over(Window.partitionBy(*w).orderBy("__h", key))
    taken = near.withColumn("__r", place).filter(F.col("__r") <= F.col("__k")).select(*w, key, "__k")
    short = taken.groupBy(*w).agg(F.count("*").alias("__n"), F.first("__k").alias("__k")).filter(F.col("__n") >= F.col("__k")).select(*w)
    rest = hashed.join(short, w, "left_anti").withColumn("__r", place).filter(F.col("__r") <= F.col("__k"))
    return taken.join(short, w, "left_semi").select(*w, key).unionByName(rest.select(*w, key))


def person_periods(trials: DataFrame, keys: list[str], t0: str, event: str, end: str, width: int, horizon: int) -> DataFrame:
    """``(keys..., bin, at, imminent)``: a row for each bin of ``width`` from a trial's ``t0`` on while neither its event nor its end has come.

    ``at`` is the bin's end, ``imminent`` whether the event comes within ``horizon`` after it. A bin that the event or end cuts short is left out; trials without an event have only
    false rows; those without ``t0`` or end none.
    """
    stop = F.least(F.coalesce(F.col(event), F.col(end)), F.col(end))
    n = F.floor((stop - F.col(t0)) / width).cast("int")
    rows = trials.filter(n >= 1).withColumn("bin", F.explode(F.sequence(F.lit(0), n - 1)))
    at = F.col(t0) + (F.col("bin") + 1) * width
    return rows.select(*keys, "bin", at.alias("at"), F.coalesce((F.col(event) - at <= horizon) & (F.col(event) <= F.col(end)), F.lit(False)).alias("imminent"))
