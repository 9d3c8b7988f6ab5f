"""Work across the seams of a recording kept as blocks: windows cut whole, sliding templates, scan windows, waveform bases.

A block is ``(key..., t0, samples)`` on a grid: it begins at a multiple of ``block`` samples and is full but for the last
one. Only the samples near a seam are sent to the neighbouring blocks, so each place of a recording is worked on once,
by the block that holds it, with all the samples around it that it needs.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_halo(blocks: DataFrame, keys: list[str], t0: str, samples: str, block: int, before: int, after: int) -> DataFrame:
    """``(keys..., index, t0, n, lead, wide)``: blocks with up to ``before`` and ``after`` samples of their neighbours around them.

    ``lead`` is how many samples stand before the block's own ``n`` ones: fewer than ``before`` at the beginning. A halo may reach over several blocks; after a
    missing block it ends there, so nothing is joined across a gap. Null and empty blocks are left out.
    """
    held = blocks.select(*keys, F.col(t0).cast("long").alias("t0"), F.col(samples).alias("x")).filter(F.size("x") > 0).withColumn("index", F.expr(f"t0 div {block}"))
    reach = range(-(-(-after // block)), -(-before // block) + 1)
    size = F.size("x")
    first, last = F.col("t0"), F.col("t0") + size

    def piece(step: int) -> Column:
        """What the block ``step`` further on needs of this one: the samples in its halo."""
        to = (F.col("index") + step) * block
        lo, hi = F.greatest(first, to - before if step > 0 else to), F.least(last, to if step > 0 else to + block + after)
        lo = lo if step >= 0 else first
        return F.struct((F.col("index") + step).alias("to"), F.lit(-step).alias("step"), lo.alias("at"), F.slice("x", (lo - first + 1).cast("int"), F.greatest(hi - lo, F.lit(0)).cast("int")).alias("part"))

    own = F.struct(F.col("index").alias("to"), F.lit(0).alias("step"), first.alias("at"), F.col("x").alias("part"))
    pieces = held.select(*keys, F.explode(F.array(*[own if s == 0 else piece(s) for s in reach])).alias("p")).filter(F.size("p.part") > 0)
    gathered = pieces.groupBy(*keys, F.col("p.to").alias("index")).agg(F.sort_array(F.collect_list(F.struct("p.step", "p.at", "p.part"))).alias("__p"))
    # the unbroken run of pieces around the block's own one
    whole = gathered.withColumn("__m", F.filter("__p", lambda p: p["step"] == 0)).filter(F.size("__m") == 1).withColumn("__own", F.get("__m", F.lit(0)))
    joined = lambda a, b: a["at"] + F.size(a["part"]) == b["at"]
    start = F.struct(F.col("__own")["at"].alias("at"), F.col("__own")["part"].alias("part"))
    left = F.aggregate(F.reverse(F.filter("__p", lambda p: p["step"] < 0)), start, lambda acc, p: F.when(p["at"] + F.size(p["part"]) == acc["at"], F.struct(p["at"].alias("at"), F.concat(p["part"], acc["part"]).alias("part"))).otherwise(acc))
    right = F.aggregate(F.filter("__p", lambda p: p["step"] > 0), F.col("__left"), lambda acc, p: F.when(joined(acc, p), F.struct(acc["at"].alias("at"), F.concat(acc["part"], p["part"]).alias("part"))).otherwise(acc))
    out = whole.withColumn("__left", left).withColumn("__w", right)
    return out.select(*keys, "index", F.col("__own.at").alias("t0"), F.size("__own.part").alias("n"), (F.col("__own.at") - F.col("__w.at")).cast("int").alias("lead"), F.col("__w.part").alias("wide"))


def _around(blocks: DataFrame, events: DataFrame, keys: list[str], t0: str, samples: str, t: str, block: int, pre: int, post: int) -> DataFrame:
    """``events`` with ``__wide``, the samples around their block, and ``__from``, where these begin."""
    wide = with_halo(blocks, keys, t0, samples, block, pre, post)
    wide = wide.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)], F.col("index").alias("__index"), (F.col("t0") - F.col("lead")).alias("__from"), F.col("wide").alias("__wide"))
    same = F.expr(f"`{t}` div {block}") == F.col("__index")
    for i, c in enumerate(keys):
        same &= F.col(c) == F.col(f"__k{i}")
    return events.join(wide, same, "left")


def cut_windows(blocks: DataFrame, events: DataFrame, keys: list[str], t0: str, samples: str, t: str, block: int, pre: int, post: int, base: int = 0) -> DataFrame:
    """``events`` with ``window``: the samples from ``pre`` before an event to ``post`` after it (not included), whole over seams.

    With ``base`` the mean of the window's first ``base`` samples is taken off. A window that leaves the recording or meets a gap is null, as is that of an event
    whose block is not there. All in the JVM: one shuffle of the blocks and one of the events by block.
    """
    at = F.col(t) - pre - F.col("__from")
    window = F.when((at >= 0) & (at + pre + post <= F.size("__wide")), F.slice("__wide", (at + 1).cast("int"), pre + post).cast("array<double>"))
    rows = _around(blocks, events, keys, t0, samples, t, block, pre, post).withColumn("__v", window)
    level = F.aggregate(F.slice("__v", 1, base), F.lit(0.0), lambda s, x: s + x) / base if base else F.lit(0.0)
    return rows.withColumn("__level", level).withColumn("window", F.transform("__v", lambda x: x - F.col("__level"))).select(*events.columns, "window")


def window_features(cuts: DataFrame, window: str = "window") -> DataFrame:
    """``cuts`` with ``trough`` (least sample), ``p2t`` (from the trough to the largest sample after it), ``energy`` (of all samples) and ``width`` (samples between the two)."""
    w = F.col(window)
    low = F.array_min(w)
    tail = F.slice(w, F.array_position(w, low).cast("int"), F.size(w))
    peak = F.array_max(tail)
    return cuts.select("*", low.alias("trough"), (peak - low).alias("p2t"), F.aggregate(w, F.lit(0.0), lambda s, x: s + x * x).alias("energy"), (F.array_position(tail, peak) - 1).alias("width"))


def scan_windows(bursts: DataFrame, key: str, pad: int, lengths: DataFrame, n: int, length: int, seed: int = 0) -> DataFrame:
    """``(key, t0, t1, kind)``: every burst ``(key, t0, t1)`` with ``pad`` around it, and ``n`` windows of ``length`` for each row of ``lengths(key, total)``.

    A drawn window begins at the md5 of seed, key and its number, modulo the places there are; so it is the same in every run and on every task. Windows are cut at
    the recording's ends.
    """
    total = lengths.select(F.col(key).alias("__key"), "total")
    around = bursts.join(total, F.col(key) == F.col("__key")).select(key, F.greatest(F.col("t0") - pad, F.lit(0)).alias("t0"), F.least(F.col("t1") + pad, "total").alias("t1"), F.lit("burst").alias("kind"))
    name = F.concat_ws("|", F.lit(str(seed)), F.col("__key").cast("string"), F.col("__i").cast("string"))
    start = F.conv(F.substring(F.md5(name.cast("binary")), 1, 12), 16, 10).cast("long") % F.greatest(F.col("total") - length, F.lit(1))
    drawn = total.withColumn("__i", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("t0", start)
    return around.unionByName(drawn.select(F.col("__key").alias(key), "t0", F.least(F.col("t0") + length, "total").alias("t1"), F.lit("drawn").alias("kind")))


def filter_scores(blocks: DataFrame, keys: list[str], t0: str, samples: str, block: int, template: np.ndarray, chan: str | None = None) -> DataFrame:
    """``(keys..., t0, scores)``: the sliding product of a template of unit norm with a recording, at every place where the template fits.

    ``template`` has a row for each channel 0, 1, ... in ``chan`` if there is one: products add up over channels, where all of them are there. A task holds a batch of
    blocks with all their channels and the template.
    """
    shape = np.atleast_2d(np.asarray(template, float))
    shape = shape / (np.linalg.norm(shape) + 1e-9)
    width = shape.shape[1]
    wide = with_halo(blocks if chan is None else blocks.filter(F.col(chan).between(0, len(shape) - 1)), keys + ([chan] if chan else []), t0, samples, block, 0, width - 1)
    if chan is None:
        held = wide.select(*keys, "t0", F.array(F.struct(F.lit(0).alias("c"), "wide", "n")).alias("__c"))
    else:
        held = wide.groupBy(*keys, "index").agg(F.min("t0").alias("t0"), F.collect_list(F.struct(F.col(chan).cast("int").alias("c"), "wide", "n")).alias("__c"))
    fits = (F.size("__c") == len(shape)) & (F.size(F.array_distinct(F.transform("__c", lambda c: F.least(c["n"], F.size(c["wide"]) - (width - 1))))) == 1)
    held = held.filter(F.forall("__c", lambda c: F.size(c["wide"]) >= width) & fits).select(*keys, "t0", F.transform(F.sort_array("__c"), lambda c: c["wide"]).alias("__w"), F.least(F.get("__c", F.lit(0))["n"], F.size(F.get("__c", F.lit(0))["wide"]) - (width - 1)).alias("__n"))

    @F.pandas_udf("array<double>")
    def score(waves: pd.Series, n: pd.Series) -> pd.Series:
        # blocks of one length at once; a place adds up the same products in the same order whatever block holds it
        sizes = np.array([[len(x) for x in w] for w in waves]).reshape(len(waves), len(shape))
        out: list[np.ndarray | None] = [None] * len(waves)
        kinds, which = np.unique(np.column_stack([sizes, n.to_numpy()]), axis=0, return_inverse=True)
        for k, (*_, places) in enumerate(kinds):
            at = np.flatnonzero(which.ravel() == k)
            total = np.zeros((len(at), int(places)))
            for c, weights in enumerate(shape):
                x = np.array([waves.iat[i][c] for i in at], float)
                for j, w in enumerate(weights):
                    total += w * x[:, j : j + int(places)]
            for i, row in zip(at, total):
                out[i] = row
        return pd.Series(out, dtype=object)

    return held.select(*keys, "t0", score("__w", "__n").alias("scores"))


def local_peaks(scores: DataFrame, keys: list[str], block: int) -> DataFrame:
    """``(keys..., pos, score)``: places higher than the one before and no lower than the one after; the two ends are none."""
    wide = with_halo(scores, keys, "t0", "scores", block, 1, 1)
    at = lambda i: F.get("wide", i)
    own = F.sequence(F.col("lead"), F.col("lead") + F.col("n") - 1)
    peaks = F.filter(own, lambda i: (i > 0) & (i < F.size("wide") - 1) & (at(i - 1) < at(i)) & (at(i) >= at(i + 1)))
    found = wide.withColumn("__i", F.explode(peaks))
    return found.select(*keys, (F.col("t0") - F.col("lead") + F.col("__i")).alias("pos"), at(F.col("__i")).alias("score"))


def separated(peaks: DataFrame, keys: list[str], distance: int, stretch: int = 1 << 20) -> DataFrame:
    """The peaks that stay when the highest are taken first and those less than ``distance`` from a taken one go; of equally high ones the earlier is taken.

    A peak that is the highest within the distance is taken whatever else is, and those near it go. What is left between two of these does not influence what lies
    beyond, so each such segment is judged for itself, many in a batch. A train is worked on in stretches that overlap by two distances; a long ramp without such a peak is one segment.
    """
    rank = F.struct(F.col("score").alias("s"), (-F.col("pos")).alias("p"))
    first, last = F.expr(f"(pos - {2 * distance}) div {stretch}"), F.expr(f"(pos + {2 * distance}) div {stretch}")
    spread = peaks.withColumn("__part", F.explode(F.sequence(first, last)))
    near = Window.partitionBy(*keys, "__part").orderBy("pos").rangeBetween(-(distance - 1), distance - 1)
    marked = spread.withColumn("__top", F.max(rank).over(near) == rank)
    marked = marked.withColumn("__gone", F.max(F.col("__top").cast("int")).over(near) == 1).filter(F.col("__part") == F.expr(f"pos div {stretch}"))
    ahead = Window.partitionBy(*keys).orderBy("pos")
    segments = marked.filter("__top or not __gone").withColumn("__segment", F.coalesce(F.last(F.when(F.col("__top"), F.col("pos")), True).over(ahead), F.lit(-1)))
    columns = [*keys, "pos", "score"]

    @F.pandas_udf("array<int>")
    def take(places: pd.Series, scores: pd.Series) -> pd.Series:
        out = []
        for pos, score in zip(places, scores):
            taken: list[int] = []  # in order, so that only the two neighbours of a place can be near
            kept = []
            for i in np.lexsort((pos, -score)):
                k = bisect.bisect(taken, pos[i])
                if (not k or pos[i] - taken[k - 1] >= distance) and (k == len(taken) or taken[k] - pos[i] >= distance):
                    taken.insert(k, int(pos[i]))
                    kept.append(int(i))
            out.append(kept)
        return pd.Series(out, dtype=object)

    rest = segments.filter("not __top").groupBy(*keys, "__segment").agg(F.collect_list("pos").alias("__pos"), F.collect_list("score").alias("__score"))
    rest = rest.select(*keys, "__pos", "__score", F.explode(take("__pos", "__score")).alias("__i"))
    rest = rest.select(*keys, F.get("__pos", "__i").alias("pos"), F.get("__score", "__i").alias("score"))
    return segments.filter("__top").select(columns).unionByName(rest)


def matched_candidates(scores: DataFrame, events: DataFrame, keys: list[str], t: str, block: int, near: int, distance: int, share: float = 0.0, least: int = 5) -> tuple[DataFrame, DataFrame]:
    """What a matched filter accepts and what it proposes: ``(keys..., t, at, score)`` and ``(keys..., pos, score)``.

    The first is a row for each event that has scores within ``near`` of its onset ``t``: the highest of them (the first of equal ones) and its place. The second are the
    peaks at ``distance`` or more from each other that are further than ``near`` from all of these places and, where a key has ``least`` accepted events,
    at least ``share`` of their mean.
    """
    held = _around(scores, events.select(*keys, t), keys, "t0", "scores", t, block, near, near + 1)
    lo = F.greatest(F.col(t) - near - F.col("__from"), F.lit(0))
    part = F.slice("__wide", (lo + 1).cast("int"), F.greatest(F.least(F.col(t) + near + 1 - F.col("__from"), F.size("__wide")) - lo, F.lit(0)).cast("int"))
    best = held.withColumn("__s", part).filter(F.size("__s") > 0)
    accepted = best.select(*keys, t, (F.col("__from") + lo + F.array_position("__s", F.array_max("__s")) - 1).alias("at"), F.array_max("__s").alias("score"))
    found = separated(local_peaks(scores, keys, block), keys, distance)
    # places within the distance, as equal keys of place and offset; there are 2 near + 1 offsets
    taken = accepted.select(*keys, F.explode(F.sequence(F.col("at") - near, F.col("at") + near)).alias("pos")).distinct()
    floor = accepted.groupBy(*keys).agg(F.when(F.count("*") >= least, share * F.avg("score")).alias("__floor"))
    free = found.join(taken, [*keys, "pos"], "left_anti").join(floor, keys, "left") if keys else found
    return accepted, free.filter(F.col("__floor").isNull() | (F.col("score") >= F.col("__floor"))).select(*keys, "pos", "score")


def basis(waves: DataFrame, wave: str, components: int = 2, parts: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """``(mean, components)`` of the waves: the directions of most variance, from one scan's sums of samples and of their products.

    Each component is negative at the mean's least sample (the first of equal ones; where it is 0 there, at its largest entry), so that the sign is fixed; of equal singular values the order is numpy's.
    Partial sums are added in ``parts`` tasks; what the driver solves is a matrix of the wave's length. Null waves and those with nulls or NaN are left out.
    """
    whole = waves.select(F.col(wave).cast("array<double>").alias("x")).filter(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)))

    def add(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if len(batch):
                x = np.stack(batch["x"].to_list())
                z = np.column_stack([np.ones(len(x)), x])
                total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            yield pd.DataFrame({"sums": [total.ravel()]})

    each = whole.mapInPandas(add, "sums array<double>").select(F.posexplode("sums").alias("i", "s")).repartition(parts, "i").groupBy("i").agg(F.sum("s").alias("s"))
    sums = np.array([r.s for r in each.orderBy("i").collect()])  # (length + 1)^2 numbers
    if not len(sums):
        raise ValueError("no waves")
    d = int(round(np.sqrt(len(sums)))) - 1
    sums = sums.reshape(d + 1, d + 1)
    n, mean = sums[0, 0], sums[0, 1:] / sums[0, 0]
    values, vectors = np.linalg.eigh(sums[1:, 1:] - n * np.outer(mean, mean))
    found = vectors[:, ::-1][:, :components].T.copy()
    trough = int(np.argmin(mean))
    for v in found:
        at = trough if abs(v[trough]) > 1e-12 else int(np.argmax(np.abs(v)))
        if v[at] > 0:
            v *= -1
    return mean, found


def project(waves: DataFrame, wave: str, mean: np.ndarray, components: np.ndarray, name: str = "pc") -> DataFrame:
    """``waves`` with ``pc1``, ``pc2``, ...: a wave less the mean along each component, in the JVM."""
    off = F.zip_with(F.col(wave), F.array(*map(F.lit, mean.tolist())), lambda x, m: x - m)
    along = lambda v: F.aggregate(F.zip_with("__off", F.array(*map(F.lit, v.tolist())), lambda x, c: x * c), F.lit(0.0), lambda s, x: s + x)
    rows = waves.withColumn("__off", off)
    return rows.select(*waves.columns, *[along(v).alias(f"{name}{k}") for k, v in enumerate(components, 1)])
