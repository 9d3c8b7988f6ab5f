"""Curation and lineage: range unions, merge groups, verdict overlays, dense selections, checks."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Parts of a session up to which their table is broadcast.
MOST_PARTS = 10_000


def range_union(ranges: DataFrame, key: str, t0: str = "t0", t1: str = "t1") -> DataFrame:
    """Closed ranges of each key joined where they overlap or touch: ``(key, t0, t1)``."""
    before = Window.partitionBy(key).orderBy(t0, t1).rowsBetween(Window.unboundedPreceding, -1)
    w = Window.partitionBy(key).orderBy(t0, t1)
    rows = ranges.withColumn("__reach", F.max(t1).over(before))
    rows = rows.withColumn("__island", F.sum(F.when(F.col("__reach") >= F.col(t0), 0).otherwise(1)).over(w))
    return rows.groupBy(key, "__island").agg(F.min(t0).alias("t0"), F.max(t1).alias("t1")).drop("__island")


def merged_windows(merges: DataFrame, restrictions: DataFrame, session: tuple[int, int]) -> DataFrame:
    """Windows of merged units: the union of their parents', the whole session if a parent has no restriction.

    ``merges(merged, parent)``, ``restrictions(parent, t0, t1)``.
    """
    rows = merges.join(restrictions, "parent", "left")
    rows = rows.withColumn("t0", F.coalesce("t0", F.lit(session[0]))).withColumn("t1", F.coalesce("t1", F.lit(session[1])))
    return range_union(rows.select("merged", "t0", "t1"), "merged")


def clip_ranges(ranges: DataFrame, parts: DataFrame) -> DataFrame:
    """Ranges on the joined axis cut at the parts' borders and put on each part's own clock; empty pieces go.

    ``ranges(range_id, t0, t1)``, ``parts(part, start, stop)``: as many parts as a session has files.
    """
    few = F.broadcast(parts) if parts.count() <= MOST_PARTS else parts
    rows = ranges.join(few, (F.col("t1") > F.col("start")) & (F.col("t0") < F.col("stop")))
    lo, hi = F.greatest("t0", "start"), F.least("t1", "stop")
    return rows.select("range_id", "part", (lo - F.col("start")).alias("t0"), (hi - F.col("start")).alias("t1"))


def shared_root(spark: SparkSession) -> None:
    """Sees to a checkpoint folder: ``spark.checkpoint.dir``; a temporary one only where that is unset and all runs on one machine."""
    sc = spark.sparkContext
    if not (sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()):
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="pulsegrid-"))


def merge_groups(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, root)`` of the groups linked by ``edges(a, b)``; the root is the least member.

    Every round each node takes the least label around it and then its label's label; rounds are checkpointed.
    """
    shared_root(edges.sparkSession)
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a is not null and b is not null").distinct()
    both = both.checkpoint()
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("root")).checkpoint()
    for _ in range(rounds):
        seen = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        new = labels.join(seen, "node").select("node", F.least("root", "near").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("up"))
        new = new.join(jump, "root").select("node", F.least("root", "up").alias("root")).checkpoint()
        moved = new.join(labels.withColumnRenamed("root", "was"), "node").filter("root <> was").isEmpty()
        labels = new
        if moved:
            return labels
    raise RuntimeError("the groups did not settle")


def by_precedence(rows: DataFrame, key: str, label: str, sources: list[tuple[str, DataFrame]], own: str = "auto") -> DataFrame:
    """``rows`` with ``label`` from the first of ``sources``, pairs of a name and a table ``(key, label)``, that has one; else their own, which may be null.

    ``label_source`` names where it is from. Of several labels of one source the greatest counts; a null label or key is none.
    """
    for k, (_, df) in enumerate(sources):
        one = df.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias(f"__k{k}")).agg(F.max(label).alias(f"__l{k}"))
        rows = rows.join(one, F.col(key) == F.col(f"__k{k}"), "left")
    found = [F.col(f"__l{k}") for k in range(len(sources))]
    source = F.coalesce(*[F.when(c.isNotNull(), name) for c, (name, _) in zip(found, sources)], F.lit(own))
    new = F.coalesce(*found, F.col(label))
    return rows.withColumn("label_source", source).withColumn(label, new).drop(*[f"__{x}{k}" for k in range(len(sources)) for x in "kl"])


def overlay(rows: DataFrame, verdicts: DataFrame, key: str, label: str, verdict: str) -> DataFrame:
    """The label replaced where there is a verdict, with ``label_source``; of several verdicts the greatest counts."""
    one = verdicts.groupBy(key).agg(F.max(verdict).alias("__v"))
    out = rows.join(one, key, "left")
    return out.withColumn("label_source", F.when(F.col("__v").isNotNull(), "verdict").otherwise("automatic")).withColumn(label, F.coalesce("__v", label)).drop("__v")


def unknown_verdicts(rows: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """Verdicts on things that do not exist."""
    return verdicts.join(rows.select(key), key, "left_anti")


def dense_selection(units: DataFrame, trials: DataFrame, windows: DataFrame, unit: str, trial: str, t: str) -> DataFrame:
    """``(unit, trial, selected)`` for every unit and trial: inside a closed window of the unit, or the unit has none.

    The result is dense by definition: its rows are units times trials.
    """
    grid = units.select(unit).join(trials.select(trial, t), how="cross")
    inside = windows.select(unit, "t0", "t1").withColumn("__w", F.lit(1))
    hit = (F.col(t) >= F.col("t0")) & (F.col(t) <= F.col("t1"))
    rows = grid.join(inside, unit, "left").groupBy(unit, trial).agg(F.max(F.when(F.col("__w").isNull(), True).otherwise(hit)).alias("selected"))
    return rows


def shares(rows: DataFrame, key: str, n: str, dominant: float = 0.95) -> DataFrame:
    """Each row's share of its group's total, and whether it dominates."""
    share = F.col(n) / F.sum(n).over(Window.partitionBy(key))
    return rows.withColumn("share", share).withColumn("dominant", F.col("share") > dominant)


def coverage(expected: DataFrame, got: DataFrame, key: str) -> DataFrame:
    """``(key, problem)`` for keys that are missing, extra or duplicated; no row means all is well."""
    counts = got.groupBy(key).agg(F.count("*").alias("__n"))
    want = expected.select(key).distinct().withColumn("__want", F.lit(True))
    rows = want.join(counts, key, "full")
    problem = F.when(F.col("__n").isNull(), "missing").when(F.col("__want").isNull(), "extra").when(F.col("__n") > 1, "duplicated")
    return rows.select(key, problem.alias("problem")).filter("problem is not null")


def keep_first(rows: DataFrame, key: str, order: list) -> DataFrame:
    """One row per key, the first in order."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__r = 1").drop("__r")


def vetoed(groups: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Pairs judged "separate" that a merge group holds together: ``(root, a, b)``; "unsure" abstains."""
    apart = verdicts.filter("verdict = 'separate'").select("a", "b")
    ra = groups.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    rb = groups.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    return apart.join(ra, "a").join(rb, "b").filter("ra = rb").select(F.col("ra").alias("root"), "a", "b")
