"""Matching of two event sets within a tolerance: any, nearest, and one to one; scores of a match."""

from __future__ import annotations

import bisect
import math
from collections import deque
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.operators.bands import band_join
from pulsegrid.operators.sequence import ISLANDS


def any_match(ref: DataFrame, test: DataFrame, on: list[str], t: str, tolerance: int, by_ref: str, by_test: str) -> DataFrame:
    """``(on..., by_ref, by_test, n)``: pairs of events within the tolerance, an upper bound of any matching."""
    a = ref.select(*on, by_ref, F.col(t).alias("__t1"))
    b = test.select(*on, by_test, F.col(t).alias("__t2"))
    return band_join(a, b, "__t1", "__t2", -tolerance, tolerance, on).groupBy(*on, by_ref, by_test).agg(F.count("*").alias("n"))


def nearest_match(ref: DataFrame, test: DataFrame, on: list[str], t: str, tolerance: int, ref_id: str, test_id: str) -> DataFrame:
    """Each ref event that has one, with the nearest test event within the tolerance: ``(ref_id, test_id, dt)``.

    Of equally near events the earlier is taken, then the lesser id. One test event may serve several ref events.
    """
    a = ref.select(*on, ref_id, F.col(t).alias("__t1"))
    b = test.select(*on, F.col(test_id).alias("__test"), F.col(t).alias("__t2"))
    near = band_join(a, b, "__t1", "__t2", -tolerance, tolerance, on)
    dt = F.col("__t2") - F.col("__t1")
    best = near.groupBy(ref_id).agg(F.min(F.struct(F.abs(dt).alias("d"), F.col("__t2").alias("t"), F.col("__test").alias("i"), dt.alias("dt"))).alias("b"))
    return best.select(ref_id, F.col("b.i").alias(test_id), F.col("b.dt").alias("dt"))


def one_to_one(ref: DataFrame, test: DataFrame, on: str, t: str, tolerance: int) -> DataFrame:
    """``(on, t_ref, t_test)``: ref events in time order each take the nearest unused test event within the tolerance; of equally near ones the earlier.

    To look at the nearest unused event whatever its distance and drop it beyond the tolerance gives the same pairs. Events of both
    sides are cut into islands further apart than the tolerance, which cannot compete, so a long train is dealt to many tasks.
    These read events in order; a worker holds one batch and the events within twice the tolerance, however long an
    island is. Events without a time match nothing.
    """
    side = lambda df, n: df.filter(F.col(t).isNotNull()).select(F.col(on), F.col(t).cast("long").alias("__t"), F.lit(n).alias("__side"))
    w = Window.partitionBy(on).orderBy("__t")
    both = side(ref, 0).unionByName(side(test, 1))
    new = F.coalesce((F.col("__t") - F.lag("__t").over(w) > tolerance).cast("int"), F.lit(0))
    islands = both.withColumn("__new", new).withColumn("__island", F.sum("__new").over(w)).drop("__new")
    dealt = islands.withColumn("__deal", F.expr(f"__island div {ISLANDS}"))
    dealt = dealt.repartition(on, "__deal").sortWithinPartitions(on, "__deal", "__t")

    def settled(waiting: deque, free: list[int], until: float) -> list[tuple[int, int]]:
        """Pairs of the ref events that no test event from ``until`` on can reach; test events too early for later ones go."""
        pairs = []
        while waiting and waiting[0] + tolerance < until:
            r = waiting.popleft()
            del free[: bisect.bisect_left(free, r - tolerance)]
            at = bisect.bisect_left(free, r)
            near = [x for x in free[max(at - 1, 0) : at + 1] if abs(x - r) <= tolerance]
            if near:
                x = min(near, key=lambda v: (abs(v - r), v))
                free.pop(bisect.bisect_left(free, x))
                pairs.append((r, x))
        return pairs

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        now, waiting, free = None, deque(), []
        for batch in batches:
            found = []
            for name, x, kind, island in zip(*(batch.column(c).to_pylist() for c in (on, "__t", "__side", "__island"))):
                if (name, island) != now:
                    found += [(now, pair) for pair in settled(waiting, free, math.inf)]
                    now, waiting, free = (name, island), deque(), []
                (free if kind else waiting).append(x)
                found += [(now, pair) for pair in settled(waiting, free, x)]
                if not waiting:
                    del free[: bisect.bisect_left(free, x - tolerance)]
            key_type = batch.schema.field(on).type
            yield packed(found, key_type)
        if now is not None:
            yield packed([(now, pair) for pair in settled(waiting, free, math.inf)], key_type)

    def packed(found: list, kind: pa.DataType) -> pa.RecordBatch:
        columns = [pa.array([k[0] for k, _ in found], kind), *(pa.array([p[i] for _, p in found], pa.int64()) for i in (0, 1))]
        return pa.RecordBatch.from_arrays(columns, names=[on, "t_ref", "t_test"])

    return dealt.mapInArrow(scan, T.StructType([T.StructField(on, ref.schema[on].dataType), T.StructField("t_ref", T.LongType()), T.StructField("t_test", T.LongType())]))


def match_scores(ref: DataFrame, test: DataFrame, pairs: DataFrame, on: str) -> DataFrame:
    """``(on, n_ref, n_test, n_hit, recall, precision)``; a side without events gives null."""
    n = lambda df, name: df.groupBy(on).agg(F.count("*").alias(name))
    out = n(ref, "n_ref").join(n(test, "n_test"), on, "full").join(n(pairs, "n_hit"), on, "left").fillna(0, ["n_ref", "n_test", "n_hit"])
    return out.withColumn("recall", F.when(F.col("n_ref") > 0, F.col("n_hit") / F.col("n_ref"))).withColumn("precision", F.when(F.col("n_test") > 0, F.col("n_hit") / F.col("n_test")))


def best_partner(overlaps: DataFrame, ref_sizes: DataFrame, test_sizes: DataFrame, ref: str, test: str) -> DataFrame:
    """Each ref group with the test group it overlaps most (ties: the more precise, then the lesser): recall and precision."""
    rows = overlaps.join(ref_sizes, ref).join(test_sizes, test).withColumn("recall", F.col("n") / F.col("n_ref")).withColumn("precision", F.col("n") / F.col("n_test"))
    w = Window.partitionBy(ref).orderBy(F.desc("n"), F.desc("precision"), test)
    return rows.withColumn("__r", F.row_number().over(w)).filter("__r = 1").select(ref, test, "n", "recall", "precision")
