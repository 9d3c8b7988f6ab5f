"""Embedding near-duplicates by a pivot-permutation index.

A vector is described by its nearest reference points (pivots) in order of their number. Each class of equal vectors is posted to the
inverted lists of its pivots as a 16-bit copy; two members of a list that share enough pivots are candidates in the first list that
they share, and only there. The 16-bit copies decide all pairs that are not within their rounding error of the threshold;
the others are compared in double precision. A list longer than BLOCK is cut into blocks and every pair of blocks is a group
of its own, so no list, however long, is one task, and no pair is written but the undecided ones. Where the vectors lie so
close together that few pivots can be spread, the lists hold everything: that is exact, and grows with their square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import union_all, written
from pulsegrid.llm.components import components

#: Pivots for each root of the number of vectors, their bounds (the upper one also in numbers), and rows they are picked from for each pivot.
PER_ROOT, FEWEST, MOST, MOST_NUMBERS, SAMPLE = 4, 64, 16_384, 1 << 20, 4
#: Greatest cosine between two pivots (else the order of pivots within a dense group is chance), how many of them describe a vector,
#: and how many of these two vectors must share.
PIVOT_COSINE, NEAREST, SHARED = 0.6, 7, 2
#: Rows of a list's block, and of the slices in which a block is compared.
BLOCK, SLICE = 4096, 512
#: Steps of the 16-bit copies of unit vectors.
STEPS = 32_000


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, safe for very large and very small components."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def rounding_error(dim: int) -> float:
    """The most by which the cosine of two 16-bit copies, multiplied in single precision, is off."""
    each = np.sqrt(dim) / (2 * STEPS)
    return 2 * each + each * each + dim * 2.0**-22


def spread_pivots(x: np.ndarray, most: int) -> np.ndarray:
    """The first rows that are no more similar to an earlier one than pivots may be."""
    taken, n = np.empty((min(most, len(x)), x.shape[1])), 0
    for row in x:
        if n < most and (not n or (taken[:n] @ row).max() < PIVOT_COSINE):
            taken[n] = row
            n += 1
    return taken[:n]


def _describe(pivots: np.ndarray):
    """Replaces the vector by the sorted numbers of its nearest pivots (ties go to the lower number) and its 16-bit copy."""
    k = min(NEAREST, len(pivots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                unit = _unit(_matrix(part.column(3)))
                near = np.sort(np.argsort(-(unit @ pivots.T), axis=1, kind="stable")[:, :k], axis=1).astype(np.int16)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, k), pa.int32()), pa.array(near.ravel()))
                copies = pa.array([r.tobytes() for r in np.rint(unit * STEPS).astype("<i2")], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], lists, copies], names=["id", "h1", "h2", "near", "copy"])

    return run


def _starts(table: pa.Table) -> np.ndarray:
    """Where runs of equal (key, bi, bj) begin."""
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for c in ("key", "bi", "bj"):
        v = table.column(c).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row that each of n rows reaches over the links (a, b)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compared(copies: np.ndarray, near: np.ndarray, key: int, side: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, certain): pairs of a group's rows that meet here first, share enough pivots and are similar, or may be."""
    error = rounding_error(copies.shape[1])
    out = []
    for at in range(0, len(copies), SLICE):
        similar = copies[at : at + SLICE] @ copies[at:].T
        a, b = np.nonzero(similar >= least - error)
        ahead = a < b
        a, b = a[ahead], b[ahead]
        value = similar[a, b]
        a, b = a + at, b + at
        if side is not None:
            other = side[a] != side[b]
            a, b, value = a[other], b[other], value[other]
        for first in range(0, len(a), BLOCK * 16):
            i, j, v = (z[first : first + BLOCK * 16] for z in (a, b, value))
            equal = near[i][:, :, None] == near[j][:, None, :]
            earlier = (equal & (near[i] < key)[:, :, None]).any(axis=(1, 2))
            good = ~earlier & (equal.sum(axis=(1, 2)) >= min(SHARED, near.shape[1]))
            out.append((i[good], j[good], v[good] >= least + error))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*out))


def _batch(node: np.ndarray, links: np.ndarray, root: np.ndarray, other: np.ndarray | None = None) -> pa.RecordBatch:
    values = [pa.array(node, pa.int64()), pa.array(links, pa.int64()), pa.array(root, pa.int64()), pa.array(other, pa.int64()) if other is not None else pa.nulls(len(node), pa.int64())]
    return pa.RecordBatch.from_arrays(values, names=["node", "links", "root", "other"])


def _meet(dim: int, least: float):
    """(node, links, root, null) for each linked row of a group, and (node, 0, node, other) for each undecided pair."""

    def group(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if table.num_rows < 2:
            return
        node, n, own = (table.column(c).to_numpy() for c in ("node", "n", "own"))
        near = _matrix(table.column("near").combine_chunks()).astype(np.int16)
        copies = np.frombuffer(b"".join(table.column("copy").to_pylist()), "<i2").reshape(-1, dim).astype(np.float32) / np.float32(STEPS)
        cross = table.column("bi")[0].as_py() != table.column("bj")[0].as_py()
        a, b, certain = _compared(copies, near, table.column("key")[0].as_py(), own if cross else None, least)
        if not certain.all():
            yield _batch(node[a[~certain]], np.zeros((~certain).sum(), np.int64), node[a[~certain]], node[b[~certain]])
        a, b = a[certain], b[certain]
        if len(a):
            links = np.bincount(a, n[b], len(node)) + np.bincount(b, n[a], len(node))
            some = np.flatnonzero(links)
            yield _batch(node[some], links[some].astype(np.int64), node[_roots(len(node), a, b)][some])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if sum(b.num_rows for b in held) >= BLOCK:
                    table = pa.Table.from_batches(held)
                    starts = _starts(table)
                    for s, e in zip(starts[:-1], starts[1:]):
                        yield from group(table.slice(s, e - s))
                    held = table.slice(starts[-1]).to_batches()
        if held:
            table = pa.Table.from_batches(held)
            starts = _starts(table)
            for s, e in zip(starts, [*starts[1:], table.num_rows]):
                yield from group(table.slice(s, e - s))

    return run


def _verify(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = _unit(_matrix(batch.column(2))), _unit(_matrix(batch.column(3)))
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(np.einsum("ij,ij->i", x, y) >= least)) for c in batch.columns[:2]], names=["a", "b"])

    return run


def _linked(good: DataFrame, dim: int, least: float) -> tuple[DataFrame, DataFrame]:
    """The classes ``(node, h1, h2, least_id, n)`` of ``good(id, h1, h2, vec)``, whose vectors have ``dim`` numbers, and their links ``(node, links, root)``."""
    spark = good.sparkSession
    n_rows = good.count()
    n_pivots = max(FEWEST, min(MOST, MOST_NUMBERS // dim, int(PER_ROOT * n_rows**0.5)))
    picked = good.orderBy(F.xxhash64("id", "h1"), "id", "h2").limit(min(SAMPLE * n_pivots, 4 * MOST_NUMBERS // dim + FEWEST)).select("vec").toArrow()
    pivots = spread_pivots(_unit(_matrix(picked.column(0).combine_chunks())), n_pivots)
    kinds = f"id {good.schema['id'].dataType.simpleString()}, h1 long, h2 int, near array<smallint>, copy binary"
    described = good.select("id", "h1", "h2", "vec").mapInArrow(_describe(pivots), kinds)
    classes = described.groupBy("h1", "h2").agg(F.min("id").alias("least_id"), F.count("*").alias("n"), F.first("near").alias("near"), F.first("copy").alias("copy"))
    classes = written(classes.withColumn("node", F.xxhash64("h1", "h2")), "vector-classes")
    posted = classes.select("node", "n", "near", "copy", F.explode("near").alias("key"))
    # at most one row for each pivot
    long_lists = F.broadcast(posted.groupBy("key").agg(F.count("*").alias("size")).filter(F.col("size") > BLOCK))
    blocks = F.ceil(F.coalesce("size", F.lit(1)) / BLOCK).cast("int")
    placed = posted.join(long_lists, "key", "left").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.least(b, F.col("own")).alias("bi"), F.greatest(b, F.col("own")).alias("bj"))))
    grouped = placed.select("key", "node", "n", "near", "copy", "own", pair.alias("pair")).select("key", "pair.bi", "pair.bj", "own", "node", "n", "near", "copy")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = grouped.repartition(parts, "key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    met = written(dealt.mapInArrow(_meet(dim, least), "node long, links long, root long, other long"), "vector-links")
    sure = met.filter("other is null").select("node", "links", "root")
    unsure = met.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))
    wanted = written(unsure.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "vector-nodes")
    vectors = good.select(F.xxhash64("h1", "h2").alias("node"), "vec").join(wanted, "node", "left_semi").groupBy("node").agg(F.first("vec").alias("vec"))
    vectors = written(vectors, "vectors-compared")
    side = lambda c: vectors.select(F.col("node").alias(c), F.col("vec").alias(f"vec_{c}"))
    verified = unsure.join(side("a"), "a").join(side("b"), "b").select("a", "b", "vec_a", "vec_b").mapInArrow(_verify(least), "a long, b long")
    verified = written(verified, "vector-pairs")
    both = verified.unionByName(verified.select(F.col("b").alias("a"), F.col("a").alias("b")))
    late = both.join(classes.select(F.col("node").alias("b"), "n"), "b").select(F.col("a").alias("node"), F.col("n").alias("links"), F.col("b").alias("root"))
    return classes.select("node", "h1", "h2", "least_id", "n"), sure.unionByName(late)


def near_duplicates(vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(id, n_links, component_id, kept)`` for every row.

    Equal vectors are one class, compared once. Vectors that are null, empty, zero or hold null or non-finite components,
    and rows with a null id, link with nothing; vectors of different lengths are not compared. ``n_links`` counts other rows
    linked directly; ``component_id`` is the least id reachable. Links have a cosine of ``least`` or more in double
    precision, and no pair below it is linked. Some links may be missed: pairs just above the threshold share fewer than SHARED of their
    NEAREST pivots in one or two of a hundred cases (the tests measure it); rows of a repeated id are compared like any others.
    Pivots come from a sample of SAMPLE rows for each, at most 4 * MOST_NUMBERS numbers; all rows are indexed.
    """
    c = F.col(vector_col)
    good = c.isNotNull() & F.col(id_col).isNotNull() & (F.size(c) > 0) & F.exists(c, lambda x: x != 0)
    good = good & F.forall(c, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    rows = vectors.select(F.col(id_col).alias("id"), c.alias("vec"), F.coalesce(good, F.lit(False)).alias("good"))
    rows = rows.select("id", "good", "vec", F.xxhash64("vec").alias("h1"), F.hash("vec").alias("h2"))
    usable = rows.filter("good")
    found = [_linked(usable.filter(F.size("vec") == r[0]), r[0], least) for r in usable.select(F.size("vec")).distinct().collect()]
    joined = rows.filter("good").select("id", F.lit(0).cast("long").alias("links"), F.col("id").cast("long").alias("component")).limit(0)
    if found:
        classes, linked = union_all([x[0] for x in found]), union_all([x[1] for x in found])
        counts = linked.groupBy("node").agg(F.sum("links").alias("links"))
        groups = components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")))
        named = classes.join(counts, "node", "left").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
        named = written(named.select("h1", "h2", "component", "least_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links")), "vector-names")
        heads = named.groupBy("component").agg(F.min("least_id").cast("long").alias("head"))
        named = named.join(heads, "component").select("h1", "h2", "links", F.col("head").alias("component"))
        joined = usable.select("id", "h1", "h2").join(named, ["h1", "h2"]).select("id", "links", "component")
    alone = rows.filter("not good").select("id", F.lit(0).cast("long").alias("links"), F.col("id").cast("long").alias("component"))
    out = joined.unionByName(alone)
    return out.select(F.col("id").alias(id_col), F.col("links").alias("n_links"), F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
