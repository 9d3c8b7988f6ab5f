"""Shards cut from a Hilbert curve through several metadata dimensions, with row counts at most one apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import fresh, written

#: Rows per run of one curve cell, and the least number of runs a cell is cut into.
RUN_ROWS, LEAST_RUNS = 250_000, 256


def hilbert_index(point: tuple[int, ...], bits: int) -> int:
    """Place on the curve of a point whose coordinates have ``bits`` bits (Skilling's transform)."""
    x, n = list(point), len(point)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                swap = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= swap
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn, q = 0, top
    while q > 1:
        if x[n - 1] & q:
            turn ^= q - 1
        q >>= 1
    x = [v ^ turn for v in x]
    out = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = out << 1 | v >> b & 1
    return out


def _cuts(base: DataFrame, column: str, levels: int) -> list:
    """The values at which the rows are cut into levels of about equal numbers, from the counts of whole distinct values.

    The values are range partitioned, and only the rows of a partition and the cuts reach one place.
    """
    if isinstance(base.schema[column].dataType, T.NumericType):
        return base.agg(F.percentile_approx(column, [k / levels for k in range(1, levels)], 10_000)).first()[0] or []
    counts = base.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    counts = written(counts.repartitionByRange("value").withColumn("part", F.spark_partition_id()), "shard-values")
    parts = counts.groupBy("part").agg(F.sum("n").alias("part_n")).withColumn("before", F.sum("part_n").over(Window.orderBy("part")) - F.col("part_n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    end = F.sum("n").over(Window.partitionBy("part").orderBy("value")) + F.col("before")
    ranked = counts.join(F.broadcast(parts), "part").select("value", "n", end.alias("end"))
    level = F.floor((F.col("end") - F.col("n")) * levels / F.lit(max(total, 1)))
    return sorted(r[0] for r in ranked.groupBy(level.alias("level")).agg(F.min("value").alias("cut")).filter("level > 0").select("cut").collect())


def hilbert_shards(
    docs: DataFrame, n_shards: int = 16, dims: tuple[str, ...] = ("lang", "source", "size"), bits: int = 4, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None
) -> DataFrame:
    """``(id, size, text_crc32, law, shard, slot, grown_shard, curve)`` for every row; with ``row_col``, also the row as a struct of that name.

    ``dims`` are columns of ``docs`` or ``size`` (UTF-8 bytes of the text and 1; a null text has none). Each is
    quantised to 2^bits levels at quantiles of the whole table (of numbers approximate ones, of others those of whole values; nulls: level 0); a
    row's cell has a place on the curve. Rows are ordered by (curve, run, crc, id), a run being a hashed part of a cell, so a cell
    that holds a third of all rows is ranked by many tasks. Ranks come from counts of cells and runs: one task sees
    at most one row per cell, 2^(bits * dims) of them. Shards are equal runs of ranks. Ties keep any order; an
    empty table gives no rows.
    """
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    size = (F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) + 1).cast("long")
    carried = [] if row_col is None else [F.struct(*docs.columns).alias("row")]
    orderly = lambda d: F.col(d).cast("double" if isinstance(docs.schema[d].dataType, T.NumericType) else "string")
    named = docs.select(F.col(id_col).alias("id"), size.alias("size"), F.crc32(text).alias("crc"), *[orderly(d).alias(f"dim{k}") for k, d in enumerate(dims) if d != "size"], *carried)
    levels = 1 << bits
    columns = ["size" if d == "size" else f"dim{k}" for k, d in enumerate(dims)]
    base = written(named, "shard-rows")
    total = base.count()
    cuts = [_cuts(base, c, levels) for c in columns]
    level = [sum((F.when(F.col(c) >= x if isinstance(x, str) else F.col(c) > x, 1).otherwise(0) for x in sorted(set(cut))), F.lit(0)) for c, cut in zip(columns, cuts)]
    cell = F.lit(0)
    for x in level:
        cell = cell * levels + x
    n = len(dims)
    curve = [hilbert_index(tuple(v >> bits * (n - 1 - k) & levels - 1 for k in range(n)), bits) for v in range(levels**n)]
    place = F.expr(f"array({','.join(map(str, curve))})")
    runs = max(LEAST_RUNS, -(-total // RUN_ROWS))
    rows = base.select("id", "size", "crc", F.element_at(place, cell + 1).alias("curve"), F.pmod(F.xxhash64("id", "crc"), F.lit(runs)).alias("run"), *(["row"] if carried else []))
    counts = rows.groupBy("curve", "run").agg(F.count("*").alias("n"))
    cells = counts.groupBy("curve").agg(F.sum("n").alias("cell_n"))
    before = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(F.col("curve").alias("c"), F.coalesce(F.sum("cell_n").over(before), F.lit(0)).alias("cell_start"))
    inside = Window.partitionBy("curve").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("run_start", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(cells), F.col("curve") == F.col("c"))
    starts = starts.select(F.col("curve").alias("sc"), F.col("run").alias("sr"), (F.col("cell_start") + F.col("run_start")).alias("start"))
    order = Window.partitionBy("curve", "run").orderBy("crc", "id", "size")
    ranked = rows.withColumn("r", F.row_number().over(order) - 1).join(starts, (F.col("curve") == F.col("sc")) & (F.col("run") == F.col("sr")))
    rank = F.col("start") + F.col("r")
    shard = F.expr(f"(start + r) * {n_shards} div {max(total, 1)}")
    first = F.expr(f"(shard * {total} + {n_shards - 1}) div {n_shards}")
    out = ranked.select("id", "size", "crc", "curve", rank.alias("rank"), shard.alias("shard"), *(["row"] if carried else []))
    return out.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("rank") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve", *([F.col("row").alias(row_col)] if carried else []),
    )


def write_shards(docs: DataFrame, path: str, rows_per_file: int = 1_000_000, shard_col: str = "shard", **more) -> None:
    """Writes every row of ``docs`` into one folder per shard, in curve order, so that file statistics prune all dimensions.

    A shard is cut into files of at most ``rows_per_file`` rows, runs of slots that different tasks write. Rows with repeated or null ids are written each. The
    folders are named after ``shard_col``, with underscores after it where ``docs`` has a column of that name; ``more`` goes to ``hilbert_shards``.
    """
    name = fresh(shard_col, docs.columns)
    placed = hilbert_shards(docs, row_col="row", **more).select("row", "shard", "slot", F.expr(f"slot div {rows_per_file}").alias("file"))
    dealt = placed.repartition("shard", "file").sortWithinPartitions("shard", "file", "slot")
    dealt.select(F.col("shard").alias(name), *[F.col("row")[c].alias(c) for c in docs.columns]).write.option("maxRecordsPerFile", rows_per_file).partitionBy(name).parquet(path)
