"""Vector code compression: product quantisation whose codebooks are trained by an RDD treeAggregate.

The kept vectors are written once as columnar blocks of whole numbers. A round hands the codebooks to every task, which
assigns each part of its blocks, the distances adding up dimension by dimension, and adds parts and counts to one int64
tensor of sums and one of counts; the tensors, whose size does not depend on the rows, merge through a reduction tree. All arithmetic is in whole
numbers, so neither the partitions nor the order of merging changes a result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import fresh, small, written

#: Vectors of a block.
BLOCK = 8192
#: Components are below this after scaling, so that squared distances and sums of 2^32 rows stay within 64 bits.
LIMIT = 1 << 26


def finite(vector: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _blocks(rows: DataFrame, scale: float) -> DataFrame:
    """``(n, width, ids, labels, block)``: whole components as int32, all first components before all second ones."""
    ids, labels = rows.schema[0].dataType.simpleString(), rows.schema[1].dataType.simpleString()

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                vectors = batch.column(2)
                widths = np.diff(vectors.offsets.to_numpy())
                if (widths != widths[0]).any():
                    raise ValueError("vectors of different lengths")
                x = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
                if len(x) and np.abs(x).max() >= LIMIT:
                    raise ValueError(f"a component times {scale} is {LIMIT} or more")
                data = np.ascontiguousarray(x.reshape(batch.num_rows, -1).astype("<i4").T).tobytes()
                one = lambda column: pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.num_rows], pa.int32()), pa.array([int(widths[0])], pa.int32()), one(batch.column(0)), one(batch.column(1)), pa.array([data], pa.binary())], names=["n", "width", "ids", "labels", "block"]
                )

    return rows.mapInArrow(pack, f"n int, width int, ids array<{ids}>, labels array<{labels}>, block binary")


def _nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(parts, n)`` indexes of the nearest entries, the lowest of equally near ones, and their squared distances."""
    parts, _, width = books.shape
    codes, errors = np.empty((parts, x.shape[1]), np.int64), np.empty((parts, x.shape[1]), np.int64)
    for p in range(parts):
        distance = np.zeros((x.shape[1], books.shape[1]), np.int64)
        for d in range(width):
            step = x[p * width + d][:, None] - books[p, :, d][None, :]
            distance += step * step
        codes[p] = distance.argmin(axis=1)
        errors[p] = distance[np.arange(x.shape[1]), codes[p]]
    return codes, errors


def _columns(block: bytes, n: int) -> np.ndarray:
    return np.frombuffer(block, "<i4").reshape(-1, n).astype(np.int64)


def _round(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after every part has been assigned and each used entry has become the floor of its parts' mean."""
    held = blocks.sparkSession.sparkContext.broadcast(books)  # its size is that of the codebooks

    def add(total: tuple, row) -> tuple:
        sums, counts = total
        if sums is None:
            sums, counts = np.zeros(held.value.shape, np.int64), np.zeros(held.value.shape[:2], np.int64)
        x, width = _columns(row.block, row.n), held.value.shape[2]
        for p, code in enumerate(_nearest(x, held.value)[0]):
            np.add.at(counts[p], code, 1)
            for d in range(width):
                np.add.at(sums[p, :, d], code, x[p * width + d])
        return sums, counts

    def merge(a: tuple, b: tuple) -> tuple:
        return b if a[0] is None else a if b[0] is None else (a[0] + b[0], a[1] + b[1])

    sums, counts = blocks.select("n", "block").rdd.treeAggregate((None, None), add, merge, depth=3)
    held.unpersist()
    used = counts > 0
    out = books.copy()
    out[used] = sums[used] // counts[used][:, None]
    return out


def _encode(blocks: DataFrame, books: np.ndarray, names: list[str]) -> DataFrame:
    held = blocks.sparkSession.sparkContext.broadcast(books)
    kinds = [blocks.schema[c].dataType.elementType.simpleString() for c in ("ids", "labels")]
    digits = np.array([f"{i:02x}" for i in range(books.shape[1])])

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                n = batch.column(0)[i].as_py()
                codes, errors = _nearest(_columns(batch.column(4)[i].as_py(), n), held.value)
                text = ["".join(row) for row in digits[codes.T]]
                yield pa.RecordBatch.from_arrays([batch.column(2)[i].values, batch.column(3)[i].values, pa.array(text, pa.string()), pa.array(errors.sum(axis=0))], names=[*names, "code", "error"])

    return blocks.mapInArrow(encode, f"`{names[0]}` {kinds[0]}, `{names[1]}` {kinds[1]}, code string, error long")


def train(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: float = 256) -> tuple[DataFrame, np.ndarray | None]:
    """The written blocks of ``vectors`` and the codebooks ``(part, entry, position)`` after some rounds; no codebooks for an empty table."""
    if not 1 <= entries <= 256:
        raise ValueError("a code of two hex digits needs 1 to 256 entries")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vector")).filter(finite("vector"))
    blocks = written(_blocks(rows, scale), "vectors")
    widths = [r.width for r in blocks.select("width").distinct().limit(2).collect()]
    if len(widths) > 1 or widths and widths[0] % parts:
        raise ValueError(f"vectors need one length, a multiple of {parts}")
    if not widths:
        return blocks, None
    whole = F.transform("vector", lambda x: F.floor(x.cast("double") * scale))
    first = rows.select("id", whole.alias("whole")).orderBy(F.asc_nulls_last("id"), "whole").limit(entries).collect()
    books = np.array([r.whole for r in first], np.int64).reshape(len(first), parts, widths[0] // parts).transpose(1, 0, 2)
    for _ in range(rounds):
        books = _round(blocks, books)
    return blocks, books


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: float = 256) -> DataFrame:
    """``(id, code, error, label_error, codebooks_sha256)``, a row for each vector that is there and finite.

    Components become floor(scale x); the codebooks start as the parts of the vectors with the least ids (of rows that repeat an id those with the
    lesser numbers first; null ids last) and take ``rounds`` rounds; ties go to the lower index, unused entries stay. With fewer vectors than
    ``entries`` the codebooks are as many. ``label_error`` adds up the errors of a label, nulls together. Repeated rows and ids count each time; an empty table gives
    no rows; vectors of different lengths, of a length that ``parts`` does not divide, or with a scaled component of 2^26 or more are an error. Other columns are not looked at.
    """
    blocks, books = train(vectors, id_col, vec_col, label_col, parts, entries, rounds, scale)
    label = fresh("label", [id_col])
    if books is None:
        coded, digest = blocks.select(F.explode("ids").alias(id_col), F.lit(None).cast(blocks.schema["labels"].dataType.elementType).alias(label), F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), None
    else:
        coded, digest = written(_encode(blocks, books, [id_col, label]), "codes"), hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    total = small(coded.groupBy(F.col(label).alias("__label")).agg(F.sum("error").alias("label_error")))
    return coded.join(total, F.col(label).eqNullSafe(F.col("__label"))).select(id_col, "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def decode(codes: DataFrame, books: np.ndarray, code_col: str = "code", scale: float = 256) -> DataFrame:
    """``codes`` with ``vector``: the middles of the whole numbers' cells that its code names, looked up in the JVM."""
    entry = lambda x: F.array(*[F.lit((int(v) + 0.5) / scale) for v in x])
    place = lambda p: F.conv(F.substring(code_col, 2 * p + 1, 2), 16, 10).cast("int")
    return codes.withColumn("vector", F.flatten(F.array(*[F.get(F.array(*map(entry, book)), place(p)) for p, book in enumerate(books)])))


def _assign(books: str) -> str:
    """SQL of the nearest entry of every part: ``(row, p, e, d)``."""
    return f"""SELECT row, p, e, d FROM (SELECT *, row_number() OVER (PARTITION BY row, p ORDER BY d, e) AS k FROM (SELECT x.row, x.p, b.e, sum((x.v - b.v) * (x.v - b.v)) AS d FROM x JOIN {books} b ON b.p = x.p AND b.i = x.i GROUP BY ALL)) WHERE k = 1"""


def _moved(books: str, assigned: str) -> str:
    floor = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
    return f"""SELECT b.p, b.e, b.i, coalesce({floor}, b.v) AS v FROM {books} b LEFT JOIN (SELECT x.p, a.e, x.i, sum(x.v) AS s, count(*) AS n FROM x JOIN {assigned} a ON a.row = x.row AND a.p = x.p GROUP BY ALL) t ON t.p = b.p AND t.e = b.e AND t.i = b.i"""


SQL = f"""WITH kept AS (SELECT vec_id, label, [CAST(floor(y::DOUBLE * 256) AS BIGINT) FOR y IN embedding] AS w FROM embeddings WHERE embedding IS NOT NULL AND len([y FOR y IN embedding IF y IS NULL OR NOT isfinite(y)]) = 0),
r AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, w) AS row, len(w) // 16 AS width FROM kept),
x AS (SELECT row, (i - 1) // width AS p, (i - 1) % width AS i, v FROM (SELECT row, width, unnest(w) AS v, generate_subscripts(w, 1) AS i FROM r)),
b0 AS (SELECT p, row - 1 AS e, i, v FROM x WHERE row <= 64), a0 AS ({_assign("b0")}), b1 AS ({_moved("b0", "a0")}), a1 AS ({_assign("b1")}), b2 AS ({_moved("b1", "a1")}), a2 AS ({_assign("b2")}),
h AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM b2),
c AS (SELECT row, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY row)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r JOIN c USING (row), h"""
