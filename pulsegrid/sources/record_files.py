"""Binary record files that say their own layout, as a Spark data source; clock maps and spike arrays made of them.

``spark.dataSource.register(RecordFiles)``, then ``spark.read.format("record_files").option("path", ...).load()``. A file begins either with the header of a NumPy
array of one dimension, or with a text header that ends with a line END and has a line ``Fields: <name type><name type>...``; little-endian records follow. The header is
read once on the driver; tasks read ranges of records. Paths must be mounted on every executor.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pulsegrid.operators.lineage import MOST_PARTS

# Fixed values of the text header: its last line, and the names of its field types.
END = b"<End settings>"
TYPES = {"uint8": "u1", "int8": "i1", "uint16": "u2", "int16": "i2", "uint32": "u4", "int32": "i4", "uint64": "u8", "int64": "i8", "single": "f4", "float": "f4", "double": "f8"}
#: Bytes in which a text header must end.
LONGEST_HEADER = 1 << 16
#: Records that a task reads unless the option ``records`` says otherwise.
RECORDS = 4_000_000


def layout(path: str) -> tuple[np.dtype, int, dict[str, str]]:
    """The type of the records, the offset of the first, and the other entries of a text header."""
    with open(path, "rb") as f:
        if f.read(6) == b"\x93NUMPY":
            f.seek(0)
            version = np.lib.format.read_magic(f)
            shape, _, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
            if len([n for n in shape if n != 1]) > 1 or kind.hasobject:
                raise ValueError(f"{path}: an array of one dimension is needed, not {shape} of {kind}")
            kind = kind if kind.names else np.dtype([("value", kind)])
            if os.path.getsize(path) != f.tell() + int(np.prod(shape)) * kind.itemsize:
                raise ValueError(f"{path}: the file's size is not that of {shape} records of {kind.itemsize} bytes")
            return kind, f.tell(), {}
        f.seek(0)
        head = f.read(LONGEST_HEADER)
    end = head.find(END + b"\n")
    if end < 0:
        raise ValueError(f"{path}: no line {END.decode()} within {LONGEST_HEADER} bytes")
    entries = dict(re.findall(r"^([^:<\n]+): *(.*)$", head[:end].decode("utf-8", "replace"), re.M))
    fields = re.findall(r"<(\w+) +(?:(\d+)\*)?(\w+)>", entries.get("Fields", ""))
    if not fields or any(t not in TYPES for _, _, t in fields):
        raise ValueError(f"{path}: no fields, or of unknown types: {entries.get('Fields')}")
    kind = np.dtype([(n, "<" + TYPES[t]) + ((int(k),) if k else ()) for n, k, t in fields])
    offset = end + len(END) + 1
    if (os.path.getsize(path) - offset) % kind.itemsize:
        raise ValueError(f"{path}: cut off, {os.path.getsize(path) - offset} bytes are no multiple of {kind.itemsize}")
    return kind, offset, entries


def _arrow(kind: np.dtype) -> pa.DataType:
    """Unsigned numbers become the next wider signed type, as Spark has none; 64 bits stay, their highest bit is the sign."""
    if kind.shape:
        return pa.list_(_arrow(kind.base))
    return {"u1": pa.int16(), "u2": pa.int32(), "u4": pa.int64(), "u8": pa.int64(), "i1": pa.int8(), "i2": pa.int16(), "i4": pa.int32(), "i8": pa.int64(), "f4": pa.float32(), "f8": pa.float64(), "b1": pa.bool_()}[kind.str[1:]]


class _Range(InputPartition):
    def __init__(self, part: int, path: str, offset: int, first: int, n: int, row: int):
        self.part, self.path, self.offset, self.first, self.n, self.row = part, path, offset, first, n, row


class RecordFiles(DataSource):
    """Options: ``path`` (several joined by commas are one sequence of records), ``columns`` to read (joined by commas; all without), ``records`` of a task, and ``expect``,
    the number of records that there must be. Rows are ``(part, row, fields...)``; ``row`` counts on over the files."""

    @classmethod
    def name(cls) -> str:
        return "record_files"

    def _columns(self) -> tuple[np.dtype, list[str]]:
        kind = layout(self.options["path"].split(",")[0])[0]
        wanted = [c for c in self.options.get("columns", "").split(",") if c] or list(kind.names)
        if missing := [c for c in wanted if c not in kind.names]:
            raise ValueError(f"no fields {missing} among {kind.names}")
        return kind, wanted

    def schema(self) -> str:
        kind, wanted = self._columns()
        names = {pa.int8(): "byte", pa.int16(): "short", pa.int32(): "int", pa.int64(): "long", pa.float32(): "float", pa.float64(): "double", pa.bool_(): "boolean"}
        of = lambda t: f"array<{names[t.value_type]}>" if pa.types.is_list(t) else names[t]
        return "part int, row long, " + ", ".join(f"`{c}` {of(_arrow(kind[c]))}" for c in wanted)

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, *self._columns())


class _Reader(DataSourceReader):
    def __init__(self, options: dict, kind: np.dtype, wanted: list[str]):
        self.kind, self.wanted, size = kind, wanted, int(options.get("records", RECORDS))
        self.ranges, row = [], 0
        for part, path in enumerate(options["path"].split(",")):
            own, offset, _ = layout(path)
            if own != kind:
                raise ValueError(f"{path}: records of {own}, not of {kind}")
            n = (os.path.getsize(path) - offset) // kind.itemsize
            self.ranges += [_Range(part, path, offset, a, min(size, n - a), row + a) for a in range(0, n, size)]
            row += n
        if options.get("expect") and int(options["expect"]) != row:
            raise ValueError(f"{row} records where {options['expect']} are expected")

    def partitions(self) -> list[InputPartition]:
        return self.ranges or [_Range(0, "", 0, 0, 0, 0)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        for at in range(0, part.n, 1 << 18):
            n = min(1 << 18, part.n - at)
            data = np.fromfile(part.path, self.kind, n, offset=part.offset + (part.first + at) * self.kind.itemsize)
            if len(data) != n:
                raise ValueError(f"{part.path}: cut off at record {part.first + at + len(data)}")
            columns = [pa.array(np.full(n, part.part, np.int32)), pa.array(part.row + at + np.arange(n))]
            for c in self.wanted:
                values, kind = np.ascontiguousarray(data[c]).astype(data[c].dtype.newbyteorder("="), copy=False), _arrow(self.kind[c])
                if pa.types.is_list(kind):
                    width = values.shape[1]
                    columns.append(pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width, dtype=np.int32)), pa.array(values.ravel()).cast(kind.value_type)))
                else:
                    columns.append(pa.array(values.view(np.int64) if values.dtype == np.uint64 else values).cast(kind))
            yield pa.RecordBatch.from_arrays(columns, names=["part", "row", *self.wanted])


def records(spark: SparkSession, paths: list[str], **options) -> DataFrame:
    spark.dataSource.register(RecordFiles)
    return spark.read.format("record_files").options(path=",".join(paths), **options).load()


def clock_segments(clock: DataFrame, row: str = "row", time: str = "time") -> DataFrame:
    """``(segment, row0, row1, time0, time1, whole)``: stretches of rows over which a counter goes up by one a row.

    Rows of a stretch share the counter less the row, so they are one aggregation and no order of all rows is needed. ``whole`` is false where the counter has gone back or
    stood still, so that stretches with the same difference meet.
    """
    n = F.count("*")
    lag = F.col(time) - F.col(row)
    return clock.groupBy(lag.alias("segment")).agg(F.min(row).alias("row0"), F.max(row).alias("row1"), F.min(time).alias("time0"), F.max(time).alias("time1"), n.alias("n")).withColumn("whole", F.col("row1") - F.col("row0") + 1 == F.col("n")).drop("n")


def recording_gaps(segments: DataFrame, least: int = 1) -> DataFrame:
    """``(row, t0, t1, missing)``: where at least ``least`` counts are missing before a row; from the stretches, which are few, in one window."""
    w = Window.orderBy("row0")
    rows = segments.select(F.col("row0").alias("row"), (F.lag("time1").over(w) + 1).alias("t0"), F.col("time0").alias("t1"))
    return rows.withColumn("missing", F.col("t1") - F.col("t0")).filter(F.col("missing") >= least)


def on_clock(events: DataFrame, segments: DataFrame, sample: str, name: str = "clock") -> DataFrame:
    """``events`` with the counter of their sample, looked up in the measured stretches; null outside of them.

    The stretches are broadcast where they are counted to be few; else both sides meet in buckets that a stretch is copied to.
    """
    held = segments.select(F.col("row0").alias("__r0"), F.col("row1").alias("__r1"), F.col("segment").alias("__lag"))
    inside = F.col(sample).between(F.col("__r0"), F.col("__r1"))
    if held.count() <= MOST_PARTS:
        joined = events.join(F.broadcast(held), inside, "left")
    else:
        width = 1 << 22
        spread = held.withColumn("__b", F.explode(F.sequence(F.expr(f"__r0 div {width}"), F.expr(f"__r1 div {width}"))))
        joined = events.withColumn("__e", F.expr(f"`{sample}` div {width}")).join(spread, (F.col("__e") == F.col("__b")) & inside, "left")
    return joined.select(*events.columns, (F.col(sample) + F.col("__lag")).alias(name))


def spike_arrays(spark: SparkSession, folder: str, times: str = "spike_times.npy", clusters: str = "spike_clusters.npy", **options) -> DataFrame:
    """``(row, t, unit)`` of two arrays side by side, which must be of one length; they meet by row, as ranges of both are read in parallel."""
    paths = [os.path.join(folder, f) for f in (times, clusters)]
    n = []
    for path in paths:
        kind, offset, _ = layout(path)
        n.append((os.path.getsize(path) - offset) // kind.itemsize)
    if n[0] != n[1]:
        raise ValueError(f"{folder}: {n[0]} times and {n[1]} clusters")
    t, unit = (records(spark, [p], **options).select("row", F.col("value").cast("long").alias(c)) for p, c in zip(paths, ("t", "unit")))
    return t.join(unit, "row")
