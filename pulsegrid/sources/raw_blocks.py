"""Sample-major int16 recordings as a Spark data source: one row per block and channel.

``spark.dataSource.register(RawBlocks)`` and then ``spark.read.format("raw_blocks").options(n_chan=384, block=30000)
.load(path)``. Several paths joined by commas are one recording on a common sample axis, each used up to its number in
``used`` (samples per path, joined by commas) if that is given. Paths must be mounted on every executor.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "part int, t0 long, chan int, samples array<float>"


class _Block(InputPartition):
    def __init__(self, part: int, path: str, first: int, n: int, t0: int):
        self.part, self.path, self.first, self.n, self.t0 = part, path, first, n, t0


class RawBlocks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raw_blocks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return RawReader(self.options)


class RawReader(DataSourceReader):
    """Blocks of ``block`` samples (the last shorter), ``gain`` applied; optional half-open range ``start`` to ``stop``
    on the joined axis and list ``chans`` of channels."""

    def __init__(self, options: dict):
        self.n_chan, self.block, self.gain = int(options["n_chan"]), int(options.get("block", 30_000)), float(options.get("gain", 1.0))
        self.paths = options["path"].split(",")
        width = 2 * self.n_chan
        sizes = [os.path.getsize(p) for p in self.paths]
        if bad := [p for p, s in zip(self.paths, sizes) if s % width]:
            raise ValueError(f"size is no multiple of {width} bytes: {bad}")
        held = [s // width for s in sizes]
        used = [int(x) for x in options["used"].split(",")] if options.get("used") else held
        if len(used) != len(held) or any(u > h for u, h in zip(used, held)):
            raise ValueError("used needs one number per path, no larger than its samples")
        self.used = used
        self.range = int(options.get("start", 0)), int(options.get("stop", sum(used)))
        self.chans = [int(c) for c in options["chans"].split(",")] if options.get("chans") else list(range(self.n_chan))

    def partitions(self) -> list[InputPartition]:
        out, offset = [], 0
        for part, (path, n) in enumerate(zip(self.paths, self.used)):
            lo, hi = max(self.range[0] - offset, 0), min(self.range[1] - offset, n)
            out += [_Block(part, path, a, min(self.block, hi - a), offset + a) for a in range(lo, hi, self.block)]
            offset += n
        return out

    def read(self, block: _Block) -> Iterator[pa.RecordBatch]:
        with open(block.path, "rb") as f:
            f.seek(2 * self.n_chan * block.first)
            data = np.frombuffer(f.read(2 * self.n_chan * block.n), "<i2").reshape(-1, self.n_chan)
        rows = (data[:, self.chans].T * np.float32(self.gain)).astype(np.float32)
        k = len(self.chans)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, block.n), pa.int32()), pa.array(rows.ravel()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([block.part] * k, pa.int32()), pa.array([block.t0] * k, pa.int64()), pa.array(self.chans, pa.int32()), lists], names=["part", "t0", "chan", "samples"]
        )
