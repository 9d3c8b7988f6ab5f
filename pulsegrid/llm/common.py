"""Shared folder, written intermediate tables and text rules used by several operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rules: space and the ASCII controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]"


#: Rows up to which a table of one or two numbers is broadcast (some 64 MB as a hash table); larger ones are joined by shuffling.
BROADCAST_ROWS = 2_000_000


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; set here only where it is unset and all runs on one machine."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="pulsegrid-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder path below the shared one; it is deleted when the application ends."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def local_path(path: str) -> str:
    """The mounted path of a shared folder, for code that memory-maps files in it."""
    if path.startswith("file:"):
        return re.sub("^file:/+", "/", path)
    if "://" in path:
        raise ValueError(f"memory mapping needs a mounted spark.checkpoint.dir, not {path}")
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage and outlives lost executors."""
    spark, path = df.sparkSession, work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, all else unchanged."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def id_bucket(id_col: str | Column, k: int) -> Column:
    """crc32 of the id as text, modulo ``k``; a null id is hashed as an empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.encode(F.coalesce(c.cast("string"), F.lit("")), "UTF-8")) % k


def small(df: DataFrame) -> DataFrame:
    """``df`` of one or two numbers a row, marked for broadcasting where its counted rows are few enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A hash of id and text: rows that share an id are told apart, and a null id is a value like any other."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def fresh(name: str, columns: list[str]) -> str:
    """``name``, with underscores after it until no column is called so in any case."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def without(docs: DataFrame, keys: DataFrame, id_col: str = "doc_id", text_col: str = "text", only: bool = False) -> DataFrame:
    """The rows of ``docs`` whose ``row_key`` is not among ``keys``, a table of one column (with ``only``: is); no text is shuffled where the keys are few."""
    key = fresh("row_key", docs.columns)
    keys = written(keys.toDF(key).distinct(), "keys")
    return docs.join(small(keys), row_key(id_col, text_col) == F.col(key), "left_semi" if only else "left_anti")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
