"""Folders of recordings: a census by file sizes, labels beside or above a sort, children of clusters, sharded folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.sources.documents import labels_tsv

#: The names of a session's files below its archive, and the number that a child cluster's id adds to its parent's.
RAW_FILE = r"/((\d{8})_(\d{6}))\.rec/\1\.rec$"
PROBE_FILE = r"/((\d{8})_(\d{6}))\.rec/\1\.kilosort/\1\.probe1\.dat$"
CHILD_OFFSET = 1000


def census(spark: SparkSession, path: str, n_chan: int = 384, rate: float = 30_000.0) -> DataFrame:
    """``(session, start, rec_bytes, probe_bytes, samples, seconds, exact)`` of every session below ``path``.

    Only names and sizes are read, never a file's content. ``exact`` says whether the probe file holds whole samples of
    ``n_chan`` int16 values; a session without one has null samples and seconds and is not exact. Other files are ignored.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    raw, probe = F.regexp_extract("path", RAW_FILE, 1), F.regexp_extract("path", PROBE_FILE, 1)
    named = files.select("length", (raw != "").alias("raw"), F.when(raw != "", raw).otherwise(probe).alias("session")).filter("session <> ''")
    size = lambda is_raw: F.max(F.when(F.col("raw") == is_raw, F.col("length")))
    sessions = named.groupBy("session").agg(size(True).alias("rec_bytes"), size(False).alias("probe_bytes"))
    width = 2 * n_chan
    samples = F.floor(F.col("probe_bytes") / width)
    start = F.try_to_timestamp("session", F.lit("yyyyMMdd_HHmmss"))
    return sessions.select("session", start.alias("start"), "rec_bytes", "probe_bytes", samples.alias("samples"), (samples / rate).alias("seconds"), F.coalesce(F.col("probe_bytes") % width == 0, F.lit(False)).alias("exact"))


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def nearest_labels(spark: SparkSession, folder: str, column: str) -> DataFrame:
    """``(cluster_id, <column>)`` of the folder's label file or, if it is missing or labels nothing, of its parent's.

    Without either the table is empty. Rows whose id is no number are left out.
    """
    folder = folder.rstrip("/")
    labels = spark.createDataFrame([], f"cluster_id int, `{column}` string")
    for place in (folder, folder.rsplit("/", 1)[0]):
        if _exists(spark, path := f"{place}/cluster_{column}.tsv"):
            labels = labels_tsv(spark, path, column).filter("cluster_id is not null").withColumn(column, F.trim(column))
            if not labels.isEmpty():
                break
    return labels


def with_children(events: DataFrame, recovered: DataFrame, key: str, offset: int = CHILD_OFFSET) -> DataFrame:
    """``events`` and, as clusters of their own, the recovered ones under ``key + offset``; parents stay as they are.

    Both tables need the columns of ``events``; more columns of ``recovered`` are ignored. Recovered rows without a key are left out.
    """
    children = recovered.filter(F.col(key).isNotNull()).withColumn(key, (F.col(key) + offset).cast(events.schema[key].dataType))
    return events.unionByName(children.select(events.columns))


def shard_of(key: str | Column, size: int = 25) -> Column:
    """The shard of an id: ``size`` ids in a row share one."""
    return F.floor((F.col(key) if isinstance(key, str) else key) / size)


def write_shards(rows: DataFrame, key: str, path: str, size: int = 25, ceiling: int = 16 << 20, per_file: int = 100_000) -> DataFrame:
    """Writes JSON folders ``shard=<n>`` of ``size`` ids each and returns ``(shard, n, bytes)`` of what they hold.

    A shard of more bytes of JSON than ``ceiling`` stops the job before anything is written. A shard is dealt to tasks by its
    rows' ids, and a file has at most ``per_file`` rows. Rows without an id are in the shard of the null name.
    """
    lines = rows.select(shard_of(key, size).alias("shard"), F.col(key).alias("__id"), F.to_json(F.struct(*rows.columns)).alias("value"))
    sizes = lines.groupBy("shard").agg(F.count("*").alias("n"), F.sum(F.octet_length("value") + 1).alias("bytes"))
    over = sizes.filter(F.col("bytes") > ceiling).orderBy(F.desc("bytes")).first()
    if over:
        raise ValueError(f"shard {over.shard} has {over.bytes} bytes, over the ceiling of {ceiling}")
    lines.repartition("shard", "__id").select("shard", "value").write.partitionBy("shard").option("maxRecordsPerFile", per_file).text(path)
    return sizes
