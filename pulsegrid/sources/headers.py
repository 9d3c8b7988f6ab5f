"""Text headers at the front of recordings: their text, gain and channel map, and fingerprints of the map."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the header: its last tag, the tags of electrodes and channels, and the attributes that are read.
END = "</Configuration>"
GAIN = r'spikeScalingToUv="([^"]+)"'
ELECTRODE = r'<SpikeNTrode\b[^>]*\bid="([^"]*)"'
CHANNEL = r"<SpikeChannel\b[^>]*/>"
ATTRIBUTES = ["hwChan", "coord_ml", "coord_ap", "coord_dv"]
#: Bytes in which a header must end.
LONGEST = 4 << 20


def texts(spark: SparkSession, paths: list[str], end: str = END, longest: int = LONGEST) -> DataFrame:
    """``(path, header)``: the text up to ``end``, null where it does not come within ``longest`` bytes. Tasks read the fronts of files alone, one
    at a time; the paths must be mounted on every executor."""

    def read(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                with open(path, "rb") as f:
                    head = f.read(longest)
                at = head.find(end.encode())
                yield pd.DataFrame({"path": [path], "header": [head[: at + len(end)].decode("utf-8", "replace") if at >= 0 else None]})

    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    return rows.repartition(max(1, min(len(paths), 1000)), "path").mapInPandas(read, "path string, header string")


def attribute(tag: Column, name: str) -> Column:
    """An attribute of a tag; null where it is absent. Of a repeated one the last counts."""
    found = F.regexp_extract_all(tag, F.lit(rf'\b{name}="([^"]*)"'), F.lit(1))
    return F.try_element_at(found, F.lit(-1))


def gains(headers: DataFrame, header: str = "header", pattern: str = GAIN) -> DataFrame:
    """``headers`` with ``gain``; a header without a gain, or with several different ones, stops the query."""
    found = F.array_distinct(F.coalesce(F.regexp_extract_all(header, F.lit(pattern), F.lit(1)), F.array().cast("array<string>")))
    one = F.when(F.size(found) == 1, F.element_at(found, 1).cast("double"))
    return headers.withColumn("gain", F.when(F.size(found) == 1, one).otherwise(F.raise_error(F.concat(F.lit("one gain is needed, not: "), F.array_join(found, ", "))).cast("double")))


def channel_maps(headers: DataFrame, header: str = "header") -> DataFrame:
    """``headers`` with ``electrodes`` (ids), ``channels`` (their attributes), both in the order of the text, and ``fingerprint``, a SHA-256 of both.

    Headers with one map have one fingerprint, whatever else they say; no header gives nulls.
    """
    tags = F.regexp_extract_all(header, F.lit(CHANNEL), F.lit(0))
    out = headers.withColumn("electrodes", F.regexp_extract_all(header, F.lit(ELECTRODE), F.lit(1)))
    out = out.withColumn("channels", F.transform(tags, lambda tag: F.struct(*[attribute(tag, a).alias(a) for a in ATTRIBUTES])))
    both = F.to_json(F.struct("electrodes", "channels"), {"ignoreNullFields": "false"})
    return out.withColumn("fingerprint", F.when(F.col(header).isNotNull(), F.sha2(both, 256)))


def map_history(maps: DataFrame, order: str) -> DataFrame:
    """``(fingerprint, first, last, n)``: from when to when each map was used."""
    return maps.filter("fingerprint is not null").groupBy("fingerprint").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))
