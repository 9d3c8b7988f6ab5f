"""Curation documents: verdict files in three shapes, geometry, tab-separated labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERDICTS = ("good", "mua", "noise")


def verdict_rows(texts: DataFrame, text: str = "value") -> DataFrame:
    """``(id, verdict, ts)`` of JSON texts that are a list of records, a list of {id, data} rows, or a map by id.

    An unknown verdict stops the query.
    """
    record = "struct<id: string, verdict: string, ts: bigint, data: struct<verdict: string, ts: bigint>>"
    listed = F.from_json(text, f"array<{record}>")
    mapped = F.transform(F.map_entries(F.from_json(text, "map<string, struct<verdict: string, ts: bigint>>")), lambda e: F.struct(e["key"].alias("id"), e["value"]["verdict"].alias("verdict"), e["value"]["ts"].alias("ts")))
    flat = F.transform(listed, lambda r: F.struct(r["id"].alias("id"), F.coalesce(r["verdict"], r["data"]["verdict"]).alias("verdict"), F.coalesce(r["ts"], r["data"]["ts"]).alias("ts")))
    rows = texts.select(F.inline(F.when(F.trim(F.col(text)).startswith("["), flat).otherwise(mapped)))
    known = F.assert_true(F.col("verdict").isin(*VERDICTS), F.concat(F.lit("unknown verdict "), F.col("verdict")))
    return rows.select("id", F.coalesce(known.cast("string"), F.col("verdict")).alias("verdict"), "ts")


def latest(verdicts: DataFrame) -> DataFrame:
    """The last verdict of each id; of equally late ones the greatest."""
    return verdicts.groupBy("id").agg(F.max_by("verdict", F.struct(F.coalesce("ts", F.lit(0)).alias("ts"), "verdict")).alias("verdict"))


def verdict_files(spark: SparkSession, path: str) -> DataFrame:
    """One JSON file per unit, named by its id."""
    docs = spark.read.schema("ts long, verdict string").option("multiLine", True).json(path)
    return docs.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("id"), "verdict", "ts")


def merge_entries(texts: DataFrame, text: str = "value", labels: tuple[str, ...] = VERDICTS) -> DataFrame:
    """``(parents, merged_id, note, decided, quality_label)`` of JSON texts of merges: records under ``merges`` or alone in a list, or lists of ids.

    Parents are sorted. An unknown label or an entry without parents stops the query; other columns of ``texts`` are ignored.
    """
    record = "parents array<bigint>, merged_id bigint, note string, decided string, quality_label string"
    entries = F.from_json(F.coalesce(F.get_json_object(text, "$.merges"), F.when(F.trim(F.col(text)).startswith("["), F.col(text))), "array<string>")
    rows = texts.select(F.explode(entries).alias("__e"))
    parsed = F.when(F.trim("__e").startswith("["), F.struct(F.from_json("__e", "array<bigint>").alias("parents"), *[F.lit(None).cast(t).alias(c) for c, t in (f.split(" ") for f in record.split(", ")[1:])])).otherwise(F.from_json("__e", record))
    fields = rows.select(parsed.alias("r")).select("r.*")
    known = F.col("quality_label").isNull() | F.col("quality_label").isin(*labels)
    listed = F.col("parents").isNotNull() & (F.size("parents") > 0) & ~F.exists("parents", lambda x: x.isNull())
    checked = F.when(~known, F.raise_error(F.concat(F.lit("unknown label "), F.col("quality_label"))).cast("array<bigint>")).when(~listed, F.raise_error(F.lit("a merge without parents")).cast("array<bigint>"))
    return fields.select(checked.otherwise(F.array_sort("parents")).alias("parents"), "merged_id", "note", "decided", "quality_label")


def selection_ranges(texts: DataFrame, text: str = "value") -> DataFrame:
    """``(unit, place, t0, t1)`` of JSON texts of kept ranges by unit, under ``selections`` or alone, each a list or ``{ranges: list}``.

    Names that begin with an underscore are notes. A unit without ranges keeps everything and has no row; a range that lacks a bound stops the query.
    """
    span = "array<struct<t0: double, t1: double>>"
    units = F.from_json(F.coalesce(F.get_json_object(text, "$.selections"), F.col(text)), "map<string, string>")
    rows = texts.select(F.explode(units).alias("__k", "__v")).filter(~F.col("__k").startswith("_"))
    ranges = F.when(F.trim("__v").startswith("["), F.from_json("__v", span)).otherwise(F.from_json(F.get_json_object("__v", "$.ranges"), span))
    out = rows.select(F.col("__k").cast("long").alias("unit"), F.posexplode(ranges).alias("place", "r"))
    bounded = F.when(F.col("r.t0").isNull() | F.col("r.t1").isNull(), F.raise_error(F.concat(F.lit("a range without a bound: unit "), F.col("unit"))).cast("double"))
    return out.select("unit", "place", bounded.otherwise(F.col("r.t0")).alias("t0"), F.col("r.t1").alias("t1"))


def geometry(spark: SparkSession, path: str) -> DataFrame:
    """``(chan, x, y, shank)`` of a probe file with parallel arrays."""
    doc = spark.read.schema("chanMap array<int>, xc array<double>, yc array<double>, kcoords array<int>").option("multiLine", True).json(path)
    rows = doc.select(F.inline(F.arrays_zip("chanMap", "xc", "yc", "kcoords")))
    return rows.toDF("chan", "x", "y", "shank")


def labels_tsv(spark: SparkSession, path: str, column: str) -> DataFrame:
    """``(cluster_id, <column>)`` of a tab-separated file with a header."""
    return spark.read.option("sep", "\t").option("header", True).schema(f"cluster_id int, `{column}` string").csv(path)


def write_label_columns(scores: DataFrame, key: str, path: str) -> None:
    """One folder of tab-separated files per score column, sorted by id."""
    for column in (c for c in scores.columns if c != key):
        scores.select(F.col(key).alias("cluster_id"), column).orderBy("cluster_id").write.option("sep", "\t").option("header", True).mode("error").csv(f"{path}/cluster_{column}")
