"""The corpus pipeline: documents of low quality, near copies and benchmark leaks go, personal data is replaced,
and what stays is encoded.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again for the next one; all
but the last return the columns of ``documents``. Rows are told apart by id and text, so repeated and null ids are judged like any
others, and more columns, whatever their names, are carried along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import decontaminate, near_copies, quality
from pulsegrid.llm.common import fresh, row_key, without, written
from pulsegrid.llm.pii_surrogates import replace_entities
from pulsegrid.llm.piece_codec import encode_decode
from pulsegrid.llm.queries import KEY
from pulsegrid.session import table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the model of trusted text is within their language's threshold."""
    return quality.kept_documents(docs, table(spark, sf_dir, "labels").filter("quality = 1"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of SimHash near-duplicates, which are linked by a Jaccard similarity of 0.8 or
    more of five-word shingles; of rows that repeat id and text one stays."""
    return near_copies.single_documents(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    keyed = docs.select(row_key().alias("row"), "text")
    leaks = decontaminate.contained_items(keyed, table(spark, sf_dir, "benchmark"), id_col="row")
    return without(docs, leaks.select("row"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data and the length of the new text."""
    replaced = replace_entities(docs, KEY, count_col=fresh("n_entities", docs.columns))
    return replaced.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids' count and digest, and the digest of the decoded text, of each document."""
    return encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)


STAGES = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("benchmark_leaks", drop_leaks),
    ("personal_data", replace_personal_data),
    ("encode", encode),
]

#: No SQL expresses the perplexity model, the fingerprints or the encoding; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
