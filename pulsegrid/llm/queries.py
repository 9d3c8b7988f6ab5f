"""One query per operator over its whole table, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import collocations, decontaminate, embedding_dedup, license_scan, lm_scoring, quality, vector_codes
from pulsegrid.llm.common import id_bucket
from pulsegrid.llm.hilbert_shards import hilbert_shards
from pulsegrid.llm.piece_codec import encode_decode
from pulsegrid.llm.pii_surrogates import replace_entities
from pulsegrid.llm.simhash import near_duplicates
from pulsegrid.llm.token_counts import token_counts
from pulsegrid.llm.toxicity import score_toxicity
from pulsegrid.session import table

#: Surrogate key of the registered queries; a real corpus needs a secret of its own.
KEY = "pulsegrid test key"
ORACLES: dict[str, str] = {
    "op9_decontaminate": decontaminate.SQL, "op11_vector_codes": vector_codes.SQL, "op12_license_scan": license_scan.SQL, "op13_collocations": collocations.SQL
}


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").filter("quality = 1"))
    return judged.withColumnRenamed("id", "doc_id").drop("row")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(table(spark, sf_dir, "documents"), KEY).select("doc_id", "text", "n_entities")


def op8_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (id_bucket("doc_id", 10) == 0).alias("held_out"))
    return lm_scoring.score(docs, lm_scoring.train(docs.filter("not held_out")), more={"held_out": F.col("held_out")})


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash, op2_token_counts, op3_quality, op4_toxicity, op5_pieces, op6_embeddings, op7_pii_surrogates, op8_hilbert_shards, op9_decontaminate, op10_lm_scoring,
        op11_vector_codes, op12_license_scan, op13_collocations,
    )
}
