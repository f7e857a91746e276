"""The queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hash_ring, lang_ecoc, mph_store, packing, pii_crf, sentencepieces, simhash, suffix_dedup, threshold_search, transport_stream
from .shared import read


def op1_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no media, so every document is made a stream first; payloads are in base64 for the SQL."""
    units = transport_stream.demux(transport_stream.mux(read(spark, sf_dir, "documents")))
    return units.withColumn("payload", F.translate(F.base64("payload"), "\r\n", ""))


def op2_hash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_ring.assign(read(spark, sf_dir, "documents"))


def op3_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode(read(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op5_threshold_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold_search.neighbours(read(spark, sf_dir, "embeddings"))


def op6_pii_semi_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_crf.find(read(spark, sf_dir, "documents"))


def op7_mph_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mph_store.build(read(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_ecoc.identify(read(spark, sf_dir, "documents"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(read(spark, sf_dir, "documents"))


def op10_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        op1_transport_stream,
        op2_hash_ring,
        op3_sentencepiece_nbest,
        op4_best_fit_packing,
        op5_threshold_top_k,
        op6_pii_semi_crf,
        op7_mph_token_store,
        op8_language_id,
        op9_suffix_array_dedup,
        op10_simhash_near_duplicates,
    ]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_transport_stream": transport_stream.ORACLE,
        "op2_hash_ring": hash_ring.oracle(),
        "op5_threshold_top_k": threshold_search.oracle(),
    }
