"""The corpus pipeline: language ID, near-dedup, repeated passages, PII, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.  All but the last
return the columns of ``docs``, extra ones and ones with clashing names included.

Every stage has a defined result for an empty table (no row), for very long texts
(read whole) and for repeated rows; what it does with nulls, empty texts and ties
is said with it, and in full in the module that it calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillion.llm import lang_ecoc, packing, pii_crf, simhash, suffix_dedup
from quillion.llm.shared import discard, materialize


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the identifier rejects go.

    So do null and empty texts and those without letters.  Rows are judged one by
    one, a null ``doc_id`` or ``lang`` changes nothing; of languages at equal
    distance the first in order is taken, which keeps the document.
    """
    return lang_ecoc.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the least by (doc_id, hash of the text).

    Rows with a null ``doc_id`` and null and empty texts are in no group and stay;
    of rows alike in id and text one stays.
    """
    return simhash.keep_one_of_each(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that occur earlier are cut from the texts.

    A text of which nothing is left goes; null and empty texts, and rows with a
    null ``doc_id``, stay as they are.
    """
    return suffix_dedup.cut_repeats(docs)


def mask_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Private data becomes its type in brackets; no row goes, null and empty texts stay as they are."""
    return pii_crf.mask(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each training sequence, with the pieces of documents in it and their token ids.

    Null and empty texts have no token; rows with a null or an equal ``doc_id`` are
    packed each for itself.
    """
    # the stages before have left their own workers and memory behind: time is spent to save room
    return packing.pack(docs, keep_words=False)


STAGES = [
    ("language_id", identify_languages),
    ("near_dedup", drop_near_duplicates),
    ("repeated_passages", cut_repeated_passages),
    ("private_data", mask_private_data),
    ("packing", pack_sequences),
]

#: The stages train models and follow chains of copies, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
            discard(before)
    return docs
