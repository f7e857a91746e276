"""Sizes that packed postings and a front-coded dictionary have, as plans over the postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bits_needed
from ..sources.tables import dense_ids, prefix_sums
from .index import BLOCK, with_gaps

HEADER = 8
GROUP = 16
LONGEST_PREFIX = 255


def gaps(posted: DataFrame, block: int = BLOCK) -> DataFrame:
    """(term, block_no, doc_id, tf, gap): the ids left out since the block's posting before; null at its first."""
    return with_gaps(posted, block).select("term", "block_no", "doc_id", "tf", "gap")


def packed_blocks(posted: DataFrame, block: int = BLOCK) -> DataFrame:
    """(term, block_no, n, doc_bits, tf_bits, bytes): a header, then gaps and tf - 1 at the widths that the block needs."""
    widths = gaps(posted, block).groupBy("term", "block_no").agg(
        F.count("*").alias("n"), bits_needed(F.coalesce(F.max("gap"), F.lit(0))).alias("doc_bits"), bits_needed(F.max("tf") - 1).alias("tf_bits")
    )
    bits = (F.col("n") - 1) * F.col("doc_bits") + F.col("n") * F.col("tf_bits")
    return widths.withColumn("bytes", HEADER + F.floor((bits + 7) / 8).cast("long"))


def offsets(packed: DataFrame) -> DataFrame:
    """``packed`` with ``byte_offset``: where each block begins if all lie one behind the other, by term and number."""
    return prefix_sums(packed, ["term", "block_no"], "bytes", "byte_offset")


def encoded(posted: DataFrame, block: int = BLOCK) -> DataFrame:
    """(term, block_no, first_doc, gaps, less): a row for each block, ``gaps`` from its second posting on, ``less`` is tf - 1."""
    rows = F.sort_array(F.collect_list(F.struct("doc_id", "gap", "tf")))  # a block's postings, 128 at most
    held = gaps(posted, block).groupBy("term", "block_no").agg(rows.alias("rows"))
    return held.select(
        "term", "block_no", F.col("rows")[0]["doc_id"].alias("first_doc"), F.expr("slice(rows.gap, 2, size(rows))").alias("gaps"), F.transform("rows", lambda r: r["tf"] - 1).alias("less")
    )


def decoded(blocks: DataFrame) -> DataFrame:
    """(term, block_no, doc_id, tf) of ``encoded`` blocks: the running sum of the gaps, and the ids between them, each block by itself."""
    ids = F.expr("aggregate(gaps, array(first_doc), (ids, g) -> concat(ids, array(element_at(ids, -1) + g + 1)))")  # 128 at most
    rows = blocks.select("term", "block_no", F.inline_outer(F.arrays_zip(ids.alias("doc_id"), F.transform("less", lambda t: t + 1).alias("tf"))))
    return rows.select("term", "block_no", "doc_id", "tf")


def frequency_at(blocks: DataFrame, place: str = "place") -> DataFrame:
    """``blocks`` with ``tf`` of the posting at a place in its block, without decoding the others; null outside."""
    return blocks.withColumn("tf", F.get("less", F.col(place)) + 1)


def ratio(packed: DataFrame) -> DataFrame:
    """One row: packed_bytes, raw_bytes (two numbers of four bytes a posting)."""
    return packed.agg(F.sum("bytes").alias("packed_bytes"), (F.sum("n") * 8).alias("raw_bytes"))


def dictionary(stats: DataFrame) -> DataFrame:
    """(term, term_id): ranks of the terms in order, from 0."""
    return dense_ids(stats.select("term"), ["term"], "term_id")


def terms_at(ranks: DataFrame, listed: DataFrame) -> DataFrame:
    """``ranks(term_id)`` with the term of each rank in ``dictionary``; null where there is none."""
    return ranks.join(listed, "term_id", "left")


def front_coded(terms: DataFrame) -> DataFrame:
    """(group_no, head, encoded_bytes) of groups of sixteen terms: each stores what differs from the term before."""
    code = terms.select("term", "term_id", F.expr(f"term_id div {GROUP}").alias("group_no"), F.hex(F.encode("term", "UTF-8")).alias("h"))
    own = Window.partitionBy("group_no").orderBy("term_id")
    pair = code.withColumn("p", F.lag("h").over(own))
    least = f"least(length(h), length(p)) div 2, {LONGEST_PREFIX}"
    differ = f"filter(sequence(1, least({least})), i -> substr(h, 2 * i - 1, 2) <> substr(p, 2 * i - 1, 2))"
    shared = F.expr(f"CASE WHEN least({least}) = 0 THEN 0 ELSE coalesce(array_min({differ}) - 1, least({least})) END")
    size = F.length("h") / 2
    coded = F.when(F.col("p").isNull(), 2 + size).otherwise(3 + size - shared)
    return pair.withColumn("bytes", coded.cast("long")).groupBy("group_no").agg(F.min_by("term", "term_id").alias("head"), F.sum("bytes").alias("encoded_bytes"))
