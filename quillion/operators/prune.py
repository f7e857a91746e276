"""Exact top-k that leaves out what can't reach it: by ranges of documents, or by terms.

Both plans compute a threshold first (the k-th best score among some candidates)
and then drop what is bounded strictly below it.  They need bounds that hold, so
a negative idf (more documents with the term than live ones) makes them fall back
to scoring everything.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bm25
from ..functions.tokenizer import query_terms
from .index import Index, bounds
from .search import HITS, matched, scored, search, top

SLACK = 1e-5
#: Document ids of a stored range.
WIDTH = 64
MAXSCORE_TERMS = 5


@dataclass
class Counters:
    """Work of a pruned query, in the plan's own units: postings, documents, and (term, range) pairs."""

    docs_total: int
    query_terms: int
    postings_visited: int
    docs_scored: int
    blocks_visited: int
    blocks_skipped: int


def ranges(posted: DataFrame, width: int = WIDTH) -> DataFrame:
    """(term, bucket, max_tf, min_len, n) of ranges of ``width`` document ids."""
    return posted.groupBy("term", F.expr(f"doc_id div {width}").alias("bucket")).agg(F.max("tf").alias("max_tf"), F.min("doc_len").alias("min_len"), F.count("*").alias("n"))


def stored_ranges(posted: DataFrame) -> DataFrame:
    """``ranges`` in order of the terms: laid out by terms and ranges once, and gathered there."""
    placed = posted.withColumn("bucket", F.expr(f"doc_id div {WIDTH}")).repartitionByRange("term", "bucket")
    got = placed.groupBy("term", "bucket").agg(F.max("tf").alias("max_tf"), F.min("doc_len").alias("min_len"), F.count("*").alias("n"))
    return got.sortWithinPartitions("term", "bucket")


def _usable(index: Index, wanted: list[str]) -> bool:
    _, stats = matched(index, wanted)
    low = stats.join(F.broadcast(index.corpus_stats), F.lit(True)).agg(F.min(bm25.idf("n_docs", "df"))).first()[0]
    return low is None or low >= 0


def search_ranges(index: Index, query: str, k: int = 10, width: int = WIDTH, first: int = 8, counted: bool = True) -> tuple[DataFrame, Counters | None]:
    """(hits, counters) by bounds of document ranges: the ``first`` best ranges give the threshold.

    Bounds come from the index's stored ranges, if it has them of this width, else
    from the postings.  Counting the work is a query of its own and left out
    without ``counted``; postings that were read for bounds count as visited.
    """
    wanted = query_terms(query, index.remove_stopwords)
    if k <= 0 or not wanted or not _usable(index, wanted):
        return search(index, query, k), None
    posted, stats = matched(index, wanted)
    stored = index.buckets is not None and width == WIDTH
    each = bounds(index.buckets.where(F.col("term").isin(*wanted)) if stored else ranges(posted, width), stats, index.corpus_stats)
    upper = each.groupBy("bucket").agg(F.sum("bound").alias("upper"), F.count("*").alias("pairs"))
    placed = posted.withColumn("bucket", F.expr(f"doc_id div {width}"))
    best = upper.orderBy(F.desc("upper"), "bucket").limit(first)
    trial = scored(placed.join(F.broadcast(best), "bucket", "left_semi"), stats, index.corpus_stats)
    least = trial.orderBy(F.desc("score")).limit(k).agg(F.min("score"), F.count("*")).first()
    threshold = least[0] - SLACK if least[1] == k else float("-inf")
    live = upper.where(F.col("upper") >= threshold)
    kept = placed.join(live.select("bucket"), "bucket", "left_semi")
    scores = scored(kept, stats, index.corpus_stats)
    if not counted:
        return top(scores, k).select("rank", "doc_id", "score"), None
    count = kept.agg(F.count("*"), F.count_distinct("doc_id")).first()
    read = 0 if stored else posted.count()
    pairs = upper.agg(F.coalesce(F.sum("pairs"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("upper") >= threshold, F.col("pairs"))), F.lit(0))).first()
    counters = Counters(index.corpus_stats.first()["n_docs"], len(wanted), read + count[0], count[1], pairs[1], pairs[0] - pairs[1])
    return top(scores, k).select("rank", "doc_id", "score"), counters


def essential(weights: list[tuple[str, float]], threshold: float) -> list[str]:
    """The terms of which a document needs one to reach the threshold; ``weights`` has each term's bound."""
    rising, total, out = sorted(weights, key=lambda x: (x[1], x[0])), 0.0, []
    for term, bound in rising:
        total += bound
        if total >= threshold:
            out.append(term)
    return out


def search_essential(index: Index, query: str, k: int = 10, counted: bool = True) -> tuple[DataFrame, Counters | None]:
    """(hits, counters) by bounds of terms: documents without an essential term are not scored.

    The term of greatest bound gives the threshold.
    """
    wanted = query_terms(query, index.remove_stopwords)
    if k <= 0 or not wanted or not _usable(index, wanted):
        return search(index, query, k), None
    posted, stats = matched(index, wanted)
    listed = bounds(index.term_stats.where(F.col("term").isin(*wanted)), stats, index.corpus_stats).select("term", "bound", "df").collect()  # the query's terms
    if not listed:
        return index.docs.sparkSession.createDataFrame([], HITS), None
    strongest = max(listed, key=lambda r: (r["bound"], r["term"]))["term"]
    trial = scored(posted.where(F.col("term") == strongest), stats, index.corpus_stats)
    least = trial.orderBy(F.desc("score")).limit(k).agg(F.min("score"), F.count("*")).first()
    threshold = least[0] - SLACK if least[1] == k else float("-inf")
    needed = essential([(r["term"], r["bound"]) for r in listed], threshold)
    if len(needed) == len(listed):
        kept = posted
    else:
        # whole documents: their postings of the other terms are kept as well
        has = F.max(F.col("term").isin(*needed)).over(Window.partitionBy("doc_id"))
        kept = posted.withColumn("_has", has).where("_has").drop("_has")
    if not counted:
        return top(scored(kept, stats, index.corpus_stats), k).select("rank", "doc_id", "score"), None
    count = kept.agg(F.count("*"), F.count_distinct("doc_id")).first()
    counters = Counters(index.corpus_stats.first()["n_docs"], len(wanted), count[0], count[1], len(needed), len(listed) - len(needed))
    return top(scored(kept, stats, index.corpus_stats), k).select("rank", "doc_id", "score"), counters


def search_pruned(index: Index, query: str, k: int = 10) -> tuple[DataFrame, Counters | None]:
    """By terms from five distinct terms on, by ranges below."""
    many = len(query_terms(query, index.remove_stopwords)) >= MAXSCORE_TERMS
    return search_essential(index, query, k) if many else search_ranges(index, query, k)


def counters_row(spark, counters: Counters) -> DataFrame:
    return spark.createDataFrame([tuple(vars(counters).values())], ", ".join(f"{x} long" for x in vars(counters)))
