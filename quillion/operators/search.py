"""Exact BM25 top-k: one query, or a table of queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bm25
from ..functions.tokenizer import distinct_terms, query_terms
from ..sources.tables import dense_ids
from .index import Index

HEAP = 1 << 14
#: Pairs of posting and query that a task of a batch meets.
MET = 1 << 21
#: Rows of a batch's terms up to which they go to every task.
FEW = 1 << 18
HITS = "rank int, doc_id long, score double"


def scored(posted: DataFrame, stats: DataFrame, corpus: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, score): the rounded sum of the contributions of ``posted``, whose terms are the query's."""
    got = posted.join(stats.select("term", "df"), "term").join(F.broadcast(corpus), F.lit(True))  # one row
    part = bm25.contribution(bm25.idf("n_docs", "df"), "tf", "doc_len", "avg_doc_len")
    return got.groupBy(*keys).agg(bm25.rounded(F.sum(part)).alias("score"))


def top(scores: DataFrame, k: int, ties: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(rank, ..., score) of the k best, by falling score, then by ``ties``.

    Up to ``HEAP`` each task keeps k rows and the rank is given to k rows only;
    beyond, all rows are sorted by ranges and numbered.
    """
    if k > HEAP:
        ranked = dense_ids(scores, [F.desc("score"), *ties], "rank", 1).where(F.col("rank") <= k)
        return ranked.withColumn("rank", F.col("rank").cast("int"))
    best = scores.orderBy(F.desc("score"), *ties).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), *ties)))


def matched(index: Index, wanted: list[str]) -> tuple[DataFrame, DataFrame]:
    """Postings and statistics of a query's terms, a handful of rows of statistics."""
    return index.postings.where(F.col("term").isin(*wanted)), F.broadcast(index.term_stats.where(F.col("term").isin(*wanted)))


def search(index: Index, query: str, k: int = 10) -> DataFrame:
    """(rank, doc_id, score) of the k best documents; equal scores by doc_id, all matches if there are fewer."""
    wanted = query_terms(query, index.remove_stopwords)
    if k <= 0 or not wanted:
        return index.docs.sparkSession.createDataFrame([], HITS)
    posted, stats = matched(index, wanted)
    return top(scored(posted, stats, index.corpus_stats), k).select("rank", "doc_id", "score")


def few(hits: DataFrame, k: int) -> DataFrame:
    """``hits`` marked for broadcast if k bounds them to a few rows; else Spark goes by their size."""
    return F.broadcast(hits) if k <= HEAP else hits


def with_titles(index: Index, hits: DataFrame, k: int = 10) -> DataFrame:
    """(rank, id, score, title): the documents of the k hits are looked up last."""
    return few(hits, k).join(index.docs.select("doc_id", "id", "title"), "doc_id").select("rank", "id", "score", "title")


def met(index: Index, asked: DataFrame, *columns: str) -> DataFrame:
    """``asked(query_id, term, df, ...)`` with the postings (doc_id, columns) of each term, all of a document in one task.

    The postings of asked terms are shuffled, each once whatever number of queries
    has its term, into tasks of about ``MET`` pairs: more queries or documents make
    more tasks, not larger ones.
    """
    n, pairs = asked.agg(F.count("*"), F.coalesce(F.sum("df"), F.lit(0))).first()
    spark = asked.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-pairs // MET))
    small = F.broadcast if n <= FEW else lambda df: df
    own = index.postings.select("term", "doc_id", *columns).join(small(asked.select("term").distinct()), "term", "left_semi")
    return own.repartition(tasks, "doc_id").join(small(asked), "term")


def search_batch(index: Index, queries: DataFrame, k: int = 10, query: str = "query") -> DataFrame:
    """(query_id, rank, doc_id, score) for each row of ``queries(query_id, query)``.

    Postings are filtered by the terms of all queries and laid out by documents before they are joined.
    """
    asked = queries.select("query_id", F.explode(distinct_terms(query, index.remove_stopwords)).alias("term"))
    stats = asked.join(index.term_stats.select("term", "df"), "term").join(F.broadcast(index.corpus_stats), F.lit(True))  # one row
    weights = stats.select("query_id", "term", "df", bm25.idf("n_docs", "df").alias("idf"), "avg_doc_len")
    part = bm25.contribution("idf", "tf", "doc_len", "avg_doc_len")
    scores = met(index, weights, "tf", "doc_len").groupBy("query_id", "doc_id").agg(bm25.rounded(F.sum(part)).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def query_work(index: Index, queries: DataFrame, query: str = "query") -> DataFrame:
    """(query_id, term_postings): postings of each query's terms, 0 where no term is known."""
    asked = queries.select("query_id", F.explode_outer(distinct_terms(query, index.remove_stopwords)).alias("term"))
    got = asked.join(index.term_stats.select("term", "df"), "term", "left")
    return got.groupBy("query_id").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("term_postings"))


def batch_work(index: Index, queries: DataFrame, query: str = "query") -> DataFrame:
    """(query_id, docs_scored, postings_visited, term_postings) of scoring each query in full."""
    asked = queries.select("query_id", F.explode(distinct_terms(query, index.remove_stopwords)).alias("term"))
    known = asked.join(index.term_stats.select("term", "df"), "term")
    each = met(index, known).groupBy("query_id", "doc_id").agg(F.count("*").alias("n"))
    seen = each.groupBy("query_id").agg(F.count("*").alias("docs_scored"), F.sum("n").alias("postings_visited"))
    none = F.lit(0)
    return query_work(index, queries, query).join(seen, "query_id", "left").select(
        "query_id", F.coalesce("docs_scored", none).alias("docs_scored"), F.coalesce("postings_visited", none).alias("postings_visited"), "term_postings"
    )
