"""Reports on timings: nearest-rank percentiles, work ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def percentiles(rows: DataFrame, value: str) -> DataFrame:
    """One row: n, mean, p50, p95, p99 (values that occur, by nearest rank)."""
    disc = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").alias(f"p{round(100 * p)}")
    return rows.agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), disc(0.5), disc(0.95), disc(0.99))


def work_ratios(work: DataFrame, docs_total: int) -> DataFrame:
    """One row from (docs_scored, postings_visited, term_postings): mean shares of the corpus and of the terms' postings."""
    seen = F.when(F.col("term_postings") > 0, F.col("postings_visited") / F.col("term_postings"))
    return work.agg(
        F.count("*").alias("num_queries"),
        F.coalesce(F.avg(F.col("docs_scored") / F.lit(max(docs_total, 1))), F.lit(0.0)).alias("docs_scored_ratio"),
        F.coalesce(F.avg(seen), F.lit(0.0)).alias("postings_visited_ratio"),
    )
