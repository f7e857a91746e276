"""One handle for an index in a folder: build, search, change, inspect."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import result_url
from .functions.tokenizer import query_terms
from .operators import prune, reorder
from .operators import search as ops
from .operators.index import Index
from .operators.segments import SegmentedIndex
from .sources.documents import read_jsonl

ORDERS = ("none", "path", "bp")


@dataclass
class Outcome:
    """Results as rows of (rank, id, score, title), the time they took, and the work of a pruned search."""

    query: str
    results: list
    took_ms: float
    counters: prune.Counters | None = None


class SearchIndex(SegmentedIndex):
    """A ``SegmentedIndex`` with the whole interface; one segment without deletes is a plain index."""

    @classmethod
    def build(cls, spark: SparkSession, docs: DataFrame, path: str, order: str = "none", title_weight: int = 2, remove_stopwords: bool = True) -> SearchIndex:
        """A new index of ``docs(id, title, body)``; ``order`` is none, path or bp."""
        if order not in ORDERS:
            raise ValueError(f"unknown order {order!r}")
        made = cls.create(spark, path, title_weight, remove_stopwords)
        if made.manifest["segments"]:
            raise FileExistsError(f"there is an index at {path}; add to it instead")
        if docs.head(1):
            made.add(docs)
        if order != "none" and docs.head(1):
            made._reorder(order)
        return made

    @classmethod
    def build_from_jsonl(cls, spark: SparkSession, source: str, path: str, **options) -> SearchIndex:
        return cls.build(spark, read_jsonl(spark, source), path, **options)

    def _reorder(self, order: str) -> None:
        """Write the only segment again under new document ids."""
        docs, posted = self.docs, self.postings
        if order == "path":
            ids = reorder.by_path(docs.select("doc_id", "id")).select("doc_id", "new_id")
        else:
            ids = reorder.bisection(posted, docs)
        self._only(reorder.renumber(docs, ids), reorder.renumber(posted, ids))

    def single(self) -> Index:
        """The tables of an index of one clean segment, for the plans over single indexes."""
        if len(self.manifest["segments"]) != 1 or self._dead():
            raise ValueError("merge the segments first")
        docs, posted, terms, buckets = (x.drop("segment") for x in (self.docs, self.postings, self.terms, self.buckets))
        return Index(docs, posted, terms, self.corpus, self.manifest["remove_stopwords"], self.manifest["title_weight"], buckets)

    def run(self, query: str, k: int = 10) -> Outcome:
        """Search and fetch the results."""
        start = time.perf_counter()
        rows = self.search(query, k).collect()  # k rows
        return Outcome(query, rows, (time.perf_counter() - start) * 1000)

    def run_pruned(self, query: str, k: int = 10) -> Outcome:
        """As ``run`` by a pruned plan, with its counters; for a single clean segment."""
        start, index = time.perf_counter(), self.single()
        hits, counters = prune.search_pruned(index, query, k)
        rows = ops.with_titles(index, hits, k).orderBy("rank").collect()  # k rows
        return Outcome(query, rows, (time.perf_counter() - start) * 1000, counters)

    def with_urls(self, results: DataFrame, template: str) -> DataFrame:
        return results.withColumn("url", result_url(template, F.col("id"), F.col("title")))

    def terms_of(self, query: str) -> list[str]:
        return query_terms(query, self.manifest["remove_stopwords"])

    def bench(self, queries: list[str], k: int = 10) -> dict[str, float]:
        """Latencies of queries run one after the other, after a pass that warms up; percentiles by nearest rank."""
        for q in queries:
            self.run(q, k)
        times = sorted(self.run(q, k).took_ms for q in queries)
        at = lambda p: times[max(0, -(-len(times) * p // 100) - 1)]
        return {"queries": len(times), "avg_ms": sum(times) / len(times), "p50_ms": at(50), "p95_ms": at(95), "p99_ms": at(99), "min_ms": times[0], "qps": 1000 * len(times) / sum(times)}
