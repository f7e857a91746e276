"""Segments: immutable batches of documents, tombstones, and statistics over all of them.

The functions work on DataFrames with a ``segment`` column; ``SegmentedIndex``
keeps them in a folder.  Every change writes new files and then a manifest of the
next number, which is the only commit: the highest number is the index, so a
writer that dies at any point leaves the index as it was.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bm25
from ..functions.text import content_hash
from ..functions.tokenizer import distinct_terms, query_terms
from ..sources import tables
from .index import BLOCK, analyse, analysed_once, term_stats
from .prune import Counters, stored_ranges
from .search import few, top

_MANIFEST = re.compile(r"manifest-(\d+)\.json")
KEYS = ["segment", "doc_id"]
TOMBSTONES = "segment int, doc_id long"


def _manifest(path: str, version: int) -> str:
    return f"{path}/manifest-{version:012d}.json"


def live(rows: DataFrame, tombstones: DataFrame) -> DataFrame:
    """The rows (documents or postings) whose document is not deleted."""
    return rows.join(tombstones.select(*KEYS), KEYS, "left_anti")


def live_stats(docs: DataFrame, tombstones: DataFrame) -> DataFrame:
    """One row: n_docs, total_len, avg_doc_len of the live documents of all segments."""
    got = live(docs, tombstones).agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("doc_len"), F.lit(0)).cast("long").alias("total_len"))
    return got.withColumn("avg_doc_len", bm25.average_length("total_len", "n_docs"))


def frequencies(posted: DataFrame, tombstones: DataFrame) -> DataFrame:
    """(term, df_all, df_live): deleted documents count for df until segments are merged."""
    marked = posted.join(tombstones.select(*KEYS, F.lit(1).alias("_dead")), KEYS, "left")
    return marked.groupBy("term").agg(F.count("*").alias("df_all"), F.count_if(F.col("_dead").isNull()).alias("df_live"))


def scores(posted: DataFrame, docs: DataFrame, tombstones: DataFrame, wanted: list[str], terms: DataFrame | None = None, corpus: DataFrame | None = None) -> DataFrame:
    """(segment, doc_id, score) of the live documents with a wanted term, by statistics over all segments.

    ``terms(segment, term, df)`` and ``corpus`` (one row) are what an index has stored; without them both are counted.
    """
    own = posted.where(F.col("term").isin(*wanted))
    counts = own.groupBy("term").agg(F.count("*").alias("df")) if terms is None else terms.where(F.col("term").isin(*wanted)).groupBy("term").agg(F.sum("df").alias("df"))
    weights = counts.join(F.broadcast(live_stats(docs, tombstones) if corpus is None else corpus), F.lit(True))
    weights = weights.select("term", bm25.idf("n_docs", "df").alias("idf"), "avg_doc_len")  # a row for each wanted term
    part = bm25.contribution("idf", "tf", "doc_len", "avg_doc_len")
    return live(own, tombstones).join(F.broadcast(weights), "term").groupBy(*KEYS).agg(bm25.rounded(F.sum(part)).alias("score"))


def search(posted: DataFrame, docs: DataFrame, tombstones: DataFrame, query: str, k: int = 10, remove_stopwords: bool = True, **stored: DataFrame) -> DataFrame:
    """(rank, segment, doc_id, score); equal scores by segment, then doc_id."""
    wanted = query_terms(query, remove_stopwords)
    if k <= 0 or not wanted:
        return docs.sparkSession.createDataFrame([], "rank int, segment int, doc_id long, score double")
    return top(scores(posted, docs, tombstones, wanted, **stored), k, tuple(KEYS)).select("rank", *KEYS, "score")


def first_live(docs: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Live documents with ``copy``, the place of each among those of its id, by segment and doc_id, from 1."""
    order = Window.partitionBy("id").orderBy("segment", "doc_id")
    return live(docs, tombstones).withColumn("copy", F.row_number().over(order))


def resolve_deletes(docs: DataFrame, tombstones: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, segment, doc_id) that deleting each of ``ids(id)`` once hits; ids without a live document are left out."""
    times = ids.groupBy("id").agg(F.count("*").alias("times"))
    wanted = docs.join(times.select("id"), "id", "left_semi")  # before anything of the documents is shuffled
    return first_live(wanted, tombstones).join(times, "id").where("copy <= times").select("id", *KEYS)


def classify(batch: DataFrame, docs: DataFrame, tombstones: DataFrame) -> DataFrame:
    """``batch(id, title, body)`` with ``status``: added, updated or unchanged against the first live document of its id.

    Copies within the batch are all compared with what was there before.
    """
    wanted = docs.join(batch.select("id").distinct(), "id", "left_semi")
    held = first_live(wanted, tombstones).where("copy = 1").select("id", F.col("content_hash").alias("_held"))
    status = F.when(F.col("_held").isNull(), "added").when(F.col("_held") == content_hash("title", "body"), "unchanged").otherwise("updated")
    return batch.join(held, "id", "left").withColumn("status", status).drop("_held")


def renumbered(docs: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Live documents with ``new_id``, dense from 0 in the order of segment and doc_id."""
    return tables.dense_ids(live(docs, tombstones), KEYS, "new_id")


def merged(posted: DataFrame, docs: DataFrame, tombstones: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings, documents) of one segment 0 with what is live; terms without live documents vanish."""
    ids = renumbered(docs, tombstones)
    moved = posted.join(ids.select(*KEYS, "new_id"), KEYS)
    new_docs = ids.select(F.lit(0).alias("segment"), F.col("new_id").alias("doc_id"), "id", "title", "snippet", "doc_len", "content_hash")
    return moved.select(F.lit(0).alias("segment"), "term", F.col("new_id").alias("doc_id"), "tf", "doc_len"), new_docs


class SegmentedIndex:
    """An updatable index in a folder: Parquet for each segment, one table of tombstones, numbered manifests.

    A segment's folder has ``docs``, ``postings``, and beside them ``terms`` (df and
    impacts of each term) and ``buckets`` (impacts by ranges of documents); what is
    live and how long it is stands in the manifest.  Searches read these, they count
    nothing.
    """

    def __init__(self, spark: SparkSession, path: str, manifest: dict):
        self.spark, self.path, self.manifest = spark, path, manifest

    @staticmethod
    def _versions(spark: SparkSession, path: str) -> list[int]:
        names = (_MANIFEST.fullmatch(x) for x in tables.children(spark, path))
        return sorted(int(m[1]) for m in names if m)

    @classmethod
    def create(cls, spark: SparkSession, path: str, title_weight: int = 2, remove_stopwords: bool = True) -> SegmentedIndex:
        """Open the index, or make an empty one; the settings of one that is there win.

        A folder with segments and no manifest is an error: something has been lost there, and it isn't overwritten.
        """
        if cls._versions(spark, path):
            return cls.open(spark, path)
        if any(x.startswith("seg-") for x in tables.children(spark, path)):
            raise FileExistsError(f"{path} has segments but no manifest")
        made = cls(spark, path, {"version": 0, "next": 0, "title_weight": max(1, title_weight), "remove_stopwords": remove_stopwords, "segments": [], "counts": {}, "tombstones": None})
        made._commit(made.manifest)
        return made

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> SegmentedIndex:
        versions = cls._versions(spark, path)
        if not versions:
            raise FileNotFoundError(f"there is no index at {path}")
        return cls(spark, path, json.loads(tables.read_text(spark, _manifest(path, versions[-1]))))

    def _commit(self, manifest: dict) -> None:
        """Make ``manifest`` the index, unless another writer has committed since this one was read; older ones but the last go."""
        manifest = manifest | {"version": self.manifest["version"] + 1}
        tables.write_once(self.spark, _manifest(self.path, manifest["version"]), json.dumps(manifest))
        self.manifest = manifest
        for n in self._versions(self.spark, self.path)[:-2]:
            tables.remove(self.spark, _manifest(self.path, n))

    def _all(self, what: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/seg-{n:06d}/{what}" for n in self.manifest["segments"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    @property
    def docs(self) -> DataFrame:
        return self._all("docs", "segment int, doc_id long, id string, title string, snippet string, doc_len long, content_hash long")

    @property
    def postings(self) -> DataFrame:
        return self._all("postings", "segment int, term string, doc_id long, tf long, doc_len long")

    @property
    def terms(self) -> DataFrame:
        return self._all("terms", "segment int, term string, df long, max_tf long, min_len long")

    @property
    def buckets(self) -> DataFrame:
        return self._all("buckets", "segment int, term string, bucket long, max_tf long, min_len long, n long")

    @property
    def corpus(self) -> DataFrame:
        """One row: n_docs, total_len, avg_doc_len of what is live, from the manifest."""
        counts = self.manifest["counts"].values()
        n, total = sum(c["docs"] - c["dead"] for c in counts), sum(c["len"] - c["dead_len"] for c in counts)
        return self.spark.createDataFrame([(n, total, total / n if total else 1.0)], "n_docs long, total_len long, avg_doc_len double")

    @property
    def tombstones(self) -> DataFrame:
        at = self.manifest["tombstones"]
        return self.spark.read.schema(TOMBSTONES).parquet(f"{self.path}/{at}") if at else self.spark.createDataFrame([], TOMBSTONES)


    def _store(self, number: int, docs: DataFrame, posted: DataFrame) -> dict[str, int]:
        """Write a segment's tables and the statistics beside them; its counts."""
        base = f"{self.path}/seg-{number:06d}"
        docs.write.mode("overwrite").parquet(f"{base}/docs")
        posted.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{base}/postings")
        return self._count(number)

    def _count(self, number: int) -> dict[str, int]:
        """Write ``terms`` and ``buckets`` of a written segment; its counts."""
        base, read = f"{self.path}/seg-{number:06d}", self.spark.read.parquet
        own = F.lit(number).alias("segment")
        posted = read(f"{base}/postings")
        terms = term_stats(posted).repartitionByRange("term").sortWithinPartitions("term")
        terms.select(own, "*").write.mode("overwrite").parquet(f"{base}/terms")
        stored_ranges(posted).select(own, "*").write.mode("overwrite").parquet(f"{base}/buckets")
        held = read(f"{base}/docs").agg(F.count("*"), F.coalesce(F.sum("doc_len"), F.lit(0))).first()
        listed = read(f"{base}/terms").agg(F.count("*"), F.coalesce(F.sum("df"), F.lit(0))).first()
        return {"docs": held[0], "len": held[1], "dead": 0, "dead_len": 0, "terms": listed[0], "postings": listed[1]}

    def _write(self, number: int, docs: DataFrame) -> dict[str, int]:
        ready = tables.dense_ids(tables.spread(docs.select("id", "title", "body")), [], "doc_id").withColumn("segment", F.lit(number))
        analysed = analyse(ready, self.manifest["title_weight"], self.manifest["remove_stopwords"])
        return self._store(number, *analysed_once(analysed))

    def _bury(self, more: DataFrame, number: int) -> dict:
        """What the manifest says after these (segment, doc_id) are dead as well."""
        name = f"tombstones-{number:06d}"
        self.tombstones.unionByName(more.select(*KEYS)).distinct().write.mode("overwrite").parquet(f"{self.path}/{name}")
        dead = self.docs.join(more.select(*KEYS).distinct(), KEYS, "left_semi").groupBy("segment").agg(F.count("*").alias("n"), F.sum("doc_len").alias("len"))
        counts = {k: dict(v) for k, v in self.manifest["counts"].items()}
        for r in dead.collect():  # a row for each segment
            counts[str(r["segment"])]["dead"] += r["n"]
            counts[str(r["segment"])]["dead_len"] += r["len"]
        return {"tombstones": name, "counts": counts}

    def add(self, docs: DataFrame) -> str:
        """A new segment of ``docs(id, title, body)``; ids may be there already.  An empty batch is an error."""
        if not docs.head(1):
            raise ValueError("no documents to add")
        return self._replace(self.tombstones.where("false"), docs)

    def delete(self, *ids: str) -> int:
        """Delete one live document for each id; how many there were."""
        hit = tables.written(resolve_deletes(self.docs, self.tombstones, self.spark.createDataFrame([(i,) for i in ids], "id string")), "deleted")
        n = hit.count()
        if n:
            number = self.manifest["next"]
            self._commit(self.manifest | {"next": number + 1} | self._bury(hit, number))
        return n

    def update(self, docs: DataFrame) -> str:
        """Replace the documents of these ids, or add them."""
        hit = resolve_deletes(self.docs, self.tombstones, docs.select("id"))
        return self._replace(tables.written(hit, "replaced"), docs)

    def _replace(self, hit: DataFrame, docs: DataFrame) -> str:
        number = self.manifest["next"]
        own = self._write(number, docs)
        changed = {"next": number + 1, "segments": [*self.manifest["segments"], number]}
        if hit.head(1):
            changed |= self._bury(hit, number)
        changed["counts"] = changed.get("counts", self.manifest["counts"]) | {str(number): own}
        self._commit(self.manifest | changed)
        return f"seg-{number:06d}"

    def upsert(self, docs: DataFrame) -> tuple[int, int, int]:
        """(added, updated, unchanged): documents whose content is the same are skipped, the others go to one new segment."""
        ready = tables.written(classify(docs.select("id", "title", "body"), self.docs, self.tombstones), "upsert")
        n = {r["status"]: r["n"] for r in ready.groupBy("status").agg(F.count("*").alias("n")).collect()}
        changed = ready.where("status <> 'unchanged'")
        if n.get("added", 0) + n.get("updated", 0):
            hit = resolve_deletes(self.docs, self.tombstones, ready.where("status = 'updated'").select("id"))
            self._replace(tables.written(hit, "replaced"), changed.drop("status"))
        return n.get("added", 0), n.get("updated", 0), n.get("unchanged", 0)

    def _only(self, docs: DataFrame, posted: DataFrame) -> None:
        """Commit these tables as the only segment and remove what was there."""
        number, old, buried = self.manifest["next"], list(self.manifest["segments"]), self.manifest["tombstones"]
        segment = F.lit(number).alias("segment")
        own = self._store(number, docs.select(segment, "doc_id", "id", "title", "snippet", "doc_len", "content_hash"), posted.select(segment, "term", "doc_id", "tf", "doc_len"))
        self._commit(self.manifest | {"next": number + 1, "segments": [number], "counts": {str(number): own}, "tombstones": None})
        for n in old:
            tables.remove(self.spark, f"{self.path}/seg-{n:06d}")
        if buried:
            tables.remove(self.spark, f"{self.path}/{buried}")

    def merge(self) -> None:
        """One segment of what is live; nothing happens to a single segment without deletes."""
        if len(self.manifest["segments"]) <= 1 and not self._dead():
            return
        posted, docs = merged(self.postings, self.docs, self.tombstones)
        self._only(docs, posted)

    def _dead(self) -> int:
        return sum(c["dead"] for c in self.manifest["counts"].values())

    def search(self, query: str, k: int = 10) -> DataFrame:
        """(rank, id, score, title) of the k best live documents."""
        hits = search(self.postings, self.docs, self.tombstones, query, k, self.manifest["remove_stopwords"], terms=self.terms, corpus=self.corpus)
        return few(hits, k).join(self.docs.select(*KEYS, "id", "title"), KEYS).select("rank", "id", "score", "title").orderBy("rank")

    def search_batch(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """(query_id, rank, id, score, title) of ``queries(query_id, query)``.

        Postings meet the terms of the batch first and the tombstones after.
        """
        asked = queries.select("query_id", F.explode(distinct_terms("query", self.manifest["remove_stopwords"])).alias("term"))
        counts = self.terms.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
        stats = counts.join(F.broadcast(self.corpus), F.lit(True))  # one row
        weights = asked.join(stats, "term").select("query_id", "term", bm25.idf("n_docs", "df").alias("idf"), "avg_doc_len")
        part = bm25.contribution("idf", "tf", "doc_len", "avg_doc_len")
        found = live(self.postings.join(weights, "term"), self.tombstones).groupBy("query_id", *KEYS).agg(bm25.rounded(F.sum(part)).alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), *KEYS))
        best = found.withColumn("rank", rank).where(F.col("rank") <= k)
        return best.join(self.docs.select(*KEYS, "id", "title"), KEYS).select("query_id", "rank", "id", "score", "title")

    def work(self, query: str) -> Counters:
        """What scoring a query in full looks at: all postings of its terms, and the live documents that have one."""
        wanted = query_terms(query, self.manifest["remove_stopwords"])
        listed = self.terms.where(F.col("term").isin(*wanted)) if wanted else self.terms.where("false")
        seen = listed.agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum(F.ceil(F.col("df") / BLOCK)), F.lit(0))).first()
        own = self.postings.where(F.col("term").isin(*wanted)) if wanted else self.postings.where("false")
        matches = live(own, self.tombstones).agg(F.count_distinct(*KEYS)).first()[0]
        return Counters(self.corpus.first()["n_docs"], len(wanted), seen[0], matches, seen[1], 0)

    def find(self, id: str) -> DataFrame:
        """The live document of an id that a delete would hit."""
        return first_live(self.docs.where(F.col("id") == id), self.tombstones).where("copy = 1").drop("copy")

    def stats(self) -> dict:
        """Live documents and their mean length, terms, postings, segments, bytes on disk; only several segments' terms are counted, the rest is stored."""
        row, counts = self.corpus.first(), list(self.manifest["counts"].values())
        terms = counts[0]["terms"] if len(counts) == 1 else self.terms.select("term").distinct().count()
        return {
            "num_docs": row["n_docs"], "avg_doc_len": row["avg_doc_len"], "num_terms": terms, "num_postings": sum(c["postings"] for c in counts),
            "num_segments": len(self.manifest["segments"]), "index_size_bytes": tables.size_of(self.spark, self.path),
        }

    def segments(self) -> DataFrame:
        """(segment, num_docs, total_len, live_docs, live_len), from the manifest."""
        rows = [(n, c["docs"], c["len"], c["docs"] - c["dead"], c["len"] - c["dead_len"]) for n in self.manifest["segments"] for c in [self.manifest["counts"][str(n)]]]
        return self.spark.createDataFrame(rows, "segment int, num_docs long, total_len long, live_docs long, live_len long")

    def rebuild_stats(self) -> dict[str, int]:
        """Write the statistics of every segment anew from its tables; terms by segment."""
        counts = {}
        for n in self.manifest["segments"]:
            old = self.manifest["counts"].get(str(n), {})
            counts[str(n)] = self._count(n) | {k: old.get(k, 0) for k in ("dead", "dead_len")}
        self._commit(self.manifest | {"counts": counts})
        return {f"seg-{int(n):06d}": c["terms"] for n, c in counts.items()}
