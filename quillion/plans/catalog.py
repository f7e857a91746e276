"""Every capability as a query over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bm25
from ..functions.text import result_url
from ..functions.tokenizer import STOPWORDS, terms
from ..operators import compression, prune, reorder, search, segments
from ..operators import index as ix
from ..sources import documents as sources
from ..sources import tables
from ..streaming.ingest import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

ONE, THREE, LONG = "from", "thtion attion erst", "from thtion attion erst eron anea thble"
UNKNOWN, ONLY_UNKNOWN, REPEATED = "zzzunknownterm erst qqqmissing", "zzzunknownterm qqqmissing", "erst the ERST attion, erst Attion"
URL = "https://wiki.example/{title}?id={id}"

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_KEEP = f"lambda t: t <> '' AND t NOT IN ({_STOP})"


def _toks(text: str, keep: str = _KEEP) -> str:
    return rf"list_filter(list_transform(regexp_split_to_array(coalesce({text}, ''), '[^\p{{L}}\p{{N}}]+'), lambda t: lower(t)), {keep})"


#: docs, an(alysed), lens, postings, stats and corpus of the documents, title weight 2.
BASE = f"""WITH docs AS (
  SELECT doc_id, doc_id::VARCHAR AS id, split_part(coalesce(text, ''), chr(10), 1) AS title,
         CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END AS body FROM documents
), an AS (
  SELECT doc_id, {_toks("title")} AS tt, {_toks("body")} AS bt FROM docs
), lens AS (
  SELECT doc_id, (len(tt) + len(bt))::BIGINT AS doc_len FROM an
), tok AS (
  SELECT doc_id, unnest(tt) AS term, 2 AS w FROM an UNION ALL SELECT doc_id, unnest(bt), 1 FROM an
), postings AS (
  SELECT term, doc_id, sum(w)::BIGINT AS tf, any_value(doc_len) AS doc_len FROM tok JOIN lens USING (doc_id) GROUP BY term, doc_id
), stats AS (
  SELECT term, count(*) AS df, max(tf) AS max_tf, min(doc_len) AS min_len FROM postings GROUP BY term
), corpus AS (
  SELECT count(*) AS n_docs, sum(doc_len)::BIGINT AS total_len, CASE WHEN sum(doc_len) = 0 THEN 1.0::DOUBLE ELSE sum(doc_len)::DOUBLE / count(*) END AS avg_doc_len FROM lens
)"""
_IDF = "ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))"


def _part(tf: str = "tf", length: str = "doc_len") -> str:
    return f"{_IDF} * {tf} * 2.2::DOUBLE / ({tf} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * {length} / avg_doc_len))"


def _scores(wanted: str) -> str:
    """SQL for (doc_id, score) of the postings whose term is in a list or subquery."""
    return f"SELECT doc_id, round(sum({_part()}), 6) AS score FROM postings JOIN stats USING (term), corpus WHERE term IN ({wanted}) GROUP BY doc_id"


def _ranked(wanted: list[str], k: int) -> str:
    quoted = ", ".join(f"'{t}'" for t in wanted)
    return f"{BASE}, hits AS ({_scores(quoted)}) SELECT row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM hits ORDER BY rank LIMIT {k}"


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, id, title, body) of the documents."""
    return sources.from_text_table(tables.spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


_built: dict[tuple, ix.Index] = {}


def built(spark: SparkSession, sf_dir: str, title_weight: int = 2) -> ix.Index:
    """The written index of the documents, built once a session and folder; what only pruned plans by ranges read is not in it."""
    key = (spark.sparkContext.applicationId, sf_dir, title_weight)
    if key not in _built:
        _built[key] = ix.build(corpus(spark, sf_dir), title_weight, buckets=False)
    return _built[key]


def bucketed(spark: SparkSession, sf_dir: str) -> ix.Index:
    """``built`` with the impacts by ranges of documents."""
    index = _built[(spark.sparkContext.applicationId, sf_dir, 2)] = ix.with_buckets(built(spark, sf_dir))
    return index


def lazy(spark: SparkSession, sf_dir: str, title_weight: int = 2) -> ix.Index:
    """The index as plans over the documents, nothing written."""
    return ix.build(corpus(spark, sf_dir), title_weight, keep=False)


# analysis


@query(
    rf"""SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct
    FROM (SELECT doc_id, {_toks("text", "lambda t: t <> ''")} AS t FROM documents)"""
)
def tokenize_docs(spark, sf_dir):
    got = tables.spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", terms("text", remove_stopwords=False).alias("t"))
    return got.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query(
    rf"""SELECT doc_id, len(k)::BIGINT AS kept, (len(t) - len(k))::BIGINT AS dropped
    FROM (SELECT doc_id, {_toks("text", "lambda t: t <> ''")} AS t, {_toks("text")} AS k FROM documents)"""
)
def stopword_filter(spark, sf_dir):
    got = tables.spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", terms("text", False).alias("t"), terms("text").alias("k"))
    return got.select("doc_id", F.size("k").cast("long").alias("kept"), (F.size("t") - F.size("k")).cast("long").alias("dropped"))


@query(f"{BASE} SELECT doc_id, substr(body, 1, 200) AS snippet FROM docs")
def snippet_projection(spark, sf_dir):
    return ix.documents(ix.analyse(corpus(spark, sf_dir))).select("doc_id", "snippet")


@query(f"{BASE} SELECT doc_id, term, tf FROM postings")
def postings_tf(spark, sf_dir):
    return ix.postings(ix.analyse(corpus(spark, sf_dir))).select("doc_id", "term", "tf")


@query(f"{BASE} SELECT doc_id, doc_len FROM lens")
def doc_lengths(spark, sf_dir):
    return ix.analyse(corpus(spark, sf_dir)).select("doc_id", "doc_len")


@query(f"{BASE} SELECT n_docs, total_len, round(avg_doc_len, 6) AS avg_doc_len, (SELECT count(*) FROM stats) AS n_terms, (SELECT count(*) FROM postings) AS n_postings FROM corpus")
def corpus_stats(spark, sf_dir):
    return ix.totals(built(spark, sf_dir)).withColumn("avg_doc_len", F.round("avg_doc_len", 6))


@query(f"{BASE} SELECT term, df, round({_IDF}, 6) AS idf FROM stats, corpus")
def term_df_idf(spark, sf_dir):
    index = built(spark, sf_dir)
    got = index.term_stats.join(F.broadcast(index.corpus_stats), F.lit(True))  # one row
    return got.select("term", "df", F.round(bm25.idf("n_docs", "df"), 6).alias("idf"))


@query(f"{BASE} SELECT term, max_tf, min_len FROM stats")
def term_impacts(spark, sf_dir):
    return built(spark, sf_dir).term_stats.select("term", "max_tf", "min_len")


_BLOCKED = f"""{BASE}, blocked AS (
  SELECT *, ((row_number() OVER (PARTITION BY term ORDER BY doc_id) - 1) // 128)::BIGINT AS block_no FROM postings
), impacts AS (
  SELECT term, block_no, max(doc_id) AS max_doc_id, max(tf) AS max_tf, min(doc_len) AS min_len, count(*) AS n FROM blocked GROUP BY term, block_no
)"""


@query(f"{_BLOCKED} SELECT term, block_no, max_doc_id, max_tf, min_len, n FROM impacts")
def block_metadata(spark, sf_dir):
    return ix.blocks(built(spark, sf_dir).postings)


@query(f"{_BLOCKED} SELECT i.term, block_no, round({_part('i.max_tf', 'i.min_len')}, 6) AS bound FROM impacts i JOIN stats s ON s.term = i.term, corpus")
def block_bounds(spark, sf_dir):
    index = built(spark, sf_dir)
    got = ix.bounds(ix.blocks(index.postings), index.term_stats, index.corpus_stats)
    return got.select("term", "block_no", F.round("bound", 6).alias("bound"))


@query(f"{BASE} SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id FROM stats")
def term_dictionary(spark, sf_dir):
    return compression.dictionary(built(spark, sf_dir).term_stats)


@query(f"{BASE} SELECT term, doc_id, tf, doc_len FROM postings WHERE term = '{ONE}'")
def posting_lookup(spark, sf_dir):
    return ix.find_postings(built(spark, sf_dir).postings, ONE)


@query(f"{BASE} SELECT doc_id, id, title FROM docs WHERE id = '17' ORDER BY doc_id LIMIT 1")
def doc_lookup(spark, sf_dir):
    return ix.find_document(built(spark, sf_dir).docs, "17").select("doc_id", "id", "title")


# bm25


def _bm25(name: str, text: str, wanted: list[str], k: int = 10) -> None:
    query(_ranked(wanted, k), name)(lambda spark, sf_dir: search.search(built(spark, sf_dir), text, k))


_bm25("bm25_single", ONE, [ONE])
_bm25("bm25_multi", THREE, THREE.split())
_bm25("bm25_long", LONG, LONG.split())
_bm25("bm25_unknown_terms", UNKNOWN, UNKNOWN.split())
_bm25("bm25_only_unknown_terms", ONLY_UNKNOWN, ONLY_UNKNOWN.split())
_bm25("bm25_dup_terms", REPEATED, ["erst", "attion"])
_bm25("bm25_k_exceeds_matches", "thtion", ["thtion"], 1_000_000_000)


@query(_ranked(["erst", "attion"], 10).replace("2 AS w", "5 AS w"))
def bm25_title_weight(spark, sf_dir):
    return search.search(built(spark, sf_dir, 5), "erst attion", 10)


@query(f"{BASE}, hits AS ({_scores(', '.join(repr(t) for t in THREE.split()))} ORDER BY score DESC, doc_id LIMIT 10) SELECT row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank, id, score, title FROM hits JOIN docs USING (doc_id)")
def bm25_with_titles(spark, sf_dir):
    index = built(spark, sf_dir)
    return search.with_titles(index, search.search(index, THREE, 10))


_ASKED = f"""asked AS (
  SELECT DISTINCT item_id AS query_id, unnest({_toks("text")}) AS term FROM benchmark
)"""


def benchmark_queries(spark, sf_dir):
    """(query_id, query): the whole text of every benchmark item."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query(
    f"""{BASE}, {_ASKED}, hits AS (
  SELECT query_id, doc_id, round(sum({_part()}), 6) AS score FROM asked JOIN postings USING (term) JOIN stats USING (term), corpus GROUP BY query_id, doc_id
) SELECT query_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM hits) WHERE rank <= 10"""
)
def bm25_batch(spark, sf_dir):
    return search.search_batch(built(spark, sf_dir), benchmark_queries(spark, sf_dir), 10)


@query(f"{BASE}, {_ASKED} SELECT item_id AS query_id, coalesce(sum(df), 0)::BIGINT AS term_postings FROM benchmark LEFT JOIN asked ON query_id = item_id LEFT JOIN stats USING (term) GROUP BY item_id")
def query_postings_work(spark, sf_dir):
    return search.query_work(built(spark, sf_dir), benchmark_queries(spark, sf_dir))


@query(_ranked(THREE.split(), 10))
def bm25_bucket_pruned(spark, sf_dir):
    return prune.search_ranges(bucketed(spark, sf_dir), THREE, 10, counted=False)[0]


@query(_ranked(LONG.split(), 10))
def bm25_maxscore_pruned(spark, sf_dir):
    return prune.search_essential(built(spark, sf_dir), LONG, 10, counted=False)[0]


@query()
def prune_counters(spark, sf_dir):
    return prune.counters_row(spark, prune.search_ranges(bucketed(spark, sf_dir), ONE, 10)[1])


# compression

_PACKED = f"""{_BLOCKED}, gapped AS (
  SELECT term, block_no, tf, doc_id - lag(doc_id) OVER (PARTITION BY term, block_no ORDER BY doc_id) - 1 AS gap FROM blocked
), widths AS (
  SELECT term, block_no, count(*) AS n, coalesce(max(gap), 0) AS g, max(tf) - 1 AS t FROM gapped GROUP BY term, block_no
), packed AS (
  SELECT term, block_no, n, CASE WHEN g = 0 THEN 0 ELSE length(bin(g)) END::BIGINT AS doc_bits, CASE WHEN t = 0 THEN 0 ELSE length(bin(t)) END::BIGINT AS tf_bits FROM widths
), sized AS (
  SELECT *, (8 + ((n - 1) * doc_bits + n * tf_bits + 7) // 8)::BIGINT AS bytes FROM packed
)"""


@query(f"{_PACKED} SELECT term, block_no, doc_bits, tf_bits, bytes FROM sized")
def gap_encoding(spark, sf_dir):
    return compression.packed_blocks(built(spark, sf_dir).postings).drop("n")


@query(f"{_PACKED} SELECT term, block_no, bytes, (sum(bytes) OVER (ORDER BY term, block_no) - bytes)::BIGINT AS byte_offset FROM sized")
def block_offsets(spark, sf_dir):
    return compression.offsets(compression.packed_blocks(built(spark, sf_dir).postings)).select("term", "block_no", "bytes", "byte_offset")


@query(f"{_BLOCKED} SELECT term, block_no, doc_id, tf FROM blocked")
def decode_blocks(spark, sf_dir):
    """All postings, put into blocks of gaps and taken out again."""
    return compression.decoded(compression.encoded(built(spark, sf_dir).postings))


@query(f"""{BASE}, listed AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id FROM stats)
  SELECT DISTINCT doc_id AS term_id, term FROM documents LEFT JOIN listed ON term_id = doc_id""")
def terms_at_ranks(spark, sf_dir):
    """The terms at the ranks that the documents have as ids."""
    ranks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("term_id")).distinct()
    return compression.terms_at(ranks, compression.dictionary(built(spark, sf_dir).term_stats))


@query(f"{_PACKED} SELECT sum(bytes)::BIGINT AS packed_bytes, sum(n)::BIGINT * 8 AS raw_bytes FROM sized")
def compression_ratio(spark, sf_dir):
    return compression.ratio(compression.packed_blocks(built(spark, sf_dir).postings))


@query(
    f"""{BASE}, ids AS (
  SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id, hex(encode(term)) AS h FROM stats
), pairs AS (
  SELECT *, term_id // 16 AS group_no, lag(h) OVER (PARTITION BY term_id // 16 ORDER BY term_id) AS p FROM ids
), coded AS (
  SELECT *, length(h) // 2 AS size, least(length(h) // 2, length(p) // 2, 255) AS most FROM pairs
) SELECT group_no::BIGINT AS group_no, arg_min(term, term_id) AS head,
  sum(CASE WHEN p IS NULL THEN 2 + size ELSE 3 + size - coalesce(list_min(list_filter(range(1, most + 1), lambda i: substr(h, 2 * i - 1, 2) <> substr(p, 2 * i - 1, 2))) - 1, most) END)::BIGINT AS encoded_bytes
FROM coded GROUP BY group_no"""
)
def front_coding(spark, sf_dir):
    return compression.front_coded(compression.dictionary(built(spark, sf_dir).term_stats))


# segments

_SEGMENTS = f"""{BASE}, seg AS (
  SELECT (doc_id % 3)::INT AS segment, doc_id, id, doc_len FROM docs JOIN lens USING (doc_id)
), alive AS (
  SELECT * FROM seg WHERE doc_id % 50 <> 7
), live AS (
  SELECT count(*) AS n_docs, CASE WHEN sum(doc_len) = 0 THEN 1.0::DOUBLE ELSE sum(doc_len)::DOUBLE / count(*) END AS avg_doc_len FROM alive
)"""


def in_segments(spark, sf_dir):
    """(postings, documents, tombstones) of the corpus in three segments, with every fiftieth document deleted."""
    index = built(spark, sf_dir)
    return _cut(index.postings), *_marked(index.docs)


def _cut(rows: DataFrame) -> DataFrame:
    return rows.withColumn("segment", F.pmod("doc_id", F.lit(3)).cast("int"))


def _marked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    docs = _cut(rows)
    return docs, docs.where("doc_id % 50 = 7").select("segment", "doc_id")


def docs_in_segments(spark, sf_dir):
    """(documents, tombstones) as of ``in_segments``, for what needs no postings: no index is built for it."""
    index = _built.get((spark.sparkContext.applicationId, sf_dir, 2)) or lazy(spark, sf_dir)
    return _marked(index.docs)


@query(
    f"""{_SEGMENTS}, hits AS (
  SELECT segment, doc_id, round(sum({_part("tf", "p.doc_len")}), 6) AS score FROM postings p JOIN stats USING (term) JOIN alive a USING (doc_id), live
  WHERE term IN ({", ".join(repr(t) for t in THREE.split())}) GROUP BY segment, doc_id
) SELECT row_number() OVER (ORDER BY score DESC, segment, doc_id)::INT AS rank, segment, doc_id, score FROM hits ORDER BY rank LIMIT 10"""
)
def segment_search(spark, sf_dir):
    return segments.search(*in_segments(spark, sf_dir), THREE, 10)


@query(f"{_SEGMENTS} SELECT term, count(*) AS df_all, count(*) FILTER (doc_id % 50 <> 7) AS df_live FROM postings GROUP BY term")
def segment_df_with_tombstones(spark, sf_dir):
    posted, _, tombstones = in_segments(spark, sf_dir)
    return segments.frequencies(posted, tombstones)


@query(f"{_SEGMENTS} SELECT segment, doc_id AS old_id, row_number() OVER (ORDER BY segment, doc_id) - 1 AS new_id FROM alive")
def merge_renumber(spark, sf_dir):
    docs, tombstones = docs_in_segments(spark, sf_dir)
    return segments.renumbered(docs.select("segment", "doc_id"), tombstones).select("segment", F.col("doc_id").alias("old_id"), "new_id")


@query(
    f"""{_SEGMENTS}, again AS (SELECT term, count(*) AS df FROM postings JOIN alive USING (doc_id) GROUP BY term), ids AS (
  SELECT doc_id, row_number() OVER (ORDER BY segment, doc_id) - 1 AS new_id FROM alive
), hits AS (
  SELECT new_id AS doc_id, round(sum({_part("tf", "p.doc_len")}), 6) AS score FROM postings p JOIN again USING (term) JOIN ids USING (doc_id), live
  WHERE term IN ({", ".join(repr(t) for t in THREE.split())}) GROUP BY new_id
) SELECT row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM hits ORDER BY rank LIMIT 10"""
)
def merge_search(spark, sf_dir):
    posted, docs, tombstones = in_segments(spark, sf_dir)
    new_posted, new_docs = segments.merged(posted, docs, tombstones)
    none = tombstones.where("false")
    return segments.search(new_posted, new_docs, none, THREE, 10).select("rank", "doc_id", "score")


@query(f"{_SEGMENTS} SELECT id, segment, doc_id FROM alive WHERE doc_id % 20 = 4 UNION ALL SELECT id, segment, doc_id FROM alive WHERE FALSE")
def delete_resolution(spark, sf_dir):
    """Deleting every document whose id ends its twenty with 4, and ids that aren't there."""
    docs, tombstones = docs_in_segments(spark, sf_dir)
    ids = docs.where("doc_id % 20 = 4").select("id").unionByName(docs.where("doc_id % 20 = 4").select(F.concat("id", F.lit("-missing")).alias("id")))
    return segments.resolve_deletes(docs, tombstones, ids)


@query(
    f"""{_SEGMENTS} SELECT CASE WHEN doc_id % 50 = 7 OR doc_id % 10 = 1 THEN 'added' WHEN doc_id % 10 = 2 THEN 'updated' ELSE 'unchanged' END AS status, count(*) AS n
    FROM seg GROUP BY 1"""
)
def upsert_classify(spark, sf_dir):
    """All documents again: a tenth under new ids, a tenth with more text; the deleted ones count as new."""
    docs, tombstones = docs_in_segments(spark, sf_dir)
    turn = F.pmod("doc_id", F.lit(10))
    batch = corpus(spark, sf_dir).select(
        F.when(turn == 1, F.concat("id", F.lit("-new"))).otherwise(F.col("id")).alias("id"), "title", F.when(turn == 2, F.concat("body", F.lit(" more"))).otherwise(F.col("body")).alias("body")
    )
    return segments.classify(batch, docs, tombstones).groupBy("status").agg(F.count("*").alias("n"))


# reordering


@query("SELECT page_id, url, row_number() OVER (ORDER BY url, page_id) - 1 AS new_id FROM pages")
def path_reorder(spark, sf_dir):
    return reorder.by_path(table(spark, sf_dir, "pages").select("page_id", "url"), "url", "page_id")


@query(f"{BASE} SELECT term, round(coalesce(sum(log2(d)), 0), 4) AS cost FROM (SELECT term, doc_id - lag(doc_id) OVER (PARTITION BY term ORDER BY doc_id) AS d FROM postings) GROUP BY term")
def log_gap_cost(spark, sf_dir):
    return reorder.log_gap_cost(built(spark, sf_dir).postings).withColumn("cost", F.round("cost", 4))


_bisected: dict[tuple, DataFrame] = {}


def bisected(spark, sf_dir) -> DataFrame:
    """(doc_id, new_id) of the documents by recursive bisection, found once a session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _bisected:
        index = built(spark, sf_dir)
        _bisected[key] = tables.written(reorder.bisection(index.postings, index.docs), "order")
    return _bisected[key]


@query()
def bp_reorder(spark, sf_dir):
    return bisected(spark, sf_dir)


@query()
def bp_reorder_cost(spark, sf_dir):
    """One row: the log-gap cost of the documents before and after bisection, and whether the order is a permutation."""
    index, order = built(spark, sf_dir), bisected(spark, sf_dir)
    cost = lambda posted: reorder.log_gap_cost(posted).agg(F.round(F.sum("cost"), 4).alias("c"))
    dense = reorder.by_path(index.docs.select("doc_id"), "doc_id")
    before = cost(reorder.renumber(index.postings, dense)).withColumnRenamed("c", "cost_before")
    after = cost(reorder.renumber(index.postings, order)).withColumnRenamed("c", "cost_after")
    check = order.agg(((F.count_distinct("new_id") == F.count("*")) & (F.max("new_id") == F.count("*") - 1)).alias("permutation"), F.count("*").alias("n_docs"))
    return before.crossJoin(after).crossJoin(check)


# sources and streams


def as_jsonl(spark, sf_dir) -> str:
    """A folder with the documents as JSON Lines."""
    folder = tables.fresh_path(spark, "jsonl")
    corpus(spark, sf_dir).select("id", "title", "body").write.json(folder)
    return folder


@query(f"{BASE} SELECT id, length(title) AS title_chars, length(body) AS body_chars FROM docs")
def jsonl_source(spark, sf_dir):
    got = sources.read_jsonl(spark, as_jsonl(spark, sf_dir))
    return got.select("id", F.length("title").cast("long").alias("title_chars"), F.length("body").cast("long").alias("body_chars"))


@query(ORACLES["corpus_stats"])
def stream_ingest(spark, sf_dir):
    """The documents as a stream of files, upserted into an index; its totals."""
    path = tables.fresh_path(spark, "streamed")
    ingest(sources.stream_jsonl(spark, as_jsonl(spark, sf_dir)), path, tables.fresh_path(spark, "stream-state")).awaitTermination()
    index = segments.SegmentedIndex.open(spark, path)
    stats = segments.live_stats(index.docs, index.tombstones).withColumn("avg_doc_len", F.round("avg_doc_len", 6))
    held = segments.frequencies(index.postings, index.tombstones).agg(F.count("*").alias("n_terms"), F.sum("df_live").alias("n_postings"))
    return stats.crossJoin(held)


# reports, links


@query(
    """SELECT count(*) AS n, round(avg(value), 6) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99
    FROM events"""
)
def bench_percentiles(spark, sf_dir):
    from ..operators.report import percentiles

    return percentiles(table(spark, sf_dir, "events"), "value")


@query(
    f"""{BASE}, {_ASKED}, met AS (
  SELECT query_id, count(DISTINCT doc_id) AS docs, count(*) AS visited FROM asked JOIN postings USING (term) GROUP BY query_id
), work AS (
  SELECT item_id, coalesce(docs, 0) AS docs, coalesce(visited, 0) AS visited FROM benchmark LEFT JOIN met ON query_id = item_id
) SELECT count(*) AS num_queries, round(coalesce(avg(docs / n_docs), 0), 6) AS docs_scored_ratio,
  round(coalesce(avg(CASE WHEN visited > 0 THEN visited / visited END), 0), 6) AS postings_visited_ratio FROM work, corpus"""
)
def bench_work_ratios(spark, sf_dir):
    from ..operators.report import work_ratios

    index = built(spark, sf_dir)
    work = search.batch_work(index, benchmark_queries(spark, sf_dir))
    got = work_ratios(work, index.corpus_stats.first()["n_docs"])
    return got.withColumns({c: F.round(c, 6) for c in ("docs_scored_ratio", "postings_visited_ratio")})


@query(
    f"""{BASE} SELECT id, replace(replace('{URL}', '{{id}}', url_encode(id)), '{{title}}', url_encode(title)) AS url FROM docs"""
)
def url_template(spark, sf_dir):
    return corpus(spark, sf_dir).select("id", result_url(URL, F.col("id"), F.col("title")).alias("url"))


@query(
    rf"""{BASE}, w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(trim(title)), '\s+'), lambda w: regexp_full_match(w, '[\p{{L}}\p{{N}}]+') AND w NOT IN ({_STOP})) AS w FROM docs WHERE doc_id % 7 = 0
), n AS (
  SELECT doc_id, w, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM w WHERE len(w) > 0
) SELECT doc_id, CASE WHEN n % 3 = 0 AND len(w) >= 2 THEN array_to_string(w[1:4], ' ') WHEN n % 3 = 1 AND len(w) >= 2 THEN array_to_string(w[1:2], ' ')
  ELSE list_filter(w, lambda x: length(x) = list_max(list_transform(w, lambda y: length(y))))[1] END AS query FROM n"""
)
def query_sampler(spark, sf_dir):
    """A sampling operator: queries from every seventh title."""
    return sources.sample_queries(corpus(spark, sf_dir), every=7, limit=None)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
