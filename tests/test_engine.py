import math

import pytest
from pyspark.sql import functions as F

from quillion.functions import bm25
from quillion.functions.text import bits_needed, percent_encode, result_url
from quillion.functions.tokenizer import STOPWORDS, query_terms, terms
from quillion.operators import compression, prune, reorder, report, search
from quillion.operators import index as ix
from quillion.sources import tables

from .corpora import HAND, naive, random_docs, topic_docs


def frame(spark, docs):
    return spark.createDataFrame([(k, *d) for k, d in enumerate(docs)], "doc_id long, id string, title string, body string")


def hits(index, df):
    ids = {r.doc_id: r.id for r in index.docs.collect()}
    rows = sorted(df.collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
    return [(r.score, ids[r.doc_id]) for r in rows]


@pytest.fixture(scope="module")
def rand(spark):
    docs = random_docs(400, 50, 42)
    return docs, ix.build(frame(spark, docs), 1, remove_stopwords=False)


@pytest.mark.parametrize(
    "text,want",
    [
        ("Cheap PIZZA, in Montreal!", ["cheap", "pizza", "in", "montreal"]),
        ("  --  hello   world -- ", ["hello", "world"]),
        ("...!!!", []),
        ("", []),
        (None, []),
        ("route 66 rocks", ["route", "66", "rocks"]),
        ("Crème Brûlée à Montréal", ["crème", "brûlée", "à", "montréal"]),
        ("ΟΔΟΣ snake_case İx", ["οδοσ", "snake", "case", "i̇x"]),
    ],
)
def test_terms(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(terms("t", False)).first()[0] == want
    if text is not None:
        assert query_terms(text, False) == list(dict.fromkeys(want))


def test_stopwords(spark):
    assert len(STOPWORDS) == 33
    assert query_terms("the best pizza in the city the best") == ["best", "pizza", "city"]
    assert spark.sql("select 'the best pizza in the city' t").select(terms("t")).first()[0] == ["best", "pizza", "city"]


def test_formula(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert math.isclose(value(bm25.idf(F.lit(10), F.lit(2))), math.log(1 + 8.5 / 2.5))
    part = lambda tf, n: value(bm25.contribution(F.lit(1.0), F.lit(tf), F.lit(n), F.lit(10)))
    assert part(1, 10) < part(2, 10) < part(50, 10) < 2.2 and part(2, 5) > part(2, 10) > part(2, 40)
    assert value(bm25.average_length(F.lit(0), F.lit(3))) == 1.0
    assert [value(bits_needed(F.lit(x))) for x in (0, 1, 2, 255, 256)] == [0, 1, 2, 8, 9]


def test_links(spark):
    got = spark.createDataFrame([("a b/c~é*",)], "t string").select(percent_encode(F.col("t")), result_url("u?{id}&{title}", F.col("t"), F.lit("x+y"))).first()
    assert tuple(got) == ("a%20b%2Fc~%C3%A9%2A", "u?a%20b%2Fc~%C3%A9%2A&x%2By")


@pytest.mark.parametrize("query", ["pizza", "cheap montreal", "cheap pizza montreal", "flights nothing", "nothing", "pizza PIZZA pizza"])
def test_handmade(spark, query):
    index = ix.build(frame(spark, HAND), 1, remove_stopwords=False)
    for k in (1, 3, 10):
        assert hits(index, search.search(index, query, k)) == naive(HAND, query, k)


@pytest.mark.parametrize("query", ["w3", "w1 w7", "w0 w2 w40", "w5 w9 w11 w13 w17 w49", "w0 w1 w2 w3 w4 w5 w6 w7"])
def test_random_plans_agree(rand, query):
    docs, index = rand
    want = naive(docs, query, 10)
    assert hits(index, search.search(index, query, 10)) == want
    assert hits(index, prune.search_ranges(index, query, 10, width=16, first=4)[0]) == want
    assert hits(index, prune.search_essential(index, query, 10)[0]) == want


def test_k(spark, rand):
    docs, index = rand
    assert search.search(index, "w3", 0).count() == 0 and search.search(index, "...", 5).count() == 0
    every = naive(docs, "w3", 10**6)
    assert hits(index, search.search(index, "w3", 10**6)) == every and hits(index, search.search(index, "w3", 5000)) == every


def test_pruning_skips_and_counts(spark):
    docs = [(f"d{k}", "", "rare rare rare rare common" if k % 250 == 0 else f"common filler{k % 17} filler{k % 31} pad pad pad") for k in range(3000)]
    index = ix.build(frame(spark, docs), 1, remove_stopwords=False)
    found, counters = prune.search_ranges(index, "rare common", 5)
    assert hits(index, found) == naive(docs, "rare common", 5)
    assert counters.blocks_skipped > 0 and counters.docs_scored < 3000 and counters.docs_total == 3000 and counters.query_terms == 2
    found, counters = prune.search_essential(index, "rare common", 5)
    assert hits(index, found) == naive(docs, "rare common", 5) and counters.docs_scored == 12
    assert prune.essential([("a", 1.0), ("b", 2.0), ("c", 4.0)], 3.5) == ["c"]


def test_pruning_falls_back_on_negative_weights(spark, rand):
    docs, index = rand
    corpus = spark.createDataFrame([(3, 30, 10.0)], "n_docs long, total_len long, avg_doc_len double")
    found, counters = prune.search_ranges(index.with_tables(corpus_stats=corpus), "w1 w2", 5)
    assert counters is None and found.count() == 5


def test_batch(spark, rand):
    docs, index = rand
    queries = ["w1 w2", "w30", "none here", "w4 w4 w5"]
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")
    rows = search.search_batch(index, asked, 7).collect()
    ids = {r.doc_id: r.id for r in index.docs.collect()}
    for k, q in enumerate(queries):
        got = [(r.score, ids[r.doc_id]) for r in sorted((r for r in rows if r.query_id == k), key=lambda r: r["rank"])]
        assert got == naive(docs, q, 7)
    work = {r.query_id: r.term_postings for r in search.query_work(index, asked).collect()}
    assert work[2] == 0 and work[3] == work[3] > 0


@pytest.mark.parametrize("weight", [1, 3])
def test_title_weight(spark, weight):
    docs = [("a", "pizza", "one two three"), ("b", "one", "pizza two three")]
    index = ix.build(frame(spark, docs), weight, remove_stopwords=False)
    assert hits(index, search.search(index, "pizza", 2)) == naive(docs, "pizza", 2, weight)
    assert [r.doc_len for r in index.docs.collect()] == [4, 4]


def test_statistics_and_empty_documents(spark):
    index = ix.build(frame(spark, [*HAND, ("e", "", ""), ("n", None, None)]), 1, remove_stopwords=False)
    row = ix.totals(index).first()
    assert (row.n_docs, row.total_len, row.n_terms, row.n_postings) == (8, 21, 9, 15)
    assert ix.find_document(index.docs, "e").first().doc_len == 0
    assert {r.doc_id: r.tf for r in ix.find_postings(index.postings, "pizza").collect()} == {0: 2, 1: 1, 3: 3}
    none = ix.build(frame(spark, HAND).where("false"))
    assert none.corpus_stats.first().avg_doc_len == 1.0 and search.search(none, "pizza", 3).count() == 0


def test_lookup_reaches_the_files(rand):
    _, index = rand
    plan = ix.find_postings(index.postings, "w1")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,w1)]" in plan or "In(term" in plan


def test_blocks_and_bounds(spark, rand, monkeypatch):
    docs, index = rand
    monkeypatch.setattr(ix, "RANGE", 64)  # lists are numbered in pieces
    blocks = ix.blocks(index.postings, 16).collect()
    per_term = {}
    for r in index.postings.orderBy("term", "doc_id").collect():
        per_term.setdefault(r.term, []).append(r)
    assert len(blocks) == sum(-(-len(v) // 16) for v in per_term.values())
    for b in blocks:
        own = per_term[b.term][b.block_no * 16 : b.block_no * 16 + 16]
        assert (b.max_doc_id, b.max_tf, b.min_len, b.n) == (own[-1].doc_id, max(r.tf for r in own), min(r.doc_len for r in own), len(own))
    bounds = ix.bounds(spark.createDataFrame(blocks), index.term_stats, index.corpus_stats)
    parts = search.matched(index, ["w3"])[0].join(index.term_stats.select("term", "df"), "term").crossJoin(index.corpus_stats)
    most = parts.agg(F.max(bm25.contribution(bm25.idf("n_docs", "df"), "tf", "doc_len", "avg_doc_len"))).first()[0]
    assert bounds.where("term = 'w3'").agg(F.max("bound")).first()[0] >= most - 1e-9


def test_packed_sizes_and_gaps(rand):
    _, index = rand
    gaps = compression.gaps(index.postings).where("term = 'w2'").orderBy("doc_id").collect()
    at = gaps[0].doc_id
    for r in gaps[1:]:
        at += 1 + r.gap if r.gap is not None else r.doc_id - at
        assert at == r.doc_id  # the ids come back from the gaps
    row = compression.ratio(compression.packed_blocks(index.postings)).first()
    assert row.packed_bytes < 0.5 * row.raw_bytes


def test_dictionary_and_front_coding(rand):
    _, index = rand
    words = compression.dictionary(index.term_stats)
    listed = [r.term for r in words.orderBy("term_id").collect()]
    assert listed == sorted(listed) and [r.term_id for r in words.orderBy("term_id").collect()] == list(range(len(listed)))
    size = {}
    for k, t in enumerate(listed):
        lcp = 0
        while k % 16 and lcp < min(len(t), len(listed[k - 1])) and t[lcp] == listed[k - 1][lcp]:
            lcp += 1
        size[k // 16] = size.get(k // 16, 0) + (3 + len(t) - lcp if k % 16 else 2 + len(t))
    assert {r.group_no: r.encoded_bytes for r in compression.front_coded(words).collect()} == size


def test_reordering(spark):
    docs = topic_docs(160)
    index = ix.build(frame(spark, docs), 1, remove_stopwords=False)
    cost = lambda p: reorder.log_gap_cost(p).agg(F.sum("cost")).first()[0]
    before = cost(index.postings)
    by_tasks, by_jobs = reorder.bisection(index.postings, index.docs), reorder.bisection(index.postings, index.docs, local_docs=40)
    assert sorted(map(tuple, by_tasks.collect())) == sorted(map(tuple, by_jobs.collect()))  # large parts go by jobs, with the same swaps
    for order in (reorder.by_path(index.docs).select("doc_id", "new_id"), by_tasks):
        order = order.cache()
        assert sorted(r.new_id for r in order.collect()) == list(range(160))
        moved = index.with_tables(docs=reorder.renumber(index.docs, order), postings=reorder.renumber(index.postings, order))
        assert cost(moved.postings) < 0.85 * before
        got, want = hits(moved, search.search(moved, "t0w1 t1w5", 10)), naive(docs, "t0w1 t1w5", 10)
        assert [s for s, _ in got] == [s for s, _ in want]


def test_log_gap_cost_over_ranges(rand, monkeypatch):
    _, index = rand
    whole = {r.term: r.cost for r in reorder.log_gap_cost(index.postings).collect()}
    monkeypatch.setattr(ix, "RANGE", 16)
    assert {r.term: pytest.approx(r.cost) for r in reorder.log_gap_cost(index.postings).collect()} == whole
    ids = sorted(r.doc_id for r in index.postings.where("term = 'w7'").collect())
    assert whole["w7"] == pytest.approx(sum(math.log2(b - a) for a, b in zip(ids, ids[1:])))


def test_small_tables_use_all_cores(spark):
    assert tables.spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert tables.spread(spark.range(10).coalesce(1), least=1).rdd.getNumPartitions() == 1


def test_dense_ids(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    got = tables.dense_ids(df, [F.desc("x")], "n", 5).collect()
    assert all(r.n == 5 + 999 - r.x for r in got)


def test_percentiles_and_ratios(spark):
    rows = spark.createDataFrame([(float(x),) for x in range(1, 101)], "value double")
    assert tuple(report.percentiles(rows, "value").first()) == (100, 50.5, 50.0, 95.0, 99.0)
    work = spark.createDataFrame([(5, 10, 20), (10, 0, 0)], "docs_scored int, postings_visited int, term_postings int")
    assert tuple(report.work_ratios(work, 100).first()) == pytest.approx((2, 0.075, 0.5))


def test_offsets_decoding_and_ranks(rand):
    _, index = rand
    packed = compression.packed_blocks(index.postings, 4)
    total = 0
    for r in sorted(compression.offsets(packed).collect(), key=lambda r: (r.term, r.block_no)):
        assert r.byte_offset == total
        total += r.bytes
    assert compression.offsets(packed.where("false")).count() == 0
    blocks = compression.encoded(index.postings, 4)
    got = compression.decoded(blocks).select("term", "doc_id", "tf").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, index.postings.select("term", "doc_id", "tf").collect()))
    second = compression.frequency_at(blocks.withColumn("place", F.lit(1))).collect()
    assert all(r.tf == (r.less[1] + 1 if len(r.less) > 1 else None) for r in second)
    names = sorted(r.term for r in index.term_stats.select("term").collect())
    ranks = index.postings.sparkSession.createDataFrame([(0,), (len(names) - 1,), (len(names),)], "term_id long")
    found = {r.term_id: r.term for r in compression.terms_at(ranks, compression.dictionary(index.term_stats)).collect()}
    assert found == {0: names[0], len(names) - 1: names[-1], len(names): None}
