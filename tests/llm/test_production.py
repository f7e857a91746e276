"""The registered queries over whole tables, against brute force, with the parameters that they run with."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillion.llm import mph_store, packing, pii_crf, queries, sentencepieces, simhash

from .test_packing import naive_anew, texts_of
from .test_simhash import groups_by_force
from .test_suffix_dedup import marks_by_force

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def test_all_queries_are_registered():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{k}" for k in range(1, 11)]
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_passages(spark, docs):
    want = marks_by_force([(r.doc_id, r.text) for r in docs.collect()], 50)
    got = defaultdict(set)
    for r in queries.op9_suffix_array_dedup(spark, SF).collect():
        got[r.doc_id].update(range(r.start_word, r.end_word))
    assert got == want and want


def test_near_duplicates(spark, docs):
    prints = sorted((r.doc_id, r.f0, r.f1) for r in simhash.fingerprints(docs).collect())
    f = np.array([[a, b] for _, a, b in prints], np.int64).view(np.uint64)
    groups = groups_by_force(f, 24)
    got = {r.doc_id: r.duplicate_of for r in queries.op10_simhash_near_duplicates(spark, SF).collect()}
    assert got == {prints[k][0]: prints[g][0] for k, g in enumerate(groups) if g != k}


def test_packing(spark, docs):
    lengths = []
    for r in queries.op3_sentencepiece_nbest(spark, SF).where("rank = 1").collect():
        lengths += [4096] * (r.n_pieces // 4096) + ([r.n_pieces % 4096] if r.n_pieces % 4096 else [])
    got = queries.op4_best_fit_packing(spark, SF).collect()
    bins = sorted(sorted(p.length for p in r.pieces) for r in got)
    assert bins == sorted(b for _, b in naive_anew(lengths, packing.CAPACITIES, packing.sequence_cost()))
    assert texts_of(spark, got) == {r.doc_id: r.text for r in docs.collect() if r.text}


def test_segmentations(spark, docs):
    rows = defaultdict(list)
    for r in queries.op3_sentencepiece_nbest(spark, SF).collect():
        rows[r.doc_id].append(r)
    assert len(rows) == docs.count()
    vocabulary = sentencepieces.load(sentencepieces._read_model(sentencepieces.MODEL)).vocabulary
    for found in rows.values():
        found.sort(key=lambda r: r["rank"])
        assert all(r.restores for r in found) and len({tuple(r.ids) for r in found}) == len(found)
        assert all(a.score >= b.score for a, b in zip(found, found[1:]))
    # the search over a whole text, without chunks, finds the same scores
    for r in docs.orderBy(F.length("text")).limit(40).collect():
        raw = (" " + r.text if r.text else "").encode()
        want = [s / sentencepieces.UNIT for s, _ in sentencepieces.n_best(vocabulary.edges(raw), 3)]
        assert [x.score for x in rows[r.doc_id]] == pytest.approx(want)


def test_token_store(spark, docs, tmp_path):
    assert mph_store.write(docs, str(tmp_path)).where("found <> n_keys").count() == 0
    got = {r.key: r.ids for r in mph_store.lookup(spark, str(tmp_path), docs.select(F.col("doc_id").alias("key"))).collect()}
    best = {r.doc_id: r.ids for r in queries.op3_sentencepiece_nbest(spark, SF).where("rank = 1").collect()}
    assert got == best
    # the registered query's rows, read without the index: each payload is the ids of its keys, one after the other, in the order of slots
    held = []
    for r in queries.op7_mph_token_store(spark, SF).collect():
        lengths, offsets, payload = np.frombuffer(r.lengths, "<u4"), np.frombuffer(r.offsets, "<u8"), np.frombuffer(r.payload, "<u2")
        assert r.found == r.n_keys == len(lengths) and offsets.tolist() == [0, *np.cumsum(lengths)[:-1].tolist()] and len(payload) == r.n_ids
        held += [tuple(payload[a : a + n].tolist()) for a, n in zip(offsets.tolist(), lengths.tolist())]
    assert Counter(held) == Counter(tuple(x) for x in best.values())


def test_language_of_labelled_documents(spark, docs):
    got = {r.doc_id: r for r in queries.op8_language_id(spark, SF).collect()}
    labelled = [r for r in docs.collect() if r.lang]
    right = sum(got[r.doc_id].lang_pred == r.lang for r in labelled)
    assert right / len(labelled) > 0.95
    assert sum(got[r.doc_id].rejected for r in labelled) < 0.03 * len(labelled)


def test_private_data(spark, docs):
    import re

    found = defaultdict(list)
    for r in queries.op6_pii_semi_crf(spark, SF).collect():
        found[r.doc_id].append(r)
    patterns = {"EMAIL": r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", "IP": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])", "CARD": r"(?<!\d)\d{13,19}(?!\d)", "SECRET": r"\b[0-9a-f]{24,}\b"}
    seen = Counter()
    for d in docs.collect():
        for kind, pattern in patterns.items():
            for m in re.finditer(pattern, d.text or ""):
                if kind == "SECRET" and m.group().isdigit():
                    continue
                seen[kind, any(r.entity == kind and r.start <= m.start() and r.end >= m.end() for r in found[d.doc_id])] += 1
    assert sum(n for (_, ok), n in seen.items() if ok) >= 0.97 * sum(seen.values()) and seen
    assert all(pii_crf.TYPES.index(r.entity) >= 0 and r.end > r.start for rs in found.values() for r in rs)
