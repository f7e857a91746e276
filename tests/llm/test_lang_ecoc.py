import random

import numpy as np
import pytest

from quillion.llm import lang_ecoc as L

STEMS = {"en": "the of and thing ness whole shire", "fr": "le que eau aille ment oux ière", "de": "der und sch heit keit über ung", "es": "el los ción ñero dad mente ista"}


def text_in(lang, rng, n=60):
    stems = STEMS[lang].split()
    return " ".join("".join(rng.choice(stems) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    rows = [(k, text_in(lang := list(STEMS)[k % 4], rng), lang) for k in range(240)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


@pytest.mark.parametrize("k", [1, 2, 4, 6, 9])
def test_codewords_are_apart(k):
    code = L.codewords(k)
    assert set(np.unique(code)) <= {-1.0, 1.0} and len({tuple(r) for r in code}) == k
    assert all((row > 0).any() and (row < 0).any() for row in code.T) or k == 1


def test_held_out_accuracy(spark, corpus):
    model = L.fit(corpus, rows_per_lang=30)
    rng = random.Random(77)
    rows = [(k, text_in(lang := list(STEMS)[k % 4], rng, 20), lang) for k in range(80)]
    held = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = held.select("lang", L.classifier(model)("text").alias("r")).select("lang", "r.*").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 78 and not any(r.rejected for r in got)


def test_decoding_is_the_nearest_codeword(corpus):
    model = L.fit(corpus, rows_per_lang=20)
    rng = np.random.default_rng(0)
    z = rng.normal(size=(50, model.code.shape[1]))
    want = [min(range(4), key=lambda c: sum(w * np.log1p(np.exp(-x * s)) for x, s, w in zip(row, model.code[c], model.weight))) for row in z]
    assert model.distances(z).argmin(1).tolist() == want


def test_sums_by_force():
    rng = np.random.default_rng(1)
    table = rng.normal(size=(L.BUCKETS, 3)).astype(np.float32)
    texts = ["abc de", "", "x", "  ", "Éclair été"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.r_[0, np.cumsum([len(t.encode()) for t in texts])]
    got = L.sums(raw, offsets, table)
    for k in range(len(texts)):
        own = raw[offsets[k] : offsets[k + 1]]
        code, use = L.trigrams(own, np.array([0, len(own)]))
        assert np.allclose(got[k, :-1], table[code[use]].sum(0), atol=1e-4) and got[k, -1] == use.sum()


def test_rejects_and_odd_rows(spark, corpus, odd, empty):
    model = L.fit(corpus)
    junk = spark.createDataFrame([(1, "§§§ 123 %%%"), (2, None), (3, ""), (4, "ξένη γλώσσα εντελώς άγνωστη"), (5, text_in("fr", random.Random(1)))], "doc_id long, text string")
    got = {r.doc_id: r.r for r in junk.select("doc_id", L.classifier(model)("text").alias("r")).collect()}
    assert [got[k].rejected for k in range(1, 6)] == [True, True, True, True, False] and got[5].lang_pred == "fr"
    assert L.identify(odd).count() == odd.count()
    kept = L.keep_identified(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} >= {1, 5, 6, 7, 8}
    assert L.identify(empty).count() == 0
    none = corpus.withColumn("lang", corpus.lang.substr(9, 1))
    assert L.identify(none).where("lang_pred IS NULL AND NOT rejected AND ambiguous").count() == 240
