import random

import numpy as np
import pytest

from quillion.llm import suffix_dedup as D

from .conftest import prose


@pytest.mark.parametrize("v", [7, 13, 31])
@pytest.mark.parametrize("seed", range(6))
def test_suffixes_are_sorted(v, seed):
    rng = np.random.default_rng(seed)
    n = [0, 1, 40, 300, 700, 200][seed]
    text = rng.integers(1, [2, 3, 50][seed % 3] + 1, n)
    if seed == 4:
        text = np.tile(rng.integers(1, 4, 7), 100)  # ties as long as the text
    want = sorted(range(n), key=lambda k: text[k:].tolist())
    assert D.sorted_suffixes(text, v, block=64).tolist() == want


def marks_by_force(rows, w):
    """Words of windows that occur earlier, by (doc_id, position)."""
    seen, out = {}, {}
    for d, t in sorted(set(rows)):
        words = t.split()
        for k in range(len(words) - w + 1):
            key = tuple(words[k : k + w])
            if key in seen:
                out.setdefault(d, set()).update(range(k, k + w))
            else:
                seen[key] = d
    return out


@pytest.mark.parametrize("seed", range(3))
def test_finds_every_repeat(docs_of, seed):
    rng = random.Random(seed)
    shared = [prose(rng.randint(8, 40), 1000 + s) for s in range(4)]
    rows = []
    for d in range(30):
        parts = [prose(rng.randint(0, 30), seed * 100 + d)]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(shared), prose(rng.randint(0, 12), seed * 100 + d + 50)]
        rows.append((d, " ".join(p for p in parts if p)))
    rows.append((40, "go " * 60))
    got = {}
    for r in D.repeated_passages(docs_of(rows), min_words=10, k=4, v=7).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
        assert r.n_words == r.end_word - r.start_word and r.first_doc_id <= r.doc_id
    assert got == marks_by_force(rows, 10)


def test_cut_keeps_the_first_and_the_rest(docs_of):
    passage = prose(60, 1)
    rows = [(1, f"one {passage} two"), (2, f"three {passage} four"), (3, passage), (4, prose(70, 9)), (5, None), (6, "")]
    got = {r.doc_id: r for r in D.cut_repeats(docs_of(rows)).collect()}
    assert got[1].text == rows[0][1] and got[2].text == "three four" and got[2].n_chars == 10
    assert 3 not in got and got[4].text == rows[3][1] and got[5].text is None and got[6].text == ""


def test_odd_rows(odd, empty):
    got = D.cut_repeats(odd)
    assert got.columns == odd.columns
    ids = sorted(str(r.doc_id) for r in got.collect())
    assert ids == sorted(["1", "2", "3", "4", "None", "None", "6", "7", "7", "8", "8", "9"])  # 5 repeats 1 as a whole
    assert D.repeated_passages(empty).count() == 0 and D.cut_repeats(empty).count() == 0


@pytest.mark.parametrize("hot", [1, 3])
def test_hot_minimisers_give_the_same(docs_of, hot):
    rng = random.Random(7)
    line = prose(16, 77)
    rows = [(d, f"{prose(rng.randint(5, 25), d)} {line} {prose(rng.randint(5, 25), d % 9)}") for d in range(60)]
    got = {}
    for r in D.repeated_passages(docs_of(rows), min_words=12, k=4, v=7, hot_regions=hot).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    assert got == marks_by_force(rows, 12) and got


def test_one_minimiser_of_a_hundred_thousand_rows(spark):
    """A line of 50 words on every row, with other words about it on each, goes by hashes; buckets stay small."""
    line = " ".join(f"same{k}" for k in range(50))
    docs = spark.range(100_000).selectExpr("id AS doc_id", f"concat('before', id, ' {line} after', id) AS text")
    got = D.repeated_passages(docs)
    assert got.where("start_word = 1 AND end_word = 51 AND first_doc_id < doc_id").count() == got.count() == 99_999


def test_regions_of_any_length(docs_of):
    """Windows of 200 words make regions of over 255 words."""
    shared = " ".join(f"w{k}" for k in range(900))
    rows = [(1, f"a b {shared} c"), (2, f"d {shared} e f"), (3, prose(300, 3))]
    got = [(r.doc_id, r.start_word, r.end_word) for r in D.repeated_passages(docs_of(rows), min_words=200).collect()]
    assert got == [(2, 1, 901)]
    with pytest.raises(ValueError, match="min_words"):
        D.repeated_passages(docs_of(rows), min_words=8)


def test_names_in_any_case_and_ids_that_are_no_numbers(docs_of):
    passage = prose(60, 1)
    docs = docs_of([(1, f"one {passage} two"), (2, f"three {passage} four")]).selectExpr("*", "7 AS _SPANS", "8 AS _ID", "9 AS _NEW", "6 AS _Variant")
    got = D.cut_repeats(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r["_SPANS"], r["_ID"], r["_NEW"]) for r in got.collect()) == [(1, 7, 8, 9), (2, 7, 8, 9)]
    with pytest.raises(TypeError, match="whole number"):
        D.cut_repeats(docs.withColumn("doc_id", docs.doc_id.cast("string")))
