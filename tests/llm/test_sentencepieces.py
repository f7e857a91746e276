import random
import time

import numpy as np
import pytest

from quillion.llm import sentencepieces as S


def toy(prefix=True, bytes_too=True):
    pieces = [b"", b" ", b" a", b"a", b"b", b"ab", b"ba", b" ab", b"c", b"abc", b"bc", "é".encode(), "éa".encode(), b"  ", b"\n"]
    rng = random.Random(2)
    score = [0] + [-rng.randint(1, 9) * S.UNIT for _ in pieces[1:]]
    at = None
    if bytes_too:
        at = np.arange(len(pieces), len(pieces) + 256)
        pieces, score = pieces + [b""] * 256, score + [0] * 256
    return S.Vocabulary(pieces, np.array(score), at, 0, prefix)


def brute(v, text, n):
    chunk = text.encode()
    chunk = b" " + chunk if chunk and v.prefix else chunk
    into, found = v.edges(chunk), []

    def back(at, score, path):
        if at == 0:
            found.append((score, tuple(path)))
            return
        for i, s, k in into[at]:
            back(i, score + s, [(i, at, k), *path])

    back(len(chunk), 0, [])
    return sorted((s for s, _ in found), reverse=True)[:n], len(found)


@pytest.mark.parametrize("seed", range(40))
def test_all_paths_of_short_texts(seed):
    rng, v = random.Random(seed), toy(bytes_too=seed % 2 == 0)
    text = "".join(rng.choice("aabbc é漢\n") for _ in range(rng.randint(0, 11)))
    raw = text.encode()
    e = S.Encoded(S.Memory(v), np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    others = e.others(0, 6, {})
    want, _ = brute(v, text, 6)
    assert [int(e.score[0])] + [s for s, _ in others] == want
    paths = [tuple(e.ids.tolist())] + [tuple(x.tolist()) for _, x in others]
    assert len(set(paths)) == len(paths)
    if seed % 2 == 0:
        for p in paths:
            ids = np.array(p, np.int32)
            assert S.written(v, ids, np.array([0, len(ids)]))[0].tobytes() == raw


def test_ties_give_no_path_twice():
    pieces = [b"", b" ", b"a", b"b", b" a", b"ab", b"ba", b" ab"]
    v = S.Vocabulary(pieces, np.array([0, *[-S.UNIT] * 2, -S.UNIT, *[-2 * S.UNIT] * 3, -3 * S.UNIT]), None, 0)  # all paths score alike
    for text in (b"abab", b"ab ab ab", b"ab", b"a b"):
        e = S.Encoded(S.Memory(v), np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        for n in (2, 3, 5):
            paths = [tuple(e.ids.tolist())] + [tuple(x.tolist()) for _, x in e.others(0, n, {})]
            assert len(set(paths)) == len(paths) == min(n, brute(v, text.decode(), 99)[1])


def test_a_star_meets_paths_in_order():
    v = toy()
    got = S.n_best(v.edges(b" abcabab"), 50)
    scores = [s for s, _ in got]
    assert scores == sorted(scores, reverse=True) and len({tuple(p) for _, p in got}) == len(got)
    assert S.forward(v.edges(b" abcabab"))[-1] == scores[0]


def test_long_chunks_are_solved_as_short_ones():
    v, rng = toy(), random.Random(9)
    text = "".join(rng.choice("abc") for _ in range(300)).encode()
    long = S.solve(v, np.frombuffer(text, np.uint8), np.array([0, 0]), np.array([300, 30]))
    into = v.edges(text)
    assert long.score[0] == S.forward(into)[300]
    two = S.n_best(v.edges(text[:30]), 2)
    assert long.score[1] == two[0][0] and long.gap[1] == two[0][0] - two[1][0]
    both = S.n_best(into, 2)
    assert long.gap[0] == both[0][0] - both[1][0]


def words_of(rng, letters, sizes):
    enc = ["".join(rng.choice(letters) for _ in range(n)).encode() for n in sizes]
    at = np.r_[0, np.cumsum([len(x) for x in enc])]
    return enc, np.frombuffer(b"".join(enc), np.uint8), at[:-1], at[1:]


@pytest.mark.parametrize("step", [1, 64, 1 << 18])
def test_many_chunks_are_solved_as_each_alone(step):
    rng = random.Random(4)
    for v, letters in ((toy(), "aabbc é漢\n"), (toy(bytes_too=False), "abcé漢"), (S.load(S._read_model(S.MODEL)).vocabulary, "theirandong é漢🙂\x00")):
        enc, raw, start, end = words_of(rng, letters, [rng.randint(1, 30) for _ in range(60)])
        got = S.solve(v, raw, start, end, step)
        alone = S.Vocabulary(v.texts, v.scores, v.bytes_at, v.unknown, False)
        for c, chunk in enumerate(enc):
            two = S.n_best(v.edges(chunk), 2)
            assert got.score[c] == two[0][0] and got.gap[c] == (two[0][0] - two[1][0] if len(two) > 1 else -S.NONE)
            ids = got.ids[got.at[c] : got.at[c + 1]]
            if v.bytes_at is not None:
                assert S.written(alone, ids, np.array([0, len(ids)]))[0].tobytes() == chunk


def test_a_byte_of_a_long_word_costs_as_one_of_a_short_word():
    rng, v = random.Random(5), S.load(S._read_model(S.MODEL)).vocabulary

    def seconds(size):
        _, raw, start, end = words_of(rng, "abcdefghijklmnopqrstuvwxyz", [size] * (360_000 // size))
        took = []
        for _ in range(3):
            began = time.process_time()
            S.solve(v, raw, start, end)
            took.append(time.process_time() - began)
        return min(took)

    assert seconds(36) < 2.5 * seconds(6)


def test_real_model_round_trip_and_odd_rows(spark, odd, empty):
    got = S.encode(odd, n=3)
    rows = got.collect()
    assert all(r.restores for r in rows)
    assert {r.doc_id for r in rows} == {1, 3, 4, 5, 6, 7, 8, 9, None}
    assert [(r["rank"], r.n_pieces) for r in rows if r.doc_id == 3] == [(1, 0)]
    texts = S.decode(got).where("doc_id = 6").select("text").distinct().collect()
    assert [r.text for r in texts] == [odd.where("doc_id = 6").first().text]
    assert S.encode(empty).count() == 0


def test_rejects_ids_outside_the_vocabulary(spark):
    with pytest.raises(Exception, match="outside the vocabulary"):
        S.decode(spark.createDataFrame([([40_000_000],)], "ids array<int>")).collect()
