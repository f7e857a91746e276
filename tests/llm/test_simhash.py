import random

import numpy as np
import pytest

from quillion.llm import simhash as H

from .conftest import prose


def groups_by_force(f, radius):
    n = len(f)
    group = list(range(n))
    for i in range(n):
        for j in range(i):
            if sum(bin(int(x) ^ int(y)).count("1") for x, y in zip(f[i], f[j])) <= radius:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    return group


@pytest.mark.parametrize("seed", range(4))
def test_tiles_find_every_pair(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, (12, 2), dtype=np.uint64)
    f = base[rng.integers(0, 12, 150)].copy()
    for _ in range(rng.integers(1, 20)):
        f[np.arange(150), rng.integers(0, 2, 150)] ^= np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64)
    node, least = H.components(np.arange(150), f, None, 8)
    assert dict(zip(node, least)) == dict(enumerate(groups_by_force(f, 8)))


def test_tile_size_does_not_matter(monkeypatch):
    rng = np.random.default_rng(5)
    f = rng.integers(0, 1 << 63, (90, 2), dtype=np.uint64)
    f[::3] = f[0] ^ np.uint64(3)
    whole = sorted(zip(*H.components(np.arange(90), f, None, 50)))
    monkeypatch.setattr(H, "TILE", 16)
    assert sorted(zip(*H.components(np.arange(90), f, None, 50))) == whole


def test_whole_search_against_force(docs_of):
    rng, rows = random.Random(2), []
    for d in range(40):
        words = prose(150, d % 13).split()
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(150)] = "changed"
        rows.append((d * 3, " ".join(words)))
    docs = docs_of(rows)
    prints = sorted((r.doc_id, r.f0, r.f1) for r in H.fingerprints(docs).collect())
    f = np.array([[a, b] for _, a, b in prints], np.int64).view(np.uint64)
    groups = groups_by_force(f, 24)
    want = {prints[k][0]: prints[g][0] for k, g in enumerate(groups) if g != k}
    got = {r.doc_id: r.duplicate_of for r in H.near_duplicates(docs, stripes=3).collect()}
    assert got == want and len(got) >= 20


def test_chains_of_copies_become_one_group(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(40)] + [(101, 100)], "a long, b long")
    got = {r.node: r.least for r in H.connect(edges).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100}


def test_odd_rows(odd, empty):
    gone = H.near_duplicates(odd).collect()
    assert {(r.doc_id, r.duplicate_of) for r in gone} == {(5, 1)}
    kept = H.keep_one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "3", "4", "None", "None", "6", "7", "8", "8", "9"])  # 8 has two texts
    assert H.near_duplicates(empty).count() == 0 and H.keep_one_of_each(empty).count() == 0


def test_texts_of_one_id_are_documents_of_their_own(docs_of):
    a, b, c = prose(90, 1), prose(90, 2), prose(90, 3)
    docs = docs_of([(1, a), (2, a), (2, b), (3, b), (4, c), (4, c)])
    assert sorted((r.doc_id, r.duplicate_of, r.group_size) for r in H.near_duplicates(docs).collect()) == [(2, 1, 2), (3, 2, 2)]
    assert sorted((r.doc_id, r.text) for r in H.keep_one_of_each(docs).collect()) == sorted([(1, a), (2, b), (4, c)])


def test_ids_of_any_type_and_names_in_any_case(spark, docs_of):
    docs = docs_of([(1, prose(90, 1)), (2, prose(90, 1)), (3, prose(90, 2))])
    named = docs.selectExpr("concat('d', doc_id) AS doc_id", "text", "1 AS _RANK", "2 AS _Own", "3 AS _GONE_ID", "4 AS _gone_TEXT")
    assert [(r.doc_id, r.duplicate_of) for r in H.near_duplicates(named).collect()] == [("d2", "d1")]
    kept = H.keep_one_of_each(named)
    assert kept.columns == named.columns
    assert sorted(tuple(r)[0::2] for r in kept.collect()) == [("d1", 1, 3), ("d3", 1, 3)]


def test_short_words_weigh_the_same_in_every_text():
    """A word more or less changes the fingerprint of near copies little, however many long words they have."""
    for n in range(10, 24):
        a = " ".join(["a of the to in"] + [f"longword{k}" for k in range(n)])
        raw = (a + a + " longwordmore").encode()
        f, _ = H.fingerprints_of(np.frombuffer(raw, np.uint8), np.array([0, len(a), len(raw)]))
        assert np.bitwise_count(f[0] ^ f[1]).sum() <= 24


@pytest.mark.parametrize("radius, blocks", [(24, 4), (24, 5), (3, 4), (2, 4), (9, 5)])
def test_masks_miss_no_pair_within_the_radius(radius, blocks):
    rng = np.random.default_rng(radius)
    masks = np.zeros((len(H.covering(radius, blocks)), 128), bool)
    for k, bits in enumerate(H.covering(radius, blocks)):
        masks[k, bits] = True
    for n in range(2000):
        differ = rng.choice(128, radius, False) if n % 2 else (rng.integers(0, 128) + np.arange(radius)) % 128
        assert (~masks[:, differ].any(1)).any()


def planted(rows, seed=9):
    """Fingerprints, a tenth of them near another one (groups, chains and a crowd that is like one)."""
    rng = np.random.default_rng(seed)
    f = rng.integers(0, 1 << 63, (rows, 2), dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, (rows, 2), dtype=np.uint64)
    to = rng.permutation(rows)[: rows // 10]
    bits = np.unpackbits(f.view(np.uint8), axis=1)
    for k, at in enumerate(to[1:]):
        bits[at] = bits[to[0] if k < 600 else to[k]]
        bits[at, rng.choice(128, int(rng.integers(1, 13 if k < 600 else 27)), False)] ^= 1
    return np.packbits(bits, axis=1).view(np.uint64)


def test_work_does_not_grow_with_the_square(monkeypatch):
    """Before, every pair of 40,000 rows was compared."""
    f, looked = planted(40_000), [0]
    node = np.random.default_rng(0).permutation(len(f))
    tiles = H._by_tiles(f, np.zeros(len(f), int), [np.arange(len(f))] * 2, True, 24, (0, 1), np.arange(len(f)))
    within, near, far = H._within, H._next_to, H._far

    def count(n):
        looked[0] += int(n)

    monkeypatch.setattr(H, "_within", lambda a, b, *rest: (count(len(a) * len(b)), within(a, b, *rest))[1])
    monkeypatch.setattr(H, "_next_to", lambda s, n, r: (count(len(s[0]) * n), near(s, n, r))[1])
    monkeypatch.setattr(H, "_far", lambda w, rows, a, b, r: (count(np.maximum(b - a, 0).sum()), far(w, rows, a, b, r))[1])
    got = dict(zip(*H.components(node, f, None, 24)))
    assert looked[0] < len(f) ** 2 / 2 / 4
    while not np.array_equal(tiles, up := tiles[tiles]):
        tiles = up
    least = np.full(len(f), len(f))
    np.minimum.at(least, tiles, node)
    assert got == dict(zip(node.tolist(), least[tiles].tolist())) and (least[tiles] != node).sum() > 2000


def test_shares_and_sides_together_find_all(monkeypatch):
    f = planted(3000)
    node, side = np.arange(3000), np.arange(3000) % 2
    want = dict(zip(*H.components(node, f, None, 24)))
    for way in ("tiles", "masks"):
        monkeypatch.setattr(H, "_masks", lambda *a: None if way == "tiles" else H.covering(24, 4))
        monkeypatch.setattr(H, "TILE", 256)
        parent = node.copy()
        for rows, of in ((node[side == 0], None), (node[side == 1], None), (node, side)):
            for k in range(3):
                a, b = H.components(rows, f[rows], of, 24, (k, 3))
                parent = H._join(parent, a, b)
        least = np.full(3000, 3000)
        np.minimum.at(least, parent, node)
        assert dict(zip(node.tolist(), least[parent].tolist())) == want


def test_many_stripes_and_shares_find_the_same_groups(spark):
    """Each pair of stripes is a task of its own, so none waits for several in one."""
    f = planted(4000).view(np.int64)
    rows = [(k, int(a), int(b), int(np.bitwise_count(f[k : k + 1].view(np.uint64)).sum())) for k, (a, b) in enumerate(f)]
    distinct = spark.createDataFrame(rows, "node long, f0 long, f1 long, pc int")
    want = dict(zip(*H.components(np.arange(4000), f.view(np.uint64), None, 24)))
    for stripes, small in ((1, 1000), (1, 8192), (5, 500)):
        pairs = H.near_pairs(distinct, 24, stripes, small=small)
        got = {r.node: r.least for r in H.connect(pairs).collect()}
        assert {k: got.get(k, k) for k in range(4000)} == want
