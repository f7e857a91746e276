import math

import pytest

from quillion.llm import hash_ring as H


def brute(keys, shards, vnodes, slack):
    """Keys in ring order, one at a time."""
    ring = H.points(range(shards), vnodes)
    bound = math.ceil(len(set(keys)) * (1 + slack) / shards)
    load, out = dict.fromkeys(range(shards), 0), {}
    for place, key in sorted((H.place_of(str(k)), k) for k in set(keys)):
        k = next((k for k, (p, _) in enumerate(ring) if p >= place), 0)
        while load[ring[k % len(ring)][1]] >= bound:
            k += 1
        out[key] = ring[k % len(ring)][1]
        load[out[key]] += 1
    return out, bound


@pytest.mark.parametrize("n,shards,vnodes,slack", [(500, 5, 4, 0.05), (97, 7, 1, 0.0), (64, 64, 2, 0.1), (3, 8, 3, 0.5)])
def test_matches_one_by_one(spark, n, shards, vnodes, slack):
    docs = spark.range(n).withColumnRenamed("id", "doc_id")
    got = {r.doc_id: r.shard for r in H.assign(docs, shards=shards, vnodes=vnodes, slack=slack).collect()}
    want, bound = brute(range(n), shards, vnodes, slack)
    assert got == want
    loads = [list(got.values()).count(s) for s in range(shards)]
    assert max(loads) <= bound


def test_few_keys_move_when_a_shard_is_added(spark):
    before, _ = brute(range(2000), 10, 32, 0.25)
    after, _ = brute(range(2000), 11, 32, 0.25)
    moved = sum(before[k] != after[k] for k in before)
    assert moved < 2000 * 0.3


def test_odd_rows(odd, empty):
    got = H.assign(odd, shards=3, vnodes=4).collect()
    assert len(got) == odd.count()
    assert all((r.shard is None) == (r.doc_id is None) for r in got)
    by_key = {}
    for r in got:
        by_key.setdefault(r.doc_id, set()).add(r.shard)
    assert all(len(v) == 1 for v in by_key.values())
    assert H.assign(empty).count() == 0
