import random
from collections import Counter

import pytest

from quillion.llm import packing as P
from quillion.llm import sentencepieces as S


def naive(lengths, capacities, cost):
    """Best fit, one piece at a time, in falling order; the size of new bins is chosen once for each length."""
    counts = Counter(lengths)
    sizes, bins, left = sorted(counts), [], sorted(lengths, reverse=True)
    choice = {}
    for at, size in enumerate(left):
        fit = min(((room, k) for k, (room, _) in enumerate(bins) if room >= size), default=None)
        if fit is None:
            if size not in choice:
                rest = sum(1 for x in left[at:] if x == size)
                choice[size] = P.best_capacity(size, rest, sizes[: sizes.index(size)], counts, capacities, cost)
            bins.append([choice[size], []])
            fit = (choice[size], len(bins) - 1)
        bins[fit[1]][0] -= size
        bins[fit[1]][1].append(size)
    return sorted(sorted(b) for _, b in bins)


@pytest.mark.parametrize("seed", range(25))
def test_plan_is_best_fit(seed):
    rng, capacities = random.Random(seed), (8, 16, 32)
    lengths = [rng.randint(1, 32) for _ in range(rng.randint(1, 150))]
    bins: dict[int, list[int]] = {}
    placed = Counter()
    for size, a, b, first, per in P.plan(Counter(lengths), capacities):
        for r in range(a, b):
            bins.setdefault(first + (r - a) // per, []).append(size)
            placed[size] += 1
    assert placed == Counter(lengths)
    assert sorted(sorted(b) for b in bins.values()) == naive(lengths, capacities, P.sequence_cost())


def test_new_bin_size_is_the_cheapest():
    linear = P.linear_cost(0)
    assert P.best_capacity(5, 1, [], {}, (8, 16), linear) == 8
    assert P.best_capacity(8, 2, [], {8: 2}, (8, 16), P.linear_cost(10)) == 16
    assert P.best_capacity(8, 2, [], {8: 2}, (8, 16), linear) == 8


def texts_of(spark, bins):
    """(doc_id, text) of the documents that the bins hold, from their ids; documents have ids of their own."""
    parts = {}
    for r in bins:
        assert len(r.ids) == r.used <= r.capacity and r.used == sum(p.length for p in r.pieces)
        assert r.n_pieces == len(r.pieces) and r.doc_ids == [p.doc_id for p in r.pieces]
        at = 0
        for p in r.pieces:
            parts.setdefault(p.doc_id, []).append((p.part, p.start, r.ids[at : at + p.length]))
            at += p.length
    whole = [(d, [i for *_, x in sorted(ps) for i in x]) for d, ps in parts.items()]
    for ps in parts.values():
        ps.sort()
        assert [k for k, *_ in ps] == list(range(len(ps))) and [a for _, a, _ in ps] == [sum(len(x) for *_, x in ps[:k]) for k in range(len(ps))]
    return {r.doc_id: r.text for r in S.decode(spark.createDataFrame(whole, "doc_id long, ids array<int>")).collect()}


def test_bins_hold_every_token(spark, odd, empty):
    own = odd.selectExpr("CAST(row_number() OVER (ORDER BY text, source) AS long) AS doc_id", "text", "lang AS PACK", "source AS IDS", "n_chars AS part")
    for chars in (1 << 24, 50_000):
        got = P.pack(own, capacities=(64, 128, 256), group_chars=chars).collect()
        assert all(not any(c >= r.used for c in (64, 128, 256) if c < r.capacity) for r in got)
        assert len({r.bin_id for r in got}) == len(got) and (len({r.bin_id >> 32 for r in got}) > 1) == (chars == 50_000)
        assert texts_of(spark, got) == {r.doc_id: r.text for r in own.collect() if r.text}
    assert P.pack(odd).selectExpr("sum(used)").first()[0] == sum(r.used for r in got)
    assert P.pack(empty).count() == 0 and P.pack(odd.withColumn("doc_id", odd.doc_id.cast("string"))).count() > 0


def test_lengths_are_tokens(spark, docs_of):
    chinese = "天地玄黄宇宙洪荒日月盈昃辰宿列张" * 900
    got = P.pack(docs_of([(1, chinese), (2, "short")])).collect()
    assert sum(r.used for r in got) > 5000 and texts_of(spark, got) == {1: chinese, 2: "short"}


def naive_anew(lengths, capacities, cost):
    """Best fit, one piece at a time; each new bin's size is chosen with the pieces that no earlier bin of its length counted on."""
    left, bins, queue = Counter(), [], sorted(lengths, reverse=True)
    for at, size in enumerate(queue):
        if at == 0 or queue[at - 1] != size:
            left = Counter(lengths)
        fit = min(((room, k) for k, (room, _) in enumerate(bins) if room >= size), default=None)
        if fit is None:
            left[size] = sum(1 for x in queue[at:] if x == size)
            tried = []
            for c in capacities:
                if c >= size:
                    room, used = c, Counter()
                    for x in sorted((x for x in left if x <= size), reverse=True):
                        used[x] = min(left[x], room // x)
                        room -= used[x] * x
                    tried.append((cost(c) / (c - room), c, used))
            _, c, used = min(tried, key=lambda t: t[:2])
            left.subtract({x: n for x, n in used.items() if x < size})
            bins.append([c, []])
            fit = (c, len(bins) - 1)
        bins[fit[1]][0] -= size
        bins[fit[1]][1].append(size)
    return sorted((room + sum(b), sorted(b)) for room, b in bins)


def placed_bins(rows):
    bins: dict[int, list[int]] = {}
    for size, a, b, first, per in rows:
        for r in range(a, b):
            bins.setdefault(first + (r - a) // per, []).append(size)
    return bins


@pytest.mark.parametrize("seed", range(40))
def test_plan_chooses_for_every_bin(seed):
    rng, capacities = random.Random(seed), (8, 16, 32)
    cost = P.linear_cost(rng.choice([1, 4, 16, 64]))
    some = [rng.randint(1, 32) for _ in range(rng.randint(1, 8))]
    lengths = [rng.choice(some) for _ in range(rng.randint(1, 200))]
    got = placed_bins(P.plan(Counter(lengths), capacities, cost)).values()
    assert sorted(map(sorted, got)) == [b for _, b in sorted(naive_anew(lengths, capacities, cost), key=lambda x: x[1])]


def test_one_filler_serves_one_bin():
    bins, cost = placed_bins(P.plan({300: 100_000, 212: 1})).values(), P.sequence_cost()
    spent = sum(cost(min(c for c in P.CAPACITIES if c >= sum(b))) for b in bins)
    assert sum(map(sum, bins)) == 30_000_212 and spent < 1.29 * 30_000_212


def test_pack_is_the_plan(spark, docs_of):
    rng = random.Random(3)
    docs = docs_of([(k, "a " * rng.randint(1, 700)) for k in range(120)])
    lengths = [x for r in S.encode(docs, n=1).collect() for x in [64] * (r.n_pieces // 64) + [r.n_pieces % 64] if x]
    got = P.pack(docs, capacities=(16, 32, 64)).collect()
    assert sorted(sorted(p.length for p in r.pieces) for r in got) == [b for _, b in sorted(naive_anew(lengths, (16, 32, 64), P.sequence_cost()), key=lambda x: x[1])]
