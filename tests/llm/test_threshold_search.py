import numpy as np
import pytest

from quillion.llm import threshold_search as T


def brute(ids, x, own, q, k):
    out = []
    for i, v in zip(own, q):
        s = np.round((x.astype(float) * v.astype(float)).sum(1), 6)
        best = sorted((-s[j], ids[j]) for j in range(len(ids)) if ids[j] != i)[:k]
        out += [(i, b, -a) for a, b in best]
    return out


@pytest.mark.parametrize("n,d,k,kind", [(300, 8, 5, "normal"), (700, 3, 10, "normal"), (400, 16, 4, "ties"), (5, 4, 10, "normal"), (900, 2, 3, "skew"), (200, 6, 3, "zero")])
def test_block_is_exact(n, d, k, kind):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, d)).astype(np.float32)
    if kind == "ties":
        x = np.round(x)
    if kind == "skew":
        x *= rng.lognormal(sigma=2, size=(n, 1)).astype(np.float32)
    if kind == "zero":
        x[::3] = 0
    ids = rng.permutation(n) * 3
    q, at, s, _ = T.search(T.Lists(ids, x), ids, x, k, first=8)
    assert sorted(zip(ids[q], ids[at], s)) == sorted(brute(ids, x, ids, x, k))


def test_bound_stops_before_the_end():
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(4000, 2)) * rng.lognormal(sigma=1.5, size=(4000, 1))).astype(np.float32)
    *_, depth = T.search(T.Lists(np.arange(4000), x), np.arange(4000), x, 5)
    assert np.median(depth) < 1000


def test_over_blocks_with_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=4).tolist(), k % 3) for k in range(120)]
    rows += [(200, None, 1), (None, [1.0, 2.0, 3.0, 4.0], 1), (201, [], 1), (202, [1.0, float("nan"), 0.0, 0.0], 1), (203, [1.0, None, 0.0, 0.0], 1)]
    rows += [(300, [1.0, 2.0], 0), (301, [2.0, 1.0], 0), (300, [0.5, 2.0], 0), (7, rows[7][1], 1), (204, [float("inf"), 0.0, 0.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    ids = np.arange(120)
    x = np.array([r[1] for r in rows[:120]], np.float32)
    for every, wave in ((1, 1500), (10, 1 << 25)):
        got = T.neighbours(df.withColumn("rank", df.label), k=4, every=every, wave_bytes=wave, block_bytes=1000).collect()
        want = [r for r in brute(ids, x, ids, x, 4) + [(300, 301, 2.0 * 0.5 + 2.0), (301, 300, 3.0)] if r[0] % every == 0]
        assert sorted((r.vec_id, r.neighbour, r.score) for r in got) == sorted(want)
        assert all(r["rank"] <= 4 for r in got)
    assert T.neighbours(df.where("false")).count() == 0 and T.neighbours(df.where("vec_id % 100 > 0")).count() == 0
    with pytest.raises(TypeError, match="whole number"):
        T.neighbours(df.withColumn("vec_id", df.vec_id.cast("string")))


def test_doubles_stay_doubles(spark):
    rows = [(0, [1e25, 1.0]), (1, [1.0 + 1e-6, 0.0]), (2, [1.0, 0.0]), (3, [-1e25, 3.0])]
    got = T.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3, every=2).collect()
    assert [r.neighbour for r in sorted((r for r in got if r.vec_id == 0), key=lambda r: r["rank"])] == [1, 2, 3]


def test_principal_axes_let_the_bound_stop():
    """Forty dimensions that a few directions explain: the lists along the axes stop early, and the result is exact."""
    rng = np.random.default_rng(8)
    plain = rng.normal(size=(5000, 40)) * np.r_[5.0, 3.0, np.full(38, 0.02)]
    x = plain @ np.linalg.qr(rng.normal(size=(40, 40)))[0]
    ids = np.arange(5000)
    q, at, s, depth = T.search(T.Lists(ids, x), ids[:100], x[:100], 5)
    assert sorted(zip(ids[q], ids[at], s)) == sorted(brute(ids, x, ids[:100], x[:100], 5))
    assert np.median(depth) < 2500
