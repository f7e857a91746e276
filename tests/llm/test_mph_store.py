import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillion.llm import mph_store as M
from quillion.llm import sentencepieces as S


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 5000])
def test_index_is_minimal_and_perfect(n):
    keys = np.random.default_rng(n).choice(1 << 60, n, replace=False).astype(np.uint64)
    index = M.Index.build(keys)
    assert sorted(index.slots(keys).tolist()) == list(range(n))


def test_shard_finds_own_keys_and_no_others():
    rng = np.random.default_rng(1)
    keys = rng.choice(1 << 40, 3000, replace=False).astype(np.int64) - (1 << 39)
    runs = [rng.integers(0, 60000, rng.integers(0, 20)).astype("<u2") for _ in keys]
    row = M.make_shard(0, keys, pa.array([r.tobytes() for r in runs], pa.binary()), 2)
    shard = M.Shard(row)
    assert row["found"] == row["n_keys"] == 3000
    for k in range(0, 3000, 7):
        assert np.array_equal(shard.get(int(keys[k])), runs[k])
    strange = np.setdiff1d(rng.choice(1 << 40, 3000), keys + 0)
    assert (shard.find((strange + (1 << 41)).view(np.uint64)) >= 0).sum() == 0


def test_rows_of_one_key_lie_together():
    runs = [np.array(x, "<u2").tobytes() for x in ([5, 6], [1], [9], [2, 3])]
    shard = M.Shard(M.make_shard(0, np.array([4, 4, 8, 4]), pa.array(runs, pa.binary()), 2))
    assert shard.get(4).tolist() == [1, 2, 3, 5, 6] and shard.get(8).tolist() == [9] and shard.get(5) is None


def test_store_gives_back_every_document(spark, odd, empty, tmp_path):
    assert M.build(odd, shard_chars=1 << 16).agg(F.sum("n_keys"), F.sum("found"), F.sum("n_rows")).first() == (9, 9, 11)
    for path in (str(tmp_path / "a"), f"file://{tmp_path}/b"):
        made = M.write(odd, path, shard_chars=1 << 16)
        assert made.agg(F.sum("n_keys"), F.sum("found"), F.sum("n_rows")).first() == (9, 9, 11)
        got = {r.key: r.ids for r in M.lookup(spark, path, spark.createDataFrame([(k,) for k in [1, 2, 3, 5, 6, 7, 7, 8, 99, None]], "key long")).collect()}
    best = {}
    for r in S.encode(odd, n=1).orderBy("doc_id").collect():
        best.setdefault(r.doc_id, []).append(r.ids)
    assert set(got) == {1, 2, 3, 5, 6, 7, 8} and got[2] == [] and got[3] == []
    assert got[6] == best[6][0] and got[7] == best[7][0] * 2 and sorted(got[8]) == sorted(sum(best[8], []))
    assert M.build(empty).count() == 0
    M.write(empty, str(tmp_path / "none"))
    assert M.lookup(spark, str(tmp_path / "none"), spark.createDataFrame([(1,)], "key long")).count() == 0
    with pytest.raises(TypeError, match="whole number"):
        M.build(odd.withColumn("doc_id", odd.doc_id.cast("string")))


def test_reads_grow_with_the_keys_not_with_the_store(tmp_path):
    rng = np.random.default_rng(2)
    read = {}
    for n in (500, 20_000):
        keys = np.arange(n, dtype=np.int64) * 7919
        runs = [rng.integers(0, 60000, 50).astype("<u2") for _ in keys]
        M.save_shard(M.make_shard(n, keys, pa.array([r.tobytes() for r in runs], pa.binary()), 2), str(tmp_path))
        stored = M.StoredShard(str(tmp_path), n)
        before = stored.bytes_read
        for k in range(0, 500, 5):
            assert np.array_equal(stored.get(int(keys[k])), runs[k])
        assert all(stored.get(int(k)) is None for k in keys[:200] + 1)
        read[n] = stored.bytes_read - before
    assert read[20_000] < 1.2 * read[500] < 100 * 300 + 200 * 40


def test_long_headers_are_read(tmp_path):
    row = M.make_shard(1, np.array([5], np.int64), pa.array([b"ab"], pa.binary()), 2)
    row["level_bits"] = row["level_bits"] + [64] * 3000
    M.save_shard(row, str(tmp_path))
    assert M.StoredShard(str(tmp_path), 1).get(5).tolist() == [0x6261]
