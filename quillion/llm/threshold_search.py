"""Exact top-k inner products by Fagin's threshold algorithm.

Every dimension of a block of vectors is a sorted list.  A query reads all lists
from the end where its coordinate gains most, to the same depth; vectors that it
meets are scored in full.  No vector that is still unseen can score more than the
sum over the dimensions of coordinate times the value at that depth.  A query
stops when this bound is below its k-th best score, else it reads on to four
times the depth.  When all but a sixteenth of the block has been met, the rest is
scored without reading the lists any further.

The dimensions are those of the block's principal axes.  Turning vectors and
query alike leaves inner products as they are, but a few axes then hold most of
what tells vectors apart and the bound falls soon.  Vectors without such
structure gain nothing: most of a block is met before the bound stops a query.
The answer is exact either way, since candidates are scored by the vectors as
given.

Queries are handled in tiles: marks of what each has met, and one matrix product
for what the tile's queries have met anew.

The queries are the rows whose id is divisible by ``every``.  They are cut into
waves of about ``wave_bytes``, a bounded table that is sent to all tasks; a wave
is one scan of all vectors, in blocks of the tasks' own rows (``block_bytes``), and
only the k best a query and block are shuffled.  No vector is.

Defined results:

* Rows whose id or vector is null, and vectors that are empty or hold a null, NaN
  or infinity, take no part.  An empty table gives an empty result.
* Ids must be whole numbers.  Rows with equal id are one vector, the least of
  theirs.
* Vectors are compared with those of the same number of dimensions, as doubles,
  however long.
* Scores are rounded to six decimals; equal scores go by the lesser id.  A vector
  is not its own neighbour.  Where fewer than k others exist, all are given.
* Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, ship, whole_numbers

DECIMALS = 6
SLACK = 1e-5
FEW = 1 / 16


class Lists:
    """A block of vectors with its sorted lists; ``turn`` takes vectors to the principal axes."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.exact = ids, np.ascontiguousarray(vectors, np.float64)
        spread = self.exact / max(1.0, np.abs(self.exact).max(initial=0))
        self.turn = np.linalg.eigh(spread.T @ spread)[1]
        self.vectors = self.exact @ self.turn
        self.order = np.argsort(self.vectors.T, axis=1, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(self.vectors.T, self.order, 1)
        self.longest = float(np.sqrt((self.exact**2).sum(1)).max(initial=0))


def search(lists: Lists, own_ids: np.ndarray, queries: np.ndarray, k: int, first: int = 64, tile: int = 128) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector row, score, depth read for the query) of the k best vectors of each query."""
    out_q, out_x, out_s = [], [], []
    depth_of = np.zeros(len(queries), np.int64)
    n = len(lists.ids)
    for a in range(0, len(queries), tile):
        asked = np.ascontiguousarray(queries[a : a + tile], np.float64)
        q = asked @ lists.turn
        slack = SLACK * (1 + np.sqrt((asked**2).sum(1)) * lists.longest)
        live = np.arange(len(q))
        seen = np.zeros((len(q), n), bool)
        score = np.full((len(q), n), -np.inf)
        scored = np.zeros(n, bool)
        depth, kth = 0, np.full(len(q), -np.inf)
        mine = lists.ids[None, :] == own_ids[a : a + tile, None]
        while len(live):
            upto = min(n, max(first, 4 * depth, n // 64))
            positive = q[live] > 0
            for d in range(q.shape[1]):
                top, low = live[positive[:, d]], live[~positive[:, d]]
                for rows, met in ((top, lists.order[d, n - upto : n - depth]), (low, lists.order[d, depth:upto])):
                    if len(rows):
                        seen[rows[:, None], met] = True
            depth = upto
            if (rest := ~seen[live]).mean() < FEW:  # the lists' rest holds little new; it is met at once
                rows, met = np.nonzero(rest)
                seen[live[rows], met] = True
                depth = n
            depth_of[a + live] = depth
            # random access to what the tile's queries have met
            anew = seen[live].any(0) & ~scored
            if anew.mean() > 0.5:
                score[live] = q[live] @ lists.vectors.T
                scored[:] = True
            elif anew.any():
                at = np.flatnonzero(anew)
                score[np.ix_(live, at)] = q[live] @ lists.vectors[at].T
                scored |= anew
            known = np.where(seen[live] & ~mine[live], score[live], -np.inf)
            if n > k:
                kth[live] = np.partition(known, n - k, axis=1)[:, n - k]
            bound = np.where(positive, q[live] * lists.values[:, n - depth], q[live] * lists.values[:, depth - 1]).sum(1)
            done = (bound < kth[live] - slack[live]) | (depth >= n)
            for r, row in zip(live[done], known[done]):
                at = np.flatnonzero((row >= kth[r] - slack[r]) & (row > -np.inf))
                exact = np.round((lists.exact[at] * asked[r]).sum(1), DECIMALS)
                best = np.lexsort((lists.ids[at], -exact))[:k]
                out_q.append(np.full(len(best), a + r))
                out_x.append(at[best])
                out_s.append(exact[best])
            live = live[~done]
    z = np.zeros(0, np.int64)
    return np.concatenate([z, *out_q]), np.concatenate([z, *out_x]), np.concatenate([z.astype(float), *out_s]) + 0.0, depth_of


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _by_dims(batches: list[pa.RecordBatch]):
    """(ids, vectors) of the rows of each number of dimensions."""
    table = pa.Table.from_batches(batches).combine_chunks()
    dims = table["dims"].to_numpy()
    for d in np.unique(dims):
        own = table.filter(pa.array(dims == d)).combine_chunks()
        yield int(d), own["id"].to_numpy(), _matrix(own["v"].combine_chunks())


def neighbours(
    vectors: DataFrame, k: int = 10, every: int = 100, key: str = "vec_id", column: str = "embedding", wave_bytes: int = 1 << 25, block_bytes: int = 1 << 24
) -> DataFrame:
    """(<key>, rank, neighbour, score): for each vector whose id is divisible by ``every``, the ``k`` vectors of greatest inner product with it."""
    spark = vectors.sparkSession
    ship(spark)
    whole_numbers(vectors, key)
    usable = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    held = (
        vectors.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v"))
        .where(F.col("id").isNotNull() & usable)
        .groupBy("id")
        .agg(F.min("v").alias("v"))
        .withColumn("dims", F.size("v"))
    )
    held = materialize(held, "vectors")
    asked = held.where(F.pmod("id", F.lit(every)) == 0)
    n, most = asked.agg(F.count("*"), F.coalesce(F.max("dims"), F.lit(0))).first()
    waves = max(1, -(-n * most * 8 // wave_bytes))
    best = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "neighbour"))
    out = spark.createDataFrame([], "id long, neighbour long, score double")
    for wave in range(waves):
        # about wave_bytes of queries, whatever the corpus
        mine = asked.where(F.pmod(F.xxhash64("id"), F.lit(waves)) == wave).toArrow()
        sent = spark.sparkContext.broadcast({d: (ids, x) for d, ids, x in _by_dims(mine.to_batches())} if len(mine) else {})

        def run(batches, sent=sent):
            waiting, size = [], 0

            def compare():
                for d, ids, x in _by_dims(waiting):
                    if d in sent.value:
                        own, q = sent.value[d]
                        at, to, score, _ = search(Lists(ids, x), own, q, k)
                        yield pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(ids[to]), pa.array(score)], names=["id", "neighbour", "score"])

            for batch in batches:
                waiting.append(batch)
                size += batch.nbytes
                if size >= block_bytes:
                    yield from compare()
                    waiting, size = [], 0
            if waiting:
                yield from compare()

        found = held.select("id", "v", "dims").mapInArrow(run, "id long, neighbour long, score double")
        found = found.withColumn("rank", best).where(F.col("rank") <= k)
        out = (out.withColumn("rank", F.lit(0)) if wave == 0 else out).unionByName(materialize(found, "wave") if waves > 1 else found)
    return out.select(F.col("id").alias(key), "rank", "neighbour", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, min(embedding) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id
), pairs AS (
  SELECT a.vec_id, b.vec_id AS neighbour, round(list_inner_product(a.e::DOUBLE[], b.e::DOUBLE[]), 6) AS score
  FROM v a JOIN v b ON a.vec_id % {every} = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
)
SELECT vec_id, rank::INT AS rank, neighbour, score
FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, neighbour) AS rank FROM pairs)
WHERE rank <= {k}
"""


def oracle(k: int = 10, every: int = 100) -> str:
    return ORACLE.format(k=k, every=every)
