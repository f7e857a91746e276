"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard has ``vnodes`` points on a ring of 2**60 places.  A key belongs to
the first point at or after its own place (its arc).  No shard takes more than
ceil((1 + slack) * keys / shards) keys: a key whose shard is full goes on
clockwise to the first point of a shard with room.

Keys are placed in ring order, from place 0 on.  This order makes the outcome a
function of the numbers of keys on the arcs, ``shards * vnodes`` numbers however
many keys there are: the driver walks over the arcs and finds which arcs are
split between shards, and by how many keys.  Only the keys of split arcs (a shard
that fills splits one arc at most) are ranked to find the place of each cut; the
assignment of rows is then a look-up in a table of place ranges, without a
shuffle of the rows.

Loads are balanced by construction.  When a shard is added or removed, the other
points stay where they are, so only keys of changed arcs and of the overflow
behind them move.

Defined results:

* The load counts distinct keys; all rows of a key go to one shard together.
* A null key has no place: ``shard`` null, and it counts nowhere.
* Points at the same place: the least (shard, point) comes first and takes the
  arc.  Keys at the same place (2**-60) stay together and may exceed the bound.
* An empty table gives no row.  Other columns are not looked at.
"""

from __future__ import annotations

import bisect
import hashlib
import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

RING = 1 << 60
CELLS = 1 << 14


def place_of(key: str) -> int:
    """The place of a key on the ring: the first 15 digits of its MD5."""
    return int(hashlib.md5(key.encode()).hexdigest()[:15], 16)


def place(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 15), 16, 10).cast("long")


def points(shards: Iterable[int], vnodes: int) -> list[tuple[int, int]]:
    """(place, shard) of all points, in ring order."""
    return sorted((place_of(f"shard-{s}-{v}"), s) for s in shards for v in range(vnodes))


def walk(ring: list[tuple[int, int]], counts: list[int], bound: int) -> list[list[tuple[int, int]]]:
    """For each arc its (shard, keys) in the order in which its keys are placed.

    ``counts[i]`` keys lie after point i - 1 and up to point i; those after the
    last point belong to arc 0 but come last in ring order, as counts[len(ring)].
    """
    left: dict[int, int] = {s: bound for _, s in ring}
    out = []
    # the next point of a shard with room, with paths made short
    following = list(range(len(ring)))

    def open_point(i: int) -> int:
        chain = []
        while left[ring[i][1]] == 0:
            chain.append(i)
            i = following[i] if following[i] != i else (i + 1) % len(ring)
        for c in chain:
            following[c] = i
        return i

    for arc, n in enumerate(counts):
        own: list[tuple[int, int]] = []
        at = arc % len(ring)
        while n:
            at = open_point(at)
            s = ring[at][1]
            take = min(n, left[s])
            left[s] -= take
            n -= take
            own.append((s, take))
        out.append(own)
    return out


def _ranges(ring: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(first place, last place, arc) of the arcs in ring order; the part after the last point is one of its own."""
    out, at = [], 0
    for k, (p, _) in enumerate(ring):
        if p >= at:
            out.append((at, p, k))
            at = p + 1
    if at < RING:
        out.append((at, RING - 1, len(ring)))
    return out


def _cells(spark, ranges: list[tuple], schema: str) -> DataFrame:
    """The ranges cut at the bounds of equal cells of the ring, for an equi-join on the cell."""
    wide = RING // CELLS
    rows = []
    for lo, hi, *rest in ranges:
        for c in range(lo // wide, hi // wide + 1):
            rows.append((c, max(lo, c * wide), min(hi, (c + 1) * wide - 1), *rest))
    return spark.createDataFrame(rows, "cell int, lo long, hi long, " + schema)


def _cell() -> Column:
    return F.shiftright("place", 46).cast("int")  # 60 - 14 bits


def assign(docs: DataFrame, key: str = "doc_id", shards: int = 64, vnodes: int = 64, slack: float = 0.1) -> DataFrame:
    """(<key>, place, home, shard, moved_on): a row for each row; ``home`` is the shard of the key's arc."""
    spark = docs.sparkSession
    ring = points(range(shards), vnodes)
    ranges = _ranges(ring)
    keys = docs.select(F.col(key).alias("key")).where("key IS NOT NULL").distinct().select(place(F.col("key")).alias("place"))
    keys = materialize(keys, "ring-keys")
    # both look-up tables have shards * vnodes + CELLS rows, however many keys there are
    arcs = F.broadcast(_cells(spark, ranges, "arc int"))
    in_arc = keys.join(arcs, (_cell() == arcs["cell"]) & F.col("place").between(F.col("lo"), F.col("hi"))).select("place", "arc")
    counts = [0] * (len(ring) + 1)
    for r in in_arc.groupBy("arc").agg(F.count("*").alias("n")).collect():  # a row for each arc
        counts[r["arc"]] = r["n"]
    total = sum(counts)
    bound = math.ceil(total * (1 + slack) / shards)
    runs = walk(ring, counts, bound)
    wanted = []  # the rank within its arc of the last key of every run but the last
    for arc, own in enumerate(runs):
        upto = 0
        for _, n in own[:-1]:
            upto += n
            wanted.append((arc, upto))
    cut: dict[tuple[int, int], int] = {}
    if wanted:
        split = in_arc.where(F.col("arc").isin(sorted({a for a, _ in wanted})))
        nth = F.row_number().over(Window.partitionBy("arc").orderBy("place"))
        ends = F.broadcast(spark.createDataFrame(wanted, "arc int, nth int"))  # at most shards rows a turn of the ring
        cut = {(r["arc"], r["nth"]): r["place"] for r in split.withColumn("nth", nth).join(ends, ["arc", "nth"]).collect()}
    table = []
    for lo, hi, arc in ranges:
        at, upto, home = lo, 0, ring[arc % len(ring)][1]
        for s, n in runs[arc][:-1]:
            upto += n
            if (end := cut[arc, upto]) >= at:
                table.append((at, end, home, s))
                at = end + 1
        if at <= hi:
            table.append((at, hi, home, runs[arc][-1][0] if runs[arc] else home))
    found = F.broadcast(_cells(spark, table, "home int, shard int"))
    rows = docs.select(F.col(key), place(F.col(key)).alias("place"))
    joined = rows.join(found, (_cell() == found["cell"]) & F.col("place").between(F.col("lo"), F.col("hi")), "left")
    return joined.select(key, "place", "home", "shard", (F.col("home") != F.col("shard")).alias("moved_on"))


def owner(ring_places: list[int], at: int) -> int:
    """The point that owns a place, for tests and single look-ups."""
    return bisect.bisect_left(ring_places, at) % len(ring_places)


ORACLE = """
WITH RECURSIVE ring AS (
  SELECT row_number() OVER (ORDER BY place, shard) - 1 AS i, place, shard FROM (
    SELECT ('0x' || md5('shard-' || s.range || '-' || v.range)[1:15])::BIGINT AS place, s.range::INT AS shard
    FROM range({shards}) s, range({vnodes}) v)
), keys AS (
  SELECT doc_id, ('0x' || md5(doc_id::VARCHAR)[1:15])::BIGINT AS place FROM documents WHERE doc_id IS NOT NULL
), held AS (
  SELECT h.place, coalesce(r.i, {points}) AS arc, row_number() OVER (PARTITION BY r.i ORDER BY h.place) AS nth
  FROM (SELECT DISTINCT place FROM keys) h ASOF LEFT JOIN ring r ON h.place <= r.place
), bound AS (
  SELECT ceil(count(*) * (1 + {slack}::DOUBLE) / {shards})::BIGINT AS most FROM held
), arcs AS (
  SELECT arc, count(*) AS n, row_number() OVER (ORDER BY arc) AS turn FROM held GROUP BY arc
), places AS (
  SELECT list(shard ORDER BY i) AS shards FROM ring
), fill AS (
  SELECT 0::BIGINT AS turn, 0::BIGINT AS arc, 0::BIGINT AS n, 0::BIGINT AS pt, 0::INT AS shard, 0::BIGINT AS upto, 0::BIGINT AS take,
         list_transform(range({shards}), lambda x: most) AS room FROM bound
  UNION ALL
  SELECT turn, arc, n, pt, shard, upto, least(n - upto, room[shard + 1]) AS take,
         list_transform(room, lambda x, j: CASE WHEN j = shard + 1 THEN x - least(n - upto, x) ELSE x END) AS room
  FROM (
    SELECT turn, arc, n, pt, upto, room, p.shards[pt + 1] AS shard FROM (
      SELECT f.turn, f.arc, f.n, (f.pt + 1) % {points} AS pt, f.upto + f.take AS upto, f.room FROM fill f WHERE f.upto + f.take < f.n
      UNION ALL
      SELECT a.turn, a.arc, a.n, a.arc % {points}, 0, f.room FROM fill f JOIN arcs a ON a.turn = f.turn + 1 WHERE f.upto + f.take = f.n
    ), places p
  )
)
SELECT k.doc_id, k.place, r.shard AS home, f.shard, r.shard <> f.shard AS moved_on
FROM keys k JOIN held h ON h.place = k.place JOIN ring r ON r.i = h.arc % {points}
JOIN fill f ON f.arc = h.arc AND f.turn > 0 AND h.nth > f.upto AND h.nth <= f.upto + f.take
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL FROM documents WHERE doc_id IS NULL
"""


def oracle(shards: int = 64, vnodes: int = 64, slack: float = 0.1) -> str:
    return ORACLE.format(shards=shards, vnodes=vnodes, slack=slack, points=shards * vnodes)
