"""Near-duplicate documents by SimHash, all within the radius found exactly.

A document's features are its distinct words in lower case and without
punctuation (the whole text if it has no word).  Each feature votes on 128 bits.
Its weight is 1 + floor(log2(occurrences)), so that a line repeated through a
document counts for more than a phrase that many documents share; words of at
least ``least`` bytes count ``long_weight`` times as much as shorter ones, in
every text alike.  Documents whose fingerprints differ in at most ``radius`` bits
are near duplicates; chains of them form a group, whose least (``doc_id``, hash of
the text) stays.

Equal fingerprints are first made one.  The distinct ones are cut by population
count into stripes of at most about ``stripe_rows``; each pair of stripes whose
counts lie within the radius is compared, in one task or, while pairs are few, in
several that share its work.  A row is copied to about as many tasks as there are
stripes times shares, and a task holds at most two full stripes.

Within a task no pair is missed and few are looked at: two fingerprints within the
radius agree on all bits of at least one of a few hundred masks (``covering``), so
rows are sorted by each mask in turn and only those that agree on it are compared.
Where that would cost more (few rows, or bits that hardly differ), sorted tiles are
compared whole.  A task returns each row's local group, so groups of thousands of
copies make one row a member, not one a pair.

Defined results:

* Null and empty texts (white space alone is empty) have no fingerprint and are
  in no group.  Rows with a null ``doc_id`` are in no group either.
* ``doc_id`` may be of any type that can be ordered.
* Rows alike in ``doc_id`` and text are one document; rows of one ``doc_id`` with
  different texts are documents of their own.
* Very long texts are read whole.  An empty table gives an empty result.
* A bit whose votes are tied is 0.
* Other columns are not looked at.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, free_name, give_back, materialize, ship
from .textbytes import _SPACE, buffers, hashes, lowered, mix, pieces, row_of, runs, words

TILE = 4096
SLAB = 16
CHUNK, CROWD = 1 << 15, 512
#: Costs of sorting a row by a mask, of comparing a pair that agrees on it, and of comparing a pair of tiles: they choose between ways with the same result.
ROW_NS, MET_NS, PAIR_NS = 40, 8, 1.3


def _features(raw: np.ndarray, offsets: np.ndarray, least: int, long_weight: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, weight) of the distinct features, sorted by row."""
    rows = len(offsets) - 1
    low = lowered(raw)
    start, end = words(low, offsets, "alnum")
    row = row_of(offsets, start)
    has = np.zeros(rows, bool)
    has[row] = True
    if not has.all():  # no word: the text without the white space around it
        ink = np.flatnonzero(~_SPACE[raw])
        of = row_of(offsets, ink)
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, int)
        last = np.r_[first[1:], len(of)] - 1 if len(of) else first
        pick = ~has[of[first]]
        start = np.r_[start, ink[first][pick]]
        end = np.r_[end, ink[last][pick] + 1]
        row = np.r_[row, of[first][pick]]
        order = np.argsort(start, kind="stable")
        start, end, row = start[order], end[order], row[order]
    h = hashes(low, start, end)
    order = np.lexsort((h, row))
    row, h, long = row[order], h[order], (end - start >= least)[order]
    new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, int)
    times = np.diff(np.r_[new, len(h)])
    weight = np.frexp(times)[1] * np.where(long[new], long_weight, 1)  # 1 + floor(log2)
    return row[new], h[new], weight.astype(np.int32)


def fingerprints_of(raw: np.ndarray, offsets: np.ndarray, least: int = 5, long_weight: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(n, 2) words of fingerprint and the number of features, of each row."""
    rows = len(offsets) - 1
    out, count = np.zeros((rows, 2), np.uint64), np.zeros(rows, np.int64)
    row, h, weight = _features(raw, offsets, least, long_weight)
    if len(h) == 0:
        return out, count
    begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    count[row[begin]] = np.diff(np.r_[begin, len(h)])
    most = np.add.reduceat(weight, begin)
    both = np.stack([h, mix(h ^ np.uint64(0xD6E8FEB86659FD93))], 1)
    step = 1 << 16
    votes = np.zeros((len(begin), 128), np.int32)
    narrow = weight.astype(np.uint8 if weight.max() < 256 else np.uint16)[:, None]
    for at in range(0, len(h), step):
        end = min(len(h), at + step)
        a = int(np.searchsorted(begin, at, "right")) - 1
        b = int(np.searchsorted(begin, end, "left"))
        bits = np.unpackbits(both[at:end].view(np.uint8).reshape(-1, 16), axis=1) * narrow[at:end]
        votes[a:b] += np.add.reduceat(bits, np.maximum(begin[a:b] - at, 0), axis=0, dtype=np.int32)
    out[row[begin]] = np.packbits(votes * 2 > most[:, None], axis=1).view(np.uint64)
    return out, count


def fingerprints(docs: DataFrame, least: int = 5, long_weight: int = 4) -> DataFrame:
    """(doc_id, own, f0, f1) of each document with an id and a text; ``own`` is a hash of the text."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            raw, offsets = buffers(batch["text"])
            for a, b in pieces(offsets):
                f, n = fingerprints_of(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], least, long_weight)
                keep = np.flatnonzero(n > 0)
                f, rows = f.view(np.int64)[keep], pa.array(keep)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(a, b - a).take(rows), batch["own"].slice(a, b - a).take(rows), pa.array(f[:, 0]), pa.array(f[:, 1])],
                    names=["doc_id", "own", "f0", "f1"],
                )
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("own"), "text")
    got = got.mapInArrow(run, f"doc_id {kind}, own long, f0 long, f1 long")
    return got.groupBy("doc_id", "own").agg(F.first("f0").alias("f0"), F.first("f1").alias("f1"))


def _within(a: np.ndarray, b: np.ndarray, radius: int, bits: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and b whose words differ in at most ``radius`` bits; the last three are scratch that stays in the cache."""
    b0, b1 = np.ascontiguousarray(b[:, 0]), np.ascontiguousarray(b[:, 1])
    found = []
    for k in range(0, len(a), SLAB):
        rows = a[k : k + SLAB]
        x, c, d = (m[: len(rows), : len(b)] for m in (bits, one, two))
        np.bitwise_xor(rows[:, :1], b0, out=x)
        np.bitwise_count(x, out=c)
        np.bitwise_xor(rows[:, 1:], b1, out=x)
        np.bitwise_count(x, out=d)
        np.add(c, d, out=c)
        hit = c <= radius
        if hit.any():
            i, j = np.nonzero(hit)
            found.append((i + k, j))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


@functools.cache
def covering(radius: int, blocks: int) -> list[list[int]]:
    """Bits of each mask; two fingerprints within the radius agree on all bits of at least one mask.

    The bits are cut into blocks, whose radii are such that a pair within the whole
    radius is within its own in at least one block.  There each bit gets a vector of
    one dimension more than the block's radius.  The bits that differ leave a vector
    at right angles to all of theirs, and its mask holds none of them.
    """
    out: list[list[int]] = []
    rng = np.random.default_rng(blocks)
    for k in range(blocks):
        bits = np.arange(128 * k // blocks, 128 * (k + 1) // blocks)
        near = radius_of(radius, blocks, k)
        if near < 0:
            continue
        all_v = np.arange(1, 2 << near)
        vectors = 1 + rng.permutation(np.arange(len(bits)) % len(all_v))
        at = lambda x: np.bitwise_count(all_v[:, None] & x) % 2 == 1
        weight = at(vectors).sum(1)
        for n in range(20 * len(bits) if near else 0):  # any vectors do; masks of like size leave the fewest pairs
            t, other = n % len(bits), rng.integers(1, len(all_v) + 1)
            tried = weight - at(vectors[t])[:, 0] + at(other)[:, 0]
            if np.exp2(-tried).sum() < np.exp2(-weight).sum():
                vectors[t], weight = other, tried
        out += [bits[m].tolist() for m in at(vectors)]
    return out


def radius_of(radius: int, blocks: int, k: int) -> int:
    """Radius of a block: with one bit more in each block, the whole is further apart than ``radius``."""
    each, more = divmod(radius - blocks + 1, blocks)
    return each + (k < more)


def _keys(columns: np.ndarray, mask: list[int]) -> np.ndarray:
    """The mask's bits of each fingerprint, the first sixteen where it has more, as a number."""
    key = np.zeros(columns.shape[1], np.uint16)
    value = np.arange(256)
    for byte in sorted({t // 8 for t in mask[:16]}):
        table = np.zeros(256, np.uint16)
        for n, t in enumerate(mask[:16]):
            if t // 8 == byte:
                table |= ((value >> t % 8 & 1) << n).astype(np.uint16)
        key |= table[columns[byte]]
    return key


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a[:, 0] ^ b[:, 0]) + np.bitwise_count(a[:, 1] ^ b[:, 1])


def _masks(f: np.ndarray, columns: np.ndarray, pairs: int, radius: int) -> list[list[int]] | None:
    """The masks that cost least here, or None where comparing all ``pairs`` costs less; the same for the same rows."""
    best, least = None, pairs * PAIR_NS
    for blocks in (4, 5):
        many = sum((2 << radius_of(radius, blocks, k)) - 1 for k in range(blocks) if radius_of(radius, blocks, k) >= 0)
        if many * len(f) * ROW_NS >= least:
            continue
        masks = covering(radius, blocks)
        tries = masks[:: max(1, len(masks) // 4)]
        met = 0.0
        for mask in tries:
            key = _keys(columns, mask)
            order = np.argsort(key, kind="stable")
            key, g = key[order], f[order]
            size = np.bincount(key, minlength=1 << 16).astype(float)
            linked = np.bincount(key[1:][(key[1:] == key[:-1]) & (_apart(g[1:], g[:-1]) <= radius)], minlength=1 << 16)
            met += (size * np.maximum(size - 1 - linked, 0) / 2).sum()  # rows of one group are not compared again
        cost = many * (len(f) * ROW_NS + met / len(tries) * MET_NS)
        if cost < least:
            best, least = masks, cost
    return best


def _join(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The root of each row after linking rows i with rows j, from the roots before."""
    x, y = parent[i], parent[j]
    apart = x != y
    if not apart.any():
        return parent
    roots, at = np.unique(np.r_[x[apart], y[apart]], return_inverse=True)
    i, j = at[: len(at) // 2], at[len(at) // 2 :]
    up = np.arange(len(roots))
    while len(i):
        while not np.array_equal(up, top := up[up]):
            up = top
        x, y = up[i], up[j]
        apart = x != y
        i, j, x, y = i[apart], j[apart], x[apart], y[apart]
        if len(i):  # each root goes under the least root that it meets
            np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
    to = np.arange(len(parent))
    to[roots] = roots[up]
    return to[parent]


def _next_to(s: tuple[np.ndarray, np.ndarray], near: int, radius: int):
    """Yields rows i < j <= i + near of the words ``s`` that differ in at most ``radius`` bits."""
    n, step = len(s[0]), max(256, SLAB * TILE // 2 // near)
    room = np.empty((near, step), np.uint64), np.empty((near, step), np.uint8), np.empty((near, step), np.uint8)
    wide = [np.lib.stride_tricks.sliding_window_view(np.r_[x, np.zeros(near, np.uint64)], near + 1).T[1:] for x in s]
    for k in range(0, n, step):
        end = min(n, k + step)
        x, c, d = (m[:, : end - k] for m in room)
        np.bitwise_xor(wide[0][:, k:end], s[0][k:end], out=x)
        np.bitwise_count(x, out=c)
        np.bitwise_xor(wide[1][:, k:end], s[1][k:end], out=x)
        np.bitwise_count(x, out=d)
        np.add(c, d, out=c)
        hit = np.flatnonzero(c <= radius)
        if len(hit):
            by, i = np.divmod(hit, end - k)
            i += k
            j = i + by + 1
            yield i[j < n], j[j < n]


def _far(words: tuple[np.ndarray, np.ndarray], rows: np.ndarray, first: np.ndarray, end: np.ndarray, radius: int):
    """Yields those of ``rows`` k and j with first[k] <= j < end[k] that differ in at most ``radius`` bits."""
    f0, f1 = (w[rows] for w in words)
    some = np.flatnonzero(end > first)
    many = end[some] - first[some]
    ends = np.cumsum(many)
    shift = first[some] - (ends - many)
    at = 0
    while at < len(some):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + CHUNK, "right")))
        n = many[at:to]
        j = np.arange(base, ends[to - 1])
        j += np.repeat(shift[at:to], n)
        apart = np.bitwise_count(np.repeat(f0[some[at:to]], n) ^ f0[j])
        apart += np.bitwise_count(np.repeat(f1[some[at:to]], n) ^ f1[j])
        hit = np.flatnonzero(apart <= radius)
        if len(hit):
            yield rows[np.repeat(some[at:to], n)[hit]], rows[j[hit]]
        at = to


def _link(parent: np.ndarray, found) -> np.ndarray:
    """The roots after all links that ``found`` yields; those within a group are dropped at once."""
    held, many = [], 0
    for i, j in found:
        new = parent[i] != parent[j]
        if new.any():
            held.append((i[new], j[new]))
            many += len(held[-1][0])
        if many > len(parent) // 4 + CHUNK:
            parent, held, many = _join(parent, *map(np.concatenate, zip(*held))), [], 0
    return _join(parent, *map(np.concatenate, zip(*held))) if held else parent


def _by_masks(f: np.ndarray, columns: np.ndarray, masks: list[list[int]], radius: int, parent: np.ndarray) -> np.ndarray:
    """The roots after comparing rows that agree on a mask, neighbours in sorted order first.

    Places of many rows are then sorted by group and compared only between groups.
    """
    words = np.ascontiguousarray(f[:, 0]), np.ascontiguousarray(f[:, 1])
    ends = lambda new: np.repeat(at := np.r_[np.flatnonzero(new) + 1, len(new) + 1], np.diff(np.r_[0, at]))
    for mask in masks:
        key = _keys(columns, mask)
        order = np.argsort(key, kind="stable")
        size = np.bincount(key, minlength=1 << 16)
        near = 1
        while near < 64 and np.maximum(size - near - 1, 0).sum() * 4 > len(f):
            near += 1
        near_by = _next_to((words[0][order], words[1][order]), near, radius)
        parent = _link(parent, ((order[i], order[j]) for i, j in near_by))
        rows = order[np.repeat((size > near + 1) & (size <= CROWD), size)]
        if len(rows):
            place = key[rows]
            parent = _link(parent, _far(words, rows, np.arange(len(rows)) + near + 1, ends(place[1:] != place[:-1]), radius))
        rows = order[np.repeat(size > CROWD, size)]
        if len(rows):
            rows = rows[np.lexsort((parent[rows], key[rows]))]
            place, root = key[rows], parent[rows]
            other = place[1:] != place[:-1]
            parent = _link(parent, _far(words, rows, ends(other | (root[1:] != root[:-1])), ends(other), radius))
    return parent


def components(node: np.ndarray, f: np.ndarray, side: np.ndarray | None, radius: int, share: tuple[int, int] = (0, 1)) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its group) of the rows that are in a group.

    Finds all pairs, or with ``side`` those of side 0 with side 1 and maybe others.
    ``share`` (k, n) looks at part k of n; over the same rows the parts together find all.
    """
    pc = np.bitwise_count(f).sum(1).astype(np.int64)
    order = np.lexsort((node, pc))
    node, f, pc = node[order], np.ascontiguousarray(f[order]), pc[order]
    groups = [np.arange(len(node))] * 2 if side is None else [np.flatnonzero(side[order] == s) for s in (0, 1)]
    parent = np.arange(len(node))
    columns = np.ascontiguousarray(f.view(np.uint8).reshape(-1, 16).T)
    masks = _masks(f, columns, len(groups[0]) * len(groups[1]) // (2 if side is None else 1), radius)
    if masks is not None:
        parent = _by_masks(f, columns, masks[share[0] :: share[1]], radius, parent)
    else:
        parent = _by_tiles(f, pc, groups, side is None, radius, share, parent)
    while not np.array_equal(parent, up := parent[parent]):
        parent = up
    least = node.copy()
    np.minimum.at(least, parent, node)
    moved = np.zeros(len(node), bool)
    moved[parent[parent != np.arange(len(node))]] = True
    return node, np.where(moved[parent], least[parent], node)


def _by_tiles(f: np.ndarray, pc: np.ndarray, groups: list[np.ndarray], own: bool, radius: int, share: tuple[int, int], parent: np.ndarray) -> np.ndarray:
    """The groups after comparing every row of the first group with every row of the second (itself, if ``own``)."""
    room = np.empty((SLAB, TILE), np.uint64), np.empty((SLAB, TILE), np.uint8), np.empty((SLAB, TILE), np.uint8)
    cuts = [[x[k : k + TILE] for k in range(0, len(x), TILE)] for x in groups]
    turn = 0
    for ka, a in enumerate(cuts[0]):
        for kb, b in enumerate(cuts[1]):
            if own and kb < ka:
                continue
            if pc[b[0]] - pc[a[-1]] > radius or pc[a[0]] - pc[b[-1]] > radius:
                continue
            turn += 1
            if turn % share[1] != share[0]:
                continue
            i, j = _within(f[a], f[b], radius, *room)
            i, j = a[i], b[j]
            if own:
                i, j = i[i < j], j[i < j]
            parent = _join(parent, i, j)
    return parent


def _stripes(distinct: DataFrame, stripes: int, stripe_rows: int, small: int) -> tuple[list[int], list[int], dict[int, tuple[int, int]], int]:
    """Least and greatest population count of each stripe; count -> (first stripe, stripes); rows."""
    histogram = sorted((r["pc"], r["n"]) for r in distinct.groupBy("pc").agg(F.count("*").alias("n")).collect())  # at most 129 rows
    total = sum(n for _, n in histogram)
    size = max(small, min(stripe_rows, -(-total // stripes)))
    lo: list[int] = []
    hi: list[int] = []
    place: dict[int, tuple[int, int]] = {}
    room = 0
    for pc, n in histogram:
        if n > size * 3 // 2:
            parts = -(-n // size)
            place[pc] = (len(lo), parts)
            lo += [pc] * parts
            hi += [pc] * parts
            room = 0
        else:
            if room < n // 2 + 1:
                lo.append(pc)
                hi.append(pc)
                room = size
            place[pc] = (len(lo) - 1, 1)
            hi[-1] = pc
            room -= n
    return lo, hi, place, total


def near_pairs(distinct: DataFrame, radius: int, stripes: int = 1, stripe_rows: int = 1 << 20, small: int = 8192) -> DataFrame:
    """(a, b): each of ``distinct(node, f0, f1, pc)`` and the least node of its local group, b < a, for every task."""
    spark = distinct.sparkSession
    lo, hi, place, total = _stripes(distinct, stripes, stripe_rows, small)
    if not lo:
        return spark.createDataFrame([], "a long, b long")
    many = len(lo)
    shares = max(1, min(64, total // small, -(-4 * spark.sparkContext.defaultParallelism // (many * (many + 1)))))
    first = F.create_map(*[F.lit(x) for pc, (at, _) in place.items() for x in (pc, at)])
    parts = F.create_map(*[F.lit(x) for pc, (_, n) in place.items() for x in (pc, n)])
    low, high = (F.array(*map(F.lit, x)) for x in (lo, hi))
    own = distinct.withColumn("stripe", (first[F.col("pc")] + F.pmod(F.xxhash64("f0", "f1"), parts[F.col("pc")])).cast("int"))
    both = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(many - 1))))
    gap = F.greatest(low[F.col("other")] - high[F.col("stripe")], low[F.col("stripe")] - high[F.col("other")])
    one, two = F.least("stripe", "other"), F.greatest("stripe", "other")
    pair = (one * many - F.expr("shiftright(least(stripe, other) * (least(stripe, other) - 1), 1)") + two - one).cast("int")
    side = F.when(F.col("stripe") == F.col("other"), 2).otherwise((F.col("stripe") > F.col("other")).cast("int"))
    sent = both.where(gap <= radius).select(pair.alias("pair"), side.alias("side"), "node", "f0", "f1")
    sent = sent.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    sent = sent.select((F.col("pair") * shares + F.col("share")).cast("int").alias("task"), "side", "node", "f0", "f1")

    def compare(batches):
        got: list[list[np.ndarray]] = [[] for _ in range(5)]
        for batch in batches:
            for held, column in zip(got, batch.columns):
                held.append(np.array(column))
        if got[0]:
            task, side, node, f0, f1 = map(np.concatenate, got)
            got.clear()
            f = np.stack([f0, f1], 1).view(np.uint64)
            del f0, f1
            node, least = components(node, f, None if side[0] == 2 else side, radius, (int(task[0]) % shares, shares))
            at = np.flatnonzero(least != node)
            for k in range(0, len(at), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[at[k : k + (1 << 16)]]) for x in (node, least)], names=["a", "b"])
        give_back()

    # one task for each pair of stripes and share: keys would be hashed, several to one task and none to others
    return sent.repartitionById(many * (many + 1) // 2 * shares, F.col("task")).mapInArrow(compare, "a long, b long")


def connect(edges: DataFrame) -> DataFrame:
    """(node, least): the least node that each node of the edges (a, b) is connected with.

    Every round passes the least label over the edges and then jumps to the
    label's own label, so a chain of n nodes takes about log n rounds.
    """
    both = materialize(edges.union(edges.select("b", "a")).distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("least")), "labels")
    while True:
        met = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("least").alias("met"))
        own = labels.join(met, labels["node"] == met["a"]).select("node", "least", F.least("least", "met").alias("lower"))
        root = labels.select(F.col("node").alias("at"), F.col("least").alias("jump"))
        step = own.join(root, F.col("lower") == F.col("at"), "left").select("node", F.least("lower", "jump").alias("least"), (F.col("least") != F.least("lower", "jump")).alias("moved"))
        step = materialize(step, "labels")
        discard(labels)
        labels = step
        if not labels.where("moved").head(1):
            discard(both)
            return labels.select("node", "least")


def _later(docs: DataFrame, radius: int = 24, least: int = 5, long_weight: int = 4, stripes: int = 1, stripe_rows: int = 1 << 20) -> DataFrame:
    """(doc_id, own, duplicate_of, group_size) of each member of a group but the one that stays."""
    prints = materialize(fingerprints(docs, least, long_weight), "prints")
    distinct = prints.select("f0", "f1").distinct().withColumn("node", F.monotonically_increasing_id())
    distinct = materialize(distinct.withColumn("pc", (F.bit_count("f0") + F.bit_count("f1")).cast("int")), "distinct")
    pairs = materialize(near_pairs(distinct, radius, stripes, stripe_rows), "pairs")
    held = prints.join(distinct.select("f0", "f1", "node"), ["f0", "f1"]).select("doc_id", "own", "node")
    if pairs.head(1):
        roots = connect(pairs).withColumnRenamed("node", "at")
        held = held.join(roots, held["node"] == roots["at"], "left").select("doc_id", "own", F.coalesce("least", "node").alias("node"))
    held = materialize(held, "members")
    # aggregates combine within the tasks, so no task holds all members of a large group
    groups = held.groupBy("node").agg(F.count("*").alias("group_size"), F.min(F.struct("doc_id", "own")).alias("keeper")).where("group_size > 1")
    later = held.join(groups, "node").where("NOT (doc_id = keeper.doc_id AND own = keeper.own)")
    return later.select("doc_id", "own", F.col("keeper.doc_id").alias("duplicate_of"), "group_size")


def near_duplicates(docs: DataFrame, **params) -> DataFrame:
    """(doc_id, duplicate_of, group_size): each document that has a near duplicate of lesser id in its group.

    ``duplicate_of`` is the group's least id, the document that stays (another
    text under the same id, where that is the one that stays).
    """
    return _later(docs, **params).select("doc_id", "duplicate_of", "group_size")


def keep_one_of_each(docs: DataFrame, **params) -> DataFrame:
    """``docs`` without the near duplicates of a kept document, all columns as they are.

    Of rows alike in ``doc_id`` and text one stays, that of the least hash of all
    its columns; rows with a null id all stay, and so do other texts of an id that
    are no near duplicate themselves.
    """
    own, rank, id, text = (free_name(docs, x) for x in ("_own", "_rank", "_gone_id", "_gone_text"))
    gone = materialize(_later(docs, **params).select(F.col("doc_id").alias(id), F.col("own").alias(text)), "gone")
    every = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    nth = F.row_number().over(Window.partitionBy("doc_id", own).orderBy(F.xxhash64(*every)))
    one = docs.where("doc_id IS NOT NULL").withColumn(own, F.xxhash64("text")).withColumn(rank, nth).where(F.col(rank) == 1)
    same = (F.col("doc_id") == F.col(id)) & (F.col(own) == F.col(text))
    kept = one.hint("merge").join(gone.hint("merge"), same, "left_anti").select(*docs.columns)
    return kept.union(docs.where("doc_id IS NULL"))
