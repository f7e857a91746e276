"""Best-fit packing of tokenised documents into sequences of several permitted lengths.

Lengths are counted in tokens: every text becomes ids of a SentencePiece
vocabulary (its best segmentation), and the packed rows hold the ids.  A document
longer than the greatest permitted length is cut, between tokens, into pieces of
that length and a rest; nothing is dropped, and a document's pieces in order give
its ids again.

Pieces are packed in order of falling length.  Each goes into the open bin with
the least room that suffices (of equal room, the least bin).  Where none does, a
bin is opened.  Its size is the permitted length at which the bin, if filled with
the largest pieces still to come, costs least per token: ``cost`` gives the price
of a sequence, by default ``sequence_cost``.  The choice is made anew for every
bin; of the bins that a piece length opens, none counts on pieces that an earlier
one's choice counted on.  Finally each bin takes the least permitted length that
holds its contents.

Where pieces go depends on the number of pieces of each length alone, so the plan
is made on that histogram.  Pieces are spread evenly over groups of about
``group_chars`` bytes of text, whatever their documents' ids, and each group is
packed by its own histogram in one task: ids are shuffled once, a task's memory is
bounded, and what groups lose against one histogram of the whole is the unfilled
rest of a few bins in thousands.

Defined results:

* Null and empty texts have no token and are in no bin; an empty table has no bin.
* Very long texts are cut as above, their pieces spread over the groups.
* Rows with equal or null ``doc_id`` are packed each for itself; ids may be of any
  type that can be ordered.
* Pieces of equal length are ranked by ``doc_id`` (nulls last), place, then ids;
  identical rows may change places, which changes nothing.
* Other columns are not looked at.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sentencepieces import MODEL, Encoded, _read_model, forget, load
from .shared import give_back, ship
from .textbytes import buffers, mix, pieces

CAPACITIES = (256, 512, 1024, 2048, 4096)


def linear_cost(overhead: int = 64) -> Callable[[int], float]:
    return lambda capacity: capacity + overhead


def sequence_cost(overhead: int = 64, attention: int = 16384) -> Callable[[int], float]:
    """A price per sequence, per word, and per pair of words that attend to each other."""
    return lambda capacity: overhead + capacity + capacity * capacity / attention


def _fill(size: int, count: int, room: int, smaller: list[int], counts: dict[int, int]) -> tuple[int, list[tuple[int, int, bool]]]:
    """Room left in a bin, and the (length, pieces, whether more would fit) that fill it: its own length, then the largest left."""
    k = min(count, room // size)
    taken = [(size, k, k < room // size)]
    room -= k * size
    end = len(smaller)
    while room > 0 and (end := bisect.bisect_right(smaller, room, 0, end)) > 0:
        s = smaller[end - 1]
        k = min(counts[s], room // s)
        taken.append((s, k, k < room // s))
        room -= k * s
        end -= 1
    return room, taken


def _choose(size: int, count: int, smaller: list[int], counts: dict[int, int], capacities: Sequence[int], cost):
    """The capacity of least cost per word (the least of equals), what fills it, and what fills each capacity."""
    best, least, fills = None, None, []
    for c in sorted(x for x in capacities if x >= size):
        room, taken = _fill(size, count, c, smaller, counts)
        fills.append(taken)
        price = cost(c) / (c - room)
        if least is None or price < least:
            best, least = (c, taken), price
    return *best, fills


def best_capacity(size: int, count: int, smaller: list[int], counts: dict[int, int], capacities: Sequence[int], cost) -> int:
    """The capacity of least cost per word, filled with the largest pieces that are left; the least of equals."""
    return _choose(size, count, smaller, counts, capacities, cost)[0]


def _alike(left: dict[int, int], taken: list[tuple[int, int, bool]], fills: list[list[tuple[int, int, bool]]]) -> int:
    """How many bins in a row see the same fill at every capacity, if each uses up ``taken``; 1 at least."""
    need: dict[int, int] = {}
    for fill in fills:
        for s, k, short in fill:
            need[s] = max(need.get(s, 0), left[s] + 1 if short else k)
    return max(1, min(1 + (left[s] - need[s]) // k for s, k, _ in taken))


def plan(counts: dict[int, int], capacities: Sequence[int] = CAPACITIES, cost=None) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first bin, pieces a bin) of runs of pieces that go to consecutive bins."""
    cost = cost or sequence_cost()
    lengths = sorted(x for x, n in counts.items() if n)
    open_bins: dict[int, list[tuple[int, int]]] = {}  # room -> heap of (first bin, bins)
    rooms: list[int] = []
    out, bins = [], 0

    def leave(room: int, first: int, n: int) -> None:
        if room > 0 and n > 0:
            if not open_bins.get(room):
                bisect.insort(rooms, room)
                open_bins[room] = []
            heapq.heappush(open_bins[room], (first, n))

    for at in range(len(lengths) - 1, -1, -1):
        size, rank = lengths[at], 0
        end = counts[size]
        left: dict[int, int] = {}  # what no bin of this length counts on yet
        while rank < end:
            k = bisect.bisect_left(rooms, size)
            if k < len(rooms):
                room = rooms[k]
                first, n = heapq.heappop(open_bins[room])
                if not open_bins[room]:
                    rooms.pop(k)
            else:
                if not left:
                    smaller = lengths[:at]
                    left = {x: counts[x] for x in smaller}
                left[size] = end - rank
                room, taken, fills = _choose(size, end - rank, smaller, left, capacities, cost)
                first, n = bins, _alike(left, taken, fills)
                for x, k, _ in taken[1:]:
                    left[x] -= n * k
                    if not left[x]:
                        smaller.pop(bisect.bisect_left(smaller, x))
                bins += n
            per = room // size
            full = min(n, (end - rank) // per)
            if full:
                out.append((size, rank, rank + full * per, first, per))
                rank += full * per
                leave(room - per * size, first, full)
            if full < n and rank < end:
                rest = end - rank
                out.append((size, rank, end, first + full, rest))
                rank = end
                leave(room - rest * size, first + full, 1)
                full += 1
            leave(room, first + full, n - full)
    return out


def tokenized_pieces(docs: DataFrame, most: int, groups: int, model: str | bytes = MODEL, keep_words: bool = True, piece_bytes: int = 1 << 21) -> DataFrame:
    """(pack, doc_id, part, start, length, ids): each row's tokens in pieces of at most ``most``, as raw numbers, and the group of each.

    With ``keep_words`` a worker keeps solved words for its later tasks, which
    saves time and takes about 100 MB in each worker; the result is the same.
    """
    ship(docs.sparkSession)
    proto = docs.sparkSession.sparkContext.broadcast(_read_model(model))  # a vocabulary, not corpus data
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        memory = load(proto.value)
        number = _number(memory)
        for batch in batches:
            raw, offsets = buffers(batch["text"])
            spread = batch["spread"].to_numpy().view(np.uint64)
            for a, b in pieces(offsets, piece_bytes):
                got = Encoded(memory, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                total = np.diff(got.rows)
                parts = -(-total // most)
                row = np.repeat(np.arange(b - a), parts)
                part = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                start = part * most
                length = np.minimum(most, total[row] - start)
                with np.errstate(over="ignore"):
                    to = mix(spread[a + row] + part.astype(np.uint64)) % np.uint64(groups)
                at = np.r_[0, np.cumsum(length)] * number.itemsize  # all pieces in turn are all tokens in turn
                ids = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(got.ids.astype(number).tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to.astype(np.int32)), batch["doc_id"].take(pa.array(a + row)), pa.array(part.astype(np.int32)), pa.array(start), pa.array(length.astype(np.int32)), ids],
                    names=["pack", "doc_id", "part", "start", "length", "ids"],
                )
                del got, ids
            del raw, offsets
        if not keep_words:
            forget()
        give_back()

    rows = docs.where("text <> ''").select("doc_id", "text", F.xxhash64(F.monotonically_increasing_id()).alias("spread"))
    return rows.mapInArrow(run, f"pack int, doc_id {kind}, part int, start long, length int, ids binary")


def _number(memory) -> np.dtype:
    return np.dtype("<u2" if len(memory.vocabulary.texts) <= 1 << 16 else "<u4")


def _lists(values: pa.Array, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)


def pack_group(table: pa.Table, group: int, capacities: Sequence[int], cost, number: np.dtype) -> pa.Table:
    """The bins of one group of pieces."""
    table = table.combine_chunks()
    order = pa.compute.sort_indices(table, sort_keys=[("length", "descending"), ("doc_id", "ascending"), ("part", "ascending"), ("ids", "ascending")])
    length = table["length"].to_numpy()[order.to_numpy()]
    sizes, first, counts = np.unique(-length, return_index=True, return_counts=True)
    base = dict(zip((-sizes).tolist(), first.tolist()))
    to = np.empty(len(length), np.int64)
    for size, a, b, first_bin, per in plan(dict(zip((-sizes).tolist(), counts.tolist())), capacities, cost):
        to[base[size] + a : base[size] + b] = first_bin + np.arange(b - a) // per
    by_bin = np.argsort(to, kind="stable")  # within a bin the lengths fall
    to, length, held = to[by_bin], length[by_bin], table.take(order.take(pa.array(by_bin)))
    begin = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.zeros(0, np.int64)
    ends = np.r_[begin, len(to)]
    used = np.add.reduceat(length, begin) if len(to) else length
    permitted = np.array(sorted(capacities))
    column = lambda name: held[name].combine_chunks()
    ids = np.frombuffer(b"".join(x.as_buffer() for x in column("ids")), number).astype(np.int32)
    doc_id = column("doc_id")
    each = pa.StructArray.from_arrays([doc_id, column("part"), column("start"), column("length")], names=["doc_id", "part", "start", "length"])
    got = pa.table({
        "bin_id": pa.array((np.int64(group) << 32) + to[begin]), "capacity": pa.array(permitted[np.searchsorted(permitted, used)].astype(np.int32)),
        "used": pa.array(used.astype(np.int32)), "n_pieces": pa.array(np.diff(ends).astype(np.int32)),
        "doc_ids": _lists(doc_id, ends), "pieces": _lists(each, ends), "ids": _lists(pa.array(ids), np.r_[0, np.cumsum(used)]),
    })
    return pa.Table.from_batches(got.to_batches(max_chunksize=64), got.schema)


def pack(docs: DataFrame, capacities: Sequence[int] = CAPACITIES, cost=None, model: str | bytes = MODEL, group_chars: int = 1 << 23, keep_words: bool = True) -> DataFrame:
    """(bin_id, capacity, used, n_pieces, doc_ids, pieces, ids): one row for each sequence.

    ``pieces`` is a list of (doc_id, part, start, length) with ``start`` in tokens;
    ``doc_ids`` has their documents and ``ids`` their tokens, in the same order.
    ``bin_id`` has the group in its upper half.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-total // group_chars))
    number = _number(load(_read_model(model)))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def fill(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        forget()  # all texts are encoded by now; the group needs the room
        got = pack_group(table, key[0].as_py(), capacities, cost, number)
        del table
        give_back()
        return got

    schema = f"bin_id long, capacity int, used int, n_pieces int, doc_ids array<{kind}>, pieces array<struct<doc_id: {kind}, part: int, start: long, length: int>>, ids array<int>"
    return tokenized_pieces(docs, max(capacities), groups, model, keep_words).groupBy("pack").applyInArrow(fill, schema)
