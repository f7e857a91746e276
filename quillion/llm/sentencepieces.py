"""SentencePiece encoding and decoding, with the N best segmentations of a text.

All segmentations of a text into pieces of the vocabulary are the paths of a
lattice over its bytes.  A forward pass (Viterbi) gives each place the best score
of a path that leads to it.  These scores are exact heuristics: a search
backward from the end that always extends the partial path of greatest (score so
far + forward score of its place), A-star, meets the N best paths in order.

No piece has a space after another character, so a lattice falls into chunks of
spaces and the word behind them.  Each distinct chunk of a batch is solved once
for the best path and for the loss of its second path.  Of a text's N best paths
none needs a second path in other than the N - 1 chunks of least loss; those
chunks are searched by A-star, and A-star again combines their paths.  The
result is that of the whole lattice.

Scores are log probabilities.  The model gives them if it is a unigram model;
the scores of a BPE model are only ranks, from which Zipf's law makes
probabilities.  They are kept as whole millionths so that sums are exact.

Defined results:

* A null text has no row.  An empty text has the one segmentation without piece.
  An empty table gives an empty result; very long texts are encoded whole.
* A character that is no piece is one edge, ten nats below the least score; it
  becomes its byte pieces, or the unknown piece where the model has none.
* Texts with fewer than N segmentations give fewer rows; ``rank`` counts from 1
  without gaps.  Of paths of equal score the first is the one that ends in the
  shortest last piece, and so back to the front; the others follow in the order in
  which the search meets them, the same in every run.
* Repeated rows and equal or null ``doc_id`` are encoded one by one.
* A literal U+2581 is encoded as bytes, so decoding restores every text.
* Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import ship
from .textbytes import buffers, hashes, pieces

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NONE = -(1 << 60)
UNIT = 1_000_000
_SHORT = 40  # longer chunks are solved one by one


def _fields(data: bytes):
    """(number, value) of the fields of a protocol buffer message."""

    def varint(at):
        value = shift = 0
        while True:
            b = data[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        else:
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class Vocabulary:
    """Pieces as bytes (a space for U+2581), scores in millionths of a nat, and a trie from bytes to ids."""

    def __init__(self, texts: list[bytes], scores: np.ndarray, bytes_at: np.ndarray | None, unknown: int, prefix: bool = True):
        """``texts`` has b"" for ids that stand for no text (control pieces, bytes, the unknown piece)."""
        self.texts, self.scores = texts, scores.astype(np.int64)
        self.bytes_at, self.unknown, self.prefix = bytes_at, unknown, prefix
        self.ids = {}
        for k, t in enumerate(texts):
            if t and (t not in self.ids or self.scores[k] > self.scores[self.ids[t]]):
                self.ids[t] = k
        used = np.array(sorted(self.ids.values()), np.int64)
        self.lost = int(self.scores[used].min(initial=0)) - 10 * UNIT
        self.longest = max((len(t) for t in self.ids), default=1)
        self.cuts = not any(b" " in t.lstrip(b" ") for t in self.ids)
        # what each id writes: pieces their text, byte pieces their byte
        out = list(texts)
        if bytes_at is not None:
            for b, k in enumerate(bytes_at):
                out[k] = bytes([b])
        self.sizes = np.array([len(t) for t in out], np.int64)
        self.places = np.r_[0, np.cumsum(self.sizes)]
        self.joined = np.frombuffer(b"".join(out) or b"\0", np.uint8)
        self._index(used)

    def _index(self, used: np.ndarray) -> None:
        """A trie of the pieces in one array: the child of a node by a byte is at ``base[node] + byte`` if ``up`` there is the node."""
        kids: list[dict[int, int]] = [{}]
        ends = {}
        for k in used.tolist():
            node = 0
            for b in self.texts[k]:
                if b not in kids[node]:
                    kids[node][b] = len(kids)
                    kids.append({})
                node = kids[node][b]
            ends[node] = k + 1
        taken, free = bytearray(4 * len(kids) + 512), 1
        taken[0] = 1
        slot, base = np.zeros(len(kids), np.int64), np.zeros(len(kids), np.int64)
        for node in sorted((x for x in range(len(kids)) if kids[x]), key=lambda x: -len(kids[x])):
            low, *more = sorted(kids[node])
            at = taken.index(0, free if more else 1)  # nodes of one child fill what the others leave
            while at < low or any(taken[at - low + b] for b in more):
                at = taken.index(0, at + 1)
                if at + 512 > len(taken):
                    taken += bytearray(len(taken))
            free = at if more else free
            base[node] = at - low
            for b, child in kids[node].items():
                slot[child] = at - low + b
                taken[at - low + b] = 1
        room = int(max(slot.max(), base.max())) + 256
        self.base, self.up, self.ends = np.zeros(room, np.int32), np.full(room, -1, np.int32), np.zeros(room, np.int32)
        self.base[slot] = base
        for node, below in enumerate(kids):
            for child in below.values():
                self.up[slot[child]] = slot[node]
        for node, k in ends.items():
            self.ends[slot[node]] = k
        self.weights = np.r_[self.lost, self.scores]  # by id + 1

    def matches(self, raw: np.ndarray, left: np.ndarray):
        """Yields (places, bytes, ids + 1) of the pieces at each place of ``raw``, shorter ones first, none of over ``left`` bytes.

        A place is left as soon as no piece goes on as its text does.
        """
        at, node = np.arange(len(raw), dtype=np.int32), np.zeros(len(raw), np.int32)
        size = 0
        while len(at):
            to = self.base[node] + raw[at + size]
            on = np.flatnonzero(self.up[to] == node)
            at, node, size = at[on], to[on], size + 1
            k = self.ends[node]
            hit = np.flatnonzero(k)
            if len(hit):
                yield at[hit], size, k[hit]
            on = np.flatnonzero(left[at] > size)
            at, node = at[on], node[on]

    def spell(self, chunk: bytes) -> list[int]:
        """The ids of a lost character."""
        return [self.unknown] if self.bytes_at is None else [int(self.bytes_at[b]) for b in chunk]

    def edges(self, chunk: bytes) -> list[list[tuple[int, int, int]]]:
        """For each place the edges (start, score, id) that end there; id -1 is a lost character."""
        n = len(chunk)
        into: list[list[tuple[int, int, int]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            if chunk[i] & 0xC0 == 0x80:
                continue
            size = 1
            while i + size < n and chunk[i + size] & 0xC0 == 0x80:
                size += 1
            for j in range(i + 1, min(n, i + self.longest) + 1):
                k = self.ids.get(chunk[i:j])
                if k is not None:
                    into[j].append((i, int(self.scores[k]), k))
                elif j == i + size:
                    into[j].append((i, self.lost, -1))
        if n and chunk[0] & 0xC0 == 0x80:  # not UTF-8; does not come from a string column
            raise ValueError("a chunk begins inside a character")
        return into


def from_sentencepiece(model: bytes) -> Vocabulary:
    """The vocabulary of a SentencePiece model without normalisation rules."""
    import sentencepiece

    kind, prefix = 1, True
    for number, value in _fields(model):
        if number == 2:
            kind = dict(_fields(value)).get(3, 1)
        elif number == 3:
            spec = dict(_fields(value))
            prefix = bool(spec.get(3, 1))
            if spec.get(2):
                raise ValueError("models with normalisation rules are not supported")
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    texts, score, byte = [], np.zeros(sp.vocab_size()), {}
    for k in range(sp.vocab_size()):
        piece = sp.id_to_piece(k)
        plain = not (sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k) or sp.is_byte(k))
        texts.append(piece.replace("▁", " ").encode() if plain else b"")
        score[k] = sp.get_score(k)
        if sp.is_byte(k):
            byte[int(piece[3:5], 16)] = k
    if kind != 1:  # ranks, not log probabilities
        used = np.array([k for k, t in enumerate(texts) if t], int)
        order = used[np.argsort(-score[used], kind="stable")]
        rank = np.arange(1, len(order) + 1)
        score[order] = -np.log(rank) - math.log((1 / rank).sum())
    at = np.array([byte[b] for b in range(256)]) if len(byte) == 256 else None
    return Vocabulary(texts, np.round(score * UNIT), at, sp.unk_id(), prefix)


def forward(into: list[list[tuple[int, int, int]]]) -> list[int]:
    """The best score of a path from the start to each place."""
    best = [NONE] * len(into)
    best[0] = 0
    for j in range(1, len(into)):
        for i, s, _ in into[j]:
            if best[i] > NONE and best[i] + s > best[j]:
                best[j] = best[i] + s
    return best


def n_best(into: list[list[tuple[int, int, int]]], n: int, best: list[int] | None = None) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """The n best paths, (score, edges as (start, end, id)), by A-star from the end with the forward scores."""
    best = best or forward(into)
    end = len(into) - 1
    if best[end] <= NONE:
        return []
    out, count = [], 0
    heap: list = [(-best[end], 0, end, 0, None)]
    while heap and len(out) < n:
        _, _, at, behind, tail = heapq.heappop(heap)
        if at == 0:
            path = []
            while tail is not None:
                edge, tail = tail
                path.append(edge)
            out.append((behind, path))
            continue
        for i, s, k in into[at]:
            if best[i] > NONE:
                count += 1
                heapq.heappush(heap, (-(best[i] + s + behind), -count, i, behind + s, ((i, at, k), tail)))
    return out


class Solved:
    """Best paths of distinct chunks: ids[at[c]:at[c + 1]] of score[c]; gap[c] is the second path's loss."""

    def __init__(self, ids: np.ndarray, at: np.ndarray, score: np.ndarray, gap: np.ndarray):
        self.ids, self.at, self.score, self.gap = ids, at, score, gap


def _short(vocabulary: Vocabulary, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best paths of the short chunks raw[bounds[c]:bounds[c + 1]]: all ids in turn, their number, scores, gaps."""
    v, rows, n = vocabulary, len(bounds) - 1, len(raw)
    size = np.diff(bounds)
    chunk = np.repeat(np.arange(rows, dtype=np.int32), size)
    inside = np.arange(n, dtype=np.int32) - bounds[:-1].astype(np.int32)[chunk]
    left = size.astype(np.int32)[chunk] - inside
    lead = np.flatnonzero((raw & 0xC0) != 0x80).astype(np.int32)
    wide = np.zeros(n, np.int32)
    wide[lead] = np.diff(np.r_[lead, n])  # bytes of the character that begins here
    lost = wide > 0
    found = []
    for at, width, k in v.matches(raw, left):
        if width <= 4:
            lost[at[wide[at] == width]] = False
        found.append((at, np.full(len(at), width, np.uint8), k))
    at = np.flatnonzero(lost).astype(np.int32)
    found.append((at, wide[at].astype(np.uint8), np.zeros(len(at), np.int32)))  # a character that is no piece
    at, width, k = (np.concatenate(x) for x in zip(*found))
    del found, lost
    # edges by the place in the chunk where they end, the shorter first: all that lead to a place are there before one leaves it
    kind = ((inside[at] + width) << 6 | width).astype(np.uint16)
    order = np.argsort(kind, kind="stable")
    kind, at, k = kind[order], at[order], k[order]
    del order, width
    start = at + chunk[at]  # a chunk has a place more than it has bytes
    s = v.weights[k]
    first = bounds[:-1] + np.arange(rows)
    best, second = np.full(n + rows, NONE, np.int64), np.full(n + rows, NONE, np.int64)
    back, by = np.zeros(n + rows, np.int8), np.zeros(n + rows, np.int32)
    best[first] = 0
    cuts = np.r_[np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]]), len(kind)].tolist() if len(kind) else []
    for a, b in zip(cuts, cuts[1:]):
        width = int(kind[a]) & 63
        to = start[a:b] + width
        score, old = s[a:b] + best[start[a:b]], best[to]
        second[to] = np.maximum(second[to], np.minimum(old, score))
        better = np.flatnonzero(score > old)
        to = to[better]
        best[to], back[to], by[to] = score[better], width, k[a:b][better]
    place = first + size
    total, gap = best[place], np.full(rows, -NONE, np.int64)
    spelt = np.full(n, -1, np.int32)  # ids at the place of their last byte
    live = np.flatnonzero(size)
    place = place[live]
    while len(live):
        loss = np.where(second[place] > NONE, best[place] - second[place], -NONE)
        gap[live] = np.minimum(gap[live], loss)
        k, width = by[place] - 1, back[place]
        end = place - live
        spelt[end - 1] = k
        odd = np.flatnonzero(k < 0)
        if len(odd):
            if v.bytes_at is None:
                spelt[end[odd] - 1] = v.unknown
            else:
                for b in range(1, int(width[odd].max()) + 1):
                    e = end[odd[width[odd] >= b]] - b
                    spelt[e] = v.bytes_at[raw[e]]
        place = place - width
        on = np.flatnonzero(place > first[live])
        live, place = live[on], place[on]
    ids = spelt >= 0
    many = np.r_[0, np.cumsum(ids)]
    return spelt[ids], many[bounds[1:]] - many[bounds[:-1]], total, gap


def solve(vocabulary: Vocabulary, raw: np.ndarray, start: np.ndarray, end: np.ndarray, step: int = 1 << 18) -> Solved:
    """The best path of each chunk raw[start:end], of the short ones for about ``step`` bytes at once."""
    n = len(start)
    size = end - start
    score, gap, count = np.zeros(n, np.int64), np.full(n, -NONE, np.int64), np.zeros(n, np.int64)
    parts: list[tuple[np.ndarray, np.ndarray]] = []  # ids of chunks in this order
    for c in np.flatnonzero(size > _SHORT):
        ids, chunk = [], raw[start[c] : end[c]].tobytes()
        into = vocabulary.edges(chunk)
        best = forward(into)
        # the second path leaves the first at one place, so its loss is that of one edge
        path, at, least = [], len(chunk), -NONE
        while at:
            ways = sorted(((best[i] + s, i, k) for i, s, k in into[at] if best[i] > NONE), key=lambda x: (-x[0], -x[1]))
            if len(ways) > 1:
                least = min(least, ways[0][0] - ways[1][0])
            path.append((ways[0][1], at, ways[0][2]))
            at = ways[0][1]
        for i, j, k in reversed(path):
            ids += [k] if k >= 0 else vocabulary.spell(chunk[i:j])
        score[c], gap[c], count[c] = best[-1], least, len(ids)
        parts.append((np.array([c]), np.array(ids, np.int32)))
    short = np.flatnonzero(size <= _SHORT)
    ends = np.r_[0, np.cumsum(size[short])]
    for a, b in pieces(ends, step):
        rows, bounds = short[a:b], ends[a : b + 1] - ends[a]
        pick = np.arange(bounds[-1]) + np.repeat(start[rows] - bounds[:-1], size[rows])
        ids, count[rows], score[rows], gap[rows] = _short(vocabulary, raw[pick], bounds)
        parts.append((rows, ids))
    at = np.r_[0, np.cumsum(count)]
    flat = np.concatenate([x for _, x in parts]) if parts else np.zeros(0, np.int32)
    # they lie in the order of parts; put them in the order of chunks
    order = np.concatenate([x for x, _ in parts]) if parts else np.zeros(0, np.int64)
    begin = np.empty(n, np.int64)
    begin[order] = np.r_[0, np.cumsum(count[order])][:-1]
    pick = np.arange(at[-1]) + np.repeat(begin - at[:-1], count)
    return Solved(flat[pick], at, score, gap)


def prefixed(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows with a space before each that is not empty."""
    size = np.diff(offsets)
    more = (size > 0).astype(np.int64)
    new = np.r_[0, np.cumsum(size + more)]
    out = np.full(new[-1], 32, np.uint8)
    keep = np.ones(new[-1], bool)
    keep[new[:-1][more > 0]] = False
    out[keep] = raw
    return out, new


def chunks(vocabulary: Vocabulary, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the chunks; each row's chunks cover it."""
    if len(raw) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.zeros(len(raw), bool)
    if vocabulary.cuts:
        blank = raw == 32
        new[1:] = blank[1:] & ~blank[:-1]
    at = offsets[:-1]
    new[at[at < len(raw)]] = True
    start = np.flatnonzero(new)
    return start, np.r_[start[1:], len(raw)]


class Memory:
    """Solved chunks by hash, so that a process solves a chunk once for many batches; emptied when it is full.

    This saves time alone: results are the same without it.
    """

    def __init__(self, vocabulary: Vocabulary, most: int = 1_000_000):
        self.vocabulary, self.most = vocabulary, most
        self.ways: dict[tuple[int, bytes], list] = {}  # n best paths of some chunks
        self.clear()

    def clear(self) -> None:
        z = np.zeros(0, np.int64)
        self.hash, self.slot = z.astype(np.uint64), z
        self.solved = Solved(z.astype(np.int32), np.zeros(1, np.int64), z, z)

    def find(self, raw: np.ndarray, h: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[Solved, np.ndarray]:
        """All that is solved, and where in it each of these distinct chunks (h rising) is."""
        if len(self.hash) + len(h) > self.most:
            self.clear()
        at = np.searchsorted(self.hash, h)
        known = np.zeros(len(h), bool)
        inside = at < len(self.hash)
        known[inside] = self.hash[at[inside]] == h[inside]
        new = np.flatnonzero(~known)
        old = self.solved
        if len(new):
            got = solve(self.vocabulary, raw, start[new], end[new])
            slot = len(old.score) + np.arange(len(new))
            self.hash, self.slot = np.insert(self.hash, at[new], h[new]), np.insert(self.slot, at[new], slot)
            self.solved = Solved(
                np.concatenate([old.ids, got.ids]), np.concatenate([old.at, old.at[-1] + got.at[1:]]),
                np.concatenate([old.score, got.score]), np.concatenate([old.gap, got.gap]),
            )
        return self.solved, self.slot[np.searchsorted(self.hash, h)]


_loaded: dict[bytes, Memory] = {}


def load(model: bytes) -> Memory:
    """The vocabulary with what has been solved, once a process."""
    key = hashlib.blake2b(model, digest_size=16).digest()
    if key not in _loaded:
        _loaded[key] = Memory(from_sentencepiece(model))
    return _loaded[key]


def forget() -> None:
    """Give back the room of what this process has solved."""
    for memory in _loaded.values():
        memory.clear()
        memory.ways.clear()


class Encoded:
    """The best paths of a run of rows, and what the search for others needs."""

    def __init__(self, memory: Memory, raw: np.ndarray, offsets: np.ndarray):
        vocabulary = memory.vocabulary
        if vocabulary.prefix:
            raw, offsets = prefixed(raw, offsets)
        self.vocabulary, self.raw, self.offsets = vocabulary, raw, offsets
        self.start, self.end = chunks(vocabulary, raw, offsets)
        h, first, which = np.unique(hashes(raw, self.start, self.end), return_index=True, return_inverse=True)
        self.solved, place = memory.find(raw, h, self.start[first], self.end[first])
        self.which = place[which]
        size = np.diff(self.solved.at)[self.which]
        self.at = np.r_[0, np.cumsum(size)]  # ids of each chunk
        pick = np.arange(self.at[-1]) + np.repeat(self.solved.at[:-1][self.which] - self.at[:-1], size)
        self.ids = self.solved.ids[pick]
        self.bounds = np.searchsorted(self.start, offsets)  # chunks of each row
        self.rows = self.at[self.bounds]  # ids of each row
        total = np.r_[0, np.cumsum(self.solved.score[self.which])]
        self.score = total[self.bounds[1:]] - total[self.bounds[:-1]]

    def others(self, row: int, n: int, memo: dict[tuple[int, bytes], list]) -> list[tuple[int, np.ndarray]]:
        """(score, ids) of the second to the n-th path of a row."""
        a, b = int(self.bounds[row]), int(self.bounds[row + 1])
        gaps = self.solved.gap[self.which[a:b]]
        if len(gaps) > n - 1:
            near = np.argpartition(gaps, n - 2)[: n - 1]
        else:
            near = np.arange(len(gaps))
        near = np.sort(near[gaps[near] < -NONE]) + a
        if len(near) == 0:
            return []
        into: list[list[tuple[int, int, int]]] = [[]]
        ways = []
        for place, c in enumerate(near):
            chunk = self.raw[self.start[c] : self.end[c]].tobytes()
            key = n, chunk
            if key not in memo:
                if len(memo) > 100_000:
                    memo.clear()
                found = []
                for score, path in n_best(self.vocabulary.edges(chunk), n):
                    ids: list[int] = []
                    for i, j, k in path:
                        ids += [k] if k >= 0 else self.vocabulary.spell(chunk[i:j])
                    found.append((score, np.array(ids, np.int32)))
                # of several best paths the one already taken comes first, so that no path comes twice
                own = self.ids[self.at[c] : self.at[c + 1]]
                others = [x for x in found if not np.array_equal(x[1], own)]
                memo[key] = [(found[0][0], own.copy()), *others][:n]
            ways.append(memo[key])
            # a path's own score less the best keeps the numbers those of the whole text
            into.append([(place, score - memo[key][0][0], k) for k, (score, _) in enumerate(memo[key])])
        base = self.ids[self.rows[row] : self.rows[row + 1]]
        out = []
        found_paths = [x for x in n_best(into, n) if any(k for _, _, k in x[1])]  # the rest is the path already taken
        for loss, path in found_paths[: n - 1]:
            parts, at = [], 0
            for (place, _, k), c in zip(path, near):
                if k:
                    lo, hi = self.at[c] - self.rows[row], self.at[c + 1] - self.rows[row]
                    parts += [base[at:lo], ways[place][k][1]]
                    at = hi
            out.append((int(self.score[row]) + loss, np.concatenate(parts + [base[at:]])))
        return out


def written(vocabulary: Vocabulary, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) that rows of ids stand for, without the first space where the model adds one."""
    size = vocabulary.sizes[ids]
    at = np.r_[0, np.cumsum(size)]
    pick = np.arange(at[-1]) + np.repeat(vocabulary.places[ids] - at[:-1], size)
    raw, offsets = vocabulary.joined[pick], at[bounds]
    if not vocabulary.prefix:
        return raw, offsets
    first = offsets[:-1][offsets[1:] > offsets[:-1]]
    drop = np.zeros(len(raw), bool)
    drop[first[raw[first] == 32]] = True
    lost = np.r_[0, np.cumsum(drop)]
    return raw[~drop], offsets - lost[offsets]


def _restores(vocabulary: Vocabulary, ids: np.ndarray, bounds: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each row of ids decodes to the row of bytes."""
    got, at = written(vocabulary, ids, bounds)
    if len(got) == len(raw) and np.array_equal(at, offsets):
        if np.array_equal(got, raw):
            return np.ones(len(at) - 1, bool)
        wrong = np.r_[0, np.cumsum(got != raw)]
        return wrong[at[1:]] == wrong[at[:-1]]
    return np.array([np.array_equal(got[at[k] : at[k + 1]], raw[offsets[k] : offsets[k + 1]]) for k in range(len(at) - 1)], bool)


def _read_model(model: str | bytes) -> bytes:
    if isinstance(model, bytes):
        return model
    with open(model, "rb") as f:
        return f.read()


def encode(docs: DataFrame, n: int = 3, model: str | bytes = MODEL, piece_bytes: int = 1 << 22) -> DataFrame:
    """(doc_id, rank, score, n_pieces, ids, restores): the ``n`` best segmentations of each text.

    ``restores`` tells whether the ids decode to the text again.  ``model`` is a
    SentencePiece model, as a path of the driver or as its bytes.
    """
    ship(docs.sparkSession)
    proto = docs.sparkSession.sparkContext.broadcast(_read_model(model))  # a vocabulary, not corpus data
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        memory = load(proto.value)
        vocabulary = memory.vocabulary
        for batch in batches:
            raw, offsets = buffers(batch["text"])
            for a, b in pieces(offsets, piece_bytes):
                part, off = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                got = Encoded(memory, part, off)
                by_rank: list[list] = [[] for _ in range(n - 1)]
                for row in range(b - a if n > 1 else 0):
                    for r, (score, ids) in enumerate(got.others(row, n, memory.ways)):
                        by_rank[r].append((row, score, ids))
                for r, found in enumerate([None, *by_rank]):
                    if found is None:
                        rows, score, ids, bounds = np.arange(b - a), got.score, got.ids, got.rows
                    elif found:
                        rows, score = np.array([x[0] for x in found]), np.array([x[1] for x in found])
                        ids = np.concatenate([x[2] for x in found])
                        bounds = np.r_[0, np.cumsum([len(x[2]) for x in found])]
                    else:
                        continue
                    if len(rows) == b - a:
                        ok = _restores(vocabulary, ids, bounds, part, off)
                    else:
                        size = np.diff(off)[rows]
                        sub = np.r_[0, np.cumsum(size)]
                        pick = np.arange(sub[-1]) + np.repeat(off[:-1][rows] - sub[:-1], size)
                        ok = _restores(vocabulary, ids, bounds, part[pick], sub)
                    yield pa.RecordBatch.from_arrays(
                        [batch["doc_id"].slice(a, b - a).take(pa.array(rows)), pa.array(np.full(len(rows), r + 1, np.int32)), pa.array(score / UNIT),
                         pa.array(np.diff(bounds).astype(np.int32)), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)), pa.array(ok)],
                        names=["doc_id", "rank", "score", "n_pieces", "ids", "restores"],
                    )

    got = docs.where("text IS NOT NULL").select("doc_id", "text")
    return got.mapInArrow(run, f"doc_id {kind}, rank int, score double, n_pieces int, ids array<int>, restores boolean")


def decode(encoded: DataFrame, model: str | bytes = MODEL) -> DataFrame:
    """``encoded`` with a column ``text`` in place of ``ids``; null ids give null, ids outside the vocabulary are an error.

    Bytes that are no UTF-8 become U+FFFD.
    """
    ship(encoded.sparkSession)
    proto = encoded.sparkSession.sparkContext.broadcast(_read_model(model))
    from pyspark.sql import functions as F

    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        vocabulary = load(proto.value).vocabulary
        out = []
        for x in ids:
            if not x.is_valid:
                out.append(None)
                continue
            flat = x.values.to_numpy(zero_copy_only=False)
            if len(flat) and (flat.min() < 0 or flat.max() >= len(vocabulary.texts)):
                raise ValueError("an id is outside the vocabulary")
            out.append(written(vocabulary, flat, np.array([0, len(flat)]))[0].tobytes().decode(errors="replace"))
        return pa.array(out, pa.string())

    keep = [c for c in encoded.columns if c not in ("ids", "text")]
    return encoded.select(*keep, text("ids").alias("text"))
