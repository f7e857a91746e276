"""Passages of many words that repeat, found by blockwise suffix sorting.

A passage repeats when a window of ``min_words`` consecutive words (runs without
white space, byte for byte) occurs at an earlier place, in the order of
(doc_id, word position).  All words of such windows are marked; the first
occurrence stays as it is.

Suffixes are sorted one bucket at a time.  A bucket holds the suffixes whose
window has the same minimiser, the k-gram of least hash in the window: equal
windows have equal minimisers, so each window is compared in exactly one bucket
and a bucket needs only the words about its minimiser (a region), never the
corpus.  A bucket's text is sorted by the first ``v`` words; ties beyond that are
resolved by the precomputed ranks of a difference-cover sample of the bucket's
own suffixes: for any two positions a shift below ``v`` puts both in the sample.
Memory is bounded by the bucket, however long the ties.

Before anything is sorted, regions equal as a whole are settled by their least
place, found by an aggregate that combines within the tasks; minimisers with one
region are dropped, and only regions that differ about a shared minimiser are
sent on as words.  A minimiser with more than ``hot_regions`` of them (a line on
millions of pages, each with other words around it) is in no bucket: its windows
are hashed (128 bits) and the least place of each hash is found by an aggregate,
too.  So a bucket has a hard bound, whatever repeats in the corpus.

Defined results:

* Null and empty texts and texts under ``min_words`` words have no passage; an
  empty table gives an empty result.
* Very long texts are read whole; a passage may be as long as a text.
* ``doc_id`` must be a whole number.  Rows with a null ``doc_id`` are left as they
  are and mark nothing.
* Rows with equal ``doc_id`` and equal text are one document; with other texts
  each row is its own, in the order of the texts' hashes (64 bits).
* ``min_words`` under ``k`` is an error.
* Equal windows in one document count as well: the first stays.
* Other columns are not looked at.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, free_name, give_back, materialize, ship, whole_numbers
from .textbytes import buffers, hashes, mix, pieces, row_of, string_array, words

_OTHER = np.uint64(0xD1B54A32D192ED03)
#: Perfect difference covers: period -> residues whose differences are all residues.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 31: (0, 1, 3, 8, 12, 18), 57: (0, 1, 3, 13, 32, 36, 43, 52)}


def shift_table(v: int) -> np.ndarray:
    """[a, b] -> the shift below v that puts residues a and b both into the cover."""
    cover = np.array(COVERS[v])
    table = np.full((v, v), -1)
    for x, y in itertools.product(cover, cover):
        for a in range(v):
            s = (x - a) % v
            b = (y - s) % v
            if table[a, b] < 0 or s < table[a, b]:
                table[a, b] = s
    assert (table >= 0).all()
    return table


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks (equal for equal keys) of rows by the keys, the first the most significant."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def cover_ranks(text: np.ndarray, v: int) -> np.ndarray:
    """Rank of every sample suffix among the sample, 0 elsewhere; text is padded by 2v zeros.

    Sorted by the first v words, then by doubling: position p + v is of the
    sample as p is.
    """
    n = len(text) - 2 * v
    inside = np.zeros(v, bool)
    inside[list(COVERS[v])] = True
    at = np.flatnonzero(inside[np.arange(n) % v])
    full = np.zeros(len(text), np.int64)
    if len(at) == 0:
        return full
    rank = np.zeros(len(at), np.int64)
    for k in range(v):  # refine word by word, ties only
        if k == 0:
            rank = _dense(text[at])
        else:
            rank = _dense(rank, text[at + k])
        if rank[-1:].size and len(np.unique(rank)) == len(rank):
            break
    full[at] = rank + 1
    step = v
    while True:
        much = full[at]
        if len(np.unique(much)) == len(much):
            return full
        later = np.minimum(at + step, len(full) - 1)
        full[at] = _dense(much, full[later]) + 1
        step *= 2
        if step > 2 * len(text):
            return full


def sorted_suffixes(text: np.ndarray, v: int = 31, block: int = 1 << 18) -> np.ndarray:
    """Positions of the suffixes of ``text`` (positive numbers) in lexicographic order.

    The suffixes are cut into buckets by their first word, none over ``block``
    unless one word begins more, and sorted a bucket at a time.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    padded = np.zeros(n + 2 * v, np.int64)
    padded[:n] = text
    ranks = cover_ranks(padded, v)
    shift = shift_table(v)
    by_word = np.argsort(padded[:n], kind="stable")
    first = padded[by_word]
    cuts = [0]
    while cuts[-1] < n:
        end = min(n, cuts[-1] + block)
        if end < n:
            down = int(np.searchsorted(first, first[end], "left"))
            end = down if down > cuts[-1] else int(np.searchsorted(first, first[end], "right"))
        cuts.append(end)
    out = [_bucket(padded, by_word[a:b], ranks, shift, v) for a, b in zip(cuts, cuts[1:])]
    return np.concatenate(out)


def _bucket(text: np.ndarray, at: np.ndarray, ranks: np.ndarray, shift: np.ndarray, v: int) -> np.ndarray:
    """The suffixes ``at`` in order: by v words, then by the sample's ranks."""
    order = at
    group = np.zeros(len(at), np.int64)
    loose = np.arange(len(at))  # places in order that are still tied
    for k in range(v):
        if len(loose) == 0:
            return order
        key = text[order[loose] + k]
        s = np.lexsort((key, group[loose]))
        order[loose] = order[loose][s]
        key, g = key[s], group[loose]
        new = np.r_[True, (g[1:] != g[:-1]) | (key[1:] != key[:-1])]
        group[loose] = loose[np.maximum.accumulate(np.where(new, np.arange(len(loose)), 0))]
        g = group[loose]
        alone = np.r_[g[1:] != g[:-1], True] & np.r_[True, g[1:] != g[:-1]]
        loose = loose[~alone]
    if len(loose) == 0:
        return order
    g = group[loose]
    begin = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    size = np.diff(np.r_[begin, len(g)])
    for width in np.unique(size):
        rows = begin[size == width]
        step = max(1, (1 << 20) // int(width * width)) if width <= 1024 else 1
        for k in range(0, len(rows), step):
            where = loose[rows[k : k + step, None] + np.arange(width)]
            p = order[where]
            place = np.zeros(p.shape, np.int64)
            if width <= 1024:
                s = shift[p[:, :, None] % v, p[:, None, :] % v]
                place = (ranks[p[:, None, :] + s] < ranks[p[:, :, None] + s]).sum(2)
            else:  # by residue classes: each is sorted by itself, then counted into the others
                q = p[0]
                classes = [np.flatnonzero(q % v == r) for r in np.unique(q % v)]
                for mine in classes:
                    for other in classes:
                        s = shift[q[mine[0]] % v, q[other[0]] % v]
                        place[0, mine] += np.searchsorted(np.sort(ranks[q[other] + s]), ranks[q[mine] + s], "left")
            moved = np.empty_like(p)
            np.put_along_axis(moved, place, p, 1)
            order[where] = moved
    return order


def same_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the first ``length`` words at a and b are equal; text is padded by ``length`` zeros."""
    same = np.zeros(len(a), bool)
    live = np.arange(len(a))
    for k in range(length):
        live = live[text[a[live] + k] == text[b[live] + k]]
        if len(live) == 0:
            return same
    same[live] = True
    return same


def regions_of(h: np.ndarray, bounds: np.ndarray, min_words: int, k: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, document, first word, words) of the regions of documents' word hashes.

    Document d has the words bounds[d]:bounds[d+1].  A region is a run of windows
    with the same minimiser place, with all their words.
    """
    n, w = len(h), min_words - k + 1
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    if n < min_words:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z
    with np.errstate(over="ignore"):
        gram = h[: n - k + 1].copy()
        odd = np.uint64(0x2545F4914F6CDD1D)
        for i in range(1, k):
            gram = gram * odd + h[i : n - k + 1 + i]
    gram = mix(gram)
    # the place of the least gram among w, the leftmost on ties, by doubling
    best, at, span = gram.copy(), np.arange(len(gram)), 1
    while span < w:
        step = min(span, w - span)
        x, y = best[:-step], best[step:]
        right = y < x
        best = np.where(right, y, x)
        at = np.where(right, at[step:], at[:-step])
        span += step
    start = np.arange(len(at))
    whole = doc[start] == doc[start + min_words - 1]
    start, at, best = start[whole], at[whole], best[whole]
    if len(start) == 0:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (doc[start[1:]] != doc[start[:-1]])])
    last = np.r_[new[1:], len(start)] - 1
    d = doc[start[new]]
    return best[new], d, start[new] - bounds[d], start[last] - start[new] + min_words


def _range_hash(h: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A hash of the words first:first+count."""
    with np.errstate(over="ignore"):
        odd, total = np.uint64(0x9E3779B97F4A7C15), np.zeros(len(first), np.uint64)
        live = np.arange(len(first))
        for k in range(int(count.max()) if len(count) else 0):
            if not (k < count[live]).all():
                live = live[k < count[live]]
            total[live] = total[live] * odd + h[first[live] + k] + np.uint64(1)
    return mix(total ^ count.astype(np.uint64))


def _word_table(batch_text, limit: int = 1 << 21):
    """For each piece of a text column: first row, word starts, ends, hashes, bounds by row."""
    raw, offsets = buffers(batch_text)
    for a, b in pieces(offsets, limit):
        part, off = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        s, e = words(part, off)
        bounds = np.searchsorted(s, off)
        yield a, b, part, off, s, e, hashes(part, s, e), bounds


def _sources(docs: DataFrame) -> DataFrame:
    """(doc_id, variant, text): rows with an id and a text; variant tells rows of one id apart."""
    whole_numbers(docs, "doc_id")
    got = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    return got.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("variant"), "text")


def _occurrences(docs: DataFrame, min_words: int, k: int) -> DataFrame:
    """(anchor, whole, n, doc_id, variant, start) of every region of the corpus; ``whole`` is a hash of its n words."""

    def run(batches):
        for batch in batches:
            for a, _, _, _, _, _, h, bounds in _word_table(batch["text"]):
                anchor, d, start, n = regions_of(h, bounds, min_words, k)
                whole, rows = _range_hash(h, bounds[d] + start, n), pa.array(a + d)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(n.astype(np.int32)),
                     batch["doc_id"].take(rows), batch["variant"].take(rows), pa.array(start.astype(np.int32))],
                    names=["anchor", "whole", "n", "doc_id", "variant", "start"],
                )
        give_back()

    return docs.mapInArrow(run, "anchor long, whole long, n int, doc_id long, variant long, start int")


def _region_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(anchor, hot, doc_id, variant, start, words) of the wanted regions; ``words`` is their text."""
    per_doc = wanted.groupBy("doc_id", "variant").agg(F.collect_list(F.struct("anchor", "hot", "start", "n")).alias("_regions"))
    # the regions of a corpus are too many to broadcast; the plan is the same at every size
    once = docs.groupBy("doc_id", "variant").agg(F.first("text").alias("text"))
    held = once.hint("merge").join(per_doc.hint("merge"), ["doc_id", "variant"]).select("doc_id", "variant", "text", "_regions")

    def run(batches):
        for batch in batches:
            lists = batch["_regions"]
            flat, ends = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            start, n = (flat.field(x).to_numpy() for x in ("start", "n"))
            for a, b, raw, _, s, e, _, bounds in _word_table(batch["text"]):
                lo_, hi_ = int(ends[a]), int(ends[b])
                part = slice(lo_, hi_)
                row = np.repeat(np.arange(b - a), np.diff(ends[a : b + 1]))
                first = bounds[row] + start[part]
                lo, hi = s[first], e[first + n[part] - 1]
                size = hi - lo
                off = np.r_[0, np.cumsum(size)]
                pick = np.arange(off[-1]) + np.repeat(lo - off[:-1], size)
                rows = pa.array(a + row)
                yield pa.RecordBatch.from_arrays(
                    [flat.field("anchor").slice(lo_, hi_ - lo_), flat.field("hot").slice(lo_, hi_ - lo_), batch["doc_id"].take(rows), batch["variant"].take(rows),
                     flat.field("start").slice(lo_, hi_ - lo_), string_array(raw[pick], off)],
                    names=["anchor", "hot", "doc_id", "variant", "start", "words"],
                )

    return held.mapInArrow(run, "anchor long, hot boolean, doc_id long, variant long, start int, words string")


def _windows(texts: DataFrame, min_words: int) -> DataFrame:
    """(h0, h1, doc_id, variant, start) of each window of the regions."""

    def run(batches):
        for batch in batches:
            start = batch["start"].to_numpy()
            for a, _, _, _, _, _, h, bounds in _word_table(batch["words"]):
                count = np.maximum(np.diff(bounds) - min_words + 1, 0)
                row = np.repeat(np.arange(len(count)), count)
                inside = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                at, width = bounds[row] + inside, np.full(len(row), min_words)
                rows = pa.array(a + row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_range_hash(h, at, width).view(np.int64)), pa.array(_range_hash(mix(h ^ _OTHER), at, width).view(np.int64)),
                     batch["doc_id"].take(rows), batch["variant"].take(rows), pa.array((start[a + row] + inside).astype(np.int32))],
                    names=["h0", "h1", "doc_id", "variant", "start"],
                )

    return texts.select("words", "doc_id", "variant", "start").mapInArrow(run, "h0 long, h1 long, doc_id long, variant long, start int")


def bucket_marks(doc: np.ndarray, variant: np.ndarray, at: np.ndarray, text: pa.Array, min_words: int, v: int) -> tuple[np.ndarray, ...]:
    """(doc, variant, at, words, first doc) of the runs of windows that occur at an earlier place of the bucket."""
    raw, offsets = buffers(text)
    s, e = words(raw, offsets)
    bounds = np.searchsorted(s, offsets)
    _, ids = np.unique(hashes(raw, s, e), return_inverse=True)
    rows, total = len(offsets) - 1, len(ids)
    region = np.repeat(np.arange(rows), np.diff(bounds))
    line = np.zeros(total + rows, np.int64)  # each region ends with a sentinel of its own, less than any word
    line[np.arange(total) + region] = ids + rows + 1
    line[bounds[1:] + np.arange(rows)] = np.arange(rows) + 1
    order = sorted_suffixes(line, v)
    of = np.searchsorted(bounds[1:] + np.arange(rows), order, "left")
    inside = order - (bounds[of] + of)
    full = inside + min_words <= np.diff(bounds)[of]
    order, of, inside = order[full], of[full], inside[full]
    if len(order) < 2:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z
    padded = np.r_[line, np.zeros(min_words, np.int64)]
    same = same_prefix(padded, order[:-1], order[1:], min_words)
    group = np.r_[0, np.cumsum(~same)]
    place = doc[of], variant[of], at[of] + inside
    rank = np.lexsort((*place[::-1], group))
    group, of, inside, (p_doc, p_variant, p_at) = group[rank], of[rank], inside[rank], (x[rank] for x in place)
    lead = np.r_[True, group[1:] != group[:-1]]
    head = np.maximum.accumulate(np.where(lead, np.arange(len(group)), 0))
    later = (p_doc != p_doc[head]) | (p_variant != p_variant[head]) | (p_at != p_at[head])
    of, inside, first = of[later], inside[later], p_doc[head][later]
    back = np.lexsort((inside, of))
    of, inside, first = of[back], inside[back], first[back]
    if len(of) == 0:
        return of, of, of, of, of
    begin = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (inside[1:] != inside[:-1] + 1) | (first[1:] != first[:-1])])
    count = np.diff(np.r_[begin, len(of)]) + min_words - 1
    of, inside = of[begin], inside[begin]
    return doc[of], variant[of], at[of] + inside, count, first[begin]


PLACE = ("doc_id", "variant", "start")


def marks(docs: DataFrame, min_words: int = 50, k: int = 16, v: int = 31, bucket_words: int = 250_000, hot_regions: int = 4096) -> DataFrame:
    """(doc_id, variant, start, end, first_doc_id): runs of words in windows that occur earlier; runs may overlap."""
    if min_words < k:
        raise ValueError("min_words must be k at least")
    spark = docs.sparkSession
    ship(spark)
    source = _sources(docs)
    place = F.struct(*PLACE)
    seen = materialize(_occurrences(source, min_words, k), "occurrences")
    regions = seen.groupBy("anchor", "whole").agg(F.first("n").alias("n"), F.min(place).alias("first"), F.count("*").alias("times"))
    regions = materialize(regions, "regions")
    # whole regions that occur again: all places but the first
    again = seen.join(regions.where("times > 1").select("anchor", "whole", "first"), ["anchor", "whole"])
    again = materialize(again.where(place != F.col("first")).select(*PLACE, "n", F.col("first.doc_id").alias("first_doc_id")), "again")
    discard(seen)
    # regions that differ about a shared minimiser: the first place of each
    kinds = regions.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    wanted = regions.join(kinds, "anchor").select("anchor", (F.col("kinds") > hot_regions).alias("hot"), "first.*", "n")
    wanted = materialize(wanted, "wanted")
    discard(regions)
    size = wanted.agg(F.sum(F.when(~F.col("hot"), F.col("n"))).alias("cold"), F.max("hot").alias("hot")).first()
    buckets = max(spark.sparkContext.defaultParallelism, -(-(size["cold"] or 0) // bucket_words))
    texts = _region_texts(source, wanted)

    def sort(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        doc, variant, at, n, first = bucket_marks(*(table[x].to_numpy() for x in PLACE), table["words"], min_words, v)
        give_back()
        return pa.table({"doc_id": doc, "variant": variant, "start": at.astype(np.int32), "n": n.astype(np.int32), "first_doc_id": first})

    if size["hot"]:
        texts = materialize(texts, "texts")
    bucket = F.pmod(F.xxhash64("anchor"), F.lit(buckets)).alias("bucket")
    cold = texts.where("NOT hot").select(bucket, *PLACE, "words").groupBy("bucket")
    found = again.union(cold.applyInArrow(sort, "doc_id long, variant long, start int, n int, first_doc_id long"))
    if size["hot"]:
        hashed = materialize(_windows(texts.where("hot"), min_words), "windows")
        least = hashed.groupBy("h0", "h1").agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1")
        later = hashed.join(least, ["h0", "h1"]).where(place != F.col("first"))
        found = found.union(later.select(*PLACE, F.lit(min_words).alias("n"), F.col("first.doc_id").alias("first_doc_id")))
    return found.select("doc_id", "variant", "start", (F.col("start") + F.col("n")).alias("end"), "first_doc_id")


def merged(found: DataFrame) -> DataFrame:
    """(doc_id, variant, start, end, first_doc_id): overlapping and adjoining runs made one, the least first id."""
    before = Window.partitionBy("doc_id", "variant").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    running = Window.partitionBy("doc_id", "variant").orderBy("start", "end")
    opens = F.coalesce(F.col("start") > F.max("end").over(before), F.lit(True))
    return (
        found.withColumn("opens", opens.cast("int"))
        .withColumn("span", F.sum("opens").over(running))
        .groupBy("doc_id", "variant", "span")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("first_doc_id").alias("first_doc_id"))
        .drop("span")
    )


def repeated_passages(docs: DataFrame, **params) -> DataFrame:
    """(doc_id, start_word, end_word, n_words, first_doc_id) of each run of repeated words, end exclusive.

    ``first_doc_id`` is a document that holds one of its windows earlier, the least
    of those found; where a whole region repeats it is the first with that region,
    though another may hold a part of it still earlier.
    """
    return merged(marks(docs, **params)).select(
        "doc_id", F.col("start").alias("start_word"), F.col("end").alias("end_word"), (F.col("end") - F.col("start")).alias("n_words"), "first_doc_id"
    )


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of the spans and without white space at its ends."""
    raw = text.encode()
    s, e = words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    out, at = [], 0
    for lo, hi in spans:
        out.append(raw[at : s[lo]])
        at = int(s[hi]) if hi < len(s) else len(raw)
    out.append(raw[at:])
    return b"".join(out).decode().strip(" \t\n\r\x0b\x0c")


def _cut(text: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for t, s in zip(text, spans):
        out.append(cut_words(t.as_py(), [(x["start"], x["end"]) for x in s.as_py()]) if s.is_valid and t.is_valid else None)
    return pa.array(out, pa.string())


def cut_repeats(docs: DataFrame, **params) -> DataFrame:
    """``docs`` with all repeated passages cut from ``text`` but the first of each; columns as they are.

    ``n_chars``, where there is such a column, is counted anew for the texts that
    change.  A document of which nothing is left goes.
    """
    spans = materialize(merged(marks(docs, **params)), "spans")
    id, variant, cut, changed = (free_name(docs, x) for x in ("_id", "_variant", "_spans", "_new"))
    per_doc = spans.groupBy(F.col("doc_id").alias(id), F.col("variant").alias(variant)).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(cut))
    same = (F.col("doc_id") == F.col(id)) & (F.xxhash64("text") == F.col(variant))
    joined = docs.hint("merge").join(per_doc.hint("merge"), same, "left")
    hit, new = F.col(cut).isNotNull(), F.col(changed)
    got = joined.withColumn(changed, F.arrow_udf(_cut, "string")(F.when(hit, F.col("text")), F.col(cut))).where(~hit | (new != ""))
    out = []
    for f in docs.schema.fields:
        if f.name == "text":
            out.append(F.when(hit, new).otherwise(F.col("text")).alias("text"))
        elif f.name == "n_chars":
            out.append(F.when(hit, F.char_length(new)).otherwise(F.col("n_chars")).cast(f.dataType).alias("n_chars"))
        else:
            out.append(F.col(f.name))
    return got.select(*out)
