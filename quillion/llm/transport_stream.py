"""MPEG transport streams in a binary column: program tables, continuity, elementary packets, timestamps.

``demux`` parses whole streams.  Packets (188 bytes) are found by their sync
bytes, also behind junk; the program association table and the program maps tell
which packet ids carry elementary streams; continuity counters are checked; the
payloads between two unit starts are put together to one elementary packet (PES),
whose header gives presentation and decoding times.  A unit whose first packet
has the random access indicator is a point to seek to: ``packet`` tells where it
begins.

All packets of a batch of streams are parsed at once, as a matrix of bytes.

``mux`` is the reverse: it makes a stream of one program from the rows' texts.

Defined results of ``demux``:

* Null and empty streams, and bytes without a sync byte, have no row.
* Bytes outside packets are skipped.  A packet begins with a sync byte where the
  packet before it ends; the first, and one behind junk, only where another sync
  byte is 188 bytes on, or the stream ends less than a packet later.
* Tables with a wrong checksum are ignored.  Streams without a valid program map
  have no row.  Of several versions of a table the last one counts.
* Packets with the transport error indicator, and scrambled ones, are dropped
  (and so are missing).
* A packet repeated at once with the same counter is dropped without error.
  ``lost`` is the number of packets (modulo 16) missing before and inside a unit.
* What comes before the first unit start of a packet id is dropped.
* A unit is ``complete`` if nothing is lost after its first packet, its header is
  whole, and it has as many bytes as its header says (any number if 0).
* A unit without a time has the times null; without a decoding time it is that of
  presentation.  Times are in ticks of 90 kHz and go on past the 33-bit end.
* Repeated rows are parsed one by one; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ship
from .textbytes import buffers, pieces

PACKET = 188
SYNC = 0x47
VIDEO, AUDIO, PMT_PID = 0x100, 0x101, 0x1000
UNIT_CHARS = 2000


def _crc_table() -> list[int]:
    out = []
    for k in range(256):
        c = k << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc(data: bytes) -> int:
    """The checksum of program tables; 0 over a table with its own checksum."""
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def section(table: int, number: int, body: bytes, version: int = 0) -> bytes:
    """A program table with its header and checksum."""
    size = len(body) + 9
    data = bytes([table, 0xB0 | size >> 8, size & 255, number >> 8, number & 255, 0xC1 | version << 1, 0, 0]) + body
    return data + crc(data).to_bytes(4, "big")


def pat(programs: dict[int, int], version: int = 0) -> bytes:
    return section(0, 1, b"".join(p.to_bytes(2, "big") + (0xE000 | pid).to_bytes(2, "big") for p, pid in programs.items()), version)


def pmt(program: int, streams: dict[int, int], version: int = 0, descriptors: bytes = b"") -> bytes:
    """``streams``: packet id -> stream type."""
    first = next(iter(streams), 0x1FFF)
    body = (0xE000 | first).to_bytes(2, "big") + (0xF000 | len(descriptors)).to_bytes(2, "big") + descriptors
    for pid, kind in streams.items():
        body += bytes([kind]) + (0xE000 | pid).to_bytes(2, "big") + b"\xf0\x00"
    return section(2, program, body, version)


def table_packet(pid: int, data: bytes, counter: int = 0) -> bytes:
    """A table of up to 183 bytes as one packet."""
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10 | counter & 15, 0]) + data).ljust(PACKET, b"\xff")


_HEAD = np.frombuffer(table_packet(0, pat({1: PMT_PID})) + table_packet(PMT_PID, pmt(1, {VIDEO: 0x1B, AUDIO: 0x0F})), np.uint8).reshape(2, PACKET)


# ------------------------------------------------------------------------- mux


def _stamp(out: np.ndarray, at: np.ndarray, mark: int, time: np.ndarray) -> None:
    """Write 33-bit times in five bytes each."""
    out[at] = mark << 4 | ((time >> 30) & 7) << 1 | 1
    out[at + 1] = (time >> 22) & 255
    out[at + 2] = ((time >> 15) & 127) << 1 | 1
    out[at + 3] = (time >> 7) & 255
    out[at + 4] = (time & 127) << 1 | 1


def multiplex(raw: np.ndarray, offsets: np.ndarray, side: np.ndarray, side_offsets: np.ndarray, unit_chars: int = UNIT_CHARS) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the streams: units of ``unit_chars`` characters of the text, then one unit of the side text."""
    rows = len(offsets) - 1
    first = np.flatnonzero((raw & 0xC0) != 0x80)
    upto = np.searchsorted(first, offsets)
    nth = np.arange(len(first)) - np.repeat(upto[:-1], np.diff(upto))
    start = first[nth % unit_chars == 0]
    row = np.searchsorted(offsets, start, "right") - 1
    end = np.r_[start[1:], len(raw)]
    units = np.bincount(row, minlength=rows)
    k = np.arange(len(start)) - np.repeat(np.r_[0, np.cumsum(units)][:-1], units)
    has = np.flatnonzero(np.diff(side_offsets))
    # units of a row: those of the text, then the side text
    row = np.r_[row, has]
    start, end = np.r_[start, side_offsets[:-1][has] + len(raw)], np.r_[end, side_offsets[1:][has] + len(raw)]
    pid = np.r_[np.full(len(k), VIDEO), np.full(len(has), AUDIO)]
    k = np.r_[k, np.zeros(len(has), np.int64)]
    order = np.lexsort((k, pid, row))
    row, start, end, pid, k = row[order], start[order], end[order], pid[order], k[order]
    video = pid == VIDEO
    head = np.where(video, 19, 14)
    size = head + end - start
    # elementary packets
    at = np.r_[0, np.cumsum(size)]
    pes = np.zeros(at[-1], np.uint8)
    base = at[:-1]
    body = end - start
    to = np.r_[0, np.cumsum(body)]
    source = np.r_[raw, side]
    pes[np.arange(to[-1]) + np.repeat(base + head - to[:-1], body)] = source[np.arange(to[-1]) + np.repeat(start - to[:-1], body)]
    pes[base + 2] = 1
    pes[base + 3] = np.where(video, 0xE0, 0xC0)
    length = np.where(video | (size - 6 > 65535), 0, size - 6)  # unbounded for video
    pes[base + 4], pes[base + 5] = length >> 8, length & 255
    pes[base + 6] = 0x80
    pes[base + 7] = np.where(video, 0xC0, 0x80)
    pes[base + 8] = head - 9
    _stamp(pes, base[video] + 9, 3, k[video] * 3600 + 7200)
    _stamp(pes, base[video] + 14, 1, k[video] * 3600 + 3600)
    _stamp(pes, base[~video] + 9, 2, k[~video] * 3600 + 7200)
    # packets: the first has eight bytes of adaptation field
    count = 1 + np.maximum(0, -(-(size - 176) // 184))
    unit = np.repeat(np.arange(len(size)), count)
    p0 = np.r_[0, np.cumsum(count)][:-1]
    nth = np.arange(len(unit)) - p0[unit]
    begin = np.where(nth == 0, 0, 176 + (nth - 1) * 184)
    some = np.minimum(size[unit] - begin, np.where(nth == 0, 176, 184))
    per_row = np.bincount(row, weights=count, minlength=rows).astype(np.int64)
    total = per_row + 2
    ends = np.r_[0, np.cumsum(total)]
    out = np.full((ends[-1], PACKET), 0xFF, np.uint8)
    out[ends[:-1]], out[ends[:-1] + 1] = _HEAD[0], _HEAD[1]
    slot = np.arange(len(unit)) + 2 * (row[unit] + 1)
    # counters run on over the units of a packet id
    kind = row * 2 + ~video
    before = np.zeros(len(size), np.int64)
    run = np.r_[0, np.cumsum(count)][:-1]
    lead = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]]) if len(kind) else np.zeros(0, np.int64)
    before = run - np.repeat(run[lead], np.diff(np.r_[lead, len(kind)]))
    counter = (before[unit] + nth) & 15
    out[slot, 0] = SYNC
    out[slot, 1] = np.where(nth == 0, 0x40, 0) | pid[unit] >> 8
    out[slot, 2] = pid[unit] & 255
    stuff = 184 - some
    out[slot, 3] = np.where(stuff > 0, 0x30, 0x10) | counter
    out[slot[stuff > 0], 4] = stuff[stuff > 0] - 1
    out[slot[stuff > 1], 5] = 0
    random = video & (k % 8 == 0) | ~video
    f = slot[nth == 0]
    out[f, 5] = 0x10 | np.where(random, 0x40, 0)
    clock = k * 3600
    out[f, 6], out[f, 7], out[f, 8], out[f, 9] = (clock >> 25) & 255, (clock >> 17) & 255, (clock >> 9) & 255, (clock >> 1) & 255
    out[f, 10], out[f, 11] = (clock & 1) << 7 | 0x7E, 0
    place = slot * PACKET + PACKET - some
    reach = np.r_[0, np.cumsum(some)]
    out.reshape(-1)[np.arange(reach[-1]) + np.repeat(place - reach[:-1], some)] = pes
    return out.reshape(-1), ends * PACKET


def mux(docs: DataFrame, unit_chars: int = UNIT_CHARS, batch_bytes: int = 1 << 22) -> DataFrame:
    """(doc_id, media): a stream of each row's text (video) and source (audio); a null text gives a null stream."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            raw, offsets = buffers(batch["text"])
            side, side_offsets = buffers(batch["source"])
            for a, b in pieces(offsets, batch_bytes):
                lo, hi = side_offsets[a], side_offsets[b]
                out, ends = multiplex(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], side[lo:hi], side_offsets[a : b + 1] - lo, unit_chars)
                media = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(out)]).cast(pa.binary())
                media = pa.compute.if_else(batch["text"].slice(a, b - a).is_valid(), media, pa.scalar(None, pa.binary()))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), media], names=["doc_id", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    source = F.col("source") if "source" in docs.columns else F.lit(None).cast("string").alias("source")
    return docs.select("doc_id", "text", source).mapInArrow(run, f"doc_id {kind}, media binary")


# ----------------------------------------------------------------------- demux


def packets(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place of the first byte) of all packets."""
    rows, places = [], []
    size = np.diff(offsets)
    whole = size // PACKET
    for r in range(len(size)):
        a, n = int(offsets[r]), int(size[r])
        at = a + np.arange(whole[r]) * PACKET
        if n % PACKET == 0 and (raw[at] == SYNC).all():
            rows.append(np.full(len(at), r))
            places.append(at)
            continue
        own = raw[a : a + n]
        good = own[: max(0, n - PACKET + 1)] == SYNC
        follow = np.zeros(len(good), bool)
        follow[: max(0, n - PACKET)] = own[PACKET:n][: max(0, n - PACKET)] == SYNC
        last = np.arange(len(good)) + 2 * PACKET > n
        good &= follow[: len(good)] | last
        marks, p, found, locked = np.flatnonzero(good), 0, [], False
        while p + PACKET <= n:
            if not (locked and own[p] == SYNC):
                if (k := int(np.searchsorted(marks, p))) == len(marks):
                    break
                p = int(marks[k])
            found.append(a + p)
            p, locked = p + PACKET, True
        rows.append(np.full(len(found), r))
        places.append(np.array(found, np.int64))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(places)


def sections(parts: list[tuple[bool, bytes]]) -> list[bytes]:
    """Valid tables of one packet id, from (unit start, payload) of its packets."""
    out, held, open_ = [], b"", False

    def drain(data: bytes) -> bytes:
        while len(data) >= 3 and data[0] != 0xFF:
            size = 3 + ((data[1] & 15) << 8 | data[2])
            if len(data) < size:
                return data
            if size >= 12 and crc(data[:size]) == 0:
                out.append(data[:size])
            data = data[size:]
        return b"" if data[:1] == b"\xff" else data

    for start, data in parts:
        if start:
            if not data:
                continue
            skip = data[0]
            if open_:
                drain(held + data[1 : 1 + skip])
            held, open_ = drain(data[1 + skip :]), True
        elif open_:
            held = drain(held + data)
    return out


def read_pat(data: bytes) -> dict[int, int]:
    if data[0] != 0 or not data[5] & 1:
        return {}
    body = data[8:-4]
    pairs = [(int.from_bytes(body[k : k + 2], "big"), int.from_bytes(body[k + 2 : k + 4], "big") & 0x1FFF) for k in range(0, len(body) - 3, 4)]
    return {program: pid for program, pid in pairs if program}


def read_pmt(data: bytes) -> tuple[int, dict[int, int]] | None:
    if data[0] != 2 or not data[5] & 1 or len(data) < 16:
        return None
    at, end, streams = 12 + ((data[10] & 15) << 8 | data[11]), len(data) - 4, {}
    while at + 5 <= end:
        streams[(data[at + 1] & 31) << 8 | data[at + 2]] = data[at]
        at += 5 + ((data[at + 3] & 15) << 8 | data[at + 4])
    return int.from_bytes(data[3:5], "big"), streams


def _time(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    b = [raw[at + k].astype(np.int64) for k in range(5)]
    return ((b[0] >> 1) & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def _unrolled(time: np.ndarray, known: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Times that go on past the 33-bit end, within each group (consecutive)."""
    out = time.copy()
    at = np.flatnonzero(known)
    if len(at) > 1:
        t, g = time[at], group[at]
        step = np.diff(t)
        turn = np.where(step < -(1 << 32), 1, np.where(step > 1 << 32, -1, 0))
        turn[g[1:] != g[:-1]] = 0
        total = np.r_[0, np.cumsum(turn)]
        lead = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        total -= np.repeat(total[lead], np.diff(np.r_[lead, len(g)]))
        out[at] = t + (total << 33)
    return out


def demultiplex(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray | pa.Array] | None:
    """Columns of the units of a batch of streams; None if there is none."""
    row, at = packets(raw, offsets)
    if len(row) == 0:
        return None
    number = (at - offsets[row]) // PACKET
    b1, b2, b3 = raw[at + 1], raw[at + 2], raw[at + 3]
    pid = (b1 & 0x1F).astype(np.int64) << 8 | b2
    keep = ((b1 & 0x80) == 0) & ((b3 & 0xC0) == 0) & (pid != 0x1FFF)
    row, at, number, b1, b3, pid = (x[keep] for x in (row, at, number, b1, b3, pid))
    order = np.lexsort((np.arange(len(row)), pid, row))
    row, at, number, b1, b3, pid = (x[order] for x in (row, at, number, b1, b3, pid))
    start, filled, counter = (b1 & 0x40) > 0, (b3 & 0x10) > 0, (b3 & 15).astype(np.int64)
    field = (b3 & 0x20) > 0
    length = np.where(field, raw[at + 4].astype(np.int64), -1)
    flags = np.where(length > 0, raw[at + 5], 0)
    skip = np.minimum(4 + length + 1, PACKET)
    size = np.where(filled, PACKET - skip, 0)
    # continuity, within a row and packet id
    same = np.r_[False, (row[1:] == row[:-1]) & (pid[1:] == pid[:-1])]
    gap = np.zeros(len(row), np.int64)
    gap[1:] = (counter[1:] - counter[:-1] - filled[1:]) & 15
    gap[~same | ((flags & 0x80) > 0)] = 0
    again = np.zeros(len(row), bool)
    twin = np.flatnonzero(same & filled & (gap == 15) & np.r_[False, filled[:-1]])
    if len(twin):
        again[twin] = (raw[at[twin, None] + np.arange(4)] == raw[at[twin - 1, None] + np.arange(4)]).all(1)
        again &= ~np.r_[False, again[:-1]]  # one repeat is allowed
        gap[again] = 0
    live = ~again
    row, at, number, pid, start, size, skip, flags, gap = (x[live] for x in (row, at, number, pid, start, size, skip, flags, gap))
    # program tables
    group = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (pid[1:] != pid[:-1])])
    bounds = np.r_[group, len(row)]
    spans = {(int(row[a]), int(pid[a])): (int(a), int(b)) for a, b in zip(bounds[:-1], bounds[1:])}
    memo: dict = {}

    def tables(r: int, p: int) -> list[bytes]:
        a, b = spans.get((r, p), (0, 0))
        parts = [(bool(start[k]), raw[at[k] + skip[k] : at[k] + PACKET].tobytes()) for k in range(a, b) if size[k] > 0]
        key = tuple(parts)
        if key not in memo:
            memo[key] = sections(parts)
        return memo[key]

    kinds: dict[tuple[int, int], tuple[int, int]] = {}
    for r in np.unique(row):
        programs: dict[int, int] = {}
        for data in tables(int(r), 0):
            programs |= read_pat(data)
        for program, p in programs.items():
            for data in tables(int(r), p):
                got = read_pmt(data)
                if got and got[0] == program:
                    for own in [x for x, (pr, _) in kinds.items() if x[0] == r and pr == program]:
                        del kinds[own]
                    kinds |= {(int(r), x): (program, kind) for x, kind in got[1].items()}
    program = np.zeros(len(row), np.int64)
    kind = np.full(len(row), -1, np.int64)
    for key, (pr, k) in kinds.items():
        if key in spans:
            a, b = spans[key]
            program[a:b], kind[a:b] = pr, k
    # units
    lost_so_far = np.cumsum(gap)
    use = kind >= 0
    row, at, number, pid, start, size, skip, flags, gap, program, kind, lost_so_far = (
        x[use] for x in (row, at, number, pid, start, size, skip, flags, gap, program, kind, lost_so_far)
    )
    if len(row) == 0:
        return None
    fresh = np.r_[True, (row[1:] != row[:-1]) | (pid[1:] != pid[:-1])]
    begun = np.cumsum(start)
    base = np.maximum.accumulate(np.where(fresh, np.arange(len(row)), 0))
    inside = begun - begun[base] + start[base] > 0
    head = np.flatnonzero(start)
    if len(head) == 0:
        return None
    lead = np.searchsorted(head, np.arange(len(row)), "right") - 1
    row_i, lead = np.flatnonzero(inside), lead[inside]
    n = size[row_i]
    end = np.r_[0, np.cumsum(n)]
    data = raw[np.arange(end[-1]) + np.repeat(at[row_i] + skip[row_i] - end[:-1], n)]
    first = np.searchsorted(row_i, head)
    units = len(head)
    lo, hi = end[first], end[np.r_[first[1:], len(row_i)]]
    later = np.zeros(units, np.int64)
    np.add.at(later, lead, np.where(row_i == head[lead], 0, gap[row_i]))
    padded = np.r_[data, np.zeros(32, np.uint8)]
    have = hi - lo
    code = padded[lo + 3]
    ok = (have >= 9) & (padded[lo] == 0) & (padded[lo + 1] == 0) & (padded[lo + 2] == 1)
    plain = np.isin(code, (0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF))  # without a long header
    said = padded[lo + 4].astype(np.int64) << 8 | padded[lo + 5]
    marks, more = padded[lo + 7], padded[lo + 8].astype(np.int64)
    inner = np.where(plain, 6, 9 + more)
    ok = np.where(plain, (have >= 6) & (padded[lo] == 0) & (padded[lo + 1] == 0) & (padded[lo + 2] == 1), ok & (have >= inner))
    has_pts = ok & ~plain & ((marks & 0x80) > 0) & (more >= 5)
    has_dts = ok & ~plain & ((marks & 0xC0) == 0xC0) & (more >= 10)
    group = row[head] << 13 | pid[head]
    pts = np.where(has_pts, _time(padded, np.minimum(lo + 9, len(padded) - 5)), 0)
    dts = np.where(has_dts, _time(padded, np.minimum(lo + 14, len(padded) - 5)), pts)
    span = _unrolled(dts, has_pts, group)
    away = (pts - dts) % (1 << 33)
    complete = ok & (later == 0) & ((said == 0) | (have == 6 + said))
    # bytes beyond the said length are stuffing
    stop = np.where(ok & (said > 0), np.minimum(hi, lo + 6 + said), hi)
    body = np.where(ok, lo + inner, lo)
    width = np.maximum(0, stop - body)
    out_end = np.r_[0, np.cumsum(width)]
    payload = data[np.arange(out_end[-1]) + np.repeat(body - out_end[:-1], width)]
    turn = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    unit = np.arange(units) - np.repeat(turn, np.diff(np.r_[turn, units]))
    return {
        "row": row[head], "program": program[head], "pid": pid[head], "stream_type": kind[head], "unit": unit, "packet": number[head],
        "pts": pa.array(span + away, mask=~has_pts), "dts": pa.array(span, mask=~has_pts), "random_access": (flags[head] & 0x40) > 0,
        "lost": gap[head] + later, "complete": complete,
        "payload": pa.Array.from_buffers(pa.large_binary(), units, [None, pa.py_buffer(out_end.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(payload))]).cast(pa.binary()),
    }


def demux(media: DataFrame, column: str = "media", key: str = "doc_id", batch_bytes: int = 1 << 22) -> DataFrame:
    """(<key>, program, pid, stream_type, unit, packet, pts, dts, random_access, lost, complete, payload): the units of each stream."""
    ship(media.sparkSession)
    names = ("program", "pid", "stream_type", "unit", "packet", "pts", "dts", "random_access", "lost", "complete", "payload")
    kinds = (pa.int32(),) * 5 + (pa.int64(),) * 2 + (pa.bool_(), pa.int32(), pa.bool_(), pa.binary())

    def run(batches):
        for batch in batches:
            column_ = batch["_media"].cast(pa.large_binary()).fill_null(b"")
            n = len(column_)
            if n == 0:
                continue
            _, off, data = column_.buffers()
            offsets = np.frombuffer(off, np.int64, n + 1, column_.offset * 8)
            raw = np.frombuffer(data, np.uint8, int(offsets[-1])) if data is not None else np.zeros(0, np.uint8)
            for a, b in pieces(offsets, batch_bytes):
                got = demultiplex(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if got:
                    keys = batch["_key"].slice(a, b - a).take(pa.array(got["row"]))
                    cols = [x if isinstance(x := got[c], pa.Array) else pa.array(x) for c in names]
                    yield pa.RecordBatch.from_arrays([keys, *(x.cast(t) for x, t in zip(cols, kinds))], names=["_key", *names])

    kind = media.schema[key].dataType.simpleString()
    got = media.where(F.col(column).isNotNull()).select(F.col(key).alias("_key"), F.col(column).alias("_media"))
    schema = f"_key {kind}, program int, pid int, stream_type int, unit int, packet int, pts long, dts long, random_access boolean, lost int, complete boolean, payload binary"
    return got.mapInArrow(run, schema).withColumnRenamed("_key", key)


ORACLE = f"""
WITH units AS (
  SELECT doc_id, {VIDEO} AS pid, 27 AS stream_type, u.range AS k, 19 AS head, encode(substr(text, u.range * {UNIT_CHARS} + 1, {UNIT_CHARS})) AS body
  FROM documents, range((length(text) + {UNIT_CHARS - 1}) // {UNIT_CHARS}) u
  UNION ALL
  SELECT doc_id, {AUDIO}, 15, 0, 14, encode(source) FROM documents WHERE text IS NOT NULL AND source <> ''
), sized AS (
  SELECT *, 1 + greatest(0, (head + octet_length(body) - 176 + 183) // 184) AS n FROM units
)
SELECT doc_id, 1::INT AS program, pid::INT AS pid, stream_type::INT AS stream_type, k::INT AS unit,
       (2 + coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY pid, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS packet,
       (k * 3600 + 7200)::BIGINT AS pts, CASE WHEN pid = {VIDEO} THEN k * 3600 + 3600 ELSE 7200 END::BIGINT AS dts,
       k % 8 = 0 AS random_access, 0::INT AS lost, TRUE AS complete, base64(body) AS payload
FROM sized
"""
