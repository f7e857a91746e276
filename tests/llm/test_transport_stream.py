import numpy as np
import pytest

from quillion.llm import transport_stream as T


def stream(spark, *media):
    return spark.createDataFrame([(k, bytearray(m) if m is not None else None) for k, m in enumerate(media)], "doc_id long, media binary")


def made(text: str, side: str = "side", unit: int = 50) -> bytes:
    a, b = text.encode(), side.encode()
    raw, offsets = T.multiplex(np.frombuffer(a, np.uint8), np.array([0, len(a)]), np.frombuffer(b, np.uint8), np.array([0, len(b)]), unit)
    assert len(raw) % 188 == 0 and offsets[-1] == len(raw)
    return raw.tobytes()


def slow(data: bytes) -> list[tuple]:
    """A plain parser for whole streams: (pid, payload) of the units in order of start."""
    units, order = {}, []
    for at in range(0, len(data), 188):
        p = data[at : at + 188]
        pid, skip = (p[1] & 31) << 8 | p[2], 4
        if pid < 0x100 or pid == T.PMT_PID:
            continue
        if p[3] & 0x20:
            skip += 1 + p[4]
        if p[1] & 0x40:
            order.append(pid)
            units[len(order) - 1] = b""
            last = {**locals().get("last", {}), pid: len(order) - 1}
        units[last[pid]] += p[skip:]
    return [(pid, units[k][9 + units[k][8] :]) for k, pid in enumerate(order)]


@pytest.mark.parametrize("size", [1, 10, 155, 156, 157, 158, 159, 338, 339, 340, 341, 342, 343, 344, 2000])
def test_round_trip_at_every_fill(spark, size):
    text = "".join(chr(97 + k % 26) for k in range(size))
    data = made(text, "abc", 100_000)
    got = T.demux(stream(spark, data)).orderBy("pid").collect()
    assert [bytes(r.payload) for r in got] == [text.encode(), b"abc"]
    assert [(T.VIDEO, text.encode()), (T.AUDIO, b"abc")] == slow(data)
    assert all(r.complete and r.lost == 0 for r in got)


def test_times_and_random_access(spark):
    got = T.demux(stream(spark, made("x" * 1000))).where("pid = 256").orderBy("unit").collect()
    assert [r.pts for r in got] == [7200 + 3600 * k for k in range(20)]
    assert [r.dts for r in got] == [3600 + 3600 * k for k in range(20)]
    assert [r.unit for r in got if r.random_access] == [0, 8, 16]
    assert {(r.program, r.stream_type) for r in got} == {(1, 0x1B)}


def test_lost_repeated_and_junk_packets(spark):
    data = made("".join(chr(97 + k % 26) for k in range(3000)), unit=1000)
    packets = [data[k : k + 188] for k in range(0, len(data), 188)]
    without = b"".join(p for k, p in enumerate(packets) if k != 4)
    twice = b"".join(p * (2 if k == 4 else 1) for k, p in enumerate(packets))
    junk = b"\x00\x47junk" + b"".join(packets[:6]) + b"noise" + b"".join(packets[6:]) + b"\x47tail"
    bad = b"".join(bytes([p[0], p[1] | 0x80]) + p[2:] if k == 4 else p for k, p in enumerate(packets))
    rows = T.demux(stream(spark, data, without, twice, junk, bad)).where("pid = 256").orderBy("doc_id", "unit").collect()
    of = lambda k: [r for r in rows if r.doc_id == k]
    assert [(r.lost, r.complete) for r in of(0)] == [(0, True)] * 3
    assert [(r.lost, r.complete) for r in of(1)] == [(1, False), (0, True), (0, True)]
    for k in (2, 3):
        assert [bytes(r.payload) for r in of(k)] == [bytes(r.payload) for r in of(0)] and all(r.lost == 0 for r in of(k))
    assert [(r.lost, r.complete) for r in of(4)] == [(1, False), (0, True), (0, True)]


def test_tables_over_several_packets_and_wrong_checksum(spark):
    body = made("y" * 100)[2 * 188 :]
    table = T.pmt(1, {T.VIDEO: 0x1B, T.AUDIO: 0x0F}, descriptors=bytes([0x05, 250]) + b"d" * 250)
    first = bytes([0x47, 0x50, 0x00, 0x10, 0]) + table[:183]
    rest = bytes([0x47, 0x10, 0x00, 0x11]) + table[183:].ljust(184, b"\xff")
    good = T.table_packet(0, T.pat({1: T.PMT_PID})) + first + rest + body
    broken = T.table_packet(0, T.pat({1: T.PMT_PID})[:-1] + b"\0") + first + rest + body
    got = T.demux(stream(spark, good, broken)).collect()
    assert {r.doc_id for r in got} == {0} and sum(len(r.payload) for r in got if r.pid == T.VIDEO) == 100
    assert T.crc(table) == 0


def test_times_go_on_past_33_bits():
    known, group = np.array([True, True, False, True, True]), np.array([1, 1, 1, 1, 2])
    out = T._unrolled(np.array([(1 << 33) - 10, 5, 0, 20, 7]), known, group)
    assert out.tolist() == [(1 << 33) - 10, (1 << 33) + 5, 0, (1 << 33) + 20, 7]


def test_odd_rows(spark, odd, empty):
    media = T.mux(odd)
    got = T.demux(media).groupBy("doc_id").count().collect()
    assert media.count() == odd.count() and media.where("media IS NULL").count() == 2
    assert {r.doc_id for r in got} == {1, 3, 4, 5, 6, 7, 8, 9, None}  # empty texts still have their source
    assert T.demux(T.mux(empty)).count() == 0
    assert T.demux(stream(spark, None, b"", b"no sync here", b"\x47" * 100)).count() == 0
