"""Token ids as raw binary, found by key through a minimal perfect hash.

Texts become ids of a SentencePiece vocabulary (their best segmentations), kept
as plain little-endian numbers of two bytes (four for vocabularies over 65,536).
Documents are spread over shards by hash of their key.  A shard is one row: the
payload, and an index of its n keys that needs neither the keys nor a search:

* ``levels``: bit arrays.  A key's place in level 0 is a hash modulo the level's
  size; places that exactly one key has are set, the other keys go on to the next
  level.  The number of set bits before a key's bit is its slot, 0 to n - 1.
* ``ranks``: set bits before each word of 64 bits, so a slot takes constant time.
* by slot: ``fingerprints`` (32 bits of another hash; a key that was never
  stored passes with probability 2**-32), ``offsets`` and ``lengths`` in ids.

A lookup reads one bit a level (1.6 levels on average), one rank and one slot.

``build`` gives the shards as rows.  ``write`` puts each shard into a file of its
own, straight from the task that makes it, and ``lookup`` reads from these files
only the words, slots and payload runs of the keys asked for, by offset: what it
reads grows with the keys, not with the store.  The number of shards stands in
``store.json``, which is written last and makes the store valid.

Defined results:

* ``doc_id`` must be a whole number.  Rows with a null ``doc_id`` can't be looked
  up and are in no shard.
* A null or empty text has the length 0; very long texts are one run of ids.
* Rows with equal ``doc_id`` are one key: their ids lie one after the other, in
  the order of the texts' ids, and the key finds them all; ``n_rows`` counts rows.
* A key that was not stored gives nothing (or, by chance 2**-32, a wrong run).
* An empty table has no shard.
* Other columns are not looked at.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sentencepieces import MODEL, Encoded, _read_model, forget, load
from .shared import give_back, materialize, ship, whole_numbers
from .textbytes import buffers, mix, pieces

GAMMA = 2.0
MAX_LEVELS = 48
_SCHEMA = (
    "shard int, n_keys int, n_rows int, n_ids long, id_bytes int, level_bits array<int>, levels binary, ranks binary, "
    "fingerprints binary, offsets binary, lengths binary, payload binary, found int"
)


def _level_hash(keys: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(keys + np.uint64((level * 0x9E3779B97F4A7C15 + 0x1234567) & ((1 << 64) - 1)))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(keys ^ np.uint64(0xA24BAED4963EE407)) >> np.uint64(32)).astype(np.uint32)


class Index:
    """A minimal perfect hash: distinct keys (64 bits) to 0 .. n - 1."""

    def __init__(self, bits: list[int], words: np.ndarray, ranks: np.ndarray):
        self.bits, self.words, self.ranks = bits, words, ranks
        self.first = np.r_[0, np.cumsum([b // 64 for b in bits])].astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> Index:
        left, bits, parts = keys.astype(np.uint64), [], []
        for level in range(MAX_LEVELS):
            if len(left) == 0:
                break
            size = max(64, -(-int(len(left) * GAMMA) // 64) * 64)
            at = (_level_hash(left, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            parts.append(np.packbits(alone, bitorder="little").view(np.uint64))
            bits.append(size)
            left = left[~alone[at]]
        if len(left):
            raise ValueError("keys are not distinct")
        words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        ranks = np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)][:-1].astype(np.uint32)
        return cls(bits, words, ranks)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for some keys that were not stored, a wrong one for others."""
        keys = keys.astype(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        live = np.arange(len(keys))
        for level, size in enumerate(self.bits):
            if len(live) == 0:
                break
            at = (_level_hash(keys[live], level) % np.uint64(size)).astype(np.int64)
            word, bit = self.first[level] + (at >> 6), (at & 63).astype(np.uint64)
            hit = (self.words[word] >> bit) & np.uint64(1) == 1
            below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[live[hit]] = (self.ranks[word].astype(np.int64) + np.bitwise_count(below))[hit]
            live = live[~hit]
        return out


class Shard:
    """Keyed access to one row of the store."""

    def __init__(self, row):
        self.kind = {2: "<u2", 4: "<u4"}[row["id_bytes"]]
        self.index = Index(list(row["level_bits"]), np.frombuffer(row["levels"], "<u8"), np.frombuffer(row["ranks"], "<u4"))
        self.prints = np.frombuffer(row["fingerprints"], "<u4")
        self.offsets = np.frombuffer(row["offsets"], "<u8")
        self.lengths = np.frombuffer(row["lengths"], "<u4")
        self.payload = row["payload"]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of the keys, -1 for those that are not stored."""
        if len(self.prints) == 0:
            return np.full(len(keys), -1, np.int64)
        slot = self.index.slots(keys)
        ok = (slot >= 0) & (self.prints[np.maximum(slot, 0)] == fingerprints(keys.astype(np.uint64)))
        return np.where(ok, slot, -1)

    def get(self, key: int) -> np.ndarray | None:
        """The ids that are stored under a key."""
        slot = int(self.find(np.array([key], np.int64).view(np.uint64))[0])
        if slot < 0:
            return None
        size = np.dtype(self.kind).itemsize
        return np.frombuffer(self.payload, self.kind, int(self.lengths[slot]), int(self.offsets[slot]) * size)


def make_shard(shard: int, keys: np.ndarray, runs: pa.Array, id_bytes: int) -> dict:
    """A row of the store from keys (signed, may repeat) and their raw id runs."""
    raw, ends = _binary(runs)
    size = np.diff(ends) // id_bytes
    order = np.argsort(keys, kind="stable")
    begin = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]])
    again = np.diff(np.r_[begin, len(order)])
    for a, n in zip(begin[again > 1], again[again > 1]):  # rows of one key, in the order of their ids
        rows = order[a : a + n]
        order[a : a + n] = sorted(rows, key=lambda r: raw[ends[r] : ends[r + 1]].tobytes())
    own, length = keys[order][begin].view(np.uint64), np.add.reduceat(size[order], begin)
    index = Index.build(own)
    slot = index.slots(own)
    at_slot = np.empty(len(own), np.int64)
    at_slot[slot] = np.arange(len(own))
    # the payload lies in the order of slots
    several = again[at_slot]
    before = np.r_[0, np.cumsum(several)][:-1]
    rows = order[np.arange(len(order)) + np.repeat(begin[at_slot] - before, several)]
    width = (ends[1:] - ends[:-1])[rows]
    to = np.r_[0, np.cumsum(width)]
    payload = bytearray(int(to[-1]))
    view, source = memoryview(payload), memoryview(np.ascontiguousarray(raw))
    for r, a, b in zip(rows.tolist(), to[:-1].tolist(), to[1:].tolist()):
        view[a:b] = source[ends[r] : ends[r + 1]]
    length = length[at_slot]
    row = {
        "shard": shard, "n_keys": len(own), "n_rows": len(keys), "n_ids": int(size.sum()), "id_bytes": id_bytes,
        "level_bits": index.bits, "levels": index.words.astype("<u8").tobytes(), "ranks": index.ranks.astype("<u4").tobytes(),
        "fingerprints": fingerprints(own[at_slot]).astype("<u4").tobytes(), "offsets": np.r_[0, np.cumsum(length)][:-1].astype("<u8").tobytes(),
        "lengths": length.astype("<u4").tobytes(), "payload": payload,
    }
    made = Shard(row)
    row["found"] = int((made.find(own) == slot).sum())
    return row


def _binary(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.cast(pa.large_binary()).combine_chunks()
    else:
        column = column.cast(pa.large_binary())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, column.offset * 8)
    first, last = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8, last - first, first) if last > first else np.zeros(0, np.uint8)
    return raw, offsets - first


def tokenized(docs: DataFrame, model: str | bytes = MODEL, piece_bytes: int = 1 << 21) -> DataFrame:
    """(key, ids): the best segmentation of each row with a key, as raw numbers."""
    ship(docs.sparkSession)
    whole_numbers(docs, "doc_id")
    proto = docs.sparkSession.sparkContext.broadcast(_read_model(model))  # a vocabulary, not corpus data

    def run(batches):
        memory = load(proto.value)
        kind = "<u2" if len(memory.vocabulary.texts) <= 1 << 16 else "<u4"
        wide = np.dtype(kind).itemsize
        for batch in batches:
            raw, offsets = buffers(batch["text"])
            for a, b in pieces(offsets, piece_bytes):
                got = Encoded(memory, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                ids = pa.Array.from_buffers(
                    pa.binary(), b - a, [None, pa.py_buffer((got.rows * wide).astype(np.int32)), pa.py_buffer(got.ids.astype(kind).tobytes())]
                )
                yield pa.RecordBatch.from_arrays([batch["key"].slice(a, b - a), ids], names=["key", "ids"])
                del got, ids
            pa.default_memory_pool().release_unused()
        give_back()

    return docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("key"), "text").mapInArrow(run, "key long, ids binary")


def shard_of(shards: int):
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")


def _sharded(docs: DataFrame, model: str | bytes, shard_chars: int):
    """(tokenised rows by shard, number of shards, bytes of an id)."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // shard_chars))
    id_bytes = 2 if len(load(_read_model(model)).vocabulary.texts) <= 1 << 16 else 4
    return tokenized(docs, model).withColumn("shard", shard_of(shards)).groupBy("shard"), shards, id_bytes


def build(docs: DataFrame, model: str | bytes = MODEL, shard_chars: int = 1 << 24) -> DataFrame:
    """The store: one row for each shard of about ``shard_chars`` bytes of text.

    ``found`` counts the keys whose lookup in the finished index gives their own
    slot; it equals ``n_keys``.
    """
    by_shard, _, id_bytes = _sharded(docs, model, shard_chars)

    def make(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        forget()  # all texts are encoded by now; the shard needs the room
        row = make_shard(key[0].as_py(), table["key"].to_numpy(), table["ids"], id_bytes)
        return pa.Table.from_pylist([row], schema=_ARROW)

    return by_shard.applyInArrow(make, _SCHEMA)


SECTIONS = ("levels", "ranks", "fingerprints", "offsets", "lengths", "payload")
_HEAD = 1 << 12


def _file_of(path: str, shard: int) -> str:
    return f"{path.rstrip('/')}/shard-{shard:07d}.bin"


def _open(where: str):
    """(file system, path in it) of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(where) if "://" in where or where.startswith("file:") else (fs.LocalFileSystem(), where)


def save_shard(row: dict, path: str) -> int:
    """Write a shard as a file, whole or not at all, and so again if a task is run again; its bytes.

    The file begins with a JSON header of ``_HEAD`` bytes or a multiple, which says where the sections are.
    """
    header = {k: row[k] for k in ("shard", "n_keys", "n_rows", "n_ids", "id_bytes", "level_bits")}
    size = -(-(len(json.dumps(header)) + 40 * len(SECTIONS) + 64) // _HEAD) * _HEAD
    at = size
    for name in SECTIONS:
        header[name] = [at, len(row[name])]
        at += len(row[name])
    header["head"] = size
    system, own = _open(_file_of(path, row["shard"]))
    system.create_dir(own.rpartition("/")[0], recursive=True)
    draft = f"{own}.{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as out:
        out.write(json.dumps(header).encode().ljust(size))
        for name in SECTIONS:
            out.write(row[name])
    system.move(draft, own)
    return at


class StoredShard:
    """Keyed access to a shard in its file; ``bytes_read`` counts what was read."""

    def __init__(self, path: str, shard: int):
        system, own = _open(_file_of(path, shard))
        self.file, self.bytes_read = system.open_input_file(own), 0
        head = self._read(0, _HEAD)
        try:
            self.header = json.loads(head)
        except ValueError:  # a longer header; its last field is its size
            size = _HEAD
            while True:
                size *= 2
                try:
                    self.header = json.loads(self._read(0, size).rstrip())
                    break
                except ValueError:
                    if size > self.file.size():
                        raise
        self.first = np.r_[0, np.cumsum([b // 64 for b in self.header["level_bits"]])].astype(np.int64)

    def _read(self, at: int, n: int) -> bytes:
        got = self.file.read_at(n, at)
        self.bytes_read += len(got)
        return got

    def _item(self, section: str, k: int, kind: str) -> int:
        width = np.dtype(kind).itemsize
        return int(np.frombuffer(self._read(self.header[section][0] + k * width, width), kind)[0])

    def get(self, key: int) -> np.ndarray | None:
        """The ids that are stored under a key."""
        own = np.array([key], np.int64).view(np.uint64)
        for level, size in enumerate(self.header["level_bits"]):
            at = int(_level_hash(own, level)[0] % np.uint64(size))
            place, bit = int(self.first[level]) + (at >> 6), at & 63
            word = self._item("levels", place, "<u8")
            if word >> bit & 1:
                slot = self._item("ranks", place, "<u4") + (word & ((1 << bit) - 1)).bit_count()
                if self._item("fingerprints", slot, "<u4") != int(fingerprints(own)[0]):
                    return None
                width = self.header["id_bytes"]
                start, n = self._item("offsets", slot, "<u8"), self._item("lengths", slot, "<u4")
                return np.frombuffer(self._read(self.header["payload"][0] + start * width, n * width), f"<u{width}")
        return None


def write(docs: DataFrame, path: str, model: str | bytes = MODEL, shard_chars: int = 1 << 24) -> DataFrame:
    """Write the store into the folder ``path``, which all executors share; (shard, n_keys, n_rows, n_ids, bytes, found) of each shard.

    ``path`` is a local path or a URI that pyarrow's file systems open.
    """
    spark = docs.sparkSession
    by_shard, shards, id_bytes = _sharded(docs, model, shard_chars)

    def make(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        forget()
        row = make_shard(key[0].as_py(), table["key"].to_numpy(), table["ids"], id_bytes)
        own = {x: row[x] for x in ("shard", "n_keys", "n_rows", "n_ids", "found")} | {"bytes": save_shard(row, path)}
        return pa.Table.from_pylist([own], schema=pa.schema([("shard", pa.int32()), ("n_keys", pa.int32()), ("n_rows", pa.int32()), ("n_ids", pa.int64()), ("bytes", pa.int64()), ("found", pa.int32())]))

    made = materialize(by_shard.applyInArrow(make, "shard int, n_keys int, n_rows int, n_ids long, bytes long, found int"), "shards")
    held = [r["shard"] for r in made.select("shard").collect()]  # a number for each shard file
    system, own = _open(f"{path.rstrip('/')}/store.json")
    system.create_dir(own.rpartition("/")[0], recursive=True)
    with system.open_output_stream(f"{own}.draft") as out:
        out.write(json.dumps({"shards": shards, "held": sorted(held)}).encode())
    system.move(f"{own}.draft", own)
    return made


_ARROW = pa.schema(
    [("shard", pa.int32()), ("n_keys", pa.int32()), ("n_rows", pa.int32()), ("n_ids", pa.int64()), ("id_bytes", pa.int32()), ("level_bits", pa.list_(pa.int32()))]
    + [(x, pa.binary()) for x in ("levels", "ranks", "fingerprints", "offsets", "lengths", "payload")]
    + [("found", pa.int32())]
)


def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """(key, ids) of the keys (column ``key``) that the store in ``path`` holds; a key asked for twice is given once."""
    ship(spark)
    whole_numbers(keys, "key")
    system, own = _open(f"{path.rstrip('/')}/store.json")
    with system.open_input_stream(own) as f:
        meta = json.loads(f.read())
    held = set(meta["held"])

    def run(key: tuple[pa.Scalar, ...], wanted: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        got = []
        if shard in held:
            stored = StoredShard(path, shard)
            got = [(k, ids.astype(np.int32)) for k in wanted["key"].to_pylist() if (ids := stored.get(k)) is not None]
        return pa.table({"key": pa.array([k for k, _ in got], pa.int64()), "ids": pa.array([x for _, x in got], pa.list_(pa.int32()))})

    wanted = keys.where("key IS NOT NULL").select(F.col("key").cast("long").alias("key")).distinct().withColumn("shard", shard_of(meta["shards"]))
    return wanted.groupBy("shard").applyInArrow(run, "key long, ids array<int>")
