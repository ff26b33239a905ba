"""Sorted-string-table shards of token ids.

A shard holds entries in ascending key order in blocks.  A block stores each key as the
length it shares with the key before it and the rest, with restart points that hold whole
keys; blocks are compressed one by one.  After the blocks follow a Bloom filter over the
keys, a sparse index (the last key of each block, its place and length) and a footer of
fixed size.  A lookup reads the footer, asks the filter, searches the index by halving and
reads one block.

Layout: blocks | filter | index | footer.  Block: zstd(entries, restarts as u32, number
of restarts as u32), then crc32 of the compressed bytes.  Entry: varints shared, unshared,
value length; key rest; value.  Keys order as (null first, doc_id, place among repeats).

Defined results: a null text counts as empty; a null doc_id sorts first; repeated rows are
kept, each under its own key; an empty table gives no shards and an empty result.
"""

from __future__ import annotations

import bisect
import posixpath
import struct
import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import bpe
from plumbline.llm.common import new_path

MAGIC = b"PLSST01\n"
FOOTER = struct.Struct("<QQQQQQII8s")  # filter at, index at, end, entries, ids, blocks, id bytes, hashes, magic
BLOCK_BYTES = 64 * 1024
SHARD_BYTES = 256 * 1024 * 1024
RESTART = 16
READERS = 20_000
BITS_PER_KEY = 10
HASHES = 7


def key_of(doc_id: int | None, repeat: int = 0) -> bytes:
    """Bytes that sort as (null first, doc_id, repeat)."""
    head = b"\0" + bytes(8) if doc_id is None else b"\1" + (doc_id + (1 << 63)).to_bytes(8, "big")
    return head + repeat.to_bytes(4, "big")


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else int.from_bytes(key[1:9], "big") - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def bloom_bits(keys: list[bytes], n_bits: int) -> np.ndarray:
    """Places of the keys in the filter: double hashing over 128 bits."""
    import xxhash

    digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(k[:9]) for k in keys), ">u8").reshape(-1, 2).astype(np.uint64)
    steps = np.arange(HASHES, dtype=np.uint64)
    return (digests[:, :1] + steps * (digests[:, 1:] | np.uint64(1))) % np.uint64(n_bits)


class Writer:
    """Writes entries, given in key order, to an open binary stream."""

    def __init__(self, stream: Any, id_bytes: int) -> None:
        import zstandard

        self._stream, self._pack = stream, zstandard.ZstdCompressor(level=1).compress
        self.id_bytes, self.size, self.entries, self.ids = id_bytes, 0, 0, 0
        self._index: list[tuple[bytes, int, int]] = []
        self._keys: list[bytes] = []
        self._new_block()

    def _new_block(self) -> None:
        self._block, self._held, self._restarts, self._since, self._last = [], 0, [0], 0, b""

    @property
    def first(self) -> bytes:
        return self._keys[0]

    @property
    def last(self) -> bytes:
        return self._keys[-1]

    def add(self, key: bytes, value: bytes) -> None:
        if self._keys and key <= self._keys[-1]:
            raise ValueError("keys must ascend")
        if self._since == RESTART:
            self._restarts.append(self._held)
            self._since, self._last = 0, b""
        shared = 0
        for a, b in zip(key, self._last, strict=False):
            if a != b:
                break
            shared += 1
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:]
        self._block += (entry, value)
        self._held += len(entry) + len(value)
        self._since, self._last = self._since + 1, key
        self._keys.append(key)
        self.entries += 1
        self.ids += len(value) // self.id_bytes
        if self._held >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if not self._held:
            return
        raw = b"".join(self._block) + struct.pack(f"<{len(self._restarts) + 1}I", *self._restarts, len(self._restarts))
        packed = self._pack(raw)
        packed += struct.pack("<I", zlib.crc32(packed))
        self._index.append((self._last, self.size, len(packed)))
        self._write(packed)
        self._new_block()

    def _write(self, data: bytes) -> None:
        self._stream.write(data)
        self.size += len(data)

    def finish(self) -> None:
        self._flush()
        filter_at = self.size
        n_bits = max(64, -(-len(self._keys) * BITS_PER_KEY // 8) * 8)
        bits = np.zeros(n_bits, np.uint8)
        if self._keys:
            bits[bloom_bits(self._keys, n_bits).ravel()] = 1
        self._write(np.packbits(bits).tobytes())
        index_at = self.size
        self._write(b"".join(_varint(len(k)) + k + _varint(at) + _varint(n) for k, at, n in self._index))
        self._write(FOOTER.pack(filter_at, index_at, self.size, self.entries, self.ids, len(self._index), self.id_bytes, HASHES, MAGIC))


class Reader:
    """Reads a shard from a random-access file; holds the filter and the index."""

    def __init__(self, file: Any) -> None:
        import zstandard

        self._file, self._unpack = file, zstandard.ZstdDecompressor().decompress
        footer = self._at(file.size() - FOOTER.size, FOOTER.size)
        self._filter_at, index_at, end, self.entries, self.ids, blocks, self.id_bytes, _, magic = FOOTER.unpack(footer)
        if magic != MAGIC:
            raise ValueError("not a shard")
        self._filter: bytes | None = None
        self._held: tuple[int, bytes] = (-1, b"")  # the last block read
        self._index_at = index_at
        data, at = self._at(index_at, end - index_at), 0
        self.last_keys: list[bytes] = []
        self.places: list[tuple[int, int]] = []
        for _ in range(blocks):
            n, at = _read_varint(data, at)
            self.last_keys.append(data[at : at + n])
            place, at = _read_varint(data, at + n)
            size, at = _read_varint(data, at)
            self.places.append((place, size))

    def _at(self, at: int, n: int) -> bytes:
        self._file.seek(at)
        return self._file.read(n)

    def _block(self, k: int) -> bytes:
        if self._held[0] != k:
            data = self._at(*self.places[k])
            if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
                raise ValueError("a block is damaged")
            self._held = (k, self._unpack(data[:-4]))
        return self._held[1]

    @staticmethod
    def _entries(raw: bytes, at: int, end: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < end:
            shared, at = _read_varint(raw, at)
            rest, at = _read_varint(raw, at)
            n, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + rest]
            at += rest
            yield key, raw[at : at + n]
            at += n

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        """All entries in order, block by block."""
        for k in range(len(self.places)):
            raw = self._block(k)
            (n,) = struct.unpack_from("<I", raw, len(raw) - 4)
            yield from self._entries(raw, 0, len(raw) - 4 - 4 * n)

    def may_hold(self, doc_id: int | None) -> bool:
        if self._filter is None:
            self._filter = self._at(self._filter_at, self._index_at - self._filter_at)
        return all(self._filter[b >> 3] & 128 >> (b & 7) for b in bloom_bits([key_of(doc_id)], 8 * len(self._filter))[0].tolist())

    def get(self, doc_id: int | None) -> list[bytes]:
        """The values under an id: none, one, or those of its repeats in this shard."""
        out: list[bytes] = []
        if not self.may_hold(doc_id):
            return out
        first = key_of(doc_id)
        for k in range(bisect.bisect_left(self.last_keys, first), len(self.places)):
            raw = self._block(k)
            (n,) = struct.unpack_from("<I", raw, len(raw) - 4)
            end = len(raw) - 4 - 4 * n
            restarts = struct.unpack_from(f"<{n}I", raw, end)

            def whole(at: int, raw: bytes = raw) -> bytes:
                _, at = _read_varint(raw, at)
                size, at = _read_varint(raw, at)
                _, at = _read_varint(raw, at)
                return raw[at : at + size]

            start = max(0, bisect.bisect_left(restarts, first, key=whole) - 1)
            for key, value in self._entries(raw, restarts[start], end):
                if key[:9] == first[:9]:
                    out.append(value)
                elif key > first:
                    return out
        return out


def open_fs(uri: str) -> tuple[pa.fs.FileSystem, str]:
    import pyarrow.fs

    return pyarrow.fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pyarrow.fs.LocalFileSystem(), uri)


_SHARD = "path string, part int, number int, entries long, ids long, bytes long, first binary, last binary"


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encodes the texts and writes them, in ascending doc_id order over all shards, below
    ``path`` (a folder that all executors share).  Returns one row per shard, computed once:
    a task that runs again writes the same bytes to a name of its own and moves them."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        part = task.partitionId()
        encode = bpe.encoder(tokenizer)
        id_bytes = 2 if encode.vocabulary <= 1 << 16 else 4
        kind = np.dtype(f"<u{id_bytes}")
        end = np.array([end_id], bpe.ID_TYPE).tobytes()
        fs, root = open_fs(path)
        fs.create_dir(root, recursive=True)
        stream = writer = None
        number, last, repeat, done = 0, (), 0, []

        def close() -> None:
            nonlocal stream, writer, number
            writer.finish()
            stream.close()
            name = f"part-{part:06d}-{number:04d}.sst"
            fs.move(held, posixpath.join(root, name))
            done.append((f"{path}/{name}", part, number, writer.entries, writer.ids, writer.size, writer.first, writer.last))
            stream = writer = None
            number += 1

        for batch in batches:
            for at in range(0, batch.num_rows, 5000):
                block = batch.slice(at, 5000).to_pydict()
                for doc_id, ids in zip(block["doc_id"], encode.encode(block["text"]), strict=True):
                    if writer is None:
                        held = posixpath.join(root, f".part-{part:06d}-{number:04d}-{task.taskAttemptId()}")
                        stream = fs.open_output_stream(held)
                        writer = Writer(stream, id_bytes)
                    repeat = repeat + 1 if last == (doc_id,) else 0
                    last = (doc_id,)
                    writer.add(key_of(doc_id, repeat), np.frombuffer(ids + end, bpe.ID_TYPE).astype(kind).tobytes())
                    if writer.size >= shard_bytes:
                        close()
        if writer is not None:
            close()
        columns = list(zip(*done, strict=True)) if done else [[]] * 8
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in _SHARD.split(", ")])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = slim.repartitionByRange(F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return ordered.mapInArrow(shards, _SHARD)


def read(shards: DataFrame) -> DataFrame:
    """doc_id, start (ids before it over all shards), n_tokens, ids_crc32 of every entry, from
    the files.  ``shards`` must be stored rows, not a plan that would write again."""
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    placed = shards.select("path", F.coalesce(F.sum("ids").over(before), F.lit(0)).cast("long").alias("base"))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, name = open_fs(row["path"])
                with fs.open_input_file(name) as file:
                    reader = Reader(file)
                    kind = np.dtype(f"<u{reader.id_bytes}")
                    start, rows = row["base"], []
                    for key, value in reader:
                        ids = np.frombuffer(value, kind).astype(bpe.ID_TYPE)
                        rows.append((id_of(key), start, len(ids), bpe.crc(ids.tobytes())))
                        start += len(ids)
                        if len(rows) == 10_000:
                            yield _batch(rows)
                            rows = []
                    if rows:
                        yield _batch(rows)

    return _dealt(placed, shards).mapInArrow(entries, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(shards: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 of every entry under the distinct ``doc_id`` of ``ids``, by key:
    the shards whose range holds an id, then per shard its filter, its index and one block.

    Ids that no shard holds give no row; null asks for entries without an id; an id that repeats
    gives a row per entry.  The ranges (one row per shard, a 256 MB file) go to all tasks."""
    ranges = sorted((bytes(r["first"][:9]), bytes(r["last"][:9]), r["path"]) for r in shards.select("first", "last", "path").collect())
    lasts = [r[1] for r in ranges]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, wanted = [], []
            for doc_id in batch.column(0).to_pylist():
                key = key_of(doc_id)[:9]
                k = bisect.bisect_left(lasts, key)
                while k < len(ranges) and ranges[k][0] <= key:
                    paths.append(ranges[k][2])
                    wanted.append(doc_id)
                    k += 1
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(wanted, pa.int64())], ["path", "doc_id"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, file, reader = None, None, None
        try:
            for batch in batches:
                rows = []
                for path, doc_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if path != held:
                        if file is not None:
                            file.close()
                        fs, name = open_fs(path)
                        held, file = path, fs.open_input_file(name)
                        reader = Reader(file)
                    for value in reader.get(doc_id):
                        ids = np.frombuffer(value, f"<u{reader.id_bytes}").astype(bpe.ID_TYPE)
                        rows.append((doc_id, len(ids), bpe.crc(ids.tobytes())))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "n_tokens", "ids_crc32"])
        finally:
            if file is not None:
                file.close()

    wanted = ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().mapInArrow(placed, "path string, doc_id long")
    return _dealt(wanted, shards).sortWithinPartitions("path", "doc_id").mapInArrow(found, "doc_id long, n_tokens long, ids_crc32 long")


def _dealt(rows: DataFrame, shards: DataFrame) -> DataFrame:
    """Rows that name a shard, dealt to a task per shard (READERS at most).  The number is given, as rows
    this small would else be put together in one task, which would read all shards."""
    return rows.repartition(max(1, min(READERS, shards.count())), F.col("path"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def shard_path(df: DataFrame) -> str:
    return new_path(df.sparkSession, "sst")
