"""Token ids in sorted-string tables: prefix-compressed blocks, sparse index, Bloom filter and footer.

A shard file holds, in this order:
  blocks   zstd frames; in each, entries in ascending key order:
           shared u8, unshared u8, bytes of the value u32, the key's unshared bytes, the value.
           The key is the identifier as 8 big-endian bytes with the sign bit flipped, of a null one no byte; `shared`
           bytes of it are those of the entry before, none at a block's start. The value is the ids, 2 or 4 little-endian bytes each.
  index    for each block: last key (8 bytes), place u64, bytes u32
  bloom    bits, 10 a document; 7 probes by double hashing
  footer   place of the index, of the bloom filter, blocks, documents, ids, bytes an id, each u64; magic
"""

from __future__ import annotations

import bisect
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import texts, written
from .tokens import encoder, in_batches

BLOCK_BYTES = 1 << 16
_MAGIC = b"RVLSST01"
_FOOTER = struct.Struct("<6Q8s")
_INDEX = struct.Struct("<8sQI")
_ENTRY = struct.Struct("<BBI")
_BITS, _PROBES = 10, 7
_MANIFEST = "path string, first_id long, last_id long, documents long, tokens long"


def _key(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def _id(key: bytes) -> int | None:
    return None if not key else struct.unpack(">Q", key)[0] - (1 << 63)


def _probes(keys: np.ndarray, bits: int) -> np.ndarray:
    """keys: pairs of hashes, one row each."""
    return (keys[:, :1] + np.arange(_PROBES, dtype=np.uint64) * (keys[:, 1:] | np.uint64(1))) % np.uint64(bits)


def _hashes(key: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(key)
    return h & ((1 << 64) - 1), h >> 64


class ShardWriter:
    """Takes documents in ascending order of their identifiers, null ones first; a repeated identifier gets an entry
    each time. first and last are identifiers other than null, if there is one."""

    def __init__(self, out, width: int, block_bytes: int = BLOCK_BYTES):
        self.out, self.dtype, self.width, self.block_bytes = out, f"<u{width}", width, block_bytes
        self.place, self.documents, self.tokens = 0, 0, 0
        self.index: list[tuple[bytes, int, int]] = []
        self.hashes: list[tuple[int, int]] = []
        self.first = self.last = None
        self._pack = zstandard.ZstdCompressor(level=1)
        self._block, self._size, self._before = [], 0, b""

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        key, value = _key(doc_id), ids.astype(self.dtype).tobytes()
        shared = 0
        while shared < min(len(self._before), len(key)) and key[shared] == self._before[shared]:
            shared += 1
        self._block += [_ENTRY.pack(shared, len(key) - shared, len(value)), key[shared:], value]
        self._size += len(value) + 14
        self._before = key
        self.hashes.append(_hashes(key))
        self.first = doc_id if self.first is None else self.first
        self.last = doc_id
        self.documents, self.tokens = self.documents + 1, self.tokens + len(ids)
        if self._size >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self._block:
            data = self._pack.compress(b"".join(self._block))
            self.index.append((self._before, self.place, len(data)))
            self._write(data)
            self._block, self._size, self._before = [], 0, b""

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.place += len(data)

    def close(self) -> None:
        self._flush()
        index_at = self.place
        self._write(b"".join(_INDEX.pack(*x) for x in self.index))
        bloom_at, bits = self.place, max(64, _BITS * self.documents)
        bits += -bits % 8
        bloom = np.zeros(bits, bool)
        if self.hashes:
            bloom[_probes(np.array(self.hashes, np.uint64), bits).ravel()] = True
        self._write(np.packbits(bloom).tobytes())
        self._write(_FOOTER.pack(index_at, bloom_at, len(self.index), self.documents, self.tokens, self.width, _MAGIC))


class ShardReader:
    """entries() in order; get(doc_id) by Bloom filter, binary search of the index and one block."""

    def __init__(self, source: pa.NativeFile):
        self.source = source
        size = source.size()
        foot = self._read(size - _FOOTER.size, _FOOTER.size)
        index_at, self.bloom_at, blocks, self.documents, self.tokens, self.width, magic = _FOOTER.unpack(foot)
        if magic != _MAGIC:
            raise ValueError("not a shard file")
        self.index = list(_INDEX.iter_unpack(self._read(index_at, blocks * _INDEX.size)))
        self._bloom = np.unpackbits(np.frombuffer(self._read(self.bloom_at, size - _FOOTER.size - self.bloom_at), np.uint8))

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def _block(self, place: int, n: int) -> Iterator[tuple[int, np.ndarray]]:
        data = zstandard.ZstdDecompressor().decompress(self._read(place, n))
        at, key = 0, b""
        while at < len(data):
            shared, rest, size = _ENTRY.unpack_from(data, at)
            at += _ENTRY.size
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield _id(key), np.frombuffer(data, f"<u{self.width}", size // self.width, at)
            at += size

    def entries(self) -> Iterator[tuple[int, np.ndarray]]:
        for _, place, n in self.index:
            yield from self._block(place, n)

    def get(self, doc_id: int) -> list[np.ndarray]:
        key = _key(doc_id)
        if not self._bloom[_probes(np.array([_hashes(key)], np.uint64), len(self._bloom)).ravel()].all():
            return []
        found: list[np.ndarray] = []
        for last, place, n in self.index[bisect.bisect_left(self.index, key, key=lambda x: x[0]) :]:
            found += [v for i, v in self._block(place, n) if i == doc_id]
            if last > key:
                break
        return found


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def write_table(docs: DataFrame, tokenizer: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Writes shard files under path, a shared folder, and returns their manifest
    (path, first_id, last_id, documents, tokens).

    Sampled splitters range-partition the texts by doc_id; each task encodes its range in order and writes one
    file under a name of its own, so that a task that is run again leaves the first file unnamed. A null or empty
    text holds its end id only; an empty table has no shards; repeated rows have an entry each, rows with a null
    doc_id too, which stand first and which no lookup finds; other input columns are ignored.
    """
    schema = pa.schema([("path", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("documents", pa.int64()), ("tokens", pa.int64())])

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        width = 2 if max(enc.vocabulary, end_id + 1) <= 1 << 16 else 4
        name, out, writer = f"{path}/shard-{uuid.uuid4().hex}.sst", None, None
        for b in batches:
            for i, t in zip(b.column(0), b.column(1), strict=True):
                if writer is None:
                    system, at = _opened(name)
                    system.create_dir(at.rsplit("/", 1)[0], recursive=True)
                    out = system.open_output_stream(at)
                    writer = ShardWriter(out, width, block_bytes)
                writer.add(i.as_py(), np.append(np.frombuffer(enc.ids(t.as_py()), "<u4"), np.uint32(end_id)))
        enc.rest()
        if writer is not None:
            writer.close()
            out.close()
            yield from in_batches(iter([(name, writer.first, writer.last, writer.documents, writer.tokens)]), schema)

    ordered = texts(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return written(ordered.mapInArrow(shard, _MANIFEST), "sst-manifest")


def read_table(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, ids) from the shard files that a manifest names: start counts the ids of all documents
    before, over all shards; ids are little-endian unsigned 32-bit integers with the end id.

    The manifest has one small row a file; one task reads one file.
    """
    before = F.sum("tokens").over(W.orderBy("first_id", "last_id", "path").rowsBetween(W.unboundedPreceding, -1))
    files = manifest.select("path", F.coalesce(before, F.lit(0)).alias("base"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for f in b.to_pylist():
                system, at = _opened(f["path"])
                with system.open_input_file(at) as source:
                    start = f["base"]
                    for doc_id, ids in ShardReader(source).entries():
                        yield doc_id, start, ids.astype("<u4").tobytes()
                        start += len(ids)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_batches(rows(batches), schema)

    return files.repartition(max(1, manifest.count())).mapInArrow(read, "doc_id long, start long, ids binary")


def lookup(spark: SparkSession, manifest: DataFrame, doc_id: int) -> list[np.ndarray]:
    """The ids of one document, read on the driver from the shards whose range holds it."""
    found: list[np.ndarray] = []
    for f in manifest.filter((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)).collect():
        system, at = _opened(f["path"])
        with system.open_input_file(at) as source:
            found += ShardReader(source).get(doc_id)
    return found
