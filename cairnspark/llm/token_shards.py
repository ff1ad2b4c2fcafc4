"""Token-ID output (3): concatenated id arrays whose document boundaries are Elias-Fano encoded.

A shard file holds: a header, the boundaries (token position after each document) and the document
ids as two Elias-Fano sequences, then the ids of all its documents. Shards are in ascending
document order. Only files that the manifest lists count, so what a lost or repeated task has left
behind is never read.
"""

from __future__ import annotations

import struct
import uuid
from itertools import islice
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnspark.llm.common import by_bytes, map_arrow, shared_dir, shuffle_partitions, stored
from cairnspark.llm.encoders import byte_level

_HEADER = struct.Struct("<4sIIQqIII")
_EF_HEADER = struct.Struct("<QQBI")
MAGIC = b"EFT1"


#: Documents of a shard, and of a batch that is read from one; texts may be empty, so ids alone bound neither.
SHARD_DOCS, READ_DOCS = 1 << 20, 1 << 14


class EliasFano:
    """A non-decreasing sequence of n numbers in [0, u] in about n * (2 + log2(u / n)) bits.

    Every ``STEP``-th one of the upper bits has its place recorded, so that ``select(i)`` reads a
    bounded part of it.
    """

    STEP = 64

    def __init__(self, n: int, universe: int, low_bits: int, samples: np.ndarray, high: np.ndarray, low: np.ndarray):
        self.n, self.universe, self.low_bits, self.samples, self.high, self.low = n, universe, low_bits, samples, high, low

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n, u = len(v), int(v[-1]) if len(v) else 0
        bits = max(0, (u // n).bit_length() - 1) if n else 0
        ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        upper = np.zeros(n + (u >> bits) + 1, np.uint8)
        upper[ones] = 1
        lower = ((v[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
        return cls(n, u, bits, ones[:: cls.STEP].astype("<u4" if not n or ones[-1] < 1 << 32 else "<u8"), np.packbits(upper, bitorder="little"), np.packbits(lower, bitorder="little"))

    def to_bytes(self) -> bytes:
        wide = self.samples.dtype.itemsize == 8
        return _EF_HEADER.pack(self.n, self.universe, self.low_bits | wide << 7, len(self.high)) + self.samples.tobytes() + self.high.tobytes() + self.low.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, u, flags, size = _EF_HEADER.unpack_from(data)
        bits, kind, at = flags & 127, np.dtype("<u8" if flags >> 7 else "<u4"), _EF_HEADER.size
        k = -(-n // cls.STEP)
        samples = np.frombuffer(data, kind, k, at)
        at += k * kind.itemsize
        return cls(n, u, bits, samples, np.frombuffer(data, np.uint8, size, at), np.frombuffer(data, np.uint8, -(-n * bits // 8), at + size))

    def select(self, i: int) -> int:
        """The i-th number, from one stretch of upper bits and its own low bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        block, rest = divmod(i, self.STEP)
        first = int(self.samples[block])
        last = int(self.samples[block + 1]) if block + 1 < len(self.samples) else len(self.high) * 8
        ones = np.flatnonzero(np.unpackbits(self.high[first // 8 : last // 8 + 1], bitorder="little")) + first // 8 * 8
        one = int(ones[ones >= first][rest])
        at = i * self.low_bits
        tail = np.unpackbits(self.low[at // 8 : (at + self.low_bits + 7) // 8 + 1], bitorder="little")[at % 8 : at % 8 + self.low_bits]
        return (one - i) << self.low_bits | int((tail.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum())

    def select_range(self, start: int, stop: int) -> np.ndarray:
        """The numbers from ``start`` up to ``stop``, from the stretch of upper bits that has them and their own low bits; nothing else is expanded."""
        start, stop = max(0, start), min(stop, self.n)
        if start >= stop:
            return np.zeros(0, np.int64)
        block = start // self.STEP
        first = int(self.samples[block])
        last = -(-stop // self.STEP)
        end = int(self.samples[last]) if last < len(self.samples) else len(self.high) * 8
        ones = np.flatnonzero(np.unpackbits(self.high[first // 8 : end // 8 + 1], bitorder="little")) + first // 8 * 8
        ones = ones[ones >= first][start - block * self.STEP : stop - block * self.STEP]
        at = start * self.low_bits
        tail = np.unpackbits(self.low[at // 8 : -(-stop * self.low_bits // 8)], bitorder="little")[at % 8 :][: (stop - start) * self.low_bits]
        low = tail.reshape(stop - start, self.low_bits).astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits, dtype=np.int64))
        return ((ones - np.arange(start, stop)) << self.low_bits) | low


def pack_shard(doc_ids: list, arrays: list[np.ndarray]) -> bytes:
    """The bytes of a shard. Null ids come first, as in ascending order."""
    nulls = sum(d is None for d in doc_ids)
    known = np.array(doc_ids[nulls:], np.int64)
    base = int(known[0]) if len(known) else 0
    ends = EliasFano.encode(np.cumsum([len(a) for a in arrays], dtype=np.uint64)).to_bytes()
    ids = EliasFano.encode((known - base).astype(np.uint64)).to_bytes()
    tokens = np.concatenate(arrays) if arrays else np.zeros(0, "<u2")
    return _HEADER.pack(MAGIC, len(doc_ids), nulls, len(tokens), base, tokens.dtype.itemsize, len(ends), len(ids)) + ends + ids + tokens.tobytes()


class Shard:
    """A shard read back; offsets come from the boundaries' select structure."""

    def __init__(self, data: bytes):
        magic, self.n_docs, self.nulls, self.n_ids, self.base, width, ends, ids = _HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = _HEADER.size
        self.ends = EliasFano.from_bytes(data[at : at + ends])
        self.docs = EliasFano.from_bytes(data[at + ends : at + ends + ids])
        self.tokens = np.frombuffer(data, f"<u{width}", self.n_ids, at + ends + ids)

    def span(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def document(self, i: int) -> np.ndarray:
        start, end = self.span(i)
        return self.tokens[start:end]

    def documents(self, block: int = 1024) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start, ids) of every document, in order. Boundaries and ids come from the select structures, a block at a time."""
        before = 0
        for at in range(0, self.n_docs, block):
            ends = self.ends.select_range(at, at + block).tolist()
            known = self.docs.select_range(at - self.nulls, at + block - self.nulls).tolist()
            ids = [None] * (len(ends) - len(known)) + [x + self.base for x in known]
            for doc_id, end in zip(ids, ends, strict=True):
                yield doc_id, before, self.tokens[before:end]
                before = end


def ids_crc32(ids: np.ndarray) -> int:
    """crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_shards(docs: DataFrame, folder: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, shards: int | None = None, shard_ids: int = 8_000_000) -> DataFrame:
    """Encodes every whole text, ends each document with ``end_id`` and writes shards in ascending doc_id order.

    Returns the manifest, written to the shared folder: part, seq (their order), path, n_docs, n_ids.
    A task writes several shards when it has more than ``shard_ids`` ids or SHARD_DOCS documents, so that memory stays bounded.
    Rows that share a doc_id are ordered by a hash of their text, repeats by their place in the table, and spread
    by both. Null text counts as empty (the end id alone); null ids come first. ``folder`` is opened by
    pyarrow: a local or mounted path, file://, hdfs://, s3:// and gs:// work.
    """
    spark = docs.sparkSession

    def write(batches):
        encoder, part, seq = byte_level(tokenizer), TaskContext.get().partitionId(), 0
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        doc_ids, arrays, held = [], [], 0
        end = np.array([end_id], encoder.dtype)

        def flush():
            nonlocal doc_ids, arrays, held, seq
            path = f"{root}/{part:06d}-{seq:04d}-{uuid.uuid4().hex}.eft"
            with store.open_output_stream(path) as out:
                out.write(pack_shard(doc_ids, arrays))
            row = (part, seq, path, len(doc_ids), held)
            doc_ids, arrays, held, seq = [], [], 0, seq + 1
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["part", "seq", "path", "n_docs", "n_ids"])

        for batch in by_bytes(batches, 1):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.concatenate([encoder.encode(text), end]) if text else end
                doc_ids.append(doc_id)
                arrays.append(ids)
                held += len(ids)
                if held >= shard_ids or len(doc_ids) >= SHARD_DOCS:
                    yield flush()
        if doc_ids:
            yield flush()

    order = [F.col("doc_id"), F.xxhash64("text"), F.col("tag")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("tag"))
    rows = rows.repartitionByRange(shards or shuffle_partitions(spark), *order).sortWithinPartitions(*order).select("doc_id", "text")
    return stored(rows.transform(map_arrow, write, "part long, seq long, path string, n_docs long, n_ids long"), "token-manifest")


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files that the manifest lists.

    The manifest has a row for each shard of about ``shard_ids`` ids; their running total is one window, which bears
    some million shards, that is 10^13 ids.
    """
    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard, not per document
    placed = manifest.select("path", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("base"))

    def read(batches):
        store, _ = _store(folder)
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_stream(path) as f:
                    shard = Shard(f.read())
                rows = ((doc_id, start + base, len(ids), ids_crc32(ids)) for doc_id, start, ids in shard.documents())
                while some := list(islice(rows, READ_DOCS)):
                    columns = zip(*some, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.repartition(shuffle_partitions(manifest.sparkSession)).transform(map_arrow, read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_shards(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0) -> DataFrame:
    """Writes the shards to a new shared folder and returns what their files hold.

    Null text counts as empty; null ids come first; repeated rows are documents of their own; other
    columns are ignored; an empty table writes no shard and gives no rows.
    """
    folder = f"{shared_dir(docs.sparkSession)}/token-shards-{uuid.uuid4().hex}"
    return read_shards(write_shards(docs, folder, tokenizer, end_id), folder)
