"""Token-id files: one array of ids, and document boundaries in Elias-Fano code.

A file holds the ids of consecutive documents (ascending doc_id) as unsigned integers of 16 bits, or of 32
for a vocabulary of more than 65,536. The
n + 1 boundaries are split into low bits, packed, and high bits, in unary, with the place of every
64th one sampled, so a boundary is found in constant time from about 2 + log2(ids / documents) bits
a document instead of a 64-bit table.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import narrow, read_blobs, shared_dir, small_batches, staged, write_blob
from .tokens import encoder

MAGIC = b"CWTOKEN2"
#: A file is closed beyond so many bytes of ids.
FILE_BYTES = 16 << 20
SAMPLE = 64
_HEADER = struct.Struct("<8sqqqqqqq")
#: Of each byte: its one bits, and the place of the k-th of them.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_ONES = _BITS.sum(axis=1).astype(np.int64)
_PLACE = np.argsort(1 - _BITS, axis=1, kind="stable")


class EliasFano:
    """A monotone sequence of non-negative integers with random access."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.width, self.low, self.high, self.samples = n, width, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> "EliasFano":
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        bits = (values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        at = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        high[at] = 1
        return cls(n, width, low, np.packbits(high, bitorder="little"), at[::SAMPLE].astype(np.uint64))

    def _low(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        for b in range(self.width):
            k = i * self.width + b
            out |= ((self.low[k >> 3] >> (k & 7).astype(np.uint8)) & 1).astype(np.int64) << b
        return out

    def select(self, i: np.ndarray) -> np.ndarray:
        """The values with numbers i: each from its sampled place on, over whole bytes, to its one bit."""
        i = np.asarray(i, np.int64)
        at, left = self.samples[i // SAMPLE].astype(np.int64), i % SAMPLE
        byte = at >> 3
        bits = self.high[byte] & (0xFF << (at & 7)).astype(np.uint8)
        far = np.arange(len(i))
        while len(far := far[left[far] >= _ONES[bits[far]]]):  # those whose bit is in a later byte
            left[far] -= _ONES[bits[far]]
            byte[far] += 1
            bits[far] = self.high[byte[far]]
        return ((byte * 8 + _PLACE[bits, left] - i) << self.width) | self._low(i)


def dump(doc_ids: list, bounds: np.ndarray, ids: list[bytes], width: int, part: int, seq: int) -> list[bytes]:
    """The parts of a file; ids: each document's as little-endian integers of width bytes."""
    ef = EliasFano.encode(bounds)
    known = np.packbits(np.array([d is not None for d in doc_ids], np.uint8), bitorder="little").tobytes()
    names = np.array([d or 0 for d in doc_ids], "<i8").tobytes()
    head = _HEADER.pack(MAGIC, part, seq, len(doc_ids), ef.width, len(ef.low), len(ef.high), width)
    return [head, known, names, ef.low.tobytes(), ef.high.tobytes(), ef.samples.astype("<u8").tobytes(), *ids]


def load(blob: bytes) -> tuple[int, int, list, EliasFano, np.ndarray]:
    """part, seq, doc_ids, boundaries, and all ids."""
    magic, part, seq, n, width, lows, highs, id_bytes = _HEADER.unpack_from(blob)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = _HEADER.size

    def take(size: int, kind: str) -> np.ndarray:
        nonlocal at
        at += size
        return np.frombuffer(blob, kind, size // np.dtype(kind).itemsize, at - size)

    known = np.unpackbits(take((n + 7) // 8, "u1"), bitorder="little")[:n]
    names = take(8 * n, "<i8")
    low, high, samples = take(lows, "u1"), take(highs, "u1"), take(8 * (-(-(n + 1) // SAMPLE)), "<u8")
    ids = [int(d) if k else None for d, k in zip(names, known)]
    return part, seq, ids, EliasFano(n + 1, width, low, high, samples), np.frombuffer(blob, f"<u{id_bytes}", -1, at)


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, folder: str) -> DataFrame:
    """Encodes whole texts in ascending doc_id order into token files; returns the staged manifest
    (path, part, seq, n_docs, n_ids). A null text is empty; null doc_ids come first; rows with one
    doc_id follow the hash of their text. An empty table gives no file."""
    small_batches(docs.sparkSession)
    end = struct.pack("<I", end_id)

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa

        enc, part = encoder(tokenizer, "byte"), TaskContext.get().partitionId()
        width = 2 if max(enc.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        out, names, ids, bounds, seq = [], [], [], [np.zeros(1, np.int64)], 0

        def close() -> None:
            nonlocal names, ids, bounds, seq
            at = np.concatenate(bounds)
            path = write_blob(folder, f"tokens-{part:06d}-{seq:04d}", dump(names, at, ids, width, part, seq))
            out.append((path, part, seq, len(names), int(at[-1])))
            names, ids, bounds, seq = [], [], [np.zeros(1, np.int64)], seq + 1

        for b in batches:
            got = enc.encode(b["text"].to_pylist())
            names += b["doc_id"].to_pylist()
            ids.append(np.frombuffer(end.join([*got, b""]), "<u4").astype(f"<u{width}").tobytes())
            bounds.append(bounds[-1][-1] + np.cumsum(np.fromiter(map(len, got), np.int64, len(got)) // 4 + 1))
            if bounds[-1][-1] * width >= FILE_BYTES:
                close()
        if names:
            close()
        yield pa.RecordBatch.from_pylist([dict(zip(("path", "part", "seq", "n_docs", "n_ids"), x)) for x in out], schema=pa.schema([("path", pa.string()), *[(c, pa.int64()) for c in ("part", "seq", "n_docs", "n_ids")]]))

    rows = narrow(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("tie", F.xxhash64("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return staged(ordered.mapInArrow(write, "path string, part long, seq long, n_docs long, n_ids long"))


def _based(manifest: DataFrame) -> DataFrame:
    """The manifest with each file's base: the ids of all files before it. One row a file, in one task a row a part."""
    before = lambda by: by.rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    parts = parts.select("part", F.coalesce(F.sum("ids").over(before(Window.orderBy("part"))), F.lit(0)).alias("first"))
    own = F.coalesce(F.sum("n_ids").over(before(Window.partitionBy("part").orderBy("seq"))), F.lit(0))
    return manifest.join(parts, "part").select("path", (F.col("first") + own).alias("base"))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32, part, seq (the file), position in it."""

    def parse(blob: bytes, base: int) -> Iterator:
        import pyarrow as pa

        part, seq, ids, ef, data = load(blob)
        n = len(ids)
        at, raw = ef.select(np.arange(n + 1)), memoryview(data.astype("<u4").tobytes())
        crc = [zlib.crc32(raw[s:e]) for s, e in zip((4 * at[:-1]).tolist(), (4 * at[1:]).tolist())]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(base + at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64()), pa.array(np.full(n, part)), pa.array(np.full(n, seq)), pa.array(np.arange(n))],
            ["doc_id", "start", "n_tokens", "ids_crc32", "part", "seq", "position"],
        )

    return read_blobs(_based(manifest), parse, "doc_id long, start long, n_tokens long, ids_crc32 long, part long, seq long, position long")


def token_store(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Writes ``docs`` (doc_id, text) as token files and reads them back."""
    return read_tokens(write_tokens(docs, tokenizer, end_id, folder or shared_dir(docs.sparkSession)))
