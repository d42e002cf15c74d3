"""Exact dedup over a log-structured merge index of digests.

Memtables take digests in the order rows come, fold repeats, and flush sorted runs, one file each. Compaction merges
all runs into level 1: runs that split the digests by their first bits, each one file with one entry for each digest and
a Bloom filter of those that more than one row has. A lookup goes to the one run that can have its digest; what the filter
rules out is a text of its own and needs no search, the rest is found by binary search. The rows of a run that many
lookups meet are dealt over several tasks. Each hit is verified byte by byte against the text that stays; where bytes
differ (a digest collision) texts are grouped as they are instead.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, HOT_SHARE, SALTS, ascii_lower, column, filesystem, fresh, narrow, read_blobs, shared_dir, small_batches, spread_join, staged, write_blob

#: Entries of a memtable; it is flushed as a sorted run beyond that. A level-1 run has about as many.
MEMTABLE_ROWS = 50_000
#: Bits of the filter for an entry, and digest words that it looks at.
FILTER_BITS, FILTER_WORDS = 16, 4
MAGIC = b"CWRUN001"
_HEADER = struct.Struct("<8sqq")
_ENTRY = np.dtype([("digest", "S32"), ("known", "?"), ("doc_id", "<i8"), ("row", "<i8"), ("copies", "<i8")])


def _normal(docs: DataFrame) -> DataFrame:
    text = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    return docs.select("doc_id", text.alias("text"))


class Run:
    """A sorted run of entries with a filter of the digests that several rows have."""

    def __init__(self, entries: np.ndarray, bits: np.ndarray):
        self.entries, self.bits, self.keys = entries, bits, np.ascontiguousarray(entries["digest"])

    @classmethod
    def of(cls, entries: np.ndarray) -> "Run":
        entries = entries[np.argsort(entries["digest"], kind="stable")]
        shared = entries["digest"][entries["copies"] > 1]
        bits = np.zeros(max(8, 1 << (len(shared) * FILTER_BITS).bit_length() >> 3), np.uint8)
        at = _places(shared, len(bits)).ravel()
        np.bitwise_or.at(bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        return cls(entries, bits)

    def dump(self) -> list[bytes]:
        return [_HEADER.pack(MAGIC, len(self.entries), len(self.bits)), self.entries.tobytes(), self.bits.tobytes()]

    @classmethod
    def load(cls, blob: bytes) -> "Run":
        magic, n, size = _HEADER.unpack_from(blob)
        if magic != MAGIC:
            raise ValueError("not a run")
        return cls(np.frombuffer(blob, _ENTRY, n, _HEADER.size), np.frombuffer(blob, np.uint8, size, _HEADER.size + n * _ENTRY.itemsize))

    def may_share(self, digests: np.ndarray) -> np.ndarray:
        at = _places(digests, len(self.bits))
        return ((self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)

    def find(self, digests: np.ndarray) -> np.ndarray:
        """The entries' numbers; every digest is there."""
        at = np.searchsorted(self.keys, digests)
        if len(at) and (at.max() >= len(self.keys) or (self.keys[at] != digests).any()):
            raise ValueError("a digest that no run has")
        return at


def _places(digests: np.ndarray, size: int) -> np.ndarray:
    words = np.frombuffer(np.ascontiguousarray(digests).tobytes(), "<u4").reshape(-1, 8)[:, :FILTER_WORDS]
    return (words & np.uint32(size * 8 - 1)).astype(np.int64)


def _entries(rows: list[tuple]) -> np.ndarray:
    """rows: (digest, doc_id or None, row, copies)."""
    out = np.zeros(len(rows), _ENTRY)
    for k, (digest, doc, row, copies) in enumerate(rows):
        out[k] = (digest, doc is not None, doc or 0, row, copies)
    return out


def _flush(batches: Iterator, folder: str) -> Iterator:
    """Folds (digest, doc_id, row) into memtables; each full one becomes the file of a sorted run. The entry of the largest
    (doc_id, row) stays; a null doc_id is smaller than any other."""
    import pyarrow as pa

    part, out, table = TaskContext.get().partitionId(), [], {}

    def flush() -> None:
        run = Run.of(_entries([(key, doc, row, copies) for key, (_, doc, row, copies) in table.items()]))
        out.append({"path": write_blob(folder, f"level0-{part:06d}-{len(out):04d}", run.dump()), "entries": len(table)})
        table.clear()

    for b in batches:
        for key, doc, row in zip(b["digest"].to_pylist(), b["doc_id"].to_pylist(), b["row"].to_pylist()):
            entry = (doc is not None, doc, row, 1)
            if (old := table.get(key)) is not None:
                best = max(old[:3], entry[:3], key=lambda x: (x[0], x[1] or 0, x[2]))
                entry = (*best, old[3] + 1)
            table[key] = entry
        if len(table) >= MEMTABLE_ROWS:
            flush()
    if table:
        flush()
    yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("path", pa.string()), ("entries", pa.int64())]))


_ENTRIES = "digest binary, doc_id long, row long, copies long"
_LEVEL1 = "run long, path string, entries long, n long"


def _run_rows(blob: bytes) -> Iterator:
    """A run's entries as rows."""
    import pyarrow as pa

    e = Run.load(blob).entries
    raw = e["digest"].tobytes()
    digests = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(e), [None, pa.py_buffer(raw)]).cast(pa.binary())
    yield pa.RecordBatch.from_arrays([digests, pa.array(e["doc_id"], mask=~e["known"]), pa.array(e["row"]), pa.array(e["copies"])], ["digest", "doc_id", "row", "copies"])


def _merge(batches: Iterator, folder: str) -> Iterator:
    """Entries sorted by run -> one file a run."""
    import pyarrow as pa

    now, held = None, []
    schema = pa.schema([("run", pa.int64()), ("path", pa.string()), ("entries", pa.int64()), ("n", pa.int64())])

    def close() -> pa.RecordBatch:
        path = write_blob(folder, f"level1-{now:08d}", Run.of(_entries(held)).dump())
        return pa.RecordBatch.from_pylist([{"run": now, "path": path, "entries": len(held), "n": sum(h[3] for h in held)}], schema=schema)

    for b in batches:
        for run, *entry in zip(*(b[c].to_pylist() for c in ("run", "digest", "doc_id", "row", "copies"))):
            if run != now:
                if held:
                    yield close()
                now, held = run, []
            held.append(tuple(entry))
    if held:
        yield close()


def _probe(batches: Iterator) -> Iterator:
    """Rows that follow the file of their run -> what the index says of each."""
    import pyarrow as pa

    run = None
    for b in batches:
        paths = b["path"].to_pylist()
        cuts = [i for i, p in enumerate(paths) if p is not None]
        for start, end in zip([0, *cuts], [*cuts, len(paths)]):
            if start < len(paths) and paths[start] is not None:
                fs, path = filesystem(paths[start])
                with fs.open_input_stream(path, compression=None) as f:
                    run = Run.load(f.read())
                start += 1
            if start >= end:
                continue
            part = b.slice(start, end - start)
            digests = np.array(part["digest"].to_pylist(), "S32")
            doc, row = part["doc_id"], np.asarray(part["row"])
            known = np.asarray(doc.is_valid())
            keep, keep_known, kept, size = np.asarray(doc.fill_null(0)).copy(), known.copy(), np.ones(len(row), bool), np.ones(len(row), np.int64)
            may = np.flatnonzero(run.may_share(digests))  # what the filter rules out is alone with its text
            e = run.entries[run.find(digests[may])]
            keep[may], keep_known[may], size[may], kept[may] = e["doc_id"], e["known"], e["copies"], e["row"] == row[may]
            yield pa.RecordBatch.from_arrays([part["digest"], doc, pa.array(keep, mask=~keep_known), pa.array(size), pa.array(kept)], ["digest", "doc_id", "keep_id", "group_size", "kept"])


class MergeIndex:
    """The index in a folder of the shared store: ``append`` adds runs, ``compact`` merges them, ``lookup`` asks them."""

    def __init__(self, spark, path: str | None = None):
        self.spark, self.path, self.level0, self.level1, self.runs = spark, path or shared_dir(spark), None, None, 0

    def append(self, digests: DataFrame) -> None:
        """digests: digest binary (32 bytes), doc_id long, row long (a number of its own for each row)."""
        folder = self.path
        new = staged(digests.select("digest", "doc_id", "row").mapInArrow(lambda b: _flush(b, folder), "path string, entries long"))
        self.level0 = new if self.level0 is None else self.level0.union(new)

    def _run(self) -> Column:
        """The level-1 run of a digest, by its first 32 bits."""
        first = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
        return F.shiftright(first * self.runs, 32)

    def compact(self) -> DataFrame:
        """Merges the runs of level 0 (and what level 1 has) into a new level 1; returns its manifest."""
        sources = self.level0.select("path") if self.level1 is None else self.level0.select("path").union(self.level1.select("path"))
        total = self.level0.agg(F.sum("entries")).first()[0] or 0
        last = F.max(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "row")).alias("last")
        merged = read_blobs(sources, _run_rows, _ENTRIES).groupBy("digest").agg(last, F.sum("copies").alias("copies"))
        if self.level1 is not None:
            total += self.level1.agg(F.sum("entries")).first()[0] or 0
        parts, folder = int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.path
        self.runs = max(parts, -(-total // MEMTABLE_ROWS))
        entries = merged.select(self._run().alias("run"), "digest", "last.doc_id", "last.row", "copies").repartition(parts, "run").sortWithinPartitions("run", "digest")
        self.level1, self.level0 = staged(entries.mapInArrow(lambda b: _merge(b, folder), _LEVEL1)), None
        return self.level1

    def entries(self) -> DataFrame:
        """digest, doc_id, row, copies: of each digest the entry that stays, and how many rows have it."""
        return read_blobs(self.level1.select("path"), _run_rows, _ENTRIES)

    def lookup(self, rows: DataFrame) -> DataFrame:
        """rows: as appended -> digest, doc_id, keep_id, group_size, kept."""
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        total = self.level1.agg(F.sum("n")).first()[0] or 0
        hot = [r.run for r in self.level1.where(F.col("n") >= max(HOT_ROWS, total // HOT_SHARE, 2 * (total // max(self.runs, 1)))).select("run").limit(HOT_SHARE).collect()]
        salt = F.when(F.col("run").isin(hot), F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).otherwise(0) if hot else F.lit(0)
        salts = F.when(F.col("run").isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))) if hot else F.array(F.lit(0))
        asked = rows.select(self._run().alias("run"), F.lit(None).cast("string").alias("path"), "digest", "doc_id", "row").withColumn("salt", salt)
        files = self.level1.select("run", "path", F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("row"), F.explode(salts).alias("salt"))
        dealt = asked.unionByName(files).repartition(parts, "run", "salt").sortWithinPartitions("run", "salt", F.col("path").isNull())
        return dealt.mapInArrow(_probe, "digest binary, doc_id long, keep_id long, group_size long, kept boolean")


def exact_groups(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with its group of equal texts.

    Equal: identical after lower-casing A-Z; a null text counts as empty. The row with the largest
    doc_id stays; a null doc_id is smaller than all others; of repeated rows (same doc_id, same text)
    one stays. Other columns are not read. An empty table gives an empty result.
    Returns doc_id, keep_id, group_size, kept, text_sha256 (lower-case hex).
    """
    spark = docs.sparkSession
    small_batches(spark)
    normal = _normal(narrow(docs, doc_id="long", text="string"))
    hashed = F.unhex(F.sha2("text", 256))
    rows = staged(normal.select("doc_id", hashed.alias("digest"), F.monotonically_increasing_id().alias("row")))
    index = MergeIndex(spark)
    index.append(rows)
    index.compact()

    shared = staged(index.entries().where("copies > 1").select("digest", F.col("doc_id").alias("keep_id"), F.col("copies").alias("n")))
    hits = staged(spread_join(normal.withColumn("digest", hashed), shared.select("digest", "keep_id"), "digest", shared))
    kept_text = hits.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.min("text").alias("kept_text"))
    differ = spread_join(hits.select("digest", "text"), kept_text, "digest", shared).where("text != kept_text")
    if not differ.isEmpty():
        return _by_text(normal)  # two texts with one SHA-256: group on the bytes themselves
    found = index.lookup(rows)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def _by_text(normal: DataFrame) -> DataFrame:
    """The exact way for a collision of digests: groups are the texts themselves."""
    rows = staged(normal.withColumn("row", F.monotonically_increasing_id()))
    last = F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "row")
    groups = rows.groupBy("text").agg(F.max(last).alias("last"), F.count(F.lit(1)).alias("group_size"))
    return rows.join(groups, "text").select(
        "doc_id", F.col("last.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("last.row")).alias("kept"), F.sha2("text", 256).alias("text_sha256")
    )


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all columns, less those whose text a row with a larger doc_id has."""
    groups = staged(exact_groups(docs))
    names = docs.columns
    own_id, own_digest = fresh(docs, "id"), fresh(docs, "digest")
    digest = F.sha2(ascii_lower(F.coalesce(column(docs, "text").cast("string"), F.lit(""))), 256)
    marked = docs.select(*[column(docs, n) for n in names], column(docs, "doc_id").cast("long").alias(own_id), digest.alias(own_digest))
    gone = groups.where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("doc_id", "text_sha256").distinct()
    left = marked.join(gone, marked[own_id].eqNullSafe(gone["doc_id"]) & (marked[own_digest] == gone["text_sha256"]), "left_anti")
    again = groups.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("doc_id", "text_sha256").count().where("count > 1")
    if not again.isEmpty():  # repeated rows
        left = left.dropDuplicates([own_id, own_digest])
    return left.select(*[column(left, n) for n in names])
