"""Shared plumbing of the training-data operators: input projection, staging, blob files."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.session import ARROW_BYTES, shared_dir, ship, small_batches  # noqa: F401  for the operators
from causeway.session import stored as staged  # noqa: F401

def column(df: DataFrame, name: str) -> Column:
    """A column by name, also where the name has dots; a repeated name is an error of the caller."""
    return df["`" + name.replace("`", "``") + "`"]


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def narrow(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the wanted columns, as name=type, cast; other columns can't clash with working names."""
    return df.select(*[column(df, n).cast(t).alias(n) for n, t in wanted.items()])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Pure ASCII texts take the JVM's fast path."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))


#: Up to so many hashes of the smaller side of a join a bitmap of their low bits goes to the tasks of the other side (16 bits a hash), so that
#: most rows without a partner aren't shuffled; beyond that all are, and the join alone decides. Results are the same.
FILTER_HASHES = 4_000_000


def bitmap_of(df: DataFrame, name: str):
    """The low bits of a column of 64-bit hashes, or None for more than FILTER_HASHES rows. Tasks make bitmaps of their rows, which are merged."""
    import numpy as np

    n = df.count()
    if n > FILTER_HASHES:
        return None
    size = max(1 << 10, 1 << (2 * n).bit_length())

    def mark(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bits = np.zeros(size, np.uint8)
        for b in batches:
            low = np.asarray(b[name]).astype(np.uint64) & np.uint64(size * 8 - 1)
            np.bitwise_or.at(bits, (low >> np.uint64(3)).astype(np.int64), np.uint8(1) << (low & np.uint64(7)).astype(np.uint8))
        yield pa.RecordBatch.from_pydict({"bits": pa.array([bits.tobytes()], pa.binary())})

    out = np.zeros(size, np.uint8)
    for r in df.select(name).coalesce(4).mapInArrow(mark, "bits binary").collect():  # four bitmaps at most
        out |= np.frombuffer(r.bits, np.uint8)
    return out


def in_bitmap(bits, value: Column) -> Column:
    """Whether a bitmap has the low bits of a 64-bit hash. Only hashes go to Python."""
    import numpy as np
    import pandas as pd

    def test(hashes: pd.Series) -> pd.Series:
        low = hashes.to_numpy(np.int64).astype(np.uint64) & np.uint64(len(bits) * 8 - 1)
        return pd.Series((bits[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8)) & 1 == 1)

    test.__annotations__ = {"hashes": pd.Series, "return": pd.Series}
    return F.pandas_udf(test, "boolean")(value)


#: A key is frequent from this part of all rows on, so there are no more frequent keys than that; their rows go to so many tasks.
HOT_SHARE, HOT_ROWS, SALTS = 1000, 100, 64


def spread_join(many: DataFrame, one: DataFrame, key: str, counts: DataFrame) -> DataFrame:
    """many.join(one, key), where ``one`` has one row for a key. The rows of frequent keys are dealt over SALTS tasks, and the
    frequent keys' rows of ``one`` go to each. counts: the key, n (rows of ``many`` with it). Key columns hold no null."""
    spark = many.sparkSession
    counts = counts.select(key, "n")
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") >= max(HOT_ROWS, total // HOT_SHARE)).select(key).limit(HOT_SHARE).collect()  # by their share no more than that
    if not hot:
        return many.join(one, key)
    mark = F.broadcast(spark.createDataFrame(hot, counts.select(key).schema).withColumn("__hot", F.lit(True)))
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(*[column(many, c) for c in many.columns]), F.lit(SALTS)).cast("int")).otherwise(0)
    dealt = many.join(mark, key, "left").withColumn("__salt", salt).drop("__hot")
    every = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    sent = one.join(mark, key, "left").withColumn("__salt", F.explode(every)).drop("__hot")
    return dealt.join(sent, [key, "__salt"]).drop("__salt")


def filesystem(uri: str):
    """pyarrow's filesystem and path of a Hadoop-style URI (file:, hdfs:, s3: and the like)."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def write_blob(folder: str, name: str, parts: Iterable[bytes]) -> str:
    """Writes a file under a name that no other task attempt uses; only the manifest makes it count."""
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    name = f"{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(f"{path}/{name}", compression=None) as out:
        for p in parts:
            out.write(p)
    return f"{folder}/{name}"


def read_blobs(manifest: DataFrame, parse: Callable[..., Iterator], schema: str) -> DataFrame:
    """The files that a manifest names (column ``path``), each read whole by one task, one at a time. ``parse`` gets
    a file and the manifest's other columns and gives Arrow batches. Neither names nor data pass the driver."""
    others = [c for c in manifest.columns if c != "path"]

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            for uri, *own in zip(*(b[c].to_pylist() for c in ("path", *others))):
                fs, path = filesystem(uri)
                with fs.open_input_stream(path, compression=None) as f:
                    blob = f.read()
                yield from parse(blob, *own)

    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path", *others).repartition(parts, "path").mapInArrow(run, schema)


_CACHES: dict[str, Callable[[], None]] = {}


def keep_only(name: str, clear: Callable[[], None] = lambda: None) -> None:
    """A worker serves one operator after the other; when another one begins, what the last kept is let go."""
    for other in [n for n in _CACHES if n != name]:
        _CACHES.pop(other)()
    _CACHES[name] = clear
