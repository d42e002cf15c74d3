"""Sharding along a Hilbert curve, with DataFrame functions only.

Several metadata dimensions are quantised to BITS bits each, in order: numbers by their quantiles, strings by the
quantiles of their first six bytes as a number. The curve index of the cell orders the documents, and runs of that order are cut into shards, so
each shard (and each file of it) covers a compact box of the metadata and can be skipped by its
column statistics. The order is total, so shard sizes are exact: the law is ``rows``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, staged

BITS = 5


def hilbert_index(dims: list[Column], bits: int = BITS) -> Column:
    """The place on the curve of a cell given by integer columns of 0 to 2**bits - 1 (transpose form of the
    curve: undo excess work bit by bit, then Gray-encode, then interleave)."""
    n = len(dims)
    steps = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def undo(x: Column, step: Column) -> Column:
        low, own = step["q"] - 1, F.get(x, step["i"])
        swap = (F.get(x, F.lit(0)).bitwiseXOR(own)).bitwiseAND(low)
        invert = own.bitwiseAND(step["q"]) != 0
        first = F.get(x, F.lit(0))
        moved = F.transform(x, lambda v, j: F.when(j == step["i"], v.bitwiseXOR(swap)).otherwise(v))
        swapped = F.transform(moved, lambda v, j: F.when((j == 0) & (step["i"] != 0), first.bitwiseXOR(swap)).otherwise(v))
        inverted = F.transform(x, lambda v, j: F.when(j == 0, v.bitwiseXOR(low)).otherwise(v))
        return F.when(invert, inverted).otherwise(swapped)

    x = F.aggregate(steps, F.array(*[d.cast("int") for d in dims]), undo)
    # Gray: a running XOR over the dimensions, then the last one's high bits flip what is below
    gray = F.aggregate(F.sequence(F.lit(1), F.lit(n - 1)), x, lambda a, i: F.transform(a, lambda v, j: F.when(j == i, v.bitwiseXOR(F.get(a, i - 1))).otherwise(v))) if n > 1 else x
    flips = F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)])
    turned = F.transform(F.array(gray), lambda g: F.struct(g.alias("g"), F.aggregate(flips, F.lit(0), lambda t, q: F.when(F.get(g, F.lit(n - 1)).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t)).alias("t")))[0]
    places = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(1 << b).alias("q")) for b in range(bits - 1, -1, -1) for i in range(n)])
    bit = lambda o, p: F.when(F.get(o["g"], p["i"]).bitwiseXOR(o["t"]).bitwiseAND(p["q"]) != 0, F.lit(1)).otherwise(F.lit(0))
    return F.transform(F.array(turned), lambda o: F.aggregate(places, F.lit(0).cast("long"), lambda acc, p: acc * 2 + bit(o, p)))[0]


def ordered(df: DataFrame, dim: str) -> Column:
    """A dimension as a number in its own order; a string by its first six bytes, which a double holds exactly."""
    if dict(df.dtypes)[dim] != "string":
        return F.col(dim).cast("double")
    head = F.rpad(F.hex(F.substring(F.col(dim).cast("binary"), 1, 6)), 12, "0")
    return F.conv(head, 16, 10).cast("double")


def quantised(df: DataFrame, dims: list[str], bits: int = BITS) -> list[Column]:
    """Each dimension as 0 to 2**bits - 1, in its order; null is 0. Quantiles are taken over all rows; a dimension of few values is
    spread over all cells, so that it counts in the curve's first bits as others do."""
    top, out = 1 << bits, []
    at = F.array(*[F.lit(k / top) for k in range(1, top)])
    cuts = df.agg(*[F.percentile_approx(ordered(df, d), at, 10_000).alias(d) for d in dims]).first()  # 2**bits - 1 numbers a dimension
    for d in dims:
        bounds = sorted(set(cuts[d] or []))
        below = F.size(F.filter(F.array(*[F.lit(float(c)) for c in bounds]).cast("array<double>"), lambda c: c < ordered(df, d)))
        cell = F.floor(below * (top - 1) / max(len(bounds), 1)).cast("int")
        out.append(F.coalesce(F.when(F.col(d).isNotNull(), cell), F.lit(0)))
    return out


def skipped(sharded: DataFrame, dims: list[str]) -> DataFrame:
    """sharded: shard and the dimensions -> dim, share: how many of the shards a lookup of one row's value can skip by the shards' smallest
    and largest values, over all rows."""
    rows = sharded.select("shard", *[ordered(sharded, d).alias(d) for d in dims])
    boxes = rows.groupBy("shard").agg(*[f(d).alias(f"{d}_{n}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))]).collect()  # one row a shard
    out_of = lambda d: sum((F.when((F.col(d) < b[f"{d}_lo"]) | (F.col(d) > b[f"{d}_hi"]), 1).otherwise(0) if b[f"{d}_lo"] is not None else F.lit(1) for b in boxes), F.lit(0)) / max(len(boxes), 1)
    each = rows.agg(*[F.avg(F.when(F.col(d).isNotNull(), out_of(d))).alias(d) for d in dims])
    return each.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("share")) for d in dims])).alias("x")).select("x.*")


def _placed(docs: DataFrame, dims: tuple[str, ...], shards: int, bits: int, carry: bool = False) -> DataFrame:
    """Every row of ``docs`` with its place; carry: with all its columns as ``__row``, and rows that repeat told apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    wanted = {"doc_id": "long", "text": "string", "lang": "string", "source": "string"}
    carried = [F.struct(*[column(docs, n) for n in docs.columns]).alias("__row"), F.monotonically_increasing_id().alias("__at")] if carry else []
    rows = docs.select(*[column(docs, n).cast(t).alias(n) for n, t in wanted.items()], *carried)
    own = ["__row", "__at"] if carry else []
    rows = rows.select("doc_id", "lang", "source", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *own)
    cells = quantised(rows, list(dims), bits)
    # the curve index leads, 32 bits of hash follow: no key is frequent, however many rows share a cell
    tie = F.xxhash64("doc_id", "text_crc32").bitwiseAND(F.lit(0xFFFFFFFF))
    keyed = rows.withColumn("curve", hilbert_index(cells, bits)).withColumn("key", F.shiftleft("curve", 32) + tie)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "doc_id", "text_crc32", *own[1:]]
    dealt = staged(keyed.repartitionByRange(parts, *order).withColumn("run", F.spark_partition_id()).drop("lang", "source"))
    # one row a run, not the documents: what a running total over runs needs
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("run").agg(F.count(F.lit(1)).alias("rows")).withColumn("first", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    total = dealt.count()
    rank = F.col("first") + F.row_number().over(Window.partitionBy("run").orderBy(*order)) - 1
    ranked = dealt.join(counts, "run").withColumn("rank", rank)
    cut = ranked.withColumn("shard", F.expr(f"rank * {shards} div {max(total, 1)}").cast("int"))
    begin = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    return cut.withColumn("slot", F.col("rank") - begin)


def shard(docs: DataFrame, dims: tuple[str, ...] = ("size", "lang", "source"), shards: int = 8, bits: int = BITS) -> DataFrame:
    """Every row of ``docs`` (doc_id, text, lang, source) with its shard: doc_id, size, text_crc32, law, shard,
    slot, grown_shard, curve.

    size: UTF-8 bytes of the text (null: none) plus 1. Shards hold floor or ceil of rows / shards rows, in
    curve order (ties: by a hash of doc_id, then doc_id, then the text's checksum); slots are gapless from 0.
    Null metadata is cell 0; rows may repeat; other columns are not read; an empty table gives no row.
    """
    placed = _placed(docs, dims, shards, bits)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def write_shards(docs: DataFrame, path: str, dims: tuple[str, ...] = ("size", "lang", "source"), shards: int = 8, bits: int = BITS) -> None:
    """``docs``, with all columns, as Parquet by the shards that ``shard`` gives, each in slot order. Rows carry their
    columns to their place, so null ids and rows that repeat are written as they are counted. ``docs`` has no column ``shard``."""
    if "shard" in map(str.lower, docs.columns):
        raise ValueError("shard is the name of the written partitions")
    placed = _placed(docs, dims, shards, bits, carry=True)
    rows = placed.select(*[F.col("__row")[n].alias(n) for n in docs.columns], "shard", F.col("slot").alias("__slot"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(parts, "shard", "__slot").sortWithinPartitions("shard", "__slot").drop("__slot").write.partitionBy("shard").parquet(path)
