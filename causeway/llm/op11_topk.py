"""Exact top-k search by columnar branch-and-bound.

Vectors are quantised to whole numbers and stored in blocks with a vertical layout: the dimensions, those with most mass
first, are cut into slices, and a block holds one slice after the other. A task gets a block of queries and then, one at a
time, blocks of candidates. Partial inner products are added up slice by slice. After each slice the lengths of what is left
of both vectors bound the rest (Cauchy-Schwarz); pairs that can't reach the query's k-th best score so far are dropped and
the survivors compacted, so that later slices are read for them only. Nothing is estimated: the result is exact.

The stated queries meet all rows in blocks. Query blocks are sent to each stripe of the candidates and candidate blocks to each
group of queries, whichever is needed to fill the tasks; the k best of each stripe are merged at the end.

Defined results: null vectors, vectors with a null or non-finite component and rows without an id take no part. A shorter vector counts
as filled up with zeros, so an empty one has score 0 with all. Rows with the query's id are its own rows; other
repeated ids are candidates each. Equal rows of a query are asked once; rows of one query id with different vectors are asked
each. Ties go to the smaller id. An empty table gives no rows. A score that can't fit 64 bits is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import narrow, small_batches, staged

#: Whole numbers for each unit of a component.
SCALE = 256
#: Numbers held by a block, so that blocks are of equal bytes at any dimension; queries compared at a time; slices of the dimensions.
BLOCK_NUMBERS, QUERIES_AT_ONCE, SLICES = 1 << 18, 256, 8
#: From this part of survivors on a slice is added for all pairs as a matrix product, below it for the compacted survivors.
DENSE = 0.1


def top_k(rows: DataFrame, k: int = 5, every: int = 50, scale: int = SCALE) -> DataFrame:
    """rows (vec_id, embedding) -> query_id, rank, vec_id, score: the k best of each row whose id is divisible by ``every``."""
    spark = rows.sparkSession
    small_batches(spark)
    sound = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = narrow(rows, vec_id="long", embedding="array<double>").where(F.col("vec_id").isNotNull() & sound)
    facts = _facts(rows, scale)
    if not facts["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if facts["dims"] * facts["most"] ** 2 >= 2**63:
        raise ValueError(f"inner products of {facts['dims']} components up to {facts['most']:.0f} don't fit 64 bits")
    exact = "f8" if facts["dims"] * facts["most"] ** 2 < 2**53 else "i8"
    per_block = max(16, BLOCK_NUMBERS // max(1, facts["dims"]))
    pack = _packer(facts["order"], scale, per_block, exact)
    block = "number long, n int, ids binary, cells binary"
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).distinct()
    queries, candidates = staged(asked.mapInArrow(pack, block)), staged(rows.mapInArrow(pack, block))
    n_queries = queries.agg(F.sum("n")).first()[0] or 0
    groups = max(1, -(-n_queries // (4 * per_block)))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stripes = max(1, -(-tasks // groups))
    dealt = lambda n: F.pmod(F.xxhash64("number", "ids"), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select(dealt(groups).alias("g"), all_of(stripes).alias("s"), F.lit(0).alias("kind"), "number", "n", "ids", "cells")
    given = candidates.select(all_of(groups).alias("g"), dealt(stripes).alias("s"), F.lit(1).alias("kind"), "number", "n", "ids", "cells")
    cells = asked.union(given).repartition(max(tasks, groups), "g", "s").sortWithinPartitions("g", "s", "kind", "number")
    found = cells.mapInArrow(_search(facts["dims"], k, exact), "at long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id", "at").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _facts(rows: DataFrame, scale: int) -> dict:
    """Rows, dimensions, the largest component, and the dimensions by falling mass: one row a task and dimension, summed by Spark."""
    import numpy as np

    def mass(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total, n, most = np.zeros(0), 0, 0.0
        for b in batches:
            lengths, cells = _flat(b["embedding"], scale)
            n += len(lengths)
            if len(cells):
                most = max(most, float(np.abs(cells).max()))
                at = np.arange(len(cells)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                part = np.bincount(at, cells**2)
                total, part = (part, total) if len(part) > len(total) else (total, part)
                total[: len(part)] += part
        yield pa.RecordBatch.from_pydict({"d": pa.array([-1, *range(len(total))], pa.int32()), "mass": pa.array([float(n), *total], pa.float64()), "most": pa.array([most] * (len(total) + 1), pa.float64())})

    sums = rows.select("embedding").mapInArrow(mass, "d int, mass double, most double").groupBy("d").agg(F.sum("mass").alias("mass"), F.max("most").alias("most")).collect()  # one row a dimension
    by = {r.d: r for r in sums}
    dims = sorted((d for d in by if d >= 0), key=lambda d: (-by[d].mass, d))
    return {"n": int(by[-1].mass) if -1 in by else 0, "dims": len(dims), "order": dims, "most": max((r.most for r in sums), default=0.0)}


def _flat(lists, scale: int):
    """Lengths of a list column's rows, and its components quantised in one array."""
    import numpy as np

    lengths = np.diff(np.asarray(lists.offsets))
    return lengths, np.floor(scale * np.asarray(lists.flatten(), np.float64))


def _packer(order: list[int], scale: int, per_block: int, exact: str):
    """Blocks of quantised vectors, dimension by dimension in the given order."""
    import numpy as np

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        number, where = 0, np.array(order, np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, per_block):
                part = b.slice(lo, per_block)
                lengths, cells = _flat(part["embedding"], scale)
                at = np.arange(len(cells)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                table = np.zeros((len(where), len(lengths)), exact)
                table[at, np.repeat(np.arange(len(lengths)), lengths)] = cells
                yield pa.RecordBatch.from_pydict({"number": pa.array([number], pa.int64()), "n": pa.array([len(lengths)], pa.int32()), "ids": [np.asarray(part["vec_id"], np.int64).tobytes()], "cells": [table[where].tobytes()]}, schema=pa.schema([("number", pa.int64()), ("n", pa.int32()), ("ids", pa.binary()), ("cells", pa.binary())]))
                number += 1

    return run


class _Block:
    """Vectors in slices of dimensions, and the length of what is left after each slice."""

    def __init__(self, ids, cells) -> None:
        import numpy as np

        self.ids = ids
        width = max(1, -(-len(cells) // SLICES))
        self.slices = [np.ascontiguousarray(cells[lo : lo + width].T) for lo in range(0, len(cells), width)] or [np.zeros((len(ids), 1), cells.dtype)]
        squares = np.array([np.square(x.astype("f8")).sum(1) for x in self.slices])
        self.left = np.sqrt(np.vstack([np.cumsum(squares[::-1], 0)[::-1][1:], np.zeros(len(ids))]))


class _Best:
    """The k best of each query so far, by score and then id."""

    def __init__(self, n: int, k: int) -> None:
        import numpy as np

        self.k, self.at, self.ids, self.scores = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.reach = np.full(n, -np.inf)

    def add(self, at, ids, scores) -> None:
        import numpy as np

        at, ids, scores = np.concatenate([self.at, at]), np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        order = np.lexsort((ids, -scores, at))
        at, ids, scores = at[order], ids[order], scores[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        last = rank == self.k - 1
        self.reach[at[last]] = scores[last]
        keep = rank < self.k
        self.at, self.ids, self.scores = at[keep], ids[keep], scores[keep]


def _search(dims: int, k: int, exact: str):
    import numpy as np

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        cell, queries, parts, best = None, None, [], None

        def result():
            if queries is not None and best is not None and len(best.at):
                yield pa.RecordBatch.from_arrays([pa.array(at_all[best.at]), pa.array(queries.ids[best.at]), pa.array(best.ids), pa.array(best.scores)], ["at", "query_id", "vec_id", "score"])

        at_all = None
        for b in batches:
            for g, s, kind, number, n, ids, cells in zip(*(b[c].to_pylist() for c in ("g", "s", "kind", "number", "n", "ids", "cells"))):
                if (g, s) != cell:
                    yield from result()
                    cell, queries, parts, best = (g, s), None, [], None
                own = np.frombuffer(ids, np.int64), np.frombuffer(cells, exact).reshape(dims, n)
                if kind == 0:
                    parts.append(own)
                    continue
                if not parts:
                    continue
                if queries is None:
                    queries = _Block(np.concatenate([i for i, _ in parts]), np.concatenate([c for _, c in parts], 1))
                    at_all, best = _names(queries), _Best(len(queries.ids), k)
                compare(queries, _Block(*own), best)
        yield from result()

    def compare(queries: _Block, block: _Block, best: _Best) -> None:
        for lo in range(0, len(queries.ids), QUERIES_AT_ONCE):
            at = np.arange(lo, min(lo + QUERIES_AT_ONCE, len(queries.ids)))
            one = [x[lo : lo + QUERIES_AT_ONCE] for x in queries.slices]
            sums, done = one[0] @ block.slices[0].T, 1
            if np.isneginf(best.reach[at]).any():
                begin(at, sums, one, queries, block, best)
            while True:
                # the slack covers rounding of the lengths, never of the sums
                alive = sums + (queries.left[done - 1][at][:, None] * block.left[done - 1][None, :] * (1 + 1e-9) + 1e-6) >= best.reach[at][:, None]
                if done == len(one) or np.count_nonzero(alive) < DENSE * alive.size:
                    break
                sums += one[done] @ block.slices[done].T
                done += 1
            q, c = np.nonzero(alive)
            partial = sums[q, c]
            for d in range(done, len(one)):
                partial = partial + np.einsum("ij,ij->i", one[d][q], block.slices[d][c])
                keep = partial + (queries.left[d][at[q]] * block.left[d][c] * (1 + 1e-9) + 1e-6) >= best.reach[at[q]]
                q, c, partial = q[keep], c[keep], partial[keep]
            other = queries.ids[at[q]] != block.ids[c]
            best.add(at[q[other]], block.ids[c[other]], partial[other].astype(np.int64))

    def begin(at, sums, one, queries: _Block, block: _Block, best: _Best) -> None:
        """Where a query has no k scores yet, those that lead after the first slice give its k-th score something to start from."""
        m = min(k + 1, sums.shape[1])
        lead = np.argpartition(-sums, m - 1, axis=1)[:, :m]
        scores = np.zeros(lead.shape, exact)
        for x, y in zip(one, block.slices):
            scores += np.einsum("id,ikd->ik", x, y[lead])
        scores = np.where(queries.ids[at][:, None] == block.ids[lead], -np.inf, scores.astype("f8"))
        if m >= k:
            found = -np.sort(-scores, axis=1)[:, k - 1]
            best.reach[at] = np.maximum(best.reach[at], found if exact == "f8" else found - np.abs(found) * 1e-9 - 1)

    return run


def _names(queries: _Block):
    """A number for each query row, the same in all stripes: rows of one id differ in their vectors, which are hashed."""
    import hashlib

    import numpy as np

    whole = np.hstack(queries.slices)
    return np.array([int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "little", signed=True) for x in whole], np.int64)
