"""Traversals of the cause graph, one trace after the other within a partition.

Rows of a trace are brought together by one shuffle on trace_id and streamed to Python in (trace, layer,
seq, id) order, so a task holds one trace at a time. Sets of steps are bitsets (Python integers), and a
walk in seq order needs no recursion because a cause always comes before its effect.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.plans.projection import causes
from causeway.schema import TraceSet, struct
from causeway.session import ship, values


class Graph:
    """One trace: steps in (seq, id) order with two marks and a name, and each step's causes in canonical order."""

    def __init__(self, trace_id: str):
        self.trace_id, self.ids, self.seq, self.names, self.marks = trace_id, [], [], [], []
        self.at: dict[str, int] = {}
        self.causes: list[list[int]] = []
        self.explicit: list[list[int]] = []

    def step(self, sid: str, seq: int, name: str | None, marks: int) -> None:
        self.at[sid] = len(self.ids)
        self.ids.append(sid)
        self.seq.append(seq)
        self.names.append(name)
        self.marks.append(marks)
        self.causes.append([])
        self.explicit.append([])

    def run_of_steps(self, ids: list, seq: list, names: list, marks: list) -> None:
        n = len(ids)
        self.at.update(zip(ids, range(len(self.ids), len(self.ids) + n)))
        self.ids += ids
        self.seq += seq
        self.names += names
        self.marks += marks
        self.causes += [[] for _ in range(n)]
        self.explicit += [[] for _ in range(n)]

    def edge(self, src: str, dst: str, explicit: bool) -> None:
        a, b = self.at.get(src), self.at.get(dst)
        if a is not None and b is not None:
            self.causes[a].append(b)
            if explicit:
                self.explicit[a].append(b)

    def close(self) -> None:
        for c in self.causes:
            c.sort()  # places are in (seq, id) order


def over_graphs(ts: TraceSet, fn: Callable[[Graph], Iterator[tuple]], ddl: str, first: Column | None = None, second: Column | None = None) -> DataFrame:
    """fn's rows for every trace. first, second: conditions on steps, as marks 1 and 2."""
    from causeway import schema

    spark = ts.steps.sparkSession
    ship(spark)
    mark = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0) if c is not None else F.lit(0)
    nodes = ts.steps.select("trace_id", F.lit(0).alias("layer"), "seq", F.col("step_id").alias("id"), "name", (mark(first, 1) + mark(second, 2)).alias("marks"))
    arcs = causes(ts).select("trace_id", F.lit(1).alias("layer"), F.lit(0).cast("long").alias("seq"), F.col("src").alias("id"), F.col("dst").alias("name"), F.coalesce(F.col("origin").isin(*schema.EXPLICIT_ORIGINS), F.lit(False)).cast("int").alias("marks"))
    kinds = struct(ddl)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark.sql.pandas.types import to_arrow_schema

        shape = to_arrow_schema(kinds)
        graph, out, held = None, [], 0

        def flush(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), shape)], schema=shape)

        def finish(g: Graph) -> Iterator:
            nonlocal held
            g.close()
            for row in fn(g):
                out.append(row)
                held += 1 + len(row[-1]) if type(row[-1]) is list else 1
                if held >= 50_000:
                    yield flush(out)
                    out.clear()
                    held = 0

        ends = lambda c: pc.run_end_encode(c).run_ends.to_numpy()
        for b in batches:
            traces, layers, seqs, ids, names, marks = (values(b[c]) for c in ("trace_id", "layer", "seq", "id", "name", "marks"))
            first = 0
            # a run: the steps, or the edges, of one trace
            for end in np.union1d(ends(b["trace_id"]), ends(b["layer"])).tolist():
                if graph is None or traces[first] != graph.trace_id:
                    if graph is not None:
                        yield from finish(graph)
                    graph = Graph(traces[first])
                if layers[first] == 0:
                    graph.run_of_steps(ids[first:end], seqs[first:end], names[first:end], marks[first:end])
                else:
                    for src, dst, explicit in zip(ids[first:end], names[first:end], marks[first:end]):
                        graph.edge(src, dst, bool(explicit))
                first = end
        if graph is not None:
            yield from finish(graph)
        if out:
            yield flush(out)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # dealt by a hash of the key: a union of tables that were shuffled by the key itself would count as dealt already, while each of
    # its sides may have been coalesced in its own way
    dealt = nodes.union(arcs).repartition(parts, F.xxhash64("trace_id")).sortWithinPartitions("trace_id", "layer", "seq", "id")
    return dealt.mapInArrow(run, ddl)


class Reach:
    """What each step leads to, as intervals. A spanning tree of the latest causes numbers the steps so that a subtree is one interval; the effects
    of a step are the union of its effects' intervals, merged. Near-trees need few intervals a step, so the index is about as long as the
    trace. ``levels``: intervals of what is reached by a path of at least so many hops; level 0 has the step itself."""

    def __init__(self, graph: Graph, levels: int):
        n = len(graph.ids)
        effects: list[list[int]] = [[] for _ in range(n)]
        below: list[list[int]] = [[] for _ in range(n)]
        roots = []
        for i, cs in enumerate(graph.causes):
            (below[cs[-1]] if cs else roots).append(i)
            for c in cs:
                effects[c].append(i)
        size = [1] * n
        for i in range(n - 1, -1, -1):
            if graph.causes[i]:
                size[graph.causes[i][-1]] += size[i]
        self.number, free = [0] * n, 0
        for r in roots:
            self.number[r], free = free, free + size[r]
        for i in range(n):
            free = self.number[i] + 1
            for e in below[i]:
                self.number[e], free = free, free + size[e]
        now = [[] for _ in range(n)]
        for i in range(n - 1, -1, -1):
            own = (self.number[i], self.number[i] + size[i])
            extra = [x for e in effects[i] for x in now[e] if not own[0] <= x[0] <= x[1] <= own[1]]
            now[i] = _merged([own, *extra]) if extra else [own]
        for _ in range(levels):
            now = [_merged([x for e in effects[i] for x in now[e]]) for i in range(n)]
        self.intervals = now


def _merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    if len(intervals) < 2:
        return intervals
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(intervals):
        if out and lo <= out[-1][1]:
            if hi > out[-1][1]:
                out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def _exact(graph: Graph, start: int, effects: list[list[int]], lo: int, hi: int) -> set[int]:
    """The steps that paths of lo to hi hops lead to from one start."""
    front, found = {start}, set()
    for length in range(1, hi + 1):
        front = {e for i in front for e in effects[i]}
        if not front:
            break
        if length >= lo:
            found |= front
    return found


def _pairs(g: Graph, lo: int, hi: int | None, same_name: bool) -> Iterator[tuple[int, int, Callable[[], list[int]]]]:
    """For each marked start in order: (start, how many ends it leads to, a function that lists them in order). Starts without an end of their name further
    along are passed over."""
    ends: dict[str | None, list[int]] = {}
    for i, m in enumerate(g.marks):
        if m & 2 and not (same_name and g.names[i] is None):
            ends.setdefault(g.names[i] if same_name else None, []).append(i)
    starts = [(i, ends[k]) for i, m in enumerate(g.marks) if m & 1 and (k := g.names[i] if same_name else None) in ends and not (same_name and k is None) and ends[k][-1] > i]
    if not starts:
        return
    if hi is None:
        from bisect import bisect_left

        index = Reach(g, lo)
        by_number = {k: sorted((index.number[e], e) for e in own) for k, own in ends.items()}
        numbers = {k: [x for x, _ in own] for k, own in by_number.items()}
        for i, own in starts:
            k = g.names[i] if same_name else None
            cuts = [(bisect_left(numbers[k], x), bisect_left(numbers[k], y)) for x, y in index.intervals[i]]
            yield i, sum(y - x for x, y in cuts), lambda cuts=cuts, k=k: sorted(e for x, y in cuts for _, e in by_number[k][x:y])
    else:
        effects: list[list[int]] = [[] for _ in g.ids]
        for i, cs in enumerate(g.causes):
            for c in cs:
                effects[c].append(i)
        for i, own in starts:
            found = _exact(g, i, effects, lo, hi)
            met = [e for e in own if e in found] if len(own) < len(found) else sorted(found.intersection(own))
            yield i, len(met), lambda met=met: met


def _likely(ts: TraceSet, start: Column, end: Column, same_name: bool) -> TraceSet:
    """The traces with a start before an end (of its name)."""
    by = ["trace_id", "name"] if same_name else ["trace_id"]
    marks = ts.steps.groupBy(*by).agg(F.min(F.when(start, F.col("seq"))).alias("first"), F.max(F.when(end, F.col("seq"))).alias("last"))
    return ts.where(marks.where("last > first" + (" AND name IS NOT NULL" if same_name else "")).select("trace_id").distinct())


def gap_pairs(ts: TraceSet, start: Column, end: Column, lo: int, hi: int | None, same_name: bool) -> DataFrame:
    """trace_id, a, e: marked steps that a causal path of lo to hi hops connects (a is the cause); with
    same_name both names must be there and equal. Only traces that have a start before an end (of its name) are walked. Without
    an upper bound the work grows with the trace and the pairs found, not with starts times steps."""

    def run(g: Graph) -> Iterator[tuple]:
        for i, n, listed in _pairs(g, lo, hi, same_name):
            for e in listed() if n else ():
                yield g.trace_id, g.ids[i], g.ids[e]

    return over_graphs(_likely(ts, start, end, same_name), run, "trace_id string, a string, e string", start, end)


def first_pairs(ts: TraceSet, start: Column, end: Column, lo: int, hi: int | None, same_name: bool, first: int) -> DataFrame:
    """trace_id, a, e, total: the first pairs of each trace by the order of their steps, so many at most, and in ``total`` how many there are. The rest
    is counted from the index and never made."""

    def run(g: Graph) -> Iterator[tuple]:
        total, kept = 0, []
        for i, n, listed in _pairs(g, lo, hi, same_name):
            if n and len(kept) < first:
                kept += [(i, e) for e in listed()[: first - len(kept)]]
            total += n
        for i, e in kept:
            yield g.trace_id, g.ids[i], g.ids[e], total

    return over_graphs(_likely(ts, start, end, same_name), run, "trace_id string, a string, e string, total long", start, end)


def ancestors(ts: TraceSet, target: Column) -> DataFrame:
    """trace_id, target, ancestor, level, position: all causes behind each target step, nearest first (breadth
    first; the causes of a step in (seq, id) order; first discovery counts)."""

    def run(g: Graph) -> Iterator[tuple]:
        for i in range(len(g.ids)):
            if not g.marks[i] & 1:
                continue
            level, queue = {i: 0}, [i]
            for j in queue:
                for c in g.causes[j]:
                    if c not in level:
                        level[c] = level[j] + 1
                        queue.append(c)
            for p, j in enumerate(queue[1:]):
                yield g.trace_id, g.ids[i], g.ids[j], level[j], p

    return over_graphs(ts, run, "trace_id string, target string, ancestor string, level int, position int", target)


def _depths(g: Graph) -> tuple[list[int], list[bool]]:
    """Each step's longest path from a root, and whether a failed step (mark 1) is behind it through declared causes."""
    depth, behind = [0] * len(g.ids), [False] * len(g.ids)
    for i in range(len(g.ids)):
        depth[i] = 1 + max((depth[c] for c in g.causes[i]), default=-1)
        behind[i] = any(behind[c] or g.marks[c] & 1 for c in g.explicit[i])
    return depth, behind


def failed(ts: TraceSet) -> DataFrame:
    """trace_id, step_id, depth, primary, causal of each failed step: ``depths`` and, for one without a failed step behind it, the ids of all
    steps behind it, nearest first, then by id (null: none)."""

    def run(g: Graph) -> Iterator[tuple]:
        depth, behind = _depths(g)
        for i in range(len(g.ids)):
            if not g.marks[i] & 1:
                continue
            causal = None
            if not behind[i]:
                level, queue = {i: 0}, [i]
                for j in queue:
                    for c in g.causes[j]:
                        if c not in level:
                            level[c] = level[j] + 1
                            queue.append(c)
                causal = [g.ids[j] for j in sorted(queue[1:], key=lambda j: (level[j], g.ids[j]))] or None
            yield g.trace_id, g.ids[i], depth[i], not behind[i], causal

    return over_graphs(ts, run, "trace_id string, step_id string, depth int, primary boolean, causal array<string>", F.col("status") == "error")


def depths(ts: TraceSet) -> DataFrame:
    """trace_id, step_id, depth (longest path from a root), error_ancestor (a failed step behind it, through
    declared causes only)."""

    def run(g: Graph) -> Iterator[tuple]:
        depth, behind = _depths(g)
        for i in range(len(g.ids)):
            yield g.trace_id, g.ids[i], depth[i], bool(behind[i])

    return over_graphs(ts, run, "trace_id string, step_id string, depth int, error_ancestor boolean", F.col("status") == "error")
