"""Traversals of traces that are too large for a task: rounds of joins over staged (trace, step) tables, with the rows that the walks give.

A round settles all steps whose causes are settled, or finds the next level behind all targets, for all such traces at once; the next round reads its
table from the shared folder. No task holds a trace. Rounds are as many as the longest path has steps, so this suits wide traces; the walks suit deep ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway import schema
from causeway.plans import walk
from causeway.plans.projection import causes
from causeway.schema import TraceSet
from causeway.session import staged


def split(ts: TraceSet, large: int) -> tuple[TraceSet, TraceSet]:
    """(traces of at most ``large`` steps, larger ones)."""
    big = staged(ts.steps.groupBy("trace_id").count().where(F.col("count") > large).select("trace_id"))
    rest = TraceSet(*(df.join(big, "trace_id", "left_anti") for df in (ts.traces, ts.steps, ts.edges)))
    return rest, ts.where(big)


def _edges(ts: TraceSet) -> DataFrame:
    ids = ts.steps.select("trace_id", F.col("step_id").alias("src"))
    known = causes(ts).select("trace_id", "src", "dst", F.coalesce(F.col("origin").isin(*schema.EXPLICIT_ORIGINS), F.lit(False)).alias("explicit"))
    known = known.groupBy("trace_id", "src", "dst").agg(F.bool_or("explicit").alias("explicit"))
    return staged(known.join(ids, ["trace_id", "src"], "left_semi").join(ids.withColumnRenamed("src", "dst"), ["trace_id", "dst"], "left_semi"))


def depths(ts: TraceSet, large: int) -> DataFrame:
    """``walk.depths``, in rounds for traces of more than ``large`` steps."""
    small, big = split(ts, large)
    return walk.depths(small).unionByName(depths_in_rounds(big))


def depths_in_rounds(ts: TraceSet) -> DataFrame:
    edges = _edges(ts)
    failed = (F.coalesce(F.col("status") == "error", F.lit(False))).alias("failed")
    wait = edges.groupBy("trace_id", F.col("src").alias("step_id")).agg(F.count(F.lit(1)).alias("open"))
    pending = staged(ts.steps.select("trace_id", "step_id", failed).join(wait, ["trace_id", "step_id"], "left").select("trace_id", "step_id", "failed", F.coalesce("open", F.lit(0)).cast("long").alias("open"), F.lit(False).alias("behind")))
    depth, done = 0, []
    while True:
        front = staged(pending.where("open = 0"))
        if front.isEmpty():
            break
        done.append(front.select("trace_id", "step_id", F.lit(depth).alias("depth"), F.col("behind").alias("error_ancestor")))
        reached = front.select("trace_id", F.col("step_id").alias("dst"), (F.col("failed") | F.col("behind")).alias("bad")).join(edges, ["trace_id", "dst"])
        told = reached.groupBy("trace_id", F.col("src").alias("step_id")).agg(F.count(F.lit(1)).alias("closed"), F.bool_or(F.col("bad") & F.col("explicit")).alias("bad"))
        left = pending.where("open > 0").join(told, ["trace_id", "step_id"], "left")
        pending = staged(left.select("trace_id", "step_id", "failed", (F.col("open") - F.coalesce("closed", F.lit(0))).alias("open"), (F.col("behind") | F.coalesce("bad", F.lit(False))).alias("behind")))
        depth += 1
    return _all(done, ts, "trace_id string, step_id string, depth int, error_ancestor boolean")


def ancestors(ts: TraceSet, target: Column, large: int) -> DataFrame:
    """``walk.ancestors``, in rounds for traces of more than ``large`` steps."""
    small, big = split(ts, large)
    return walk.ancestors(small, target).unionByName(ancestors_in_rounds(big, target))


def ancestors_in_rounds(ts: TraceSet, target: Column) -> DataFrame:
    """Level by level behind all targets. A step is found by the cause-bearer with the smallest place that leads to it, and the steps found by one come in
    (seq, id) order."""
    seq = ts.steps.select("trace_id", F.col("step_id").alias("dst"), "seq")
    edges = staged(_edges(ts).select("trace_id", "src", "dst").join(seq, ["trace_id", "dst"]))
    front = staged(ts.steps.where(target).select("trace_id", F.col("step_id").alias("target"), F.col("step_id").alias("ancestor"), F.lit(0).alias("level"), F.lit(-1).alias("position")))
    seen, done, level = front, [], 1
    while True:
        met = front.select("trace_id", "target", F.col("ancestor").alias("src"), F.col("position").alias("by")).join(edges, ["trace_id", "src"])
        first = met.groupBy("trace_id", "target", F.col("dst").alias("ancestor")).agg(F.min("by").alias("by"), F.min("seq").alias("seq"))
        new = first.join(seen.select("trace_id", "target", "ancestor"), ["trace_id", "target", "ancestor"], "left_anti")
        ends = seen.groupBy("trace_id", "target").agg(F.max("position").alias("last"))
        line = Window.partitionBy("trace_id", "target").orderBy("by", "seq", "ancestor")
        front = staged(new.join(ends, ["trace_id", "target"]).select("trace_id", "target", "ancestor", F.lit(level).alias("level"), (F.col("last") + F.row_number().over(line)).alias("position")))
        if front.isEmpty():
            break
        done.append(front)
        seen = staged(seen.union(front))
        level += 1
    return _all(done, ts, "trace_id string, target string, ancestor string, level int, position int")


def _all(done: list[DataFrame], ts: TraceSet, ddl: str) -> DataFrame:
    out = ts.steps.sparkSession.createDataFrame([], ddl)
    for more in done:
        out = out.union(more.select(*out.columns))
    return out
