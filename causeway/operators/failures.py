"""Ancestry of failures: what failed first, what followed, and what lies behind a step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.plans import walk
from causeway.plans.projection import causes, primary_parents
from causeway.schema import TraceSet
from causeway.session import staged


def explain(ts: TraceSet, target: Column) -> DataFrame:
    """trace_id, target, ancestor, level, position, lossy (the tree shows only one of its causes)."""
    lossy = primary_parents(ts).select("trace_id", F.col("step_id").alias("ancestor"), (F.col("n_causes") > 1).alias("lossy"))
    return walk.ancestors(ts, target).join(lossy, ["trace_id", "ancestor"], "left").select("trace_id", "target", "ancestor", "level", "position", F.coalesce("lossy", F.lit(False)).alias("lossy"))


def find_step(ts: TraceSet, wanted: str) -> DataFrame:
    """Steps with this id; where a trace has none, its only step whose id ends so. trace_id, step_id."""
    hit = ts.steps.where(F.col("step_id").endswith(wanted)).select("trace_id", "step_id", (F.col("step_id") == wanted).alias("exact"))
    per = hit.groupBy("trace_id").agg(F.max("exact").alias("any"), F.count(F.lit(1)).alias("n"), F.max(F.struct("exact", "step_id"))["step_id"].alias("step_id"))
    return per.where(F.col("any") | (F.col("n") == 1)).select("trace_id", "step_id")


def split(ts: TraceSet) -> DataFrame:
    """Every failed step: trace_id, step_id, seq, kind, name, depth, primary (no failed step behind it through declared
    causes), rank (primaries by depth, deepest first, then seq and id; the rest by seq and id)."""
    return _ranked(ts, walk.depths(ts).withColumn("primary", ~F.col("error_ancestor")))


def explained(ts: TraceSet) -> DataFrame:
    """``split``, and as causal the ids of the steps behind each primary failure, nearest first, then by id (null: none). One walk tells both."""
    return _ranked(ts, walk.failed(ts))


def _ranked(ts: TraceSet, walked: DataFrame) -> DataFrame:
    failed = ts.steps.where("status = 'error'").select("trace_id", "step_id", "seq", "kind", "name")
    rows = failed.join(walked, ["trace_id", "step_id"])
    deep = F.when(F.col("primary"), -F.col("depth")).otherwise(0)
    line = Window.partitionBy("trace_id", "primary").orderBy(deep, "seq", "step_id")
    more = ["causal"] if "causal" in walked.columns else []
    return rows.select("trace_id", "step_id", "seq", "kind", "name", "depth", "primary", F.row_number().over(line).alias("rank"), *more)


def _marked(ts: TraceSet, steps: DataFrame) -> TraceSet:
    mark = steps.select("trace_id", "step_id", F.lit(True).alias("is_target"))
    return TraceSet(ts.traces, ts.steps.join(mark, ["trace_id", "step_id"], "left"), ts.edges)


def causal_steps(ts: TraceSet, known: DataFrame | None = None) -> DataFrame:
    """For each primary failure all steps behind it: trace_id, failure, step_id, level. known: the split, where it is at hand."""
    marked = _marked(ts, (known if known is not None else split(ts)).where("primary"))
    return walk.ancestors(marked, F.col("is_target")).select("trace_id", F.col("target").alias("failure"), F.col("ancestor").alias("step_id"), "level")


def causal_edges(ts: TraceSet, known: DataFrame | None = None) -> DataFrame:
    """The causes among each primary failure and the steps behind it: trace_id, failure, effect, cause, origin. known: the split, where it is at hand."""
    known = staged((known if known is not None else split(ts)).where("primary"))
    behind = causal_steps(ts, known).select("trace_id", "failure", "step_id")
    inside = behind.union(known.select("trace_id", F.col("step_id").alias("failure"), "step_id"))
    # every cause of such a step is behind the failure as well
    return inside.join(causes(ts).withColumnRenamed("src", "step_id"), ["trace_id", "step_id"]).select("trace_id", "failure", F.col("step_id").alias("effect"), F.col("dst").alias("cause"), "origin")
