"""From the recorded causes to the single-parent tree, and the checks of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway import schema
from causeway.schema import TraceSet
from causeway.session import staged


def causes(ts: TraceSet) -> DataFrame:
    return ts.edges.where("type = 'CAUSED_BY'").select("trace_id", "src", "dst", "origin")


def origin_rank(origin: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for pair in schema.ORIGIN_RANK.items() for x in pair])
    return F.coalesce(ranks[origin], F.lit(3))


def primary_parents(ts: TraceSet, origin_priority: bool = True) -> DataFrame:
    """trace_id, step_id, parent, origin, n_causes: the one tree parent of each step that has causes. Earliest by
    (origin rank, seq, ts, id); a minimum, so it is folded before it is shuffled."""
    cause = ts.steps.select("trace_id", F.col("step_id").alias("dst"), F.col("seq").alias("cause_seq"), F.coalesce("ts", F.lit("")).alias("cause_ts"))
    rank = origin_rank(F.col("origin")) if origin_priority else F.lit(0)
    best = F.min(F.struct(rank.alias("rank"), "cause_seq", "cause_ts", "dst", "origin"))
    joined = causes(ts).join(cause, ["trace_id", "dst"])
    picked = joined.groupBy("trace_id", "src").agg(best.alias("best"), F.count(F.lit(1)).alias("n_causes"))
    return picked.select("trace_id", F.col("src").alias("step_id"), F.col("best.dst").alias("parent"), F.col("best.origin").alias("origin"), "n_causes")


def normalize(ts: TraceSet, origin_priority: bool = True) -> tuple[TraceSet, DataFrame]:
    """The traces with lossy flags and status derived from their steps, and the tree (trace_id, step_id, parent)."""
    parents = primary_parents(ts, origin_priority)
    steps = ts.steps.drop("projection_lossy").join(parents.select("trace_id", "step_id", "n_causes"), ["trace_id", "step_id"], "left")
    steps = steps.withColumn("projection_lossy", F.coalesce(F.col("n_causes") > 1, F.lit(False))).select(*schema.struct(schema.STEPS).names)
    status = ts.steps.groupBy("trace_id").agg(F.bool_or(F.col("status") == "error").alias("failed"))
    traces = ts.traces.drop("status").join(status, "trace_id", "left").withColumn("status", F.when(F.col("failed"), "error").otherwise("ok"))
    return TraceSet(traces.select(*schema.struct(schema.TRACES).names), steps, ts.edges), parents.select("trace_id", "step_id", "parent")


def layers(ts: TraceSet) -> DataFrame:
    """All edge layers in canonical order: causes, then each step's membership and tree parent."""
    at = ts.steps.select("trace_id", F.col("step_id").alias("src"), F.col("seq").alias("src_seq"))
    to = ts.steps.select("trace_id", F.col("step_id").alias("dst"), F.col("seq").alias("dst_seq"))
    raw = causes(ts).join(at, ["trace_id", "src"]).join(to, ["trace_id", "dst"]).select("trace_id", F.lit("CAUSED_BY").alias("type"), "src", "dst", "origin", F.lit(0).alias("layer"), "src_seq", "dst_seq", F.lit(0).alias("sub"))
    own = at.select("trace_id", F.lit("BELONGS_TO").alias("type"), "src", F.col("trace_id").alias("dst"), F.lit(None).cast("string").alias("origin"), F.lit(1).alias("layer"), "src_seq", F.lit(None).cast("long").alias("dst_seq"), F.lit(0).alias("sub"))
    tree = primary_parents(ts).join(at.withColumnRenamed("src", "step_id"), ["trace_id", "step_id"]).select("trace_id", F.lit("TREE_PARENT").alias("type"), F.col("step_id").alias("src"), F.col("parent").alias("dst"), F.lit(None).cast("string").alias("origin"), F.lit(1).alias("layer"), "src_seq", F.lit(None).cast("long").alias("dst_seq"), F.lit(1).alias("sub"))
    line = Window.partitionBy("trace_id").orderBy("layer", "src_seq", F.when(F.col("layer") == 0, F.col("dst_seq")), "src", F.when(F.col("layer") == 0, F.col("dst")), "sub")
    return raw.unionByName(own).unionByName(tree).withColumn("position", F.row_number().over(line) - 1).select("trace_id", "type", "src", "dst", "origin", "position")


def needs_origin_priority(ts: TraceSet) -> DataFrame:
    """trace_id, steps whose tree parent differs when origins are ignored."""
    cause = ts.steps.select("trace_id", F.col("step_id").alias("dst"), F.col("seq").alias("cause_seq"), F.coalesce("ts", F.lit("")).alias("cause_ts"))
    first = lambda *rank: F.min(F.struct(*rank, "cause_seq", "cause_ts", "dst"))["dst"]
    picked = causes(ts).join(cause, ["trace_id", "dst"]).groupBy("trace_id", "src").agg(first(origin_rank(F.col("origin")).alias("rank")).alias("parent"), first().alias("temporal"))
    return picked.where("parent <> temporal").groupBy("trace_id").agg(F.count(F.lit(1)).alias("n_steps"))


def projection_rules(ts: TraceSet) -> DataFrame:
    """trace_id, rule: which choice of parents gives the stored tree, origin_priority or temporal (null: neither); a trace whose edges
    hold no tree has the former."""
    stored = ts.edges.where("type = 'TREE_PARENT'").select("trace_id", F.col("src").alias("step_id"), F.col("dst").alias("stored"))
    by_rank = primary_parents(ts).select("trace_id", "step_id", F.col("parent").alias("ranked"))
    by_time = primary_parents(ts, False).select("trace_id", "step_id", F.col("parent").alias("timed"))
    rows = by_rank.join(by_time, ["trace_id", "step_id"]).join(stored, ["trace_id", "step_id"], "full_outer")
    fits = lambda c: F.bool_and(F.col(c).eqNullSafe(F.col("stored")))
    per = rows.groupBy("trace_id").agg(fits("ranked").alias("ranked"), fits("timed").alias("timed"), F.count("stored").alias("n"))
    rule = F.when((F.coalesce("n", F.lit(0)) == 0) | F.col("ranked"), "origin_priority").when(F.col("timed"), "temporal")
    return ts.traces.select("trace_id").join(per, "trace_id", "left").select("trace_id", rule.alias("rule"))


def violations(ts: TraceSet) -> DataFrame:
    """trace_id, rule, subject: everything that breaks the model's rules. Empty for valid traces. The columns that rules read are staged and dealt by the keys of
    the joins, once for all rules: into all partitions, as a task of so few, well compressed columns holds many rows once partitions are coalesced by their bytes."""
    parts = int(ts.steps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    steps = staged(ts.steps.select("trace_id", "step_id", "seq", "status", (F.size("unknown_fields") > 0).alias("unknown")))
    traces = staged(ts.traces.select("trace_id", "status", F.col("capture").isNull().alias("open")))
    edges = staged(ts.edges.where("type IN ('CAUSED_BY', 'TREE_PARENT')").select("trace_id", "type", "src", "dst"))
    step = steps.select("trace_id", "step_id", "seq").repartition(parts, "trace_id", "step_id")
    tell = lambda df, rule, subject: df.select("trace_id", F.lit(rule).alias("rule"), subject.alias("subject"))

    def told(df: DataFrame, subject: Column, rules: dict[str, Column]) -> DataFrame:
        broken = F.array_compact(F.array(*[F.when(bad, F.lit(rule)) for rule, bad in rules.items()]))
        return df.select("trace_id", F.explode(broken).alias("rule"), subject.alias("subject"))

    e, tree = (edges.where(F.col("type") == t).repartition(parts, "trace_id", "src") for t in ("CAUSED_BY", "TREE_PARENT"))
    arrow = F.concat_ws("->", "src", "dst")
    heads = traces.groupBy("trace_id").agg(F.count(F.lit(1)).alias("heads"), F.bool_or("open").alias("open"))
    # a join of two staged tables is no staged table: the hint is given again
    ends = e.join(step.toDF("trace_id", "src", "src_seq"), ["trace_id", "src"], "left").repartition(parts, "trace_id", "dst").hint("merge").join(step.toDF("trace_id", "dst", "dst_seq"), ["trace_id", "dst"], "left")
    derived = steps.groupBy("trace_id").agg(F.max(F.col("status") == "error").alias("failed"))
    found = [
        tell(step.groupBy("trace_id", "step_id").count().where("count > 1"), "duplicate step", F.col("step_id")),
        told(steps.repartition(parts, "trace_id").join(heads, "trace_id", "left"), F.col("step_id"), {"step without trace": F.col("heads").isNull(), "unknown fields without capture": F.col("unknown") & F.col("open")}),
        tell(heads.where("heads > 1"), "duplicate trace", F.col("trace_id")),
        told(ends, arrow, {"unknown endpoint": F.col("src_seq").isNull() | F.col("dst_seq").isNull(), "cause not before effect": (F.col("src") != F.col("dst")) & (F.col("dst_seq") >= F.col("src_seq"))}),
        tell(edges.where("type = 'CAUSED_BY' AND src = dst"), "self edge", arrow),
        tell(e.groupBy("trace_id", "src", "dst").count().where("count > 1"), "duplicate edge", arrow),
        tell(tree.groupBy("trace_id", "src").count().where("count > 1"), "several tree parents", F.col("src")),
        tell(tree.repartition(parts, "trace_id", "dst").join(step.toDF("trace_id", "dst", "s"), ["trace_id", "dst"], "left_anti"), "unknown tree parent", arrow),
        tell(traces.join(derived, "trace_id", "left").where("status IS NOT NULL AND (status = 'error') <> coalesce(failed, false)"), "status differs from steps", F.col("trace_id")),
    ]
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out
