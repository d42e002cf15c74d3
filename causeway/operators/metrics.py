"""Telemetry of a trace: sums, an envelope of times, exact costs, and what had to be withheld."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions import costs
from causeway.schema import TraceSet

def summary(ts: TraceSet) -> DataFrame:
    """One row a trace: wall_duration_ms, tokens, total_cost (text), cost_currency, and for each whether every step
    reported it. A total is exact or null: wall time is withheld where a step ends before it starts or the
    envelope is negative, costs where one is unreadable or currencies mix."""
    ev = F.col("evidence")
    start, end = F.try_to_timestamp("ts"), F.try_to_timestamp(ev["end_ts"])
    cost_text = ev["total_cost"]
    cost = costs.fixed(cost_text)
    usable = cost.isNotNull()
    rows = ts.steps.select(
        "trace_id", start.alias("start"), end.alias("end"), *[ev[c].alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")],
        cost.alias("cost"), (cost_text.isNotNull() & ~usable).alias("bad_cost"), F.when(usable, F.coalesce(ev["cost_currency"], F.lit(""))).alias("currency"),
    )
    n = F.count(F.lit(1))
    agg = rows.groupBy("trace_id").agg(
        n.alias("n"), F.min("start").alias("first"), F.max("end").alias("last"), F.count("start").alias("starts"), F.count("end").alias("ends"), F.count_if(F.col("end") < F.col("start")).alias("reversed"),
        *[F.sum(c).alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")], *[F.count(c).alias(f"n_{c}") for c in ("prompt_tokens", "completion_tokens", "total_tokens")],
        costs.summed(F.col("cost")).alias("cost"), F.count("cost").alias("n_cost"), F.count_if("bad_cost").alias("bad"), F.min("currency").alias("cur1"), F.max("currency").alias("cur2"),
    )
    wall = F.round((F.unix_micros("last") - F.unix_micros("first")) / 1000, 6)
    clear = (F.col("bad") == 0) & F.col("cur1").eqNullSafe(F.col("cur2"))
    sums = [F.col(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")]
    timed = (F.col("reversed") == 0) & (wall >= 0)
    return agg.select(
        "trace_id", F.col("n").alias("n_steps"), F.when(timed, wall).alias("wall_duration_ms"), *sums,
        F.when(clear, costs.total(F.col("cost"))).alias("total_cost"), F.when(clear & (F.col("cur1") != ""), F.col("cur1")).alias("cost_currency"),
        F.coalesce(timed & (F.col("starts") == F.col("n")) & (F.col("ends") == F.col("n")), F.lit(False)).alias("wall_complete"),
        *[(F.col(f"n_{c}") == F.col("n")).alias(f"{c}_complete") for c in ("prompt_tokens", "completion_tokens", "total_tokens")],
        (clear & (F.col("n_cost") == F.col("n"))).alias("cost_complete"), "reversed",
    )


def evaluations(ts: TraceSet) -> DataFrame:
    """trace_id, step_id, eval_name, label, score."""
    return ts.steps.select("trace_id", "step_id", F.explode("evidence.evaluations").alias("e")).select("trace_id", "step_id", F.col("e.name").alias("eval_name"), F.col("e.label").alias("label"), F.col("e.score").alias("score"))


def deltas(ts: TraceSet, pairs: DataFrame) -> DataFrame:
    """pairs: current, baseline -> differences, only where both sides are complete (costs also in one known currency)."""
    m = summary(ts)
    cur = m.select(*[F.col(c).alias(f"c_{c}") for c in m.columns])
    base = m.select(*[F.col(c).alias(f"b_{c}") for c in m.columns])
    both = pairs.join(cur, pairs["current"] == cur["c_trace_id"]).join(base, pairs["baseline"] == base["b_trace_id"])
    diff = lambda c, ok: F.when(F.col(f"c_{ok}") & F.col(f"b_{ok}"), F.col(f"c_{c}") - F.col(f"b_{c}"))
    money = F.col("c_cost_complete") & F.col("b_cost_complete") & (F.col("c_cost_currency") == F.col("b_cost_currency"))
    return both.select(
        "current", "baseline", diff("wall_duration_ms", "wall_complete").alias("wall_delta"), *[diff(c, f"{c}_complete").alias(f"{c}_delta") for c in ("prompt_tokens", "completion_tokens", "total_tokens")],
        F.when(money, costs.difference(F.col("c_total_cost"), F.col("b_total_cost"))).alias("cost_delta"),
    )


def counts(ts: TraceSet) -> DataFrame:
    """One row a trace: steps, errors, tools, lossy, interrupted, scheduled, undecided tasks."""
    from causeway.plans.projection import primary_parents

    lossy = primary_parents(ts).groupBy("trace_id").agg(F.count_if(F.col("n_causes") > 1).alias("n_lossy"))
    per = ts.steps.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("n_steps"), F.count_if(F.col("status") == "error").alias("n_errors"), F.count_if(F.col("kind") == "TOOL").alias("n_tools"),
        F.count_if(F.col("source") == "interrupt").alias("n_interrupted"), F.count_if(F.col("source") == "scheduled").alias("n_scheduled"),
    )
    undecided = F.aggregate(F.coalesce(F.filter(F.col("capture.gaps"), lambda g: g["code"] == "langgraph.undecided_interrupt"), F.array().cast("array<struct<code: string, count: bigint>>")), F.lit(0).cast("long"), lambda a, g: a + g["count"])
    head = ts.traces.select("trace_id", undecided.alias("n_undecided"))
    return head.join(per, "trace_id").join(lossy, "trace_id", "left").select("trace_id", "n_steps", "n_errors", "n_tools", F.coalesce("n_lossy", F.lit(0)).alias("n_lossy"), "n_interrupted", "n_scheduled", "n_undecided")
