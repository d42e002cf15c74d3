"""The diagnosis of each trace in one row: failures, findings, metrics, notes, and what changed since a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions.labels import gaps_have, safe
from causeway.operators import check, failures, metrics, motifs, trees
from causeway.plans import patterns
from causeway.plans.projection import primary_parents
from causeway.schema import HEURISTIC_EDGES, TraceSet
from causeway.session import staged

#: What a note says, by its code.
NOTES = {
    "parent_only": "only containment was recorded, so causes are parents and nothing else",
    "lossy_tree": "the tree shows one cause of steps that have several; comparisons of trees see no others",
    "links": "links count as causes as their producer declared them",
    "heuristic_parents": "some causes were chosen by time among several candidates",
    "checkpoints": "checkpoint layouts that aren't known record no failure, so none seen is no proof of success",
    "no_graph": "without the graph, a run that stopped and one that finished look the same",
    "task_marks": "paused or scheduled tasks are recorded beside the trace's status",
    "incident": "a failure without a failed cause behind it is a candidate for what went wrong first, not its proof",
    "partial_metrics": "sums cover the values that steps reported; producers' aggregates may count twice",
    "reversed_times": "steps that end before they start; wall time is withheld",
    "withheld_cost": "costs are unreadable or in several currencies; their total is withheld",
}


def _notes(when: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for code, c in when.items()]))


def analyze(ts: TraceSet, known: DataFrame | None = None, digests: bool = True) -> DataFrame:
    """One row a trace: its header, step_count, error_count, primary_failures (deepest first, each with the ids of the steps behind it),
    propagated_failures, patterns (matches of the presets that an analysis runs), metrics, notes (codes of NOTES), digest. Names are redacted
    where their shape isn't harmless. known: the explained failures, where they are at hand. digests: False leaves the digest out, as it needs each trace's document."""
    split = known if known is not None else staged(failures.explained(ts))
    step = F.struct("rank", "step_id", "kind", safe(F.col("name")).alias("name"), "depth", F.col("causal").alias("causal_steps"))
    told = split.groupBy("trace_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("primary"), step))).alias("primary_failures"), F.array_sort(F.collect_list(F.when(~F.col("primary"), step.dropFields("causal_steps")))).alias("propagated_failures")
    )
    order = F.create_map(*[F.lit(x) for i, n in enumerate(patterns.AUTO) for x in (n, i)])
    hit = F.struct(order[F.col("pattern_id")].alias("turn"), "first_seq", "pattern_id", "pattern_version", "path")
    found = patterns.sweep(ts).groupBy("trace_id").agg(F.transform(F.array_sort(F.collect_list(hit)), lambda x: x.dropFields("turn", "first_seq")).alias("patterns"))
    m = metrics.summary(ts)
    measured = m.select("trace_id", F.struct(*[c for c in m.columns if c not in ("trace_id", "n_steps")]).alias("metrics"))
    lossy = primary_parents(ts).groupBy("trace_id").agg(F.count_if(F.col("n_causes") > 1).alias("n_lossy"))
    per = ts.steps.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("step_count"), F.count_if(F.col("status") == "error").alias("error_count"), F.bool_or(F.col("source").isin("interrupt", "scheduled")).alias("marked"),
        F.bool_or(F.col("evidence.total_cost").isNotNull()).alias("costed"),
    )
    rows = ts.traces.join(per, "trace_id").join(lossy, "trace_id", "left").join(told, "trace_id", "left").join(found, "trace_id", "left").join(measured, "trace_id", "left")
    if digests:
        rows = rows.join(motifs.digest(ts), "trace_id")
    sums = [F.col(f"metrics.{c}").isNotNull() for c in ("prompt_tokens", "completion_tokens", "total_tokens", "total_cost")]
    notes = _notes({
        "parent_only": F.col("causal_fidelity") == "parent_only", "lossy_tree": F.col("n_lossy") > 0, "links": F.col("links_preserved"), "heuristic_parents": gaps_have(F.col("capture"), HEURISTIC_EDGES),
        "checkpoints": F.col("source_kind") == "langgraph", "no_graph": (F.col("source_kind") == "langgraph") & F.col("schedule_graph").isNull(), "task_marks": F.col("marked"), "incident": F.col("error_count") > 0,
        "partial_metrics": sums[0] | sums[1] | sums[2] | sums[3], "reversed_times": F.col("metrics.reversed") > 0, "withheld_cost": F.col("costed") & F.col("metrics.total_cost").isNull(),
    })
    none = lambda c: F.coalesce(c, F.array())
    return rows.select(
        "trace_id", safe(F.col("source_kind")).alias("source_kind"), "status", "causal_fidelity", "links_preserved", "step_count", "error_count", none("primary_failures").alias("primary_failures"),
        none("propagated_failures").alias("propagated_failures"), none("patterns").alias("patterns"), "metrics", "decision_evidence", notes.alias("notes"), *(["digest"] if digests else []),
    )


def compare(ts: TraceSet, pairs: DataFrame) -> DataFrame:
    """pairs: current, baseline -> one row a pair: topology_identical, topology_changes (texts), behaviour_changes, pattern_count_deltas (one a
    preset), metric_deltas, baseline_digest."""
    changed = trees.differences(ts, pairs).groupBy("current", "baseline").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "change"))), lambda x: x["change"]).alias("topology_changes"))
    behaviour = trees.behaviour_changes(ts, pairs).groupBy("current", "baseline").agg(F.array_sort(F.collect_list(F.struct("key", safe(F.col("name")).alias("name"), "before", "after"))).alias("behaviour_changes"))
    deltas = metrics.deltas(ts, pairs)
    measured = deltas.select("current", "baseline", F.struct(*[c for c in deltas.columns if c not in ("current", "baseline")]).alias("metric_deltas"))
    counted = pattern_deltas(ts, pairs).groupBy("current", "baseline").agg(F.array_sort(F.collect_list(F.struct("pattern_id", "delta"))).alias("pattern_count_deltas"))
    out = pairs
    for part in (changed, behaviour, measured, counted):
        out = out.join(part, ["current", "baseline"], "left")
    out = out.join(motifs.digest(ts).toDF("baseline", "baseline_digest"), "baseline", "left")
    return out.select("current", "baseline", F.col("topology_changes").isNull().alias("topology_identical"), "topology_changes", "behaviour_changes", "pattern_count_deltas", "metric_deltas", "baseline_digest")


def pattern_deltas(ts: TraceSet, pairs: DataFrame, names: tuple[str, ...] = patterns.AUTO) -> DataFrame:
    """current, baseline, pattern_id, delta: how many more matches the current run has; every preset, zero too."""
    counts = patterns.sweep(ts, names).groupBy("trace_id", "pattern_id").agg(F.count(F.lit(1)).alias("n"))
    every = pairs.select("current", "baseline", F.explode(F.array(*map(F.lit, names))).alias("pattern_id"))
    side = lambda c: counts.select(F.col("trace_id").alias(c), "pattern_id", F.col("n").alias(f"n_{c}"))
    both = every.join(side("current"), ["current", "pattern_id"], "left").join(side("baseline"), ["baseline", "pattern_id"], "left")
    return both.select("current", "baseline", "pattern_id", (F.coalesce("n_current", F.lit(0)) - F.coalesce("n_baseline", F.lit(0))).cast("long").alias("delta"))


def check_report(ts: TraceSet, pairs: DataFrame, rules: list[str]) -> DataFrame:
    """One row a pair: verdict, and rules as an array of outcomes with their reasons and evidence."""
    outcomes = check.evaluate(ts, pairs, rules)
    listed = outcomes.groupBy("current", "baseline").agg(F.array_sort(F.collect_list(F.struct("rule", "outcome", "risen", "reasons", "evidence"))).alias("rules"))
    return listed.join(check.verdict(outcomes), ["current", "baseline"])


def as_json(report: DataFrame, *keys: str) -> DataFrame:
    """The keys, and a report's row as one JSON text (``report``)."""
    return report.select(*keys, F.to_json(F.struct(*sorted(report.columns)), {"ignoreNullFields": "false"}).alias("report"))
