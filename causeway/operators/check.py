"""Regression rules with three outcomes: PASS, FAIL, INSUFFICIENT_EVIDENCE.

A rule compares a current run with a baseline. It fails only if something rose and nothing unknown in the
baseline could explain it; it passes only if nothing rose and nothing unknown in the current run could hide it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway import schema
from causeway.functions.labels import gaps_have, gaps_hide, known
from causeway.operators.trees import shapes
from causeway.plans import patterns
from causeway.schema import TraceSet
from causeway.session import staged

PASS, FAIL, OPEN = "PASS", "FAIL", "INSUFFICIENT_EVIDENCE"
HIDES = schema.OMITS_STEPS + schema.REWRITTEN_ERRORS


def decide(rose: Column, baseline_open: Column, current_open: Column) -> Column:
    return F.when(rose & ~baseline_open, FAIL).when(~rose & ~current_open, PASS).otherwise(OPEN)


def failure_counts(ts: TraceSet) -> DataFrame:
    """trace_id, kind, name, n: failures by signature; kind null: of unknown signature."""
    sure = known("kind") & known("name")
    failed = ts.steps.where("status = 'error'")
    return failed.groupBy("trace_id", F.when(sure, F.col("kind")).alias("kind"), F.when(sure, F.col("name")).alias("name")).agg(F.count(F.lit(1)).alias("n"))


def _headers(ts: TraceSet) -> DataFrame:
    """What preconditions need of each trace."""
    cap = F.col("capture")
    per = ts.steps.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n_steps"), F.bool_or(F.col("status") == "unset").alias("unset"), F.bool_or(~(known("kind") & known("name"))).alias("unlabelled"))
    return ts.traces.join(per, "trace_id", "left").select(
        "trace_id", "source_kind", "causal_fidelity", "links_preserved", F.col("schedule_graph.fingerprint").alias("graph"), cap.isNull().alias("no_record"), F.coalesce("n_steps", F.lit(0)).alias("n_steps"),
        F.coalesce("unset", F.lit(False)).alias("unset"), F.coalesce("unlabelled", F.lit(False)).alias("unlabelled"), gaps_hide(cap, HIDES).alias("hides"), gaps_hide(cap, schema.OMITS_STEPS).alias("omits"),
        gaps_hide(cap, schema.HEURISTIC_EDGES).alias("guessed"), gaps_have(cap, schema.UNDECIDED_EDGES).alias("undecided"), gaps_have(cap, schema.REWRITTEN_ERRORS).alias("rewritten"),
    )


def _sides(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """pairs with a table's columns for either side, as c_... and b_..."""
    out = pairs
    for side, key in (("c", "current"), ("b", "baseline")):
        own = table.select(*[F.col(c).alias(f"{side}_{c}") for c in table.columns])
        out = out.join(own, out[key] == own[f"{side}_trace_id"], "left")
    return out


#: Why two runs can't be compared, or an outcome isn't known: (code, condition) each, codes led by the side that it is about.
Reasons = list[tuple[str, Column]]


def _both(code: str, column: str) -> Reasons:
    return [(f"{side}:{code}", F.col(f"{side[0]}_{column}")) for side in ("current", "baseline")]


def _listed(reasons: Reasons) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), code) for code, c in reasons])).cast("array<string>")


def _common() -> Reasons:
    """Whether the two runs can be compared at all."""
    empty = [(f"{side}:no_steps", F.col(f"{side[0]}_n_steps") == 0) for side in ("current", "baseline")]
    return _both("no_capture_record", "no_record") + empty + [("different_sources", F.col("c_source_kind") != F.col("b_source_kind"))]


def _causal() -> Reasons:
    differ = (F.col("c_causal_fidelity") != F.col("b_causal_fidelity")) | ~F.col("c_links_preserved").eqNullSafe(F.col("b_links_preserved"))
    return [("different_causal_settings", differ)] + _both("heuristic_edges", "guessed") + _both("undecided_edges", "undecided")


def _risen(pairs: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """Per pair: risen (signatures with more than before), more (the total rose), and the counts of unknown signature on both sides.
    counts: trace_id, keys, n; all keys null: unknown signature."""
    sig = F.to_json(F.struct(*[F.coalesce(F.col(k), F.lit("")).alias(k) for k in keys], *[F.col(k).isNull().alias(f"{k}_null") for k in keys]))
    flat = counts.select("trace_id", sig.alias("sig"), F.col(keys[0]).isNull().alias("unknown"), "n")
    cur = pairs.join(flat, pairs["current"] == flat["trace_id"]).select("current", "baseline", "sig", "unknown", F.col("n").alias("c"))
    base = pairs.join(flat, pairs["baseline"] == flat["trace_id"]).select("current", "baseline", "sig", "unknown", F.col("n").alias("b"))
    both = cur.join(base, ["current", "baseline", "sig", "unknown"], "full_outer").na.fill(0, ["c", "b"])
    per = both.groupBy("current", "baseline").agg(
        F.count_if(~F.col("unknown") & (F.col("c") > F.col("b"))).alias("risen"), (F.sum("c") > F.sum("b")).alias("more"),
        F.array_sort(F.collect_list(F.when(~F.col("unknown") & (F.col("c") > F.col("b")), F.struct(F.col("sig").alias("signature"), F.col("b").alias("baseline"), F.col("c").alias("current"))))).alias("evidence"),
        F.sum(F.when(F.col("unknown"), F.col("c")).otherwise(0)).alias("c_unknown"), F.sum(F.when(F.col("unknown"), F.col("b")).otherwise(0)).alias("b_unknown"),
    )
    return pairs.join(per, ["current", "baseline"], "left").na.fill(0, ["risen", "c_unknown", "b_unknown"]).na.fill(False, ["more"])


def _outcome(rows: DataFrame, rule: str, blocking: Reasons, outcome: Column, risen: Column, hidden: Reasons = ()) -> DataFrame:
    why = _listed(blocking)
    none = F.array().cast("array<string>")
    reasons = F.when(F.size(why) > 0, why).when(outcome == OPEN, _listed(list(hidden)) if hidden else none).otherwise(none)
    evidence = F.col("evidence") if "evidence" in rows.columns else F.lit(None)
    return rows.select(
        "current", "baseline", F.lit(rule).alias("rule"), F.when(F.size(why) > 0, OPEN).otherwise(outcome).alias("outcome"), risen.cast("long").alias("risen"),
        reasons.alias("reasons"), evidence.cast("array<struct<signature: string, baseline: bigint, current: bigint>>").alias("evidence"),
    )


def _may_hide_reasons(rose: Column, baseline_open: Column, current_open: Column) -> Reasons:
    return [("baseline:may_hide", rose & baseline_open), ("current:may_hide", ~rose & current_open)]


def failures_not_increased(ts: TraceSet, pairs: DataFrame) -> DataFrame:
    """current, baseline, rule, outcome, risen, reasons (codes, where the outcome isn't known), evidence (signatures that rose)."""
    rows = _sides(_risen(pairs, failure_counts(ts), ["kind", "name"]), _headers(ts))
    rose = (F.col("risen") > 0) | F.col("more")
    is_open = lambda s: (F.col(f"{s}_unknown") > 0) | F.col(f"{s}_unset") | F.col(f"{s}_hides")
    return _outcome(rows, "failures-not-increased", _common(), decide(rose, is_open("b"), is_open("c")), F.col("risen"), _may_hide_reasons(rose, is_open("b"), is_open("c")))


def may_hide(ts: TraceSet, pattern: patterns.PathPattern) -> DataFrame:
    """trace_id: traces in which something unknown could add a match."""
    by_step = F.lit(False)
    for p, fields in zip(pattern.steps, pattern.constrained()):
        unknown = reduce(lambda a, b: a | b, [~known(f) for f in sorted(fields)], F.lit(False))
        parts = [("kind", p.kind and F.col("kind") == p.kind), ("status", p.status and F.col("status") == p.status), ("error_msg", p.error_contains and F.coalesce(F.col("error_msg").contains(p.error_contains), F.lit(False)))]
        parts += [("name", p.name and F.col("name") == p.name), ("name", p.name_prefix and F.col("name").startswith(p.name_prefix))]
        fits = reduce(lambda a, b: a & b, [~known(f) | F.coalesce(c, F.lit(False)) for f, c in parts if c is not None], F.lit(True))
        by_step = by_step | (unknown & fits)
    steps = ts.steps.where(by_step).select("trace_id").distinct()
    return ts.traces.where(gaps_hide(F.col("capture"), HIDES)).select("trace_id").union(steps).distinct()


def confirmed(ts: TraceSet, pattern: patterns.PathPattern) -> DataFrame:
    """Matches on whose steps every constrained field is known."""
    sure = F.lit(True)
    for i, fields in enumerate(pattern.constrained()):
        for f in sorted(fields):
            sure = sure & known(f, f"s{i}_")
    return patterns.matches(ts, pattern, details=True).withColumn("confirmed", sure)


def pattern_not_increased(ts: TraceSet, pairs: DataFrame, pattern: patterns.PathPattern) -> DataFrame:
    """current, baseline, rule, outcome, risen, reasons, evidence."""
    n = range(len(pattern.steps))
    sure = reduce(lambda a, b: a & b, [known("kind", f"s{i}_") & known("name", f"s{i}_") for i in n])
    keys = [f"{f}{i}" for i in n for f in ("kind", "name")]
    found = confirmed(ts, pattern).where("confirmed").select("trace_id", *[F.when(sure, F.col(f"s{i}_{f}")).alias(f"{f}{i}") for i in n for f in ("kind", "name")])
    counts = found.groupBy("trace_id", *keys).agg(F.count(F.lit(1)).alias("n"))
    hidden = may_hide(ts, pattern).withColumn("may_hide", F.lit(True))
    head = _headers(ts).join(hidden, "trace_id", "left").na.fill(False, ["may_hide"])
    rows = _sides(_risen(pairs, counts, keys), head)
    rose = (F.col("risen") > 0) | F.col("more")
    is_open = lambda s: (F.col(f"{s}_unknown") > 0) | F.col(f"{s}_may_hide")
    blocking = _common()
    if len(pattern.steps) > 1:
        blocking += _causal()
    if any(p.status == "ok" for p in pattern.steps):
        blocking += _both("rewritten_errors", "rewritten")
    return _outcome(rows, f"pattern-not-increased:{pattern.pattern_id}", blocking, decide(rose, is_open("b"), is_open("c")), F.col("risen"), _may_hide_reasons(rose, is_open("b"), is_open("c")))


def topology_unchanged(ts: TraceSet, pairs: DataFrame, shape_only: bool = False) -> DataFrame:
    """current, baseline, rule, outcome, risen (null), reasons, evidence (null)."""
    rows = _sides(pairs, staged(_headers(ts).join(shapes(ts, shape_only), "trace_id", "left")))
    blocking = _common() + _causal() + [("different_graphs", ~F.col("c_graph").eqNullSafe(F.col("b_graph")))] + _both("omitted_steps", "omits")
    if not shape_only:
        blocking += _both("unlabelled_steps", "unlabelled")
    same = F.when(F.col("c_shape").eqNullSafe(F.col("b_shape")), PASS).otherwise(FAIL)
    return _outcome(rows, "topology-unchanged" + (":shape" if shape_only else ""), blocking, same, F.lit(None))


def parse_rules(texts: list[str]) -> list[str]:
    """Rules without repeats, in canonical order; an unknown one is an error."""
    allowed = ["failures-not-increased", *[f"pattern-not-increased:{p}" for p in patterns.PRESETS], "topology-unchanged", "topology-unchanged:shape"]
    if bad := [t for t in texts if t not in allowed]:
        raise ValueError(f"no such rule: {bad[0]}")
    return [r for r in allowed if r in set(texts)]


def evaluate(ts: TraceSet, pairs: DataFrame, rules: list[str]) -> DataFrame:
    """One row a pair and rule."""
    out = None
    for r in parse_rules(rules):
        name, _, what = r.partition(":")
        got = failures_not_increased(ts, pairs) if name == "failures-not-increased" else pattern_not_increased(ts, pairs, patterns.PRESETS[what]) if name == "pattern-not-increased" else topology_unchanged(ts, pairs, what == "shape")
        out = got if out is None else out.unionByName(got)
    return out


def verdict(outcomes: DataFrame) -> DataFrame:
    """current, baseline, verdict: FAIL over INSUFFICIENT_EVIDENCE over PASS."""
    rank = F.when(F.col("outcome") == FAIL, 2).when(F.col("outcome") == OPEN, 1).otherwise(0)
    top = outcomes.groupBy("current", "baseline").agg(F.max(rank).alias("worst"))
    return top.select("current", "baseline", F.when(F.col("worst") == 2, FAIL).when(F.col("worst") == 1, OPEN).otherwise(PASS).alias("verdict"))
