"""Report documents: the analysis of a trace, the check of a pair of runs, the summary of a failure shape over many traces.

A document is one JSON text with its keys in order at every level and nulls written out, so equal findings give equal bytes. Names
are redacted where their shape isn't harmless; where an alias is left in a document, its warnings say so. Analyses and checks are one
document a trace or pair; a summary is JSON lines, one of the whole and one a group, as groups may be many.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causeway.functions.labels import known, safe
from causeway.operators import analysis, check, failures, metrics, motifs, trees
from causeway.plans import patterns
from causeway.plans.projection import needs_origin_priority
from causeway.schema import TraceSet
from causeway.session import staged

ANALYSIS_VERSION, CHECK_VERSION, SUMMARY_VERSION = 2, 1, 1
REDACTED = "Some names are shown as aliases, which are the same in every document; ids are shown as they are, so nothing here is anonymous."
#: What stands behind a PASS for runs whose layouts record no failure of their own.
UNRECORDED_FAILURES = "Failures that a checkpoint layout doesn't record can't be counted."


def ordered(value: Column, kind: T.DataType) -> Column:
    """The value with the fields of its structs and the keys of its maps in order, at every level."""
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[ordered(value[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: ordered(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.array_sort(F.map_entries(value)))
    return value


def _text(value: Column, kind: T.DataType) -> Column:
    return F.to_json(ordered(value, kind), {"ignoreNullFields": "false"})


def documents(rows: DataFrame, *keys: str) -> DataFrame:
    """The keys, and ``report``: the document of each row's column ``body``, a struct with an array ``warnings``."""
    kind = rows.schema["body"].dataType
    plain = rows.select(*keys, "body", _text(F.col("body"), kind).alias("report"))
    warned = F.col("body").withField("warnings", F.array_append("body.warnings", F.lit(REDACTED)))
    return plain.select(*keys, F.when(F.col("report").rlike("redacted:[0-9a-f]{64}"), _text(warned, kind)).otherwise(F.col("report")).alias("report"))


def _shown() -> Column:
    return F.struct("step_id", "seq", safe(F.col("name")).alias("name"), "kind", "status")


def _none(c: str) -> Column:
    return F.coalesce(c, F.array())


def findings(ts: TraceSet) -> DataFrame:
    """trace_id, patterns: every match of the presets that an analysis runs, with its steps' ids and redacted names, presets in their order and matches in theirs."""
    steps = staged(ts.steps.select("trace_id", "step_id", "seq", "kind", "name", "status", "error_msg", "source", "unknown_fields"))
    light, every = TraceSet(ts.traces, steps, staged(ts.edges.where("type = 'CAUSED_BY'"))), None
    for turn, p in enumerate(patterns.PRESETS[n] for n in patterns.AUTO):
        n = range(len(p.steps))
        place = F.array(*[F.struct(F.col(f"s{i}_seq").alias("seq"), F.col(f"s{i}").alias("id")) for i in n])
        told = F.struct(F.lit(p.pattern_id).alias("pattern_id"), F.lit(p.pattern_version).alias("pattern_version"), F.array(*[f"s{i}" for i in n]).alias("step_ids"), F.array(*[safe(F.col(f"s{i}_name")) for i in n]).alias("labels"))
        got = patterns.matches(light, p, details=True).select("trace_id", F.struct(F.lit(turn).alias("turn"), place.alias("place"), told.alias("told")).alias("hit"))
        every = got if every is None else every.unionByName(got)
    return every.groupBy("trace_id").agg(F.transform(F.array_sort(F.collect_list("hit")), lambda h: h["told"]).alias("patterns"))


def _failures(ts: TraceSet, split: DataFrame) -> DataFrame:
    """trace_id, primary_failures, propagated_failures: each primary one with the steps behind it and the causes among them."""
    steps = ts.steps.select("trace_id", "step_id", _shown().alias("step"))
    at = lambda c, n: ts.steps.select("trace_id", F.col("step_id").alias(c), F.col("seq").alias(n))
    behind = failures.causal_steps(ts, split).join(steps, ["trace_id", "step_id"]).groupBy("trace_id", "failure").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("step.seq", "step.step_id", "step"))), lambda x: x["step"]).alias("causal_steps")
    )
    edge = F.struct("effect_seq", "cause_seq", "effect", "cause", F.struct("effect", "cause", "origin").alias("edge"))
    inside = failures.causal_edges(ts, split).join(at("effect", "effect_seq"), ["trace_id", "effect"]).join(at("cause", "cause_seq"), ["trace_id", "cause"])
    edges = inside.groupBy("trace_id", "failure").agg(F.transform(F.array_sort(F.collect_list(edge)), lambda x: x["edge"]).alias("causal_edges"))
    rows = split.select("trace_id", "step_id", "primary", "rank").join(steps, ["trace_id", "step_id"]).withColumnRenamed("step_id", "failure")
    rows = rows.join(behind, ["trace_id", "failure"], "left").join(edges, ["trace_id", "failure"], "left")
    finding = F.struct("rank", F.struct("step", _none("causal_steps").alias("causal_steps"), _none("causal_edges").alias("causal_edges")).alias("told"))
    listed = lambda on, x: F.transform(F.array_sort(F.collect_list(F.when(on, x))), lambda y: y["told"])
    return rows.groupBy("trace_id").agg(
        listed(F.col("primary"), finding).alias("primary_failures"), listed(~F.col("primary"), F.struct("rank", F.col("step").alias("told"))).alias("propagated_failures")
    )


def _comparison(ts: TraceSet, pairs: DataFrame) -> DataFrame:
    """current, baseline, comparison."""
    hidden = TraceSet(ts.traces, ts.steps.withColumn("name", safe(F.col("name"))), ts.edges)  # aliases are equal where names are
    c = analysis.compare(ts, pairs).drop("topology_identical", "topology_changes")
    changed = trees.differences(hidden, pairs).groupBy("current", "baseline").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "change"))), lambda x: x["change"]).alias("topology_changes"))
    m = F.col("metric_deltas")
    deltas = F.struct(m["wall_delta"].alias("wall_duration_ms"), *[m[f"{c}_delta"].alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")], m["cost_delta"].alias("total_cost"))
    told = F.struct(
        "baseline_digest", F.col("topology_changes").isNull().alias("topology_identical"), _none("topology_changes").alias("topology_changes"),
        F.transform(_none("behaviour_changes"), lambda x: F.struct(x["key"].alias("logical_step_key"), x["name"].alias("name"), x["before"].alias("before"), x["after"].alias("after"))).alias("behavior_changes"),
        F.map_from_entries("pattern_count_deltas").alias("pattern_count_deltas"), deltas.alias("metric_deltas"),
    )
    return c.join(changed, ["current", "baseline"], "left").select("current", "baseline", told.alias("comparison"))


def analyses(ts: TraceSet, pairs: DataFrame | None = None) -> DataFrame:
    """One document a trace (version 2): trace_id, report. pairs (current, baseline): one a pair instead, with what changed since the baseline:
    current, baseline, report. The findings of one trace are gathered in its row."""
    ts = ts.staged()
    split = staged(failures.explained(ts))
    rows = analysis.analyze(ts, split).drop("primary_failures", "propagated_failures", "patterns")
    seq = ts.steps.select("trace_id", "step_id", "seq", F.posexplode("evidence.evaluations").alias("place", "e"))
    item = F.struct("step_id", safe(F.col("e.name")).alias("name"), safe(F.col("e.label")).alias("label"), F.col("e.score").alias("score"))
    judged = seq.groupBy("trace_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "step_id", "place", item.alias("told")))), lambda x: x["told"]).alias("evaluations"))
    for part in (_failures(ts, split), findings(ts), judged):
        rows = rows.join(part, "trace_id", "left")
    if pairs is not None:
        rows = rows.join(_comparison(ts, pairs).withColumnRenamed("current", "trace_id"), "trace_id")
    text = F.create_map(*[F.lit(x) for pair in analysis.NOTES.items() for x in pair])
    measured = F.struct(*[F.col(f"metrics.{c}").alias(c) for c in ("wall_duration_ms", "prompt_tokens", "completion_tokens", "total_tokens", "total_cost")], safe(F.col("metrics.cost_currency")).alias("cost_currency"), _none("evaluations").alias("evaluations"))
    body = F.struct(
        F.lit(ANALYSIS_VERSION).alias("schema_version"), F.lit("causeway.analysis").alias("kind"), F.col("digest").alias("artifact_digest"), "trace_id", "source_kind", "status", "causal_fidelity", "links_preserved",
        "step_count", "error_count", *[_none(c).alias(c) for c in ("primary_failures", "propagated_failures", "patterns")], measured.alias("metrics"), _none("decision_evidence").alias("decision_evidence"),
        (F.col("comparison") if pairs is not None else F.lit(None).cast("string")).alias("comparison"), F.transform("notes", lambda n: text[n]).alias("warnings"), F.lit("safe-v1").alias("privacy_profile"),
    ).alias("body")
    if pairs is None:
        return documents(rows.select("trace_id", body), "trace_id")
    return documents(rows.select(F.col("trace_id").alias("current"), "baseline", body), "current", "baseline")


def contexts(ts: TraceSet) -> DataFrame:
    """trace_id, context: what a check says of each run."""
    ranked = needs_origin_priority(ts).select("trace_id", F.lit(True).alias("ranked"))
    n = ts.steps.groupBy("trace_id").agg(F.count(F.lit(1)).alias("step_count"))
    rows = ts.traces.join(n, "trace_id", "left").join(ranked, "trace_id", "left").join(motifs.digest(ts), "trace_id", "left")
    context = F.struct(
        F.col("digest").alias("artifact_digest"), "trace_id", safe(F.col("source_kind")).alias("source_kind"), "causal_fidelity", "links_preserved", F.when(F.col("ranked"), "origin_priority").otherwise("temporal").alias("projection_rule"),
        F.col("schedule_graph.fingerprint").alias("schedule_graph_fingerprint"), F.coalesce("step_count", F.lit(0)).alias("step_count"), F.array_sort("capture.gaps").alias("capture_gaps"),
    )
    return rows.select("trace_id", context.alias("context"))


def _counted(ts: TraceSet, pairs: DataFrame, rule: str) -> DataFrame:
    """current, baseline, evidence (JSON): signatures that rose, counts on both sides and the current run's ids; last the count of unknown signature, where there is any."""
    preset = rule.partition(":")[2]
    if preset:
        p = patterns.PRESETS[preset]
        n = range(len(p.steps))
        sure = reduce(lambda a, b: a & b, [known("kind", f"s{i}_") & known("name", f"s{i}_") for i in n])
        shown = F.array(*[F.struct(F.col(f"s{i}_kind").alias("kind"), safe(F.col(f"s{i}_name")).alias("name")) for i in n])
        flat = check.confirmed(ts, p).where("confirmed").select("trace_id", F.array(*[f"s{i}" for i in n]).alias("ids"), F.when(sure, shown).alias("signature"))
        noun, empty = "matches", F.array().cast("array<array<string>>")
    else:
        sure = known("kind") & known("name")
        flat = ts.steps.where("status = 'error'").select("trace_id", F.col("step_id").alias("ids"), F.when(sure, F.struct("kind", safe(F.col("name")).alias("name"))).alias("signature"))
        noun, empty = "errors", F.array().cast("array<string>")
    counts = flat.groupBy("trace_id", "signature").agg(F.count(F.lit(1)).alias("n"))
    side = lambda s: pairs.join(counts, pairs[s] == counts["trace_id"]).select("current", "baseline", "signature", F.lit(s).alias("side"), "n")
    of = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col("n"))), F.lit(0))
    both = side("current").union(side("baseline")).groupBy("current", "baseline", "signature").agg(of("baseline").alias("b"), of("current").alias("c"))
    risen = both.where(F.col("c") > F.when(F.col("signature").isNull(), F.lit(0)).otherwise(F.col("b")))
    ids = flat.groupBy(F.col("trace_id").alias("current"), F.col("signature").alias("s")).agg(F.array_sort(F.collect_list("ids")).alias("ids"))
    met = risen.join(ids, (risen["current"] == ids["current"]) & risen["signature"].eqNullSafe(ids["s"])).drop(ids["current"])
    told = F.struct("signature", F.col("b").alias(f"baseline_{noun}"), F.col("c").alias(f"current_{noun}"), F.coalesce("ids", empty).alias("current_step_ids"))
    listed = met.groupBy("current", "baseline").agg(F.array_sort(F.collect_list(F.struct(F.col("signature").isNull().alias("last"), "signature", told.alias("told")))).alias("x"))
    rows = listed.select("current", "baseline", F.transform("x", lambda x: x["told"]).alias("evidence"))
    return rows.select("current", "baseline", _text(F.col("evidence"), rows.schema["evidence"].dataType).alias("evidence"))


def _changed(ts: TraceSet, pairs: DataFrame, shape_only: bool) -> DataFrame:
    """current, baseline, evidence (JSON): where the trees differ; without labels if shapes alone are compared."""
    steps = ts.steps.withColumns({"name": F.lit(None).cast("string"), "kind": F.lit("step")}) if shape_only else ts.steps.withColumn("name", safe(F.col("name")))
    found = trees.differences(TraceSet(ts.traces, steps, ts.edges), pairs).groupBy("current", "baseline").agg(F.array_sort(F.collect_list(F.struct("position", "change"))).alias("x"))
    return found.select("current", "baseline", F.to_json(F.transform("x", lambda x: F.struct(x["change"].alias("change")))).alias("evidence"))


def checks(ts: TraceSet, pairs: DataFrame, rules: list[str]) -> DataFrame:
    """One document a pair (version 1): current, baseline, report. A rule whose outcome isn't settled by missing preconditions has its evidence;
    that of changed trees is there where the rule failed."""
    rules, ts, every = check.parse_rules(rules), ts.staged(), None
    outcomes = staged(check.evaluate(ts, pairs, rules))
    for turn, rule in enumerate(rules):
        rule_id, _, what = rule.partition(":")
        own = outcomes.where(F.col("rule") == rule)
        if rule_id == "topology-unchanged":
            failed = staged(own.where(F.col("outcome") == check.FAIL).select("current", "baseline"))
            params, found = {"compare": what or "labels"}, _changed(ts, failed, what == "shape")
        else:
            params = {"preset": what, "pattern_version": patterns.PRESETS[what].pattern_version} if what else {}
            settled = F.forall("reasons", lambda r: r.endswith(":may_hide"))
            found = _counted(ts, own.where(settled).select("current", "baseline"), rule)
        fixed = F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in sorted(params.items())])) if params else F.lit("{}")
        checkpoints = (F.col("source_kind") == "langgraph") & (F.col("outcome") == check.PASS) if rule_id != "topology-unchanged" else F.lit(False)
        rows = own.join(found.withColumnRenamed("evidence", "found"), ["current", "baseline"], "left").join(ts.traces.select(F.col("trace_id").alias("current"), "source_kind"), "current")
        told = F.struct(
            F.lit(turn).alias("turn"), F.lit(rule_id).alias("rule_id"), F.lit(1).alias("rule_version"), fixed.alias("params"), "outcome", "reasons",
            F.when(checkpoints, F.array(F.lit(UNRECORDED_FAILURES))).otherwise(F.array().cast("array<string>")).alias("limitations"), F.coalesce("found", F.lit("[]")).alias("evidence"),
        )
        got = rows.select("current", "baseline", told.alias("rule"))
        every = got if every is None else every.unionByName(got)
    listed = every.groupBy("current", "baseline").agg(F.array_sort(F.collect_list("rule")).alias("rules"))
    # parameters and evidence differ from rule to rule, so they are JSON values of no fixed shape
    free = F.transform("rules", lambda r: r.dropFields("turn").withField("params", F.parse_json(r["params"])).withField("evidence", F.parse_json(r["evidence"])))
    told_of = staged(contexts(ts))
    side = lambda c: told_of.toDF(c, f"{c}_context")
    rows = listed.join(check.verdict(outcomes), ["current", "baseline"]).join(side("current"), "current").join(side("baseline"), "baseline")
    body = F.struct(
        F.lit(CHECK_VERSION).alias("schema_version"), F.lit("causeway.check").alias("kind"), "verdict", F.col("current_context").alias("current"), F.col("baseline_context").alias("baseline"), free.alias("rules"),
        F.array().cast("array<string>").alias("warnings"), F.lit("safe-v1").alias("privacy_profile"),
    )
    return documents(rows.select("current", "baseline", body.alias("body")), "current", "baseline")


def shape(prefix: str) -> Column:
    """A matched step as its signature has it: fields whose value isn't known are null, and listed."""
    fields = ("kind", "name", "status")
    value = lambda f: safe(F.col(prefix + f)) if f == "name" else F.col(prefix + f)
    listed = F.array_compact(F.array(*[F.when(~known(f, prefix), f) for f in fields])).cast("array<string>")
    return F.struct(*[F.when(known(f, prefix), value(f)).alias(f) for f in fields], F.col(prefix + "source").alias("source"), listed.alias("unknown"))


def motif_groups(ts: TraceSet, pattern: patterns.PathPattern) -> DataFrame:
    """signature (a JSON text), match_count, trace_count, representatives (the three smallest by digest, then ids), rank: by traces, then matches, most
    first, then signature. Counts are taken per trace first; representatives are cut to three before they are shuffled."""
    if not pattern.strict or pattern.pattern_id is None:
        raise ValueError("only strict, versioned patterns can be summarised")
    found, n = motifs.with_origins(ts, pattern).where("confirmed"), range(len(pattern.steps))
    head = ts.traces.select("trace_id", safe(F.col("source_kind")).alias("source_kind"), "causal_fidelity", "links_preserved", motifs.guessed(pattern).alias("heuristic_edges"))
    signature = F.struct(
        F.lit(pattern.pattern_id).alias("pattern_id"), F.lit(pattern.pattern_version).alias("pattern_version"), "source_kind", "causal_fidelity", "links_preserved", "heuristic_edges",
        F.array(*[shape(f"s{i}_") for i in n]).alias("steps"), F.array(*[F.col(f"o{i}") for i in n[1:]]).cast("array<string>").alias("edge_origins"),
    )
    rows = found.join(head, "trace_id").select("trace_id", signature.alias("s"), F.array(*[f"s{i}" for i in n]).alias("step_ids"))
    rows = staged(rows.select("trace_id", _text(F.col("s"), rows.schema["s"].dataType).alias("signature"), "step_ids"))
    per = rows.groupBy("signature", "trace_id").agg(F.count(F.lit(1)).alias("n"))
    counted = per.groupBy("signature").agg(F.sum("n").alias("match_count"), F.count(F.lit(1)).alias("trace_count"))
    known_as = rows.join(motifs.digest(ts.where(rows.select("trace_id").distinct())).withColumnRenamed("digest", "artifact_digest"), "trace_id")
    first = known_as.select("signature", F.struct("artifact_digest", "step_ids").alias("r")).withColumn("p", F.row_number().over(Window.partitionBy("signature").orderBy("r"))).where("p <= 3")
    few = first.groupBy("signature").agg(F.array_sort(F.collect_list("r")).alias("representatives"))
    return motifs.ranked(counted.join(few, "signature"), [F.desc("trace_count"), F.desc("match_count"), F.asc("signature")])


def motif_lines(ts: TraceSet, pattern: patterns.PathPattern, skipped: int = 0) -> DataFrame:
    """position, report: a summary (version 1) as JSON lines in the order of position: at 0 the pattern and its coverage, then the groups by rank.
    skipped: how many artifacts were found but couldn't be read."""
    ts = ts.staged()
    c = motifs.coverage(ts, pattern)
    coverage = F.struct(
        (F.col("n_traces") + skipped).alias("artifacts_discovered"), F.col("n_traces").alias("artifacts_valid"), F.lit(skipped).alias("artifacts_skipped"), F.col("matched").alias("traces_matched"), F.col("may_hide").alias("traces_may_hide_matches"),
        F.col("with_gaps").alias("traces_with_disclosed_gaps"), F.col("without_record").alias("traces_without_provenance"), F.col("unconfirmed").alias("unconfirmed_matches"), F.col("with_unconfirmed").alias("traces_with_unconfirmed_matches"),
    )
    named = F.struct(F.lit(pattern.pattern_id).alias("id"), F.lit(pattern.pattern_version).alias("version"))
    whole = c.select(F.struct(F.lit(SUMMARY_VERSION).alias("schema_version"), F.lit("causeway.motif-summary").alias("kind"), F.lit("motif-signature/v1").alias("signature_version"), F.lit("safe-v1").alias("privacy_profile"), named.alias("pattern"), coverage.alias("coverage")).alias("body"))
    groups = motif_groups(ts, pattern)
    body = groups.select("rank", F.struct(F.parse_json("signature").alias("signature"), "match_count", "trace_count", "representatives").alias("body"))
    line = lambda df, place: df.select(place.cast("int").alias("position"), _text(F.col("body"), df.schema["body"].dataType).alias("report"))
    return line(whole, F.lit(0)).unionByName(line(body, F.col("rank")))
