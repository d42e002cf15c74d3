"""Failure shapes across traces, review candidates and incident memos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions.labels import heuristic_edges, known, label, run_alias, safe
from causeway.operators import failures
from causeway.operators.check import confirmed, may_hide
from causeway.plans import patterns
from causeway.plans.projection import causes
from causeway.schema import TraceSet
from causeway.session import staged
from causeway.sources.artifacts import to_text


def digest(ts: TraceSet) -> DataFrame:
    """trace_id, digest: the SHA-256 of each trace's canonical document."""
    return to_text(ts, check=False).select("trace_id", "digest")


def with_origins(ts: TraceSet, pattern: patterns.PathPattern) -> DataFrame:
    """Matches of a strict pattern with their steps' details, whether they are confirmed, and the origin of each edge as o1, o2, ..."""
    found, edges = confirmed(ts, pattern), causes(ts)
    for i in range(1, len(pattern.steps)):
        found = found.join(edges.select("trace_id", F.col("src").alias(f"s{i}"), F.col("dst").alias(f"s{i - 1}"), F.col("origin").alias(f"o{i}")), ["trace_id", f"s{i}", f"s{i - 1}"])
    return found


def guessed(pattern: patterns.PathPattern) -> Column:
    """Whether a trace discloses edges chosen by heuristics; a single step has no edge."""
    return heuristic_edges(F.col("capture")) if len(pattern.steps) > 1 else F.lit("not_applicable")


def _signed(ts: TraceSet, pattern: patterns.PathPattern) -> DataFrame:
    """Confirmed matches with their signature as text."""
    if not pattern.strict or pattern.pattern_id is None:
        raise ValueError("only strict, versioned patterns can be summarised")
    found = with_origins(ts, pattern)
    head = ts.traces.select("trace_id", F.concat_ws("/", safe(F.col("source_kind")), "causal_fidelity", F.coalesce(F.col("links_preserved").cast("string"), F.lit("unknown")), guessed(pattern)).alias("head"))
    shape = lambda i: F.concat_ws(":", *[F.when(known(f, f"s{i}_"), safe(F.col(f"s{i}_{f}"))).otherwise("?") for f in ("kind", "name", "status")], F.col(f"s{i}_source"))
    steps = [x for i in range(len(pattern.steps)) for x in ([F.coalesce(F.col(f"o{i}"), F.lit("none"))] if i else []) + [shape(i)]]
    path = F.concat_ws(">", *[f"s{i}" for i in range(len(pattern.steps))])
    return found.join(head, "trace_id").select("trace_id", "confirmed", F.concat_ws(" ", "head", *steps).alias("signature"), path.alias("path"))


def partial(ts: TraceSet, pattern: patterns.PathPattern) -> DataFrame:
    """signature, match_count, trace_count, first: a summary that can be stored and merged with those of other traces. Matches are counted per trace
    first and the smallest three kept at each fold, so a frequent shape is never gathered."""
    rows = _signed(ts, pattern).where("confirmed")
    per = rows.groupBy("signature", "trace_id").agg(F.count(F.lit(1)).alias("n"))
    counted = per.groupBy("signature").agg(F.sum("n").alias("match_count"), F.count(F.lit(1)).alias("trace_count"))
    few = rows.select("signature", F.concat_ws("/", "trace_id", "path").alias("rep"))
    three = few.withColumn("p", F.row_number().over(Window.partitionBy("signature").orderBy("rep"))).where("p <= 3").groupBy("signature").agg(F.array_sort(F.collect_list("rep")).alias("first"))
    return counted.join(three, "signature")


def merge(*parts: DataFrame) -> DataFrame:
    """Partial summaries of traces that are in one of them only, as one partial summary. The order doesn't matter."""
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    first = F.slice(F.array_sort(F.flatten(F.collect_list("first"))), 1, 3)  # three of each part
    return every.groupBy("signature").agg(F.sum("match_count").alias("match_count"), F.sum("trace_count").alias("trace_count"), first.alias("first"))


def finish(summary: DataFrame) -> DataFrame:
    """signature, match_count, trace_count, representatives (the three smallest, comma-joined), rank of a partial summary."""
    rows = summary.select("signature", "match_count", "trace_count", F.array_join("first", ",").alias("representatives"))
    return ranked(rows, [F.desc("trace_count"), F.desc("match_count"), F.asc("signature")])


def groups(ts: TraceSet, pattern: patterns.PathPattern) -> DataFrame:
    """signature, match_count, trace_count, representatives, rank: the summary of these traces alone."""
    return finish(partial(ts, pattern))


def ranked(rows: DataFrame, order: list) -> DataFrame:
    """rows with their place in the order, from 1: a range sort, then running numbers from each range's first; no task gets all rows."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = staged(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    first = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return dealt.join(first, "part").withColumn("rank", (F.col("first") + place).cast("int")).drop("part", "first")


def coverage(ts: TraceSet, pattern: patterns.PathPattern) -> DataFrame:
    """One row: how many traces there are, match, may hide matches, disclose gaps, have no record, and what is unconfirmed."""
    found = confirmed(ts, pattern).groupBy("trace_id").agg(F.count_if("confirmed").alias("sure"), F.count_if(~F.col("confirmed")).alias("unsure"))
    hidden = may_hide(ts, pattern).withColumn("hidden", F.lit(1))
    rows = ts.traces.select("trace_id", "capture").join(found, "trace_id", "left").join(hidden, "trace_id", "left")
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return rows.agg(
        F.count(F.lit(1)).alias("n_traces"), count(F.col("sure") > 0).alias("matched"), count(F.col("hidden") == 1).alias("may_hide"), count(F.size("capture.gaps") > 0).alias("with_gaps"),
        count(F.col("capture").isNull()).alias("without_record"), F.coalesce(F.sum("unsure"), F.lit(0)).alias("unconfirmed"), count(F.col("unsure") > 0).alias("with_unconfirmed"),
    )


def review_candidates(ts: TraceSet, pattern: patterns.PathPattern, separator: str = "::") -> DataFrame:
    """run_id, pattern_id, pattern_version, tool_key, digest: distinct failing tools for review. A run without id, or a tool whose
    name isn't server, separator, tool without white space, is an error."""
    if not pattern.exportable or pattern.pattern_id is None:
        raise ValueError("this pattern cannot be exported for review")
    end = len(pattern.steps) - 1
    rows = patterns.matches(ts, pattern, details=True).join(ts.traces.select("trace_id", "run_id"), "trace_id").join(digest(ts), "trace_id")
    key = F.col(f"s{end}_name")
    fit = F.coalesce(key.rlike(rf"^[^\s]+?{separator}[^\s]+$"), F.lit(False))
    checked = F.when(F.col("run_id").isNull(), F.raise_error(F.concat(F.lit("no run_id: "), "trace_id")).cast("string")).when(~fit, F.raise_error(F.concat(F.lit("no server-qualified tool: "), "trace_id")).cast("string")).otherwise(key)
    return rows.select("run_id", F.lit(pattern.pattern_id).alias("pattern_id"), F.lit(pattern.pattern_version).alias("pattern_version"), checked.alias("tool_key"), "digest").distinct()


def memo_lines(ts: TraceSet) -> DataFrame:
    """trace_id, section, position, text: an incident memo's lines. Steps appear under aliases, runs under a digest, no message does."""
    ts = ts.staged()
    failed = staged(failures.split(ts))
    alias = Window.partitionBy("trace_id").orderBy("seq", "step_id")
    names = ts.steps.select("trace_id", "step_id", "seq", "kind", F.concat_ws("_", F.lit("step"), F.row_number().over(alias).cast("string"), F.lower("kind")).alias("alias"))
    head = ts.traces.select("trace_id", F.lit("run").alias("section"), F.lit(0).alias("position"), F.concat(F.lit("Run "), run_alias(F.col("trace_id")), F.lit(", status "), "status", F.lit(", fidelity "), "causal_fidelity").alias("text"))
    lines = failed.join(names.select("trace_id", "step_id", "alias"), ["trace_id", "step_id"])
    told = lines.select("trace_id", F.when(F.col("primary"), "candidates").otherwise("context").alias("section"), F.col("rank").alias("position"), F.concat("alias", F.lit(": "), safe(label(F.col("name"), F.col("kind")))).alias("text"))
    edges = failures.causal_edges(ts, failed).select("trace_id", "effect", "cause", "origin").distinct()
    say = F.when(F.col("origin").isin("graph_parent", "checkpoint_parent", "checkpoint_subgraph_return"), "declared cause").when(F.col("origin") == "span_link", "linked cause").when(F.col("origin") == "graph_parent_heuristic", "inferred cause").otherwise("contained in")
    ends = edges.join(names.select("trace_id", F.col("step_id").alias("effect"), F.col("seq").alias("eseq"), F.col("alias").alias("ealias")), ["trace_id", "effect"]).join(names.select("trace_id", F.col("step_id").alias("cause"), F.col("seq").alias("cseq"), F.col("alias").alias("calias")), ["trace_id", "cause"])
    arrows = ends.select("trace_id", F.lit("edges").alias("section"), F.row_number().over(Window.partitionBy("trace_id").orderBy("eseq", "cseq", "effect", "cause")).alias("position"), F.concat_ws(" ", "ealias", F.lit("<-"), "calias", F.concat(F.lit("("), say, F.lit(")"))).alias("text"))
    return head.unionByName(told).unionByName(arrows)


def memo(ts: TraceSet) -> DataFrame:
    """trace_id, memo: the lines as Markdown, one text a trace."""
    order = F.create_map(*[F.lit(x) for pair in (("run", 0), ("candidates", 1), ("context", 2), ("edges", 3)) for x in pair])
    lines = memo_lines(ts).select("trace_id", F.struct(order[F.col("section")].alias("a"), F.col("position").alias("b"), F.concat(F.lit("- "), "text").alias("text")).alias("line"))
    return lines.groupBy("trace_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("line")), lambda x: x["text"]), "\n").alias("memo"))
