"""Checkpoint histories to traces, as joins and windows over one row a checkpoint.

A checkpoint is a step; its cause is the checkpoint it was built from or, for the first one of a
subgraph, the checkpoint that launched it. Where a graph goes on after a subgraph, the cause is the
last checkpoint of that subgraph's invocation that was written before. Failed and paused tasks, which are only
recorded as pending writes, become steps of their own, named where a recomputed task id proves the name (sources.tasks). With a
graph, tasks that it schedules at the newest root checkpoint and that wrote nothing become steps too. Input rows are decoded checkpoints
(ROWS; a column pending_sends, array<string>, may follow).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway import schema
from causeway.schema import TraceSet
from causeway.session import staged
from causeway.sources import tasks as named

ROWS = (
    "thread_id string, checkpoint_ns string, checkpoint_id string, parent_ns string, parent_checkpoint_id string, ts string, v int, channel_values map<string,string>, channel_versions map<string,string>, "
    "versions_seen map<string,map<string,string>>, md_source string, md_step int, md_parents map<string,string>, pending_writes array<struct<task_id: string, channel: string, value: string>>"
)
# Fixed values of the format.
BRANCH, ERROR, INTERRUPT, RESUME = "branch:to:", "__error__", "__interrupt__", "__resume__"
NULL_TASK = "00000000-0000-0000-0000-000000000000"
CANCELLED = "CancelledError("
_KEY = "struct<ns: string, id: string>"


def step_id(ns: Column, cid: Column) -> Column:
    return F.when(ns == "", cid).otherwise(F.concat_ws(":", ns, cid))


def segments(ns: Column) -> Column:
    """Node names of a namespace, outermost first."""
    return F.when(ns == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(ns, r"\|"), lambda s: F.substring_index(s, ":", 1)))


def looks_like_tool(name: Column) -> Column:
    """Whether a node's name has the word tool or tools, however it is written."""
    words = F.regexp_extract_all(name, F.lit("[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+"), 0)
    return F.exists(words, lambda w: F.lower(w).isin("tool", "tools"))


def _launcher(ns: Column, parents: Column) -> Column:
    """The closest enclosing checkpoint among the recorded parents: the longest namespace whose names begin this one's."""
    own = segments(ns)
    fits = F.filter(F.coalesce(F.map_entries(parents), F.array().cast("array<struct<key: string, value: string>>")), lambda p: (p["key"] == "") | ((F.size(segments(p["key"])) < F.size(own)) & (F.slice(own, 1, F.greatest(F.size(segments(p["key"])), F.lit(0))) == segments(p["key"]))))
    ranked = F.array_max(F.transform(fits, lambda p: F.struct(F.size(segments(p["key"])).alias("n"), F.length(p["key"]).alias("l"), p["key"].alias("ns"), p["value"].alias("id"))))
    return F.when(ranked.isNotNull(), F.struct(ranked["ns"].alias("ns"), ranked["id"].alias("id")))


def _base(rows: DataFrame) -> DataFrame:
    ns = F.coalesce("checkpoint_ns", F.lit(""))
    line = Window.partitionBy("thread_id").orderBy("checkpoint_id", F.coalesce("ts", F.lit("")), "sid")
    out = rows.withColumns({"ns": ns, "sid": step_id(ns, F.col("checkpoint_id"))})
    launch = _launcher(F.col("ns"), F.col("md_parents"))
    declared = F.when(F.col("parent_checkpoint_id").isNotNull(), F.struct(F.coalesce("parent_ns", "ns").alias("ns"), F.col("parent_checkpoint_id").alias("id")))
    out = out.withColumns({"launch": launch, "ref": F.coalesce(declared, launch), "rank": F.row_number().over(line), "source": F.when(F.col("md_source").isin("input", "loop", "update", "fork"), F.col("md_source")).otherwise("loop")})
    return out.withColumn("again", F.count(F.lit(1)).over(Window.partitionBy("thread_id", "sid")) > 1)


def invocations(base: DataFrame) -> DataFrame:
    """thread_id, ns, sid, rank, invocation, launcher: each subgraph checkpoint's run of its namespace. A run begins with a checkpoint whose
    parent lies outside and above, or which names a launcher not seen before; what comes before the first joins it."""
    sub = base.where("ns <> ''")
    outside = (F.col("ref.ns") != F.col("ns")) & ~F.col("ref.ns").startswith(F.concat("ns", F.lit("|")))
    order = Window.partitionBy("thread_id", "ns").orderBy("rank")
    first = F.row_number().over(Window.partitionBy("thread_id", "ns", F.coalesce("launch", "ref")).orderBy("rank")) == 1
    rows = sub.withColumn("enters", F.coalesce(outside, F.lit(False))).withColumn("n_before", F.sum(F.col("enters").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("relaunched", ~F.col("enters") & F.col("launch").isNotNull() & first & (F.coalesce("n_before", F.lit(0)) > 0))
    rows = rows.withColumn("begins", F.col("enters") | F.col("relaunched"))
    rows = rows.withColumn("invocation", F.greatest(F.sum(F.col("begins").cast("int")).over(order), F.lit(1)))
    by = F.when(F.col("enters"), F.col("ref")).when(F.col("relaunched"), F.col("launch"))
    return rows.withColumn("launcher", F.first(by, ignorenulls=True).over(Window.partitionBy("thread_id", "ns", "invocation"))).select("thread_id", "ns", "sid", "rank", "invocation", "launcher", "relaunched", "launch")


def causes(base: DataFrame) -> DataFrame:
    """thread_id, src, dst, origin. A parent that isn't there is an error."""
    inv = staged(invocations(base))
    keys = base.select("thread_id", F.struct("ns", F.col("checkpoint_id").alias("id")).cast(_KEY).alias("key"), F.col("sid").alias("dst"), "versions_seen")
    refs = base.where("ref IS NOT NULL").select("thread_id", "sid", "ns", "rank", "source", "versions_seen", F.col("ref").cast(_KEY).alias("key"))
    known = refs.join(keys.withColumnRenamed("versions_seen", "launcher_seen"), ["thread_id", "key"], "left")
    missing = F.raise_error(F.concat(F.lit("checkpoint history is partial, a parent is missing: "), F.col("sid"))).cast("string")
    known = known.withColumn("dst", F.coalesce("dst", missing))
    # as-of: of each invocation that the parent launched, the last member written before this step
    member = inv.select("thread_id", F.col("launcher").cast(_KEY).alias("key"), F.col("ns").alias("inv_ns"), "invocation", F.col("sid").alias("exit"), F.col("rank").alias("exit_rank"))
    node = F.substring_index(F.element_at(F.split("inv_ns", r"\|"), F.size(segments(F.col("ns"))) + 1), ":", 1)
    applied = (F.col("source") == "loop") | ~F.col("versions_seen")[node].cast("string").eqNullSafe(F.col("launcher_seen")[node].cast("string"))
    own = known.where("key.ns = ns").join(member, ["thread_id", "key"]).where(F.col("exit_rank") < F.col("rank")).where(applied)
    last = own.groupBy("thread_id", "sid", "source", "key", "inv_ns", "invocation", "rank", "dst").agg(F.max_by("exit", "exit_rank").alias("exit"))
    # a copy that earlier steps contradict keeps its declared parent
    before = Window.partitionBy("thread_id", "key", "inv_ns", "invocation").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    held = last.withColumn("earlier", F.collect_set(F.when(F.col("source") != "fork", F.col("exit"))).over(before))
    held = held.withColumn("unsure", (F.col("source") == "fork") & (F.size(F.array_remove("earlier", F.col("exit"))) > 0))
    returns = held.where("NOT unsure").select("thread_id", F.col("sid").alias("src"), F.col("exit").alias("dst"), F.lit("checkpoint_subgraph_return").alias("origin"))
    replaced = held.groupBy("thread_id", "sid").agg(F.bool_and(~F.col("unsure")).alias("replaced")).hint("merge")
    declared = known.join(replaced, ["thread_id", "sid"], "left").where("NOT coalesce(replaced, false)").select("thread_id", F.col("sid").alias("src"), "dst", F.lit("checkpoint_parent").alias("origin"))
    again = inv.where("relaunched").select("thread_id", F.col("sid").alias("src"), F.col("launch").cast(_KEY).alias("key")).join(keys.drop("versions_seen"), ["thread_id", "key"]).select("thread_id", "src", "dst", F.lit("checkpoint_parent").alias("origin"))
    return declared.union(returns).union(again).distinct()


def discover(rows: DataFrame) -> DataFrame:
    """thread_id, first_checkpoint, n_checkpoints: the threads of a history."""
    return rows.groupBy("thread_id").agg(F.min("checkpoint_id").alias("first_checkpoint"), F.count(F.lit(1)).alias("n_checkpoints"))


def ingest(rows: DataFrame, error_channel: str = "error", error_messages: bool = True, source_kind: str = "langgraph", graph: named.Graph | None = None) -> TraceSet:
    base = staged(_base(rows))  # long expressions: later plans read the result
    repeated = F.when(F.col("again"), F.raise_error(F.concat(F.lit("a checkpoint is there twice: "), F.col("sid"))).cast("string")).otherwise(F.col("sid"))
    edges = staged(causes(base))
    held = lambda m: F.coalesce(F.nullif(m[error_channel], F.lit("")), F.lit(None).cast("string"))
    parent = base.select("thread_id", F.struct("ns", F.col("checkpoint_id").alias("id")).cast(_KEY).alias("key"), F.col("ns").alias("p_ns"), F.col("source").alias("p_source"), F.col("channel_values").alias("p_values"), F.col("channel_versions").alias("p_versions"))
    # a hint doesn't reach through joins and unions: what they make says it again
    at = base.withColumn("key", F.col("ref").cast(_KEY)).join(parent, ["thread_id", "key"], "left")
    target = F.when(F.col("p_ns") != F.col("ns"), F.get(segments(F.col("ns")), F.size(segments(F.col("p_ns")))))
    routed = F.filter(F.map_keys("p_values"), lambda k: k.startswith(BRANCH))
    name = F.when(target.isNotNull(), F.when(F.array_contains(routed, F.concat(F.lit(BRANCH), target)), target)).otherwise(F.substring(F.get(routed, 0), len(BRANCH) + 1, 1000))
    no_node = (F.col("source") == "input") | ((F.col("source") == "loop") & F.coalesce(F.col("p_source") == "input", F.lit(False)))
    states = base.select(F.col("thread_id"), F.col("sid").alias("dst"), held(F.col("channel_values")).isNotNull().alias("had"))
    upstream = edges.select("thread_id", F.col("src").alias("sid"), "dst").join(states, ["thread_id", "dst"]).groupBy("thread_id", "sid").agg(F.bool_or("had").alias("had_before")).hint("merge")
    at = at.join(upstream, ["thread_id", "sid"], "left")
    error = held(F.col("channel_values"))
    had = F.coalesce("had_before", F.lit(False)) | F.coalesce(held(F.col("p_values")).isNotNull(), F.lit(False))
    fresh = error.isNotNull() & ~had & (F.col("source") != "fork")
    moved = ~F.col("channel_versions")[error_channel].eqNullSafe(F.col("p_versions")[error_channel])
    rewritten = error.isNotNull() & held(F.col("p_values")).isNotNull() & (F.col("source") == "loop") & ~no_node & (F.col("p_ns") == F.col("ns")) & F.when(F.col("channel_versions")[error_channel].isNotNull() & F.col("p_versions")[error_channel].isNotNull(), moved).otherwise(error != held(F.col("p_values")))
    order = F.coalesce("md_step", F.lit(0)).cast("long")
    valid = edges.join(base.select("thread_id", F.col("sid").alias("src"), order.alias("a")), ["thread_id", "src"]).join(base.select("thread_id", F.col("sid").alias("dst"), order.alias("b")), ["thread_id", "dst"]).groupBy("thread_id").agg(F.bool_and(F.col("b") < F.col("a")).alias("ordered")).hint("merge")
    at = at.join(valid, "thread_id", "left")
    # recorded steps where they order all causes, else the order of writing, which does
    seq = F.when(F.coalesce("ordered", F.lit(True)), order).otherwise(F.col("rank") - 1)
    hidden = F.array_compact(F.array(F.when(fresh & F.lit(not error_messages), "error_msg"), F.when(~no_node, "kind"), F.when(~no_node, "name")))
    main = staged(at.select(
        F.col("thread_id").alias("trace_id"), repeated.alias("step_id"), seq.alias("seq"), "ts", F.when(looks_like_tool(name), "TOOL").otherwise("CHAIN").alias("kind"), "source", name.alias("name"), F.when(fresh, "error").otherwise("ok").alias("status"),
        F.when(fresh & F.lit(error_messages), error).alias("error_msg"), F.lit(None).cast(schema.EVIDENCE).alias("evidence"), F.lit(None).cast("boolean").alias("projection_lossy"), hidden.alias("unknown_fields"), F.coalesce(rewritten, F.lit(False)).alias("rewritten"),
    ))
    tasks = base.select("thread_id", "sid", "ns", "checkpoint_id", F.posexplode("pending_writes").alias("at", "w"))
    malformed = tasks.where("w IS NULL OR w.task_id IS NULL OR w.channel IS NULL").select("thread_id", F.lit("langgraph.malformed_pending_writes").alias("code"))
    first = lambda channel, value: F.min_by(F.when(F.col("w.channel") == channel, value), F.when((F.col("w.channel") == channel) & value.isNotNull(), F.col("at")))
    lost = F.lit("<exception not serialized by the checkpointer>")
    per = tasks.where(F.col("w.task_id") != NULL_TASK).groupBy("thread_id", "sid", "ns", "checkpoint_id", F.col("w.task_id").alias("task")).agg(
        F.collect_set("w.channel").alias("channels"), first(ERROR, F.coalesce("w.value", lost)).alias("error"), first(named.SOURCE_NODE, F.nullif("w.value", F.lit(""))).alias("by_source"))
    head = base.where("ns = ''").groupBy("thread_id").agg(F.max_by("sid", "checkpoint_id").alias("head"))
    per = per.join(head, "thread_id", "left").join(main.select(F.col("trace_id").alias("thread_id"), F.col("step_id").alias("sid"), F.col("seq").alias("at"), "ts"), ["thread_id", "sid"])
    cancelled = F.col("error").startswith(CANCELLED)
    open_ = (F.col("sid") == F.col("head")) & F.array_contains("channels", INTERRUPT)
    failed = F.array_contains("channels", ERROR)
    paused = open_ & (F.size("channels") == 1)
    unsure = open_ & (F.size("channels") > 1) & (F.size(F.array_except("channels", F.array(*map(F.lit, (INTERRUPT, RESUME, ERROR))))) == 0)
    told = base.where(F.exists("pending_writes", lambda w: w["channel"].isin(ERROR, INTERRUPT)))
    asked = per.where((failed | paused) & F.col("by_source").isNull()).select("thread_id", "sid", F.col("task").alias("task_id"))
    proved = named.names(told, asked).withColumnRenamed("task_id", "task").withColumnRenamed("name", "proved").hint("merge")
    per = staged(per.join(proved, ["thread_id", "sid", "task"], "left").withColumn("name", F.coalesce("by_source", "proved")))
    mark = lambda kind: F.concat("sid", F.lit(f"#{kind}:"), "task")
    kind_of = F.when(looks_like_tool(F.col("name")), "TOOL").otherwise("CHAIN")
    derived = lambda where, kind, status, message, extra: per.where(where).select(
        F.col("thread_id").alias("trace_id"), mark(kind).alias("step_id"), (F.col("at") + 1).alias("seq"), "ts", kind_of.alias("kind"), F.lit(kind).alias("source"), "name", status.alias("status"), message.alias("error_msg"),
        F.lit(None).cast(schema.EVIDENCE).alias("evidence"), F.lit(None).cast("boolean").alias("projection_lossy"), extra.alias("unknown_fields"), F.lit(False).alias("rewritten"))
    unnamed = F.when(F.col("name").isNull(), F.array(F.lit("kind"), F.lit("name"))).otherwise(F.array().cast("array<string>"))
    hides = ~cancelled & (F.lit(not error_messages) | F.col("error").startswith("<exception not"))
    steps = main.unionByName(derived(failed, "task", F.when(cancelled, "unset").otherwise("error"), F.when(~cancelled & F.lit(error_messages), F.col("error")), F.when(hides, F.concat(F.array(F.lit("error_msg")), unnamed)).otherwise(unnamed)))
    steps = steps.unionByName(derived(paused, "interrupt", F.lit("unset"), F.lit(None).cast("string"), unnamed))
    gap = lambda where, code: per.where(where).select("thread_id", F.lit(code).alias("code"))
    nameless = F.col("name").isNull()
    codes = malformed.union(gap(failed & ~cancelled & nameless, "langgraph.unattributed_failed_task")).union(gap(paused & nameless, "langgraph.unattributed_interrupted_task")).union(gap(unsure, "langgraph.undecided_interrupt"))
    unread = named.packets(base.where(F.col("channel_values")[named.PACKETS].isNotNull())).where(F.col("node").isNull() & (F.col("channel") == named.PACKETS))
    codes = codes.union(unread.select("thread_id", F.lit("langgraph.undecodable_send_packets")))
    codes = codes.union(main.where("rewritten").select("trace_id", F.lit("langgraph.rewritten_error_channel")))
    links = edges.select(F.col("thread_id").alias("trace_id"), F.lit("CAUSED_BY").alias("type"), "src", "dst", "origin")
    for where, kind in ((failed, "task"), (paused, "interrupt")):
        links = links.union(per.where(where).select("thread_id", F.lit("CAUSED_BY"), mark(kind), "sid", F.lit("checkpoint_parent")))
    if graph:
        waiting, lost_codes = _scheduled(base, head, main, graph)
        steps, codes = steps.unionByName(waiting.drop("head")), codes.union(lost_codes)
        links = links.union(waiting.select("trace_id", F.lit("CAUSED_BY"), "step_id", "head", F.lit("checkpoint_parent")))
    gaps = codes.groupBy("thread_id", "code").agg(F.count(F.lit(1)).alias("count")).groupBy("thread_id").agg(F.array_sort(F.collect_list(F.struct("code", "count"))).alias("gaps"))
    heads = steps.groupBy("trace_id").agg(F.when(F.bool_or(F.col("status") == "error"), "error").otherwise("ok").alias("status")).join(gaps.withColumnRenamed("thread_id", "trace_id").hint("merge"), "trace_id", "left")
    fingerprint = F.struct(F.lit(graph.fingerprint().first()[0]).alias("fingerprint")) if graph else F.lit(None).cast("struct<fingerprint: string>")  # one digest
    traces = heads.select(
        "trace_id", F.lit(source_kind).alias("source_kind"), F.lit(None).cast("string").alias("run_id"), F.col("trace_id").alias("thread_id"), "status", F.lit("declared_dag").alias("causal_fidelity"), F.lit(None).cast("boolean").alias("links_preserved"),
        F.lit(None).cast("array<struct<source: string, artifact_digest: string, graph_generation: bigint, verdict: string>>").alias("decision_evidence"), fingerprint.alias("schedule_graph"),
        F.struct(F.coalesce("gaps", F.array().cast("array<struct<code: string, count: bigint>>")).alias("gaps")).alias("capture"),
    )
    return TraceSet(traces, steps.drop("rewritten").hint("merge"), links.hint("merge"))  # unions of staged tables, which are as large


def _scheduled(base: DataFrame, head: DataFrame, main: DataFrame, graph: named.Graph) -> tuple[DataFrame, DataFrame]:
    """Steps (with ``head``) of tasks that the graph schedules at the newest root checkpoint and that wrote nothing there, and the gap codes of what the graph's answer leaves
    out: packets to nodes that it hasn't, and input writes that wait to be applied. A task given for another checkpoint is an error."""
    heads = staged(base.join(head.select("thread_id", F.col("head").alias("sid")), ["thread_id", "sid"]))
    tasks = graph.tasks if graph.tasks is not None else named.scheduled_tasks(heads, graph.nodes)
    at = heads.select("thread_id", "sid", F.col("checkpoint_id").alias("newest"))
    other = F.raise_error(F.concat(F.lit("the graph read a checkpoint that isn't the newest of its thread: "), F.col("checkpoint_id"))).cast("string")
    tasks = tasks.join(at, "thread_id").withColumn("sid", F.when(F.col("checkpoint_id").eqNullSafe(F.col("newest")), F.col("sid")).otherwise(other))
    wrote = heads.select("thread_id", F.explode("pending_writes").alias("w")).where("w.task_id IS NOT NULL AND w.channel IS NOT NULL")
    idle = tasks.join(wrote.select("thread_id", F.col("w.task_id").alias("task_id")), ["thread_id", "task_id"], "left_anti")
    idle = idle.join(main.select(F.col("trace_id").alias("thread_id"), F.col("step_id").alias("sid"), F.col("seq").alias("at"), "ts"), ["thread_id", "sid"])
    steps = idle.select(
        F.col("thread_id").alias("trace_id"), F.concat("sid", F.lit("#scheduled:"), "task_id").alias("step_id"), (F.col("at") + 1).alias("seq"), "ts", F.when(looks_like_tool(F.col("name")), "TOOL").otherwise("CHAIN").alias("kind"), F.lit("scheduled").alias("source"), "name",
        F.lit("unset").alias("status"), F.lit(None).cast("string").alias("error_msg"), F.lit(None).cast(schema.EVIDENCE).alias("evidence"), F.lit(None).cast("boolean").alias("projection_lossy"), F.array().cast("array<string>").alias("unknown_fields"), F.lit(False).alias("rewritten"), F.col("sid").alias("head"),
    )
    channels = F.broadcast(graph.nodes.select(F.explode("triggers").alias("channel")).union(base.sparkSession.createDataFrame([(named.PACKETS,)], "channel string")).distinct())  # a graph's nodes, not a corpus
    waits = wrote.where(F.col("w.task_id") == NULL_TASK).select("thread_id", F.col("w.channel").alias("channel")).join(channels, "channel", "left_semi")
    unknown = named.packets(heads).where("node IS NOT NULL").join(F.broadcast(graph.nodes.select("node")), "node", "left_anti")
    return steps, waits.select("thread_id", F.lit("langgraph.unapplied_command_goto").alias("code")).union(unknown.select("thread_id", F.lit("langgraph.unknown_send_target")))
