"""Trace views of ordinary tables: user histories as traces, orders and conversations as trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causeway import schema
from causeway.schema import TraceSet
from causeway.session import staged


def _whole(df: DataFrame, ddl: str) -> DataFrame:
    """The columns of a trace table, missing ones null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.struct(ddl)])


def events(spark: SparkSession, sf_dir: str) -> TraceSet:
    """One trace a user: events in time order, causes near before them. Causes are found by looking back a
    fixed number of rows, so one sort by user makes steps and edges."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    line = Window.partitionBy("user_id").orderBy("ts", "event_id")
    sid = F.concat(F.lit("e"), F.col("event_id").cast("string"))
    e = e.withColumns({"seq": (F.row_number().over(line) - 1).cast("long"), "step_id": sid, **{f"back{n}": F.lag(sid, n).over(line) for n in (1, 2, 3, 4)}})
    k, kind = F.col("k"), F.col("event_type")
    part = lambda stem: F.concat(F.lit(stem), (k % 2).cast("string"))
    failed = kind == "error"
    name = (
        F.when(kind == "signup", part("a")).when(kind == "click", part("t")).when(kind == "purchase", "llm")
        .when(kind == "view", F.when(k % 10 < 3, "plan").when(k % 10 < 6, part("retry:t")).otherwise("view"))
        .when(k % 3 == 0, part("t")).when(k % 3 == 1, part("gate:g")).otherwise(part("a"))
    )
    llm = kind == "purchase"
    steps = e.withColumns({
        "trace_id": F.concat(F.lit("u"), F.col("user_id").cast("string")),
        "kind": F.when(kind == "signup", "AGENT").when(kind == "view", "CHAIN").when(kind == "click", "TOOL").when(llm, "LLM").when(k % 3 == 2, "AGENT").otherwise("TOOL"),
        "name": name,
        "status": F.when(failed, "error").when(llm & (k % 7 == 0), "unset").otherwise("ok"),
        "error_msg": F.when(failed, F.when(k % 4 == 0, "timeout").otherwise(F.concat(F.lit("exit_code="), k.cast("string")))),
        "source": F.lit("loop"),
        "start": F.col("ts"),
        "ts": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'"),
    })
    # telemetry of purchases: tokens, a cost, an end
    steps = steps.withColumn("evidence", F.when(llm, F.struct(
        F.date_format(F.timestamp_seconds(F.unix_timestamp("start") + k), "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("end_ts"), (k * 1000).cast("double").alias("duration_ms"),
        (k * 3).cast("long").alias("prompt_tokens"), k.cast("long").alias("completion_tokens"), (k * 4).cast("long").alias("total_tokens"), F.lit(None).cast("string").alias("prompt_cost"),
        F.lit(None).cast("string").alias("completion_cost"), F.format_string("0.%02d", k).alias("total_cost"), F.lit("USD").alias("cost_currency"), F.lit(None).cast("string").alias("artifact_digest"),
        F.array(F.struct(F.lit("quality").alias("name"), F.when(k % 2 == 0, "pass").alias("label"), (k / 100).cast("double").alias("score"))).alias("evaluations"),
    ).cast(schema.EVIDENCE)))
    near = F.when((k % 4 != 0) | (k % 3 == 0), F.col("back1")).when(k % 3 == 1, F.coalesce("back2", "back1")).otherwise(F.coalesce("back3", "back2", "back1"))
    causes = steps.select("trace_id", "step_id", F.array(
        F.struct(near.alias("dst"), F.lit("graph_parent").alias("origin")), F.struct(F.when(k % 5 == 0, F.col("back4")).alias("dst"), F.lit("span_link").alias("origin"))
    ).alias("causes"))
    edges = causes.select("trace_id", F.col("step_id").alias("src"), F.inline("causes")).where("dst IS NOT NULL")
    edges = edges.groupBy("trace_id", "src", "dst").agg(F.min("origin").alias("origin")).withColumn("type", F.lit("CAUSED_BY"))
    traces = steps.groupBy("trace_id").agg(F.when(F.bool_or(F.col("status") == "error"), "error").otherwise("ok").alias("status"))
    traces = traces.withColumns({"source_kind": F.lit("events"), "run_id": F.concat(F.lit("run-"), F.col("trace_id")), "causal_fidelity": F.lit("declared_dag"), "links_preserved": F.lit(True), "capture": F.lit(None).cast("struct<gaps: array<struct<code: string, count: bigint>>>")})
    number = F.substring("trace_id", 2, 20).cast("long")
    # one trace in 11 discloses a gap, one in 13 has no record
    gap = lambda code: F.array(F.struct(F.lit(code).alias("code"), F.lit(1).cast("long").alias("count")))
    gaps = F.when(number % 11 == 0, gap("otlp.unresolved_span_link")).when(number % 11 == 1, gap("otlp.unreadable_timestamp")).otherwise(F.array().cast("array<struct<code: string, count: bigint>>"))
    traces = traces.withColumn("capture", F.when(number % 13 != 0, F.struct(gaps.alias("gaps"))))
    steps = steps.withColumn("unknown_fields", F.when((k % 17 == 0) & failed, F.array(F.lit("kind"))).otherwise(F.array().cast("array<string>")))
    return TraceSet(_whole(traces, schema.TRACES), _whole(steps, schema.STEPS), _whole(edges, schema.EDGES))


def _plain(df: DataFrame, kind: str) -> TraceSet:
    """df: trace_id, step_id, seq, kind, name, status, parent; made once, as all three tables are read off it."""
    df = staged(df)
    steps = df.withColumns({"source": F.lit("loop"), "unknown_fields": F.array().cast("array<string>")})
    edges = df.where("parent IS NOT NULL").select("trace_id", F.lit("CAUSED_BY").alias("type"), F.col("step_id").alias("src"), F.col("parent").alias("dst"), F.lit("graph_parent").alias("origin"))
    traces = df.groupBy("trace_id").agg(F.when(F.bool_or(F.col("status") == "error"), "error").otherwise("ok").alias("status")).withColumns({"source_kind": F.lit(kind), "causal_fidelity": F.lit("declared_dag")})
    return TraceSet(_whole(traces, schema.TRACES), _whole(steps, schema.STEPS), _whole(edges, schema.EDGES))


def orders(spark: SparkSession, sf_dir: str) -> TraceSet:
    """One trace an order: the order is the root, its lines are its children; a returned line failed."""
    o, li = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    tid = lambda c: F.concat(F.lit("o"), F.col(c).cast("string"))
    roots = o.select(tid("o_orderkey").alias("trace_id"), F.lit("root").alias("step_id"), F.lit(0).cast("long").alias("seq"), F.lit("AGENT").alias("kind"), F.col("o_orderstatus").alias("name"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("parent"))
    lines = li.join(o.select("o_orderkey"), li["l_orderkey"] == o["o_orderkey"], "left_semi").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"), F.min("l_linestatus").alias("line"))
    leaves = lines.select(tid("l_orderkey").alias("trace_id"), F.concat(F.lit("l"), F.col("l_linenumber").cast("string")).alias("step_id"), F.col("l_linenumber").cast("long").alias("seq"), F.lit("TOOL").alias("kind"), F.concat("flag", "line").alias("name"), F.when(F.col("flag") == "R", "error").otherwise("ok").alias("status"), F.lit("root").alias("parent"))
    ts = _plain(roots.unionByName(leaves), "orders")
    # one order in seven has no capture record, one in seven discloses a gap
    number = F.substring("trace_id", 2, 20).cast("long")
    gap = F.array(F.struct(F.lit("otlp.unresolved_span_link").alias("code"), F.lit(1).cast("long").alias("count")))
    gaps = F.when(number % 7 == 1, gap).otherwise(F.array().cast("array<struct<code: string, count: bigint>>"))
    return TraceSet(ts.traces.withColumn("capture", F.when(number % 7 != 0, F.struct(gaps.alias("gaps")))), ts.steps, ts.edges)


def customers(spark: SparkSession, sf_dir: str) -> TraceSet:
    """One trace a customer: a forest, with a root for each order and its lines as children."""
    o, li = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    tid, sid = F.concat(F.lit("k"), F.col("o_custkey").cast("string")), F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))
    roots = o.select(tid.alias("trace_id"), sid.alias("step_id"), (F.col("o_orderkey") * 100).alias("seq"), F.lit("AGENT").alias("kind"), F.col("o_orderstatus").alias("name"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("parent"))
    lines = li.join(o.select("o_orderkey", "o_custkey"), li["l_orderkey"] == o["o_orderkey"]).groupBy("o_custkey", "o_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"), F.min("l_linestatus").alias("line"))
    leaves = lines.select(tid.alias("trace_id"), F.concat(sid, F.lit("l"), F.col("l_linenumber").cast("string")).alias("step_id"), (F.col("o_orderkey") * 100 + F.col("l_linenumber")).alias("seq"), F.lit("TOOL").alias("kind"), F.concat("flag", "line").alias("name"), F.when(F.col("flag") == "R", "error").otherwise("ok").alias("status"), sid.alias("parent"))
    return _plain(roots.unionByName(leaves), "customers")


def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A checkpoint history (sources.checkpoints.ROWS) of each user: an event is a checkpoint built from the one before; errors stand in the
    error channel; one event in 6 has a failed task, one in 12 of them a cancelled one; every second history ends paused."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    line = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = e.withColumns({"seq": F.row_number().over(line) - 1, "last": F.lead("event_id").over(line).isNull()})
    cid = lambda n: F.concat(F.lit("c"), F.lpad(n.cast("string"), 7, "0"))
    write = lambda task, channel, value: F.struct(F.lit(task).alias("task_id"), F.lit(channel).alias("channel"), value.cast("string").alias("value"))
    failed = F.when(F.col("k") % 6 == 0, write("t1", "__error__", F.when(F.col("k") % 12 == 0, "CancelledError()").otherwise("ValueError('no')")))
    paused = F.when(F.col("last") & (F.col("user_id") % 2 == 0), write("t2", "__interrupt__", F.lit("?")))
    values = F.map_concat(F.create_map(F.concat(F.lit("branch:to:n"), (F.col("k") % 3).cast("string")), F.lit("1")), F.when(F.col("event_type") == "error", F.create_map(F.lit("error"), F.concat(F.lit("exit_code="), F.col("k").cast("string")))).otherwise(F.create_map().cast("map<string,string>")))
    rows = e.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("thread_id"), F.lit("").alias("checkpoint_ns"), cid(F.col("seq")).alias("checkpoint_id"), F.when(F.col("seq") > 0, cid(F.col("seq") - 1)).alias("parent_checkpoint_id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("ts"), F.lit(4).alias("v"), values.alias("channel_values"), F.when(F.col("seq") == 0, "input").otherwise("loop").alias("md_source"), (F.col("seq") - 1).cast("int").alias("md_step"),
        F.array_compact(F.array(failed, paused)).alias("pending_writes"),
    )
    from causeway.sources.checkpoints import ROWS

    return _whole(rows, ROWS)


def task_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A checkpoint history of each user in which an event's k says what became of a task: 0 to 3 failed as a routed, a joined, a seen or a sent node, 4 with its
    node written down, 5 cancelled at the start, 6 failed under an id that no node has. Every second history ends paused, every third with an input write."""
    from causeway.sources.checkpoints import ROWS
    from causeway.sources.tasks import PACKETS, SOURCE_NODE

    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    line = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = e.withColumns({"seq": F.row_number().over(line) - 1, "last": F.lead("event_id").over(line).isNull()})
    k, text, kind = F.col("k"), lambda stem, n: F.concat(F.lit(stem), n.cast("string")), F.col("k") % 7
    e = e.withColumns({"cid": F.concat(F.lit("c"), F.lpad(F.col("seq").cast("string"), 7, "0")), "routed": text("n", k % 3), "joined": text("join", k % 2), "seen": F.when(k % 2 == 0, "call_tool").otherwise("seen")})
    branch = lambda c: F.concat(F.lit("branch:to:"), F.col(c) if isinstance(c, str) else c)

    def task(node, *rest):
        h = F.sha1(F.concat(F.unhex("cid"), F.concat(node, F.col("seq").cast("string"), node, *rest).cast("binary")))
        return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])

    pull, start = F.lit("__pregel_pull"), F.lit("__start__")
    routed = task(F.col("routed"), pull, branch("routed"))
    ids = F.when(kind == 0, routed).when(kind == 1, task(F.col("joined"), pull, branch("joined"), F.concat(F.lit("join:a+b:"), "joined"))).when(kind == 2, task(F.col("seen"), pull, branch("seen")))
    ids = ids.when(kind == 3, task(text("send", k % 2), F.lit("__pregel_push"), (k % 2).cast("string"))).when(kind == 4, "zz").when(kind == 5, task(start, pull, start)).otherwise("unknown")
    write = lambda t, channel, value: F.struct(t.alias("task_id"), F.lit(channel).alias("channel"), F.lit(value).alias("value"))
    writes = F.array(write(ids, "__error__", "ValueError('no')"))
    writes = F.when(kind == 4, F.array(write(F.lit("zz"), "__error__", "KeyError('k')"), write(F.lit("zz"), SOURCE_NODE, "origin"))).when(kind == 5, F.array(write(ids, "__error__", "CancelledError()"))).otherwise(writes)
    ends = lambda n: F.col("last") & (F.col("user_id") % n == 0)
    paused = F.when(ends(2) & (kind != 0), F.array(write(routed, "__interrupt__", "?"))).otherwise(F.array().cast("array<struct<task_id: string, channel: string, value: string>>"))
    moved = F.when(ends(3), F.array(write(F.lit("00000000-0000-0000-0000-000000000000"), "branch:to:n0", "1"), write(F.lit("00000000-0000-0000-0000-000000000000"), "other", "1"))).otherwise(F.array().cast("array<struct<task_id: string, channel: string, value: string>>"))
    values = F.map_concat(F.create_map(branch("routed"), F.lit("1")), F.when(kind == 3, F.create_map(F.lit(PACKETS), F.lit('[{"node": "send0", "arg": 1}, {"node": "send1"}, null]'))).otherwise(F.create_map().cast("map<string,string>")))
    versions = F.create_map(branch("routed"), F.col("seq").cast("string"), F.concat(F.lit("join:a+b:"), "joined"), F.lit("1"))
    seen = F.create_map(F.col("seen"), F.create_map().cast("map<string,string>"), F.col("routed"), F.create_map(branch("routed"), (F.col("seq") - k % 2).cast("string")))
    rows = e.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("thread_id"), F.lit("").alias("checkpoint_ns"), F.col("cid").alias("checkpoint_id"), F.when(F.col("seq") > 0, F.concat(F.lit("c"), F.lpad((F.col("seq") - 1).cast("string"), 7, "0"))).alias("parent_checkpoint_id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("ts"), F.lit(1).alias("v"), values.alias("channel_values"), versions.alias("channel_versions"), seen.alias("versions_seen"), F.when(F.col("seq") == 0, "input").otherwise("loop").alias("md_source"),
        (F.col("seq") - 1).cast("int").alias("md_step"), F.concat(writes, paused, moved).alias("pending_writes"),
    )
    return _whole(rows, ROWS)


def conversations(spark: SparkSession, sf_dir: str) -> TraceSet:
    """One trace a conversation: each turn is caused by the turn before."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    line = Window.partitionBy("conv_id").orderBy("turn")
    tid, sid = F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.concat(F.lit("t"), F.col("turn").cast("string"))
    return _plain(c.select(tid.alias("trace_id"), sid.alias("step_id"), (F.row_number().over(line) - 1).cast("long").alias("seq"), F.when(F.col("role") == "user", "PROMPT").otherwise("LLM").alias("kind"), F.col("role").alias("name"), F.lit("ok").alias("status"), F.lag(sid).over(line).alias("parent")), "conversations")
