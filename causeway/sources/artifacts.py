"""Portable trace files: one JSON document a trace, read and written by Spark, many at a time."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from causeway import schema
from causeway.plans import model
from causeway.plans.projection import layers, needs_origin_priority, normalize, projection_rules, violations
from causeway.schema import TraceSet
from causeway.session import small_batches, staged

VERSIONS = range(1, 10)


def _struct(ddl: str) -> str:
    return schema.struct(ddl).simpleString()


def _envelope() -> str:
    edge = _struct("type string, src string, dst string, origin string")
    return f"struct<schema_version: int, trace: struct<trace: {_struct(schema.TRACES)}, steps: array<{_struct(schema.STEPS)}>, edges: array<{edge}>>>"


def required_version(ts: TraceSet) -> DataFrame:
    """trace_id, version: the lowest version whose readers understand all that the trace uses."""
    per = ts.steps.groupBy("trace_id").agg(F.bool_or(F.size("unknown_fields") > 0).alias("unknown"), *[F.bool_or(F.col("source") == s).alias(s) for s in ("scheduled", "interrupt", "task")])
    new = ts.edges.where("type = 'CAUSED_BY'").groupBy("trace_id").agg(F.bool_or(F.col("origin") == "checkpoint_subgraph_return").alias("returns"), F.bool_or(F.col("origin") == "graph_parent_heuristic").alias("guesses"))
    ranked = needs_origin_priority(ts).select("trace_id", F.lit(True).alias("ranked"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    version = (
        F.when(yes("returns"), 9).when(yes("guesses"), 8).when(F.col("capture").isNotNull() | yes("unknown"), 7).when(F.col("schedule_graph").isNotNull() | yes("scheduled"), 6)
        .when(yes("interrupt"), 5).when(yes("ranked"), 4).when(yes("task"), 3).otherwise(2)
    )
    return ts.traces.join(per, "trace_id", "left").join(new, "trace_id", "left").join(ranked, "trace_id", "left").select("trace_id", version.alias("version"))


@F.pandas_udf(StringType())
def _canonical(texts: pd.Series) -> pd.Series:
    """A document's one spelling: sorted keys, two blanks a level, no absent header, no empty list of unknown fields."""

    def one(text: str) -> str:
        doc = json.loads(text)
        head = doc["trace"]["trace"]
        for name in ("schedule_graph", "capture"):
            if head.get(name) is None:
                head.pop(name, None)
        for step in doc["trace"]["steps"]:
            if not step.get("unknown_fields"):
                step.pop("unknown_fields", None)
        return json.dumps(doc, indent=2, sort_keys=True, allow_nan=False)

    return texts.map(one)


def to_text(ts: TraceSet, check: bool = True) -> DataFrame:
    """trace_id, version, value, digest: each trace as a canonical JSON document (steps and edges in canonical order, one spelling) and the
    SHA-256 of that text. check: a trace that breaks the model's rules is an error."""
    if check:
        refuse(ts)
    small_batches(ts.traces.sparkSession)  # documents are long: 10,000 of them are no batch
    whole, _ = normalize(ts)
    steps = whole.steps.groupBy("trace_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col("step_id").alias("k"), F.struct(*whole.steps.columns).alias("step")))), lambda x: x["step"]).alias("steps"))
    edges = layers(ts).groupBy("trace_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", F.struct("type", "src", "dst", "origin").alias("edge")))), lambda x: x["edge"]).alias("edges"))
    head = whole.traces.select("trace_id", F.struct(*whole.traces.columns).alias("trace"))
    rows = head.join(steps, "trace_id", "left").join(edges, "trace_id", "left").join(required_version(ts), "trace_id")
    body = F.struct(F.col("version").alias("schema_version"), F.struct("trace", F.coalesce("steps", F.array()).alias("steps"), F.coalesce("edges", F.array()).alias("edges")).alias("trace"))
    text = rows.select("trace_id", "version", _canonical(F.to_json(body, {"ignoreNullFields": "false"})).alias("value"))
    return text.withColumn("digest", F.concat(F.lit("sha256:"), F.sha2("value", 256)))


def faults(ts: TraceSet, versions: DataFrame | None = None) -> DataFrame:
    """trace_id, rule, subject: where a record or a trace breaks a rule of the model, its stored tree is none that its causes give, or (versions: trace_id, version) it
    uses more than the version that it declares."""
    bad = model.faults(ts, writing=versions is None).unionByName(violations(ts)).unionByName(projection_rules(ts).where("rule IS NULL").select("trace_id", F.lit("stored tree differs from causes").alias("rule"), F.col("trace_id").alias("subject")))
    if versions is not None:
        more = required_version(ts).withColumnRenamed("version", "needed").join(versions, "trace_id").where(F.col("needed") > F.greatest("version", F.lit(2)))
        bad = bad.unionByName(more.select("trace_id", F.concat(F.lit("declares version "), F.col("version").cast("string"), F.lit(", needs "), F.col("needed").cast("string")).alias("rule"), F.col("trace_id").alias("subject")))
    return bad


def refuse(ts: TraceSet, versions: DataFrame | None = None) -> None:
    """An error where there are any ``faults``."""
    if (row := faults(ts, versions).first()) is not None:
        raise ValueError(f"trace {row.trace_id!r}: {row.rule} ({row.subject})")


def from_text(texts: DataFrame, check: bool = True, found: list | None = None) -> TraceSet:
    """texts: value string. A document of another shape or version is an error; version 1 gets what it lacked. check: so is a trace
    that breaks the model's rules or uses more than the version that it declares. found: a list that gets the table of faults instead; such traces stay."""
    wrong = lambda why: F.raise_error(F.concat(F.lit(why), F.substring("value", 1, 60))).cast("int")
    doc = texts.select("value", F.from_json("value", _envelope()).alias("d"))
    version = F.when(F.col("d.trace.trace.trace_id").isNull(), wrong("no trace document: ")).when(~F.coalesce(F.col("d.schema_version").isin(*VERSIONS), F.lit(False)), wrong("no such version: ")).otherwise(F.col("d.schema_version"))
    rows = staged(doc.select(version.alias("version"), "d.trace.*"))
    old: Column = F.col("version") == 1
    heads = rows.select("version", "trace.*")
    # what a document leaves out has its default
    default = lambda c, v: F.coalesce(c, F.lit(v))
    traces = heads.withColumns({"causal_fidelity": default("causal_fidelity", "legacy_unknown"), "status": default("status", "ok")}).drop("version")
    steps = rows.select(F.inline("steps")).withColumns({"unknown_fields": F.coalesce("unknown_fields", F.array().cast("array<string>")), "source": default("source", "loop"), "kind": default("kind", "CHAIN"), "status": default("status", "ok")})
    every = rows.select("version", F.col("trace.trace_id").alias("trace_id"), F.inline("edges"))
    every = every.select("trace_id", "type", "src", "dst", F.when(F.col("type") == "CAUSED_BY", F.coalesce("origin", F.when(old, "legacy_unknown"))).alias("origin"))
    ts = TraceSet(traces.select(*schema.struct(schema.TRACES).names), steps.select(*schema.struct(schema.STEPS).names), every)
    if found is not None:
        found.append(staged(faults(ts, heads.select("trace_id", "version"))))
    elif check:
        refuse(ts, heads.select("trace_id", "version"))
    return TraceSet(ts.traces, ts.steps, every.where("type = 'CAUSED_BY'"))


def read(spark, path: str, lenient: bool = False) -> TraceSet:
    """A file or a folder of *.json. lenient: files that hold no trace document are left out; ``skipped`` lists them."""
    texts = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
    return from_text(texts.where(readable()) if lenient else texts)


def skipped(spark, path: str) -> DataFrame:
    """file: what a lenient read leaves out."""
    return spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True).where(~readable()).select(F.col("_metadata.file_path").alias("file"))


def readable() -> Column:
    d = F.from_json(F.when(F.try_parse_json(F.col("value")).isNotNull(), F.col("value")), _envelope())
    return F.coalesce(d["trace"]["trace"]["trace_id"].isNotNull() & d["schema_version"].isin(*VERSIONS), F.lit(False))


def write(ts: TraceSet, path: str) -> None:
    """One line a trace; readable by ``from_text(spark.read.text(path))``."""
    to_text(ts).select(F.regexp_replace("value", "\n *", "").alias("value")).write.text(path)


def duplicates(ts: TraceSet) -> DataFrame:
    """trace_id of traces that were read more than once."""
    return ts.traces.groupBy("trace_id").count().where("count > 1").select("trace_id")
