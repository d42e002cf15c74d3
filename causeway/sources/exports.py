"""Exports of a tracing server: objects with spans of their own naming, alone, in an array, or in an envelope.

They carry containment only, statuses stay unset where they were, and no free text survives: messages go,
names and evaluation labels must look like identifiers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.schema import TraceSet
from causeway.sources import spans

_ANNOTATION = "struct<name: string, label: string, score: double, result: struct<label: string, score: double>>"
_SPAN = (
    "struct<id: string, span_id: string, context: struct<trace_id: string, span_id: string>, name: string, span_kind: string, kind: string, parent_id: string, parentId: string, start_time: string, startTime: string, end_time: string, endTime: string, "
    f"status_code: string, statusCode: string, attributes: map<string, string>, annotations: array<{_ANNOTATION}>>"
)
_TRACE = f"struct<traceId: string, trace_id: string, spans: array<{_SPAN}>>"
ENVELOPE = f"struct<traces: array<{_TRACE}>, data: array<{_TRACE}>, traceId: string, trace_id: string, spans: array<{_SPAN}>>"
NAME = "^[A-Za-z0-9_.:/#@-]{1,200}$"
#: Attributes that are read; all others are dropped.
ATTRIBUTES = ("graph.node.id", "graph.node.parent_id", *[n for names in (*spans.TOKENS.values(), *spans.COSTS.values()) for n in names], "llm.cost.currency")


def traces(texts: DataFrame, tolerant: bool = False) -> DataFrame:
    """texts: value string -> one trace object a row. A text that is no export is an error; tolerant: it has a row without one, and other columns stay."""
    others = [c for c in texts.columns if c != "value"] if tolerant else []
    array = F.from_json("value", f"array<{_TRACE}>")
    env = F.from_json("value", ENVELOPE)
    own = F.array(F.struct(env["traceId"].alias("traceId"), env["trace_id"].alias("trace_id"), env["spans"].alias("spans")))
    many = F.when(F.ltrim("value").startswith("["), array).otherwise(F.coalesce(env["traces"], env["data"], F.when(env["spans"].isNotNull(), own)))
    if tolerant:
        return texts.select(*others, F.explode_outer(many).alias("t"))
    shown = F.coalesce(many, F.raise_error(F.lit("no trace export")).cast(f"array<{_TRACE}>"))
    return texts.select(F.explode(shown).alias("t"))


def _time(c: Column) -> tuple[Column, Column]:
    """(nanoseconds, start number of unknown unit): ISO text is a time, a number of 10^17 or more is nanoseconds, a smaller one only orders."""
    n = c.try_cast("decimal(38,6)")
    iso = F.unix_micros(F.try_to_timestamp(c)) * 1000
    return F.when(n >= 10**17, n.cast("bigint")).when(n.isNull(), iso), F.when(n < 10**17, n.cast("double"))


def decode(texts: DataFrame, tolerant: bool = False) -> DataFrame:
    """The spans of exports (spans.DECODED). What names no trace, several, or another one is an error; tolerant: such a span has a ``problem`` instead, and
    other columns of the texts stay."""
    others = [c for c in texts.columns if c != "value"] if tolerant else []
    # a trace has the id that it declares, else the one that all its spans share
    said = F.array_distinct(F.array_compact(F.transform("t.spans", lambda x: F.nullif(x["context"]["trace_id"], F.lit("")))))
    each = F.explode_outer if tolerant else F.explode
    s = traces(texts, tolerant).select(*others, F.coalesce(F.nullif("t.traceId", F.lit("")), F.nullif("t.trace_id", F.lit(""))).alias("declared"), said.alias("said"), F.col("t").isNull().alias("no_trace"), each("t.spans").alias("s"))
    own = F.coalesce("declared", F.get("said", F.lit(0)))
    foreign, sid = F.exists("said", lambda x: x != own), F.coalesce("s.context.span_id", "s.span_id", "s.id")
    problem = F.when(F.col("no_trace"), "no trace export").when(own.isNull(), "a trace export without a trace id").when(foreign & F.col("declared").isNull(), "spans of one export name several traces").when(foreign, "a span of another trace").when(F.col("s").isNotNull() & sid.isNull(), "a span without id")
    checked = own if tolerant else F.when(problem.isNotNull(), F.raise_error(problem).cast("string")).otherwise(own)
    begun, ended = F.coalesce("s.start_time", "s.startTime"), F.coalesce("s.end_time", "s.endTime")
    (start, order), (end, _) = _time(begun), _time(ended)
    code = F.upper(F.coalesce("s.status_code", "s.statusCode", F.lit("UNSET")))
    status = F.when(code == "OK", "ok").when(code == "ERROR", "error").otherwise("unset")
    kind = F.upper(F.coalesce("s.span_kind", "s.kind", F.lit("")))
    a = F.map_filter(F.coalesce("s.attributes", F.create_map().cast("map<string,string>")), lambda k, v: k.isin(*ATTRIBUTES))
    ok = lambda c: F.when(F.trim(c).rlike(NAME), F.trim(c))
    evals = F.transform(F.coalesce("s.annotations", F.array().cast(f"array<{_ANNOTATION}>")), lambda e: F.struct(ok(e["name"]).alias("name"), ok(F.coalesce(e["result"]["label"], e["label"])).alias("label"), F.coalesce(e["result"]["score"], e["score"]).alias("score")))
    if tolerant:
        s = s.withColumn("problem", problem)
    return s.select(
        *others, *(["problem"] if tolerant else []), checked.alias("trace_id"), sid.alias("step_id"), F.nullif(F.coalesce("s.parent_id", "s.parentId"), F.lit("")).alias("parent"), ok(F.col("s.name")).alias("name"),
        start.alias("start"), begun.isNotNull().alias("start_sent"), order.alias("start_order"), end.alias("end"), ended.isNotNull().alias("end_sent"), status.alias("status"), F.lit(None).cast("string").alias("error_msg"), F.lit(False).alias("stand_in"),
        F.when(kind.isin(*spans.SPAN_KINDS), kind).alias("kind"), a["graph.node.id"].alias("node"), a["graph.node.parent_id"].alias("node_parent"), a.alias("attrs"),
        F.array().cast("array<struct<trace: string, span: string>>").alias("links"), F.filter(evals, lambda e: e["name"].isNotNull()).alias("evaluations"),
    )


def ingest(texts: DataFrame) -> TraceSet:
    return resolved(decode(texts))


def resolved(decoded: DataFrame, faults: list | None = None) -> TraceSet:
    return spans.ingest(decoded, links_as_causes=False, error_messages=False, keep_unset=True, source_kind="phoenix", faults=faults)
