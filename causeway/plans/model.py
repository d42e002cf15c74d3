"""What the data model says of single records: vocabularies, forms of codes and digests, numbers, provenance. Each rule is one expression, all are told in one pass a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway import schema
from causeway.schema import TraceSet

# Fixed values of the data model.
CODE = r"^[a-z][a-z0-9_]*+(\.[a-z][a-z0-9_]*+)++$"
CODE_CHARS = 128
DIGEST = "^sha256:[0-9a-f]{64}$"
VERDICT = "^[a-z][a-z0-9_-]{0,63}$"
DECIDED_BY = "toolgraph_preflight"
UNKNOWN_FIELDS = ("error_msg", "kind", "name")


def _told(rows: DataFrame, subject: Column, rules: dict[str, Column]) -> DataFrame:
    broken = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), rule) for rule, bad in rules.items()]))
    return rows.select("trace_id", F.explode(broken).alias("rule"), subject.alias("subject"))


def _outside(c: str, values: tuple[str, ...]) -> Column:
    return F.col(c).isNull() | ~F.col(c).isin(*values)


def _in_order(codes: Column) -> Column:
    """Whether an array is sorted and has no value twice."""
    return F.forall(F.sequence(F.lit(1), F.size(codes)), lambda k: (k == 1) | (F.get(codes, k - 2) < F.get(codes, k - 1))) | (F.size(codes) == 0)


def faults(ts: TraceSet, writing: bool = False) -> DataFrame:
    """trace_id, rule, subject: records that the model refuses. writing: also gap codes that this library doesn't know; a reader keeps
    those, for a newer writer may have them, and takes their effect as unknown."""
    gaps = F.coalesce("capture.gaps", F.array().cast("array<struct<code: string, count: bigint>>"))
    codes = F.transform(gaps, lambda g: g["code"])
    decided = F.coalesce("decision_evidence", F.array().cast("array<struct<source: string, artifact_digest: string, graph_generation: bigint, verdict: string>>"))
    odd = lambda d: (d["source"] != DECIDED_BY) | ~d["artifact_digest"].rlike(DIGEST) | (d["graph_generation"] < 0) | ~d["verdict"].rlike(VERDICT)
    head = {
        "a trace without a source kind": F.col("source_kind").isNull(), "no such status": _outside("status", schema.STATUSES), "no such fidelity": _outside("causal_fidelity", schema.FIDELITIES),
        "a capture record without gaps": F.col("capture").isNotNull() & F.col("capture.gaps").isNull(), "gaps are sorted by code, one for each": ~_in_order(codes),
        "a gap's code has another form": F.exists(codes, lambda c: c.isNull() | ~c.rlike(CODE) | (F.length(c) > CODE_CHARS)), "a gap counts one or more": F.exists(gaps, lambda g: g["count"].isNull() | (g["count"] < 1)),
        "a decision has another form": F.exists(decided, lambda d: F.coalesce(odd(d), F.lit(True))), "a graph's fingerprint has another form": F.col("schedule_graph").isNotNull() & ~F.coalesce(F.col("schedule_graph.fingerprint").rlike(DIGEST), F.lit(False)),
    }
    if writing:
        head["a gap code that isn't known"] = F.exists(codes, lambda c: ~c.isin(*schema.GAP_CODES))
    unknown, ev = F.coalesce("unknown_fields", F.array().cast("array<string>")), F.col("evidence")
    endless = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    step = {
        "a step without an id": F.col("step_id").isNull(), "a step without a place": F.col("seq").isNull(), "no such kind": _outside("kind", schema.KINDS), "no such status": _outside("status", schema.STATUSES), "no such source": _outside("source", schema.SOURCES),
        "unknown fields are sorted and known": ~_in_order(unknown) | F.exists(unknown, lambda u: u.isNull() | ~u.isin(*UNKNOWN_FIELDS)), "a digest of another form": ev["artifact_digest"].isNotNull() & ~ev["artifact_digest"].rlike(DIGEST),
        "a number that is endless": endless(ev["duration_ms"]) | F.exists(ev["evaluations"], lambda e: F.coalesce(endless(e["score"]), F.lit(False))), "an evaluation without a name": F.exists(ev["evaluations"], lambda e: e["name"].isNull()),
    }
    edge = {"no such edge type": _outside("type", schema.EDGE_TYPES), "no such origin": F.col("origin").isNotNull() & ~F.col("origin").isin(*schema.ORIGIN_RANK), "an edge without an end": F.col("src").isNull() | F.col("dst").isNull()}
    flagged = ts.steps.where(F.size("unknown_fields") > 0).select("trace_id").distinct()
    alone = ts.traces.where("capture IS NULL").join(flagged, "trace_id").select("trace_id", F.lit("unknown fields without a capture record").alias("rule"), F.col("trace_id").alias("subject"))
    told = _told(ts.traces, F.col("trace_id"), head).union(_told(ts.steps, F.col("step_id"), step)).union(_told(ts.edges, F.concat_ws("->", "src", "dst"), edge))
    return told.union(alone)
