"""Rules of single records: each is broken once, valid traces break none."""

import pytest
from pyspark.sql import functions as F

from causeway import schema
from causeway.plans import model
from causeway.schema import TraceSet
from causeway.sources import artifacts, views
from tests.test_traces import build

DIGEST = "sha256:" + "a" * 64


def changed(spark, ts, table, **columns):
    """The trace set with columns of one table replaced: values, or expressions."""
    df = getattr(ts, table)
    as_column = lambda c, v: (v if isinstance(v, F.Column) else F.lit(v)).cast(df.schema[c].dataType)
    df = df.withColumns({c: as_column(c, v) for c, v in columns.items()})
    return TraceSet(**{"traces": ts.traces, "steps": ts.steps, "edges": ts.edges, table: df})


GAP = lambda *pairs: F.struct(F.array(*[F.struct(F.lit(c).alias("code"), F.lit(n).cast("long").alias("count")) for c, n in pairs]).alias("gaps"))
DECISION = lambda *v: F.array(F.struct(*[F.lit(x).alias(n) for n, x in zip(("source", "artifact_digest", "graph_generation", "verdict"), v)]))
EVIDENCE = lambda **v: F.struct(*[(F.lit(v.get(f.name)) if not isinstance(v.get(f.name), F.Column) else v[f.name]).cast(f.dataType).alias(f.name) for f in schema.struct("e " + schema.EVIDENCE)["e"].dataType])
SCORE = lambda name, x: F.array(F.struct(F.lit(name).alias("name"), F.lit("l").alias("label"), F.lit(x).alias("score")))


def test_rules(spark):
    ts = build(spark, [("t", "a", 0, "a", "TOOL", "ok"), ("t", "b", 1, "b", "TOOL", "ok")], [("t", "b", "a")])
    a = F.col("step_id") == "a"
    gap = ("langgraph.undecided_interrupt", 1)
    cases = {
        "a trace without a source kind": ("traces", dict(source_kind=None)), "no such status": ("traces", dict(status="fine")), "no such fidelity": ("traces", dict(causal_fidelity="some")), "a capture record without gaps": ("traces", dict(capture=F.struct(F.lit(None).alias("gaps")))),
        "gaps are sorted by code, one for each": ("traces", dict(capture=GAP(gap, gap))), "a gap's code has another form": ("traces", dict(capture=GAP(("Bad code", 1)))), "a gap counts one or more": ("traces", dict(capture=GAP((gap[0], 0)))),
        "a decision has another form": ("traces", dict(decision_evidence=DECISION("other", DIGEST, 1, "ok"))), "a graph's fingerprint has another form": ("traces", dict(schedule_graph=F.struct(F.lit("x").alias("fingerprint")))),
        "a step without a place": ("steps", dict(seq=F.when(~a, F.col("seq")))), "no such kind": ("steps", dict(kind=F.when(a, "HAMMER").otherwise("TOOL"))), "no such source": ("steps", dict(source=F.when(a, F.lit(None)).otherwise("loop"))),
        "a digest of another form": ("steps", dict(evidence=F.when(a, EVIDENCE(artifact_digest="sha256:A")))), "a number that is endless": ("steps", dict(evidence=F.when(a, EVIDENCE(evaluations=SCORE("q", float("nan")))))),
        "an evaluation without a name": ("steps", dict(evidence=F.when(a, EVIDENCE(evaluations=SCORE(None, 1.0))))), "no such edge type": ("edges", dict(type="LIKES")), "no such origin": ("edges", dict(origin="hearsay")), "an edge without an end": ("edges", dict(src=None)),
    }
    assert model.faults(ts, writing=True).isEmpty()
    parts = [model.faults(changed(spark, ts, table, **columns)).select(F.lit(rule).alias("case"), "rule", "subject") for rule, (table, columns) in cases.items()]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.union(p)
    got = sorted((r.case, r.rule) for r in whole.collect())
    assert got == sorted((rule, rule) for rule in cases)
    flags = changed(spark, ts, "steps", unknown_fields=F.when(a, F.array(F.lit("name"), F.lit("kind"))).otherwise(F.array().cast("array<string>")))
    assert sorted(r.rule for r in model.faults(flags).collect()) == ["unknown fields are sorted and known", "unknown fields without a capture record"]


def test_codes_of_newer_writers(spark):
    """A well-formed code that isn't known is read and kept, and never written."""
    ts = build(spark, [("t", "a", 0, "a", "TOOL", "ok")], [])
    new = changed(spark, ts, "traces", capture=GAP(("otlp.something_new", 2)), decision_evidence=DECISION("toolgraph_preflight", DIGEST, 1, "ok"))
    assert model.faults(new).isEmpty() and [r.rule for r in model.faults(new, writing=True).collect()] == ["a gap code that isn't known"]
    text = artifacts.to_text(new, check=False).select("value")
    assert artifacts.from_text(text).traces.first().capture.gaps[0].code == "otlp.something_new"
    with pytest.raises(ValueError, match="isn't known"):
        artifacts.to_text(new)


def test_views_are_valid(spark, small):
    for view in (views.events, views.orders, views.conversations):
        assert model.faults(view(spark, small), writing=True).where("rule <> 'unknown fields without a capture record'").isEmpty()
