"""Report documents: their form, and what stands in them."""

import json

import pytest
from pyspark.sql import functions as F

from causeway.operators import motifs, reports
from causeway.plans import patterns
from causeway.schema import TraceSet

from .test_traces import build


def in_order(text):
    """The document, its keys in order at every level."""
    def pairs(items):
        keys = [k for k, _ in items]
        assert keys == sorted(keys)
        return dict(items)

    return json.loads(text, object_pairs_hook=pairs)


@pytest.fixture(scope="module")
def two(spark):
    steps = [("a", "p", 0, "plan", "CHAIN", "ok"), ("a", "q", 1, "tool", "TOOL", "error"), ("a", "r", 2, "odd name!", "TOOL", "error"), ("b", "p", 0, "plan", "CHAIN", "ok"), ("b", "q", 1, "tool", "TOOL", "ok")]
    ts = build(spark, steps, [("a", "q", "p"), ("a", "r", "q"), ("b", "q", "p")])
    record = F.struct(F.array().cast("array<struct<code: string, count: bigint>>").alias("gaps"))
    return TraceSet(ts.traces.withColumn("capture", record.cast(ts.traces.schema["capture"].dataType)), ts.steps, ts.edges), spark.createDataFrame([("a", "b")], "current string, baseline string")


def test_analysis_documents(two):
    ts, pairs = two
    a, b = (in_order(r.report) for r in reports.analyses(ts).orderBy("trace_id").collect())
    assert a["schema_version"] == 2 and a["comparison"] is None and a["links_preserved"] is None and a["error_count"] == 2 and a["artifact_digest"].startswith("sha256:")
    plan, tool = ({"kind": k, "name": n, "seq": s, "status": t, "step_id": i} for k, n, s, t, i in (("CHAIN", "plan", 0, "ok", "p"), ("TOOL", "tool", 1, "error", "q")))
    assert a["primary_failures"] == [{"step": tool, "causal_steps": [plan], "causal_edges": [{"effect": "q", "cause": "p", "origin": "graph_parent"}]}]
    hidden = a["propagated_failures"][0]["name"]
    assert hidden.startswith("redacted:") and a["warnings"][-1] == reports.REDACTED and reports.REDACTED not in b["warnings"]
    assert [(p["pattern_id"], p["step_ids"], p["labels"]) for p in a["patterns"]] == [
        ("plan-then-tool-failure", ["p", "q"], ["plan", "tool"]), ("tool-failure", ["q"], ["tool"]), ("tool-failure", ["r"], [hidden]), ("error", ["q"], ["tool"]), ("error", ["r"], [hidden]),
    ]
    assert b["primary_failures"] == b["propagated_failures"] == b["patterns"] == b["metrics"]["evaluations"] == []
    row = reports.analyses(ts, pairs).first()
    c = in_order(row.report)["comparison"]
    assert (row.current, row.baseline, c["baseline_digest"]) == ("a", "b", b["artifact_digest"])
    assert c["pattern_count_deltas"]["error"] == 2 and c["pattern_count_deltas"]["timeout"] == 0 and c["metric_deltas"]["total_cost"] is None and not c["topology_identical"]
    assert any(hidden in x for x in c["topology_changes"]) and not any("odd name" in x for x in c["topology_changes"])
    assert {(x["name"], x["before"], x["after"]) for x in c["behavior_changes"]} == {("tool", "ok", "error"), (hidden, None, "error")}


def test_check_documents(two):
    ts, pairs = two
    rules = ["topology-unchanged", "topology-unchanged:shape", "failures-not-increased", "pattern-not-increased:plan-then-tool-failure"]
    both = pairs.union(pairs.sparkSession.createDataFrame([("b", "a"), ("a", "a")], pairs.schema))
    got = {(r.current, r.baseline): in_order(r.report) for r in reports.checks(ts, both, rules).collect()}
    d = got["a", "b"]
    assert d["verdict"] == "FAIL" and d["kind"] == "causeway.check" and [r["rule_id"] for r in d["rules"]] == ["failures-not-increased", "pattern-not-increased", "topology-unchanged", "topology-unchanged"]
    assert [r["params"] for r in d["rules"]] == [{}, {"preset": "plan-then-tool-failure", "pattern_version": 1}, {"compare": "labels"}, {"compare": "shape"}]
    first, path, labels, shape = (r["evidence"] for r in d["rules"])
    assert [(e["baseline_errors"], e["current_errors"], e["current_step_ids"]) for e in first] == [(0, 1, ["r"]), (0, 1, ["q"])] and first[1]["signature"] == {"kind": "TOOL", "name": "tool"}
    assert path == [{"baseline_matches": 0, "current_matches": 1, "current_step_ids": [["p", "q"]], "signature": [{"kind": "CHAIN", "name": "plan"}, {"kind": "TOOL", "name": "tool"}]}]
    assert labels and shape and "odd name" not in json.dumps(d) and d["warnings"] == [reports.REDACTED]
    assert d["current"]["capture_gaps"] == [] and d["current"]["projection_rule"] == "temporal" and d["current"]["step_count"] == 3 and d["baseline"]["trace_id"] == "b"
    assert got["b", "a"]["verdict"] == "FAIL" and got["b", "a"]["rules"][0]["evidence"] == [] and got["b", "a"]["rules"][0]["outcome"] == "PASS"
    assert got["a", "a"]["verdict"] == "PASS" and all(r["evidence"] == [] for r in got["a", "a"]["rules"])
    blind = TraceSet(ts.traces.withColumn("capture", F.lit(None).cast(ts.traces.schema["capture"].dataType)), ts.steps, ts.edges)
    d = in_order(reports.checks(blind, pairs, rules[2:]).first().report)
    assert d["verdict"] == "INSUFFICIENT_EVIDENCE" and d["current"]["capture_gaps"] is None and all(r["evidence"] == [] and r["reasons"] for r in d["rules"])


def test_motif_lines(spark):
    """Unknown fields are listed; representatives are the three smallest by digest, then ids."""
    specs = [(t, f"s{i}", i, "tool", "TOOL", "error") for t in "abcd" for i in range(2)] + [("e", "x", 0, "tool", "TOOL", "error")]
    ts = build(spark, specs, [])
    odd = F.when(F.col("trace_id") == "e", F.array(F.lit("name"), F.lit("kind"))).otherwise(F.col("unknown_fields"))
    ts = TraceSet(ts.traces, ts.steps.withColumn("unknown_fields", odd), ts.edges)
    head, large, small = (in_order(r.report) for r in reports.motif_lines(ts, patterns.PRESETS["error"], skipped=2).orderBy("position").collect())
    assert head["coverage"]["artifacts_discovered"] == 7 and head["coverage"]["artifacts_skipped"] == 2 and head["pattern"] == {"id": "error", "version": 1}
    assert (large["match_count"], large["trace_count"], small["match_count"]) == (8, 4, 1)
    assert small["signature"]["steps"] == [{"kind": None, "name": None, "source": "loop", "status": "error", "unknown": ["kind", "name"]}]
    digests = sorted(r.digest for r in motifs.digest(ts).where("trace_id != 'e'").collect())
    assert large["representatives"] == [{"artifact_digest": d, "step_ids": [s]} for d, s in ((digests[0], "s0"), (digests[0], "s1"), (digests[1], "s0"))]
    with pytest.raises(ValueError):
        reports.motif_groups(ts, patterns.PRESETS["repeated-agent-failure"])
    none = TraceSet(ts.traces, ts.steps.where("status = 'ok'"), ts.edges)
    assert [in_order(r.report)["coverage"]["traces_matched"] for r in reports.motif_lines(none, patterns.PRESETS["error"]).collect()] == [0]


def test_trace_documents_reach_python_in_batches_of_bounded_bytes(spark, small, monkeypatch):
    """Long documents come a few at a time, however many traces there are."""
    import pandas as pd
    from pyspark.sql import functions as F

    from causeway.schema import TraceSet
    from causeway.session import ARROW_BYTES
    from causeway.sources import artifacts, views

    @F.pandas_udf("string")
    def told(texts: pd.Series) -> pd.Series:
        return pd.Series([f"{int(texts.str.len().sum())} {len(t)}" for t in texts])

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    monkeypatch.setattr(artifacts, "_canonical", told)
    ts = views.events(spark, small)
    long = ts.steps.withColumn("error_msg", F.repeat(F.lit("x"), F.lit(50_000)))
    sizes = [tuple(map(int, r.value.split())) for r in artifacts.to_text(TraceSet(ts.traces, long, ts.edges), check=False).select("value").collect()]
    assert len(sizes) > 4 and max(batch for batch, _ in sizes) <= ARROW_BYTES + max(own for _, own in sizes)
