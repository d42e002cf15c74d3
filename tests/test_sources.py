"""Sources on small documents."""

import json

import pytest

from causeway.plans import projection
from causeway.sources import artifacts, checkpoints, exports, router, spans
from causeway.streaming import follow


def texts(spark, *docs):
    return spark.createDataFrame([(d if isinstance(d, str) else json.dumps(d),) for d in docs], "value string")


def span(sid, parent="", start=None, node=None, wants=None, links=(), trace="t", **more):
    attrs = [{"key": k, "value": {"stringValue": v}} for k, v in (("graph.node.id", node), ("graph.node.parent_id", wants)) if v is not None]
    return {"traceId": trace, "spanId": sid, "parentSpanId": parent, "name": sid, "startTimeUnixNano": None if start is None else str(start), "links": [{"traceId": t, "spanId": s} for t, s in links], "attributes": attrs + more.pop("attributes", []), **more}


def doc(*s):
    return {"resourceSpans": [{"scopeSpans": [{"spans": list(s)}]}]}


def ingest(spark, *docs, **options):
    return spans.ingest(spans.decode(spans.documents(texts(spark, *docs))), **options)


def arcs(ts):
    return sorted((r.src, r.dst, r.origin) for r in projection.causes(ts).collect())


def gaps(ts):
    return {g.code: g["count"] for r in ts.traces.collect() for g in r.capture.gaps}


def test_loop_parent_and_links(spark):
    ts = ingest(spark, doc(span("r", start=10), span("p1", "r", 20, node="plan"), span("x", "r", 30, wants="plan"), span("p2", "r", 40, node="plan"), span("y", "r", 50, wants="plan", links=[("t", "p2"), ("", "r"), ("other", "r"), ("t", "gone"), ("t", "y")]),
                           span("z", "r", wants="plan"), span("w", "r", 70, wants="nowhere")))
    assert arcs(ts) == [("p1", "r", "span_parent_fallback"), ("p2", "r", "span_parent_fallback"), ("w", "r", "span_parent_fallback"), ("x", "p1", "graph_parent_heuristic"), ("y", "p2", "graph_parent"), ("z", "r", "span_parent_fallback")]
    assert gaps(ts) == {"otlp.graph_parent_by_timing": 1, "otlp.graph_parent_fallback": 2, "otlp.unscoped_span_link": 1, "otlp.foreign_trace_link": 1, "otlp.unresolved_span_link": 1}
    assert projection.violations(ts).isEmpty()


def test_lines_and_snake_case(spark):
    a = json.dumps(doc(span("a", start=1, status={"code": 2, "message": "timeout"})))
    b = json.dumps({"resource_spans": [{"scope_spans": [{"spans": [{"trace_id": "t", "span_id": "b", "parent_span_id": "a", "name": "", "start_time_unix_nano": "1500000000000000000", "end_time_unix_nano": "bad", "attributes": [{"key": "openinference.span.kind", "value": {"stringValue": "tool"}}, {"key": "llm.token_count.prompt", "value": {"intValue": "7"}}, {"key": "llm.token_count.total", "value": {"doubleValue": 1.5}}, {"key": "llm.cost.total", "value": {"stringValue": "cheap"}}]}]}]}]})
    ts = ingest(spark, a + "\n\n" + b)
    step = {r.step_id: r for r in ts.steps.collect()}
    assert (step["a"].status, step["a"].error_msg, step["a"].kind, step["a"].unknown_fields) == ("error", "timeout", "CHAIN", ["kind"])
    assert (step["b"].kind, step["b"].ts, step["b"].evidence.prompt_tokens, step["b"].evidence.total_tokens, step["b"].evidence.total_cost) == ("TOOL", "2017-07-14T02:40:00+00:00", 7, None, "unreadable")
    assert gaps(ts) == {"otlp.unreadable_timestamp": 1, "otlp.unreadable_token_count": 1, "otlp.unreadable_total_cost": 1}


@pytest.mark.parametrize("bad", [doc(span("a", "gone")), doc(span("a"), span("a")), doc(span("a", "b"), span("b", "a")), doc(span("a", wants="x")), doc(span("a", links=[("t", "b")]), span("b", links=[("t", "a")])), "not json"])
def test_contradictions_are_errors(spark, bad):
    with pytest.raises(Exception):
        ingest(spark, bad).edges.collect()


def test_exports(spark):
    t = {"traceId": "t", "spans": [{"id": "n1", "context": {"trace_id": "t", "span_id": "a"}, "name": "ok.name", "span_kind": "agent", "start_time": "2024-01-01T00:00:00Z", "status_code": "OK"}, {"context": {"span_id": "b"}, "parent_id": "a", "name": "free text here", "start_time": "5", "status_code": "ERROR", "attributes": {"input.value": "secret", "llm.token_count.total": "3"}, "annotations": [{"name": "q", "result": {"label": "good", "score": 0.5}}, {"name": "no name here"}]}]}
    for envelope in (t, [t], {"traces": [t]}, {"data": [t]}):
        ts = exports.ingest(texts(spark, envelope))
        step = {r.step_id: r for r in ts.steps.collect()}
        assert (step["a"].name, step["a"].kind, step["b"].name, step["b"].status, step["b"].error_msg) == ("ok.name", "AGENT", None, "error", None)
        assert [tuple(e) for e in step["b"].evidence.evaluations] == [("q", "good", 0.5)] and step["b"].evidence.total_tokens == 3
        assert "secret" not in str(step) and arcs(ts) == [("b", "a", "span_parent_fallback")]


def test_artifacts(spark, tmp_path):
    ts = ingest(spark, doc(span("a", start=1), span("b", "a", 2)))
    (tmp_path / "one.json").write_text(artifacts.to_text(ts).first().value)
    (tmp_path / "bad.json").write_text("{}")
    again = artifacts.read(spark, str(tmp_path), lenient=True)
    assert arcs(again) == arcs(ts) and again.steps.count() == 2 and artifacts.skipped(spark, str(tmp_path)).count() == 1
    with pytest.raises(Exception):
        artifacts.read(spark, str(tmp_path)).traces.collect()
    old = {"schema_version": 1, "trace": {"trace": {"trace_id": "o", "source_kind": "x"}, "steps": [{"trace_id": "o", "step_id": s, "seq": k, "kind": "CHAIN", "status": "ok"} for k, s in enumerate("ab")], "edges": [{"type": "CAUSED_BY", "src": "b", "dst": "a"}]}}
    first = artifacts.from_text(texts(spark, old))
    assert arcs(first) == [("b", "a", "legacy_unknown")] and first.traces.first().causal_fidelity == "legacy_unknown"


def checkpoint(cid, parent=None, ns="", step=0, source="loop", values=None, writes=(), parents=None, parent_ns=None, seen=None):
    return ("th", ns, cid, parent_ns, parent, f"2024-01-01T00:00:{int(cid[1:]):02d}", 4, values or {}, {}, seen or {}, source, step, parents or {}, [dict(zip(("task_id", "channel", "value"), w)) for w in writes])


def test_checkpoints(spark):
    rows = [checkpoint("c1", step=-1, source="input"), checkpoint("c2", "c1", step=0, values={"branch:to:plan": "x"}), checkpoint("c3", "c2", step=1, values={"branch:to:call_tools": "x", "branch:to:sub": "y"}),
            checkpoint("c4", ns="sub:1", step=0, parents={"": "c3"}), checkpoint("c5", "c4", ns="sub:1", step=1, parents={"": "c3"}),
            checkpoint("c6", "c3", step=2, values={"error": "boom"}, writes=[("k1", "__error__", "ValueError('x')"), ("k2", "__error__", "CancelledError()"), ("k3", "__interrupt__", "?"), (None, "x", "y")]), ]
    ts = checkpoints.ingest(spark.createDataFrame(rows, checkpoints.ROWS))
    assert arcs(ts) == sorted([("c2", "c1", "checkpoint_parent"), ("c3", "c2", "checkpoint_parent"), ("sub:1:c4", "c3", "checkpoint_parent"), ("sub:1:c5", "sub:1:c4", "checkpoint_parent"), ("c6", "sub:1:c5", "checkpoint_subgraph_return"), ("c6#task:k1", "c6", "checkpoint_parent"), ("c6#task:k2", "c6", "checkpoint_parent"), ("c6#interrupt:k3", "c6", "checkpoint_parent")])
    step = {r.step_id: r for r in ts.steps.collect()}
    assert (step["c3"].name, step["sub:1:c4"].name, step["c6"].status, step["c6"].error_msg, step["c2"].unknown_fields) == ("plan", "sub", "error", "boom", [])
    assert (step["c6"].name, step["c6"].kind) == ("call_tools", "TOOL")
    assert [step[f"c6#task:{k}"].status for k in ("k1", "k2")] == ["error", "unset"] and step["c6#interrupt:k3"].source == "interrupt"
    assert gaps(ts) == {"langgraph.malformed_pending_writes": 1, "langgraph.unattributed_failed_task": 1, "langgraph.unattributed_interrupted_task": 1}
    assert projection.violations(ts).isEmpty()
    with pytest.raises(Exception, match="partial"):
        checkpoints.ingest(spark.createDataFrame([checkpoint("c2", "c1")], checkpoints.ROWS)).edges.collect()


def test_stream(spark, tmp_path):
    src, seen = tmp_path / "in", {}
    src.mkdir()
    renew = lambda ts, k: seen.update({r.trace_id: r.n_failed for r in follow.failures_per_trace(ts).collect()})
    (src / "a.json").write_text(json.dumps(doc(span("a", start=1, status={"code": 2}))))
    follow.follow(spark, str(src), str(tmp_path / "store"), str(tmp_path / "cp"), renew).awaitTermination(120)
    assert seen == {"t": 1}
    (src / "b.json").write_text(json.dumps(doc(span("b", "a", 2, status={"code": "ERROR"}))))
    follow.follow(spark, str(src), str(tmp_path / "store"), str(tmp_path / "cp"), renew).awaitTermination(120)
    assert seen == {"t": 2}


BAD_SHAPES = ["[]", "5", '"x"', '{"resourceSpans": {"a": 1}}', '{"resourceSpans": 0}', '{"resourceSpans": [5]}', '{"resourceSpans": [{"scopeSpans": "x"}]}', '{"resourceSpans": [{"scopeSpans": [{"spans": {}}]}]}',
              '{"resourceSpans": [{"scopeSpans": [{"spans": [1]}]}]}', '{"resource_spans": [{"scope_spans": [{"spans": [{"events": 3}]}]}]}']


def test_malformed_documents_are_errors(spark):
    for bad in BAD_SHAPES:
        with pytest.raises(Exception):
            spans.documents(texts(spark, bad)).collect()
    for empty in ("{}", '{"resourceSpans": null}', '{"resourceSpans": [{"scopeSpans": []}]}'):
        assert spans.decode(spans.documents(texts(spark, empty))).count() == 0


def test_parents_by_number_and_late_causes(spark):
    """Untimed spans of one node are told apart by start numbers; a cause that starts after its effect still comes first."""
    t = {"traceId": "t", "spans": [{"span_id": s, "parent_id": p, "start_time": str(n), "attributes": a} for s, p, n, a in [
        ("r", None, 1, {}), ("p1", "r", 2, {"graph.node.id": "plan"}), ("x", "r", 3, {"graph.node.parent_id": "plan"}), ("p2", "r", 4, {"graph.node.id": "plan"}), ("y", "r", 5, {"graph.node.parent_id": "plan", "graph.node.id": "plan"})]]}
    assert [a for a in arcs(exports.ingest(texts(spark, t))) if a[0] in "xy"] == [("x", "p1", "graph_parent_heuristic"), ("y", "p2", "graph_parent_heuristic")]
    ts = ingest(spark, doc(span("a", start=10, links=[("t", "c")]), span("b", "a", 20), span("c", start=30), span("d", start=5)))
    assert [r.step_id for r in ts.steps.orderBy("seq").collect()] == ["d", "c", "a", "b"]
    deep = [span("s0", start=1)] + [span(f"s{k}", f"s{k - 1}", 1) for k in range(1, 40)]
    assert [r.step_id for r in ingest(spark, doc(*deep)).steps.orderBy("seq").collect()] == [f"s{k}" for k in range(40)]


def test_artifacts_are_validated(spark):
    ts = ingest(spark, doc(span("a", start=1), span("b", "a", 2), span("c", "b", 3, status={"code": 2})))
    rows = artifacts.to_text(ts).collect()
    text = rows[0].value
    assert text == json.dumps(json.loads(text), indent=2, sort_keys=True) and '"schedule_graph"' not in text and rows[0].version == 7
    import hashlib

    assert rows[0].digest == "sha256:" + hashlib.sha256(text.encode()).hexdigest()
    body = json.loads(text)
    assert artifacts.from_text(texts(spark, body)).steps.count() == 3

    def broken(change):
        other = json.loads(text)
        change(other, other["trace"])
        with pytest.raises(Exception):
            artifacts.from_text(texts(spark, other)).traces.collect()

    broken(lambda d, t: t["edges"].append({"type": "CAUSED_BY", "src": "a", "dst": "gone", "origin": "span_link"}))
    broken(lambda d, t: t["edges"].append({"type": "CAUSED_BY", "src": "a", "dst": "c", "origin": "span_link"}))
    broken(lambda d, t: t["trace"].update(status="ok"))
    broken(lambda d, t: [e.update(dst="a") for e in t["edges"] if e["type"] == "TREE_PARENT" and e["src"] == "c"])
    broken(lambda d, t: d.update(schema_version=6))
    broken(lambda d, t: d.update(schema_version=12))


def test_router(spark, tmp_path):
    ts = ingest(spark, doc(span("a", start=1)))
    art = json.loads(artifacts.to_text(ts).first().value)
    art["trace"]["trace"]["trace_id"] = "art"
    for part in (art["trace"]["steps"], art["trace"]["edges"]):
        for x in part:
            x.update({k: "art" for k in ("trace_id", "dst") if x.get(k) == "t"})
    export = {"traceId": "e", "spans": [{"span_id": "s", "start_time": "1"}]}
    lines = "\n".join(json.dumps(doc(span("q", start=1, trace=f"l{k}"))) for k in range(2))
    files = {"art": art, "spans": doc(span("a", start=1, trace="o")), "lines": lines, "export": export, "listed": [dict(export, traceId="e2")], "bad": "{", "none": {"x": 1}, "both": {**doc(span("a")), "spans": []}, "held": {"traces": [art]}, "rows": json.dumps(export) + "\n" + json.dumps(export)}
    for name, body in files.items():
        (tmp_path / f"{name}.json").write_text(body if isinstance(body, str) else json.dumps(body))
    got, failed = router.read(spark, str(tmp_path))
    assert {r.trace_id for r in got.traces.collect()} == {"art", "o", "l0", "l1", "e", "e2"}
    reasons = {r.file.rsplit("/", 1)[1]: r.reason for r in failed.collect()}
    assert reasons == {"bad.json": "not valid JSON", "none.json": "unsupported shape", "both.json": "ambiguous: records of two formats", "held.json": "a portable trace must be the whole document", "rows.json": "lines are read as span documents only"}
    one, _ = router.read(spark, str(tmp_path), ["o"])
    assert router.sole_trace(one) == "o"
    with pytest.raises(ValueError):
        router.sole_trace(got)
