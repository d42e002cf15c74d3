"""Folders in which some files are bad: the others are read, each bad one is named with its reason, digests are those of the bytes."""

import hashlib
import json

import pytest

from causeway.sources import artifacts, exports, router, spans
from tests.test_sources import doc, ingest, span, texts


def artifact(text, name, change=lambda doc: None):
    body = json.loads(text.replace('"good5"', f'"{name}"'))
    change(body)
    return body


def attribute(key, value):
    return {"key": key, "value": {"stringValue": value}}


DIGEST = "sha256:" + "0" * 64
DECIDED = [attribute("toolgraph.preflight.artifact_digest", DIGEST), attribute("toolgraph.graph_generation", "3"), attribute("toolgraph.preflight.verdict", "allow")]


def with_attributes(*attrs, name="a", trace="t"):
    s = span(name, start=1, trace=trace)
    s["attributes"] = [*s.get("attributes", []), *attrs]
    return s


REFUSED = {
    "half a decision": [with_attributes(*DECIDED[:2])], "wrong digest": [with_attributes(attribute("syncmill.artifact_digest", "sha256:xyz"))], "wrong verdict": [with_attributes(*DECIDED[:2], attribute("toolgraph.preflight.verdict", "Not OK"))],
    "wrong generation": [with_attributes(DECIDED[0], attribute("toolgraph.graph_generation", "-1"), DECIDED[2])], "two decisions": [with_attributes(*DECIDED), with_attributes(*DECIDED[:2], attribute("toolgraph.preflight.verdict", "deny"), name="b")],
    "blank run": [with_attributes(attribute("syncmill.run_id", "a b"))],
}


def test_refused_attributes(spark):
    """An incomplete decision is an error; a whole one is kept. The other refusals are tested in a folder."""
    got = ingest(spark, doc(with_attributes(*DECIDED, attribute("syncmill.artifact_digest", DIGEST)), with_attributes(*DECIDED, name="b"))).traces.first()
    assert [tuple(d) for d in got.decision_evidence] == [("toolgraph_preflight", DIGEST, 3, "allow")]
    with pytest.raises(Exception):
        ingest(spark, doc(*REFUSED["half a decision"])).traces.collect()


def test_exports_name_one_trace(spark):
    one = lambda *ids, **more: {**more, "spans": [{"id": f"s{k}", "context": {"trace_id": t} if t else None} for k, t in enumerate(ids)]}
    assert exports.ingest(texts(spark, one("x", None, "x"))).traces.first().trace_id == "x"
    for bad in (one("x", "y"), one(None, None), one("x", traceId="y"), {"spans": [{"id": "s"}], "traceId": ""}):
        with pytest.raises(Exception):
            exports.decode(texts(spark, bad)).collect()


def test_bad_files_do_not_stop_a_folder(spark, tmp_path):
    text = artifacts.to_text(ingest(spark, doc(span("a", start=1, trace="good5"), span("b", "a", 2, trace="good5")))).first().value
    good = {"spans": doc(span("a", start=1, trace="good1")), "lines": "\n".join(json.dumps(doc(span("q", start=1, trace=f"good{k}"))) for k in (2, 3)), "export": {"traceId": "good4", "spans": [{"span_id": "s"}]}, "art": artifact(text, "good5")}
    bad = {
        "notjson": "{", "shape": {"resourceSpans": [{"scopeSpans": 3}]}, "parent": doc(span("a", "gone", trace="b1")), "twice": doc(span("a", trace="b2"), span("a", trace="b2")), "inside": doc(span("a", "b", trace="b3"), span("b", "a", trace="b3")),
        "untold": doc(span("a", wants="x", trace="b4")), "cycle": doc(span("a", links=[("b5", "b")], trace="b5"), span("b", links=[("b5", "a")], trace="b5")), "noid": doc({**span("a", trace="b6"), "spanId": ""}), "status": doc(span("a", status={"code": 7}, trace="b7")),
        "half": doc(span("a", start=1, trace="fine"), with_attributes(*DECIDED[:2], trace="b8")), "foreign": {"traceId": "b9", "spans": [{"id": "s", "context": {"trace_id": "z"}}]}, "several": {"spans": [{"id": "s", "context": {"trace_id": t}} for t in ("b10", "b11")]},
        "version": artifact(text, "b12", lambda d: d.update(schema_version=12)), "cause": artifact(text, "b13", lambda d: d["trace"]["edges"].append({"type": "CAUSED_BY", "src": "a", "dst": "gone", "origin": "span_link"})),
        **{f"refused{k}": doc(*[dict(s, traceId=f"r{k}") for s in rows]) for k, rows in enumerate(REFUSED.values())},
    }
    for name, body in {**good, **bad}.items():
        (tmp_path / f"{name}.json").write_text(body if isinstance(body, str) else json.dumps(body))
    (tmp_path / "bytes.json").write_bytes(b'{"resourceSpans": "\xff\xfe"}')
    got = router.load(spark, str(tmp_path))
    short = lambda f: f.rsplit("/", 1)[1].removesuffix(".json")
    reasons = {short(r.file): r.reason for r in got.failures.collect()}
    assert set(reasons) == {*bad, "bytes"} and all(reasons.values())
    assert reasons["notjson"] == "not valid JSON" and reasons["bytes"] == "not UTF-8" and "parent" in reasons["parent"] and reasons["cycle"] == "causes form a cycle" and "together" in reasons["half"] and "several" in reasons["several"]
    want = {f"good{k}" for k in range(1, 6)}
    assert {r.trace_id for r in got.traces.traces.collect()} == {r.trace_id for r in got.traces.steps.select("trace_id").collect()} == want
    told = {(short(r.file), r.trace_id): r.digest for r in got.evidence.collect()}
    assert {t for _, t in told} == want
    for (name, _), digest in told.items():
        assert digest == "sha256:" + hashlib.sha256((tmp_path / f"{name}.json").read_bytes()).hexdigest()


def test_all_files_bad_or_none(spark, tmp_path):
    (tmp_path / "a.json").write_text("{")
    got = router.load(spark, str(tmp_path))
    assert got.failures.count() == 1 and got.traces.steps.count() == 0 and got.evidence.count() == 0


def test_shape_checks_agree(spark):
    """The shape check that never fails tells what the failing one refuses."""
    from tests.test_sources import BAD_SHAPES

    good = ["{}", '{"resourceSpans": null}', json.dumps(doc(span("a")))]
    rows = spans.documents(texts(spark, *BAD_SHAPES, *good), tolerant=True).collect()
    assert sorted(r.problem is None for r in rows) == [False] * len(BAD_SHAPES) + [True] * len(good)


def test_packed_files_are_a_folder(spark, tmp_path):
    """A table of files gives what a folder of them gives."""
    bodies = {"good": json.dumps(doc(span("a", start=1, trace="g1"))), "notjson": "{", "twice": json.dumps(doc(span("a", trace="b2"), span("a", trace="b2"))), "lines": "\n".join(json.dumps(doc(span("q", start=1, trace=f"g{k}"))) for k in (2, 3))}
    for name, body in bodies.items():
        (tmp_path / f"{name}.json").write_text(body)
    packed = spark.createDataFrame([(f"{name}.json", bytearray(body.encode())) for name, body in bodies.items()], "file string, content binary")
    plain = lambda got: (sorted((r.file.rsplit("/", 1)[-1], r.reason) for r in got.failures.collect()), sorted((r.file.rsplit("/", 1)[-1], r.digest, r.trace_id) for r in got.evidence.collect()), sorted(map(tuple, got.traces.steps.select("trace_id", "step_id").collect())))
    a, b = plain(router.load_table(packed)), plain(router.load(spark, str(tmp_path)))
    assert a == b and len(a[0]) == 2 and len(a[1]) == 3


def test_load_query_lists_no_files_and_sends_no_tables(spark, small, monkeypatch):
    """As many files as users aren't listed by the driver, and no part of their rows is sent through it."""
    from causeway.queries import QUERIES

    plans, real = [], router.staged
    for module in (router, spans):
        monkeypatch.setattr(module, "staged", lambda df: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or real(df))
    plans.append(QUERIES["h42_load_failures"](spark, small)._jdf.queryExecution().sparkPlan().toString())
    assert len(plans) > 8 and not [line for plan in plans for line in plan.splitlines() if "binaryFile" in line or "BroadcastHashJoin" in line]
