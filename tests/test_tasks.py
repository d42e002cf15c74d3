"""Task ids, names, packets and scheduled steps of checkpoint histories against plain loops and stated cases."""

import hashlib
import json

import pytest
from xxhash import xxh3_128_hexdigest

from causeway.sources import checkpoints, tasks

NULL = "00000000-0000-0000-0000-000000000000"


def hashed(cid, v, *parts):
    try:
        seed = bytes.fromhex(cid.replace("-", ""))
    except ValueError:
        return None
    data = seed + "".join(parts).encode()
    h = hashlib.sha1(data).hexdigest() if v <= 1 else xxh3_128_hexdigest(data)
    return "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:32]))


def pull(cid, v, ns, step, node, *triggers):
    return hashed(cid, v, f"{ns}|{node}" if ns else node, str(step + 1), node, "__pregel_pull", *triggers)


def push(cid, v, ns, step, node, idx):
    return hashed(cid, v, f"{ns}|{node}" if ns else node, str(step + 1), node, "__pregel_push", str(idx))


def row(cid, parent=None, ns="", step=0, v=4, values=None, versions=None, seen=None, writes=(), parents=None, source="loop", thread="t"):
    return (thread, ns, cid, None, parent, f"2024-01-01T00:00:{step % 60:02}", v, values or {}, versions or {}, seen or {}, source, step, parents or {}, [{"task_id": t, "channel": c, "value": x} for t, c, x in writes])


def read(spark, rows, **more):
    return checkpoints.ingest(spark.createDataFrame(rows, checkpoints.ROWS), **more)


def gaps(ts):
    return {(r.trace_id, g["code"]): g["count"] for r in ts.traces.collect() for g in r.capture.gaps}


def test_names_equal_plain_loops(spark):
    """Every node a checkpoint mentions, under every set of triggers, in root and subgraph, is named, by SHA-1 ids in old checkpoints and xxh3 ids in others; nothing else is."""
    wants, rows = {}, []
    for v in (1, 4):
        wants[f"v{v}"], more = named_rows(v)
        rows += more
    ts = read(spark, rows)
    got = {(r.trace_id, r.step_id.split("#")[0], r.step_id.split(":")[-1]): r for r in ts.steps.where("source = 'task'").collect()}
    assert len(got) == sum(map(len, wants.values()))
    for thread, want in wants.items():
        for (s, t), name in want.items():
            r = got[thread, f"{s}:{CID}" if s else CID, t]
            assert r.name == name and r.unknown_fields == ([] if name else ["kind", "name"]) and r.kind == ("TOOL" if name == "call_tool" else "CHAIN"), (s, t, name)
    assert gaps(ts) == {(f"v{v}", code): 6 for v in (1, 4) for code in ("langgraph.undecodable_send_packets", "langgraph.unattributed_failed_task")}


CID = "1ef4f797-8335-6428-8001-8a1503f9b875"


def named_rows(v):
    cid, ns = CID, "sub:9"
    values = {"branch:to:call_tool": "1", "join:a+b:fan": "1", "branch:to:": "1", "join:a:b:odd": "1", "other": "x", "__pregel_tasks": json.dumps([{"node": "work"}, {"node": 5}, None, {"node": "work"}, "text"])}
    want = {}
    for s, step in (("", 3), (ns, 7)):
        known = {"call_tool": [["branch:to:call_tool"]], "fan": [["branch:to:fan", "join:a+b:fan"], ["join:a+b:fan"], ["branch:to:fan"]], "odd": [["branch:to:odd", "join:a:b:odd"]], "old": [["branch:to:old"]], "__start__": [["__start__"]], "Ünï": [["branch:to:Ünï"]]}
        for node, sets in known.items():
            want |= {(s, pull(cid, v, s, step, node, *t)): node for t in sets}
        want |= {(s, push(cid, v, s, step, "work", i)): "work" for i in (0, 3)}
        want |= {(s, push(cid, v, s, step, "work", 1)): None, (s, pull(cid, v, s, step, "never", "branch:to:never")): None, (s, "k"): None}
    writes = lambda s: [(t, "__error__", "E()") for x, t in want if x == s]
    return want, [row(cid, ns=s, step=step, v=v, values=values, versions={"join:a+b:fan": "2"}, seen={"old": {}, "Ünï": {}}, writes=writes(s), source="input", parents={"": cid} if s else None, thread=f"v{v}") for s, step in (("", 3), (ns, 7))]


def test_ids_need_hexadecimal_checkpoints(spark):
    t = pull("ab", 4, "", 0, "n", "branch:to:n")
    rows = [row("xyz", v=4, values={"branch:to:n": "1"}, writes=[(t, "__error__", "E()")], source="input"), row("abc", v=4, values={"branch:to:n": "1"}, writes=[(t, "__error__", None)], source="input", thread="odd"),
            row("ab", v=4, values={"branch:to:n": "1"}, writes=[(t, "other", "1"), (t, "__error__", "First()"), (t, "__error__", "Then()")], source="input", thread="hex")]
    got = {r.trace_id: r for r in read(spark, rows).steps.where("source = 'task'").collect()}
    assert [got[k].name for k in ("t", "odd", "hex")] == [None, None, "n"]
    assert got["hex"].error_msg == "First()" and got["odd"].error_msg.startswith("<exception not") and got["odd"].unknown_fields == ["error_msg", "kind", "name"]


def test_source_node_wins_and_cancelled_tasks_are_no_gap(spark):
    rows = [row("aa", values={"branch:to:n": "1"}, writes=[("k1", "__error_source_node__", ""), ("k1", "__error_source_node__", "by"), ("k1", "__error__", "E()"), ("k2", "__error__", "CancelledError()"), (pull("aa", 4, "", 0, "n", "branch:to:n"), "__interrupt__", "?")], source="input")]
    ts = read(spark, rows)
    got = {r.step_id.split(":")[-1]: r for r in ts.steps.where("source <> 'input'").collect()}
    assert got["k1"].name == "by" and got["k2"].name is None and got["k2"].status == "unset"
    assert {r.name for r in got.values() if r.source == "interrupt"} == {"n"} and gaps(ts) == {}


def graph(spark, *nodes, given=None):
    return tasks.Graph(spark.createDataFrame(list(nodes), tasks.NODES), None if given is None else spark.createDataFrame(given, tasks.TASKS))


def test_scheduled_steps(spark):
    ready = dict(values={"branch:to:b": "1", "branch:to:tools": "1", "branch:to:gone": "1"}, versions={"branch:to:b": "10", "branch:to:tools": "9"}, seen={"b": {"branch:to:b": "9"}, "tools": {"branch:to:tools": "9"}})
    wrote = pull("ab", 4, "", 1, "c", "branch:to:c", "x")
    packets = json.dumps([{"node": "w"}, {"node": "absent"}, {"node": "w"}])
    rows = [row("aa", step=0, source="input"), row("ab", "aa", step=1, values=ready["values"] | {"x": "1", "__pregel_tasks": packets}, versions=ready["versions"] | {"x": "1"}, seen=ready["seen"], writes=[(wrote, "y", "1"), (NULL, "branch:to:b", "1"), (NULL, "__pregel_tasks", "1"), (NULL, "free", "1")]),
            row("ff", ns="sub:1", step=0, source="input", parents={"": "ab"}, values={"branch:to:b": "1"})]
    g = graph(spark, ("b", ["branch:to:b"]), ("tools", ["branch:to:tools"]), ("c", ["x", "branch:to:c"]), ("w", []), ("__start__", ["__start__"]))
    ts = read(spark, rows, graph=g)
    got = {r.step_id: r for r in ts.steps.where("source = 'scheduled'").collect()}
    want = {f"ab#scheduled:{pull('ab', 4, '', 1, 'b', 'branch:to:b')}": "b", f"ab#scheduled:{push('ab', 4, '', 1, 'w', 0)}": "w", f"ab#scheduled:{push('ab', 4, '', 1, 'w', 2)}": "w"}
    assert {k: r.name for k, r in got.items()} == want  # versions compare as numbers: 10 is newer than 9
    assert {(r.status, r.kind, r.seq) for r in got.values()} == {("unset", "CHAIN", 2)}
    assert gaps(ts) == {("t", "langgraph.unapplied_command_goto"): 2, ("t", "langgraph.unknown_send_target"): 1}
    assert {(r.src, r.dst, r.origin) for r in ts.edges.collect() if "#" in r.src} == {(k, "ab", "checkpoint_parent") for k in want}
    again = graph(spark, ("w", []), ("c", ["branch:to:c", "x"]), ("__start__", ["__start__"]), ("tools", ["branch:to:tools"]), ("b", ["branch:to:b", "branch:to:b"]))
    assert g.fingerprint().first() == again.fingerprint().first() and ts.traces.first().schedule_graph.fingerprint == again.fingerprint().first()[0]
    assert graph(spark, ("b", ["x"])).fingerprint().first() != g.fingerprint().first()


def test_given_tasks(spark):
    rows = [row("aa", step=0, source="input"), row("ab", "aa", step=1, writes=[("k1", "__error__", "E()"), ("k2", "done", "1"), (None, "x", "1")])]
    ts = read(spark, rows, graph=graph(spark, ("n", ["c"]), given=[("t", "ab", k, f"call_tool_{k}") for k in ("k1", "k2", "k3")] + [("other thread", "zz", "k", "n")]))
    assert [(r.step_id, r.name, r.kind) for r in ts.steps.where("source = 'scheduled'").collect()] == [("ab#scheduled:k3", "call_tool_k3", "TOOL")]
    with pytest.raises(Exception, match="isn't the newest"):
        read(spark, rows, graph=graph(spark, ("n", ["c"]), given=[("t", "aa", "k", "n")])).steps.collect()
    none = read(spark, rows)
    assert none.traces.first().schedule_graph is None and none.steps.where("source = 'scheduled'").count() == 0


def test_old_checkpoints_keep_packets_apart(spark):
    table = spark.createDataFrame([("t", "s", {"__pregel_tasks": "not json"}, ['{"node": "a"}', None, "{"]), ("t", "r", {"__pregel_tasks": '{"node": "a"}'}, None)], "thread_id string, sid string, channel_values map<string,string>, pending_sends array<string>")
    assert sorted((r.sid, r.idx, r.node, r.channel) for r in tasks.packets(table).collect() if r.node) == [("s", 0, "a", "pending_sends")]


def test_histories_never_go_whole_through_the_driver(spark, small):
    """Whatever the size of their files, staged tables are joined by sorting; only a graph's own nodes are sent."""
    from causeway.queries import QUERIES

    for name in ("a03_checkpoint_counts", "c17_scheduled_gaps"):
        plan = QUERIES[name](spark, small)._jdf.queryExecution().sparkPlan().toString()
        sent = [line.split("BroadcastHashJoin ")[1] for line in plan.splitlines() if "BroadcastHashJoin " in line]
        assert "SortMergeJoin" in plan and all(line.startswith(("[node#", "[channel#")) for line in sent), (name, sent)


def test_staged_parts_of_histories_never_go_whole_through_the_driver(spark, small, monkeypatch):
    """The plans that an ingest runs on its way, not only its last one: joins with unions and aggregates are by sorting, too."""
    from causeway.queries import QUERIES
    from causeway.sources import checkpoints

    plans, real = [], checkpoints.staged
    monkeypatch.setattr(checkpoints, "staged", lambda df: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or real(df))
    for name in ("s11_checkpoint_edges", "c17_scheduled_steps"):
        plans.append(QUERIES[name](spark, small)._jdf.queryExecution().sparkPlan().toString())
    sent = [line.split("BroadcastHashJoin ")[1] for plan in plans for line in plan.splitlines() if "BroadcastHashJoin " in line]
    assert len(plans) > 8 and all(line.startswith(("[node#", "[channel#")) for line in sent), sent
