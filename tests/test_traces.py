"""Traces built by hand: projection, walks, patterns and trees against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from causeway import schema
from causeway.operators import analysis, check, failures, metrics, motifs, trees
from causeway.plans import patterns, projection, walk
from causeway.schema import TraceSet

S = patterns.StepPredicate


def build(spark, specs, arcs, **header):
    """specs: (trace, id, seq, name, kind, status[, message]); arcs: (trace, effect, cause[, origin])."""
    steps = [dict(trace_id=t, step_id=i, seq=q, name=n, kind=k, status=s, error_msg=m[0] if m else None, source="loop", unknown_fields=[]) for t, i, q, n, k, s, *m in specs]
    edges = [dict(trace_id=t, type="CAUSED_BY", src=a, dst=b, origin=o[0] if o else "graph_parent") for t, a, b, *o in arcs]
    traces = [dict(trace_id=t, source_kind="test", causal_fidelity="declared_dag", status="error" if any(x["trace_id"] == t and x["status"] == "error" for x in steps) else "ok", **header) for t in sorted({x[0] for x in specs})]
    make = lambda rows, ddl: spark.createDataFrame([tuple(r.get(f.name) for f in schema.struct(ddl)) for r in rows], schema.struct(ddl))
    return TraceSet(make(traces, schema.TRACES), make(steps, schema.STEPS), make(edges, schema.EDGES))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_fan_in_is_lossy(spark):
    ts = build(spark, [("t", c, i, c, "CHAIN", "ok") for i, c in enumerate("abcd")], [("t", "b", "a"), ("t", "c", "a"), ("t", "d", "b", "span_link"), ("t", "d", "c", "span_parent_fallback")])
    got, tree = projection.normalize(ts)
    assert rows(tree.select("step_id", "parent")) == [("b", "a"), ("c", "a"), ("d", "c")]
    assert rows(got.steps.where("projection_lossy").select("step_id")) == [("d",)]
    assert rows(projection.primary_parents(ts, False).where("step_id = 'd'").select("parent")) == [("b",)]
    assert rows(projection.needs_origin_priority(ts)) == [("t", 1)]
    assert projection.violations(ts).isEmpty()


def test_violations(spark):
    ts = build(spark, [("t", "a", 0, "a", "CHAIN", "ok"), ("t", "b", 0, "b", "CHAIN", "ok"), ("t", "b", 1, "b", "CHAIN", "ok")], [("t", "a", "b"), ("t", "a", "a"), ("t", "a", "x"), ("t", "a", "x")])
    found = {r.rule for r in projection.violations(ts).collect()}
    assert found == {"duplicate step", "unknown endpoint", "self edge", "duplicate edge", "cause not before effect"}


def test_violations_are_told_from_tables_made_once(spark, small):
    """The view isn't made again for each rule, and joins read what was dealt into all partitions: coalesced by bytes, a task's memory grew with the input."""
    from causeway.sources import views

    plan = projection.violations(views.events(spark, small))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("REPARTITION_BY_NUM") >= 5


def test_violations_keep_each_row(spark):
    """Rules that share a join give the rows that each gave alone: repeated steps multiply what their edges break, a step may break two rules."""
    ts = build(spark, [("t", "a", 0, "a", "CHAIN", "ok"), ("t", "b", 0, "b", "CHAIN", "error"), ("t", "b", 1, "b", "CHAIN", "ok"), ("u", "c", 0, "c", "CHAIN", "ok")], [("t", "a", "b"), ("t", "a", "x"), ("u", "c", "c")])
    steps = ts.steps.withColumn("unknown_fields", F.when(F.col("step_id") == "c", F.array(F.lit("kind"))).otherwise(F.col("unknown_fields")))
    traces = ts.traces.where("trace_id = 'u'").withColumn("capture", F.lit(None).cast(ts.traces.schema["capture"].dataType))
    tree = ts.edges.where("dst = 'x'").withColumn("type", F.lit("TREE_PARENT"))
    got = rows(projection.violations(TraceSet(traces.union(traces), steps, ts.edges.union(tree).union(tree))))
    assert got == sorted([
        ("t", "cause not before effect", "a->b"), ("t", "cause not before effect", "a->b"), ("t", "duplicate step", "b"), ("t", "several tree parents", "a"), ("t", "step without trace", "a"), ("t", "step without trace", "b"),
        ("t", "step without trace", "b"), ("t", "unknown endpoint", "a->x"), ("t", "unknown tree parent", "a->x"), ("t", "unknown tree parent", "a->x"), ("u", "duplicate trace", "u"), ("u", "self edge", "c->c"), ("u", "unknown fields without capture", "c"),
    ])


def random_dag(rng, trace, n):
    kinds, names = ["AGENT", "TOOL", "CHAIN"], ["a", "b", "", None]
    specs = [(trace, f"s{i}", i, rng.choice(names), rng.choice(kinds), rng.choice(["ok", "error", "unset"]), rng.choice(["timeout", "x"])) for i in range(n)]
    arcs = {(trace, f"s{i}", f"s{j}") for i in range(1, n) for j in rng.sample(range(i), min(i, rng.randrange(0, 3)))}
    return specs, sorted(arcs)


def brute(specs, arcs, pattern):
    """All matches by following every path."""
    step, children = {s[1]: s for s in specs}, {}
    for _, e, c in arcs:
        children.setdefault(c, []).append(e)

    def fits(p, s):
        _, _, _, name, kind, status, message = s
        return (p.name is None or name == p.name) and (not p.name_prefix or (name or "").startswith(p.name_prefix)) and (not p.error_contains or p.error_contains in message) and (not p.kind or kind == p.kind) and (not p.status or status == p.status)

    def reach(sid, lo, hi):
        out, level = set(), {sid}
        for d in range(1, (hi or len(specs)) + 1):
            level = {c for x in level for c in children.get(x, [])}
            if d >= lo:
                out |= level
        return out

    paths = [(sid,) for sid in step if fits(pattern.steps[0], step[sid])]
    for i, p in enumerate(pattern.steps[1:], 1):
        nxt = []
        for path in paths:
            for c in reach(path[-1], *(p.gap or (1, 1))):
                same = p.same_name_as is None or (step[path[p.same_name_as]][3] is not None and step[path[p.same_name_as]][3] == step[c][3])
                if fits(p, step[c]) and same:
                    nxt.append((*path, c))
        paths = nxt
    return sorted(set(paths))


def test_patterns_against_brute_force(spark):
    rng = random.Random(7)
    dags = [random_dag(rng, f"t{k}", 12) for k in range(25)]
    ts = build(spark, [s for d in dags for s in d[0]], [a for d in dags for a in d[1]]).staged()
    ad_hoc = [patterns.PathPattern((S(), S(gap=(2, 3)))), patterns.PathPattern((S(kind="TOOL"), S(), S(same_name_as=0, gap=(1, None)))), patterns.PathPattern((S(name="a"), S(gap=(3, None), same_name_as=0), S(status="error")))]
    for p in [*patterns.PRESETS.values(), *ad_hoc]:
        cols = [f"s{i}" for i in range(len(p.steps))]
        got = sorted((r.trace_id, *[r[c] for c in cols]) for r in patterns.matches(ts, p).collect())
        assert got == sorted((f"t{k}", *m) for k, d in enumerate(dags) for m in brute(*d, p)), str(p)


def test_pattern_construction():
    for bad in (dict(gap=(0, 1)), dict(gap=(3, 2)), dict(name="a", name_prefix="b"), dict(name_prefix=""), dict(same_name_as=-1), dict(kind="ROBOT")):
        with pytest.raises(ValueError):
            S(**bad)
    with pytest.raises(ValueError):
        patterns.PathPattern((S(), S(same_name_as=1)))
    with pytest.raises(ValueError):
        patterns.PathPattern((S(),), pattern_id="x")
    assert str(patterns.PathPattern((S(kind="TOOL"), S(gap=(2, None), same_name_as=0)))) == "{kind=TOOL} →[gap 2..]→ {name=#0}"


def test_walks_and_failures(spark):
    # a -> b(error) -> c(error); c also contained in d; e fails through containment only
    ts = build(spark, [("t", "a", 0, "a", "AGENT", "ok"), ("t", "b", 1, "b", "TOOL", "error"), ("t", "d", 1, "d", "CHAIN", "ok"), ("t", "c", 2, "c", "TOOL", "error"), ("t", "e", 3, "e", "TOOL", "error")],
               [("t", "b", "a"), ("t", "c", "b"), ("t", "c", "d", "span_parent_fallback"), ("t", "e", "b", "span_parent_fallback")])
    split = {r.step_id: (r.primary, r["rank"], r.depth) for r in failures.split(ts).collect()}
    assert split == {"b": (True, 2, 1), "c": (False, 1, 2), "e": (True, 1, 2)}
    order = [r.ancestor for r in walk.ancestors(ts, F.col("step_id") == "c").orderBy("position").collect()]
    assert order == ["b", "d", "a"]
    assert rows(failures.causal_edges(ts).where("failure = 'e'").select("effect", "cause")) == [("b", "a"), ("e", "b")]
    assert rows(failures.find_step(ts, "c")) == [("t", "c")]


def test_trees(spark):
    def run(t, flip, extra):
        specs = [(t, "r", 0, "r", "AGENT", "ok"), (t, "x", 2 - flip, "x", "TOOL", "ok"), (t, "y", 1 + flip, "y", "TOOL", "ok"), (t, "z", 3, "z" if not extra else "q", "TOOL", "ok")]
        return specs, [(t, "x", "r"), (t, "y", "r"), (t, "z", "y")]

    parts = [run("t1", 0, False), run("t2", 1, False), run("t3", 0, True)]
    ts = build(spark, [s for p in parts for s in p[0]], [a for p in parts for a in p[1]])
    shape = {r.trace_id: r.shape for r in trees.shapes(ts).collect()}
    assert shape["t1"] == shape["t2"] != shape["t3"]
    assert len(set(r.shape for r in trees.shapes(ts, shape_only=True).collect())) == 1
    pairs = spark.createDataFrame([("t2", "t1"), ("t3", "t1")], "current string, baseline string")
    assert rows(trees.differences(ts, pairs).select("current", "change")) == [("t3", "only in A under r > y: subtree z"), ("t3", "only in B under r > y: subtree q")]
    changed = rows(trees.behaviour_changes(ts, pairs).select("current", "name", "before", "after"))
    assert changed == [("t3", "q", None, "ok"), ("t3", "z", "ok", None)] or sorted(changed, key=str) == sorted([("t3", "q", None, "ok"), ("t3", "z", "ok", None)], key=str)


def test_forms_need_no_joins(spark):
    """Forms come from one shuffle of steps and causes; a comparison of forms makes each trace's row once. Of several causes the earliest by origin, then seq, is the parent."""
    ts = build(spark, [("t", "r", 0, "r", "AGENT", "ok"), ("t", "a", 1, "a", "TOOL", "ok"), ("t", "b", 2, "b", "TOOL", "ok"), ("u", "r", 0, "r", "AGENT", "ok")], [("t", "a", "r"), ("t", "b", "a"), ("t", "b", "r"), ("t", "b", "gone")])
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan(trees.shapes(ts)) and "Join" not in plan(trees.canonical(ts))
    got = {(r.trace_id, r.step_id): (r.parent, r.size, r.place, r.level) for r in trees.canonical(ts).collect()}
    assert got == {("t", "r"): (None, 3, 0, 0), ("t", "a"): ("r", 1, 1, 1), ("t", "b"): ("r", 1, 2, 1), ("u", "r"): (None, 1, 0, 0)}
    assert trees.shapes(ts).count() == 2
    pairs = spark.createDataFrame([("u", "t")], "current string, baseline string")
    assert plan(check.topology_unchanged(ts, pairs)).count("MapInArrow") == 0 and check.topology_unchanged(ts, pairs).first().outcome == check.OPEN


def test_checks(spark):
    fine = dict(capture=([],))
    base = [("b", "a", 0, "a", "AGENT", "ok"), ("b", "x", 1, "t", "TOOL", "ok")]
    worse = [("c", "a", 0, "a", "AGENT", "ok"), ("c", "x", 1, "t", "TOOL", "error")]
    vague = [("v", "a", 0, "a", "AGENT", "ok"), ("v", "x", 1, "t", "TOOL", "unset")]
    ts = build(spark, base + worse + vague, [("b", "x", "a"), ("c", "x", "a"), ("v", "x", "a")], **fine)
    pairs = spark.createDataFrame([("c", "b"), ("b", "c"), ("v", "b"), ("c", "v")], "current string, baseline string")
    got = {(r.current, r.baseline): r.outcome for r in check.failures_not_increased(ts, pairs).collect()}
    assert got == {("c", "b"): "FAIL", ("b", "c"): "PASS", ("v", "b"): "INSUFFICIENT_EVIDENCE", ("c", "v"): "INSUFFICIENT_EVIDENCE"}
    tool = {(r.current, r.baseline): r.outcome for r in check.pattern_not_increased(ts, pairs, patterns.PRESETS["tool-failure"]).collect()}
    assert tool == got
    assert {r.outcome for r in check.topology_unchanged(ts, pairs).collect()} == {"PASS"}
    assert {r.verdict for r in check.verdict(check.failures_not_increased(ts, pairs)).where("current = 'c' AND baseline = 'b'").collect()} == {"FAIL"}
    blind = build(spark, base + worse, [], capture=None)
    assert {r.outcome for r in check.failures_not_increased(blind, pairs.limit(1)).collect()} == {"INSUFFICIENT_EVIDENCE"}
    hidden = build(spark, base + worse, [], capture=([("otlp.some_new_code", 1)],))
    assert {r.outcome for r in check.failures_not_increased(hidden, pairs.limit(1)).collect()} == {"INSUFFICIENT_EVIDENCE"}
    with pytest.raises(ValueError):
        check.parse_rules(["no-such-rule"])


def test_metrics_withheld(spark):
    ts = build(spark, [("t", "a", 0, "a", "LLM", "ok"), ("t", "b", 1, "b", "LLM", "ok")], [("t", "b", "a")])
    ev = lambda end, cost, cur: F.struct(*[(F.lit(end) if f.name == "end_ts" else F.lit(cost) if f.name == "total_cost" else F.lit(cur) if f.name == "cost_currency" else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.struct("e " + schema.EVIDENCE)["e"].dataType])
    at = lambda end, c1, c2, cur2="USD": TraceSet(ts.traces, ts.steps.withColumn("ts", F.lit("2024-01-01T00:00:10+00:00")).withColumn("evidence", F.when(F.col("step_id") == "a", ev(end, c1, "USD")).otherwise(ev(end, c2, cur2))), ts.edges)
    one = lambda t: metrics.summary(t).first()
    r = one(at("2024-01-01T00:00:12Z", "0.10", "0.250"))
    assert (r.wall_duration_ms, r.total_cost, r.cost_currency, r.wall_complete, r.cost_complete) == (2000.0, "0.350", "USD", True, True)
    r = one(at("2024-01-01T00:00:09Z", "0.10", "unreadable"))
    assert (r.wall_duration_ms, r.total_cost, r.reversed) == (None, None, 2)
    assert one(at("2024-01-01T00:00:12Z", "1", "1", "EUR")).total_cost is None


def test_review_and_memo(spark):
    ts = build(spark, [("t", "a", 0, "srv::tool", "TOOL", "error")], [], run_id="r1")
    got = motifs.review_candidates(ts, patterns.PRESETS["tool-failure"]).collect()
    assert [(r.run_id, r.tool_key) for r in got] == [("r1", "srv::tool")] and got[0].digest.startswith("sha256:")
    with pytest.raises(ValueError):
        motifs.review_candidates(ts, patterns.PRESETS["gate-failure-after-success"])
    with pytest.raises(Exception, match="server-qualified"):
        motifs.review_candidates(build(spark, [("t", "a", 0, "tool", "TOOL", "error")], [], run_id="r1"), patterns.PRESETS["tool-failure"]).collect()
    assert "step_1_tool" in motifs.memo(ts).first().memo


def tree_differences(a, b):
    """Where two forests differ, from the definition: a forest is a list of (label, children)."""
    from collections import Counter

    form = lambda n: (n[0], tuple(sorted(map(form, n[1]))))
    text = lambda n: n[0] + ("(" + ", ".join(map(text, n[1])) + ")" if n[1] else "")

    def level(xs, ys, path):
        same = Counter(map(form, xs)) & Counter(map(form, ys))
        left, spare = [], Counter(same)
        for x in xs:
            if spare[form(x)]:
                spare[form(x)] -= 1
            else:
                left.append(x)
        first = {}
        for i, y in enumerate(ys):
            first.setdefault(form(y), i)
        right, spare = [], Counter(same)
        for i, y in reversed(list(enumerate(ys))):
            if spare[form(y)]:
                spare[form(y)] -= 1
            else:
                right.insert(0, (first[form(y)], i, y))
        right = [y for _, _, y in sorted(right, key=lambda r: r[:2])]
        for key in (lambda n: tuple(sorted(map(form, n[1]))) or None, lambda n: n[0] or None):
            for x in list(left):
                partner = next((y for y in reversed(right) if key(x) is not None and key(y) == key(x)), None)
                if partner is not None:
                    left, right = [z for z in left if z is not x], [z for z in right if z is not partner]
                    if x[0] != partner[0]:
                        yield f"diverges at {' > '.join(path) or '(root)'}: A='{x[0]}' B='{partner[0]}'"
                    else:
                        yield from level(x[1], partner[1], [*path, x[0]])
        where, what = (f" under {' > '.join(path)}", "subtree") if path else ("", "root subtree")
        yield from (f"only in A{where}: {what} {text(x)}" for x in left)
        yield from (f"only in B{where}: {what} {text(y)}" for y in right)

    return sorted(level(a, b, []))


def test_differences_equal_brute_force(spark):
    import random

    rng, rows, edges, forests = random.Random(3), [], [], {}

    def grow(trace, depth, parent=None):
        out = []
        for _ in range(rng.randrange(1, 4) if depth else 0):
            n = sum(r[0] == trace for r in rows)
            rows.append((trace, f"s{n}", n, rng.choice("ab"), "CHAIN", "ok"))
            if parent:
                edges.append((trace, f"s{n}", parent))
            out.append((rows[-1][3], grow(trace, depth - 1, f"s{n}")))
        return out

    for k in range(24):
        forests[f"t{k}"] = grow(f"t{k}", 3)
    ts = build(spark, rows, edges)
    pairs = spark.createDataFrame([(f"t{k + 1}", f"t{k}") for k in range(23)], "current string, baseline string")
    got = {}
    for r in trees.differences(ts, pairs).collect():
        got.setdefault(r.current, []).append(r.change)
    want = {f"t{k + 1}": tree_differences(forests[f"t{k}"], forests[f"t{k + 1}"]) for k in range(23)}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_walks_equal_brute_force(spark):
    """Gap pairs, and their first ones with the total, against paths taken hop by hop."""
    import random

    rng = random.Random(8)
    rows = [(f"t{t}", f"s{k:02d}", k, rng.choice(["x", "y", None]), "TOOL", rng.choice(["ok", "error"])) for t in range(4) for k in range(40)]
    edges = [(f"t{t}", f"s{k:02d}", f"s{j:02d}") for t in range(4) for k in range(1, 40) for j in {rng.randrange(k), max(0, k - 1)} if rng.random() < (0.4, 0.7, 1, 0.9)[t]]
    ts = build(spark, rows, edges)
    ok, failed = F.col("status") == "ok", F.col("status") == "error"
    effects = {}
    for t, src, dst in edges:
        effects.setdefault((t, dst), set()).add(src)
    at = {(t, s): (name, status) for t, s, _, name, _, status in rows}

    def brute(lo, hi, same):
        for t, a in at:
            front, seen = {a}, set()
            for length in range(1, 41 if hi is None else hi + 1):
                front = {e for i in front for e in effects.get((t, i), ())}
                seen |= front if length >= lo else set()
            yield from ((t, a, e) for e in seen if at[t, a][1] == "ok" and at[t, e][1] == "error" and (not same or at[t, a][0] is not None and at[t, a][0] == at[t, e][0]))

    for lo, hi, same in ((1, None, False), (2, None, True), (3, None, False), (1, 3, False), (2, 30, True)):
        want = sorted(brute(lo, hi, same))
        assert sorted(map(tuple, walk.gap_pairs(ts, ok, failed, lo, hi, same).collect())) == want and want
        first = sorted(map(tuple, walk.first_pairs(ts, ok, failed, lo, hi, same, 3).collect()))
        by = {t: [w for w in want if w[0] == t] for t in {w[0] for w in want}}
        assert first == [(*w, len(by[t])) for t in sorted(by) for w in by[t][:3]]


def test_first_matches(spark):
    from causeway.plans.patterns import PRESETS, PathPattern, StepPredicate, first_matches, matches, order_columns

    ts = build(spark, [(t, f"s{k}", k, "a", "AGENT", "error") for t in ("x", "y") for k in range(30)], [(t, f"s{k}", f"s{k - 1}") for t in ("x", "y") for k in range(1, 30)])
    three = PathPattern((StepPredicate(kind="AGENT"), StepPredicate(kind="AGENT", gap=(2, 4)), StepPredicate(status="error", same_name_as=0)))
    for pattern in (PRESETS["repeated-agent-failure"], PRESETS["error"], three, PathPattern((StepPredicate(name="none"), StepPredicate(gap=(1, None)))), PathPattern(())):
        every = matches(ts, pattern)
        want = [tuple(r) for r in every.orderBy("trace_id", *order_columns(pattern)).limit(40).collect()]
        got = first_matches(ts, pattern, 40).collect()
        assert [tuple(r)[:-1] for r in got] == want and {r.total for r in got} <= {every.count()}
        assert first_matches(ts, pattern, 0).count() == 0


def _seconds(fn) -> float:
    import time

    took = []
    for _ in range(3):
        began = time.process_time()
        fn()
        took.append(time.process_time() - began)
    return min(took)


def test_gap_walks_grow_in_proportion():
    """One trace twice as long takes at most three times as long: chains whose names never, always or in pairs repeat, a wide fan, and near-trees."""

    def graph(n, causes, name):
        g = walk.Graph("t")
        for i in range(n):
            g.step(f"s{i}", i, name(i), 3)
        for i in range(1, n):
            for c in causes(i):
                g.edge(f"s{i}", f"s{c}", True)
        g.close()
        return g

    chain, fan, braid = lambda i: [i - 1], lambda i: [0], lambda i: {max(0, i - 1), max(0, i - 4)}
    count = lambda g, lo, hi, same: sum(n for _, n, _ in walk._pairs(g, lo, hi, same))
    for causes, name, lo, hi, same in ((chain, lambda i: f"n{i}", 1, None, True), (chain, lambda i: None, 1, None, True), (chain, lambda i: f"n{i // 2}", 1, None, True), (chain, lambda i: "n", 2, None, True), (fan, lambda i: "n", 1, None, False), (braid, lambda i: "n", 2, None, True), (chain, lambda i: f"n{i % 40}", 2, 30, True)):
        took = [_seconds(lambda g=graph(n, causes, name): count(g, lo, hi, same)) for n in (4000, 8000, 16000)]
        assert all(b <= 3 * a + 0.05 for a, b in zip(took, took[1:])), took


def test_first_of_millions_of_matches(spark):
    """A chain of 2,500 failing agents of one name has 3.1 million matches; the first is found and the others counted without being made."""
    from causeway.plans.patterns import PRESETS, first_matches

    ids = spark.range(2500).withColumn("trace_id", F.lit("t"))
    ts = build(spark, [("t", "s", 0, "a", "AGENT", "error")], [])
    steps = ids.select("trace_id", F.concat(F.lit("s"), "id").alias("step_id"), F.col("id").alias("seq"), F.lit("AGENT").alias("kind"), F.lit("a").alias("name"), F.lit("error").alias("status"))
    edges = ids.where("id > 0").select("trace_id", F.lit("CAUSED_BY").alias("type"), F.concat(F.lit("s"), "id").alias("src"), F.concat(F.lit("s"), F.col("id") - 1).alias("dst"), F.lit("graph_parent").alias("origin"))
    whole = lambda df, like: df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(like.schema[c].dataType).alias(c) for c in like.columns])
    ts = TraceSet(ts.traces, whole(steps, ts.steps), whole(edges, ts.edges))
    pairs = walk.first_pairs(ts, F.lit(True), F.lit(True), 1, None, True, 1)
    assert pairs.collect()[0].total == 2500 * 2499 // 2 and pairs.count() == 1
    got = first_matches(ts, PRESETS["repeated-agent-failure"], 1).collect()
    assert [(r.s0, r.s1, r.total) for r in got] == [("s0", "s1", 3123750)]


def test_analysis_and_reasons(spark):
    ts = build(spark, [("a", "p", 0, "plan", "CHAIN", "ok"), ("a", "q", 1, "tool", "TOOL", "error"), ("a", "r", 2, "odd name!", "TOOL", "error"), ("b", "p", 0, "plan", "CHAIN", "ok")], [("a", "q", "p"), ("a", "r", "q")])
    got = {r.trace_id: r for r in analysis.analyze(ts).collect()}
    a, b = got["a"], got["b"]
    assert [f.step_id for f in a.primary_failures] == ["q"] and a.primary_failures[0].causal_steps == ["p"] and [f.step_id for f in a.propagated_failures] == ["r"]
    assert a.propagated_failures[0].name.startswith("redacted:") and "incident" in a.notes and "incident" not in b.notes and b.patterns == [] and set(a.notes) | set(b.notes) <= set(analysis.NOTES)
    assert [(p.pattern_id, p.path) for p in a.patterns] == [("plan-then-tool-failure", "p>q"), ("tool-failure", "q"), ("tool-failure", "r"), ("error", "q"), ("error", "r")]
    pairs = spark.createDataFrame([("a", "b")], "current string, baseline string")
    c = analysis.compare(ts, pairs).first()
    assert trees.differences(ts, pairs.where("false")).collect() == []
    assert not c.topology_identical and {d.pattern_id: d.delta for d in c.pattern_count_deltas}["error"] == 2 and c.baseline_digest == b.digest
    report = analysis.as_json(analysis.check_report(ts, pairs, ["failures-not-increased", "topology-unchanged"]), "current", "baseline").first().report
    assert '"verdict"' in report and '"reasons"' in report
    blind = TraceSet(ts.traces.withColumn("capture", F.lit(None).cast(ts.traces.schema["capture"].dataType)), ts.steps, ts.edges)
    assert check.failures_not_increased(blind, pairs).first().reasons == ["current:no_capture_record", "baseline:no_capture_record"]


def test_an_analysis_walks_failures_once(spark, small, monkeypatch):
    """Depths and what lies behind failures come from one walk, gap pairs from another; staged tables aren't staged again; no documents are made for digests that nobody reads."""
    from causeway.sources import views

    walks, again, inner = [], [], walk.over_graphs
    monkeypatch.setattr(walk, "over_graphs", lambda *a, **k: walks.append(1) or inner(*a, **k))
    monkeypatch.setattr(patterns, "staged", lambda df: again.append(1) or df)
    got = analysis.analyze(views.events(spark, small).staged(), digests=False)
    assert len(walks) == 2 and not again and "digest" not in got.columns


def test_explained_failures(spark):
    """The one walk gives what the split and the walk of ancestors give."""
    rng, specs, arcs = random.Random(5), [], []
    for t in range(8):
        s, a = random_dag(rng, f"t{t}", 25)
        specs, arcs = specs + s, arcs + [(*x, rng.choice(["graph_parent", "span_link", "span_parent_fallback"])) for x in a]
    ts, want = build(spark, specs, arcs), {}
    for r in failures.causal_steps(ts).collect():
        want.setdefault((r.trace_id, r.failure), []).append((r.level, r.step_id))
    got = failures.explained(ts).collect()
    assert sorted(tuple(r)[:-1] for r in got) == rows(failures.split(ts))
    assert {(r.trace_id, r.step_id): r.causal for r in got if r.causal is not None} == {k: [i for _, i in sorted(v)] for k, v in want.items()} and want


def test_differences_stage_little(spark, monkeypatch):
    """Outlines, pairs, two tables a round and paths are staged; digests among them have 16 bytes."""
    kept, inner = [], trees.staged
    monkeypatch.setattr(trees, "staged", lambda df: kept.append(df) or inner(df))
    ts = build(spark, [("a", "r", 0, "x", "AGENT", "ok"), ("b", "r", 0, "y", "AGENT", "ok")], [])
    got = trees.differences(ts, spark.createDataFrame([("b", "a")], "current string, baseline string")).collect()
    assert [r.change for r in got] == ["only in A: root subtree x", "only in B: root subtree y"]
    assert len(kept) == 5 and dict(kept[0].dtypes)["below"] == "binary"


def test_deep_differences_take_few_rounds(spark, monkeypatch):
    """A chain of 4,000 steps with a side step at each that differs at its end, and one whose smaller branch differs, take rounds by the logarithm of the steps."""
    rounds = []
    inner = trees._descended
    monkeypatch.setattr(trees, "_descended", lambda *a: rounds.append(1) or inner(*a))
    n = 2000

    def run(t, end, side):
        rows = [(t, f"s{k:05d}", 2 * k, f"n{k % 7}", "CHAIN", "ok") for k in range(n)] + [(t, f"x{k:05d}", 2 * k + 1, "tool", "TOOL", "ok") for k in range(n)]
        rows += [(t, "end", 2 * n, end, "TOOL", "ok"), (t, "u0", 2 * n + 1, "small", "TOOL", "ok"), (t, "u1", 2 * n + 2, side, "TOOL", "ok")]
        edges = [(t, f"s{k:05d}", f"s{k - 1:05d}") for k in range(1, n)] + [(t, f"x{k:05d}", f"s{k:05d}") for k in range(n)]
        return rows, [*edges, (t, "end", f"s{n - 1:05d}"), (t, "u0", f"s{n // 2:05d}"), (t, "u1", "u0")]

    runs = [run("a", "same", "left"), run("b", "other", "left"), run("c", "same", "right"), run("d", "same", "left")]
    ts = build(spark, [r for rows, _ in runs for r in rows], [e for _, edges in runs for e in edges])
    got = {}
    for r in trees.differences(ts, spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "a")], "current string, baseline string")).collect():
        got.setdefault(r.current, []).append(r.change)
    way = " > ".join(f"n{k % 7}" for k in range(n))
    assert got["b"] == [f"only in A under {way}: subtree same", f"only in B under {way}: subtree other"]
    half = " > ".join([*(f"n{k % 7}" for k in range(n // 2 + 1)), "small"])
    assert got["c"] == [f"only in A under {half}: subtree left", f"only in B under {half}: subtree right"] and "d" not in got
    assert len(rounds) <= 6


def test_tables_at_rest_are_staged_once(spark, monkeypatch):
    """A memo stages its tables and its split once; tables that are staged aren't written again."""
    from causeway import session

    written, inner = [], session.stored
    monkeypatch.setattr(session, "stored", lambda df: written.append(df) or inner(df))
    splits, split = [], failures.split
    monkeypatch.setattr(failures, "split", lambda ts: splits.append(1) or split(ts))
    ts = build(spark, [("t", "a", 0, "x", "TOOL", "error"), ("t", "b", 1, "y", "TOOL", "error")], [("t", "b", "a")]).staged()
    assert ts.staged() is ts and len(written) == 3
    assert [r.text for r in motifs.memo_lines(ts).where("section <> 'run'").orderBy("section").collect()] == ["step_1_tool: x", "step_2_tool: y"]
    assert len(splits) == 1
