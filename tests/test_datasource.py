"""The data source of portable trace files, and merged summaries."""

import json
import re

from pyspark.sql import functions as F

from causeway.operators import motifs
from causeway.plans.patterns import PRESETS
from causeway.schema import TraceSet
from causeway.sources import artifacts, datasource
from tests.test_traces import build


def test_trace_files_as_a_format(spark, tmp_path):
    ts = build(spark, [(t, s, k, s, "TOOL", "ok") for t in ("x", "y", "z") for k, s in enumerate("ab")], [(t, "b", "a") for t in ("x", "y", "z")])
    for r in artifacts.to_text(ts).collect():
        (tmp_path / f"{r.trace_id}.json").write_text(r.value)
    broken = json.loads((tmp_path / "z.json").read_text())
    broken["trace"]["steps"] = "not read where the trace isn't wanted"
    (tmp_path / "z.json").write_text(json.dumps(broken))
    datasource.register(spark)
    read = lambda table: spark.read.format("causeway").option("table", table).load(str(tmp_path))
    steps = read("steps").where(F.col("trace_id").isin("x", "y"))
    assert sorted((r.trace_id, r.step_id, r.seq, r.kind) for r in steps.collect()) == [(t, s, k, "TOOL") for t in "xy" for k, s in enumerate("ab")]
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    # the pushed filter is the reader's alone; another one stays in the plan
    assert not re.search(r"\bFilter ", plan(steps)) and re.search(r"\bFilter ", plan(read("steps").where("seq = 0")))
    assert read("edges").rdd.getNumPartitions() == 3 and read("edges").where("trace_id = 'x'").select("src", "dst", "origin").collect() == [("b", "a", "graph_parent")]
    assert sorted(r.trace_id for r in datasource.discover(spark, str(tmp_path)).collect()) == ["x", "y", "z"]
    whole = artifacts.from_text(spark.createDataFrame([((tmp_path / "x.json").read_text(),)], "value string"))
    assert read("traces").where("trace_id = 'x'").collect() == whole.traces.collect()


def test_summaries_merge(spark):
    """Summaries of any parts of the traces merge to the summary of all."""
    p = PRESETS["gate-failure-after-success"]
    ts = build(spark, [x for t in range(9) for x in ((f"t{t}", "a", 0, "a", "AGENT", "ok"), (f"t{t}", "b", 1, f"gate:g{t % 2}", "TOOL", "error"), (f"t{t}", "c", 2, "gate:g0", "TOOL", "error"))], [x for t in range(9) for x in ((f"t{t}", "b", "a"), (f"t{t}", "c", "a"))], capture=None)
    part = lambda *ids: motifs.partial(TraceSet(*(df.where(F.col("trace_id").isin(*ids)) for df in (ts.traces, ts.steps, ts.edges))), p)
    parts = [part("t0", "t5"), part("t1", "t2", "t8"), part("t3", "t4", "t6", "t7")]
    want = sorted(map(tuple, motifs.groups(ts, p).collect()))
    assert sorted(map(tuple, motifs.finish(motifs.merge(*parts)).collect())) == want
    assert sorted(map(tuple, motifs.finish(motifs.merge(parts[2], motifs.merge(parts[1], parts[0]))).collect())) == want and want
