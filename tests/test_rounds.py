"""Rounds give the rows of the walks."""

import random

from pyspark.sql import functions as F

from causeway.plans import rounds, walk
from tests.test_traces import build


def test_rounds_equal_walks(spark):
    rng = random.Random(6)
    specs, arcs = [], []
    for t, n in (("small", 5), ("wide", 60), ("deep", 12)):
        specs += [(t, f"s{i:02d}", i, "a", "TOOL", rng.choice(["ok", "ok", "error"])) for i in range(n)]
        for i in range(1, n):
            behind = {i - 1} if t == "deep" else {rng.randrange(max(1, min(i, 8))) for _ in range(rng.randrange(3))}
            arcs += [(t, f"s{i:02d}", f"s{j:02d}", rng.choice(["graph_parent", "span_parent_fallback"])) for j in behind]
    ts = build(spark, specs, arcs)
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(walk.depths(ts))
    assert rows(rounds.depths(ts, 0)) == want and rows(rounds.depths(ts, 10)) == want and any(r[3] for r in want)
    target = F.col("step_id").isin("s04", "s11", "s59")
    want = rows(walk.ancestors(ts, target))
    assert rows(rounds.ancestors(ts, target, 0)) == want and rows(rounds.ancestors(ts, target, 10)) == want and want
    assert rounds.depths(ts, 1000).count() == len(specs)
