"""Path patterns: a sequence of step predicates along a causal path, compiled to one DataFrame plan.

Hops between neighbours are equi-joins on the cause table, left-deep, so Catalyst pushes the predicates
and picks the joins. A hop with a gap is a join with the pairs that a walk of each trace finds between
candidate starts and ends (plans.walk.gap_pairs); those are distinct, so no plan needs a DISTINCT.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway import schema
from causeway.functions.labels import label
from causeway.plans.projection import causes
from causeway.plans.walk import first_pairs, gap_pairs
from causeway.schema import TraceSet
from causeway.session import staged

#: The gap of the preset that looks nearby; other patterns may have any.
NEAR_GAP = 30


@dataclass(frozen=True)
class StepPredicate:
    """Conditions on one step, all of which must hold; what is None holds always.

    gap: (lo, hi) causal hops from the step before, hi None for any number; None: one hop.
    same_name_as: index of an earlier predicate whose step must have the same, recorded, name.
    """

    name: str | None = None
    name_prefix: str | None = None
    error_contains: str | None = None
    kind: str | None = None
    status: str | None = None
    same_name_as: int | None = None
    gap: tuple[int, int | None] | None = None

    def __post_init__(self):
        if self.gap is not None and (self.gap[0] < 1 or (self.gap[1] is not None and self.gap[1] < self.gap[0])):
            raise ValueError(f"not a gap: {self.gap}")
        if self.same_name_as is not None and self.same_name_as < 0:
            raise ValueError("same_name_as counts predicates from 0")
        if self.name is not None and self.name_prefix is not None:
            raise ValueError("a name and a name prefix exclude each other")
        if "" in (self.name_prefix, self.error_contains):
            raise ValueError("an empty prefix or message part matches everything; leave it out")
        if self.kind is not None and self.kind not in schema.KINDS or self.status is not None and self.status not in schema.STATUSES:
            raise ValueError("no such kind or status")

    def condition(self, prefix: str = "") -> Column:
        """True or false, never null."""
        col = lambda n: F.col(prefix + n)
        parts = [
            col("name") == self.name if self.name is not None else None, col("name").startswith(self.name_prefix) if self.name_prefix else None,
            col("error_msg").contains(self.error_contains) if self.error_contains else None, col("kind") == self.kind if self.kind else None, col("status") == self.status if self.status else None,
        ]
        out = F.lit(True)
        for p in parts:
            if p is not None:
                out = out & F.coalesce(p, F.lit(False))
        return out

    def fields(self) -> set[str]:
        """The fields that it constrains."""
        named = self.name is not None or self.name_prefix is not None or self.same_name_as is not None
        return {f for f, on in (("kind", self.kind), ("name", named), ("status", self.status), ("error_msg", self.error_contains)) if on}

    def __str__(self) -> str:
        shown = [f"{k}{op}{v}" for k, op, v in (("name", "=", self.name), ("name", "^=", self.name_prefix), ("error", "~=", self.error_contains), ("kind", "=", self.kind), ("status", "=", self.status)) if v is not None]
        shown += [f"name=#{self.same_name_as}"] if self.same_name_as is not None else []
        return "{" + (", ".join(shown) or "any") + "}"


@dataclass(frozen=True)
class PathPattern:
    steps: tuple[StepPredicate, ...]
    description: str = ""
    pattern_id: str | None = None
    pattern_version: int | None = None
    review_eligible: bool = True

    def __post_init__(self):
        if (self.pattern_id is None) != (self.pattern_version is None):
            raise ValueError("a pattern has an id and a version, or neither")
        if self.pattern_version is not None and self.pattern_version < 1:
            raise ValueError("versions count from 1")
        for i, p in enumerate(self.steps):
            if p.same_name_as is not None and p.same_name_as >= i:
                raise ValueError(f"predicate {i} can only refer to an earlier one")

    @property
    def strict(self) -> bool:
        """Every hop is a single edge."""
        return all(p.gap in (None, (1, 1)) for p in self.steps[1:])

    @property
    def exportable(self) -> bool:
        """Ends at a failing tool whose name is not prescribed."""
        end = self.steps[-1] if self.steps else None
        return self.review_eligible and end is not None and (end.kind, end.status, end.name, end.name_prefix) == ("TOOL", "error", None, None)

    def constrained(self) -> list[set[str]]:
        """The fields constrained on each step; a reference constrains both names."""
        out = [p.fields() for p in self.steps]
        for p in self.steps:
            if p.same_name_as is not None:
                out[p.same_name_as].add("name")
        return out

    def __str__(self) -> str:
        hop = lambda p: " → " if p.gap is None else f" →[gap {p.gap[0]}..{'' if p.gap[1] is None else p.gap[1]}]→ "
        return "".join((hop(p) if i else "") + str(p) for i, p in enumerate(self.steps))


def _preset(name: str, *steps: StepPredicate, version: int = 1, review: bool = True, about: str) -> PathPattern:
    return PathPattern(steps, about, name, version, review)


_FAILED_TOOL = StepPredicate(kind="TOOL", status="error")
_AGAIN = lambda gap: StepPredicate(kind="TOOL", status="error", same_name_as=0, gap=gap)

# The presets' names, versions and predicates.
PRESETS = {
    p.pattern_id: p
    for p in (
        _preset("error", StepPredicate(status="error"), about="a failed step"),
        _preset("tool-failure", _FAILED_TOOL, about="a failed tool"),
        _preset("plan-then-tool-failure", StepPredicate(name="plan"), _FAILED_TOOL, about="a plan that directly causes a failing tool"),
        _preset("timeout", StepPredicate(status="error", error_contains="timeout"), about="a failure whose message tells of a timeout"),
        _preset("repeated-agent-failure", StepPredicate(kind="AGENT", status="error"), StepPredicate(kind="AGENT", status="error", same_name_as=0, gap=(1, None)), about="an agent that fails again further along"),
        _preset("gate-failure-after-success", StepPredicate(kind="AGENT", status="ok"), StepPredicate(kind="TOOL", status="error", name_prefix="gate:"), about="an agent's success that directly causes a failing gate"),
        _preset("tool-retry-failure", StepPredicate(kind="TOOL"), StepPredicate(kind="CHAIN", name_prefix="retry:"), StepPredicate(kind="TOOL", status="error", same_name_as=0), version=2, about="a marked retry of a tool that fails"),
        _preset("tool-repeat-failure-heuristic", StepPredicate(kind="TOOL"), _AGAIN((2, None)), review=False, about="a tool that is used again later and fails"),
        _preset("tool-retry-failure-near", StepPredicate(kind="TOOL"), _AGAIN((2, NEAR_GAP)), review=False, about="a tool that is used again nearby and fails"),
    )
}
#: The presets that an analysis runs, in the order of its findings.
AUTO = ("tool-retry-failure", "repeated-agent-failure", "gate-failure-after-success", "timeout", "plan-then-tool-failure", "tool-failure", "error")


def matches(ts: TraceSet, pattern: PathPattern, details: bool = False) -> DataFrame:
    """trace_id, s0, s0_seq, s1, s1_seq, ...: one row a match (details: also each step's kind, name, status,
    source, error_msg and unknown_fields as s0_kind, ...). A pattern without predicates matches nothing."""
    if not pattern.steps:
        return ts.steps.where("false").select("trace_id")
    hops, edges = [], causes(ts)
    for i, p in enumerate(pattern.steps[1:], 1):
        if p.gap in (None, (1, 1)):
            hops.append(edges.select("trace_id", F.col("dst").alias(f"s{i - 1}"), F.col("src").alias(f"s{i}")))
        else:
            before = pattern.steps[i - 1].condition()
            hops.append(gap_pairs(ts, before, p.condition(), *p.gap, same_name=p.same_name_as == i - 1).toDF("trace_id", f"s{i - 1}", f"s{i}"))
    return _joined(ts, pattern, hops, details)


def _joined(ts: TraceSet, pattern: PathPattern, hops: list[DataFrame], details: bool) -> DataFrame:
    """The matches from each hop's pairs of steps."""
    fields = ["seq", "name", "kind"] + (["status", "source", "error_msg", "unknown_fields"] if details else [])

    def candidates(i: int) -> DataFrame:
        return ts.steps.where(pattern.steps[i].condition()).select("trace_id", F.col("step_id").alias(f"s{i}"), *[F.col(f).alias(f"s{i}_{f}") for f in fields])

    out = candidates(0)
    for i, (p, hop) in enumerate(zip(pattern.steps[1:], hops), 1):
        out = out.join(hop, ["trace_id", f"s{i - 1}"]).join(candidates(i), ["trace_id", f"s{i}"])
        if p.same_name_as is not None:  # plain equality: a null name equals nothing
            out = out.where(F.col(f"s{p.same_name_as}_name") == F.col(f"s{i}_name"))
    n = range(len(pattern.steps))
    keep = [c for i in n for c in (f"s{i}", *[f"s{i}_{f}" for f in fields if details or f == "seq"])]
    labels = F.array(*[label(F.col(f"s{i}_name"), F.col(f"s{i}_kind")) for i in n])
    return out.select("trace_id", *keep, F.array_join(labels, " > ").alias("labels"))


def order_columns(pattern: PathPattern) -> list[str]:
    """The canonical order of matches."""
    return [c for i in range(len(pattern.steps)) for c in (f"s{i}_seq", f"s{i}")]


def first_matches(ts: TraceSet, pattern: PathPattern, n: int, details: bool = False) -> DataFrame:
    """The first n matches of all traces in canonical order, each with the exact total. Where the pattern is one gap, a trace gives its first n pairs and counts
    the others from its index. Else the matches pass twice, through a sort that keeps n rows a task and through a count. Neither writes them all."""
    gap = pattern.steps[1].gap if len(pattern.steps) == 2 else None
    after = pattern.steps[1] if len(pattern.steps) == 2 else None
    if gap not in (None, (1, 1)):
        pairs = staged(first_pairs(ts, pattern.steps[0].condition(), after.condition(), *gap, same_name=after.same_name_as == 0, first=n))
        total = pairs.select("trace_id", "total").distinct().agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
        seen = pairs.select("trace_id", F.col("a").alias("s0"), F.col("e").alias("s1"))
        return _joined(ts, pattern, [seen], details).orderBy("trace_id", *order_columns(pattern)).limit(n).withColumn("total", F.lit(total).cast("long"))
    found = matches(ts, pattern, details)
    if not pattern.steps:
        return found.withColumn("total", F.lit(0).cast("long"))
    return found.orderBy("trace_id", *order_columns(pattern)).limit(n).withColumn("total", F.lit(found.count()).cast("long"))


def numbered(found: DataFrame, pattern: PathPattern) -> DataFrame:
    """Matches with their place within their trace."""
    return found.withColumn("number", F.row_number().over(Window.partitionBy("trace_id").orderBy(*order_columns(pattern))))


def sweep(ts: TraceSet, names: tuple[str, ...] = AUTO) -> DataFrame:
    """All matches of several presets: pattern_id, pattern_version, trace_id, path, first_seq. One match under two
    presets is two findings. Steps and causes are staged with the columns that predicates read, where they weren't staged; all presets of a single step take one pass."""
    kept = (lambda df: df) if ts.at_rest else staged
    steps = kept(ts.steps.select("trace_id", "step_id", "seq", "kind", "name", "status", "error_msg", "source", "unknown_fields"))
    light = TraceSet(ts.traces, steps, kept(ts.edges.where("type = 'CAUSED_BY'")), True)
    single = [PRESETS[n] for n in names if len(PRESETS[n].steps) == 1]
    hits = F.array_compact(F.array(*[F.when(p.steps[0].condition(), F.struct(F.lit(p.pattern_id).alias("pattern_id"), F.lit(p.pattern_version).alias("pattern_version"))) for p in single])) if single else F.array()
    out = steps.select(F.explode(hits).alias("p"), "trace_id", F.col("step_id").alias("path"), F.col("seq").alias("first_seq")).select("p.pattern_id", "p.pattern_version", "trace_id", "path", "first_seq") if single else None
    for p in (PRESETS[n] for n in names if len(PRESETS[n].steps) > 1):
        path = F.concat_ws(">", *[f"s{i}" for i in range(len(p.steps))])
        got = matches(light, p).select(F.lit(p.pattern_id).alias("pattern_id"), F.lit(p.pattern_version).alias("pattern_version"), "trace_id", path.alias("path"), F.col("s0_seq").alias("first_seq"))
        out = got if out is None else out.unionByName(got)
    return out
