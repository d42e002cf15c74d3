"""The trace tables: types, vocabularies and the bundle of three DataFrames.

An edge points from effect (src) to cause (dst). ``edges`` holds the recorded causes only; the single
parent tree is derived from them (plans.projection) and never stored on its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

EVALUATION = "struct<name: string, label: string, score: double>"
EVIDENCE = (
    "struct<end_ts: string, duration_ms: double, prompt_tokens: bigint, completion_tokens: bigint, total_tokens: bigint, prompt_cost: string, "
    f"completion_cost: string, total_cost: string, cost_currency: string, artifact_digest: string, evaluations: array<{EVALUATION}>>"
)
TRACES = (
    "trace_id string, source_kind string, run_id string, thread_id string, status string, causal_fidelity string, links_preserved boolean, "
    "decision_evidence array<struct<source: string, artifact_digest: string, graph_generation: bigint, verdict: string>>, "
    "schedule_graph struct<fingerprint: string>, capture struct<gaps: array<struct<code: string, count: bigint>>>"
)
STEPS = (
    "trace_id string, step_id string, seq bigint, ts string, kind string, source string, name string, status string, error_msg string, "
    f"evidence {EVIDENCE}, projection_lossy boolean, unknown_fields array<string>"
)
EDGES = "trace_id string, type string, src string, dst string, origin string"


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


# Fixed values of the data model.
KINDS = ("AGENT", "CHAIN", "TOOL", "LLM", "RETRIEVER", "EMBEDDING", "RERANKER", "GUARDRAIL", "EVALUATOR", "PROMPT", "UNKNOWN", "DATA")
SOURCES = ("input", "loop", "update", "fork", "task", "interrupt", "scheduled")
STATUSES = ("ok", "error", "unset")
FIDELITIES = ("declared_dag", "parent_only", "legacy_unknown")
EDGE_TYPES = ("CAUSED_BY", "TREE_PARENT", "BELONGS_TO", "WROTE", "READ")
#: origin -> rank when one parent is chosen; any other origin, and none, ranks 3.
ORIGIN_RANK = {"checkpoint_parent": 0, "checkpoint_subgraph_return": 0, "graph_parent": 0, "graph_parent_heuristic": 0, "span_parent_fallback": 1, "span_link": 2, "legacy_unknown": 3}
#: Origins that a producer declared; only these carry error ancestry.
EXPLICIT_ORIGINS = ("checkpoint_parent", "checkpoint_subgraph_return", "graph_parent", "span_link")
GAP_CODES = (
    "langgraph.ambiguous_subgraph_return", "langgraph.malformed_pending_writes", "langgraph.rewritten_error_channel", "langgraph.unapplied_command_goto",
    "langgraph.unattributed_failed_task", "langgraph.unattributed_interrupted_task", "langgraph.undecided_interrupt", "langgraph.undecodable_send_packets",
    "langgraph.unknown_send_target", "otlp.foreign_trace_link", "otlp.graph_parent_by_timing", "otlp.graph_parent_fallback", "otlp.unreadable_component_cost",
    "otlp.unreadable_cost_currency", "otlp.unreadable_timestamp", "otlp.unreadable_token_count", "otlp.unreadable_total_cost", "otlp.unresolved_span_link",
    "otlp.unscoped_span_link", "phoenix.unreadable_evaluation_score",
)
#: What a gap code can hide; a code that isn't known may hide all of it.
OMITS_STEPS = ("langgraph.malformed_pending_writes", "langgraph.undecided_interrupt", "langgraph.unapplied_command_goto", "langgraph.unknown_send_target", "otlp.unresolved_span_link", "otlp.unscoped_span_link")
REWRITTEN_ERRORS = ("langgraph.rewritten_error_channel",)
HEURISTIC_EDGES = ("otlp.graph_parent_by_timing", "otlp.graph_parent_fallback")
UNDECIDED_EDGES = ("langgraph.ambiguous_subgraph_return",)


@dataclass(frozen=True)
class TraceSet:
    """Many traces: header, step and cause tables, all keyed by trace_id."""

    traces: DataFrame
    steps: DataFrame
    edges: DataFrame
    at_rest: bool = False

    def staged(self) -> "TraceSet":
        """The tables written to the shared folder once, for plans that read them several times; tables that were aren't written again."""
        from causeway.session import staged

        return self if self.at_rest else TraceSet(staged(self.traces), staged(self.steps), staged(self.edges), True)

    def union(self, other: "TraceSet") -> "TraceSet":
        return TraceSet(*(a.unionByName(b) for a, b in ((self.traces, other.traces), (self.steps, other.steps), (self.edges, other.edges))))

    def where(self, trace_ids: DataFrame) -> "TraceSet":
        return TraceSet(*(t.join(trace_ids.select("trace_id"), "trace_id", "left_semi") for t in (self.traces, self.steps, self.edges)))
