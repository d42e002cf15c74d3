"""Causal analytics of execution traces, and their companions, on Spark."""

from causeway.operators.analysis import analyze, check_report, compare
from causeway.operators.check import evaluate, verdict
from causeway.operators.failures import causal_edges, explain, find_step, split
from causeway.operators.metrics import counts, deltas, summary
from causeway.operators.motifs import coverage, groups, memo, review_candidates
from causeway.operators.trees import behaviour_changes, canonical, differences, isomorphic_groups, rendered, subtree_changes
from causeway.plans.patterns import PRESETS, PathPattern, StepPredicate, first_matches, matches, sweep
from causeway.plans.projection import normalize, primary_parents, projection_rules, violations
from causeway.schema import TraceSet

__version__ = "0.2.0"
__all__ = [
    "PRESETS", "PathPattern", "StepPredicate", "TraceSet", "analyze", "behaviour_changes", "canonical", "causal_edges", "check_report", "compare", "counts", "coverage", "deltas", "differences", "evaluate",
    "explain", "find_step", "first_matches", "groups", "isomorphic_groups", "matches", "memo", "normalize", "primary_parents", "projection_rules", "rendered", "review_candidates", "split", "subtree_changes", "summary",
    "sweep", "verdict", "violations",
]
