"""Labels, redaction and evidence tests as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from causeway import schema

SAFE = "^[A-Za-z0-9_.:/#@-]{1,200}$"


def label(name: Column, kind: Column) -> Column:
    """A step's name, or its kind where the name is null or empty."""
    return F.coalesce(F.nullif(name, F.lit("")), kind)


def safe(text: Column) -> Column:
    """Text of harmless shape as it is, other text as a stable alias; null stays null."""
    return F.when(text.isNull() | text.rlike(SAFE), text).otherwise(F.concat(F.lit("redacted:"), F.sha2(text, 256)))


def run_alias(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.substring(F.sha2(text, 256), 1, 16))


#: Names that some file systems reserve; fixed values.
RESERVED = ("CON", "PRN", "AUX", "NUL", *[f"{p}{i}" for p in ("COM", "LPT") for i in range(1, 10)])


def default_path(trace_id: Column) -> Column:
    """A portable file name of a trace."""
    portable = trace_id.rlike("^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$") & ~trace_id.endswith(".") & ~F.upper(F.substring_index(trace_id, ".", 1)).isin(*RESERVED)
    return F.when(portable, F.concat(trace_id, F.lit(".json"))).otherwise(F.concat(F.lit("trace-"), F.sha2(trace_id, 256), F.lit(".json")))


def gap_codes(capture: Column) -> Column:
    """Codes of a capture record; none where there is no record."""
    return F.coalesce(F.transform(capture["gaps"], lambda g: g["code"]), F.array().cast("array<string>"))


def gaps_hide(capture: Column, codes: tuple[str, ...]) -> Column:
    """Whether a gap has one of the codes, or a code nobody knows."""
    own = gap_codes(capture)
    return F.arrays_overlap(own, F.array(*map(F.lit, codes))) | (F.size(F.array_except(own, F.array(*map(F.lit, schema.GAP_CODES)))) > 0)


def gaps_have(capture: Column, codes: tuple[str, ...]) -> Column:
    return F.arrays_overlap(gap_codes(capture), F.array(*map(F.lit, codes)))


def heuristic_edges(capture: Column) -> Column:
    """disclosed, not_disclosed, or unknown (no record, or a code nobody knows)."""
    odd = F.size(F.array_except(gap_codes(capture), F.array(*map(F.lit, schema.GAP_CODES)))) > 0
    return F.when(capture.isNull(), "unknown").when(gaps_have(capture, schema.HEURISTIC_EDGES), "disclosed").when(odd, "unknown").otherwise("not_disclosed")


def known(field: str, prefix: str = "") -> Column:
    """Whether a step's field was recorded, as opposed to substituted or unrecorded."""
    col = lambda n: F.col(prefix + n)
    listed = F.coalesce(F.array_contains(col("unknown_fields"), field), F.lit(False))
    if field == "status":
        return F.coalesce(col("status") != "unset", F.lit(False))
    if field == "error_msg":
        return F.coalesce(col("status") != "unset", F.lit(False)) & ~listed
    if field == "name":
        return col("name").isNotNull() & ~listed
    return ~listed
