"""Folders of mixed documents: what each file is, told by its top-level keys before any reader runs, and the traces of all that can be read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway import schema
from causeway.schema import TraceSet
from causeway.session import staged
from causeway.sources import artifacts, exports, spans

ARTIFACT, SPANS, EXPORT = "artifact", "otlp", "phoenix"


def _has(v: Column, *names: str) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | F.try_variant_get(v, f"$.{n}", "variant").isNotNull()
    return out


def _is_array(v: Column, name: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")).startswith("ARRAY"), F.lit(False))


def _families(v: Column, root: bool) -> dict[str, Column]:
    """Which readers' keys a record has. Envelopes count at a document's root only."""
    arrays = [_is_array(v, n) for n in (("spans", "traces", "data") if root else ("spans",))]
    export = arrays[0]
    for a in arrays[1:]:
        export = export | a
    return {ARTIFACT: _has(v, "schema_version"), SPANS: _has(v, "resourceSpans", "resource_spans"), EXPORT: export}


def classify(files: DataFrame) -> DataFrame:
    """files: file, value -> file, value, family, reason. Exactly one of the last two is set. A portable trace file is a document of its own, never a
    record among others; records of two formats are ambiguous; of the line formats only span documents are read."""
    whole = F.try_parse_json("value")
    lines = F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")
    # Spark's parser stops after a text's first value, so several lines that are documents each come first
    by_line = (F.size(lines) > 1) & F.forall(lines, lambda x: F.try_parse_json(x).isNotNull())
    listed = F.try_variant_get(whole, "$", "array<variant>")
    records = F.when(by_line, F.transform(lines, lambda x: F.try_parse_json(x))).when(listed.isNotNull(), listed).otherwise(F.array(whole))
    kind = F.when(by_line, "lines").when(listed.isNotNull(), "list").otherwise("document")
    inner = lambda v: F.coalesce(F.try_variant_get(v, "$.traces", "array<variant>"), F.try_variant_get(v, "$.data", "array<variant>"), F.array().cast("array<variant>"))
    some = lambda rows, family, root: F.exists(rows, lambda v: _families(v, root)[family])
    rows = files.withColumns({"kind": kind, "records": records, "nested": F.flatten(F.transform(records, inner))})
    at = {f: F.when(F.col("kind") == "list", some(F.col("records"), f, False)).otherwise(some(F.col("records"), f, True)) for f in (ARTIFACT, SPANS, EXPORT)}
    own_artifact = (F.col("kind") == "document") & at[ARTIFACT]
    within = {f: (F.col("kind") == "document") & some(F.col("nested"), f, False) for f in (ARTIFACT, SPANS)}
    found = rows.select("file", "value", "kind", own_artifact.alias("own"), (at[ARTIFACT] & (F.col("kind") != "document") | within[ARTIFACT]).alias("held"), (at[SPANS] | within[SPANS]).alias("spans"), at[EXPORT].alias("export"), whole.isNull().alias("broken"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    reason = (
        F.when(yes("broken") & (F.col("kind") != "lines"), "not valid JSON").when(yes("own"), None).when(yes("held"), "a portable trace must be the whole document").when(yes("spans") & yes("export"), "ambiguous: records of two formats")
        .when(~yes("spans") & ~yes("export"), "unsupported shape").when((F.col("kind") == "lines") & ~yes("spans"), "lines are read as span documents only")
    )
    family = F.when(reason.isNull(), F.when(yes("own"), ARTIFACT).when(yes("spans"), SPANS).otherwise(EXPORT))
    return found.select("file", "value", family.alias("family"), reason.alias("reason"))


@dataclass(frozen=True)
class Loaded:
    """What a folder holds. failures: file, reason of each file that can't be used whole. evidence: file, digest, trace_id of the others, the digest being that of
    the bytes that were read."""

    traces: TraceSet
    failures: DataFrame
    evidence: DataFrame


def files(spark, path: str) -> DataFrame:
    """file, value, digest, reason: each file read once, as bytes; the same bytes are hashed and parsed. value is null where they are no UTF-8."""
    return _hashed(spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content"))


def _hashed(raw: DataFrame) -> DataFrame:
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return raw.select("file", text.alias("value"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("digest"), F.when(text.isNull(), "not UTF-8").alias("reason"))


def load(spark, path: str, trace_ids: list[str] | None = None) -> Loaded:
    """The traces of all files under path that can be read. A file that can't be, or one of whose traces breaks a rule, is left out whole and named with its
    first reason; the other files are not touched by it. trace_ids: only these traces. Spark's driver lists the files, so their number is bounded by its memory:
    millions of documents are packed into a table for ``load_table``."""
    return _load(spark, files(spark, path), trace_ids)


def load_table(packed: DataFrame, trace_ids: list[str] | None = None) -> Loaded:
    """packed: file string, content binary, a row a file -> what ``load`` gives for a folder of these files. No list of files is made."""
    return _load(packed.sparkSession, _hashed(packed.select("file", "content")), trace_ids)


def _load(spark, read_files: DataFrame, trace_ids: list[str] | None) -> Loaded:
    every = staged(read_files)
    routed = staged(classify(every.where("reason IS NULL").select("file", "value")))
    of = lambda family: routed.where(F.col("family") == family).select("file", "value")
    bad, owners, sets = [every.where("reason IS NOT NULL").select("file", "reason"), routed.where("reason IS NOT NULL").select("file", "reason")], [], []
    if not (own := of(SPANS)).isEmpty():
        docs = staged(spans.documents(own, tolerant=True))
        decoded = staged(spans.decode(docs.where("problem IS NULL"), tolerant=True))
        _gather(docs, decoded, lambda rows, faults: spans.ingest(rows, faults=faults), bad, owners, sets)
    if not (own := of(EXPORT)).isEmpty():
        decoded = staged(exports.decode(own, tolerant=True))
        _gather(decoded, decoded.where("step_id IS NOT NULL"), exports.resolved, bad, owners, sets)
    if not (own := of(ARTIFACT)).isEmpty():
        whole = staged(own.withColumn("fit", artifacts.readable()))
        bad.append(whole.where("NOT fit").select("file", F.lit("no portable trace of a known version").alias("reason")))
        found: list[DataFrame] = []
        good = whole.where("fit")
        sets.append(artifacts.from_text(good.select("value"), found=found))
        owners.append(staged(good.select("file", F.get_json_object("value", "$.trace.trace.trace_id").alias("trace_id"))))
        bad.append(owners[-1].join(found[0], "trace_id").select("file", F.col("rule").alias("reason")))
    failures = staged(_union(bad).groupBy("file").agg(F.min("reason").alias("reason")))
    if not sets:
        empty = lambda ddl: spark.createDataFrame([], ddl)
        return Loaded(TraceSet(empty(schema.TRACES), empty(schema.STEPS), empty(schema.EDGES)), failures, empty("file string, digest string, trace_id string"))
    owned = _union(owners).distinct()
    # a trace of a file that fails is left out, also where another file has a part of it
    lost = staged(owned.join(failures, "file", "left_semi").select("trace_id").distinct())
    kept = owned.join(lost, "trace_id", "left_anti")
    if trace_ids is not None:
        kept = kept.join(spark.createDataFrame([(t,) for t in trace_ids], "trace_id string"), "trace_id", "left_semi")
    kept = staged(kept)
    ts = sets[0]
    for more in sets[1:]:
        ts = ts.union(more)
    return Loaded(ts.where(kept.select("trace_id").distinct()), failures, kept.join(every.select("file", "digest"), "file").select("file", "digest", "trace_id"))


def _gather(read: DataFrame, decoded: DataFrame, ingest, bad: list, owners: list, sets: list) -> None:
    """Decoded spans (file, problem, ...) -> their traces without those that have faults, whose files are told."""
    wrong = staged(read.where("problem IS NOT NULL").select("file", F.col("problem").alias("reason")).union(decoded.where("problem IS NOT NULL").select("file", "problem")).distinct())
    bad.append(wrong)
    good = staged(decoded.join(wrong.select("file").distinct(), "file", "left_anti"))
    faults: list[DataFrame] = []
    sets.append(ingest(good.drop("file", "problem"), faults))
    own = staged(decoded.where("trace_id IS NOT NULL").select("file", "trace_id").distinct())
    owners.append(own)
    for told in faults:
        bad.append(own.join(told, "trace_id").select("file", "reason"))


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out


def read(spark, path: str, trace_ids: list[str] | None = None) -> tuple[TraceSet, DataFrame]:
    """(traces, file and reason of what can't be used): ``load`` without its evidence."""
    got = load(spark, path, trace_ids)
    return got.traces, got.failures


def sole_trace(ts: TraceSet) -> str:
    """The id of the one trace there is; none or several are an error."""
    few = [r.trace_id for r in ts.traces.select("trace_id").distinct().orderBy("trace_id").limit(6).collect()]
    if len(few) != 1:
        raise ValueError(f"{'no trace' if not few else 'several traces, name one: ' + ', '.join(few)}")
    return few[0]
