"""Tasks of checkpoint histories: names proved by recomputed ids, pending packets, and tasks that a graph schedules.

A checkpoint records a task by its id only, which is a digest of the checkpoint's id and of what was to run. Names that the
checkpoint itself mentions are hashed with every plausible set of triggers, and an equal id proves the name; a name that isn't
the right one can't match. Candidates are made for checkpoints with tasks to name only and meet the recorded ids in an
equi-join. SHA-1 ids of old checkpoints are made by Spark itself, xxh3 ids of newer ones by Arrow batches.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from causeway.session import ship

# Fixed values of the format.
BRANCH, JOIN, START, PACKETS = "branch:to:", "join:", "__start__", "__pregel_tasks"
PULL, PUSH, SOURCE_NODE = "__pregel_pull", "__pregel_push", "__error_source_node__"
#: Checkpoints up to this version have SHA-1 ids.
LEGACY = 1
NODES = "node string, triggers array<string>"
TASKS = "thread_id string, checkpoint_id string, task_id string, name string"
_STRINGS = "array<string>"


@dataclass(frozen=True)
class Graph:
    """What is known of the program that wrote histories. nodes (NODES): its nodes and the channels that trigger them. tasks (TASKS): the tasks that it
    schedules at the newest root checkpoint of each thread; ``scheduled_tasks`` derives them where they aren't given."""

    nodes: DataFrame
    tasks: DataFrame | None = None

    def fingerprint(self) -> DataFrame:
        """One row: a digest of what decides which tasks run, the same for equal nodes in any order."""
        each = self.nodes.select(F.struct("node", F.array_sort(F.array_distinct(F.coalesce("triggers", F.array().cast(_STRINGS)))).alias("triggers")).alias("x"))
        return each.agg(F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.array_sort(F.collect_set("x"))), 256)).alias("fingerprint"))  # a graph's nodes, not a corpus


def _keys(m: str) -> Column:
    return F.coalesce(F.map_keys(m), F.array().cast(_STRINGS))


def target(channel: Column) -> Column:
    """The node that a trigger channel starts, or null."""
    name = F.when(channel.startswith(BRANCH), F.substr(channel, F.lit(len(BRANCH) + 1))).when(channel.startswith(JOIN), F.substring_index(channel, ":", -1))
    return F.nullif(name, F.lit(""))


def triggers() -> Column:
    """Of a checkpoint row: its trigger channels with their targets. A consumed channel has lost its value but keeps its version."""
    pairs = F.transform(F.array_union(_keys("channel_values"), _keys("channel_versions")), lambda c: F.struct(c.alias("channel"), target(c).alias("node")))
    return F.filter(pairs, lambda p: p["node"].isNotNull())


@F.pandas_udf(StringType())
def _xxh3(data: pd.Series) -> pd.Series:
    from xxhash import xxh3_128_hexdigest

    return data.map(lambda b: None if b is None else xxh3_128_hexdigest(b))


def task_id(checkpoint: str, version: str, *parts: Column) -> Column:
    """The id of a task at a checkpoint; null where the checkpoint's id is no hexadecimal number, which no such id was made from."""
    digits = F.replace(F.col(checkpoint), F.lit("-"), F.lit(""))
    seed = F.when(digits.rlike("^[0-9a-fA-F]*$") & (F.length(digits) % 2 == 0), F.unhex(digits))
    data = F.concat(seed, F.concat(*parts).cast("binary"))
    h = F.when(F.coalesce(F.col(version), F.lit(0)) <= LEGACY, F.sha1(data)).otherwise(_xxh3(data))
    return F.concat_ws("-", *[F.nullif(F.substring(h, lo, n), F.lit("")) for lo, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def _identity(node: Column) -> list[Column]:
    """What an id says of a node: its namespace, the step to come, its name."""
    inside = F.when(F.coalesce("ns", F.lit("")) == "", node).otherwise(F.concat("ns", F.lit("|"), node))
    return [inside, (F.coalesce("md_step", F.lit(0)) + 1).cast("string"), node]


def pull_ids(rows: DataFrame) -> DataFrame:
    """rows: checkpoints with sid and ns -> thread_id, sid, task_id, node: the ids that nodes mentioned there would have, for each plausible set of triggers."""
    found = rows.select("thread_id", "sid", "ns", "checkpoint_id", "v", "md_step", triggers().alias("triggers"), _keys("versions_seen").alias("seen"))
    names = F.array_union(F.array_union(F.transform("triggers", lambda p: p["node"]), F.col("seen")), F.array(F.lit(START)))
    each = found.select("*", F.explode(names).alias("node"))
    observed = F.array_sort(F.transform(F.filter("triggers", lambda p: p["node"] == F.col("node")), lambda p: p["channel"]))
    branch = F.array(F.concat(F.lit(BRANCH), "node"))
    # a node with several sources is also triggered by a branch channel that no checkpoint need mention
    sets = F.when(F.col("node") == START, F.array(F.array(F.lit(START)))).otherwise(F.array_distinct(F.array(F.array_sort(F.array_union(observed, branch)), F.when(F.size(observed) > 0, observed).otherwise(branch), branch)))
    each = each.select("thread_id", "sid", "ns", "checkpoint_id", "v", "md_step", "node", F.explode(sets).alias("set"))
    parts = [*_identity(F.col("node")), F.lit(PULL), F.array_join("set", "")]
    return each.select("thread_id", "sid", task_id("checkpoint_id", "v", *parts).alias("task_id"), "node")


def packets(rows: DataFrame) -> DataFrame:
    """rows -> thread_id, sid, idx, node, channel: the packets in the tasks channel, a JSON list, with their place in it, and those that older
    checkpoints kept apart (column pending_sends: a list of JSON texts). node is null where a packet can't be read."""
    listed = F.try_variant_get(F.try_parse_json(F.col("channel_values")[PACKETS]), "$", "array<variant>")
    own = rows.select("thread_id", "sid", F.posexplode(listed).alias("idx", "packet")).withColumn("channel", F.lit(PACKETS))
    if "pending_sends" in rows.columns:
        apart = rows.select("thread_id", "sid", F.posexplode("pending_sends").alias("idx", "packet"))
        own = own.union(apart.select("thread_id", "sid", "idx", F.try_parse_json("packet"), F.lit("pending_sends")))
    kind = F.schema_of_variant(F.try_variant_get("packet", "$.node", "variant"))
    return own.select("thread_id", "sid", "idx", F.when(kind == "STRING", F.try_variant_get("packet", "$.node", "string")).alias("node"), "channel")


def push_ids(rows: DataFrame) -> DataFrame:
    """rows -> thread_id, sid, task_id, node, idx: the ids of packets. Their place is part of the id, so two packets to one node are two tasks."""
    own = packets(rows).where(F.col("node").isNotNull() & (F.col("channel") == PACKETS)).select("thread_id", "sid", "idx", "node")
    at = own.join(rows.select("thread_id", "sid", "ns", "checkpoint_id", "v", "md_step"), ["thread_id", "sid"])
    return at.select("thread_id", "sid", task_id("checkpoint_id", "v", *_identity(F.col("node")), F.lit(PUSH), F.col("idx").cast("string")).alias("task_id"), "node", "idx")


def names(rows: DataFrame, tasks: DataFrame) -> DataFrame:
    """tasks: thread_id, sid, task_id -> those of them that a candidate's id equals, with name: the first node by name, else a packet's node."""
    ship(rows.sparkSession)
    candidates = pull_ids(rows).select("*", F.lit(True).alias("pull")).union(push_ids(rows).select("thread_id", "sid", "task_id", "node", F.lit(False)))
    # joined by sorting: the size of a union of exploded rows is guessed far too low, and the smaller side sent whole through the driver
    met = candidates.join(tasks.select("thread_id", "sid", "task_id").hint("merge"), ["thread_id", "sid", "task_id"])
    found = met.groupBy("thread_id", "sid", "task_id").agg(F.min(F.when(F.col("pull"), F.col("node"))).alias("pulled"), F.max(F.when(~F.col("pull"), F.col("node"))).alias("sent"))
    return found.select("thread_id", "sid", "task_id", F.coalesce("pulled", "sent").alias("name"))


def scheduled_tasks(heads: DataFrame, nodes: DataFrame) -> DataFrame:
    """heads: newest root checkpoints with sid and ns -> TASKS: nodes of which a trigger has a value and a version newer than the node has seen, and
    packets addressed to nodes that there are. Versions compare as numbers where both are, else as texts."""
    ship(heads.sparkSession)
    both = heads.select("thread_id", "sid", "ns", "checkpoint_id", "v", "md_step", "channel_versions", "versions_seen", F.explode(_keys("channel_values")).alias("channel"))
    wired = nodes.select("node", F.array_sort(F.array_distinct("triggers")).alias("triggers")).select("*", F.explode("triggers").alias("channel"))
    met = both.join(F.broadcast(wired), "channel")  # a graph's nodes, not a corpus
    now, seen = F.col("channel_versions")[F.col("channel")], F.col("versions_seen")[F.col("node")][F.col("channel")]
    number = lambda c: F.expr(f"try_cast({c} as decimal(38,18))")
    met = met.withColumns({"now": now, "seen": seen})
    newer = F.col("seen").isNull() | F.coalesce(number("now") > number("seen"), F.col("now") > F.col("seen"), F.lit(False))
    ready = met.where(newer).groupBy("thread_id", "sid", "node").agg(*[F.first(c).alias(c) for c in ("ns", "checkpoint_id", "v", "md_step", "triggers")])
    pulled = ready.select("thread_id", "checkpoint_id", task_id("checkpoint_id", "v", *_identity(F.col("node")), F.lit(PULL), F.array_join("triggers", "")).alias("task_id"), F.col("node").alias("name"))
    sent = push_ids(heads).join(F.broadcast(nodes.select("node")), "node", "left_semi").join(heads.select("thread_id", "sid", "checkpoint_id"), ["thread_id", "sid"])
    return pulled.union(sent.select("thread_id", "checkpoint_id", "task_id", F.col("node").alias("name")))
