"""Near-duplicate classes by a multi-index Hamming join of b-bit MinHash signatures.

A signature has CHUNKS x SLOTS slots of 8 bits. Two signatures that differ in at most
CHUNKS * (ERRORS + 1) - 1 slots agree, by the pigeonhole principle, in some chunk but for ERRORS
slots; so each chunk is indexed once for each set of ERRORS slots left out, and all such pairs meet in a
bucket. (Beyond that distance they still meet with high probability: at similarity 0.8 one pair in
about 100,000 does not.) Equal shingle sets are one class from the start. Members of a bucket are compared
with a hub, its smallest member, not with each other. Those within FAR slots of it are tied to it. Whatever
is LIMIT or nearer to a member that is NEAR or nearer to the hub is tied to the hub itself, as distances add up
(NEAR + LIMIT = FAR), so only members further off than NEAR stay in the bucket. After HUBS turns with new hubs, what still
stays is compared within its bucket, in blocks: all pairs up to LIMIT end in one cluster. Links are then confirmed on full shingle sets within a
cluster, in blocks of bounded size: all pairs of a block, and of it with a few pivots, that aren't joined yet,
then all members outside the cluster's largest component against every block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, fresh, keep_only, narrow, small_batches, spread_join, staged
from .graph import components

CHUNKS, SLOTS, ERRORS = 11, 6, 1
SIGNATURE = CHUNKS * SLOTS
#: Signatures that differ in so many slots or fewer are certain to end in one cluster.
LIMIT = CHUNKS * (ERRORS + 1) - 1
#: A member that differs from a bucket's hub in more slots is not tied to it: unrelated texts differ in more.
FAR = 46
NEAR = FAR - LIMIT
#: Hubs that a bucket gets one after the other; then blocks of so many of the members that still stay are compared.
HUBS, MEMBERS = 3, 2048
#: Shingles of a block of a cluster, about.
BLOCK = 100_000
#: Members that every block of a large cluster also gets, so that what is like them is joined across blocks at once.
PIVOTS = 16
#: The doc_id that stands for null: the smallest.
NULL_ID = -(2**63)

_RNG = np.random.default_rng(8)
_MUL = (_RNG.integers(0, 2**32, SIGNATURE, np.uint32) | np.uint32(1))[:, None]
_ADD = _RNG.integers(0, 2**32, SIGNATURE, np.uint32)[:, None]


def shingles(text: str | None) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct word pairs (A-Z lower-cased; a single word is its own shingle)."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    h = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    if len(h) > 1:
        h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + (h[1:] ^ (h[1:] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return np.unique(h ^ (h >> np.uint64(32)))


def signature(s: np.ndarray) -> bytes:
    """The lowest-hash element of s under each of SIGNATURE permutations, 8 bits of each."""
    low = np.full(SIGNATURE, 2**32 - 1, np.uint32)
    x = (s >> np.uint64(17)).astype(np.uint32)
    for k in range(0, len(x), 2048):
        low = np.minimum(low, (_MUL * x[k : k + 2048] + _ADD).min(axis=1))
    return ((low * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8).tobytes()


def set_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def bucket_keys(signatures: np.ndarray) -> np.ndarray:
    """n x SIGNATURE bytes -> n x (CHUNKS * SLOTS) keys: each chunk with one slot left out in turn."""
    keys = []
    for c in range(CHUNKS):
        chunk = signatures[:, c * SLOTS : (c + 1) * SLOTS].astype(np.int64)
        for out in range(SLOTS):
            key = np.full(len(chunk), c * SLOTS + out, np.int64)
            for j in range(SLOTS):
                if j != out:
                    key = (key << 8) | chunk[:, j]
            keys.append(key)
    return np.stack(keys, axis=1)


def _sketch(batches: Iterator) -> Iterator:
    import pyarrow as pa

    keep_only("sketches")
    for b in batches:
        sets = [shingles(t) for t in b["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b["doc_id"], b["text_hash"], pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) for s in sets], pa.binary()), pa.array([signature(s) if len(s) else b"" for s in sets], pa.binary())],
            ["doc_id", "text_hash", "n_shingles", "set_key", "signature"],
        )


def _buckets(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for b in batches:
        n = b.num_rows
        for k in range(0, n, 4096):
            part = b.slice(k, 4096)
            sig = np.frombuffer(b"".join(part["signature"].to_pylist()), np.uint8).reshape(-1, SIGNATURE)
            keys, cls = bucket_keys(sig), np.asarray(part["class"])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(cls, keys.shape[1]))], ["key", "class"])


def _distances(batches: Iterator) -> Iterator:
    """a, b and the number of slots in which their signatures differ."""
    import pyarrow as pa

    for b in batches:
        one, two = (np.frombuffer(b"".join(b[c].to_pylist()), np.uint8).reshape(-1, SIGNATURE) for c in ("sig_a", "sig_b"))
        yield pa.RecordBatch.from_arrays([b["a"], b["b"], pa.array((one != two).sum(axis=1), pa.int32())], ["a", "b", "d"])


def _close(batches: Iterator) -> Iterator:
    """Members of buckets, sorted by bucket and pair of blocks -> links that join all that differ in LIMIT slots or fewer."""
    import pyarrow as pa

    def links(rows: list) -> tuple[list, list]:
        held = {c: (first, s) for c, first, s in rows}  # a block with itself comes once
        ids = list(held)
        sig = np.frombuffer(b"".join(s for _, s in held.values()), np.uint8).reshape(-1, SIGNATURE)
        own, group, one, two = np.array([f for f, _ in held.values()]), np.arange(len(ids)), [], []
        for i in np.flatnonzero(own):
            near = np.flatnonzero(((sig != sig[i]).sum(axis=1) <= LIMIT) & (group != group[i]))
            for g, j in {int(group[j]): int(j) for j in near}.items():
                one.append(ids[i])
                two.append(ids[j])
                group[group == g] = group[i]
        return one, two

    now, rows, out = None, [], ([], [])
    for b in batches:
        for unit, *row in zip(*(b[c].to_pylist() for c in ("unit", "class", "first", "signature"))):
            if unit != now:
                if len(rows) > 1:
                    for have, more in zip(out, links(rows)):
                        have.extend(more)
                now, rows = unit, []
            rows.append(row)
    if len(rows) > 1:
        for have, more in zip(out, links(rows)):
            have.extend(more)
    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b"])


def _tied(keys: DataFrame, sig: DataFrame) -> DataFrame:
    """keys (key, class) -> a, b: classes that are FAR or nearer to a hub of a bucket that they share, or LIMIT or nearer to each other."""
    count = F.count(F.lit(1)).alias("members")
    ties, rest = None, keys
    for turn in range(HUBS):
        # the first hub is the smallest member, so that near copies share it in all buckets; others are drawn
        hub = F.min("class") if turn == 0 else F.min_by("class", F.xxhash64("class", F.lit(turn)))
        hubs = rest.groupBy("key").agg(hub.alias("hub"), count).where("members > 1").drop("members")
        met = staged(rest.join(hubs, "key").where("class != hub"))
        pairs = met.select(F.col("class").alias("a"), F.col("hub").alias("b")).distinct()
        known = staged(pairs.join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b").mapInArrow(_distances, "a long, b long, d int"))
        own = known.where(F.col("d") <= FAR).select("a", "b")
        ties = own if ties is None else ties.union(own)
        far = known.where(F.col("d") > NEAR).select(F.col("a").alias("class"), F.col("b").alias("hub"))
        rest = staged(met.join(far, ["class", "hub"], "left_semi").select("key", "class"))
        if rest.isEmpty():
            return ties
    blocks = rest.groupBy("key").agg(F.ceil(count / MEMBERS).cast("int").alias("blocks"), count).where("members > 1").drop("members")
    dealt = rest.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("class"), "blocks").cast("int"))
    # a member goes to each pair of its block with another; the pair's smaller block asks, the other one answers
    to = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    units = dealt.withColumn("to", to).select(F.xxhash64("key", F.least("block", "to"), F.greatest("block", "to")).alias("unit"), "class", (F.col("block") <= F.col("to")).alias("first"))
    parts = int(sig.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = units.join(sig, "class").repartition(parts, "unit").sortWithinPartitions("unit")
    return ties.union(staged(rows.select("unit", "class", "first", "signature").mapInArrow(_close, "a long, b long")))


def confirmed(ids: list[int], sets: list[np.ndarray], comp: list[int], query: list[bool], percent: int) -> list[tuple[int, int]]:
    """Links that join what isn't joined yet: pairs (a query, any member) with percent/100 or more similarity on full sets."""
    n = len(ids)
    if n < 2:
        return []
    own_comp = np.array(comp)
    size = np.array([len(s) for s in sets])
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(ids[0], ids[1])] if comp[0] != comp[1] and 100 * both >= percent * (size[0] + size[1] - both) else []
    _, where = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(where, kind="stable")
    posted, count = owner[order], np.bincount(where)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    at = np.concatenate([[0], np.cumsum(size)])
    out = []
    for i in np.flatnonzero(query):
        if (own_comp == own_comp[i]).all():
            break
        own = where[at[i] : at[i + 1]]
        length = count[own]
        gather = np.repeat(first[own] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(int(length.sum()))
        both = np.bincount(posted[gather], minlength=n)
        new = np.flatnonzero((100 * both >= percent * (size[i] + size - both)) & (own_comp != own_comp[i]))
        for other, j in dict(zip(own_comp[new].tolist(), new.tolist())).items():
            out.append((ids[i], ids[j]))
            own_comp[own_comp == other] = own_comp[i]
    return out


def _compare(percent: int):
    """Blocks come one after the other, sorted; links that join components leave."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def links(rows: list) -> pa.RecordBatch:
            held = {}
            for cls, comp, query, text in rows:
                held[cls] = (comp, query or held.get(cls, (0, False))[1], text)
            got = confirmed(list(held), [shingles(h[2]) for h in held.values()], [h[0] for h in held.values()], [h[1] for h in held.values()], percent)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in got], pa.int64()) for k in (0, 1)], ["a", "b"])

        now, rows = None, []
        for b in batches:
            for block, *row in zip(*(b[c].to_pylist() for c in ("block", "class", "component", "query", "text"))):
                if block != now:
                    if len(rows) > 1:
                        yield links(rows)
                    now, rows = block, []
                rows.append(row)
        if len(rows) > 1:
            yield links(rows)

    return run


def _by_block(rows: DataFrame, percent: int) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("block", "class", "component", "query", "text").repartition(parts, "block").sortWithinPartitions("block")
    return staged(dealt.mapInArrow(_compare(percent), "a long, b long"))


def classes(docs: DataFrame, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(sketches, components): sketches has doc_id, text_hash, n_shingles, set_key for every row; components has set_key, copies (rows
    with it), component (its own number) and component_id (a doc_id; NULL_ID for null) for each distinct non-empty shingle set."""
    spark = docs.sparkSession
    small_batches(spark)
    own = F.when(F.col("doc_id") == NULL_ID, F.raise_error(F.lit("the smallest 64-bit number is no doc_id")).cast("long")).otherwise(F.coalesce("doc_id", F.lit(NULL_ID)))
    rows = narrow(docs, doc_id="long", text="string").select(own.alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    sketches = staged(rows.mapInArrow(_sketch, "doc_id long, text_hash long, n_shingles long, set_key binary, signature binary"))
    least = F.min(F.struct("doc_id", "text_hash"))
    folded = sketches.where("n_shingles > 0").groupBy("set_key").agg(least.alias("least"), F.max("n_shingles").alias("n"), F.max("signature").alias("signature"), F.count(F.lit(1)).alias("copies"))
    reps = staged(folded.select("set_key", "least.*", "n", "signature", "copies", F.monotonically_increasing_id().alias("class")))

    keys = reps.select("signature", "class").mapInArrow(_buckets, "key long, class long")
    clusters = components(_tied(keys, reps.select("class", "signature"))).withColumnRenamed("component", "cluster")

    held = staged(clusters.join(reps.select(F.col("class").alias("node"), "doc_id", "text_hash", "set_key", "n"), "node"))
    blocks = held.groupBy("cluster").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    held = staged(held.join(blocks, "cluster").select("doc_id", "text_hash", "set_key", F.col("node").alias("class"), "cluster", "blocks", "n"))
    texts = staged(_texts(rows, held))
    place = F.pmod(F.xxhash64("class"), "blocks").cast("int")
    task = lambda b: F.xxhash64("cluster", b).alias("block")
    rest = ["class", F.col("class").alias("component"), F.lit(True).alias("query"), "text"]
    one = texts.select(task(place), *rest)
    large = not held.where("blocks > 1").isEmpty()
    if large:
        pivots = held.where("blocks > 1").groupBy("cluster", place.alias("p")).agg(F.min("class").alias("class")).where(F.col("p") < PIVOTS).select("cluster", "class")
        every = texts.where("blocks > 1").join(pivots, ["cluster", "class"]).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("to"))
        one = one.union(every.select(task(F.col("to")), *rest))
    links = _by_block(one, percent)

    if large:
        links = links.union(_across(texts.where("blocks > 1"), links, percent))
    joined = components(links)
    final = staged(reps.join(joined, reps["class"] == joined["node"], "left").select("set_key", "doc_id", "copies", "class", "component"))
    linked = final.where("component IS NOT NULL")
    smallest = staged(linked.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n")))
    named = spread_join(linked.select("set_key", "copies", "component"), smallest.drop("n"), "component", smallest)
    alone = final.where("component IS NULL").select("set_key", "copies", F.col("class").alias("component"), F.col("doc_id").alias("component_id"))
    return sketches, staged(named.select(alone.columns).union(alone))


def _texts(rows: DataFrame, held: DataFrame) -> DataFrame:
    """The text of each class in a cluster, once; of rows that share its doc_id and text hash, those with its shingle set."""

    def same(batches: Iterator) -> Iterator:
        import pyarrow as pa

        last = None
        for b in batches:
            ok = []
            for cls, key, text in zip(b["class"].to_pylist(), b["set_key"].to_pylist(), b["text"].to_pylist()):
                ok.append(cls != last and set_key(shingles(text)) == key)
                last = cls if ok[-1] else last
            yield b.select(["class", "cluster", "blocks", "n", "text"]).filter(pa.array(ok, pa.bool_()))

    # a merge join at every size: one class table that happens to be small must not change what is shuffled
    return rows.join(held.hint("merge"), ["doc_id", "text_hash"]).select("class", "cluster", "blocks", "n", "set_key", "text").mapInArrow(same, "class long, cluster long, blocks int, n long, text string")


def _across(texts: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Clusters of several blocks: all members outside the largest component against every block."""
    joined = components(links)
    now = staged(texts.select("class", "cluster", "blocks", "n").join(joined, texts["class"] == joined["node"], "left").select("class", "cluster", "n", F.coalesce("component", "class").alias("component")))
    sizes = now.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("size"))
    main = sizes.groupBy("cluster").agg(F.max(F.struct("size", "component"))["component"].alias("main"))
    now = now.join(main, "cluster").withColumn("query", F.col("component") != F.col("main"))
    slices = now.where("query").groupBy("cluster").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("slices"))
    now = staged(now.join(slices, "cluster").select("class", "component", "query", "slices"))
    rows = texts.join(now, "class")  # clusters that are one component are gone
    block, part = F.pmod(F.xxhash64("class"), "blocks"), F.pmod(F.xxhash64("class", F.lit(1)), "slices")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    task = lambda b, s: F.xxhash64("cluster", b, s, F.lit(2)).alias("block")
    members = rows.select("*", every("slices").alias("s")).select(task(block.cast("int"), F.col("s")), "class", "component", F.lit(False).alias("query"), "text")
    queries = rows.where("query").select("*", every("blocks").alias("s")).select(task(F.col("s"), part.cast("int")), "class", "component", "query", "text")
    return _by_block(members.union(queries), percent)


def near_groups(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Every row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Rows are linked when 100 * intersection >= percent * union of their distinct word-pair shingles.
    A text without words is linked with nothing. component_id is the smallest doc_id that links reach; a
    null doc_id is smaller than all others and comes out as null; kept says the row's doc_id is it, so
    rows that repeat it are kept. Other columns are not read; an empty table gives an empty result.
    """
    sketches, found = classes(docs, percent)
    some = spread_join(sketches.where("n_shingles > 0").select("doc_id", "n_shingles", "set_key"), found.select("set_key", "component_id"), "set_key", found.select("set_key", F.col("copies").alias("n")))
    none = sketches.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    rows = some.select("doc_id", "n_shingles", "component_id").union(none)
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c)).alias(c)
    return rows.select(real("doc_id"), "n_shingles", real("component_id"), (F.col("component_id") == F.col("doc_id")).alias("kept"))


def keep_one_of_each(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One row of each component of ``docs``, with all columns: that of the smallest doc_id (a null one is smaller
    than all others), of several that share it the one of the smallest text hash. Of rows with the same doc_id and
    text one stays, any of them. Rows without words all stay."""
    sketches, found = classes(docs, percent)
    key = F.struct("doc_id", "text_hash")
    least = sketches.where("n_shingles > 0").groupBy("set_key").agg(F.min(key).alias("least"))
    elected = staged(found.join(least, "set_key").groupBy("component").agg(F.min("least").alias("elected"), F.count(F.lit(1)).alias("n")))
    chosen = staged(spread_join(found.select("set_key", "copies", "component"), elected.drop("n"), "component", elected).select("set_key", "copies", "elected"))
    every = sketches.where("n_shingles > 0").select("doc_id", "text_hash", "set_key")
    rows = staged(spread_join(every, chosen.drop("copies"), "set_key", chosen.select("set_key", F.col("copies").alias("n"))).select("doc_id", "text_hash", (key == F.col("elected")).alias("kept")))
    gone = rows.where("NOT kept").select("doc_id", "text_hash").distinct()
    again = staged(rows.where("kept").groupBy("doc_id", "text_hash").count().where("count > 1").drop("count"))
    names, own_id, own_hash, whole = docs.columns, fresh(docs, "id"), fresh(docs, "hash"), fresh(docs, "whole")
    every = docs.select(*[column(docs, n) for n in names], F.coalesce(column(docs, "doc_id").cast("long"), F.lit(NULL_ID)).alias(own_id), F.xxhash64(column(docs, "text").cast("string")).alias(own_hash))

    def on(keys: DataFrame) -> Column:
        return (every[own_id] == keys["doc_id"]) & (every[own_hash] == keys["text_hash"])

    if again.isEmpty():
        kept = every.join(gone, on(gone), "left_anti")
        return kept.select(*[column(kept, n) for n in names])
    # rows that repeat as they are: one of each by a partial aggregate, so that a frequent one is folded where it lies
    both = gone.union(again)
    kept = every.join(both, on(both), "left_anti")
    some = every.join(again, on(again), "left_semi")
    once = some.groupBy(own_id, own_hash).agg(F.first(F.struct(*[column(some, n) for n in names])).alias(whole))
    return kept.select(*[column(kept, n) for n in names]).union(once.select(*[F.col(whole)[n].alias(n) for n in names]))
