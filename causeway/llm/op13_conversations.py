"""Conversation structure repair: least-cost edits by a parallel Viterbi search that relies on rank convergence.

A conversation's rows must read ``(s?(ua)+)?`` in role initials. The search is a min-plus recurrence over four states, run
backwards. Rows are sorted by conversation over range partitions and cut into chunks, so that one conversation may span many
tasks. All chunks but the last of a conversation start from a speculative vector of costs; fix-up passes run a chunk again from
what the chunk after it gives, until both differ only by a constant, which alters no choice. Stitched constants give the
true costs. Tracing then goes forward: each chunk finds the end state of every start state, these maps are chained, and
each chunk writes its least edits.

Defined results: a null text, role or id reads as one space in the key and in the row; the null conversation is one of its own. Rows of equal
turn are ordered by role and text; null turns come first. A role's initial is its first character, an empty role has none and fits nowhere.
Repeated rows are duplicates. A conversation without rows after the damage has zeros, an empty audit and the hash of
nothing. An empty table gives no rows. The hash of a conversation is taken by one task that reads its pieces in order, for SHA-256 has no other way; it
holds a piece at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import narrow, small_batches, spread_join, staged

#: Rows and bytes of a chunk.
CHUNK_ROWS, CHUNK_BYTES = 4096, 4 << 20
BLANKS = " \t\n\v\f\r"
#: States: nothing yet, after the system row, after a user row, after an assistant row. Kept initials lead on; an edit that gives a role gives the one wanted.
LEADS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
WANTED = (2, 2, 3, 2)
NAMES = {1: "system", 2: "user", 3: "assistant"}
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
NEVER = 1 << 60
#: What a row's byte holds: its initial, and its faults.
INITIALS = "sua?"
BLANK, DUPLICATE, CUT = 4, 8, 16

_CHUNK = "conv_id long, part int, seq int, alone boolean, rows int, codes binary, digests binary, roles array<string>, texts array<string>, turns struct<low long, high long, kinds long, first long, last long>"


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, there: each row as its key's checksum has it; a dropped row stays as a mark without content."""
    rows = narrow(rows, conv_id="long", turn="long", role="string", text="string")
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")) % 20
    role, text = plain("role"), plain("text")
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    out = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"), (kind != 0).alias("there"), F.when(kind == 3, 2).otherwise(1).alias("times"))
    gone = lambda c: F.when(F.col("there"), F.col(c))
    return out.select("conv_id", gone("turn").alias("turn"), gone("role").alias("role"), gone("text").alias("text"), "there", F.explode(F.sequence(F.lit(1), "times")).alias("copy"))


def repair(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """rows (conv_id, turn, role, text), damaged -> one row a conversation: faults, cost, audit and the digest of the repaired text."""
    spark = rows.sparkSession
    small_batches(spark)
    chunks = staged(_chunks(damage(rows), chunk_rows))
    several = _duplicates(chunks.where("not alone").select("conv_id", "part", "seq", "rows", "codes", "digests"))
    plan = _states(several, _converged(several))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = chunks.where("not alone").drop("codes").join(plan, ["part", "seq"]).mapInArrow(_finish, _PIECE)
    joined = pieces.repartition(tasks, "conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(_stitch, _RESULT)
    nothing = {"after": F.lit(None).cast("array<long>"), "shift": F.lit(0).cast("long"), "last": F.lit(True), "state": F.lit(0)}
    whole = chunks.where("alone").withColumns(nothing).mapInArrow(_finish, _PIECE)
    return whole.select(*[c.split()[0] for c in _RESULT.split(", ")]).unionByName(joined)


def _chunks(rows: DataFrame, chunk_rows: int) -> DataFrame:
    """Rows in order, as one row a chunk. Equal rows are dealt over tasks by a random number; their order among each other doesn't matter."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("deal", F.rand(13)).repartitionByRange(tasks, "conv_id", "turn", "role", F.substring("text", 1, 64), "deal")
    in_order = dealt.sortWithinPartitions("conv_id", "turn", "role", "text").drop("deal", "copy")
    return in_order.mapInArrow(_cut(chunk_rows), _CHUNK)


def _cut(chunk_rows: int):
    """Chunks of rows in order. ``alone``: the conversation surely has no other chunk; the first and last ones of a task may go on elsewhere."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, seq, first = TaskContext.get().partitionId(), 0, True
        schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("alone", pa.bool_()), ("rows", pa.int32()), ("codes", pa.binary()), ("digests", pa.binary()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("turns", _turns())])
        out, held, now, size, split = [], 0, None, 0, False

        def close(alone: bool) -> None:
            nonlocal seq
            known = [t for t in now.pop("turns") if t is not None]
            turns = {"low": min(known, default=None), "high": max(known, default=None), "kinds": len(set(known)), "first": known[0] if known else None, "last": known[-1] if known else None}
            out.append(now | {"part": part, "seq": seq, "alone": alone, "turns": turns, "codes": bytes(now["codes"]), "digests": b"".join(now["digests"]), "rows": len(now["codes"])})
            seq += 1

        for b in batches:
            for conv, turn, role, text, there in zip(*(b[c].to_pylist() for c in ("conv_id", "turn", "role", "text", "there"))):
                if now is None or now["conv_id"] != conv or len(now["codes"]) >= chunk_rows or size >= CHUNK_BYTES:
                    if now is not None:
                        same = now["conv_id"] == conv
                        close(not same and not split and not first)
                        first, split, held = first and same, same, held + size
                        if len(out) >= 256 or held >= CHUNK_BYTES:
                            yield pa.RecordBatch.from_pylist(out, schema=schema)
                            out, held = [], 0
                    now, size = {"conv_id": conv, "codes": bytearray(), "digests": [], "roles": [], "texts": [], "turns": []}, 0
                    seen = set()
                if not there:
                    continue
                end = text.rstrip(BLANKS)[-1:]
                digest = hashlib.sha256(b"%d:%s%s" % (len(role), role.encode(), text.encode())).digest()[:16]
                code = INITIALS.index(role[0]) if role[:1] in ("s", "u", "a") else 3
                now["codes"].append(code | (BLANK if not end else 0 if end in ".!?" else CUT) | (DUPLICATE if digest in seen else 0))
                seen.add(digest)
                for name, value in (("digests", digest), ("roles", role), ("texts", text), ("turns", turn)):
                    now[name].append(value)
                size += len(text)
        if now is not None:
            close(False)
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def _turns():
    import pyarrow as pa

    return pa.struct([(n, pa.int64()) for n in ("low", "high", "kinds", "first", "last")])


def _duplicates(chunks: DataFrame) -> DataFrame:
    """conv_id, part, seq, codes of chunks (without texts), with a mark on each row that an earlier chunk of its conversation has: they meet by digest."""
    digest = F.expr("substring(digests, k * 16 + 1, 16)")
    rows = chunks.where("rows > 0").select("conv_id", "part", "seq", "digests", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("k"))
    rows = staged(rows.select(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).cast("binary"), F.lit(b":"), digest).alias("key"), F.struct("part", "seq", "k").alias("at")))
    counts = rows.groupBy("key").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1")
    later = spread_join(rows, counts.select("key", "first"), "key", counts).where("at > first")
    marks = later.groupBy("at.part", "at.seq").agg(F.collect_list("at.k").alias("later"))
    return staged(chunks.select("conv_id", "part", "seq", "codes").join(marks, ["part", "seq"], "left").mapInArrow(_mark, "conv_id long, part int, seq int, codes binary"))


def _mark(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for b in batches:
        marked = []
        for codes, later in zip(b["codes"].to_pylist(), b["later"].to_pylist()):
            codes = bytearray(codes)
            for k in later or ():
                codes[k] |= DUPLICATE
            marked.append(bytes(codes))
        yield pa.RecordBatch.from_arrays([b["conv_id"], b["part"], b["seq"], pa.array(marked, pa.binary())], ["conv_id", "part", "seq", "codes"])


def _filled(vector: list[int]) -> tuple[int, ...]:
    """Least costs where rows may be inserted first."""
    for _ in range(3):
        vector = [min(c, INSERT + vector[WANTED[s]]) for s, c in enumerate(vector)]
    return tuple(vector)


#: The costs behind a conversation's last row: nothing or whole pairs are right.
END = _filled([0, NEVER, NEVER, 0])


def _edits(code: int, state: int) -> list[tuple[str, int, int]]:
    """The edits of a row in a state, least initial first, as (initial, cost, next state). Inserts are apart: they take no row."""
    out = [("D", DELETE, state)]
    if not code & (BLANK | DUPLICATE):
        more = TRUNCATED if code & CUT else 0
        to = LEADS[state].get(INITIALS[code & 3])
        out += [("K", more, to)] if to is not None else []
        out.append(("R", REROLE + more, WANTED[state]))
    return out


_STEPS: dict[tuple[int, tuple[int, ...]], tuple[int, ...]] = {}


def _step(code: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """The vector before a row from that after it. Vectors are few once their least cost is taken off."""
    least = min(after)
    key = code, tuple(c - least for c in after)
    if key not in _STEPS:
        _STEPS[key] = _filled([min(cost + key[1][to] for _, cost, to in _edits(code, s)) for s in range(4)])
    return tuple(c + least for c in _STEPS[key])


def _backward(codes: bytes, end: tuple[int, ...]) -> list[tuple[int, ...]]:
    """The vectors before each row, and behind the last."""
    out = [end]
    for code in reversed(codes):
        out.append(_step(code, out[-1]))
    return out[::-1]


def _trace(codes: bytes, costs: list[tuple[int, ...]], state: int, last: bool) -> tuple[str, list[tuple[int, int]], int]:
    """The least edits from a state: their initials, (row or -1, state given or -1) of each row of the result, the end state. Inserts behind
    the last row belong to the next chunk, if there is one."""
    audit, out, k = [], [], 0
    while k < len(codes) or last and costs[k][state] > 0:
        options = [(i, c, to, k + 1) for i, c, to in _edits(codes[k], state)] if k < len(codes) else []
        initial, _, to, row = next(o for o in sorted([*options, ("I", INSERT, WANTED[state], k)]) if o[1] + costs[o[3]][o[2]] == costs[k][state])
        audit.append(initial)
        if initial != "D":
            out.append((-1 if initial == "I" else k, to if initial != "K" else -1))
        state, k = to, row
    return "".join(audit), out, state


def _converged(several: DataFrame) -> DataFrame:
    """part, seq, after, shift, last: for each chunk of a conversation with several the vector behind it, right but for the constant ``shift``."""
    light = several.select("conv_id", "part", "seq", "codes")
    begin = F.array(*[F.lit(c).cast("long") for c in END])
    known = staged(light.withColumn("after", begin).mapInArrow(_pass, "conv_id long, part int, seq int, after array<long>, before array<long>"))
    order = Window.partitionBy("conv_id").orderBy("part", "seq")
    while True:
        seen = known.select("*", F.lead("before").over(order).alias("given"))
        seen = seen.select("conv_id", "part", "seq", "after", "before", F.coalesce("given", begin).alias("wanted"), F.col("given").isNull().alias("last"))
        gap = F.col("wanted")[0] - F.col("after")[0]
        same = F.forall(F.sequence(F.lit(0), F.lit(3)), lambda k: F.col("wanted")[k] - F.col("after")[k] == gap)
        seen = staged(seen.select("*", gap.alias("gap"), same.alias("same")))
        again = seen.where("not same")
        if not again.limit(1).count():
            break
        more = light.join(again.select("part", "seq", F.col("wanted").alias("after")), ["part", "seq"]).select(*light.columns, "after")
        known = staged(seen.where("same").select("conv_id", "part", "seq", "after", "before").union(more.mapInArrow(_pass, "conv_id long, part int, seq int, after array<long>, before array<long>")))
    back = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return seen.select("part", "seq", "after", F.sum("gap").over(back).alias("shift"), "last")


def _pass(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for b in batches:
        before = [_backward(codes, tuple(after))[0] for codes, after in zip(b["codes"].to_pylist(), b["after"].to_pylist())]
        yield pa.RecordBatch.from_arrays([b["conv_id"], b["part"], b["seq"], b["after"], pa.array(before, pa.list_(pa.int64()))], ["conv_id", "part", "seq", "after", "before"])


def _states(several: DataFrame, vectors: DataFrame) -> DataFrame:
    """Adds the state in which each chunk begins: the chunks' maps from start to end states, chained in order. A chunk is one light row here."""
    light = several.select("conv_id", "part", "seq", "codes").join(vectors, ["part", "seq"])
    maps = light.mapInArrow(_ends, "conv_id long, part int, seq int, codes binary, after array<long>, shift long, last boolean, ends array<int>")
    tasks = int(several.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_order = maps.repartition(tasks, "conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return staged(in_order.mapInArrow(_chain, "part int, seq int, codes binary, after array<long>, shift long, last boolean, state int"))


def _ends(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for b in batches:
        ends = []
        for codes, after, last in zip(b["codes"].to_pylist(), b["after"].to_pylist(), b["last"].to_pylist()):
            costs = _backward(codes, tuple(after))
            ends.append([_trace(codes, costs, s, last)[2] for s in range(4)])
        yield pa.RecordBatch.from_arrays([*(b[c] for c in ("conv_id", "part", "seq", "codes", "after", "shift", "last")), pa.array(ends, pa.list_(pa.int32()))], ["conv_id", "part", "seq", "codes", "after", "shift", "last", "ends"])


def _chain(batches: Iterator) -> Iterator:
    import pyarrow as pa

    now, state = (), 0
    for b in batches:
        states = []
        for conv, ends in zip(b["conv_id"].to_pylist(), b["ends"].to_pylist()):
            if (conv,) != now:
                now, state = (conv,), 0
            states.append(state)
            state = ends[state]
        names = ["part", "seq", "codes", "after", "shift", "last"]
        yield pa.RecordBatch.from_arrays([*(b[c] for c in names), pa.array(states, pa.int32())], [*names, "state"])


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_PIECE = _RESULT + ", part int, seq int, alone boolean, initials string, lines int, body binary, turns struct<low long, high long, kinds long, first long, last long>"


def _finish(batches: Iterator) -> Iterator:
    """Each chunk's counts, least edits and repaired rows. A conversation's only chunk gives its whole result, others a piece of it."""
    import pyarrow as pa

    schema = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in _COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("alone", pa.bool_()), ("initials", pa.string()), ("lines", pa.int32()), ("body", pa.binary()),
                        ("turns", _turns())])
    for b in batches:
        pieces = []
        for r in b.to_pylist():
            codes, alone = r["codes"], r["alone"]
            state, costs = r["state"], _backward(codes, tuple(r["after"] or END))
            audit, rows, _ = _trace(codes, costs, state, r["last"])
            text = "\n".join(f"{r['roles'][k] if to < 0 else NAMES[to]}:{r['texts'][k] if k >= 0 else ''}" for k, to in rows).encode()
            initials = "".join(INITIALS[c & 3] for c in codes)
            turns = r["turns"]
            pieces.append({
                "conv_id": r["conv_id"], "gaps": (turns["high"] - turns["low"] + 1 - turns["kinds"]) if turns["kinds"] else 0, "blank": sum(1 for c in codes if c & BLANK), "duplicate": sum(1 for c in codes if c & DUPLICATE and not c & BLANK),
                "truncated": sum(1 for c in codes if c & CUT and not c & DUPLICATE), "illegal": _illegal(initials), "cost": costs[0][state] + r["shift"], "audit": audit, "repaired_sha256": hashlib.sha256(text).hexdigest() if alone else None,
                "part": r["part"], "seq": r["seq"], "alone": alone, "initials": initials[:1] + initials[-1:], "lines": len(rows), "body": None if alone else text, "turns": turns,
            })
        yield pa.RecordBatch.from_pylist(pieces, schema=schema)


def _illegal(initials: str) -> int:
    return sum(initials[k : k + 2] not in ("su", "ua", "au") for k in range(len(initials) - 1))


def _stitch(batches: Iterator) -> Iterator:
    """One row for each conversation of several pieces, which come in order."""
    import pyarrow as pa

    schema = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in _COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    now, whole = (), None

    def result():
        low, high = whole["low"], whole["high"]
        row = {c: whole[c] for c in _COUNTS} | {"conv_id": now[0], "gaps": high - low + 1 - whole["kinds"] if whole["kinds"] else 0, "audit": "".join(whole["audit"]), "repaired_sha256": whole["hash"].hexdigest()}
        return pa.RecordBatch.from_pylist([row], schema=schema)

    for b in batches:
        for r in b.to_pylist():
            if (r["conv_id"],) != now:
                if whole:
                    yield result()
                now = (r["conv_id"],)
                whole = dict.fromkeys(_COUNTS, 0) | {"cost": r["cost"], "audit": [], "hash": hashlib.sha256(), "lines": 0, "low": None, "high": None, "kinds": 0, "end": "", "turn": None}
            for c in ("blank", "duplicate", "truncated", "illegal"):
                whole[c] += r[c]
            own = r["initials"]
            if own:
                whole["illegal"] += _illegal(whole["end"] + own[0])
                whole["end"] = own[-1]
            t = r["turns"]
            if t["kinds"]:  # turns come in order, so only the last one of a piece can go on in the next
                whole["low"], whole["high"] = t["low"] if whole["low"] is None else whole["low"], t["high"]
                whole["kinds"] += t["kinds"] - (t["first"] == whole["turn"])
                whole["turn"] = t["last"]
            whole["audit"].append(r["audit"])
            if r["lines"]:
                whole["hash"].update((b"\n" if whole["lines"] else b"") + r["body"])
                whole["lines"] += r["lines"]
    if whole:
        yield result()

