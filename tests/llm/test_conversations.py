"""The repair of conversations against a plain search over edit strings."""

import hashlib
import zlib
from itertools import groupby

import pytest

from causeway.llm.op13_conversations import repair

BLANKS = " \t\n\v\f\r"


def brute(rows):
    """rows (conv_id, turn, role, text) -> conv_id: the contract's values, by one search over whole conversations."""
    out, by = {}, {}
    for conv, turn, role, text in rows:
        plain = [" " if x is None else x for x in (conv, turn, role, text)]
        kind = zlib.crc32(f"{plain[0]}:{plain[1]}".encode()) % 20
        role, text = plain[2], plain[3]
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        own = by.setdefault(conv, [])
        if kind != 0:
            own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv, own in by.items():
        own.sort(key=lambda r: ((r[0] is not None, r[0] or 0), r[1].encode(), r[2].encode()))
        faults, seen = [], set()
        for _, role, text in own:
            end = text.rstrip(BLANKS)[-1:]
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        initials = [r[:1] for _, r, _ in own]
        cost, audit, text = search(own, faults)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest(),
        )
    return out


def search(own, faults):
    """From the last row on, for each place in ``(s?(ua)+)?``: the cheapest and then least edits. Places: 0 nothing, 1 after s, 2 after u, 3 after a."""
    after = {0: (0, "", []), 2: (5, "I", ["assistant:"]), 3: (0, "", []), 1: (10, "II", ["user:", "assistant:"])}
    want = {0: "u", 1: "u", 2: "a", 3: "u"}
    place = {"s": 1, "u": 2, "a": 3}
    name = {"u": "user", "a": "assistant"}
    for (_, role, text), fault in zip(reversed(own), reversed(faults)):
        now = {}
        for p in range(4):
            c, a, t = after[p]
            options = [(c + 2, "D" + a, t)]
            if fault not in ("blank", "duplicate"):
                more = 5 if fault else 0
                if role[:1] == want[p] or (p == 0 and role[:1] == "s"):
                    c, a, t = after[place[role[0]]]
                    options.append((c + more, "K" + a, [f"{role}:{text}", *t]))
                c, a, t = after[place[want[p]]]
                options.append((c + more + 1, "R" + a, [f"{name[want[p]]}:{text}", *t]))
            now[p] = min(options)
        for _ in range(4):
            for p in range(4):
                c, a, t = now[place[want[p]]]
                now[p] = min(now[p], (c + 5, "I" + a, [f"{name[want[p]]}:", *t]))
        after = now
    return after[0]


def check(spark, rows, **more):
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r[0]: tuple(r[1:]) for r in repair(table, **more).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    wrong = {c: (got[c], want[c]) for c in got if got[c] != want[c]}
    assert not wrong, list(wrong.items())[:3]


def test_whole_table(spark, small):
    from causeway.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    frame = QUERIES["op13_rank_convergence_repair"](spark, small)
    assert {r[0]: tuple(r[1:]) for r in frame.collect()} == brute(rows)


@pytest.mark.parametrize("chunk_rows", [1, 3, 4096])
def test_edges_and_ties(spark, chunk_rows):
    import random

    rng = random.Random(5)
    roles = ["system", "user", "assistant", "tool", "", None, "ux", "User"]
    texts = ["Yes.", "No?", "and then", "", None, " \n", "Ä!", "So. ", "x" * 5000]
    rows = [(rng.choice([1, 2, 3, 4, None, 6]), rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for _ in range(160)]
    rows += [(7, t, "user", "Again.") for t in range(40)] + [(8, None, None, None)] * 5 + [(9, 4, "assistant", "Only.")]
    rows += [(c, 0, "user", "Gone.") for c in range(100, 160)]  # some of these lose their only row
    check(spark, rows, chunk_rows=chunk_rows)


def test_one_conversation_over_all_tasks(spark):
    """Speculation is wrong at first for some chunks: long runs that only one parity of the remaining rows decides."""
    import random

    rng = random.Random(9)
    rows = [(1, t, ("user", "assistant")[t % 2], f"Row {t}.") for t in range(600)] + [(1, 600 + t, "user", f"More {t}.") for t in range(5)]
    rows += [(2, t, rng.choice(["user", "assistant", "system"]), rng.choice([f"Row {t}.", f"Row {t}", "Same."])) for t in range(700)]
    check(spark, rows, chunk_rows=7)


def test_empty_and_clashing_columns(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair(none).count() == 0
    more = spark.createDataFrame([(1, 0, "user", "Hi.", 1, "x"), (1, 1, "assistant", "Yes.", 2, "y")], "conv_id long, turn long, role string, text string, part int, codes string")
    assert repair(more).columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert [r[0] for r in groupby(sorted(r.conv_id for r in repair(more).collect()))] == [1]
