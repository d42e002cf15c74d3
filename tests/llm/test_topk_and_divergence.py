"""Exact top-k and the source audit on small tables: plain loops, odd values, ties, repeated rows, empty tables, clashing names."""

import math
from collections import Counter, defaultdict

import pytest

from causeway.llm import op12_divergence
from causeway.llm.op11_topk import top_k
from causeway.llm.op12_divergence import audit


def top_brute(rows, k=5, every=50):
    sound = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {(i, tuple(v)) for i, v in sound if i % every == 0}:
        found = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in sound if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_top_k_odd_rows(spark):
    import random

    rng = random.Random(3)
    f = lambda: rng.choice([0.0, -0.5, 0.25, 1.0, -3.0])
    rows = [(i, [f() for _ in range(rng.choice([0, 3, 9, 9, 9]))]) for i in range(0, 1500, 10)]
    rows += [(1, None), (100, [None, 1.0]), (150, [float("nan")]), (3, [float("inf")]), (None, [1.0]), (200, [1.0] * 9), (5, [1.0] * 9), (5, [1.0] * 9), (-50, [0.5] * 9)]
    got = sorted(tuple(r) for r in top_k(vectors(spark, rows)).collect())
    assert got == top_brute(rows)


@pytest.mark.parametrize("rows", [[], [(0, [1.0])], [(50, None)], [(0, [1.0]), (50, [2.0])], [(3, [1.0]), (7, [2.0])]])
def test_top_k_few_rows(spark, rows):
    assert sorted(tuple(r) for r in top_k(vectors(spark, rows)).collect()) == top_brute(rows)


def test_top_k_many_equal_vectors_and_large_numbers(spark):
    same = [(i, [0.5, 0.25, -1.0, 2.0]) for i in range(400)]
    assert sorted(tuple(r) for r in top_k(vectors(spark, same)).collect()) == top_brute(same)
    large = [(i, [float(2**21 + i), -float(i * 2**15), 3.0]) for i in range(120)]  # products beyond 53 bits
    assert sorted(tuple(r) for r in top_k(vectors(spark, large)).collect()) == top_brute(large)
    with pytest.raises(ValueError):
        top_k(vectors(spark, [(0, [1e30]), (1, [1e30])]))


def test_top_k_blocks_and_clashing_names(spark, monkeypatch):
    import random

    from causeway.llm import op11_topk

    monkeypatch.setattr(op11_topk, "BLOCK_NUMBERS", 16 * 12)
    rng = random.Random(8)
    centres = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, 0.1) for x in rng.choice(centres)]) for i in range(900)]
    table = spark.createDataFrame([(*r, 1, "s") for r in rows], "vec_id long, embedding array<float>, g int, number string")
    exact = [(r.vec_id, r.embedding) for r in table.collect()]
    assert sorted(tuple(r) for r in top_k(table, every=3).collect()) == top_brute(exact, every=3)


def audit_brute(rows, least=10, top=10):
    import re

    df, count, groups = Counter(), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        groups.add((lang, source))
        df.update((lang, t) for t in set(terms))
        count[lang, source].update(terms)
    out = []
    for lang, source in groups:
        kept = [t for (x, t), n in df.items() if x == lang and n >= least]

        def shares(counts, kept=kept):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p = shares(count[lang, source])
        q = shares(sum((count[g] for g in groups if g[0] == lang), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        pairs = []
        for x, other in groups:
            if x == lang and other != source:
                r = shares(count[x, other])
                pairs.append((-sum(f(p[t], r[t]) for t in kept), other.encode()))
        terms = [(-f(p[t], q[t]), t.encode()) for t in kept if count[lang, source][t] and p[t] > q[t]]
        out += [(lang, source, "pair", i.decode(), -v, k + 1) for k, (v, i) in enumerate(sorted(pairs))]
        out += [(lang, source, "term", i.decode(), -v, k + 1) for k, (v, i) in enumerate(sorted(terms)[:top])]
    return sorted(out)


def texts(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string, source string")


def odd_texts():
    import random

    rng = random.Random(4)
    words = [*"abcdefgh", "Über", "ÜBER", "中文", "don't", "X1Y", "é"]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(12))), rng.choice(["en", "en", "de", None]), rng.choice(["s1", "s2", "s3", "", None, "é"])) for _ in range(300)]
    rows += [("same text here", "en", s) for s in ("s1", "s1", "s2", "s9")] * 8 + [(None, "en", "s1"), (None, None, None), ("word " * 40_000, "en", "long"), ("rare", "fr", "only"), ("", "fr", "other")]
    return rows


def test_audit_odd_rows(spark, monkeypatch):
    rows = odd_texts()
    assert sorted(tuple(r) for r in audit(texts(spark, rows)).collect()) == audit_brute(rows)
    monkeypatch.setattr(op12_divergence, "HELD", 20)
    monkeypatch.setattr(op12_divergence, "PAIRS_AT_ONCE", 3)
    monkeypatch.setattr(op12_divergence, "SENT_DIGESTS", 0)
    assert sorted(tuple(r) for r in audit(texts(spark, rows), least=3, top=4).collect()) == audit_brute(rows, 3, 4)


def test_audit_empty_and_clashing_names(spark):
    assert audit(texts(spark, [])).count() == 0
    rows = [("a b", "en", "x"), ("a c", "en", "y"), (None, "de", "x")]
    more = spark.createDataFrame([(*r, 1, "t") for r in rows], "text string, lang string, source string, h int, term string")
    assert sorted(tuple(r) for r in audit(more).collect()) == audit_brute(rows)
    assert sorted(tuple(r) for r in audit(more, least=1).collect()) == audit_brute(rows, 1)
