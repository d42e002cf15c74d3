"""The training-data operators on small tables with nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.llm import common
from causeway.llm import op1_token_store as tok
from causeway.llm import op2_packing, op3_warc, op4_decontaminate, op5_hilbert, op6_language, op7_license, op8_near_dedup, op9_surrogates, op10_lsm_dedup
from causeway.llm.graph import components
from causeway.llm.queries import tokenizer

COLS = "doc_id long, text string, lang string, source string, n_chars long, row string, key long, class string, block int, size string, window string, shard string, found string"


def table(spark, rows):
    """rows: (doc_id, text[, lang, source]); other columns clash with working names."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, 1, "x", 7, "c", 3, "s", "w", "h", "f") for r in rows]
    return spark.createDataFrame(full, COLS)


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    long = prose(rng, 4000)
    base = prose(rng, 60).split()
    near = [" ".join(base[:k] + ["changed"] + base[k + 1 :]) for k in range(0, 60, 3)]
    rows = [(1, None), (2, ""), (3, "   \n "), (4, "One"), (5, "one"), (6, long), (7, long.upper()), (7, long.upper()), (None, "null id text here"), (None, "null id text here")]
    rows += [(20 + k, t) for k, t in enumerate(near)] + [(60 + k, prose(rng, 30)) for k in range(10)] + [(90, " ".join(base)), (91, " ".join(base[:30])), (92, "Ça déjà vu\n\n  là "), (93, "\U0001f642   x<|endoftext|>y")]
    return table(spark, rows).persist()


def local(df):
    return [r.asDict() for r in df.collect()]


def plain(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_elias_fano():
    rng = np.random.default_rng(2)
    for n, top in ((1, 0), (2, 5), (1000, 10), (1000, 10**6), (300, 10**12)):
        v = np.sort(rng.integers(0, top + 1, n))
        ef = tok.EliasFano.encode(v)
        assert (ef.select(np.arange(n)) == v).all()
        some = rng.permutation(n)[:50]
        assert (ef.select(some) == v[some]).all()
        assert len(ef.low) + len(ef.high) <= n * (2 + max(0, np.log2(max(top / n, 1)) + 1)) / 8 + 16


def test_token_store(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    got = sorted(local(tok.token_store(docs, tokenizer("byte_bpe_50k.json"), 2)), key=lambda r: r["start"])
    assert len(got) == docs.count()
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
    want = {}
    for d, text in plain(docs):
        x = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        want.setdefault(d, []).append((len(x), zlib.crc32(x.tobytes())))
    at = 0
    for r in got:
        assert r["start"] == at
        want[r["doc_id"]].remove((r["n_tokens"], r["ids_crc32"]))
        at += r["n_tokens"]
    assert tok.token_store(docs.limit(0), tokenizer("byte_bpe_50k.json"), 2).count() == 0


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    sub = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    want = {d: np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4") for d, x in plain(sub)}
    got, seqs, seen = local(op2_packing.pack(sub, tokenizer("word_bpe_49k.json"), 1)), {}, {d: 0 for d in want}
    for r in sorted(got, key=lambda r: (r["doc_id"], r["start"])):
        ids = want[r["doc_id"]]
        assert r["start"] == seen[r["doc_id"]] and r["doc_tokens"] == len(ids)
        assert zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        seen[r["doc_id"]] += r["length"]
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert seen == {d: len(x) for d, x in want.items()}
    for pieces in seqs.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
    assert op2_packing.pack(docs.limit(0), tokenizer("word_bpe_49k.json"), 1).count() == 0


def test_sum_of_squares_rule():
    rng = random.Random(3)
    s = op2_packing.SumOfSquares(32)
    for _ in range(400):
        n, before = rng.randrange(1, 32), s.counts.copy()
        s.place(n, (n,))
        options = []
        for h in [0, *[h for h in range(1, 33 - n) if before[h]]]:
            c = before.copy()
            if h:
                c[h] -= 1
            if h + n < 32:
                c[h + n] += 1
            options.append(int((c**2).sum()))
        assert int((s.counts[:32] ** 2).sum()) == min(options)


def test_packing_of_null_and_repeated_ids(spark):
    """Every row is a document of its own, whatever its doc_id: each has its ids in pieces from 0 to its length, windows are gapless."""
    from tokenizers import Tokenizer

    path, rng = tokenizer("word_bpe_49k.json"), random.Random(12)
    texts = [(None, "same text"), (None, "same text"), (None, None), (3, "same text"), (3, "same text"), (3, ""), (3, prose(rng, 1500)), (None, prose(rng, 2500)), (-1, "x")]
    plain_ids = [Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids + [1] for _, t in texts]
    got = local(op2_packing.pack(table(spark, texts), path, 1))
    shown = lambda x: str(x)  # noqa: E731  null ids sort as text
    whole = sorted((shown(d), len(i)) for (d, _), i in zip(texts, plain_ids))
    assert sorted((shown(r["doc_id"]), r["doc_tokens"]) for r in got if r["start"] == 0) == whole
    for key in set(whole):
        rows = sorted((r["start"], r["length"]) for r in got if (shown(r["doc_id"]), r["doc_tokens"]) == key)
        assert sum(n for _, n in rows) == key[1] * whole.count(key)
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    ids_of = {(shown(d), len(i)): i for (d, _), i in zip(texts, plain_ids)}
    assert all(r["ids_crc32"] == crc(ids_of[shown(r["doc_id"]), r["doc_tokens"]][r["start"] : r["start"] + r["length"]]) for r in got)
    windows = {}
    for r in got:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in windows.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048


def test_warc(spark):
    body = "<p>same</p>" * 5
    rows = [(5, "http://a", body), (3, "http://b c", body), (9, None, body), (1, "http://d", None), (2, "http://e", ""), (4, "x", "é"), (None, "y", "é"), (6, "z", "WARC/1.1\r\n\r\nx" * 50_000)]
    got = {r["page_id"]: r for r in local(op3_warc.warc(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))))}
    assert len(got) == len(rows)
    assert [(p, got[p]["record_type"], got[p]["refers_to"]) for p in (3, 5, 9)] == [(3, "response", None), (5, "revisit", 3), (9, "revisit", 3)]
    assert (got[1]["record_type"], got[2]["refers_to"], got[1]["payload_bytes"]) == ("response", 1, 0)
    assert got[1]["payload_digest"] == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    assert (got[None]["record_type"], got[4]["record_type"], got[4]["payload_bytes"]) == ("response", "revisit", 2)
    # rows that repeat and null page_ids have records of their own
    twice = local(op3_warc.warc(spark.createDataFrame([(1, "u", "x"), (1, "u", "x"), (None, "v", "y"), (None, "w", "y"), (2, "z", "x"), (3, "z", "y")], "page_id long, url string, html string")))
    assert len({r["record_id"] for r in twice}) == 6 and sorted((str(r["page_id"]), r["record_type"], str(r["refers_to"])) for r in twice) == [("1", "response", "None")] * 2 + [("2", "revisit", "1"), ("3", "revisit", "None")] + [("None", "response", "None")] * 2
    small = op3_warc.warc(spark.createDataFrame(rows[:3], "page_id long, url string, html string"), min_bytes=1000)
    assert {r.record_type for r in small.collect()} == {"response"}
    assert op3_warc.warc(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_with_and_without_bitmap(spark, monkeypatch):
    """Revisits are the same where the bitmap of revisits is given up, and where it takes every page for one."""
    rng = random.Random(3)
    rows = [(k % 190 if k % 50 else None, f"u{k}", f"page {rng.randrange(60)} " * (1 + k % 3)) for k in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    shown = lambda: sorted((str(r.page_id), r.url, r.payload_digest, r.record_type, str(r.refers_to), r.payload is None) for r in op3_warc.resolve(pages).collect())
    want = shown()
    assert len(want) == 300 and all((kind == "revisit") == (to != "None" or bare) for _, _, _, kind, to, bare in want)
    monkeypatch.setattr(common, "FILTER_HASHES", 0)
    assert shown() == want
    monkeypatch.undo()
    monkeypatch.setattr(op3_warc, "bitmap_of", lambda *_: np.full(16, 0xFF, np.uint8))
    assert shown() == want


def test_decontamination(spark):
    item = "A train leaves Paris at 60 km per hour and meets Anna after 3 hours near the river bridge"
    other = item.replace("60", "75").replace("Paris", "Rome").replace("Anna", "Olga").replace("after 3", "after 5")
    mixed = item.replace("Paris", "Rome")
    bench = spark.createDataFrame([(1, item), (2, "short one"), (3, None), (4, "what is the sum"), (5, "Compute 3 + 5"), (6, "Is 17 prime"), (7, "42")], "item_id long, text string")
    rows = [(10, "Some text before. " + item + " and after."), (11, "x " + other + " y"), (12, "A train of thought that never leaves the station at all, and that is that"), (13, None), (14, ""), (15, mixed), (16, "say what is the sum of it"), (10, "clean twin"),
            (17, "To warm up: compute 3 + 5, then rest."), (18, "is 17 prime?"), (19, "Short one."), (20, "a short one here"), (21, "42"), (22, "42 more")]
    got = {(r["doc_id"], r["item_id"]): r for r in local(op4_decontaminate.contaminations(table(spark, rows), bench))}
    assert set(got) == {(10, 1), (11, 1), (15, 1), (16, 4), (17, 5), (18, 6), (19, 2), (21, 7)}
    assert (got[10, 1]["reparameterised"], got[11, 1]["reparameterised"]) == (False, True)
    kept = op4_decontaminate.clean(table(spark, rows), bench)
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.text) == sorted((d, t) for d, t in rows if t and d in (12, 20, 22) or t == "clean twin") and kept.count() == 6
    assert kept.columns == table(spark, rows).columns
    assert op4_decontaminate.contaminations(table(spark, rows).limit(0), bench).count() == 0
    assert op4_decontaminate.contaminations(table(spark, rows), bench.limit(0)).count() == 0


def test_decontamination_slots_across_alignments(spark):
    """One value for two is no template, also where an inserted word puts the second on an alignment of its own."""
    item = "Anna walks to Bern. In the far end there Anna meets Karl"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    one, two = item.replace("Anna walks", "Mary walks"), item.replace("Anna", "Mary").replace("Bern", "Rome")
    odd = one.replace("Anna meets", "Zoe meets").replace("Bern", "Rome").replace("Karl", "Ivan")
    rows = [(1, two), (2, odd), (3, odd.replace("In the", "And in the")), (4, two.replace("In the", "And in the"))]
    got = {r["doc_id"]: r["matched_windows"] for r in local(op4_decontaminate.contaminations(table(spark, rows), bench))}
    found = {k: len(v) for k, v in decontamination_brute(rows, [(1, item)], counts=True).items()}
    assert got == {d: n for (d, _), n in found.items()} and got[1] > got.get(2, 0) >= got.get(3, 0)


def decontamination_brute(rows, items, counts=False):
    """(doc, item) -> matched item places, from windows as tuples of words, one pair after the other."""
    from collections import Counter

    m = op4_decontaminate

    def read(text):
        words, start, out = (text or "").replace("\n", " … ").split(), True, []
        for raw in words:
            core = re.sub(r"^[\W_]+|[\W_]+$", "", raw)
            if core:
                number = re.fullmatch(r"\d+(?:[.,:/]\d+)*", core) is not None
                unit = not number and core.lower() in m.UNITS and bool(out) and out[-1][1] == 1
                cap = not number and not (core.lower() in m.UNITS and unit) and len(core) > 1 and core[0].isupper() and core[1:].islower()
                out.append((core.lower(), 1 if number else 3 if unit else 0, cap, start))
                start = False
            if raw.rstrip("\"')]»”’")[-1:] in (".", "!", "?", ":", "…"):
                start = True
        return out

    def forms(ws):
        plain = tuple(w[0] for w in ws)
        out, last = [(("p",) + plain, [])], None
        for opens in (False, True):
            kinds = [k or (2 if cap and (opens or not start) else 0) for _, k, cap, start in ws]
            literal = kinds.count(0)
            key = tuple(w[0] if not k else k for w, k in zip(ws, kinds))
            if literal >= min(m.MIN_LITERAL, len(ws)) and (literal < len(ws) if last is None else kinds != last):
                out.append((("t",) + key, [f"{k}{w[0]}" for w, k in zip(ws, kinds) if k]))
            last = kinds
        return out

    def places(ws, size):
        return [(i, key, slots) for i in range(len(ws) - size + 1) for key, slots in forms(ws[i : i + size])]

    result, read_docs, seen = {}, [(d, read(t)) for d, t in rows], {}
    for item_id, text in items:
        iw = read(text)
        if not iw:
            continue
        size = min(m.WINDOW, len(iw))
        known = places(iw, size) if size >= m.MIN_WORDS else places(iw, size)[:1]
        at = {}
        for j, key, slots in known:
            at.setdefault(key[1:], []).append((j, slots))
        for n, (doc_id, dw) in enumerate(read_docs):
            if size < m.MIN_WORDS and len(dw) != size:
                continue
            if (n, size) not in seen:
                seen[n, size] = places(dw, size)
            hits = [(i - j, j, js, ds) for i, dk, ds in seen[n, size] for j, js in at.get(dk[1:], ()) if size >= m.MIN_WORDS or dk[0] == "p"]
            votes = Counter(p for p in {(d, j, x, y) for d, j, js, ds in hits for x, y in zip(js, ds)})
            votes = Counter((x, y) for _, _, x, y in votes)
            best = {}
            for (x, y), n in votes.items():
                rank = (n, x == y, [-ord(c) for c in y])
                if x not in best or rank > best[x][0]:
                    best[x] = (rank, y)
            kept = [h for h in hits if all(best[x][1] == y for x, y in zip(h[2], h[3]))]
            plain, run, top = {(d, j) for d, j, _, ds in kept if not ds}, 0, 0
            for d, j in plain:
                run = m.WINDOW
                while (d, j + run - m.WINDOW + 1) in plain:
                    run += 1
                top = max(top, run)
            found = {j for _, j, _, _ in kept}
            if found and (len(found) >= m.MIN_COVER * len({j for j, _, _ in known}) or top >= m.LONG_RUN):
                result[doc_id, item_id] = found
    return result


def test_decontamination_equals_brute_force(spark, small):
    """The query's rows over whole tables, against windows as tuples of words."""
    from causeway.llm.queries import QUERIES

    docs, items = (plain_rows(spark, small, t, k) for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    got = {(r["doc_id"], r["item_id"]): r["matched_windows"] for r in local(QUERIES["op4_template_decontamination"](spark, small))}
    assert got == {k: len(v) for k, v in decontamination_brute(docs, items).items()}


def plain_rows(spark, folder, name, key):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/{name}.parquet").select(key, "text").collect()]


def test_decontamination_of_partial_copies(spark):
    """Copies with one odd slot, merged values, other names at a sentence's start, few literals, or a long run of a longer item."""
    twice = "Take 5 apples and then take 5 pears and add up the 5 plums of the whole big basket"
    merged = "Add 3 red apples to 5 red pears and say how many of them are in the basket"
    opens = "Anna walks to the old market. Anna buys bread there. Anna pays with a coin."
    digits = "12 99 41 73 Paris 10 22 81 64 90"
    long = " ".join(f"word{k}" for k in range(200))
    bench = spark.createDataFrame([(1, twice), (2, merged), (3, opens), (4, digits), (5, long)], "item_id long, text string")
    rows = [(10, twice.replace("5 apples", "6 apples")), (11, merged.replace("3", "4").replace("5", "4")), (12, opens.replace("Anna", "Olga")), (13, opens.lower()), (14, "so " + digits + " it is"), (15, "x " + " ".join(long.split()[50:90]) + " y"),
            (20, " ".join(long.split()[50:70])), (21, "Take 7 eggs and go to the old market there with a coin"), (None, twice), (None, "clean")]
    got = {(r["doc_id"], r["item_id"]): r for r in local(op4_decontaminate.contaminations(table(spark, rows), bench))}
    assert set(got) == {(10, 1), (11, 2), (12, 3), (13, 3), (14, 4), (15, 5), (None, 1)}
    assert [got[k]["reparameterised"] for k in ((10, 1), (11, 2), (12, 3), (13, 3), (15, 5))] == [False, True, True, False, False]
    assert got[10, 1]["matched_windows"] < got[10, 1]["item_windows"] == got[None, 1]["matched_windows"]
    assert sorted((str(r.doc_id), r.text) for r in op4_decontaminate.clean(table(spark, rows), bench).collect()) == sorted((str(d), t) for d, t in rows if d in (20, 21) or t == "clean")
    # a slot pair against the mapping of most windows takes its own windows only
    item = "Give 5 coins to each of the men in town and then give 5 coins to each of the women as well"
    both = op4_decontaminate.contaminations(table(spark, [(1, item.replace("5", "8")), (2, item.replace("Give 5", "Give 8"))]), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {r["doc_id"]: r["matched_windows"] == r["item_windows"] for r in local(both)} == {1: True, 2: False}


def hilbert_brute(x, bits):
    """The published transpose algorithm, one cell at a time."""
    x, n, q = list(x), len(x), 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    out = 0
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | ((x[i] ^ t) >> b & 1)
    return out


@pytest.mark.parametrize("n", [2, 3])
def test_hilbert_index(spark, n):
    bits = 3
    cells = [tuple((k >> (bits * i)) & 7 for i in range(n)) for k in range(8**n)]
    df = spark.createDataFrame(cells, ", ".join(f"x{i} int" for i in range(n)))
    got = {tuple(r[:n]): r[n] for r in df.select("*", op5_hilbert.hilbert_index([F.col(f"x{i}") for i in range(n)], bits)).collect()}
    assert got == {c: hilbert_brute(c, bits) for c in cells}
    line = sorted(got, key=got.get)
    assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for p, q in zip(line, line[1:]))


def test_shards(spark, docs):
    got = local(op5_hilbert.shard(docs))
    n = docs.count()
    assert len(got) == n
    sizes = {}
    for r in got:
        sizes.setdefault(r["shard"], []).append(r["slot"])
    assert max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1 and set(sizes) == set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in sizes.values())
    want = sorted((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in plain(docs))
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    assert op5_hilbert.shard(docs.limit(0)).count() == 0


def test_written_shards(spark, tmp_path):
    """The files hold every row, null ids and repeats too, in the sizes of the law."""
    rng = random.Random(13)
    rows = [(k, prose(rng, 5 + k % 30), "en", "web") for k in range(60)] + [(None, f"no id {k}", None, None) for k in range(10)] + [(7, "the same", "de", "web")] * 40 + [(None, None)] * 3
    docs = table(spark, rows).drop("shard")
    op5_hilbert.write_shards(docs, f"{tmp_path}/shards")
    back = spark.read.parquet(f"{tmp_path}/shards")
    shown = lambda df: sorted(map(str, df.select(docs.columns).collect()))
    assert shown(back) == shown(docs)
    assert {r.shard: r["count"] for r in back.groupBy("shard").count().collect()} == {r.shard: r["count"] for r in op5_hilbert.shard(docs).groupBy("shard").count().collect()}
    with pytest.raises(ValueError):
        op5_hilbert.write_shards(table(spark, rows), f"{tmp_path}/other")


def test_shards_equal_brute_force_and_prune(spark, tmp_path):
    """Shards and slots from the curve's order recomputed row by row; written shards rule out more shards than rows dealt by hash do."""
    rng = random.Random(17)
    rows = [(k, prose(rng, rng.randrange(1, 200)), rng.choice(["de", "en", "es", "fr"]), rng.choice(["web", "wiki", "forum", "news", "code"])) for k in range(600)] + [(7, None, None, None)] * 3
    docs, bits = table(spark, rows).drop("shard"), op5_hilbert.BITS
    got = local(op5_hilbert.shard(docs))
    size = lambda r: len((r[1] or "").encode()) + 1
    number = lambda v: None if v is None else int.from_bytes(v.encode()[:6].ljust(6, b"\0"), "big") if isinstance(v, str) else v
    dims = [[number(v) for v in c] for c in ([size(r) for r in rows], [r[2] for r in rows], [r[3] for r in rows])]
    cells = []
    for column in dims:
        known = sorted(v for v in column if v is not None)
        cuts = sorted({known[max(0, -(-k * len(known) // 32) - 1)] for k in range(1, 32)})
        cells.append([0 if v is None else sum(c < v for c in cuts) * 31 // len(cuts) for v in column])
    curve = {}
    for r, *cell in zip(rows, *cells):
        curve.setdefault(r[0], hilbert_brute(cell, bits) if r[1] is not None else None)
    exact = sum(r["curve"] == curve[r["doc_id"]] for r in got if r["doc_id"] != 7)
    assert exact == len(got) - 4
    line = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve"] for r in line] == sorted(r["curve"] for r in got)
    n = len(rows)
    assert [(r["shard"], r["slot"]) for r in line] == [(k * 8 // n, k - -(-(k * 8 // n) * n // 8)) for k in range(n)]
    op5_hilbert.write_shards(docs, f"{tmp_path}/s")
    back = spark.read.parquet(f"{tmp_path}/s").withColumn("length", F.length("text"))
    share = {r["dim"]: r["share"] for r in local(op5_hilbert.skipped(back, ["length", "lang", "source"]))}
    dealt = {r["dim"]: r["share"] for r in local(op5_hilbert.skipped(back.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(8))), ["length", "lang", "source"]))}
    assert all(share[d] > dealt[d] for d in share) and sum(share.values()) > 0.9 and sum(dealt.values()) < 0.2


def test_language(spark):
    rng = random.Random(5)
    parts = {"en": ["the", "ing", "and", "tion", "wh"], "de": ["sch", "ung", "der", "ß", "ein"], "fr": ["eau", "é", "le", "que", "oi"]}
    word = lambda lang: "".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4)))
    rows = [(k, " ".join(word(lang) for _ in range(40)), lang) for k in range(300) for lang in [rng.choice(list(parts))]]
    truth = {r[0]: r[2] for r in rows}
    rows += [(900, None, "en"), (901, "123 ... !!", "en"), (902, "the end", None), (None, "ein schein der dung", None), (903, "", None)]
    got = {r["doc_id"]: r for r in local(op6_language.identify(table(spark, rows)))}
    assert all(r["held_out"] == (k is not None and zlib.crc32(str(k).encode()) % 3 == 1) for k, r in got.items())
    held = [k for k in truth if got[k]["held_out"]]
    assert sum(got[k]["lang_pred"] == truth[k] for k in held) / len(held) > 0.95
    assert [got[k]["lang_pred"] for k in (900, 901, 903)] == ["und"] * 3 and got[None]["lang_pred"] == "de"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    kept = op6_language.keep_identified(table(spark, rows))
    assert kept.columns == table(spark, rows).columns and {r.doc_id for r in kept.collect()} >= set(truth)
    assert op6_language.identify(table(spark, rows[:0] + [(1, "no labels", None)])).first().lang_pred == "und"
    assert op6_language.identify(table(spark, rows).limit(0)).count() == 0
    unlabelled = table(spark, [(k, "some text", None) for k in range(9)])
    assert op6_language.keep_identified(unlabelled).count() == 9 and op6_language.keep_identified(unlabelled.limit(0)).count() == 0


def test_language_equals_brute_force(spark, small):
    """Labels, scores and rejections over whole tables, from cosines of n-grams counted one by one."""
    from collections import Counter

    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = op6_language.fit(op6_language.training_rows(docs))
    got = {r["doc_id"]: r for r in local(op6_language.identify(docs))}
    centroids = model.centroids / np.maximum(np.linalg.norm(model.centroids, axis=1, keepdims=True), 1e-12)
    for d, text in plain(docs):
        if text is None or not any(c.isalpha() for c in text):
            assert (got[d]["lang_pred"], got[d]["score"]) == ("und", 0.0)
            continue
        b = [32, *[x if x >= 128 or chr(x).isalpha() else 32 for x in text.lower().encode()], 32]
        seen = Counter((x * 257 + y) * 2654435761 % 2**32 >> 20 for x, y in zip(b, b[1:]))
        seen.update((((x * 257 + y) * 263 + z + 2**25) * 2654435761) % 2**32 >> 20 for x, y, z in zip(b, b[1:], b[2:]))
        v = np.zeros(op6_language.FEATURES)
        for k, n in seen.items():
            v[k] = np.log1p(n) * model.idf[k]
        near = centroids @ (v / np.linalg.norm(v))
        best = int(near.argmax())
        floor = model.floor[min(31, int(np.log2(sum(seen.values()))))]
        assert got[d]["lang_pred"] == model.labels[best] or np.sort(near)[-1] - near[model.labels.index(got[d]["lang_pred"])] < 1e-4
        assert abs(got[d]["score"] - near[best]) < 1e-4 and (got[d]["rejected"] == (near[best] < floor) or abs(near[best] - floor) < 1e-4)


def test_language_that_was_not_learned(spark, small):
    """Long texts of a language without labels are rejected, those of learned ones are kept."""
    docs = spark.read.parquet(f"{small}/documents.parquet").where("lang IS NOT NULL AND length(text) > 400")
    model = op6_language.fit(op6_language.training_rows(docs.where("lang <> 'fr'")))
    rows = [(r.lang, r.text) for r in docs.select("lang", "text").collect()]
    far = dict(zip(range(len(rows)), model.predict([t for _, t in rows])[2]))
    share = lambda own: (x := [far[k] for k, (lang, _) in enumerate(rows) if (lang == "fr") == own]) and sum(x) / len(x)
    assert share(False) < 0.01 and share(True) > 0.6, (share(False), share(True))


def license_brute(text):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, label) for p, label in op7_license.BASE.items() for k in [p.split()] for i in range(len(ws)) if ws[i : i + len(k)] == k]
    return len(ws), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({x for _, x in places}))


def license_cover(template, text):
    """The best share of a template's 4-grams that a run of near diagonals has in order, by plain comparison of words."""
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    want, have = find(template), find(text)
    k = min(op7_license.LONG, len(want))
    grams = [want[i : i + k] for i in range(len(want) - k + 1)]
    hits = sorted((i - j, i, j) for i in range(len(have) - k + 1) for j, g in enumerate(grams) if have[i : i + k] == g)
    best, span, last = 0, [], None
    for d, i, j in [*hits, (None, 0, 0)]:
        if last is not None and (d is None or d - last > op7_license.NEAR):
            chain = {}
            for x, y in sorted((x, y) for _, x, y in span):
                chain[x, y] = 1 + max((n for (a, b), n in chain.items() if a < x and b < y), default=0)
            best, span = max(best, max(chain.values())), []
        span.append((d, i, j))
        last = d
    return best / len(grams)


def license_labels(text):
    found = {label: c for label, t in op7_license.TEXTS.items() if (c := license_cover(t, text)) >= op7_license.COVER}
    base = [x for x in license_brute(text)[4].split(",") if x]
    return ",".join(sorted({*found, *base})), round(max([*found.values(), *[1.0] * bool(base)], default=0.0), 9)


def test_licenses(spark):
    mit = op7_license.TEXTS["mit-text"]
    rows = [(1, None), (2, ""), (3, "CC BY CC-BY cc by-nc"), (4, "Under the GNU General\n(Public) License; gnu general public licenses"), (5, "apache license " * 50 + "mit license"), (6, "intro " + mit.replace("free of charge", "wholly free of charge").upper()),
            (7, "Licensed under the Apache License, Version 2.0."), (8, "é mit license日本 mit  license"), (9, "plain words " * 500), (9, "plain words " * 500), (None, "MIT LICENSE")]
    got = local(op7_license.licenses(table(spark, rows)))
    want = sorted((str(d), *license_brute(t)) for d, t in rows)
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == want
    labels = {r["doc_id"]: r["labels"] for r in got}
    assert sorted((str(r["doc_id"]), r["labels"], round(r["score"], 9)) for r in got) == sorted((str(d), *license_labels(t)) for d, t in rows)
    # the same words in another order vote for the same diagonals' neighbours, but are no text
    few = spark.createDataFrame([("own", "one two three four five six seven eight nine ten", False), ("none", "", False), ("short", "solo", False)], "label string, text string, base boolean")
    some = [(1, "zero one two three four five and six seven eight nine ten"), (2, "seven eight nine ten one two three four five six"), (3, "a solo b"), (4, "one two three four five six seven eight nine")]
    assert {r["doc_id"]: r["labels"] for r in local(op7_license.licenses(table(spark, some), few))} == {1: "own" if license_cover("one two three four five six seven eight nine ten", some[0][1]) >= 0.7 else "", 2: "", 3: "short", 4: "own"}
    assert labels[6] == "mit-text" and labels[7] == "apache,apache-2.0" and labels[9] == ""
    assert op7_license.licenses(table(spark, rows).limit(0)).count() == 0


def test_licenses_with_a_large_template_table(spark, monkeypatch):
    """Beyond SENT_ROWS hits are shuffled, frequent grams are dealt, documents without hits stay."""
    rows = [(k, "see the mit license here" if k % 3 else "nothing of the kind") for k in range(400)] + [(900, None), (901, op7_license.TEXTS["mit-text"]), (902, "cc by " * 300), (None, "apache license"), (5, "see the mit license here")]
    shown = lambda: sorted((str(r["doc_id"]), *[str(r[c]) for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")]) for r in local(op7_license.licenses(table(spark, rows))))
    want = shown()
    monkeypatch.setattr(op7_license, "SENT_ROWS", 0)
    assert shown() == want and len(want) == len(rows)
    assert op7_license.licenses(table(spark, rows).limit(0)).count() == 0


def near_brute(rows, percent=80):
    def sh(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return {(w[0],)} if len(w) == 1 else set(zip(w, w[1:]))

    ids, sets = [(d is not None, d or 0) for d, _ in rows], [sh(t) for _, t in rows]
    comp = list(ids)
    changed = True
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in links:
            low = min(comp[i], comp[j])
            if comp[i] != low or comp[j] != low:
                comp[i] = comp[j] = low
                changed = True
    real = lambda c: c[1] if c[0] else None
    return sorted((str(rows[i][0]), len(sets[i]), str(real(comp[i])), comp[i] == ids[i]) for i in range(len(rows)))


def test_near_dedup(spark, docs, monkeypatch):
    shown = lambda df: sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in local(df))
    assert shown(op8_near_dedup.near_groups(docs)) == near_brute(plain(docs))
    assert op8_near_dedup.near_groups(docs.limit(0)).count() == 0
    kept = op8_near_dedup.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    # a large cluster with members on both sides of the threshold, in many small blocks
    rng = random.Random(9)
    base = prose(rng, 80).split()
    rows = [(k, " ".join(w if rng.random() > (k % 10) / 40 else f"w{rng.randrange(10**6)}" for w in base)) for k in range(150)]
    monkeypatch.setattr(op8_near_dedup, "BLOCK", 1500)
    assert shown(op8_near_dedup.near_groups(table(spark, rows))) == near_brute(rows)


def test_near_dedup_keeps_one_row(spark):
    """doc_ids that repeat or are null: one row of each component stays, and none of another component goes."""
    rng = random.Random(11)
    one, two, three, four, five = (prose(rng, 60) for _ in range(5))
    near = lambda t: t + " more"
    groups = [
        [(1, one), (2, near(one))], [(2, two)],  # 2 goes for its text, not for its id
        [(3, three), (3, near(three)), (3, three)], [(None, four), (None, near(four)), (None, four + " again"), (8, four)],
        [(3, five), (None, near(five)), (None, near(five))], [(None, "")], [(None, "")], [(2, None)], [(1, "something else")],
    ]
    rows = [r for g in groups for r in g]
    kept = op8_near_dedup.keep_one_of_each(table(spark, rows))
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(got) == len(groups) and kept.columns == table(spark, rows).columns
    assert all(any(r in g for r in got) for g in groups)
    assert {d for d, t in got if t and t.startswith(four)} == {None} == {d for d, t in got if t and t.startswith(five)}


def test_signatures_meet():
    """Signatures at any distance up to CHUNKS * (ERRORS + 1) - 1 share a bucket."""
    rng = np.random.default_rng(4)
    limit = op8_near_dedup.CHUNKS * (op8_near_dedup.ERRORS + 1) - 1
    for _ in range(300):
        a = rng.integers(0, 256, op8_near_dedup.SIGNATURE, np.uint8)
        b = a.copy()
        b[rng.choice(op8_near_dedup.SIGNATURE, limit, replace=False)] ^= 1
        assert set(op8_near_dedup.bucket_keys(a[None])[0]) & set(op8_near_dedup.bucket_keys(b[None])[0])


def test_pairs_behind_an_unlike_hub(spark):
    """Pairs at the stated distance whose one common bucket has a hub that neither resembles end in one cluster; so do all pairs of a bucket of
    signatures that are far from each other."""
    from pyspark.sql import types as T

    m, rng, rows = op8_near_dedup, np.random.default_rng(5), []
    for k in range(40):
        x = rng.integers(0, 256, m.SIGNATURE, np.uint8)
        y, hub = x.copy(), rng.integers(0, 256, m.SIGNATURE, np.uint8)
        y[[0, *[c * m.SLOTS + j for c in range(1, m.CHUNKS) for j in (0, 1)]]] ^= 1  # one error in the first chunk, two in all others
        hub[1 : m.SLOTS] = x[1 : m.SLOTS]
        assert (x != y).sum() == m.LIMIT and (x != hub).sum() > m.FAR
        rows += [(3 * k, hub.tobytes()), (3 * k + 1, x.tobytes()), (3 * k + 2, y.tobytes())]
    shared = rng.integers(0, 256, m.SLOTS, np.uint8)
    for k in range(60):  # one bucket, all members far apart, every second one with a partner
        x = rng.integers(0, 256, m.SIGNATURE, np.uint8)
        x[: m.SLOTS] = shared
        y = x.copy()
        y[rng.choice(np.arange(m.SLOTS, m.SIGNATURE), m.LIMIT - 1, replace=False)] ^= 1
        rows += [(1000 + k, x.tobytes()), (2000 + k, y.tobytes())]
    reps = spark.createDataFrame([(c, bytearray(s)) for c, s in rows], T.StructType([T.StructField("class", T.LongType()), T.StructField("signature", T.BinaryType())])).persist()
    keys = reps.select("signature", "class").mapInArrow(m._buckets, "key long, class long")
    comp = {r.node: r.component for r in components(m._tied(keys, reps)).collect()}
    assert all(comp[3 * k + 1] == comp[3 * k + 2] for k in range(40)) and all(comp[1000 + k] == comp[2000 + k] for k in range(60))


def test_near_dedup_recall_at_the_threshold(spark):
    """Planted pairs with similarity 0.80 to 0.85: no more than one in a hundred may be missed (expected: one in 100,000)."""
    rng, rows = random.Random(21), []
    for k in range(250):
        one = prose(rng, 200).split()
        two = list(one)
        for at in rng.sample(range(1, 199, 2), 8 + k % 3):
            two[at] = f"changed{at}"
        rows += [(2 * k, " ".join(one)), (2 * k + 1, " ".join(two))]
    want = {r[0]: r[2] for r in near_brute(rows)}
    got = {str(r["doc_id"]): str(r["component_id"]) for r in local(op8_near_dedup.near_groups(table(spark, rows)))}
    linked = [d for d in want if want[d] != d]
    assert len(linked) > 150 and sum(got[d] == want[d] for d in linked) >= 0.99 * len(linked) and all(got[d] in (d, want[d]) for d in want)


def test_components(spark, monkeypatch):
    from causeway.llm import graph

    rng = random.Random(6)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 480)]
    root = {n: n for x in links for n in x}
    for _ in range(500):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame(links, "a long, b long")
    want = {n: r for n, r in root.items() if any(a != b and n in (a, b) for a, b in links)}
    for bound in (100_000, 5):
        monkeypatch.setattr(graph, "ONE_TASK", bound)
        assert {r.node: r.component for r in components(df).collect()} == want
    assert components(df.limit(0)).count() == 0


def test_surrogates(spark):
    rows = [(1, "Write to ann.lee@mail.example.com or ANN.LEE@MAIL.EXAMPLE.COM, tel +1 (212) 555-7713."), (2, "bob@x.org, ann.lee@mail.example.com; 97.51.17.173!! 4111 1111 1111 1111 and 4111111111111111"), (3, None), (4, ""), (5, "no data 4.0 and 1.2.3"),
            (6, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" TOKEN = "04DBEBAB91AB85687D33EEAAF9AC699E1188F962"'), (7, "Mr. Smith met Mrs Jones and Mr Smith; Госпожа Иванова"), (7, "same id 97.51.17.173"), (None, "x@y.de")] + [(100 + k, f"{k}.{k % 250}.7.9 u{k}@h.io +1 (100) 555-{k:04d} Mr Name{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}") for k in range(1, 250)]
    got = local(op9_surrogates.surrogates(table(spark, rows), "k"))
    assert len(got) == len(rows)
    text = {}
    for r in got:
        text.setdefault(r["doc_id"], []).append(r["text"])
    one, two = text[1][0], text[2][0]
    mail = re.findall(r"[\w.]+@[\w.]+", one)
    assert mail[0].upper() == mail[1].rstrip(".,") or mail[0].upper() == mail[1]
    assert mail[0].rstrip(",") in two and "ann.lee" not in one + two and re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}\.$", one) and "555-7713" not in one
    cards = re.findall(r"\d{4} \d{4} \d{4} \d{4}|\d{16}", two)
    assert cards[0].replace(" ", "") == cards[1] != "4111111111111111"
    luhn = lambda d: sum(int(x) if i % 2 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(d)) % 10 == 0
    assert luhn(cards[1]) and re.search(r"\d+\.\d+\.\d+\.\d+!!", two)
    assert text[3] == [None] and text[4] == [""] and text[5] == ["no data 4.0 and 1.2.3"]
    keys = re.findall(r'"([0-9a-fA-F]{40})"', text[6][0])
    assert keys[0].upper() == keys[1] and "04dbebab" not in keys[0]
    names = re.findall(r"(Mr\.?|Mrs) (\w+)", next(t for t in text[7] if "met" in t))
    assert names[0][1] == names[2][1] != names[1][1] and "Smith" not in str(names) and re.search(r"Госпожа [А-Я][а-я]+", next(t for t in text[7] if "met" in t))
    ip = re.search(r"\d+\.\d+\.\d+\.\d+", two)[0]
    assert any(ip in t for t in text[7])
    for pattern in (r"\d+\.\d+\.\d+\.\d+", r"\S+@\S+", r"\(\d{3}\) \d{3}-\d{4}"):
        assert len({re.search(pattern, text[100 + k][0])[0] for k in range(1, 250)}) == 249
    assert op9_surrogates.surrogates(table(spark, rows).limit(0), "k").count() == 0


def test_surrogate_collisions(spark, monkeypatch):
    """Entities that draw the same surrogate, or a real entity, draw again."""
    real = op9_surrogates.draw
    small = lambda rows, attempt, key: real(rows, attempt, key).withColumn("surrogate", F.pmod(F.xxhash64("canon", F.lit(attempt)), F.lit(40)).cast("string"))
    monkeypatch.setattr(op9_surrogates, "draw", small)
    got = op9_surrogates.assign(spark.createDataFrame([("ip", str(k)) for k in range(12)], "kind string, canon string"), "k").collect()
    assert len({r.surrogate for r in got}) == 12 and not {r.surrogate for r in got} & {r.canon for r in got}


def test_surrogates_of_many_forms(spark):
    """Whole names with and without title, genders, scripts, number formats; mentions of one entity stay one."""
    rows = ["Mr. John Smith came. Smith said so, and SMITH left. John too.", "Señora María López y Sr. López", "Mr SMITH, Mr O'Brien, Dr. Peter Weiss, Prof. Anna Kraus; Weiss and Kraus", "Ms Lee-Ann met Mrs Smith-Jones",
            "212-555-7713, (212) 555-7713, +1 (212) 555-7713, 212.555.7713", "sk-abcdefghij1234567890XYZ password=e9b9ed9cc9999999d9, token: hello", "DE89 3704 0044 0532 0130 00 DE89370400440532013000 123-45-6789", "2001:db8:85a3::8a2e:370:7334, 2001:0DB8:85A3:0:0:8A2E:370:7334 at 12:30:45",
            "Госпожа Иванова и Господин Иванов", "std::vector a::b 3.14159 1,234,567 2024-01-02 03:04", "Dr van der Berg and Mr J. R. Tolkien"]
    got = {r["doc_id"]: r["text"] for r in local(op9_surrogates.surrogates(table(spark, list(enumerate(rows))), "k"))}
    for k, gone in {0: ["Smith", "SMITH", "John"], 1: ["María", "López"], 2: ["SMITH", "O'Brien", "Peter", "Weiss", "Anna", "Kraus"], 3: ["Lee", "Ann", "Smith", "Jones"], 4: ["555", "7713"], 5: ["abcdefghij", "e9b9ed9cc"], 6: ["3704", "123-45"], 7: ["85a3", "85A3"], 8: ["Иванов"], 10: ["Berg", "Tolkien"]}.items():
        assert not [g for g in gone if g in got[k]], (k, got[k])
    given, family = got[0].split()[1:3]
    assert got[0] == f"Mr. {given} {family} came. {family} said so, and {family.upper()} left. {given} too." and any(given.lower().endswith(x.lower()) for x in op9_surrogates.GIVEN["latin", "m"])
    assert re.fullmatch(r"Señora (\w+) (\w+) y Sr\. \2", got[1]) and any(got[1].split()[1].lower().endswith(x.lower()) for x in op9_surrogates.GIVEN["latin", "f"])
    assert got[2].split()[1] == family.upper() + "," and re.search(r"Dr\. \w+ (\w+), Prof\. \w+ (\w+); \1 and \2$", got[2])
    assert len({re.sub(r"\D", "", x)[-10:] for x in got[4].split(", ")}) == 1 and re.fullmatch(r"\d{3}-\d{3}-\d{4}, \(\d{3}\) \d{3}-\d{4}, \+1 \(\d{3}\) \d{3}-\d{4}, \d{3}\.\d{3}\.\d{4}", got[4])
    assert re.fullmatch(r"sk-[a-z]{10}\d{10}[A-Z]{3} password=\w{18}, token: hello", got[5])
    iban = re.fullmatch(r"(DE\d\d(?: \d{4}){4} \d\d) (\w{22}) \d{3}-\d{2}-\d{4}", got[6])
    assert iban[1].replace(" ", "") == iban[2] and int("".join(str(int(c, 36)) for c in iban[2][4:] + iban[2][:4])) % 97 == 1
    one, two = re.findall(r"2001:[0-9a-fA-F:]+", got[7])
    assert one.lower() == two.lower() and got[7].endswith("12:30:45")
    assert re.fullmatch(r"Госпожа (\w+ов)а и Господин \1", got[8]) and got[9] == rows[9] and "van der" in got[10] and "J. R." in got[10]
    with pytest.raises(ValueError):
        op9_surrogates.surrogates(table(spark, [(1, "x")]), "")


def test_surrogates_equal_brute_force(spark, small):
    """Over whole documents: the same mentions as a plain scan finds, all else untouched, entities one to one."""
    import regex

    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r["doc_id"]: r for r in local(op9_surrogates.surrogates(docs, "k"))}
    pattern, forward = regex.compile(op9_surrogates.ANY.replace(r"\k<gap>", "(?P=gap)")), {}
    for d, text in plain(docs):
        found = [m.group(0) for m in pattern.finditer(text or "")]
        assert got[d]["n_entities"] == len(found)
        if not found:
            assert got[d]["text"] == text
            continue
        keeps, at = [], 0
        for m in pattern.finditer(text):
            keeps.append(text[at : m.start()])
            at = m.end()
        new = re.fullmatch("(.+?)".join(map(re.escape, [*keeps, text[at:]])), got[d]["text"], re.S)
        assert new
        for old, put in zip(found, new.groups()):
            assert forward.setdefault(old.lower(), put.lower()) == put.lower() != old.lower()
    assert len(set(forward.values())) == len(forward) and not set(forward) & set(forward.values())


def test_surrogates_outlast_a_draw_space(spark):
    """More names than given names of a gender, and than short formats hold: longer draws, or an error, never an endless loop."""
    rows = [(k, f"Ms {a}{b}ela Ray") for k, (a, b) in enumerate((a, b) for a in "ABCDEFGH" for b in "aeiouy")]
    got = [r["text"].split()[1] for r in local(op9_surrogates.surrogates(table(spark, rows), "k"))]
    assert len(set(got)) == len(rows)
    with pytest.raises(ValueError):
        op9_surrogates.assign(spark.createDataFrame([("secret", c) for c in "0123456789abcdef"], "kind string, canon string"), "k", attempts=3)


def test_exact_dedup(spark, docs):
    groups = {}
    for d, t in plain(docs):
        groups.setdefault("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""), []).append(d)
    import hashlib

    got = local(op10_lsm_dedup.exact_groups(docs))
    rank = lambda d: (d is not None, d or 0)
    want = sorted((str(d), str(max(ids, key=rank)), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for d in ids)
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    kept = op10_lsm_dedup.keep_one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert op10_lsm_dedup.exact_groups(docs.limit(0)).count() == 0
    by_text = op10_lsm_dedup._by_text(op10_lsm_dedup._normal(docs.select("doc_id", "text")))
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in local(by_text)) == want


def test_merge_index_runs(spark, monkeypatch):
    """Runs of several appends and compactions, with memtables of two entries, digests with zero bytes, and a frequent one."""
    import hashlib

    monkeypatch.setattr(op10_lsm_dedup, "MEMTABLE_ROWS", 2)
    index, every = op10_lsm_dedup.MergeIndex(spark), []
    key = lambda k: b"\0" * 30 + bytes([k, 0]) if k < 4 else hashlib.sha256(bytes([k])).digest()
    for turn in range(3):
        rows = [(bytearray(key(k % (5 + turn))), None if k == 3 else 100 * turn + k, 1000 * turn + k) for k in range(12)] + [(bytearray(key(7)), 5, 1000 * turn + 100 + k) for k in range(300)]
        index.append(spark.createDataFrame(rows, "digest binary, doc_id long, row long"))
        every += [(bytes(d), i, r) for d, i, r in rows]
        if turn:
            index.compact()
    want = {}
    for d, i, r in every:
        best, n = want.get(d, ((False, 0, -1), 0))
        want[d] = (max(best, (i is not None, i or 0, r)), n + 1)
    assert {bytes(r.digest): ((r.doc_id is not None, r.doc_id or 0, r.row), r.copies) for r in index.entries().collect()} == want
    asked = spark.createDataFrame([(bytearray(d), i, r) for d, i, r in every], "digest binary, doc_id long, row long")
    got = sorted((bytes(r.digest), r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in index.lookup(asked).collect())
    assert got == sorted((d, i or 0, want[d][0][1], want[d][1], want[d][0][2] == r) for d, i, r in every)
    run = op10_lsm_dedup.Run.of(op10_lsm_dedup._entries([(hashlib.sha256(bytes([k])).digest(), k, k, 1 + k % 2) for k in range(200)]))
    digests = run.entries["digest"]
    assert run.may_share(digests)[run.entries["copies"] > 1].all() and run.may_share(digests)[run.entries["copies"] == 1].mean() < 0.1


def test_clashing_names(spark):
    """Tables whose columns have the operators' working names."""
    rows = [(k, f"the text of row {k // 2} and some more words", "en", "web") for k in range(40)]
    odd = spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6, 7) for r in rows], "doc_id long, text string, lang string, source string, id int, digest int, rejected int, hash int, whole int, __hot int, __salt int")
    for fn, n in ((op10_lsm_dedup.keep_one_of_each, 20), (op8_near_dedup.keep_one_of_each, 20), (op6_language.keep_identified, 40)):
        kept = fn(odd)
        assert kept.columns == odd.columns and kept.count() == n
