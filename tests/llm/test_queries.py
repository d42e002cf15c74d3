"""The registered queries and the pipeline on the smallest tables."""

import pytest

from causeway.llm.queries import ORACLES, QUERIES
from tests.conftest import same_rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, small, duck, name):
    same_rows(QUERIES[name](spark, small), duck, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_rows(spark, small, name):
    n = QUERIES[name](spark, small).count()
    if name.startswith("op13"):
        assert n == spark.read.parquet(f"{small}/conversations.parquet").select("conv_id").distinct().count()
        return
    docs = spark.read.parquet(f"{small}/documents.parquet").count()
    assert n >= docs if name.startswith("op2") else 0 < n <= docs if name.startswith("op4") else n == docs


def test_pipeline_equals_brute_force(spark, small):
    """The rows of run() over whole tables, from the language stage's rows on by plain loops over texts."""
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    import corpus_pipeline
    from causeway.llm.common import read_table
    from causeway.llm.queries import tokenizer
    from tests.llm.test_operators import decontamination_brute, near_brute

    docs = read_table(spark, small, "documents")
    known = corpus_pipeline.language(spark, docs, small)
    assert known.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in known.collect()]
    last = {}
    for d, t in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        last[low] = max(last.get(low, d), d)
    rows = [r for r in rows if r[0] in set(last.values())]
    kept = {int(d) for d, _, _, own in near_brute(rows) if own}
    rows = [r for r in rows if r[0] in kept]
    items = [tuple(r) for r in read_table(spark, small, "benchmark").select("item_id", "text").collect()]
    dirty = {d for d, _ in decontamination_brute(rows, items)}
    rows = dict(r for r in rows if r[0] not in dirty)
    t, got, windows = Tokenizer.from_file(tokenizer("word_bpe_49k.json")), {}, {}
    for r in corpus_pipeline.run(spark, small).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(got) == set(rows) and dirty
    for d, pieces in got.items():
        ids, at = np.array([*t.encode(rows[d] or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for start, length, crc in sorted(pieces):
            assert start == at and zlib.crc32(ids[start : start + length].tobytes()) == crc
            at += length
        assert at == len(ids)
    for pieces in windows.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))] and sum(n for _, n in pieces) <= 2048
