"""The operators' queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from . import op1_token_store, op2_packing, op3_warc, op4_decontaminate, op5_hilbert, op6_language, op7_license, op8_near_dedup, op9_surrogates, op10_lsm_dedup, op11_topk, op12_divergence, op13_conversations
from .common import read_table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1(spark, d):
    rows = op1_token_store.token_store(read_table(spark, d, "documents"), tokenizer("byte_bpe_50k.json"), end_id=2)
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32")


def op2(spark, d):
    return op2_packing.pack(read_table(spark, d, "documents"), tokenizer("word_bpe_49k.json"), end_id=1)


def op3(spark, d):
    return op3_warc.warc(read_table(spark, d, "pages")).drop("url", "record_id")


def op4(spark, d):
    found = op4_decontaminate.contaminations(read_table(spark, d, "documents"), read_table(spark, d, "benchmark"))
    return found.select("doc_id", "item_id", "matched_windows", "item_windows", "reparameterised")


def op5(spark, d):
    return op5_hilbert.shard(read_table(spark, d, "documents"))


def op6(spark, d):
    return op6_language.identify(read_table(spark, d, "documents"))


def op7(spark, d):
    return op7_license.licenses(read_table(spark, d, "documents"))


def op8(spark, d):
    return op8_near_dedup.near_groups(read_table(spark, d, "documents"))


def op9(spark, d):
    # a deployment sets its own secret; what is checked here does not depend on it
    return op9_surrogates.surrogates(read_table(spark, d, "documents"), key=spark.conf.get("spark.causeway.surrogateKey", "no secret"))


def op10(spark, d):
    return op10_lsm_dedup.exact_groups(read_table(spark, d, "documents"))


def op11(spark, d):
    return op11_topk.top_k(read_table(spark, d, "embeddings"))


def op12(spark, d):
    return op12_divergence.audit(read_table(spark, d, "documents"))


def op13(spark, d):
    return op13_conversations.repair(read_table(spark, d, "conversations"))


QUERIES = {
    "op1_token_store": op1, "op2_sum_of_squares_packing": op2, "op3_warc_revisits": op3, "op4_template_decontamination": op4, "op5_hilbert_shards": op5,
    "op6_nearest_centroid_language": op6, "op7_diagonal_license_scan": op7, "op8_hamming_near_dedup": op8, "op9_surrogates": op9, "op10_lsm_exact_dedup": op10,
    "op11_branch_and_bound_top_k": op11, "op12_source_divergence": op12, "op13_rank_convergence_repair": op13,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op3_warc_revisits": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        h AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS hex FROM p),
        d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
                substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, CAST((i // 4) * 5 + 1 AS BIGINT), 5))::BIGINT >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) + 1, 1)), '') AS payload_digest FROM h),
        m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM m""",
    "op8_hamming_near_dedup": f"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(ws) = 1 THEN ws ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh FROM w),
        sets AS (SELECT doc_id, len(sh) AS n, sh FROM s),
        items AS (SELECT doc_id, n, unnest(sh) AS g FROM sets),
        pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared, any_value(a.n) AS m, any_value(b.n) AS n FROM items a JOIN items b ON a.g = b.g AND a.doc_id < b.doc_id AND a.n * 5 >= b.n * 4 AND b.n * 5 >= a.n * 4 GROUP BY 1, 2),
        links AS (SELECT x, y FROM pairs WHERE 100 * shared >= 80 * (m + n - shared)),
        both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
        reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x),
        comp AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
        SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN comp ON doc_id = x""",
    "op10_lsm_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {_LOWER} AS text FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY text) AS kept, sha256(text) AS text_sha256 FROM t""",
    "op11_branch_and_bound_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
                   WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op12_source_divergence": f"""
        WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWER} AS text FROM documents),
        o AS (SELECT k, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
        kept AS (SELECT lang, term, count(*) AS n FROM o GROUP BY lang, term HAVING count(DISTINCT k) >= 10),
        grp AS (SELECT DISTINCT lang, source FROM d),
        own AS (SELECT o.lang, o.source, o.term, count(*) AS n FROM o JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
        size AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
        total AS (SELECT lang, source, sum(n) AS n FROM own GROUP BY lang, source),
        cell AS (SELECT g.lang, g.source, kept.term, coalesce(own.n, 0) AS n,
                        1 + CAST(1000000000 AS HUGEINT) * (coalesce(own.n, 0) + 2) // (coalesce(total.n, 0) + 2 * size.v) AS p,
                        1 + CAST(1000000000 AS HUGEINT) * (kept.n + 2) // (size.n + 2 * size.v) AS q
                 FROM grp g JOIN kept ON kept.lang = g.lang JOIN size ON size.lang = g.lang LEFT JOIN total ON total.lang = g.lang AND total.source = g.source
                 LEFT JOIN own ON own.lang = g.lang AND own.source = g.source AND own.term = kept.term),
        met AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
                FROM cell a JOIN cell b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
        pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(met.value, 0) AS value
                  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN met ON met.lang = a.lang AND met.source = a.source AND met.item = b.source),
        terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM cell WHERE n > 0 AND p > q),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10""",
}
