"""Source divergence audit over collapsed duplicate texts.

Equal texts of a language are grouped with the number of documents that each source has of them, and tokenised once; their
terms add to document frequencies and counts with those numbers as weights. Only texts whose digest occurs more than once
are moved to be grouped; the others are tokenised where they are read. Sources of a language are then compared pair by pair: a term
that neither has adds the same to each pair, so terms are folded by probability before they meet the other sources, and only
terms that two sources share are looked at one by one, inside tasks that each hold some terms.

Probabilities are 1 + floor(10^9 * (count + 2) / (N + 2 * V)); a term adds floor((p - q)^2 / (p + q)); all whole numbers.

Defined results: null text, lang and source count as ''. A (lang, source) group without terms has N = 0. With no kept term (V = 0) all
pairs of the language are 0 and there are no term rows. A source that is alone in its language has no pairs.
Repeated rows count each. Ties are ordered by the item's bytes. An empty table gives no rows. Texts are tokenised whole.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import narrow, small_batches, spread_join, staged

#: Least documents of a language with a term; terms reported for a group.
LEAST_DOCUMENTS, TOP_TERMS = 10, 10
#: Sums that a task holds before it passes them on; pairs of sources that a task looks at in one go.
HELD, PAIRS_AT_ONCE = 300_000, 1 << 21
#: Up to so many digests of repeated texts (8 bytes each) are sent to all tasks; beyond that all texts are grouped.
SENT_DIGESTS = 1_000_000
SALTS = 16
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """docs (text, lang, source) -> lang, source, part ('pair' or 'term'), item, value, rank."""
    small_batches(docs.sparkSession)
    docs = narrow(docs, text="string", lang="string", source="string").fillna("")
    terms = kept_terms(docs, least)
    counts = terms.select("lang", "term", "total", F.inline("own"))
    groups = _groups(docs, terms, counts)
    entries = counts.withColumn("grp", F.struct("lang", "source"))
    held = spread_join(entries, groups.select("grp", "g", "none", "below", "below_all"), "grp", entries.groupBy("grp").agg(F.count("*").alias("n")))
    known = staged(held.select("lang", "term", "source", "g", "none", _probability("n", "below").alias("p"), _probability("total", "below_all").alias("q")))
    return _pairs(known, groups).unionByName(_top_terms(known, top))


def kept_terms(docs: DataFrame, least: int) -> DataFrame:
    """lang, term, total, own (source, n): terms in at least ``least`` documents of a language."""
    counted = collapse(docs).mapInArrow(_count, "lang string, source string, term string, n long, df long")
    # one shuffle by language and term serves both sums
    by_source = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    both = by_source.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("df").alias("df"), F.collect_list(F.struct("source", "n")).alias("own"))
    return staged(both.where(F.col("df") >= least).drop("df"))


def collapse(docs: DataFrame) -> DataFrame:
    """docs (text, lang, source) -> lang, text, own (source, times): one row for equal texts of a language."""
    docs = docs.withColumn("h", F.xxhash64("lang", "text"))
    again = staged(docs.groupBy("h").count().where("count > 1").select("h"))
    grouped = docs
    if few := again.count() <= SENT_DIGESTS:
        again = F.broadcast(again)
        grouped = docs.join(again, "h", "left_semi")
    sums = grouped.groupBy("lang", "text", "source").agg(F.count("*").alias("times")).groupBy("lang", "text").agg(F.collect_list(F.struct("source", "times")).alias("own"))
    if not few:
        return sums
    alone = F.array(F.struct("source", F.lit(1).cast("long").alias("times"))).alias("own")
    return docs.join(again, "h", "left_anti").select("lang", "text", alone).unionByName(sums)


def _count(batches: Iterator) -> Iterator:
    """Each text's terms once, added with the weights of its sources. Bytes from 128 on are parts of letters outside ASCII, so bytes can be cut at ASCII."""
    from collections import Counter

    import pyarrow as pa

    cut = bytes(b if b >= 128 or chr(b) in LETTERS else ord(chr(b).lower()) if chr(b).lower() in LETTERS else 32 for b in range(256))
    counts: dict[tuple[str, str], Counter] = {}
    frequency: dict[tuple[str, str], Counter] = {}

    def flush():
        for group, n in counts.items():
            df, size = frequency[group], len(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([group[0]] * size, pa.string()), pa.array([group[1]] * size, pa.string()), pa.array([t.decode() for t in n], pa.string()), pa.array(n.values(), pa.int64()), pa.array([df[t] for t in n], pa.int64())],
                ["lang", "source", "term", "n", "df"],
            )
        counts.clear()
        frequency.clear()

    held = 0
    for b in batches:
        for lang, text, own in zip(b["lang"].to_pylist(), b["text"], b["own"].to_pylist()):
            terms = Counter(text.as_buffer().to_pybytes().translate(cut).split())
            for x in own:
                group, times = (lang, x["source"]), x["times"]
                n, df = counts.setdefault(group, Counter()), frequency.setdefault(group, Counter())
                before = len(n)
                if times == 1:
                    n.update(terms)
                    df.update(terms.keys())
                else:
                    n.update({t: c * times for t, c in terms.items()})
                    df.update(dict.fromkeys(terms, times))
                held += len(n) - before
                if held > HELD:
                    yield from flush()
                    held = 0
    yield from flush()


def _probability(count: str, below: str) -> Column:
    """1 + floor(10^9 * (count + 2) / below), in decimals so that counts of any size are exact."""
    return F.expr(f"1 + (cast(1000000000 as decimal(10,0)) * cast({count} + 2 as decimal(20,0))) div cast({below} as decimal(21,0))")


def _divergence(p: str, q: str) -> Column:
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q}))")


def _groups(docs: DataFrame, terms: DataFrame, counts: DataFrame) -> DataFrame:
    """One row for each (lang, source): grp, g (its number), below (N + 2 V), below_all (the language's), v, none (the probability of
    a term it hasn't), missing (such terms). The table is as long as there are groups, the result has their pairs."""
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("all"), F.count("*").alias("kinds"))
    sizes = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("whole"))
    filled = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(sizes, "lang", "left").fillna(0, ["all", "kinds", "v", "whole"])
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source"))
    rows = filled.select("lang", "source", "v", F.expr("all + 2 * v").alias("below"), F.expr("whole + 2 * v").alias("below_all"), F.expr("v - kinds").alias("missing"), number.alias("g"))
    return staged(rows.select(F.struct("lang", "source").alias("grp"), "*", F.expr("if(v > 0, 1 + 2000000000 div below, 1)").alias("none")))


def _pairs(known: DataFrame, groups: DataFrame) -> DataFrame:
    """The sum over all kept terms w of f(p_s(w), p_t(w)), as X(s, t) + X(t, s) - V f(none_s, none_t) + D, where X(s, t) compares s with a t
    that has no term at all, and D corrects the terms that both have. f is symmetric and all parts are whole numbers."""
    folded = known.groupBy("lang", "g", "p").agg(F.count("*").alias("n")).unionByName(groups.where("missing > 0").select("lang", "g", F.col("none").alias("p"), F.col("missing").alias("n")))
    others = groups.select("lang", F.col("g").alias("t"), "none", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = folded.withColumn("salt", F.pmod(F.xxhash64("g", "p"), F.lit(SALTS)).cast("int")).join(others, ["lang", "salt"]).where("g != t")
    x = met.groupBy("lang", "g", "t").agg(F.sum(F.col("n") * _divergence("p", "none")).alias("value"))
    ends = lambda df, a, b: df.select("lang", F.col(a).alias("g"), F.col(b).alias("t"), "value")
    a, b = groups.select("lang", "g", "v", F.col("none").alias("p")), groups.select("lang", F.col("g").alias("t"), F.col("none").alias("q"))
    base = a.join(b, "lang").where("g != t").select("lang", "g", "t", (-F.col("v") * _divergence("p", "q")).alias("value"))
    in_order = known.select("lang", "term", "g", "p", "none").repartition("lang", "term").sortWithinPartitions("lang", "term", "g")
    shared = in_order.mapInArrow(_both, "lang string, g int, t int, value long")
    sums = ends(x, "g", "t").union(ends(x, "t", "g")).union(ends(base, "g", "t")).union(ends(shared, "g", "t")).union(ends(shared, "t", "g")).groupBy("lang", "g", "t").agg(F.sum("value").alias("value"))
    names = groups.select("lang", "g", "source")
    named = sums.join(names, ["lang", "g"]).join(names.toDF("lang", "t", "item"), ["lang", "t"])
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return named.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))


def _both(batches: Iterator) -> Iterator:
    """For sources a < b that share terms: the sum of f(pa, pb) - f(pa, none_b) - f(none_a, pb) + f(none_a, none_b). Rows come sorted by term."""
    import numpy as np
    import pyarrow as pa

    def f(p, q):
        return (p - q) ** 2 // (p + q)

    def sums(lang: str, g, p, none, i, j):
        part = f(p[i], p[j]) - f(p[i], none[j]) - f(none[i], p[j]) + f(none[i], none[j])
        pairs, at = np.unique((g[i] << 32) | g[j], return_inverse=True)
        total = np.zeros(len(pairs), np.int64)
        np.add.at(total, at, part)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(pairs), pa.string()), pa.array((pairs >> 32).astype(np.int32)), pa.array((pairs & 0xFFFFFFFF).astype(np.int32)), pa.array(total)], ["lang", "g", "t", "value"])

    def runs(lang: str, ends, g, p, none):
        """ends: where each term's rows end. Terms are taken together while their pairs fit; a single larger one is cut."""
        sizes = np.diff(ends, prepend=0)
        lo, many = 0, sizes * (sizes - 1) // 2
        total = np.cumsum(many)
        while lo < len(ends):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PAIRS_AT_ONCE, "right")))
            start, stop = (ends[lo - 1] if lo else 0), ends[hi - 1]
            own = np.repeat(ends[lo:hi], sizes[lo:hi])  # of each row: where its term ends
            rows = np.arange(start, stop)
            after = own - rows - 1  # partners of a row: the rows of its term after it
            at = 0
            while at < len(rows):
                to = max(at + 1, int(np.searchsorted(np.cumsum(after[at:]), PAIRS_AT_ONCE, "right")) + at)
                i = np.repeat(rows[at:to], after[at:to])
                if len(i):
                    first = np.cumsum(after[at:to]) - after[at:to]
                    j = i + 1 + np.arange(len(i)) - np.repeat(first, after[at:to])
                    yield sums(lang, g, p, none, i, j)
                at = to
            lo = hi

    kept = None  # rows of the last term, which may go on in the next batch
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b] if kept is None else [kept, b]).combine_chunks()
        lang, term = (np.asarray(t[c].dictionary_encode().combine_chunks().indices) for c in ("lang", "term"))
        new = np.flatnonzero((np.diff(lang, prepend=-1) != 0) | (np.diff(term, prepend=-1) != 0))
        done = int(new[-1])
        kept = t.slice(done).to_batches()[0] if done < t.num_rows else None
        yield from _languages(t.slice(0, done), lang[:done], new[:-1], runs)
    if kept is not None:
        yield from _languages(pa.Table.from_batches([kept]), np.zeros(kept.num_rows, np.int64), np.array([0]), runs)


def _languages(t, lang, new, runs) -> Iterator:
    """Calls ``runs`` for each language's rows. new: where a term begins."""
    import numpy as np

    g, p, none = (np.asarray(t[c].combine_chunks(), np.int64) if t.num_rows else np.zeros(0, np.int64) for c in ("g", "p", "none"))
    bounds = np.flatnonzero(np.diff(lang, prepend=-1)) if len(lang) else []
    for lo, hi in zip(bounds, [*bounds[1:], len(lang)]):
        starts = new[(new >= lo) & (new < hi)]
        ends = np.append(starts[1:], hi) - lo
        yield from runs(t["lang"][int(lo)].as_py(), ends, g[lo:hi], p[lo:hi], none[lo:hi])


def _top_terms(known: DataFrame, top: int) -> DataFrame:
    over = known.where("p > q").select("lang", "source", F.col("term").alias("item"), _divergence("p", "q").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return over.select("lang", "source", F.lit("term").alias("part"), "item", "value", rank.alias("rank")).where(F.col("rank") <= top)
