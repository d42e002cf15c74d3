"""Benchmark decontamination by template canonicalisation.

Words are lower-cased and stripped of punctuation; numbers, capitalised words (names) and units after a
number become typed placeholders. Windows of WINDOW words are hashed on both sides and hash-joined, as
plain words and as templates, with words that open a sentence both as literals and as names; a benchmark
item shorter than a window is one window of its own length, and one of fewer than MIN_WORDS words must be the
whole document. Plain windows always count. For each document and item the values in the slots of all alignments
are compared: an item value stands for the document value that it has in most windows, and template windows
that say otherwise are dropped as chance. A document is contaminated by an item when at least MIN_COVER of
the item's windows are found, or a verbatim run of LONG_RUN words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap_of, column, keep_only, narrow, small_batches, staged

WINDOW = 8
MIN_COVER = 0.5
#: Items of fewer words are in too many texts by chance: they have no template and count where they are the whole text.
MIN_WORDS = 3
#: Words of a template window that must be literal.
MIN_LITERAL = 3
#: Words in a row, the same on both sides, that contaminate however long the item is.
LONG_RUN = 30
UNITS = {
    "mm", "cm", "m", "km", "inch", "inches", "feet", "foot", "yard", "yards", "mile", "miles", "meter", "meters", "metre", "metres", "mg", "g", "kg", "gram", "grams",
    "pound", "pounds", "ounce", "ounces", "ton", "tons", "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons", "s", "second", "seconds", "minute", "minutes",
    "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "dollar", "dollars", "euro", "euros", "cent", "cents", "percent", "degrees", "kmh", "mph",
}
_NUMBER = re.compile(r"\d+(?:[.,:/]\d+)*")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_WORD, _NUM, _NAME, _UNIT = 0, 1, 2, 3
#: Words that a worker remembers.
_CACHE = 400_000
#: Characters of the texts that are worked on at once.
_GROUP = 1 << 18


class _Words(dict):
    """raw word -> its row in the columns: hash, kind (-1: no word), ends a sentence, capitalised."""

    def __init__(self):
        self.columns = [np.zeros(1 << 16, t) for t in (np.uint64, np.int8, bool, bool)]

    def __missing__(self, raw: str) -> int:
        from xxhash import xxh64_intdigest

        row = len(self)
        if row >= len(self.columns[0]):
            self.columns = [np.concatenate([c, np.zeros_like(c)]) for c in self.columns]
        core = _EDGE.sub("", raw)
        ends = raw.rstrip("\"')]»”’")[-1:] in (".", "!", "?", ":", "…")
        kind = -1 if not core else _NUM if _NUMBER.fullmatch(core) else _UNIT if core.lower() in UNITS else _WORD
        for column, value in zip(self.columns, (xxh64_intdigest(core.lower().encode()), kind, ends, len(core) > 1 and core[0].isupper() and core[1:].islower())):
            column[row] = value
        self[raw] = row
        return row


_WORDS = _Words()


def templates(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Of the words of all texts in a row: (hash as plain word and as template word, sentence openers as
    literals and as names: 3 x n, the two templates' kinds: 2 x n, the word's text, its raw form). Line ends end sentences."""
    split = [(t or "").replace("\n", " … ").split() for t in texts]
    raw = list(chain.from_iterable(split))
    if not raw:
        return np.zeros((3, 0), np.uint64), np.zeros((2, 0), np.int8), np.zeros(0, np.int64), []
    if len(_WORDS) > _CACHE:
        _WORDS.clear()
    rows = np.fromiter(map(_WORDS.__getitem__, raw), np.int64, len(raw))
    h, kind, ends, cap = (c[rows] for c in _WORDS.columns)
    keep = np.flatnonzero(kind >= 0)
    owner = np.repeat(np.arange(len(texts)), [len(x) for x in split])[keep]
    first = np.concatenate([[True], owner[1:] != owner[:-1]])[: len(keep)]
    # white space and loose punctuation between two words pass on the end of a sentence
    passed = np.concatenate([[0], np.cumsum(ends)])
    before = np.concatenate([[0], keep[:-1]])[: len(keep)]
    starts = first | (passed[keep] - passed[before] > 0)
    h, kind, cap = h[keep], kind[keep], cap[keep]
    after = np.concatenate([[False], kind[:-1] == _NUM])[: len(keep)] & ~first
    kind = np.where((kind == _UNIT) & ~after, np.int8(_WORD), kind)
    cap &= kind == _WORD
    kinds = np.where(np.stack([cap & ~starts, cap]), np.int8(_NAME), kind)
    hashes = np.concatenate([h[None], np.where(kinds == _WORD, h, kinds.astype(np.uint64))])
    return hashes, kinds, owner, [raw[k] for k in keep.tolist()]


def windows(h: np.ndarray, kinds: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows in the three forms, and which of them count: plain ones in one text, templates
    that differ from the form before and have literal words enough."""
    n = h.shape[1] - size + 1
    if n <= 0:
        return np.zeros((3, 0), np.uint64), np.zeros((3, 0), bool)
    out, power = np.full((3, n), size, np.uint64), np.uint64(0x9E3779B97F4A7C15)
    for j in range(size):
        out = (out ^ (out >> np.uint64(31))) * power + h[:, j : j + n]
    within = lambda x: (c := np.concatenate([np.zeros((len(x), 1), np.int64), np.cumsum(x, axis=1)], axis=1))[:, size:] - c[:, :-size]
    literal, opens = within(kinds == _WORD), within((kinds[1] != kinds[0])[None])[0]
    enough = literal >= min(MIN_LITERAL, size)
    fit = np.stack([np.ones(n, bool), enough[0] & (literal[0] < size), enough[1] & (opens > 0)])
    return out ^ (out >> np.uint64(29)), fit & (owner[:n] == owner[size - 1 :])


_ROWS = "row long, doc_id long, text_hash long, window long, at long, slots array<string>"


def _groups(texts: list, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of texts, each ended by the text that brings it to ``limit`` characters."""
    lo = held = 0
    for k, t in enumerate(texts, 1):
        held += len(t or "") + 1
        if held >= limit or k == len(texts):
            yield lo, k
            lo, held = k, 0


def _emit(items: bool, sizes: list[int], bitmap: np.ndarray | None):
    """Windows of a table's texts as rows; bitmap: low bits of the hashes that the other side has."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        keep_only("templates", _WORDS.clear)
        row = TaskContext.get().partitionId() << 33
        schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("window", pa.int64()), ("at", pa.int64()), ("slots", pa.list_(pa.string()))])
        for b in batches:
            out: list = []
            doc, th, text = (b[c].to_pylist() for c in ("doc_id", "text_hash", "text"))
            for lo, hi in _groups(text, 1 if items else _GROUP):
                h, kinds, owner, raw = templates(text[lo:hi])
                begin = np.searchsorted(owner, np.arange(hi - lo))
                length = np.bincount(owner, minlength=hi - lo)  # words of each text
                for size in sizes if not items else [min(WINDOW, len(raw))] if raw else []:
                    got, fit = windows(h, kinds, owner, size)
                    if size < MIN_WORDS:
                        fit[1:] = False
                        fit[0] &= length[owner[: fit.shape[1]]] == size
                    if bitmap is not None:
                        low = (got & np.uint64(len(bitmap) * 8 - 1)).astype(np.int64)
                        fit &= (bitmap[low >> 3] >> (low & 7).astype(np.uint8)) & 1 == 1
                    for form, at in zip(*(x.tolist() for x in np.nonzero(fit))):
                        of, kind = int(owner[at]), kinds[form - 1]
                        slots = [f"{kind[k]}{_EDGE.sub('', raw[k]).lower()}" for k in range(at, at + size) if kind[k] != _WORD] if form else []
                        out.append((row + lo + of, doc[lo + of], th[lo + of], int(got[form, at].astype(np.int64)), at - int(begin[of]), slots))
                if len(out) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*out), schema)], schema=schema)
                    out = []
            row += len(text)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*out), schema)], schema=schema)

    return run


def _rows(table: DataFrame, key: str) -> DataFrame:
    return narrow(table, **{key: "long", "text": "string"}).select(F.col(key).alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def _agree(batches: Iterator) -> Iterator:
    """One row a document and item -> the item's windows that count, the longest verbatim run in words, whether a slot differs."""
    import pyarrow as pa

    for b in batches:
        out = []
        for hits in b["hits"].to_pylist():
            seen = {(h["diagonal"], h["item_at"], *pair) for h in hits for pair in zip(h["item_slots"], h["slots"])}
            votes = Counter((x, y) for _, _, x, y in seen)
            # of doc values with as many windows, the unchanged one stands, then the smallest
            stands = dict(sorted(votes, key=lambda p: (votes[p], p[0] == p[1], [-ord(c) for c in p[1]])))
            kept = [h for h in hits if all(stands[x] == y for x, y in zip(h["item_slots"], h["slots"]))]
            longest, last = 0, None
            for place in sorted({(h["diagonal"], h["item_at"]) for h in kept if not h["slots"]}):
                follows = last is not None and place == (last[0], last[1] + 1)
                run, last = run + 1 if follows else WINDOW, place
                longest = max(longest, run)
            out.append((list({h["item_at"] for h in kept}), longest, any(h["item_slots"] != h["slots"] for h in kept)))
        columns = [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.list_(pa.int64()), pa.int64(), pa.bool_()))]
        names = ["row", "doc_id", "text_hash", "item", "item_id"]
        yield pa.RecordBatch.from_arrays([*[b[n] for n in names], *columns], [*names, "places", "run", "reparameterised"])


def _found(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    bench = staged(_rows(benchmark, "item_id").mapInArrow(_emit(True, [], None), _ROWS)).toDF("item", "item_id", "item_hash", "window", "item_at", "item_slots")
    totals = bench.groupBy("item").agg(F.count_distinct("item_at").alias("item_windows"))
    sizes = [r.size for r in _rows(benchmark, "item_id").mapInArrow(_lengths, "size int").distinct().collect()]  # WINDOW values at most
    found = _rows(docs, "doc_id").mapInArrow(_emit(False, sorted(sizes), bitmap_of(bench, "window")), _ROWS)
    hit = F.struct((F.col("at") - F.col("item_at")).alias("diagonal"), "item_at", "item_slots", "slots")
    aligned = found.join(bench, "window").groupBy("row", "doc_id", "text_hash", "item", "item_id").agg(F.collect_list(hit).alias("hits"))
    agreed = aligned.mapInArrow(_agree, "row long, doc_id long, text_hash long, item long, item_id long, places array<long>, run long, reparameterised boolean")
    matched = F.size("places").cast("long")
    cover = F.col("matched_windows") / F.col("item_windows")
    whole = agreed.withColumn("matched_windows", matched).join(totals, "item").withColumn("coverage", cover)
    return whole.where((cover >= MIN_COVER) | (F.col("run") >= LONG_RUN)).select("doc_id", "item_id", "matched_windows", "item_windows", "coverage", "reparameterised", "text_hash")


def contaminations(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document row and benchmark item that contaminates it: doc_id, item_id, matched_windows,
    item_windows, coverage, reparameterised (some slot differs), text_hash.

    docs: doc_id, text; benchmark: item_id, text. A null or empty text has no windows; null ids are kept as
    they are; rows that repeat count each. Other columns are not read. Empty tables give an empty result.
    """
    return _found(docs, benchmark)


def _lengths(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for b in batches:
        n = {min(WINDOW, len(templates([t])[3])) for t in b["text"].to_pylist()}
        yield pa.RecordBatch.from_pydict({"size": pa.array([k for k in n if k], pa.int32())})


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all columns, that no benchmark item contaminates."""
    hit = staged(contaminations(docs, benchmark)).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    on = column(docs, "doc_id").cast("long").eqNullSafe(hit["__id"]) & (F.xxhash64(column(docs, "text").cast("string")) == hit["__hash"])
    return docs.join(hit, on, "left_anti")
