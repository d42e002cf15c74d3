"""License scanning by diagonal voting.

Templates are a table: phrases, and whole license texts. Both sides are cut to words; hashes of rolling word k-grams are joined,
and each hit votes for a diagonal (document position less template position). Neighbouring diagonals of a text template are
merged (a word more or less shifts what follows), and a merged span is verified: what counts is the longest run of hits
that go forward in document and template alike, as a share of the template's k-grams. A phrase counts where one
diagonal has all of it. A bitmap of the templates' k-grams keeps other k-grams of documents out of the join.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bitmap_of, keep_only, narrow, small_batches, spread_join, staged

#: phrase -> label; fixed values of the scan.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: label -> public license texts and notices; fixed values. Other tables of templates can be passed in.
TEXTS = {
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "bsd-2-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-3-clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "boost-text": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
    "unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-notice": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "mit-notice": "released under the mit license",
}
#: Words of a k-gram of phrases, and of texts; shorter templates are one k-gram.
SHORT, LONG = 2, 4
#: Diagonals of a text template that are at most so far apart are one span.
NEAR = 3
#: Share of a text template's k-grams that a span needs, in order.
COVER = 0.7
#: Up to so many template k-grams go to all tasks (about 40 bytes each); more are joined as any table.
SENT_ROWS = 200_000
_CACHE = 400_000
_WORD_BYTES = bytes(b"abcdefghijklmnopqrstuvwxyz"[c - 65] if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words of ASCII letters, digits and all non-ASCII characters."""
    return (text or "").encode().translate(_WORD_BYTES).split()


_HASHES: dict[bytes, int] = {}


def _hashes(ws: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    if len(_HASHES) > _CACHE:
        _HASHES.clear()
    for w in set(ws).difference(_HASHES):
        _HASHES[w] = xxh64_intdigest(w)
    return np.fromiter(map(_HASHES.__getitem__, ws), np.uint64, len(ws))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of rolling k-grams."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n]
    return (out ^ (out >> np.uint64(29))).astype(np.int64)


def built_in(spark) -> DataFrame:
    """label, text, base: the built-in templates."""
    return spark.createDataFrame([(label, text, True) for text, label in BASE.items()] + [(label, text, False) for label, text in TEXTS.items()], "label string, text string, base boolean")


_POSITIONS = "gram long, template long, label string, base boolean, place int, size int, k int"


def _positions(batches: Iterator) -> Iterator:
    """Templates -> their k-grams. A template without words has none."""
    import pyarrow as pa

    number, schema = TaskContext.get().partitionId() << 33, None
    for b in batches:
        rows = []
        for label, text, base in zip(*(b[c].to_pylist() for c in ("label", "text", "base"))):
            number += 1
            ws = words(text)
            k = min(SHORT if base else LONG, len(ws))
            g = grams(_hashes(ws), k).tolist() if k else []
            rows += [(x, number, label, base, p, len(g), k) for p, x in enumerate(g)]
        schema = schema or pa.schema([("gram", pa.int64()), ("template", pa.int64()), ("label", pa.string()), ("base", pa.bool_()), ("place", pa.int32()), ("size", pa.int32()), ("k", pa.int32())])
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


def _hits(sizes: list[int], bitmap: np.ndarray | None):
    """Texts -> their k-grams that templates may have, with their places."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        keep_only("license words", _HASHES.clear)
        row, kinds = TaskContext.get().partitionId() << 33, pa.list_(pa.struct([("gram", pa.int64()), ("at", pa.int64())]))
        for b in batches:
            rows, n, hits = [], [], []
            for text in b["text"].to_pylist():
                row += 1
                ws = words(text)
                h, found = _hashes(ws), []
                for k in sizes:
                    g = grams(h, k)
                    at = np.arange(len(g))
                    if bitmap is not None:
                        low = (g.astype(np.uint64) & np.uint64(len(bitmap) * 8 - 1)).astype(np.int64)
                        at = np.flatnonzero((bitmap[low >> 3] >> (low & 7).astype(np.uint8)) & 1)
                    found += [{"gram": x, "at": p} for x, p in zip(g[at].tolist(), at.tolist())]
                rows.append(row)
                n.append(len(ws))
                hits.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), b["doc_id"], pa.array(n, pa.int64()), pa.array(hits, kinds)], ["row", "doc_id", "n_words", "hits"])

    return run


def _forward(batches: Iterator) -> Iterator:
    """Spans -> found: the most hits that go forward in document and template alike."""
    import pyarrow as pa

    for b in batches:
        found = []
        for parts in b["parts"].to_pylist():
            ends: list[int] = []
            # of one document place the later template places first, so that it counts once
            for _, place in sorted((p["diagonal"] + x, -x) for p in parts for x in p["seen"]):
                k = bisect_left(ends, -place)
                ends[k : k + 1] = [-place]
            found.append(len(ends))
        yield pa.RecordBatch.from_arrays([*[b[c] for c in b.schema.names if c != "parts"], pa.array(found, pa.int64())], [*[c for c in b.schema.names if c != "parts"], "found"])


def _sent(seen: DataFrame, table: DataFrame) -> DataFrame:
    """Hits with the template places of their grams; a document without any is one row. The table goes to each task."""
    votes = seen.select("row", "doc_id", "n_words", F.explode_outer("hits").alias("hit")).select("row", "doc_id", "n_words", F.col("hit.gram").alias("gram"), F.col("hit.at").alias("at"))
    return votes.join(F.broadcast(table.drop("k")), "gram", "left")


def _dealt(seen: DataFrame, table: DataFrame) -> DataFrame:
    """The same where the table is too large to be sent: hits alone are shuffled, those of frequent grams dealt over tasks, and documents without any are added."""
    seen = staged(seen)
    hits = seen.select("row", "doc_id", "n_words", F.inline("hits"))
    counts = staged(hits.groupBy("gram").agg(F.count(F.lit(1)).alias("n")))
    found = staged(spread_join(hits, table.drop("k"), "gram", counts))
    none = seen.select("row", "doc_id", "n_words").join(found.select("row").distinct(), "row", "left_anti")
    return found.unionByName(none, allowMissingColumns=True)


def spans(docs: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """One row for each document row and template found in it (or one with null label): row, doc_id, n_words,
    template, label, base, first, last (smallest and largest start), places, cover."""
    spark = docs.sparkSession
    small_batches(spark)
    given = templates if templates is not None else built_in(spark)
    table = staged(narrow(given, label="string", text="string", base="boolean").mapInArrow(_positions, _POSITIONS))
    sizes = [r.k for r in table.select("k").distinct().collect()]  # LONG values at most
    bitmap = bitmap_of(table, "gram")
    seen = narrow(docs, doc_id="long", text="string").mapInArrow(_hits(sorted(sizes), bitmap), "row long, doc_id long, n_words long, hits array<struct<gram: long, at: long>>")
    own = ["row", "doc_id", "n_words", "template", "label", "base", "size"]
    met = _sent(seen, table) if table.count() <= SENT_ROWS else _dealt(seen, table)
    diagonals = met.withColumn("diagonal", F.col("at") - F.col("place")).groupBy(*own, "diagonal").agg(F.collect_set("place").alias("seen"))
    line = Window.partitionBy("row", "template").orderBy("diagonal")
    step = F.coalesce((~F.col("base") & (F.col("diagonal") - F.lag("diagonal").over(line) <= NEAR)), F.lit(False))
    merged = diagonals.withColumn("new", F.when(step, 0).otherwise(1)).withColumn("span", F.sum("new").over(line))
    gathered = merged.groupBy(*own, "span").agg(F.min("diagonal").alias("start"), F.collect_list(F.struct("diagonal", "seen")).alias("parts"))
    covered = gathered.mapInArrow(_forward, "row long, doc_id long, n_words long, template long, label string, base boolean, size int, span long, start long, found long")
    cover = F.col("found") / F.col("size")
    ok = F.when(F.col("base"), F.col("found") == F.col("size")).otherwise(cover >= COVER)
    return covered.groupBy("row", "doc_id", "n_words", "template", "label", "base").agg(
        F.min(F.when(ok, F.col("start"))).alias("first"), F.max(F.when(ok, F.col("start"))).alias("last"),
        F.count(F.when(ok, F.lit(1))).alias("places"), F.max(F.when(ok, cover)).alias("cover"),
    )


def licenses(docs: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """Every row of ``docs`` (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A null text is empty: no words, no labels (empty strings), score 0, null places. n_base counts all places of
    all base phrases, overlapping ones too. Rows may repeat; other columns are not read; an empty table gives
    an empty result. templates: label, text, base (a phrase that must stand as it is), instead of the built-in ones.
    """
    found, base = spans(docs, templates), F.col("base")
    text = lambda cond: F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("label")))), ",")
    has = F.col("places") > 0
    return found.groupBy("row", "doc_id", "n_words").agg(
        F.coalesce(F.sum(F.when(base, F.col("places"))), F.lit(0)).alias("n_base"), F.min(F.when(base, F.col("first"))).alias("first_word"), F.max(F.when(base, F.col("last"))).alias("last_word"),
        text(base & has).alias("base_labels"), text(has).alias("labels"), F.coalesce(F.max("cover"), F.lit(0.0)).cast("double").alias("score"),
    ).drop("row")
