"""Nearest-centroid language identification.

Texts become normalised TF-IDF vectors of byte n-grams (2 and 3 bytes, hashed). Document frequencies
are counted over all training rows by Spark; centroids (several a language, by spherical k-means) are
fitted on a bounded sample of labelled rows: SAMPLE rows a language. A text takes the language of the
centroid with the largest cosine; one that is too far from every centroid is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, fresh, keep_only, narrow, small_batches

FEATURES = 4096
#: Labelled rows a language that centroids are fitted on, and all of them at most; with more languages each has fewer. The bounds of the fit.
SAMPLE, SAMPLE_ALL = 250, 8000
#: Labels of fewer training rows are no languages, nor are those beyond the most frequent: the model's size is bounded by their number.
MIN_ROWS, LABELS = 5, 200
CENTROIDS = 4
ROUNDS = 12
#: A text is rejected when its cosine is below a floor for its length (a power of two n-grams). The floor lies this far from what 9 in 10 sample rows
#: of about that length stay under with other languages' centroids towards what 19 in 20 reach with their own (a few labels are wrong). For lengths that fewer than
#: LENGTH_ROWS sample rows have it is that of the next shorter one, or SHORT_REJECT of what 99 in 100 reach at any length.
REJECT, SHORT_REJECT, LENGTH_ROWS = 0.2, 0.3, 20
#: The label of a text that is null or has no letter.
NONE = "und"
_PLAIN = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def counts(text: str | None) -> np.ndarray:
    """Counts of hashed n-grams of the whole lower-cased text; what is no letter counts as a space."""
    b = np.frombuffer(b" " + (text or "").lower().encode().translate(_PLAIN) + b" ", np.uint8).astype(np.uint32)
    two = b[:-1] * np.uint32(257) + b[1:]
    three = two[:-1] * np.uint32(263) + b[2:] + np.uint32(1 << 25)
    h = np.concatenate([two, three]) * np.uint32(2654435761) >> np.uint32(20)
    return np.bincount(h, minlength=FEATURES).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _document_counts(batches: Iterator) -> Iterator:
    """One row a feature and task: in how many texts it is; feature -1: texts."""
    import pyarrow as pa

    keep_only("language")
    seen, n = np.zeros(FEATURES, np.int64), 0
    for b in batches:
        for t in b["text"].to_pylist():
            seen += counts(t) > 0
            n += 1
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, FEATURES)), pa.array(np.concatenate([[n], seen]))], ["feature", "texts"])


def _vectors(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for b in batches:
        yield pa.RecordBatch.from_arrays([b["lang"], pa.array([np.log1p(counts(t)).astype("<f2").tobytes() for t in b["text"].to_pylist()], pa.binary())], ["lang", "logs"])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _length(n: np.ndarray) -> np.ndarray:
    """The power of two of a number of n-grams, 31 at most."""
    return np.clip(np.log2(np.maximum(n, 1)).astype(int), 0, 31)


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    labels: list[str]
    #: the least cosine of a text that isn't rejected, by its length (see _length)
    floor: np.ndarray

    def predict(self, texts: list) -> tuple[list[str], np.ndarray, list[bool]]:
        """Label, cosine (0 to 1), and whether the text is rejected."""
        labels, scores, far = [], np.zeros(len(texts)), []
        for k in range(0, len(texts), 128):
            part = texts[k : k + 128]
            n = np.stack([counts(t) for t in part])
            near = _unit(np.log1p(n) * self.idf) @ self.centroids.T if self.labels else np.zeros((len(part), 1))
            best, floor = near.argmax(axis=1), self.floor[_length(n.sum(axis=1))] if self.labels else np.zeros(len(part))
            for i, t in enumerate(part):
                known = bool(self.labels) and has_letter(t)
                labels.append(self.labels[best[i]] if known else NONE)
                scores[k + i] = min(1.0, max(0.0, float(near[i, best[i]]))) if known else 0.0
                far.append(not known or scores[k + i] < floor[i])
        return labels, scores, far


def _kmeans(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from the farthest points; deterministic."""
    centre = _unit(x.mean(axis=0, keepdims=True))
    for _ in range(min(k, len(x)) - 1):
        centre = np.concatenate([centre, x[[(x @ centre.T).max(axis=1).argmin()]]])
    for _ in range(ROUNDS):
        own = (x @ centre.T).argmax(axis=1)
        centre = np.stack([_unit(x[own == j].mean(axis=0)) if (own == j).any() else centre[j] for j in range(len(centre))])
    return centre


def fit(rows: DataFrame, sample: int = SAMPLE) -> Model:
    """rows: doc_id, text, lang (training rows; a null lang or a text without letters is left out).
    The sample is the rows of smallest doc_id hash in each language."""
    small_batches(rows.sparkSession)
    rows = rows.where("lang IS NOT NULL AND text RLIKE '\\\\p{L}'").select("doc_id", "lang", "text")
    seen = rows.select("text").mapInArrow(_document_counts, "feature long, texts long").groupBy("feature").agg(F.sum("texts").alias("texts")).collect()
    frequent = rows.groupBy("lang").count().where(F.col("count") >= MIN_ROWS).orderBy(F.desc("count"), "lang").limit(LABELS)
    sizes = {r.lang: r["count"] for r in frequent.collect()}
    sample = min(sample, max(1, SAMPLE_ALL // max(len(sizes), 1)))
    total = max([r.texts for r in seen if r.feature < 0], default=0)
    df = np.zeros(FEATURES)
    for r in seen:
        if r.feature >= 0:
            df[r.feature] = r.texts
    idf = np.log((1 + total) / (1 + df)).astype(np.float32) + 1
    # thin out by hash to about twice the bound before the exact bound, so no language is ranked in one task
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, (2 * sample + 50) / n))]) if sizes else None
    if not sizes:
        return Model(idf, np.zeros((0, FEATURES), np.float32), [], np.zeros(32))
    hashed = F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1 << 30))
    few = rows.withColumn("h", hashed).where(F.col("h") < share[F.col("lang")] * (1 << 30))  # no share: no language
    few = few.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("n") <= sample)
    got: dict[str, list] = {}
    for r in few.select("lang", "text").mapInArrow(_vectors, "lang string, logs binary").collect():
        got.setdefault(r.lang, []).append(np.frombuffer(r.logs, "<f2"))
    centroids, labels, reached, length, units = [], [], [], [], []
    for lang in sorted(got):
        logs = np.stack(got[lang]).astype(np.float32)
        x = _unit(logs * idf)
        c = _kmeans(x, CENTROIDS)
        centroids.append(c)
        labels += [lang] * len(c)
        units.append(x)
        reached.append((x @ c.T).max(axis=1))
        length.append(_length(np.expm1(logs).sum(axis=1)))
    reached, length, rows = np.concatenate(reached), np.concatenate(length), np.concatenate(units)
    own = np.repeat(sorted(got), [len(u) for u in units])
    other = np.where(own[:, None] != np.array(labels)[None], rows @ np.concatenate(centroids).T, 0).max(axis=1)
    floor = np.full(32, SHORT_REJECT * np.quantile(reached, 0.01))
    for k in range(1, 32):
        if (length == k).sum() >= LENGTH_ROWS:
            low, high = np.quantile(other[length == k], 0.9), np.quantile(reached[length == k], 0.05)
            floor[k] = low + REJECT * (high - low) if high > low else floor[0]
        else:
            floor[k] = floor[k - 1]
    # no length is held to more than half of them are: a few wrong labels can raise what others stay under
    floor = np.minimum(floor, np.median(np.unique(floor[floor > floor[0]]))) if (floor > floor[0]).any() else floor
    return Model(idf, np.concatenate(centroids).astype(np.float32), labels, floor)


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows with crc32(doc_id as text) mod 3 other than 1; a null doc_id trains too."""
    return narrow(docs, doc_id="long", text="string", lang="string").where(~held_out(F.col("doc_id")))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def predictor(spark, model: Model):
    """A column function: text -> struct(lang_pred, score, rejected). The model has a fixed size a language."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(text: pd.Series) -> pd.DataFrame:
        labels, scores, far = sent.value.predict([None if t is None or t != t else t for t in text])
        return pd.DataFrame({"lang_pred": labels, "score": scores, "rejected": far})

    return predict


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Every row of ``docs`` (doc_id, text, lang): doc_id, held_out, lang_pred, score, rejected.

    Learns from rows that aren't held out; lang is no input of a prediction. A text that is null or has no
    letter is ``und`` with score 0; rows may repeat; other columns are not read; without any labelled row all
    are ``und``; an empty table gives an empty result.
    """
    predict = predictor(docs.sparkSession, fit(training_rows(docs), sample))
    rows = narrow(docs, doc_id="long", text="string")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict("text").alias("p")).select("doc_id", "held_out", "p.*")


def keep_identified(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, with all columns, that the classifier does not reject. A table from which no language can be learnt is kept
    whole: nothing says then that a text is in none of them."""
    model = fit(training_rows(docs), sample)
    if not model.labels:
        return docs
    predict = predictor(docs.sparkSession, model)
    names, rejected = docs.columns, fresh(docs, "rejected")
    seen = docs.select(*[column(docs, n) for n in names], predict(column(docs, "text").cast("string"))["rejected"].alias(rejected))
    return seen.where(~column(seen, rejected)).select(*[column(seen, n) for n in names])
