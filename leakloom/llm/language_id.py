"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Weights are learned by follow-the-regularised-leader with an elastic-net penalty, on shards whose weights are averaged;
a temperature fitted on texts kept apart from training makes the scores probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .char_ngrams import ngram_buckets
from .common import fold_of

SIZES, BITS = (1, 2, 3), 16
#: The one test for a letter, the same for learning and prediction.
LETTER = regex.compile(r"\p{L}")
SHARDS = 4


def features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that a text has, and their TF-IDF, of length 1."""
    counts = np.bincount(ngram_buckets(text, SIZES, BITS), minlength=1 << BITS)
    has = np.flatnonzero(counts)
    value = np.log1p(counts[has]) * idf[has]
    return has, value / (np.sqrt((value * value).sum()) or 1.0)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass(frozen=True)
class Model:
    """weight: bucket by language, the last row is the bias; idf: of each bucket."""

    languages: tuple[str, ...]
    weight: np.ndarray
    idf: np.ndarray
    temperature: float

    def logits(self, text: str) -> np.ndarray:
        has, value = features(text, self.idf)
        return value @ self.weight[has] + self.weight[-1]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not text or not LETTER.search(text):
            return "und", 1.0 if self.languages else 0.0
        p = softmax(self.logits(text) / self.temperature)
        return self.languages[int(p.argmax())], float(p.max())


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], languages: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3) -> np.ndarray:
    """Follow the regularised leader, one text at a time. Weights within the L1 penalty are exactly 0."""
    z = np.zeros(((1 << BITS) + 1, languages))
    n = np.zeros_like(z)

    def weights(at):
        small = np.abs(z[at]) <= l1
        return np.where(small, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for has, value, label in rows:
            at, x = np.append(has, 1 << BITS), np.append(value, 1.0)
            w = weights(at)
            p = softmax(x @ w)
            p[label] -= 1.0
            g = x[:, None] * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    return weights(slice(None))


def fit(docs: DataFrame, max_rows: int = 6000, folds: int = 3, held: int = 1) -> Model:
    """Fit on about max_rows documents outside the held-out fold that have a language and a letter, drawn by a hash of doc_id.

    Each language gives an equal share of them, or all it has if that is less, so that a rare language is learned too. A
    fifth of them sets the temperature. Without any such document the model knows no language.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (fold_of(F.col("doc_id"), folds) != held))
    have = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}  # one row a language
    quota = max_rows / max(1, len(have))
    share = F.create_map(*(x for lang, n in have.items() for x in (F.lit(lang), F.lit(int(min(1.0, quota / n) * (1 << 30)))))) if have else F.create_map().cast("map<string,int>")
    rows = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share[F.col("lang")]).select("doc_id", "text", "lang")
    rows = rows.withColumn("test", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5)) == 0).repartition(SHARDS, F.xxhash64("doc_id")).sortWithinPartitions(F.xxhash64("doc_id"), "text", "lang").persist()
    try:
        languages = tuple(sorted(r.lang for r in rows.select("lang").distinct().collect()))
        if not languages:
            return Model((), np.zeros((1, 0)), np.zeros(1), 1.0)
        code = {x: i for i, x in enumerate(languages)}

        def document_counts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            have, n = np.zeros(1 << BITS, np.int64), 0
            for part in parts:
                for text in part.text:
                    have[np.unique(ngram_buckets(text, SIZES, BITS))] += 1
                n += len(part)
            yield pd.DataFrame({"n": [n], "have": [have]})

        counted = rows.select("text").mapInPandas(document_counts, "n long, have array<long>").toPandas()
        idf = np.log((1 + counted.n.sum()) / (1 + np.sum(np.stack(counted.have), axis=0))) + 1

        def train(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            data = [(*features(t, idf), code[x]) for part in parts for t, x in zip(part.text, part.lang, strict=True)]
            if data:
                order = np.random.default_rng(5).permutation(len(data))
                w = ftrl([data[i] for i in order], len(languages))
                kept = np.flatnonzero(w.any(axis=1))
                yield pd.DataFrame({"bucket": [kept], "weight": [w[kept].ravel()], "rows": [len(data)]})

        parts = rows.where(~F.col("test")).mapInPandas(train, "bucket array<long>, weight array<double>, rows long").toPandas()
        weight = np.zeros(((1 << BITS) + 1, len(languages)))
        for bucket, w, n in zip(parts.bucket, parts.weight, parts.rows, strict=True):
            weight[bucket] += np.reshape(w, (-1, len(languages))) * (n / parts.rows.sum())
        model = Model(languages, weight, idf, 1.0)

        def logits(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                yield pd.DataFrame({"label": part.lang.map(code), "z": [model.logits(t) for t in part.text]})

        kept = rows.where("test").mapInPandas(logits, "label int, z array<double>").toPandas()
        return Model(languages, weight, idf, temperature(np.stack(kept.z), kept.label.to_numpy()) if len(kept) else 1.0)
    finally:
        rows.unpersist()


def temperature(z: np.ndarray, label: np.ndarray) -> float:
    """The divisor of logits with the least log loss, to a few per cent."""
    tries = np.geomspace(0.05, 20, 100)
    loss = [-np.log(np.maximum(softmax(z / t)[np.arange(len(label)), label], 1e-12)).mean() for t in tries]
    return float(tries[int(np.argmin(loss))])


def identify_language(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of each row, whole texts.

    A text that is null, empty or without a letter is `und`; a null doc_id stays null; repeated rows each give a row; an
    empty table gives none; other columns, whatever their names, are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                found = [held.value.predict(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(predict, "doc_id long, lang_pred string, score double")


def language_digest(docs: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row, learnt outside the held-out fold; odd rows as in identify_language."""
    found = identify_language(docs, fit(docs, folds=folds, held=held))
    return found.select("doc_id", (fold_of(F.col("doc_id"), folds) == held).alias("held_out"), "lang_pred", "score")
