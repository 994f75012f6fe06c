"""Toxicity: a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

A text's features are the distinct hashed n-grams it has, each worth its log-count ratio: how much likelier it is among
toxic than among other training texts. Features whose ratio could be chance are left out; a logistic regression with an
L2 penalty weighs the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .char_ngrams import ngram_buckets
from .common import fold_of

SIZES, BITS = (3, 4, 5, 6), 20
BLOCK = 1 << 15
#: Entries of the training matrix that are worked on at a time.
CHUNK = 1 << 19


@dataclass(frozen=True)
class Model:
    """weight: of each bucket, its ratio included; bias: of a text without features."""

    weight: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        buckets = ngram_buckets(text or "", SIZES, BITS)
        return float(1 / (1 + np.exp(-(self.bias + self.weight[distinct(buckets)].sum(dtype=np.float64)))))


_seen = np.zeros(1 << BITS, np.int32)


def distinct(buckets: np.ndarray) -> np.ndarray:
    """Each bucket once, without a sort: the last of equal ones overwrites the others."""
    places = np.arange(len(buckets), dtype=np.int32)
    _seen[buckets] = places
    return buckets[_seen[buckets] == places]


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int, folds: int = 5, held: int = 0) -> DataFrame:
    """text, label of at most max_rows labelled documents outside the held-out fold, those with the least hash of doc_id.

    A document with several labels counts as toxic if any says so; labels that are null don't count.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id"), folds) != held))
    known = known.groupBy(F.col("doc_id").alias("labelled")).agg(F.max("toxic").alias("label"))
    drawn = known.orderBy(F.xxhash64("labelled"), "labelled").limit(max_rows)  # ids and labels only
    return docs.select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("labelled")).select("text", "label")


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 16_000, alpha: float = 1.0, z: float = 4.0, most_features: int = 20_000, penalty: float = 1.0, steps: int = 300) -> Model:
    """Fit on a bounded sample: at most max_rows labelled texts, most_features features.

    Without rows of both labels, every text gets the share of toxic rows (a half if there are none).
    """
    rows = training_rows(docs, labels, max_rows).repartition(8).persist()
    try:
        counted = {r.label: r["count"] for r in rows.groupBy((F.col("label") > 0).cast("int").alias("label")).count().collect()}
        no, yes = counted.get(0, 0), counted.get(1, 0)
        weight = np.zeros(1 << BITS, np.float32)
        if not no or not yes:
            return Model(weight, float(np.log((yes + 0.5) / (no + 0.5))))

        def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            have = np.zeros((2, 1 << BITS), np.float32)
            for part in parts:
                for text, label in zip(part.text, part.label, strict=True):
                    have[int(label > 0), distinct(ngram_buckets(text or "", SIZES, BITS))] += 1
            for b in range(0, 1 << BITS, BLOCK):
                yield pd.DataFrame({"block": [b], "no": [have[0, b : b + BLOCK]], "yes": [have[1, b : b + BLOCK]]})

        def ratios(part: pd.DataFrame) -> pd.DataFrame:
            n, y = (np.sum(np.stack(part[c]), axis=0) for c in ("no", "yes"))
            ratio = np.log((y + alpha) / (yes + 2 * alpha)) - np.log((n + alpha) / (no + 2 * alpha))
            spread = np.sqrt(1 / (y + alpha) + 1 / (n + alpha))
            chosen = np.flatnonzero(np.abs(ratio) > z * spread)
            return pd.DataFrame({"bucket": chosen + part.block.iloc[0], "ratio": ratio[chosen], "sure": np.abs(ratio[chosen]) / spread[chosen]})

        counts = rows.mapInPandas(count, "block int, no array<float>, yes array<float>")
        features = counts.groupBy("block").applyInPandas(ratios, "bucket int, ratio double, sure double")
        chosen = features.orderBy(F.desc("sure"), "bucket").limit(most_features).toPandas().sort_values("bucket")
        ids, ratio = chosen.bucket.to_numpy(np.int64), chosen.ratio.to_numpy()
        place = np.full(1 << BITS, -1, np.int32)
        place[ids] = np.arange(len(ids))

        def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, labels_ = batch.column(0).to_pylist(), batch.column(1)
                found = [place[distinct(ngram_buckets(t or "", SIZES, BITS))] for t in texts]
                yield pa.RecordBatch.from_arrays([labels_.cast(pa.int32()), pa.array([np.sort(x[x >= 0]) for x in found], pa.list_(pa.int32()))], ["label", "has"])

        # The sums below depend on the order of rows: sort them by what they hold.
        matrix = rows.mapInArrow(narrow, "label int, has array<int>").orderBy("label", "has").toArrow()
        has = matrix.column("has").combine_chunks()
        starts, columns, label = has.offsets.to_numpy().astype(np.int64), has.values.to_numpy(), matrix.column("label").to_numpy() > 0
        del matrix
        w, bias = descend(starts, columns, ratio, label, penalty, steps)
        weight[ids] = w * ratio
        return Model(weight, bias)
    finally:
        rows.unpersist()


def descend(starts: np.ndarray, columns: np.ndarray, ratio: np.ndarray, label: np.ndarray, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient descent with diagonal scaling.

    Row i has the features columns[starts[i]:starts[i + 1]], each worth its ratio. Rows are taken in chunks of about
    CHUNK entries, so that temporary arrays stay small whatever the number of rows.
    """
    n, k = len(label), len(ratio)
    cuts = np.unique(np.concatenate((np.searchsorted(starts, np.arange(0, int(starts[-1]) + CHUNK, CHUNK)).clip(0, n), [0, n])))
    chunks = [(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]

    def row_sums(of_feature: np.ndarray) -> np.ndarray:
        out = np.zeros(n)
        for a, b in chunks:
            total = np.concatenate(([0.0], np.cumsum(of_feature[columns[starts[a] : starts[b]]])))
            at = starts[a : b + 1] - starts[a]
            out[a:b] = total[at[1:]] - total[at[:-1]]
        return out

    def feature_sums(of_row: np.ndarray) -> np.ndarray:
        out = np.zeros(k)
        for a, b in chunks:
            out += np.bincount(columns[starts[a] : starts[b]], np.repeat(of_row[a:b], np.diff(starts[a : b + 1])), k)
        return out

    per_row = row_sums(np.abs(ratio)).max(initial=1.0)
    scale = 0.25 * np.abs(ratio) * per_row * feature_sums(np.ones(n)) + penalty
    w, bias = np.zeros(k), float(np.log((label.sum() + 0.5) / (n - label.sum() + 0.5)))
    before, bias_before = w.copy(), bias
    for step in range(steps):
        m = step / (step + 3)
        v, b = w + m * (w - before), bias + m * (bias - bias_before)
        gap = 1 / (1 + np.exp(-np.clip(b + row_sums(v * ratio), -40, 40))) - label
        before, bias_before = w, bias
        w = v - (ratio * feature_sums(gap) + penalty * v) / scale
        bias = b - gap.sum() / n
    return w, float(bias)


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of each row, whole texts.

    Null and empty texts score as a text without features; a null doc_id stays null; repeated rows each give a row; an
    empty table gives none; other columns, whatever their names, are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([held.value.score(t) for t in part.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, score double")


def toxicity_digest(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted of each row, learnt outside the held-out fold; odd rows as in score_toxicity."""
    scored = score_toxicity(docs, fit(docs, labels))
    return scored.select("doc_id", (fold_of(F.col("doc_id"), folds) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose text scores under a half; all columns stay, whatever their names.

    Null and empty texts score as a text without features; rows with a null doc_id are scored like others; repeated rows
    stay or go together; an empty table gives none.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return texts.map(model.value.score)

    return docs.where(score(F.coalesce("text", F.lit(""))) < 0.5)
