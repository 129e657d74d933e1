"""Quality classifier: supervised subword embeddings.

Words, word pairs and byte n-grams (of UTF-8) of a text are hashed to rows of a learned table; their mean is the
document vector, and a softmax over it gives the label. The table and the output layer are trained together
by stochastic gradient descent in numpy on the driver, on a sample bounded by ``rows_per_label`` labelled rows of
each label; features of the sample are made by tasks. A word that repeats the one before it is one feature of its
own, whatever the word. Scoring reads every whole text: the output layer folds into the table, so a text's logit is
the mean of one number per feature.

Null and empty texts have no features and get the score of the bias. Without labelled rows of two labels the score
is 0.5. Repeated rows are scored alike; only id, text (and label) columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.arrays import LOWER, SLICE, WHITE, Prefix, column_bytes, row_sums, runs, slices
from caseloom.llm.common import bounded_sample, cut, with_fields

BUCKETS = 1 << 17
GRAMS = (3, 4, 5)


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket of each feature, first feature of each row), for words, word pairs and each n of ``GRAMS``."""
    low = LOWER[data]
    white = WHITE[low]
    prefix = Prefix(low)
    starts, ends, first = runs(~white, offsets)
    words = prefix.span(starts, ends)
    yield (words % np.uint64(BUCKETS)).astype(np.int64), first
    if len(words) > 1:
        again = words[1:] == words[:-1]
        pairs = words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]
        pairs = np.where(again, np.uint64(1), (pairs >> np.uint64(20)) % np.uint64(BUCKETS)).astype(np.int64)
        inside = np.ones(len(pairs), bool)
        cuts = first[1:-1]
        inside[cuts[(cuts > 0) & (cuts < len(words))] - 1] = False
        kept = np.concatenate(([0], np.cumsum(inside)))
        yield pairs[inside], kept[np.minimum(first, len(pairs))]
    blanks = np.concatenate(([0], np.cumsum(white)))
    for n in GRAMS:
        if len(low) < n:
            continue
        at = np.flatnonzero(blanks[n - 1 : len(low)] == blanks[1 : len(low) - n + 2])  # no blank but at an end
        row_end = offsets[np.searchsorted(offsets, at, "right")]
        at = at[at + n <= row_end]
        grams = prefix.span(at, at + n) >> np.uint64(n)
        yield (grams % np.uint64(BUCKETS)).astype(np.int64), np.searchsorted(at, offsets)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = column_bytes(batch.column("text"))
        label = batch.column("label").to_pylist()
        for i in range(batch.num_rows):
            own = data[offsets[i] : offsets[i + 1]]
            found = [b for b, _ in features(own, np.array([0, len(own)]))]
            bucket, count = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column("order").slice(i, 1), pa.array([label[i]], pa.int32()), pa.array([bucket.astype("<i4").tobytes()]),
                 pa.array([count.astype("<i4").tobytes()])], names=["order", "label", "bucket", "count"])


class Model:
    """Folded weights: the logit of label 1 is ``bias`` plus the mean of ``weight`` over the features."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight.astype(np.float32), bias

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total, number = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
        for bucket, first in features(data, offsets):
            total += row_sums(self.weight[bucket], first)
            number += np.diff(first)
        return 1 / (1 + np.exp(-(total / np.maximum(number, 1) + self.bias)))


def descend(rows: pd.DataFrame, dims: int = 8, epochs: int = 8, rate: float = 1.0, seed: int = 1) -> Model:
    """Train on (label, bucket, count) rows, the labels weighted to equal shares."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / dims, 1 / dims, (BUCKETS, dims))
    output, bias = np.zeros((dims, 2)), np.zeros(2)
    parsed = [(int(y), np.frombuffer(b, "<i4"), np.frombuffer(c, "<i4")) for y, b, c in zip(rows.label, rows.bucket, rows["count"])]
    share = np.bincount([p[0] for p in parsed], minlength=2) / max(len(parsed), 1)
    if (share == 0).any():
        return Model(np.zeros(BUCKETS), 0.0)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for k in rng.permutation(len(parsed)):
            label, bucket, count = parsed[k]
            if not len(bucket):
                continue
            part = (count / count.sum())[:, None]
            vectors = table[bucket]
            mean = (part * vectors).sum(axis=0)
            logits = mean @ output + bias
            chance = np.exp(logits - logits.max())
            error = chance / chance.sum()
            error[label] -= 1
            error *= step * 0.5 / share[label]
            back = output @ error
            output -= np.outer(mean, error)
            bias -= 0.1 * error
            table[bucket] = vectors - part * back * 50
    return Model(table @ (output[:, 1] - output[:, 0]), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows_per_label: int = 1_000) -> Model:
    """Learn ``label`` (0 or 1) of at most ``rows_per_label`` labelled documents of each label.

    Ids are sampled first, so that only the sampled texts leave the scan; the sample is what is broadcast.
    """
    named = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter("label in (0, 1) and doc_id is not null")
    ids = cut(bounded_sample(named, "label", F.xxhash64("doc_id"), rows_per_label), "quality-ids")
    rows = cut(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"), "quality-sample")
    sample = bounded_sample(rows, "label", F.xxhash64("doc_id", "text"), rows_per_label)  # ids may repeat
    counted = sample.select(F.xxhash64("text", "doc_id").alias("order"), "label", "text").mapInArrow(
        _count, "order long, label int, bucket binary, count binary").toPandas()
    return descend(counted.sort_values(["order", "label"]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with its columns and ``score``, the probability of label 1 (a column of that name is replaced)."""
    docs = docs.drop("score")
    sent = docs.sparkSession.sparkContext.broadcast((model.weight, model.bias))  # BUCKETS numbers, whatever the input

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            parts = [own.score(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in slices(offsets, SLICE // 4)]
            values = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values)], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(scored, with_fields(docs.schema, score="double"))
