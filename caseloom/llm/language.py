"""Language identification by words first, then shorter and shorter byte n-grams.

A known word counts by its log frequency in each language. A word not seen in training falls back to its longest
known byte n-grams (of UTF-8, so a letter outside ASCII is two to four): if any of its 5-grams is known, the mean of the log frequencies of those, else 4-grams,
and so on. The language of the highest sum wins; the score is its share of a softmax over the sums.

The tables are learned from at most ``rows_per_lang`` documents of each language (those of the lowest hash), counted
by tasks and kept up to ``KEPT`` most frequent entries for each order, so they are bounded whatever the corpus. Every text
is scored whole. Null texts, and texts with no letter, are ``und`` with score 0; with nothing learned all are. Null languages
are not learned. Repeated rows are scored alike; a column ``lang_pred`` or ``score`` of the input is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseloom.llm.arrays import SLICE, Prefix, column_bytes, look_up, row_sums, runs, slices
from caseloom.llm.common import bounded_sample, cut, with_fields

#: Entries kept for words and for each n.
KEPT = 200_000
#: Order 0 is words.
ORDERS = (5, 4, 3, 2, 1)
#: Bytes of words: ASCII letters and everything beyond ASCII.
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _lower(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column_bytes(pc.utf8_lower(column))


def _grams(starts: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, word) of every n-gram of the words."""
    number = np.maximum(ends - starts - n + 1, 0)
    word = np.repeat(np.arange(len(starts)), number)
    return np.arange(len(word)) - np.repeat(np.cumsum(number) - number, number) + starts[word], word


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, n, hash, count) of the batch; n is 0 for words."""
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        data, offsets = _lower(batch.column("text"))
        for lang in dict.fromkeys(langs.tolist()):
            rows, found = np.flatnonzero(langs == lang), {0: [], **{n: [] for n in ORDERS}}
            for r in rows:
                own = data[offsets[r] : offsets[r + 1]]
                prefix = Prefix(own)
                starts, ends, _ = runs(LETTER[own], np.array([0, len(own)]))
                found[0].append(prefix.span(starts, ends))
                for n in ORDERS:
                    at, _ = _grams(starts, ends, n)
                    found[n].append(prefix.span(at, at + n))
            for n, hashes in found.items():
                value, count = np.unique(np.concatenate(hashes), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(value), pa.string()), pa.array(np.full(len(value), n, np.int32)), pa.array(value.view(np.int64)),
                     pa.array(count.astype(np.int64))], names=["lang", "n", "hash", "count"])


class Model:
    """For each order sorted hashes and the log frequency of each in every language."""

    def __init__(self, langs: list[str], tables: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.langs, self.tables = langs, tables

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language, score) of each row of lower-case bytes."""
        starts, ends, first = runs(LETTER[data], offsets)
        prefix = Prefix(data)
        words, sample, place = np.unique(prefix.span(starts, ends), return_index=True, return_inverse=True)
        value = np.zeros((len(words), len(self.langs)))
        spot, known = look_up(self.tables[0][0], words)
        value[known] = self.tables[0][1][spot[known]]
        open_ = np.flatnonzero(~known)
        for n in ORDERS:
            if not len(open_):
                break
            at, word = _grams(starts[sample[open_]], ends[sample[open_]], n)
            spot, known = look_up(self.tables[n][0], prefix.span(at, at + n))
            at, word, spot = at[known], word[known], spot[known]
            number = np.bincount(word, minlength=len(open_))
            for k in range(len(self.langs)):
                total = np.bincount(word, self.tables[n][1][spot, k], minlength=len(open_))
                value[open_, k] = total / np.maximum(number, 1)
            open_ = open_[number == 0]
        value[open_] = 0
        sums = np.column_stack([row_sums(value[place, k], first) for k in range(len(self.langs))])
        best = sums.argmax(axis=1)
        return best, 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)


def train(docs: DataFrame, rows_per_lang: int = 1_000) -> Model | None:
    """Learn from (doc_id, text, lang); None if no text has a language."""
    known = docs.select("doc_id", "text", "lang").filter("lang is not null and text is not null")
    sample = bounded_sample(known, "lang", F.xxhash64("doc_id", "text"), rows_per_lang)
    counts = cut(sample.select("lang", "text").mapInArrow(_count, "lang string, n int, hash long, count long")
                 .groupBy("lang", "n", "hash").agg(F.sum("count").alias("count")), "language-counts")
    totals = counts.groupBy("lang", "n").agg(F.sum("count").alias("total")).toPandas()
    if not len(totals):
        return None
    langs = sorted(totals.lang.unique())
    rank = F.row_number().over(Window.partitionBy("n").orderBy(F.desc("all"), "hash"))
    top = counts.groupBy("n", "hash").agg(F.sum("count").alias("all")).withColumn("rank", rank).filter(F.col("rank") <= KEPT)
    rows = counts.join(top.select("n", "hash"), ["n", "hash"]).toPandas()
    tables = {}
    for n in (0, *ORDERS):
        own = rows[rows.n == n]
        hashes, place = np.unique(own.hash.to_numpy(np.int64).view(np.uint64), return_inverse=True)
        seen = np.full((len(hashes), len(langs)), 0.5)
        seen[place, np.searchsorted(langs, own.lang)] += own["count"]
        total = totals[totals.n == n].set_index("lang").total.reindex(langs).fillna(0).to_numpy()
        tables[n] = hashes, np.log(seen / (total + 0.5 * max(len(hashes), 1))).astype(np.float32)
    return Model(langs, tables)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with lang_pred and score."""
    docs = docs.drop("lang_pred", "score")
    if model is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.tables))  # at most 6 * KEPT entries

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        names = np.array(own.langs, object)
        for batch in batches:
            texts = batch.column("text")
            data, offsets = _lower(texts)
            best, score = [np.zeros(0, np.int64)], [np.zeros(0)]
            for i, j in slices(offsets, SLICE):
                found = own.predict(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                best.append(found[0])
                score.append(found[1])
            letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            lang = np.where(letters, names[np.concatenate(best)], "und")
            score = np.where(letters, np.concatenate(score), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score)],
                                             names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(predicted, with_fields(docs.schema, lang_pred="string", score="double"))
