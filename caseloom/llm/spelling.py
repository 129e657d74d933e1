"""Spelling variants grouped by a relational walk through a trie of the vocabulary.

Words are runs of letters, lower-cased in A to Z only, that are long and frequent enough. Two words are near if one inserted, deleted or replaced
code point turns one into the other. The form of a word is its most frequent near word (ties: the smallest in code-point order), if that is
``ratio`` times as frequent; its root is reached by following forms.

Trie. Nodes are prefixes. A node that neither ends a word nor branches is passed over, so an edge carries a label of one or more characters, and
there are as many levels as branching places on a word, not as letters. The edge table of a level is one aggregation: of the words below a
node that go on with the same character, the smallest and the largest share what all share. An edge also knows whether
its child ends a word, and by which characters it goes on.

Frontier. States (word, position, node, edits) move down one level a round by a join with the edges of that level. With no edit so
far, the label may differ in one character, or be what is left when one character of the word is dropped; with one edit spent, it must be equal,
so the join is on the node and the next character. A state lives on only if its child goes on with the next character, or
ends as the word does. States that end at the end of a word with one edit are near pairs. A pair is found from one of its sides (the longer
word, or of equal length the smaller one) and turned round, which spares the branches of inserted characters.

Rows at scale: states without an edit are one a word and level; those with one are a few a word, most of which end at the next label. The
first levels, where all words meet at few nodes, have at most as many edges as the alphabet allows, 90 and 8,100; a level of at most
``MOST_EDGES`` edges is broadcast after its count, a larger one is joined by node and split by Spark where it is skewed. Counts are combined
before they are shuffled. Every level is written to the shared folder.

Rows: a null text has no words; a null id counts as empty text in the hash below; repeated rows count again. An empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.llm.common import cut

LETTERS = "A-Za-zÀ-ÿ"
#: Words counted in a task before they are handed on, and edges of a level that are broadcast.
HELD_WORDS = 200_000
MOST_EDGES = 20_000


def _count(least: int, typos: int | None):
    long_runs = re.compile(f"[{LETTERS}]{{{least},}}")

    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                found = long_runs.findall(text.encode().lower().decode()) if text else []  # bytes lower A to Z only
                if not typos:
                    counts.update(found)
                    continue
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for run in found:
                    h = zlib.crc32(run.encode(), start)
                    if h % typos:
                        counts[run] += 1
                    elif len(run) > least:
                        at = h % len(run)
                        counts[run[:at] + run[at + 1 :]] += 1
            if len(counts) > HELD_WORDS:
                yield rows(counts)
                counts = Counter()
        yield rows(counts)

    return work


def vocabulary(docs: DataFrame, least_length: int = 7, least_count: int = 2, typos: int | None = None) -> DataFrame:
    """(word, n) of (doc_id, text). With ``typos``, a run loses a character if that number divides the crc32 of ``<doc_id>:<run>``."""
    counted = docs.select("doc_id", "text").mapInArrow(_count(least_length, typos), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


@F.pandas_udf(T.StringType())
def _common_prefix(low: pd.Series, high: pd.Series) -> pd.Series:
    return pd.Series([os.path.commonprefix(pair) for pair in zip(low, high)], dtype=object)


def _char(of: str, at) -> F.Column:
    """The character of ``of`` behind its first ``at``."""
    return F.substring(of, at + 1, F.lit(1))


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near): all pairs, both ways round, of the distinct strings in ``words`` that are one edit apart."""
    paths = words.select("word", F.lit("").alias("node"), F.substring("word", 1, 1).alias("first")).filter("word <> ''")
    states, found, level = None, [], 0
    while True:
        grouped = paths.groupBy("node", "first").agg(F.min("word").alias("low"), F.max("word").alias("high"))
        edges = cut(grouped.select("node", "first", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(
            _common_prefix("low", "high")).alias("child")), "trie-edges")
        number = edges.count()
        if not number:
            break
        few = F.broadcast if number <= MOST_EDGES else (lambda df: df)
        below = cut(paths.join(few(edges), ["node", "first"]).select("word", F.col("child").alias("node"), _char("word", F.length("child")).alias("first")), "trie-paths")
        ends = below.groupBy(F.col("node").alias("child")).agg(
            F.max(F.col("word") == F.col("node")).alias("ends"), F.collect_set(F.when(F.col("first") != "", F.col("first"))).alias("nexts"))
        size = F.length("child") - F.length("node")
        edges = few(cut(edges.join(ends, "child").select("*", F.substring("child", F.length("node") + 1, size).alias("label"), size.alias("size")), "trie-labels"))

        taken = F.substring("word", F.length("node") + 1, F.col("size") + F.col("more"))
        moved = paths.drop("first").join(edges, "node").withColumn("more", F.explode(F.array(F.lit(0), F.lit(1)))).filter(
            (F.length(taken) == F.col("size") + F.col("more")) & (F.levenshtein(taken, F.col("label"), 1) == 1)
            & ((F.col("more") == 1) | (taken < F.col("label")))
        ).select("word", (F.length("child") + F.col("more")).alias("at"), "child", "ends", "nexts")
        if states is not None:
            same = F.substring("word", F.col("at") + 1, F.col("size")) == F.col("label")
            moved = moved.unionByName(states.withColumn("first", _char("word", F.col("at"))).join(edges, ["node", "first"]).filter(same).select(
                "word", (F.col("at") + F.col("size")).alias("at"), "child", "ends", "nexts"))
        left = _char("word", F.col("at"))
        alive = cut(moved.filter(F.when(left == "", F.col("ends")).otherwise(F.array_contains("nexts", left))).select("word", "at", F.col("child").alias("node")), "trie-states")
        found.append(alive.filter(F.col("at") == F.length("word")).select("word", F.col("node").alias("near")))
        states = alive.filter(F.col("at") < F.length("word"))
        paths = below.filter("first <> ''")
        level += 1
    if not found:
        return words.select("word", F.col("word").alias("near")).limit(0)
    pairs = reduce(DataFrame.unionByName, found)
    return pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("word").alias("near"))).distinct()


def variants(vocab: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of (word, n) with distinct words."""
    vocab = cut(vocab.select("word", "n"), "vocabulary")
    known = near_pairs(vocab).join(vocab.select(F.col("word").alias("near"), F.col("n").alias("m")), "near")
    best = known.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("minus"), "near")).alias("best"))
    enough = -F.col("best.minus") >= F.lit(ratio) * F.col("n")
    rows = cut(vocab.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.near")).alias("form"),
        F.when(enough, -F.col("best.minus")).alias("form_n")), "forms")
    forms = rows.filter("form IS NOT NULL").select(F.col("word").alias("root"), F.col("form").alias("next"))
    roots = rows.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:  # counts grow by the ratio at each step, so the rounds are as few as the digits of the largest
        followed = cut(roots.join(forms, "root", "left"), "roots")
        roots = followed.select("word", F.coalesce("next", "root").alias("root"))
        if not followed.filter("next IS NOT NULL").limit(1).count():
            break
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
