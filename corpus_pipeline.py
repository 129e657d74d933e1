"""Training-data pipeline over the documents table.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept: rows that the quality classifier rejects go, one
document of each near-duplicate group stays, repeated passages are cut out of the texts, documents with benchmark passages
go, and what is left is packed. All stages but the last return the columns of documents. The steps have no SQL form (a trained
model, graph components, byte windows), so there is no ORACLE_SQL.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from caseloom.llm import decontaminate, neardup, packing, quality, suffixdedup
from caseloom.llm.common import cut, fold, short_batches, table

ORACLE_SQL = None


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a quality score of at least 0.5, by a model of the labelled rows outside the held-out third."""
    short_batches(spark)
    labels = table(spark, sf_dir, "labels").filter(fold("doc_id", 3) != 1)
    return quality.score(docs, quality.train(docs, labels)).filter("score >= 0.5").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-copy group, the one of the smallest id.

    SimHash fingerprints of at most 4 differing bits link; so do edited copies that fingerprints do not tell, by a Jaccard similarity of
    their five-word shingles of at least 0.8.
    """
    short_batches(spark)
    return neardup.keep_one(docs, distance=4)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of over 50 words, or of 400 bytes and more, that occur anywhere else."""
    short_batches(spark)
    return suffixdedup.without_repeats(docs, words=51)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, in its words or with other numbers and names."""
    short_batches(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, packed into sequences of 4096 tokens."""
    short_batches(spark)
    pieces = packing.encode_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
    return packing.pack(pieces.drop("ids"))


STAGES = [
    ("quality classifier", classify),
    ("SimHash near-dedup", drop_near_copies),
    ("suffix-array dedup", drop_repeats),
    ("benchmark decontamination", drop_leaks),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each over the written result of the one before."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
