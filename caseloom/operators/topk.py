"""Ordering, paging and top-k selections. Every order ends in a unique key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ranking(entities: DataFrame, limit: int, entity_type: str | None = None) -> DataFrame:
    """Highest scores first, protected rows left out."""
    kept = entities.filter(~F.col("is_protected"))
    if entity_type:
        kept = kept.filter(F.col("entity_type") == entity_type)
    return kept.orderBy(F.desc("score"), "entity_id").limit(limit)


def case_order(df: DataFrame, first: Column, then: list[Column]) -> DataFrame:
    """Rows with the condition first, then by the given order."""
    return df.orderBy(F.when(first, 0).otherwise(1), *then)


def next_in_queue(docs: DataFrame, eligible: Column, done: DataFrame, key: str, priority: str, n: int) -> DataFrame:
    """The next ``n`` eligible rows that are not done, by priority."""
    return docs.filter(eligible).join(done.select(key), key, "left_anti").orderBy(F.desc(priority), key).limit(n)


def frequent_pairs(edges: DataFrame, at_least: int = 3, n: int | None = None) -> DataFrame:
    """Edges seen often, most often first; the first ``n``, or all."""
    pairs = edges.filter(F.col("evidence") >= at_least).orderBy(F.desc("evidence"), "source_id", "target_id")
    return pairs if n is None else pairs.limit(n)


def capped_nodes(nodes: DataFrame, n: int) -> DataFrame:
    """Connected nodes first, then by score and degree."""
    return nodes.orderBy(F.when(F.col("degree") > 0, 0).otherwise(1), F.desc("score"), F.desc("degree"), "entity_id").limit(n)


def known_names(entities: DataFrame, n: int) -> DataFrame:
    """One row: the names of the ``n`` best unprotected entities, best first."""
    top = entities.filter(~F.col("is_protected")).orderBy(F.desc("score"), "entity_id").limit(n)
    listed = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "entity_id", "name")))
    return top.agg(F.array_join(F.transform(listed, lambda r: r["name"]), "; ").alias("names"),
                   F.count(F.lit(1)).alias("n"))
