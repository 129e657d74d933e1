"""Edge weights and entity scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.fixed import BASE_EDGE_WEIGHT, DECAY


def literal_map(values: dict, default) -> "callable":
    """Column lookup in a small fixed mapping."""
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return lambda column: F.coalesce(F.element_at(table, column), F.lit(default))


def edge_weight(kind: Column, evidence: Column) -> Column:
    """base(kind) * (1 + log2 n); the base alone where nothing supports the edge."""
    base = literal_map(BASE_EDGE_WEIGHT, 1.0)(kind)
    return F.when(evidence <= 0, base).otherwise(base * (1 + F.log2(evidence)))


def both_ends(edges: DataFrame, source: str = "source_id", target: str = "target_id") -> DataFrame:
    """Each edge seen from both of its ends: adds ``entity_id`` and ``other_id`` (one pass, no union)."""
    return edges.withColumn(
        "_end",
        F.explode(F.array(
            F.struct(F.col(source).alias("entity_id"), F.col(target).alias("other_id")),
            F.struct(F.col(target).alias("entity_id"), F.col(source).alias("other_id")),
        )),
    ).select("*", "_end.entity_id", "_end.other_id").drop("_end")


def decayed_average(evidence: DataFrame) -> DataFrame:
    """Per entity: evidence count and the rank-decayed mean of its positive scores.

    Equal scores occupy consecutive ranks, so their weights form a geometric
    series: counts per (entity, score) are enough, and no entity's evidence is
    ever ordered row by row in one task.
    """
    counts = (
        evidence.filter(F.col("evidence_score") > 0)
        .groupBy("entity_id", "evidence_score").agg(F.count(F.lit(1)).alias("n"))
    )
    above = Window.partitionBy("entity_id").orderBy(F.desc("evidence_score")).rowsBetween(
        Window.unboundedPreceding, -1)
    step = F.lit(math.exp(-DECAY))
    ranked = counts.withColumn("first", F.coalesce(F.sum("n").over(above), F.lit(0)))
    share = F.pow(step, F.col("first")) * (1 - F.pow(step, F.col("n"))) / (1 - step)
    return ranked.groupBy("entity_id").agg(
        F.sum("n").alias("evidence_count"),
        (F.sum(F.col("evidence_score") * share) / F.sum(share)).alias("avg_score"),
    )


def entity_scores(evidence: DataFrame, edges: DataFrame, locked: DataFrame | None = None) -> DataFrame:
    """(entity_id, score, evidence_count, document_count).

    Decayed mean + count boost + edge boost, at most 100; a locked entity keeps
    the user's value; an entity without positive evidence scores 0. ``evidence`` is
    read twice, so it should be a written table.
    """
    documents = evidence.groupBy("entity_id").agg(F.countDistinct("document_id").alias("document_count"))
    strength = both_ends(edges).groupBy("entity_id").agg(F.sum("weight").alias("edge_weight"))
    joined = documents.join(decayed_average(evidence), "entity_id", "left").join(strength, "entity_id", "left")
    boosted = (
        F.col("avg_score")
        + F.least(F.lit(20.0), 5 * F.log2(F.col("evidence_count") + 1))
        + F.least(F.lit(15.0), 0.5 * F.coalesce("edge_weight", F.lit(0.0)))
    )
    # least() passes over nulls, so entities without positive evidence are told apart first
    score = F.when(F.col("avg_score").isNotNull(), F.round(F.least(F.lit(100.0), boosted), 2)).otherwise(0.0)
    if locked is not None:
        joined = joined.join(locked.select("entity_id", "user_score"), "entity_id", "left")
        score = F.coalesce(F.col("user_score").cast("double"), score)
    return joined.select(
        "entity_id", score.alias("score"),
        F.coalesce("evidence_count", F.lit(0)).cast("long").alias("evidence_count"), "document_count",
    )
