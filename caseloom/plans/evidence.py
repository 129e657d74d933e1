"""Scores of single evidence rows, detectors together, the merged card."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom import fixed
from caseloom.functions.text import contains_any, registry_ids
from caseloom.operators import aggs, joins
from caseloom.operators.scoring import both_ends, literal_map


def score_evidence(links: DataFrame, terms: Sequence[str]) -> DataFrame:
    """0-100 per link from its type and its context; locked rows keep the user's score.

    Input: entity_id, document_id, page, evidence_type, context, name, removed, user_score.
    """
    low = F.lower(F.coalesce("context", F.lit("")))
    base = literal_map(fixed.EVIDENCE_BASE, fixed.EVIDENCE_BASE["other"])(F.col("evidence_type"))
    extra = (
        F.when(F.contains(low, F.lit("redact")), fixed.GAP_WORDING_BONUS).otherwise(0)
        + F.when(contains_any(low, terms), fixed.TERM_BONUS).otherwise(0)
        + F.when(F.contains(low, F.lower("name")), fixed.NAMED_BONUS).otherwise(0)
        + F.when(F.col("removed"), fixed.REMOVED_BONUS).otherwise(0))
    computed = F.greatest(F.lit(0), F.least(F.lit(100), base + extra))
    return links.withColumn("base", base).withColumn("modifier", extra).withColumn(
        "score", F.coalesce(F.col("user_score").cast("int"), computed))


def sequences_and_hubs(followed: DataFrame, edges: DataFrame, entities: DataFrame, at_least: int = 3) -> DataFrame:
    """Second events soon after first ones, and organisations with many links, as one typed table."""
    first = followed.select("entity_id", F.lit("payment_after_travel").alias("pattern"), F.col("gap_days").alias("measure"),
                            "document_id")
    hubs = joins.linked_hubs(both_ends(edges), entities, "organization", at_least).select(
        "entity_id", F.lit("hub").alias("pattern"), F.col("link_count").alias("measure"),
        F.lit(None).cast("long").alias("document_id"))
    return first.unionByName(hubs)


def merged_card(members: DataFrame, entities: DataFrame, mentions: DataFrame, edges: DataFrame, others: DataFrame,
                third: DataFrame) -> DataFrame:
    """One row for a set of ids taken as one entity; every list in it is a top-k."""
    mine = members.select("entity_id", F.lit("A").alias("grp"))
    groups = mine.unionByName(others.select("entity_id", F.lit("B").alias("grp")))
    own = entities.join(members.select("entity_id"), "entity_id", "left_semi").agg(
        F.max("score").alias("score"), F.sum("document_count").alias("documents"), F.count(F.lit(1)).alias("members"))

    def listed(df: DataFrame, order: list, item, name: str) -> DataFrame:
        rows = F.array_sort(F.collect_list(F.struct(*order, item.alias("v"))))
        joined = F.array_join(F.transform(rows, lambda r: r["v"].cast("string")), ",")
        return df.agg(F.when(F.count(F.lit(1)) > 0, joined).alias(name))  # null where there is nothing to list

    near = listed(aggs.connections_of(edges, members), [(-F.col("weight_total")).alias("w"), (-F.col("evidence_total")).alias("e"),
                  (-F.col("edge_count")).alias("n"), F.col("other_id")], F.col("other_id"), "connections")
    docs = listed(aggs.documents_of(mentions, members, "R"), [(-F.col("top_score")).alias("s"), (-F.col("mention_count")).alias("m"),
                  (-F.col("document_id")).alias("d")], F.col("document_id"), "top_documents")
    shared = joins.shared_documents(mentions, groups).agg(F.count(F.lit(1)).alias("shared_documents"))
    co = joins.shared_third(mentions, groups, third).orderBy(F.desc("shared_docs"), "entity_id").limit(8)
    present = listed(co, [(-F.col("shared_docs")).alias("n"), F.col("entity_id")], F.col("entity_id"), "also_present")
    direct = joins.between_groups(edges, groups)
    row = own
    for part in (near, docs, shared, present, direct):  # one row each, attached as scalar subqueries
        record = part.select(F.struct(*part.columns).alias("r")).scalar()
        row = row.withColumn("_r", record).select("*", *[F.col(f"_r.{c}").alias(c) for c in part.columns]).drop("_r")
    return row


def card_details(members: DataFrame, mentions: DataFrame, analyses: DataFrame, texts: DataFrame, recent: int = 6, ids: int = 20) -> DataFrame:
    """(recent, registry_ids) of a card: the newest analysis of each of its documents, newest first, and the registry ids in most of their texts.

    ``analyses`` is (document_id, analysis_id, analyzed_at), ``texts`` (document_id, text). Both lists are top-k: every task keeps its own best rows.
    """
    own = mentions.join(members.select("entity_id"), "entity_id", "left_semi").select("document_id").distinct()
    newest = analyses.join(own, "document_id", "left_semi").groupBy("document_id").agg(
        F.max(F.struct("analyzed_at", "analysis_id")).alias("m")).select("document_id", "m.*")
    best = newest.orderBy(F.desc("analyzed_at"), F.desc("analysis_id")).limit(recent)
    listed = best.agg(F.reverse(F.array_sort(F.collect_list(F.struct("analyzed_at", "analysis_id", "document_id")))).alias("recent"))
    found = texts.join(own, "document_id", "left_semi").select("document_id", F.explode(registry_ids(F.col("text"))).alias("registry_id"))
    often = found.groupBy("registry_id").agg(F.countDistinct("document_id").alias("n")).orderBy(F.desc("n"), "registry_id").limit(ids)
    named = often.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), "registry_id"))).alias("x")).select(
        F.col("x.registry_id").alias("registry_ids"))
    return listed.withColumn("registry_ids", named.scalar())


def weighted(links: DataFrame, weights: DataFrame, column: str = "evidence_type") -> DataFrame:
    """Scores from a weights table (kind, weight); a kind that the table lacks takes its 'other' row."""
    default = weights.filter("kind = 'other'").agg(F.max("weight")).scalar()
    table = weights.withColumnRenamed("kind", column)
    return links.join(table, column, "left").withColumn("weight", F.coalesce("weight", default))
