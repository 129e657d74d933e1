"""Exports. Protected rows are filtered here again, whatever the caller passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.functions.text import truncate
from caseloom.operators.joins import inner_edges
from caseloom.operators.scoring import both_ends
from caseloom.operators.skew import bucketed_rank
from caseloom.operators.windows import top_per_key


def write_json(df: DataFrame, path: str, by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).json(path)


def public(entities: DataFrame, least: float = 0.0) -> DataFrame:
    return entities.filter(~F.col("is_protected") & (F.col("score") >= least))


def graph(entities: DataFrame, edges: DataFrame, least: float = 0.0, inferred: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, links): unprotected nodes from a score on, links with both ends kept."""
    nodes = public(entities, least)
    links = edges if inferred else edges.filter(~F.col("inferred"))
    return nodes, inner_edges(links, nodes)


def graph_counts(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(part, value, n): nodes per type and links per kind."""
    per_type = nodes.groupBy(F.col("entity_type").alias("value")).agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit("node"))
    per_kind = links.groupBy(F.col("kind").alias("value")).agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit("link"))
    return per_type.unionByName(per_kind)


def cards(entities: DataFrame, mentions: DataFrame, edges: DataFrame, evidence: int = 10, connections: int = 20,
          timeline: int = 20) -> DataFrame:
    """One nested record per unprotected entity; each list is a top-n taken before it is collected."""
    kept = entities.filter(~F.col("is_protected"))
    ids = kept.select("entity_id")
    mine = mentions.join(ids, "entity_id", "left_semi")

    def listed(top: DataFrame, fields: list[str], name: str) -> DataFrame:
        rows = top.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("rn", *fields))).alias("l"))
        return rows.select("entity_id", F.transform("l", lambda r: F.struct(*[r[f].alias(f) for f in fields])).alias(name))

    best = top_per_key(mine, "entity_id", [F.desc("evidence_score"), F.asc("document_id"), F.asc("page")], evidence)
    ends = both_ends(inner_edges(edges, kept))
    near = top_per_key(ends, "entity_id", [F.desc("weight"), F.asc("other_id"), F.asc("kind")], connections)
    dated = mine.filter(F.col("event_ts").isNotNull()).withColumn("day", F.date_format("event_ts", "yyyy-MM-dd"))
    story = top_per_key(dated, "entity_id", [F.asc("event_ts"), F.asc("document_id"), F.asc("page")], timeline)
    return (
        kept.join(listed(best, ["document_id", "evidence_score"], "evidence"), "entity_id", "left")
        .join(listed(near, ["other_id", "kind", "evidence"], "connections"), "entity_id", "left")
        .join(listed(story, ["day", "document_id"], "timeline"), "entity_id", "left")
    )


def timeline(events: DataFrame, entities: DataFrame, size: int | None = None) -> DataFrame:
    """Dated events of unprotected entities with the range of all dates; ``size`` shortens the texts for a viewer."""
    open_ids = entities.filter(~F.col("is_protected")).select("entity_id", "name")
    rows = events.filter(F.col("event_ts").isNotNull()).join(open_ids, "entity_id")
    span = rows.agg(F.min("event_ts").alias("a"), F.max("event_ts").alias("z"))
    first, last = span.select("a").scalar(), span.select("z").scalar()
    text = F.col("text") if size is None else truncate(F.col("text"), size)
    return rows.withColumn("text", text).withColumn("first_ts", first).withColumn(
        "last_ts", last).orderBy("event_ts", "entity_id", "document_id")


def category_report(findings: DataFrame, classes: list[str], block: int = 4096) -> DataFrame:
    """Lines of a report: findings of the wanted classes in order below their category.

    (category, line_no, line); line 0 is the heading. Lines are placed by id
    blocks, so a category of any size is written by many tasks.
    """
    kept = findings.filter(F.col("confidence").isin(classes)).withColumn("_b", F.floor(F.col("finding_id") / block))
    placed = bucketed_rank(kept, ["category"], "_b", [F.asc("finding_id")], out="line_no")
    body = placed.select("category", "line_no", F.concat_ws(" ", F.concat(F.lit("- ["), "confidence", F.lit("]")), "title").alias("line"))
    heads = kept.select("category").distinct().select(
        "category", F.lit(0).cast("long").alias("line_no"), F.concat(F.lit("## "), F.upper("category")).alias("line"))
    return heads.unionByName(body)


def write_report(lines: DataFrame, path: str) -> None:
    """Text files, one folder per category, lines in order inside each file range."""
    ordered = lines.repartitionByRange("category", "line_no").sortWithinPartitions("category", "line_no")
    ordered.select("category", "line").write.mode("overwrite").partitionBy("category").text(path)


def entity_report(entities: DataFrame, least: float) -> DataFrame:
    """Unprotected entities from a score on, one decimal, best first."""
    shown = F.format_string("%.1f", F.round("score", 1))
    return public(entities, least).orderBy(F.desc("score"), "entity_id").select("entity_id", "name", shown.alias("score"))
