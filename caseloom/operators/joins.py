"""Joins: evidence, endpoints, blocks in place of theta conditions, as-of lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def semi(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    return left.join(right.select(F.col(right_key).alias(left_key)), left_key, "left_semi")


def anti(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows of ``left`` without a partner; nulls on the right do not empty the result."""
    return left.join(right.select(F.col(right_key).alias(left_key)), left_key, "left_anti")


def event_search(events: DataFrame, people: DataFrame, registry: int | None = None, place: str | None = None,
                 start: str | None = None, end: str | None = None, participant: int | None = None,
                 min_score: float | None = None, limit: int | None = None) -> DataFrame:
    """Events by registry id, place at either end, half-open time range, participant and score."""
    if registry is not None:
        events = events.filter(F.col("registry") == registry)
    if place is not None:
        events = events.filter((F.col("origin") == place) | (F.col("dest") == place))
    if start is not None:
        events = events.filter(F.col("event_ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        events = events.filter(F.col("event_ts") < F.lit(end).cast("timestamp_ntz"))
    if min_score is not None:
        events = events.filter(F.col("score") >= min_score)
    if participant is not None:
        events = events.join(people.filter(F.col("entity_id") == participant).select("event_id"), "event_id", "left_semi")
    ordered = events.orderBy(F.desc("score"), F.desc("event_ts"), "event_id")
    return ordered if limit is None else ordered.limit(limit)


def evidence_with_documents(mentions: DataFrame, documents: DataFrame) -> DataFrame:
    return mentions.join(documents, "document_id")


def dated_timeline(mentions: DataFrame, messages: DataFrame) -> DataFrame:
    """All mentions; the event date is the message's where the document is a message."""
    return mentions.join(messages, "document_id", "left").withColumn("event_date", F.coalesce("sent_at", "event_ts"))


def named_edges(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges with the names of both ends."""
    names = entities.select("entity_id", "name")
    source = names.select(F.col("entity_id").alias("source_id"), F.col("name").alias("source_name"))
    target = names.select(F.col("entity_id").alias("target_id"), F.col("name").alias("target_name"))
    return edges.join(source, "source_id").join(target, "target_id")


def inner_edges(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges whose ends both are in the kept set."""
    ids = kept.select("entity_id")
    return (
        edges.join(ids.withColumnRenamed("entity_id", "source_id"), "source_id", "left_semi")
        .join(ids.withColumnRenamed("entity_id", "target_id"), "target_id", "left_semi")
    )


def linked_hubs(ends: DataFrame, entities: DataFrame, entity_type: str, at_least: int = 3) -> DataFrame:
    """Entities of a type with enough edges on either end."""
    counts = ends.groupBy("entity_id").agg(F.count(F.lit(1)).alias("link_count")).filter(F.col("link_count") >= at_least)
    return entities.filter(F.col("entity_type") == entity_type).join(counts, "entity_id")


def shared_documents(mentions: DataFrame, groups: DataFrame) -> DataFrame:
    """Documents with members of group A and of group B, with the best score of each.

    ``groups`` is (entity_id, grp). One conditional aggregate, no pairs of mentions.
    """
    side = mentions.join(groups, "entity_id")
    best = side.groupBy("document_id").agg(
        F.max(F.when(F.col("grp") == "A", F.col("evidence_score"))).alias("score_a"),
        F.max(F.when(F.col("grp") == "B", F.col("evidence_score"))).alias("score_b"))
    return best.filter(F.col("score_a").isNotNull() & F.col("score_b").isNotNull())


def shared_third(mentions: DataFrame, groups: DataFrame, third: DataFrame) -> DataFrame:
    """Third-type entities in documents that A and B share; distinct documents of each."""
    docs = shared_documents(mentions, groups).select("document_id")
    rest = mentions.join(third.select("entity_id"), "entity_id", "left_semi").join(docs, "document_id", "left_semi")
    return rest.groupBy("entity_id").agg(F.countDistinct("document_id").alias("shared_docs"))


def message_role(name: Column, from_name: Column, from_address: Column, recipients: Column) -> Column:
    """author, recipient or mentioned."""
    low = F.lower(name)
    author = F.coalesce((low == F.lower(from_name)) | (low == F.lower(from_address)), F.lit(False))
    to = F.coalesce(F.exists(recipients, lambda r: F.contains(F.lower(r), low)), F.lit(False))
    return F.when(author, "author").when(to, "recipient").otherwise("mentioned")


def active_between(mentions: DataFrame, start: str, end: str, place: str | None = None) -> DataFrame:
    """Entities with a mention in the half-open time range, at a place if given."""
    ts = F.col("event_ts")
    hit = mentions.filter((ts >= F.lit(start).cast("timestamp_ntz")) & (ts < F.lit(end).cast("timestamp_ntz")))
    if place:
        hit = hit.filter(F.contains(F.lower("doc_type"), F.lit(place.lower())))
    return hit.select("entity_id").distinct()


def within_range(messages: DataFrame, threads: DataFrame, block: str, days: int = 365) -> DataFrame:
    """Messages dated within the thread's range widened by ``days``; ``block`` is the equality first required."""
    span = F.make_dt_interval(F.lit(days))
    joined = messages.join(threads, block)
    return joined.filter((F.col("sent_at") >= F.col("first_at") - span) & (F.col("sent_at") <= F.col("last_at") + span))


def json_members(df: DataFrame, column: str, field: str, value: int) -> DataFrame:
    """Rows whose JSON array holds an object with the given number in ``field``."""
    objects = F.from_json(column, f"array<struct<{field}:bigint>>")
    return df.filter(F.exists(objects, lambda o: o[field] == value))


def latest_child(parent: DataFrame, child: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """Parents with the values of their newest child."""
    newest = child.groupBy(key).agg(F.max(F.struct(*order, *values)).alias("_r"))
    return parent.join(newest, key, "left").select(parent["*"], *[F.col(f"_r.{v}").alias(f"latest_{v}") for v in values])


def resolve_names(names: DataFrame, master: DataFrame, canonical) -> DataFrame:
    """(id, entity_id): by canonical name, else by alias; the lowest id of the best kind.

    ``master`` is (entity_id, name, aliases). All spellings become keys of one equality join.
    """
    spellings = master.select("entity_id", F.explode(F.concat(
        F.array(F.struct(F.lit(0).alias("kind"), F.col("name").alias("s"))),
        F.transform("aliases", lambda a: F.struct(F.lit(1).alias("kind"), a.alias("s"))))).alias("k"))
    keyed = spellings.select(canonical(F.col("k.s")).alias("_key"), "k.kind", "entity_id").filter("_key <> ''")
    best = keyed.groupBy("_key").agg(F.min(F.struct("kind", "entity_id")).alias("_m"))
    return names.withColumn("_key", canonical(F.col("name"))).join(best, "_key").select(
        "id", F.col("_m.entity_id").alias("entity_id"), F.when(F.col("_m.kind") == 0, "canonical").otherwise("alias").alias("by"))


def between_groups(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Number, weight and evidence of the edges that run between group A and group B."""
    a = groups.select(F.col("entity_id").alias("source_id"), F.col("grp").alias("gs"))
    t = groups.select(F.col("entity_id").alias("target_id"), F.col("grp").alias("gt"))
    crossing = edges.join(a, "source_id").join(t, "target_id").filter("gs <> gt")
    return crossing.agg(F.count(F.lit(1)).alias("edge_count"), F.sum("weight").alias("weight"),
                        F.sum("evidence").alias("evidence"))
