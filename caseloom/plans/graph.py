"""Edges from documents, neighbourhoods, inferred links, merges, the graph view."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseloom.fixed import EDGE_CONFIDENCE
from caseloom.functions.names import looks_noisy, norm_rel_type, squeeze
from caseloom.operators.aggs import merge_edges, node_priority
from caseloom.operators.bitsets import sharing
from caseloom.operators.joins import inner_edges
from caseloom.operators.pairs import shared_pairs
from caseloom.operators.scoring import both_ends
from caseloom.operators.skew import dealt, salted_join
from caseloom.session import cut
from caseloom.sources.contributions import Contributions


def document_edges(mentions: DataFrame, email: str = "email", flight: str = "flight_log", money: str = "financial",
                   author: str = "author", recipient: str = "recipient") -> DataFrame:
    """Per-document edge observations: pairs by document type, sender to recipient in messages.

    Every pair of a document co-occurs; in flight and money documents the same
    pair gives a second, typed observation, so pairs are formed only once.
    An edge comes once from a document of one type.
    """
    mentions = cut(mentions.select("document_id", "doc_type", "entity_id", "evidence_type"), "mentions")
    # the type travels inside the group, so pairs need no second join
    pairs = shared_pairs(dealt(mentions, mentions.count(), "document_id"), ["document_id", "doc_type"], "entity_id")
    typed = F.array_compact(F.array(
        F.lit("co_occurs_with"),
        F.when(F.col("doc_type") == flight, "flew_with").when(F.col("doc_type") == money, "financially_linked")))
    paired = pairs.select(F.col("a").alias("source_id"), F.col("b").alias("target_id"), "document_id", "doc_type",
                          F.explode(typed).alias("kind"))
    mail = mentions.filter(F.col("doc_type") == email)
    senders = mail.filter(F.col("evidence_type") == author).select(
        "document_id", "doc_type", F.col("entity_id").alias("source_id")).distinct()
    receivers = mail.filter(F.col("evidence_type") == recipient).select(
        "document_id", F.col("entity_id").alias("target_id")).distinct()
    sent = senders.join(receivers, "document_id").filter("source_id <> target_id").withColumn("kind", F.lit("emailed"))
    both = paired.unionByName(sent)
    confidence = F.lit(None).cast("double")
    for kind, value in EDGE_CONFIDENCE.items():
        confidence = F.when(F.col("kind") == kind, value).otherwise(confidence)
    return both.select(
        "source_id", "target_id", "kind", "document_id", confidence.alias("confidence"), F.lit(False).alias("inferred"),
        F.lit(None).cast("timestamp").alias("seen_at"), F.col("doc_type").alias("note"))


def _lowest(directed: DataFrame) -> DataFrame:
    """Edges (x, y) with the lowest of x and its neighbours; combined on the map side, joined back."""
    low = directed.groupBy("x").agg(F.min("y").alias("m")).withColumn("m", F.least("x", "m"))
    return directed.join(low, "x")


def components(nodes: DataFrame, links: DataFrame, node: str = "id") -> DataFrame:
    """(id, root): smallest id of the connected component, for links (a, b).

    Alternates two contractions until every component is a star around its
    smallest id: larger neighbours are re-linked to the lowest neighbour, then
    smaller ones. The number of rounds grows with the logarithm of the graph,
    also for long chains. Each round is a written table.
    """
    edges = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct(), "links")
    state = None
    while True:
        both = edges.select(F.explode(F.array(
            F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).alias("e")).select("e.x", "e.y")
        large = _lowest(both).filter("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        small = _lowest(large).select(F.explode(F.array(
            F.struct("x", F.col("m").alias("y")), F.struct(F.col("y").alias("x"), F.col("m").alias("y")))).alias("e"))
        edges = cut(small.select("e.x", "e.y").filter("x <> y").distinct(), "links")
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if mark == state:
            break
        state = mark
    return nodes.select(F.col(node).alias("id")).join(edges.select(F.col("x").alias("id"), "y"), "id", "left").select(
        "id", F.coalesce("y", "id").alias("root"))


def khop(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(entity_id, distance) of everything within ``hops`` edges of the seeds."""
    adjacent = cut(both_ends(edges).select("entity_id", "other_id").distinct(), "adjacent")
    frontier = seeds.select("entity_id").distinct().withColumn("distance", F.lit(0))
    visited = frontier
    for hop in range(1, hops + 1):
        reached = salted_join(frontier.select("entity_id"), adjacent, "entity_id", "other_id").select(
            F.col("other_id").alias("entity_id")).distinct()
        frontier = cut(reached.join(visited, "entity_id", "left_anti").withColumn("distance", F.lit(hop)), "frontier")
        visited = visited.unionByName(frontier)
    return visited


def transitive_links(edges: DataFrame, strong: float = 2.0, hops: int = 3, entities: DataFrame | None = None) -> DataFrame:
    """Pairs at distance 2..hops of an end of a strong edge, with their distance and confidence.

    Protected ones of ``entities`` are neither ends nor on the way.
    """
    if entities is not None:
        edges = cut(inner_edges(edges, entities.filter(~F.col("is_protected"))), "open-edges")
    adjacent = cut(both_ends(edges).select("entity_id", "other_id").distinct(), "adjacent")
    seeds = both_ends(edges.filter(F.col("weight") >= strong)).select(F.col("entity_id").alias("seed")).distinct()
    level = adjacent.join(seeds, adjacent.entity_id == F.col("seed"), "left_semi").select(
        F.col("entity_id").alias("seed"), F.col("other_id").alias("entity_id"))
    seen, found = level, None
    for hop in range(2, hops + 1):
        step = salted_join(level, adjacent, "entity_id", "other_id").select("seed", F.col("other_id").alias("entity_id"))
        fresh = step.filter("seed <> entity_id").distinct().join(seen, ["seed", "entity_id"], "left_anti")
        level = cut(fresh, "level")
        seen = seen.unionByName(level)
        pairs = level.select(F.least("seed", "entity_id").alias("source_id"), F.greatest("seed", "entity_id").alias("target_id"),
                             F.lit(hop).alias("degrees"))
        found = pairs if found is None else found.unionByName(pairs)
    return found.distinct().withColumn("confidence", F.round(F.lit(1.0) / F.col("degrees"), 2))


CLUSTER_BLOCK = 4096  # entities of one block; a tile holds the bit strings of two


def cluster_edges(members: DataFrame, at_least: int = 3, protected: DataFrame | None = None, block: int = CLUSTER_BLOCK) -> DataFrame:
    """Inferred edges among the entities of each time cluster: clusters shared, lowest document.

    Entities of ``protected`` (entity_id) are left out before clusters are counted. Clusters begin on days, so they are few: they are numbered by
    their lowest document, and an entity's clusters are one bit string. Entities are dealt into blocks, two blocks make a tile, and only bit
    strings are sent to the tiles; the lowest bit that a pair shares names its lowest document.
    """
    if protected is not None:
        members = members.join(protected.select("entity_id").distinct(), "entity_id", "left_anti")
    members = cut(members.select("start", "entity_id", "document_id"), "members")
    big = members.groupBy("start").agg(F.countDistinct("entity_id").alias("n"), F.min("document_id").alias("doc")).filter(
        F.col("n") >= at_least).select("start", "doc")
    number = (F.row_number().over(Window.orderBy(F.asc_nulls_last("doc"), "start")) - 1).alias("mark")  # a row a day
    days = cut(big.select("start", "doc", number), "cluster-days")
    rows = cut(members.filter(F.col("entity_id").isNotNull()).select("start", F.col("entity_id").cast("long").alias("item")).join(
        days.select("start", "mark"), "start").select("item", "mark").distinct(), "clusters")
    blocks = max(4, -(-rows.select("item").distinct().count() // block))
    pairs = sharing(rows, days.count(), blocks)
    return pairs.join(days, "mark").select("a", "b", F.col("n").alias("clusters"), F.col("doc").alias("evidence_doc"))


DOCUMENTS = "documents"  # the detector of what documents say, whose observations are many an edge
DETECTED = ["source_id", "target_id", "kind", "document_id", "confidence", "inferred", "seen_at", "note"]


def detected_edges(clusters: DataFrame, transitive: DataFrame, candidates: DataFrame) -> dict[str, DataFrame]:
    """The edges that each detector infers, with its own evidence, in the columns of edge observations.

    ``clusters`` is (a, b, clusters, evidence_doc), ``transitive`` (source_id, target_id, degrees, confidence), ``candidates``
    (context_id, entity_id, score): who may stand behind a placeholder.
    """
    none, yes = F.lit(None), F.lit(True).alias("inferred")
    return {
        "temporal": clusters.select(
            F.col("a").alias("source_id"), F.col("b").alias("target_id"), F.lit("temporal_cluster").alias("kind"),
            F.col("evidence_doc").alias("document_id"), F.lit(0.5).alias("confidence"), yes, none.cast("timestamp").alias("seen_at"),
            F.concat(F.col("clusters").cast("string"), F.lit(" clusters")).alias("note")),
        "transitive": transitive.select(
            "source_id", "target_id", F.lit("transitively_linked").alias("kind"), none.cast("long").alias("document_id"), "confidence", yes,
            none.cast("timestamp").alias("seen_at"), F.concat(F.col("degrees").cast("string"), F.lit(" degrees of separation")).alias("note")),
        "candidates": candidates.select(
            F.col("context_id").alias("source_id"), F.col("entity_id").alias("target_id"), F.lit("may_be").alias("kind"),
            none.cast("long").alias("document_id"), F.col("score").alias("confidence"), yes, none.cast("timestamp").alias("seen_at"),
            F.lit("name in context").alias("note")),
    }


def write_detected(store: Contributions, edges: dict[str, DataFrame]) -> None:
    """Every detector replaces the edges of its last run, and only those."""
    for detector, rows in edges.items():
        mine = store.spark.createDataFrame([(detector,)], "detector string")
        store.replace(mine, {"edges": rows.select(F.lit(detector).alias("detector"), *DETECTED)})


def merge_detected(store: Contributions) -> DataFrame:
    """Edges of the documents and of every detector: (source_id, target_id, kind, evidence, confidence, inferred).

    Detectors give an edge once, below a kind of their own, so only the observations of documents are grouped.
    """
    rows = store.read("edges")
    seen, own = rows.filter(F.col(store.owner) == DOCUMENTS), rows.filter(F.col(store.owner) != DOCUMENTS)
    columns = ["source_id", "target_id", "kind", "evidence", "confidence", "inferred"]
    single = own.withColumn("evidence", F.col("document_id").isNotNull().cast("long"))
    return merge_edges(seen, once=seen.count()).select(*columns).unionByName(single.select(*columns))


def merge_mentions(mentions: DataFrame, mapping: DataFrame) -> DataFrame:
    """Mentions with every id replaced by the survivor of its merge chain.

    ``mapping`` is (dropped, kept) and may form chains; edges and counts are
    recomputed from the result, so nothing is counted twice.
    """
    links = mapping.select(F.col("dropped").alias("a"), F.col("kept").alias("b"))
    ids = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    roots = components(ids, links).withColumnRenamed("id", "entity_id")
    return mentions.join(roots, "entity_id", "left").withColumn("entity_id", F.coalesce("root", "entity_id")).drop("root")


def merged_aliases(entities: DataFrame, mapping: DataFrame) -> DataFrame:
    """(entity_id, alias): the distinct names of everything merged into a survivor, a row each."""
    links = mapping.select(F.col("dropped").alias("a"), F.col("kept").alias("b"))
    ids = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    roots = components(ids, links).withColumnRenamed("id", "entity_id")
    return entities.join(roots, "entity_id").select(F.col("root").alias("entity_id"), F.col("name").alias("alias")).distinct()


def merged_counts(mentions: DataFrame, mapping: DataFrame) -> DataFrame:
    """(entity_id, document_count, evidence_count) counted anew after a merge, equal links once."""
    slim = cut(mentions.select("entity_id", "document_id", "evidence_type").distinct(), "slim-mentions")
    # dealt by survivor and document, so equal links and documents are counted in place
    links = dealt(merge_mentions(slim, mapping), slim.count(), "entity_id", "document_id").distinct()
    by_document = links.groupBy("entity_id", "document_id").agg(F.count(F.lit(1)).alias("n"))
    return by_document.groupBy("entity_id").agg(F.count(F.lit(1)).alias("document_count"), F.sum("n").alias("evidence_count"))


def deduplicated(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, id map): entities with equal name and type become the best-scored one."""
    clean = entities.filter(~looks_noisy(F.col("name"))).withColumn("_k", F.lower(squeeze(F.col("name"))))
    nodes = clean.groupBy("_k", "entity_type").agg(
        F.max(F.struct("score", (-F.col("entity_id")).alias("o"))).alias("m"), F.max("document_count").alias("document_count"))
    nodes = nodes.withColumn("node_id", -F.col("m.o")).withColumn("score", F.col("m.score")).drop("m")
    ids = clean.select("entity_id", "_k", "entity_type").join(nodes.select("_k", "entity_type", "node_id"), ["_k", "entity_type"])
    return nodes.select("node_id", F.col("_k").alias("name"), "entity_type", "score", "document_count"), ids.select(
        "entity_id", "node_id")


def graph_view(entities: DataFrame, edges: DataFrame, center: int, fill: int, most: int,
               most_links: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) around a centre, protected entities left out: people at hop 1, people behind connectors, filled and capped by priority."""
    edges = cut(edges, "edges")
    nodes, ids = deduplicated(cut(entities.filter(~F.col("is_protected")), "entities"))
    ids = cut(ids, "ids")
    source = ids.select(F.col("entity_id").alias("source_id"), F.col("node_id").alias("s"))
    target = ids.select(F.col("entity_id").alias("target_id"), F.col("node_id").alias("t"))
    weight = F.greatest(F.lit(1.0), F.coalesce("weight", F.lit(1.0)))
    links = edges.join(source, "source_id").join(target, "target_id").filter("s <> t").groupBy(
        F.least("s", "t").alias("source_id"), F.greatest("s", "t").alias("target_id"), norm_rel_type(F.col("kind")).alias("kind")
    ).agg(F.sum(weight).alias("weight"), F.count(F.lit(1)).alias("n"))
    links = cut(links, "links")
    ranked = cut(node_priority(nodes.withColumnRenamed("node_id", "entity_id"), links), "nodes")
    hub = ranked.join(ids.filter(F.col("entity_id") == center).select(F.col("node_id").alias("entity_id")), "entity_id", "left_semi")
    hub = hub.select("entity_id")
    adjacent = cut(both_ends(links).select("entity_id", "other_id").distinct(), "adjacent")
    people = ranked.filter("entity_type = 'person'").select("entity_id")
    first = adjacent.join(hub, "entity_id", "left_semi").select(F.col("other_id").alias("entity_id"))
    direct = first.join(people, "entity_id", "left_semi")
    via = first.join(people, "entity_id", "left_anti").join(adjacent, "entity_id").join(
        people.withColumnRenamed("entity_id", "other_id"), "other_id", "left_semi").join(
        hub.withColumnRenamed("entity_id", "other_id"), "other_id", "left_anti")
    ego = hub.union(direct).union(via.select("entity_id")).union(via.select("other_id")).distinct()
    # below ``fill`` nodes, people join by priority; the rank of an outsider counts only outsiders
    outside = ranked.filter("entity_type = 'person'").join(ego, "entity_id", "left_anti").orderBy(
        F.desc("priority"), "entity_id").limit(fill)
    ego = cut(ego, "ego")
    room = F.greatest(F.lit(fill) - ego.agg(F.count(F.lit(1))).scalar(), F.lit(0))
    place = F.row_number().over(Window.orderBy(F.desc("priority"), "entity_id"))  # at most ``fill`` rows
    added = outside.withColumn("_r", place).filter(F.col("_r") <= room).select("entity_id")
    keep = ranked.join(ego.union(added), "entity_id", "left_semi").withColumn(
        "is_center", F.col("entity_id") == hub.agg(F.max("entity_id")).scalar())
    keep = cut(keep.orderBy(F.desc("is_center"), F.desc("priority"), "entity_id").limit(most), "keep")
    kind = keep.select("entity_id", (F.col("is_center") | (F.col("entity_type") == "person")).alias("p"))
    inner = links.join(kind.select(F.col("entity_id").alias("source_id"), F.col("p").alias("ps")), "source_id").join(
        kind.select(F.col("entity_id").alias("target_id"), F.col("p").alias("pt")), "target_id").filter("ps OR pt")
    shown = inner.select("source_id", "target_id", "kind", "weight", "n").orderBy(
        "kind", F.desc("weight"), "source_id", "target_id").limit(most_links)
    ends = both_ends(inner.select("source_id", "target_id")).select("entity_id").distinct().withColumn("linked", F.lit(True))
    final = keep.join(ends, "entity_id", "left").filter(F.coalesce("linked", F.lit(False)) | (F.col("score") >= 75)).drop("linked")
    return final, shown
