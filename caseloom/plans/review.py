"""Removed files, review queue, quarantine, event scores, document view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.operators.diff import removed
from caseloom.operators.windows import neighbour_ids
from caseloom.sources.landed import latest_snapshot


def removed_scan(known: DataFrame, current: DataFrame, snapshots: DataFrame, host: str | None = None) -> DataFrame:
    """Files that left the listing: priority at least 90, their mirror copies and recovery status.

    ``known`` is (url, key, priority); ``snapshots`` (key, stamp, snap_id).
    """
    if host:
        known = known.filter(F.contains("url", F.lit(host)))
    gone = removed(known, current)
    copies = latest_snapshot(snapshots, "key", "stamp", "snap_id")
    status = F.when(F.col("snapshots") > 0, "mirror_found").otherwise("not_found")
    return gone.join(copies, "key", "left").select(
        "url", F.greatest("priority", F.lit(90)).alias("priority"), F.coalesce("snapshots", F.lit(0).cast("long")).alias("snapshots"),
        "last_id", status.alias("status"))


def review_queue(documents: DataFrame, queued: DataFrame, below: int = 10) -> DataFrame:
    """Analysed, unreviewed, low-priority documents that are not queued yet."""
    low = documents.filter(F.col("analyzed") & ~F.col("reviewed") & (F.col("priority") < below))
    return low.join(queued.select("document_id"), "document_id", "left_anti")


def quarantine(images: DataFrame, hold_unreviewed: bool = True) -> DataFrame:
    """Adds why a row is held back and whether it may be exported."""
    held = F.coalesce("quarantined", F.lit(False))
    reason = F.when(held, "already quarantined").when(F.col("flagged"), "flagged")
    if hold_unreviewed:
        reason = reason.when(~F.col("reviewed"), "not reviewed")
    allowed = F.col("reviewed") & ~held & ~F.col("flagged") & F.col("decision").isin("save", "save_redacted", "flagged")
    return images.withColumn("reason", reason).withColumn("exportable", F.coalesce(allowed, F.lit(False)))


def event_flags(links: DataFrame, scored: DataFrame, people: DataFrame) -> DataFrame:
    """Entity links with whether the entity took part in any event of a known registry."""
    flown = people.join(scored.filter("known_registry").select("event_id"), "event_id", "left_semi").select(
        "entity_id").distinct().withColumn("has_event_evidence", F.lit(True))
    return links.join(flown, "entity_id", "left").withColumn("has_event_evidence", F.coalesce("has_event_evidence", F.lit(False)))


def document_view(documents: DataFrame, lines: DataFrame) -> DataFrame:
    """One row per document: its rows, entities and gaps counted, and the neighbouring documents."""
    counts = lines.groupBy("document_id").agg(
        F.countDistinct("page").alias("pages"), F.countDistinct("entity_id").alias("entities"), F.count_if("redacted").alias("gaps"))
    near = neighbour_ids(documents, "document_id")
    zero = F.lit(0).cast("long")
    return documents.join(near, "document_id").join(counts, "document_id", "left").select(
        "document_id", "prev_id", "next_id", *[F.coalesce(c, zero).alias(c) for c in ("pages", "entities", "gaps")])


# --- one document with all that is known of it ---

BLOCK = 4096  # characters of a page that share a join key when spans are laid over paragraphs
MARKS = r"(?i)\[redacted\]|\[redaction\]|█"


def _starts(rows: DataFrame, keys: list[str], size: Column) -> DataFrame:
    """``begins`` of pieces that follow each other in order of ``i``, each ``size`` long."""
    before = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("begins", F.coalesce(F.sum(size).over(before), F.lit(0)))


def paragraph_spans(pages: DataFrame) -> DataFrame:
    """(document_id, page, para, begins, ends, text): paragraphs between blank lines, trimmed, with their places in the page."""
    split = pages.select("document_id", "page", F.posexplode(F.split("text", "\n\n", -1)).alias("i", "piece"))
    placed = _starts(split, ["document_id", "page"], F.length("piece") + 2)
    lead = F.length("piece") - F.length(F.regexp_replace("piece", r"^\s+", ""))
    rows = placed.select("document_id", "page", "i", (F.col("begins") + lead).alias("begins"),
                         F.regexp_replace("piece", r"^\s+|\s+$", "").alias("text")).filter("text <> ''")
    order = Window.partitionBy("document_id", "page").orderBy("i")
    return rows.select("document_id", "page", F.row_number().over(order).alias("para"), "begins",
                       (F.col("begins") + F.length("text")).alias("ends"), "text")


def mention_spans(pages: DataFrame, links: DataFrame) -> DataFrame:
    """(document_id, page, begins, ends, entity_id, entity_type): where the linked names of a document stand on its pages.

    Spans do not overlap: from left to right, the longest name that begins at a place is taken. Of links of one name the best-scored stands for it.
    """
    named = links.filter("name <> ''").groupBy("document_id", "name").agg(
        F.max(F.struct("score", (-F.col("entity_id")).alias("o"), "entity_type")).alias("m")).select(
        "document_id", "name", (-F.col("m.o")).alias("entity_id"), "m.entity_type")
    quoted = F.regexp_replace("name", r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    either = named.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct((-F.length("name")).alias("l"), "name", quoted.alias("q")))).alias("all")).select(
        "document_id", F.array_join("all.q", "|").alias("either"))
    cut_up = pages.join(either, "document_id").select(
        "document_id", "page", F.split("text", F.col("either"), -1).alias("ps"), F.regexp_extract_all("text", F.col("either"), F.lit(0)).alias("ms"))
    hits = cut_up.filter(F.size("ms") > 0).select(
        "document_id", "page", F.posexplode(F.arrays_zip(F.col("ps").alias("before"), F.col("ms").alias("name"))).alias("i", "x")).select(
        "document_id", "page", "i", F.col("x.before").alias("before"), F.col("x.name").alias("name")).filter("name IS NOT NULL")
    placed = _starts(hits, ["document_id", "page"], F.length("before") + F.length("name"))
    at = F.col("begins") + F.length("before")
    return placed.join(named, ["document_id", "name"]).select(
        "document_id", "page", at.alias("begins"), (at + F.length("name")).alias("ends"), "entity_id", "entity_type")


def annotated_paragraphs(pages: DataFrame, links: DataFrame, block: int = BLOCK) -> DataFrame:
    """(document_id, page, para, text, spans, types, redacted): paragraphs with the mentions inside them.

    Paragraphs are laid out by the blocks of characters that they cover and mentions by the block in which they begin, so the join has equal keys
    and no page is one key. Places count from the paragraph's start.
    """
    paras, block_of = paragraph_spans(pages), lambda c: F.floor(c / block)
    covered = paras.withColumn("block", F.explode(F.sequence(block_of(F.col("begins")), block_of(F.col("ends") - 1))))
    spans = mention_spans(pages, links).withColumn("block", block_of(F.col("begins"))).withColumnsRenamed({"begins": "at", "ends": "until"})
    inside = covered.join(spans, ["document_id", "page", "block"]).filter((F.col("at") >= F.col("begins")) & (F.col("until") <= F.col("ends")))
    found = inside.groupBy("document_id", "page", "para").agg(
        F.array_sort(F.collect_list(F.struct((F.col("at") - F.col("begins")).alias("at"), (F.col("until") - F.col("at")).alias("size"), "entity_id", "entity_type"))).alias("spans"))
    rows = paras.join(found, ["document_id", "page", "para"], "left")
    none = F.array().cast(found.schema["spans"].dataType)
    spans_or_none = F.coalesce("spans", none)
    return rows.select("document_id", "page", "para", "text", spans_or_none.alias("spans"),
                       F.array_sort(F.array_distinct(F.transform(spans_or_none, lambda s: s["entity_type"]))).alias("types"),
                       F.col("text").rlike(MARKS).alias("redacted"))


def whole_documents(documents: DataFrame, pages: DataFrame, links: DataFrame, gaps: DataFrame) -> DataFrame:
    """One nested row a document: pages, links (best first), types, gaps in page order, annotated paragraphs, neighbours.

    ``documents`` is (document_id), ``pages`` (document_id, page, text), ``links`` (document_id, entity_id, name, entity_type, score),
    ``gaps`` (document_id, page, gap_id, status). Every list is bounded by its document. A document without pages keeps its row.
    """
    key = "document_id"

    def listed(rows: DataFrame, name: str, *fields) -> DataFrame:
        return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))

    paged = listed(pages, "pages", "page", "text")
    linked = listed(links, "links", (-F.col("score")).alias("minus"), "entity_id", "name", "entity_type", "score").withColumn(
        "links", F.transform("links", lambda x: x.dropFields("minus")))
    counted = links.groupBy(key, "entity_type").agg(F.count(F.lit(1)).alias("n"))
    types = listed(counted, "types", "entity_type", "n")
    opened = listed(gaps, "gaps", "page", "gap_id", "status")
    marked = listed(annotated_paragraphs(pages, links), "paragraphs", "page", "para", "text", "spans", "types", "redacted")
    near = neighbour_ids(documents, key)
    whole = documents.select(key).join(near, key, "left")
    for part in (paged, linked, types, opened, marked):
        whole = whole.join(part, key, "left")
    chars = F.aggregate(F.coalesce("pages", F.array().cast(paged.schema["pages"].dataType)), F.lit(0).cast("long"), lambda n, p: n + F.length(p["text"]))
    return whole.withColumn("chars", chars)
