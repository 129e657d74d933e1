"""Annotator answers: sections to records, agreement, application, findings, prompts."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom import fixed
from caseloom.functions.names import forms_match, is_garbage, map_entity_type, match_form, normalize_name
from caseloom.functions.text import categorize, confidence_class, find_all
from caseloom.operators.dictionary import longest_matches
from caseloom.operators.scoring import literal_map
from caseloom.operators.sets import missing_values
from caseloom.operators.skew import dealt, spread
from caseloom.operators.windows import align_answers, top_per_key
from caseloom.sources.contributions import Contributions

ANY_HEADER = r"(?i)===\s*(?:" + "|".join(fixed.SECTIONS.values()) + r")\s*==="
FEWEST = {"entities": 1, "timeline": 2, "locations": 2, "financial": 2, "evidence_scores": 2, "career_roles": 1}
WIDTH = {"entities": 4, "timeline": 4, "locations": 4, "financial": 6, "evidence_scores": 4, "career_roles": 7}


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def sections(responses: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section, body) of each answer; a repeated header keeps its last body."""
    plain = re.sub(r"\[_ \]\?|\?", "", " ".join(fixed.SECTIONS.values())).lower().split()  # singular and plural
    names = {form: section for section, word in zip(fixed.SECTIONS, plain) for form in (word, word.removesuffix("s"))}

    def named(header: Column) -> Column:
        return literal_map(names, None)(F.translate(F.lower(header), "=_ \t\n\x0b\f\r", ""))

    split = spread(responses, key).select(
        key, F.transform(find_all(F.col(text), ANY_HEADER), named).alias("_h"), F.split(F.col(text), ANY_HEADER).alias("_b"))
    zipped = F.arrays_zip(F.col("_h").alias("section"), F.slice("_b", F.lit(2), F.size("_b")).alias("body"))
    last = F.filter(zipped, lambda s, i: ~F.array_contains(F.slice("_h", i + 2, F.size("_h")), s["section"]))
    rows = split.select(key, F.explode(last).alias("s")).select(key, "s.section", _strip(F.col("s.body")).alias("body"))
    return rows.filter((F.col("body") != "") & ~F.startswith(F.lower("body"), F.lit("none identified")))


def section_records(responses: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section, pos, fields): every record of every section.

    Fields are named by place: entities name, type, role, details; connections
    source, relation, target, evidence; scores name, score, category, reason;
    gaps index, context, rank, name, confidence, reason; the rest as written.
    """
    parts = sections(responses, key, text)
    stripped = F.transform(F.split("body", "\n"), lambda x: _strip(F.regexp_replace(_strip(x), r"^-*\**", "")))
    none = F.lit(None).cast("string")

    def line(i, x, head):
        return F.struct(i.alias("pos"), x.alias("line"), head.alias("head"))

    # every answer is cut up once: the lines of its sections, those of gaps with their header
    written = F.when(F.col("section") == "summary", F.array(line(F.lit(0), F.col("body"), none))).when(
        F.col("section") == "redaction_inferences", _gap_lines(line)).otherwise(
        F.transform(F.filter(stripped, lambda x: x != ""), lambda x, i: line(i, x, none)))
    lines = parts.select(key, "section", F.explode(written).alias("w")).select(key, "section", "w.*")
    cells = F.transform(F.split("line", r"\|"), lambda c: _strip(c))
    size = F.size("c")
    arrow = F.col("line").rlike(fixed.ARROW)
    quote = F.regexp_extract("line", r'(?i)evidence:\s*"(.*?)"', 1)
    drawn = F.array(*[_strip(F.regexp_extract("line", fixed.ARROW, i)) for i in (1, 2, 3)], F.nullif(quote, F.lit("")))
    number = F.regexp_extract(F.get("c", F.lit(1)), r"\d+", 0)
    score = F.when(number != "", number).otherwise("0")
    empty = F.lit("")
    graded = F.array(F.get("c", F.lit(0)), score, F.when(size >= 4, F.get("c", F.lit(2))).otherwise(empty),
                     F.when(size >= 4, F.get("c", F.lit(3))).when(size == 3, F.get("c", F.lit(2))).otherwise(empty))
    width, fewest = F.lit(1), F.lit(1)
    for name, n in WIDTH.items():
        width = F.when(F.col("section") == name, n).otherwise(width)
        fewest = F.when(F.col("section") == name, FEWEST[name]).otherwise(fewest)
    piped = F.slice("c", F.lit(1), F.least(width, size))
    section = F.col("section")
    fields = (
        F.when(section == "summary", F.array("line"))
        .when(section == "redaction_inferences", F.when(F.col("line").rlike(fixed.CANDIDATE), _candidate()))
        .when((section == "connections") & arrow, drawn)
        .when(section == "connections", F.when(size >= 3, F.slice("c", 1, 4)))
        .when(section.isin("cross_references", "flags"), F.array("line"))
        .when(size < fewest, F.lit(None))
        .when(section == "evidence_scores", graded)
        .when((section == "entities") & is_garbage(F.get("c", F.lit(0))), F.lit(None))
        .otherwise(piped))
    # an explode of none or one, where a filter would compute the fields twice
    return lines.withColumn("c", cells).select(key, "section", "pos", F.explode(F.array_compact(F.array(fields))).alias("fields"))


def _gap_lines(line) -> Column:
    """The lines below each gap header, with it; what comes before the first header is none of them."""
    body = F.split("body", fixed.GAP_HEADER)
    blocks = F.arrays_zip(find_all(F.col("body"), fixed.GAP_HEADER).alias("h"), F.slice(body, F.lit(2), F.size(body)).alias("b"))
    return F.flatten(F.transform(blocks, lambda z: F.transform(F.split(z["b"], "\n"), lambda x, i: line(i, _strip(x), z["h"]))))


def _candidate() -> Column:
    """Fields of a numbered candidate; a header without candidates leaves no record."""
    return F.array(F.regexp_extract("head", r"(?i)REDACTION\s*#?\s*(\d+)", 1), F.regexp_extract("head", r'(?i)context:\s*"(.*?)"', 1),
                   *[_strip(F.regexp_extract("line", fixed.CANDIDATE, i)) for i in (1, 2, 3, 4)])


def response_quality(responses: DataFrame, key: str, text: str) -> DataFrame:
    """0-1 per answer: weight of each section times its fullness (three records are full)."""
    counts = section_records(responses, key, text)
    gap = F.when(F.col("section") == "redaction_inferences", F.get("fields", F.lit(0)))
    per = counts.groupBy(key, "section").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(gap).alias("g"))
    items = F.when(F.col("section") == "redaction_inferences", F.col("g")).otherwise(F.col("n"))
    weight = F.lit(0.0)
    for name, value in fixed.SECTION_WEIGHT.items():
        weight = F.when(F.col("section") == name, value).otherwise(weight)
    full = F.when(F.col("section") == "summary", 1.0).otherwise(F.least(items / 3, F.lit(1.0)))
    scored = per.groupBy(key).agg(F.least(F.sum(weight * full), F.lit(1.0)).alias("q"))
    return responses.select(key).join(scored, key, "left").select(key, F.round(F.coalesce("q", F.lit(0.0)), 4).alias("quality"))


# --- agreement; judgements are (document_id, annotator, item, score) ---

def annotators_per_document(judgements: DataFrame) -> DataFrame:
    return judgements.groupBy("document_id").agg(F.countDistinct("annotator").alias("annotators"))


def consensus_items(judgements: DataFrame) -> DataFrame:
    """Items with the number of annotators that name them and a tag."""
    per_item = judgements.groupBy("document_id", "item").agg(F.countDistinct("annotator").alias("models"))
    n, c = F.col("annotators"), F.col("models")
    tag = F.when((n >= 3) & (c == 1), "UNIQUE_INSIGHT").when((n >= 3) & (c == 2), "LIKELY").when(c >= n, "CONFIRMED").otherwise("LIKELY")
    return per_item.join(annotators_per_document(judgements), "document_id").withColumn("tag", tag)


def consensus_scores(judgements: DataFrame) -> DataFrame:
    """Mean (half-even), spread, scores by annotator and a tag per item."""
    each = judgements.groupBy("document_id", "item", "annotator").agg(F.max("score").alias("s"))
    per_item = each.groupBy("document_id", "item").agg(
        F.bround(F.avg("s")).cast("int").alias("score"), (F.max("s") - F.min("s")).alias("spread"),
        F.count(F.lit(1)).alias("models"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("annotator", "s")))).alias("scores"))
    n, c = F.col("annotators"), F.col("models")
    tag = (F.when((c < n) & (c == 1), "UNIQUE_INSIGHT").when(c < n, "LIKELY").when(F.col("spread") > 30, "NEEDS_REVIEW")
           .otherwise("CONFIRMED"))
    return per_item.join(annotators_per_document(judgements), "document_id").withColumn("tag", tag)


def consensus_votes(judgements: DataFrame, top: int = 5) -> DataFrame:
    """Ranked candidates per slot: mean confidence, annotators, agreement, tag. Input has slot and item."""
    votes = judgements.groupBy("document_id", "slot", "item").agg(
        F.avg("score").alias("mean"), F.countDistinct("annotator").alias("models"))
    n, c = F.col("annotators"), F.col("models")
    tag = F.when(c >= n, "CONFIRMED").when(c >= 2, "LIKELY").otherwise("UNIQUE_INSIGHT")
    agreement = F.least(F.col("mean") / 100 * (1 + 0.15 * (c - 1)), F.lit(0.95))
    rows = votes.join(annotators_per_document(judgements), "document_id").select(
        F.struct("document_id", "slot").alias("gap"), "item", F.bround("mean").cast("int").alias("avg_confidence"), "models",
        F.round(agreement + 1e-9, 4).alias("agreement"), tag.alias("tag"))
    ranked = top_per_key(rows, "gap", [F.desc("avg_confidence"), F.asc("item")], top)
    return ranked.select("gap.document_id", "gap.slot", "item", "avg_confidence", "models", "agreement", "tag", "rn")


def agreement_levels(judgements: DataFrame) -> DataFrame:
    """Level per document from the number of items that annotators score far apart."""
    scored = consensus_scores(judgements)
    per_doc = scored.groupBy("document_id").agg(
        F.max("annotators").alias("annotators"), F.count_if(F.col("spread") > 30).alias("disagreements"),
        F.count(F.lit(1)).alias("items"), F.max("score").alias("top_score"),
        F.max(F.struct("score", "item")).getField("item").alias("top_item"))
    d = F.col("disagreements")
    level = F.when(F.col("annotators") == 1, "single_source").when(d == 0, "full").when(d <= 3, "majority").otherwise("split")
    return per_doc.withColumn("agreement", level).withColumn("needs_review", F.col("agreement").isin("split", "single_source"))


def coverage(judgements: DataFrame, available: Sequence[int]) -> DataFrame:
    """Documents that some annotators have not answered, and which."""
    have = judgements.groupBy("document_id").agg(F.collect_set("annotator").alias("have"))
    return have.withColumn("missing", missing_values(F.col("have"), list(available))).filter(F.size("missing") > 0)


def consensus(judgements: DataFrame, available: Sequence[int]) -> DataFrame:
    """One row per document: level, items by tag, top score, missing annotators."""
    tags = consensus_items(judgements).groupBy("document_id").agg(
        F.count_if(F.col("tag") == "CONFIRMED").alias("confirmed"), F.count_if(F.col("tag") == "LIKELY").alias("likely"),
        F.count_if(F.col("tag") == "UNIQUE_INSIGHT").alias("unique_items"))
    gaps = coverage(judgements, available).select("document_id", "missing")
    return agreement_levels(judgements).join(tags, "document_id").join(gaps, "document_id", "left").withColumn(
        "missing", F.coalesce("missing", F.array().cast("array<bigint>")))


# --- application to the graph ---

def consensus_entities(items: DataFrame) -> DataFrame:
    """(canonical, entity_type, document_count, first_doc) from (document_id, name, raw_type)."""
    named = items.select("document_id", normalize_name(F.col("name")).alias("canonical"),
                         map_entity_type(F.col("raw_type")).alias("entity_type")).filter("canonical <> ''").distinct()
    return named.groupBy("canonical", "entity_type").agg(
        F.count(F.lit(1)).alias("document_count"), F.min("document_id").alias("first_doc"))


def consensus_edges(items: DataFrame, connections: DataFrame) -> DataFrame:
    """Edges between entities of the same document, each document counted once: evidence is the weight."""
    known = items.select("document_id", normalize_name(F.col("name")).alias("n")).distinct()
    links = connections.select("document_id", normalize_name(F.col("source")).alias("source"),
                               normalize_name(F.col("target")).alias("target"), "kind").filter("source <> target").distinct()
    ends = [known.select("document_id", F.col("n").alias(side)) for side in ("source", "target")]
    held = links.join(ends[0], ["document_id", "source"], "left_semi").join(ends[1], ["document_id", "target"], "left_semi")
    return held.groupBy("source", "target", "kind").agg(
        F.count(F.lit(1)).alias("evidence"), F.count(F.lit(1)).cast("double").alias("weight"))


def contributions(items: DataFrame, roles: DataFrame, scores: DataFrame, connections: DataFrame, inferred: DataFrame,
                  gaps: DataFrame, rows: int | None = None) -> dict[str, DataFrame]:
    """What each document's consensus adds to the graph: its links, edges and gap candidates, every row with its document_id.

    ``items`` is (document_id, name, raw_type), ``roles`` (document_id, place, name, role), ``scores`` (document_id, name, score, reason),
    ``connections`` (document_id, source, target, kind, confidence), ``inferred`` (document_id, index, rank, candidate, confidence) with 1-based
    indices, ``gaps`` (document_id, page, gap_id, status). A name takes the role of the first entry that matches it. The best
    score of a name counts. Connections hold between names of the same document. Candidates meet the gap of their place in page order; numbers
    without a gap drop out. With ``rows``, about how many rows the largest of the tables has, each is dealt by document once and all that
    follows works in place.
    """
    def by_document(df: DataFrame) -> DataFrame:
        return df if rows is None else dealt(df, rows, "document_id", each=1 << 19)

    named = by_document(items.select("document_id", F.trim("name").alias("name"), normalize_name(F.col("name")).alias("canonical"),
                                     map_entity_type(F.col("raw_type")).alias("entity_type")).filter("canonical <> ''")).distinct()
    # forms are made before names meet the roles of their document
    asked = named.withColumn("form", match_form(F.col("name")))
    held = by_document(roles.select("document_id", "place", "role", match_form(F.col("name")).alias("whose")))
    first = F.min(F.when(forms_match(F.col("whose"), F.col("form")), F.struct("place", "role")))
    found = asked.join(held, "document_id", "left").groupBy("document_id", "canonical", "entity_type", "name").agg(
        first.getField("role").alias("role")).groupBy("document_id", "canonical", "entity_type").agg(F.min("role").alias("role"))
    best = by_document(scores.select("document_id", normalize_name(F.col("name")).alias("canonical"), "score", "reason")).groupBy(
        "document_id", "canonical").agg(F.max(F.struct("score", "reason")).alias("best"))
    links = found.join(best, ["document_id", "canonical"], "left").select(
        "document_id", "canonical", "entity_type", "role", F.col("best.score").alias("score"), F.col("best.reason").alias("reason"))

    ends = named.select("document_id", "canonical").distinct()
    between = by_document(connections.select(
        "document_id", normalize_name(F.col("source")).alias("source"), normalize_name(F.col("target")).alias("target"),
        "kind", "confidence").filter("source <> target"))
    for side in ("source", "target"):
        between = between.join(ends.withColumnRenamed("canonical", side), ["document_id", side], "left_semi")
    edges = between.groupBy("document_id", "source", "target", "kind").agg(F.max("confidence").alias("confidence"))

    answers = by_document(inferred.select("document_id", F.col("index").cast("long").alias("index"), "rank", "candidate", "confidence"))
    placed = align_answers(by_document(gaps), answers, "page", "gap_id")
    candidates = placed.select("document_id", "gap_id", "rank", "candidate", "confidence",
                               F.when(F.col("status") == "unresolved", "inferred").otherwise(F.col("status")).alias("status"))
    return {"links": links, "edges": edges, "candidates": candidates}


def apply_documents(store: Contributions, documents: DataFrame, tables: dict[str, DataFrame]) -> None:
    """The consensus of ``documents`` replaces what they added before, in every table; no document is counted twice."""
    store.replace(documents, tables)


def applied_entities(links: DataFrame) -> DataFrame:
    """Entities over all documents: documents, first document and its role, best score, scored documents.

    The links of the store hold a document's name and type once, so documents are counted as links.
    """
    return links.groupBy("canonical", "entity_type").agg(
        F.count("document_id").alias("document_count"), F.min("document_id").alias("first_doc"),
        F.min_by("role", "document_id").alias("role"), F.coalesce(F.max("score"), F.lit(0)).alias("score"),
        F.count("score").alias("evidence_count"))


def applied_edges(edges: DataFrame) -> DataFrame:
    """Edges over all documents, each counted once; the confidence is that of the first document."""
    return edges.groupBy("source", "target", "kind").agg(
        F.count(F.lit(1)).alias("evidence"), F.count(F.lit(1)).cast("double").alias("weight"), F.min_by("confidence", "document_id").alias("confidence"))


def new_findings(levels: DataFrame, notes: DataFrame, known_docs: DataFrame, known_titles: DataFrame, most: int | None = None) -> DataFrame:
    """Findings from consensus rows that say something and are not known yet, newest documents first; the first ``most``, or all.

    ``notes`` is (document_id, flags, connections): latest flags text and number of connections.
    """
    rows = levels.join(notes, "document_id", "left")
    flags, links = F.coalesce("flags", F.lit("")), F.coalesce("connections", F.lit(0))
    worth = (F.col("top_score") >= 30) | (links > 0) | (flags != "")
    title = F.concat(F.col("top_item"), F.lit(" investigative lead (Doc #"), F.col("document_id").cast("string"), F.lit(")"))
    fresh = rows.filter(worth).withColumn("title", title).join(known_docs.select("document_id"), "document_id", "left_anti")
    fresh = fresh.withColumn("_t", F.lower("title")).join(
        known_titles.select(F.lower("title").alias("_t")), "_t", "left_anti").drop("_t")
    chosen = fresh.orderBy(F.desc("document_id"))
    return (chosen if most is None else chosen.limit(most)).select(
        "document_id", "title", categorize(F.col("flags")).alias("category"),
        confidence_class(F.col("top_score"), F.col("agreement")).alias("confidence"))


def finding_rows(levels: DataFrame, notes: DataFrame, aliases: DataFrame, known_docs: DataFrame, known_titles: DataFrame, most: int | None = None) -> DataFrame:
    """New findings with their category by the whole text and the entities that it names.

    ``notes`` is (document_id, summary, flags, relations, connections), the first three text; ``aliases`` (entity_id, alias). The text of a finding
    is its top name, summary, flags and relations together; names are matched as whole words, the longest first.
    """
    found = new_findings(levels, notes.select("document_id", "flags", "connections"), known_docs, known_titles, most).drop("category")
    top = levels.select("document_id", F.col("top_item").cast("string").alias("top_item"))
    parts = found.join(notes, "document_id", "left").join(top, "document_id", "left")
    blob = F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("summary", "flags", "relations")))
    texts = parts.select("document_id", "title", "confidence", blob.alias("blob"), "top_item")
    named = longest_matches(texts.select("document_id", F.concat_ws(" . ", "top_item", "blob").alias("text")), "document_id", "text", aliases, "entity_id", "alias")
    linked = named.groupBy("document_id").agg(F.array_sort(F.collect_set("entity_id")).alias("linked_ids"))
    none = F.array().cast(linked.schema["linked_ids"].dataType)
    return texts.join(linked, "document_id", "left").select(
        "document_id", "title", categorize(F.col("blob")).alias("category"), "confidence", F.coalesce("linked_ids", none).alias("linked_ids"))


def prompt_parts(documents: DataFrame, key: Sequence[str], prior: DataFrame, known_names: Column) -> DataFrame:
    """The text put before an annotator, as ordered parts: (key, block, place, text).

    Blocks are 0 metadata, 1 earlier messages, 2 known entities, 3 body. Joined
    in order they are the text; as rows, a thread of any length fits.
    ``documents`` has doc_type, meta and body; ``prior`` the key, place and part.
    """
    head = F.concat(F.lit("TYPE: "), F.coalesce("doc_type", F.lit("unknown")), F.lit("\n"), "meta")
    fixed_parts = documents.select(*key, F.explode(F.array(
        F.struct(F.lit(0).alias("block"), head.alias("text")), F.struct(F.lit(2).alias("block"), known_names.alias("text")),
        F.struct(F.lit(3).alias("block"), F.col("body").alias("text")))).alias("p"))
    return fixed_parts.select(*key, "p.block", F.lit(0).cast("long").alias("place"), "p.text").unionByName(
        prior.select(*key, F.lit(1).alias("block"), "place", F.col("part").alias("text")))
