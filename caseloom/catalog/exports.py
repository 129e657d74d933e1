"""Exports and review jobs."""

from pyspark.sql import functions as F

from caseloom import bindings as b
from caseloom.catalog.aggs import SCORED_EVENTS, scored_flights
from caseloom.catalog.registry import query
from caseloom.catalog.scalars import TOPICS, URL_SQL, category_sql
from caseloom.catalog.views import SCORES, V1, V3, V4, V5, V8, using
from caseloom.functions.text import categorize
from caseloom.operators.blocking import containing
from caseloom.plans import review
from caseloom.session import cut, scratch_path
from caseloom.sources import exports

# parts of one brand count as protected
PUB = """pub AS (SELECT v4.entity_id, v4.name, v4.entity_type, v4.score, p_brand = 'Brand#7' AS is_protected FROM v4 JOIN part ON p_partkey = v4.entity_id)"""
GRAPH_SQL = using(V1, V3, V5, SCORES, V4, PUB)


def guarded(spark, sf, seen=None, linked=None):
    flag = b.table(spark, sf, "part").select(F.col("p_partkey").alias("entity_id"), (F.col("p_brand") == "Brand#7").alias("is_protected"))
    return b.scored_parts(spark, sf, seen, linked).drop("is_protected").join(flag, "entity_id")


@query("export_graph", GRAPH_SQL + "SELECT entity_id, name, score FROM pub WHERE NOT is_protected AND score >= 60")
def export_graph(spark, sf):
    edges = cut(b.edges(spark, sf), "edges")
    nodes, _ = exports.graph(cut(guarded(spark, sf, linked=edges), "entities"), edges, 60)
    path = scratch_path(spark, "nodes")
    exports.write_json(nodes.select("entity_id", "name", "score"), path)
    return spark.read.schema("entity_id bigint, name string, score double").json(path)


@query("export_graph_links", GRAPH_SQL + """, k AS (SELECT entity_id FROM pub WHERE NOT is_protected AND score >= 60)
SELECT source_id, target_id, evidence FROM v5 WHERE source_id IN (SELECT * FROM k) AND target_id IN (SELECT * FROM k)""")
def export_graph_links(spark, sf):
    edges = cut(b.edges(spark, sf), "edges")
    _, links = exports.graph(cut(guarded(spark, sf, linked=edges), "entities"), edges, 60)
    return links.select("source_id", "target_id", "evidence")


@query("export_graph_counts", GRAPH_SQL + """, k AS (SELECT * FROM pub WHERE NOT is_protected AND score >= 60),
l AS (SELECT kind, source_id % 3 = 0 AS inferred FROM v5 WHERE source_id IN (SELECT entity_id FROM k) AND target_id IN (SELECT entity_id FROM k))
SELECT 'node' AS part, entity_type AS value, count(*) AS n FROM k GROUP BY 2 UNION ALL
SELECT 'link', kind, count(*) FROM l WHERE NOT inferred GROUP BY 2""")
def export_graph_counts(spark, sf):
    """Counts of the export without inferred links; its links are written as well."""
    edges = cut(b.edges(spark, sf).withColumn("inferred", F.col("source_id") % 3 == 0), "edges")
    nodes, links = exports.graph(cut(guarded(spark, sf, linked=edges), "entities"), edges, 60, inferred=False)
    path = scratch_path(spark, "links")
    exports.write_json(links.select("source_id", "target_id", "kind", "evidence"), path)
    written = spark.read.schema("source_id bigint, target_id bigint, kind string, evidence bigint").json(path)
    return exports.graph_counts(nodes, written)


@query("export_cards", GRAPH_SQL + """, e AS (SELECT entity_id, array_to_string(list(document_id || ':' || evidence_score ORDER BY rn), ',') AS evidence FROM
 (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY evidence_score DESC, document_id, page) AS rn FROM v1) WHERE rn <= 10 GROUP BY 1),
ok AS (SELECT entity_id FROM pub WHERE NOT is_protected),
k AS (SELECT entity_id, array_to_string(list(other_id || ':' || kind ORDER BY rn), ',') AS connections FROM (SELECT *, row_number() OVER (PARTITION BY entity_id
 ORDER BY weight DESC, other_id, kind) AS rn FROM v5b WHERE entity_id IN (SELECT * FROM ok) AND other_id IN (SELECT * FROM ok)) WHERE rn <= 20 GROUP BY 1),
t AS (SELECT entity_id, array_to_string(list(strftime(event_ts, '%Y-%m-%d') || ':' || document_id ORDER BY rn), ',') AS timeline FROM (SELECT *,
 row_number() OVER (PARTITION BY entity_id ORDER BY event_ts, document_id, page) AS rn FROM v1) WHERE rn <= 20 GROUP BY 1)
SELECT pub.entity_id, evidence, connections, timeline FROM pub LEFT JOIN e USING (entity_id) LEFT JOIN k USING (entity_id) LEFT JOIN t USING (entity_id)
WHERE NOT is_protected""")
def export_cards(spark, sf):
    seen, edges = cut(b.mentions(spark, sf), "seen"), cut(b.edges(spark, sf), "edges")
    card = exports.cards(cut(guarded(spark, sf, seen, edges), "entities"), seen, edges)

    def flat(column, *fields):
        return F.array_join(F.transform(column, lambda r: F.concat_ws(":", *[r[f].cast("string") for f in fields])), ",").alias(column)

    return card.select("entity_id", flat("evidence", "document_id", "evidence_score"), flat("connections", "other_id", "kind"),
                       flat("timeline", "day", "document_id"))


@query("export_timeline", GRAPH_SQL + """, r AS (SELECT entity_id, document_id, page, event_ts, doc_type || ' ' || repeat(name, 40) AS text FROM v1 JOIN pub USING (entity_id)
 WHERE NOT is_protected)
SELECT entity_id, document_id, page, strftime(event_ts, '%Y-%m-%d') AS day, md5(text) AS text_md5,
 strftime((SELECT min(event_ts) FROM r), '%Y-%m-%d') AS first_day, strftime((SELECT max(event_ts) FROM r), '%Y-%m-%d') AS last_day FROM r""")
def export_timeline(spark, sf):
    names = guarded(spark, sf)
    events = b.mentions(spark, sf).join(names.select("entity_id", F.repeat("name", F.lit(40)).alias("long")), "entity_id")
    events = events.withColumn("text", F.concat_ws(" ", "doc_type", "long")).drop("long")
    return exports.timeline(events, names).select(
        "entity_id", "document_id", "page", b.day("event_ts").alias("day"), F.md5("text").alias("text_md5"),
        b.day("first_ts").alias("first_day"), b.day("last_ts").alias("last_day"))


FINDINGS = f"""f AS (SELECT doc_id, {category_sql('t')} AS category, CASE WHEN quality = 1 AND toxic = 0 THEN 'confirmed' WHEN quality = 1 THEN 'likely' ELSE 'unverified' END
 AS confidence, title FROM (SELECT doc_id, quality, toxic, source || ' document ' || doc_id AS title, lower(text || ' ' || {TOPICS}[length(text) % 6 + 1]) AS t
 FROM documents JOIN labels USING (doc_id)))"""


@query("report_by_category", using(FINDINGS) + """, k AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY doc_id) AS line_no FROM f WHERE confidence IN ('confirmed', 'likely'))
SELECT category, line_no, '- [' || confidence || '] ' || title AS line FROM k UNION ALL SELECT DISTINCT category, 0, '## ' || upper(category) FROM k""")
def report_by_category(spark, sf):
    docs = b.table(spark, sf, "documents").join(b.table(spark, sf, "labels"), "doc_id")
    topic = F.element_at(F.array(*map(F.lit, TOPICS)), (F.length("text") % 6 + 1).cast("int"))
    confidence = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "confirmed").when(F.col("quality") == 1, "likely").otherwise("unverified")
    found = docs.select(F.col("doc_id").alias("finding_id"), confidence.alias("confidence"), F.concat("source", F.lit(" document "), F.col("doc_id").cast("string")).alias("title"),
                        categorize(F.concat("text", F.lit(" "), topic)).alias("category"))
    return exports.category_report(found, ["confirmed", "likely"])


@query("entity_report", GRAPH_SQL + "SELECT entity_id, name, format('{:.1f}', round(score, 1)) AS score FROM pub WHERE NOT is_protected AND score >= 50")
def entity_report(spark, sf):
    return exports.entity_report(guarded(spark, sf), 50)


@query("removed_scan", using(V8) + f""", gone AS (SELECT page_id, url FROM mirror WHERE {URL_SQL.format('url')} NOT IN (SELECT {URL_SQL.format('url')} FROM current_l)),
snap AS (SELECT user_id, count(*) AS n, arg_max(event_id, (ts, event_id)) AS last_id FROM events GROUP BY 1)
SELECT url, greatest(CAST(page_id % 100 AS INT), 90) AS priority, coalesce(n, 0) AS snapshots, last_id, CASE WHEN n > 0 THEN 'mirror_found' ELSE 'not_found' END AS status
FROM gone LEFT JOIN snap ON user_id = page_id WHERE contains(url, 'example')""")
def removed_scan(spark, sf):
    known = b.mirror_listing(spark, sf).select("url", F.col("page_id").alias("key"), (F.col("page_id") % 100).cast("int").alias("priority"))
    snaps = b.table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("stamp"), F.col("event_id").alias("snap_id"))
    return review.removed_scan(known, b.current_listing(spark, sf), snaps, "example")


@query("review_queue", """SELECT o_orderkey AS document_id FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT' AND o_totalprice < 50000
AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def review_queue(spark, sf):
    docs = b.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("document_id"), (F.col("o_orderstatus") == "F").alias("analyzed"),
        (F.col("o_orderpriority") == "1-URGENT").alias("reviewed"), (F.col("o_totalprice") / 5000).alias("priority"))
    queued = b.table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("document_id"))
    return review.review_queue(docs, queued).select("document_id")


@query("quarantine", """SELECT doc_id, CASE WHEN q THEN 'already quarantined' WHEN toxic = 1 THEN 'flagged' WHEN quality = 0 THEN 'not reviewed' END AS reason,
 quality = 1 AND NOT q AND toxic = 0 AND lang <> 'es' AS exportable FROM (SELECT *, source = 'src3' AS q FROM labels JOIN documents USING (doc_id))""")
def quarantine(spark, sf):
    rows = b.table(spark, sf, "labels").join(b.table(spark, sf, "documents"), "doc_id").select(
        "doc_id", (F.col("toxic") == 1).alias("flagged"), (F.col("quality") == 1).alias("reviewed"), (F.col("source") == "src3").alias("quarantined"),
        F.when(F.col("lang") == "es", "discard").otherwise("save").alias("decision"))
    return review.quarantine(rows).select("doc_id", "reason", "exportable")


@query("batch_pattern_score", using(SCORED_EVENTS) + """, fl AS (SELECT DISTINCT entity_id FROM v2p WHERE event_id IN (SELECT event_id FROM scored_events WHERE known_registry
 AND event_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')))
SELECT v2p.event_id, v2p.entity_id, score, v2p.entity_id IN (SELECT * FROM fl) AS has_event_evidence FROM v2p JOIN scored_events USING (event_id)
WHERE event_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')""")
def batch_pattern_score(spark, sf):
    # events of finished orders count as scored already
    unscored = b.table(spark, sf, "orders").filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("event_id"))
    scored = scored_flights(spark, sf).join(unscored, "event_id", "left_semi").select("event_id", "known_registry", "score")
    people = b.participants(spark, sf)
    links = people.join(scored.select("event_id", "score"), "event_id")
    return review.event_flags(links, scored, people).select("event_id", "entity_id", "score", "has_event_evidence")


@query("document_view", """SELECT o_orderkey AS document_id, lag(o_orderkey) OVER (ORDER BY o_orderkey) AS prev_id, lead(o_orderkey) OVER (ORDER BY o_orderkey) AS next_id,
 coalesce(pages, 0) AS pages, coalesce(entities, 0) AS entities, coalesce(gaps, 0) AS gaps FROM orders LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_linenumber) AS pages,
 count(DISTINCT l_partkey) AS entities, count(*) FILTER (WHERE l_returnflag = 'R') AS gaps FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def document_view(spark, sf):
    docs = b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("document_id"))
    lines = b.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("page"), F.col("l_partkey").alias("entity_id"),
        (F.col("l_returnflag") == "R").alias("redacted"))
    return review.document_view(docs, lines)


# lines of a document are its pages, sentences its paragraphs; the first one or two words of the passages are names
DOC_VIEW = r"""nm AS (SELECT item_id AS entity_id, split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) AS name,
 ['person', 'organization', 'location'][item_id % 3 + 1] AS entity_type, item_id % 100 AS score FROM benchmark
 UNION ALL SELECT item_id + 1000, split_part(text, ' ', 1), 'location', item_id % 7 FROM benchmark),
lk AS (SELECT doc_id, nm.* FROM documents, nm WHERE contains(text, name)),
pg AS (SELECT doc_id, page, replace(ps[page], '. ', E'.\n\n') AS text FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS page FROM
 (SELECT doc_id, string_split(text, E'\n') AS ps FROM documents))),
bits AS (SELECT doc_id, page, i, regexp_replace(qs[i], '^\s+|\s+$', '', 'g') AS text FROM (SELECT *, unnest(range(1, len(qs) + 1)) AS i FROM
 (SELECT doc_id, page, string_split(text, E'\n\n') AS qs FROM pg))),
para AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY i) AS para, text FROM bits WHERE text <> ''),
who AS (SELECT DISTINCT ON (doc_id, name) * FROM lk ORDER BY doc_id, name, score DESC, entity_id),
pat AS (SELECT doc_id, array_to_string(list(regexp_escape(name) ORDER BY length(name) DESC, name), '|') AS either FROM who GROUP BY 1),
hit AS (SELECT doc_id, page, para, k, ms[k] AS name, list_sum([length(x) FOR x IN bs[1:k]]) + coalesce(list_sum([length(x) FOR x IN ms[1:k - 1]]), 0) AS spot FROM
 (SELECT *, unnest(range(1, len(ms) + 1)) AS k FROM (SELECT doc_id, page, para, regexp_extract_all(text, either) AS ms, regexp_split_to_array(text, either) AS bs
  FROM para JOIN pat USING (doc_id)))),
spans AS (SELECT doc_id, page, para, string_agg(CAST(spot AS BIGINT) || '+' || length(name) || '=' || entity_id, ',' ORDER BY spot) AS spans,
 string_agg(DISTINCT entity_type, ',' ORDER BY entity_type) AS types FROM hit JOIN who USING (doc_id, name) GROUP BY 1, 2, 3),
shown AS (SELECT doc_id, string_agg(page || '.' || para || ':' || coalesce(spans, '') || ':' || coalesce(types, '') || ':' || md5(text)
  || CASE WHEN regexp_matches(text, '(?i)\[redacted\]|\[redaction\]|█') THEN '!' ELSE '' END, ' ' ORDER BY page, para) AS paragraphs FROM para LEFT JOIN spans USING (doc_id, page, para) GROUP BY 1),
ls AS (SELECT doc_id, string_agg(entity_id || '/' || name, ',' ORDER BY score DESC, entity_id) AS links FROM lk GROUP BY 1),
ty AS (SELECT doc_id, string_agg(entity_type || '=' || n, ',' ORDER BY entity_type) AS types FROM (SELECT doc_id, entity_type, count(*) AS n FROM lk GROUP BY 1, 2) GROUP BY 1),
gs AS (SELECT doc_id, string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) AS gaps FROM pg WHERE contains(text, 'http') GROUP BY 1),
cs AS (SELECT doc_id, count(*) AS n_pages, CAST(sum(length(text)) AS BIGINT) AS chars FROM pg GROUP BY 1)"""


@query("document_nested", using(DOC_VIEW) + """SELECT doc_id AS document_id, lag(doc_id) OVER (ORDER BY doc_id) AS prev_id, lead(doc_id) OVER (ORDER BY doc_id) AS next_id,
 n_pages, chars, links, types, gaps, paragraphs FROM documents LEFT JOIN cs USING (doc_id) LEFT JOIN ls USING (doc_id) LEFT JOIN ty USING (doc_id)
 LEFT JOIN gs USING (doc_id) LEFT JOIN shown USING (doc_id)""")
def document_nested(spark, sf):
    """Whole documents with their annotated paragraphs, the nested lists written out."""
    docs = b.table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), "text")
    first, two = F.split_part("text", F.lit(" "), F.lit(1)), F.concat_ws(" ", F.split_part("text", F.lit(" "), F.lit(1)), F.split_part("text", F.lit(" "), F.lit(2)))
    kind = F.element_at(F.array(*map(F.lit, ["person", "organization", "location"])), (F.col("item_id") % 3 + 1).cast("int"))
    items = b.table(spark, sf, "benchmark")
    names = items.select(F.col("item_id").alias("entity_id"), two.alias("name"), kind.alias("entity_type"), (F.col("item_id") % 100).alias("score")).unionByName(
        items.select(F.col("item_id") + 1000, first, F.lit("location"), F.col("item_id") % 7).toDF("entity_id", "name", "entity_type", "score"))
    held = containing(docs, "document_id", "text", names, "entity_id", "name")
    links = cut(held.join(names, "entity_id"), "links")
    pages = docs.select("document_id", F.posexplode(F.split("text", "\n", -1)).alias("page", "text")).select(
        "document_id", (F.col("page") + 1).alias("page"), F.replace("text", F.lit(". "), F.lit(".\n\n")).alias("text"))
    gaps = pages.filter(F.contains("text", F.lit("http"))).select("document_id", "page", (F.col("page") * 10).alias("gap_id"), F.lit("unresolved").alias("status"))
    whole = review.whole_documents(docs, cut(pages, "pages"), links, gaps)

    def written(column, sep, line):
        return F.array_join(F.transform(column, line), sep).alias(column)

    text = lambda c: c.cast("string")
    spans = lambda p: F.array_join(F.transform(p["spans"], lambda s: F.concat(text(s["at"]), F.lit("+"), text(s["size"]), F.lit("="), text(s["entity_id"]))), ",")
    return whole.select(
        "document_id", "prev_id", "next_id", F.size("pages").cast("long").alias("n_pages"), "chars",
        written("links", ",", lambda x: F.concat(text(x["entity_id"]), F.lit("/"), x["name"])),
        written("types", ",", lambda x: F.concat(x["entity_type"], F.lit("="), text(x["n"]))), written("gaps", ",", lambda x: text(x["page"])),
        written("paragraphs", " ", lambda p: F.concat(
            text(p["page"]), F.lit("."), text(p["para"]), F.lit(":"), spans(p), F.lit(":"), F.array_join(p["types"], ","), F.lit(":"), F.md5(p["text"]),
            F.when(p["redacted"], "!").otherwise(""))))
