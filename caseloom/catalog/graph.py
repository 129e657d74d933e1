"""Graph jobs."""

from pyspark.sql import functions as F

from caseloom import bindings as b
from caseloom.catalog.aggs import CARD, OBS, card_members
from caseloom.catalog.joins import ASOF, WATCH, followed, protected_names, watchlist
from caseloom.catalog.registry import query
from caseloom.catalog.views import LETTERS, SCORES, V1, V1S, V3, V4, V5, using
from caseloom.catalog.windows import CLUSTERS
from caseloom.operators import aggs, topk, windows
from caseloom.operators.blocking import placeholder_candidates
from caseloom.operators.pairs import pair_counts
from caseloom.operators.scoring import entity_scores
from caseloom.operators.skew import bucketed_neighbours
from caseloom.plans import evidence, graph
from caseloom.session import cut, scratch_path
from caseloom.sources.contributions import Contributions


@query("map_connections", using(V1, OBS) + """SELECT source_id, target_id, kind, document_id, CASE kind WHEN 'emailed' THEN 0.9
 WHEN 'flew_with' THEN 0.95 WHEN 'financially_linked' THEN 0.8 ELSE 0.6 END::DOUBLE AS confidence FROM obs""")
def map_connections(spark, sf):
    return graph.document_edges(b.mentions(spark, sf), **b.TYPES).select("source_id", "target_id", "kind", "document_id", "confidence")


@query("khop", using(V5, CARD) + """, h1 AS (SELECT DISTINCT other_id AS e FROM v5b WHERE entity_id IN (SELECT * FROM card)
  AND other_id NOT IN (SELECT * FROM card)),
h2 AS (SELECT DISTINCT other_id AS e FROM v5b WHERE entity_id IN (SELECT * FROM h1) AND other_id NOT IN (SELECT * FROM card)
  AND other_id NOT IN (SELECT * FROM h1))
SELECT entity_id, 0 AS distance FROM card UNION ALL SELECT e, 1 FROM h1 UNION ALL SELECT e, 2 FROM h2""")
def khop(spark, sf):
    return graph.khop(b.edges(spark, sf), card_members(spark, sf), 2)


TRANSITIVE = """v5o AS (SELECT * FROM v5b WHERE entity_id NOT IN (SELECT entity_id FROM v3 WHERE is_protected)
 AND other_id NOT IN (SELECT entity_id FROM v3 WHERE is_protected)),
adj AS (SELECT DISTINCT entity_id AS a, other_id AS b FROM v5o),
seed AS (SELECT DISTINCT entity_id AS a FROM v5o WHERE weight >= 2.0),
l1 AS (SELECT adj.* FROM adj JOIN seed USING (a)),
l2 AS (SELECT DISTINCT l1.a, adj.b FROM l1 JOIN adj ON l1.b = adj.a WHERE l1.a <> adj.b EXCEPT SELECT * FROM l1),
l3 AS (SELECT DISTINCT l2.a, adj.b FROM l2 JOIN adj ON l2.b = adj.a WHERE l2.a <> adj.b EXCEPT SELECT * FROM l1 EXCEPT SELECT * FROM l2),
trans AS (SELECT DISTINCT least(a, b) AS source_id, greatest(a, b) AS target_id, 2 AS degrees FROM l2
 UNION SELECT least(a, b), greatest(a, b), 3 FROM l3)"""


@query("transitive_links", using(V3, V5, TRANSITIVE) + "SELECT *, round(1.0::DOUBLE / degrees, 2) AS confidence FROM trans")
def transitive_links(spark, sf):
    return graph.transitive_links(b.edges(spark, sf), 2.0, 3, b.entities(spark, sf))


def flight_members(spark, sf):
    seen = b.supplier_mentions(spark, sf).filter("doc_type = '2-HIGH' AND evidence_type = 'R'")
    return windows.cluster_members(seen)


def protected_suppliers(spark, sf):
    return b.table(spark, sf, "supplier").filter("s_nationkey = 0").select(F.col("s_suppkey").alias("entity_id"))


FLIGHTS = V1S.replace("WHERE rn = 1", "WHERE rn = 1 AND doc_type = '2-HIGH' AND evidence_type = 'R'")
TEMPORAL = """free AS (SELECT * FROM members WHERE entity_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 0)),
big AS (SELECT start, min(document_id) AS doc FROM free GROUP BY 1 HAVING count(DISTINCT entity_id) >= 3),
tm AS (SELECT DISTINCT start, entity_id, doc FROM free JOIN big USING (start)),
temporal AS (SELECT x.entity_id AS a, y.entity_id AS b, count(*) AS clusters, min(x.doc) AS evidence_doc FROM tm x JOIN tm y
 ON x.start = y.start AND x.entity_id < y.entity_id GROUP BY 1, 2)"""


@query("cluster_edges", using(FLIGHTS, CLUSTERS)
       + f", {TEMPORAL} SELECT a, b, clusters, evidence_doc FROM temporal")
def cluster_edges(spark, sf):
    return graph.cluster_edges(flight_members(spark, sf), protected=protected_suppliers(spark, sf))


FOLLOWED = """fol AS (SELECT user_id, event_id, CAST(floor(epoch_us(ts - seen) / 86400000000) AS BIGINT) AS gap_days FROM ev
 WHERE event_type = 'purchase' AND seen IS NOT NULL AND floor(epoch_us(ts - seen) / 86400000000) BETWEEN 0 AND 30)"""
HUBS = """hubs AS (SELECT v5b.entity_id, count(*) AS link_count FROM v5b JOIN v3 USING (entity_id)
 WHERE entity_type = 'organization' GROUP BY 1 HAVING count(*) >= 3)"""


@query("financial_patterns", using(ASOF, V3, V5, FOLLOWED, HUBS) + """SELECT user_id AS entity_id, 'payment_after_travel' AS pattern,
 gap_days AS measure, event_id AS document_id FROM fol UNION ALL SELECT entity_id, 'hub', link_count, NULL FROM hubs""")
def financial_patterns(spark, sf):
    pairs = followed(spark, sf).select(F.col("user_id").alias("entity_id"), "gap_days", F.col("event_id").alias("document_id"))
    return evidence.sequences_and_hubs(pairs, b.edges(spark, sf), b.entities(spark, sf))


TERMS = ["statement", "payment"]
LINKS = """links AS (SELECT v1.entity_id, document_id, page, CASE doc_type WHEN '1-URGENT' THEN 'email' WHEN '2-HIGH' THEN 'flight_log'
  WHEN '3-MEDIUM' THEN 'financial' WHEN '5-LOW' THEN 'court_filing' ELSE 'other' END AS evidence_type,
 CASE page WHEN 1 THEN 'near [REDACTED] ' WHEN 2 THEN 'a Statement of ' WHEN 3 THEN 'no name' ELSE '' END
  || CASE WHEN page <> 3 THEN upper(p_name) ELSE '' END AS context, p_name AS name, o_orderstatus = 'P' AS removed,
 CASE WHEN evidence_score = 50 THEN 77 END AS user_score
 FROM v1 JOIN part ON p_partkey = v1.entity_id JOIN orders ON o_orderkey = document_id),
item_scores AS (SELECT *, CASE evidence_type WHEN 'email' THEN 20 WHEN 'flight_log' THEN 30 WHEN 'financial' THEN 35 WHEN 'court_filing' THEN 40
  ELSE 5 END AS base, CASE WHEN contains(lower(context), 'redact') THEN 15 ELSE 0 END
  + CASE WHEN contains(lower(context), 'statement') OR contains(lower(context), 'payment') THEN 10 ELSE 0 END
  + CASE WHEN contains(lower(context), lower(name)) THEN 5 ELSE 0 END + CASE WHEN removed THEN 15 ELSE 0 END AS modifier FROM links)"""


def evidence_links(spark, sf):
    kind = F.lit("other")
    for priority, name in {**b.KIND_OF_PRIORITY, "5-LOW": "court_filing"}.items():
        kind = F.when(F.col("doc_type") == priority, name).otherwise(kind)
    lead = F.when(F.col("page") == 1, "near [REDACTED] ").when(F.col("page") == 2, "a Statement of ").when(
        F.col("page") == 3, "no name").otherwise("")
    part = b.table(spark, sf, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"))
    gone = b.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("document_id"), (F.col("o_orderstatus") == "P").alias("removed"))
    return b.mentions(spark, sf).join(part, "entity_id").join(gone, "document_id").select(
        "entity_id", "document_id", "page", "event_ts", "doc_type", "redacted", kind.alias("evidence_type"),
        F.concat(lead, F.when(F.col("page") != 3, F.upper("name")).otherwise("")).alias("context"), "name", "removed",
        F.when(F.col("evidence_score") == 50, 77).alias("user_score"))


@query("score_evidence", using(V1, LINKS) + """SELECT entity_id, document_id, page, base, modifier,
 coalesce(user_score, greatest(0, least(100, base + modifier))) AS score FROM item_scores""")
def score_evidence(spark, sf):
    return evidence.score_evidence(evidence_links(spark, sf), TERMS).select(
        "entity_id", "document_id", "page", "base", "modifier", "score")


WEIGHTS = """weights AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'email' WHEN '2-HIGH' THEN 'flight_log' WHEN '3-MEDIUM' THEN 'financial'
 ELSE 'other' END AS kind, CAST(floor(avg(o_totalprice) / 10000) AS INT) AS weight FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1)"""


@query("weights_as_data", using(V1, LINKS, WEIGHTS) + """SELECT entity_id, document_id, page, coalesce(w.weight, (SELECT weight FROM weights WHERE kind = 'other'))
 AS weight FROM links LEFT JOIN weights w ON kind = evidence_type""")
def weights_as_data(spark, sf):
    kind = F.lit("other")
    for priority, name in b.KIND_OF_PRIORITY.items():
        kind = F.when(F.col("o_orderpriority") == priority, name).otherwise(kind)
    weights = b.table(spark, sf, "orders").filter("o_orderpriority <> '5-LOW'").groupBy(kind.alias("kind")).agg(
        F.floor(F.avg("o_totalprice") / 10000).cast("int").alias("weight"))
    return evidence.weighted(evidence_links(spark, sf), weights).select("entity_id", "document_id", "page", "weight")


SAME = "same AS (SELECT p_partkey AS id, min(p_partkey) OVER (PARTITION BY p_name, p_brand) AS root FROM part)"


def merge_map(spark, sf):
    """Parts of one name and brand: each is merged into the one before it, so the map is a chain."""
    part = b.table(spark, sf, "part")
    rows = part.select("p_name", "p_brand", "p_partkey", F.floor(F.col("p_partkey") / 100000).alias("b"))
    chained = bucketed_neighbours(rows, ["p_name", "p_brand"], "b", ["p_partkey"], [], prev="p")
    return chained.filter("p IS NOT NULL").select(F.col("p_partkey").alias("dropped"), F.col("p.p_partkey").alias("kept"))


@query("merge_aliases", using(SAME.replace("FROM part", ", p_name || ' ' || p_type AS alias FROM part"), "grown AS (SELECT root FROM same GROUP BY 1 HAVING count(*) > 1)")
       + "SELECT DISTINCT root AS entity_id, alias FROM same WHERE root IN (SELECT root FROM grown)")
def merge_aliases(spark, sf):
    names = b.table(spark, sf, "part").select(F.col("p_partkey").alias("entity_id"), F.concat_ws(" ", "p_name", "p_type").alias("name"))
    return graph.merged_aliases(names, merge_map(spark, sf))


@query("merge_counts", using(SAME, V1) + """SELECT root AS entity_id, count(DISTINCT document_id) AS document_count,
 count(DISTINCT (document_id, evidence_type)) AS evidence_count FROM v1 JOIN same ON id = entity_id GROUP BY 1""")
def merge_counts(spark, sf):
    return graph.merged_counts(b.mentions(spark, sf), merge_map(spark, sf))


@query("merge_entities", using(SAME) + """, m AS (SELECT DISTINCT l_orderkey AS d, root AS e FROM lineitem JOIN same ON id = l_partkey
 JOIN orders ON o_orderkey = l_orderkey)
SELECT x.e AS source_id, y.e AS target_id, count(*) AS evidence FROM m x JOIN m y ON x.d = y.d AND x.e < y.e GROUP BY 1, 2 HAVING count(*) >= 2""")
def merge_entities(spark, sf):
    merged = graph.merge_mentions(b.mentions(spark, sf).select("entity_id", "document_id"), merge_map(spark, sf))
    return pair_counts(merged, "document_id", "entity_id", 2).select(
        F.col("a").alias("source_id"), F.col("b").alias("target_id"), F.col("groups").alias("evidence"))


VIEW = """ent AS (SELECT entity_id, lower(name || ' ' || p_brand) AS name, entity_type, score, document_count FROM v4 JOIN part ON p_partkey = entity_id WHERE NOT is_protected),
nodes AS (SELECT name, entity_type, arg_max(entity_id, (score, -entity_id)) AS node_id, max(score) AS score, max(document_count) AS document_count
 FROM ent GROUP BY 1, 2),
ids AS (SELECT ent.entity_id, node_id FROM ent JOIN nodes USING (name, entity_type)),
lk AS (SELECT least(s.node_id, t.node_id) AS source_id, greatest(s.node_id, t.node_id) AS target_id, kind, sum(greatest(1, weight)) AS weight,
 count(*) AS n FROM v5 JOIN ids s ON s.entity_id = source_id JOIN ids t ON t.entity_id = target_id WHERE s.node_id <> t.node_id GROUP BY 1, 2, 3),
lb AS (SELECT source_id AS a, target_id AS b FROM lk UNION ALL SELECT target_id, source_id FROM lk),
deg AS (SELECT a, count(*) AS degree FROM lb GROUP BY 1),
rk AS (SELECT nodes.*, coalesce(degree, 0) AS degree, coalesce(degree, 0) * 100 + score * 3 + document_count * 2
 + CASE WHEN entity_type = 'person' THEN 25 ELSE 0 END AS priority FROM nodes LEFT JOIN deg ON a = node_id),
hub AS (SELECT node_id AS h FROM ids WHERE entity_id = 5),
people AS (SELECT node_id AS p FROM rk WHERE entity_type = 'person'),
f1 AS (SELECT DISTINCT b AS e FROM lb WHERE a IN (SELECT h FROM hub)),
via AS (SELECT e, b FROM f1 JOIN lb ON a = e WHERE e NOT IN (SELECT p FROM people) AND b IN (SELECT p FROM people) AND b NOT IN (SELECT h FROM hub)),
ego AS (SELECT h AS e FROM hub UNION SELECT e FROM f1 WHERE e IN (SELECT p FROM people) UNION SELECT e FROM via UNION SELECT b FROM via),
outs AS (SELECT node_id AS e, row_number() OVER (ORDER BY priority DESC, node_id) AS r FROM rk WHERE entity_type = 'person' AND node_id NOT IN (SELECT e FROM ego)),
wide AS (SELECT e FROM ego UNION ALL SELECT e FROM outs WHERE r <= 45 - (SELECT count(*) FROM ego)),
keep AS (SELECT *, node_id IN (SELECT h FROM hub) AS is_center FROM rk WHERE node_id IN (SELECT e FROM wide)
 ORDER BY is_center DESC, priority DESC, node_id LIMIT 350),
inn AS (SELECT lk.* FROM lk JOIN keep s ON s.node_id = source_id JOIN keep t ON t.node_id = target_id
 WHERE s.is_center OR t.is_center OR s.entity_type = 'person' OR t.entity_type = 'person')"""
VIEW_SQL = using(V1, V3, V5, SCORES, V4, VIEW)


def view(spark, sf):
    brand = b.table(spark, sf, "part").select(F.col("p_partkey").alias("entity_id"), "p_brand")
    edges = cut(b.edges(spark, sf), "edges")
    ents = b.scored_parts(spark, sf, linked=edges).join(brand, "entity_id").withColumn("name", F.concat_ws(" ", "name", "p_brand"))
    return graph.graph_view(ents, edges, center=5, fill=45, most=350, most_links=2500)


@query("graph_view", VIEW_SQL + """SELECT node_id AS entity_id, name, entity_type, degree, round(priority, 4)::DOUBLE AS priority, is_center
FROM keep WHERE score >= 75 OR node_id IN (SELECT source_id FROM inn UNION SELECT target_id FROM inn)""")
def graph_view(spark, sf):
    return view(spark, sf)[0].select("entity_id", "name", "entity_type", "degree", F.round("priority", 4).alias("priority"), "is_center")


@query("graph_view_links", VIEW_SQL + """SELECT source_id, target_id, kind, round(weight, 4) AS weight, n FROM inn
ORDER BY kind, inn.weight DESC, source_id, target_id LIMIT 2500""")
def graph_view_links(spark, sf):
    return view(spark, sf)[1].select("source_id", "target_id", "kind", F.round("weight", 4).alias("weight"), "n")


CARD_SQL = """a_ids AS (SELECT entity_id FROM card), b_ids AS (SELECT p_partkey AS entity_id FROM part WHERE p_name = 'blue bolt'),
conn AS (SELECT other_id, sum(weight) AS w, sum(evidence) AS e, count(*) AS n FROM v5b WHERE entity_id IN (SELECT * FROM a_ids)
 AND other_id NOT IN (SELECT * FROM a_ids) GROUP BY 1 ORDER BY w DESC, e DESC, n DESC, other_id LIMIT 14),
dcs AS (SELECT document_id, max(evidence_score) AS s, count(*) AS m FROM v1 WHERE entity_id IN (SELECT * FROM a_ids) GROUP BY 1
 ORDER BY s DESC, m DESC, document_id DESC LIMIT 8),
shr AS (SELECT document_id FROM v1 WHERE entity_id IN (SELECT * FROM a_ids) INTERSECT SELECT document_id FROM v1 WHERE entity_id IN (SELECT * FROM b_ids)),
thr AS (SELECT entity_id, count(DISTINCT document_id) AS n FROM v1 WHERE document_id IN (SELECT * FROM shr) AND entity_id IN
 (SELECT p_partkey FROM part WHERE p_type = 'SMALL') GROUP BY 1 ORDER BY n DESC, entity_id LIMIT 8)"""


@query("merged_card", using(V1, V3, V5, SCORES, V4, CARD, CARD_SQL) + """SELECT (SELECT max(score) FROM v4 WHERE entity_id IN (SELECT * FROM a_ids)) AS score,
 (SELECT CAST(sum(document_count) AS BIGINT) FROM v4 WHERE entity_id IN (SELECT * FROM a_ids)) AS documents,
 (SELECT count(*) FROM v4 WHERE entity_id IN (SELECT * FROM a_ids)) AS members,
 (SELECT array_to_string(list(other_id ORDER BY w DESC, e DESC, n DESC, other_id), ',') FROM conn) AS connections,
 (SELECT array_to_string(list(document_id ORDER BY s DESC, m DESC, document_id DESC), ',') FROM dcs) AS top_documents,
 (SELECT count(*) FROM shr) AS shared_documents,
 (SELECT array_to_string(list(entity_id ORDER BY n DESC, entity_id), ',') FROM thr) AS also_present,
 (SELECT count(*) FROM v5 WHERE (source_id IN (SELECT * FROM a_ids) AND target_id IN (SELECT * FROM b_ids))
   OR (target_id IN (SELECT * FROM a_ids) AND source_id IN (SELECT * FROM b_ids))) AS edge_count""")
def merged_card(spark, sf):
    part = b.table(spark, sf, "part").withColumnRenamed("p_partkey", "entity_id")
    seen, edges = cut(b.mentions(spark, sf), "seen"), cut(b.edges(spark, sf), "edges")
    card = evidence.merged_card(
        card_members(spark, sf), b.scored_parts(spark, sf, seen, edges), seen, edges,
        part.filter("p_name = 'blue bolt'"), part.filter("p_type = 'SMALL'"))
    return card.select("score", "documents", "members", "connections", "top_documents", "shared_documents", "also_present",
                       "edge_count")


@query("card_details", using(V1, CARD, LETTERS) + r""", own AS (SELECT DISTINCT document_id FROM v1 WHERE entity_id IN (SELECT * FROM card)),
an AS (SELECT document_id, max((l_shipdate, l_linenumber)) AS m FROM own JOIN lineitem ON l_orderkey = document_id GROUP BY 1),
top AS (SELECT document_id, m FROM an ORDER BY m DESC, document_id DESC LIMIT 6),
rg AS (SELECT registry_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(upper(text), '\bN\d{1,5}[A-Z]{0,2}\b')) AS registry_id
 FROM letters WHERE doc_id IN (SELECT * FROM own)) GROUP BY 1 ORDER BY n DESC, registry_id LIMIT 20)
SELECT (SELECT string_agg(document_id || '@' || strftime(m[1], '%Y-%m-%d'), ',' ORDER BY m DESC, document_id DESC) FROM top) AS recent,
 (SELECT string_agg(registry_id, ',' ORDER BY n DESC, registry_id) FROM rg) AS registry_ids""")
def card_details(spark, sf):
    lines = b.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("document_id"), (F.col("l_linenumber").cast("long") * 10**12 + F.col("l_orderkey")).alias("analysis_id"),
        F.col("l_shipdate").alias("analyzed_at"))
    texts = b.letters(spark, sf).select(F.col("doc_id").alias("document_id"), "text")
    row = evidence.card_details(card_members(spark, sf), b.mentions(spark, sf), lines, texts)
    shown = F.transform("recent", lambda r: F.concat(r["document_id"].cast("string"), F.lit("@"), F.date_format(r["analyzed_at"], "yyyy-MM-dd")))
    return row.select(F.array_join(shown, ",").alias("recent"), F.array_join("registry_ids", ",").alias("registry_ids"))


CANDS = """cp AS (SELECT doc_id AS context_id, entity_id, lower(text) AS c, lower(name) AS n, lower(canonical) AS k FROM documents, w),
cands AS (SELECT * FROM (SELECT context_id, entity_id, CASE WHEN contains(c, n) THEN 0.6 WHEN contains(c, k) THEN 0.5 ELSE 0 END::DOUBLE AS score FROM cp) WHERE score >= 0.5 AND entity_id % 9 <> 4)"""
REBUILD = """, sp AS (SELECT count(*) AS c FROM (SELECT entity_id, evidence_type, (n - avg(n) OVER w) / nullif(stddev_samp(n) OVER w, 0) AS z,
  sum(n) OVER w AS t, count(*) OVER w AS k FROM (SELECT entity_id, evidence_type, strftime(event_ts, '%Y-%m') AS m, count(*) AS n FROM v1s GROUP BY 1, 2, 3)
  WINDOW w AS (PARTITION BY entity_id, evidence_type)) WHERE z >= 2.0 AND t >= 3 AND k >= 2),
tc AS (SELECT count(*) AS c FROM (SELECT start FROM members GROUP BY 1 HAVING count(DISTINCT entity_id) >= 3)),
cr AS (SELECT count(*) AS c FROM (SELECT entity_id, count(*) AS t, count(*) FILTER (WHERE marks > 0) AS r, sum(marks) AS s FROM
 (SELECT DISTINCT entity_id, document_id FROM v1s) JOIN (SELECT document_id, count(*) FILTER (WHERE redacted) AS marks FROM v1s GROUP BY 1)
 USING (document_id) GROUP BY 1) WHERE r::DOUBLE / t >= 0.8 AND s >= 5)
SELECT 'scored_links' AS step, count(*) AS n FROM item_scores UNION ALL SELECT 'edges', (SELECT count(*) FROM (SELECT DISTINCT source_id, target_id, kind FROM obs))
UNION ALL SELECT 'frequent_pairs', (SELECT count(*) FROM v5 WHERE evidence >= 3) UNION ALL SELECT 'clusters', c FROM tc
UNION ALL SELECT 'spikes', c FROM sp UNION ALL SELECT 'concealment', c FROM cr
UNION ALL SELECT 'sequences', (SELECT count(*) FROM fol) + (SELECT count(*) FROM hubs) UNION ALL SELECT 'transitive', (SELECT count(*) FROM trans)
UNION ALL SELECT 'entity_scores', (SELECT count(*) FROM scores) UNION ALL SELECT 'candidates', (SELECT count(*) FROM cands)"""


@query("rebuild_graph", using(V1, V1S, V3, V5, SCORES, LINKS, OBS, CLUSTERS, ASOF, FOLLOWED, HUBS, TRANSITIVE, WATCH, CANDS) + REBUILD)
def rebuild_graph(spark, sf):
    tables = rebuild(spark, sf)
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(step).alias("step"), "n") for step, df in tables.items()]
    union = counts[0]  # a row a step
    for part in counts[1:]:
        union = union.unionByName(part)
    return union


@query("rebuild_graph_edges", using(V1, V3, V5, OBS, TRANSITIVE, FLIGHTS, CLUSTERS, TEMPORAL, WATCH, CANDS) + """SELECT source_id, target_id, kind,
 count(DISTINCT document_id) AS evidence, max(CASE kind WHEN 'emailed' THEN 0.9 WHEN 'flew_with' THEN 0.95 WHEN 'financially_linked' THEN 0.8 ELSE 0.6 END::DOUBLE)
 AS confidence, false AS inferred FROM obs GROUP BY 1, 2, 3
UNION ALL SELECT source_id, target_id, 'transitively_linked', 0, round(1.0::DOUBLE / degrees, 2), true FROM trans
UNION ALL SELECT a + 1000000000000, b + 1000000000000, 'temporal_cluster', 1, 0.5, true FROM temporal
UNION ALL SELECT context_id + 3000000000000, entity_id + 4000000000000, 'may_be', 0, score, true FROM cands""")
def rebuild_graph_edges(spark, sf):
    """Edges of the documents and of every detector, each below its own name; the detectors run again and replace only their own."""
    store = Contributions(spark, scratch_path(spark, "graph"), "detector", "string")
    transitive = graph.transitive_links(cut(b.edges(spark, sf), "edges"), entities=b.entities(spark, sf))
    shifted = graph.cluster_edges(flight_members(spark, sf), protected=protected_suppliers(spark, sf)).withColumns(
        {c: F.col(c) + b.ORG for c in ("a", "b")})
    candidates = cut(candidates_of(spark, sf), "candidates").withColumns(
        {"context_id": F.col("context_id") + PLACE, "entity_id": F.col("entity_id") + WATCHED})
    found = graph.detected_edges(shifted, transitive, candidates)
    graph.write_detected(store, {graph.DOCUMENTS: graph.document_edges(b.mentions(spark, sf), **b.TYPES), **found})
    graph.write_detected(store, {"candidates": found["candidates"]})
    return graph.merge_detected(store)


def candidates_of(spark, sf):
    """Watched names that may stand behind the placeholders of documents."""
    contexts = b.table(spark, sf, "documents").select(F.col("doc_id").alias("context_id"), F.col("text").alias("context"))
    return placeholder_candidates(contexts, watchlist(spark, sf), 0.5, protected_names(spark, sf))


PLACE, WATCHED = 3_000_000_000_000, 4_000_000_000_000  # id offsets of placeholders and of watched names


def rebuild(spark, sf):
    """Scores, edges and all detectors over shared written tables."""
    links = evidence_links(spark, sf)
    seen = cut(b.supplier_mentions(spark, sf), "seen")
    mentions = cut(b.mentions(spark, sf), "mentions")
    edges = cut(b.edges(spark, sf), "edges")
    pairs = followed(spark, sf).select(F.col("user_id").alias("entity_id"), "gap_days", F.col("event_id").alias("document_id"))
    observed = graph.document_edges(mentions, **b.TYPES)
    return {
        "scored_links": evidence.score_evidence(links, TERMS),
        "edges": aggs.merge_edges(observed),
        "entity_scores": entity_scores(mentions, edges),
        "candidates": candidates_of(spark, sf),
        "frequent_pairs": topk.frequent_pairs(edges),
        "clusters": windows.time_clusters(windows.cluster_members(seen)),
        "spikes": windows.spikes(seen, ["entity_id", "evidence_type"], "event_ts", 2.0, 3),
        "concealment": aggs.concealment(seen),
        "sequences": evidence.sequences_and_hubs(pairs, edges, b.entities(spark, sf)),
        "transitive": graph.transitive_links(edges, entities=b.entities(spark, sf)),
    }
