"""Ordering, limits and top-k; set operations."""

from pyspark.sql import functions as F

from caseloom import bindings as b
from caseloom.catalog.registry import query
from caseloom.catalog.scalars import CANON, URL_SQL
from caseloom.catalog.views import NAMES, SCORES, V1, V1S, V3, V4, V5, V8, using
from caseloom.operators import aggs, diff, sets, skew, topk
from caseloom.operators.scoring import both_ends, entity_scores
from caseloom.operators.skew import bucketed_rank
from caseloom.sources.tables import manifest
from caseloom.session import cut

SCORED = using(V1, V3, V5, SCORES, V4)


@query("decayed_score", using(V1, V5, SCORES) + "SELECT entity_id, score, evidence_count, document_count FROM scores")
def decayed_score(spark, sf):
    return entity_scores(cut(b.mentions(spark, sf).select("entity_id", "document_id", "evidence_score"), "seen"), b.edges(spark, sf))


@query("ranking", SCORED + """SELECT entity_id, name, entity_type, score, evidence_count FROM v4
WHERE NOT is_protected ORDER BY score DESC, entity_id LIMIT 50""")
def ranking(spark, sf):
    return topk.ranking(b.scored_parts(spark, sf), 50).select(
        "entity_id", "name", "entity_type", "score", "evidence_count")


@query("pagination", """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey) AS position,
 CAST(greatest(ceil(count(*) OVER () / 50.0), 1) AS BIGINT) AS total_pages FROM orders)
SELECT o_orderkey, position, total_pages FROM r WHERE position > (least(99, total_pages) - 1) * 50 AND position <= least(99, total_pages) * 50""")
def pagination(spark, sf):
    orders = b.table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return skew.page_of(orders, "day", [F.asc("o_orderkey")], 99, 50, descending=True).select(
        "o_orderkey", "position", "total_pages")


@query("case_order", """SELECT o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders""")
def case_order(spark, sf):
    orders = b.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", b.day("o_orderdate").alias("day"))
    return topk.case_order(orders, F.col("o_orderstatus") == "P", [F.desc("day"), F.asc("o_orderkey")])


@query("priority_queue", """SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '2-HIGH' AND o_orderstatus <> 'P'
 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""")
def priority_queue(spark, sf):
    done = b.table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    eligible = (F.col("o_orderpriority") == "2-HIGH") & (F.col("o_orderstatus") != "P")
    return topk.next_in_queue(b.table(spark, sf, "orders"), eligible, done, "o_orderkey", "o_totalprice", 100).select(
        "o_orderkey", "o_totalprice")


@query("thread_order", """SELECT o_orderkey, CASE WHEN m THEN o_custkey END AS thread_id, CASE WHEN m THEN row_number() OVER (PARTITION BY o_custkey, m
 ORDER BY o_orderdate, o_orderkey) END AS position FROM (SELECT *, o_orderpriority IN ('1-URGENT', '2-HIGH') AS m FROM orders)""")
def thread_order(spark, sf):
    orders = b.table(spark, sf, "orders")
    members = orders.filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select(
        "o_orderkey", F.col("o_custkey").alias("thread_id"), "o_orderdate", F.date_trunc("month", "o_orderdate").alias("m"))
    placed = bucketed_rank(members, ["thread_id"], "m", [F.asc("o_orderdate"), F.asc("o_orderkey")], "position").select(
        "o_orderkey", "thread_id", "position")
    return orders.select("o_orderkey").join(placed, "o_orderkey", "left").orderBy(
        F.asc_nulls_last("thread_id"), "position", "o_orderkey")


@query("capped_pairs", using(V5) + """SELECT source_id, target_id, evidence FROM v5 WHERE evidence >= 3""")
def capped_pairs(spark, sf):
    return topk.frequent_pairs(b.edges(spark, sf, 3)).select("source_id", "target_id", "evidence")


@query("multi_key_topk", SCORED + """, n AS (SELECT v4.*, coalesce(d, 0) AS degree FROM v4 LEFT JOIN
 (SELECT entity_id, count(*) AS d FROM v5b GROUP BY 1) USING (entity_id))
SELECT entity_id, degree, score FROM n ORDER BY CASE WHEN degree > 0 THEN 0 ELSE 1 END, score DESC, degree DESC, entity_id LIMIT 350""")
def multi_key_topk(spark, sf):
    edges = cut(b.edges(spark, sf), "edges")
    nodes = aggs.node_priority(b.scored_parts(spark, sf, linked=edges), edges)
    return topk.capped_nodes(nodes, 350).select("entity_id", "degree", "score")


@query("known_entities", SCORED + """SELECT array_to_string(list(name ORDER BY score DESC, entity_id), '; ') AS names, count(*) AS n FROM
 (SELECT * FROM v4 WHERE NOT is_protected ORDER BY score DESC, entity_id LIMIT 200)""")
def known_entities(spark, sf):
    return topk.known_names(b.scored_parts(spark, sf), 200)


@query("union_directions", using(V5) + """SELECT source_id AS entity_id, target_id AS other_id FROM v5 UNION
SELECT target_id, source_id FROM v5""")
def union_directions(spark, sf):
    return both_ends(b.edges(spark, sf)).select("entity_id", "other_id").distinct()


@query("url_difference", using(V8) + f"""SELECT {URL_SQL.format('url')} AS address FROM mirror EXCEPT
SELECT {URL_SQL.format('url')} FROM current_l""")
def url_difference(spark, sf):
    return sets.url_difference(b.mirror_listing(spark, sf), b.current_listing(spark, sf))


@query("month_sets", using(V1S) + """, m AS (SELECT DISTINCT entity_id, strftime(event_ts, '%Y-%m') AS mo FROM v1s),
g AS (SELECT mo FROM m WHERE entity_id = 3)
SELECT entity_id, CAST(count(*) FILTER (WHERE mo IN (SELECT mo FROM g)) AS INT) AS common,
 CAST(count(*) FILTER (WHERE mo NOT IN (SELECT mo FROM g)) + (SELECT count(*) FROM g) AS INT) AS either FROM m GROUP BY 1""")
def month_sets(spark, sf):
    return sets.month_sets(b.supplier_mentions(spark, sf), 3)


@query("missing_set", """SELECT l_orderkey AS document_id, array_to_string(list_filter([0, 1, 2, 3], lambda x:
 NOT list_contains(list(DISTINCT l_suppkey % 4), x)), ',') AS missing FROM lineitem GROUP BY 1""")
def missing_set(spark, sf):
    done = b.judgements(spark, sf).groupBy("document_id").agg(F.collect_set("annotator").alias("have"))
    return done.select("document_id", F.array_join(sets.missing_values(F.col("have"), [0, 1, 2, 3]), ",").alias("missing"))


@query("alias_union", using(NAMES) + f""", a AS (SELECT id, unnest([plain, name, 'Dr. ' || plain, p_brand, '  ', lower(p_brand)]) AS name,
 unnest([1, 2, 3, 4, 5, 6]) AS pos FROM raw_names),
k AS (SELECT id, name, pos, row_number() OVER (PARTITION BY id, {CANON} ORDER BY pos) AS rn, {CANON} AS key FROM a)
SELECT id, array_to_string(list(name ORDER BY pos), '|') AS aliases FROM k WHERE rn = 1 AND key <> '' GROUP BY 1""")
def alias_union(spark, sf):
    old = F.array("plain", "name", F.concat(F.lit("Dr. "), "plain"))
    new = F.array(F.col("p_brand"), F.lit("  "), F.lower("p_brand"))
    return b.raw_names(spark, sf).select("id", F.array_join(sets.merge_aliases(old, new), "|").alias("aliases"))


@query("manifest_diff", """WITH o AS (SELECT doc_id, text FROM documents WHERE lang <> 'fr'),
n AS (SELECT doc_id, CASE WHEN lang = 'de' THEN text || '!' ELSE text END AS text FROM documents WHERE lang <> 'es')
SELECT 'docs/' || coalesce(o.doc_id, n.doc_id) || '.txt' AS path, CASE WHEN o.text IS NULL THEN 'added' WHEN n.text IS NULL THEN 'missing'
 WHEN o.text = n.text THEN 'verified' ELSE 'changed' END AS state FROM o FULL JOIN n ON o.doc_id = n.doc_id""")
def manifest_diff(spark, sf):
    path = F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path")
    docs = b.table(spark, sf, "documents")
    old = docs.filter("lang <> 'fr'").select(path, F.col("text").alias("content"))
    new = docs.filter("lang <> 'es'").select(
        path, F.when(F.col("lang") == "de", F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("content"))
    return diff.manifest_diff(manifest(old), manifest(new))
