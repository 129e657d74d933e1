"""Predicates, searches, integrity checks."""

from pyspark.sql import functions as F

from caseloom import bindings as b
from caseloom.catalog.registry import query
from caseloom.catalog.views import SCORES, V1, V2, V3, V4, V5, using
from caseloom.operators import filters, joins


@query("dynamic_filter", """SELECT p_partkey, p_name, p_size FROM part WHERE p_type = 'PROMO' AND p_size >= 5
AND p_size <= 40 AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4')""")
def dynamic_filter(spark, sf):
    kept = filters.where_all(
        b.table(spark, sf, "part"), equal={"p_type": "PROMO", "p_name": None}, at_least={"p_size": 5},
        at_most={"p_size": 40}, among={"p_brand": ["Brand#1", "Brand#2", "Brand#3", "Brand#4"]})
    return kept.select("p_partkey", "p_name", "p_size")


@query("like_literal", r"""WITH p AS (SELECT p_partkey, p_name || CASE WHEN p_size < 10 THEN '_100%' ELSE 'X100Y' END AS name FROM part)
SELECT p_partkey, name FROM p WHERE contains(lower(name), 'g_100%')""")
def like_literal(spark, sf):
    mark = F.when(F.col("p_size") < 10, "_100%").otherwise("X100Y")
    names = b.table(spark, sf, "part").select("p_partkey", F.concat("p_name", mark).alias("name"))
    return names.filter(filters.contains_literal(F.col("name"), "G_100%"))


NORM = r"trim(regexp_replace(strip_accents(lower(text)), '[^\p{L}\p{N}]+', ' ', 'g'))"


@query("phrase_search", f"""SELECT doc_id, lang FROM documents WHERE contains(' ' || {NORM} || ' ', ' and the ')""")
def phrase_search(spark, sf):
    hits = filters.phrase_hits(b.table(spark, sf, "documents"), "text", "And, the!")
    return hits.select("doc_id", "lang")


@query("snippet", f"""WITH n AS (SELECT doc_id, text, ' ' || {NORM} || ' ' AS norm FROM documents),
h AS (SELECT *, instr(norm, ' de la ') AS hit, string_split(trim(norm), ' ') AS tok,
 len(string_split(substring(norm, 1, instr(norm, ' de la ')), ' ')) - 1 AS pos FROM n)
SELECT doc_id, CASE WHEN hit > 0 THEN array_to_string(list_concat(list_concat(
  tok[greatest(pos - 32, 1) : pos - 1], ['[de la]']), tok[pos + 2 : greatest(pos - 32, 1) + 63]), ' ')
 ELSE text END AS snippet FROM h""")
def snippet(spark, sf):
    docs = b.table(spark, sf, "documents")
    return docs.select("doc_id", filters.snippet(F.col("text"), "de la").alias("snippet"))


@query("effective_score", using(V1, V3, V5, SCORES, V4) + """SELECT entity_id,
 coalesce(CAST(l.q AS DOUBLE), score) AS effective_score
FROM v4 LEFT JOIN (SELECT doc_id, max(quality) * 100 AS q FROM labels WHERE toxic = 0 GROUP BY 1) l ON entity_id = l.doc_id""")
def effective_score(spark, sf):
    chosen = b.table(spark, sf, "labels").filter("toxic = 0").groupBy(F.col("doc_id").alias("entity_id")).agg(
        (F.max("quality") * 100).cast("double").alias("user_score"))
    return b.scored_parts(spark, sf).join(chosen, "entity_id", "left").select(
        "entity_id", F.coalesce("user_score", "score").alias("effective_score"))


@query("exists_semi", """SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey
AND (l_quantity > 48 OR l_discount > 0.09 OR l_returnflag = 'R' AND l_linestatus = 'F'))""")
def exists_semi(spark, sf):
    marked = b.table(spark, sf, "lineitem").filter(
        (F.col("l_quantity") > 48) | (F.col("l_discount") > 0.09)
        | ((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")))
    return joins.semi(b.table(spark, sf, "orders"), marked, "o_orderkey", "l_orderkey").select("o_orderkey")


@query("not_in_anti", """SELECT o_orderkey, o_orderstatus FROM orders
WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def not_in_anti(spark, sf):
    left = joins.anti(b.table(spark, sf, "orders"), b.table(spark, sf, "lineitem"), "o_orderkey", "l_orderkey")
    return left.select("o_orderkey", "o_orderstatus")


@query("domain_check", """SELECT event_id, event_type FROM events
WHERE event_type NOT IN ('signup', 'click', 'view', 'purchase')""")
def domain_check(spark, sf):
    bad = filters.outside_domain(b.table(spark, sf, "events"), "event_type", ["signup", "click", "view", "purchase"])
    return bad.select("event_id", "event_type")


@query("fk_orphans", """SELECT o_orderkey, o_custkey FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12)""")
def fk_orphans(spark, sf):
    parents = b.table(spark, sf, "customer").filter("c_nationkey < 12")
    return filters.orphans(b.table(spark, sf, "orders"), parents, "o_custkey", "c_custkey").select(
        "o_orderkey", "o_custkey")


@query("unique_violations", """SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem
GROUP BY 1, 2 HAVING count(*) > 1""")
def unique_violations(spark, sf):
    return filters.repeated_keys(b.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("safe_cast", """SELECT event_id, CASE WHEN event_type IN ('error', 'click') THEN -1.0::DOUBLE
 ELSE CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS num FROM events""")
def safe_cast(spark, sf):
    raw = F.when(F.col("event_type") == "error", "NaN").when(F.col("event_type") == "click", "n/a").otherwise(
        F.get_json_object("props", "$.k"))
    return b.table(spark, sf, "events").select("event_id", filters.safe_number(raw, -1.0).alias("num"))


@query("event_search", using(V2) + """SELECT event_id, registry, strftime(event_ts, '%Y-%m-%d') AS event_date, score FROM (
 SELECT v2.*, o_totalprice AS score FROM v2 JOIN orders ON o_orderkey = event_id)
WHERE (origin = '1-URGENT' OR dest = '1-URGENT') AND event_ts >= TIMESTAMP '1996-01-01' AND event_ts < TIMESTAMP '2000-01-01'
 AND score >= 1000 AND event_id IN (SELECT event_id FROM v2p WHERE entity_id = 7)
ORDER BY score DESC, event_ts DESC, event_id""")
def event_search(spark, sf):
    scores = b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("event_id"),
                                                 F.col("o_totalprice").alias("score"))
    found = joins.event_search(
        b.flights(spark, sf).join(scores, "event_id"), b.participants(spark, sf), place="1-URGENT",
        start="1996-01-01", end="2000-01-01", participant=7, min_score=1000)
    return found.select("event_id", "registry", b.day("event_ts").alias("event_date"), "score")


@query("ids_in_order", """SELECT o_orderkey, o_orderstatus, pos FROM orders JOIN
 (SELECT unnest([17, 3, 99999999999, 5, 11]) AS k, unnest([0, 1, 2, 3, 4]) AS pos) ON o_orderkey = k""")
def ids_in_order(spark, sf):
    found = filters.in_request_order(b.table(spark, sf, "orders"), "o_orderkey", [17, 3, 99999999999, 5, 17, 11])
    return found.select("o_orderkey", "o_orderstatus", "pos")


@query("status_filter", """SELECT o_orderkey, state FROM (SELECT *, CASE WHEN o_orderpriority = '1-URGENT' THEN 'flagged'
 WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'P' THEN 'running' ELSE 'pending' END AS state FROM orders)
WHERE state = 'done' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50""")
def status_filter(spark, sf):
    docs = b.table(spark, sf, "orders").withColumn(
        "state", filters.derived_state(F.col("o_orderstatus"), F.col("o_orderpriority") == "1-URGENT"))
    dear = F.floor(F.col("o_totalprice") / 10_000)
    return filters.document_page(docs, "o_orderkey", "done", dear, [F.desc("o_totalprice")], 3, 25, descending=True).select("o_orderkey", "state")
