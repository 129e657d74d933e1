"""Joins."""

from pyspark.sql import functions as F

from caseloom import bindings as b
from caseloom.catalog.registry import query
from caseloom.catalog.scalars import CANON, URL_SQL
from caseloom.catalog.views import LETTERS, NAMES, V1, V1S, V2, V3, V5, V6D, V8, using
from caseloom.functions.names import normalize_name
from caseloom.functions.text import email_fields, upper
from caseloom.operators import blocking, diff, joins
from caseloom.operators.pairs import pair_counts
from caseloom.operators.scoring import both_ends
from caseloom.operators.skew import bucketed_last, spread


@query("evidence_docs", using(V1) + """SELECT entity_id, document_id, page, evidence_score, o_totalprice, strftime(o_orderdate,
 '%Y-%m-%d') AS doc_date FROM v1 JOIN orders ON o_orderkey = document_id""")
def evidence_docs(spark, sf):
    docs = b.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("document_id"), "o_totalprice", b.day("o_orderdate").alias("doc_date"))
    return joins.evidence_with_documents(b.mentions(spark, sf), docs).select(
        "entity_id", "document_id", "page", "evidence_score", "o_totalprice", "doc_date")


@query("timeline_left", using(V1) + """SELECT entity_id, document_id, page, strftime(coalesce(o_orderdate, event_ts), '%Y-%m-%d')
 AS event_date FROM v1 LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') ON o_orderkey = document_id""")
def timeline_left(spark, sf):
    mails = b.dated_messages(spark, sf).filter("sender = '1-URGENT'").select(
        F.col("message_id").alias("document_id"), "sent_at")
    return joins.dated_timeline(b.mentions(spark, sf), mails).select(
        "entity_id", "document_id", "page", b.day("event_date").alias("event_date"))


@query("either_end", using(V3, V5) + """SELECT v5b.entity_id, other_id, v3.name AS other_name, kind, evidence
FROM v5b JOIN v3 ON v3.entity_id = other_id""")
def either_end(spark, sf):
    names = b.entities(spark, sf).select(F.col("entity_id").alias("other_id"), F.col("name").alias("other_name"))
    return both_ends(b.edges(spark, sf)).join(names, "other_id").select(
        "entity_id", "other_id", "other_name", "kind", "evidence")


@query("two_alias", using(V3, V5) + """SELECT source_id, target_id, s.name AS source_name, t.name AS target_name,
 round(weight, 4) AS weight FROM v5 JOIN v3 s ON s.entity_id = source_id JOIN v3 t ON t.entity_id = target_id""")
def two_alias(spark, sf):
    return joins.named_edges(b.edges(spark, sf), b.entities(spark, sf)).select(
        "source_id", "target_id", "source_name", "target_name", F.round("weight", 4).alias("weight"))


@query("pair_selfjoin", """WITH m AS (SELECT DISTINCT l_orderkey AS d, l_partkey AS e FROM lineitem)
SELECT x.e AS a, y.e AS b, count(*) AS groups FROM m x JOIN m y ON x.d = y.d AND x.e < y.e GROUP BY 1, 2""")
def pair_selfjoin(spark, sf):
    return pair_counts(b.table(spark, sf, "lineitem"), "l_orderkey", "l_partkey")


@query("or_join", using(V3, V5) + """SELECT v3.entity_id, name, count(*) AS link_count FROM v3 JOIN v5
ON source_id = v3.entity_id OR target_id = v3.entity_id WHERE entity_type = 'organization' GROUP BY 1, 2 HAVING count(*) >= 3""")
def or_join(spark, sf):
    hubs = joins.linked_hubs(both_ends(b.edges(spark, sf)), b.entities(spark, sf), "organization", 3)
    return hubs.select("entity_id", "name", "link_count")


@query("both_ends_semi", using(V3, V5) + """, k AS (SELECT entity_id FROM v3 WHERE entity_type = 'person')
SELECT source_id, target_id, evidence FROM v5 WHERE source_id IN (SELECT * FROM k) AND target_id IN (SELECT * FROM k)""")
def both_ends_semi(spark, sf):
    kept = b.entities(spark, sf).filter("entity_type = 'person'")
    return joins.inner_edges(b.edges(spark, sf), kept).select("source_id", "target_id", "evidence")


@query("removed_anti", using(V8) + f"""SELECT page_id, url FROM mirror WHERE {URL_SQL.format('url')} NOT IN
 (SELECT {URL_SQL.format('url')} FROM current_l)""")
def removed_anti(spark, sf):
    return diff.removed(b.mirror_listing(spark, sf), b.current_listing(spark, sf)).select("page_id", "url")


def _groups(spark, sf):
    return b.table(spark, sf, "part").filter(F.col("p_type").isin("PROMO", "LARGE")).select(
        F.col("p_partkey").alias("entity_id"), F.when(F.col("p_type") == "PROMO", "A").otherwise("B").alias("grp"))


GROUPS = """g AS (SELECT p_partkey AS entity_id, CASE p_type WHEN 'PROMO' THEN 'A' ELSE 'B' END AS grp FROM part
 WHERE p_type IN ('PROMO', 'LARGE'))"""
SHARED = """sd AS (SELECT x.document_id, max(x.evidence_score) AS score_a, max(y.evidence_score) AS score_b FROM
 (SELECT * FROM v1 JOIN g USING (entity_id) WHERE grp = 'A') x JOIN (SELECT * FROM v1 JOIN g USING (entity_id) WHERE grp = 'B') y
 ON x.document_id = y.document_id GROUP BY 1)"""


@query("shared_doc_groups", using(V1, GROUPS, SHARED) + "SELECT * FROM sd")
def shared_doc_groups(spark, sf):
    return joins.shared_documents(b.mentions(spark, sf), _groups(spark, sf))


@query("triple_shared", using(V1, GROUPS, SHARED) + """SELECT entity_id, count(DISTINCT document_id) AS shared_docs
FROM v1 JOIN sd USING (document_id) WHERE entity_id IN (SELECT p_partkey FROM part WHERE p_type = 'SMALL') GROUP BY 1""")
def triple_shared(spark, sf):
    third = b.table(spark, sf, "part").filter("p_type = 'SMALL'").select(F.col("p_partkey").alias("entity_id"))
    return joins.shared_third(b.mentions(spark, sf), _groups(spark, sf), third)


WATCH = r"""w AS (SELECT item_id AS entity_id, CASE WHEN item_id % 2 = 1 THEN 'Dr. ' ELSE '' END || split_part(text, ' ', 1) || ' '
 || split_part(text, ' ', 2) AS name, upper(split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2)) AS canonical FROM benchmark)"""


def watchlist(spark, sf):
    """Names made of the first two words of the passages, every other one with a title."""
    two = F.substring_index("text", " ", 2)
    title = F.when(F.col("item_id") % 2 == 1, "Dr. ").otherwise("")
    return b.table(spark, sf, "benchmark").select(
        F.col("item_id").alias("entity_id"), F.concat(title, two).alias("name"), upper(two).alias("canonical"))


def protected_names(spark, sf):
    """Every ninth of the watched names is protected."""
    return watchlist(spark, sf).filter("entity_id % 9 = 4").select("entity_id")


@query("substring_theta", using(WATCH) + r""", p AS (SELECT doc_id AS context_id, entity_id, lower(text) AS c, lower(name) AS n,
 lower(canonical) AS k FROM documents, w),
q AS (SELECT *, list_distinct(regexp_split_to_array(n, '\s+')) AS nt, regexp_split_to_array(c, '\s+') AS ct FROM p),
s AS (SELECT context_id, entity_id, CASE WHEN contains(c, n) THEN 0.6 WHEN contains(c, k) THEN 0.5
 WHEN len(list_filter(nt, lambda x: list_contains(ct, x)))::DOUBLE / len(nt) >= 0.5 THEN 0.3 ELSE 0 END::DOUBLE AS score FROM q)
SELECT * FROM s WHERE score >= 0.3""")
def substring_theta(spark, sf):
    contexts = b.table(spark, sf, "documents").select(F.col("doc_id").alias("context_id"), F.col("text").alias("context"))
    return blocking.placeholder_candidates(contexts, watchlist(spark, sf), 0.3)


@query("role_tagging", using(LETTERS) + """SELECT doc_id, k, CASE k WHEN 0 THEN 'author' WHEN 1 THEN 'recipient' WHEN 2 THEN
 'recipient' ELSE 'mentioned' END AS role FROM letters, (SELECT unnest([0, 1, 2, 3]) AS k)""")
def role_tagging(spark, sf):
    mails = email_fields(spread(b.letters(spark, sf).select("doc_id", "cust", "text"), "doc_id"), "text")
    cust = F.col("cust").cast("string")
    found = F.array(F.concat(F.lit("customer "), cust), F.concat(F.lit("C"), (F.col("cust") + 1).cast("string"),
                    F.lit("@mail.example.com")), F.lit("Desk"), F.lit("Oak Street"))
    named = mails.select("doc_id", "from_name", "from_address", "to", "cc", F.posexplode(found).alias("k", "name"))
    role = joins.message_role(F.col("name"), F.col("from_name"), F.col("from_address"), F.concat("to", "cc"))
    return named.select("doc_id", "k", role.alias("role"))


ASOF = """ev AS (SELECT *, last_value(CASE WHEN event_type = 'view' THEN ts END IGNORE NULLS) OVER (PARTITION BY user_id
 ORDER BY ts, (event_type = 'purchase')::INT, event_id ROWS UNBOUNDED PRECEDING) AS seen FROM events
 WHERE event_type IN ('view', 'purchase'))"""


def last_views(spark, sf):
    """Views and purchases; each row with the user's latest view up to it."""
    ev = b.table(spark, sf, "events").filter(F.col("event_type").isin("view", "purchase")).select(
        "event_id", "user_id", "ts", "event_type", F.to_date("ts").alias("day"),
        (F.col("event_type") == "purchase").cast("int").alias("side"))
    viewed = F.when(F.col("event_type") == "view", F.col("ts"))
    return bucketed_last(ev, ["user_id"], "day", ["ts", "side", "event_id"], viewed, "seen")


def followed(spark, sf):
    """Purchases within 0-30 days after a view of the same user; days are whole elapsed ones."""
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("seen").cast("timestamp"))
    gap = F.floor(micros / 86400000000).cast("long")
    return last_views(spark, sf).filter("event_type = 'purchase' AND seen IS NOT NULL").withColumn(
        "gap_days", gap).filter("gap_days BETWEEN 0 AND 30")


@query("asof_lookup", using(ASOF) + """SELECT user_id, event_id, strftime(seen, '%Y-%m-%d %H:%M:%S') AS seen_at,
 CAST(floor(epoch_us(ts - seen) / 86400000000) AS BIGINT) AS gap_days FROM ev WHERE event_type = 'purchase' AND seen IS NOT NULL
 AND floor(epoch_us(ts - seen) / 86400000000) BETWEEN 0 AND 30""")
def asof_lookup(spark, sf):
    return followed(spark, sf).select(
        "user_id", "event_id", F.date_format("seen", "yyyy-MM-dd HH:mm:ss").alias("seen_at"), "gap_days")


@query("window_between", using(V1S) + """SELECT DISTINCT entity_id FROM v1s WHERE event_ts >= TIMESTAMP '1997-03-01'
 AND event_ts < TIMESTAMP '1997-03-08' AND contains(lower(doc_type), 'high')""")
def window_between(spark, sf):
    return joins.active_between(b.supplier_mentions(spark, sf), "1997-03-01", "1997-03-08", "HIGH")


@query("range_match", using(V6D) + """, t AS (SELECT thread_id, min(sent_at) AS first_at, max(sent_at) AS last_at FROM v6d
 WHERE sender = '1-URGENT' GROUP BY 1)
SELECT message_id, thread_id FROM v6d JOIN t USING (thread_id) WHERE sender = '2-HIGH'
 AND sent_at >= first_at - INTERVAL 365 DAY AND sent_at <= last_at + INTERVAL 365 DAY""")
def range_match(spark, sf):
    msgs = b.dated_messages(spark, sf)
    threads = msgs.filter("sender = '1-URGENT'").groupBy("thread_id").agg(
        F.min("sent_at").alias("first_at"), F.max("sent_at").alias("last_at"))
    return joins.within_range(msgs.filter("sender = '2-HIGH'"), threads, "thread_id").select("message_id", "thread_id")


@query("json_membership", """SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) = 69 OR user_id = 69""")
def json_membership(spark, sf):
    candidates = F.concat(F.lit('[{"entity_id": '), F.get_json_object("props", "$.k"), F.lit('}, {"entity_id": '),
                          F.col("user_id").cast("string"), F.lit("}]"))
    events = b.table(spark, sf, "events").select("event_id", candidates.alias("candidates"))
    return joins.json_members(events, "candidates", "entity_id", 69).select("event_id")


@query("participants_explode", using(V2) + """SELECT registry, count(DISTINCT event_id) AS events,
 count(DISTINCT entity_id) AS participants FROM v2 JOIN v2p USING (event_id) GROUP BY 1""")
def participants_explode(spark, sf):
    joined = b.flights(spark, sf).join(b.participants(spark, sf), "event_id")
    return joined.groupBy("registry").agg(F.countDistinct("event_id").alias("events"),
                                          F.countDistinct("entity_id").alias("participants"))


@query("latest_scalar", """SELECT c_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest_o_orderkey,
 arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS latest_o_orderstatus FROM customer LEFT JOIN orders ON o_custkey = c_custkey
 GROUP BY 1""")
def latest_scalar(spark, sf):
    orders = b.table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    customers = b.table(spark, sf, "customer").select("c_custkey")
    return joins.latest_child(customers, orders, "c_custkey", ["o_orderdate"], ["o_orderkey", "o_orderstatus"])


@query("anchor_join", """WITH g AS (SELECT item_id, substring(text, 1, 80) AS bf, right(text, 80) AS af,
 length(text) - 160 AS expected FROM benchmark WHERE length(text) >= 200),
c AS (SELECT item_id, doc_id, expected, text, right(bf, 30) AS l, left(af, 30) AS r, instr(text, right(bf, 30)) AS p FROM g, documents
 WHERE contains(text, right(bf, 30)) AND contains(text, left(af, 30))),
m AS (SELECT *, substring(text, p + 30) AS rest FROM c),
f AS (SELECT *, regexp_replace(substring(rest, 1, instr(rest, r) - 1), '^\\s+|\\s+$', '', 'g') AS recovered FROM m WHERE instr(rest, r) > 0),
s AS (SELECT *, CASE WHEN expected > 0 AND length(recovered)::DOUBLE / expected BETWEEN 0.7 AND 1.3 THEN 0.85 ELSE 0.8 END::DOUBLE
 AS score FROM f WHERE recovered <> '')
SELECT item_id AS gap_id, doc_id AS found_in, recovered, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id
 ORDER BY score DESC, doc_id) AS n FROM s) WHERE n = 1""")
def anchor_join(spark, sf):
    long = b.table(spark, sf, "benchmark").filter(F.length("text") >= 200)
    gaps = long.select(F.col("item_id").alias("gap_id"), F.lit(-1).cast("long").alias("doc_id"),
                       F.substring("text", 1, 80).alias("before"), F.right("text", F.lit(80)).alias("after"),
                       (F.length("text") - 160).alias("expected"))
    guarded = b.entities(spark, sf).filter("is_protected")
    return blocking.anchor_join(gaps, b.table(spark, sf, "documents").select("doc_id", "text"), guarded)


@query("alias_resolve", using(NAMES) + f""", m AS (SELECT min(p_partkey) AS entity_id, p_name AS name,
 'The ' || p_name AS alias FROM part WHERE p_size < 40 GROUP BY p_name),
k AS (SELECT entity_id, 0 AS kind, name FROM m UNION ALL SELECT entity_id, 1, alias FROM m),
kk AS (SELECT {CANON} AS key, kind, entity_id FROM k),
best AS (SELECT key, arg_min(entity_id, (kind, entity_id)) AS entity_id, min(kind) AS kind FROM kk GROUP BY 1),
q AS (SELECT id, CASE WHEN p_size % 2 = 0 THEN name ELSE 'mr the  ' || plain END AS name FROM raw_names)
SELECT id, best.entity_id, CASE best.kind WHEN 0 THEN 'canonical' ELSE 'alias' END AS "by" FROM q JOIN best ON {CANON} = key""")
def alias_resolve(spark, sf):
    master = b.table(spark, sf, "part").filter("p_size < 40").groupBy(F.col("p_name").alias("name")).agg(
        F.min("p_partkey").alias("entity_id")).withColumn("aliases", F.array(F.concat(F.lit("The "), "name")))
    asked = b.raw_names(spark, sf).select("id", F.when(F.col("p_size") % 2 == 0, F.col("name")).otherwise(
        F.concat(F.lit("mr the  "), "plain")).alias("name"))
    return joins.resolve_names(asked, master, normalize_name)


@query("entity_cooccur_target", using(V5, GROUPS) + """SELECT count(*) AS edge_count, round(sum(weight), 4) AS weight,
 CAST(sum(evidence) AS BIGINT) AS evidence FROM v5 JOIN g s ON s.entity_id = source_id JOIN g t ON t.entity_id = target_id
 WHERE s.grp <> t.grp""")
def entity_cooccur_target(spark, sf):
    found = joins.between_groups(b.edges(spark, sf), _groups(spark, sf))
    return found.withColumn("weight", F.round("weight", 4))
