"""Window-like queries."""

from pyspark.sql import functions as F

from caseloom import bindings as b
from caseloom.catalog.joins import ASOF, last_views
from caseloom.catalog.registry import query
from caseloom.catalog.views import V1, V1S, V6D, using
from caseloom.functions.text import tokens
from caseloom.operators import windows


@query("topn_per_key", using(V1) + """SELECT entity_id, document_id, page, evidence_score, rn FROM (SELECT *, row_number() OVER
 (PARTITION BY entity_id ORDER BY evidence_score DESC, document_id, page) AS rn FROM v1) WHERE rn <= 10""")
def topn_per_key(spark, sf):
    top = windows.top_per_key(b.mentions(spark, sf), "entity_id",
                              [F.desc("evidence_score"), F.asc("document_id"), F.asc("page")], 10)
    return top.select("entity_id", "document_id", "page", "evidence_score", F.col("rn").cast("long").alias("rn"))


@query("thread_position", """SELECT thread_id, message_id, row_number() OVER (PARTITION BY thread_id ORDER BY sent_at NULLS LAST, message_id)
 AS position FROM (SELECT o_custkey AS thread_id, o_orderkey AS message_id, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS sent_at FROM orders)""")
def thread_position(spark, sf):
    dated = b.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("thread_id"), F.col("o_orderkey").alias("message_id"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("sent_at"))
    return windows.thread_positions(dated).select("thread_id", "message_id", "position")


@query("gap_detection", using(V6D) + """, n AS (SELECT *, lead(message_id) OVER w AS before_id, lead(sent_at) OVER w AS nxt FROM v6d
 WINDOW w AS (PARTITION BY thread_id ORDER BY sent_at, message_id)),
g AS (SELECT *, CAST(floor(epoch(nxt - sent_at) / 86400) AS BIGINT) AS gap_days FROM n WHERE epoch(nxt - sent_at) > 7 * 86400)
SELECT thread_id, message_id AS after_id, before_id, gap_days, CASE WHEN gap_days > 30 THEN 'high' ELSE 'medium' END AS severity FROM g""")
def gap_detection(spark, sf):
    return windows.gaps(b.dated_messages(spark, sf))


@query("prior_context", r"""WITH p AS (SELECT conv_id, turn, E'From: ' || role || E'\n' || text || E'\n' AS part FROM conversations)
SELECT conv_id, turn, part, row_number() OVER w AS position,
 CAST(coalesce(sum(length(part)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)
 AS prior_chars FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def prior_context(spark, sf):
    return context_parts(spark, sf)


def context_parts(spark, sf):
    part = F.concat(F.lit("From: "), "role", F.lit("\n"), "text", F.lit("\n"))
    ctx = windows.running_context(b.table(spark, sf, "conversations"), "conv_id", "turn", part)
    return ctx.select("conv_id", "turn", "part", "position", "prior_chars")


SPIKE = """, m AS (SELECT {k}, strftime(event_ts, '%Y-%m') AS month, count(*) AS n FROM v1s GROUP BY ALL),
s AS (SELECT *, avg(n) OVER w AS mean, stddev_samp(n) OVER w AS sd, sum(n) OVER w AS t, count(*) OVER w AS k FROM m WINDOW w AS (PARTITION BY {k}))
SELECT {k}, month, n, {extra}round((n - mean) / sd, 2) AS z FROM s WHERE t >= {least} AND k >= 2 AND sd > 0 AND (n - mean) / sd >= 2.0"""


@query("monthly_spikes_pair", using(V1S) + SPIKE.format(k="entity_id, evidence_type", extra="", least=3))
def monthly_spikes_pair(spark, sf):
    found = windows.spikes(b.supplier_mentions(spark, sf), ["entity_id", "evidence_type"], "event_ts", 2.0, 3)
    return found.select("entity_id", "evidence_type", "month", "n", b.rounded("z", 2).alias("z"))


@query("activity_spikes", using(V1S) + SPIKE.format(k="entity_id", extra="round(mean, 2) AS mean, round(sd, 2) AS sd, ", least=5))
def activity_spikes(spark, sf):
    found = windows.spikes(b.supplier_mentions(spark, sf), ["entity_id"], "event_ts", 2.0, 5)
    return found.select("entity_id", "month", "n", b.rounded("mean", 2).alias("mean"), b.rounded("sd", 2).alias("sd"),
                        b.rounded("z", 2).alias("z"))


CLUSTERS = """days AS (SELECT DISTINCT CAST(event_ts AS DATE) AS day, entity_id, document_id FROM v1s),
starts AS (SELECT DISTINCT day AS start FROM days),
members AS (SELECT start, day, entity_id, document_id FROM starts JOIN days ON day BETWEEN start AND start + 3)"""


@query("temporal_clusters", using(V1S, CLUSTERS) + """SELECT strftime(start, '%Y-%m-%d') AS date_start, strftime(max(day), '%Y-%m-%d')
 AS date_end, count(DISTINCT entity_id) AS entity_count, count(DISTINCT document_id) AS document_count FROM members GROUP BY start
HAVING count(DISTINCT entity_id) >= 3""")
def temporal_clusters(spark, sf):
    found = windows.time_clusters(windows.cluster_members(b.supplier_mentions(spark, sf)))
    return found.select(b.day("date_start").alias("date_start"), b.day("date_end").alias("date_end"), "entity_count", "document_count")


@query("asof_last", using(ASOF) + "SELECT event_id, user_id, strftime(seen, '%Y-%m-%d %H:%M:%S') AS last_view FROM ev")
def asof_last(spark, sf):
    return last_views(spark, sf).select("event_id", "user_id", F.date_format("seen", "yyyy-MM-dd HH:mm:ss").alias("last_view"))


@query("prev_next", """SELECT o_orderkey, lag(o_orderkey) OVER (ORDER BY o_orderkey) AS prev_id,
 lead(o_orderkey) OVER (ORDER BY o_orderkey) AS next_id FROM orders""")
def prev_next(spark, sf):
    return windows.neighbour_ids(b.table(spark, sf, "orders"), "o_orderkey")


@query("nth_alignment", """WITH g AS (SELECT DISTINCT l_orderkey AS document_id, l_linenumber AS page, l_partkey AS gap_id FROM lineitem
 WHERE l_returnflag = 'R'), n AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page, gap_id) AS "index" FROM g),
a AS (SELECT l_orderkey AS document_id, CAST(l_linenumber AS BIGINT) AS "index", max(l_suppkey) AS candidate FROM lineitem
 WHERE l_returnflag = 'A' GROUP BY 1, 2)
SELECT document_id, gap_id, page, candidate FROM n JOIN a USING (document_id, "index")""")
def nth_alignment(spark, sf):
    lines = b.table(spark, sf, "lineitem")
    gap_rows = lines.filter("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("page"), F.col("l_partkey").alias("gap_id")).distinct()
    answers = lines.filter("l_returnflag = 'A'").groupBy(
        F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").cast("long").alias("index")).agg(
        F.max("l_suppkey").alias("candidate"))
    return windows.align_answers(gap_rows, answers, "page", "gap_id").select("document_id", "gap_id", "page", "candidate")


@query("first_mention", r"""WITH t AS (SELECT doc_id, string_split(trim(regexp_replace(strip_accents(lower(text)), '[^\p{L}\p{N}]+', ' ', 'g')), ' ')
 AS w FROM documents), u AS (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) AS pos FROM t)
SELECT doc_id, token, CAST(min(pos) AS BIGINT) AS first_pos FROM u WHERE token <> '' GROUP BY 1, 2""")
def first_mention(spark, sf):
    rows = b.table(spark, sf, "documents").select("doc_id", F.posexplode(tokens(F.col("text"))).alias("p", "token"))
    return windows.first_mentions(rows.withColumn("pos", (F.col("p") + 1).cast("long")), "doc_id", "token", "pos")


@query("decay_rank", using(V1) + """SELECT entity_id, document_id, page, row_number() OVER (PARTITION BY entity_id
 ORDER BY evidence_score DESC, document_id, page) - 1 AS decay_rank FROM v1 WHERE evidence_score > 0""")
def decay_rank(spark, sf):
    return windows.decay_ranks(b.mentions(spark, sf)).select("entity_id", "document_id", "page", "decay_rank")


@query("best_candidate", """SELECT l_orderkey AS document_id, l_linenumber AS slot, arg_max(l_suppkey, (CAST(l_quantity AS INT), -l_suppkey)) AS candidate,
 max(CAST(l_quantity AS INT)) AS score FROM lineitem GROUP BY 1, 2""")
def best_candidate(spark, sf):
    rows = b.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("slot"), F.col("l_suppkey").alias("candidate"),
        F.col("l_quantity").cast("int").alias("score"))
    return windows.best_candidate(rows, ["document_id", "slot"], "score", "candidate")
