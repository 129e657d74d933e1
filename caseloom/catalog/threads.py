"""Message threads."""

from pyspark.sql import functions as F

from caseloom import bindings as b
from caseloom.catalog.registry import query
from caseloom.plans import threads
from caseloom.session import cut

# orders as messages: ten customers share a subject, some have none, bodies repeat within a month
MAIL = """m AS (SELECT o_orderkey AS id, CASE WHEN o_orderpriority = '5-LOW' AND o_custkey % 10 = 0 THEN '' ELSE
  lower(o_orderstatus) || ' order ' || (o_custkey // 10) END AS subject, o_custkey AS person,
 md5(o_orderpriority || strftime(o_orderdate, '%Y-%m') || (o_custkey // 100)) AS body, o_orderdate AS sent_at FROM orders)"""


def order_mail(spark, sf):
    cust = F.col("o_custkey")
    subject = F.when((F.col("o_orderpriority") == "5-LOW") & (cust % 10 == 0), "").otherwise(F.concat(
        F.lower("o_orderstatus"), F.lit(" order "), F.floor(cust / 10).cast("string")))
    person = F.concat(F.lit("c"), cust.cast("string"), F.lit("@mail.example.com"))
    return b.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), subject.alias("subject"), F.array(person).alias("people"),
        F.md5(F.concat("o_orderpriority", F.date_format("o_orderdate", "yyyy-MM"), F.floor(cust / 100).cast("string"))).alias("body_hash"),
        F.col("o_orderdate").alias("sent_at"),
        F.sha2(F.concat_ws("|", subject, person), 256).alias("thread_key"))


STITCHED = f"""WITH RECURSIVE {MAIL}, s AS (SELECT DISTINCT subject FROM m WHERE subject <> ''),
rel AS (SELECT x.subject AS s1, y.subject AS s2 FROM s x JOIN s y ON contains(y.subject, x.subject)),
p AS (SELECT x.id AS a, y.id AS b FROM rel JOIN m x ON x.subject = s1 JOIN m y ON y.subject = s2 WHERE x.id <> y.id
  AND (x.person = y.person OR x.body = y.body OR abs(date_diff('day', x.sent_at, y.sent_at)) <= 5)
 UNION SELECT x.id, y.id FROM m x JOIN m y ON x.person = y.person AND x.id <> y.id WHERE x.subject = '' AND
  (y.subject = '' OR x.body = y.body OR abs(date_diff('day', x.sent_at, y.sent_at)) <= 5)
 UNION SELECT x.id, y.id FROM m x JOIN m y ON x.body = y.body AND x.id <> y.id WHERE x.subject = '' AND abs(date_diff('day', x.sent_at, y.sent_at)) <= 5),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r(id, root) AS (SELECT id, id FROM m UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id WHERE r.root < e.b)
, t AS (SELECT id, min(root) AS root FROM r GROUP BY 1)"""


@query("stitch_threads", STITCHED + " SELECT id, root FROM t")
def stitch_threads(spark, sf):
    return threads.stitch(order_mail(spark, sf), days=5)


@query("stitch_batches", STITCHED + " SELECT id, root FROM t")
def stitch_batches(spark, sf):
    """The later half of the messages joins the threads of the earlier half."""
    mail = order_mail(spark, sf)
    early = mail.filter("sent_at < '1995-07-01'")
    roots = cut(threads.stitch(early, days=5), "early-roots")
    return threads.stitch_more(early, roots, mail.filter("sent_at >= '1995-07-01'"), days=5)


@query("thread_table", STITCHED + """,
placed AS (SELECT t.id, root, person, sent_at, row_number() OVER w AS position, lead(t.id) OVER w AS next_id, date_diff('day', sent_at, lead(sent_at) OVER w) AS pause
 FROM t JOIN m ON m.id = t.id WINDOW w AS (PARTITION BY root ORDER BY sent_at, t.id)),
summary AS (SELECT root, count(*) AS message_count, strftime(min(sent_at), '%Y-%m-%d') AS first_at, strftime(max(sent_at), '%Y-%m-%d') AS last_at,
 count(DISTINCT person) AS people_count FROM placed GROUP BY root)
SELECT id, root, position, message_count, first_at, last_at, people_count, CASE WHEN pause > 7 THEN next_id END AS before_id, CASE WHEN pause > 7 THEN pause END AS gap_days,
 CASE WHEN pause > 30 THEN 'high' WHEN pause > 7 THEN 'medium' END AS severity FROM placed JOIN summary USING (root)""")
def thread_table(spark, sf):
    rows = threads.stitched_threads(order_mail(spark, sf), days=5)
    return rows.withColumns({c: b.day(c) for c in ("first_at", "last_at")})
