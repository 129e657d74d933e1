"""Scans, landed files, manifests, upserts and logs."""

from pyspark.sql import functions as F

from caseloom import bindings as b
from caseloom.catalog.registry import query
from caseloom.catalog.views import V8, using
from caseloom.functions.urls import file_type, url_filename
from caseloom.session import scratch_path
from caseloom.sources import landed, tables


@query("scan_table", """SELECT l_orderkey, l_partkey, l_quantity FROM lineitem
WHERE l_quantity > 45 AND l_returnflag = 'R'""")
def scan_table(spark, sf):
    where = (F.col("l_quantity") > 45) & (F.col("l_returnflag") == "R")
    return tables.scan(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_partkey", "l_quantity"], where)


def _files(spark, sf):
    return b.table(spark, sf, "documents").select(
        F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.col("text").alias("content"), "lang")


@query("file_manifest", """SELECT min('docs/' || doc_id || '.txt') AS path, sha256(text) AS sha256,
max(strlen(text)) AS size_bytes FROM documents WHERE sha256(text) NOT IN
(SELECT sha256(text) FROM documents WHERE lang = 'de') GROUP BY sha256(text)""")
def file_manifest(spark, sf):
    files = _files(spark, sf)
    known = tables.manifest(files.filter("lang = 'de'"))
    return tables.register_unseen(tables.manifest(files), known)


@query("exact_dedup", """SELECT min(doc_id) AS doc_id, sha256(text) AS content_hash, count(*) AS copies
FROM documents GROUP BY 2""")
def exact_dedup(spark, sf):
    return tables.exact_copies(b.table(spark, sf, "documents"), "doc_id", F.col("text"))


@query("file_type", """WITH f AS (SELECT p_partkey, p_name || ['.pdf', '.JPG', '.mp4', '.wav', '.csv', '.xyz', ''][p_size % 7 + 1]
 AS path FROM part) SELECT p_partkey, path, CASE WHEN lower(path) LIKE '%.pdf' THEN 'pdf' WHEN lower(path) LIKE '%.jpg'
 THEN 'image' WHEN lower(path) LIKE '%.mp4' THEN 'video' WHEN lower(path) LIKE '%.wav' THEN 'audio'
 WHEN lower(path) LIKE '%.csv' THEN 'text' ELSE 'other' END AS file_type FROM f""")
def file_type_(spark, sf):
    ending = F.element_at(F.array(*map(F.lit, [".pdf", ".JPG", ".mp4", ".wav", ".csv", ".xyz", ""])),
                          (F.col("p_size") % 7 + 1).cast("int"))
    paths = b.table(spark, sf, "part").select("p_partkey", F.concat("p_name", ending).alias("path"))
    return paths.withColumn("file_type", file_type(F.col("path")))


@query("html_links", r"""WITH a AS (SELECT page_id, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) AS host,
 unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 1)) AS href,
 unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 2)) AS label FROM pages)
SELECT page_id, CASE WHEN starts_with(href, '/') THEN host || href ELSE href END AS link,
 trim(regexp_replace(label, '<[^>]*>', '', 'g')) AS link_text FROM a""")
def html_links(spark, sf):
    links = landed.html_links(b.table(spark, sf, "pages"), "page_id", extensions=None)
    return links.select("page_id", "link", "link_text")


@query("text_links", r"""WITH p AS (SELECT page_id, 'mirror ' || url || '/files/report_' || page_id || '.pdf and '
 || html || ' magnet:?xt=urn:btih:' || md5(url) || ' end' AS t, url FROM pages)
SELECT page_id, unnest(regexp_extract_all(t, '(?i)https?://[^\s"''<>)\]]+\.(?:pdf|zip|rar|7z|tar\.gz)')) AS url,
 false AS is_magnet, 'report_' || page_id || '.pdf' AS filename FROM p
UNION ALL SELECT page_id, unnest(regexp_extract_all(t, 'magnet:\?xt=urn:[^\s"''<>)\]]+')), true,
 'magnet_from_' || page_id FROM p""")
def text_links(spark, sf):
    pages = b.table(spark, sf, "pages")
    text = F.concat(F.lit("mirror "), "url", F.lit("/files/report_"), F.col("page_id").cast("string"),
                    F.lit(".pdf and "), "html", F.lit(" magnet:?xt=urn:btih:"), F.md5("url"), F.lit(" end"))
    return landed.text_links(pages, "page_id", text)


URL_SQL = (r"regexp_extract({0}, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)', 1) || regexp_replace(lower(regexp_extract({0}, "
           r"'^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1)), '/+$', '')")


@query("inventory_union", using(V8) + f""", u AS (SELECT 0 AS r, 'current' AS source, page_id, url,
 CAST(NULL AS BIGINT) AS size FROM current_l UNION ALL SELECT 1, 'mirror', page_id, url, strlen(url) FROM mirror)
SELECT address, source, url, size FROM (SELECT *, {URL_SQL.format('url')} AS address,
 row_number() OVER (PARTITION BY {URL_SQL.format('url')} ORDER BY r, url, page_id) AS n FROM u) WHERE n = 1""")
def inventory_union(spark, sf):
    mirror = b.mirror_listing(spark, sf).withColumn("size", F.octet_length("url").cast("long"))
    sources = [("current", b.current_listing(spark, sf)), ("mirror", mirror)]
    return landed.inventory(sources).select("address", "source", "url", "size")


@query("json_listing", """SELECT event_id, 0 AS row, unnest(['k', 'type']) AS field,
unnest([json_extract_string(props, '$.k'), event_type]) AS value FROM events""")
def json_listing(spark, sf):
    k = F.get_json_object("props", "$.k")
    listing = F.concat(F.lit('[["k","type"],["'), k, F.lit('","'), "event_type", F.lit('"]]'))
    events = b.table(spark, sf, "events").select("event_id", listing.alias("listing"))
    return landed.listing_rows(events, "event_id", "listing")


@query("latest_snapshot", """SELECT user_id, count(*) AS snapshots, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts,
 arg_max(event_id, (ts, event_id)) AS last_id FROM events GROUP BY 1""")
def latest_snapshot(spark, sf):
    latest = landed.latest_snapshot(b.table(spark, sf, "events"), "user_id", "ts", "event_id")
    return latest.withColumn("last_ts", F.date_format("last_ts", "yyyy-MM-dd HH:mm:ss"))


@query("upsert_first_wins", """WITH u AS (
 SELECT 0 AS b, p_partkey AS id, p_name AS name, CASE WHEN p_size < 20 THEN p_brand END AS role, p_type AS alias
 FROM part WHERE p_retailprice < 1000
 UNION ALL SELECT 1, p_partkey, p_name, CASE WHEN p_size > 10 THEN p_brand END, p_type FROM part
 WHERE p_retailprice >= 1000)
SELECT name, arg_min(id, (b, id)) AS id, arg_min(role, (b, id)) FILTER (WHERE role IS NOT NULL) AS role,
 array_to_string(list_sort(list(DISTINCT alias)), ',') AS aliases FROM u GROUP BY name""")
def upsert_first_wins(spark, sf):
    part = b.table(spark, sf, "part")

    def batch(df, role):
        return df.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"),
                         F.when(role, F.col("p_brand")).alias("role"), F.array("p_type").alias("aliases"))

    known = batch(part.filter("p_retailprice < 1000"), F.col("p_size") < 20)
    new = batch(part.filter("p_retailprice >= 1000"), F.col("p_size") > 10)
    merged = tables.upsert_first_wins(known, new, ["name"], ["role"], "id", union="aliases")
    return merged.withColumn("aliases", F.array_join("aliases", ","))


@query("upsert_last_wins", """SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey,
 arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus,
 arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice FROM orders GROUP BY 1""")
def upsert_last_wins(spark, sf):
    orders = b.table(spark, sf, "orders")
    return tables.upsert_last_wins(orders, "o_custkey", ["o_orderdate"], ["o_orderkey", "o_orderstatus", "o_totalprice"])


@query("append_log", """SELECT event_id, event_type AS action, props AS details, event_type <> 'error' AS user_initiated
FROM events""")
def append_log(spark, sf):
    path = scratch_path(spark, "log")
    events = b.table(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("action"), F.col("props").alias("details"),
        (F.col("event_type") != "error").alias("user_initiated"))
    tables.append_log(events.filter("action = 'error'"), path)
    tables.append_log(events.filter("action <> 'error'"), path)
    return spark.read.parquet(path)
