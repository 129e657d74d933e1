"""SQL text of the binding views, shared by the queries' SQL."""

V1 = """v1 AS (SELECT entity_id, document_id, page, event_ts, doc_type, evidence_type, evidence_score, redacted FROM (
 SELECT {e} AS entity_id, l_orderkey AS document_id, l_linenumber AS page, l_shipdate AS event_ts,
  o_orderpriority AS doc_type, l_returnflag AS evidence_type, CAST(l_quantity AS INT) AS evidence_score,
  l_returnflag = 'R' AS redacted,
  row_number() OVER (PARTITION BY {e}, l_orderkey, l_linenumber ORDER BY CAST(l_quantity AS INT) DESC,
   l_shipdate, l_partkey, l_extendedprice, l_returnflag) AS rn
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE rn = 1)"""
V1S = V1.format(e="l_suppkey").replace("v1 AS", "v1s AS", 1)
V1 = V1.format(e="l_partkey")
V2 = """v2 AS (SELECT o_orderkey AS event_id, o_custkey AS registry, o_orderdate AS event_ts,
 o_orderpriority AS origin, o_orderstatus AS dest FROM orders),
v2p AS (SELECT DISTINCT l_orderkey AS event_id, l_suppkey AS entity_id FROM lineitem)"""
V3 = """v3 AS (SELECT p_partkey AS entity_id, p_name AS name, CASE WHEN p_size % 4 = 0 THEN 'organization'
  WHEN p_size % 4 = 1 THEN 'location' ELSE 'person' END AS entity_type, p_size = 13 AS is_protected FROM part
 UNION ALL SELECT s_suppkey + 1000000000000, s_name, 'organization', s_nationkey = 0 FROM supplier
 UNION ALL SELECT c_custkey + 2000000000000, c_name, 'person', c_nationkey = 0 FROM customer)"""
V5 = """v5d AS (SELECT DISTINCT l_orderkey AS d, l_partkey AS e FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
v5 AS (SELECT a.e AS source_id, b.e AS target_id, 'co_occurs_with' AS kind, count(*) AS evidence,
  1.0::DOUBLE * (1 + log2(count(*))) AS weight
 FROM v5d a JOIN v5d b ON a.d = b.d AND a.e < b.e GROUP BY 1, 2 HAVING count(*) >= 2),
v5b AS (SELECT *, source_id AS entity_id, target_id AS other_id FROM v5
 UNION ALL SELECT *, target_id, source_id FROM v5)"""
SCORES = """ranked AS (SELECT entity_id, evidence_score AS s,
  row_number() OVER (PARTITION BY entity_id ORDER BY evidence_score DESC, document_id, page) - 1 AS i
  FROM v1 WHERE evidence_score > 0),
avgs AS (SELECT entity_id, count(*) AS n, sum(s * exp(-0.15 * i)) / sum(exp(-0.15 * i)) AS a FROM ranked GROUP BY 1),
docs AS (SELECT entity_id, count(DISTINCT document_id) AS d FROM v1 GROUP BY 1),
strength AS (SELECT entity_id, sum(weight) AS w FROM v5b GROUP BY 1),
scores AS (SELECT docs.entity_id, CASE WHEN a IS NULL THEN 0 ELSE round(least(100, a + least(20, 5 * log2(n + 1))
   + least(15, 0.5 * coalesce(w, 0))), 2) END::DOUBLE AS score, coalesce(n, 0) AS evidence_count,
   d AS document_count
  FROM docs LEFT JOIN avgs USING (entity_id) LEFT JOIN strength USING (entity_id))"""
V4 = "v4 AS (SELECT v3.*, score, evidence_count, document_count FROM v3 JOIN scores USING (entity_id))"
V6 = """v6 AS (SELECT c.conv_id, c.turn, c.role AS sender, c.text AS body, f.subject FROM conversations c
 LEFT JOIN (SELECT conv_id, min(string_split(text, '. ')[1]) AS subject FROM conversations WHERE turn = 0 GROUP BY 1) f
 USING (conv_id))"""
V6D = """v6d AS (SELECT o_custkey AS thread_id, o_orderkey AS message_id, o_orderdate AS sent_at,
 o_orderpriority AS sender FROM orders)"""
V7 = """v7 AS (SELECT l_orderkey AS document_id, l_returnflag AS item, l_suppkey % 4 AS annotator,
 CAST(l_quantity AS INT) AS score, l_linenumber AS slot FROM lineitem)"""
V8 = """mirror AS (SELECT page_id, url FROM pages),
current_l AS (SELECT page_id, CASE WHEN contains(url, '?') THEN url || '#again'
  WHEN NOT regexp_matches(url, '[?#/]$|[?#]') THEN url || '/' ELSE url END AS url
 FROM pages WHERE NOT contains(url, '/de/'))"""
NAMES = """raw_names AS (SELECT p_partkey AS id, p_name AS plain, ['', 'Dr. ', 'mrs ', ' Judge  ', 'Prof. ', 'Lord '][p_size % 6 + 1]
 || replace(p_name, ' ', '  ') || ['', ', Jr.', ' PhD', '  ', ', Esq', ' III'][CAST(floor(p_retailprice) AS INT) % 6 + 1]
 AS name, p_size, p_brand, p_type FROM part)"""
LETTERS = r"""letters AS (SELECT o_orderkey AS doc_id, 'From: Customer ' || o_custkey || ' <c' || o_custkey
 || E'@mail.example.com>\nTo: Desk <desk@example.org>; c' || (o_custkey + 1) || E'@mail.example.com\nSubject: Re: Fwd: order '
 || o_orderpriority || E'\nDate: ' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || E'\n\nPlease send a wire transfer of $'
 || CAST(floor(o_totalprice) AS BIGINT) || '.00 to account 55' || o_orderkey || ' for case No. 12-cv-100' || o_orderkey
 || '. Pilot of N' || (o_custkey % 900 + 100) || E'AB will meet you at 12 Oak Street.\n> earlier line ' || o_orderstatus
 || E'\nSincerely, Customer ' || o_custkey AS text, o_custkey AS cust, o_orderdate AS sent_at FROM orders)"""


def using(*views: str) -> str:
    """WITH clause over the given views."""
    return "WITH " + ",\n".join(views) + "\n"
