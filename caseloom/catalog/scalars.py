"""Scalar functions, each over a whole table."""

from pyspark.sql import functions as F

from caseloom import bindings as b
from caseloom import fixed
from caseloom.catalog.registry import query
from caseloom.catalog.scans import URL_SQL
from caseloom.catalog.views import LETTERS, NAMES, V6, using
from caseloom.functions import dates, names, text, urls
from caseloom.operators.skew import spread

TITLE_SQL, SUFFIX_SQL = fixed.TITLE, fixed.SUFFIX
CANON = (f"upper(trim(regexp_replace(regexp_replace(regexp_replace(trim(name), '{TITLE_SQL}', ''), '{SUFFIX_SQL}', ''), "
         r"'\s+', ' ', 'g')))")


def cases(values, default, column):
    return "CASE " + column + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + f" ELSE '{default}' END"


@query("normalize_name", using(NAMES) + f"SELECT id, {CANON} AS canonical FROM raw_names")
def normalize_name(spark, sf):
    return b.raw_names(spark, sf).select("id", names.normalize_name(F.col("name")).alias("canonical"))


@query("title_name", using(NAMES) + r"""SELECT id, array_to_string(list_transform(string_split(trim(
 regexp_replace(name, '\s+', ' ', 'g')), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title FROM raw_names""")
def title_name(spark, sf):
    return b.raw_names(spark, sf).select("id", names.title_name(F.col("name")).alias("title"))


MATCH_PAIR = """, p AS (SELECT id, lower(plain) AS a, lower(CASE p_size % 5 WHEN 0 THEN upper(plain)
 WHEN 1 THEN split_part(plain, ' ', 1) WHEN 2 THEN split_part(plain, ' ', 2) WHEN 3 THEN substring(plain, 2, 6)
 ELSE p_brand END) AS b FROM raw_names)"""


def _one_way(s, t):
    return (f"(length({s}) >= 6 AND contains({t}, {s})) OR (length({s}) BETWEEN 4 AND 5 AND "
            f"contains(' ' || {t} || ' ', ' ' || {s} || ' '))")


@query("names_match", using(NAMES) + MATCH_PAIR + f"""SELECT id, a <> '' AND b <> '' AND (a = b OR {_one_way('a', 'b')}
 OR {_one_way('b', 'a')}) AS same FROM p""".replace("FROM p", """FROM (SELECT id,
 trim(regexp_replace(a, '\\s+', ' ', 'g')) AS a, trim(regexp_replace(b, '\\s+', ' ', 'g')) AS b FROM p)"""))
def names_match(spark, sf):
    k = F.col("p_size") % 5
    other = (F.when(k == 0, F.upper("plain")).when(k == 1, F.split_part("plain", F.lit(" "), F.lit(1)))
             .when(k == 2, F.split_part("plain", F.lit(" "), F.lit(2))).when(k == 3, F.substring("plain", 2, 6))
             .otherwise(F.col("p_brand")))
    return b.raw_names(spark, sf).select("id", names.names_match(F.col("plain"), other).alias("same"))


# candidate strings: all sentences of the documents, shouted names, debris made from brands and sizes
CANDIDATES = """cand AS (SELECT doc_id AS id, unnest(string_split(text, '. ')) AS s FROM documents
 UNION ALL SELECT p_partkey + 1000000000, CASE p_size % 8 WHEN 0 THEN p_name WHEN 1 THEN 'A' || p_size || '00' WHEN 2 THEN
 repeat(p_name[1], 6) || p_name WHEN 3 THEN repeat(p_name[1:2], 4) WHEN 4 THEN p_name || ' xkcdrt pqrst vwxzt' WHEN 5 THEN
 '$' || p_size || '00' WHEN 6 THEN replace(p_name, ' ', '_') ELSE replace(p_name, ' ', '') || p_type END FROM part)"""


def _candidates(spark, sf):
    k, n = F.col("p_size") % 8, F.col("p_name")
    size = F.col("p_size").cast("string")
    shaped = (F.when(k == 0, n).when(k == 1, F.concat(F.lit("A"), size, F.lit("00")))
              .when(k == 2, F.concat(F.repeat(F.substring(n, 1, 1), F.lit(6)), n))
              .when(k == 3, F.repeat(F.substring(n, 1, 2), F.lit(4))).when(k == 4, F.concat(n, F.lit(" xkcdrt pqrst vwxzt")))
              .when(k == 5, F.concat(F.lit("$"), size, F.lit("00"))).when(k == 6, F.replace(n, F.lit(" "), F.lit("_")))
              .otherwise(F.concat(F.replace(n, F.lit(" "), F.lit("")), F.col("p_type"))))
    return b.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.explode(F.split("text", r"\. ")).alias("s")).union(
        b.table(spark, sf, "part").select((F.col("p_partkey") + 1000000000).alias("id"), shaped.alias("s")))


def _run(s, n, width):
    """SQL: the same ``width`` characters ``n`` times in a row."""
    return (f"len(list_filter(range(1, length({s}) + 1), lambda i: substring({s}, i, {n * width}) = "
            f"repeat(substring({s}, i, {width}), {n}) AND length(substring({s}, i, {n * width})) = {n * width})) > 0")


VOWEL = "length(regexp_replace(lower({w}), '[^{v}]', '', 'g'))"
TOK = r"list_filter(regexp_split_to_array({s}, '\s+'), lambda x: x <> '')"
ALPHA = r"length(regexp_replace(s, '[^\p{L}]', '', 'g'))::DOUBLE / greatest(length(s), 1)"


@query("is_noise", using(CANDIDATES) + f""", t AS (SELECT id, trim(s) AS s, {TOK.format(s="regexp_replace(trim(s), '[^A-Za-z\\s''.-]', '', 'g')")} AS w FROM cand),
u AS (SELECT *, len(list_filter(w, lambda x: length(x) >= 5 AND {VOWEL.format(w='x', v='aeiouy')}::DOUBLE / length(x) < 0.2)) AS bad FROM t)
SELECT id, length(s) < 2 OR length(s) > 200 OR regexp_matches(s, '[\\n\\r]') OR regexp_matches(s, '^[A-Z]{{1,3}}\\d{{3,}}$')
 OR {_run('s', 5, 1)} OR len(w) = 0 OR (len(w) = 1 AND length(w[1]) > 18)
 OR (len(w) >= 2 AND bad >= greatest(2, len(w) // 2)) AS noise FROM u""")
def is_noise(spark, sf):
    return _candidates(spark, sf).select("id", names.is_noise(F.col("s"), F.lit("person")).alias("noise"))


@query("is_garbage", using(CANDIDATES) + f""", t AS (SELECT id, trim(s) AS s, {TOK.format(s='trim(s)')} AS w FROM cand),
u AS (SELECT *, len(list_filter(w, lambda x: length(x) >= 4 AND ({VOWEL.format(w='x', v='aeiouy')}::DOUBLE / length(x) < 0.15
  OR {_run('x', 3, 1)}))) AS odd, starts_with(s, '$') AS money FROM t)
SELECT id, length(s) <= 2 OR regexp_matches(s, '[\\n\\r]') OR ({ALPHA} < 0.5 AND NOT money) OR {_run('s', 5, 1)} OR {_run('s', 4, 2)}
 OR (regexp_matches(s, '[^\\p{{L}}\\p{{N}}_\\s.,''\\-/&()#@$%:]') AND NOT money)
 OR (contains(s, '_') AND NOT regexp_matches(lower(s), 'u\\.s\\.|u\\.k\\.|d\\.c\\.'))
 OR regexp_matches(s, '[^aeiouAEIOU\\s]{{5,}}')
 OR len(list_filter(w, lambda x: length(regexp_replace(x, '[^a-zA-Z]', '', 'g')) >= 4 AND {VOWEL.format(w='x', v='aeiouy')} = 0)) > 0
 OR (len(w) = 1 AND length(s) > 12) OR (len(w) >= 2 AND odd >= 2 AND odd >= len(w) * 0.5) AS garbage FROM u""")
def is_garbage(spark, sf):
    return _candidates(spark, sf).select("id", names.is_garbage(F.col("s")).alias("garbage"))


@query("looks_noisy", using(CANDIDATES) + f""", t AS (SELECT id, trim(s) AS s FROM cand)
SELECT id, length(s) < 3 OR regexp_matches(s, '[\\n\\r]') OR ({ALPHA} < 0.38 AND NOT starts_with(s, '$')) OR {_run('s', 5, 1)}
 OR {_run('s', 4, 2)} OR regexp_matches(s, '[^\\p{{L}}\\p{{N}}_\\s.,''\\-/&()#:$%]') AS noisy FROM t""")
def looks_noisy(spark, sf):
    return _candidates(spark, sf).select("id", names.looks_noisy(F.col("s")).alias("noisy"))


RAW_TYPES = ["Person", " company", "PLACE", "plane", "bank ", "court", "phone", "event", "thing", "Organisation"]


@query("map_entity_type", f"""SELECT p_partkey, {cases(fixed.ENTITY_TYPES, 'person',
 f"lower(trim({RAW_TYPES}[p_size % 10 + 1]))")} AS entity_type FROM part""")
def map_entity_type(spark, sf):
    raw = F.element_at(F.array(*map(F.lit, RAW_TYPES)), (F.col("p_size") % 10 + 1).cast("int"))
    return b.table(spark, sf, "part").select("p_partkey", names.map_entity_type(raw).alias("entity_type"))


RAW_RELS = ["Co occurs", "emailed  with", "works for", "paid", "knows", "Financially linked to", "", "flew_with"]


@query("norm_rel_type", rf"""SELECT p_partkey, {cases(fixed.RELATIONS, 'associated_with',
 f"replace(lower(trim(regexp_replace({RAW_RELS}[p_size % 8 + 1], '[[:space:]]+', ' ', 'g'))), ' ', '_')")} AS kind FROM part""")
def norm_rel_type(spark, sf):
    raw = F.element_at(F.array(*map(F.lit, RAW_RELS)), (F.col("p_size") % 8 + 1).cast("int"))
    return b.table(spark, sf, "part").select("p_partkey", names.norm_rel_type(raw).alias("kind"))


@query("normalize_url", f"SELECT page_id, {URL_SQL.format('url')} AS address FROM pages")
def normalize_url(spark, sf):
    return b.table(spark, sf, "pages").select("page_id", urls.normalize_url(F.col("url")).alias("address"))


@query("url_filename", r"""WITH u AS (SELECT page_id, url || '/My%20File+v1%2Epdf?x=1' AS a, url AS c FROM pages)
SELECT page_id, url_decode(split_part(string_split(a, '/')[-1], '?', 1)) AS long_name,
 url_decode(split_part(string_split(c, '/')[-1], '?', 1)) AS filename FROM u""")
def url_filename(spark, sf):
    long = F.concat("url", F.lit("/My%20File+v1%2Epdf?x=1"))
    return b.table(spark, sf, "pages").select("page_id", urls.url_filename(long).alias("long_name"),
                                              urls.url_filename(F.col("url")).alias("filename"))


@query("safe_filename", r"""WITH n AS (SELECT page_id, regexp_replace(replace(regexp_replace(
 CASE page_id % 4 WHEN 0 THEN url || '..pdf' WHEN 1 THEN 'con.txt' WHEN 2 THEN '..' ELSE html || '.html' END,
 '[<>:"/\\|?*]', '_', 'g'), '..', '_'), '^[. ]+|[. ]+$', '', 'g') AS c FROM pages),
m AS (SELECT page_id, CASE WHEN upper(regexp_replace(c, '\.[^.]*$', '')) IN ('CON') THEN '_' || c ELSE c END AS c FROM n)
SELECT page_id, CASE WHEN c = '' THEN '_unnamed' WHEN length(c) > 200 THEN
 substring(regexp_replace(c, '([^.])\.[^.]*$', '\1'), 1, 200) || regexp_extract(c, '[^.](\.[^.]*)$', 1) ELSE c END AS filename FROM m""")
def safe_filename(spark, sf):
    k = F.col("page_id") % 4
    raw = (F.when(k == 0, F.concat("url", F.lit("..pdf"))).when(k == 1, "con.txt").when(k == 2, "..")
           .otherwise(F.concat("html", F.lit(".html"))))
    return b.table(spark, sf, "pages").select("page_id", urls.safe_filename(raw).alias("filename"))


REPLY = using(V6) + r""", r AS (SELECT conv_id, turn, body || E'\nOn Monday X wrote:\n> ' || coalesce(subject, '')
 || E'\ntail\n--- Original Message ---\n' || body AS t, 'Re: FW:  re: ' || coalesce(subject, '') AS subj, sender FROM v6)"""


def _replies(spark, sf):
    s = F.coalesce("subject", F.lit(""))
    return b.messages(spark, sf).select(
        "conv_id", "turn", "sender",
        F.concat("body", F.lit("\nOn Monday X wrote:\n> "), s, F.lit("\ntail\n--- Original Message ---\n"), "body").alias("t"),
        F.concat(F.lit("Re: FW:  re: "), s).alias("subj"))


@query("clean_body", REPLY + r"""SELECT conv_id, turn, trim(regexp_replace(regexp_replace(t,
 '(?is)-{3,}\s*Original Message\s*-{3,}.*', ''), '(?mi)^>[^\n]*$|^On [^\n]+ wrote:[^\n]*$', '', 'g')) AS body FROM r""")
def clean_body(spark, sf):
    return _replies(spark, sf).select("conv_id", "turn", text.clean_body(F.col("t")).alias("body"))


SUBJ = r"regexp_replace(trim(lower(regexp_replace(trim(subj), '(?i)^(?:(?:re|fw|fwd)\s*:\s*)+', ''))), '\s+', ' ', 'g')"


@query("normalize_subject", REPLY + f"SELECT conv_id, turn, {SUBJ} AS subject FROM r")
def normalize_subject(spark, sf):
    return _replies(spark, sf).select("conv_id", "turn", text.normalize_subject(F.col("subj")).alias("subject"))


@query("thread_key", REPLY + f"""SELECT conv_id, turn, substring(sha256({SUBJ} || '|' || CASE WHEN sender < 'desk' THEN
 sender || ',desk' ELSE 'desk,' || sender END), 1, 32) AS thread_key FROM r""")
def thread_key(spark, sf):
    people = F.array(F.lit("desk"), F.col("sender"))
    return _replies(spark, sf).select("conv_id", "turn", text.thread_key(F.col("subj"), people).alias("thread_key"))


# (Spark format, DuckDB format, SQL of the time that survives the format)
FORMS = [
    ("EEE, dd MMM yyyy HH:mm:ss", "%a, %d %b %Y %H:%M:%S", " -0500", "t + INTERVAL 5 HOUR"),
    ("EEE, dd MMM yyyy HH:mm:ss", "%a, %d %b %Y %H:%M:%S", "", "t"),
    ("dd MMM yyyy HH:mm:ss", "%d %b %Y %H:%M:%S", " (CEST)", "t - INTERVAL 2 HOUR"),
    ("dd MMM yyyy HH:mm:ss", "%d %b %Y %H:%M:%S", " XYZ", "t"),
    ("MM/dd/yyyy hh:mm:ss a", "%m/%d/%Y %I:%M:%S %p", "", "t"),
    ("MM/dd/yyyy HH:mm:ss", "%m/%d/%Y %H:%M:%S", "", "t"),
    ("MM/dd/yyyy hh:mm a", "%m/%d/%Y %I:%M %p", "", "date_trunc('minute', t)"),
    ("MM/dd/yyyy", "%m/%d/%Y", "", "date_trunc('day', t)"),
    ("yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S", "", "t"),
    ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S", " +0130", "t - INTERVAL 90 MINUTE"),
    ("yyyy-MM-dd", "%Y-%m-%d", "", "date_trunc('day', t)"),
    ("MMMM dd, yyyy", "%B %d, %Y", "", "date_trunc('day', t)"),
    ("MMM dd, yyyy", "%b %d, %Y", "", "date_trunc('day', t)"),
    ("dd-MMM-yyyy", "%d-%b-%Y", "", "date_trunc('day', t)"),
    ("dd-MMM-yy", "%d-%b-%y", "", "date_trunc('day', t)"),
    (None, None, "soon", "NULL"),
]


@query("parse_date", """WITH o AS (SELECT o_orderkey, o_orderdate + to_seconds(o_custkey * 37) AS t FROM orders)
SELECT o_orderkey, strftime(CASE o_orderkey % 16 """ + " ".join(
    f"WHEN {i} THEN {form[3]}" for i, form in enumerate(FORMS)) + """ END, '%Y-%m-%d %H:%M:%S') AS parsed FROM o""")
def parse_date(spark, sf):
    stamp = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("o_custkey") * 37)
    written = F.lit("soon")
    for i, (form, _, zone, _) in enumerate(FORMS[:-1]):
        weekday = form.startswith("EEE, ")
        value = F.date_format(stamp, form.removeprefix("EEE, "))
        if weekday:
            value = F.concat(F.date_format(stamp, "EEE"), F.lit(", "), value)
        written = F.when(F.col("o_orderkey") % 16 == i, F.concat(value, F.lit(zone))).otherwise(written)
    orders = b.table(spark, sf, "orders").select("o_orderkey", written.alias("w"))
    return orders.select("o_orderkey", F.date_format(dates.parse_date(F.col("w")), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("month_key", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def month_key(spark, sf):
    return b.table(spark, sf, "orders").select("o_orderkey", dates.month_key("o_orderdate").alias("month"))


@query("registry_ids", using(LETTERS) + r"""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(
 upper(text || ' n12b N7 ' || doc_id), '\bN\d{1,5}[A-Z]{0,2}\b'))), ',') AS ids FROM letters""")
def registry_ids(spark, sf):
    extra = F.concat(F.lit("n12b N7 "), F.col("doc_id").cast("string"))
    return b.letters(spark, sf).select(
        "doc_id", F.array_join(text.registry_ids(F.col("text"), extra), ",").alias("ids"))


@query("email_fields", using(LETTERS) + r"""SELECT doc_id, 'Customer ' || cust AS from_name,
 'c' || cust || '@mail.example.com' AS from_address, 2::INT AS n_to, split_part(split_part(text, 'Subject: ', 2), E'\n', 1) AS subject,
 strftime(sent_at, '%Y-%m-%d %H:%M:%S') AS date, substring(text, instr(text, 'Please send')) AS body FROM letters""")
def email_fields(spark, sf):
    f = text.email_fields(spread(b.letters(spark, sf).select("doc_id", "text"), "doc_id"), "text")
    return f.select("doc_id", "from_name", "from_address", F.size("to").alias("n_to"), "subject", "date", "body")


@query("split_context", r"""WITH l AS (SELECT doc_id, string_split(text, E'\n') AS ls,
 CAST(floor((doc_id % 10) / 10.0 * len(string_split(text, E'\n'))) AS INT) AS raw FROM documents),
c AS (SELECT doc_id, array_to_string(ls[1:cut], E'\n') AS bf, array_to_string(ls[cut + 1:], E'\n') AS af FROM
 (SELECT *, greatest(0, least(raw, len(ls) - 1)) AS cut FROM l))
SELECT doc_id, nullif(right(bf, 500), '') AS before, nullif(substring(af, 1, 500), '') AS after FROM c""")
def split_context(spark, sf):
    ratio = (F.col("doc_id") % 10) / F.lit(10.0)
    before, after = text.split_context(F.col("text"), ratio)
    return b.table(spark, sf, "documents").select("doc_id", before.alias("before"), after.alias("after"))


@query("truncate_label", """SELECT doc_id, CASE WHEN length(text) <= 300 THEN text ELSE substring(text, 1, 297) || '...' END AS short,
 least(greatest(n_chars / 40.0 - 5, 0), 100)::DOUBLE AS clamped, CASE WHEN n_chars >= 3000 THEN 'HIGH' WHEN n_chars >= 2000 THEN
 'MEDIUM' WHEN n_chars >= 1000 THEN 'LOW' ELSE 'MINIMAL' END AS label FROM documents""")
def truncate_label(spark, sf):
    return b.table(spark, sf, "documents").select(
        "doc_id", text.truncate(F.col("text")).alias("short"),
        F.least(F.greatest(F.col("n_chars") / 40 - 5, F.lit(0.0)), F.lit(100.0)).alias("clamped"),
        text.score_label(F.col("n_chars") / 40).alias("label"))


def category_sql(column):
    whens = " ".join("WHEN " + " OR ".join(f"contains({column}, '{k}')" for k in keys) + f" THEN '{name}'"
                     for name, keys in fixed.CATEGORIES)
    return f"CASE {whens} ELSE 'other' END"


TOPICS = ["sealed file", "Wire payment", "false statement", "the Senator", "obstruction of", "nothing"]


@query("categorize_text", f"""SELECT doc_id, {category_sql('t')} AS category FROM (SELECT doc_id,
 lower(text || ' ' || {TOPICS}[doc_id % 6 + 1]) AS t FROM documents)""")
def categorize_text(spark, sf):
    topic = F.element_at(F.array(*map(F.lit, TOPICS)), (F.col("doc_id") % 6 + 1).cast("int"))
    return b.table(spark, sf, "documents").select("doc_id", text.categorize(F.concat("text", F.lit(" "), topic)).alias("category"))


@query("confidence_class", """SELECT o_orderkey, CASE WHEN s >= 85 AND a IN ('full', 'majority') THEN 'confirmed'
 WHEN s >= 60 OR a IN ('full', 'majority') THEN 'likely' ELSE 'unverified' END AS by_consensus,
 CASE WHEN s >= 85 THEN 'very_high' WHEN s >= 70 THEN 'high' WHEN s >= 50 THEN 'medium' WHEN s >= 30 THEN 'low'
 ELSE 'very_low' END AS by_pattern FROM (SELECT o_orderkey, o_custkey % 101 AS s, CASE o_orderstatus WHEN 'F' THEN 'full'
 WHEN 'P' THEN 'majority' ELSE 'split' END AS a FROM orders)""")
def confidence_class(spark, sf):
    s = F.col("o_custkey") % 101
    a = F.when(F.col("o_orderstatus") == "F", "full").when(F.col("o_orderstatus") == "P", "majority").otherwise("split")
    return b.table(spark, sf, "orders").select(
        "o_orderkey", text.confidence_class(s, a).alias("by_consensus"), text.pattern_class(s / 100).alias("by_pattern"))


@query("json_safe", """SELECT event_id, CASE WHEN event_type = 'error' THEN -1 ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k
FROM events""")
def json_safe(spark, sf):
    raw = F.when(F.col("event_type") == "error", F.concat(F.lit("{"), F.col("props"))).otherwise(F.col("props"))
    parsed = F.from_json(raw, "k bigint").getField("k")
    return b.table(spark, sf, "events").select("event_id", F.coalesce(parsed, F.lit(-1).cast("long")).alias("k"))


@query("token_overlap", r"""WITH t AS (SELECT p_partkey, list_distinct(string_split(lower(p_name || ' ' || p_brand), ' ')) AS n,
 string_split(lower(p_name || ' of ' || p_type), ' ') AS c FROM part)
SELECT p_partkey, round(len(list_filter(n, lambda x: list_contains(c, x)))::DOUBLE / len(n), 4) AS share FROM t""")
def token_overlap(spark, sf):
    share = text.token_overlap(F.concat_ws(" ", "p_name", "p_brand"), F.concat_ws(" of ", "p_name", "p_type"))
    return b.table(spark, sf, "part").select("p_partkey", F.round(share, 4).alias("share"))


@query("alpha_ratio", r"""SELECT doc_id, round(length(regexp_replace(text, '[^\p{L}]', '', 'g'))::DOUBLE / greatest(length(text), 1), 6)
 AS ratio FROM documents""")
def alpha_ratio(spark, sf):
    return b.table(spark, sf, "documents").select("doc_id", F.round(names.alpha_ratio(F.col("text")), 6).alias("ratio"))


@query("hashes", "SELECT doc_id, sha256(text) AS sha, md5(text) AS md FROM documents")
def hashes(spark, sf):
    return b.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.md5("text").alias("md"))


STEMS = ["mail_{}.eml", "Depo-{}.txt", "flight_log_{}.pdf", "bank {}.csv", "motion_order_{}", "notes_{}.MSG"]


@query("stem_type_hint", f"""WITH f AS (SELECT doc_id, lower(replace({STEMS}[doc_id % 6 + 1], '{{}}', source)) AS n FROM documents)
SELECT doc_id, CASE WHEN contains(n, 'mail') OR n LIKE '%.eml' OR n LIKE '%.msg' THEN 10 ELSE 0 END AS email,
 CASE WHEN contains(n, 'depo') THEN 10 ELSE 0 END AS deposition,
 CASE WHEN contains(n, 'flight') OR contains(n, 'log') OR contains(n, 'manifest') THEN 10 ELSE 0 END AS flight_log,
 CASE WHEN contains(n, 'invoice') OR contains(n, 'bank') OR contains(n, 'financial') THEN 10 ELSE 0 END AS financial,
 CASE WHEN contains(n, 'motion') OR contains(n, 'order') OR contains(n, 'filing') THEN 10 ELSE 0 END AS court_filing FROM f""")
def stem_type_hint(spark, sf):
    stem = F.element_at(F.array(*map(F.lit, STEMS)), (F.col("doc_id") % 6 + 1).cast("int"))
    hints = text.stem_hints(F.replace(stem, F.lit("{}"), F.col("source")))
    return b.table(spark, sf, "documents").select("doc_id", *[v.alias(k) for k, v in hints.items()])
