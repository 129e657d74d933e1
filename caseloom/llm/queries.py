"""Registered queries of the corpus operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import functions as F

from caseloom.llm import chat, covers, crosstoken, decontaminate, language, lattice, neardup, packing, quality, sharding, spelling, suffixdedup, topk
from caseloom.llm.common import fold, short_batches, table

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def keep(fn):
        def run(spark, sf_dir):
            short_batches(spark)
            return fn(spark, sf_dir)

        QUERIES[key] = run
        if sql:
            ORACLES[key] = sql
        return fn

    return keep


@query("op1_quality_classifier")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(fold("doc_id", 3) != 1)
    return quality.score(docs, quality.train(docs, labels)).select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op2_suffix_dedup", """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 800)) AS k FROM d, unnest(range(n - 399)) AS r(i)),
twice AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS opens FROM w JOIN twice USING (k)),
u AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
s AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM u GROUP BY doc_id, run),
e AS (SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS kept_from, b FROM s),
k AS (SELECT doc_id, string_agg(substr(h, 2 * kept_from + 1, 2 * (a - kept_from)), '' ORDER BY a) AS kept, max(b) AS last_b, count(*) AS n_spans, sum(b - a) AS n_removed
 FROM e JOIN d USING (doc_id) GROUP BY doc_id),
p AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS ws FROM documents),
pw AS (SELECT doc_id, i, md5(array_to_string(ws[i + 1:i + 51], ' ')) AS k FROM p, unnest(range(len(ws) - 50)) AS r(i)),
pt AS (SELECT k FROM pw GROUP BY k HAVING count(*) > 1),
pc AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeated FROM pw JOIN pt USING (k), range(51) AS t(j) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
 sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last_b, 0) + 1))) AS kept_sha256, coalesce(n_repeated, 0) AS n_repeated
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN pc USING (doc_id)""")
def op2(spark, sf_dir):
    return suffixdedup.digests(table(spark, sf_dir, "documents"), words=51)


@query("op3_lattice_lm")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lattice.score(docs, fold("doc_id", 10) == 0, public_tokenizers.path("piece_bpe_32k.model"))


@query("op4_simhash_near_dedup")
def op4(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", neardup.hexadecimal().alias("fingerprint"), "component_id")


@query("op5_sharding", """
WITH t AS (SELECT [list_reduce([CAST(i AS UBIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END)
 FOR i IN range(256)] AS tab),
b AS (SELECT doc_id, coalesce(source, '') AS source, CAST(coalesce(strlen(text), 0) + 16 AS BIGINT) AS size,
 CAST(xor(list_reduce(list_concat([CAST(4294967295 AS UBIGINT)], [CAST('0x' || x AS UBIGINT) FOR x IN regexp_extract_all(hex(encode(coalesce(text, ''))), '..')]),
  lambda c, y: xor(c >> 8, tab[CAST(xor(c, y) % 256 AS BIGINT) + 1])), CAST(4294967295 AS UBIGINT)) AS BIGINT) AS text_crc32,
 CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM documents, t),
r AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY h, doc_id, text_crc32, size)
  - CAST('0x' || substr(md5('17:source:' || source), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE) / count(*) OVER (PARTITION BY source) AS part FROM b),
p AS (SELECT *, row_number() OVER (ORDER BY part, source, h, doc_id, text_crc32, size) - 1 AS place, count(*) OVER () AS n FROM r)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(place * 40 // n AS INTEGER) AS shard,
 CAST(place - ((place * 40 // n) * n + 39) // 40 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM p""")
def op5(spark, sf_dir):
    rows = sharding.stratified_shards(table(spark, sf_dir, "documents"), 40)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))


@query("op6_decontamination")
def op6(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")


@query("op7_language_id")
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.filter(fold("doc_id", 3) != 1).select("doc_id", "text", "lang"))
    return language.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


@query("op8_exact_topk", """
WITH v AS (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
             AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             CAST(list_sum([q.e[i] * c.e[i] FOR i IN range(1, len(q.e) + 1)]) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""")
def op8(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


@query("op9_chat_format", f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(role) + length(text) + len(regexp_extract_all(role || ' ' || text, '{chat.CONTROL}|{chat.ESCAPE}')) + {sum(map(len, chat.MARKS))} AS shown FROM t),
c AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
 coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss, CAST(sum(shown) AS BIGINT) AS formatted_chars
 FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM c""")
def op9(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    return chat.read_back(chat.format_conversations(turns.unionByName(extra), path), path).drop("n_tokens", "loss_tokens")


@query("op10_best_fit_packing")
def op10(spark, sf_dir):
    pieces = packing.encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
    return packing.pack(pieces.drop("ids")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op11_substring_dedup", """
WITH d AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i + 1:i + 13], ' ')) AS k FROM d, unnest(range(len(w) - 12)) AS r(i)),
earliest AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
hit AS (SELECT doc_id, i FROM win JOIN earliest USING (k) WHERE m < doc_id),
gone AS (SELECT DISTINCT doc_id, i + j + 1 AS place FROM hit, range(13) AS t(j)),
words AS (SELECT doc_id, place, w[place] AS word FROM d, unnest(range(1, len(w) + 1)) AS r(place)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS text FROM words ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""")
def op11(spark, sf_dir):
    return covers.digests(table(spark, sf_dir, "documents"), 13)


@query("op13_spelling_variants", """
WITH RECURSIVE t AS (SELECT [list_reduce([CAST(i AS UBIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END)
 FOR i IN range(256)] AS tab),
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{C0}-\\x{FF}]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
h AS (SELECT run, CAST(xor(list_reduce(list_concat([CAST(4294967295 AS UBIGINT)], [CAST('0x' || x AS UBIGINT) FOR x IN regexp_extract_all(hex(encode(doc_id || ':' || run)), '..')]),
  lambda c, y: xor(c >> 8, tab[CAST(xor(c, y) % 256 AS BIGINT) + 1])), CAST(4294967295 AS UBIGINT)) AS BIGINT) AS h FROM r, t),
w AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM h),
v AS (SELECT word, count(*) AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
d AS (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM v, unnest(range(1, length(word) + 1)) AS u(i)),
p AS (SELECT a.word, b.word AS near FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
 UNION SELECT d.word, v.word FROM d JOIN v ON rest = v.word UNION SELECT v.word, d.word FROM d JOIN v ON rest = v.word),
k AS (SELECT p.word, count(*) AS n_near, min(struct_pack(m := -v.n, near := near)) AS best FROM p JOIN v ON v.word = near GROUP BY p.word),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= 10 * n THEN best.near END AS form, CASE WHEN -best.m >= 10 * n THEN -best.m END AS form_n FROM v LEFT JOIN k USING (word)),
up AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT up.word, f.word, f.form FROM up JOIN f ON f.word = up.next)
SELECT word, form, root, CAST(n AS BIGINT) AS n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM f JOIN up USING (word) WHERE up.next IS NULL""")
def op13(spark, sf_dir):
    return spelling.variants(spelling.vocabulary(table(spark, sf_dir, "documents"), 7, 2, typos=31))


@query("op12_token_alignment")
def op12(spark, sf_dir):
    return crosstoken.alignments(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
