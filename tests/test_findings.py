"""Cases that a review found: values that repeat, bounds, letters, repeated pages."""

import os

import duckdb
from pyspark.sql import functions as F

from caseloom import bindings as b
from caseloom import catalog
from caseloom.functions.text import upper
from caseloom.llm import neardup
from caseloom.llm.suffixdedup import _merged
from caseloom.operators import windows
from caseloom.streaming import jobs
from tests.oracle import TABLES, compare, duck

SF = "/root/testdata/sf0.001"
# counts of which one lies exactly two deviations above the mean
TIES = [[7, 5, 20, 7, 5, 4], [2, 6, 3, 5, 3, 6, 1, 2, 1, 3, 3, 2, 4, 5, 2, 3, 5, 1, 3, 3, 3, 1, 5, 1, 3, 1, 2, 2, 3, 4, 2, 5, 4]]


def test_customers_of_one_tail_stay_apart(spark, tmp_path):
    tables = {
        "customer": "SELECT * FROM (VALUES (1, 9500.0::DOUBLE), (90001, 100.0)) t(c_custkey, c_acctbal)",
        "supplier": "SELECT 1 AS s_suppkey, 10.0::DOUBLE AS s_acctbal",
        "lineitem": "SELECT * FROM (VALUES (5, 1), (6, 1)) t(l_orderkey, l_suppkey)",
        "orders": "SELECT k AS o_orderkey, c AS o_custkey, 'O' AS o_orderstatus, TIMESTAMP '1997-01-01' AS o_orderdate, '5-LOW' AS o_orderpriority "
                  "FROM (VALUES (5, 1), (6, 90001)) t(k, c)"}
    for name, sql in tables.items():
        duckdb.sql(sql).write_parquet(f"{tmp_path}/{name}.parquet")
    rows = {r.event_id: r for r in catalog.queries()["pattern_score"](spark, str(tmp_path)).collect()}
    assert rows[5].tail == rows[6].tail
    assert (rows[5].registry_score, rows[6].registry_score) == (1.0, 0.0)


def test_counts_at_the_bound_are_spikes(spark):
    counts = [(key, str(i), n) for key, ns in enumerate(TIES) for i, n in enumerate(ns)]
    rows = windows.count_spikes(spark.createDataFrame(counts, "k int, p string, n long"), ["k"], "p", 2.0, 3).collect()
    assert {r.k for r in rows} == set(range(len(TIES)))


def test_rounding_goes_by_the_double(spark):
    assert spark.range(1).select(F.lit(40.175).alias("x")).select(b.rounded("x", 2)).first()[0] == 40.17


def test_upper_keeps_the_number_of_letters(spark):
    texts = ["enlich sch\u00df.", "\ufb01n \u00e4b", "plain"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(upper(F.col("t"))).collect()]
    assert got == ["ENLICH SCH\u1e9e.", "\ufb01N \u00c4B", "PLAIN"]


def test_removed_pages_of_one_address_stay_apart(spark, tmp_path):
    rows = [(1, "http://x/1"), (9, "http://x/1"), (2, "http://x/2"), (3, None)]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(str(tmp_path / "known"))
    now = spark.createDataFrame([("http://x/2/",)], "url string")
    stream = jobs.read_stream(spark, str(tmp_path / "known"), 1)
    gone = jobs.stream_removed(stream, now, str(tmp_path / "gone"), once=("page_id", "url"))
    assert sorted(map(tuple, gone.collect())) == [(1, "http://x/1"), (9, "http://x/1")]


def test_every_watched_name_is_a_candidate(spark):
    for key in ("substring_theta", "stream_candidates"):
        assert catalog.queries()[key](spark, SF).filter("entity_id % 9 = 4").count() > 0


def test_fingerprints_link_what_shingle_sets_do_not(spark):
    head = "same " * 200
    rows = [(i, head + " ".join(f"t{i}w{k}" for k in range(20))) for i in (1, 2)] + [(3, "another text of no kin at all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in neardup.keep_one(docs).collect()) == [1, 2, 3]
    assert sorted(r.doc_id for r in neardup.keep_one(docs, distance=4).collect()) == [1, 3]


def test_runs_of_neighbouring_parts_are_one(spark):
    runs = spark.createDataFrame([([(7, 5), (3, 1), (10, 8)],)], "runs array<struct<first:int,last:int>>")
    assert [tuple(r) for r in runs.select(_merged(F.col("runs")).alias("m")).first().m] == [(10, 5), (3, 1)]


def test_searched_patterns_match_the_same(spark):
    """Faster patterns find what the written ones do, and letters are shared out beside documents of many files."""
    import re

    from caseloom.catalog.text import corpus
    from caseloom.functions.text import find_all
    from caseloom.plans import mentions

    kinds = {kind: pattern for kind, pattern, *_ in mentions.RULES}
    texts = ["a@b.com_x@c.org,é_y@d.net", "@a@b.co a@b.c1@d.ee.ff@g.hh", "x" * 300 + "@y.com" + "z" * 300, "12 Oak Street. 00\n\nPlease send Pl a b Ct",
             "1 Old Mill Pond Hill Road, Suite 5; 77 st Street 123456 Main  St", "5 a Road 12 Ab Cd Ef Gh Ij Way 3 Main\nDr. 9 Streetstreet Streetst"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    for kind, faster in mentions.SEARCHED.items():
        found = rows.select("id", "text", find_all(F.col("text"), faster).alias("a"), F.split("text", faster, -1).alias("p")).collect()
        for row in found:
            assert row.a == [m.group() for m in re.finditer(kinds[kind], row.text, re.ASCII)], (kind, row.text)
            assert row.p == [p for p in re.split(kinds[kind], row.text, flags=re.ASCII)], (kind, row.text)
    cores = spark.sparkContext.defaultParallelism
    assert corpus(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > cores


def test_roles_meet_names_by_forms_made_before(spark):
    from caseloom.catalog.consensus import named_items
    from caseloom.plans import consensus

    items, links = named_items(spark, SF)
    none = spark.createDataFrame([], "document_id long, place int, name string, role string")
    scores = spark.createDataFrame([], "document_id long, name string, score int, reason string")
    inferred = spark.createDataFrame([], "document_id long, index int, rank int, candidate long, confidence int")
    gaps = spark.createDataFrame([], "document_id long, page int, gap_id long, status string")
    made = consensus.contributions(items, none, scores, links.withColumn("confidence", F.lit(0.8)), inferred, gaps)["links"]
    plan = made._jdf.queryExecution().optimizedPlan().toString().splitlines()
    tests = [line for line in plan if "contains(" in line.lower()]
    assert tests and not any("regexp_replace" in line for line in tests)


def test_answers_are_cut_up_once(spark):
    from caseloom.plans import consensus

    text = "=== evidence scores ===\n- A B | 7\n=== CROSS_REFERENCE ===\nDoc 1\n===LOCATION===\nX | y\n=== Redaction ===\nfree\nREDACTION 3\n\n1. Eve (5%) - no"
    made = consensus.section_records(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text")
    assert sorted((r.section, r.pos, r.fields) for r in made.collect()) == [
        ("cross_references", 0, ["Doc 1"]), ("evidence_scores", 0, ["A B", "7", "", ""]), ("locations", 0, ["X", "y"]),
        ("redaction_inferences", 2, ["3", "", "1", "Eve", "5", "no"])]
    assert "Union" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_addresses_that_look_like_debris_are_entities(spark, tmp_path):
    for name in TABLES:
        if name != "documents":
            os.symlink(f"{SF}/{name}.parquet", tmp_path / f"{name}.parquet")
    texts = ["near 174 eren hean thansh thst. today", "at 85514\nThe than thhast row", "12 Oak Street", None]
    duckdb.sql("SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, {'NULL' if t is None else repr(t).replace(chr(92) + 'n', chr(10))})" for i, t in enumerate(texts))
               + ") t(doc_id, text)").write_parquet(f"{tmp_path}/documents.parquet")
    found = catalog.queries()["extract_entities"](spark, str(tmp_path))
    assert compare(found, duck(str(tmp_path)), catalog.oracle_sql()["extract_entities"]) == []
    assert {"174 EREN HEAN THANSH THST.", "85514 THE THAN THHAST"} <= {r.canonical for r in found.collect()}
