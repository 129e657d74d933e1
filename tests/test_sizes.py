"""Steps whose shuffles or memory grew faster than their input."""

import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from caseloom import bindings, catalog
from caseloom.llm import neardup
from caseloom.operators import aggs, pairs
from caseloom.operators.skew import dealt
from caseloom.plans import graph, threads
from caseloom.sources.contributions import Contributions


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cluster_pairs_are_counted_in_tiles(spark):
    rows = [(s, e, s * 100 + e % 7) for s in range(5) for e in range(23) if (s + e) % 3]
    found = graph.cluster_edges(spark.createDataFrame(rows, "start int, entity_id long, document_id long"), block=3)
    want = {}
    for s in range(5):
        doc = min(d for t, _, d in rows if t == s)
        for pair in combinations(sorted(e for t, e, _ in rows if t == s), 2):
            n, low = want.get(pair, (0, doc))
            want[pair] = (n + 1, min(low, doc))
    assert {(r.a, r.b): (r.clusters, r.evidence_doc) for r in found.collect()} == want
    # members go to their tiles, pairs stay there
    assert "hashpartitioning(a" not in plan_of(found) and "hashpartitioning(i" in plan_of(found)


def test_more_rows_are_dealt_to_more_tasks(spark):
    assert dealt(spark.range(9), 10_000_000, "id", each=1_000_000).rdd.getNumPartitions() == 10
    assert dealt(spark.range(9), 20_000_000, "id", each=1_000_000).rdd.getNumPartitions() == 20
    assert dealt(spark.range(9), 0, "id").rdd.getNumPartitions() == 1


def test_edges_of_documents_are_grouped_once(spark):
    rows = [(1, 2, "co_occurs_with", d, 0.6, False, None, n) for d, n in ((7, "x"), (5, "z"), (6, "a"))]
    seen = spark.createDataFrame(rows + [(1, 3, "emailed", 5, 0.9, False, None, None)],
                                 "source_id long, target_id long, kind string, document_id long, confidence double, inferred boolean, seen_at timestamp, note string")
    merged = aggs.merge_edges(seen, once=4)
    assert plan_of(merged).count("Exchange ") == 1
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, aggs.merge_edges(seen).collect()))


def test_groups_without_hot_ones_are_paired_in_one_pass(spark):
    rows = spark.createDataFrame([(g, t, i) for g in range(3) for t in "ab" for i in range(g + 2)], "g int, t string, i long")
    whole = pairs.shared_pairs(rows, ["g", "t"], "i")
    assert "Join" not in plan_of(whole) and "Union" not in plan_of(whole)
    want = {(g, t, a, b) for g in range(3) for t in "ab" for a, b in combinations(range(g + 2), 2)}
    for found in (whole, pairs.shared_pairs(rows, ["g", "t"], "i", tile=2)):
        assert sorted(map(tuple, found.collect())) == sorted(want)


def test_marks_are_summed_in_one_pass(spark):
    rows = [(e, d, e == 1 or d == 3) for e in range(1, 4) for d in range(1, 9) if (e * d) % 5]
    found = aggs.concealment(spark.createDataFrame(rows, "entity_id long, document_id long, redacted boolean"), 0.5, 1)
    assert "Join" not in plan_of(found)
    marked = {d: sum(m for _, x, m in rows if x == d) for _, d, _ in rows}
    for r in found.collect():
        own = {d for e, d, _ in rows if e == r.entity_id}
        assert (r.total_docs, r.redacted_docs, r.total_redactions) == (len(own), sum(marked[d] > 0 for d in own), sum(marked[d] for d in own))


def test_merged_counts_deal_links_by_survivor_and_document(spark):
    mentions = spark.createDataFrame([(1, 5, "A"), (2, 5, "A"), (2, 6, "R"), (3, 6, "R"), (9, 6, "R")], "entity_id long, document_id long, evidence_type string")
    found = graph.merged_counts(mentions, spark.createDataFrame([(2, 1), (3, 2)], "dropped long, kept long"))
    assert sorted(map(tuple, found.collect())) == [(1, 2, 2), (9, 1, 1)]
    assert "REPARTITION_BY_NUM" in plan_of(found)


def test_lines_of_mentions_are_shuffled_once(spark):
    plan = plan_of(aggs.seen_in_kinds(bindings.supplier_mentions(spark, "/root/testdata/sf0.01")))
    assert "hashpartitioning(l_orderkey" in plan
    assert not re.search(r"hashpartitioning\(entity_id#\w+, (doc_type#\w+, )?document_id", plan)


@pytest.mark.parametrize("key", ["export_graph_counts", "graph_view", "merged_card", "export_cards"])
def test_edges_and_mentions_are_made_once_a_query(spark, monkeypatch, key):
    made, real = [], {n: getattr(bindings, n) for n in ("edges", "mentions")}
    for name, fn in real.items():
        monkeypatch.setattr(bindings, name, lambda *a, name=name, fn=fn: made.append(name) or fn(*a))
    catalog.queries()[key](spark, "/root/testdata/sf0.001")
    assert sorted(made) == ["edges", "mentions"]


def test_postings_are_never_broadcast(spark, monkeypatch):
    plans, real = {}, neardup.cut
    monkeypatch.setattr(neardup, "cut", lambda df, name="step": plans.update({name: plan_of(df)}) or real(df, name))
    prints = real(spark.range(200).select(F.xxhash64(F.col("id") % 150).alias("fp")).distinct())
    neardup.links(prints).count()
    # sized as the fingerprints alone, far below the threshold, and 70 rows each
    assert "SortMergeJoin" in plans["postings"] and "BroadcastHashJoin" not in plans["postings"]


def test_cluster_pairs_are_counted_as_bits(spark):
    rows = [(s, e, 10_000 - s * 10 + e) for s in range(700) for e in range(9) if (s * 7 + e * e) % 5 < 3]
    found = graph.cluster_edges(spark.createDataFrame(rows, "start int, entity_id long, document_id long"), block=2)
    holders = {s: {e for t, e, _ in rows if t == s} for s in range(700)}
    first = {s: min(d for t, _, d in rows if t == s) for s in range(700) if len(holders[s]) >= 3}
    want = {}
    for a, b in combinations(range(9), 2):
        shared = [s for s in first if {a, b} <= holders[s]]
        if shared:
            want[a, b] = (len(shared), min(first[s] for s in shared))
    assert {(r.a, r.b): (r.clusters, r.evidence_doc) for r in found.collect()} == want
    assert max(n for n, _ in want.values()) > 256
    # members' lists went to every tile, and a tile's pairs to a table of counts
    assert "MapInArrow" in plan_of(found) and "HashAggregate" not in plan_of(found).split("MapInArrow")[0]


def test_only_observations_of_documents_are_grouped(spark, tmp_path):
    store = Contributions(spark, str(tmp_path), "detector", "string")
    schema = "source_id long, target_id long, kind string, document_id long, confidence double, inferred boolean, seen_at timestamp, note string"
    said = spark.createDataFrame([(1, 2, "co_occurs_with", d, 0.6, False, None, "x") for d in (5, 6, 7)], schema)
    found = spark.createDataFrame([(3, 4, "temporal_cluster", 9, 0.5, True, None, "2 clusters"), (3, 5, "may_be", None, 0.6, True, None, None)], schema)
    graph.write_detected(store, {graph.DOCUMENTS: said, "temporal": found})
    merged = graph.merge_detected(store)
    documents, detectors = plan_of(merged).split("\n   +- ", 1)
    assert "Aggregate(keys=[source_id" in documents and "Aggregate(keys=[source_id" not in detectors
    columns = ["source_id", "target_id", "kind", "evidence", "confidence", "inferred"]
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, aggs.merge_edges(store.read("edges")).select(columns).collect()))


def test_answers_of_documents_are_dealt_once(spark):
    from caseloom.catalog import consensus as queries
    from caseloom.plans import consensus

    lines = queries.named_lines(spark, "/root/testdata/sf0.001")
    parts = queries.answers_of(lines)
    wanted, dealt_once = consensus.contributions(*parts), consensus.contributions(*parts, rows=4 << 19)
    for name in ("links", "edges", "candidates"):
        assert sorted(map(tuple, wanted[name].collect()), key=str) == sorted(map(tuple, dealt_once[name].collect()), key=str)
    # names meet roles where they were dealt
    plan = plan_of(consensus.contributions(*parts, rows=4 << 19)["links"])
    assert plan.count("REPARTITION_BY_NUM") == 3 and not re.search(r"hashpartitioning\(document_id#\w+, name", plan)


def test_messages_of_a_key_are_met_once(spark, monkeypatch):
    names, real = [], threads.cut
    monkeypatch.setattr(threads, "cut", lambda df, name="step": names.append((name, plan_of(df))) or real(df, name))
    rows = [(i, f"t{i // 4}" if i % 3 else "", f"s{i // 3}" if i % 5 else "", [f"p{i % 7}"], f"b{i % 11}" if i % 2 else "", f"2001-01-{i % 28 + 1:02d}") for i in range(60)]
    mail = spark.createDataFrame(rows, "id long, thread_key string, subject string, people array<string>, body_hash string, day string").withColumn(
        "sent_at", F.to_timestamp("day")).drop("day")
    short = threads.short_keys(mail)
    assert {r.thread_key == "" for r in mail.join(short.filter("thread_key = ''").select("id"), "id").collect()} == {True}
    assert short.select("thread_key").distinct().count() == mail.select("thread_key").distinct().count()
    assert {len(r[0]) for r in short.select("thread_key").union(short.select("body_hash")).collect()} == {0, 22}
    threads.thread_links(mail, 2).count()
    # runs and the lowest messages of a subject and key are made once; only keys with an open message are ordered
    assert [n for n, _ in names].count("runs") == 1 and [n for n, _ in names].count("subject-keys") == 2
    assert [n for n, _ in names].count("open-keys") == 2
