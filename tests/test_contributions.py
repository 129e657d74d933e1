"""Contributions that their owners replace: the store, detectors that run again, documents analysed again."""

import pytest
from pyspark.sql import functions as F

from caseloom.operators import aggs
from caseloom.plans import consensus, graph
from caseloom.sources.contributions import Contributions


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_store_replaces_by_owner(spark, tmp_path):
    store = Contributions(spark, str(tmp_path), "doc")
    table = lambda *r: spark.createDataFrame(list(r), "doc long, x string")
    owners = lambda *d: spark.createDataFrame([(i,) for i in d], "doc long")
    assert store.replace(owners(1, 2, 3), {"a": table((1, "p"), (1, "q"), (2, "r")), "b": table((2, "s"), (3, "t"))}) == 1
    assert store.replace(owners(2, 4), {"a": table((4, "u")), "b": table((2, "v"))}) == 2
    assert rows(store.read("a"), "doc", "x") == [(1, "p"), (1, "q"), (4, "u")]
    assert rows(store.read("b"), "doc", "x") == [(2, "v"), (3, "t")]
    table((1, "lost")).write.parquet(f"{tmp_path}/a/batch=3")  # a batch that broke off before its owners were written
    assert rows(store.read("a"), "doc", "x") == [(1, "p"), (1, "q"), (4, "u")]
    assert store.compact(["a", "b"]) == 3
    assert rows(store.read("a"), "doc", "x") == [(1, "p"), (1, "q"), (4, "u")] and rows(store.read("b"), "doc", "x") == [(2, "v"), (3, "t")]
    assert store.replace(owners(1), {"a": table(), "b": table((1, "w"))}) == 4
    assert rows(store.read("a"), "doc", "x") == [(4, "u")] and rows(store.read("b"), "doc", "x") == [(1, "w"), (2, "v"), (3, "t")]


def test_detectors_replace_only_their_own(spark, tmp_path):
    store = Contributions(spark, str(tmp_path), "detector", "string")
    clusters = spark.createDataFrame([(1, 2, 3, 70), (1, 3, 1, 71)], "a long, b long, clusters long, evidence_doc long")
    links = spark.createDataFrame([(4, 5, 2, 0.5)], "source_id long, target_id long, degrees int, confidence double")
    maybe = spark.createDataFrame([(90, 1, 0.6)], "context_id long, entity_id long, score double")
    edges = graph.detected_edges(clusters, links, maybe)
    graph.write_detected(store, edges)
    merged = lambda: rows(aggs.merge_edges(store.read("edges")), "source_id", "target_id", "kind", "evidence", "confidence", "inferred")
    first = merged()
    assert first == sorted([(1, 2, "temporal_cluster", 1, 0.5, True), (1, 3, "temporal_cluster", 1, 0.5, True),
                            (4, 5, "transitively_linked", 0, 0.5, True), (90, 1, "may_be", 0, 0.6, True)], key=str)
    graph.write_detected(store, edges)
    assert merged() == first
    graph.write_detected(store, {"temporal": edges["temporal"].filter("target_id = 2")})
    assert merged() == [r for r in first if r[:2] != (1, 3)]


def test_clusters_leave_out_protected(spark):
    members = spark.createDataFrame([("2001-01-01", e, 10 + e) for e in range(1, 5)], "start string, entity_id long, document_id long")
    shut = spark.createDataFrame([(4,)], "entity_id long")
    assert rows(graph.cluster_edges(members, 3, shut), "a", "b", "clusters", "evidence_doc") == [(1, 2, 1, 11), (1, 3, 1, 11), (2, 3, 1, 11)]
    two = spark.createDataFrame([(4,), (3,)], "entity_id long")
    assert graph.cluster_edges(members, 3, two).count() == 0


@pytest.fixture
def analysed(spark):
    def frame(schema, *r):
        return spark.createDataFrame(list(r), f"document_id long, {schema}")

    return [
        frame("name string, raw_type string", (1, "Dr. Ann Lee", "person"), (1, "Acme", "company"), (1, " ", "person"), (2, "ann  lee", "person"), (3, "Acme", "org")),
        frame("place int, name string, role string", (1, 2, "Ann Lee", "cook"), (1, 1, "Lee", "skipped: too short"), (1, 3, "Ann Lee Smith", "late"), (2, 1, "Ann Lee", "pilot")),
        frame("name string, score int, reason string", (1, "Ann Lee", 40, "a"), (1, "ann lee", 55, "b"), (2, "Nobody", 99, "c")),
        frame("source string, target string, kind string, confidence double", (1, "Ann Lee", "ACME", "works for", 0.7), (1, "Ann Lee", "Acme", "works for", 0.9),
              (1, "Ann Lee", "Dr. Ann Lee", "self", 1.0), (2, "Ann Lee", "Acme", "works for", 0.5)),
        frame("index int, rank int, candidate string, confidence int", (1, 2, 1, "x", 80), (1, 2, 2, "y", 20), (1, 3, 1, "none", 5), (1, 0, 1, "none", 5)),
        frame("page int, gap_id long, status string", (1, 4, 30, "unresolved"), (1, 1, 31, "confirmed"), (2, 1, 32, "unresolved")),
    ]


def test_consensus_adds_rows_by_document(analysed):
    got = consensus.contributions(*analysed)
    assert rows(got["links"], "document_id", "canonical", "entity_type", "role", "score", "reason") == sorted([
        (1, "ACME", "organization", None, None, None), (1, "ANN LEE", "person", "cook", 55, "b"), (2, "ANN LEE", "person", "pilot", None, None),
        (3, "ACME", "organization", None, None, None)], key=str)
    assert rows(got["edges"], "document_id", "source", "target", "kind", "confidence") == [(1, "ANN LEE", "ACME", "works for", 0.9)]
    assert rows(got["candidates"], "document_id", "gap_id", "rank", "candidate", "status") == [(1, 30, 1, "x", "inferred"), (1, 30, 2, "y", "inferred")]


def test_documents_are_applied_once(spark, tmp_path, analysed):
    store = Contributions(spark, str(tmp_path), "document_id")
    documents = analysed[0].select("document_id").distinct()
    for _ in range(2):  # the second time changes nothing
        consensus.apply_documents(store, documents, consensus.contributions(*analysed))
        assert rows(consensus.applied_entities(store.read("links")), "canonical", "document_count", "first_doc", "role", "score", "evidence_count") == [
            ("ACME", 2, 1, None, 0, 0), ("ANN LEE", 2, 1, "cook", 55, 1)]
        assert rows(consensus.applied_edges(store.read("edges")), "source", "target", "evidence", "weight", "confidence") == [("ANN LEE", "ACME", 1, 1.0, 0.9)]
    one = [t.filter("document_id = 1") for t in analysed]
    one[0] = one[0].filter("name = 'Acme'")
    consensus.apply_documents(store, spark.createDataFrame([(1,)], "document_id long"), consensus.contributions(*one))
    assert rows(consensus.applied_entities(store.read("links")), "canonical", "document_count", "first_doc", "role", "score") == [
        ("ACME", 2, 1, None, 0), ("ANN LEE", 1, 2, "pilot", 0)]
    assert store.read("edges").count() == 0 and store.read("candidates").agg(F.count(F.lit(1))).first()[0] == 2
