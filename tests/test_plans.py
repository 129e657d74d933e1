"""Jobs on hand-made rows: threads, graph, consensus, exports, upserts, streams."""

import itertools
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from caseloom.plans import consensus, evidence, graph, mentions, threads
from caseloom.sources import exports, landed, tables
from caseloom.streaming import jobs
from caseloom.operators import windows


def roots(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_and_stars(spark):
    random.seed(5)
    ids = list(range(200))
    chain = ids[:90]
    random.shuffle(chain)
    links = list(zip(chain, chain[1:])) + [(100, i) for i in range(101, 130)] + [(150, 151)]
    got = graph.components(spark.createDataFrame([(i,) for i in ids], "id int"), spark.createDataFrame(links, "a int, b int"))
    assert {r["id"]: r["root"] for r in got.collect()} == roots(links, ids)


def brute_threads(rows, days):
    links = []
    for x, y in itertools.combinations(rows, 2):
        near = x["sent_at"] and y["sent_at"] and abs(x["sent_at"] - y["sent_at"]) <= timedelta(days=days)
        person, body = bool(set(x["people"]) & set(y["people"])), x["body_hash"] != "" and x["body_hash"] == y["body_hash"]
        if x["subject"] and y["subject"]:
            related = x["subject"] in y["subject"] or y["subject"] in x["subject"]
            hit = related and (person or body or near)
        else:
            hit = sum(map(bool, (person, body, near))) >= 2
        if hit or x["thread_key"] == y["thread_key"]:
            links.append((x["id"], y["id"]))
    return roots(links, [r["id"] for r in rows])


@pytest.mark.parametrize("seed", [1, 2])
def test_threads_equal_all_pairs_in_any_order(spark, seed):
    random.seed(seed)
    rows = []
    for i in range(70):
        when = datetime(2001, 1, 1) + timedelta(days=random.randrange(2000)) if random.random() < 0.9 else None
        rows.append({"id": i, "thread_key": f"k{i}" if random.random() < 0.9 else "kx",
                     "subject": random.choice(["", "plan", "the plan", "other news", "news", f"solo {i}"]),
                     "people": random.sample(["a", "b", "c", "d", "e", "f", "g"], random.randint(1, 2)),
                     "body_hash": random.choice(["", "", "h1", "h2", f"b{i}", f"b{i}"]), "sent_at": when})
    schema = "id long, thread_key string, subject string, people array<string>, body_hash string, sent_at timestamp"
    shuffled = random.sample(rows, len(rows))
    got = threads.stitch(spark.createDataFrame([tuple(r[c] for c in ("id", "thread_key", "subject", "people", "body_hash", "sent_at"))
                                                for r in shuffled], schema), days=20)
    assert {r["id"]: r["root"] for r in got.collect()} == brute_threads(rows, 20)


def test_khop_and_transitive(spark):
    edges = spark.createDataFrame([(1, 2, 2.0), (2, 3, 1.0), (3, 4, 1.0), (4, 5, 1.0)], "source_id int, target_id int, weight double")
    got = graph.khop(edges, spark.createDataFrame([(1,)], "entity_id int"), 2)
    assert {r["entity_id"]: r["distance"] for r in got.collect()} == {1: 0, 2: 1, 3: 2}
    links = graph.transitive_links(edges).collect()
    assert {(r["source_id"], r["target_id"], r["degrees"], r["confidence"]) for r in links} == {
        (1, 3, 2, 0.5), (1, 4, 3, 0.33), (2, 4, 2, 0.5), (2, 5, 3, 0.33)}


def test_merge_follows_chains(spark):
    rows = spark.createDataFrame([(1, 10), (2, 10), (3, 11), (9, 11)], "entity_id int, document_id int")
    mapping = spark.createDataFrame([(3, 2), (2, 1)], "dropped int, kept int")
    got = sorted(tuple(r) for r in graph.merge_mentions(rows, mapping).select("entity_id", "document_id").collect())
    assert got == [(1, 10), (1, 10), (1, 11), (9, 11)]


def judged(spark, rows):
    return spark.createDataFrame(rows, "document_id long, annotator long, item string, score int")


def test_consensus_rules(spark):
    rows = [(1, a, "x", s) for a, s in ((0, 10), (1, 45), (2, 11))] + [(1, 0, "y", 50), (1, 1, "y", 51), (1, 2, "z", 7), (2, 0, "x", 5)]
    items = {(r["document_id"], r["item"]): r["tag"] for r in consensus.consensus_items(judged(spark, rows)).collect()}
    assert items == {(1, "x"): "CONFIRMED", (1, "y"): "LIKELY", (1, "z"): "UNIQUE_INSIGHT", (2, "x"): "CONFIRMED"}
    scores = {(r["document_id"], r["item"]): (r["score"], r["spread"], r["tag"]) for r in consensus.consensus_scores(judged(spark, rows)).collect()}
    assert scores[1, "x"] == (22, 35, "NEEDS_REVIEW") and scores[1, "y"] == (50, 1, "LIKELY") and scores[1, "z"][2] == "UNIQUE_INSIGHT"
    levels = {r["document_id"]: (r["agreement"], r["needs_review"]) for r in consensus.agreement_levels(judged(spark, rows)).collect()}
    assert levels == {1: ("majority", False), 2: ("single_source", True)}


ANSWER = '''=== SUMMARY ===
First
=== EVIDENCE SCORES ===
- Jane Doe | 92 | facilitator | Multiple records
=== REDACTION ===
REDACTION #2 context: "by the"
1. Ann (70%) - near
=== SUMMARY ===
Second
=== CROSS REFERENCES ===
- doc 5
=== CAREER ROLES ===
Ann | cook | Inn'''


def test_answer_sections(spark):
    df = spark.createDataFrame([(1, ANSWER)], "id int, t string")
    got = {(r["section"], tuple(r["fields"])) for r in consensus.section_records(df, "id", "t").collect()}
    assert got == {("summary", ("Second",)), ("evidence_scores", ("Jane Doe", "92", "facilitator", "Multiple records")),
                   ("redaction_inferences", ("2", "by the", "1", "Ann", "70", "near")), ("cross_references", ("doc 5",)),
                   ("career_roles", ("Ann", "cook", "Inn"))}


def test_score_evidence(spark):
    rows = [(1, 1, 1, "email", "[REDACTED] Jane Doe said", "jane doe", True, None), (1, 2, 1, "odd", None, "jane doe", False, 99)]
    df = spark.createDataFrame(rows, "entity_id int, document_id int, page int, evidence_type string, context string, name string, "
                                     "removed boolean, user_score int")
    got = {r["document_id"]: (r["base"], r["modifier"], r["score"]) for r in evidence.score_evidence(df, ["said"]).collect()}
    assert got == {1: (20, 45, 65), 2: (5, 0, 99)}


def test_unlabelled_message_is_an_email(spark):
    msg = "Forwarded message\nOn Monday, Bob wrote:\nann@x.org to bob@y.org\nSubject - Re: plan"
    row = mentions.classify(spark.createDataFrame([(1, msg), (2, "nothing here at all")], "doc_id int, text string")).orderBy("doc_id").collect()
    assert [r["doc_type"] for r in row] == ["email", "unknown"]


def test_masking_is_longest_first(spark):
    texts = spark.createDataFrame([(1, "Ann Lee met Ann and x@y.org [a"), (2, "none")], "id int, t string")
    names = spark.createDataFrame([("Ann",), ("Ann Lee",)], "name string")
    got = mentions.mask_protected(texts, "id", "t", names, [r"\S+@\S+", "[a"]).orderBy("id").collect()
    assert [r["t"] for r in got] == ["[PROTECTED] met [PROTECTED] and [REDACTED] [REDACTED]", "none"]


def test_no_export_holds_protected_rows(spark):
    ents = spark.createDataFrame([(1, "a", "person", 90.0, True, 1), (2, "b", "person", 80.0, False, 1), (3, "c", "person", 70.0, False, 1)],
                                 "entity_id int, name string, entity_type string, score double, is_protected boolean, document_count int")
    edges = spark.createDataFrame([(1, 2, "k", 1, 1.0, False), (2, 3, "k", 1, 1.0, True)],
                                  "source_id int, target_id int, kind string, evidence int, weight double, inferred boolean")
    seen = spark.createDataFrame([(e, 7, 1, 50, datetime(2001, 1, e), "t") for e in (1, 2, 3)],
                                 "entity_id int, document_id int, page int, evidence_score int, event_ts timestamp, text string")
    nodes, links = exports.graph(ents, edges)
    assert {r["entity_id"] for r in nodes.collect()} == {2, 3}
    assert [(r["source_id"], r["target_id"]) for r in links.collect()] == [(2, 3)]
    assert exports.graph(ents, edges, inferred=False)[1].count() == 0
    cards = {r["entity_id"]: r for r in exports.cards(ents, seen, edges).collect()}
    assert set(cards) == {2, 3} and [c["other_id"] for c in cards[2]["connections"]] == [3]
    assert {r["entity_id"] for r in exports.timeline(seen, ents).collect()} == {2, 3}
    assert [r["entity_id"] for r in exports.entity_report(ents, 75).collect()] == [2]


def test_report_is_written_by_category(spark, tmp_path):
    rows = spark.createDataFrame([(1, "confirmed", "t1", "fraud"), (2, "likely", "t2", "fraud"), (3, "other", "t3", "x")],
                                 "finding_id long, confidence string, title string, category string")
    lines = exports.category_report(rows, ["confirmed", "likely"], block=1)
    assert [(r["line_no"], r["line"]) for r in lines.orderBy("line_no").collect()] == [
        (0, "## FRAUD"), (1, "- [confirmed] t1"), (2, "- [likely] t2")]
    exports.write_report(lines, str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).count() == 3


def test_upserts_are_idempotent(spark):
    old = spark.createDataFrame([(1, "a", None, ["x"]), (2, "b", "r", ["y"])], "id int, name string, role string, aliases array<string>")
    new = spark.createDataFrame([(7, "a", "q", ["z"]), (8, "a", "w", ["x"]), (9, "c", None, [])], "id int, name string, role string, aliases array<string>")
    once = tables.upsert_first_wins(old, new, ["name"], ["role"], "id", "aliases")
    got = {r["name"]: (r["id"], r["role"], r["aliases"]) for r in once.collect()}
    assert got == {"a": (1, "q", ["x", "z"]), "b": (2, "r", ["y"]), "c": (9, None, [])}
    twice = tables.upsert_first_wins(once, new, ["name"], ["role"], "id", "aliases")
    assert {r["name"]: (r["id"], r["role"], r["aliases"]) for r in twice.collect()} == got


def test_landed_files(spark, tmp_path):
    for name, content in (("a.txt", b"one"), ("b.txt", b"one"), ("c.txt", b"two")):
        (tmp_path / name).write_bytes(content)
    found = tables.manifest(tables.read_files(spark, str(tmp_path), "*.txt"))
    fresh = tables.register_unseen(found, found.filter(F.col("path").endswith("c.txt")))
    assert [r["path"].rsplit("/", 1)[1] for r in fresh.collect()] == ["a.txt"]
    page = spark.createDataFrame([(1, "https://h.org/p", '<a href="/media/x.pdf?d=1"><b>Get</b> it</a><a href="https://o.org/b.zip">Z</a><a href="/q">no</a>')],
                                 "id int, url string, html string")
    got = [(r["link"], r["filename"], r["file_type"], r["link_text"]) for r in landed.html_links(page, "id").orderBy("pos").collect()]
    assert got == [("https://h.org/media/x.pdf?d=1", "x.pdf", "pdf", "Get it"), ("https://o.org/b.zip", "b.zip", "other", "Z")]


def test_streams_over_several_batches_equal_batch(spark, tmp_path):
    random.seed(6)
    rows = [(t, i, datetime(2001, 1, 1) + timedelta(days=random.randrange(90))) for t in range(4) for i in range(t * 100, t * 100 + 12)]
    random.shuffle(rows)
    src = str(tmp_path / "in")
    df = spark.createDataFrame(rows, "thread_id long, message_id long, sent_at timestamp")
    df.repartition(3).write.parquet(src)
    got = jobs.stream_threads(jobs.read_stream(spark, src, 1), str(tmp_path / "out"), 7)
    cols = ["thread_id", "after_id", "before_id", "gap_days", "severity"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, windows.gaps(df, 7).select(cols).collect()))
    daily = jobs.stream_activity(jobs.read_stream(spark, src), "thread_id", "sent_at", str(tmp_path / "act"))
    want = df.groupBy("thread_id", F.date_format("sent_at", "yyyy-MM").alias("month")).count().collect()
    assert sorted(map(tuple, jobs.months_of(daily, "thread_id").collect())) == sorted(map(tuple, want))
    known = spark.createDataFrame([(i, f"http://x/{i}") for i in range(6)] + [(9, "http://x/1")], "page_id long, url string")
    known.repartition(3).write.parquet(str(tmp_path / "known"))
    now = spark.createDataFrame([("http://x/0/",)], "url string")
    gone = jobs.stream_removed(jobs.read_stream(spark, str(tmp_path / "known"), 1), now, str(tmp_path / "gone"))
    assert sorted(r["url"] for r in gone.collect()) == [f"http://x/{i}" for i in range(1, 6)]
