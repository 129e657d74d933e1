"""Formulas and skew-safe operators against brute force on small rows."""

import itertools
import math
import random
import statistics

from pyspark.sql import functions as F

from caseloom.operators import aggs, blocking, diff, pairs, scoring, sets, skew, windows


def test_pairs_with_many_tiles_equal_all_pairs(spark):
    random.seed(1)
    rows = [(g, i) for g in range(3) for i in random.sample(range(60), 10 + 20 * g)] * 2
    df = spark.createDataFrame(rows, "g int, i int")
    want = {}
    for g in range(3):
        for a, b in itertools.combinations(sorted({i for h, i in rows if h == g}), 2):
            want[a, b] = want.get((a, b), 0) + 1
    for tile in (4, 2048):
        got = {(r["a"], r["b"]): r["groups"] for r in pairs.pair_counts(df, "g", "i", 1, tile).collect()}
        assert got == want
    got = {(r["a"], r["b"]) for r in pairs.pair_counts(df, "g", "i", 2, 4).collect()}
    assert got == {k for k, n in want.items() if n >= 2}


def test_bucketed_helpers_equal_plain_windows(spark):
    random.seed(2)
    rows = [(random.choice("hhha"), t // 7, t, random.random() < 0.3) for t in range(120)]
    df = spark.createDataFrame(rows, "k string, b int, t int, m boolean")
    for key in "ha":
        mine = [r for r in rows if r[0] == key]
        rank = skew.bucketed_rank(df, ["k"], "b", [F.asc("t")]).filter(F.col("k") == key).orderBy("t").collect()
        assert [r["rn"] for r in rank] == list(range(1, len(mine) + 1))
        near = skew.bucketed_neighbours(df, ["k"], "b", ["t"], [], prev="p", following="n").filter(F.col("k") == key).orderBy("t").collect()
        assert [r["p"] and r["p"]["t"] for r in near] == [None] + [r[2] for r in mine[:-1]]
        assert [r["n"] and r["n"]["t"] for r in near] == [r[2] for r in mine[1:]] + [None]
        for strict in (False, True):
            last = skew.bucketed_last(df, ["k"], "b", ["t"], F.when(F.col("m"), F.col("t")), "s", strict).filter(F.col("k") == key).orderBy("t").collect()
            want, seen = [], None
            for r in mine:
                if not strict and r[3]:
                    seen = r[2]
                want.append(seen)
                if r[3]:
                    seen = r[2]
            assert [r["s"] for r in last] == want
        total = skew.bucketed_before(df, ["k"], "b", [F.asc("t")], F.col("t"), "x").filter(F.col("k") == key).orderBy("t").collect()
        assert [r["x"] for r in total] == [sum(q[2] for q in mine[:i]) for i in range(len(mine))]
    page = skew.page_of(df, "b", [F.asc("t")], 3, 10).orderBy("position").collect()
    assert [r["t"] for r in page] == list(range(20, 30)) and page[0]["total_pages"] == 12
    beyond = skew.page_of(df, "b", [F.asc("t")], 99, 50).orderBy("position").collect()
    assert [r["t"] for r in beyond] == list(range(100, 120))


def test_salted_join_equals_join(spark):
    left = spark.createDataFrame([(k, v) for k in range(4) for v in range(3)], "k int, v int")
    right = spark.createDataFrame([(0, w) for w in range(50)] + [(1, 1), (9, 9)], "k int, w int")
    got = sorted(tuple(r) for r in skew.salted_join(left, right, "k", "w", most=7).select("k", "v", "w").collect())
    assert got == sorted(tuple(r) for r in left.join(right, "k").select("k", "v", "w").collect())


def brute_score(scores, weight):
    scores = sorted((s for s in scores if s > 0), reverse=True)
    if not scores:
        return 0.0
    w = [math.exp(-0.15 * i) for i in range(len(scores))]
    mean = sum(s * x for s, x in zip(scores, w)) / sum(w)
    return round(min(100.0, mean + min(20, math.log2(len(scores) + 1) * 5) + min(15, weight * 0.5)), 2)


def test_decayed_score(spark):
    random.seed(3)
    scores = {e: [random.choice([0, 10, 10, 40, 77]) for _ in range(n)] for e, n in ((1, 1), (2, 9), (3, 200), (4, 2))}
    scores[5] = [0, 0]
    rows = [(e, d, s) for e, ss in scores.items() for d, s in enumerate(ss)]
    evidence = spark.createDataFrame(rows, "entity_id long, document_id long, evidence_score int")
    edges = spark.createDataFrame([(1, 2, 4.0), (2, 3, 50.0)], "source_id long, target_id long, weight double")
    got = {r["entity_id"]: r["score"] for r in scoring.entity_scores(evidence, edges).collect()}
    assert got == {1: brute_score(scores[1], 4), 2: brute_score(scores[2], 54), 3: brute_score(scores[3], 50),
                   4: brute_score(scores[4], 0), 5: 0.0}
    locked = spark.createDataFrame([(4, 88)], "entity_id long, user_score int")
    assert {r["entity_id"]: r["score"] for r in scoring.entity_scores(evidence, edges, locked).collect()}[4] == 88.0


def test_edge_weight(spark):
    df = spark.createDataFrame([("flew_with", 1), ("emailed", 4), ("other", 0)], "k string, n int")
    assert [r[0] for r in df.select(scoring.edge_weight(F.col("k"), F.col("n"))).collect()] == [3.0, 4.5, 1.0]


def test_gaps(spark):
    rows = [(1, 1, "2001-01-01"), (1, 2, "2001-01-08"), (1, 3, "2001-01-16"), (1, 4, "2001-03-16"), (2, 5, "2001-01-01")]
    df = spark.createDataFrame(rows, "thread_id long, message_id long, d string").withColumn("sent_at", F.to_timestamp("d"))
    got = [(r["after_id"], r["before_id"], r["gap_days"], r["severity"]) for r in windows.gaps(df).orderBy("after_id").collect()]
    assert got == [(2, 3, 8, "medium"), (3, 4, 59, "high")]


def test_spikes_need_a_spread(spark):
    flat = [("a", f"2001-{m:02d}-01") for m in range(1, 7) for _ in range(5)]
    peak = [("b", f"2001-{m:02d}-01") for m in range(1, 9) for _ in range(40 if m == 8 else 2)]
    df = spark.createDataFrame(flat + peak, "k string, d string").withColumn("at", F.to_timestamp("d"))
    got = windows.spikes(df, ["k"], "at", 2.0, 3).collect()
    counts = [2] * 7 + [40]
    assert [(r["k"], r["month"], r["n"]) for r in got] == [("b", "2001-08", 40)]
    assert abs(got[0]["z"] - (40 - statistics.mean(counts)) / statistics.stdev(counts)) < 1e-9


def test_time_clusters(spark):
    rows = [(e, d, f"2001-01-{day:02d}") for e, d, day in [(1, 10, 1), (2, 11, 3), (3, 12, 4), (4, 13, 9), (1, 14, 5)]]
    df = spark.createDataFrame(rows, "entity_id long, document_id long, d string").withColumn("event_ts", F.to_timestamp("d"))
    got = windows.time_clusters(windows.cluster_members(df)).collect()
    found = {str(r["date_start"]): (str(r["date_end"]), r["entity_count"], r["document_count"]) for r in got}
    assert found == {"2001-01-01": ("2001-01-04", 3, 3), "2001-01-03": ("2001-01-05", 3, 3)}


def brute_candidates(contexts, entities):
    out = {}
    for cid, text in contexts:
        low = text.lower()
        for eid, name, canonical in entities:
            words = set(name.lower().split())
            if name.lower() in low:
                out[cid, eid] = 0.6
            elif canonical.lower() in low:
                out[cid, eid] = 0.5
            elif words and len(words & set(low.split())) / len(words) >= 0.5:
                out[cid, eid] = 0.3
    return out


def test_containing_equals_brute_force(spark):
    random.seed(4)
    bits = ["al", "an", "ann", "bo", "xann", "le", "lee", "of the", "an le", "a b", "b"]
    texts = [(i, " ".join(random.choice(bits) for _ in range(random.randint(1, 12)))) for i in range(60)]
    needles = [(j, n) for j, n in enumerate(["ann lee", "n le", "an", "lee of the", "b", "a b an", "zz top", "e of t", "the"])]
    got = {(r["i"], r["j"]) for r in blocking.containing(
        spark.createDataFrame(texts, "i int, t string"), "i", "t", spark.createDataFrame(needles, "j int, n string"), "j", "n").collect()}
    assert got == {(i, j) for i, t in texts for j, n in needles if n in t}
    people = [(1, "Dr. Ann Lee", "ANN LEE"), (2, "Bo Le", "BO LE"), (3, "Xann", "XANN"), (4, "Of", "OF")]
    found = blocking.placeholder_candidates(
        spark.createDataFrame(texts, "context_id int, context string"),
        spark.createDataFrame(people, "entity_id int, name string, canonical string"), 0.3)
    assert {(r["context_id"], r["entity_id"]): r["score"] for r in found.collect()} == brute_candidates(texts, people)


def test_phrase_matches(spark):
    texts = [(1, "The Red-Fox ran."), (2, "red. fox"), (3, "redfox fox red"), (4, "é RED   FOX")]
    got = blocking.phrase_matches(spark.createDataFrame(texts, "i int, t string"), "i", "t",
                                  spark.createDataFrame([(7, "red fox"), (8, "wolf")], "p int, n string"), "p", "n")
    assert sorted((r["i"], r["p"]) for r in got.collect()) == [(1, 7), (2, 7), (4, 7)]


def test_anchor_join(spark):
    before, after = "the quick brown fox jumps over", "lazy dogs that sleep all day long"
    gaps = [(1, 1, "x " + before, after + " y", 10), (2, 9, "abcdefghijklmnopqrstuvwxyzabcdefgh", "ABCDEFGHIJKLMNOPQRSTUVWXYZABCDEFGH", 100)]
    texts = [(1, f"{before} itself {after}"), (2, f"aa {before} every one {after} bb"), (3, f"{before} no end"),
             (4, "00abcdefghijklmnopqrstuvwxyzabcdefgh hidden ABCDEFGHIJKLMNOPQRSTUVWXYZABCDEFGH")]
    got = blocking.anchor_join(spark.createDataFrame(gaps, "gap_id int, doc_id int, before string, after string, expected int"),
                               spark.createDataFrame(texts, "doc_id int, text string"))
    assert {r["gap_id"]: (r["found_in"], r["recovered"], r["score"]) for r in got.collect()} == {
        1: (2, "every one", 0.85), 2: (4, "hidden", 0.8)}
    guarded = blocking.anchor_join(spark.createDataFrame(gaps, "gap_id int, doc_id int, before string, after string, expected int"),
                                   spark.createDataFrame(texts, "doc_id int, text string"),
                                   spark.createDataFrame([("Every One",)], "name string"))
    assert {r["gap_id"] for r in guarded.collect()} == {2}


def test_manifest_diff_and_removed(spark):
    old = spark.createDataFrame([("a", "h1", 1), ("b", "h2", 2), ("c", "h3", 3)], "path string, sha256 string, size_bytes long")
    new = spark.createDataFrame([("a", "h1", 1), ("b", "h9", 2), ("d", "h4", 4)], "path string, sha256 string, size_bytes long")
    got = {r["path"]: r["state"] for r in diff.manifest_diff(old, new).collect()}
    assert got == {"a": "verified", "b": "changed", "c": "missing", "d": "added"}
    known = spark.createDataFrame([("http://x/A",), ("http://x/b?q",), ("http://x/c",)], "url string")
    now = spark.createDataFrame([("http://x/a/#f",), ("http://x/b",)], "url string")
    assert [r["url"] for r in diff.removed(known, now).collect()] == ["http://x/c"]


def test_both_ends_is_symmetric(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3)], "source_id int, target_id int")
    got = {(r["entity_id"], r["other_id"]) for r in scoring.both_ends(edges).collect()}
    assert got == {(b, a) for a, b in got} and len(got) == 4


def test_alias_merge_keeps_first_spelling(spark):
    df = spark.createDataFrame([(["Dr. Ann", "Bo"], ["ANN", "bo", "Cy", " "])], "a array<string>, b array<string>")
    assert df.select(sets.merge_aliases(F.col("a"), F.col("b"))).first()[0] == ["Dr. Ann", "Bo", "Cy"]


def test_concealment_counts_marks_once(spark):
    rows = [(1, d, p, p == 1) for d in range(5) for p in (1, 2)] + [(2, 9, 1, False)]
    df = spark.createDataFrame(rows, "entity_id int, document_id int, page int, redacted boolean")
    got = [tuple(r) for r in aggs.concealment(df).collect()]
    assert got == [(1, 5, 5, 5, 1.0)]
