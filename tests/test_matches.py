"""Dictionary matches, id ranges, months of a stream, card details, findings."""

import random
import re
from collections import Counter
from datetime import datetime, timedelta


from caseloom.operators import windows
from caseloom.operators.dictionary import longest_matches
from caseloom.plans import consensus, evidence
from caseloom.streaming import jobs


def test_longest_matches(spark):
    rnd = random.Random(4)
    terms = [(1, "red"), (2, "Red Fox"), (3, "fox"), (4, "red fox den"), (5, "den of the"), (6, "the"), (7, "RED"), (8, " - "), (9, None), (10, "éa ob")]
    texts = [(i, " ".join(rnd.choice(["red", "Fox,", "den", "of", "the", "x", "(Éa)", "ob"]) for _ in range(rnd.randint(0, 14)))) for i in range(80)] + [(90, None), (91, "")]
    fold = lambda t: re.sub(r"[^a-z]+", " ", (t or "").lower().replace("é", "e")).strip()
    known = {}
    for i, t in terms:
        if fold(t):
            known[fold(t)] = min(i, known.get(fold(t), i))
    want = []
    for i, t in texts:
        words, at = fold(t).split(), 0
        while at < len(words):
            best = next((n for n in (3, 2, 1) if " ".join(words[at : at + n]) in known and at + n <= len(words)), 0)
            if best:
                want.append((i, at + 1, best, known[" ".join(words[at : at + best])]))
            at += best or 1
    a, b = spark.createDataFrame(texts, "t long, text string"), spark.createDataFrame(terms, "k long, term string")
    assert sorted(map(tuple, longest_matches(a, "t", "text", b, "k", "term").collect())) == sorted(want) and len(want) > 100
    assert longest_matches(a, "t", "text", b.limit(0), "k", "term").count() == 0


def test_neighbours_of_uneven_ids(spark):
    """Half of the ids in one dense stretch; no range holds much more than the others."""
    ids = [*range(5_000, 8_000), *(10**9 + k * 10**6 for k in range(3_000)), -7]
    df = spark.createDataFrame([(i,) for i in random.Random(1).sample(ids, len(ids))], "id long")
    seen = []
    keep = windows.cut
    windows.cut = lambda rows, name: seen.append(keep(rows, name)) or seen[-1]
    try:
        got = {r["id"]: (r["prev_id"], r["next_id"]) for r in windows.neighbour_ids(df, "id", rows=500).collect()}
    finally:
        windows.cut = keep
    ids.sort()
    assert got == {x: (a, b) for a, x, b in zip([None, *ids], ids, [*ids[1:], None])}
    sizes = sorted(r["count"] for r in seen[0].groupBy("_b").count().collect())
    assert len(sizes) > 8 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    assert windows.neighbour_ids(df.limit(0), "id").count() == 0


def test_months_of_a_stream(spark, tmp_path):
    rnd = random.Random(8)
    rows = [(rnd.randrange(3), datetime(2001, 1, 1) + timedelta(days=rnd.randrange(300))) for _ in range(200)] + [(1, None)]
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (rows[:120], rows[120:]):  # in no order of time; the second start goes on behind the first
        spark.createDataFrame(part, "k int, at timestamp").repartition(2).write.mode("append").parquet(source)
        got = jobs.stream_months(jobs.read_stream(spark, source, 1), "k", "at", root)
        got.count()
    assert {(r["k"], r["month"]): r["n"] for r in got.collect()} == Counter((k, f"{at:%Y-%m}") for k, at in rows if at)


def test_card_details(spark):
    members = spark.createDataFrame([(1,), (2,)], "entity_id long")
    seen = spark.createDataFrame([(1, 10), (2, 11), (2, 10), (3, 12), (1, 13)], "entity_id long, document_id long")
    analyses = spark.createDataFrame([(10, 1, "2001-01-01"), (10, 2, "2001-03-01"), (11, 3, "2001-02-01"), (12, 4, "2001-09-01")], "document_id long, analysis_id long, analyzed_at string")
    texts = spark.createDataFrame([(10, "N12AB and N7"), (11, "n12ab"), (12, "N99"), (13, None)], "document_id long, text string")
    row = evidence.card_details(members, seen, analyses, texts).first()
    assert [tuple(r) for r in row["recent"]] == [("2001-03-01", 2, 10), ("2001-02-01", 3, 11)] and row["registry_ids"] == ["N12AB", "N7"]
    assert [tuple(r) for r in evidence.card_details(members, seen, analyses, texts, recent=1, ids=1).first()["recent"]] == [("2001-03-01", 2, 10)]


def test_findings_name_entities(spark):
    judged = spark.createDataFrame([(1, 0, "Ann Lee", 90), (1, 1, "Ann Lee", 88), (2, 0, "nobody", 10), (3, 0, "Bob", 50)], "document_id long, annotator long, item string, score int")
    notes = spark.createDataFrame([(1, "Met at Acme Holdings Ltd", "", "wire payment", 1), (2, None, None, None, 0)],
                                  "document_id long, summary string, flags string, relations string, connections long")
    aliases = spark.createDataFrame([(5, "Ann Lee"), (6, "Lee"), (7, "Acme"), (8, "acme holdings")], "entity_id long, alias string")
    none = spark.createDataFrame([], "document_id long"), spark.createDataFrame([], "title string")
    rows = {r["document_id"]: r for r in consensus.finding_rows(consensus.agreement_levels(judged), notes, aliases, *none).collect()}
    assert set(rows) == {1, 3} and rows[1]["linked_ids"] == [5, 8] and rows[3]["linked_ids"] == []
    assert rows[1]["confidence"] == "confirmed" and rows[1]["category"] != "other" and rows[3]["category"] == "other"
    again = consensus.finding_rows(consensus.agreement_levels(judged), notes, aliases, spark.createDataFrame([(3,)], "document_id long"), none[1]).collect()
    assert [r["document_id"] for r in again] == [1]
