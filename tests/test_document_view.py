"""Nested documents: paragraphs, mentions laid over them, and rows without pages."""

import random
import re

import pytest

from caseloom.plans import review


@pytest.fixture(scope="module")
def tables(spark):
    rnd = random.Random(2)
    words = ["Ann", "Ann Lee", "Lee", "a.b", "(x)", "plain", "[redacted]", "\n", "\n\n", "\n\n  ", "é", "Ann Leeds"]
    pages = [(d, p, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 40)))) for d in range(6) for p in range(1, 4)]
    pages += [(20, 1, None), (21, 1, ""), (21, 2, "\n\n \n\n")]
    links = [(d, e, n, t, s) for d in (*range(5), 30) for e, n, t, s in (
        (1, "Ann", "person", 5), (2, "Ann Lee", "person", 9), (3, "Lee", "person", 1), (4, "a.b", "company", 7), (5, "(x)", "place", 7), (6, "Ann", "place", 6), (7, "", "person", 1))]
    gaps = [(1, 2, 12, "open"), (1, 1, 11, "done"), (20, 1, 13, "open")]
    return (spark.createDataFrame([(d,) for d in (*range(6), 20, 21, 40)], "document_id long"),
            spark.createDataFrame(pages, "document_id long, page int, text string"),
            spark.createDataFrame(links, "document_id long, entity_id long, name string, entity_type string, score int"),
            spark.createDataFrame(gaps, "document_id long, page int, gap_id long, status string"), pages, links)


@pytest.mark.parametrize("block", [8, 4096])
def test_mentions_over_paragraphs(tables, block):
    _, pages, links, _, raw, named = tables
    best = {}
    for d, e, n, t, s in sorted(named, key=lambda x: (x[4], -x[1])):
        if n:
            best[d, n] = (e, t)
    want = []
    for d, p, text in raw:
        names = sorted((n for k, n in best if k == d), key=len, reverse=True)
        for k, para in enumerate(q.strip() for q in (text or "").split("\n\n") if q.strip()):
            hits = [(m.start(), len(m[0]), *best[d, m[0]]) for m in re.finditer("|".join(map(re.escape, names)), para)] if names else []
            want.append((d, p, k + 1, para, tuple(hits), tuple(sorted({h[3] for h in hits})), "[redacted]" in para))
    got = [(r["document_id"], r["page"], r["para"], r["text"], tuple(map(tuple, r["spans"])), tuple(r["types"]), r["redacted"])
           for r in review.annotated_paragraphs(pages, links, block).collect()]
    assert sorted(got) == sorted(want) and sum(len(w[4]) for w in want) > 100


def test_whole_documents(tables):
    docs, pages, links, gaps, raw, _ = tables
    got = {r["document_id"]: r for r in review.whole_documents(docs, pages, links, gaps).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4, 5, 20, 21, 40]
    assert [(r["prev_id"], r["next_id"]) for _, r in sorted(got.items())] == [
        (None, 1), (0, 2), (1, 3), (2, 4), (3, 5), (4, 20), (5, 21), (20, 40), (21, None)]
    one = got[1]
    assert [tuple(g) for g in one["gaps"]] == [(1, 11, "done"), (2, 12, "open")] and [p["page"] for p in one["pages"]] == [1, 2, 3]
    assert [x["entity_id"] for x in one["links"]] == [2, 4, 5, 6, 1, 3, 7] and {t["entity_type"]: t["n"] for t in one["types"]} == {"person": 4, "company": 1, "place": 2}
    assert one["chars"] == sum(len(t) for d, _, t in raw if d == 1) and [(p["page"], p["para"]) for p in one["paragraphs"]] == sorted((p["page"], p["para"]) for p in one["paragraphs"])
    assert got[40]["pages"] is None and got[40]["chars"] == 0 and got[40]["paragraphs"] is None and got[21]["paragraphs"] is None and len(got[20]["gaps"]) == 1
