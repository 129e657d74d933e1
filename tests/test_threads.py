"""Threads that grow: messages in batches, live messages, and the table of places, summaries and gaps."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from caseloom.operators import blocking, needles
from caseloom.plans import graph, threads
from caseloom.streaming import jobs, stitching
from tests.test_plans import brute_threads

SCHEMA = "id long, thread_key string, subject string, people array<string>, body_hash string, sent_at timestamp"


def messages(seed, n):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        when = datetime(2001, 1, 1) + timedelta(days=rnd.randrange(1500)) if rnd.random() < 0.9 else None
        rows.append({"id": i, "thread_key": f"k{i}" if rnd.random() < 0.9 else "kx",
                     "subject": rnd.choice(["", "plan", "the plan", "other news", "news", f"solo {i}"]),
                     "people": rnd.sample(["a", "b", "c", "d", "e", "f", "g"], rnd.randint(1, 2)),
                     "body_hash": rnd.choice(["", "", "h1", "h2", f"b{i}", f"b{i}"]), "sent_at": when})
    return rows


def frame(spark, rows):
    return spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)


@pytest.mark.parametrize("seed", [3, 4])
def test_batches_equal_one_batch(spark, seed):
    rows = messages(seed, 60)
    order = random.Random(seed).sample(rows, len(rows))
    first, second, third = order[:30], order[30:33], order[33:]
    roots = threads.stitch(frame(spark, first), days=20)
    roots = threads.stitch_more(frame(spark, first), roots, frame(spark, second), days=20)
    got = threads.stitch_more(frame(spark, first + second), roots, frame(spark, third + second), days=20).collect()
    assert len(got) == 60 and {r["id"]: r["root"] for r in got} == brute_threads(rows, 20)


def test_thread_table(spark):
    rows = messages(9, 50)
    root = brute_threads(rows, 20)
    got = {r["id"]: r for r in threads.stitched_threads(frame(spark, rows), 20, 30).collect()}
    assert len(got) == 50
    own = defaultdict(list)
    for r in rows:
        own[root[r["id"]]].append(r)
    for key, members in own.items():
        members.sort(key=lambda r: (r["sent_at"] is None, r["sent_at"] or datetime(1, 1, 1), r["id"]))
        dates = [r["sent_at"] for r in members if r["sent_at"]]
        people = {p for r in members for p in r["people"]}
        for k, r in enumerate(members):
            g = got[r["id"]]
            assert (g["root"], g["position"], g["message_count"], g["people_count"]) == (key, k + 1, len(members), len(people))
            assert (g["first_at"], g["last_at"]) == (min(dates, default=None), max(dates, default=None))
            after = members[k + 1] if k + 1 < len(dates) else None
            wide = after is not None and after["sent_at"] - r["sent_at"] > timedelta(days=30)
            assert g["before_id"] == (after["id"] if wide else None)
            assert g["gap_days"] == ((after["sent_at"] - r["sent_at"]).days if wide else None)


def placed(rows, days):
    """(thread, id) to (position, earlier id, gap in days) of (thread, id, time) rows."""
    own = defaultdict(set)
    for key, message, at in rows:
        own[key].add((at is None, at or datetime(1, 1, 1), message))
    want = {}
    for key, members in own.items():
        before = None
        for k, (no_date, at, message) in enumerate(sorted(members)):
            gap = (at - before[0]).days if before and not no_date and at - before[0] > timedelta(days=days) else None
            want[key, message] = (k + 1, before[1] if before and not no_date else None, gap)
            before = before if no_date else (at, message)
    return want


def test_live_threads_and_a_restart(spark, tmp_path):
    rnd = random.Random(11)
    rows, n = [], 0
    for day in range(0, 120, 4):
        for _ in range(rnd.randint(0, 6)):  # up to five days out of order
            at = datetime(2001, 1, 1) + timedelta(days=day + rnd.random() * 4 - rnd.choice([0, 0, 3]), microseconds=rnd.randrange(10**6))
            rows.append((f"t{rnd.randrange(5)}", n, at))
            n += 1
    rows += [("t1", 900, None), ("t9", 901, None), ("t9", 902, None)]
    rows += rows[-9:]  # repeats of the newest
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    cuts = [0, 20, 21, 45, len(rows)]
    seen = []
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        seen += rows[a:b]
        part = spark.createDataFrame(rows[a:b], "thread_key string, message_id long, sent_at timestamp")
        part.coalesce(1).write.mode("append").parquet(source)
        if k == 1:
            continue  # two files at the next start
        got = stitching.stream_stitch(jobs.read_stream(spark, source, 1), root, late="10 days", days=3).collect()
        assert len(got) == len({(r["thread_key"], r["message_id"]) for r in got})
        assert {(r["thread_key"], r["message_id"]): (r["position"], r["after_id"], r["gap_days"]) for r in got} == placed(seen, 3)


def test_subject_keys_stay_few(spark, monkeypatch):
    """the subjects that meet at a key do not grow with their number."""
    monkeypatch.setattr(needles, "MOST", 0)
    rows = spark.range(3000).select(F.concat(F.lit("order "), F.col("id") + 120000).alias("subject")).union(
        spark.createDataFrame([("order 1200",), ("der 12",), ("12",)], "subject string"))
    keyed = blocking.needle_keys(rows, "subject", "subject", threads.REACH).select("_key", "subject").distinct()
    assert keyed.groupBy("_key").count().agg(F.max("count")).first()[0] <= 2
    got = threads.contained_subjects(rows).select("part", "subject").collect()
    names = [r.subject for r in rows.collect()]
    assert sorted(map(tuple, got)) == sorted((p, s) for p in ("order 1200", "der 12", "12") for s in names if p in s and p != s)


def test_links_across_frequent_and_rare_keys(spark, monkeypatch):
    """Keys of few subjects, keys of many, and dates give the same links."""
    rnd = random.Random(5)
    names = ["a 1", "a 12", "a 123", "b", "a 2"]
    rows = [(i, rnd.choice(names), rnd.choice(["k", "l", f"m{i % 7}"]), datetime(2020, 1, 1) + timedelta(days=rnd.randrange(300))) for i in range(150)]
    table = spark.createDataFrame(rows, "id long, subject string, k string, sent_at timestamp").cache()
    contained = threads.contained_subjects(table).cache()
    nodes = table.select("id")
    stars = threads._stars(table, "subject", "k").unionByName(threads._chains(table.select("id", "subject", "sent_at"), "subject", 2))
    want = None
    for few in (16, 2, 0):
        monkeypatch.setattr(threads, "FEW", few)
        links = {tuple(r) for r in threads._across(contained, table, "k").collect()}
        assert want is None or links == want
        want = links
    low = {}
    for i, s, k, _ in rows:
        low[s, k] = min(low.get((s, k), i), i)
    assert want == {(low[y, k], low[x, q]) for y, k in low for x, q in low if k == q and x != y and x in y}
    whole = graph.components(nodes, stars.unionByName(threads._across_dates(contained, table, 2)))
    root = {r.id: r.root for r in whole.collect()}
    for i, s, _, at in rows:
        for j, part, _, then in rows:
            if part in s and abs(at - then) <= timedelta(days=2):
                assert root[i] == root[j]


class _State:
    """Counts what a thread asks of its state."""

    def __init__(self, value=None):
        self.value, self.reads, self.writes, self.timer = value, 0, 0, None
        self.exists = value is not None

    @property
    def get(self):
        self.reads += 1
        return self.value

    def getCurrentWatermarkMs(self):  # noqa: N802
        return 5

    def update(self, value):
        self.writes, self.value = self.writes + 1, value

    def setTimeoutTimestamp(self, at):  # noqa: N802
        self.timer = at


def test_a_thread_reads_and_writes_its_state_once():
    """one read and one write a thread, whatever its messages."""
    state = _State((7, 1000, 3, [6000], [8]))
    rows = pd.concat(stitching.place(("t",), iter([pd.DataFrame({"at": [4000, 1000, 9000], "message_id": [9, 7, 10]})]), state))
    assert (state.reads, state.writes) == (1, 1)
    assert rows[["message_id", "position", "after_id"]].values.tolist() == [[9, 4, 7], [8, 5, 9], [10, 6, 8]]
    assert state.value == (9, 4000, 4, [6000, 9000], [8, 10]) and state.timer == 10
