"""Nothing is cut: long requests, many paragraphs, long mails, large files, contexts of every match; streams go on after a stop."""

import os

import pytest
from pyspark.sql import functions as F

from caseloom import session
from caseloom.functions.text import email_fields
from caseloom.operators import filters
from caseloom.plans import mentions
from caseloom.sources import tables
from caseloom.streaming import jobs


def test_three_hundred_ids(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    asked = list(range(600, 300, -1))
    assert [r.k for r in filters.in_request_order(df, "k", asked).collect()] == asked


def test_forty_paragraphs(spark):
    df = spark.createDataFrame([(1, "\n\n".join(f"paragraph {i}" for i in range(40)))], "d int, t string")
    rows = mentions.paragraphs(df, "d", "t").orderBy("pos").collect()
    assert [r.paragraph for r in rows] == [f"paragraph {i}" for i in range(40)]


def test_ninety_line_mail(spark):
    lines = ["Forwarded message", "ann@x.org", *(f"line {i}" for i in range(90)), *(f"p{i}@y.org" for i in range(12)), "Re: the plan"]
    row = email_fields(spark.createDataFrame([("\n".join(lines),)], "s string"), "s").first()
    assert row["subject"] == "Re: the plan" and row["to"] == [f"p{i}@y.org" for i in range(12)]


def test_large_file_keeps_its_row(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "WHOLE_FILE_BYTES", 10)
    for name, size in (("a", 3), ("b", 11)):
        (tmp_path / name).write_bytes(b"x" * size)
    rows = {os.path.basename(r.path): r for r in tables.manifest(tables.read_files(spark, str(tmp_path))).collect()}
    assert rows["a"].size_bytes == 3 and len(rows["a"].sha256) == 64
    assert rows["b"].size_bytes == 11 and rows["b"].sha256 is None


def test_context_of_each_match(spark):
    """A repeated match and one inside an earlier word have contexts of their own."""
    text = "N1234AB first here; call 305-555-0100 before noon " + "." * 150 + " then N1234 and 305-555-0100 at night"
    rows = mentions.extract_patterns(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()
    phones = [r.context for r in sorted(rows, key=lambda r: r.pos) if "555" in r.name]
    assert len(phones) == 2 and "before noon" in phones[0] and "night" in phones[1] and "before" not in phones[1]
    plane = [r.context for r in rows if r.name == "N1234"]
    assert len(plane) == 1 and "then" in plane[0] and "first" not in plane[0]


def test_short_texts_count(spark):
    rows = mentions.extract_patterns(spark.createDataFrame([(1, "305-555-0100")], "doc_id int, text string")).collect()
    assert [r.name for r in rows] == ["305-555-0100"]


def test_cluster_needs_a_shared_folder(monkeypatch, spark):
    class Cluster:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Cluster()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


def test_stream_goes_on_after_a_stop(spark, tmp_path):
    """The source of the first run is archived before the second; together they equal the batch result."""
    source, root = tmp_path / "in", str(tmp_path / "root")
    rows = [(i % 3, i, f"2024-01-{1 + i:02d} 00:00:00") for i in range(0, 28, 2)]
    df = spark.createDataFrame(rows, "thread_id int, message_id int, at string").select(
        "thread_id", "message_id", F.col("at").cast("timestamp").alias("sent_at"))
    parts = [df.filter("message_id < 12"), df.filter("message_id >= 12")]
    parts[0].coalesce(1).write.parquet(str(source))
    jobs.stream_threads(jobs.read_stream(spark, str(source)), root, 3)
    for name in os.listdir(source):
        os.remove(source / name)
    parts[1].coalesce(1).write.mode("append").parquet(str(source))
    got = jobs.stream_threads(jobs.read_stream(spark, str(source)), root, 3)
    want = jobs.gaps(df, 3)
    columns = ["thread_id", "after_id", "before_id"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))


def test_mask_takes_all_forms_in_one_pass(spark):
    texts = spark.createDataFrame([(1, "Ann Lee and ANN LEE met Annie, called Lee-Lee $5 (?P<x>a) in Ann Lee Park, [PROTECTED]ish")], "doc_id int, text string")
    names = spark.createDataFrame([("Ann Lee", "ANN LEE", ["Annie", "Ann Lee Park"]), ("PROTECTED", None, None)],
                                  "name string, canonical string, aliases array<string>")
    row = mentions.mask_protected(texts, "doc_id", "text", names, ["(?P<x>a)", "lee-lee"], custom_token="$1").first()
    assert row.text == "[PROTECTED] and [PROTECTED] met [PROTECTED], called $1 $5 $1 in [PROTECTED], [[PROTECTED]]ish"


def test_needles_either_way(spark, monkeypatch):
    from caseloom.operators import blocking, needles

    texts = spark.createDataFrame([(1, "the old oak street"), (2, "an Old oak"), (3, None), (4, "k s")], "t int, text string")
    wanted = spark.createDataFrame([(10, "oak"), (11, "old oak"), (12, "k s"), (13, None), (14, ""), (15, "old oak")], "n int, needle string")
    few = blocking.containing(texts, "t", "text", wanted, "n", "needle").collect()
    phrases = blocking.phrase_matches(texts, "t", "text", wanted, "n", "needle").collect()
    monkeypatch.setattr(needles, "MOST", 0)
    assert sorted(few) == sorted(blocking.containing(texts, "t", "text", wanted, "n", "needle").collect())
    assert sorted(phrases) == sorted(blocking.phrase_matches(texts, "t", "text", wanted, "n", "needle").collect())
    assert len(few) == 6 and len(phrases) == 7


def test_transitive_links_pass_no_protected_entity(spark):
    from caseloom.plans import graph

    edges = spark.createDataFrame([(1, 2, 3.0), (2, 3, 1.0), (3, 4, 1.0)], "source_id long, target_id long, weight double")
    ents = spark.createDataFrame([(1, False), (2, False), (3, True), (4, False)], "entity_id long, is_protected boolean")
    assert len(graph.transitive_links(edges).collect()) > 0
    assert graph.transitive_links(edges, entities=ents).collect() == []
