"""Names, texts, dates, addresses on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from caseloom.functions import dates, names, text, urls
from caseloom.operators import filters


def values(spark, rows, expr, schema="s string"):
    df = spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema)
    return [r["v"] for r in df.select(expr.alias("v")).collect()]


def test_normalize_name(spark):
    rows = ["Dr. Jane  Doe, Jr.", "  judge Roy Bean ", "Mr John", "sirius Black", "", "Ann Lee PhD"]
    want = ["JANE DOE", "ROY BEAN", "JOHN", "SIRIUS BLACK", "", "ANN LEE"]
    assert values(spark, rows, names.normalize_name(F.col("s"))) == want


@pytest.mark.parametrize("a,b,same", [
    ("John Doe", "John Doe", True), ("john doe", "JOHN DOE", True), ("John  Doe", "John Doe", True),
    ("Johnson", "Robert Johnson", True), ("Doe", "John Doe", False), ("Alan", "Evaluation", False),
    ("Alan", "Alan Poe", True), ("", "John", False), (None, "John", False)])
def test_names_match(spark, a, b, same):
    got = values(spark, [(a, b)], names.names_match(F.col("a"), F.col("b")), "a string, b string")
    assert got == [same]


def test_debris(spark):
    rows = ["AB1234", "aaaaaa bad", "x", "line\nbreak", "Jane Doe", "xkcdrt pqrst vwxzt", None]
    assert values(spark, rows, names.is_noise(F.col("s"), F.lit("person"))) == [True, True, True, True, False, True, True]
    assert values(spark, ["NINININI", "9e_a_St", "Jane Doe", "$500 paid", "Thisisaverylongword"],
                  names.is_garbage(F.col("s"))) == [True, True, False, False, True]
    assert values(spark, ["$1,000", "12345 a", "Jane Doe"], names.looks_noisy(F.col("s"))) == [False, True, False]


def test_subject_prefixes_are_all_removed(spark):
    assert values(spark, ["Re: Re: FW:  The  Plan", "RE: Meeting", None], text.normalize_subject(F.col("s"))) == [
        "the plan", "meeting", ""]


def test_clean_body(spark):
    body = "Hello\n> quoted\nOn Monday Bob wrote:\nbye\n-----Original Message-----\nold\nold2"
    assert values(spark, [body], text.clean_body(F.col("s")))[0].split() == ["Hello", "bye"]


def test_parse_date(spark):
    rows = ["Mon, 05 Mar 2001 10:00:00 -0500", "05 Mar 2001 10:00:00 EST", "3/5/2001 1:30 PM", "2001-03-05", "March 5, 2001",
            "Mar 5, 2001", "05-Mar-2001", "05-Mar-99", "05 Mar 2001 10:00:00 ABC", "not a date", None]
    want = [dt.datetime(2001, 3, 5, 15), dt.datetime(2001, 3, 5, 15), dt.datetime(2001, 3, 5, 13, 30), dt.datetime(2001, 3, 5),
            dt.datetime(2001, 3, 5), dt.datetime(2001, 3, 5), dt.datetime(2001, 3, 5), dt.datetime(1999, 3, 5),
            dt.datetime(2001, 3, 5, 10), None, None]
    assert values(spark, rows, dates.parse_date(F.col("s")).cast("timestamp_ntz")) == want


def test_like_takes_wildcards_literally(spark):
    rows = ["100% complete", "100 complete", "file_name.pdf", "filename.pdf"]
    assert values(spark, rows, filters.contains_literal(F.col("s"), "100%")) == [True, False, False, False]
    assert values(spark, rows, filters.contains_literal(F.col("s"), "FILE_N")) == [False, False, True, False]


def test_phrase_search(spark):
    df = spark.createDataFrame([(1, "The Flight-Log, found"), (2, "flight of the log"), (3, "Élan vital!!!@@@###")], "id int, s string")
    ids = lambda q: [r["id"] for r in filters.phrase_hits(df, "s", q).orderBy("id").collect()]
    assert ids("flight log") == [1]
    assert ids('"flight" LOG*') == [1]
    assert ids("elan") == [3]
    assert ids("!!!@@@###") == [3]


def test_urls(spark):
    assert values(spark, ["HTTPS://X.org/A/B/?q=1#f", "http://x.org"], urls.normalize_url(F.col("s"))) == ["HTTPS://X.org/a/b", "http://x.org"]
    assert values(spark, ["http://x/a/My%20F.pdf?x=1", "http://x/a+b.pdf"], urls.url_filename(F.col("s"))) == ["My F.pdf", "a+b.pdf"]
    assert values(spark, ["con.txt", "a/b:c", "..", "x" * 250 + ".pdf"], urls.safe_filename(F.col("s"))) == [
        "_con.txt", "a_b_c", "_", "x" * 200 + ".pdf"]
    assert values(spark, ["a.PDF", "b.tiff", "c", "d.weird"], urls.file_type(F.col("s"))) == ["pdf", "image", "other", "other"]


def test_email_fields_without_labels(spark):
    msg = "Forwarded message\nAnn <ann@x.org>\nbob@y.org ann@x.org\nRe: the plan\nMon, March 5, 2001\nbody"
    row = text.email_fields(spark.createDataFrame([(msg,)], "s string"), "s").first()
    assert (row["from_address"], row["to"], row["subject"]) == ("ann@x.org", ["bob@y.org"], "Re: the plan")
    full = "From: Ann Lee <ann@x.org>\nTo: B <b@y.org>; b@y.org, c@z.org\nCC: d@w.org\nSubject: Hi\nDate: 2001-01-01\n\nthe body"
    row = text.email_fields(spark.createDataFrame([(full,)], "s string"), "s").first()
    assert (row["from_name"], row["to"], row["cc"], row["body"]) == ("Ann Lee", ["B <b@y.org>", "c@z.org"], ["d@w.org"], "the body")


def test_safe_number(spark):
    assert values(spark, ["1.5", "NaN", "Infinity", "x", None], filters.safe_number(F.col("s"), -1.0)) == [1.5, -1, -1, -1, -1]
