"""Message threads: linked pairs as stars and chains, then connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.operators.blocking import containing
from caseloom.operators.skew import bucketed_last, bucketed_neighbours
from caseloom.operators.windows import gaps, month_bucket, thread_positions
from caseloom.plans.graph import components
from caseloom.session import cut


def _stars(rows: DataFrame, *keys: str) -> DataFrame:
    """Link every message of a key to the lowest one; as connected as all pairs, but linear."""
    known = rows
    for key in keys:
        known = known.filter(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    low = known.groupBy(*keys).agg(F.min("id").alias("b"))
    return known.join(low, list(keys)).select(F.col("id").alias("a"), "b").filter("a <> b")


def _chains(rows: DataFrame, key: str, days: int, runs: DataFrame | None = None) -> DataFrame:
    """Link every message to the first of its run (``_runs_of``), which joins exactly what all pairs of one key within ``days`` would join."""
    runs = _runs_of(rows, days, key) if runs is None else runs
    return runs.filter("id <> run").select(F.col("id").alias("a"), F.col("run").alias("b"))


def _lowest(rows: DataFrame, key: str) -> DataFrame:
    """(subject, key, id): the lowest message of each subject and key."""
    known = rows.filter(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    return cut(known.groupBy("subject", key).agg(F.min("id").alias("id")), "subject-keys")


def _to_lowest(rows: DataFrame, low: DataFrame, key: str) -> DataFrame:
    """Link every message of a subject and key to the lowest one, by ``_lowest``."""
    linked = rows.select("id", "subject", key).join(low.withColumnRenamed("id", "b"), ["subject", key])
    return linked.select(F.col("id").alias("a"), "b").filter("a <> b")


def _nearest_open(rows: DataFrame, key: str, days: int) -> DataFrame:
    """Link each message to the nearest messages without a subject, before and after, of the same key."""
    dated = rows.filter(F.col(key).isNotNull() & F.col("sent_at").isNotNull()).select(
        "id", key, "sent_at", (F.col("subject") == "").alias("open"))
    # only keys that an open message has can link; the others need not be ordered
    dated = cut(dated.join(dated.filter("open").select(key).distinct(), key, "left_semi"), "open-keys")
    span, links = F.make_dt_interval(F.lit(days)), None
    stamp = F.unix_micros(F.col("sent_at").cast("timestamp"))
    for sign in (1, -1):
        ordered = dated.withColumn("t", stamp * sign).withColumn("_k", F.floor(F.col("t") / (30 * 86400 * 1000000)))
        mark = F.when(F.col("open"), F.struct("sent_at", "id"))
        seen = bucketed_last(ordered.withColumn("o", (~F.col("open")).cast("int")), [key], "_k", ["t", "o", "id"], mark, "near",
                             strict=True)
        gap = (F.col("sent_at") <= F.col("near.sent_at") + span) & (F.col("near.sent_at") <= F.col("sent_at") + span)
        part = seen.filter(F.col("near").isNotNull() & gap).select(F.col("id").alias("a"), F.col("near.id").alias("b"))
        links = part if links is None else links.unionByName(part)
    return links.filter("a <> b")


REACH = 16  # letters of a subject's word in a search key
FEW = 16    # subjects of a key that are compared in place


def _contained(texts: DataFrame, parts: DataFrame) -> DataFrame:
    """(part, subject) of the ``subject`` of texts and of ``parts``, the first contained in the second."""
    return containing(texts, "subject", "subject", parts.withColumnRenamed("subject", "part"), "part", "part", REACH)


def contained_subjects(messages: DataFrame) -> DataFrame:
    """(part, subject): distinct subjects of which the first is contained in the second."""
    subjects = messages.filter("subject <> ''").select("subject").distinct()
    return _contained(subjects, subjects).filter("part <> subject")


def _across(contained: DataFrame, rows: DataFrame, key: str, low: DataFrame | None = None) -> DataFrame:
    """Link one message per (subject, key) to that of the contained subject with the same key; ``low`` is ``_lowest`` of the rows.

    Messages of a subject that share the key are stars already, so their lowest
    one stands for all. Keys of few subjects compare these in place. For other keys
    the longer subject's rows look up the shorter one's, so a short subject that many others contain is not copied for each of them.
    """
    low = _lowest(rows, key) if low is None else low
    many = cut(low.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > FEW).select(key), "frequent-keys")
    groups = low.join(many, key, "left_anti").groupBy(key).agg(F.collect_list(F.struct("subject", "id")).alias("xs")).filter(F.size("xs") > 1)
    placed = groups.select("xs", F.explode("xs").alias("x")).select("x", F.explode("xs").alias("y"))
    near = placed.filter((F.col("x.id") != F.col("y.id")) & F.contains(F.col("x.subject"), F.col("y.subject"))).select(
        F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    often = low.join(many, key, "left_semi")
    asked = contained.join(often, "subject").select("part", key, F.col("id").alias("a"))
    return near.unionByName(
        asked.join(often.select(F.col("subject").alias("part"), key, F.col("id").alias("b")), ["part", key]).select("a", "b"))


def _runs_of(rows: DataFrame, days: int, key: str = "subject") -> DataFrame:
    """(id, key, sent_at, run): dated messages and the first one of their stretch of the key without a pause longer than ``days``.

    If two messages are close enough, so are all neighbours between them, hence a run joins exactly what all close pairs would join.
    """
    dated = rows.filter(F.col(key).isNotNull() & F.col("sent_at").isNotNull()).select("id", key, "sent_at").withColumn("_m", month_bucket("sent_at"))
    near = bucketed_neighbours(dated, [key], "_m", ["sent_at", "id"], [], prev="p")
    begins = F.col("p").isNull() | (F.col("sent_at") > F.col("p.sent_at") + F.make_dt_interval(F.lit(days)))
    runs = bucketed_last(near.withColumn("_s", begins), [key], "_m", ["sent_at", "id"], F.when(F.col("_s"), F.col("id")), "run")
    return cut(runs.select("id", key, "sent_at", "run"), "runs")


def _across_dates(contained: DataFrame, rows: DataFrame, days: int, runs: DataFrame | None = None) -> DataFrame:
    """Link runs of a subject and of a contained one that come within ``days`` of each other; ``runs`` is ``_runs_of`` the rows.

    Inside a run no pause is longer than ``days``, so two runs hold close
    messages exactly when the runs themselves are that close, that is, when they overlap if each lasts ``days`` longer.
    Runs meet by the stretches of time that they cover, in the one where the later of the two begins. A run without long pauses
    covers no more stretches than it has messages, and one.
    """
    stretch, span = max(4 * days, 1) * 86400, days * 86400
    runs = (_runs_of(rows, days) if runs is None else runs).groupBy("subject", "run").agg(F.min("sent_at").alias("first_at"), F.max("sent_at").alias("last_at"), F.min("id").alias("id"))
    runs = runs.select("subject", "id", F.unix_micros(F.col("first_at").cast("timestamp")).alias("f"),
                                       (F.unix_micros(F.col("last_at").cast("timestamp")) + span * 1000000).alias("l"))
    place = lambda c: F.floor(c / (stretch * 1000000))
    runs = cut(runs.withColumn("s", F.explode(F.sequence(place(F.col("f")), place(F.col("l"))))), "subject-runs")
    asked = contained.join(runs, "subject").select("part", "s", F.col("id").alias("a"), "f", "l")
    held = runs.select(F.col("subject").alias("part"), "s", F.col("id").alias("b"), F.col("f").alias("g"), F.col("l").alias("m"))
    return asked.join(held, ["part", "s"]).filter(
        (F.col("f") <= F.col("m")) & (F.col("g") <= F.col("l")) & (F.col("s") == place(F.greatest("f", "g")))).select("a", "b")


def thread_links(messages: DataFrame, days: int = 365) -> DataFrame:
    """Links (a, b) between messages that belong together.

    ``messages`` is (id, thread_key, subject, people, body_hash, sent_at) with a
    normalised subject and distinct participants. Two messages belong together
    with equal thread keys, or when their subjects are equal or one contains
    the other and they also share a participant, the body, or a date within
    ``days``. Where a subject is missing, two of the other three are needed.
    """
    person = F.explode("people").alias("person")
    titled = messages.filter("subject <> ''")
    by_person = titled.select("id", "subject", person)
    contained = cut(contained_subjects(messages), "subjects")
    links = _stars(messages, "thread_key")
    for rows, key in ((titled, "body_hash"), (by_person, "person")):
        low = _lowest(rows, key)
        links = links.unionByName(_to_lowest(rows, low, key)).unionByName(_across(contained, rows, key, low))
    runs = _runs_of(titled, days)
    links = links.unionByName(_chains(titled, "subject", days, runs)).unionByName(_across_dates(contained, titled, days, runs))
    missing = messages.filter("subject = ''").limit(1).count() > 0
    if missing:
        people = messages.select("id", "subject", "body_hash", "sent_at", person)
        # messages without a subject: same participant and body; one of them open
        key = F.concat_ws("\u0001", "person", "body_hash")
        linked = people.withColumn("k", F.when(F.col("body_hash") != "", key)).filter("k IS NOT NULL")
        has_open = linked.filter("subject = ''").select("k").distinct()
        links = links.unionByName(_stars(linked.join(has_open, "k", "left_semi"), "k"))
        links = links.unionByName(_nearest_open(people, "person", days))
        links = links.unionByName(_nearest_open(messages.filter("body_hash <> ''"), "body_hash", days))
    return links.distinct()


def short_keys(messages: DataFrame) -> DataFrame:
    """Messages whose thread keys and bodies are their 128-bit digests in 22 characters; without one they stay so."""
    return messages.withColumns({c: F.when(F.col(c) == "", "").otherwise(F.substring(F.base64(F.unhex(F.md5(c))), 1, 22))
                                 for c in ("thread_key", "body_hash")})


def stitch(messages: DataFrame, days: int = 365) -> DataFrame:
    """(id, root): the thread of each message, named by its lowest message. Order of arrival does not matter."""
    messages = cut(short_keys(messages), "messages")  # read by every kind of link
    return components(messages, thread_links(messages, days))


def body_hash(c: Column) -> Column:
    return F.when(c == "", "").otherwise(F.md5(c))


def _sharing(messages: DataFrame, asked: DataFrame) -> DataFrame:
    """Ids of messages that share a participant or the body with one of ``asked``."""
    people = asked.select(F.explode("people").alias("person")).distinct()
    by_person = messages.select("id", F.explode("people").alias("person")).join(people, "person", "left_semi").select("id")
    bodies = asked.filter("body_hash <> ''").select("body_hash").distinct()
    return by_person.union(messages.join(bodies, "body_hash", "left_semi").select("id"))


def may_link(known: DataFrame, arrivals: DataFrame) -> DataFrame:
    """The rows of ``known`` that a new message could be linked to, and those of the same subjects between them.

    These are the messages of the same thread key, of an equal, contained or containing subject, and, where a subject
    is missing on either side, those that share a participant or the body. Whole subjects and all open messages of a participant come along, so
    that neighbours in time are the same as in the whole table.
    """
    fresh = cut(arrivals.filter("subject <> ''").select("subject").distinct(), "new-subjects")
    subjects = cut(known.filter("subject <> ''").select("subject").distinct(), "known-subjects")
    longer = _contained(subjects, fresh).select("subject")
    shorter = _contained(fresh, subjects).select("part")
    related = fresh.union(longer).union(shorter).distinct()
    keys = arrivals.filter("thread_key <> ''").select("thread_key").distinct()
    ids = known.join(related, "subject", "left_semi").select("id").union(known.join(keys, "thread_key", "left_semi").select("id"))
    ids = ids.union(_sharing(known.filter("subject = ''"), arrivals)).union(_sharing(known, arrivals.filter("subject = ''")))
    return known.join(ids.distinct(), "id", "left_semi")


def stitch_more(messages: DataFrame, roots: DataFrame, arrivals: DataFrame, days: int = 365) -> DataFrame:
    """(id, root) after ``arrivals`` join the stitched ``messages`` with their ``roots``; as if all had come at once.

    Links are looked for among the arrivals and what they may link to. Their ends are replaced by the stored roots, so a thread is one node, and only the
    threads that a new link touches are contracted. Arrivals of known ids are left out.
    """
    messages, arrivals = cut(short_keys(messages), "messages"), short_keys(arrivals.select(*messages.columns))
    arrivals = cut(arrivals.join(messages.select("id"), "id", "left_anti").dropDuplicates(["id"]), "arrivals")
    near = cut(may_link(messages, arrivals), "may-link")
    links = cut(thread_links(near.unionByName(arrivals), days), "new-links")
    whole = roots.select("id", "root").unionByName(arrivals.select("id", F.col("id").alias("root")))
    for end in ("a", "b"):
        links = links.join(whole.select(F.col("id").alias(end), F.col("root").alias(f"{end}_root")), end)
    links = cut(links.filter("a_root <> b_root").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct(), "root-links")
    touched = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    moved = components(touched, links).withColumnRenamed("root", "lowest").withColumnRenamed("id", "root")
    return whole.join(moved, "root", "left").select("id", F.coalesce("lowest", "root").alias("root"))


def thread_table(messages: DataFrame, roots: DataFrame, gap_days: int = 7) -> DataFrame:
    """Every message with its thread's root, its place there, the thread's size, dates and participants, and the gap behind it.

    Undated messages come last. ``gap_days``, ``severity`` and ``before_id`` tell of a pause of more than ``gap_days`` until the next dated message.
    """
    placed = cut(messages.join(roots, "id").select(F.col("root").alias("thread_id"), F.col("id").alias("message_id"), "sent_at", "people"), "stitched")
    dated = placed.groupBy("thread_id").agg(
        F.count(F.lit(1)).alias("message_count"), F.min("sent_at").alias("first_at"), F.max("sent_at").alias("last_at"))
    people = placed.select("thread_id", F.explode("people").alias("person")).distinct().groupBy("thread_id").agg(F.count(F.lit(1)).alias("people_count"))
    summary = dated.join(people, "thread_id", "left")
    rows = thread_positions(placed.select("thread_id", "message_id", "sent_at"))
    after = gaps(placed, gap_days).select(F.col("after_id").alias("message_id"), "before_id", "gap_days", "severity")
    return rows.join(after, "message_id", "left").join(summary, "thread_id").select(
        F.col("message_id").alias("id"), F.col("thread_id").alias("root"), "position", "message_count", "first_at", "last_at",
        F.coalesce("people_count", F.lit(0)).alias("people_count"), "before_id", "gap_days", "severity")


def stitched_threads(messages: DataFrame, days: int = 365, gap_days: int = 7) -> DataFrame:
    """The whole job: threads, places, summaries and gaps."""
    return thread_table(messages, cut(stitch(messages, days), "roots"), gap_days)
