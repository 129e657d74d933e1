"""Per-key sequences: top-n, positions, gaps, spikes, clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.operators.skew import bucketed_before, bucketed_neighbours, bucketed_rank
from caseloom.session import cut

DAY = 86_400_000_000  # microseconds
BLOCK = 1 << 16  # ids of one bucket where ids give the order


def top_per_key(df: DataFrame, key: str, order: Sequence[Column], n: int) -> DataFrame:
    """N best rows per key; Spark drops rows beyond N before the shuffle too."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rn") <= n)


def month_bucket(c: str) -> Column:
    """Month of a time; undated rows come after everything."""
    return F.coalesce(F.date_trunc("month", F.col(c).cast("timestamp")), F.lit("9999-01-01").cast("timestamp"))


def thread_positions(messages: DataFrame) -> DataFrame:
    """1-based place by date inside the thread, undated messages last, in blocks of their ids."""
    block = F.when(F.col("sent_at").isNull(), F.floor(F.col("message_id") / BLOCK)).otherwise(0)
    return bucketed_rank(messages.withColumn("_m", F.struct(month_bucket("sent_at").alias("m"), block.alias("b"))), ["thread_id"], "_m",
                         [F.asc_nulls_last("sent_at"), F.asc("message_id")], out="position").drop("_m")


def gaps(messages: DataFrame, days: int = 7, high: int = 30) -> DataFrame:
    """Consecutive dated messages of a thread more than ``days`` apart."""
    dated = messages.filter(F.col("sent_at").isNotNull()).withColumn("_m", month_bucket("sent_at"))
    rows = bucketed_neighbours(dated, ["thread_id"], "_m", ["sent_at", "message_id"], [], following="nxt")
    elapsed = F.unix_micros(F.col("nxt.sent_at").cast("timestamp")) - F.unix_micros(F.col("sent_at").cast("timestamp"))
    wide = rows.withColumn("_e", elapsed).filter(F.col("_e") > days * DAY)
    gap = F.floor(F.col("_e") / DAY)
    return wide.select(
        "thread_id", F.col("message_id").alias("after_id"), F.col("nxt.message_id").alias("before_id"),
        gap.cast("long").alias("gap_days"), F.when(gap > high, "high").otherwise("medium").alias("severity"))


def running_context(messages: DataFrame, thread: str, turn: str, part: Column, block: int = 1024) -> DataFrame:
    """Each message's own part of the thread text, how many parts precede it and how long they are.

    The text before message k is the parts with a lower place: the thread is
    kept once, not once more for every message.
    """
    df = messages.withColumn("part", part).withColumn("_b", F.floor(F.col(turn) / block))
    ranked = bucketed_rank(df, [thread], "_b", [F.asc(turn)], out="position")
    return bucketed_before(ranked, [thread], "_b", [F.asc(turn)], F.length("part").cast("long"), "prior_chars").drop("_b")


def prior_parts(parts: DataFrame, wanted: DataFrame, thread: str) -> DataFrame:
    """Earlier parts for the messages of a batch (``wanted``: thread, position), one row per part."""
    ask = wanted.select(thread, F.col("position").alias("wanted"))
    earlier = parts.join(ask, thread).filter(F.col("position") < F.col("wanted"))
    return earlier.select(thread, F.col("wanted").alias("position"), F.col("position").alias("place"), "part")


def spikes(events: DataFrame, keys: Sequence[str], at: str, z: float, min_events: int) -> DataFrame:
    """Months with a count at least ``z`` sample deviations above the key's mean."""
    keys = list(keys)
    monthly = events.filter(F.col(at).isNotNull()).groupBy(*keys, F.date_format(at, "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("n"))
    return count_spikes(monthly, keys, "month", z, min_events)


def count_spikes(counts: DataFrame, keys: Sequence[str], period: str, z: float, min_events: int) -> DataFrame:
    """Periods whose count ``n`` lies at least ``z`` sample deviations above the mean of the key's periods.

    Sums of whole numbers do not depend on their order, so a count at the bound is told without rounding.
    """
    keys = list(keys)
    per_key = Window.partitionBy(*keys)
    whole = F.col("n").cast("decimal(18,0)")
    scored = counts.select(
        *keys, period, "n", F.avg("n").over(per_key).alias("mean"), F.stddev_samp("n").over(per_key).alias("sd"),
        F.sum("n").over(per_key).alias("_t"), F.count(F.lit(1)).over(per_key).alias("_k"), F.sum(whole * whole).over(per_key).alias("_q"))
    total = F.col("_t").cast("decimal(18,0)")
    kept = scored.filter((F.col("_t") >= min_events) & (F.col("_k") >= 2)).withColumn(  # k * (k - 1) times the variance
        "_v", (F.col("_k").cast("decimal(18,0)") * F.col("_q") - total * total).cast("double")).filter("_v > 0")
    above = F.col("_k") * F.col("n") - F.col("_t")  # k times the distance from the mean
    high = (above > 0) & (above.cast("double") * above * (F.col("_k") - 1) >= z * z * F.col("_k") * F.col("_v"))
    return kept.filter(high).withColumn("z", (F.col("n") - F.col("mean")) / F.col("sd")).drop("_t", "_k", "_q", "_v")


def cluster_members(mentions: DataFrame, days: int = 3) -> DataFrame:
    """(start, day, entity_id, document_id): each dated mention in every window that it falls in.

    A window starts on a day with mentions and ends ``days`` later. A mention
    is copied to the ``days + 1`` possible starts, so windows need no global order.
    """
    dated = mentions.filter(F.col("event_ts").isNotNull()).select(
        F.to_date("event_ts").alias("day"), "entity_id", "document_id").distinct()
    starts = dated.select(F.col("day").alias("start")).distinct()
    copies = dated.withColumn("start", F.explode(F.sequence(F.date_sub("day", days), F.col("day"))))
    return copies.join(starts, "start", "left_semi")


def time_clusters(members: DataFrame, at_least: int = 3) -> DataFrame:
    """Windows with at least three entities: first and last date, entities, documents."""
    found = members.groupBy("start").agg(
        F.max("day").alias("date_end"), F.countDistinct("entity_id").alias("entity_count"),
        F.countDistinct("document_id").alias("document_count"))
    return found.filter(F.col("entity_count") >= at_least).withColumnRenamed("start", "date_start")


def neighbour_ids(df: DataFrame, key: str, rows: int = 1 << 17) -> DataFrame:
    """Previous and next id of every row, over the whole table.

    Ids are cut into ranges of about ``rows`` rows at splitters that Spark samples, so a dense stretch gets more ranges, however uneven ids
    are. Inside a range they are ordered; between ranges one id is handed on at either end. The ranges are written, as a range partition is
    not drawn twice the same.
    """
    ids = df.select(key).filter(F.col(key).isNotNull()).distinct()
    parts = max(1, -(-ids.count() // rows))
    ranged = cut(ids.repartitionByRange(parts, key).withColumn("_b", F.spark_partition_id()), "id-ranges")
    near = bucketed_neighbours(ranged, [], "_b", [key], [], prev="_p", following="_n")
    return near.select(key, F.col(f"_p.{key}").alias("prev_id"), F.col(f"_n.{key}").alias("next_id"))


def align_answers(gap_rows: DataFrame, answers: DataFrame, page: str, key: str, block: int = 1024) -> DataFrame:
    """The k-th answer of a document meets its k-th gap in page order; other numbers drop out."""
    numbered = bucketed_rank(gap_rows.withColumn("_b", F.floor(F.col(page) / block)), ["document_id"], "_b",
                             [F.asc(page), F.asc(key)], out="index").drop("_b")
    return numbered.join(answers, ["document_id", "index"])


def first_mentions(df: DataFrame, document: str, canonical: str, position: str) -> DataFrame:
    """First place of each value per document."""
    return df.groupBy(document, canonical).agg(F.min(position).alias("first_pos"))


def decay_ranks(evidence: DataFrame) -> DataFrame:
    """0-based rank of positive evidence of an entity, best first; buckets are blocks of document ids of one score."""
    kept = evidence.filter(F.col("evidence_score") > 0).withColumn(
        "_b", F.struct((-F.col("evidence_score")).alias("s"), F.floor(F.col("document_id") / BLOCK).alias("d")))
    ranked = bucketed_rank(kept, ["entity_id"], "_b", [F.asc("document_id"), F.asc("page")], out="rn").drop("_b")
    return ranked.withColumn("decay_rank", F.col("rn") - 1).drop("rn")


def best_candidate(df: DataFrame, keys: Sequence[str], score: str, tie: str) -> DataFrame:
    best = df.groupBy(*keys).agg(F.max(F.struct(score, (-F.col(tie)).alias("o"))).alias("m"))
    return best.select(*keys, (-F.col("m.o")).alias(tie), F.col(f"m.{score}").alias(score))
