"""Live threads: each arriving message is matched by thread key, placed, and checked for a gap to the one before.

The state of a thread is its last settled message with its place, and the messages that the watermark has not passed. A message is settled once the
watermark has passed it, as nothing earlier can arrive any more; a timer settles what waits when no further message of its thread comes.
Waiting messages are placed as things stand and placed again when others come between. No batch reads what earlier batches wrote: state is
kept by key in the state store, below the job's root. It comes with the rows of its thread, many threads at a time, so a thread costs
no calls of its own to the state store.

Messages without a date need no state; they follow the dated ones by id, as the reader adds them. Messages later than the
watermark are dropped. Repeats of a waiting message, or of the last settled one, are dropped too. A task holds the messages of one thread of
one batch and those that wait, so the size of a batch (``files_per_batch`` of the reader) bounds its memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from caseloom.operators.windows import DAY
from caseloom.streaming.jobs import batch_folder, run

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Times are microseconds. ``after_at`` is the message before this one in its thread.
PLACED = "thread_key string, message_id long, at long, position long, after_id long, after_at long"


#: The last settled message with its place, and the waiting messages in order.
STATE = "message_id long, at long, position long, waiting_at array<long>, waiting_id array<long>"


def place(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows of the waiting and new messages of one thread, of which those that the watermark has passed become settled."""
    last, waiting = (None, None, 0), []
    if state.exists:
        *last, ats, ids = state.get
        waiting = list(zip(ats, ids))
    known = set(waiting)
    for frame in frames:  # none if a timer has called
        known |= set(zip(frame["at"].tolist(), frame["message_id"].tolist()))
    known.discard((last[1], last[0]))
    watermark = state.getCurrentWatermarkMs() * 1000
    rows, waiting, settled = [], [], last
    for at, message in sorted(known):
        rows.append((key[0], message, at, last[2] + 1, last[0], last[1]))
        last = (message, at, last[2] + 1)
        if at < watermark:
            settled = last
        else:
            waiting.append((at, message))
    state.update((*settled, [at for at, _ in waiting], [message for _, message in waiting]))
    if waiting:
        state.setTimeoutTimestamp(waiting[-1][0] // 1000 + 1)
    if rows:
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in PLACED.split(", ")]).astype({"after_id": "Int64", "after_at": "Int64"})


def stream_stitch(messages: DataFrame, root: str, late: str = "1 day", days: int = 7, high: int = 30) -> DataFrame:
    """(thread_key, message_id, sent_at, position, after_id, gap_days, severity) of a stream of (thread_key, message_id, sent_at).

    ``gap_days`` and ``severity`` tell of a pause of more than ``days`` before the message. Started again on its root, the job goes on behind its last
    batch.
    """
    spark = messages.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = messages.select(F.col("thread_key").cast("string"), F.col("message_id").cast("long"), F.col("sent_at").cast("timestamp"))
    dated = rows.withWatermark("sent_at", late).select("thread_key", "message_id", "sent_at", F.unix_micros("sent_at").alias("at"))
    placed = dated.filter("sent_at IS NOT NULL").groupBy("thread_key").applyInPandasWithState(
        place, PLACED, STATE, "update", GroupStateTimeout.EventTimeTimeout)
    undated = rows.filter("sent_at IS NULL").select("thread_key", "message_id", *(
        F.lit(None).cast("long").alias(c) for c in ("at", "position", "after_id", "after_at")))

    def handle(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(batch_folder(f"{root}/placed", number))

    run(placed.unionByName(undated), handle, root, mode="update")
    return latest_places(spark.read.parquet(f"{root}/placed"), days, high)


def latest_places(written: DataFrame, days: int = 7, high: int = 30) -> DataFrame:
    """The newest place of every message, undated ones behind the others, with the pause before it."""
    newest = written.groupBy("thread_key", "message_id").agg(F.max(F.struct("batch", "at", "position", "after_id", "after_at")).alias("m"))
    rows = newest.select("thread_key", "message_id", "m.*")
    dated = rows.filter("at IS NOT NULL")
    ends = dated.groupBy("thread_key").agg(F.max("position").alias("_dated"))
    by_id = Window.partitionBy("thread_key").orderBy("message_id")
    undated = rows.filter("at IS NULL").withColumn("_r", F.row_number().over(by_id)).join(ends, "thread_key", "left").withColumn(
        "position", (F.coalesce("_dated", F.lit(0)) + F.col("_r")).cast("long"))
    whole = dated.unionByName(undated.select(*dated.columns))
    pause = F.col("at") - F.col("after_at")
    gap = F.when(pause > days * DAY, F.floor(pause / DAY).cast("long"))
    return whole.select("thread_key", "message_id", F.timestamp_micros("at").alias("sent_at"), "position", "after_id", gap.alias("gap_days"),
                        F.when(gap > high, "high").when(gap.isNotNull(), "medium").alias("severity"))
