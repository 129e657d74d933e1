"""Incremental jobs. Each arriving batch is handled as a whole and written under its own batch id.

Writing a batch overwrites only its own folder, so a batch that is retried
after a failure leaves no second copy. Progress is kept below the job's root, so a
job that is started again on its root goes on behind the last batch, also when the files it
read are gone by then. Rows later than the watermark of one
day are dropped where a job keeps windows or keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.operators.blocking import placeholder_candidates
from caseloom.operators.diff import removed
from caseloom.operators.windows import gaps

BUCKETS = 64


def read_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Parquet arrivals; times without zone become timestamps, which watermarks need."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # as a pattern the path may name a folder of files or one file
    df = reader.parquet(f"{path[:-1]}[{path[-1]}]")
    for field in schema.fields:
        if field.dataType.simpleString() == "timestamp_ntz":
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return df


def run(df: DataFrame, handle: Callable[[DataFrame, int], None], root: str, mode: str = "append") -> None:
    """Process everything new that is available, batch by batch, and stop."""
    query = (
        df.writeStream.outputMode(mode).foreachBatch(handle)
        .option("checkpointLocation", f"{root}/_progress").trigger(availableNow=True).start()
    )
    query.awaitTermination()


def batch_folder(root: str, batch: int) -> str:
    return f"{root}/batch={batch}"


def stream_threads(messages: DataFrame, root: str, days: int = 7) -> DataFrame:
    """Gaps of every thread, re-checked for the threads that each batch touches.

    ``messages`` is a stream of (thread_id, message_id, sent_at). The store is
    laid out by a hash bucket of the thread: a batch reads back only the
    buckets it touches. The result keeps each thread's newest check.
    """
    spark = messages.sparkSession
    store, checks = f"{root}/store", f"{root}/checks"
    bucket = F.pmod(F.xxhash64("thread_id"), F.lit(BUCKETS)).cast("int")

    def handle(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        batch.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(batch_folder(store, number))
        arrived = session.read.parquet(batch_folder(store, number))
        touched = arrived.select("thread_id").distinct()
        hit = [r["bucket"] for r in arrived.select("bucket").distinct().collect()]  # at most BUCKETS values
        history = session.read.parquet(store).filter(F.col("batch") <= number).filter(F.col("bucket").isin(hit))
        now = history.join(touched, "thread_id", "left_semi").select("thread_id", "message_id", "sent_at")
        found = gaps(now.dropDuplicates(["thread_id", "message_id"]), days)
        touched.join(found, "thread_id", "left").write.mode("overwrite").parquet(batch_folder(checks, number))

    run(messages.select("thread_id", "message_id", "sent_at"), handle, root)
    checked = spark.read.parquet(checks)
    newest = checked.groupBy("thread_id").agg(F.max("batch").alias("batch"))
    return checked.join(newest, ["thread_id", "batch"]).filter(F.col("after_id").isNotNull()).drop("batch")


def stream_candidates(documents: DataFrame, entities: DataFrame, root: str, threshold: float = 0.5, protected: DataFrame | None = None) -> DataFrame:
    """New documents against the names in wait, protected ones left out: (context_id, entity_id, score)."""

    def handle(batch: DataFrame, number: int) -> None:
        batch.persist()
        placeholder_candidates(batch, entities, threshold, protected).write.mode("overwrite").parquet(batch_folder(root, number))
        batch.unpersist()

    run(documents, handle, root)
    return documents.sparkSession.read.parquet(root).drop("batch")


def stream_removed(known: DataFrame, current: DataFrame, root: str, once: tuple[str, ...] = ("url",)) -> DataFrame:
    """(page_id, url) whose address is missing from the current listing, each as it was first recorded.

    ``once`` names the columns of which one record is kept: the address alone, or with it the page, so that pages of one
    address stay apart. A batch writes what it finds and reads no earlier batch; repeats are resolved by the reader.
    Records without an address are not looked for.
    """
    spark = known.sparkSession
    schema = "page_id bigint, url string"

    def handle(batch: DataFrame, number: int) -> None:
        gone = removed(batch.filter(F.col("url").isNotNull()).groupBy(*once).agg(F.min("page_id").alias("_p")), current)
        gone.select(F.col("_p").alias("page_id"), "url").write.mode("overwrite").parquet(batch_folder(root, number))

    run(known, handle, root)
    recorded = spark.read.schema(schema + ", batch int").parquet(root)
    first = recorded.groupBy(*once).agg(F.min(F.struct("batch", F.col("page_id").alias("p"))).alias("m"))
    return first.select(F.col("m.p").alias("page_id"), "url")


def stream_activity(events: DataFrame, key: str, at: str, root: str) -> DataFrame:
    """Events per key and day, kept up to date; months are added up from the days by the reader."""
    daily = events.withWatermark(at, "1 day").groupBy(key, F.window(at, "1 day")).agg(F.count(F.lit(1)).alias("n"))

    def handle(batch: DataFrame, number: int) -> None:
        batch.select(key, F.col("window.start").alias("day"), "n").write.mode("overwrite").parquet(batch_folder(root, number))

    run(daily, handle, root, mode="update")
    counts = events.sparkSession.read.parquet(root)
    latest = counts.groupBy(key, "day").agg(F.max(F.struct("batch", "n")).alias("m"))
    return latest.select(key, "day", F.col("m.n").alias("n"))


def months_of(daily: DataFrame, key: str) -> DataFrame:
    return daily.groupBy(key, F.date_format("day", "yyyy-MM").alias("month")).agg(F.sum("n").alias("n"))


def stream_months(events: DataFrame, key: str, at: str, root: str) -> DataFrame:
    """(key, month, n): events per key and month, of all batches so far.

    Each batch adds the counts of its own rows, so no batch reads an earlier one, no state is kept and no row is too late; counts of the same month are
    added up by the reader, combined before they are shuffled.
    """

    def handle(batch: DataFrame, number: int) -> None:
        month = F.date_format(at, "yyyy-MM").alias("month")
        added = batch.filter(F.col(at).isNotNull()).groupBy(key, month).agg(F.count(F.lit(1)).alias("n"))
        added.write.mode("overwrite").parquet(batch_folder(f"{root}/months", number))

    run(events.select(key, at), handle, root)
    return events.sparkSession.read.parquet(f"{root}/months").groupBy(key, "month").agg(F.sum("n").alias("n"))


def stream_dedup(events: DataFrame, keys: list[str], at: str, root: str) -> DataFrame:
    """First arrival of each key; repeats within a day of it are dropped."""
    once = events.withWatermark(at, "1 day").dropDuplicatesWithinWatermark(keys)

    def handle(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(batch_folder(root, number))

    run(once, handle, root)
    return events.sparkSession.read.parquet(root).drop("batch")
