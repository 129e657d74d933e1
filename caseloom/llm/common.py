"""Session helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.session import cut

__all__ = ["bounded_sample", "cut", "fold", "row_key", "short_batches", "table", "with_fields"]


#: Values of a stratum whose counts are sent to the tasks.
MOST_STRATA = 10_000


#: Rows of an Arrow batch; texts are long, and a batch is held in a task's memory on both sides.
BATCH_ROWS = 1_000


def short_batches(spark: SparkSession) -> None:
    """Job setting of the queries and the pipeline: Arrow batches of at most ``BATCH_ROWS`` rows in this session."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit("")).cast("binary")) % n


def row_key(*columns: str) -> Column:
    """64-bit key of a row's content. Rows of equal content share it, and share their result."""
    return F.xxhash64(*(F.col(c) for c in columns), *(F.col(c).isNull() for c in columns))


def bounded_sample(rows: DataFrame, stratum: str, order: Column, bound: int) -> DataFrame:
    """At most ``bound`` rows of each value of ``stratum``, those of the lowest ``order`` (a 64-bit hash).

    Counts give each stratum a hash threshold that lets about 1.3 times the bound pass, so that the
    exact ranking sees a bounded number of rows per value, however large a value is.
    """
    from pyspark.sql import Window

    marked = rows.withColumn("_h", F.pmod(order, F.lit(1 << 40)))
    counts = cut(rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n")), "strata")
    if counts.count() <= MOST_STRATA:
        counts = F.broadcast(counts)  # so that rows are thinned out where they are read
    share = F.lit(float(1 << 40)) * (1.3 * bound + 50) / F.col("_n")
    passed = marked.join(counts, stratum).filter(F.col("_h") < share)
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy("_h"))
    return passed.withColumn("_r", rank).filter(F.col("_r") <= bound).drop("_h", "_n", "_r")


def with_fields(schema: T.StructType, **kinds: str) -> T.StructType:
    """``schema`` and further fields, given as name=type."""
    return T.StructType([*schema.fields, *T._parse_datatype_string(", ".join(f"{n} {k}" for n, k in kinds.items())).fields])
