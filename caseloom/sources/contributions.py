"""Tables of contributions that a new run of their owner replaces.

An owner (a document, a detector) adds rows to several tables at once. When it is run again, what it added before goes and the new rows take its place,
in every table, also in those to which it adds nothing now; the rows of other owners stay. Writing is an append: a batch of
rows below its own number, then the list of its owners, which makes the batch count. A batch that broke off before is never read and its
number is taken again. Readers keep, of each owner, the rows of its newest batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Contributions:
    """A folder of tables; ``owner`` is the column that tells whose a row is, of the SQL type ``kind``."""

    def __init__(self, spark: SparkSession, root: str, owner: str, kind: str = "long"):
        self.spark, self.root, self.owner = spark, root.rstrip("/"), owner
        self.owned = T._parse_datatype_string(f"{owner} {kind}")

    def _owners(self) -> DataFrame:
        schema = T.StructType([*self.owned.fields, T.StructField("batch", T.LongType())])
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/_owners")
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/_owners")

    def last_batch(self) -> int:
        return self._owners().agg(F.max("batch")).first()[0] or 0

    def replace(self, owners: DataFrame, tables: dict[str, DataFrame]) -> int:
        """Put ``tables`` in place of all that ``owners`` added before; returns the number of the batch."""
        batch = self.last_batch() + 1
        for name, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{self.root}/{name}/batch={batch}")
        owners.select(self.owner).distinct().withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(
            f"{self.root}/_owners/number={batch}")
        return batch

    def read(self, name: str) -> DataFrame:
        """The rows of table ``name`` that count now."""
        newest = self._owners().groupBy(self.owner).agg(F.max("batch").alias("batch"))
        rows = self.spark.read.parquet(f"{self.root}/{name}").withColumn("batch", F.col("batch").cast("long"))
        return rows.filter(F.col("batch") <= self.last_batch()).join(newest, [self.owner, "batch"], "left_semi").drop("batch")

    def compact(self, names: list[str]) -> int:
        """Write what counts now as one batch of all owners; older batches are no longer read."""
        owners = self._owners().select(self.owner).distinct()
        return self.replace(owners, {name: self.read(name) for name in names})
