"""A table kept as one folder of rows per micro-batch.

A batch writes only its own folder, and overwrites it if it runs again. It reads
only folders of earlier batches. So a batch that is retried after a loss leaves
the table as if it had run once, and nothing stored is rewritten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class DeltaLog:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        # An empty first folder, so that a read finds the table.
        empty = spark.createDataFrame([], schema)
        empty.write.mode("ignore").parquet(f"{self.path}/batch_id=-1")

    def write(self, rows: DataFrame, batch_id: int) -> None:
        rows.select(*self.schema.fieldNames()).write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}")

    def read(self, before: int | None = None) -> DataFrame:
        """All rows with their ``batch_id``; with ``before`` only those of earlier batches."""
        rows = self.spark.read.schema(self.schema).option("basePath", self.path).parquet(self.path)
        return rows if before is None else rows.filter(F.col("batch_id") < before)

    def batch(self, batch_id: int) -> DataFrame:
        return self.read().filter(F.col("batch_id") == batch_id)
