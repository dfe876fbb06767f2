"""What several operators of this package need: table reads, text in SQL, ordered buckets, intermediate tables."""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.session import ship_packages

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A run of characters that are no white space.
BLANKS_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table; Python workers get this package first."""
    ship_packages(spark, ROOT)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``, which driver and executors share.

    A local session without that setting gets one of its own; a cluster without it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        folder = "file://" + tempfile.mkdtemp(prefix="mnemospark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read back, so that readers and retries do not compute them again."""
    path = shared_path(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, nothing else. ``lower`` is much faster and does the same to pure ASCII."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def unique_name(taken: Sequence[str], name: str) -> str:
    """``name``, with underscores in front until no column is called so (case aside)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = "_" + name
    return name


def in_order_buckets(docs: DataFrame, id_col: str, bucket: str, buckets: int | None = None) -> tuple[DataFrame, list]:
    """Number the rows' ranges of ``id_col`` from 0 (the smallest ids) into the new column ``bucket``.

    The bounds are approximate quantiles of the id column alone, so no text is read for them and a bucket holds about
    the same number of rows. A NULL id counts as smaller than any. Returns the rows and the bounds (at most ``buckets``).
    """
    n = buckets or max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = docs.agg(F.percentile_approx(id_col, F.array([F.lit(i / n) for i in range(1, n)]), 10_000)).first()[0]
    bounds = sorted(set(cuts or []))
    if not bounds:
        return docs.withColumn(bucket, F.lit(0)), []
    # The ranges as one literal array: the number of bounds that are at most the id, counted.
    place = F.size(F.filter(F.array([F.lit(b) for b in bounds]), lambda b: b <= F.col(id_col)))
    return docs.withColumn(bucket, F.when(F.col(id_col).isNull(), F.lit(0)).otherwise(place)), bounds
