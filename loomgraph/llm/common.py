"""Shared plumbing: scratch tables in the shared folder, prefix sums, batch sizes."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows and bytes in an Arrow batch handed to Python: they bound a worker's memory, and the
#: JVM's off-heap memory, with long texts and wide rows.
ARROW_ROWS, ARROW_BYTES = 1000, 4 << 20
#: Bytes of a row group of scratch tables: a writer holds one, and a reader takes columns of one at a time.
ROW_GROUP = 16 << 20
#: A key that more than one row in SHARES holds is hot: there are fewer than SHARES of them.
SHARES = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, where all executors are this
    machine's, one of our own where it is unset."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='loomgraph-')}"
        sc.setCheckpointDir(root)
        root = sc.getCheckpointDir()
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def tuned(spark: SparkSession) -> None:
    """Session settings that the operators count on: bounded Arrow batches, and shuffle
    files that go when the query that wrote them ends."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder; a lost executor then
    costs a reread and no recomputation."""
    spark = df.sparkSession
    path = path or scratch(spark, name)
    schema = df.schema
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    del df
    gc.collect()
    return spark.read.schema(schema).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    """Delete a table of ``scratch`` that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]


def fold(n: int, unit: int, least: int = 1, most: int = 1 << 20) -> int:
    """Buckets so that each holds about ``unit`` of ``n``."""
    return max(least, min(most, -(-n // unit)))


def looked_up(rows: DataFrame, table: DataFrame, on: list[str], weight: str, inner: bool = False) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row for a key and, as ``weight``,
    how many of the rows hold it.

    Hot keys are looked up by a broadcast of fewer than SHARES rows, so that no task gathers
    the rows of one key; all others are joined by a shuffle.  Rows whose key is null meet
    nothing and are not shuffled.
    """
    total = table.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    hot = F.col(weight) * SHARES > total
    keyed = rows.where(" and ".join(f"`{c}` is not null" for c in on))
    out = keyed.join(F.broadcast(table.where(hot).drop(weight)), on)
    rest = keyed.join(F.broadcast(table.where(hot).select(*on)), on, "left_anti")
    out = out.unionByName(rest.join(table.where(~hot).drop(weight), on, "inner" if inner else "left"))
    return out if inner else out.unionByName(rows.where(" or ".join(f"`{c}` is null" for c in on)), allowMissingColumns=True)


def running_total(df: DataFrame, order: list[str], value: str | Column, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over all rows that come before in ``order``.

    Rows are range-partitioned and written; each part adds the total of the parts
    before it, so that no task sees more than one part's rows.
    """
    spark = df.sparkSession
    value = F.col(value) if isinstance(value, str) else value
    n = partitions(spark)
    ranged = df.repartitionByRange(n, *[F.col(c).asc_nulls_first() for c in order])
    placed = written(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_v", value), "ranged")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("_part").agg(F.sum("_v").alias("_sum"))
    parts = parts.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_part").orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.join(F.broadcast(parts), "_part")  # a row for each partition of the range exchange
        .withColumn(out, F.col("_base") + F.coalesce(F.sum("_v").over(inside), F.lit(0)))
        .drop("_part", "_v", "_base")
    )
