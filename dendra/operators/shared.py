"""Intermediate results in the shared folder, and running sums within groups of any size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; without it a local session takes a temporary one, on a cluster it is an error.

    Files of checkpoints that nothing uses any more are deleted.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="dendra-"))
    context._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    return context._jsc.sc().getCheckpointDir().get()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def deleted(spark: SparkSession, path: str) -> None:
    """Deletes what new_folder() has named."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def parquet_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at path, or no rows if nothing was written there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def cut(df: DataFrame) -> DataFrame:
    """df written to the session's shared checkpoint folder, so that a plan doesn't grow and a lost executor repeats little."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Bytes of a batch of rows that a Python worker is sent.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's limit on the bytes of an Arrow batch to BATCH_BYTES, so that long texts don't add up in a Python worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def running(items: DataFrame, key: str, order: list[tuple[str, bool]], weight: Column, use: Callable[[Column, Column], dict[str, Column]], keep: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """items with the columns that use(before, total) names, from the sums of weight over the earlier rows of the key and over all of them.

    order: (column, whether it falls). keep(before, total) tells which rows stay. Null weights count as 0; a null key is a group; equal rows have some fixed order.

    The rows are written to the checkpoint folder once. Only their numbers, keys, orders and weights are dealt to ranges of (key, order), so a key with a large share of the
    rows is spread over many tasks: a window sums within (key, range), another adds up the earlier ranges' sums, one row for each. What stays meets its row by its number.
    """
    number = unused(items, "number")
    base = cut(items.withColumn(number, F.monotonically_increasing_id()))
    names = [f"o{i}" for i in range(len(order))]
    by = [F.desc(n) if falls else F.asc(n) for n, (_, falls) in zip(names, order)]
    narrow = base.select(F.col(number).alias("number"), F.col(key).alias("key"), *[F.col(c).alias(n) for n, (c, _) in zip(names, order)], F.coalesce(weight.cast("long"), F.lit(0)).alias("weight"))
    rows = cut(narrow.repartitionByRange(F.col("key"), *by, F.col("number")).withColumn("at", F.spark_partition_id()))
    group = Window.partitionBy("key")
    earlier = F.sum("sum").over(group.orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    sums = rows.groupBy("key", "at").agg(F.sum("weight").alias("sum")).select("key", "at", F.coalesce(earlier, F.lit(0)).alias("offset"), F.sum("sum").over(group).alias("total"))
    inside = F.sum("weight").over(Window.partitionBy("key", "at").orderBy(*by, "number").rowsBetween(Window.unboundedPreceding, -1))
    rows, sums = rows.withColumn("inside", F.coalesce(inside, F.lit(0))).alias("r"), sums.alias("s")
    found = rows.join(sums, (F.col("r.at") == F.col("s.at")) & F.col("r.key").eqNullSafe(F.col("s.key")))
    found = found.select("number", (F.col("offset") + F.col("inside")).alias("before"), "total")
    before, total = F.col("before"), F.col("total")
    found = found if keep is None else found.where(keep(before, total))
    made = use(before, total)
    found = found.select(F.col("number").alias(number), *[c.alias(n) for n, c in made.items()])
    return base.drop(*made).join(found, number).drop(number)
