"""Runs that pick up where they stopped: each new file is read once, through the same batch functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def process_new(
    spark: SparkSession, source: str, schema: str, transform: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, source_format: str = "json", files_per_batch: int = 100
) -> StreamingQuery:
    """Applies transform to all files that earlier runs haven't seen, appends to a Parquet sink, and ends.

    The checkpoint folder takes the place of counters and result scans: a run that failed repeats its open
    batch, a finished batch is never repeated. transform may use any batch operator. Malformed rows of JSON and CSV
    are left out; their number is in the query's progress, as observedMetrics["read"] with `rows` and `malformed`.
    """
    mark = "_corrupt_record"
    marked = source_format in ("json", "csv")
    reader = spark.readStream.format(source_format).schema(f"{schema}, {mark} string" if marked else schema).option("maxFilesPerTrigger", files_per_batch)
    rows = reader.option("columnNameOfCorruptRecord", mark).load(source)
    bad = F.col(mark).isNotNull() if marked else F.lit(False)
    rows = rows.observe("read", F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("malformed"))
    rows = rows.where(~bad).drop(mark) if marked else rows

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
