"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from contextvars import ContextVar
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

#: Spaces as the word rules of these operators see them: blank, tab, line feed, vertical tab, form feed, return.
SPACES = " \t\n\x0b\x0c\r"
BATCH_BYTES = 4 << 20
#: Tables of up to so many rows (about 60 bytes each) are broadcast; larger ones are joined by shuffling.
BROADCAST_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share.

    It is spark.checkpoint.dir of the session. Where that is unset a fresh temporary folder is taken, but only
    on a single machine; elsewhere that is an error. Files of checkpoints that no table needs any more are
    deleted, and so are shuffle files at the end of each query, so that long runs of loops don't fill the disks.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="dendra-"))
        context._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", True)
    return context._jsc.sc().getCheckpointDir().get()


#: Files of the checkpoints made in each settled() call that runs, the innermost last.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def checkpoint(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and cut its lineage there. settled() deletes the files, else Spark when df is no longer used."""
    shared_folder(df.sparkSession)
    made = df.checkpoint(eager=True)
    if _scopes.get():
        _scopes.get()[-1].append(made._jdf.queryExecution().logical().rdd().getCheckpointFile().get())
    return made


def settled(function, keep=checkpoint):
    """A function whose resulting DataFrames are written to the shared folder, by `keep`; all other checkpoints that it made are deleted as soon as they are."""

    @wraps(function)
    def run(*args, **options):
        made: list[str] = []
        outer = _scopes.get()
        inside = _scopes.set((*outer, made))
        try:
            found = function(*args, **options)
            _scopes.set(outer)  # results are the caller's to delete
            found = tuple(map(keep, found)) if isinstance(found, tuple) else keep(found)
        finally:
            _scopes.reset(inside)
            for path in made:
                _delete(path)
        return found

    return run


def _delete(path: str) -> None:
    context = SparkSession.active().sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: smaller than a checkpoint, and read by columns. See removed()."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Deletes the files of a table that written() has made; nothing may be left that reads it."""
    for file in df.inputFiles()[:1]:
        _delete(file.rpartition("/")[0])


def _size(lists: str | None) -> Column:
    return F.count("*") if lists is None else F.coalesce(F.sum(F.size(lists)), F.lit(0))


def small(df: DataFrame, lists: str | None = None) -> DataFrame:
    """df, broadcast if it is small; its size is its rows, or the entries of the array column `lists`."""
    return F.broadcast(df) if df.agg(_size(lists)).first()[0] <= BROADCAST_ROWS else df


def small_checkpoint(df: DataFrame, lists: str | None = None) -> DataFrame:
    """small(checkpoint(df)), its size seen while it is written instead of by a job of its own."""
    seen = Observation()
    made = checkpoint(df.observe(seen, _size(lists).alias("size")))
    return F.broadcast(made) if seen.get["size"] <= BROADCAST_ROWS else made


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without_ids(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is in the only column of `gone`; rows without a doc_id stay."""
    name = unused(docs, "gone")
    return docs.join(gone.toDF(name).where(F.col(name).isNotNull()).distinct(), F.col("doc_id") == F.col(name), "left_anti")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's limit on the bytes of an Arrow batch to BATCH_BYTES, so that long texts don't add up in a Python worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)


def texts_of(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id long, text string), to be read by Python in bounded batches."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))


def texts_with(docs: DataFrame, lists: DataFrame, name: str) -> DataFrame:
    """(doc_id, text, `name`) of the documents of lists (doc_id, `name`), an array. If their ids are few, other texts aren't shuffled."""
    seen = Observation()
    lists = checkpoint(lists.observe(seen, _size(name).alias("size"), F.count("*").alias("rows")))
    texts = texts_of(docs)
    if seen.get["size"] <= BROADCAST_ROWS:
        lists = F.broadcast(lists)
    elif seen.get["rows"] <= BROADCAST_ROWS:
        texts = texts.join(F.broadcast(lists.select("doc_id")), "doc_id", "left_semi")
    return texts.join(lists, "doc_id").select("doc_id", "text", name)


def give_back_memory() -> None:
    """Returns what a Python worker has freed to the system; workers are kept for later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def arrow_map(df: DataFrame, function, schema: str) -> DataFrame:
    """df.mapInArrow that gives memory back at the end of each task."""

    def run(batches):
        yield from function(batches)
        give_back_memory()

    return df.mapInArrow(run, schema)


def chunks(batches, rows: int = 2048):
    """Split Arrow record batches so that no Python step holds more than `rows` rows at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
