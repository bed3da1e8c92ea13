"""Micro-batches written once, whatever happens: a folder per batch, and a manifest of those that are whole."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructType

BATCH = "batch_id"
MANIFEST = "_manifest"
MANIFEST_SCHEMA = f"counter bigint, {BATCH} bigint"


def run_batches(
    df: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], available_now: bool = False, mode: str = "append"
) -> StreamingQuery:
    """Give each micro-batch with its number to ``handle``; a batch may come again with the same number."""
    writer = df.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def put_batch(
    rows: DataFrame, path: str, batch_id: int, by: Sequence[str] = (), fmt: str = "parquet", counter: int | None = None
) -> None:
    """Write the rows of a batch to a folder of its own, then its line of the manifest.

    Both are overwritten if the batch comes again, so nothing is added twice; readers see a batch once its
    line is there. ``counter`` is a number kept with the batch.
    """
    rows.write.mode("overwrite").format(fmt).partitionBy(*by).save(f"{path}/{BATCH}={batch_id}")
    line = rows.sparkSession.createDataFrame([(counter,)], "counter bigint")
    line.coalesce(1).write.mode("overwrite").parquet(f"{path}/{MANIFEST}/{BATCH}={batch_id}")


def manifest(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """(counter, batch_id) of the whole batches, of those before a number if it is given."""
    folder = f"{path}/{MANIFEST}"
    found = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found):
        return spark.createDataFrame([], MANIFEST_SCHEMA)
    lines = spark.read.schema(MANIFEST_SCHEMA).parquet(folder)
    return lines if before is None else lines.where(F.col(BATCH) < before)


def read_batches(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet", before: int | None = None) -> DataFrame:
    """The rows of the whole batches with their ``batch_id``, of those before a number if it is given.

    ``schema`` is that of the rows, the columns they are laid out by included.
    """
    whole = manifest(spark, path, before)
    if whole.isEmpty():
        empty = spark.createDataFrame([], schema)
        return empty.withColumn(BATCH, F.lit(None).cast("bigint"))
    typed = spark.createDataFrame([], schema).schema.add(BATCH, LongType())
    rows = spark.read.schema(typed).format(fmt).load(path)
    rows = rows if before is None else rows.where(F.col(BATCH) < before)
    # one short line per batch
    return rows.join(F.broadcast(whole.select(BATCH)), BATCH, "left_semi").select(*typed.names)
