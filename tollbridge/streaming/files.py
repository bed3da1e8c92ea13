"""File streams: the same functions as on a batch, fed by the files that arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tollbridge.session import fresh_folder


def stream_files(
    spark: SparkSession, folder: str, schema: StructType, fmt: str = "parquet", only: str | None = None,
    files_per_batch: int | None = None,
) -> DataFrame:
    """Rows of the files in ``folder`` (those whose name matches ``only``), as they arrive."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return (reader.option("pathGlobFilter", only) if only else reader).load(folder)


def append_stream(
    df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", available_now: bool = False
) -> StreamingQuery:
    """Append a stream to files; ``available_now`` takes what is there and ends."""
    writer = df.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start(path)


def drain(df: DataFrame, label: str = "stream") -> DataFrame:
    """Run a stateless stream over everything present and give the rows it wrote."""
    spark = df.sparkSession
    out, checkpoint = fresh_folder(spark, label), fresh_folder(spark, f"{label}-checkpoint")
    append_stream(df, out, checkpoint, available_now=True).awaitTermination()
    return spark.read.schema(df.schema).parquet(out)
