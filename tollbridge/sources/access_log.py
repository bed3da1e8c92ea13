"""Access-log lines: reading, parsing, and writing one log per service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tollbridge.functions.rules import truthy
from tollbridge.streaming.batches import BATCH, put_batch, read_batches, run_batches

# The nine fields of a line, in order; the last one may be missing.
FIELDS = [
    "remote_addr", "remote_user", "time_local", "request", "status",
    "body_bytes_sent", "referer", "user_agent", "forwarded_for",
]
LINE = (
    r'^(\S+) - (\S+) \[([^\]\n]+)\] "([^"\n]*)" (\d{3}) (\d+|-) "([^"\n]*)" "([^"\n]*)"'
    r'(?: "([^"\n]*)")?[ \t\r]*$'
)
TIME_FORMAT = "dd/MMM/yyyy:HH:mm:ss Z"

def parse_access_log(df: DataFrame, line_col: str = "value") -> DataFrame:
    """Replace a line column by its typed fields; lines of another shape get ``malformed=true``.

    The regex runs once per line: it rewrites the line with a newline between the fields, which
    no line can hold itself, and the split text is shared by all nine fields.
    """
    line = F.col(line_col)
    fields = F.split(F.regexp_replace(line, LINE, "\n".join(f"${n + 1}" for n in range(9))), "\n")
    split = df.withColumn("_parts", F.when(~line.contains("\n"), fields))
    shaped = split.withColumn("_parts", F.when(F.size("_parts") == 9, F.col("_parts")))

    def field(name: str) -> Column:
        text = F.get(F.col("_parts"), F.lit(FIELDS.index(name)))
        return F.when(~text.isin("", "-"), text)

    return shaped.select(
        *[c for c in df.columns if c != line_col],
        field("remote_addr").alias("remote_addr"),
        field("remote_user").alias("remote_user"),
        F.try_to_timestamp(field("time_local"), F.lit(TIME_FORMAT)).alias("time_local"),
        field("request").alias("request"),
        field("status").try_cast("int").alias("status"),
        field("body_bytes_sent").try_cast("bigint").alias("body_bytes_sent"),
        field("referer").alias("referer"),
        field("user_agent").alias("user_agent"),
        field("forwarded_for").alias("forwarded_for"),
        F.col("_parts").isNull().alias("malformed"),
    )


def read_access_log(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Parsed log lines of the files under ``path``, as a batch or as a stream of new files."""
    reader = spark.readStream if streaming else spark.read
    return parse_access_log(reader.text(path), "value")


def write_split_log(
    df: DataFrame,
    path: str,
    service_col: str,
    loggable_col: str | None,
    checkpoint: str | None = None,
    available_now: bool = False,
    fmt: str = "parquet",
) -> StreamingQuery | None:
    """Append each kept row to the folder of its own service; ``loggable_col=None`` keeps all.

    A batch is rebalanced on the service first: a busy service is split over several files of
    even size and the quiet ones do not leave one tiny file per task. A stream is written as it
    comes and needs a ``checkpoint`` folder.
    """
    kept = df if loggable_col is None else df.filter(truthy(df, loggable_col))
    if not df.isStreaming:
        kept.hint("rebalance", service_col).write.partitionBy(service_col).mode("append").format(fmt).save(path)
        return None
    if checkpoint is None:
        raise ValueError("a streaming log needs a checkpoint folder")
    writer = (
        kept.writeStream.partitionBy(service_col)
        .format(fmt)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start(path)


def write_split_batches(
    stream: DataFrame,
    path: str,
    service_col: str,
    loggable_col: str | None,
    checkpoint: str,
    available_now: bool = False,
    fmt: str = "parquet",
) -> StreamingQuery:
    """Split logs of a stream, a folder per batch and in it one per service, read by :func:`read_split_batches`.

    Each batch is rebalanced on the service, so a service has few files of even size in it, and is listed
    once it is whole; a batch that comes again adds nothing.
    """
    kept = stream if loggable_col is None else stream.filter(truthy(stream, loggable_col))

    def write(rows: DataFrame, batch_id: int) -> None:
        put_batch(rows.hint("rebalance", service_col), path, batch_id, [service_col], fmt)

    return run_batches(kept, checkpoint, write, available_now)


def read_split_batches(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet") -> DataFrame:
    """The rows that a stream has written to split logs, of whole batches only."""
    return read_batches(spark, path, schema, fmt).drop(BATCH)
