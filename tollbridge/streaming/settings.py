"""The last assignment of every key, kept up to date from a stream of settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tollbridge.streaming.batches import put_batch, read_batches, run_batches

SCHEMA = "env_id string, key string, value string, ord bigint"


def stream_overlay(assignments: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Keep the value of the highest ``ord`` of each key of a stream of assignments(env_id, ord, key, value or raw).

    The state has a row per key: the highest ord so far and its value, so a late line with a lower ord
    changes nothing. Each batch writes the keys it has touched; a batch that comes again writes the same.
    """
    value = "value" if "value" in assignments.columns else "raw"
    line = F.struct("ord", F.col(value).alias("value"))
    last = assignments.groupBy("env_id", "key").agg(F.max(line).alias("last")).select("env_id", "key", "last.value", "last.ord")
    return run_batches(last, checkpoint, lambda rows, n: put_batch(rows, path, n), available_now, mode="update")


def read_overlay(spark: SparkSession, path: str) -> DataFrame:
    """(env_id, key, value) as of the last whole batch."""
    touched = read_batches(spark, path, SCHEMA)
    return touched.groupBy("env_id", "key").agg(F.max_by("value", F.col("batch_id")).alias("value"))
