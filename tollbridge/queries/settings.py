"""Settings composed from ``events``: overlays, references, and whole files of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tollbridge.operators.settings import overlay_layers, resolve_refs
from tollbridge.plans.settings import load_settings
from tollbridge.queries.registry import query, table
from tollbridge.session import fresh_folder
from tollbridge.streaming.files import stream_files
from tollbridge.streaming.settings import read_overlay, stream_overlay

NUMBER = r"\d+"


LAST_SQL = "SELECT event_type AS env_id, 'U' || user_id AS key, arg_max(props, event_id) AS value FROM events GROUP BY ALL"


def event_settings(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_type").alias("env_id"),
        F.col("event_id").alias("ord"),
        F.concat(F.lit("U"), "user_id").alias("key"),
        F.col("props").alias("raw"),
    )


@query(LAST_SQL)
def last_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay_layers(event_settings(table(spark, sf_dir, "events")))


@query(LAST_SQL)
def last_settings_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same kept up to date from a stream of four files, the latest lines in any of them."""
    events, parts = table(spark, sf_dir, "events"), fresh_folder(spark, "events")
    events.repartition(4, "event_id").write.parquet(parts)
    stream = event_settings(stream_files(spark, parts, events.schema, files_per_batch=1))
    folder, checkpoint = fresh_folder(spark, "settings"), fresh_folder(spark, "settings-checkpoint")
    stream_overlay(stream, folder, checkpoint, available_now=True).awaitTermination()
    return read_overlay(spark, folder)


@query("""
    WITH lines AS (SELECT event_id, event_type, user_id, event_id % 4 AS kind, regexp_extract(props, '\\d+') AS k FROM events),
    bases AS (SELECT *, coalesce(last_value(CASE kind WHEN 0 THEN k END IGNORE NULLS) OVER earlier, '') AS b
              FROM lines WINDOW earlier AS (PARTITION BY event_type, user_id ORDER BY event_id
                                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    middles AS (SELECT *, last_value(CASE kind WHEN 1 THEN b || '/m' END IGNORE NULLS) OVER earlier AS m,
                       last_value(CASE kind WHEN 2 THEN CAST(coalesce(try_cast(b AS BIGINT), 0) + 200 AS VARCHAR) END
                                  IGNORE NULLS) OVER earlier AS t
                FROM bases WINDOW earlier AS (PARTITION BY event_type, user_id ORDER BY event_id
                                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT event_type AS env_id, event_id AS ord, CASE kind
        WHEN 0 THEN k WHEN 1 THEN b || '/m' WHEN 2 THEN CAST(coalesce(try_cast(b AS BIGINT), 0) + 200 AS VARCHAR)
        ELSE coalesce(m, '') || ':' || coalesce(t, '') || ':/h' END AS value
    FROM middles
""")
def resolved_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth event sets a base, the others build on it, two references deep."""
    user = F.col("user_id").cast("string")
    kinds = {
        0: ("B", F.regexp_extract("props", NUMBER, 0)),
        1: ("M", F.concat(F.lit('"${B'), user, F.lit('}/m"'))),
        2: ("T", F.concat(F.lit("$((${B"), user, F.lit("} + 200))"))),
        3: ("Z", F.concat(F.lit("${M"), user, F.lit("}:${T"), user, F.lit("}:${HOME_DIR}"))),
    }
    kind = F.col("event_id") % 4
    pick = [F.when(kind == n, F.struct(F.concat(F.lit(k), user).alias("key"), v.alias("raw"))) for n, (k, v) in kinds.items()]
    lines = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("env_id"), F.col("event_id").alias("ord"), F.coalesce(*pick).alias("line")
    )
    assignments = lines.select("env_id", "ord", "line.key", "line.raw")
    return resolve_refs(assignments, {"HOME_DIR": "/h"}).select("env_id", "ord", "value")


@query("""
    SELECT event_id AS ord, CAST(sum(CAST(regexp_extract(props, '\\d+') AS BIGINT))
           OVER (PARTITION BY user_id ORDER BY event_id) AS VARCHAR) AS value FROM events
""")
def counted_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event adds to the value its user's setting had before: one chain per user."""
    assignments = table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), "user_id").alias("env_id"),
        F.col("event_id").alias("ord"),
        F.lit("N").alias("key"),
        F.concat(F.lit("$((${N} + "), F.regexp_extract("props", NUMBER, 0), F.lit("))")).alias("raw"),
    )
    return resolve_refs(assignments).select("ord", "value")


@query("""
    WITH lines AS (SELECT 'U' || user_id AS key, event_type, event_id, regexp_extract(props, '\\d+') AS k FROM events),
    bases AS (SELECT key, arg_max('v' || k, (event_type, event_id)) AS base FROM lines WHERE event_type <> 'view' GROUP BY 1),
    views AS (SELECT key, repeat('+', count(*)) AS marks FROM lines WHERE event_type = 'view' GROUP BY 1)
    SELECT 'all' AS env_id, key, coalesce(base, '') || coalesce(marks, '') AS value FROM bases FULL JOIN views USING (key)
""")
def settings_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings written as text files, one layer per file in the order of the event types, then
    loaded; views add a mark to the value set before."""
    user = F.col("user_id").cast("string")
    value = F.when(F.col("event_type") == "view", F.concat(F.lit("${U"), user, F.lit("}+"))).otherwise(
        F.concat(F.lit("v"), F.regexp_extract("props", NUMBER, 0))
    )
    text = F.concat(F.lit("export U"), user, F.lit('="'), value, F.lit('"  # '), F.col("event_id"))
    folder = fresh_folder(spark, "settings")
    lines = table(spark, sf_dir, "events").select("event_type", "event_id", text.alias("value"))
    ordered = lines.repartitionByRange("event_type", "event_id").sortWithinPartitions("event_type", "event_id")
    ordered.select("event_type", "value").write.partitionBy("event_type").text(folder)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)  # the contents are not read
    files = listed.select(F.col("_metadata.file_path").alias("path"))
    kind = F.dense_rank().over(Window.orderBy("_type"))
    types = files.select(F.regexp_extract("path", "event_type=([^/]*)/", 1).alias("_type"), "path")
    kinds = types.select("_type").distinct().select("_type", kind.alias("kind"))
    part = F.regexp_extract("path", r"part-(\d+)-", 1).cast("bigint")
    # Each writer task wrote one range, and its number tells the order of the ranges.
    far = F.lit(1 << 40).cast("bigint")
    layers = types.join(kinds, "_type").select(F.lit("all").alias("env_id"), (F.col("kind") * far + part).alias("layer_ord"), "path")
    return load_settings(spark, layers, {}, folder)
