"""Settings files: ``[export ]KEY=VALUE`` lines of many files, in file and line order."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tollbridge.operators.attach import fits_broadcast

# The form of an assignment, and of a value with or without quotes.
ASSIGNMENT = r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_.-]*)=(.*)$"
DOUBLE_QUOTED = r'^\s*"((?:[^"\\]|\\.)*)"\s*(?:#.*)?$'
SINGLE_QUOTED = r"^\s*'([^']*)'\s*(?:#.*)?$"
COMMENT_TAIL = r"(?:^|\s+)#.*$|\s+$"

# Folders that are listed one by one; more are read through the folder above them.
MAX_FOLDERS = 1_000


def read_assignments(spark: SparkSession, layers: DataFrame, root: str | None = None) -> DataFrame:
    """assignments(env_id, ord, key, raw, quote) of the files in layers(env_id, layer_ord, path).

    A file may belong to several environments. ``root`` is a folder or glob holding the files;
    without it the folders of the paths in ``layers`` are read. ``ord`` grows with the layer, then
    the file's path, then the line; it is unique in an environment, whatever the layer numbers.
    """
    roots = root if root is not None else _folders(layers)
    lines = read_setting_lines(spark, roots)
    wanted = _with_starts(layers, _sizes(spark, roots))
    # Every environment may name the same file: a small list of files is broadcast, otherwise the
    # environments of a file are spread over many tasks.
    if fits_broadcast(wanted):
        met = lines.join(F.broadcast(wanted), "_place")
    else:
        met = _spread_join(lines, wanted)
    return met.select("env_id", (F.col("_first") + F.col("position")).alias("ord"), "key", "raw", "quote")


def _sizes(spark: SparkSession, roots: str | list[str]) -> DataFrame:
    """(_place, size) of each file; the contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots)
    located = files.select(F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_size").alias("size"))
    return located.select(_place("_path").alias("_place"), "size")


def _with_starts(layers: DataFrame, sizes: DataFrame) -> DataFrame:
    """(env_id, _place, _first): what an environment's earlier layers hold at most, so that the
    positions in this file, which are no greater than its bytes and one, follow theirs."""
    named = layers.select("env_id", "layer_ord", "path", _place("path").alias("_place")).distinct()
    placed = named.join(sizes, "_place")
    earlier = Window.partitionBy("env_id").orderBy("layer_ord", "path").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum(F.col("size") + 2).over(earlier), F.lit(0))
    return placed.select("env_id", "layer_ord", "_place", first.alias("_first"))


def _folders(layers: DataFrame) -> list[str]:
    """The folders of the files, or if they are very many the one folder that holds them all; other files
    in them fall away in the join."""
    folders = layers.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder")).distinct()
    few = [r["folder"] for r in folders.limit(MAX_FOLDERS + 1).collect()]
    if len(few) <= MAX_FOLDERS:
        return few
    # What the first and the last have in common, all have.
    return [os.path.commonpath(folders.agg(F.min("folder"), F.max("folder")).first())]


def read_setting_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(_place, position, key, raw, quote) of every assignment line; others hold no setting.

    Files are read line by line and may be split. Within a split, rows come in line order; the
    position is the start of the split plus the rank there, so it grows over the whole file.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    scanned = reader.text(paths).select(
        "value",
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_seen"),
    )
    kept = scanned.filter(F.col("value").rlike(ASSIGNMENT))
    within_split = Window.partitionBy("_path", "_start").orderBy("_seen")
    text = F.regexp_extract("value", ASSIGNMENT, 2)
    quote = F.when(text.rlike(DOUBLE_QUOTED), '"').when(text.rlike(SINGLE_QUOTED), "'").otherwise("")
    raw = (
        F.when(text.rlike(DOUBLE_QUOTED), F.regexp_extract(text, DOUBLE_QUOTED, 1))
        .when(text.rlike(SINGLE_QUOTED), F.regexp_extract(text, SINGLE_QUOTED, 1))
        .otherwise(F.regexp_replace(text, COMMENT_TAIL, ""))
    )
    return kept.select(
        _place("_path").alias("_place"),
        (F.col("_start") + F.row_number().over(within_split)).alias("position"),
        F.regexp_extract("value", ASSIGNMENT, 1).alias("key"),
        raw.alias("raw"),
        quote.alias("quote"),
    )


def _place(path_col: str):
    """A path without scheme and host, so that plain paths and URIs of one file agree. Only a
    URI is percent-decoded; a plus sign in it stands for itself."""
    scheme = "^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?(?=/)"
    path = F.col(path_col)
    bare = F.replace(F.regexp_replace(path, scheme, ""), F.lit("+"), F.lit("%2B"))
    return F.when(path.rlike(scheme), F.try_url_decode(bare)).otherwise(path)


def _spread_join(lines: DataFrame, wanted: DataFrame, salts: int = 32) -> DataFrame:
    salt = F.pmod(F.xxhash64("env_id", "layer_ord"), F.lit(salts)).cast("int")
    repeated = lines.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return repeated.join(wanted.withColumn("_salt", salt), ["_place", "_salt"])
