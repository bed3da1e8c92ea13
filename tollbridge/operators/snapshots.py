"""Snapshots stored in buckets with a digest each: two of them are compared by digests first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tollbridge.operators.ledgers import _comparable, diff_snapshots

BUCKETS = 256
BUCKET, HASHES = "_bucket", ("_hash_a", "_hash_b")


def _hash(df: DataFrame, columns: Sequence[str], seed: int) -> Column:
    """A hash that tells a null from any value and from a null in another column."""
    parts = [_comparable(c, df.schema[c].dataType) for c in columns]
    return F.xxhash64(F.lit(seed), *[p for part in parts for p in (part, part.isNull())])


def write_snapshot(df: DataFrame, path: str, keys: Sequence[str], buckets: int = BUCKETS) -> None:
    """Write a snapshot in buckets of its keys, and for each bucket its rows and the sums of their hashes."""
    spark, columns = df.sparkSession, sorted(df.columns)
    hashed = df.withColumns({
        BUCKET: F.pmod(_hash(df, sorted(keys), 0), F.lit(buckets)).cast("int"),
        **{name: _hash(df, columns, n) for n, name in enumerate(HASHES, 1)},
    })
    hashed.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(path)
    spark.createDataFrame([], df.schema).coalesce(1).write.parquet(f"{path}/_schema")
    stored = _stored(spark, path, *HASHES)
    sums = [F.sum(F.col(h).cast("decimal(38,0)")).alias(h) for h in HASHES]
    digests = stored.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("n"), *sums).withColumn("buckets", F.lit(buckets))
    digests.coalesce(1).write.parquet(f"{path}/_digests")


def _stored(spark: SparkSession, path: str, *more: str) -> DataFrame:
    schema = spark.read.parquet(f"{path}/_schema").schema
    for name in more:
        schema = schema.add(name, "long")
    return spark.read.schema(schema.add(BUCKET, "integer")).parquet(path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return _stored(spark, path).drop(BUCKET)


def _digests(spark: SparkSession, path: str) -> DataFrame:
    kind = ", ".join(f"{h} decimal(38,0)" for h in HASHES)
    return spark.read.schema(f"{BUCKET} int, n bigint, {kind}, buckets int").parquet(f"{path}/_digests")


def _compared(spark: SparkSession, old_path: str, new_path: str) -> tuple[list[int], int]:
    """The buckets that differ, and the rows of those that don't. Both sides have at most a row per bucket."""
    old, new = (_digests(spark, p).select(BUCKET, F.struct("n", *HASHES, "buckets").alias(side)) for p, side in ((old_path, "old"), (new_path, "new")))
    rows = old.join(new, BUCKET, "full_outer").select(BUCKET, "old.n", F.col("old").eqNullSafe(F.col("new")).alias("equal"), "old.buckets", F.col("new.buckets").alias("others")).collect()
    if any(r["buckets"] and r["others"] and r["buckets"] != r["others"] for r in rows):
        raise ValueError("the snapshots have different numbers of buckets")
    return sorted(r[BUCKET] for r in rows if not r["equal"]), sum(r["n"] for r in rows if r["equal"])


def stored_changes(spark: SparkSession, old_path: str, new_path: str, keys: Sequence[str]) -> DataFrame:
    """As :func:`diff_snapshots` of two stored snapshots, without the rows that are the same: only buckets
    whose digests differ are read. Keys are unique within a snapshot."""
    differ, _ = _compared(spark, old_path, new_path)
    return _diff(spark, old_path, new_path, keys, differ).where("change <> 'same'")


def change_counts(spark: SparkSession, old_path: str, new_path: str, keys: Sequence[str]) -> DataFrame:
    """(change, n) of two stored snapshots; the rows of equal buckets are counted from their digests."""
    differ, equal = _compared(spark, old_path, new_path)
    counted = _diff(spark, old_path, new_path, keys, differ).groupBy("change").agg(F.count(F.lit(1)).alias("n"))
    same = spark.createDataFrame([("same", equal)], "change string, n bigint")
    return counted.union(same).groupBy("change").agg(F.sum("n").alias("n")).where("n > 0")


def _diff(spark: SparkSession, old_path: str, new_path: str, keys: Sequence[str], buckets: list[int]) -> DataFrame:
    old, new = (_stored(spark, p).where(F.col(BUCKET).isin(buckets)).drop(BUCKET) for p in (old_path, new_path))
    return diff_snapshots(old, new, keys)
