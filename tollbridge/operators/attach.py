"""Left lookups that broadcast the rule side only after measuring it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Session settings, with their defaults. A rule table is broadcast only below both limits.
MAX_BYTES = ("spark.tollbridge.broadcast.maxBytes", 64 * 1024 * 1024)
MAX_ROWS = ("spark.tollbridge.broadcast.maxRows", 1_000_000)
# Salts per key where Spark does not split hot keys by itself.
SALTS = ("spark.tollbridge.join.salts", 32)


def setting(df: DataFrame, entry: tuple[str, int]) -> int:
    key, default = entry
    return int(df.sparkSession.conf.get(key, str(default)))


def _row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row: text by its length, nested values as JSON, all others by eight bytes."""
    size = F.lit(8 * len(df.columns))
    for field in df.schema.fields:
        kind = field.dataType.simpleString()
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(F.col(f"`{field.name}`")), F.lit(0))
        elif kind.startswith(("array<", "map<", "struct<")):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{field.name}`")))), F.lit(0))
    return size


def measure(df: DataFrame, *also: Column) -> tuple:
    """The rows and bytes of a static table, and further aggregates from the same pass."""
    rows, size_bytes, *values = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(_row_bytes(df)), F.lit(0)), *also).first()
    return rows, size_bytes, *values


def within_limits(df: DataFrame, rows: int, size_bytes: int) -> bool:
    return rows <= setting(df, MAX_ROWS) and size_bytes <= setting(df, MAX_BYTES)


def size_up(df: DataFrame, *also: Column) -> tuple:
    """Whether a static table is within the limits, and further aggregates from the same pass."""
    rows, size_bytes, *values = measure(df, *also)
    return within_limits(df, rows, size_bytes), *values


def fits_broadcast(df: DataFrame) -> bool:
    """Measure the rows and bytes of a static table in one aggregate and compare with the limits."""
    return size_up(df)[0]


def row_hash(df: DataFrame) -> Column:
    """A hash of the whole row: the same value whenever a task is run again."""
    plain = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    return F.xxhash64(*plain) if plain else F.lit(0).cast("bigint")


def attach(left: DataFrame, right: DataFrame, on: Sequence[str], small: bool | None = None) -> DataFrame:
    """Left join where ``right`` holds at most one row per key; every left row comes out once.

    A measured small side is broadcast, so the left side is not shuffled. Otherwise both sides
    are shuffled on the key, and the adaptive skew join splits the rows of a hot key over many
    tasks by the sizes it has seen, copies of one row included. Streams and sessions without it
    get a salt: left rows are dealt out over the salts and each right row is repeated once per
    salt.
    """
    on = list(on)
    extra = [c for c in right.columns if c not in on]
    if fits_broadcast(right) if small is None else small:
        joined = left.join(F.broadcast(right), on, "left")
    elif not left.isStreaming and _splits_hot_keys(left):
        joined = left.join(right, on, "left")
    else:
        salts = setting(left, SALTS)
        dealt = left.withColumn("_salt", F.pmod(row_hash(left), F.lit(salts)).cast("int"))
        repeated = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = dealt.join(repeated, [*on, "_salt"], "left")
    return joined.select(*left.columns, *extra)


def _splits_hot_keys(df: DataFrame) -> bool:
    conf = df.sparkSession.conf
    wanted = ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled")
    return all(conf.get(key) == "true" for key in wanted)
