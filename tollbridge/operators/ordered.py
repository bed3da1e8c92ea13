"""Ordered scans over any number of rows: no task ever sorts more than one range of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tollbridge.functions.text import hex_text
from tollbridge.operators.attach import row_hash, setting
from tollbridge.session import cut_lineage

# Session setting: beyond this many rows of one key its order is worked out range by range.
MAX_GROUP = ("spark.tollbridge.order.maxGroupRows", 1_000_000)

_ROW_IN_PARTITION = (1 << 33) - 1


def range_pieces(df: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    """Rows sorted over range partitions, tagged with ``_piece`` and their place ``_at`` in it.

    A partition number says nothing once a task is run again, so the tags are written out
    before anything is derived from them.
    """
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    tagged = ordered.withColumns({
        "_piece": F.spark_partition_id(),
        "_at": F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_IN_PARTITION)),
    })
    return cut_lineage(tagged, "ordered")


def assign_serials(df: DataFrame, order_cols: Sequence[str | Column], start: int | str) -> DataFrame:
    """Gap-free ``serial`` numbers in the given order from ``start`` (a number or hex text), and
    ``serial_hex`` of at least two digits. Rows tying on all of ``order_cols`` follow their hash.
    """
    first = int(start, 16) if isinstance(start, str) else int(start)
    pieces = range_pieces(df.withColumn("_tie", row_hash(df)), [*order_cols, "_tie"])
    counts = pieces.groupBy("_piece").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition, so neither the window nor the broadcast grows with the data.
    earlier = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_piece", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    serial = F.lit(first).cast("bigint") + F.col("_before") + F.col("_at")
    numbered = pieces.join(F.broadcast(starts), "_piece").select(*df.columns, serial.alias("serial"))
    return numbered.withColumn("serial_hex", hex_text(F.col("serial")))


def next_serial(numbered: DataFrame, start: int | str) -> DataFrame:
    """The counter to store afterwards, one row: ``next_serial`` and ``next_serial_hex``."""
    first = int(start, 16) if isinstance(start, str) else int(start)
    following = numbered.agg(
        F.coalesce(F.max("serial") + 1, F.lit(first).cast("bigint")).alias("next_serial")
    )
    return following.withColumn("next_serial_hex", hex_text(F.col("next_serial")))


def last_before(
    uses: DataFrame, defs: DataFrame, keys: Sequence[str], order: str, found: str, payload: Sequence[str] = ()
) -> DataFrame:
    """Add to each use the greatest ``order`` of a definition of its keys that is strictly smaller, or
    with a ``payload`` a struct of it and these columns of the definition.

    Uses and definitions of a key are put in one sequence, uses first where the order is equal;
    the answer is a running maximum. Keys of ordinary size take one window. If any key is larger,
    the sequence is cut into ranges: a window within each range, plus the maximum carried over
    from the earlier ranges of the same key.
    """
    carried = [c for c in uses.columns if c not in (*keys, order)]
    use = F.struct(*carried) if carried else F.struct(F.lit(1).alias("_one"))
    meant = F.struct(order, *payload) if payload else F.col(order).cast("bigint")
    def_rows = defs.select(*keys, order, meant.alias(found))
    empty = F.lit(None).cast(def_rows.schema[found].dataType)
    use_rows = uses.select(*keys, order, empty.alias(found), use.alias("_use"))
    def_rows = def_rows.withColumn("_use", F.lit(None).cast(use_rows.schema["_use"].dataType))
    line = use_rows.unionByName(def_rows)
    largest = line.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if largest <= setting(uses, MAX_GROUP):
        before = (
            Window.partitionBy(*keys)
            .orderBy(F.col(order), F.col(found).asc_nulls_first())
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        scanned = line.withColumn(found, F.max(found).over(before))
    else:
        scanned = _scan_by_ranges(line, keys, order, found)
    return scanned.filter("_use is not null").select(
        *keys, order, *[F.col("_use")[c].alias(c) for c in carried], found
    )


def _scan_by_ranges(line: DataFrame, keys: Sequence[str], order: str, found: str) -> DataFrame:
    pieces = range_pieces(line, [*keys, order, found])
    within = (
        Window.partitionBy("_piece", *keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    )
    earlier = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    # Only the first key of a piece can have begun in an earlier one, so this holds at most one
    # row per piece whatever the size of the data.
    carry = (
        pieces.groupBy("_piece", *keys)
        .agg(F.max(found).alias("_top"))
        .withColumn("_carry", F.max("_top").over(earlier))
        .filter("_carry is not null")
        .drop("_top")
    )
    scanned = pieces.withColumn("_local", F.max(found).over(within))
    renamed = carry.select(*[F.col(c).alias(f"_carry_{c}") for c in ("_piece", *keys)], "_carry")
    same = [F.col(c).eqNullSafe(F.col(f"_carry_{c}")) for c in ("_piece", *keys)]  # a null key is a key
    joined = scanned.join(F.broadcast(renamed), same, "left")
    return joined.select(*scanned.columns, "_carry").withColumn(found, F.coalesce("_local", "_carry"))
