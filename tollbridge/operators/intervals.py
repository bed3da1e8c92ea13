"""Overlapping intervals cut into disjoint ones, and lookups of the one that holds a point."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tollbridge.operators.attach import attach, size_up
from tollbridge.operators.ordered import assign_serials, last_before
from tollbridge.session import cut_lineage

# A key's segments are looked through in its row up to this many; beyond, points and segments are sorted together.
MAX_SEARCHED = 256
# Entries of one block of a search tree: that many are looked through per level.
BRANCHES = 64


def disjoint_segments(intervals: DataFrame, keys: Sequence[str], rank: Sequence[str], value: str) -> DataFrame:
    """(keys, start, stop, value): from ``start`` to before ``stop``, the next start of its keys, the value of
    the highest-ranked interval of ``intervals`` (keys, first, last, rank, value); null where there is none.

    ``first`` is inside, ``last`` is not; equal ranks go by the greater value. All ends of all keys are
    numbered in one order, by ranges. An interval is then some blocks of numbers, at most two of each power
    of two; each block keeps its highest interval, and each end asks the blocks it is in, one per power of
    two. So n intervals are about 2 n log n rows, however they overlap. Intervals with a null in keys or
    ends, or without length, are left out.
    """
    keys = list(keys)
    known = intervals.dropna(subset=[*keys, "first", "last"]).filter("first < last")
    known = cut_lineage(known.select(*keys, "first", "last", *rank, value), "intervals")
    ends = known.select(*keys, F.col("first").alias("start")).union(known.select(*keys, "last")).distinct()
    numbered = assign_serials(ends, [*keys, "start"], 0).select(*keys, "start", F.col("serial").alias("_n"))
    numbered = cut_lineage(numbered, "interval-ends")
    low = numbered.select(*keys, F.col("start").alias("first"), F.col("_n").alias("_i"))
    high = numbered.select(*keys, F.col("start").alias("last"), F.col("_n").alias("_j"))
    placed = known.join(low, [*keys, "first"]).join(high, [*keys, "last"])
    best = F.struct(*rank, F.col(value).alias("_value"))
    blocks = placed.select(best.alias("_best"), F.inline(_blocks(F.col("_i"), F.col("_j"))))
    blocks = cut_lineage(blocks.groupBy("_level", "_block").agg(F.max("_best").alias("_best")), "interval-blocks")
    used = sorted(r[0] for r in blocks.select("_level").distinct().collect())  # one per power of two
    asked = numbered.select("_n", F.explode(F.array(*[F.lit(level) for level in used]) if used else F.array().cast("array<int>")).alias("_level"))
    met = attach(asked.withColumn("_block", F.expr("shiftright(_n, _level)")), blocks, ["_level", "_block"])
    held = met.groupBy("_n").agg(F.max("_best").alias("_best"))
    following = numbered.select((F.col("_n") - 1).alias("_n"), *keys, F.col("start").alias("stop"))
    out = numbered.join(held, "_n", "left").join(following, ["_n", *keys], "left")
    return out.select(*keys, "start", "stop", F.col("_best._value").alias(value))


def _blocks(i: Column, j: Column) -> Column:
    """The numbers from i to j - 1 as blocks (level, block): the numbers whose upper bits past ``level`` are ``block``.

    What is left is at most half as long after each level: there are as many as j - i has binary digits.
    """
    kind = "array<struct<_level:int,_block:bigint>>"

    def step(s: Column, level: Column) -> Column:
        open_ = s["i"] < s["j"]
        left, right = open_ & (s["i"] % 2 == 1), open_ & (s["j"] % 2 == 1)
        block = lambda n: F.struct(level.cast("int").alias("_level"), n.alias("_block"))
        own = F.array_compact(F.array(F.when(left, block(s["i"])), F.when(right, block(s["j"] - 1))))
        return F.struct(
            F.shiftright(s["i"] + left.cast("bigint"), 1).alias("i"), F.shiftright(s["j"] - right.cast("bigint"), 1).alias("j"),
            F.concat(s["blocks"], own.cast(kind)).alias("blocks"),
        )

    start = F.struct(i.cast("bigint").alias("i"), j.cast("bigint").alias("j"), F.array().cast(kind).alias("blocks"))
    return F.aggregate(F.sequence(F.lit(0), F.length(F.bin(j - i)) - 1), start, step, lambda s: s["blocks"])


def value_at(df: DataFrame, segments: DataFrame, keys: Sequence[str], at: str, value: str, name: str) -> DataFrame:
    """Add to each row the value of the segment of its keys that ``at``, an integer, is in; null where there is none.

    While each key has few segments, they are one row per key, broadcast while they are few in all. A key
    with more has them as a search tree while they are few in all: a block of entries per level is looked
    through, and the rows are not shuffled. Otherwise rows and segments are put into one sequence: one
    shuffle, by ranges where a key has very many rows. Streams always take the first way.
    """
    keys = list(keys)
    segments = cut_lineage(segments.select(*keys, "start", value), "segments")
    small = size_up(segments)[0]
    most = segments.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if small and most > MAX_SEARCHED and not df.isStreaming:
        return _search(df, segments, keys, at, value, name, most)
    if df.isStreaming or most <= MAX_SEARCHED:
        part = F.struct("start", F.col(value).alias("_value"))
        grouped = segments.groupBy(*keys).agg(F.array_sort(F.collect_list(part)).alias("_segments"))
        found = attach(df, cut_lineage(grouped, "segments"), keys)
        before = F.filter("_segments", lambda s: s["start"] <= F.col(at))
        return found.select(*df.columns, F.try_element_at(before, F.lit(-1))["_value"].alias(name))
    asked = df.withColumn("_after", F.col(at) + 1)
    defs = segments.select(*keys, F.col("start").alias("_after"), F.col(value).alias("_value"))
    found = last_before(asked, defs, keys, "_after", "_segment", payload=["_value"])
    return found.select(*df.columns, F.col("_segment")["_value"].alias(name))


def _search(df: DataFrame, segments: DataFrame, keys: list[str], at: str, value: str, name: str, most: int) -> DataFrame:
    """``value_at`` by a search tree of each key's segments, one broadcast table per level."""
    order = F.row_number().over(Window.partitionBy(*keys).orderBy("start", value)) - 1
    entries, levels, left = segments.select(*keys, "start", F.col(value).alias("_value"), order.alias("_at")), [], most
    while True:
        part = F.struct("start", "_at", "_value") if not levels else F.struct("start", "_at")
        blocks = entries.groupBy(*keys, F.floor(F.col("_at") / BRANCHES).alias("_block")).agg(F.array_sort(F.collect_list(part)).alias("_entries"))
        levels.append(cut_lineage(blocks, "segments"))
        if left <= BRANCHES:
            break
        left = -(-left // BRANCHES)
        entries = levels[-1].select(*keys, F.col("_entries")[0]["start"].alias("start"), F.col("_block").alias("_at"))
    found = df.withColumn("_block", F.lit(0).cast("bigint"))
    for blocks in reversed(levels):
        before = F.filter("_entries", lambda e: e["start"] <= F.col(at))
        hit = attach(found, blocks, [*keys, "_block"], True).withColumn("_hit", F.try_element_at(before, F.lit(-1)))
        found = hit.select(*df.columns, F.col("_hit._at").cast("bigint").alias("_block"), *([F.col("_hit._value").alias(name)] if blocks is levels[0] else []))
    return found.select(*df.columns, name)
