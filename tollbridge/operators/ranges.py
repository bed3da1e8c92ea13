"""Network ranges: the most specific one that holds an address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tollbridge.functions.text import address_number
from tollbridge.operators.attach import attach, size_up
from tollbridge.operators.intervals import disjoint_segments, value_at

# Addresses are looked up among the ranges of their part: the address without its last bits.
PART_BITS = 16


def cidr_lookup(df: DataFrame, ip_col: str, cidrs: DataFrame, default, name: str = "value") -> DataFrame:
    """Add the value of the most specific range of ``cidrs(cidr, value)`` that holds the address, else ``default``.

    A range is ``base/bits``, ``first-last`` or a single address. The narrower range is the more specific
    one; of equally wide ones the later, then the one with the greater value counts. A range without a
    value, or that can't be read, says nothing. A small table of the first kind takes one broadcast
    equi-join per prefix length in use (33 at most) on the leading bits of the address. All others are cut
    into disjoint ranges, and one lookup finds the one an address is in, whatever the number of lengths.
    """
    ranges = read_ranges(cidrs)
    small, lengths, plain = size_up(ranges, F.collect_set("bits"), F.count_if(F.col("bits").isNull()) == 0)
    found = df.withColumn("_address", address_number(F.col(ip_col)))
    if small and plain:
        nets = ranges.groupBy("bits", _net(F.col("first"), F.col("bits")).alias("_net")).agg(F.max("range_value").alias("_hit"))
        hits = []
        for bits in sorted(lengths, reverse=True):
            hit = f"_hit_{bits}"
            own = nets.filter(F.col("bits") == bits).select("_net", F.col("_hit").alias(hit))
            found = attach(found.withColumn("_net", _net(F.col("_address"), F.lit(bits))), own, ["_net"], True)
            hits.append(F.col(hit))
        return found.select(*df.columns, F.coalesce(*hits, F.lit(default)).alias(name))
    found = found.withColumn("_part", F.shiftright("_address", PART_BITS))
    met = value_at(found, range_segments(ranges), ["_part"], "_address", "range_value", "_best")
    return met.select(*df.columns, F.coalesce("_best", F.lit(default)).alias(name))


def read_ranges(cidrs: DataFrame) -> DataFrame:
    """first, last (not inside), bits (null for ``first-last``) and range_value of the ranges that can be read."""
    text = F.col("cidr")
    bits = F.when(text.contains("-"), None).when(text.contains("/"), F.substring_index(text, "/", -1).try_cast("int")).otherwise(32)
    low = address_number(F.trim(F.substring_index(F.substring_index(text, "-", 1), "/", 1)))
    high = address_number(F.trim(F.substring_index(text, "-", -1)))
    read = cidrs.select(text.contains("-").alias("_pair"), bits.alias("bits"), low.alias("_low"), high.alias("_high"), F.col("value").alias("range_value"))
    size = F.pow(F.lit(2.0), 32 - F.col("bits")).cast("bigint")
    first = F.when(F.col("_pair"), F.col("_low")).otherwise(F.floor(F.col("_low") / size).cast("bigint") * size)
    good = F.when(F.col("_pair"), F.col("_low") <= F.col("_high")).otherwise(F.col("bits").between(0, 32) & F.col("_low").isNotNull())
    return read.filter(F.coalesce(good, F.lit(False)) & F.col("range_value").isNotNull()).select(
        first.alias("first"), F.when(F.col("_pair"), F.col("_high") + 1).otherwise(first + size).alias("last"), "bits", "range_value"
    )


def range_segments(ranges: DataFrame) -> DataFrame:
    """Disjoint ranges (_part, start, range_value), cut at every ``_part`` of 2^16 addresses they lie in.

    Each part has one more row at most than ends of ranges in it: 65,536 more in all.
    """
    ranked = ranges.select(F.lit(0).alias("_all"), "first", "last", (F.col("first") - F.col("last")).alias("_narrow"), F.col("first").alias("_later"), "range_value")
    cut = disjoint_segments(ranked, ["_all"], ["_narrow", "_later"], "range_value")
    last = F.coalesce("stop", F.col("start") + 1)
    parts = F.sequence(F.shiftright("start", PART_BITS), F.shiftright(last - 1, PART_BITS))
    cut = cut.select("start", "range_value", F.explode(parts).alias("_part"))
    return cut.select("_part", F.greatest("start", F.shiftleft("_part", PART_BITS)).alias("start"), "range_value")


def _net(address: Column, bits: Column) -> Column:
    """The leading bits of an address."""
    return F.floor(address / F.pow(F.lit(2.0), 32 - bits)).cast("bigint")
