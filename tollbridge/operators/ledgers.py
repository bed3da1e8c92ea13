"""Keeping a ledger: unique subjects, and what changed between two snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DataType, MapType


def _comparable(name: str, kind: DataType) -> Column:
    """Maps cannot be grouped or compared, their sorted entries can."""
    return F.array_sort(F.map_entries(name)) if isinstance(kind, MapType) else F.col(name)


def mark_unique_subject(
    new: DataFrame, ledger: DataFrame, order_col: str, subject_col: str = "subject"
) -> DataFrame:
    """Add ``accepted``: the subject is not in the ledger and this is its first row in the batch.

    ``order_col`` is the arrival order, different for every row. Firsts are found by a partial
    aggregate and joined back on subject and order together, so a subject repeated by a third of
    the batch neither meets in one task nor multiplies. A null subject is never accepted.
    """
    batch = new.withColumn("_subject", _comparable(subject_col, new.schema[subject_col].dataType))
    firsts = (
        batch.filter("_subject is not null").groupBy("_subject").agg(F.min(order_col).alias(order_col))
    )
    taken = ledger.select(_comparable(subject_col, ledger.schema[subject_col].dataType).alias("_subject")).distinct()
    winners = firsts.join(taken, "_subject", "left_anti").withColumn("_first", F.lit(True))
    marked = batch.join(winners, ["_subject", order_col], "left")
    return marked.select(*new.columns, F.coalesce("_first", F.lit(False)).alias("accepted"))


def enforce_unique_subject(
    new: DataFrame, ledger: DataFrame, order_col: str, subject_col: str = "subject"
) -> tuple[DataFrame, DataFrame]:
    """The accepted and the rejected rows of a batch, see :func:`mark_unique_subject`."""
    marked = mark_unique_subject(new, ledger, order_col, subject_col)
    return marked.filter("accepted").drop("accepted"), marked.filter("not accepted").drop("accepted")


def diff_snapshots(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: ``change`` (added, removed, changed or same) and every other column as ``old_*``
    and ``new_*``. Keys are unique within a snapshot; values compare null-safe.
    """
    keys = list(keys)
    values = [c for c in old.columns if c not in keys]
    if set(values) != {c for c in new.columns if c not in keys}:
        raise ValueError("the snapshots have different columns")

    def side(df: DataFrame, tag: str) -> DataFrame:
        compared = F.struct(F.lit(1).alias("_one"), *[_comparable(c, df.schema[c].dataType).alias(c) for c in values])
        return df.select(*keys, *[F.col(c).alias(f"{tag}_{c}") for c in values], compared.alias(f"_{tag}"))

    both = side(old, "old").join(side(new, "new"), keys, "full_outer")
    change = (
        F.when(F.col("_old").isNull(), "added")
        .when(F.col("_new").isNull(), "removed")
        .when(F.col("_old") == F.col("_new"), "same")
        .otherwise("changed")
    )
    pairs = [f"{tag}_{c}" for c in values for tag in ("old", "new")]
    return both.select(*keys, *pairs, change.alias("change"))
