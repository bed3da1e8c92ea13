"""Ordered value rules and truth of flags."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, NumericType

# A status beginning with 3 is not logged, every other status is.
STATUS_RULES = [("^[3]", 0)]
STATUS_DEFAULT = 1


def match_rules(col: Column, rules: Iterable[tuple[str, Any]], default: Any) -> Column:
    """Value of the first rule whose regex is found in the text of ``col``, else ``default``."""
    text = col.cast("string")
    result = None
    for pattern, value in rules:
        hit = text.rlike(pattern)
        result = F.when(hit, F.lit(value)) if result is None else result.when(hit, F.lit(value))
    return F.lit(default) if result is None else result.otherwise(F.lit(default))


def loggable_flag(status: Column) -> Column:
    """1 when a request with this status belongs in the access log, else 0."""
    return match_rules(status, STATUS_RULES, STATUS_DEFAULT)


def truthy(df: DataFrame, flag_col: str) -> Column:
    """False for null, the empty text, 0 and '0' (and a false boolean); true for anything else."""
    flag = F.col(flag_col)
    if isinstance(df.schema[flag_col].dataType, BooleanType):
        return F.coalesce(flag, F.lit(False))
    if isinstance(df.schema[flag_col].dataType, NumericType):
        return F.coalesce(flag != 0, F.lit(False))
    return F.coalesce(~flag.isin("", "0"), F.lit(False))
