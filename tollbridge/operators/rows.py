"""Row-at-a-time operators: the same on a batch and on a stream, no shuffle, no state."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from tollbridge.functions.rules import truthy
from tollbridge.functions.text import name_list

# Levels of an error log, from the least to the most severe.
SEVERITIES = ["debug", "info", "notice", "warn", "error", "crit", "alert", "emerg"]

# Fixed value: days a new certificate is valid.
VALID_DAYS = 824


def keep_loggable(df: DataFrame, flag_col: str) -> DataFrame:
    """Rows whose flag is set (not null, not empty, not 0)."""
    return df.filter(truthy(df, flag_col))


def severity_at_least(df: DataFrame, level_col: str, threshold: str) -> DataFrame:
    """Rows at or above a level. A level not in the list has no rank and is not kept."""
    rank = SEVERITIES.index(threshold)
    return df.filter(F.lower(F.col(level_col)).isin(*SEVERITIES[rank:]))


def filter_pick(df: DataFrame, line_col: str, regex: str, field_no: int, name: str = "field") -> DataFrame:
    """Of the lines matching ``regex``, the ``field_no``-th whitespace-separated field."""
    line = F.col(line_col)
    fields = F.split(F.regexp_replace(line, r"^\s+|\s+$", ""), r"\s+")
    others = [c for c in df.columns if c != line_col]
    return df.filter(line.rlike(regex)).select(
        *others, F.coalesce(F.try_element_at(fields, F.lit(field_no)), F.lit("")).alias(name)
    )


def derive_offsets(df: DataFrame, base_col: str, offsets: Mapping[str, int]) -> DataFrame:
    """One more integer column per name, at a fixed distance from the base column."""
    return df.withColumns({name: F.col(base_col) + F.lit(n) for name, n in offsets.items()})


def forward_headers(
    df: DataFrame,
    remote_addr: str = "remote_addr",
    scheme: str = "scheme",
    forwarded_for: str = "forwarded_for",
    host: str | None = "host",
) -> DataFrame:
    """Columns a proxy adds for its backend; ``host=None`` leaves the host one out."""
    incoming = F.nullif(F.col(forwarded_for), F.lit(""))
    added = {
        "x_real_ip": F.col(remote_addr),
        "x_forwarded_proto": F.col(scheme),
        "x_forwarded_for": F.concat_ws(", ", incoming, F.col(remote_addr)),
    }
    if host is not None:
        added["x_host"] = F.col(host)
    return df.withColumns(added)


def explode_json_groups(df: DataFrame, col: str, group: str = "group", member: str = "member") -> DataFrame:
    """One row per member of a JSON object of arrays, also when its quotes are backslash-escaped.

    A value of another kind than an array loses only itself; text that is no object gives no row.
    """
    text = F.col(col)
    plain = F.when(text.rlike(r'^\s*\{\s*\\+"'), F.regexp_replace(text, r'\\+"', '"')).otherwise(text)
    others = [c for c in df.columns if c != col]
    # An object with values of several kinds is read member by member; the others by one typed parse.
    parsed = F.from_json(plain, "map<string,array<string>>")
    mixed = F.try_variant_get(F.try_parse_json(plain), "$", "map<string,variant>")
    arrays = F.transform_values(mixed, lambda _, v: F.try_variant_get(v, "$", "array<string>"))
    # Outer explodes keep Spark from adding a filter that would parse every text twice.
    groups = df.select(*others, F.explode_outer(F.coalesce(parsed, arrays)).alias(group, "_members"))
    members = groups.select(*others, group, F.posexplode_outer("_members").alias("_at", member))
    return members.filter("_at is not null").drop("_at")


def explode_names(df: DataFrame, names_col: str = "names_text", serial_col: str = "serial") -> DataFrame:
    """One row per DNS name of a certificate; the names come as text or as an array."""
    is_text = df.schema[names_col].dataType.simpleString() == "string"
    names = name_list(F.col(names_col)) if is_text else F.col(names_col)
    exploded = df.select(F.col(serial_col).alias("serial"), F.explode_outer(names).alias("name"))
    return exploded.filter("name is not null")


def derive_expiry(df: DataFrame, start_col: str, days: int = VALID_DAYS, name: str = "not_after") -> DataFrame:
    """Expiry a fixed number of days after the start, at the same time of day."""
    return df.withColumn(name, F.col(start_col) + F.make_dt_interval(days=F.lit(days)))
