"""Wildcard and regex host names of a rule table: few as one ordered list, many by an index of their literals."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, functions as F

# A regex cannot be looked up by equality. So few patterns are part of the expression, a case each. More
# stay a table: only those are tried on a host whose text is in it. Streams have them as one list.
CASES = 100

# Letters of the piece of a pattern's text by which it is found.
GRAM = 3

# Host kinds in order of precedence after the exact names.
PATTERN_KINDS = ("wildcard", "regex")


@dataclass(frozen=True)
class HostPattern:
    port: int
    host: str
    kind: str
    regex: str
    row: Row

    @property
    def key(self) -> str:
        """Names the pattern: a wildcard and a regex may have the same text."""
        return f"{self.kind}:{self.host}"


def pattern_key(kind: Column, host: Column) -> Column:
    return F.concat(kind, F.lit(":"), host)


def host_patterns(rules: DataFrame, kind_col: str, extra: list[str] | None = None) -> list[HostPattern]:
    """Wildcards first, the longest before shorter ones, then regexes by ``rule_ord``.

    Of several rules for one pattern the one with the smallest ``rule_ord`` counts, then the
    smallest values. The patterns are part of a configuration and are held by the driver.
    """
    order = F.col("rule_ord") if "rule_ord" in rules.columns else F.lit(0)
    first = F.min(F.struct(order.alias("rule_ord"), *(extra or []))).alias("first")
    listed = (
        rules.filter(F.col(kind_col).isin(*PATTERN_KINDS) & F.col("host").isNotNull())
        .groupBy("port", "host", F.col(kind_col).alias("kind")).agg(first)
        .select("port", "host", "kind", "first.*")
        .collect()
    )

    def rank(row: Row):
        wildcard = row["kind"] == "wildcard"
        return (not wildcard, -len(row["host"]) if wildcard else row["rule_ord"], row["host"], row["port"])

    return [HostPattern(r["port"], r["host"], r["kind"], as_regex(r["kind"], r["host"]), r) for r in sorted(listed, key=rank)]


def many_patterns(rules: DataFrame, kind_col: str) -> bool:
    """Whether the patterns are more than are held as cases; no more than that are looked at."""
    named = rules.filter(F.col(kind_col).isin(*PATTERN_KINDS) & F.col("host").isNotNull())
    return named.select("port", "host", kind_col).distinct().limit(CASES + 1).count() > CASES


def pattern_table(rules: DataFrame, kind_col: str, extra: list[str] | None = None) -> DataFrame:
    """The patterns as rows (port, key, regex, rank, grams, extra), in the same precedence by ``rank``.

    ``grams`` are runs of letters that every matching host holds, none where none is certain.
    """
    order = F.col("rule_ord") if "rule_ord" in rules.columns else F.lit(0)
    first = F.min(F.struct(order.alias("rule_ord"), *(extra or []))).alias("first")
    listed = (
        rules.filter(F.col(kind_col).isin(*PATTERN_KINDS) & F.col("host").isNotNull())
        .groupBy("port", "host", F.col(kind_col).alias("kind")).agg(first)
    )
    wildcard = F.col("kind") == "wildcard"
    spelled = F.concat(F.lit(r"^\Q"), F.replace("host", F.lit("*"), F.lit(r"\E[^/]+\Q")), F.lit(r"\E$"))
    pieces = F.when(wildcard, F.split("host", r"\*")).otherwise(_regex_pieces(F.col("host")))
    grams = F.array_distinct(F.flatten(F.transform(pieces, _grams)))
    rank = F.struct(~wildcard, F.when(wildcard, -F.length("host")).otherwise(F.col("first.rule_ord")).cast("bigint"), "host", "port")
    return listed.select(
        "port", pattern_key(F.col("kind"), F.col("host")).alias("key"), F.when(wildcard, spelled).otherwise(F.col("host")).alias("regex"),
        rank.alias("rank"), grams.alias("grams"), *[F.col("first")[c].alias(c) for c in extra or []],
    )


def _regex_pieces(regex: Column) -> Column:
    """Texts that a match of the regex must hold; empty where that can't be told from its form.

    What may be absent or vary (classes, groups, escapes of kinds, whatever a quantifier follows) parts the
    texts. Alternatives outside groups, flags, quotations and groups in groups in groups say nothing.
    """
    cut, dot = "\x00", "\x01"
    text = F.regexp_replace(regex, r"\\\.", dot)
    text = F.regexp_replace(text, r"\\.", cut)
    text = F.regexp_replace(text, r"\[[^\]]*\]", cut)
    for _ in range(2):
        text = F.regexp_replace(text, r"\([^()]*\)", cut)
    text = F.regexp_replace(text, r"(?s).(?:[?*]|\{[^}]*\})", cut)
    text = F.regexp_replace(text, r"[\^$.+]", cut)
    unclear = regex.rlike(r"\(\?(?!:)|\\Q|\[[^\]]*\[") | text.rlike(r"[|()\[\]{}?*]")
    return F.when(unclear, F.array().cast("array<string>")).otherwise(F.split(F.replace(text, F.lit(dot), F.lit(".")), cut))


def _grams(text: Column) -> Column:
    """The distinct runs of GRAM letters of a text."""
    at = F.sequence(F.lit(1), F.length(text) - GRAM + 1)
    runs = F.array_distinct(F.transform(at, lambda i: F.substring(text, i, F.lit(GRAM))))
    return F.when(F.length(text) >= GRAM, runs).otherwise(F.array().cast("array<string>"))


def first_in_table(hosts: DataFrame, patterns: DataFrame, *keep: str) -> DataFrame:
    """The first matching pattern of each distinct (port, host): these two and the columns to keep.

    Each pattern stands in an index under the rarest of its runs of letters; a host asks for its own
    runs, and only patterns found so are tried. Those without any stand under the empty run, which every
    host asks for.
    """
    runs = F.when(F.size("grams") > 0, F.col("grams")).otherwise(F.array(F.lit("")))
    of_pattern = patterns.select("port", "key", F.explode(runs).alias("gram"))
    often = of_pattern.groupBy("port", "gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = of_pattern.join(often, ["port", "gram"]).groupBy("port", "key").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    index = patterns.join(rarest, ["port", "key"])
    asked = hosts.select("port", "host", F.explode(F.concat(F.array(F.lit("")), _grams(F.col("host")))).alias("gram"))
    met = asked.join(index.drop("grams"), ["port", "gram"]).filter(F.rlike("host", F.col("regex")))
    best = met.groupBy("port", "host").agg(F.min_by(F.struct(*keep), "rank").alias("_first"))
    return best.select("port", "host", "_first.*")


def as_regex(kind: str, host: str) -> str:
    if kind == "regex":
        return host
    return "^" + "[^/]+".join(re.escape(piece) for piece in host.split("*")) + "$"


def first_pattern(patterns: list[HostPattern], value=None) -> Column:
    """``value(pattern)`` of the first pattern matching the port and host columns, else null; the
    pattern's key if no ``value`` is given."""
    if value is None and len(patterns) > CASES:
        return _first_of_list(patterns)
    result = None
    for p in patterns:
        hit = (F.col("port") == F.lit(p.port)) & F.col("host").rlike(p.regex)
        found = F.lit(p.key) if value is None else value(p)
        result = F.when(hit, found) if result is None else result.when(hit, found)
    return F.lit(None).cast("string") if result is None else result


def _first_of_list(patterns: list[HostPattern]) -> Column:
    """The patterns of each port as one constant list, gone through up to the port's own."""
    by_port: dict[int, list[dict]] = {}
    for p in patterns:
        by_port.setdefault(p.port, []).append({"key": p.key, "regex": p.regex})
    result = None
    for port, own in by_port.items():
        constant = F.from_json(F.lit(json.dumps(own)), "array<struct<key:string,regex:string>>")
        hits = F.filter(constant, lambda p: F.rlike(F.col("host"), p["regex"]))
        found = F.get(hits, F.lit(0))["key"]
        result = F.when(F.col("port") == port, found) if result is None else result.when(F.col("port") == port, found)
    return result
