"""Answers given before or instead of a backend: redirects, size limits, substitute bodies."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from tollbridge.functions.rules import truthy
from tollbridge.functions.text import size_bytes
from tollbridge.operators.attach import attach
from tollbridge.operators.hosts import CASES, HostPattern, first_in_table, first_pattern, host_patterns, many_patterns, pattern_table
from tollbridge.session import cut_lineage

# A moved host answers 301; a flagged request is sent elsewhere for now, 302.
MOVED = 301
ELSEWHERE = 302

# A template is text and variables; a dollar sign that begins no name is text.
TEMPLATE = re.compile(r"((?:[^$]|\$(?![A-Za-z0-9_]))+)|\$(\d|[A-Za-z_][A-Za-z0-9_]*)")
TOKEN = TEMPLATE.pattern


def redirect_requests(requests: DataFrame, rules: DataFrame, flag_col: str | None = None) -> DataFrame:
    """Add ``location`` and ``code`` to requests(port, host, uri); null where no rule applies.

    ``rules(kind, port, host, template)`` with kind ``exact``, ``wildcard``, ``regex`` or
    ``flag``. A template may hold ``$host``, ``$request_uri`` and, for a regex, ``$1`` to ``$9``;
    in a pattern's template another variable is an error. The location is the template alone,
    whatever part of the host the pattern covers; a query is in it only by ``$request_uri``.
    A ``flag`` rule belongs to an exact host, applies when ``flag_col`` is set and goes first.
    """
    have = rules.columns
    rules = rules.select(
        "kind", "port", "host", "template", (F.col("rule_ord") if "rule_ord" in have else F.lit(0)).alias("rule_ord")
    )
    by_host = (
        rules.filter(F.col("kind").isin("exact", "flag"))
        .groupBy("port", "host")
        .agg(
            F.min(F.when(F.col("kind") == "exact", F.col("template"))).alias("_moved"),
            F.min(F.when(F.col("kind") == "flag", F.col("template"))).alias("_flagged"),
        )
    )
    found = attach(requests, by_host, ["port", "host"])
    elsewhere = F.lit(None).cast("string")
    if flag_col is not None:
        elsewhere = F.when(truthy(requests, flag_col), _filled(F.col("_flagged")))
    moved = _filled(F.col("_moved"))
    named = F.col("_moved").isNotNull() | F.col("_flagged").isNotNull()
    if not requests.isStreaming and many_patterns(rules, "kind"):
        hosts = cut_lineage(found.filter(~named & F.col("host").isNotNull()).select("port", "host").distinct(), "hosts")
        patterns = pattern_table(rules, "kind", ["template"])
        firsts = first_in_table(hosts, patterns.withColumn("_regex", F.col("regex")), "_regex", F.col("template").alias("_template"))
        found = attach(found, cut_lineage(firsts, "host-patterns"), ["port", "host"])
        by_pattern = _filled_by_match(F.col("_template"), F.col("_regex"))
    else:
        by_pattern = _by_pattern(host_patterns(rules, "kind", ["template"]))
    moved = F.when(named, moved).otherwise(by_pattern)
    placed = found.withColumns({"_elsewhere": elsewhere, "_location": moved})
    return placed.select(
        *requests.columns,
        F.coalesce("_elsewhere", "_location").alias("location"),
        F.when(F.col("_elsewhere").isNotNull(), ELSEWHERE)
        .when(F.col("_location").isNotNull(), MOVED).alias("code"),
    )


def _filled(template: Column) -> Column:
    return F.replace(F.replace(template, F.lit("$host"), F.col("host")), F.lit("$request_uri"), F.col("uri"))


def _filled_by_match(template: Column, regex: Column) -> Column:
    """The template with its variables filled, template and regex being columns; an unknown variable is refused."""
    tokens = F.regexp_extract_all(template, F.lit(TOKEN), F.lit(0))

    def filled(token: Column) -> Column:
        digit = token.rlike(r"^\$\d$")
        captured = F.call_function("regexp_extract", F.col("host"), regex, F.substring(token, 2, 1).cast("int"))
        unknown = F.raise_error(F.concat(F.lit("unknown variable "), token, F.lit(" in a template"))).cast("string")
        return (
            F.when(token == "$host", F.col("host")).when(token == "$request_uri", F.col("uri")).when(digit, captured)
            .when(token.rlike(r"^\$[A-Za-z_]"), unknown).otherwise(token)
        )

    return F.array_join(F.transform(tokens, filled), "")


def _by_pattern(patterns: list[HostPattern]) -> Column:
    """The location by the first pattern of the host; each pattern's template is filled on its own."""
    if len(patterns) <= CASES:
        return first_pattern(patterns, _captured)
    key = first_pattern(patterns)
    blocks = [patterns[k : k + CASES] for k in range(0, len(patterns), CASES)]
    return F.coalesce(*[first_key(block, key) for block in blocks])


def first_key(patterns: list[HostPattern], key: Column) -> Column:
    result = None
    for p in patterns:
        hit = (key == p.key) & (F.col("port") == p.port)
        result = F.when(hit, _captured(p)) if result is None else result.when(hit, _captured(p))
    return result


def _captured(pattern: HostPattern) -> Column:
    """The template with its variables filled; one that is not known is refused."""
    pieces = []
    for text, variable in TEMPLATE.findall(pattern.row["template"] or ""):
        if text:
            pieces.append(F.lit(text))
        elif variable == "host":
            pieces.append(F.col("host"))
        elif variable == "request_uri":
            pieces.append(F.col("uri"))
        elif variable.isdigit() and int(variable) <= _groups(pattern.regex):
            pieces.append(F.regexp_extract("host", pattern.regex, int(variable)))
        else:
            raise ValueError(f"unknown variable ${variable} in {pattern.row['template']!r}")
    return F.concat(*pieces) if pieces else F.lit(pattern.row["template"])


def _groups(regex: str) -> int:
    """Capturing groups: parentheses that are neither escaped, nor in a class, nor special."""
    plain = re.sub(r"\\.|\[(?:\\.|[^\]\\])*\]", "", regex)
    return len(re.findall(r"\((?!\?)|\(\?P?<(?![=!])", plain))


def flag_oversize(
    requests: DataFrame,
    limits: DataFrame,
    global_limit: str,
    host_col: str = "host",
    size_col: str = "body_bytes",
) -> DataFrame:
    """Add ``max_body_bytes`` (the host's own, else the global one) and ``oversize``.

    A limit of 0 is no limit.
    """
    own = limits.groupBy(F.col("host").alias(host_col)).agg(F.min(size_bytes(F.col("max_body"))).alias("_own"))
    found = attach(requests, own, [host_col])
    limit = F.coalesce("_own", size_bytes(F.lit(global_limit)))
    return found.withColumns({"max_body_bytes": limit, "oversize": (limit > 0) & (F.col(size_col) > limit)}).drop("_own")


def substitute_by_status(
    df: DataFrame, bodies: DataFrame, body_col: str = "body", substituted_col: str | None = None
) -> DataFrame:
    """Replace the body where ``bodies(host, status, body)`` has one for the host and status."""
    own = bodies.groupBy("host", "status").agg(F.min("body").alias("_body"))
    found = attach(df, own, ["host", "status"])
    changed = {body_col: F.coalesce("_body", body_col)}
    if substituted_col is not None:
        changed[substituted_col] = F.col("_body").isNotNull()
    return found.withColumns(changed).drop("_body")
