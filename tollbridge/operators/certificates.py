"""Certificates: which host is covered, and which request a policy accepts."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, functions as F

from tollbridge.functions.text import name_list
from tollbridge.operators.attach import attach, fits_broadcast
from tollbridge.operators.intervals import disjoint_segments, value_at
from tollbridge.operators.rows import explode_names
from tollbridge.session import cut_lineage

# How each subject field is judged, in the stricter and the looser policy.
MATCH_POLICY = {
    "C": "match", "ST": "match", "O": "match",
    "OU": "optional", "CN": "supplied", "emailAddress": "optional",
}
ANYTHING_POLICY = {
    "C": "optional", "ST": "optional", "L": "optional", "O": "optional",
    "OU": "optional", "CN": "supplied", "emailAddress": "optional",
}
# From the strictest to the laxest.
RULES = ("match", "supplied", "optional")

# Microseconds that stand for a time without end.
OPEN = 1 << 62


def attach_certificate(routes: DataFrame, certs: DataFrame, uncovered: bool = False) -> DataFrame:
    """Add ``cert_serial`` to each host; of several certificates naming it, the latest serial.

    ``uncovered=True`` gives the distinct hosts no certificate names. The names are written once,
    so that the certificates are not read again to measure and to join them.
    """
    names = explode_names(certs, "names" if "names" in certs.columns else "names_text")
    by_name = names.groupBy(F.col("name").alias("host")).agg(F.max("serial").alias("cert_serial"))
    if not uncovered:
        return attach(routes, by_name if routes.isStreaming else cut_lineage(by_name, "names"), ["host"])
    known = cut_lineage(by_name.select("host"), "names")
    known = F.broadcast(known) if fits_broadcast(known) else known
    return routes.select("host").distinct().join(known, "host", "left_anti")


def certificate_at(requests: DataFrame, certs: DataFrame, at_col: str = "at", host_col: str = "host") -> DataFrame:
    """Add ``cert_serial``, the certificate naming the host that was valid at the request's time; of several
    the latest serial, null if there was none.

    Certificates are valid from ``not_before`` to ``not_after``, both included; a null end is open.
    Their overlapping times are cut into disjoint ones per host, so that a request meets one row.
    """
    names_col = "names" if "names" in certs.columns else "names_text"
    is_text = certs.schema[names_col].dataType.simpleString() == "string"
    names = name_list(F.col(names_col)) if is_text else F.col(names_col)
    moment = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    valid = certs.select(
        F.explode(names).alias(host_col), F.coalesce(moment("not_before"), F.lit(-OPEN)).alias("first"),
        (F.coalesce(moment("not_after"), F.lit(OPEN)) + 1).alias("last"), F.col("serial").alias("_rank"), F.col("serial").alias("_serial"),
    ).filter("_serial is not null")
    segments = disjoint_segments(valid, [host_col], ["_rank"], "_serial")
    asked = requests.withColumn("_at", moment(at_col))
    return value_at(asked, segments, [host_col], "_at", "_serial", "cert_serial").drop("_at")


def check_policy(
    requests: DataFrame,
    authority: Mapping[str, str] | DataFrame,
    policy: Mapping[str, str] | DataFrame = MATCH_POLICY,
    subject_col: str = "subject",
) -> DataFrame:
    """Add ``accepted`` and ``reasons``, the fields that break the policy, in policy order.

    ``match`` fields must be there and equal the authority's, ``supplied`` ones must be there. Of several
    rules of one field in a table the strictest counts: ``match``, ``supplied``, ``optional``.
    The authority is a mapping or a one-row DataFrame with a ``subject`` map; both it and the
    policy are a handful of values and become part of the expression.
    """
    wanted = _authority_fields(authority)
    subject = F.col(subject_col)
    kept = {}
    for field, rule in _policy_fields(policy).items():
        value = F.try_element_at(subject, F.lit(field))
        if rule == "match":
            kept[field] = F.coalesce(value == F.lit(wanted.get(field) or None), F.lit(False))
        elif rule == "supplied":
            kept[field] = F.coalesce(value != "", F.lit(False))
    reasons = [F.when(~ok, F.lit(field)) for field, ok in kept.items()]
    return requests.withColumns({
        "accepted": reduce(and_, kept.values(), F.lit(True)),
        "reasons": F.array_compact(F.array(*reasons)) if reasons else F.array().cast("array<string>"),
    })


def _policy_fields(policy: Mapping[str, str] | DataFrame) -> dict[str, str]:
    if isinstance(policy, DataFrame):
        # a field named twice is judged by its strictest rule; a rule that isn't known is kept, to be refused
        strict = F.coalesce(F.array_position(F.array(*[F.lit(r) for r in RULES]), F.col("rule")), F.lit(0))
        fields = policy.filter("field is not null").groupBy("field").agg(F.min_by("rule", strict).alias("rule"))
        policy = {r["field"]: r["rule"] for r in fields.orderBy("field").collect()}
    unknown = set(policy.values()) - set(RULES)
    if unknown:
        raise ValueError(f"unknown policy rules: {sorted(map(str, unknown))}")
    return dict(policy)


def _authority_fields(authority: Mapping[str, str] | DataFrame) -> dict[str, str]:
    if not isinstance(authority, DataFrame):
        return dict(authority)
    rows = authority.select("subject").take(2)
    if len(rows) != 1:
        raise ValueError("the authority must be exactly one row")
    return dict(rows[0]["subject"] or {})
