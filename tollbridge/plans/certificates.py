"""Issuing certificates into a ledger."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructType

from tollbridge.operators.certificates import MATCH_POLICY, check_policy
from tollbridge.operators.ledgers import enforce_unique_subject
from tollbridge.operators.ordered import assign_serials, next_serial
from tollbridge.operators.rows import VALID_DAYS, derive_expiry
from tollbridge.session import cut_lineage
from tollbridge.streaming.batches import manifest, put_batch, read_batches, run_batches


def issue_certificates(
    requests: DataFrame,
    ledger: DataFrame,
    authority: Mapping[str, str] | DataFrame,
    start: int | str,
    policy: Mapping[str, str] | DataFrame = MATCH_POLICY,
    days: int = VALID_DAYS,
) -> DataFrame:
    """New ledger rows for requests(arrival, not_before, subject): those the policy accepts whose
    subject is new, numbered by arrival from the stored counter, with their expiry.
    """
    # Judged once and written: the subjects are read several times from here on.
    judged = cut_lineage(check_policy(requests, authority, policy), "judged")
    allowed = judged.filter("accepted").drop("accepted", "reasons")
    fresh, _ = enforce_unique_subject(allowed, ledger, "arrival")
    numbered = assign_serials(fresh, ["arrival"], start)
    return derive_expiry(numbered, "not_before", days).withColumn("status", F.lit("V"))


def stream_certificates(
    requests: DataFrame,
    path: str,
    checkpoint: str,
    authority: Mapping[str, str] | DataFrame,
    start: int | str,
    policy: Mapping[str, str] | DataFrame = MATCH_POLICY,
    days: int = VALID_DAYS,
    available_now: bool = False,
) -> StreamingQuery:
    """Issue certificates for a stream of requests into the ledger at ``path``, a part per batch.

    A batch is judged against the parts before it, and its serials go on from the counter that the last
    of them left. So a batch that comes again sees what it saw, gets the same serials, rejects no subject
    for having issued it itself, and takes the place of its first writing.
    """

    def issue(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        counter = manifest(spark, path, batch_id).agg(F.max("counter")).first()[0]
        counter = counter if counter is not None else int(start, 16) if isinstance(start, str) else int(start)
        known = read_batches(spark, path, issued_schema(rows.schema), before=batch_id)
        issued = cut_lineage(issue_certificates(rows, known, authority, counter, policy, days), "issued")
        put_batch(issued, path, batch_id, counter=next_serial(issued, counter).first()["next_serial"])

    return run_batches(requests, checkpoint, issue, available_now)


def issued_schema(requests: StructType) -> StructType:
    """The columns of a ledger made from requests with these columns."""
    out = StructType(list(requests.fields))
    return out.add("serial", LongType()).add("serial_hex", "string").add("not_after", requests["not_before"].dataType).add("status", "string")


def read_issued(spark: SparkSession, path: str, requests: StructType) -> DataFrame:
    """The ledger's rows of whole batches."""
    return read_batches(spark, path, issued_schema(requests)).drop("batch_id")
