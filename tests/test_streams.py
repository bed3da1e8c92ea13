"""Lookups on a stream give the batch rows, with a broadcast rule table and with a salted one."""

import pytest
from pyspark.sql import functions as F

from tollbridge.operators.ranges import cidr_lookup
from tollbridge.operators.settings import overlay_layers
from tollbridge.plans.certificates import issue_certificates, issued_schema, read_issued, stream_certificates
from tollbridge.sources.access_log import read_split_batches, write_split_batches
from tollbridge.streaming.batches import manifest, put_batch, run_batches
from tollbridge.streaming.files import drain, stream_files
from tollbridge.streaming.settings import read_overlay, stream_overlay

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("limit", [10**6, 0], ids=["broadcast", "salted"])
def test_ranges_on_a_stream(spark, setting, limit):
    setting("spark.tollbridge.broadcast.maxRows", limit)
    setting("spark.tollbridge.join.salts", 4)
    cidrs = spark.createDataFrame([("198.51.100.0/24", 1), ("198.51.100.64/26", 2)], "cidr string, value int")
    batch = spark.read.parquet(f"{SF_DIR}/events.parquet")

    def looked_up(events):
        ip = F.concat(F.lit("198.51.100."), F.col("event_id") % 256)
        return cidr_lookup(events.select("event_id", ip.alias("ip")), "ip", cidrs, 0)

    streamed = drain(looked_up(stream_files(spark, SF_DIR, batch.schema, only="events.parquet")))
    assert sorted(streamed.collect()) == sorted(looked_up(batch).collect())
    assert {r["value"] for r in streamed.select("value").distinct().collect()} == {1, 2}


def arrive(spark, folder, name, rows, schema):
    """One more file for a stream."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}")


def test_settings_kept_up_to_date(spark, tmp_path):
    """Late lines change nothing, and a stream that starts again goes on where it was."""
    schema = "env_id string, ord bigint, key string, raw string"
    parts = [
        [("e", 5, "A", "five"), ("e", 1, "B", "one"), (None, 1, "A", "null env")],
        [("e", 3, "A", "late"), ("e", 2, "B", "two"), ("f", 9, "A", None)],
        [("e", 7, "A", None), ("e", 0, "B", "late"), ("f", 10, "A", "ten"), (None, 0, "A", "late")],
    ]
    path, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    for n, rows in enumerate(parts):
        arrive(spark, str(tmp_path / "in"), f"part{n}", rows, schema)
        stream = stream_files(spark, str(tmp_path / "in/*"), spark.createDataFrame([], schema).schema)
        stream_overlay(stream, path, checkpoint, available_now=True).awaitTermination()
        so_far = spark.createDataFrame([r for p in parts[: n + 1] for r in p], schema)
        assert sorted(map(str, read_overlay(spark, path).collect())) == sorted(map(str, overlay_layers(so_far).collect()))
    assert manifest(spark, path).count() >= 3


REQUESTS = "arrival bigint, not_before timestamp, subject map<string,string>"


def test_a_batch_of_certificates_that_comes_again(spark, tmp_path):
    """The same serials, nothing rejected for itself, and the next batch goes on from there."""
    from datetime import datetime

    def request(n, name):
        return (n, datetime(2024, 1, 1), {"C": "X", "ST": "Y", "O": "Z", "CN": name})

    parts = [[request(1, "a"), request(2, "b"), request(3, "a")], [request(4, "b"), request(5, "c")], [request(6, "c"), request(7, "d")]]
    path, authority, handled = str(tmp_path / "ledger"), {"C": "X", "ST": "Y", "O": "Z"}, []
    schema = spark.createDataFrame([], REQUESTS).schema

    def twice(df, checkpoint, handle, *given, **how):
        """Each batch is handled again, as after a failure between its writing and the stream's own note."""

        def handle_again(rows, n):
            for _ in range(2):
                handle(rows, n)
                handled.append(n)

        return run_batches(df, checkpoint, handle_again, *given, **how)

    import tollbridge.plans.certificates as plan

    plan.run_batches = twice
    try:
        for n, rows in enumerate(parts):
            arrive(spark, str(tmp_path / "in"), f"part{n}", rows, REQUESTS)
            stream = stream_files(spark, str(tmp_path / "in/*"), schema)
            stream_certificates(stream, path, str(tmp_path / "checkpoint"), authority, "0A", available_now=True).awaitTermination()
    finally:
        plan.run_batches = run_batches
    got = [(r.arrival, r.serial, r.serial_hex) for r in read_issued(spark, path, schema).orderBy("arrival").collect()]
    assert got == [(1, 10, "0A"), (2, 11, "0B"), (5, 12, "0C"), (7, 13, "0D")] and len(handled) >= 6
    whole = spark.createDataFrame([r for p in parts for r in p], REQUESTS)
    batch = issue_certificates(whole, spark.createDataFrame([], issued_schema(schema)), authority, "0A")
    assert sorted(r.serial for r in batch.collect()) == [10, 11, 12, 13]


def test_split_batches(spark, tmp_path):
    """A batch that comes again adds nothing, one that isn't listed is not read, files per service are few."""
    schema = "service string, n int, keep int"
    path = str(tmp_path / "out")
    stream_schema = spark.createDataFrame([], schema).schema
    for n in range(2):
        rows = [("ab"[i % 2], 100 * n + i, i % 3) for i in range(50)]
        arrive(spark, str(tmp_path / "in"), f"part{n}", rows, schema)
        stream = stream_files(spark, str(tmp_path / "in/*"), stream_schema).repartition(20)
        write_split_batches(stream, path, "service", "keep", str(tmp_path / "checkpoint"), available_now=True).awaitTermination()
    wanted = sorted(100 * n + i for n in range(2) for i in range(50) if i % 3)
    assert sorted(r.n for r in read_split_batches(spark, path, schema).collect()) == wanted
    last = manifest(spark, path).agg(F.max("batch_id")).first()[0]
    rows = spark.createDataFrame([("a", 999, 1)], schema)
    put_batch(rows, path, last, ["service"])
    put_batch(rows, path, last, ["service"])
    assert sum(r.n == 999 for r in read_split_batches(spark, path, schema).collect()) == 1
    rows.write.partitionBy("service").parquet(f"{path}/batch_id=77")  # begun, not listed
    assert sum(r.n == 999 for r in read_split_batches(spark, path, schema).collect()) == 1
    assert len(list((tmp_path / "out" / "batch_id=0" / "service=a").glob("*.parquet"))) <= 2
    assert read_split_batches(spark, str(tmp_path / "nothing"), schema).count() == 0
