import random

import pytest
from pyspark.sql import functions as F

from tollbridge.operators.ledgers import diff_snapshots, enforce_unique_subject
from tollbridge.operators.ordered import assign_serials, last_before, next_serial
from tollbridge.plans.certificates import issue_certificates


def test_serials_go_on_from_the_counter(spark):
    df = spark.createDataFrame([("c", 3), ("a", 1), ("b", 2)], "name string, n int")
    got = assign_serials(df, ["n"], "1C")
    assert [tuple(r) for r in got.orderBy("n").collect()] == [("a", 1, 28, "1C"), ("b", 2, 29, "1D"), ("c", 3, 30, "1E")]
    assert tuple(next_serial(got, "1C").first()) == (31, "1F")
    small = assign_serials(df, ["n"], "09").orderBy("n").collect()
    assert [r["serial_hex"] for r in small] == ["09", "0A", "0B"]
    none = assign_serials(df.limit(0), ["n"], 28)
    assert none.count() == 0 and tuple(next_serial(none, 28).first()) == (28, "1C")
    down = assign_serials(df, [F.desc("n")], 0).orderBy("serial").collect()
    assert [r["name"] for r in down] == ["c", "b", "a"]


def test_serials_of_many_rows_with_a_hot_value(spark, setting):
    setting("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = spark.range(0, 20000, 1, 7).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 11).alias("day"), "id")
    got = assign_serials(df, ["day", "id"], 100)
    rows = sorted(map(tuple, got.select("day", "id", "serial").collect()))
    assert [r[2] for r in rows] == list(range(100, 20100))
    # Equal rows still get numbers of their own.
    same = assign_serials(df.select(F.lit(1).alias("x")), ["x"], 0)
    assert sorted(r["serial"] for r in same.collect()) == list(range(20000))


@pytest.mark.parametrize("limit", [10**6, 0], ids=["windows", "ranges"])
def test_last_before_equals_a_scan(spark, setting, limit):
    setting("spark.tollbridge.order.maxGroupRows", limit)
    setting("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rng = random.Random(1)
    keys = ["hot"] * 8 + ["a", "b", None]
    defs = [(rng.choice(keys), n) for n in range(0, 3000, 3)]
    uses = [(rng.choice(keys), rng.randint(-2, 3010), n) for n in range(1500)]
    got = last_before(
        spark.createDataFrame(uses, "k string, ord bigint, n int"), spark.createDataFrame(defs, "k string, ord bigint"),
        ["k"], "ord", "found",
    )
    expected = {}
    for k, at, n in uses:
        earlier = [o for dk, o in defs if dk == k and k is not None and o < at]
        expected[n] = max(earlier, default=None)
    found = {r["n"]: r["found"] for r in got.collect() if r["k"] is not None}
    assert found == {n: v for n, v in expected.items() if uses[n][0] is not None}
    assert got.count() == len(uses)


@pytest.mark.parametrize("as_map", [False, True])
def test_unique_subjects(spark, as_map):
    ledger = spark.createDataFrame([("a",), ("a",)], "subject string")
    new = spark.createDataFrame([(1, "a"), (2, "n"), (3, "n"), (4, "m"), (5, None)], "arrival int, subject string")
    if as_map:
        as_field = F.when(F.col("subject").isNotNull(), F.create_map(F.lit("CN"), "subject"))
        ledger, new = ledger.withColumn("subject", as_field), new.withColumn("subject", as_field)
    accepted, rejected = enforce_unique_subject(new, ledger, "arrival")
    assert sorted(r["arrival"] for r in accepted.collect()) == [2, 4]
    assert sorted(r["arrival"] for r in rejected.collect()) == [1, 3, 5]
    assert accepted.columns == new.columns


def test_snapshots(spark):
    old = spark.createDataFrame([(1, "x", {"a": "1"}), (2, None, None), (3, "x", None), (5, "q", {"a": "1", "b": "2"})],
                                "k int, v string, m map<string,string>")
    new = spark.createDataFrame([(2, None, None), (3, None, None), (4, "n", None), (5, "q", {"b": "2", "a": "1"})], old.schema)
    got = diff_snapshots(old, new, ["k"])
    assert {r["k"]: r["change"] for r in got.collect()} == {1: "removed", 2: "same", 3: "changed", 4: "added", 5: "same"}
    assert got.columns == ["k", "old_v", "new_v", "old_m", "new_m", "change"]
    with pytest.raises(ValueError):
        diff_snapshots(old, new.drop("v"), ["k"])
    only_keys = diff_snapshots(old.select("k"), new.select("k"), ["k"])
    assert {r["change"] for r in only_keys.collect()} == {"removed", "same", "added"}


def test_issuing(spark):
    own = {"C": "XX", "ST": "YY", "O": "Org"}
    subjects = [{**own, "CN": "b"}, {**own, "CN": "taken"}, {**own, "CN": "b"}, {**own, "O": "Z", "CN": "c"}, {**own, "CN": "d"}]
    requests = spark.createDataFrame([(n, s) for n, s in enumerate(subjects)], "arrival int, subject map<string,string>")
    requests = requests.withColumn("not_before", F.lit("2024-01-18 00:50:44").cast("timestamp_ntz"))
    ledger = spark.createDataFrame([({**own, "CN": "taken"},)], "subject map<string,string>")
    got = issue_certificates(requests, ledger, own, "1C").orderBy("arrival").collect()
    assert [(r["arrival"], r["serial_hex"], str(r["not_after"]), r["status"]) for r in got] == [
        (0, "1C", "2026-04-21 00:50:44", "V"), (4, "1D", "2026-04-21 00:50:44", "V")]
