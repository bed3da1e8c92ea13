"""Stored snapshots against the plain comparison, and what is read for it."""

import pytest

from tollbridge.operators.ledgers import diff_snapshots
from tollbridge.operators.snapshots import change_counts, read_snapshot, stored_changes, write_snapshot

SCHEMA = "k bigint, a string, b string, m map<string,int>"


def stored(spark, folder, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA)
    write_snapshot(df, str(folder), ["k"], **how)
    return df, str(folder)


def test_equals_the_plain_comparison(spark, tmp_path):
    rows = [(n, f"a{n}", None if n % 3 else "b", {"x": n, "y": 1}) for n in range(300)]
    changed = [r for r in rows if r[0] not in (5, 77)] + [(1000, "new", None, None), (None, "no key", None, {})]
    changed = [(k, b, a, m) if k == 9 else (k, a, b, {"y": 1, "x": 8}) if k == 11 else (k, a, b, m and dict(reversed(m.items()))) for k, a, b, m in changed]
    old, old_path = stored(spark, tmp_path / "old", rows)
    new, new_path = stored(spark, tmp_path / "new", changed)
    assert read_snapshot(spark, new_path).count() == len(changed)
    plain = diff_snapshots(old, new, ["k"])
    got = stored_changes(spark, old_path, new_path, ["k"])
    assert got.columns == plain.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.filter("change <> 'same'").collect()))
    counts = {r["change"]: r["n"] for r in change_counts(spark, old_path, new_path, ["k"]).collect()}
    assert counts == {r["change"]: r["count"] for r in plain.groupBy("change").count().collect()}
    assert (counts["added"], counts["removed"], counts["changed"]) == (2, 2, 2)


def test_only_buckets_that_differ_are_read(spark, tmp_path):
    rows = [(n, "a", "b", None) for n in range(500)]
    _, old_path = stored(spark, tmp_path / "old", rows, buckets=50)
    _, new_path = stored(spark, tmp_path / "new", rows[:-1] + [(499, "a", "c", None)], buckets=50)
    got = stored_changes(spark, old_path, new_path, ["k"])
    assert [r["k"] for r in got.collect()] == [499]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(_bucket") + plan.count("PartitionFilters: [(_bucket") + plan.count("PartitionFilters: [_bucket") >= 2


def test_empty_equal_and_other_buckets(spark, tmp_path):
    _, none = stored(spark, tmp_path / "none", [])
    _, some = stored(spark, tmp_path / "some", [(1, "a", None, None)])
    _, same = stored(spark, tmp_path / "same", [(1, "a", None, None)])
    _, other = stored(spark, tmp_path / "other", [(n, "a", None, None) for n in range(9)], buckets=3)
    assert [r["change"] for r in stored_changes(spark, none, some, ["k"]).collect()] == ["added"]
    assert stored_changes(spark, some, same, ["k"]).count() == 0 and stored_changes(spark, none, none, ["k"]).count() == 0
    assert [tuple(r) for r in change_counts(spark, some, same, ["k"]).collect()] == [("same", 1)]
    with pytest.raises(ValueError, match="buckets"):
        many = stored(spark, tmp_path / "many", [(n, "a", None, None) for n in range(9000)])[1]
        stored_changes(spark, many, other, ["k"])
