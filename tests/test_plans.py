"""Physical plans: what must and must not be in them."""

import pytest

import __spark_entry__ as spark_entry

SF_DIR = "/root/testdata/sf0.001"
REQUEST_SIDE = ["page_backends", "address_ranges", "body_limits", "substituted_bodies"]
ROW_ONLY = ["access_log_fields", "proxied_headers", "status_rules", "severity_rows", "port_offsets", "certificate_expiry"]


def plan(spark, name):
    return spark_entry.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", REQUEST_SIDE)
def test_lookups_are_broadcast_equi_joins(spark, name):
    text = plan(spark, name)
    assert "BroadcastHashJoin" in text
    for bad in ("NestedLoop", "CartesianProduct", "SortMergeJoin", "ShuffledHashJoin"):
        assert bad not in text


@pytest.mark.parametrize("name", ROW_ONLY)
def test_row_operators_do_not_shuffle(spark, name):
    assert "Exchange" not in plan(spark, name)


def test_only_needed_columns_are_read(spark):
    assert "ReadSchema: struct<doc_id:bigint,source:string,n_chars:bigint>" in plan(spark, "body_limits")


def test_overlays_aggregate_before_their_one_shuffle(spark):
    text = plan(spark, "last_settings")
    assert "partial_max_by" in text and text.count("Exchange hashpartitioning") == 1


def test_certificates_are_exploded_once_and_then_read(spark):
    assert "Generate" not in plan(spark, "host_certificates")


@pytest.mark.parametrize("name", ["unique_subjects", "snapshot_changes", "uncovered_hosts", "order_serials", "resolved_references"])
def test_keyed_operators_join_by_keys(spark, name):
    text = plan(spark, name)
    for bad in ("NestedLoop", "CartesianProduct"):
        assert bad not in text


def test_large_lookups_shuffle(spark, setting):
    setting("spark.tollbridge.broadcast.maxRows", 0)
    setting("spark.sql.autoBroadcastJoinThreshold", -1)
    for name in ("body_limits", "address_ranges"):
        text = plan(spark, name)
        assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text and "NestedLoop" not in text
