from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tollbridge.functions.rules import loggable_flag, match_rules
from tollbridge.functions.text import hex_number, hex_text, parse_subject, size_bytes
from tollbridge.operators.rows import (
    derive_expiry, derive_offsets, explode_json_groups, explode_names, filter_pick, forward_headers,
    keep_loggable, severity_at_least,
)
from tollbridge.sources.access_log import parse_access_log, read_access_log, write_split_log
from tollbridge.sources.ledger import read_ledger

LOG_LINES = [
    '192.0.2.7 - bob [01/Jan/2024:00:00:07 +0000] "GET /a?b=1 HTTP/1.1" 502 41 "-" "ua/1" "203.0.113.9"',
    '192.0.2.8 - - [01/Jan/2024:02:00:08 +0200] "GET / HTTP/1.1" 301 0 "-" "ua/1"',
    "not a log line",
]


def texts(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_log_lines_are_parsed_judged_and_forwarded(spark):
    parsed = parse_access_log(texts(spark, *LOG_LINES))
    assert parsed.dtypes == [
        ("remote_addr", "string"), ("remote_user", "string"), ("time_local", "timestamp"), ("request", "string"),
        ("status", "int"), ("body_bytes_sent", "bigint"), ("referer", "string"), ("user_agent", "string"),
        ("forwarded_for", "string"), ("malformed", "boolean"),
    ]
    one, two, three = parsed.withColumn("t", F.col("time_local").cast("bigint")).drop("time_local").collect()
    second = int(datetime(2024, 1, 1, 0, 0, 7, tzinfo=timezone.utc).timestamp())
    assert tuple(one) == ("192.0.2.7", "bob", "GET /a?b=1 HTTP/1.1", 502, 41, None, "ua/1", "203.0.113.9", False, second)
    assert tuple(two) == ("192.0.2.8", None, "GET / HTTP/1.1", 301, 0, None, "ua/1", None, False, second + 1)
    assert three["malformed"] and all(v is None for k, v in three.asDict().items() if k != "malformed")
    requests = parsed.withColumn("scheme", F.lit("http"))
    forwarded = forward_headers(requests, host=None)
    assert "x_host" not in forwarded.columns
    assert [r["x_forwarded_for"] for r in forwarded.collect()] == ["203.0.113.9, 192.0.2.7", "192.0.2.8", ""]
    kept = keep_loggable(parsed.withColumn("flag", loggable_flag(F.col("status"))), "flag")
    assert [r["status"] for r in kept.collect()] == [502, None]


@pytest.mark.parametrize("line, ok", [
    ('192.0.2.7 - - [x] "-" 400 0 "-" "-" "-"', True),
    ('192.0.2.7 - - [x] "" 400 - "" "" ""', True),
    ('192.0.2.7 - - [x] "GET /" 40 0 "-" "-"', False),
    ('192.0.2.7 - - [x] "GET \u0001" 400 0 "-" "-"', True),
    (' 192.0.2.7 - - [x] "GET /" 400 0 "-" "-"', False),
    ("", False),
    (None, False),
])
def test_odd_log_lines(spark, line, ok):
    row = parse_access_log(texts(spark, line)).first()
    assert row["malformed"] is not ok
    if ok:
        assert row["status"] == 400 and row["time_local"] is None and row["referer"] is None
    if ok and "\u0001" in line:
        assert row["request"] == "GET \u0001"


def test_log_files_batch_equals_stream(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    for n in range(3):
        (logs / f"{n}.log").write_text("\n".join(LOG_LINES) + "\n")
    batch = read_access_log(spark, str(logs))
    stream = read_access_log(spark, str(logs), streaming=True)
    flag = loggable_flag(F.col("status"))
    kinds = {"batch": batch, "stream": stream}
    out = {}
    for name, df in kinds.items():
        flagged = df.withColumns({"service": F.coalesce("remote_user", F.lit("none")), "keep": flag})
        query = write_split_log(
            flagged, str(tmp_path / name), "service", "keep", str(tmp_path / f"{name}-cp"), available_now=True
        )
        if query is not None:
            query.awaitTermination()
        out[name] = sorted(map(str, spark.read.parquet(str(tmp_path / name)).collect()))
        assert {p.name for p in (tmp_path / name).iterdir() if p.is_dir() and "=" in p.name} == {"service=bob", "service=none"}
    assert len(out["batch"]) == 6 and out["batch"] == out["stream"]


def test_split_log_appends_and_keeps_all_without_a_flag(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 0), ("b", 2, 1), ("a", 3, 1)], "service string, n int, keep int")
    for _ in range(2):
        assert write_split_log(df, str(tmp_path / "all"), "service", None) is None
        write_split_log(df, str(tmp_path / "kept"), "service", "keep")
    assert spark.read.parquet(str(tmp_path / "all")).count() == 6
    assert sorted(r["n"] for r in spark.read.parquet(str(tmp_path / "kept")).collect()) == [2, 2, 3, 3]
    stream = spark.readStream.format("rate").load()
    with pytest.raises(ValueError):
        write_split_log(stream, str(tmp_path / "x"), "timestamp", None)


def test_rules_are_tried_in_order(spark):
    df = texts(spark, "301", "200", None, "")
    got = df.select(
        loggable_flag(F.col("value")).alias("flag"),
        match_rules(F.col("value"), [("0", "zero"), ("^2", "two")], "none").alias("first"),
        match_rules(F.col("value"), [], 7).alias("empty"),
    ).collect()
    assert [tuple(r) for r in got] == [(0, "zero", 7), (1, "zero", 7), (1, "none", 7), (1, "none", 7)]
    system = match_rules(F.col("value"), [("buntu", "linux")], "other")
    assert [r[0] for r in texts(spark, "an ubuntu host", "plain").select(system).collect()] == ["linux", "other"]


@pytest.mark.parametrize("kind, values, kept", [
    ("string", ["1", "0", "", None, "x", "00"], ["1", "x", "00"]),
    ("int", [1, 0, None, 2], [1, 2]),
    ("double", [0.0, 0.5, None], [0.5]),
    ("boolean", [True, False, None], [True]),
])
def test_flags(spark, kind, values, kept):
    df = spark.createDataFrame([(v,) for v in values], f"flag {kind}")
    assert [r["flag"] for r in keep_loggable(df, "flag").collect()] == kept


def test_severity(spark):
    levels = ["debug", "info", "notice", "warn", "error", "crit", "alert", "emerg", "odd", None, "WARN"]
    kept = severity_at_least(texts(spark, *levels), "value", "warn").collect()
    assert [r["value"] for r in kept] == ["warn", "error", "crit", "alert", "emerg", "WARN"]


def test_filter_pick(spark):
    df = texts(spark, "  101 ?  S  0:00 java Entry", "202 ? S 0:01 other", "\tEntry")
    assert [r["field"] for r in filter_pick(df, "value", "Entry", 1).collect()] == ["101", "Entry"]
    assert [r["field"] for r in filter_pick(df, "value", "Entry", 2).collect()] == ["?", ""]


def test_offsets(spark):
    df = spark.createDataFrame([("a", 9001)], "service string, http_port int")
    row = derive_offsets(df, "http_port", {"admin": 100, "stop": 200}).first()
    assert (row["admin"], row["stop"]) == (9101, 9201)


def test_subjects(spark):
    cases = {
        "/C=US/O=Org/CN=x": {"C": "US", "O": "Org", "CN": "x"},
        "C = US, O = A, B & C, CN = x/emailAddress = y": {"C": "US", "O": "A, B & C", "CN": "x", "emailAddress": "y"},
        "C=US, CN=x/emailAddress=y@example.org": {"C": "US", "CN": "x", "emailAddress": "y@example.org"},
        "/OU=a/b/OU=c/CN=k=v": {"OU": "c", "CN": "k=v"},
        " /OU=1/OUX=2/OU=3 /CN= /OU=4": {"OUX": "2", "OU": "4", "CN": ""},
        "/CN=": {"CN": ""},
        "no subject": None,
        "": None,
        None: None,
    }
    got = texts(spark, *cases).select(parse_subject(F.col("value"))).collect()
    assert [r[0] for r in got] == list(cases.values())


def test_json_groups(spark):
    plain = '{"g1":["u1","u2"],"g2":[]}'
    for text in (plain, plain.replace('"', '\\"'), plain.replace('"', '\\\\\\"')):
        got = explode_json_groups(texts(spark, text, None, "bad"), "value")
        assert [tuple(r) for r in got.collect()] == [("g1", "u1"), ("g1", "u2")]
    kept = explode_json_groups(texts(spark, '{"g":["say \\"hi\\""]}'), "value")
    assert kept.first()["member"] == 'say "hi"'


def test_names_and_expiry(spark):
    start = datetime(2024, 1, 18, 0, 50, 44)
    certs = spark.createDataFrame(
        [(2, start, "DNS:a.example.org, DNS:b.example.org,IP Address:192.0.2.1")],
        "serial bigint, not_before timestamp_ntz, names_text string",
    )
    assert [tuple(r) for r in explode_names(certs).collect()] == [(2, "a.example.org"), (2, "b.example.org")]
    as_array = certs.select("serial", F.array(F.lit("x"), F.lit("y")).alias("names"))
    assert [r["name"] for r in explode_names(as_array, "names").collect()] == ["x", "y"]
    assert derive_expiry(certs, "not_before").first()["not_after"] == datetime(2026, 4, 21, 0, 50, 44)


def test_ledger(spark, tmp_path):
    (tmp_path / "index.txt").write_text(
        "V\t260421005044Z\t\t00\tunknown\t/C=XX/ST=YY/O=Org/OU=Unit/CN=a.example.org/emailAddress=x@example.org\n"
        "V\t260421005045Z\t\t1B\tunknown\t/C=XX/ST=YY/O=Org/OU=Unit/CN=b.example.org/emailAddress=x@example.org\n"
        "R\tbad\tq\tFFFFFFFFFFFFFFFFFFFF\t\n\n"
    )
    ledger = read_ledger(spark, str(tmp_path / "index.txt"))
    assert ledger.dtypes == [
        ("status", "string"), ("not_after", "timestamp"), ("c3", "string"), ("serial", "bigint"),
        ("filename", "string"), ("subject", "map<string,string>"),
    ]
    got = ledger.withColumn("not_after", F.col("not_after").cast("string")).orderBy("serial").collect()
    assert tuple(got[0]) == ("R", None, "q", None, None, None)
    assert tuple(got[2])[:5] == ("V", "2026-04-21 00:50:45", None, 27, "unknown")
    assert got[1]["subject"]["CN"] == "a.example.org"


def test_numbers_in_text(spark):
    sizes = ["4m", "2M", "512", "128k", "4x", "", None]
    assert [r[0] for r in texts(spark, *sizes).select(size_bytes(F.col("value"))).collect()] == [
        4194304, 2097152, 512, 131072, None, None, None
    ]
    row = texts(spark, "1b").select(hex_number(F.col("value")), hex_text(F.lit(9)), hex_text(F.lit(255 * 16))).first()
    assert tuple(row) == (27, "09", "FF0")


def test_a_group_of_another_kind_loses_only_itself(spark):
    values = ['{"a":["x"],"b":"y"}', '{"a":["x",5,null,{"q":1}],"b":{"c":["z"]},"d":null,"e":["w"]}', '{\\"a\\":[\\"x\\"],\\"b\\":7}', '["x"]', "{", None, '{"a":[]}']
    df = spark.createDataFrame(list(enumerate(values)), "n int, v string")
    got = sorted((tuple(r) for r in explode_json_groups(df, "v").collect()), key=str)
    assert got == sorted([(0, "a", "x"), (1, "a", "x"), (1, "a", "5"), (1, "a", None), (1, "a", '{"q":1}'), (1, "e", "w"), (2, "a", "x")], key=str)
