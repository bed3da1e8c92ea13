"""Log lines composed from ``events``, then parsed, judged, and written by service."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tollbridge.functions.rules import loggable_flag, match_rules
from tollbridge.operators.ranges import cidr_lookup
from tollbridge.operators.responses import substitute_by_status
from tollbridge.operators.rows import (
    derive_offsets, explode_json_groups, filter_pick, forward_headers, keep_loggable, severity_at_least,
)
from tollbridge.queries.registry import query, table, utc
from tollbridge.session import fresh_folder
from tollbridge.sources.access_log import (
    parse_access_log, read_access_log, read_split_batches, write_split_batches, write_split_log,
)
from tollbridge.streaming.files import drain, stream_files

STATUS = {"error": 502, "signup": 301, "view": 200, "click": 304, "purchase": 201}
STATUS_SQL = (
    "CASE event_type WHEN 'error' THEN 502 WHEN 'signup' THEN 301 WHEN 'view' THEN 200 "
    "WHEN 'click' THEN 304 ELSE 201 END"
)
ADDRESS_SQL = "'198.51.' || ((user_id // 256) % 256) || '.' || (user_id % 256)"
FORWARDED_SQL = (
    "CASE event_type WHEN 'error' THEN '203.0.113.9' WHEN 'view' THEN '203.0.113.9, 203.0.113.7' END"
)


def status_of_event() -> F.Column:
    return match_rules(F.col("event_type"), [(f"^{t}$", s) for t, s in STATUS.items()], 0)


def address_of_user() -> F.Column:
    high = F.expr("user_id div 256") % 256
    return F.concat(F.lit("198.51."), high, F.lit("."), F.col("user_id") % 256)


def forwarded_for_of_event() -> F.Column:
    return F.when(F.col("event_type") == "error", "203.0.113.9").when(
        F.col("event_type") == "view", "203.0.113.9, 203.0.113.7"
    )


def event_lines(events: DataFrame) -> DataFrame:
    """(event_id, value): a log line per event; those of small value are broken off."""
    ninth = F.when(F.col("event_type") == "signup", F.lit(' "-"')).when(
        F.col("event_type") != "purchase",
        F.concat(F.lit(' "'), F.coalesce(forwarded_for_of_event(), F.lit("-")), F.lit('"')),
    ).otherwise("")
    line = F.concat(
        address_of_user(), F.lit(" - "),
        F.when(F.col("event_type") == "click", "-").otherwise(F.concat(F.lit("u"), "user_id")),
        F.lit(" ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "GET /'),
        "event_type", F.lit("/"), "user_id", F.lit('?v=1 HTTP/1.1" '), status_of_event(), F.lit(" "),
        F.round(F.col("value") * 100).cast("bigint"), F.lit(' "-" "agent/'), "event_type", F.lit('"'), ninth,
    )
    return events.select("event_id", F.when(F.col("value") < 2, F.lit("broken line")).otherwise(line).alias("value"))


FIELDS_SQL = f"""
    value < 2 AS malformed,
    CASE WHEN value >= 2 THEN {ADDRESS_SQL} END AS remote_addr,
    CASE WHEN value >= 2 AND event_type <> 'click' THEN 'u' || user_id END AS remote_user,
    CASE WHEN value >= 2 THEN date_trunc('second', ts) END AS time_local,
    CASE WHEN value >= 2 THEN 'GET /' || event_type || '/' || user_id || '?v=1 HTTP/1.1' END AS request,
    CASE WHEN value >= 2 THEN {STATUS_SQL} END AS status,
    CASE WHEN value >= 2 THEN CAST(round(value * 100) AS BIGINT) END AS body_bytes_sent,
    CAST(NULL AS VARCHAR) AS referer,
    CASE WHEN value >= 2 THEN 'agent/' || event_type END AS user_agent,
    CASE WHEN value >= 2 THEN {FORWARDED_SQL} END AS forwarded_for
"""


def zone_free(parsed: DataFrame) -> DataFrame:
    return parsed.withColumn("time_local", utc(F.col("time_local")))


@query(f"SELECT event_id, {FIELDS_SQL} FROM events")
def access_log_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zone_free(parse_access_log(event_lines(table(spark, sf_dir, "events"))))


@query(f"""
    SELECT status, count(*) AS lines, CAST(sum(CAST(malformed AS INT)) AS BIGINT) AS broken,
           CAST(sum(body_bytes_sent) AS BIGINT) AS sent,
           max(time_local) AS latest
    FROM (SELECT {FIELDS_SQL} FROM events) GROUP BY status
""")
def access_log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines written as text files and read from there."""
    folder = fresh_folder(spark, "access-log")
    event_lines(table(spark, sf_dir, "events")).select("value").write.text(folder)
    parsed = zone_free(read_access_log(spark, folder))
    return parsed.groupBy("status").agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum(F.col("malformed").cast("int")).alias("broken"),
        F.sum("body_bytes_sent").alias("sent"),
        F.max("time_local").alias("latest"),
    )


@query(f"SELECT {FIELDS_SQL} FROM events")
def access_log_text_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines written as text files and read from there as a stream."""
    folder = fresh_folder(spark, "access-log")
    event_lines(table(spark, sf_dir, "events")).select("value").write.text(folder)
    return zone_free(drain(read_access_log(spark, folder, streaming=True), "access-log"))


@query(f"SELECT event_id, {FIELDS_SQL} FROM events")
def access_log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same parse on a stream of the table's files."""
    schema = table(spark, sf_dir, "events").schema
    events = stream_files(spark, sf_dir, schema, only="events.parquet")
    return zone_free(drain(parse_access_log(event_lines(events)), "access-log"))


@query(f"""
    SELECT event_id, {STATUS_SQL} AS status,
           CASE WHEN event_type IN ('signup', 'click') THEN 0 ELSE 1 END AS loggable,
           CASE WHEN regexp_matches(CAST(({STATUS_SQL}) AS VARCHAR), '^[45]') THEN 'failed'
                WHEN regexp_matches(CAST(({STATUS_SQL}) AS VARCHAR), '0.$') THEN 'plain' ELSE 'other' END AS outcome
    FROM events
""")
def status_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = table(spark, sf_dir, "events").select("event_id", status_of_event().alias("status"))
    return flagged.withColumns({
        "loggable": loggable_flag(F.col("status")),
        "outcome": match_rules(F.col("status"), [("^[45]", "failed"), ("0.$", "plain")], "other"),
    })


@query(f"SELECT event_id, event_type FROM events WHERE event_type NOT IN ('signup', 'click')")
def loggable_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    flagged = events.withColumn("flag", loggable_flag(status_of_event()))
    return keep_loggable(flagged, "flag").drop("flag")


LEVELS = {"view": "debug", "click": "info", "signup": "warn", "error": "error", "purchase": "crit"}


@query("""
    SELECT event_id, CASE event_type WHEN 'signup' THEN 'warn' WHEN 'error' THEN 'error' ELSE 'crit' END AS level
    FROM events WHERE event_type IN ('signup', 'error', 'purchase')
""")
def severity_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = match_rules(F.col("event_type"), list(LEVELS.items()), "unknown")
    return severity_at_least(table(spark, sf_dir, "events").select("event_id", level.alias("level")), "level", "warn")


@query("""
    SELECT string_split(p_name, ' ')[1] AS first_word, count(*) AS parts
    FROM part WHERE regexp_matches(p_name, 'blue|bolt') GROUP BY 1
""")
def line_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "part").select(
        F.concat(F.lit("  "), "p_partkey", F.lit(" \t "), "p_name", F.lit(" "), "p_size").alias("value")
    )
    picked = filter_pick(lines, "value", "blue|bolt", 2, "first_word")
    return picked.groupBy("first_word").agg(F.count(F.lit(1)).alias("parts"))


@query("""
    SELECT s_suppkey, s_suppkey + 9000 AS http_port, s_suppkey + 9100 AS admin_port, s_suppkey + 9200 AS stop_port
    FROM supplier
""")
def port_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    services = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") + 9000).alias("http_port"))
    return derive_offsets(services, "http_port", {"admin_port": 100, "stop_port": 200})


@query(f"""
    SELECT event_id, {ADDRESS_SQL} AS x_real_ip, 'https' AS x_forwarded_proto,
           concat_ws(', ', {FORWARDED_SQL}, {ADDRESS_SQL}) AS x_forwarded_for, event_type || '.example.org' AS x_host
    FROM events
""")
def proxied_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = table(spark, sf_dir, "events").select(
        "event_id",
        address_of_user().alias("remote_addr"),
        F.lit("https").alias("scheme"),
        F.coalesce(forwarded_for_of_event(), F.lit("")).alias("forwarded_for"),
        F.concat("event_type", F.lit(".example.org")).alias("host"),
    )
    return forward_headers(requests).drop("remote_addr", "scheme", "forwarded_for", "host")


@query("""
    SELECT event_id, event_type AS "group", unnest(['u' || user_id, regexp_extract(props, '\\d+')]) AS member
    FROM events
""")
def json_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of arrays around ``props``; the quotes of some event types are escaped."""
    text = F.concat(
        F.lit('{"'), "event_type", F.lit('":["u'), "user_id", F.lit('","'),
        F.regexp_extract("props", r"\d+", 0), F.lit('"],"none":[]}'),
    )
    escaped = F.when(F.col("event_type").isin("click", "view"), F.replace(text, F.lit('"'), F.lit('\\\\\\"')))
    objects = table(spark, sf_dir, "events").select("event_id", F.coalesce(escaped, text).alias("value"))
    return explode_json_groups(objects, "value")


CIDRS = [
    ("198.51.0.0/16", 1), ("198.51.0.0/24", 2), ("198.51.0.64/26", 3), ("198.51.0.100/32", 4),
    ("198.51.4.0/23", 5), ("203.0.113.0/24", 6),
]


@query("""
    SELECT event_id, CASE
        WHEN event_type = 'signup' THEN 0 WHEN event_type = 'error' THEN 6
        WHEN v = 100 THEN 4 WHEN v BETWEEN 64 AND 127 THEN 3 WHEN v < 256 THEN 2
        WHEN v BETWEEN 1024 AND 1535 THEN 5 ELSE 1 END AS value
    FROM (SELECT *, (event_id * 7 + user_id) % 2048 AS v FROM events)
""")
def address_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses spread over all ranges, whatever the number of users."""
    v = (F.col("event_id") * 7 + F.col("user_id")) % 2048
    address = (
        F.when(F.col("event_type") == "signup", F.lit("198.51.0.300"))
        .when(F.col("event_type") == "error", F.concat(F.lit("203.0.113."), F.col("user_id") % 256))
        .otherwise(F.concat(F.lit("198.51."), F.floor(v / 256), F.lit("."), v % 256))
    )
    requests = table(spark, sf_dir, "events").select("event_id", address.alias("ip"))
    ranges = spark.createDataFrame(CIDRS, "cidr string, value int")
    return cidr_lookup(requests, "ip", ranges, 0).drop("ip")


SPAN_SQL = """
    spans AS (SELECT c_custkey AS value, c_custkey % 2 = 1 AS pair,
                     CASE WHEN c_custkey % 2 = 1 THEN c_custkey * 97 % 131072 ELSE c_custkey * 97 % 131072 // 64 * 64 END AS low,
                     CASE WHEN c_custkey % 2 = 1 THEN c_custkey % 300 ELSE 63 END AS more FROM customer WHERE c_custkey % 11 <> 5),
    asked AS (SELECT event_id, (event_id * 31 + user_id) % 140000 AS v FROM events)
"""


@query(f"""
    WITH {SPAN_SQL}
    SELECT event_id, coalesce(arg_max(value, {{'narrow': -more, 'later': low, 'value': value}}), -1) AS value
    FROM asked LEFT JOIN spans ON v BETWEEN low AND low + more GROUP BY event_id
""")
def address_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range per customer, as first and last address or as a prefix, overlapping in every way."""

    def dotted(number: F.Column) -> F.Column:
        return F.concat(F.lit("198."), 51 + F.floor(number / 65536), F.lit("."), F.floor(number / 256) % 256, F.lit("."), number % 256)

    key = F.col("c_custkey")
    low = key * 97 % 131072
    pair = F.concat(dotted(low), F.lit("-"), dotted(low + key % 300))
    cidr = F.when(key % 2 == 1, pair).otherwise(F.concat(dotted(low), F.lit("/26")))
    value = F.when(key % 11 != 5, key)  # a range without a value says nothing
    ranges = table(spark, sf_dir, "customer").select(cidr.alias("cidr"), value.alias("value"))
    asked = table(spark, sf_dir, "events").select("event_id", dotted((F.col("event_id") * 31 + F.col("user_id")) % 140000).alias("ip"))
    return cidr_lookup(asked, "ip", ranges, F.lit(-1).cast("bigint")).drop("ip")


SUBSTITUTE = '{"error":"upstream","code":502}'


@query(f"""
    SELECT event_id, CASE
        WHEN event_type = 'error' AND user_id % 7 IN (1, 2) THEN '{SUBSTITUTE}'
        WHEN event_type = 'click' AND user_id % 7 = 3 THEN '' ELSE props END AS body,
        (event_type = 'error' AND user_id % 7 IN (1, 2)) OR (event_type = 'click' AND user_id % 7 = 3) AS replaced
    FROM events
""")
def substituted_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(F.lit("h"), F.col("user_id") % 7).alias("host"),
        status_of_event().alias("status"),
        F.col("props").alias("body"),
    )
    bodies = spark.createDataFrame(
        [("h1", 502, SUBSTITUTE), ("h2", 502, SUBSTITUTE), ("h3", 304, "")], "host string, status int, body string"
    )
    return substitute_by_status(answers, bodies, substituted_col="replaced").drop("host", "status")


def served_events(events: DataFrame) -> DataFrame:
    status = status_of_event()
    return events.select(
        "event_id", F.col("event_type").alias("service"), status.alias("status"), loggable_flag(status).alias("loggable")
    )


SPLIT_SQL = f"""
    SELECT event_id, event_type AS service, {STATUS_SQL} AS status
    FROM events WHERE event_type NOT IN ('signup', 'click')
"""


@query(SPLIT_SQL)
def split_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written by service and read back."""
    served, folder = served_events(table(spark, sf_dir, "events")), fresh_folder(spark, "split-log")
    write_split_log(served, folder, "service", "loggable")
    return spark.read.schema(served.schema).parquet(folder).drop("loggable")


@query(SPLIT_SQL)
def split_log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream of the table's files."""
    schema = table(spark, sf_dir, "events").schema
    served = served_events(stream_files(spark, sf_dir, schema, only="events.parquet"))
    folder, checkpoint = fresh_folder(spark, "split-log"), fresh_folder(spark, "split-log-checkpoint")
    write_split_log(served, folder, "service", "loggable", checkpoint, available_now=True).awaitTermination()
    return spark.read.schema(served.schema).parquet(folder).drop("loggable")


@query(SPLIT_SQL)
def split_log_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream of four files, a batch each."""
    events, parts = table(spark, sf_dir, "events"), fresh_folder(spark, "events")
    events.repartitionByRange(4, "event_id").write.parquet(parts)
    served = served_events(stream_files(spark, parts, events.schema, files_per_batch=1))
    folder, checkpoint = fresh_folder(spark, "split-log"), fresh_folder(spark, "split-log-checkpoint")
    write_split_batches(served, folder, "service", "loggable", checkpoint, available_now=True).awaitTermination()
    return read_split_batches(spark, folder, served.schema).drop("loggable")
