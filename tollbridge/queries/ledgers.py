"""Certificate ledgers and requests composed from the business tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tollbridge.functions.text import parse_subject
from tollbridge.operators.certificates import ANYTHING_POLICY, MATCH_POLICY, attach_certificate, certificate_at, check_policy
from tollbridge.operators.ledgers import diff_snapshots, mark_unique_subject
from tollbridge.operators.ordered import assign_serials, next_serial
from tollbridge.operators.rows import derive_expiry, explode_names
from tollbridge.operators.snapshots import change_counts, write_snapshot
from tollbridge.plans.certificates import issue_certificates, read_issued, stream_certificates
from tollbridge.queries.registry import query, table, utc
from tollbridge.queries.requests import REQUESTS_SQL, page_requests
from tollbridge.session import fresh_folder
from tollbridge.sources.ledger import read_ledger
from tollbridge.streaming.files import stream_files

COUNTER = "1C"


def customer_subject() -> F.Column:
    """Segments as organizations, a unit for some, and a value holding a slash."""
    return F.concat(
        F.lit("/C=XX/ST=YY/O="), "c_mktsegment",
        F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("/OU=Unit "), "c_nationkey")).otherwise(""),
        F.lit("/CN=c"), "c_custkey", F.lit(".example.org/emailAddress=a/b@example.org"),
    )


@query("""
    SELECT c_custkey, 'XX' AS country, c_mktsegment AS organization,
           CASE WHEN c_acctbal >= 0 THEN 'Unit ' || c_nationkey END AS unit,
           'c' || c_custkey || '.example.org' AS name, 'a/b@example.org' AS email FROM customer
""")
def subject_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both spellings: slashes, and for every other nation ``, `` with blanks around the sign."""
    slashed = customer_subject()
    dumped = F.regexp_replace(F.regexp_replace(slashed, r"^/", ""), r"/(?=(ST|O|OU|CN|emailAddress)=)", ", ")
    dumped = F.regexp_replace(dumped, "=", " = ")
    text = F.when(F.col("c_nationkey") % 2 == 0, slashed).otherwise(dumped)
    parsed = table(spark, sf_dir, "customer").select("c_custkey", parse_subject(text).alias("s"))
    fields = {"country": "C", "organization": "O", "unit": "OU", "name": "CN", "email": "emailAddress"}
    return parsed.select("c_custkey", *[F.try_element_at("s", F.lit(k)).alias(n) for n, k in fields.items()])


@query("""
    SELECT CASE WHEN c_acctbal < 0 THEN 'R' ELSE 'V' END AS status,
           TIMESTAMP '2026-01-01' + to_seconds(CAST(c_custkey AS BIGINT)) AS not_after,
           CAST(NULL AS VARCHAR) AS c3, c_custkey AS serial, 'unknown' AS filename,
           'c' || c_custkey || '.example.org' AS name, c_mktsegment AS organization
    FROM customer
""")
def ledger_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger lines written as text files and read from there."""
    moment = F.lit("2026-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("c_custkey"))
    digits = F.hex("c_custkey")
    line = F.concat_ws(
        "\t",
        F.when(F.col("c_acctbal") < 0, "R").otherwise("V"),
        F.concat(F.date_format(moment, "yyMMddHHmmss"), F.lit("Z")),
        F.lit(""),
        F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits),
        F.lit("unknown"),
        customer_subject(),
    )
    folder = fresh_folder(spark, "ledger")
    table(spark, sf_dir, "customer").select(line.alias("value")).write.text(folder)
    return read_ledger(spark, folder).select(
        "status", utc(F.col("not_after")).alias("not_after"), "c3", "serial", "filename",
        F.col("subject")["CN"].alias("name"), F.col("subject")["O"].alias("organization"),
    )


def page_certificates(spark: SparkSession, sf_dir: str, every: bool = False) -> DataFrame:
    """One certificate per page and a second name: of every page, or so that hosts of odd length have none."""
    requests = page_requests(table(spark, sf_dir, "pages"))
    names = F.concat(F.lit("DNS:"), "host", F.lit(", DNS:alt."), "host", F.lit(", IP Address:192.0.2.1"))
    named = requests if every else requests.filter(F.length("host") % 2 == 0)
    return named.select(F.col("page_id").alias("serial"), names.alias("names_text"))


@query(f"""
    WITH {REQUESTS_SQL} SELECT page_id AS serial, unnest([host, 'alt.' || host]) AS name
    FROM requests
""")
def certificate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_names(page_certificates(spark, sf_dir, every=True))


@query(f"""
    WITH {REQUESTS_SQL}
    SELECT page_id, host, CASE WHEN length(host) % 2 = 0 THEN max(page_id) OVER (PARTITION BY host) END AS cert_serial
    FROM requests
""")
def host_certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = page_requests(table(spark, sf_dir, "pages")).select("page_id", "host")
    return attach_certificate(hosts, page_certificates(spark, sf_dir))


@query(f"WITH {REQUESTS_SQL} SELECT DISTINCT host FROM requests WHERE length(host) % 2 = 1")
def uncovered_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = page_requests(table(spark, sf_dir, "pages")).select("host")
    return attach_certificate(hosts, page_certificates(spark, sf_dir), uncovered=True)


@query(f"""
    WITH {REQUESTS_SQL},
    valid AS (SELECT page_id AS serial, unnest([host, 'alt.' || host]) AS host, TIMESTAMP '2024-01-01' + to_days(CAST(page_id * 37 % 700 AS INTEGER)) AS low,
                     CASE WHEN page_id % 9 > 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(page_id * 37 % 700 + page_id % 5 * 60 AS INTEGER)) END AS high
              FROM requests),
    asked AS (SELECT page_id, host, TIMESTAMP '2024-01-01' + to_days(CAST(page_id * 13 % 900 AS INTEGER)) AS moment FROM requests)
    SELECT page_id, a.host, max(serial) AS cert_serial
    FROM asked a LEFT JOIN valid v ON a.host = v.host AND moment >= low AND (high IS NULL OR moment <= high) GROUP BY page_id, a.host
""")
def certificates_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A certificate per page, each valid for a time of its own, some without end: which was valid then?"""
    key = F.col("page_id")

    def day(number: F.Column) -> F.Column:
        return F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(days=number.cast("int"))

    certs = page_certificates(spark, sf_dir, every=True).select(
        "serial", "names_text", day(F.col("serial") * 37 % 700).alias("not_before"),
        F.when(F.col("serial") % 9 > 0, day(F.col("serial") * 37 % 700 + F.col("serial") % 5 * 60)).alias("not_after"),
    )
    asked = page_requests(table(spark, sf_dir, "pages")).select("page_id", "host", day(key * 13 % 900).alias("at"))
    return certificate_at(asked, certs).drop("at")


@query("SELECT event_id, ts + INTERVAL 824 DAY AS not_after FROM events")
def certificate_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive_expiry(table(spark, sf_dir, "events").select("event_id", "ts"), "ts").drop("ts")


AUTHORITY = {"C": "XX", "ST": "ASIA", "O": "Org"}


@query("""
    WITH judged AS (
        SELECT s_suppkey, concat_ws(',', CASE WHEN r_name <> 'ASIA' THEN 'ST' END,
               CASE WHEN s_suppkey % 3 = 0 THEN 'O' END, CASE WHEN s_acctbal < 0 THEN 'CN' END) AS reasons,
               s_acctbal >= 0 AS accepted_by_any
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
    SELECT s_suppkey, reasons, reasons = '' AS accepted, accepted_by_any FROM judged
""")
def policy_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = supplier_requests(spark, sf_dir)
    loose = check_policy(requests, AUTHORITY, ANYTHING_POLICY)
    loose = loose.select("s_suppkey", "subject", F.col("accepted").alias("accepted_by_any"))
    strict = check_policy(loose, AUTHORITY)
    return strict.select("s_suppkey", F.array_join("reasons", ",").alias("reasons"), "accepted", "accepted_by_any")


@query("""
    WITH judged AS (
        SELECT s_suppkey, concat_ws(',', CASE WHEN s_acctbal < 0 THEN 'CN' END, CASE WHEN s_suppkey % 3 = 0 THEN 'O' END,
               CASE WHEN r_name <> 'ASIA' THEN 'ST' END) AS reasons
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
    SELECT s_suppkey, reasons, reasons = '' AS accepted FROM judged
""")
def policy_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strict policy with authority and policy as tables; its fields are judged by name."""
    authority = spark.createDataFrame([(AUTHORITY,)], "subject map<string,string>")
    policy = spark.createDataFrame(list(MATCH_POLICY.items()), "field string, rule string")
    strict = check_policy(supplier_requests(spark, sf_dir), authority, policy)
    return strict.select("s_suppkey", F.array_join("reasons", ",").alias("reasons"), "accepted")


def supplier_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier as a request whose subject names its region."""
    nations = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    suppliers = table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    subject = F.concat(
        F.lit("/C=XX/ST="), "r_name",
        F.when(F.col("s_suppkey") % 3 == 0, "/O=Other").otherwise("/O=Org"),
        F.when(F.col("s_suppkey") % 2 == 0, "/OU=Unit").otherwise(""),
        F.when(F.col("s_acctbal") >= 0, F.concat(F.lit("/CN=s"), "s_suppkey")).otherwise(""),
    )
    return suppliers.select("s_suppkey", parse_subject(subject).alias("subject"))


@query("""
    SELECT o_orderkey, CAST(27 + n AS BIGINT) AS serial, printf('%02X', CAST(27 + n AS BIGINT)) AS serial_hex
    FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS n FROM orders)
""")
def order_serials(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return assign_serials(orders, ["o_orderdate", "o_orderkey"], COUNTER).drop("o_orderdate")


@query("""
    SELECT CAST(28 + count(*) AS BIGINT) AS next_serial, printf('%02X', CAST(28 + count(*) AS BIGINT)) AS next_serial_hex FROM orders
""")
def next_order_serial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counter to store after all orders are numbered."""
    return next_serial(order_serials(spark, sf_dir), COUNTER)


@query("""
    WITH subjects AS (SELECT doc_id, md5(text) AS subject, source FROM documents),
    firsts AS (SELECT subject, min(doc_id) AS doc_id FROM subjects GROUP BY 1)
    SELECT s.doc_id, s.subject, f.doc_id IS NOT NULL AND s.subject NOT IN (
        SELECT subject FROM subjects WHERE source = 'src0') AS accepted
    FROM subjects s LEFT JOIN firsts f ON s.subject = f.subject AND s.doc_id = f.doc_id
""")
def unique_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as subjects, against the ledger of one source; accepted and rejected rows together."""
    subjects = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("subject"), "source")
    ledger = subjects.filter("source = 'src0'").select("subject")
    return mark_unique_subject(subjects.drop("source"), ledger, "doc_id")


@query("""
    WITH o AS (SELECT c_custkey, c_mktsegment AS seg, CAST(round(c_acctbal * 100) AS BIGINT) AS cents
               FROM customer WHERE c_nationkey <> 3),
    n AS (SELECT c_custkey, CASE WHEN c_nationkey <> 7 THEN c_mktsegment END AS seg,
                 CAST(round(c_acctbal * 100) AS BIGINT) + CASE c_nationkey WHEN 5 THEN 1 ELSE 0 END AS cents
          FROM customer WHERE c_mktsegment <> 'BUILDING')
    SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, o.seg AS old_seg, n.seg AS new_seg,
           coalesce(CAST(o.cents AS VARCHAR), '') AS old_cents, coalesce(CAST(n.cents AS VARCHAR), '') AS new_cents,
           CASE WHEN o.c_custkey IS NULL THEN 'added' WHEN n.c_custkey IS NULL THEN 'removed'
                WHEN o.seg IS NOT DISTINCT FROM n.seg AND o.cents = n.cents THEN 'same' ELSE 'changed' END AS change
    FROM o FULL JOIN n ON o.c_custkey = n.c_custkey
""")
def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    cents = F.round(F.col("c_acctbal") * 100).cast("bigint")
    old = customers.filter("c_nationkey <> 3").select("c_custkey", F.col("c_mktsegment").alias("seg"), cents.alias("cents"))
    new = customers.filter("c_mktsegment <> 'BUILDING'").select(
        "c_custkey",
        F.when(F.col("c_nationkey") != 7, F.col("c_mktsegment")).alias("seg"),
        (cents + F.when(F.col("c_nationkey") == 5, 1).otherwise(0)).alias("cents"),
    )
    changes = diff_snapshots(old, new, ["c_custkey"])
    shown = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("old_cents", "new_cents")}
    return changes.withColumns(shown)


@query("""
    WITH o AS (SELECT c_custkey, c_name AS name FROM customer WHERE c_custkey % 997 <> 1),
    n AS (SELECT c_custkey, CASE WHEN c_custkey % 991 = 2 THEN NULL ELSE c_name END AS name FROM customer WHERE c_custkey % 983 <> 3),
    pairs AS (SELECT CASE WHEN o.c_custkey IS NULL THEN 'added' WHEN n.c_custkey IS NULL THEN 'removed'
                         WHEN o.name IS NOT DISTINCT FROM n.name THEN 'same' ELSE 'changed' END AS change
             FROM o FULL JOIN n ON o.c_custkey = n.c_custkey)
    SELECT change, count(*) AS n FROM pairs GROUP BY change
""")
def snapshot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stored snapshots with few differences: most buckets are only counted."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"))
    old, new = customers.filter("c_custkey % 997 <> 1"), customers.filter("c_custkey % 983 <> 3")
    new = new.withColumn("name", F.when(F.col("c_custkey") % 991 != 2, F.col("name")))
    paths = fresh_folder(spark, "snapshot-old"), fresh_folder(spark, "snapshot-new")
    for rows, path in zip((old, new), paths):
        write_snapshot(rows, path, ["c_custkey"], buckets=64)
    return change_counts(spark, *paths, ["c_custkey"])


@query("""
    WITH subjects AS (SELECT o_orderkey, o_orderdate, o_orderstatus, o_custkey || '.' || o_orderpriority AS name FROM orders),
    fresh AS (SELECT name, min(o_orderkey) AS o_orderkey FROM subjects WHERE o_orderstatus = 'O' GROUP BY 1),
    known AS (SELECT DISTINCT c_custkey || '.1-URGENT' AS name FROM customer)
    SELECT s.o_orderkey AS arrival, s.name, s.o_orderdate AS not_before, s.o_orderdate + INTERVAL 824 DAY AS not_after,
           CAST(27 + row_number() OVER (ORDER BY s.o_orderkey) AS BIGINT) AS serial
    FROM subjects s JOIN fresh f ON s.o_orderkey = f.o_orderkey
    WHERE s.name NOT IN (SELECT name FROM known)
""")
def issued_certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as requests: one organization is the authority's, urgent names are taken."""
    ledger = table(spark, sf_dir, "customer").select(
        order_subject(F.lit("O"), F.concat("c_custkey", F.lit(".1-URGENT"))).alias("subject")
    )
    issued = issue_certificates(order_requests(table(spark, sf_dir, "orders")), ledger, ORDERS_AUTHORITY, COUNTER)
    return issued.select("arrival", F.col("subject")["CN"].alias("name"), "not_before", "not_after", "serial")


ORDERS_AUTHORITY = {"C": "XX", "ST": "YY", "O": "O"}


def order_subject(organization: F.Column, common_name: F.Column) -> F.Column:
    return parse_subject(F.concat(F.lit("/C=XX/ST=YY/O="), organization, F.lit("/CN="), common_name))


def order_requests(orders: DataFrame) -> DataFrame:
    name = F.concat("o_custkey", F.lit("."), "o_orderpriority")
    return orders.select(
        F.col("o_orderkey").alias("arrival"), F.col("o_orderdate").alias("not_before"),
        order_subject(F.col("o_orderstatus"), name).alias("subject"),
    )


@query("""
    WITH subjects AS (SELECT o_orderkey, o_orderdate, o_custkey || '.' || o_orderpriority AS name FROM orders WHERE o_orderstatus = 'O'),
    fresh AS (SELECT name, min(o_orderkey) AS o_orderkey FROM subjects GROUP BY 1)
    SELECT s.o_orderkey AS arrival, s.name, s.o_orderdate AS not_before, s.o_orderdate + INTERVAL 824 DAY AS not_after,
           CAST(27 + row_number() OVER (ORDER BY s.o_orderkey) AS BIGINT) AS serial
    FROM subjects s JOIN fresh f ON s.o_orderkey = f.o_orderkey
""")
def issued_certificates_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders arriving as a stream, into a ledger that begins empty."""
    schema = table(spark, sf_dir, "orders").schema
    requests = order_requests(stream_files(spark, sf_dir, schema, only="orders.parquet"))
    folder, checkpoint = fresh_folder(spark, "ledger"), fresh_folder(spark, "ledger-checkpoint")
    stream_certificates(requests, folder, checkpoint, ORDERS_AUTHORITY, COUNTER, available_now=True).awaitTermination()
    issued = read_issued(spark, folder, requests.schema)
    return issued.select("arrival", F.col("subject")["CN"].alias("name"), "not_before", "not_after", "serial")
