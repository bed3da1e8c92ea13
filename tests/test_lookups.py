"""Routes, ranges, redirects, limits, certificates; with broadcast joins and without."""

import ipaddress
import random
import re

import pytest
from pyspark.sql import functions as F

from tollbridge.operators.certificates import attach_certificate, certificate_at, check_policy
from tollbridge.operators.intervals import disjoint_segments, value_at
from tollbridge.operators.ranges import cidr_lookup
from tollbridge.operators.responses import flag_oversize, redirect_requests, substitute_by_status
from tollbridge.operators.routing import attach_upstream, route_requests

ROUTES = (
    "port int, host string, host_kind string, modifier string, path string, target string, internal boolean, "
    "replacement_uri string, rule_ord int"
)
REGEX_HOST = r"^(\w+)\.stage\.example\.(net|org)$"
FIXED_ROUTES = [
    (443, "a.example.org", "exact", "", "/", "up-a", False, None, 0),
    (443, "a.example.org", "exact", "", "/api", "docs", False, None, 0),
    (443, "a.example.org", "exact", "=", "/api/one", "one", False, "/v2/one", 0),
    (443, "a.example.org", "exact", "^~", "/errors/", "files", True, None, 0),
    (443, "example.*", "wildcard", "", "/", "up-w", False, None, 0),
    (443, REGEX_HOST, "regex", "", "/", "up-r", False, None, 0),
]


@pytest.fixture(params=["broadcast", "shuffled", "salted"])
def joins(request, setting):
    if request.param != "broadcast":
        setting("spark.tollbridge.broadcast.maxRows", 0)
        setting("spark.sql.autoBroadcastJoinThreshold", -1)
        setting("spark.sql.shuffle.partitions", 3)
    if request.param == "salted":
        setting("spark.tollbridge.join.salts", 3)
        setting("spark.sql.adaptive.skewJoin.enabled", "false")
    return request.param


def test_routes(spark, joins):
    cases = [
        (443, "a.example.org", "/x", "up-a", "/x", "proxy"),
        (443, "a.example.org", "/api/two", "docs", "/api/two", "proxy"),
        (443, "a.example.org", "/api/one", "one", "/v2/one", "proxy"),
        (443, "a.example.org", "/api/one?q=1", "one", "/v2/one?q=1", "proxy"),
        (443, "a.example.org", "/apix", "docs", "/apix", "proxy"),
        (443, "a.example.org", "/errors/502.json", None, "/errors/502.json", "deny"),
        (443, "example.net", "/", "up-w", "/", "proxy"),
        (443, "q.stage.example.net", "/", "up-r", "/", "proxy"),
        (80, "a.example.org", "/", None, "/", "none"),
        (443, "none.example.com", "/", None, "/", "none"),
        (443, "a.example.org", "//api//one", "up-a", "//api//one", "proxy"),
        (443, None, "/", None, "/", "none"),
    ]
    requests = spark.createDataFrame(
        [(n, *c[:3]) for n, c in enumerate(cases)], "req_id bigint, port int, host string, uri string"
    )
    routes = spark.createDataFrame(FIXED_ROUTES, ROUTES)
    got = route_requests(requests, routes).orderBy("req_id").collect()
    assert [tuple(r)[4:] for r in got] == [c[3:] for c in cases]
    merged = route_requests(requests.filter("req_id = 10"), routes, merge_slashes=True).first()
    assert (merged["target"], merged["routed_uri"]) == ("one", "/v2/one")
    plain = routes.drop("replacement_uri", "rule_ord")
    assert route_requests(requests, plain).filter("target = 'one' and routed_uri = uri").count() == 2


def route_by_hand(routes, port, host, uri):
    path = re.split(r"[?#]", uri)[0]
    mine = [r for r in routes if r[0] == port]
    chosen = [r for r in mine if r[2] == "exact" and r[1] == host]
    if not chosen:
        wild = sorted({r[1] for r in mine if r[2] == "wildcard"}, key=lambda h: -len(h))
        wild = [h for h in wild if host.startswith(h[:-1]) and len(host) > len(h) - 1]
        regex = sorted({(r[8], r[1]) for r in mine if r[2] == "regex"})
        regex = [h for _, h in regex if re.search(h, host)]
        kind, name = ("wildcard", wild[0]) if wild else ("regex", regex[0]) if regex else (None, None)
        chosen = [r for r in mine if r[2] == kind and r[1] == name]
    hits = [r for r in chosen if r[3] == "=" and r[4] == path]
    hits = hits or sorted((r for r in chosen if r[3] != "=" and path.startswith(r[4])), key=lambda r: -len(r[4]))
    return None if not hits or hits[0][6] else hits[0][5]


def test_random_routes(spark, joins):
    rng = random.Random(11)
    hosts = [f"h{n}.example.org" for n in range(6)]
    patterns = [("w.*", "wildcard"), ("w.x.*", "wildcard"), (r"^h[0-8]\.", "regex"), (r"example\.net$", "regex")]
    paths = ["/", "/a", "/a/", "/ab", "/a/b", "/a/b/c", "/b", "/b/c", ""]
    routes = {}
    for host, kind in [(h, "exact") for h in hosts] + patterns:
        for port in (80, 443):
            for path in rng.sample(paths, rng.randint(1, 5)):
                for modifier in rng.sample(["", "="], rng.randint(1, 2)):
                    order = [p for p, _ in patterns].index(host) if kind == "regex" else 0
                    routes[port, host, kind, modifier, path] = (
                        port, host, kind, modifier, path, f"t{len(routes)}", rng.random() < 0.2, None, order)
    routes = list(routes.values())
    names = [*hosts, "h7.example.org", "h9.example.net", "w.x.y", "w.y", "w.", "other"]
    cases = [(n, rng.choice([80, 443, 8080]), rng.choice(names), rng.choice(paths) + rng.choice(["", "c", "/d", "?a=/b"]))
             for n in range(400)]
    requests = spark.createDataFrame(cases, "req_id bigint, port int, host string, uri string")
    got = route_requests(requests, spark.createDataFrame(routes, ROUTES))
    assert {r["req_id"]: r["target"] for r in got.collect()} == {c[0]: route_by_hand(routes, *c[1:]) for c in cases}
    assert got.count() == len(cases)


def test_upstreams(spark, joins):
    df = spark.createDataFrame([("up-a",), ("docs",), (None,), ("up-a",)], "target string")
    upstreams = spark.createDataFrame(
        [("up-a", "192.0.2.1", 9001), ("up-r", "192.0.2.1", 9002)], "name string, address string, port int")
    got = sorted(map(tuple, attach_upstream(df, upstreams).collect()), key=str)
    assert got == [("docs", None, None), ("up-a", "192.0.2.1", 9001), ("up-a", "192.0.2.1", 9001), (None, None, None)]


def test_ranges(spark, joins):
    cidrs = spark.createDataFrame([("198.51.0.0/16", 1), ("198.51.100.0/24", 2), ("junk", 9), ("1.2.3.4/40", 9)],
                                  "cidr string, value int")
    cases = {"198.51.100.5": 2, "198.51.7.5": 1, "203.0.113.1": 0, "bad": 0, None: 0, "198.51.100.256": 0,
             "198.51.100": 0, "255.255.255.255": 0}
    df = spark.createDataFrame([(k,) for k in cases], "ip string")
    assert {r["ip"]: r["value"] for r in cidr_lookup(df, "ip", cidrs, 0).collect()} == cases
    assert {r["value"] for r in cidr_lookup(df, "ip", cidrs.limit(0), 5).collect()} == {5}


def test_random_ranges(spark, joins):
    rng = random.Random(3)
    nets = {}
    for _ in range(60):
        bits = rng.choice([0, 1, 8, 9, 16, 24, 28, 31, 32])
        base = rng.choice([0, 1 << 31, 0xC6336400, 0xFFFFFFFF]) ^ rng.getrandbits(rng.choice([1, 8, 16]))
        net = ipaddress.ip_network((base, bits), strict=False)
        nets[net] = nets.get(net, len(nets) + 1)
    cidrs = spark.createDataFrame([(str(n), v) for n, v in nets.items()], "cidr string, value int")
    ips = [str(ipaddress.ip_address(int(n.network_address) ^ rng.getrandbits(rng.choice([0, 2, 8, 30]) or 1) & 0xFFFFFFFF))
           for n in nets for _ in range(6)]
    best = {}
    for ip in ips:
        holding = [n for n in nets if ipaddress.ip_address(ip) in n]
        best[ip] = nets[max(holding, key=lambda n: n.prefixlen)] if holding else -1
    df = spark.createDataFrame([(ip,) for ip in ips], "ip string")
    got = cidr_lookup(df, "ip", cidrs, -1).collect()
    assert len(got) == len(ips) and all(best[r["ip"]] == r["value"] for r in got)


def test_redirects(spark, joins):
    rules = spark.createDataFrame([
        ("exact", 80, "a.example.org", "https://$host$request_uri"),
        ("exact", 443, "example.org", "https://www.example.org$request_uri"),
        ("regex", 80, REGEX_HOST, "https://$1.stage.example.org$request_uri"),
        ("flag", 443, "b.example.org", "https://status.example.org/?id=1"),
        ("wildcard", 80, "stage.example.*", "https://www.stage.example.org$request_uri"),
    ], "kind string, port int, host string, template string")
    cases = [
        (80, "a.example.org", "/x?y=1", 0, "https://a.example.org/x?y=1", 301),
        (443, "example.org", "/", 0, "https://www.example.org/", 301),
        (80, "q.stage.example.net", "/z$1", 0, "https://q.stage.example.org/z$1", 301),
        (443, "b.example.org", "/deep/path", 1, "https://status.example.org/?id=1", 302),
        (443, "b.example.org", "/deep/path", 0, None, None),
        (80, "stage.example.net", "/", 0, "https://www.stage.example.org/", 301),
        (443, "a.example.org", "/", 1, None, None),
        (443, "q.stage.example.net", "/", 0, None, None),
    ]
    requests = spark.createDataFrame([(n, *c[:4]) for n, c in enumerate(cases)],
                                     "req_id int, port int, host string, uri string, flag int")
    got = redirect_requests(requests, rules, "flag").orderBy("req_id").collect()
    assert [tuple(r)[5:] for r in got] == [c[4:] for c in cases]


def test_limits_and_bodies(spark, joins):
    requests = spark.createDataFrame(
        [("b.example.org", 2097152), ("b.example.org", 2097153), ("a.example.org", 4194304), ("a.example.org", 4194305),
         (None, 1)], "host string, body_bytes bigint")
    limits = spark.createDataFrame([("b.example.org", "2m")], "host string, max_body string")
    got = flag_oversize(requests, limits, "4m").orderBy("body_bytes").collect()
    assert [(r["max_body_bytes"], r["oversize"]) for r in got] == [
        (4194304, False), (2097152, False), (2097152, True), (4194304, False), (4194304, True)]
    answers = spark.createDataFrame(
        [("a.example.org", 502, "own"), ("a.example.org", 200, "own"), ("b.example.org", 502, "own")],
        "host string, status int, body string")
    text = '{"error":"upstream","code":502}'
    bodies = spark.createDataFrame([("a.example.org", 502, text)], answers.schema)
    got = substitute_by_status(answers, bodies).orderBy("host", "status").collect()
    assert [r["body"] for r in got] == ["own", text, "own"]


def test_certificates(spark, joins):
    certs = spark.createDataFrame(
        [(2, "DNS:a.example.org, DNS:b.example.org"), (3, "DNS:b.example.org")], "serial bigint, names_text string")
    hosts = spark.createDataFrame([(f"{h}.example.org",) for h in "abcc"], "host string")
    got = attach_certificate(hosts, certs).orderBy("host").collect()
    assert [r["cert_serial"] for r in got] == [2, 3, None, None]
    assert [r["host"] for r in attach_certificate(hosts, certs, uncovered=True).collect()] == ["c.example.org"]


def test_policy(spark):
    own = {"C": "XX", "ST": "YY", "O": "Org"}
    subjects = [
        ({**own, "OU": "U", "CN": "x"}, True, []),
        ({**own, "O": "Other", "CN": "x"}, False, ["O"]),
        (own, False, ["CN"]),
        ({**own, "CN": "x"}, True, []),
        ({"CN": ""}, False, ["C", "ST", "O", "CN"]),
        (None, False, ["C", "ST", "O", "CN"]),
    ]
    requests = spark.createDataFrame([(n, s[0]) for n, s in enumerate(subjects)], "n int, subject map<string,string>")
    authority = spark.createDataFrame([(own,)], "subject map<string,string>")
    policy = spark.createDataFrame(
        [("C", "match"), ("ST", "match"), ("O", "match"), ("OU", "optional"), ("CN", "supplied")],
        "field string, rule string")
    for got in (check_policy(requests, own), check_policy(requests, authority)):
        assert [(r["accepted"], r["reasons"]) for r in got.orderBy("n").collect()] == [s[1:] for s in subjects]
    assert [r["accepted"] for r in check_policy(requests, own, policy).orderBy("n").collect()] == [s[1] for s in subjects]
    assert all(r["accepted"] for r in check_policy(requests, own, {"OU": "optional"}).collect())
    with pytest.raises(ValueError):
        check_policy(requests, authority.union(authority))
    with pytest.raises(ValueError):
        check_policy(requests, own, {"C": "same"})


@pytest.mark.parametrize("way", ["salted", "split"])
def test_a_hot_key_is_spread(spark, setting, way):
    """A third of the rows share one host; without broadcast they go to several tasks."""
    from tollbridge.operators.attach import attach

    setting("spark.tollbridge.broadcast.maxRows", 0)
    setting("spark.sql.autoBroadcastJoinThreshold", -1)
    setting("spark.sql.adaptive.coalescePartitions.enabled", "false")
    if way == "salted":
        setting("spark.sql.adaptive.skewJoin.enabled", "false")
    else:
        setting("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "10k")
        setting("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "1.1")
        setting("spark.sql.adaptive.advisoryPartitionSizeInBytes", "10k")
    numbers = spark.range(0, 30000, 1, 16).withColumn("noise", F.sha2(F.col("id").cast("string"), 256))
    left = numbers.withColumn("host", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")))
    right = left.select("host").distinct().withColumn("v", F.lit(1))
    got = attach(left, right, ["host"])
    assert got.count() == 30000 and got.filter("v is null").count() == 0
    spread = got.filter("host = 'hot' or noise = ''").withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert len(spread) > 3 and max(r["count"] for r in spread) < 7000


def redirected(spark, rules, *asked):
    rules = spark.createDataFrame(rules, "kind string, port int, host string, template string, rule_ord int")
    requests = spark.createDataFrame([(80, h, u) for h, u in asked], "port int, host string, uri string")
    return [r["location"] for r in redirect_requests(requests, rules).collect()]


def test_unanchored_templates_give_the_template_alone(spark):
    rules = [
        ("regex", 80, r"\.example\.com$", "https://x.example.org$request_uri", 1),
        ("regex", 80, r"^(\w+)\.shop", "https://$host/$1$request_uri", 2),
    ]
    assert redirected(spark, rules, ("blog.example.com", "/p?q=$1"), ("a.shop.net", "/\\z"), ("none", "/")) == [
        "https://x.example.org/p?q=$1", "https://a.shop.net/a/\\z", None,
    ]


def test_unknown_variables_and_groups_are_refused(spark):
    for template in ("$scheme://x", "https://$2.x"):
        with pytest.raises(ValueError, match="unknown variable"):
            redirected(spark, [("regex", 80, r"(\w+)[(]\.x", template, 1)], ("a", "/"))


def test_the_smallest_rule_ord_of_a_pattern_counts(spark):
    rules = [("regex", 80, "^a", f"https://{n}", n) for n in (3, 1, 2)]
    assert redirected(spark, rules, ("abc", "/")) == redirected(spark, rules[::-1], ("abc", "/")) == ["https://1"]


def test_many_patterns(spark):
    rules = [("wildcard", 80, f"h{n}.*", f"https://{n}.org$request_uri", 0) for n in range(1_200)]
    assert redirected(spark, rules, ("h7.net", "/x"), ("h1199.net", "/y"), ("h1200.net", "/")) == ["https://7.org/x", "https://1199.org/y", None]


def routed(spark, routes, *asked):
    routes = spark.createDataFrame(routes, ROUTES)
    requests = spark.createDataFrame([(80, h, u) for h, u in asked], "port int, host string, uri string")
    return {(r["host"], r["uri"]): r["target"] for r in route_requests(requests, routes).collect()}


def route(host, kind, path, target, modifier="", rule_ord=0):
    return (80, host, kind, modifier, path, target, False, None, rule_ord)


@pytest.mark.parametrize("rows", [1_000_000, 0])
@pytest.mark.parametrize("listed", [64, 1])
def test_routes_alike_in_every_branch(spark, setting, monkeypatch, rows, listed):
    setting("spark.tollbridge.broadcast.maxRows", rows)
    monkeypatch.setattr("tollbridge.operators.routing.LISTED_ROUTES", listed)
    routes = [
        route("a", "exact", "/", "root"), route("a", "exact", "/x", "x"), route("a", "exact", "/x/y", "xy"),
        route("a", "exact", "/x", "same", "="), route("a", "exact", None, "none"), route(None, "exact", "/", "none"),
        route("blog.*", "wildcard", "/", "wild"), route("blog.*", "regex", "/p", "regex", rule_ord=1),
    ]
    asked = [("a", "/"), ("a", "/x"), ("a", "/x?q"), ("a", "/x/yz"), ("a", "/xa"), ("blog.net", "/p"), ("blog.net", "/q"), ("none", "/"), ("a", None), (None, "/")]
    got = routed(spark, routes, *asked, *asked)
    assert got == dict(zip(asked, ["root", "same", "same", "xy", "x", "wild", "wild", None, None, None]))


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_lengths_cost_no_shuffles(spark, setting):
    setting("spark.tollbridge.broadcast.maxRows", 0)
    requests = spark.createDataFrame([(80, "a", "/x" * 30)], "port int, host string, uri string")
    addresses = spark.createDataFrame([("10.1.2.3",)], "ip string")
    few, many = [], []
    for n, out in ((2, few), (20, many)):
        routes = spark.createDataFrame([route("a", "exact", "/x" * k, str(k)) for k in range(1, n + 1)], ROUTES)
        ranges = spark.createDataFrame([(f"10.0.0.0/{8 + k}", k) for k in range(n)], "cidr string, value int")
        both = route_requests(requests, routes), cidr_lookup(addresses, "ip", ranges, -1)
        out += map(exchanges, both)
        assert both[0].first()["target"] == str(n)
    assert few == many


def test_no_limit(spark):
    requests = spark.createDataFrame([("a", 5)], "host string, body_bytes bigint")
    limits = spark.createDataFrame([("a", "0")], "host string, max_body string")
    assert not flag_oversize(requests, limits, "1").first()["oversize"]


def test_a_range_without_a_value_says_nothing(spark, joins):
    cidrs = spark.createDataFrame([("10.0.0.0/8", 7), ("10.1.0.0/16", None), ("10.2.0.0/16", 8), (None, 5)], "cidr string, value int")
    df = spark.createDataFrame([("10.1.2.3",), ("10.2.2.3",), ("11.1.1.1",)], "ip string")
    assert {r["ip"]: r["value"] for r in cidr_lookup(df, "ip", cidrs, 0).collect()} == {"10.1.2.3": 7, "10.2.2.3": 8, "11.1.1.1": 0}


@pytest.mark.parametrize("largest", [None, 0], ids=["searched", "sorted"])
def test_pairs_and_prefixes(spark, joins, setting, monkeypatch, largest):
    """Ranges of both forms, overlapping in every way, against brute force; few per row, or in one sequence."""
    if largest is not None:
        monkeypatch.setattr("tollbridge.operators.intervals.MAX_SEARCHED", largest)
        setting("spark.tollbridge.order.maxGroupRows", 10)
    rng = random.Random(8)
    spans = []
    for k in range(120):
        low = 0xC6330000 + rng.randrange(1 << 18)
        if k % 3:
            spans.append((low, low + rng.choice([0, 1, 9, 300, 70_000]), k))
        else:
            net = ipaddress.ip_network((low, rng.choice([14, 20, 24, 30, 32])), strict=False)
            spans.append((int(net[0]), int(net[-1]), k))
    spans += [(0, 0xFFFFFFFF, 1000)]
    word = lambda n: str(ipaddress.ip_address(n))
    rows = [(f"{word(a)}-{word(b)}" if k % 3 else f"{word(a)}/{33 - (b - a + 1).bit_length()}", k) for a, b, k in spans[:-1]]
    rows += [("0.0.0.0 - 255.255.255.255", 1000), ("1.2.3.4-1.2.3.3", 5), ("x-y", 6), ("-", 7), (None, 8)]
    ips = [0, 0xFFFFFFFF] + [min(max(x, 0), 0xFFFFFFFF) for a, b, _ in spans for x in (a - 1, a, b, b + 1)]
    best = {word(ip): max((a - b, a, k) for a, b, k in spans if a <= ip <= b)[2] for ip in ips}
    df = spark.createDataFrame([(word(ip),) for ip in ips] + [(None,), ("bad",)], "ip string")
    got = cidr_lookup(df, "ip", spark.createDataFrame(rows, "cidr string, value int"), -1).collect()
    assert len(got) == len(ips) + 2 and all(r["value"] == best.get(r["ip"], -1) for r in got)


@pytest.mark.parametrize("largest", [256, 0], ids=["searched", "sorted"])
def test_certificates_valid_then(spark, joins, monkeypatch, largest):
    monkeypatch.setattr("tollbridge.operators.intervals.MAX_SEARCHED", largest)
    rng = random.Random(9)
    certs = [(n, [f"h{rng.randrange(4)}", "all"], *sorted((rng.randrange(300), rng.randrange(300)))) for n in range(150)]
    certs += [(900, ["h1"], None, 20), (901, ["h2"], 280, None), (None, ["h0"], 0, 300), (902, ["h3"], 50, 40), (903, None, 1, 2)]
    asked = [(f"h{rng.randrange(5)}", rng.randrange(-5, 310)) for _ in range(300)] + [("all", t) for t in range(0, 300, 7)] + [(None, 5), ("h1", None)]
    wanted = sorted((
        (h, t, max((s for s, names, a, b in certs if s is not None and h in (names or []) and t is not None
                    and (a is None or a <= t) and (b is None or t <= b)), default=None)) for h, t in asked), key=str)
    moment = "timestamp_seconds({}) AS {}"
    df = spark.createDataFrame(certs, "serial bigint, names array<string>, a bigint, b bigint")
    df = df.selectExpr("serial", "names", moment.format("a", "not_before"), moment.format("b", "not_after"))
    requests = spark.createDataFrame(asked, "host string, t bigint").selectExpr("host", "t", moment.format("t", "at"))
    got = certificate_at(requests, df)
    assert got.columns == ["host", "t", "at", "cert_serial"]
    assert sorted(((r.host, r.t, r.cert_serial) for r in got.collect()), key=str) == wanted


def test_segments_of_nothing(spark):
    schema = "k string, first bigint, last bigint, r int, v int"
    none = disjoint_segments(spark.createDataFrame([("a", 5, 5, 1, 1), (None, 1, 2, 1, 1), ("a", None, 2, 1, 1)], schema), ["k"], ["r"], "v")
    assert none.count() == 0
    assert value_at(spark.createDataFrame([("a", 3)], "k string, at bigint"), none, ["k"], "at", "v", "w").first()["w"] is None


def test_interval_lookups_have_no_nested_loop(spark, joins):
    certs = spark.createDataFrame([(1, ["a"], None, None)], "serial bigint, names array<string>, not_before timestamp, not_after timestamp")
    requests = spark.createDataFrame([("a", None)], "host string, at timestamp")
    text = certificate_at(requests, certs)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text and "Python" not in text


def test_a_field_named_twice_takes_the_strictest_rule(spark):
    requests = spark.createDataFrame([({"C": "YY", "O": "x"},), ({"C": "XX"},)], "subject map<string,string>")
    rules = [("C", "optional"), ("C", "match"), ("O", "optional"), ("O", "supplied"), (None, "match")]
    policy = spark.createDataFrame(rules, "field string, rule string")
    got = [(r["accepted"], r["reasons"]) for r in check_policy(requests, {"C": "XX"}, policy).collect()]
    assert got == [(False, ["C"]), (False, ["O"])]
    for odd in ("exact", None):
        with pytest.raises(ValueError, match="unknown policy"):
            check_policy(requests, {}, spark.createDataFrame([("C", odd), ("C", "match")], "field string, rule string"))


ODD_PATTERNS = [
    (r"^blog\.(\w+)\.example\.(net|org)$", "regex"), (r"shop|store", "regex"), (r"^(?i)abc\.example", "regex"), (r"colou?r\.example", "regex"),
    (r"^x{2,3}yz\.", "regex"), (r"[abc.]{3}\.end$", "regex"), (r"pre(fix|set)[0-9]+\.host", "regex"), (r"(a(b|c))+tail\.net", "regex"),
    (r"long\-name\.test", "regex"), (r"\Qq.q\E", "regex"), (r".", "regex"), (r"ab+c\.com", "regex"), ("*.example.*", "wildcard"), ("m.*", "wildcard"),
    ("*", "wildcard"), ("a.b*c.d", "wildcard"),
]
ODD_HOSTS = [
    "blog.en.example.net", "my.shop.org", "abc.example", "ABC.example", "color.example", "colour.example", "xxyz.a", "xyz.a", "a.b.end", "prefix12.host",
    "presetx.host", "abactail.net", "long-name.test", "q.q", "qxq", "abbbc.com", "abc.com", "www.example.com", "m.n", "a.bXXc.d", "a.bc.d", "z", "", "\u00e9\u00e9\u00e9.\u00e9",
]


def plain_first(port, host):
    """Of the patterns of this port, by precedence, the first that matches."""
    ranked = sorted(
        ((kind == "regex", -len(h) if kind == "wildcard" else n, h, kind) for n, (h, kind) in enumerate(ODD_PATTERNS) if (n + port) % 3),
    )
    for _, _, h, kind in ranked:
        regex = h.replace(r"\Q", "").replace(r"\E", "").replace("q.q", r"q\.q") if kind == "regex" else "^" + "[^/]+".join(map(re.escape, h.split("*"))) + "$"
        if regex.startswith("^(?i)"):
            regex = "(?i)^" + regex[5:]
        if re.search(regex, host):
            return h
    return None


def test_many_patterns_equal_few(spark, joins, monkeypatch):
    """Patterns found by their literals against trying each, for routes and for redirects."""
    monkeypatch.setattr("tollbridge.operators.hosts.CASES", 2)
    monkeypatch.setattr("tollbridge.operators.responses.CASES", 2)
    rules = [(port, h, kind, n) for port in (80, 443) for n, (h, kind) in enumerate(ODD_PATTERNS) if (n + port) % 3]
    routes = spark.createDataFrame([(p, h, k, "", "/", h, False, None, n) for p, h, k, n in rules], ROUTES)
    asked = [(port, h) for port in (80, 443, 8080) for h in ODD_HOSTS] + [(80, None), (None, "z")]
    requests = spark.createDataFrame([(p, h, "/") for p, h in asked], "port int, host string, uri string")
    wanted = {(p, h): plain_first(p, h) if h is not None and p in (80, 443) else None for p, h in asked}
    assert {(r["port"], r["host"]): r["target"] for r in route_requests(requests, routes).collect()} == wanted
    moved = spark.createDataFrame(
        [(k, p, h, "https://$host/" + ("$1" if h == ODD_PATTERNS[0][0] else "new") + "$request_uri$", n) for p, h, k, n in rules],
        "kind string, port int, host string, template string, rule_ord int",
    )
    got = {(r["port"], r["host"]): r["location"] for r in redirect_requests(requests, moved).collect()}
    assert got == {
        (p, h): None if w is None else f"https://{h}/{'en' if w == ODD_PATTERNS[0][0] else 'new'}/$" for (p, h), w in wanted.items()
    }
    bad = moved.selectExpr("kind", "port", "host", "'$other' AS template", "rule_ord")
    with pytest.raises(Exception, match="unknown variable"):
        redirect_requests(requests, bad).collect()


def test_patterns_stay_a_table(spark):
    """50,000 patterns: none in the plan, none on the driver."""
    ids = spark.range(50_000)
    routes = ids.selectExpr("80 AS port", "concat('^(www|app)[.]site', id, '[.]example') AS host", "'regex' AS host_kind", "'' AS modifier",
                            "'/' AS path", "concat('t', id) AS target", "false AS internal")
    requests = spark.createDataFrame([(80, f"www.site{n}.example.org", "/") for n in range(0, 50_000, 7001)] + [(80, "none", "/")], "port int, host string, uri string")
    got = route_requests(requests, routes)
    assert "site7001" not in got._jdf.queryExecution().toString()
    assert sorted(r["target"] or "" for r in got.collect()) == sorted([f"t{n}" for n in range(0, 50_000, 7001)] + [""])


def test_blocks_of_sorted_paths(spark, joins, monkeypatch):
    """Servers with many nested paths: the block's last path, or what it begins with."""
    monkeypatch.setattr("tollbridge.operators.routing.LISTED_ROUTES", 1)
    monkeypatch.setattr("tollbridge.operators.routing.BLOCK_ROUTES", 3)
    rng = random.Random(12)
    paths = {"/" + "".join(rng.choices("ab/\u00e9", k=rng.randrange(8))) for _ in range(60)} | {"", "/"}
    routes = [(80, h, "exact", m, p, f"{h}{m}{p}", False, None, 0) for h in ("h", "i") for p in sorted(paths) for m in ("", "=") if rng.random() < 0.5]
    cases = [(n, 80, rng.choice(["h", "i", "j"]), "/" + "".join(rng.choices("ab/\u00e9c", k=rng.randrange(10)))) for n in range(300)] + [(300, 80, "h", None)]
    requests = spark.createDataFrame(cases, "req_id bigint, port int, host string, uri string")
    got = {r["req_id"]: r["target"] for r in route_requests(requests, spark.createDataFrame(routes, ROUTES)).collect()}
    assert got == {c[0]: route_by_hand(routes, *c[1:]) if c[3] is not None else None for c in cases}


def test_value_at_searches_many_segments_without_a_shuffle_of_the_rows(spark):
    starts = {"a": range(0, 30_000, 3), None: [4], "b": range(-5, 300)}
    segments = [(k, s, None if s % 7 == 0 else s * 2) for k, own in starts.items() for s in own]
    asked = [(k, at) for k in ("a", "b", "c", None) for at in (-9, -5, 0, 1, 2, 3, 192, 193, 12_289, 29_997, 99_999, None)]
    rows = spark.createDataFrame(asked, "k string, at bigint")
    found = value_at(rows, spark.createDataFrame(segments, "k string, start bigint, v bigint"), ["k"], "at", "v", "w")
    plain = {(k, at): max([(s, v) for o, s, v in segments if o == k and s <= at], default=(0, None))[1] if k and at is not None else None for k, at in asked}
    assert {(r.k, r.at): r.w for r in found.collect()} == plain
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "hashpartitioning" not in text and "Sort" not in text
