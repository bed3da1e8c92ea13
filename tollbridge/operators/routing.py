"""Choosing the backend of a request by port, host and path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tollbridge.operators.attach import MAX_BYTES, MAX_ROWS, attach, setting
from tollbridge.operators.hosts import first_in_table, first_pattern, host_patterns, many_patterns, pattern_key, pattern_table
from tollbridge.operators.ordered import assign_serials
from tollbridge.session import cut_lineage

# A host with more routes is looked up in blocks of sorted paths instead of through its list.
LISTED_ROUTES = 64
# Prefixes of a block.
BLOCK_ROUTES = 64

SERVER = ["port", "_server"]


def route_requests(requests: DataFrame, routes: DataFrame, merge_slashes: bool = False) -> DataFrame:
    """Add ``target``, ``routed_uri`` and ``action`` to requests(port, host, uri).

    Host: exact name, then wildcard, then regex in order of ``rule_ord``. Path: an exact (``=``)
    location, else the longest location the path starts with. The query part is not compared and
    stays when a route has its own ``replacement_uri``. Every request comes out once; ``action``
    is ``proxy``, ``deny`` for an internal location, or ``none``. Routes without a path are ignored.
    """
    rules = _plain_routes(routes)
    path = F.split(F.col("uri"), r"[?#]", 2)[0]
    if merge_slashes:
        path = F.regexp_replace(path, "/{2,}", "/")
    work = requests.withColumn("_path", path)
    servers = _servers(rules)
    rows, size, longest = servers.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0)), F.max("n")
    ).first()
    small = rows <= setting(rules, MAX_ROWS) and size <= setting(rules, MAX_BYTES)
    work = _with_server(work, rules, small)
    if small and (longest or 0) <= LISTED_ROUTES:
        hit = _by_route_lists(work, rules)
    elif small or work.isStreaming:
        hit = _by_sorted_paths(work, rules, servers, small)
    else:
        hit = _by_probes(work, rules, servers)
    query = F.regexp_extract("uri", r"^[^?#]*(\?[^#]*)?", 1)
    route = F.col("_hit")
    return hit.select(
        *requests.columns,
        F.when(~route["internal"], route["target"]).alias("target"),
        F.when(
            ~route["internal"] & route["replacement_uri"].isNotNull(),
            F.concat(route["replacement_uri"], query),
        ).otherwise(F.col("uri")).alias("routed_uri"),
        F.when(route.isNull(), "none").when(route["internal"], "deny").otherwise("proxy").alias("action"),
    )


def _plain_routes(routes: DataFrame) -> DataFrame:
    """The routes with a path; ``_server`` is the host, or the key of its pattern."""
    have = routes.columns
    kind = F.coalesce("host_kind", F.lit("exact"))
    plain = routes.filter("path is not null and host is not null").select(
        "port",
        "host",
        kind.alias("host_kind"),
        pattern_key(kind, F.col("host")).alias("_server"),
        "path",
        (F.coalesce("modifier", F.lit("")) == "=").alias("exact"),
        F.struct(
            F.coalesce("internal", F.lit(False)).alias("internal"),
            F.col("target").alias("target"),
            (F.col("replacement_uri") if "replacement_uri" in have else F.lit(None).cast("string")).alias("replacement_uri"),
        ).alias("route"),
        (F.col("rule_ord") if "rule_ord" in have else F.lit(0)).alias("rule_ord"),
    )
    return plain


def _servers(rules: DataFrame) -> DataFrame:
    """Each server's number of routes, their bytes, and the distinct lengths of its prefixes."""
    text = F.coalesce(F.octet_length("path"), F.lit(0)) + F.coalesce(F.octet_length("host"), F.lit(0)) + F.coalesce(
        F.octet_length("route.target"), F.lit(0)) + F.coalesce(F.octet_length("route.replacement_uri"), F.lit(0))
    return rules.groupBy(*SERVER).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(text + 32).alias("bytes"),
        F.collect_set(F.when(~F.col("exact"), F.length("path"))).alias("lengths"),
    )


def _with_server(work: DataFrame, rules: DataFrame, small: bool) -> DataFrame:
    """Add the server of a request: that of its host's own name, else of the first pattern. Patterns
    are only tried where no server has the name; many of them once per host."""
    named = rules.filter("host_kind = 'exact'").select("port", "host", F.col("_server").alias("_named")).distinct()
    found = attach(work, named, ["port", "host"], small or None)
    if not work.isStreaming and many_patterns(rules, "host_kind"):
        hosts = cut_lineage(found.filter("_named is null and host is not null").select("port", "host").distinct(), "hosts")
        firsts = cut_lineage(first_in_table(hosts, pattern_table(rules, "host_kind"), "key"), "host-patterns")
        met = attach(found, firsts, ["port", "host"])
        return met.withColumn("_server", F.coalesce("_named", "key")).drop("_named", "key")
    patterns = host_patterns(rules, "host_kind")
    return found.withColumn("_server", F.coalesce("_named", first_pattern(patterns))).drop("_named")


def _by_route_lists(work: DataFrame, rules: DataFrame) -> DataFrame:
    """Small route tables with few routes per server: one ordered list each, one broadcast join."""
    entry = F.struct((~F.col("exact")).alias("rank"), (-F.length("path")).alias("shorter"), "path", "route")
    lists = rules.groupBy(*SERVER).agg(F.array_sort(F.collect_list(entry)).alias("_list"))
    found = attach(work, lists, SERVER, small=True)

    def fits(e: Column) -> Column:
        return F.when(e["rank"], F.startswith(F.col("_path"), e["path"])).otherwise(F.col("_path") == e["path"])

    return found.withColumn("_hit", F.get(F.filter("_list", fits), F.lit(0))["route"])


def _keyed(rules: DataFrame) -> DataFrame:
    return rules.groupBy(*SERVER, "exact", "path").agg(F.min("route").alias("_r"))


def _by_sorted_paths(work: DataFrame, rules: DataFrame, servers: DataFrame, small: bool) -> DataFrame:
    """Servers with many routes, and large tables of streams: the last of a server's sorted prefixes that
    is not beyond the path, or the longest prefix of that one which the path begins with.

    A server's prefixes are in blocks, and a first lookup tells the block; so there are three joins,
    however many routes and lengths there are. Each prefix has its own prefixes with it, the longest first.
    """
    keyed = cut_lineage(_keyed(rules), "routes")
    exact = keyed.filter("exact").select(*SERVER, "path", F.col("_r").alias("_hit"))
    prefixes = keyed.filter(~F.col("exact")).select(*SERVER, "path", "_r")
    lengths = servers.select(*SERVER, F.explode("lengths").alias("n"))
    cuts = prefixes.select(*SERVER, "path").join(lengths, SERVER).filter(F.col("n") < F.length("path"))
    own = prefixes.select(*SERVER, F.col("path").alias("_above"), F.col("_r").alias("_above_r"))
    met = cuts.withColumn("_above", F.expr("substring(path, 1, n)")).join(own, [*SERVER, "_above"])
    above = F.sort_array(F.collect_list(F.struct(F.col("n"), F.col("_above").alias("path"), F.col("_above_r").alias("_r"))), asc=False)
    parents = met.groupBy(*SERVER, "path").agg(above.alias("_above"))
    placed = assign_serials(prefixes.join(parents, [*SERVER, "path"], "left"), [*SERVER, "path"], 0)
    starts = placed.groupBy(*SERVER).agg(F.min("serial").alias("_first"))
    block = F.floor((F.col("serial") - F.col("_first")) / BLOCK_ROUTES).alias("_block")
    placed = placed.join(starts, SERVER).select(*SERVER, block, F.struct("path", "_r", "_above").alias("_entry"))
    blocks = placed.groupBy(*SERVER, "_block").agg(F.array_sort(F.collect_list("_entry")).alias("_routes"))
    blocks = cut_lineage(blocks, "route-blocks")
    begin = F.struct(F.col("_routes")[0]["path"].alias("path"), F.col("_block").alias("n"))
    fences = cut_lineage(blocks.groupBy(*SERVER).agg(F.array_sort(F.collect_list(begin)).alias("_fences")), "route-fences")

    found = attach(work, exact.withColumnRenamed("path", "_path"), [*SERVER, "_path"], small or None)
    found = attach(found, fences, SERVER, small or None)
    last = lambda array: F.try_element_at(F.filter(array, lambda e: e["path"] <= F.col("_path")), F.lit(-1))
    found = attach(found.withColumn("_block", last("_fences")["n"]).drop("_fences"), blocks, [*SERVER, "_block"], small or None)
    found = found.withColumn("_last", last("_routes")).drop("_routes", "_block")
    fits = lambda e: F.startswith(F.col("_path"), e["path"])
    prefix = F.when(fits(F.col("_last")), F.col("_last._r")).otherwise(F.get(F.filter(F.col("_last._above"), fits), F.lit(0))["_r"])
    return found.withColumn("_hit", F.coalesce("_hit", prefix)).drop("_last")


def _by_probes(work: DataFrame, rules: DataFrame, servers: DataFrame) -> DataFrame:
    """Large route tables: every distinct path of a server is cut to the lengths its prefixes have,
    the cuts are looked up by one join, and the best route goes back to the requests by another.
    However many lengths there are, the number of shuffles stays the same."""
    asked = work.filter("_server is not null and _path is not null").select(*SERVER, "_path").distinct()
    met = asked.join(servers.select(*SERVER, "lengths"), SERVER)
    cuts = F.transform(
        F.filter("lengths", lambda n: n <= F.length("_path")),
        lambda n: F.struct(F.lit(False).alias("exact"), F.substring(F.col("_path"), F.lit(1), n).alias("path")),
    )
    whole = F.array(F.struct(F.lit(True).alias("exact"), F.col("_path").alias("path")))
    probes = met.select(*SERVER, "_path", F.inline(F.concat(whole, cuts)))
    hits = probes.join(_keyed(rules), [*SERVER, "exact", "path"])
    best = hits.groupBy(*SERVER, "_path").agg(F.max_by("_r", F.struct("exact", F.length("path"))).alias("_hit"))
    return attach(work, best, [*SERVER, "_path"])


def attach_upstream(df: DataFrame, upstreams: DataFrame, target_col: str = "target") -> DataFrame:
    """Add the ``address`` and ``upstream_port`` a symbolic target stands for, null if it has none."""
    known = upstreams.groupBy(F.col("name").alias(target_col)).agg(
        F.min(F.struct("address", F.col("port").alias("upstream_port"))).alias("_up")
    )
    return attach(df, known, [target_col]).select(*df.columns, "_up.address", "_up.upstream_port")
