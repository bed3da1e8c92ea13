"""What happens to a request, from redirect to log line; rows never leave their task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tollbridge.functions.rules import loggable_flag
from tollbridge.operators.responses import redirect_requests, substitute_by_status
from tollbridge.operators.routing import attach_upstream, route_requests
from tollbridge.operators.rows import forward_headers


def choose_backend(
    requests: DataFrame,
    routes: DataFrame,
    upstreams: DataFrame,
    redirects: DataFrame,
    flag_col: str | None = None,
    merge_slashes: bool = False,
) -> DataFrame:
    """Redirect, else route and look up the address, for requests(port, host, uri).

    A redirected request reaches no backend: its target is null and its action ``redirect``.
    """
    sent = redirect_requests(requests, redirects, flag_col)
    routed = route_requests(sent, routes, merge_slashes)
    moved = F.col("location").isNotNull()
    settled = routed.withColumns({
        "target": F.when(~moved, F.col("target")),
        "action": F.when(moved, "redirect").otherwise(F.col("action")),
    })
    return attach_upstream(settled, upstreams)


def serve_requests(
    requests: DataFrame,
    routes: DataFrame,
    upstreams: DataFrame,
    redirects: DataFrame,
    bodies: DataFrame,
    flag_col: str | None = None,
) -> DataFrame:
    """The whole way of requests(port, host, uri, scheme, remote_addr, forwarded_for, status, body).

    ``status`` and ``body`` are the backend's. A redirect answers with its own code, a denied
    path with 404; then bodies are substituted and ``loggable`` is set for the log writer.
    """
    chosen = choose_backend(requests, routes, upstreams, redirects, flag_col)
    answered = chosen.withColumn(
        "status",
        F.when(F.col("code").isNotNull(), F.col("code"))
        .when(F.col("action") == "deny", F.lit(404))
        .otherwise(F.col("status")),
    )
    replaced = substitute_by_status(forward_headers(answered), bodies)
    return replaced.withColumn("loggable", loggable_flag(F.col("status")))
