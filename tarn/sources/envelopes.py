"""Answers in the shapes that clients read: one JSON document, a stream of events, and JSON-RPC for tools."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.functions.scalars import PROTOCOL_VERSION

FIELDS = ("title", "url", "snippet_html", "source", "timestamp", "score")
PARSE_ERROR_CODES = {"invalid_request": -32600, "unknown_method": -32601, "invalid_params": -32602}


def json_answer(results: DataFrame, duration_ms: int) -> DataFrame:
    """One row `body`: protocol_version, results (best first), duration_ms. Results are a page's worth by then."""
    item = F.struct(*FIELDS)
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), F.col("url").alias("u"), item.alias("r"))))
    return results.agg(F.to_json(F.struct(F.lit(PROTOCOL_VERSION).alias("protocol_version"), F.transform(order, lambda x: x["r"]).alias("results"), F.lit(duration_ms).alias("duration_ms"))).alias("body"))


def event_stream(local: DataFrame, remote: DataFrame, finished: DataFrame) -> DataFrame:
    """(seq, event, source, payload) in the order a client gets them: local results, then each peer's as it answers, then done.

    remote has elapsed_ms; finished (source, elapsed_ms, error) has a row for each peer, failed ones with their error.
    """
    body = F.to_json(F.struct(*FIELDS))
    rows = local.select(F.lit(-1).cast("long").alias("at"), F.lit("local").alias("source"), F.lit(0).alias("k"), (-F.col("score")).alias("o"), F.col("url").alias("u"), F.lit("result").alias("event"), body.alias("payload"))
    done = local.sparkSession.range(1).select(F.lit(-1).cast("long").alias("at"), F.lit("local").alias("source"), F.lit(1).alias("k"), F.lit(0.0).alias("o"), F.lit("").alias("u"), F.lit("source_complete").alias("event"), F.lit('{"source":"local"}').alias("payload"))
    theirs = remote.select(F.col("elapsed_ms").cast("long").alias("at"), "source", F.lit(0).alias("k"), (-F.col("score")).alias("o"), F.col("url").alias("u"), F.lit("result").alias("event"), body.alias("payload"))
    ends = finished.select(F.col("elapsed_ms").cast("long").alias("at"), "source", F.lit(1).alias("k"), F.lit(0.0).alias("o"), F.lit("").alias("u"), F.lit("source_complete").alias("event"), F.to_json(F.struct("source", "error")).alias("payload"))
    last = local.sparkSession.range(1).select(F.lit((1 << 62)).cast("long").alias("at"), F.lit("").alias("source"), F.lit(2).alias("k"), F.lit(0.0).alias("o"), F.lit("").alias("u"), F.lit("done").alias("event"), F.lit("{}").alias("payload"))
    every = rows.unionByName(done).unionByName(theirs).unionByName(ends).unionByName(last)
    from pyspark.sql import Window

    order = Window.orderBy("at", "source", "k", "o", "u")  # one answer: some pages of results
    return every.withColumn("seq", F.row_number().over(order)).select("seq", "event", "source", "payload").orderBy("seq")


def read_events(text: str) -> list[dict]:
    """Result events of an event stream, up to `complete` or `done`; other events are ignored."""
    out, event = [], "message"
    for line in text.splitlines():
        if line.startswith("event:"):
            event = line[6:].strip()
        elif line.startswith("data:"):
            if event in ("complete", "done"):
                break
            if event == "result":
                out.append(json.loads(line[5:]))
        elif not line.strip():
            event = "message"
    return out


def wants_json(accept: str | None) -> bool:
    """A client that names JSON and no event stream gets one document."""
    accept = (accept or "").lower()
    return "application/json" in accept and "text/event-stream" not in accept


TOOLS = [{"name": "search", "description": "Ranked search over the collections", "inputSchema": {"type": "object", "properties": {"query": {"type": "string"}, "collection": {"type": "string"}, "depth": {"type": "integer"}}, "required": ["query"]}}]


def rpc(request: object, search: Callable[[str, str | None, int], list[dict]]) -> dict | None:
    """The answer to one JSON-RPC request for tools; null for a notification. Batches are refused."""
    def error(kind: str, message: str, rid: object = None) -> dict:
        return {"jsonrpc": "2.0", "id": rid, "error": {"code": PARSE_ERROR_CODES[kind], "message": message}}

    if not isinstance(request, dict) or request.get("jsonrpc") != "2.0" or not isinstance(request.get("method"), str):
        return error("invalid_request", "not a single JSON-RPC 2.0 request")
    if "id" not in request:
        return None
    rid, method, params = request["id"], request["method"], request.get("params") or {}
    if method == "initialize":
        result: dict = {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "tarn", "version": PROTOCOL_VERSION}}
    elif method == "ping":
        result = {}
    elif method == "tools/list":
        result = {"tools": TOOLS}
    elif method == "tools/call":
        given = params.get("arguments") or {}
        if params.get("name") != "search" or not str(given.get("query") or "").strip():
            return error("invalid_params", "search needs a query", rid)
        found = search(given["query"], given.get("collection"), max(0, min(int(given.get("depth") or 0), 2)))
        result = {"content": [{"type": "text", "text": json.dumps(found)}]}
    else:
        return error("unknown_method", method, rid)
    return {"jsonrpc": "2.0", "id": rid, "result": result}
