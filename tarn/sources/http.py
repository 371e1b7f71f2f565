"""Pages and peers over HTTP: requests are rows, dealt by host, asked one after the other; answers and failures are rows.

A host is asked by one task, with a pause between requests, as politeness wants; hosts are spread over the tasks. A task
that runs again asks again: answers are facts of their moment, so write them down before anything depends on them.
"""

from __future__ import annotations

import http.client
import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.functions.urls import index_host
from tarn.operators.federation import BUDGET_MS

AGENT = "tarn/1.0"
TIMEOUT_SECONDS, DELAY_SECONDS, REDIRECTS = 30.0, 0.25, 5
#: Bytes of a sitemap or robots.txt that are read.
RAW_BYTES = 10 * 1024 * 1024

FETCHED = "url string, status int, content_type string, etag string, last_modified string, retry_after string, final_url string, body string, error string"

_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
#: What a request that gets no answer, or half of one, ends in.
_FAILED = (OSError, ValueError, http.client.HTTPException)


class _FewRedirects(urllib.request.HTTPRedirectHandler):
    max_redirections = REDIRECTS


def _open(url: str, headers: dict[str, str], timeout: float, data: bytes | None = None):
    """An answer of any status; ValueError for anything but http and https."""
    if not url.lower().startswith(("http://", "https://")):
        raise ValueError(f"no web address: {url}")
    opener = urllib.request.build_opener(_FewRedirects)
    try:
        return opener.open(urllib.request.Request(url, data=data, headers=headers), timeout=timeout)
    except urllib.error.HTTPError as e:
        return e


def _text(body: bytes, content_type: str) -> str:
    charset = content_type.partition("charset=")[2].partition(";")[0].strip(" \"'") or "utf-8"
    try:
        return body.decode(charset, "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def _by_host(rows: DataFrame, ask, schema: str, delay: float) -> DataFrame:
    """What `ask` says to each row, as rows; requests to one host follow one another with `delay` seconds between them."""
    names = rows.columns

    kinds = [(n, _TYPES[t]) for n, t in (c.split() for c in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            for r in batch.to_pylist():
                if r["_host"] == last and delay:
                    time.sleep(delay)
                last = r["_host"]
                if out := list(ask({n: r[n] for n in names})):
                    yield pa.RecordBatch.from_arrays([pa.array([o.get(n) for o in out], t) for n, t in kinds], [n for n, _ in kinds])

    keyed = rows.withColumn("_host", index_host("url"))
    return keyed.repartition("_host").sortWithinPartitions("_host").mapInArrow(run, schema)


def fetched(requests: DataFrame, agent: str = AGENT, timeout: float = TIMEOUT_SECONDS, delay: float = DELAY_SECONDS) -> DataFrame:
    """One row for each request (url, etag, last_modified), in the shape of FETCH with `error`.

    Known validators make the request conditional. Redirects are followed five times at most; final_url tells where they
    led. Only 2xx answers of an HTML type have a body. A request that gets no answer has no status, and its error.
    """

    def ask(r: dict) -> Iterator[dict]:
        headers = {"User-Agent": agent} | ({"If-None-Match": r["etag"]} if r["etag"] else {}) | ({"If-Modified-Since": r["last_modified"]} if r["last_modified"] else {})
        try:
            with _open(r["url"], headers, timeout) as answer:
                kind, status = answer.headers.get("Content-Type") or "", answer.status
                html = 200 <= status <= 299 and "html" in kind.lower()
                yield {
                    "url": r["url"], "status": status, "content_type": kind, "etag": answer.headers.get("ETag"), "last_modified": answer.headers.get("Last-Modified"),
                    "retry_after": answer.headers.get("Retry-After"), "final_url": answer.url, "body": _text(answer.read(), kind) if html else None,
                }
        except _FAILED as e:
            yield {"url": r["url"], "error": str(e) or type(e).__name__}

    return _by_host(requests.select("url", "etag", "last_modified"), ask, FETCHED, delay)


def raw_texts(urls: DataFrame, agent: str = AGENT, timeout: float = TIMEOUT_SECONDS, delay: float = DELAY_SECONDS, most_bytes: int = RAW_BYTES) -> DataFrame:
    """(url, body, error) of each url: the first `most_bytes` as text, null unless the answer was 2xx. For robots.txt and sitemaps."""

    def ask(r: dict) -> Iterator[dict]:
        try:
            with _open(r["url"], {"User-Agent": agent}, timeout) as answer:
                yield {"url": r["url"], "body": answer.read(most_bytes).decode("utf-8", "replace") if 200 <= answer.status <= 299 else None}
        except _FAILED as e:
            yield {"url": r["url"], "error": str(e) or type(e).__name__}

    return _by_host(urls.select("url"), ask, "url string, body string, error string", delay)


def _events(lines: Iterator[bytes]) -> Iterator[tuple[str, str]]:
    """(event, data) of an event stream as it comes."""
    event, data = "message", []
    for raw in lines:
        line = raw.decode("utf-8", "replace").rstrip("\r\n")
        if not line:
            if data:
                yield event, "\n".join(data)
            event, data = "message", []
        elif line.startswith("event:"):
            event = line[6:].strip()
        elif line.startswith("data:"):
            data.append(line[5:].removeprefix(" "))


class HttpPeers:
    """A PeerClient: peers (peer_url, ...) are asked over HTTP, each for itself; one that fails is a row with its error."""

    def __init__(self, timeout: float = BUDGET_MS / 1000, agent: str = AGENT):
        self.timeout, self.agent = timeout, agent

    def _peers(self, peers: DataFrame, path: str) -> DataFrame:
        return peers.select(F.concat(F.rtrim("peer_url", F.lit("/")), F.lit(path)).alias("url"), "peer_url", *[c for c in peers.columns if c == "remote_collection"])

    def search(self, peers: DataFrame, query: str, depth: int = 0) -> DataFrame:
        """(peer_url, remote_collection, elapsed_ms, title, url, snippet_html, timestamp, score, error): `result` events up to
        `complete` of each peer (peer_url, remote_collection); others are ignored. An answer that breaks off, is no JSON or not
        2xx is one row with an error and no results."""
        timeout, agent = self.timeout, self.agent

        def ask(r: dict) -> Iterator[dict]:
            began, who, out = time.monotonic(), {"peer_url": r["peer_url"], "remote_collection": r["remote_collection"]}, []
            took = lambda: int(1000 * (time.monotonic() - began))
            try:
                body = json.dumps({"query": query, "collection": r["remote_collection"], "depth": depth}).encode()
                with _open(r["url"], {"User-Agent": agent, "Content-Type": "application/json", "Accept": "text/event-stream"}, timeout, body) as answer:
                    if not 200 <= answer.status <= 299:
                        raise ValueError(f"status {answer.status}")
                    for event, data in _events(answer):
                        if event == "complete":
                            break
                        if event == "result":
                            found = json.loads(data)
                            out.append(who | {n: found.get(n) for n in ("title", "url", "snippet_html", "timestamp")} | {"score": float(found["score"])})
            except (*_FAILED, KeyError, TypeError) as e:
                out = [who | {"error": str(e) or type(e).__name__}]
            elapsed = took()
            yield from (o | {"elapsed_ms": elapsed} for o in out)

        schema = "peer_url string, remote_collection string, elapsed_ms long, title string, url string, snippet_html string, timestamp long, score double, error string"
        return _by_host(self._peers(peers, "/api/search"), ask, schema, 0)

    def list_collections(self, peers: DataFrame) -> DataFrame:
        """(peer_url, name, description, error) of each peer's collections."""
        timeout, agent = self.timeout, self.agent

        def ask(r: dict) -> Iterator[dict]:
            try:
                with _open(r["url"], {"User-Agent": agent}, timeout) as answer:
                    if not 200 <= answer.status <= 299:
                        raise ValueError(f"status {answer.status}")
                    yield from [{"peer_url": r["peer_url"], "name": c["name"], "description": c.get("description")} for c in json.loads(answer.read())["collections"]]
            except (*_FAILED, KeyError, TypeError) as e:
                yield {"peer_url": r["peer_url"], "error": str(e) or type(e).__name__}

        return _by_host(self._peers(peers, "/api/collections"), ask, "peer_url string, name string, description string, error string", 0)

    def health_check(self, peers: DataFrame) -> DataFrame:
        """(url, healthy, response_ms) of each peer: whether its collections answer with 2xx."""
        timeout, agent = self.timeout, self.agent

        def ask(r: dict) -> Iterator[dict]:
            began = time.monotonic()
            try:
                with _open(r["url"], {"User-Agent": agent}, timeout) as answer:
                    healthy = 200 <= answer.status <= 299
            except _FAILED:
                healthy = False
            yield {"url": r["peer_url"], "healthy": healthy, "response_ms": int(1000 * (time.monotonic() - began))}

        return _by_host(self._peers(peers, "/api/collections"), ask, "url string, healthy boolean, response_ms long", 0)
