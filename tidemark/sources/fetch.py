"""HTTP responses as a batch source, one partition per host, with conditional requests.

    spark.dataSource.register(HttpSource)
    spark.read.format("tidemark_http").option("urls", json.dumps([{"url": ..., "etag": ...}])).load()

A request is never raised as a failure: its row carries the error. Hosts are throttled one by one,
which is what a partition per host is for. Only http and https are spoken, and only with hosts of the
option "allowed" (a JSON list; all if it is absent) and below them, redirects included.
"""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.request
from collections import defaultdict
from collections.abc import Iterator
from urllib.parse import urlparse

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.functions.urls import RETRY

TIMEOUT, ATTEMPTS, INTERVAL, MAX_BYTES = 25.0, 3, 1.5, 12 << 20


class _Host(InputPartition):
    def __init__(self, requests: list[dict]):
        self.requests = requests


def admitted(url: str, allowed: list[str] | None) -> bool:
    """Whether a URL is one of the web's, of an allowed host or below one."""
    parts = urlparse(url)
    host = (parts.hostname or "").lower()
    return parts.scheme in ("http", "https") and host != "" and (allowed is None or any(host == a.lower() or host.endswith("." + a.lower()) for a in allowed))


class _Redirects(urllib.request.HTTPRedirectHandler):
    def __init__(self, allowed: list[str] | None):
        self.allowed = allowed

    def redirect_request(self, req, fp, code, msg, headers, newurl):
        if not admitted(newurl, self.allowed):
            raise ValueError(f"redirected to a place that is not allowed: {newurl}")
        return super().redirect_request(req, fp, code, msg, headers, newurl)


def fetch(request: dict, timeout: float, attempts: int, interval: float, limit: int, allowed: list[str] | None = None, wait=time.sleep) -> tuple:
    """(url, status, content, content_type, etag, last_modified, unchanged, error) of one request."""
    headers = {k: v for k, v in (("If-None-Match", request.get("etag")), ("If-Modified-Since", request.get("last_modified"))) if v}
    url, error, status = request["url"], None, None
    if not admitted(url, allowed):
        return url, None, None, None, None, None, False, "not allowed"
    opener = urllib.request.OpenerDirector()
    for handler in (urllib.request.ProxyHandler(), urllib.request.HTTPHandler(), urllib.request.HTTPSHandler(), _Redirects(allowed),
                    urllib.request.HTTPDefaultErrorHandler(), urllib.request.HTTPErrorProcessor()):
        opener.add_handler(handler)
    for n in range(attempts):
        if n:
            wait(min(2.0**n, 20.0) * interval / 1.5 + random.random() * 0.1)
        try:
            with opener.open(urllib.request.Request(url, headers=headers), timeout=timeout) as r:
                body = r.read(limit + 1)
                if len(body) > limit:
                    return url, r.status, None, r.headers.get("Content-Type"), None, None, False, "too large"
                return url, r.status, body, r.headers.get("Content-Type"), r.headers.get("ETag"), r.headers.get("Last-Modified"), False, None
        except urllib.error.HTTPError as e:
            status, error = e.code, str(e)
            if status == 304:
                return url, 304, None, None, request.get("etag"), request.get("last_modified"), True, None
            if status not in RETRY:
                break
        except (OSError, ValueError) as e:
            status, error = None, str(e)
    return url, status, None, None, None, None, False, error


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.requests = json.loads(options.get("urls", "[]"))
        self.knobs = (float(options.get("timeout", TIMEOUT)), int(options.get("attempts", ATTEMPTS)),
                      float(options.get("interval", INTERVAL)), int(options.get("max_bytes", MAX_BYTES)), json.loads(options.get("allowed", "null")))

    def partitions(self) -> list[InputPartition]:
        hosts = defaultdict(list)
        for r in self.requests:
            hosts[urlparse(r["url"]).netloc.lower()].append(r)
        return [_Host(v) for _, v in sorted(hosts.items())]

    def read(self, partition: _Host) -> Iterator[tuple]:
        for i, r in enumerate(partition.requests):
            if i:
                time.sleep(self.knobs[2])
            yield fetch(r, *self.knobs)


class HttpSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidemark_http"

    def schema(self) -> str:
        return "url string, status int, content binary, content_type string, etag string, last_modified string, unchanged boolean, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
