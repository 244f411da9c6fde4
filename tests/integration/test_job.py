"""Delivery against a local service, and a collection run that is cut off and goes on."""

import json
import socket
import threading
from datetime import datetime, timedelta
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from tidemark.operators import job
from tidemark.sources import delivery

ANSWERS = {
    "sent": (200, {"ok": True, "result": {"message_id": 7}}), "unsure": (200, {"ok": True}), "list": (200, [1]), "slow": (429, {"parameters": {"retry_after": 90}}), "slow2": (200, {"error_code": 429}),
    "huge wait": (429, {"parameters": {"retry_after": 10**9}}), "no": (403, {"ok": False}), "no2": (200, {"error_code": 400}), "broken": (502, {}), "text": (200, None), "gone": (0, None),
}


@pytest.fixture
def service():
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            said = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, said["chat_id"], said["text"], self.headers["Idempotency-Key"]))
            status, body = ANSWERS[said["text"]]
            if not status:
                self.connection.shutdown(socket.SHUT_RDWR)
                return
            self.send_response(status)
            self.end_headers()
            self.wfile.write(b"<html>" if body is None else json.dumps(body).encode())

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/bot1", seen
    server.shutdown()


def test_every_answer_has_its_outcome(spark, service):
    url, seen = service
    rows = spark.createDataFrame([(k, k) for k in ANSWERS] + [("long", "x" * 4097), ("wide", "😀" * 2049)], "key string, body string")
    said = delivery.attempt(rows, url, "9")
    got = {r.key: (r.result, r.retry_after, r.external_id) for r in said.collect()}
    assert got == {
        "sent": ("SENT", None, "7"), "unsure": ("UNCERTAIN", None, None), "list": ("UNCERTAIN", None, None), "slow": ("RETRY", 90, None), "slow2": ("RETRY", 60, None), "huge wait": ("RETRY", 86400, None),
        "no": ("BLOCKED", None, None), "no2": ("BLOCKED", None, None), "broken": ("UNCERTAIN", None, None), "text": ("UNCERTAIN", None, None), "gone": ("UNCERTAIN", None, None),
        "long": ("BLOCKED", None, None), "wide": ("BLOCKED", None, None)}
    # read again, nothing is sent again
    assert said.count() == 13 and len(seen) == len(ANSWERS) and {s[3] for s in seen} == set(ANSWERS)
    assert not [r.error for r in said.collect() if r.error and "bot1" in r.error]
    closed = socket.socket()
    closed.bind(("127.0.0.1", 0))
    assert delivery.post(f"http://127.0.0.1:{closed.getsockname()[1]}", "9", "k", "b")[0] == "RETRY"
    assert delivery.post("", "9", "k", "b")[0] == "UNCONFIGURED" and delivery.post(url, "", "k", "b")[0] == "UNCONFIGURED"


def test_a_round_of_the_outbox(spark, service):
    url, seen = service
    now = datetime(2026, 9, 1, 12)
    rows = [("a", "sent", "PENDING", 0, None), ("b", "slow", "RETRY", 1, None), ("c", "broken", "PENDING", 0, None), ("d", "no", "PENDING", 0, None), ("e", "sent", "PENDING", 0, now + timedelta(hours=1)),
            ("f", "sent", "SENT", 1, None), ("g", "slow", "RETRY", 4, None)]
    df = spark.createDataFrame([(*r, now - timedelta(minutes=i)) for i, r in enumerate(rows)], "key string, body string, status string, attempts int, not_before timestamp, created_at timestamp")
    got = {r.key: (r.status, r.attempts, r.not_before) for r in delivery.deliver(df, url, "9", now).collect()}
    assert got == {"a": ("SENT", 1, None), "b": ("RETRY", 2, now + timedelta(seconds=90)), "c": ("UNCERTAIN", 1, None), "d": ("BLOCKED", 1, None), "e": ("PENDING", 0, now + timedelta(hours=1)), "f": ("SENT", 1, None), "g": ("FAILED", 5, None)}
    assert [s[2] for s in seen] == ["slow", "no", "broken", "slow", "sent"]


SITE = {
    "/a": "<a href='/a/edital-1.html'>Edital 1</a> <a href='/a/about'>About</a> <a href='/a/edital-2.html'>Edital 2</a> <a href='http://evil.test/edital'>x</a><a href='/a/edital-3.html'>Edital 3</a>",
    "/b": "<p>nothing here</p>", "/sitemap.xml": "<urlset><url><loc>HOST/b/edital-9.html</loc></url><url><loc>http://evil.test/edital</loc></url></urlset>",
    "/a/edital-1.html": "<title>One</title><p>First notice.</p>", "/a/edital-3.html": "", "/b/edital-9.html": "<title>Nine</title><p>Ninth notice.</p>",
}


@pytest.fixture
def site():
    asked, broken = [], {"/a/edital-2.html"}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            page = None if self.path in broken else SITE.get(self.path)  # entrances are asked for in canonical form, without the last slash
            self.send_response(200 if page is not None else 404)
            self.send_header("Content-Type", "text/html")
            self.end_headers()
            self.wfile.write((page or "").replace("HOST", f"http://127.0.0.1:{self.server.server_port}").encode())

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked
    server.shutdown()


def test_a_run_goes_on_where_it_was_cut_off(spark, site, tmp_path):
    root, asked = site
    sources = spark.createDataFrame([("a", f"{root}/a/", None, ["127.0.0.1"], 1, 10), ("b", f"{root}/b/", None, ["127.0.0.1"], 2, 10)],
                                    "id string, base_url string, seed_urls array<string>, allowed_hosts array<string>, priority int, max_documents int")
    wanted = lambda link, label: link.contains("edital")
    broken = {"now": True}

    def extract(documents):
        if broken["now"]:
            raise ValueError("no model")
        return documents.select("url", F.upper("title").alias("name"))

    stages = job.collection(spark, sources, wanted, ["127.0.0.1"], budget=10, extract=extract, interval="0", attempts="1")
    run = job.Run(spark, str(tmp_path), "r1")
    tables = run.execute(stages)
    assert [(r["stage"], r["state"]) for r in run.report] == [(s, "DONE") for s in ("entrances", "index", "links", "recovery", "plan", "documents")] + [("records", "FAILED")]
    states = {r.url.rsplit("/", 1)[1]: r.state for r in tables["documents"].collect()}
    assert states == {"edital-1.html": "OK", "edital-2.html": "FAILED", "edital-3.html": "EMPTY", "edital-9.html": "OK"}
    assert {r.source_id for r in tables["recovery"].collect()} == {"b"} and "evil" not in "".join(asked)
    before, broken["now"] = len(asked), False
    again = job.Run(spark, str(tmp_path), "r1")
    tables = again.execute(stages)
    assert [r["state"] for r in again.report] == ["KEPT"] * 6 + ["DONE"] and len(asked) == before
    assert {r.name for r in tables["records"].collect()} == {"ONE", "NINE"} and again.log().count() == 7
    # the budget goes to the source of higher priority first; without time no stage begins
    small = job.Run(spark, str(tmp_path), "r2").execute(job.collection(spark, sources, wanted, ["127.0.0.1"], budget=2, interval="0", attempts="1"))
    assert {r.source_id for r in small["plan"].collect()} == {"a"} and small["plan"].count() == 2
    ticks = iter(range(0, 10**6, 3000))
    late = job.Run(spark, str(tmp_path), "r3", clock=lambda: next(ticks))
    assert late.execute(stages) == {} and [r["state"] for r in late.report] == ["LATE"] + ["SKIPPED"] * 6
