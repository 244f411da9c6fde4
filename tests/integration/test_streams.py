"""Polling with offsets against a local service, and health as keyed state against the batch timeline."""

import json
import random
import threading
from datetime import datetime, timedelta
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from tidemark.operators import health
from tidemark.streaming import circuit, updates


class Service:
    """Updates by bot; what lies before an offset that is asked for is forgotten."""

    def __init__(self, fail_confirm=False):
        self.held, self.confirmed, self.refuse, self.lose_confirm = {}, {}, 0, fail_confirm
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                where = urlparse(self.path)
                bot, asked = where.path.split("/")[1], {k: int(v[0]) for k, v in parse_qs(where.query).items()}
                if outer.refuse:
                    outer.refuse -= 1
                    self.send_error(503)
                    return
                if "offset" in asked and not outer.lose_confirm:
                    outer.confirmed[bot] = max(outer.confirmed.get(bot, 0), asked["offset"])
                    outer.held[bot] = [u for u in outer.held.get(bot, []) if u["update_id"] >= asked["offset"]]
                body = json.dumps({"ok": True, "result": outer.held.get(bot, [])[: asked.get("limit", 100)]}).encode()
                self.send_response(200)
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *args):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}"

    def say(self, bot, low, n, chat="7"):
        self.held.setdefault(bot, []).extend(
            {"update_id": i, "message": {"chat": {"id": chat if i % 4 else "99"}, "text": None if i % 10 == 3 else f"/buscar w{i}", "date": 1_700_000_000 + i}} for i in range(low, low + n))


@pytest.fixture
def service():
    made = Service()
    yield made
    made.server.shutdown()


def wanted(n):
    return {i for i in range(n) if i % 4 and i % 10 != 3}


def drain(spark, service, target, checkpoint, bots, rounds=12):
    for _ in range(rounds):
        updates.collected(updates.follow(spark, service.url, bots, checkpoint, chat="7", page=10), target, checkpoint).awaitTermination()
    return [(r.bot, r.update_id) for r in spark.read.parquet(target).collect()]


def test_updates_are_read_once_in_pages_over_restarts(spark, service, tmp_path):
    service.say("a", 0, 35)
    service.say("b", 100, 4)
    service.refuse = 1
    target, checkpoint = str(tmp_path / "t"), str(tmp_path / "c")
    got = drain(spark, service, target, checkpoint, ["a", "b"], 5)
    assert sorted(got) == sorted([("a", i) for i in wanted(35)] + [("b", i) for i in range(100, 104) if i % 4 and i % 10 != 3])
    row = spark.read.parquet(target).where("update_id = 5").first()
    assert (row.command, row.argument, row.chat_id) == ("buscar", "w5", "7")
    service.say("a", 35, 3)
    again = drain(spark, service, target, checkpoint, ["a", "b"], 2)
    assert sorted(i for b, i in again if b == "a") == sorted(wanted(38))


def test_updates_whose_confirmation_was_lost_do_not_hide_new_ones(spark, service, tmp_path):
    """The run dies between a batch's log and its confirmation: a full page of done updates still waits."""
    target, checkpoint = str(tmp_path / "t"), str(tmp_path / "c")
    service.say("a", 0, 10)
    service.lose_confirm = True
    drain(spark, service, target, checkpoint, ["a"], 1)
    assert service.confirmed == {} and updates.done(spark, checkpoint) == {"a": 10}
    service.lose_confirm = False
    service.say("a", 10, 10)
    got = drain(spark, service, target, checkpoint, ["a"], 2)
    assert sorted(i for _, i in got) == sorted(wanted(20))


def test_updates_of_a_batch_that_failed_are_read_again(spark, service, tmp_path):
    target, checkpoint = str(tmp_path / "t"), str(tmp_path / "c")
    service.say("a", 0, 8)
    stream = updates.follow(spark, service.url, ["a"], checkpoint, chat="7", page=10)

    def broken(batch, n):
        batch.count()
        raise RuntimeError("lost")

    query = stream.writeStream.foreachBatch(broken).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="lost"):
        query.awaitTermination()
    assert service.confirmed == {} and updates.done(spark, checkpoint) == {}
    assert sorted(i for _, i in drain(spark, service, target, checkpoint, ["a"], 2)) == sorted(wanted(8))


def test_updates_running_on(spark, service, tmp_path):
    """One run over several pages: each is confirmed before the next is planned."""
    import time

    target, checkpoint = str(tmp_path / "t"), str(tmp_path / "c")
    service.say("a", 0, 27)
    query = updates.collected(updates.follow(spark, service.url, ["a"], checkpoint, chat="7", page=10), target, checkpoint, once=False)
    end = time.time() + 60
    while time.time() < end and service.held["a"]:
        time.sleep(1)
    query.stop()
    assert sorted(r.update_id for r in spark.read.parquet(target).collect()) == sorted(wanted(27))
    with pytest.raises(ValueError):
        updates.Reader({"url": "file:///etc", "bots": "a"})


# ----------------------------------------------------------------- keyed state
ATTEMPTS = "source_id string, at timestamp, seq long, success boolean, found int, status int, expected_min int"


def attempts(rng):
    t0, rows, seq = datetime(2026, 9, 1), [], 0
    for s in ("s1", "s2", "s3", "s4"):
        at = t0
        for _ in range(60):
            at += timedelta(minutes=rng.choice([0, 7, 40, 200, 420]))
            ok = rng.random() < (0.35 if s == "s2" else 0.75)
            rows.append((s, at, seq, ok, rng.choice([None, 0, 0, 1, 8, 9, 40]) if ok else 0, 200 if ok else rng.choice([503, None]), rng.choice([0, 0, 0, 2, None])))
            seq += 1
    return rows


@pytest.mark.parametrize("cuts", [1, 4, 9])
def test_circuit_equals_the_timeline_in_any_batching(spark, tmp_path, cuts):
    rng = random.Random(cuts)
    rows = attempts(rng)
    batch = spark.createDataFrame(rows, ATTEMPTS)
    want = {(r.source_id, r.seq): (r.at, r.streak, r.drift, r.state, r.open_until, r.alert) for r in health.timeline(batch).collect()}
    # files in order of time, but for neighbours that change places
    order = sorted(rows, key=lambda r: (r[1] + timedelta(minutes=rng.randint(0, 240)), r[2]))
    source = str(tmp_path / "in")
    size = -(-len(order) // cuts)
    for n in range(cuts):
        spark.createDataFrame(order[n * size: (n + 1) * size], ATTEMPTS).coalesce(1).write.mode("append").parquet(f"{source}/{n:02d}")
    # a later row of another source moves the watermark on
    spark.createDataFrame([("end", datetime(2027, 1, 1), 10_000, True, 1, 200, 0)], ATTEMPTS).coalesce(1).write.parquet(f"{source}/99")
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    with pytest.raises(RuntimeError):
        circuit.circuit(spark.readStream.schema(ATTEMPTS).parquet(source))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", circuit.PROVIDER)
    try:
        out = str(tmp_path / "out")
        stream = spark.readStream.schema(ATTEMPTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(source)
        query = circuit.circuit(stream, late="10 hours").writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        made = spark.read.parquet(out).collect()
        got = {(r.source_id, r.seq): (r.at, r.streak, r.drift, r.state, r.open_until, r.alert) for r in made if r.kind == "attempt"}
        assert {k: v for k, v in got.items() if k[0] != "end"} == want
        # an open circuit recovers once, at its end, unless an attempt came before
        expected = set()
        for s in {k[0] for k in want}:
            line = [want[k] for k in sorted((k for k in want if k[0] == s), key=lambda k: (want[k][0], k[1]))]
            for i, (at, *_, state, until, _) in enumerate(line):
                if state == "OPEN" and (i + 1 == len(line) or line[i + 1][0] >= until):
                    expected.add((s, until))
        assert {(r.source_id, r.at) for r in made if r.kind == "recovery"} == expected
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)
