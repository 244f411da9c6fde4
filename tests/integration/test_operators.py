"""Relational operators: sequential reference folds, health series, outbox, storage, streaming."""

import json
import random
import threading
from datetime import date, datetime, timedelta
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import functions as F

from tidemark.functions import answers, text
from tidemark.operators import health, history, intervals, merge, outbox, registry, resolve, serve
from tidemark.sources import pages, store
from tidemark.sources.fetch import HttpSource, fetch
from tidemark.streaming import ingest


def fold(rows):
    """The merge as a loop over documents, the way its rules are written."""
    value, best, found = None, None, []
    for seq, v, auth in rows:
        better = best is None or auth <= best
        if v is not None:
            if value is None:
                value = v
            elif v != value:
                found.append((seq, value, v))
                if better:
                    value = v
        best = auth if best is None else min(best, auth)
    return value, found


def test_merge_equals_a_sequential_fold(spark):
    rng = random.Random(3)
    rows, expected, conflicts = [], {}, set()
    for e in range(300):
        docs = [(s, rng.choice([None, "1", "2", "3"]), rng.choice([10, 15, 20, 25])) for s in range(rng.randint(1, 8))]
        rows += [(e, s, "salary", v, a) for s, v, a in docs]
        value, found = fold(docs)
        if value is not None:
            expected[e] = value
        conflicts |= {(e, *c) for c in found}
    df = spark.createDataFrame(rows, "entity int, seq int, field string, value string, authority int")
    assert {r.entity: r.value for r in merge.merged(df).collect()} == expected
    assert {(r.entity, r.seq, r.old_value, r.new_value) for r in merge.conflicts(df).collect()} == conflicts


def test_lost_values_are_recorded_not_alerted(spark):
    df = spark.createDataFrame([("opportunity", 1, 1, "exam_date", "2026-11-22"), ("opportunity", 1, 2, "exam_date", None),
                                ("opportunity", 1, 1, "application_fee", "85.00"), ("opportunity", 1, 2, "application_fee", "90")],
                               "scope string, entity int, version int, field string, value string")
    got = {r.field: r for r in history.changes(df).collect()}
    assert got["exam_date"].information_lost and not got["exam_date"].alertable
    assert (got["application_fee"].old_value, got["application_fee"].new_value, got["application_fee"].alertable) == ("R$ 85,00", "R$ 90,00", True)
    assert "Taxa".upper() in history.rendered(history.changes(df)).first().text


def series(spark, found, success=True, status=200, expected_min=0):
    t = datetime(2026, 9, 1)
    ok = success if isinstance(success, list) else [success] * len(found)
    return spark.createDataFrame([("s", i, t + timedelta(days=i), o, n, expected_min, status if o else None) for i, (n, o) in enumerate(zip(found, ok))],
                                 "source_id string, seq int, at timestamp, success boolean, found int, expected_min int, status int")


def test_health(spark):
    last = lambda df: health.latest(health.timeline(df)).first()
    assert last(series(spark, [12, 15, 11, 14, 0])).drift == "zero_after_history"
    assert last(series(spark, [20, 22, 19, 21, 1])).drift == "sharp_drop"
    assert last(series(spark, [0])).drift is None
    assert last(series(spark, [10, 10, 10, 0], status=503)).drift is None
    r = last(series(spark, [10, 0, 0, 0], success=[True, False, False, False]))
    assert (r.state, r.streak) == ("OPEN", 3) and r.open_until == datetime(2026, 9, 4, 6)
    assert last(series(spark, [10, 0, 0, 0, 9], success=[True, False, False, False, True])).state == "HEALTHY"


def test_health_history_outlives_failures(spark):
    fails = [0] * 130
    counts = [0] * 5 + list(range(10, 40)) + fails + [1]
    got = {r.seq: r for r in health.timeline(series(spark, counts, success=[True] * 35 + [False] * 130 + [True])).collect()}
    assert (got[165].drift, got[165].state) == ("sharp_drop", "DEGRADED")
    assert all(got[i].history == list(range(20, 40)) for i in range(35, 166)) and got[0].history == [] and got[6].history == [0] * 5 + [10]
    mixed = [i % 7 == 0 for i in range(150)]
    for r in health.timeline(series(spark, list(range(150)), success=mixed)).collect():
        assert r.history == [i for i in range(r.seq) if mixed[i]][-20:]


def test_match_cascade(spark):
    cols = "id string, institution string, name string, number string, published date, board string, url string, document_hash string"
    d = date(2026, 9, 1)
    drafts = spark.createDataFrame([
        ("a", "Prefeitura Municipal de Rio Branco", "Concurso Agente", "1/2026", d, None, "", ""),
        ("b", "Outra", "Nome", None, d, None, "", "h1"), ("c", "Outra", "Nome", None, d, None, "u1", ""),
        ("d", "Câmara Municipal de Rio Branco", "Concurso para Agente Legislativo e Analista Legislativo", None, d, "IDIB", "", ""),
        ("e", "Câmara Municipal de Rio Branco", "Concurso para Agente Legislativo e Analista Legislativo", None, date(2020, 1, 1), "IDIB", "", "")], cols)
    known = spark.createDataFrame([
        ("k1", "Prefeitura Municipal de Rio Branco", "x", "1/2026", d, None, ["u9"], ["h9"], d), ("k2", "Zz", "y", None, d, None, ["u1"], ["h1"], d),
        ("k3", "Câmara Municipal de Rio Branco", "Agente Legislativo Analista Legislativo Fiscal", None, d, "IDIB", [], [], d)],
        "id string, institution string, name string, number string, published date, board string, urls array<string>, hashes array<string>, first_seen date")
    got = {r.draft: (r.known, r.reason) for r in resolve.match(drafts, known).collect()}
    assert got == {"a": ("k1", "dedup_key"), "b": ("k2", "document_hash"), "c": ("k2", "url"), "d": ("k3", "similarity"), "e": (None, "new")}


def test_outbox_is_idempotent_and_moves_on(spark):
    t = datetime(2026, 9, 14)
    new = spark.createDataFrame([("k", t), ("k", t), ("m", t)], "key string, created_at timestamp")
    stored = spark.createDataFrame([("console:m",)], "key string")
    got = outbox.queue(new, ("console", "markdown"), stored)
    assert {r.key for r in got.collect()} == {"console:k", "markdown:k", "markdown:m"}
    rows = spark.createDataFrame([("a", 0, "SENT", None), ("b", 1, "RETRY", 30), ("c", 4, "RETRY", None), ("d", 2, "UNCERTAIN", None), ("e", 2, "UNCONFIGURED", None)],
                                 "key string, attempts int, result string, retry_after int")
    out = {r.key: (r.new_status, r.new_attempts, r.new_not_before) for r in outbox.delivered(rows, t).collect()}
    assert out == {"a": ("SENT", 1, None), "b": ("RETRY", 2, t + timedelta(seconds=30)), "c": ("FAILED", 5, None), "d": ("UNCERTAIN", 3, None), "e": ("UNCONFIGURED", 2, None)}


def test_reminders_fire_on_threshold_days_only(spark):
    today = date(2026, 9, 14)
    due = spark.createDataFrame([(1, "registration", today + timedelta(days=n)) for n in (0, 1, 2, 3, 7, 8)], "id int, kind string, due date")
    o = spark.createDataFrame([(1, "I", "N", "EDITAL_PUBLISHED")], "id int, institution string, name string, status string")
    none = spark.createDataFrame([], "id int")
    assert sorted(r.threshold for r in outbox.reminders(due, o, none, today).collect()) == [0, 1, 3, 7]
    assert sorted(r.threshold for r in outbox.reminders(due, o, none, today, catch_up=True).collect()) == [0, 1, 3, 3, 7]


def test_registry(spark):
    s = spark.createDataFrame([("a", "A", True), ("b", "B", True)], "id string, name string, enabled boolean")
    t = spark.createDataFrame([("b", "old", True), ("c", "C", True)], "id string, name string, enabled boolean")
    assert {r.id: r.action for r in registry.reconcile(s, t).collect()} == {"a": "created", "b": "updated", "c": "disabled"}
    bad = spark.createDataFrame([("a", "http://x", ["x"]), ("a", "nonsense", []), ("b", None, None)], "id string, base_url string, allowed_hosts array<string>")
    assert {(r.id, r.problem) for r in registry.problems(bad).collect()} == {("a", "duplicate_id"), ("a", "bad_url"), ("b", "bad_url"), ("a", "no_hosts"), ("b", "no_hosts")}


def test_intervals(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 4, 8), (1, 8, 9), (1, 11, 12), (1, 0, 2)], "k int, start int, end int")
    assert sorted((r.start, r.end, r.merged) for r in intervals.merge(df, ["k"]).collect()) == [(0, 9, 4), (11, 12, 1)]


def test_backup_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, name string")
    folder = str(tmp_path / "b")
    store.dump({"sources": df}, folder)
    schemas = {"sources": "id int, name string"}
    assert store.verify(spark, folder, schemas).first().ok
    assert sorted(map(tuple, store.restore(spark, folder, schemas, {"sources": df.limit(0)})["sources"].collect())) == [(1, "a"), (2, None)]
    try:
        store.restore(spark, folder, schemas, {"sources": df})
    except ValueError:
        return
    raise AssertionError("a restore over rows must be refused")


def test_pages(spark):
    html = ("<html><head><title>T</title><script>no()</script></head><body><a href='/a?utm_source=x'>A  b</a><a href='http://evil.com/'>E</a>"
            "<table><caption>C</caption><tr><th>Cargo</th><th>Vagas</th></tr><tr><td>Agente</td><td>1</td></tr></table></body></html>")
    p = pages.parsed(spark.createDataFrame([("http://x.com/i", html), ("http://x.com/n", None)], "url string, html string"))
    r = p.where("html is not null").first().page
    assert r.title == "T" and "no()" not in r.text and r.tables[0].rows == [["Cargo", "Vagas"], ["Agente", "1"]]
    assert [(x.link, x.label) for x in pages.links(p, F.array(F.lit("x.com"))).collect()] == [("http://x.com/a", "A b")]


def test_http_source_isolates_failures(spark):
    spark.dataSource.register(HttpSource)
    df = spark.read.format("tidemark_http").option("urls", '[{"url": "http://127.0.0.1:9/x"}]').option("attempts", "1").load()
    row = df.first()
    assert row.status is None and row.error and row.content is None
    assert fetch({"url": "nonsense"}, 1, 1, 0, 10)[-1] == "not allowed"


def test_http_source_against_a_server(spark):
    class Site(BaseHTTPRequestHandler):
        def do_GET(self):
            if self.headers.get("If-None-Match") == '"v1"':
                self.send_response(304)
                self.end_headers()
                return
            where = {"/away": "http://other.test/x", "/disk": "file:///etc/hostname", "/back": "/page"}.get(self.path)
            self.send_response(302 if where else 200)
            if where:
                self.send_header("Location", where)
            body = b"" if where else b"<p>hello</p>"
            for k, v in (("Content-Type", "text/html"), ("ETag", '"v1"'), ("Last-Modified", "Mon, 14 Sep 2026 10:00:00 GMT"), ("Content-Length", str(len(body)))):
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    asked = [{"url": f"{at}/page"}, {"url": f"{at}/page?2", "etag": '"v1"', "last_modified": "then"}, {"url": f"{at}/away"}, {"url": f"{at}/disk"}, {"url": f"{at}/back"},
             {"url": "file:///etc/hostname"}, {"url": "http://other.test/"}]
    spark.dataSource.register(HttpSource)
    read = spark.read.format("tidemark_http").option("urls", json.dumps(asked)).option("attempts", "1").option("interval", "0").option("allowed", '["127.0.0.1"]').load()
    got = {r.url: r for r in read.collect()}
    server.shutdown()
    page = got[f"{at}/page"]
    assert (page.status, bytes(page.content), page.etag, page.last_modified, page.unchanged, page.error) == (200, b"<p>hello</p>", '"v1"', "Mon, 14 Sep 2026 10:00:00 GMT", False, None)
    same = got[f"{at}/page?2"]
    assert (same.status, same.content, same.unchanged, same.last_modified) == (304, None, True, "then")
    assert bytes(got[f"{at}/back"].content) == b"<p>hello</p>"
    for refused in (f"{at}/away", f"{at}/disk", "file:///etc/hostname", "http://other.test/"):
        assert got[refused].content is None and "allowed" in got[refused].error, refused


def test_search_by_any_index(spark, monkeypatch):
    """Of the grams asked for, few or many, or kept for all requests."""
    from tidemark.operators import index

    rows = [(f"p{i}", f"Agente {i % 3}", "Prefeitura", "Concurso", True, i, None) for i in range(30)]
    pairs = spark.createDataFrame(rows, "position string, cargo string, institution string, name string, eligible boolean, score int, deadline date")
    asked = spark.createDataFrame([(k, f"AGENTE {k % 3}") for k in range(9)], "request int, argument string")
    want = sorted(map(tuple, serve.search(asked, pairs).collect()))
    assert len(want) == 45 and all(t == 10 for _, _, t, _ in want)
    assert sorted(map(tuple, serve.search(asked, pairs, serve.indexed(serve.haystack(pairs))).collect())) == want
    monkeypatch.setattr(index, "FEW", 0)
    plan = serve.search(asked, pairs)
    assert sorted(map(tuple, plan.collect())) == want
    assert not any(x in plan._jdf.queryExecution().toString() for x in ("CartesianProduct", "NestedLoop"))


def test_equal_values_by_field(spark):
    same = lambda a, b, field: spark.range(1).select(merge.same(F.lit(a), F.lit(b), F.lit(field)).alias("x")).first().x
    assert same("4656.75", "4656.754", "salary") and not same("4656.75", "4656.76", "salary")
    assert not same("007", "7", "edital_number") and same("São José", "SAO  jose", "organizing_board")
    assert same("True", "true", "assignment_confirmed") and not same("true", "false", "assignment_confirmed") and same("1", "TRUE", "assignment_confirmed")


def test_equal_lists_item_by_item(spark):
    r = random.Random(3)
    words = ["Prova escrita", "PROVA  escrita", "títulos", "Titulos!", "a, b", 'c" d', "", "prova"]
    lists = [[r.choice(words) for _ in range(r.randrange(4))] for _ in range(60)] + [["a b", "c"], ["a", "b c"], ["a b c"], [], [""]]
    rows = [(i, j, json.dumps(a), json.dumps(b, ensure_ascii=False, separators=(",", ":"))) for i, a in enumerate(lists) for j, b in enumerate(lists)]
    got = spark.createDataFrame(rows, "i int, j int, a string, b string").select("i", "j", merge.same(F.col("a"), F.col("b"), F.lit("selection_stages")).alias("x")).collect()
    assert all(g.x == ([text.plain(v) for v in lists[g.i]] == [text.plain(v) for v in lists[g.j]]) for g in got)


def test_answers_of_every_shape(spark):
    raws = ["", "null", "[]", "{", '{"fields": null}', '{"fields": {"validity": 3}}', '{"fields": {"validity": {"value": [], "status": "FOUND", "raw_evidence": "x"}}}',
            '{"fields": {"validity": {"value": "1 ano", "status": "FOUND", "confidence": {"a": 1}, "raw_evidence": "x"}}, "positions": [1, null, {"name": "a"}]}', None]
    got = [r.p for r in spark.createDataFrame([(i, x) for i, x in enumerate(raws)], "i int, raw string").orderBy("i").select(answers.payload(F.col("raw")).alias("p")).collect()]
    assert [len(p.fields) for p in got] == [0, 0, 0, 0, 0, 0, 0, 1, 0] and len(got[7].positions) == 1
    assert (got[7].fields["validity"].value, got[7].fields["validity"].confidence) == ("1 ano", 0.0)
    assert [p.problem is None for p in got] == [False, False, False, False, True, True, True, True, False]


def test_streaming_ingest_is_idempotent(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("u1", "h1"), ("u1", "h1"), ("u2", "h2")]
    spark.createDataFrame(rows, "url string, content_hash string").write.parquet(source)
    for n in range(2):
        ingest.ingest(ingest.follow(spark, source, "url string, content_hash string"), target, str(tmp_path / f"c{n}")).awaitTermination()
    assert spark.read.parquet(target).count() == 2


def test_streaming_health_keeps_state(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [("s", datetime(2026, 9, 1, h), False, 0) for h in range(3)]
    spark.createDataFrame(rows, "source_id string, at timestamp, success boolean, found int").write.parquet(source)
    stream = ingest.health(ingest.follow(spark, source, "source_id string, at timestamp, success boolean, found int"))
    query = stream.writeStream.outputMode("update").format("memory").queryName("health_state").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("health_state").orderBy(F.desc("attempts")).first().state == "OPEN"


def test_routing(spark):
    from tidemark.operators import serve

    said = ["/buscar agente", "/VAGAS@bot", "quais as vagas", "/nada", "", None, "qual a taxa do agente?", "qual a taxa?", "bom dia a todos"]
    df = spark.createDataFrame(list(enumerate(said)), "i int, t string").select("i", serve.route(F.col("t")).alias("r"), serve.asked_fact(F.col("t")).alias("f")).orderBy("i")
    rows = df.collect()
    assert [r.r.command for r in rows] == ["buscar", "vagas", "vagas", "unknown", "unknown", "unknown", "question", "free", "free"]
    assert rows[0].r.argument == "agente" and rows[6].f == "fee"


def test_replies_fit(spark):
    from tidemark.functions.text import utf16_units
    from tidemark.operators import serve

    body = F.array(*[F.lit("😀" * 50 + str(i)) for i in range(60)])
    r = spark.range(1).select(serve.fit(body, F.array(F.lit("fim"))).alias("t")).select("t", utf16_units(F.col("t")).alias("n")).first()
    assert r.n <= 3900 and r.t.endswith("\nfim") and r.t.startswith("😀")


def test_marks_and_issues(spark):
    from tidemark.operators import serve

    old = spark.createDataFrame([("p", "INTERESTED", 1), ("r", "REGISTERED", 1)], "position string, status string, at int")
    asked = spark.createDataFrame([("p", "descartar", 2), ("r", "esquecer", 2), ("q", "salvar", 2), ("x", "buscar", 3)], "position string, command string, at int")
    assert {r.position: r.status for r in serve.marks(asked, old).collect()} == {"p": "DISMISSED", "q": "INTERESTED"}


def test_message_files_are_written_once(spark, tmp_path):
    from tidemark.sources import sinks

    rows = spark.createDataFrame([("k", "a"), ("k", "a"), ("m", "b")], "key string, body string")
    target = str(tmp_path / "out")
    assert sinks.deliver(rows, target).count() == 2
    assert sinks.deliver(rows, target).count() == 0
    assert spark.read.parquet(target).count() == 2
    text = sinks.markdown(spark.createDataFrame([("1 A", 1, "- x"), ("2 B", 1, "- y")], "section string, line int, text string"), "Relatório")
    assert text == "# Relatório\n\n## 1 A\n\n- x\n\n## 2 B\n\n- y\n"


def test_documents_of_any_length(spark, tmp_path):
    from tidemark.plans import catalogue

    def excerpt(doc, before=600, after=2_400, budget=22_000, most=40):
        """The reference's rule (verify.py:156-202) for one name, over text without accents."""
        spans, at = [], 0
        while len(spans) < most and (at := doc.lower().find("license", at)) >= 0:
            spans.append([max(0, at - before), at + after])
            at += len("license")
        if not spans:
            return doc[:budget]
        merged, pieces, used = [spans[0]], [], 0
        for a, b in spans[1:]:
            if a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        for a, b in merged:
            if chunk := doc[a:b][: budget - used]:
                pieces.append(chunk)
                used += len(chunk)
        return "\n[...]\n".join(pieces)

    filler = "some words of no use "
    docs = ["", "no name here", "A license for all", filler * 150 + "license", filler * 190 + "license " + filler * 400 + "license", filler * 30_000]
    rows = [(2 * i + k, d, None if k else len(d)) for i, d in enumerate(docs) for k in (0, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    queries = catalogue.queries()
    assert {r.doc_id: r.n for r in queries["f47_focus_excerpt"](spark, str(tmp_path)).collect()} == {i: len(excerpt(d)) for i, d, _ in rows}
    assert {r.doc_id: (r.n, r.truncated) for r in queries["f05_tidy"](spark, str(tmp_path)).collect()} == {i: (len(d.strip()), False) for i, d, _ in rows}


def test_drafts_of_a_batch_found_opportunities_in_order(spark):
    """Against a loop over the drafts: stored rows and earlier founders are candidates of each."""
    rng = random.Random(8)
    bodies = ["Prefeitura de Rio Branco", "Prefeitura Municipal de Rio Branco", "Instituto Federal do Acre", "Universidade Federal do Acre", None]
    names = ["Concurso Agente Fiscal Tributos", "Agente Fiscal de Tributos", "Agente Fiscal", "Professor Matematica Fisica", "Professor Matematica", "Edital", None]

    def made(i, stored):
        row = {"id": f"{'k' if stored else 'd'}{i:03d}", "institution": rng.choice(bodies), "name": rng.choice(names), "number": rng.choice([None, None, "", "01/2026", "2/2026"]),
               "published": rng.choice([None, date(2026, 1, 5), date(2025, 3, 1)]), "board": rng.choice([None, "FGV", "Cebraspe"]), "first_seen": date(2026, 1, 1) + timedelta(days=rng.randrange(9))}
        links = [rng.choice(["", f"u{rng.randrange(60)}"]), rng.choice(["", f"h{rng.randrange(60)}"])]
        return row | ({"urls": links[:1], "hashes": links[1:]} if stored else {"url": links[0], "document_hash": links[1], "seq": i})

    known, drafts = [made(i, True) for i in range(12)], [made(i, False) for i in range(90)]
    shape = "id string, institution string, name string, number string, published date, board string, first_seen date"
    k = spark.createDataFrame([tuple(r.values()) for r in known], shape + ", urls array<string>, hashes array<string>")
    d = spark.createDataFrame([tuple(r.values()) for r in drafts], shape + ", url string, document_hash string, seq long").repartition(5)
    got = {r.draft: (r.known, r.reason) for r in resolve.match_batch(d, k).collect()}
    # the keys and word sets by the library, the fold by hand
    both = d.select("id", "institution", "number", "published", "name", "board").union(k.select("id", "institution", "number", "published", "name", "board"))
    seen = {r.id: r for r in both.select("id", resolve.dedup_key(F.col("institution"), F.col("number"), F.col("published"), F.col("name")).alias("key"), resolve.token_set(F.col("institution")).alias("it"), resolve.token_set(F.col("name")).alias("nt")).collect()}

    def similar(a, b):
        return len(set(a) & set(b)) / len(set(a) | set(b)) if a and b else 0

    def rule(x, y):
        a, b = seen[x["id"]], seen[y["id"]]
        urls, hashes = y.get("urls", [y.get("url")]), y.get("hashes", [y.get("document_hash")])
        if a.key == b.key:
            return 1, 0
        if x["document_hash"] and x["document_hash"] in hashes:
            return 2, 0
        if x["url"] and x["url"] in urls:
            return 3, 0
        if x["number"] and y["number"] and x["number"] == y["number"] and similar(a["it"], b["it"]) >= 0.34:
            return 4, 0
        score = similar(a["nt"], b["nt"]) + (0.08 if x["board"] and x["board"] == y["board"] else 0)
        if similar(a["it"], b["it"]) >= 0.5 and (not x["published"] or not y["published"] or x["published"].year == y["published"].year) and a["nt"] and b["nt"] and score >= 0.62:
            return 5, -score
        return None

    want, founders = {}, []
    for x in drafts:
        found = [(*r, y["first_seen"], y["id"]) for y in known + founders if (r := rule(x, y))]
        best = min(found, default=None)
        want[x["id"]] = (best[3], ("dedup_key", "document_hash", "url", "edital_number", "similarity")[best[0] - 1]) if best else (None, "new")
        if not best:
            founders.append(x)
    assert got == want and len(founders) > 5 and len({v[1] for v in want.values()}) == 6
    assert resolve.match_batch(d.limit(0), k).count() == 0


def test_index_equals_searching_every_text(spark):
    """Words of all lengths, in all places, over lists of one block and of many; the plan has no nested loop."""
    from tidemark.operators import index

    rng = random.Random(6)
    texts = {f"p{i:04d}": " ".join("".join(rng.choices("abcé1", k=rng.randint(1, 6))) for _ in range(rng.randint(0, 7))) for i in range(400)} | {"none": None}
    asked = {i: [rng.choice(["a", "b1", "abc", "é", "cab1", "zz", "1a1a", "bcé1"]) for _ in range(rng.randint(1, 3))] for i in range(40)}
    df = spark.createDataFrame(list(texts.items()), "position string, hay string")
    wanted = spark.createDataFrame(list(asked.items()), "request long, words array<string>")
    expected = {(r, p) for r, ws in asked.items() for p, t in texts.items() if t is not None and all(w in t for w in ws)}
    for kept in (index.build(df, "position", "hay"), index.build(df, "position", "hay", index.asked_grams(wanted).select("gram").distinct())):
        found = index.lookup(kept, wanted)
        assert {(r.request, r.key) for r in found.collect()} == expected
        assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    was = index.LIST
    index.LIST = 32
    try:
        small = index.build(df, "position", "hay")
        assert small.postings.agg(F.max("n")).first()[0] < 80 and {(r.request, r.key) for r in index.lookup(small, wanted).collect()} == expected
    finally:
        index.LIST = was


def test_search_pages_by_word_prefix_and_no_term(spark):
    rows = [(f"{i:08x}-p", f"agente {'fiscal' if i % 3 == 0 else 'escolar'} {i}", "orgao", "edital", i % 2 == 0, i % 7, date(2026, 1, 1) + timedelta(days=i % 5) if i % 4 else None) for i in range(40)]
    pairs = spark.createDataFrame(rows, "position string, cargo string, institution string, name string, eligible boolean, score int, deadline date")
    asked = [(1, "fisc agente --pagina 2"), (2, "0000001a"), (3, ""), (4, " --pagina 3"), (5, "zebra"), (6, "fiscal --pagina 0")]
    got = {}
    for r in serve.search(spark.createDataFrame(asked, "request int, argument string"), pairs).collect():
        got.setdefault(r.request, []).append((r.n, r.total, r.position))
    order = sorted(rows, key=lambda r: (not r[4], -r[5], r[6] is None, r[6] or date.max, r[0]))
    page = lambda chosen, k: [(n, len(chosen), r[0]) for n, r in enumerate(chosen, 1) if (k - 1) * 5 < n <= k * 5]
    fiscal = [r for r in order if "fiscal" in r[1]]
    assert {k: sorted(v) for k, v in got.items()} == {1: page(fiscal, 2), 2: [(1, 1, "0000001a-p")], 3: page(order, 1), 4: page(order, 3)}


def test_similar_combinations_meet_by_three_keys(spark):
    """All pairs by brute force, unknown years included; combinations never meet by a word of their names alone."""
    import re

    from tidemark.operators import resolve

    rng = random.Random(10)
    words = lambda pool, n: sorted(rng.sample(pool, n))
    combos = {(tuple(words(["municipal", "acre", "rio", "sena"], rng.randint(1, 3))), tuple(words(["agente", "fiscal", "saude", "escolar", "geral"], rng.randint(1, 4))),
               rng.choice([None, 2024, 2025, 2026]), rng.choice([None, "permanent", "temporary"])) for _ in range(150)}
    rows = [(i, list(it), list(nt), y, b) for i, (it, nt, y, b) in enumerate(sorted(combos, key=str))]
    mine = spark.createDataFrame(rows, "hub long, it array<string>, nt array<string>, year int, nboard string")
    theirs = spark.createDataFrame(rows, "other long, kit array<string>, knt array<string>, kyear int, kboard string")
    found = resolve._similar(mine, theirs)
    alike = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    want = {}
    for i, it, nt, y, b in rows:
        for j, kit, knt, ky, kb in rows:
            score = alike(nt, knt) + (0.08 if b is not None and b == kb else 0)
            if alike(it, kit) >= 0.5 and (y is None or ky is None or y == ky) and score >= 0.62:
                want[i, j] = round(score, 9)
    got = [(r.hub, r.other, round(r.score, 9)) for r in found.collect()]
    assert {(i, j): s for i, j, s in got} == want and len(got) == len(want) > len(rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"(?:SortMergeJoin|HashJoin)\S*(?: \(\d+\))? \[(.*?)\], \[.*?\], Inner", plan)
    assert keys and all(k.count("#") >= 3 for k in keys)


def test_batch_moves_no_draft_beside_few_hubs(spark, monkeypatch):
    """With few hubs the last step moves no draft and has one row a draft; with many (shuffled) the answers are the same."""
    from tidemark.operators import resolve

    rng = random.Random(11)
    rows = [(f"d{i:03d}", i, date(2026, 1, 1 + rng.randint(0, 20)), rng.choice(["Prefeitura de Acre", "Prefeitura Municipal de Acre", "Acre Saude", "Camara de Sena", None]),
             " ".join(rng.sample(["agente", "fiscal", "saude", "escolar"], rng.randint(1, 3))), rng.choice([None, "", "1/2026", "2/2026", "3/2026"]),
             rng.choice([None, date(2025, 5, 1), date(2026, 5, 1)]), rng.choice([None, "PERMANENT"]), f"u{rng.randint(0, 40)}", rng.choice(["", f"h{rng.randint(0, 40)}"])) for i in range(90)]
    d = spark.createDataFrame(rows, "id string, seq long, first_seen date, institution string, name string, number string, published date, board string, url string, document_hash string")
    none = d.limit(0).withColumn("urls", F.array("url")).withColumn("hashes", F.array("document_hash"))
    few = resolve.match_batch(d, none)
    assert "hashpartitioning" not in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(resolve, "SMALL", 0)
    many = resolve.match_batch(d, none)
    told = sorted(few.collect(), key=str)
    assert sorted(many.collect(), key=str) == told and len(told) == len(rows) and len({r.reason for r in told}) == 6


def test_noted_equals_trying_every_identifier(spark):
    """Codes against all identifiers: beginnings of one, of several, of none, with identifiers given twice; no row is paired or moved twice."""
    rng = random.Random(24)
    held = ["".join(rng.choices("ab", k=rng.randint(6, 14))) for _ in range(300)] + ["concurso-1", "concurso-10", "concurso-2é"]
    codes = [rng.choice(held)[: rng.randint(6, 14)] for _ in range(300)] + ["concurso", "concurso-1", "concurso-10", "concurso-2", "concurso-3"]
    asked = spark.createDataFrame([(i, f" {c}  nota {i} ") for i, c in enumerate(codes)] + [(900, "concurso-10"), (901, None)], "request long, argument string")
    tracked = {p: "REGISTERED" for p in held[::3]}
    out = serve.noted(asked, spark.createDataFrame([(p,) for p in held + held[:50]], "position string"), spark.createDataFrame(list(tracked.items()), "position string, status string"))
    fit = {i: [p for p in set(held) if p.startswith(c)] for i, c in enumerate(codes) if len(c) >= 8}
    want = {(i, ps[0], tracked.get(ps[0], "INTERESTED"), f"nota {i}") for i, ps in fit.items() if len(ps) == 1}
    got = [tuple(r) for r in out.collect()]
    assert set(got) == want and len(got) == len(want) and 50 < len(want) < len(fit)
    # a note is moved once: one exchange by the first eight characters, and no join of notes with identifiers
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    final = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Join") == 1 and final.count("hashpartitioning(head") == 1
