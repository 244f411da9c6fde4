"""Queries over collection, upkeep and presentation operators, with SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.functions import score, urls
from tidemark.operators import health, history, registry
from tidemark.plans.relational import NOW, _RUNS, _STATES, att, line, q, src, watchdog
from tidemark.sources import pages, registry_file, sinks, store
from tidemark.streaming import circuit, ingest


def _events(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet")


def _e():
    return F.col("event_id")


@q("s09_index_pages", """WITH s AS (SELECT id, lower(base_url) AS base, priority FROM v_source)
    SELECT id AS source_id, CAST(0 AS INT) AS place, base AS url FROM s UNION ALL SELECT id, 1, concat('https://www.', id, '.example/a?x=1') FROM s WHERE priority % 2 = 0""")
def index_pages(spark, sf):
    """Entrances: the base, a seed with tracking parameters, a repeated base, a foreign host, nonsense."""
    one = F.concat(F.lit("https://www."), "id", F.lit(".example/a/?utm_source=m&x=1#top"))
    seeds = F.when(F.col("priority") % 2 == 0, F.array(one, "base_url", F.lit("https://evil.test/"), F.lit("nonsense")))
    hosts = F.array(F.lit("example"))
    return registry.index_pages(src(spark, sf).select("id", F.lower("base_url").alias("base_url"), seeds.alias("seed_urls"), hosts.alias("allowed_hosts")))


_ROOTS = "SELECT id AS source_id, regexp_extract(base_url, '^(https?://[^/]+)', 1) AS root FROM v_source"


@q("s11_recovery_requests", f"SELECT source_id, CAST(step AS INT) AS step, CASE WHEN step < 5 THEN 'rss' ELSE 'sitemap' END AS method, concat(root, path) AS url FROM ({_ROOTS}), (VALUES (0, '/feed'), (1, '/rss'), (2, '/feed/'), (3, '/index.xml'), (4, '/rss.xml'), (5, '/sitemap.xml'), (6, '/sitemap_index.xml')) t(step, path)")
def recovery_requests(spark, sf):
    return registry.recovery_requests(src(spark, sf))


@q("s11_recovered", """WITH a AS (SELECT user_id % 40 AS source_id, event_id % 7 AS step, CASE WHEN event_type = 'error' THEN 404 ELSE 200 END AS status, CASE WHEN event_id % 5 = 0 THEN event_id END AS link FROM events),
    b AS (SELECT source_id, step, min(link) AS link FROM a WHERE status = 200 AND link IS NOT NULL GROUP BY ALL)
    SELECT concat('s', source_id) AS source_id, CASE WHEN step < 5 THEN 'rss' ELSE 'sitemap' END AS method, concat('u', link) AS first FROM b QUALIFY step = min(step) OVER (PARTITION BY source_id)""")
def recovered(spark, sf):
    """The first entrance that answers with links, by source."""
    e = _events(spark, sf).select(
        (F.col("user_id") % 40).alias("s"), (_e() % 7).cast("int").alias("step"), F.when(F.col("event_type") == "error", 404).otherwise(200).alias("status"), F.when(_e() % 5 == 0, _e()).alias("link"))
    answers = e.groupBy("s", "step", "status").agg(F.array_compact(F.array(F.min("link"))).alias("links")).select(
        F.concat(F.lit("s"), "s").alias("source_id"), "step", F.when(F.col("step") < 5, "rss").otherwise("sitemap").alias("method"), "status", F.transform("links", lambda v: F.concat(F.lit("u"), v)).alias("links"))
    return registry.recovered(answers).select("source_id", "method", F.get("links", F.lit(0)).alias("first"))


@q("k06_registry_form", """SELECT concat('{"enabled":', enabled, ',"id":"', id, '","priority":', priority, ',"trust_level":', trust_level, '}') AS line FROM v_source""")
def registry_form(spark, sf):
    return registry.stored_form(src(spark, sf).select("id", "priority", "trust_level", "enabled"))


@q("s01_registry_file", """SELECT id, name, institution, base_url, enabled, trust_level, CAST(CASE WHEN priority % 5 = 0 THEN -1 ELSE priority END AS BIGINT) AS priority, trust_status, array_to_string(CASE WHEN priority % 3 = 0 THEN [] ELSE [concat(id, '.example'), 'dois: "2"'] END, ' ') AS allowed_hosts,
    concat('diz "', name, '": \\d+ # não ', chr(10), ' é') AS limitations, 'generic' AS adapter, CAST(max_documents AS INT) AS max_documents FROM v_source""")
def registry_in_files(spark, sf):
    """The registry written as YAML and read again: quotes, line ends, empty lists, nulls, and what a file does not name."""
    p = F.col("priority")
    rows = src(spark, sf).select(
        "id", "name", "institution", "base_url", "enabled", "trust_level", F.when(p % 5 != 0, p).cast("int").alias("priority"), "trust_status",
        F.when(p % 3 != 0, F.array(F.concat("id", F.lit(".example")), F.lit('dois: "2"'))).otherwise(F.array().cast("array<string>")).alias("allowed_hosts"),
        F.concat(F.lit('diz "'), "name", F.lit('": \\d+ # não \n é')).alias("limitations"), "max_documents")
    path = store.place(spark, "registry")
    registry_file.write(rows, path)
    return registry_file.read(spark, path).select("id", "name", "institution", "base_url", "enabled", "trust_level", F.coalesce("priority", F.lit(-1)).cast("long").alias("priority"), "trust_status",
                                                  F.array_join("allowed_hosts", " ").alias("allowed_hosts"), "limitations", "adapter", "max_documents")


@q("s04_promoted", "SELECT id, CASE WHEN priority > 12 THEN 'TRUSTED' ELSE trust_status END AS trust_status FROM v_source")
def promoted(spark, sf):
    s = src(spark, sf)
    return registry.promote(s.select("id", "trust_status", "priority"), s.where("priority > 12")).select("id", "trust_status")


@q("p05_http_status", "SELECT event_id, event_id % 600 BETWEEN 200 AND 299 AS ok, event_id % 600 = 304 AS unchanged, event_id % 600 IN (408, 425, 429, 500, 502, 503, 504, 507, 509) AS again FROM events")
def http_status(spark, sf):
    s = F.when(_e() % 600 > 0, (_e() % 600).cast("int"))
    return _events(spark, sf).select("event_id", urls.ok(s).alias("ok"), urls.unchanged(s).alias("unchanged"), urls.retryable(s).alias("again"))


@q("s15_first_usable", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'OK' WHEN 1 THEN 'OK' WHEN 2 THEN 'ENCRYPTED' WHEN 3 THEN 'TOO_SHORT' END AS status, CASE event_id % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'a' WHEN 3 THEN 'b' END AS method FROM events""")
def first_usable(spark, sf):
    """Extractions in order: the first with enough text, an encrypted document, only short text, none."""
    n, long, short = _e() % 5, F.repeat(F.lit("palavra "), 20), F.lit("  curto  ")
    m = lambda status, text, name: F.struct(status.alias("status"), text.alias("text"), F.lit(name).alias("method"))
    a = m(F.when(n == 2, "ENCRYPTED").when(n.isin(0, 1), "OK").otherwise("NO_TEXT_LAYER"), F.when(n == 0, long).otherwise(short), "a")
    b = m(F.when(n == 4, "FAILED").otherwise("OK"), F.when(n == 3, short).otherwise(long), "b")
    return _events(spark, sf).select("event_id", pages.first_usable(a, b).alias("x")).select("event_id", "x.status", "x.method")


@q("a06_standing", f"""WITH {_STATES}, o AS (SELECT source_id, moment, seq, state, sum(CAST(state = 'HEALTHY' AS INT)) OVER (PARTITION BY source_id ORDER BY moment, seq) AS era FROM line),
    u AS (SELECT source_id, max(moment) FILTER (state = 'OPEN') AS opened FROM o WHERE era = (SELECT max(era) FROM o p WHERE p.source_id = o.source_id) GROUP BY source_id)
    SELECT id AS source_id, CASE WHEN NOT enabled THEN 'DISABLED' WHEN state = 'OPEN' AND opened + INTERVAL 6 HOUR <= TIMESTAMP '2024-01-29 12:00:00' THEN 'RECOVERING' ELSE coalesce(state, 'HEALTHY') END AS state,
        NOT enabled OR coalesce(state = 'OPEN' AND opened + INTERVAL 6 HOUR > TIMESTAMP '2024-01-29 12:00:00', false) AS skip
    FROM v_source LEFT JOIN last ON last.source_id = id LEFT JOIN u ON u.source_id = id""")
def standing(spark, sf):
    """All sources at one moment: disabled, cooling, recovering, others."""
    return health.standing(line(spark, sf), src(spark, sf), NOW)


@q("a06_next_state", """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'DISABLED' WHEN event_type <> 'error' AND event_id % 3 <> 0 THEN 'HEALTHY' WHEN event_type <> 'error' THEN 'DEGRADED' WHEN event_id % 5 >= 3 THEN 'OPEN' ELSE 'DEGRADED' END AS state FROM events""")
def next_states(spark, sf):
    now = F.when(_e() % 7 == 0, "DISABLED").when(_e() % 2 == 0, "OPEN").otherwise("HEALTHY")
    return _events(spark, sf).select("event_id", health.next_state(now, F.col("event_type") != "error", _e() % 5, _e() % 3 == 0).alias("state"))


@q("a08_source_runs", """SELECT source_id, day, count(*) AS attempts, count(*) FILTER (success) AS successes, count(*) FILTER (NOT success) AS failures, CAST(sum(found) AS BIGINT) AS documents,
    CASE WHEN count(*) FILTER (success) = 0 THEN 'FAILED' WHEN count(*) FILTER (NOT success) > 0 THEN 'PARTIAL' ELSE 'SUCCESS' END AS status FROM v_attempt GROUP BY source_id, day""")
def source_runs(spark, sf):
    return health.source_runs(att(spark, sf))


@q("a10_watchdog_notices", f"""WITH {_STATES}, {_RUNS}, o AS (SELECT count(*) FILTER (state IN ('OPEN', 'DISABLED')) AS a FROM last), f AS (SELECT count(*) FILTER (status IN ('FAILED', 'UNCERTAIN')) AS b FROM v_notification),
    h AS (SELECT CASE WHEN max(day) IS NULL OR date_diff('hour', CAST(max(day) AS TIMESTAMP), TIMESTAMP '2024-01-29 12:00:00') > 30 THEN 'CRITICAL' WHEN any_value(a) > 0 OR any_value(b) > 0 THEN 'WARNING' ELSE 'OK' END AS severity, any_value(a) AS a, any_value(b) AS b FROM judged, o, f WHERE run_status IN ('SUCCESS', 'PARTIAL')),
    p AS (SELECT severity, array_to_string(list_sort(list_filter([CASE WHEN a > 0 THEN concat(a, ' fonte(s) com circuito aberto ou desativadas') END, CASE WHEN b > 0 THEN concat(b, ' notificação(ões) pendentes de entrega ou revisão') END], lambda x: x IS NOT NULL)), chr(10)) AS problems FROM h WHERE severity <> 'OK')
    SELECT concat('system:', substr(sha256(concat_ws(chr(31), 'SYSTEM', 'watchdog', lower(severity), CASE WHEN severity = 'CRITICAL' THEN '2024 01 29' ELSE sha256(problems) END)), 1, 32)) AS key, severity, problems FROM p""")
def watchdog_notices(spark, sf):
    return health.notices(watchdog_row(spark, sf), NOW).select("key", "severity", F.array_join("problems", "\n").alias("problems"))


def watchdog_row(spark, sf):
    return watchdog(spark, sf)


@q("v_upper_median", "SELECT source_id, list_sort(list(found))[len(list(found)) // 2 + 1] AS median FROM v_attempt WHERE success GROUP BY source_id")
def upper_median(spark, sf):
    return att(spark, sf).where("success").groupBy("source_id").agg(health.upper_median(F.collect_list("found")).alias("median"))


@q("s23_expired_backups", "SELECT event_id FROM events WHERE CAST(ts AS TIMESTAMP) < TIMESTAMP '2024-01-12 00:00:00'")
def expired(spark, sf):
    backups = _events(spark, sf).select("event_id", F.col("event_id").cast("string").alias("path"), F.col("ts").cast("timestamp").alias("modified"))
    return store.expired(backups, datetime(2024, 2, 11)).select("event_id")


@q("k04_event_log", "SELECT event_id, upper(event_type) AS level, CASE event_id % 3 WHEN 0 THEN 'token [REDACTED] end' WHEN 1 THEN 'db postgres://u:[REDACTED]@h/x' ELSE repeat('y', 2000) END AS message FROM events")
def event_log(spark, sf):
    """Masked and bounded messages."""
    said = F.when(_e() % 3 == 0, "token 123456789:AAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAA end").when(_e() % 3 == 1, "db postgres://u:secret@h/x").otherwise(F.repeat(F.lit("y"), 2100))
    rows = _events(spark, sf).select("event_id", "event_type")
    return sinks.logged(rows, F.upper("event_type"), said, NOW, keep=("event_id",)).select("event_id", "level", "message")


@q("e17_shown_values", """SELECT o_orderkey AS id, CASE o_orderkey % 8 WHEN 0 THEN 'Prova marcada' WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 2 THEN concat('R$ ', replace(format('{:,}', o_orderkey), ',', '.'), ',00') WHEN 3 THEN replace(format('{:,}', o_orderkey), ',', '.')
    WHEN 4 THEN 'sim' WHEN 5 THEN 'não informado' WHEN 6 THEN 'Ensino médio' ELSE o_orderpriority END AS shown FROM orders""")
def shown(spark, sf):
    """Codes, dates, money, numbers, truth values, gaps and texts as people read them."""
    k = F.col("o_orderkey")
    n = k % 8
    field = F.when(n == 0, "status").when(n == 1, "exam_date").when(n == 2, "salary").when(n == 3, "vacancies").when(n == 4, "assignment_confirmed").when(n == 6, "education").otherwise("validity")
    value = (F.when(n == 0, "EXAM_SCHEDULED").when(n == 1, F.to_date("o_orderdate").cast("string")).when(n.isin(2, 3), k.cast("string")).when(n == 4, "True")
             .when(n == 5, F.when(k % 16 == 5, "").otherwise(F.lit(None))).when(n == 6, "high_school").otherwise(F.col("o_orderpriority")))
    return spark.read.parquet(f"{sf}/orders.parquet").select(k.alias("id"), history.shown(field, value).alias("shown"))


@q("e18_rendered_changes", """WITH v AS (SELECT o_custkey AS entity, o_orderpriority AS value, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version, o_orderkey FROM orders), w AS (SELECT *, lag(value) OVER (PARTITION BY entity ORDER BY version) AS old FROM v)
    SELECT entity, CAST(version AS INT) AS version, concat('VALIDADE DO CONCURSO', chr(10), chr(10), 'Antes:', chr(10), old, chr(10), chr(10), 'Agora:', chr(10), value) AS text FROM w WHERE version > 1 AND old <> value""")
def rendered(spark, sf):
    from pyspark.sql import Window

    o = spark.read.parquet(f"{sf}/orders.parquet")
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    snaps = o.select(F.lit("opportunity").alias("scope"), F.col("o_custkey").alias("entity"), n.alias("version"), F.lit("validity").alias("field"), F.col("o_orderpriority").alias("value"))
    return history.rendered(history.changes(snaps)).select("entity", "version", "text")


@q("e19_escalated", """WITH v AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'CANCELLED' WHEN 1 THEN 'EDITAL_PUBLISHED' WHEN 2 THEN 'REGISTRATION_OPEN' WHEN 3 THEN 'EXPIRED' END AS now, CASE event_id % 3 WHEN 0 THEN 'CANCELLED' WHEN 1 THEN 'REGISTRATION_OPEN' END AS old FROM events)
    SELECT event_id, coalesce(now IN ('CANCELLED', 'SUSPENDED', 'REGISTRATION_OPEN', 'EXAM_SCHEDULED') AND now IS DISTINCT FROM old, false) AS escalated FROM v""")
def escalated(spark, sf):
    now = F.when(_e() % 5 == 0, "CANCELLED").when(_e() % 5 == 1, "EDITAL_PUBLISHED").when(_e() % 5 == 2, "REGISTRATION_OPEN").when(_e() % 5 == 3, "EXPIRED")
    old = F.when(_e() % 3 == 0, "CANCELLED").when(_e() % 3 == 1, "REGISTRATION_OPEN")
    return _events(spark, sf).select("event_id", score.status_escalated(old, now).alias("escalated"))


@q("w_attempts_by_hour", "SELECT source_id, date_trunc('hour', moment) AS hour, count(*) AS attempts, count(*) FILTER (NOT success) AS failures FROM v_attempt GROUP BY ALL")
def attempts_by_hour(spark, sf):
    """The streaming windows over the whole log as a batch."""
    got = ingest.attempts_by_window(att(spark, sf).withColumnRenamed("moment", "at"))
    return got.select("source_id", F.col("window.start").alias("hour"), "attempts", "failures")


@q("a06_circuit_stream", f"WITH {_STATES} SELECT source_id, seq, CAST(streak AS BIGINT) AS streak, drifts, state FROM line")
def circuit_stream(spark, sf):
    """The timeline again, as a stream over the log with keyed state and timers. A source that ends all others, far in
    the future, lets the watermark pass the log; its own row is left out."""
    columns = ("source_id", "at", "seq", "success", "found", "status", "expected_min")
    log = att(spark, sf).withColumnRenamed("moment", "at").select(*columns)
    end = spark.createDataFrame([("end", datetime(2100, 1, 1), 0, True, 1, 200, 0)], log.schema)
    source, out = store.place(spark, "attempts"), store.place(spark, "circuit")
    log.union(end).write.parquet(source)
    was = spark.conf.get(circuit.SETTING)
    spark.conf.set(circuit.SETTING, circuit.PROVIDER)
    try:
        rows = circuit.circuit(spark.readStream.schema(log.schema).parquet(source), late="0 seconds")
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-log").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(circuit.SETTING, was)
    return spark.read.schema(circuit.ROWS).parquet(out).where("kind = 'attempt' and source_id <> 'end'").select(
        "source_id", "seq", F.col("streak").cast("long").alias("streak"), F.col("drift").isNotNull().alias("drifts"), "state")


@q("e07_log_versions", """WITH h AS (SELECT url, sha256(coalesce(text, '')) AS content_hash, doc_id FROM v_version), k AS (SELECT url, content_hash, max(doc_id) AS last, max(doc_id) FILTER (doc_id % 2 = 1) AS odd FROM h GROUP BY ALL)
    SELECT url, content_hash, last AS doc_id, CAST(CASE WHEN odd = last THEN 1 ELSE 2 END AS BIGINT) AS version FROM k""")
def log_versions(spark, sf):
    """Documents written to the log in two commits, those with odd numbers first, then all: a key that is stored is written
    again only under other metadata."""
    from tidemark.plans.views import view
    from tidemark.sources.versions import Log

    rows = view(spark, sf, "v_version").select("url", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"), F.format_string("%020d", "doc_id").alias("metadata_hash"), "doc_id")
    log = Log(spark, store.place(spark, "log"))
    log.append(rows.where("doc_id % 2 = 1"))
    log.append(rows)
    return log.current().select("url", "content_hash", "doc_id", F.col("_commit").alias("version"))
