"""Queries over the serving surface, sinks and registry operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import registry, serve
from tidemark.functions import present
from tidemark.functions.score import accepting
from tidemark.plans.relational import NOW, _CASES, _DAY_OF, _MONEY, _PAIRS, _PERIOD, _RUNS, _STATES, _SURE, pairs, q, src, states, watchdog
from tidemark.plans.views import TODAY
from tidemark.sources import sinks


@q("b_route", """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'buscar' WHEN 1 THEN 'vagas' WHEN 2 THEN 'unknown' WHEN 3 THEN 'question' WHEN 4 THEN 'free' ELSE 'ajuda' END AS command,
    CASE WHEN event_id % 6 = 0 THEN event_type WHEN event_id % 6 = 2 THEN '' WHEN event_id % 6 = 1 THEN 'Quais as vagas?' WHEN event_id % 6 = 3 THEN 'Qual o salário do agente?' WHEN event_id % 6 = 4 THEN 'conte algo' ELSE '' END AS argument FROM events""")
def routed(spark, sf):
    k = F.col("event_id") % 6
    said = F.when(k == 0, F.concat(F.lit("/buscar "), "event_type")).when(k == 1, "Quais as vagas?").when(k == 2, "/xyz").when(k == 3, "Qual o salário do agente?").when(k == 4, "conte algo").otherwise("/start@bot")
    r = serve.route(said)
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", r["command"].alias("command"), r["argument"].alias("argument"))


@q("b_search_pages", f"""WITH {_PAIRS}, w AS (SELECT *, lower(concat(cargo, ' ', institution, ' ', name)) AS hay FROM pairs),
    h AS (SELECT 1 AS request, 2 AS page, * FROM w WHERE contains(hay, 'red') AND contains(hay, 'prefeitura') UNION ALL SELECT 2, 1, * FROM w WHERE contains(hay, 'small')),
    n AS (SELECT request, page, position, row_number() OVER (PARTITION BY request ORDER BY eligible DESC, score DESC, deadline ASC NULLS LAST, position) AS n, count(*) OVER (PARTITION BY request) AS total FROM h)
    SELECT CAST(request AS INT) AS request, CAST(n AS INT) AS n, total, position FROM n WHERE n > (page - 1) * 5 AND n <= page * 5""")
def search_pages(spark, sf):
    asked = spark.createDataFrame([(1, "Red Prefeitura --pagina 2"), (2, "small")], "request int, argument string")
    return serve.search(asked, pairs(spark, sf)).select("request", F.col("n").cast("int").alias("n"), "total", "position")


def _columns():
    return {c: F.col(c) for c in ("cargo", "institution", "state", "salary", "weekly", "location", "assignment_confirmed", "vacancies", "start", "deadline", "exam", "fee", "employment_type", "score", "confidence", "eligible")}


_STATE_NAME = _CASES(present.STATUS, "state")


def _summary(first: str, joint: str) -> str:
    """The five lines of a summary in SQL."""
    return f"""concat_ws('{joint}', concat('{first}', cargo), concat('  ', institution), concat('  ', CASE WHEN eligible THEN 'compatível com o filtro' ELSE 'fora do filtro ou não confirmado' END, ' · ', {_STATE_NAME}),
        concat('  ', {_MONEY.format('salary')}, ' · ', coalesce(weekly || 'h/semana', 'CH não informada')), concat('  Inscrições: ', {_PERIOD}))"""


@q("b_cards", f"""WITH {_PAIRS} SELECT id, position, concat_ws(chr(10), cargo, institution, concat('Situação: ', {_STATE_NAME}), concat('Salário: ', {_MONEY.format('salary')}, ' · Jornada: ', coalesce(weekly || 'h/semana', 'não informada')),
    concat('Lotação: ', coalesce(location, 'não confirmada'), CASE WHEN assignment_confirmed THEN ' (confirmada)' ELSE ' (sem confirmação)' END), concat('Vagas: ', vacancies), concat('Inscrições: ', {_PERIOD}), concat('Prova: ', {_DAY_OF.format('exam')}),
    concat('Taxa: ', {_MONEY.format('fee')}), concat('Vínculo: ', {_CASES(present.EMPLOYMENT, 'employment_type')}), concat('Avaliação: ', score, '/100 · confiança ', {_SURE}), 'Use o código para a ficha completa.') AS card
    FROM pairs WHERE state = 'REGISTRATION_OPEN'""")
def cards(spark, sf):
    """The card of every position of an open opportunity."""
    return pairs(spark, sf).where("state = 'REGISTRATION_OPEN'").select("id", "position", serve.card(_columns()).alias("card"))


@q("b_summaries", f"WITH {_PAIRS} SELECT id, position, replace({_summary('• ', '~')}, '~', chr(10)) AS summary FROM pairs WHERE eligible")
def summaries(spark, sf):
    return pairs(spark, sf).where("eligible").select("id", "position", serve.summary(_columns()).alias("summary"))


@q("b_marks", """SELECT position, arg_max(status, n) AS status FROM (SELECT user_id AS position, event_id AS n, CASE event_type WHEN 'click' THEN 'INTERESTED' WHEN 'signup' THEN 'REGISTERED' WHEN 'error' THEN 'DISMISSED' ELSE '' END AS status FROM events WHERE event_type <> 'view')
    GROUP BY position HAVING arg_max(status, n) <> ''""")
def marked(spark, sf):
    """Decisions after all events in order; purchases forget."""
    command = F.when(F.col("event_type") == "click", "salvar").when(F.col("event_type") == "signup", "inscrito").when(F.col("event_type") == "error", "descartar").otherwise("esquecer")
    asked = spark.read.parquet(f"{sf}/events.parquet").where("event_type <> 'view'").select(F.col("user_id").alias("position"), command.alias("command"), F.col("event_id").alias("at"))
    return serve.marks(asked, spark.createDataFrame([], "position long, status string, at long")).select("position", "status")


@q("b_report", f"""WITH {_PAIRS}, r AS (SELECT unnest(list_filter([CASE WHEN state = 'REGISTRATION_OPEN' THEN '1 Inscrições abertas' END, CASE WHEN deadline BETWEEN DATE '1998-06-15' AND DATE '1998-06-15' + 30 THEN '2 Prazos em 30 dias' END,
        CASE WHEN state = 'EXAM_SCHEDULED' THEN '3 Provas marcadas' END, CASE WHEN score >= 90 THEN '4 Excelentes' END, CASE WHEN workload = 'UNKNOWN' THEN '5 Carga horária desconhecida' END], lambda x: x IS NOT NULL)) AS section,
        regexp_replace({_summary('- ', '~')}, '~ *', ' · ', 'g') AS text, score, position FROM pairs WHERE eligible)
    SELECT section, CAST(line AS INT) AS line, text FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY score DESC, position) AS line FROM r) WHERE line <= 25""")
def report(spark, sf):
    return serve.report(pairs(spark, sf), TODAY)


@q("k05_issues", f"WITH {_STATES} SELECT source_id FROM last WHERE state <> 'HEALTHY' AND source_id NOT IN (SELECT id FROM v_source WHERE CAST(substr(id, 2) AS INT) % 2 = 0)")
def issues(spark, sf):
    needed = states(spark, sf).where("state <> 'HEALTHY'").select("source_id")
    known = src(spark, sf).select(F.col("id").alias("source_id"), (F.substring("id", 2, 9).cast("int") % 2 == 0).alias("open"))
    return serve.open_issues(needed, known).select("source_id")


@q("k07_heartbeat", f"""WITH {_STATES}, {_RUNS}, o AS (SELECT count(*) FILTER (state IN ('OPEN', 'DISABLED')) AS open_sources FROM last), f AS (SELECT count(*) FILTER (status IN ('FAILED', 'UNCERTAIN')) AS failed FROM v_notification),
    h AS (SELECT max(day) AS d FROM judged WHERE run_status IN ('SUCCESS', 'PARTIAL'))
    SELECT concat('{{"severity":"', CASE WHEN d IS NULL OR date_diff('hour', CAST(d AS TIMESTAMP), TIMESTAMP '2024-01-29 12:00:00') > 30 THEN 'CRITICAL' WHEN open_sources > 0 OR failed > 0 THEN 'WARNING' ELSE 'OK' END,
        '","open_sources":', open_sources, ',"failed_messages":', failed, ',"at":"2024-01-29T12:00:00"}}') AS payload FROM o, f, h""")
def heartbeat(spark, sf):
    return sinks.heartbeat(watchdog(spark, sf), NOW)


@q("s01_registry_problems", "SELECT id, 'bad_url' AS problem FROM v_source WHERE priority = 3 UNION ALL SELECT id, 'no_hosts' FROM v_source WHERE priority = 4")
def registry_problems(spark, sf):
    s = src(spark, sf)
    return registry.problems(s.select("id", F.when(F.col("priority") == 3, "nonsense").otherwise(F.col("base_url")).alias("base_url"),
                                      F.when(F.col("priority") == 4, F.array().cast("array<string>")).otherwise(F.array(F.lit("x.example"))).alias("allowed_hosts")))


@q("s03_decoded_config", "SELECT id, CAST(CASE WHEN max_documents = 0 THEN 40 ELSE max_documents END AS INT) AS max_documents, CAST(CASE WHEN expected_min = 0 THEN 1 ELSE expected_min END AS INT) AS expected_min FROM v_source")
def decoded(spark, sf):
    return registry.decoded(src(spark, sf))


@q("s04_candidates", "SELECT concat('new', id) AS id, CAST(3 AS INT) AS trust_level, 'CANDIDATE' AS trust_status FROM v_source WHERE priority > 20")
def candidates(spark, sf):
    s = src(spark, sf)
    offered = s.where("priority > 20").select(F.concat(F.lit("new"), "id").alias("id")).union(s.select("id"))
    return registry.register_candidates(offered, s).select("id", "trust_level", "trust_status")


@q("b_context", f"""WITH {_PAIRS}, q AS (SELECT * FROM (VALUES (1, ['red', 'anvil']), (2, ['anvil', 'red', 'small', 'zz']), (3, ['astronauta']), (4, [])) t(request, words)),
    w AS (SELECT *, lower(concat(cargo, ' ', institution, ' ', name)) AS hay, {_summary('• ', '~')} AS said, row_number() OVER (ORDER BY eligible DESC, score DESC, deadline ASC NULLS LAST, position) AS place,
        eligible AND state NOT IN ('CANCELLED', 'SUSPENDED', 'HOMOLOGATED', 'EXPIRED', 'REGISTRATION_CLOSED', 'EXAM_SCHEDULED') AND coalesce(deadline >= DATE '1998-06-15', true) AS fits FROM pairs),
    few AS (SELECT position, place, row_number() OVER (ORDER BY place) AS n FROM w WHERE fits QUALIFY n <= 10),
    whole AS (SELECT request, position, row_number() OVER (PARTITION BY request ORDER BY place) AS n FROM q, w WHERE len(words) > 0 AND len(list_filter(words, lambda x: NOT contains(hay, x))) = 0),
    single AS (SELECT request, unnest(words) AS word, generate_subscripts(words, 1) AS k FROM q WHERE request NOT IN (SELECT request FROM whole)),
    each AS (SELECT request, position, min({{'k': k, 'place': place}}) AS spot FROM single, w WHERE length(word) >= 4 AND contains(hay, word) GROUP BY ALL),
    cited AS (SELECT * FROM whole WHERE n <= 6 UNION ALL SELECT request, position, row_number() OVER (PARTITION BY request ORDER BY spot) AS n FROM each QUALIFY n <= 6),
    picked AS (SELECT request, position, n FROM q, few UNION ALL SELECT request, position, n + 10 FROM cited WHERE position NOT IN (SELECT position FROM few)),
    sized AS (SELECT request, position, n, said, sum(length(said) + 2) OVER (PARTITION BY request ORDER BY n) AS used FROM picked JOIN w USING (position))
    SELECT q.request, coalesce(string_agg(position, ',' ORDER BY n), '') AS positions, replace(coalesce(string_agg(said, '~~' ORDER BY n), ''), '~', chr(10)) AS context FROM q LEFT JOIN sized ON sized.request = q.request AND used <= 2402 GROUP BY q.request""")
def contexts(spark, sf):
    """What a model is told of free questions: all words found, some found one after another, none found, no word."""
    asked = spark.createDataFrame([(1, "Vale a pena o RED anvil?"), (2, "Qual a diferença entre anvil, red, small e zz"), (3, "E o astronauta?"), (4, "Qual?")], "request int, text string")
    p = pairs(spark, sf).withColumn("accepting", accepting(F.col("state"), F.col("deadline"), TODAY))
    return serve.context(asked, p, chars=2400).select("request", F.array_join("positions", ",").alias("positions"), "context")
