"""The daily report in full, and the checks of claims by outcome, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import present, verify
from tidemark.operators import history, report
from tidemark.plans.parsing import claims
from tidemark.plans.relational import NOW, _CASES, _DAY_OF, _MONEY, _PAIRS, _PERIOD, _RANK, _RUNS, _STATES, _SURE, att, note, opp, pairs, q, runs, src, states
from tidemark.plans.views import TODAY

ZONE, CITY = "America/Rio_Branco", "Rio Branco"
_AT = "TIMESTAMP '2024-01-29 12:00:00'"
_T = "DATE '1998-06-15'"
_WORDS = {"registration": present.DEADLINES["registration"], "exam": present.DEADLINES["exam"], "fee_exemption": present.DEADLINES["fee_exemption"], "payment": present.DEADLINES["payment"]}
_FULL_LINE = f"""concat('- **', cargo, '** — ', institution, j, CASE WHEN weekly <> 0 THEN concat(weekly, 'h') ELSE 'CH?' END, ' · ', {_MONEY.format('salary')}, ' · ',
    CASE WHEN assignment_confirmed THEN 'Rio Branco' ELSE 'lotação não confirmada' END, ' · ', score, '/100 (', rank, ') · confiança ', {_SURE}, j, 'Inscrições: ', {_PERIOD}, ' · Prova: ', {_DAY_OF.format('exam')}, j,
    {_CASES(present.EMPLOYMENT, 'employment_type')}, ' · ', {_CASES(present.STATUS, 'state')}, ' · CH ', {_CASES(present.WORKLOAD, 'workload')}, j, CASE WHEN id % 3 = 0 THEN concat('https://e.example/', id) ELSE 'sem link oficial' END)"""


@q("k01_report", f"""WITH {_PAIRS}, {_STATES}, {_RUNS},
    p AS (SELECT *, {_RANK} AS rank, concat('  ', chr(10), '  ') AS j, state NOT IN ('CANCELLED', 'EXPIRED') AS live, {_AT} - to_hours(CAST(id % 60 AS BIGINT)) AS first_seen FROM pairs WHERE eligible),
    picked AS (SELECT *, unnest(list_filter([CASE WHEN first_seen >= {_AT} - INTERVAL 26 HOUR THEN 1 END, CASE WHEN live AND start <= {_T} AND deadline >= {_T} THEN 2 END, CASE WHEN live AND rank = 'EXCELLENT' THEN 3 END,
        CASE WHEN live AND rank = 'VERY GOOD' THEN 4 END, CASE WHEN live AND workload = 'UNKNOWN' THEN 5 END, CASE WHEN live AND exam >= {_T} THEN 7 END], lambda x: x IS NOT NULL)) AS section FROM p),
    ds AS (SELECT concat('doc://', coalesce(source, ''), '/', doc_id) AS url, CASE WHEN doc_id % 2 = 0 THEN text END AS title, {_AT} - to_days(CAST(doc_id % 40 AS INT)) AS seen,
        CASE doc_id % 12 WHEN 0 THEN 'RECTIFICATION' WHEN 1 THEN 'EXTENSION' WHEN 2 THEN 'REOPENING' WHEN 3 THEN 'SUSPENSION' WHEN 4 THEN 'CANCELLATION' END AS kind,
        doc_id % 7 = 0 AS held, CASE WHEN doc_id % 14 = 0 THEN concat('motivo ', coalesce(lang, ''), ' ', n_chars) WHEN doc_id % 3 = 0 THEN '' END AS why FROM documents),
    hs AS (SELECT source_id, max(moment) FILTER (success) AS ok, count(*) FILTER (success) AS good, count(*) AS tried, arg_max(found, (moment, seq)) AS docs,
        arg_max(concat('tentativa ', seq, ' sem resposta do servidor, status ', coalesce(CAST(status AS VARCHAR), 'nenhum'), '; a fonte será tentada de novo'), (moment, seq)) FILTER (NOT success) AS err FROM v_attempt GROUP BY source_id),
    h AS (SELECT id, priority, last.state, ok, good, tried, docs, coalesce(err, 'sem limites') AS said FROM v_source JOIN hs ON hs.source_id = id JOIN last ON last.source_id = id),
    r AS (SELECT day, any_value(run_status) AS status, any_value(successful) AS successful, any_value(attempted) AS attempted, any_value(errors) AS errors, sum(found) AS documents, count(*) FILTER (found % 10 = 0) AS created FROM judged JOIN v_attempt USING (day) GROUP BY day ORDER BY day DESC LIMIT 1),
    x AS (SELECT * FROM v_attempt WHERE NOT success AND moment >= {_AT} - INTERVAL 2 DAY ORDER BY moment DESC, seq DESC LIMIT 12),
    l AS (SELECT section, 1 AS place, -score AS a, concat(coalesce(CAST(deadline AS VARCHAR), '9999-12-31'), ' ', position) AS b, CASE WHEN section = 7 THEN concat('- ', {_DAY_OF.format('exam')}, ' — ', cargo, ' · ', institution) ELSE {_FULL_LINE} END AS text FROM picked
      UNION ALL SELECT 6, 1, due - DATE '1970-01-01', concat(id, ' ', kind), concat('- ', strftime(due, '%d/%m/%Y'), ' (em ', due - {_T}, 'd) — ', {_CASES(_WORDS, 'kind')}, ' · ', institution, ' — ', name)
        FROM (SELECT id, name, institution, unnest([{{'kind': 'registration', 'due': deadline}}, {{'kind': 'exam', 'due': exam}}, {{'kind': 'fee_exemption', 'due': exemption}}, {{'kind': 'payment', 'due': payment}}], recursive := true)
              FROM v_opportunity WHERE id IN (SELECT id FROM p)) WHERE due BETWEEN {_T} AND {_T} + 30
      UNION ALL (SELECT 8, 1, -epoch_us(seen), url, concat('- ', kind, ' — ', substring(coalesce(nullif(title, ''), url), 1, 110), '  ', chr(10), '  ', url) FROM ds WHERE kind IS NOT NULL AND seen >= {_AT} - INTERVAL 14 DAY ORDER BY seen DESC, url LIMIT 25)
      UNION ALL (SELECT 9, 1, -epoch_us(seen), url, concat('- ', substring(coalesce(nullif(why, ''), 'motivo não registrado'), 1, 120), '  ', chr(10), '  ', url) FROM ds WHERE held ORDER BY seen DESC, url LIMIT 30)
      UNION ALL SELECT 10, 1, priority, id, concat('| ', concat_ws(' | ', id, state, coalesce(strftime(ok - INTERVAL 5 HOUR, '%d/%m %H:%M'), 'nunca'), docs, concat(CAST(round_even(round(good / tried, 3) * 100, 0) AS INT), '%'), substring(said, 1, 70)), ' |') FROM h
      UNION ALL SELECT 10, 2, 0, '', concat('Total ', count(*), ' · saudáveis ', count(*) FILTER (state = 'HEALTHY'), ' · degradadas ', count(*) FILTER (state = 'DEGRADED'), ' · circuito aberto ', count(*) FILTER (state = 'OPEN'), ' · desativadas 0') FROM h
      UNION ALL SELECT 11, 1, 1, '', concat('- Última execução: **', status, '** em ', strftime(CAST(day AS TIMESTAMP) - INTERVAL 5 HOUR, '%d/%m/%Y %H:%M'), ' · ', successful, '/', attempted, ' fontes · ', documents, ' documentos · ', created, ' novas oportunidades · ', errors, ' erros') FROM r
      UNION ALL SELECT 11, 1, 2, '', concat('- Notificações: ', string_agg(concat(status, ' ', n), ', ' ORDER BY status)) FROM (SELECT status, count(*) AS n FROM v_notification GROUP BY status)
      UNION ALL SELECT 11, 1, 3, '', concat('- Oportunidades no banco: ', count(*), ' · compatíveis: ', count(*) FILTER (id IN (SELECT id FROM p))) FROM v_opportunity
      UNION ALL SELECT 11, 1, 4, '', '- Erros recentes:' FROM x HAVING count(*) > 0
      UNION ALL SELECT 11, 1, 5, concat(lpad(CAST(4611686018427387904 - epoch_us(moment) AS VARCHAR), 20, '0'), ' ', lpad(CAST(4611686018427387904 - seq AS VARCHAR), 20, '0')),
        concat('  - `FETCH/', CASE WHEN status IS NULL THEN 'NETWORK' ELSE concat('HTTP_', status) END, '` ', source_id, ' — tentativa ', seq, ' sem resposta') FROM x),
    t AS (SELECT CAST(unnest(range(1, 12)) AS INT) AS section, unnest([{', '.join(f"'{t}'" for t in report.TITLES)}]) AS title)
    SELECT CAST(section AS INT) AS section, CAST(place AS INT) AS place, CAST(a AS BIGINT) AS a, b, text FROM l
    UNION ALL SELECT section, 0, 0, '', concat('## ', title, chr(10), CASE WHEN section = 10 THEN concat(chr(10), '| Fonte | Estado | Última coleta OK | Docs | Parser | Observação |', chr(10), '|---|---|---|---|---|---|') ELSE '' END) FROM t
    UNION ALL SELECT section, 1, 0, '', CASE section WHEN 1 THEN '_Nenhuma oportunidade nova compatível nas últimas 24 horas._' WHEN 5 THEN '_Nenhuma oportunidade pendente de confirmação de carga horária._' WHEN 9 THEN '_Nenhum documento na fila de revisão._' ELSE '_Nada nesta categoria._' END
      FROM t WHERE section <> 10 AND section NOT IN (SELECT section FROM l)""")
def full_report(spark, sf):
    """All eleven sections over all pairs, documents, sources, runs, messages and errors."""
    c, now = F.col, F.lit(NOW)
    p = pairs(spark, sf).withColumns({"first_seen": now - F.make_dt_interval(hours=(c("id") % 60).cast("int")), "url": F.when(c("id") % 3 == 0, F.concat(F.lit("https://e.example/"), "id"))})
    fit = p.where("eligible").select("id").distinct().withColumn("eligible", F.lit(True))
    stored = opp(spark, sf)
    o = stored.select("id", "name", "institution").join(fit, "id", "left").withColumn("eligible", F.coalesce("eligible", F.lit(False)))
    n = c("doc_id")
    types = F.create_map(*[F.lit(x) for pair in enumerate(report.AMENDING) for x in pair])
    d = spark.read.parquet(f"{sf}/documents.parquet").select(
        F.concat(F.lit("doc://"), F.coalesce("source", F.lit("")), F.lit("/"), "doc_id").alias("url"), F.when(n % 2 == 0, c("text")).alias("title"), F.try_element_at(types, (n % 12).cast("int")).alias("document_type"),
        F.when(n % 7 == 0, "REVIEW").otherwise("DONE").alias("processing_state"), F.when(n % 14 == 0, F.concat_ws(" ", F.lit("motivo"), F.coalesce("lang", F.lit("")), "n_chars")).when(n % 3 == 0, "").alias("review_reason"),
        (now - F.make_dt_interval(days=(n % 40).cast("int"))).alias("last_seen"))
    a = att(spark, sf)
    why = F.concat(F.lit("tentativa "), "seq", F.lit(" sem resposta do servidor, status "), F.coalesce(c("status").cast("string"), F.lit("nenhum")), F.lit("; a fonte será tentada de novo"))
    order = F.struct("moment", "seq")
    seen = a.groupBy("source_id").agg(F.max(F.when(c("success"), c("moment"))).alias("last_success"), F.max_by("found", order).alias("documents"), F.count_if("success").alias("parsed"), F.count(F.lit(1)).alias("tried"),
                                      F.max_by(why, F.when(~c("success"), order)).alias("last_error"))
    after = states(spark, sf).select("source_id", "state").join(seen, "source_id")
    found = a.groupBy("day").agg(F.sum("found").alias("documents"), F.count_if(c("found") % 10 == 0).alias("created"))
    r = runs(spark, sf).join(found, "day").select(c("day").cast("timestamp").alias("started_at"), c("run_status").alias("status"), "successful", "attempted", "documents", "created", "errors")
    e = a.where("not success").select(c("moment").alias("created_at"), "seq", F.lit("FETCH").alias("stage"), F.coalesce(F.concat(F.lit("HTTP_"), "status"), F.lit("NETWORK")).alias("kind"), "source_id",
                                      F.concat(F.lit("tentativa "), "seq", F.lit(" sem resposta")).alias("message"))
    s = src(spark, sf).select("id", "priority", F.lit("sem limites").alias("limitations"))
    parts = [report.about_pairs(p, TODAY, NOW, CITY), report.about_deadlines(history.deadlines(stored), o, TODAY), report.about_documents(d, NOW),
             report.about_sources(s, after, ZONE), report.about_system(r, note(spark, sf), o, e, NOW, ZONE)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    return report.assembled(whole)


@q("v_claim_outcomes", """SELECT o_orderpriority AS priority, count(*) FILTER (s = 'confirmed') AS confirmed, count(*) FILTER (s = 'quote_not_found') AS quote_not_found, count(*) FILTER (s = 'parser_disagrees') AS parser_disagrees, count(*) FILTER (s = 'rejected') AS rejected
    FROM (SELECT o_orderpriority, CASE WHEN o_orderkey % 7 = 6 THEN 'rejected' WHEN o_orderkey % 3 = 2 THEN 'quote_not_found' WHEN o_orderkey % 10 <> 9 AND o_orderkey % 3 = 0 THEN 'confirmed' ELSE 'parser_disagrees' END AS s FROM orders) GROUP BY o_orderpriority""")
def claim_outcomes(spark, sf):
    """Checked claims by outcome, by priority of their order; claims about a field without a verifier are rejected."""
    k = F.col("id")
    checked = claims(spark, sf).withColumn("status", F.when(k % 7 == 6, verify.verify("validity", F.lit("x"), F.lit("x"), F.lit("x"))["status"]).otherwise(F.col("status")))
    orders = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"))
    return checked.join(orders, "id").groupBy("priority").agg(*verify.outcomes(F.col("status")))
