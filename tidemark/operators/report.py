"""The daily report in full: eleven sections of Markdown, as rows in the order in which they are written.

A line is (section, place, a, b, text): place 0 is the head of its section, 1 its lines, 2 what follows them; lines
are ordered by a, then b. Sections that list pairs are as long as the pairs are, so nothing numbers them: the writer
sorts by range, and part files in the order of their names are the report.
"""

from __future__ import annotations

from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import present
from tidemark.operators import health
from tidemark.sources.store import staged

#: Titles in order, and what an empty section says.
TITLES = ("NOVIDADES DE HOJE", "INSCRIÇÕES ABERTAS", "COMBINAÇÕES EXCELENTES", "COMBINAÇÕES MUITO BOAS", "CARGA HORÁRIA DESCONHECIDA", "PRAZOS SE APROXIMANDO",
          "PROVAS AGENDADAS", "RETIFICAÇÕES RECENTES", "ANÁLISE INCOMPLETA", "SAÚDE DAS FONTES", "SAÚDE DO SISTEMA")
NOTHING = "_Nada nesta categoria._"
EMPTY = {1: "_Nenhuma oportunidade nova compatível nas últimas 24 horas._", 5: "_Nenhuma oportunidade pendente de confirmação de carga horária._",
         9: "_Nenhum documento na fila de revisão._"}
#: Document types that amend; hours, days and rows that sections look back on.
AMENDING = ("RECTIFICATION", "EXTENSION", "REOPENING", "SUSPENSION", "CANCELLATION")
NEWS_HOURS, AHEAD_DAYS, AMENDED_DAYS, AMENDED, INCOMPLETE, ERROR_DAYS, ERRORS = 26, 30, 14, 25, 30, 2, 12
#: Fixed value: the head of the table of sources.
HEALTH_HEAD = "| Fonte | Estado | Última coleta OK | Docs | Parser | Observação |\n|---|---|---|---|---|---|"


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _line(section: int, place: int, a: Column, b: Column, text: Column) -> list[Column]:
    return [F.lit(section).cast("int").alias("section"), F.lit(place).cast("int").alias("place"), a.cast("long").alias("a"), b.cast("string").alias("b"), text.alias("text")]


def _head(value: Column, n: int) -> Column:
    return F.substring(value, 1, n)


def _said(value: Column) -> Column:
    """Null for an empty text."""
    return F.nullif(value, F.lit(""))


def pair_line(city: str) -> Column:
    """Five lines about a pair (cargo, institution, weekly, salary, assignment_confirmed, score, rank, confidence, start,
    deadline, exam, employment_type, state, workload, url)."""
    c = F.col
    hours = F.when(c("weekly") != 0, _text(present.short_number(c("weekly")), "h"))
    return F.concat_ws("  \n  ", _text("- **", c("cargo"), "** — ", c("institution")),
                       F.concat_ws(" · ", F.coalesce(hours, F.lit("CH?")), present.money(c("salary")), F.when(c("assignment_confirmed"), city).otherwise("lotação não confirmada"),
                                   _text(c("score").cast("string"), "/100 (", c("rank"), ")"), _text("confiança ", c("confidence"))),
                       _text("Inscrições: ", present.period(c("start"), c("deadline")), " · Prova: ", present.day(c("exam"))),
                       F.concat_ws(" · ", F.coalesce(F.try_element_at(_table(present.EMPLOYMENT), c("employment_type")), F.lit(present.EMPLOYMENT["UNKNOWN"])),
                                   present.label(c("state"), present.STATUS), _text("CH ", F.coalesce(F.try_element_at(_table(present.WORKLOAD), c("workload")), F.lit("?")))),
                       F.coalesce(_said(c("url")), F.lit("sem link oficial")))


def _table(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def about_pairs(pairs: DataFrame, today: date, now: datetime, city: str) -> DataFrame:
    """Sections 1 to 5 and 7, from one pass over the eligible pairs (those of :func:`pair_line`, and first_seen, position)."""
    c, t = F.col, F.lit(today)
    live = ~c("state").isin("CANCELLED", "EXPIRED")
    wanted = F.array_compact(F.array(*[F.when(known, n) for n, known in (
        (1, c("first_seen") >= F.lit(now) - F.expr(f"interval {NEWS_HOURS} hours")), (2, live & (c("start") <= t) & (c("deadline") >= t)), (3, live & (c("rank") == "EXCELLENT")),
        (4, live & (c("rank") == "VERY GOOD")), (5, live & (c("workload") == "UNKNOWN")), (7, live & (c("exam") >= t)))]))
    short = _text("- ", present.day(c("exam")), " — ", c("cargo"), " · ", c("institution"))
    order = F.concat_ws(" ", F.coalesce(c("deadline").cast("string"), F.lit("9999-12-31")), "position")
    rows = pairs.where("eligible").withColumn("_section", F.explode(wanted))
    return rows.select(c("_section").cast("int").alias("section"), F.lit(1).alias("place"), (-c("score")).cast("long").alias("a"), order.alias("b"),
                       F.when(c("_section") == 7, short).otherwise(pair_line(city)).alias("text"))


def about_deadlines(deadlines: DataFrame, opportunities: DataFrame, today: date) -> DataFrame:
    """Section 6: ``deadlines`` (id, kind, due) of eligible ``opportunities`` (id, name, institution, eligible)."""
    t, due = F.lit(today), F.col("due")
    near = deadlines.where(due.between(t, F.date_add(t, AHEAD_DAYS))).join(opportunities.where("eligible").select("id", "name", "institution"), "id")
    said = _text("- ", present.day(due), " (em ", F.date_diff(due, t).cast("string"), "d) — ", present.label(F.col("kind"), present.DEADLINES), " · ", F.col("institution"), " — ", F.col("name"))
    return near.select(*_line(6, 1, F.unix_date(due), F.concat_ws(" ", "id", "kind"), said))


def about_documents(documents: DataFrame, now: datetime) -> DataFrame:
    """Sections 8 and 9: the last amending documents and those whose analysis is incomplete, of ``documents`` (url, title,
    document_type, processing_state, review_reason, last_seen)."""
    c = F.col
    late = -F.unix_micros("last_seen")
    amended = documents.where(c("document_type").isin(*AMENDING) & (c("last_seen") >= F.lit(now) - F.expr(f"interval {AMENDED_DAYS} days")))
    said = _text("- ", c("document_type"), " — ", _head(F.coalesce(_said(c("title")), c("url")), 110), "  \n  ", c("url"))
    held = documents.where("processing_state = 'REVIEW'")
    why = _text("- ", _head(F.coalesce(_said(c("review_reason")), F.lit("motivo não registrado")), 120), "  \n  ", c("url"))
    last = lambda rows, n: rows.orderBy(F.desc("last_seen"), "url").limit(n)  # noqa: E731  (top-k sections of the report)
    return last(amended, AMENDED).select(*_line(8, 1, late, c("url"), said)).union(last(held, INCOMPLETE).select(*_line(9, 1, late, c("url"), why)))


def about_sources(sources: DataFrame, states: DataFrame, zone: str) -> DataFrame:
    """Section 10: ``sources`` (id, priority, limitations) with their ``states`` (source_id, state, last_success, documents,
    parsed, tried, last_error), and their numbers by state."""
    c = F.col
    rows = sources.join(states.withColumnRenamed("source_id", "id"), "id")
    ok = F.coalesce(F.date_format(F.from_utc_timestamp("last_success", zone), "dd/MM HH:mm"), F.lit("nunca"))
    rate = _text(F.bround(health.rate(c("parsed"), c("tried")) * 100, 0).cast("int").cast("string"), "%")
    note = _head(F.coalesce(_said(c("last_error")), c("limitations"), F.lit("")), 70)
    said = _text("| ", F.concat_ws(" | ", "id", "state", ok, F.coalesce("documents", F.lit(0)).cast("string"), rate, note), " |")
    n = lambda state: F.count_if(c("state") == state).cast("string")
    total = rows.agg(F.count(F.lit(1)).cast("string").alias("n"), n("HEALTHY").alias("h"), n("DEGRADED").alias("d"), n("OPEN").alias("o"), n("DISABLED").alias("x"))
    below = _text("Total ", c("n"), " · saudáveis ", c("h"), " · degradadas ", c("d"), " · circuito aberto ", c("o"), " · desativadas ", c("x"))
    return rows.select(*_line(10, 1, c("priority"), c("id"), said)).union(total.select(*_line(10, 2, F.lit(0), F.lit(""), below)))


def about_system(runs: DataFrame, outbox: DataFrame, opportunities: DataFrame, errors: DataFrame, now: datetime, zone: str) -> DataFrame:
    """Section 11: the last of ``runs`` (started_at, status, successful, attempted, documents, created, errors), the outbox
    by status, the opportunities, and the last ``errors`` (created_at, seq, stage, kind, source_id, message)."""
    c, s = F.col, lambda name: F.col(name).cast("string")
    last = runs.orderBy(F.desc("started_at")).limit(1)
    run = _text("- Última execução: **", c("status"), "** em ", present.local_time(c("started_at"), zone), " · ", s("successful"), "/", s("attempted"), " fontes · ", s("documents"),
                " documentos · ", s("created"), " novas oportunidades · ", s("errors"), " erros")
    by = outbox.groupBy("status").count().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("status", "count"))), lambda x: F.concat_ws(" ", x["status"], x["count"].cast("string"))), ", ").alias("n"))
    held = opportunities.agg(F.count(F.lit(1)).alias("n"), F.count_if("eligible").alias("e"))
    recent = errors.where(c("created_at") >= F.lit(now) - F.expr(f"interval {ERROR_DAYS} days")).orderBy(F.desc("created_at"), F.desc("seq")).limit(ERRORS)
    what = _text("  - `", c("stage"), "/", c("kind"), "` ", F.coalesce("source_id", F.lit("")), " — ", _head(c("message"), 90))
    parts = [last.select(*_line(11, 1, F.lit(1), F.lit(""), run)),
             by.select(*_line(11, 1, F.lit(2), F.lit(""), _text("- Notificações: ", F.coalesce(_said(c("n")), F.lit("nenhuma registrada"))))),
             held.select(*_line(11, 1, F.lit(3), F.lit(""), _text("- Oportunidades no banco: ", s("n"), " · compatíveis: ", s("e")))),
             recent.agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(*_line(11, 1, F.lit(4), F.lit(""), F.lit("- Erros recentes:"))),
             recent.select(*_line(11, 1, F.lit(5), F.format_string("%020d %020d", F.lit(2**62) - F.unix_micros("created_at"), F.lit(2**62) - c("seq")), what))]
    return reduce(DataFrame.union, parts)


def assembled(lines: DataFrame) -> DataFrame:
    """Lines of all sections with their heads; a section without lines says so."""
    kept = staged(lines)
    spark = kept.sparkSession
    first = [(n, 0, 0, "", f"## {title}\n" + (f"\n{HEALTH_HEAD}" if n == 10 else "")) for n, title in enumerate(TITLES, 1)]
    none = [(n, 1, 0, "", EMPTY.get(n, NOTHING)) for n in range(1, len(TITLES) + 1) if n != 10]
    shape = "section int, place int, a long, b string, text string"
    silent = spark.createDataFrame(none, shape).join(kept.where("place = 1").select("section").distinct(), "section", "left_anti")
    return kept.union(spark.createDataFrame(first, shape)).union(silent.select(*kept.columns))


def written(lines: DataFrame, path: str, title: str, now: datetime, zone: str, profile: str) -> None:
    """The report as text files: a range sort over all lines, in as many parts as there is text."""
    spark = lines.sparkSession
    said = F.concat(F.lit(f"# {title}\n\nGerado em **"), present.local_time(F.lit(now), zone), F.lit(f"** ({zone})  \nPerfil: {profile}\n"))
    top = spark.range(1).select(*_line(0, 0, F.lit(0), F.lit(""), said))
    end = spark.range(1).select(*_line(len(TITLES) + 1, 0, F.lit(0), F.lit(""), F.lit(
        "---\n\n_Todo dado acima vem de documento oficial coletado e versionado. Campos ausentes aparecem como não informados._")))
    every = lines.union(top).union(end)
    after = F.when((F.col("section").between(1, 11)) & (F.col("place") == 0), F.concat(F.lit("\n"), "text")).when((F.col("section") == 10) & (F.col("place") == 2), F.concat(F.lit("\n"), "text")).otherwise(F.col("text"))
    every.orderBy("section", "place", "a", "b", "text").select(after.alias("text")).write.text(path)
