"""Drafts of opportunities from documents: every parser in one select, tables before text.

``documents``: doc, title, text, institution, board, header_date, url, media_type. ``tables`` as in
:mod:`tables`. Both are joined on doc only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import cells, parse, score
from tidemark.functions.text import labelled, let
from tidemark.operators import tables as table_rules

DATES = ("registration_start", "registration_deadline", "fee_exemption_deadline", "payment_deadline", "exam_date", "publication_date")
FEE_WINDOW, HEAD = 260, 6000


def build(documents: DataFrame, tables: DataFrame, city: str) -> DataFrame:
    """One row a document: what the record merge takes, with ``material`` (it has a position, a number, a
    deadline or an exam, and offers work) and ``review_reasons``."""
    planned = table_rules.schedule(tables).groupBy("doc").pivot("field", list(DATES)).agg(F.first("due"))
    planned = planned.select("doc", *[F.col(c).alias(f"t_{c}") for c in DATES])
    fees = table_rules.fee(tables).select("doc", F.col("fee").alias("t_fee"))
    counted = table_rules.merged_rows(table_rules.positions(tables, city)).groupBy("doc").agg(F.count(F.lit(1)).alias("n_positions"))
    text, title = F.coalesce("text", F.lit("")), F.coalesce("title", F.substring_index(F.coalesce("text", F.lit("")), "\n", 1))
    rows = documents.withColumns({"text": text, "title": F.substring(title, 1, 200)})
    head = F.substring("text", 1, HEAD)
    read = rows.select(
        "*", parse.location_context(F.col("text"), city).alias("where"), parse.institution_implies_city(F.col("institution"), city).alias("municipal"),
        parse.schedule_from_text(F.col("text")).alias("said"), F.coalesce(parse.edital_number(F.col("title")), parse.edital_number(head)).alias("edital_number"),
        parse.publication_date(F.col("title"), F.col("text"), F.col("header_date")).alias("published"), parse.classify_document(F.col("title"), F.col("text")).alias("document_type"),
        parse.employment_type(F.concat_ws("\n", "title", F.substring("text", 1, 8000))).alias("employment_type"), parse.employment_regime(F.col("text")).alias("employment_regime"),
        parse.fee_exemption(F.col("text")).alias("fee_exemption"), parse.board(F.col("text"), F.col("board")).alias("organizing_board"),
        parse.stages(F.col("text")).alias("stages"), parse.validity(F.col("text")).alias("validity"),
        parse.parse_money(labelled(F.col("text"), cells.FEE, FEE_WINDOW)).alias("said_fee"), parse.is_job_selection(F.col("title"), F.col("text")).alias("work"))
    all_ = read.join(planned, "doc", "left").join(fees, "doc", "left").join(counted, "doc", "left")
    assigned = F.col("where.assignment") | F.col("municipal")
    exam_only = F.col("where.exam_only") & ~F.col("municipal")
    out = all_.select(
        "doc", "institution", "url", parse.selection_name(F.col("title"), F.col("text"), F.col("institution"), F.col("edital_number")).alias("name"), "edital_number",
        F.coalesce("t_publication_date", "published").alias("publication_date"), "employment_type", "employment_regime", "fee_exemption", "organizing_board",
        F.coalesce("t_registration_start", "said.start").alias("registration_start"), F.coalesce("t_registration_deadline", "said.deadline").alias("registration_deadline"),
        F.coalesce("t_fee", "said_fee").alias("application_fee"), F.col("t_fee_exemption_deadline").alias("fee_exemption_deadline"),
        F.col("t_payment_deadline").alias("payment_deadline"), F.coalesce("t_exam_date", "said.exam").alias("exam_date"),
        F.when(exam_only | assigned, city).alias("exam_location"), "stages", "validity", F.when(F.col("media_type") == "pdf", F.col("url")).alias("official_edital_url"),
        F.col("url").alias("official_institution_url"), "document_type", assigned.alias("assignment"), exam_only.alias("exam_only"), "work", F.coalesce("n_positions", F.lit(0)).alias("n_positions"))
    signal = (F.col("n_positions") > 0) | F.col("edital_number").isNotNull() | F.col("registration_deadline").isNotNull() | F.col("exam_date").isNotNull()
    reasons = F.array_compact(F.array(
        F.when(F.col("n_positions") == 0, "Nenhuma tabela de cargos reconhecida no documento"),
        F.when(signal & ~F.col("work"), "Documento usa vocabulário de certame mas não oferece cargo público"),
        F.when(F.col("exam_only"), f"{city} aparece apenas como local de prova; lotação não confirmada"),
        F.when(F.col("publication_date").isNull(), "Data de publicação não localizada")))
    return out.withColumns({"material": signal & F.col("work"), "review_reasons": reasons}).drop("work")


def placeholders(documents: DataFrame, drafts: DataFrame, city: str) -> DataFrame:
    """(doc, name, education, qualification_category, vacancies, weekly, location, confirmed, synthetic): one
    position, read from the whole text, for each draft without a table of them."""
    lone = drafts.where("n_positions = 0").select("doc", "name", "assignment")
    both = documents.select("doc", F.substring(F.coalesce("text", F.lit("")), 1, 20_000).alias("text")).join(lone, "doc")
    wanted = let(F.col("text"), score.qualification)
    place: Column = F.when(F.col("assignment"), city)
    return both.select("doc", F.substring("name", 1, 200).alias("name"), wanted.alias("q"), parse.vacancies(F.col("text")).alias("vacancies"), parse.weekly_workload(F.col("text")).alias("weekly"),
                       place.alias("location"), F.col("assignment").alias("confirmed"), F.lit(True).alias("synthetic")).select(
        "doc", "name", F.col("q.education").alias("education"), F.col("q.category").alias("qualification_category"), "vacancies", "weekly", "location", "confirmed", "synthetic")
