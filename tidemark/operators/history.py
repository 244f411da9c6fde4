"""Version numbering, snapshots and field-level change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import present
from tidemark.operators.merge import same

#: Label, and whether a change is worth an alert.
TRACKED = {
    "registration_start": ("Início das inscrições", True), "registration_deadline": ("Prazo de inscrição", True),
    "exam_date": ("Data da prova", True), "status": ("Situação do certame", True), "application_fee": ("Taxa de inscrição", True),
    "fee_exemption_deadline": ("Prazo de isenção", True), "payment_deadline": ("Prazo de pagamento", True),
    "employment_type": ("Tipo de vínculo", True), "organizing_board": ("Banca organizadora", False),
    "validity": ("Validade do concurso", False), "selection_stages": ("Etapas da seleção", False), "exam_location": ("Local de prova", False),
    "official_edital_url": ("Edital oficial", False), "name": ("Nome do certame", False), "edital_number": ("Número do edital", False),
    "publication_date": ("Data de publicação", False),
}
POSITION_TRACKED = {
    "salary": ("Remuneração", True), "vacancies": ("Vagas", True), "weekly_workload": ("Carga horária semanal", True),
    "education": ("Escolaridade exigida", True), "qualification_category": ("Categoria de requisito", True),
    "assignment_location": ("Lotação", True), "assignment_confirmed": ("Lotação confirmada", True), "requirements": ("Requisitos", False),
    "reserve_count": ("Cadastro de reserva", False), "daily_workload": ("Carga horária diária", False), "benefits": ("Benefícios", False),
}
CODES = {"status": present.STATUS, "employment_type": present.EMPLOYMENT, "education": present.EDUCATION, "qualification_category": present.QUALIFICATION}
MONEY = ("salary", "application_fee", "benefits_value")
TIMES = r"^(\d{4})-(\d{2})-(\d{2})(?:T.*)?$"


def shown(field: Column, value: Column) -> Column:
    """A stored value as people read it: codes named, dates day first, numbers with a comma."""
    out = F.regexp_replace(value, TIMES, "$3/$2/$1")
    number = value.try_cast("decimal(20,2)")
    out = F.when(number.isNotNull() & field.isin(*MONEY), present.money(number)).when(number.isNotNull(), present.short_number(number)).otherwise(out)
    for name, table in CODES.items():
        out = F.when(field == name, present.label(value, table)).otherwise(out)
    out = F.when(F.lower(value) == "true", "sim").when(F.lower(value) == "false", "não").otherwise(out)
    return F.when(value.isNull() | (value == ""), present.UNSAID).otherwise(out)


def _about(field: Column, scope: Column) -> tuple[Column, Column]:
    def table(rows, i):
        return F.create_map(*[F.lit(x) for k, v in rows.items() for x in (k, v[i])])

    pick = lambda i: F.when(scope == "position", F.try_element_at(table(POSITION_TRACKED, i), field)).otherwise(F.try_element_at(table(TRACKED, i), field))
    return pick(0), pick(1)


def versions(documents: DataFrame, key: str = "url", order: tuple[str, ...] = ("fetched_at", "content_hash")) -> DataFrame:
    """Numbered distinct contents of each document: a repeated (key, hash) is no new version."""
    first = documents.withColumn("_n", F.row_number().over(Window.partitionBy(key, "content_hash").orderBy(*order))).where("_n = 1").drop("_n")
    w = Window.partitionBy(key).orderBy(*order)
    return first.withColumn("version", F.row_number().over(w)).withColumn("latest", F.lead("content_hash").over(w).isNull())


def changes(snapshots: DataFrame) -> DataFrame:
    """Changes between consecutive versions of long snapshots (scope, entity, version, field, value)."""
    w = Window.partitionBy("scope", "entity", "field").orderBy("version")
    label, worth = _about(F.col("field"), F.col("scope"))
    paired = snapshots.withColumn("old", F.lag("value").over(w)).withColumn("n", F.row_number().over(w)).where("n > 1")
    lost = (F.coalesce("value", F.lit("")) == "") & (F.coalesce("old", F.lit("")) != "")
    equal = F.coalesce(same(F.col("old"), F.col("value"), F.col("field")), F.col("old").isNull() & F.col("value").isNull())
    return paired.where(~equal).select(
        "scope", "entity", "version", "field", label.alias("label"), F.col("old").alias("raw_old"), F.col("value").alias("raw_new"),
        shown(F.col("field"), F.col("old")).alias("old_value"), shown(F.col("field"), F.col("value")).alias("new_value"),
        lost.alias("information_lost"), (F.coalesce(worth, F.lit(False)) & ~lost).alias("alertable"))


def position_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Added and removed positions of two snapshots (entity, slug, name): an addition is alertable, a
    removal is lost information."""
    b, a = before.select("entity", "slug", F.col("name").alias("old_name")), after.select("entity", "slug", F.col("name").alias("new_name"))
    return b.join(a, ["entity", "slug"], "full_outer").where("old_name is null or new_name is null").select(
        "entity", "slug", F.when(F.col("old_name").isNull(), "Novo cargo").otherwise("Cargo ausente nesta versão").alias("label"),
        F.coalesce("old_name", F.lit("não existia")).alias("old_value"), F.coalesce("new_name", F.lit("não consta")).alias("new_value"),
        F.col("old_name").isNull().alias("alertable"), F.col("new_name").isNull().alias("information_lost"))


def rendered(rows: DataFrame) -> DataFrame:
    """The text of all changes of an entity's version, by label."""
    block = F.concat(F.upper("label"), F.lit("\n\nAntes:\n"), F.col("old_value"), F.lit("\n\nAgora:\n"), F.col("new_value"), F.lit("\n"))
    return rows.groupBy("scope", "entity", "version").agg(
        present.stripped(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("field", block.alias("t")))), lambda s: s["t"]), "\n")).alias("text"))


def deadlines(opportunities: DataFrame) -> DataFrame:
    """(opportunity, kind, due): the four kinds unpivoted; a null date is not active."""
    return opportunities.select("id", F.expr(
        "stack(4, 'registration', deadline, 'exam', exam, 'fee_exemption', exemption, 'payment', payment) as (kind, due)")).where("due is not null")
