"""What the tables of a document say together: schedule, fee and positions.

``tables`` is one row a table: doc, table (a number), page, rows (tidied cells). Rows are exploded and
ordered by windows within a document; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import cells, parse
from tidemark.functions.text import first_label, has_any, let, normalise, one_line

# ---------------------------------------------------------------- fixed values
SCHEDULE_HEADER = ("descricao", "atividade", "cronograma", "evento")
#: In this order: the first kind whose marker fits a row claims it.
SCHEDULE = (
    ("fee_exemption_deadline", ("isencao", "isento")),
    ("payment_deadline", ("pagamento da taxa", "geracao e pagamento", "pagamento do boleto")),
    ("registration", ("periodo de inscricoes", "periodo das inscricoes", "inscricoes", "prazo de inscricao")),
    ("exam_date", ("realizacao das provas", "aplicacao das provas", "realizacao da prova", "provas objetivas")),
    ("publication_date", ("publicacao do edital de abertura", "publicacao do edital")),
)
FEE_LEVEL = {"high_school": "medio", "higher_education": "superior", "primary": "fundamental"}
POSITIONS = 120


def _lines(tables: DataFrame, head: int, markers: tuple[str, ...]) -> DataFrame:
    """doc, table, page, n (from 1), row of the rows below the first, of tables whose first ``head`` rows hold
    a marker."""
    header = F.array_join(F.transform(F.flatten(F.slice("rows", 1, head)), lambda c: normalise(c)), " ")
    return tables.where(has_any(header, markers)).select("doc", "table", "page", F.posexplode("rows").alias("n", "row")).where("n > 0")


def _describing(row: Column) -> Column:
    """The cell with the most words of letters; empty if none has two."""
    words = lambda c: F.size(F.filter(F.split(normalise(c), " "), lambda w: (F.length(w) > 2) & ~w.rlike(r"^\d+$")))
    counted = F.transform(row, lambda c, i: F.struct(words(c).alias("w"), (-i).alias("i"), c.alias("c")))
    return let(F.array_max(counted), lambda b: F.when(b["w"] >= 2, b["c"]).otherwise(F.lit("")))


def _events(row: Column) -> Column:
    """What a row of a schedule says: an array of (field, due, raw), each part of it read once."""
    event = lambda field, due, raw: F.struct(field.alias("field"), due.alias("due"), raw.alias("raw"))

    def dated(said: Column) -> Column:
        beside = F.array_distinct(F.flatten(F.transform(F.filter(row, lambda c: c != said), parse.parse_dates)))
        return let(beside, lambda o: F.when(F.size(o) > 0, o).otherwise(parse.parse_dates(said)))

    def told(said: Column) -> Column:
        return let(F.struct(first_label(normalise(said), SCHEDULE).alias("kind"), dated(said).alias("d")), lambda x: (
            F.when(x["kind"].isNull() | (F.size(x["d"]) == 0), F.array().cast("array<struct<field:string,due:date,raw:string>>"))
            .when(x["kind"] == "registration", F.array(event(F.lit("registration_start"), F.array_min(x["d"]), said), event(F.lit("registration_deadline"), F.array_max(x["d"]), said)))
            .otherwise(F.array(event(x["kind"], F.array_max(x["d"]), said)))))

    return let(_describing(row), told)


def schedule(tables: DataFrame) -> DataFrame:
    """(doc, field, due, raw, page): dates of schedule tables. A registration row gives start and
    deadline, other rows their last date; the first row of a field counts."""
    due = _lines(tables, 1, SCHEDULE_HEADER).select("doc", "table", "page", "n", F.explode(_events(F.col("row"))).alias("d"))
    return due.groupBy("doc", F.col("d.field").alias("field")).agg(F.min_by(F.struct("d.due", "d.raw", "page"), F.struct("table", "n")).alias("v")).select(
        "doc", "field", "v.due", "v.raw", "v.page")


def fee(tables: DataFrame, education: str = "high_school") -> DataFrame:
    """(doc, fee, raw): the fee in the first row that names the level, else the least above 0."""
    rows = _lines(tables, 2, cells.FEE)
    line = F.array_join("row", " ")
    priced = rows.withColumn("line", line).select("*", F.explode(F.filter(F.array(parse.parse_money(F.col("line"))), lambda v: v > 0)).alias("value"))
    hit = normalise(F.col("line")).contains(FEE_LEVEL.get(education, "medio"))
    rank = F.struct((~hit).alias("other"), F.when(~hit, F.col("value")).alias("price"), F.col("table"), F.col("n"))
    return priced.groupBy("doc").agg(F.min_by(F.struct("value", F.substring(one_line(F.col("line")), 1, 200).alias("raw")), rank).alias("v")).select(
        "doc", F.col("v.value").alias("fee"), "v.raw")


def positions(tables: DataFrame, city: str) -> DataFrame:
    """(doc, table, n, cells of cells.classify_row): informative rows of position tables. The level that a
    section row announces holds for the rows below it; totals and section rows are no positions."""
    rows = tables.where(cells.is_position_table(F.col("rows"))).select("doc", "table", "page", F.posexplode("rows").alias("n", "row")).withColumn("own", cells.level_of(F.col("row")))
    w = Window.partitionBy("doc", "table").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    levelled = rows.withColumn("level", F.last("own", ignorenulls=True).over(w)).where("own is null").where(~cells.is_total(F.col("row")))
    # exploded, not filtered: a filter on a column is pushed below it, with the classification once for each field it names
    read = levelled.select("doc", "table", "page", "n", "row", F.explode(F.filter(F.array(cells.classify_row(F.col("row"), F.col("level"), city)), cells.informative)).alias("c"))
    return read.select("doc", "table", "page", "n", "c.*", F.array_join("row", " ").alias("raw"))


def merged_rows(rows: DataFrame, limit: int = POSITIONS) -> DataFrame:
    """One row for each name (in normal form) of a document: of every field the first known value, in
    order of table and row, and all raw lines; the first ``limit`` names."""
    fields = ("requirements", "location", "salary", "weekly", "daily", "vacancies", "reserve", "education")
    at = F.struct("table", "n")
    known = lambda c: F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), at)
    named = rows.withColumn("key", normalise(F.col("name"))).where("key <> ''")
    one = named.groupBy("doc", "key").agg(
        F.min(at).alias("at"), F.min_by("name", at).alias("name"), *[F.min_by(F.col(c), known(c)).alias(c) for c in fields],
        F.transform(F.array_sort(F.collect_list(F.struct("table", "n", "raw"))), lambda r: r["raw"]).alias("raw"))
    w = Window.partitionBy("doc").orderBy("at")
    return one.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).select("doc", "place", "name", *fields, "raw")
