"""Tables lifted from documents: tidying, and what a row's cells say."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import parse
from tidemark.functions.text import has_any, let, normalise, one_line, plain

# ---------------------------------------------------------------- fixed values
INTEGER, DASH = r"^\s*0*(\d{1,4})\s*$", r"^\s*[-–—]?\s*$"
LEVEL_ROW, TOTAL_ROW = r"cargos? de nivel (medio|superior|fundamental)", r"^(totais?|total geral|subtotal)\b"
NOT_NAMES = ("cargo", "especialidade", "requisito", "remuneracao", "carga", "horaria", "atribuicoes", "vagas", "cadastro de reserva",
             "ampla concorrencia", "reservadas", "escolaridade", "nivel", "total", "lotacao", "municipio", "codigo", "quantidade", "salario", "anexo")
REQUIRES = ("diploma", "certificado", "conclusao de curso", "ensino", "nivel", "registro no", "habilitacao", "curso tecnico", "experiencia")
CARGO_HEADER = ("cargo", "especialidade", "funcao", "emprego")
JOB_HEADER = ("vaga", "requisito", "remuneracao", "carga hor", "escolaridade", "lotacao", "vencimento", "salario", "cadastro de reserva",
              "nivel de escolaridade", "atribuicoes", "jornada")
FEE = ("taxa de inscricao", "valor da inscricao", "valor da taxa")
LEVELS = {"medio": "high_school", "superior": "higher_education", "fundamental": "primary"}


def tidy_rows(rows: Column) -> Column:
    """Cells collapsed, rows padded to one width, empty columns and rows dropped."""
    clean = F.transform(rows, lambda r: F.transform(r, lambda c: one_line(F.coalesce(c, F.lit("")))))
    width = F.array_max(F.transform(clean, F.size))
    padded = F.transform(clean, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
    keep = F.filter(F.sequence(F.lit(0), F.greatest(width - 1, F.lit(0))), lambda i: F.exists(padded, lambda r: F.coalesce(F.get(r, i), F.lit("")) != ""))
    out = F.transform(padded, lambda r: F.transform(keep, lambda i: F.get(r, i)))
    return F.filter(out, lambda r: F.exists(r, lambda c: c != ""))


def looks_like_name(cell: Column) -> Column:
    return let(normalise(cell), lambda p: _named(cell, p))


def _named(cell: Column, p: Column) -> Column:
    """Whether a cell, with its normal form, reads like a name; what has no three letters in a row is no number or dash to look for."""
    many = lambda c, part, n: F.length(c) - F.length(F.replace(c, F.lit(part), F.lit(""))) > n
    return ((F.length(p) >= 4) & (F.length(p) <= 140) & cell.rlike("[a-zA-Z]{3}") & ~p.rlike("^(" + "|".join(NOT_NAMES) + ")") & ~p.rlike(TOTAL_ROW)
            & ~(p.contains("de nivel") & p.rlike(LEVEL_ROW)) & ~many(p, " ", 14) & ~cell.contains(";") & ~many(cell, ".", 2))


def level_of(cells: Column) -> Column:
    """The education level that a section row announces, else null."""
    hits = F.filter(F.transform(cells, lambda c: F.regexp_extract(normalise(c), LEVEL_ROW, 1)), lambda x: x != "")
    return F.try_element_at(F.create_map(*[F.lit(x) for p in LEVELS.items() for x in p]), F.get(hits, F.lit(0)))


def is_total(cells: Column) -> Column:
    return normalise(F.coalesce(F.get(cells, F.lit(0)), F.lit(""))).rlike(TOTAL_ROW)


def is_position_table(rows: Column) -> Column:
    head = F.array_join(F.transform(F.flatten(F.slice(rows, 1, 3)), normalise), " | ")
    return has_any(head, CARGO_HEADER) & has_any(head, JOB_HEADER)


def classify_row(cells: Column, level: Column, city: str) -> Column:
    """name, requirements, education, salary, weekly, daily, vacancies, reserve, location of a row,
    each cell claimed by the first kind it fits that is still open."""
    none = lambda t: F.lit(None).cast(t)
    zero = F.struct(
        F.lit("").alias("name"), F.lit("").alias("req"), none("decimal(12,2)").alias("pay"), none("double").alias("week"),
        none("double").alias("day"), F.lit("").alias("place"), F.array().cast("array<int>").alias("ints"))

    def facts(c: Column) -> Column:
        """All that a cell could be, each parser run once."""
        return let(normalise(c), lambda p: F.struct(
            c.alias("c"), F.nullif(F.regexp_extract(c, INTEGER, 1), F.lit("")).try_cast("int").alias("n"),
            F.when(F.lower(F.replace(c, F.lit(" "), F.lit(""))).contains("r$"), parse.parse_money(c)).alias("pay"),
            F.when(p.contains("hora") | (p.contains("h") & p.rlike(r"\d+\s*h\b")), F.struct(parse.weekly_workload(c).alias("week"), parse.daily_workload(c).alias("day"))).alias("h"),
            ((F.length(c) > 40) & has_any(p, REQUIRES)).alias("req"),
            ((p.contains(plain(city)) & (F.length(p) <= 90)) if plain(city) else F.lit(False)).alias("place"), _named(c, p).alias("name")))

    def step(a: Column, f: Column) -> Column:
        """Flags that others need are made once, by stages."""
        number = f["n"].isNotNull()
        paid = ~number & a["pay"].isNull() & f["pay"].isNotNull()

        def claimed(open_: Column, paid: Column) -> Column:
            hours = open_ & a["week"].isNull() & f["h"].isNotNull()
            return let(F.struct(hours.alias("hours"), (open_ & ~(hours & f["h"]["week"].isNotNull())).alias("left")), lambda k: let(
                F.struct((k["left"] & f["req"]).alias("req"), (k["left"] & ~f["req"] & f["place"]).alias("place")), lambda r: F.struct(
                    F.when(k["left"] & ~r["req"] & ~r["place"] & (a["name"] == "") & f["name"], f["c"]).otherwise(a["name"]).alias("name"),
                    F.when(r["req"], F.trim(F.concat_ws(" ", a["req"], f["c"]))).otherwise(a["req"]).alias("req"),
                    F.coalesce(a["pay"], F.when(paid, f["pay"])).alias("pay"), F.coalesce(a["week"], F.when(k["hours"], f["h"]["week"])).alias("week"),
                    F.coalesce(a["day"], F.when(k["hours"], f["h"]["day"])).alias("day"), F.when(r["place"], f["c"]).otherwise(a["place"]).alias("place"), a["ints"].alias("ints"))))

        counted = F.struct(*[a[x].alias(x) for x in ("name", "req", "pay", "week", "day", "place")], F.concat(a["ints"], F.array(f["n"])).alias("ints"))
        return F.when(number, counted).otherwise(let(paid, lambda x: claimed(~x, x)))

    return let(F.aggregate(F.transform(F.filter(cells, lambda c: c != ""), facts), zero, step), lambda a: _row(a, level))


def _row(a: Column, level: Column) -> Column:
    usable = F.filter(a["ints"], lambda i: i <= 5000)
    return F.struct(
        a["name"].alias("name"), a["req"].alias("requirements"), F.coalesce(F.when(a["req"] != "", parse.education(a["req"])), level).alias("education"),
        a["pay"].alias("salary"), a["week"].alias("weekly"), a["day"].alias("daily"), F.get(usable, F.lit(0)).alias("vacancies"),
        F.when(F.size(usable) > 2, F.try_element_at(usable, F.lit(-1))).alias("reserve"), a["place"].alias("location"))


def informative(row: Column) -> Column:
    return (row["name"] != "") & ((row["requirements"] != "") | F.coalesce(row["salary"] > 0, F.lit(False)) | F.coalesce(row["weekly"] > 0, F.lit(False)) | row["vacancies"].isNotNull())
