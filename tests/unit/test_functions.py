"""Scalar functions against tables of (text, expected)."""

import unicodedata
import zlib
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.functions import cells, parse, present, score, text, urls, verify

LONG = "A jornada é de 20 horas semanais para todos os cargos deste edital, conforme o anexo."


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("raw, expected", [
    ("Inscrições até 13/10/2026", date(2026, 10, 13)), ("2026-09-11", date(2026, 9, 11)), ("05/03/26", date(2026, 3, 5)),
    ("13 de outubro de 2026", date(2026, 10, 13)), ("1 de março/2027", date(2027, 3, 1)), ("31/02/2026", None), ("12/12/1985", None),
    ("sem data", None), ("", None), (None, None), ("2026-13-40 e 01/02/2026", None), ("12 de xyz 2026, depois 3 jan 2026", date(2026, 1, 3)),
])
def test_parse_date(spark, raw, expected):
    assert one(spark, parse.parse_date(F.lit(raw))) == expected


def test_parse_dates_go_by_format_then_place(spark):
    got = one(spark, parse.parse_dates(F.lit("em 3 de maio de 2026, 01/02/2026, 2026-01-01 e 01/02/2026")))
    assert got == [date(2026, 1, 1), date(2026, 2, 1), date(2026, 5, 3)]


@pytest.mark.parametrize("raw, expected", [
    ("R$ 4.656,75", "4656.75"), ("R$ 1.500", "1500.00"), ("R$ 12.50", "12.50"), ("R$ 4656.75", "465675.00"), ("R$ 85,00 (oitenta)", "85.00"),
    ("R$ 12.345.678,90", None), ("85,00", None), ("R$", None), ("", None), (None, None),
])
def test_parse_money(spark, raw, expected):
    assert one(spark, parse.parse_money(F.lit(raw))) == (Decimal(expected) if expected else None)


def test_parse_money_english_option(spark):
    assert one(spark, parse.parse_money(F.lit("R$ 4656.75"), strict_english=True)) == Decimal("4656.75")


@pytest.mark.parametrize("raw, expected", [
    ("30 horas semanais", 30.0), ("40h semanais", 40.0), ("20 (vinte) horas semanais", 20.0), ("6 horas diárias, 5 dias por semana", 30.0),
    ("6 horas por dia", None), ("80 horas semanais", None), ("37,5 horas semanais", 37.5), ("", None), (None, None),
])
def test_weekly_workload(spark, raw, expected):
    assert one(spark, parse.weekly_workload(F.lit(raw))) == expected


def test_small_parsers(spark):
    assert one(spark, parse.daily_workload(F.lit("6 horas diárias"))) == 6.0
    assert one(spark, parse.vacancies(F.lit("3 (três) vagas"))) == 3
    assert one(spark, parse.vacancies(F.lit("9999 vagas"))) is None
    assert one(spark, parse.edital_number(F.lit("EDITAL Nº 1/2026"))) == "01/2026"
    assert one(spark, parse.edital_number(F.lit("edital de abertura n. 123-2026"))) == "123/2026"
    assert one(spark, parse.validity(F.lit("A validade do concurso será de dois (2) anos"))) == "2 ano(s)"
    assert one(spark, parse.education(F.lit("Ensino Médio ou Nível Superior"))) == "higher_education"
    assert one(spark, parse.employment_type(F.lit("Concurso público; contratação temporária"))) == "TEMPORARY"
    assert one(spark, parse.employment_regime(F.lit("regime celetista"))) == "CLT"
    assert one(spark, parse.benefits(F.lit("Vale transporte e plano de saúde"))) == "Auxílio-transporte; Auxílio-saúde"
    assert one(spark, parse.fee_exemption(F.lit("Poderá solicitar ISENÇÃO o doador de sangue"))) == "Doador de sangue"
    assert one(spark, parse.fee_exemption(F.lit("Da isenção da taxa de inscrição: ver edital"))) == parse.EXEMPTION_DEFAULT
    assert one(spark, parse.stages(F.lit("Prova Objetiva e avaliação de títulos"))) == ["Prova objetiva", "Prova de títulos"]
    assert one(spark, parse.http_date(F.lit("Mon, 14 Sep 2026 10:00:00 GMT"))) == date(2026, 9, 14)
    assert one(spark, parse.http_date(F.lit("nonsense"))) is None


@pytest.mark.parametrize("words, expected", [
    ("A lotação será em Rio Branco.", (True, False)), ("Provas serão aplicadas em Rio Branco. A lotação será em Cruzeiro do Sul.", (False, True)),
    ("Cidade: Rio Branco", (False, False)), ("Nada aqui", (False, False)), ("", (False, False)),
])
def test_location_context(spark, words, expected):
    got = one(spark, parse.location_context(F.lit(words), "Rio Branco"))
    assert (got.assignment, got.exam_only) == expected


@pytest.mark.parametrize("title, body, expected", [
    ("Edital de Abertura", "cronograma, convocação e resultado", "OPENING"), ("Retificação do edital de abertura", "", "RECTIFICATION"),
    ("Resultado final", "", "RESULT"), ("Aviso", "prorrogado o prazo", "EXTENSION"), ("Aviso", "nada", "UNKNOWN"),
])
def test_classify_document(spark, title, body, expected):
    assert one(spark, parse.classify_document(F.lit(title), F.lit(body))) == expected


def test_job_selection(spark):
    assert one(spark, parse.is_job_selection(F.lit("Concurso"), F.lit("vagas para o cargo")))
    assert not one(spark, parse.is_job_selection(F.lit("Pregão eletrônico"), F.lit("vagas para o cargo")))
    assert not one(spark, parse.is_job_selection(F.lit("Notícia"), F.lit("sem oferta")))


def test_institution_implies_city(spark):
    assert one(spark, parse.institution_implies_city(F.lit("Câmara Municipal de Rio Branco"), "Rio Branco"))
    assert not one(spark, parse.institution_implies_city(F.lit("Tribunal de Justiça do Acre"), "Rio Branco"))


def test_normalise_matches_the_unicode_database(spark):
    words = ["São José – Nº 1ª", "Straße ÆSIR œuvre", "ñandú ǅ ŉ", "égal", "", "ﬁm"]
    got = [r.n for r in spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").orderBy("i").select(text.normalise(F.col("w")).alias("n")).collect()]
    for w, g in list(zip(words, got))[:5]:
        bare = "".join(c for c in unicodedata.normalize("NFKD", w.casefold()) if not unicodedata.combining(c))
        assert g == " ".join("".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in bare).split())


def test_fold_keeps_offsets(spark):
    raw = "Da ISENÇÃO\n DA   TAXA de inscrição"
    assert len(one(spark, text.fold(F.lit(raw)))) == len(raw)
    assert one(spark, text.locate(text.fold(F.lit(raw)), ("isencao da taxa",))) == raw.index("ISENÇÃO") + 1


def test_lock_key(spark):
    for name in ("", "nightly run", "São José"):
        assert one(spark, text.lock_key(F.lit(name))) == zlib.crc32(name.encode()) & 0x7FFFFFFF


def test_redact(spark):
    assert one(spark, text.redact(F.lit("postgres://u:secret@h/db"))) == "postgres://u:[REDACTED]@h/db"
    assert one(spark, text.redact(F.lit("token 123456789:AAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAA fim"))) == "token [REDACTED] fim"
    assert one(spark, text.redact(F.lit("a hunter22 b"), ("hunter22",))) == "a [REDACTED] b"


@pytest.mark.parametrize("raw, expected", [
    ("HTTP://Ex.com/a/b/?b=2&utm_source=x&a=1#f", "http://ex.com/a/b?a=1&b=2"), ("https://ex.com", "https://ex.com/"),
    ("https://ex.com:8080/", "https://ex.com:8080/"), ("ftp://ex.com/a", ""), ("mailto:a@b", ""), ("", ""), (None, None),
])
def test_canonical_url(spark, raw, expected):
    assert one(spark, urls.canonical(F.lit(raw))) == expected


def test_hosts_and_media(spark):
    allowed = F.array(F.lit("ac.gov.br"))
    assert one(spark, urls.host_allowed(F.lit("https://www.ac.gov.br:443/x"), allowed))
    assert not one(spark, urls.host_allowed(F.lit("https://ac.gov.br.evil.com/"), allowed))
    assert not one(spark, urls.host_allowed(F.lit("nonsense"), allowed))
    assert one(spark, urls.media_type(F.lit("http://x/a.pdf"), F.lit("text/html"), F.lit(b""))) == "pdf"
    assert one(spark, urls.media_type(F.lit("http://x/a"), F.lit("text/html; x"), F.lit(b"%PDF-1"))) == "pdf"
    assert one(spark, urls.media_type(F.lit("http://x/a"), F.lit(None).cast("string"), F.lit(None).cast("binary"))) == "unknown"


def test_presentation(spark):
    assert one(spark, present.money(F.lit(4656.75))) == "R$ 4.656,75"
    assert one(spark, present.money(F.lit(None).cast("double"))) == "não informado"
    assert one(spark, present.period(F.lit(date(2026, 9, 1)), F.lit(date(2026, 10, 1)))) == "01/09/2026 a 01/10/2026"
    assert one(spark, present.utc_cron("07:17", "America/Rio_Branco")) == "17 12 * * *"
    assert one(spark, text.utf16_units(F.lit("a😀"))) == 3
    cut = one(spark, present.truncate(F.lit("x" * 5000)))
    assert len(cut) <= 4096 and cut.endswith("[mensagem truncada]")


@pytest.mark.parametrize("start, deadline, exam, stored, expected", [
    (date(2026, 9, 1), date(2026, 10, 1), None, "EDITAL_PUBLISHED", "REGISTRATION_OPEN"),
    (date(2026, 8, 1), date(2026, 9, 1), date(2026, 11, 1), "EDITAL_PUBLISHED", "EXAM_SCHEDULED"),
    (date(2026, 8, 1), date(2026, 9, 1), None, "EDITAL_PUBLISHED", "REGISTRATION_CLOSED"),
    (None, None, None, "AUTHORIZED", "AUTHORIZED"), (date(2026, 9, 1), date(2026, 10, 1), None, "SUSPENDED", "SUSPENDED"),
])
def test_effective_status(spark, start, deadline, exam, stored, expected):
    d = lambda v: F.lit(v).cast("date")
    assert one(spark, score.effective_status(F.lit(stored), d(start), d(deadline), d(exam), date(2026, 9, 14))) == expected


def test_qualification(spark):
    got = one(spark, score.qualification(F.lit("Ensino médio, curso técnico e CNH B")))
    assert (got.category, got.education, len(got.extras)) == ("HIGH SCHOOL + DRIVER/LICENSE REQUIREMENT", "high_school", 2)
    assert one(spark, score.qualification(F.lit("")))["category"] == "UNKNOWN"
    assert one(spark, score.qualification(F.lit("Ensino médio, diploma devidamente registrado")))["category"] == "HIGH SCHOOL ONLY"


def test_classify_row(spark):
    row = F.array(*[F.lit(c) for c in ("Agente Legislativo", "1", "0", "2", "R$ 4.656,75", "30 horas semanais", "Rio Branco")])
    got = one(spark, cells.classify_row(row, F.lit("high_school"), "Rio Branco"))
    assert (got.name, got.salary, got.weekly, got.vacancies, got.reserve, got.location, got.education) == (
        "Agente Legislativo", Decimal("4656.75"), 30.0, 1, 2, "Rio Branco", "high_school")


def test_verify(spark):
    check = lambda value, quote: one(spark, verify.verify("weekly_workload", F.lit(value), F.lit(quote), F.lit(LONG)))
    assert check("20", "jornada é de 20 horas semanais para todos").status == "CONFIRMED"
    assert check("30", "jornada é de 20 horas semanais para todos").status == "PARSER_DISAGREES"
    assert check("20", "20 horas").status == "QUOTE_NOT_FOUND"
    assert one(spark, verify.verify("name", F.lit("x"), F.lit("x"), F.lit(LONG))).status == "REJECTED"


def test_focus_excerpt(spark):
    doc = "x" * 5000 + "Agente" + "y" * 5000
    got = one(spark, verify.focus_excerpt(F.lit(doc), text.fold(F.lit(doc)), F.array(F.lit("agente"))))
    assert got == doc[4400: 5000 + 2400]
    assert one(spark, verify.focus_excerpt(F.lit(doc), text.fold(F.lit(doc)), F.array(F.lit("fiscal")), 10)) == doc[:10]


def _loop(value):
    """The form and its origins character by character."""
    import unicodedata

    out = []
    for i, c in enumerate(value):
        for piece in unicodedata.normalize("NFKD", c.casefold()):
            if not unicodedata.combining(piece):
                out.append((piece if "a" <= piece <= "z" or piece.isdigit() else " ", i))
    kept = [p for n, p in enumerate(out) if p[0] != " " or n and out[n - 1][0] != " "]
    while kept and kept[-1][0] == " ":
        kept.pop()
    return "".join(p[0] for p in kept), [p[1] for p in kept]


def test_origins_of_every_character(spark):
    import unicodedata

    from tidemark.functions import origins

    sample = ["", "  ", None, "Straße nº 5 — ﬁm", unicodedata.normalize("NFD", "Inscrições até às 18h: açaí"), "İstanbul ǆ ﷺ x", "\u0301a", "a\u0301\u0327 b", "１２٣ ½ ² 漢字 😀z", "x" * 3000 + "ß" * 10 + " é"]
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts = sample + docs
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", origins.form(F.col("text")).alias("f")).collect()
    for r in rows:
        if texts[r.i] is None:
            assert r.f is None or r.f.text is None
            continue
        form, back = _loop(texts[r.i])
        ends = [*r.f.places[1:], len(form)]
        assert r.f.text == form and [o + k for p, o, e in zip(r.f.places, r.f.origins, ends) for k in range(e - p)] == back
    f, t = F.col("f"), F.lit(sample[4])
    got = spark.range(1).select(origins.form(t).alias("f")).select(origins.window(t, f, ("até",), 8).alias("w"), origins.located(f, ("zzz", "inscrições")).alias("p"), origins.window(t, f, ("zzz",), 8).alias("none")).first()
    assert got.w == sample[4][sample[4].index("ate"):][:8] and tuple(got.p) == (0, 0) and got.none == ""
