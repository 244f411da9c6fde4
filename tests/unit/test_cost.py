"""What long work on each row may cost: parsers run once, forms are made once, rows are dealt to all cores."""

import pandas as pd
from pyspark.sql import functions as F

from tidemark.functions import parse, text, verify
from tidemark.plans import catalogue
from tidemark.sources import pages

SMALL = "/root/testdata/sf0.001"


def times(rows, part):
    """How often the plan of ``rows`` runs a part of its expressions."""
    rows = rows.toDF(*[f"c{i}" for i in range(len(rows.columns))])  # names of columns may repeat their expressions
    return rows._jdf.queryExecution().optimizedPlan().toString().count(part)


def said(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "text string").repartition(1)


def test_f14_classes_makes_the_normal_form_once_on_all_cores(spark):
    rows = catalogue.queries()["f14_classes"](spark, SMALL)
    assert times(rows, "translate(") == 2  # the fold of each notice, and the number in it
    assert rows.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_f16_clauses_without_the_name_cost_nothing(spark):
    long = "uma frase sem fim " * 20
    rows = said(spark, f"{long}. Lotação em Rio\xa0Branco; {long}", long, f"{long * 2} lotação: rio branco {long * 2}", None)
    where = parse.location_context(F.col("text"), "Rio Branco")
    got = rows.select(where["assignment"], where["exam_only"], where["snippet"]).collect()
    whole = parse.F.regexp_extract_all(text.fold(F.coalesce("text", F.lit(""))), F.lit(f"{parse.CLAUSE}{{0,400}}rio[^a-z0-9.;:\\n\\r•●]+branco{parse.CLAUSE}{{0,400}}"), F.lit(0))
    snippets = [r[0] for r in rows.select(F.coalesce(F.get(F.transform(whole, text.normalise), F.lit(0)), F.lit(""))).collect()]
    assert [r[2] for r in got] == snippets and [r[0] for r in got] == [True, False, False, False]
    assert times(rows.select(where), "split(") == 1


def test_f16_places_are_judged_once_and_only_naming_clauses_are_folded(spark):
    rows = catalogue.queries()["f16_location_context"](spark, SMALL)
    assert times(rows, "split(") == 1
    words = ["RÍO Brânco¹", "bránço1", "ƀranco1", "x-Branco1x", "BŘǍŃČǑ¹", "branc o1", "brancö①"]
    got = said(spark, *words).select(F.col("text").rlike(text.unfolded_pattern("branco1")), text.fold(F.col("text")).contains("branco1")).collect()
    assert all(may or not does for may, does in got) and [r[0] for r in got] == [True, True, True, True, True, False, False]
    assert not set(parse.EDGE) & (set(text._ONE.values()) - {"n", "r"}) and not set(".;:\n\r•●") & set(text._ONE)


def test_f36_parsers_run_once(spark):
    rows = said(spark, "x")
    for parser, pattern in ((parse.weekly_workload, parse.WEEKLY), (parse.daily_workload, parse.DAILY), (parse.parse_money, parse.MONEY)):
        assert times(rows.select(parser(F.col("text"))), pattern) == 1, parser
    assert times(rows.select(verify.verify("weekly_workload", F.lit("1"), F.col("text"), F.col("text"))), parse.WEEKLY) == 1
    # the whole notice number is looked for once, its parts in what was found
    assert times(rows.select(parse.edital_number(F.col("text"))), "coalesce(text") == 1


def test_f36_markers_are_searched_once_and_found_as_before(spark):
    """a marker that holds another one needs no search; those that begin alike share one for their beginning."""
    rows = said(spark, "Dispensa de licitação", "termo de fomento: cargo", "termo de posse, cargos", "x" * 1600 + " vaga", "y" * 1600, "", None)
    work = rows.select(parse.is_job_selection(F.lit("Aviso"), F.col("text")), parse.is_job_selection(F.lit("leilão"), F.col("text")))
    assert [tuple(r) for r in work.collect()] == [(False, False), (False, False), (True, False), (True, False), (False, False), (False, False), (False, False)]
    assert times(work, "dispensa de licitacao") == 0 and times(work, "termo de )") + times(work, "termo de)") > 0
    n = spark.createDataFrame([(m,) for m in parse.NOT_A_JOB] + [("termo de posse",), ("concurso",)], "n string")
    assert [r[0] for r in n.select(text.has_any(F.col("n"), parse.NOT_A_JOB)).collect()] == [True] * len(parse.NOT_A_JOB) + [False, False]


def test_dates_begin_at_edges_as_before(spark):
    """patterns that look for a digit first find what those that looked for an edge first found."""
    import random

    r = random.Random(3)
    parts = ["1", "02", "123", "2026", "/", "-", ".", " ", "de ", "maio", "MARÇO ", "jun.", "ſet", "x", "_", "º", "\n", "2026-01-02", "3/4/26", "5 de agosto de 2026"]
    rows = said(spark, *["".join(r.choice(parts) for _ in range(r.randrange(1, 25))) for _ in range(3000)])
    edge = {parse.ISO_DATE: r"\b\d{4}-\d{2}-\d{2}\b", parse.NUMERIC_DATE: r"\b\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}\b", parse.TEXT_DATE: rf"(?iu)\b\d{{1,2}}\s*(?:de\s+)?{parse._MONTH}\.?\s*(?:/|de\s)?\s*\d{{4}}\b"}
    assert not any(p.startswith((r"\b", r"(?iu)\b")) for p in edge)
    every = lambda p: F.regexp_extract_all("text", F.lit(p), F.lit(0))
    for new, old in edge.items():
        got = rows.agg(F.count_if(F.size(every(new)) > 0), F.count_if(~every(new).eqNullSafe(every(old)))).first()
        assert got[0] > 50 and got[1] == 0, new


def test_f10_a_figure_before_blanks_without_a_week_takes_no_time(spark):
    """what lies between figure and week is divided only where a week follows."""
    import time

    rows = said(spark, "1" + " " * 1500, "40 (quarenta) horas/semana", "8h sem x", "20 horas por semana", "1 oraſ h ſem")
    began = time.perf_counter()
    assert [r[0] for r in rows.select(parse.weekly_workload(F.col("text"))).collect()] == [None, 40.0, 8.0, 20.0, 1.0]
    assert time.perf_counter() - began < 10


def test_f23_f28_texts_are_folded_once(spark):
    """parsers of one text share its fold. The other folds are of titles."""
    assert times(catalogue.queries()["f23_classify_document"](spark, SMALL), "translate(") == 4
    assert times(catalogue.queries()["f28_stages_schedule"](spark, SMALL), "translate(") == 1
    rows = said(spark, "x" * 1300 + " retificação", "x" * 1100 + " retificação", "resultado", "Edital de abertura e resultado", None)
    both = rows.select(parse.classify_document(F.lit("Aviso"), F.col("text")), parse.classify_document(F.lit("Aviso"), F.col("text"), parse.folded(F.col("text"))))
    assert [tuple(r) for r in both.collect()] == [(k, k) for k in ("RECTIFICATION", "RECTIFICATION", "RESULT", "OPENING", "UNKNOWN")]


def test_f44_a_quote_as_the_document_has_it_needs_no_normal_form(spark):
    """and others are judged by normal forms as before."""
    quote = "Jornada de 40 horas por semana"
    rows = spark.createDataFrame([(f"A. {quote}!", quote), (f"({quote.upper()})", quote), ("nada", quote), (quote, "Jornada"), (None, quote), (quote, None), ("–" * 40, "–" * 30)], "document string, quote string")
    got = rows.select(verify.quote_is_real(F.col("document"), F.col("quote")).alias("real"))
    assert [r[0] for r in got.collect()] == [True, True, False, False, False, False, False]
    assert times(got, "ontains(") == 2


def test_normal_form_beyond_ascii(spark):
    words = ["Straße ¼ Ǆ", "ÀÉÎõÜ", "áb", "Kelvin", "Ελλάδα x", "ŉ", "•●–x", "", None]
    plain = lambda t: None if t is None else text.plain(t)
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "t string").select(text.normalise(F.col("t"))).collect()]
    assert got == [plain(w) for w in words]


def test_f35_rows_are_classified_once(spark):
    rows = catalogue.queries()["f35_position_tables"](spark, SMALL)
    assert times(rows, "aggregate(") == 1


def test_f49_and_tables_are_dealt_to_all_cores(spark):
    for name in ("f31_schedule_tables", "f35_position_tables", "f49_fill_gaps", "f28_stages_schedule", "f34_classify_row"):
        assert "REPARTITION_BY_NUM" in catalogue.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString(), name


def test_s08_parsed_pages_leave_in_parts():
    sizes = [len(x) for x in pages._parsed(iter([pd.Series([f"<a href='/{i}'>x</a>" for i in range(2 * pages.PART + 1)]), pd.Series([], dtype=str), pd.Series([None])]))]
    assert sizes == [pages.PART, pages.PART, 1, 1]


def test_f34_cells_that_are_no_names(spark):
    from tidemark.functions import cells

    said = [" 12 ", " – ", "Agente", "ag", "a.b.c. Agente", "a.b.c.d Agente", "Cargo de nível médio", "x" * 141, "abc " * 15, "abc " * 16, "Agente; outro", "Total geral"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in said], "c string").select(cells.looks_like_name(F.col("c"))).collect()]
    assert got == [False, False, True, False, False, False, False, False, True, False, False, False]


def test_searches_of_few_words_are_one_pass(spark, monkeypatch):
    """no posting lists, no join of what is found with the pairs, and no request's rows sorted beyond its page."""
    from tidemark.operators import index, serve

    def never(*_, **__):
        raise AssertionError("an index of a batch of few words")

    rows = [(f"{i:08x}-p", f"Agente {'Fiscal' if i % 3 == 0 else 'Escolar'} {i}", "Órgão", None, i % 2 == 0, i % 7, None, True) for i in range(60)] + [("0000001a-p", "Agente Escolar 26", "Órgão", None, True, 5, None, True)]
    pairs = spark.createDataFrame(rows, "position string, cargo string, institution string, name string, eligible boolean, score int, deadline date, accepting boolean")
    asked = spark.createDataFrame([(1, "fisc orgao --pagina 2"), (2, "0000001a"), (3, "agente 00000003"), (4, "zebra"), (5, None), (6, "fiscal --pagina 0")], "request int, argument string")
    kept = sorted(map(tuple, serve.search(asked, pairs, serve.indexed(serve.haystack(pairs))).collect()))
    monkeypatch.setattr(index, "build", never)
    found = serve.search(asked, pairs)
    got = sorted(map(tuple, found.collect()))
    assert got == kept and {r[0]: r[2] for r in got} == {1: 20, 2: 2} and [r[1] for r in got if r[0] == 1] == [6, 7, 8, 9, 10]
    assert "WindowGroupLimit" in found._jdf.queryExecution().optimizedPlan().toString()
    told = spark.createDataFrame([(1, "Qual o salário do agente fiscal?"), (2, "Qual a taxa de zebra?")], "request int, text string")
    assert {r.request: (r.answer, len(r.positions)) for r in serve.answered(told, pairs).collect()} == {1: ("choices", 5), 2: ("none", 0)}


def test_k01_states_without_all_attempts_of_a_source(spark):
    """the state of a source equals its timeline's last, and no window goes over all of its attempts."""
    import random
    from datetime import datetime, timedelta

    from tidemark.operators import health

    r, rows = random.Random(5), [("none", 1, datetime(2026, 1, 1), False, None, 0, None)]
    for s in range(150):
        sure = r.random()
        for n in range(r.choice((1, 2, 3, 4, 30, 60))):
            rows.append((f"s{s}", n, datetime(2026, 1, 1) + timedelta(hours=r.randrange(40)), r.random() < sure, r.choice((0, 1, 3, 40, 50, None)), r.randrange(2), r.choice((200, 503, None))))
    df = spark.createDataFrame(rows, "source_id string, seq long, at timestamp, success boolean, found int, expected_min int, status int")
    want = {x.source_id: x.state for x in health.latest(health.timeline(df)).collect()}
    got = health.current(df)
    assert {x.source_id: x.state for x in got.collect()} == want and set(want.values()) == {"HEALTHY", "DEGRADED", "OPEN"}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("WindowGroupLimit") == plan.count("Window [") == 2


def test_v_lookup_by_name_meets_offers_as_one_row(spark):
    """F16: nothing but the offers is grouped, and a task's rows do not grow with the table."""
    from tidemark.operators import resolve
    from tidemark.plans import views

    wanted = spark.createDataFrame([("a", "Agente"), ("a", "Agente"), ("a", "Fiscal"), ("b", "Agente"), (None, "Agente"), ("a", None)], "doc string, name string")
    offered = spark.createDataFrame([("a", "Agente Fiscal", 0), ("a", "AGENTE", 1), ("a", "!", 2), ("a", None, 3), ("c", "Agente", 0)], "doc string, other string, place int")
    got = resolve.by_name(wanted, offered)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [("a", "Agente", "AGENTE")] * 2 + [("a", "Fiscal", "Agente Fiscal"), ("b", "Agente", None), (None, "Agente", None), ("a", None, None)]))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
    assert views.spread(spark.range(1000), "id", 10).rdd.getNumPartitions() == 100
