"""The full report: what each section takes, what an empty one says, and the order in which it is written."""

from datetime import date, datetime

from tidemark.operators import report

TODAY, NOW, ZONE = date(2026, 3, 10), datetime(2026, 3, 10, 15), "America/Rio_Branco"
PAIR = ("id long, position string, cargo string, institution string, weekly int, salary int, assignment_confirmed boolean, score int, rank string, confidence string, start date, deadline date, "
        "exam date, employment_type string, state string, workload string, url string, eligible boolean, first_seen timestamp")


def _pair(i, **changes):
    base = dict(id=i, position=f"p{i}", cargo=f"Cargo {i}", institution="Inst", weekly=20, salary=1000, assignment_confirmed=True, score=50, rank="REVIEW", confidence="HIGH", start=None, deadline=None,
                exam=None, employment_type="PERMANENT", state="EDITAL_PUBLISHED", workload="PERFECT", url=None, eligible=True, first_seen=datetime(2026, 1, 1))
    return tuple((base | changes).values())


def _lines(spark, pairs=(), deadlines=(), opportunities=(), documents=(), sources=(), states=(), runs=(), outbox=(), errors=()):
    df = spark.createDataFrame
    o = df(list(opportunities), "id long, name string, institution string, eligible boolean")
    parts = [report.about_pairs(df(list(pairs), PAIR), TODAY, NOW, "Rio Branco"), report.about_deadlines(df(list(deadlines), "id long, kind string, due date"), o, TODAY),
             report.about_documents(df(list(documents), "url string, title string, document_type string, processing_state string, review_reason string, last_seen timestamp"), NOW),
             report.about_sources(df(list(sources), "id string, priority int, limitations string"), df(list(states), "source_id string, state string, last_success timestamp, documents int, parsed long, tried long, last_error string"), ZONE),
             report.about_system(df(list(runs), "started_at timestamp, status string, successful long, attempted long, documents long, created long, errors long"), df(list(outbox), "status string"), o,
                                 df(list(errors), "created_at timestamp, seq long, stage string, kind string, source_id string, message string"), NOW, ZONE)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.union(p)
    return report.assembled(whole)


def test_sections(spark):
    pairs = [_pair(1, first_seen=datetime(2026, 3, 10), state="CANCELLED"), _pair(2, start=date(2026, 3, 10), deadline=date(2026, 3, 10), score=60), _pair(3, rank="EXCELLENT", state="EXPIRED", exam=date(2026, 4, 1)),
             _pair(4, rank="VERY GOOD", workload="UNKNOWN", weekly=None, exam=date(2026, 3, 10), url=""), _pair(5, eligible=False, rank="EXCELLENT"), _pair(6, rank="EXCELLENT", employment_type="ODD", assignment_confirmed=False)]
    docs = [(f"u{i:02d}", "t" * 200 if i % 2 else None, "EXTENSION", "REVIEW" if i == 7 else "DONE", None, datetime(2026, 3, 1 + i % 9)) for i in range(40)] + [("old", None, "EXTENSION", "DONE", None, datetime(2026, 2, 1)), ("edital", "x", "NOTICE", "REVIEW", "r" * 130, datetime(2020, 1, 1))]
    rows = _lines(spark, pairs, [(1, "exam", date(2026, 4, 9)), (1, "payment", date(2026, 4, 10)), (2, "exam", TODAY)], [(1, "N", "I", True), (2, "M", "J", False)], docs,
                  [("a", 2, "lim"), ("b", 1, "lim"), ("c", 3, "without health")], [("a", "OPEN", None, None, 1, 8, ""), ("b", "HEALTHY", datetime(2026, 3, 10, 3), 5, 3, 3, "e" * 80)],
                  [(datetime(2026, 3, 9, 12), "PARTIAL", 1, 2, 3, 4, 5), (datetime(2026, 3, 8), "SUCCESS", 2, 2, 0, 0, 0)], [("SENT",), ("PENDING",), ("SENT",)],
                  [(datetime(2026, 3, 10), 1, "FETCH", "HTTP_503", "a", "m" * 100), (datetime(2026, 3, 1), 2, "FETCH", "HTTP_503", "a", "m")]).orderBy("section", "place", "a", "b").collect()
    by = {n: [r.text for r in rows if r.section == n and r.place == 1] for n in range(1, 12)}
    first = lambda n: [t.split("**")[1] for t in by[n]]
    assert (first(1), first(2), first(3), first(4), first(5)) == (["Cargo 1"], ["Cargo 2"], ["Cargo 6"], ["Cargo 4"], ["Cargo 4"])
    assert by[6] == ["- 09/04/2026 (em 30d) — DATA DA PROVA · I — N"] and by[7] == ["- 10/03/2026 — Cargo 4 · Inst"]
    assert len(by[8]) == 25 and all("old" not in t for t in by[8]) and by[8][0] == "- EXTENSION — u08  \n  u08" and by[8][1] == f"- EXTENSION — {'t' * 110}  \n  u17"
    assert by[9] == ["- motivo não registrado  \n  u07", f"- {'r' * 120}  \n  edital"]
    assert by[10] == [f"| b | HEALTHY | 09/03 22:00 | 5 | 100% | {'e' * 70} |", "| a | OPEN | nunca | 0 | 12% | lim |"]
    assert [r.text for r in rows if (r.section, r.place) == (10, 2)] == ["Total 2 · saudáveis 1 · degradadas 0 · circuito aberto 1 · desativadas 0"]
    assert by[11] == ["- Última execução: **PARTIAL** em 09/03/2026 07:00 · 1/2 fontes · 3 documentos · 4 novas oportunidades · 5 erros", "- Notificações: PENDING 1, SENT 2", "- Oportunidades no banco: 2 · compatíveis: 1",
                      "- Erros recentes:", f"  - `FETCH/HTTP_503` a — {'m' * 90}"]
    assert "CH? · R$ 1.000,00 · Rio Branco · 50/100 (VERY GOOD) · confiança HIGH" in by[4][0] and by[4][0].endswith("sem link oficial") and "lotação não confirmada" in by[3][0] and "Vínculo não confirmado" in by[3][0]


def test_empty_report_is_written_whole(spark, tmp_path):
    path = str(tmp_path / "report")
    report.written(_lines(spark), path, "Relatório", NOW, ZONE, "Rio Branco/AC")
    whole = "".join(p.read_text() for p in sorted((tmp_path / "report").glob("part-*")))
    titles = [x[3:] for x in whole.split("\n") if x.startswith("## ")]
    assert titles == list(report.TITLES) and whole.startswith("# Relatório\n\nGerado em **10/03/2026 10:00** (America/Rio_Branco)  \nPerfil: Rio Branco/AC")
    assert whole.count(report.NOTHING) == 6 and all(whole.count(t) == 1 for t in report.EMPTY.values()) and "nenhuma registrada" in whole and "Total 0" in whole and whole.rstrip().endswith("informados._")
