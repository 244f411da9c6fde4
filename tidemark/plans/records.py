"""Queries over model answers, document tables and the record merge, with SQL that says what must come out."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.functions import answers, present
from tidemark.operators import drafts as builder
from tidemark.operators import record, resolve, serve, tables
from tidemark.plans.parsing import _DAY, notices
from tidemark.functions.score import accepting
from tidemark.plans.relational import _PAIRS, pairs, q
from tidemark.plans.views import TODAY, spread


def _orders(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet")


def _k():
    return F.col("o_orderkey")


def _said(*pieces):
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in pieces])


@q("f48_parse_payload", """SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 4 THEN 'Resposta nao e JSON valido' WHEN 5 THEN 'Resposta JSON nao e um objeto' END AS problem,
    CASE o_orderkey % 7 WHEN 0 THEN 'edital_number' WHEN 1 THEN 'validity' ELSE '' END AS names, CASE o_orderkey % 7 WHEN 0 THEN concat(o_orderkey, '/2026') WHEN 1 THEN '2 anos' END AS value,
    CAST(CASE o_orderkey % 7 WHEN 0 THEN 0.9 WHEN 1 THEN 0.5 END AS DOUBLE) AS confidence, CAST(CASE o_orderkey % 7 WHEN 0 THEN 1 ELSE 0 END AS INT) AS positions FROM orders""")
def payloads(spark, sf):
    """Answers of every shape: usable, not found, without a quote, unknown fields, wrong types, no JSON."""
    n = _k() % 7
    raw = (F.when(n == 0, _said('{"fields":{"edital_number":{"value":"', _k().cast("string"), '/2026","status":"FOUND","confidence":0.95,"raw_evidence":"Edital"},"salary":{"value":1,"status":"FOUND","raw_evidence":"x"}},"positions":[{"name":"a"},3]}'))
           .when(n == 1, '{"fields":{"validity":{"value":"2 anos","status":"found","confidence":"0.5","raw_evidence":"validade"}},"positions":"none"}')
           .when(n == 2, '{"fields":{"validity":{"value":"2 anos","status":"AMBIGUOUS","confidence":0.5,"raw_evidence":"v"}}}')
           .when(n == 3, '{"fields":{"exam_date":{"value":"2026-11-22","status":"FOUND","confidence":-1,"raw_evidence":""}}}')
           .when(n == 4, "no json {").when(n == 5, "[1, 2]").otherwise('{"fields":[1],"positions":[]}'))
    p = _orders(spark, sf).select(_k().alias("id"), answers.payload(raw).alias("p"))
    first = F.get(F.map_values("p.fields"), F.lit(0))
    return p.select("id", "p.problem", F.array_join(F.array_sort(F.map_keys("p.fields")), ",").alias("names"), first["value"].alias("value"), first["confidence"].alias("confidence"), F.size("p.positions").alias("positions"))


@q("f49_fill_gaps", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'X' ELSE concat(o_orderkey, '/2026') END AS number, CASE WHEN o_orderkey % 3 <> 0 THEN '2026-11-22' END AS exam,
    concat_ws(',', CASE WHEN o_orderkey % 2 = 1 THEN 'edital_number' END, CASE WHEN o_orderkey % 3 <> 0 THEN 'exam_date' END) AS applied FROM orders""")
def filled(spark, sf):
    """Gaps of a record filled from an answer; a date that cannot be read fills nothing."""
    raw = _said('{"fields":{"edital_number":{"value":"', _k().cast("string"), '/2026","status":"FOUND","confidence":1,"raw_evidence":"e"},"exam_date":{"value":"', F.when(_k() % 3 == 0, "sem data").otherwise("22/11/2026"),
                '","status":"FOUND","confidence":1,"raw_evidence":"e"},"name":{"value":"n","status":"FOUND","confidence":1,"raw_evidence":"e"}}}')
    now = {"edital_number": F.when(_k() % 2 == 0, "X"), "exam_date": F.lit(None).cast("date"), "name": F.lit(None).cast("string")}
    got = spread(_orders(spark, sf).select("o_orderkey"), "o_orderkey").select(_k().alias("id"), answers.fill_gaps(now, answers.payload(raw)["fields"]).alias("g"))
    return got.select("id", F.col("g.values.edital_number").alias("number"), F.col("g.values.exam_date").alias("exam"), F.array_join("g.applied", ",").alias("applied"))


@q("f46_apply_to_position", """SELECT o_orderkey AS id, CAST(CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE 1 END AS INT) AS n,
    CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 3 = 2 THEN 'QUOTE_NOT_FOUND' WHEN o_orderkey % 10 = 9 THEN 'PARSER_DISAGREES' ELSE 'CONFIRMED' END AS status,
    CASE WHEN o_orderkey % 4 <> 0 AND o_orderkey % 3 <> 2 AND o_orderkey % 10 <> 9 THEN CAST(10 + o_orderkey % 40 AS DOUBLE) END AS value FROM orders""")
def applied(spark, sf):
    """Located claims about hours: only gaps are judged, short quotes are dropped, invented ones are not found."""
    k = F.col("id")
    quote = F.when(k % 3 == 2, "Jornada de vinte horas que ninguém escreveu").otherwise(F.regexp_extract("text", r"Carga horária de [^;]+; \d+ vagas", 0))
    claim = lambda v, e: F.struct(v.alias("value"), e.alias("raw_evidence"))
    own = F.struct(F.lit("Agente").alias("name"), F.struct(claim((F.lit(10) + k % 40).cast("string"), quote).alias("weekly_workload"), claim(F.lit("1"), F.lit("curta")).alias("salary")).alias("fields"))
    blank = F.struct(F.lit("").alias("name"), F.struct(claim(F.lit("1"), quote).alias("weekly_workload"), claim(F.lit("1"), F.lit("curta")).alias("salary")).alias("fields"))
    raw = F.to_json(F.struct(F.array(own, blank).alias("positions")))
    found = notices(spark, sf).select("id", "text", answers.located(raw).alias("l"))
    now = {"weekly_workload": F.when(k % 4 == 0, 20.0), "salary": F.lit(None).cast("double")}
    got = found.select("id", answers.apply_to_position(now, F.get("l", F.lit(0))["claims"], F.col("text")).alias("g"))
    return got.select("id", F.size("g").alias("n"), F.get("g", F.lit(0))["status"].alias("status"), F.get("g", F.lit(0))["value"].cast("double").alias("value"))


def _table(number: int, *rows):
    """A table of rows; a row that is null is left out."""
    return F.struct(F.lit(number).alias("table"), F.lit(number + 1).alias("page"), F.array_compact(F.array(*rows)).alias("rows"))


def _row(*cells):
    return F.array(*[F.lit(c) if isinstance(c, str) else c for c in cells])


def _rendered(spark, sf, *made):
    return spread(_orders(spark, sf).select("o_orderkey", "o_orderdate"), "o_orderkey").select(_k().alias("doc"), F.explode(F.array(*made)).alias("t")).select("doc", "t.*")


@q("f31_schedule_tables", f"""WITH d AS (SELECT o_orderkey AS doc, {_DAY} AS day FROM orders)
    SELECT doc, 'registration_start' AS field, day AS due, 1 AS page FROM d UNION ALL SELECT doc, 'registration_deadline', day + 30, 1 FROM d
    UNION ALL SELECT doc, 'fee_exemption_deadline', CASE WHEN doc % 2 = 0 THEN day + 2 ELSE day + 3 END, 1 FROM d UNION ALL SELECT doc, 'exam_date', day + 60, 1 FROM d WHERE doc % 3 <> 0""")
def schedules(spark, sf):
    """Dates of schedule tables: periods and single dates, dates beside and inside the description, first rows."""
    day = F.add_months(F.to_date("o_orderdate"), 12 * 26)
    at = lambda n: F.date_format(F.date_add(day, n), "dd/MM/yyyy")
    plan = _table(0, _row("Descrição", "Início", "Fim"), _row("Período de inscrições", at(0), at(30)),
                  F.when(_k() % 2 == 0, _row("Solicitação de isenção da taxa", at(2), "")).otherwise(_row(_said("Pedido de isenção até ", at(3)), "-", "")),
                  F.when(_k() % 3 != 0, _row("Realização das provas objetivas", at(60), "")), _row("Período de inscrições reaberto", at(90), at(95)), _row("Aviso geral", "", ""))
    other = _table(1, _row("Nome", "Valor"), _row("Realização das provas", at(70)))
    return tables.schedule(_rendered(spark, sf, plan, other)).select("doc", "field", "due", "page")


@q("f33_fee_tables", """SELECT o_orderkey AS doc, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 60 + o_orderkey % 40 ELSE 30 + o_orderkey % 10 END AS DOUBLE) AS fee FROM orders WHERE o_orderkey % 5 <> 4""")
def fees(spark, sf):
    """Fees of the wanted level, else the least; without a fee header none."""
    price = lambda c: F.concat(F.lit("R$ "), present.number(c))
    t = _table(0, _row("Cargo", F.when(_k() % 5 == 4, "Valor").otherwise("Taxa de Inscrição")), _row("Nível Superior", price(F.lit(120) + _k() % 30)),
               F.when(_k() % 2 == 0, _row("Nível Médio", price(F.lit(60) + _k() % 40))), _row("Nível Fundamental", price(F.lit(30) + _k() % 10)))
    return tables.fee(_rendered(spark, sf, t)).select("doc", F.col("fee").cast("double").alias("fee"))


@q("f35_position_tables", """SELECT o_orderkey AS doc, 'Agente Um' AS name, 'higher_education' AS education, CAST(o_orderkey % 20 AS INT) AS vacancies, CAST(20 AS DOUBLE) AS weekly FROM orders
    UNION ALL SELECT o_orderkey, 'Agente Dois', CASE WHEN o_orderkey % 2 = 0 THEN 'high_school' ELSE 'higher_education' END, CAST(o_orderkey % 7 AS INT), CAST(30 AS DOUBLE) FROM orders""")
def position_rows(spark, sf):
    """Rows of position tables under their section's level, without totals and other tables."""
    t = _table(0, _row("Cargo", "Vagas", "Carga horária", "Requisito"), _row("Cargos de Nível Superior", "", "", ""), _row("Agente Um", (_k() % 20).cast("string"), "20 horas semanais", "-"),
               F.when(_k() % 2 == 0, _row("Cargos de Nível Médio", "", "", "")), _row("Agente Dois", (_k() % 7).cast("string"), "30 horas semanais", "-"), _row("Total", "99", "", ""))
    other = _table(1, _row("Nome", "Telefone"), _row("Agente Três", "5"))
    return tables.positions(_rendered(spark, sf, t, other), "Rio Branco").select("doc", "name", "education", "vacancies", "weekly")


@q("e13_merged_rows", """WITH r AS (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n, * FROM lineitem),
    c AS (SELECT doc, n, concat('cargo ', l_partkey % 3) AS k, CASE WHEN n % 2 = 0 THEN floor(l_extendedprice) END AS salary, CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END AS requirements, CASE WHEN l_linestatus = 'O' THEN CAST(l_quantity AS DOUBLE) END AS weekly FROM r)
    SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY min(n)) AS INT) AS place, k AS name, CAST(arg_min(salary, n) FILTER (salary IS NOT NULL) AS DOUBLE) AS salary, arg_min(requirements, n) FILTER (requirements <> '') AS requirements,
        arg_min(weekly, n) FILTER (weekly IS NOT NULL) AS weekly, count(*) AS lines FROM c GROUP BY doc, k""")
def merged_rows(spark, sf):
    """Rows about one position joined: first known values in order."""
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    li = spark.read.parquet(f"{sf}/lineitem.parquet").withColumn("n", n)
    none = lambda t: F.lit(None).cast(t)
    rows = li.select(
        F.col("l_orderkey").alias("doc"), F.lit(0).alias("table"), "n", F.concat(F.when(F.col("n") % 3 == 0, "CARGO ").otherwise("Cargo: "), (F.col("l_partkey") % 3).cast("string")).alias("name"),
        F.when(F.col("n") % 2 == 0, F.floor("l_extendedprice")).alias("salary"), F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag")).alias("requirements"),
        F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).alias("weekly"), none("string").alias("location"), none("double").alias("daily"), none("int").alias("vacancies"),
        none("int").alias("reserve"), none("string").alias("education"), F.col("l_linenumber").cast("string").alias("raw"))
    from tidemark.functions.text import normalise

    return tables.merged_rows(rows).select("doc", "place", normalise(F.col("name")).alias("name"), F.col("salary").cast("double").alias("salary"), "requirements", "weekly", F.size("raw").cast("long").alias("lines"))


def drafts(spark, sf):
    """A customer's orders as documents about one opportunity, in all combinations that the rules tell apart."""
    day = F.to_date("o_orderdate")
    text = lambda c: c.cast("string")
    return _orders(spark, sf).select(
        F.col("o_custkey").alias("entity"), _k().alias("seq"), (1 + _k() % 4).cast("int").alias("trust"), (_k() % 2 == 0).alias("has_table"), F.concat(F.lit("s"), _k() % 5).alias("source_id"),
        F.when(_k() % 23 == 0, "CANCELLATION").when(_k() % 23 == 1, "SUSPENSION").when(_k() % 23 == 2, "REOPENING").when(_k() % 23 == 3, "EXTENSION").otherwise("OPENING").alias("document_type"),
        F.when(_k() % 3 == 0, "UNKNOWN").when(_k() % 3 == 1, "PERMANENT").otherwise("TEMPORARY").alias("employment_type"),
        F.when(_k() % 4 == 0, F.array(text(_k() % 8))).otherwise(F.array().cast("array<string>")).alias("stages"), F.when(_k() % 6 == 0, "").otherwise(F.col("o_orderpriority")).alias("name"),
        F.when(_k() % 7 != 0, F.concat(F.lit("i"), _k() % 9)).alias("institution"), text(_k()).alias("evidence"), text(_k()).alias("content_hash"),
        text(day).alias("registration_start"), F.when(_k() % 5 != 0, text(F.date_add(day, 30))).alias("registration_deadline"), F.when(_k() % 2 == 1, text(F.date_add(day, 60))).alias("exam_date"),
        text(F.floor(F.col("o_totalprice") / 100000)).alias("application_fee"), F.when(_k() % 4 != 0, F.col("o_orderpriority")).alias("validity"))


_DRAFTS = """d AS (SELECT o_custkey AS entity, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, (1 + o_orderkey % 4) AS trust, (1 + o_orderkey % 4) * 10 + CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 5 END AS auth,
        CASE o_orderkey % 23 WHEN 0 THEN 'CANCELLED' WHEN 1 THEN 'SUSPENDED' WHEN 2 THEN 'EDITAL_PUBLISHED' WHEN 3 THEN 'EDITAL_PUBLISHED' END AS event,
        CASE o_orderkey % 3 WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'PERMANENT' ELSE 'TEMPORARY' END AS kind, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey % 8 AS VARCHAR) END AS stage,
        CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderpriority END AS name, CASE WHEN o_orderkey % 7 <> 0 THEN concat('i', o_orderkey % 9) END AS inst,
        CAST(o_orderdate AS DATE) AS a, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) + 30 END AS b, CASE WHEN o_orderkey % 2 = 1 THEN CAST(o_orderdate AS DATE) + 60 END AS c,
        CAST(floor(o_totalprice / 100000) AS BIGINT) AS f, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS v FROM orders)"""
_PICK = "CASE WHEN d.{0} IS NULL THEN r.{0} WHEN r.{0} IS NULL OR d.auth <= r.best THEN d.{0} ELSE r.{0} END AS {0}"
_CLASH = "CASE WHEN d.{0} <> r.{0} THEN 1 ELSE 0 END"
_EFFECTIVE = """CASE WHEN {s} IN ('CANCELLED', 'SUSPENDED', 'HOMOLOGATED', 'EXPIRED') THEN {s} WHEN b < DATE '1998-06-15' AND c >= DATE '1998-06-15' THEN 'EXAM_SCHEDULED'
    WHEN b < DATE '1998-06-15' THEN 'REGISTRATION_CLOSED' WHEN a <= DATE '1998-06-15' AND b >= DATE '1998-06-15' THEN 'REGISTRATION_OPEN' ELSE {s} END"""
_RECORD = f"""WITH RECURSIVE {_DRAFTS}, r AS (
    SELECT entity, n, auth AS best, trust, kind, stage, name, inst, a, b, c, f, v, CAST(0 AS BIGINT) AS conflicts,
        CASE WHEN event IN ('CANCELLED', 'SUSPENDED') THEN event ELSE {_EFFECTIVE.format(s="'EDITAL_PUBLISHED'")} END AS status FROM d WHERE n = 1
    UNION ALL
    SELECT entity, n, best, trust, kind, stage, name, inst, a, b, c, f, v, conflicts, CASE WHEN event IN ('CANCELLED', 'SUSPENDED') THEN event ELSE {_EFFECTIVE.format(s="coalesce(event, old)")} END FROM (
        SELECT d.entity, d.n, least(r.best, d.auth) AS best, least(r.trust, d.trust) AS trust, CASE WHEN d.kind <> 'UNKNOWN' AND (r.kind = 'UNKNOWN' OR d.auth <= r.best) THEN d.kind ELSE r.kind END AS kind,
            coalesce(d.stage, r.stage) AS stage, {_PICK.format("name")}, coalesce(r.inst, d.inst) AS inst, {", ".join(_PICK.format(x) for x in "abcfv")},
            r.conflicts + {" + ".join(_CLASH.format(x) for x in "abcf")} AS conflicts, d.event, r.status AS old
        FROM r JOIN d ON d.entity = r.entity AND d.n = r.n + 1))
    """


@q("e11_merged_record", _RECORD + """SELECT r.entity, r.status, r.kind AS employment_type, r.name, r.inst AS institution, r.stage AS stages, s.sources, CAST(r.trust AS INT) AS best_trust, CAST(r.best AS INT) AS best_authority,
        r.n AS version, least(r.conflicts, 60) AS conflicts, r.a AS start, r.b AS deadline, r.c AS exam, r.f AS fee, r.v AS validity
    FROM r JOIN (SELECT entity, max(n) AS n, string_agg(DISTINCT concat('s', k % 5), ',' ORDER BY concat('s', k % 5)) AS sources FROM d GROUP BY entity) s ON r.entity = s.entity AND r.n = s.n""")
def merged_record(spark, sf):
    got = record.merged(drafts(spark, sf), TODAY)
    return got.select("entity", "status", "employment_type", "name", "institution", F.get("stages", F.lit(0)).alias("stages"), F.array_join("sources", ",").alias("sources"), "best_trust", "best_authority", "version", "conflicts",
                      F.col("registration_start").cast("date").alias("start"), F.col("registration_deadline").cast("date").alias("deadline"), F.col("exam_date").cast("date").alias("exam"), F.col("application_fee").cast("long").alias("fee"), "validity")


@q("e14_record_changes", _RECORD + """, s AS (SELECT entity, n, unnest(['registration_start', 'registration_deadline', 'exam_date', 'application_fee', 'validity']) AS field, unnest([CAST(a AS VARCHAR), CAST(b AS VARCHAR), CAST(c AS VARCHAR), CAST(f AS VARCHAR), v]) AS value FROM r),
    o AS (SELECT *, lag(value) OVER (PARTITION BY entity, field ORDER BY n) AS old FROM s)
    SELECT entity, CAST(n AS INT) AS version, field, old AS raw_old, value AS raw_new, field <> 'validity' AS alertable FROM o WHERE n > 1 AND value IS DISTINCT FROM old""")
def record_changes(spark, sf):
    """Field changes of the merged record from document to document."""
    return record.changes(drafts(spark, sf)).where(F.col("field").isin("registration_start", "registration_deadline", "exam_date", "application_fee", "validity")).select(
        "entity", F.col("version").cast("int").alias("version"), "field", "raw_old", "raw_new", "alertable")


@q("e14_snapshots", """WITH p AS (SELECT l_orderkey AS entity, l_partkey AS slug, max(l_quantity) AS weekly FROM lineitem GROUP BY ALL)
    SELECT o_orderkey AS entity, o_orderstatus AS status, count(slug) AS positions, min(slug) AS first, CAST(arg_min(weekly, slug) AS DOUBLE) AS weekly FROM orders LEFT JOIN p ON o_orderkey = entity GROUP BY ALL""")
def record_snapshots(spark, sf):
    """Snapshots of orders with their items, read back from the JSON."""
    p = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("entity"), F.col("l_partkey").alias("slug")).agg(F.max("l_quantity").alias("weekly"))
    s = record.snapshot(_orders(spark, sf).select(_k().alias("entity"), F.col("o_orderstatus").alias("status"), F.lit(None).cast("string").alias("validity")), p)
    back = s.select("entity", F.from_json("snapshot", "status string, validity string, positions array<struct<slug:long,weekly:double>>").alias("b"))
    one = F.get("b.positions", F.lit(0))
    return back.select("entity", "b.status", F.coalesce(F.size("b.positions"), F.lit(0)).cast("long").alias("positions"), one["slug"].alias("first"), one["weekly"].alias("weekly"))


@q("f36_draft", f"""SELECT o_orderkey AS doc, lpad(CAST(o_orderkey % 97 + 1 AS VARCHAR), 2, '0') || '/' || year({_DAY}) AS edital_number, CASE WHEN o_orderkey % 2 = 0 THEN {_DAY} + 5 END AS registration_start,
    CASE WHEN o_orderkey % 2 = 0 THEN {_DAY} + 9 END AS registration_deadline, CASE WHEN o_orderkey % 3 = 0 THEN {_DAY} + 60 END AS exam_date,
    CASE WHEN o_orderkey % 5 = 0 THEN CAST(80 + o_orderkey % 10 AS DOUBLE) ELSE CAST(CAST(round(o_totalprice * 100) AS BIGINT) % 100000000 AS DECIMAL(20,2)) / 100 END AS fee,
    CASE o_orderkey % 4 WHEN 0 THEN 'PERMANENT' WHEN 1 THEN 'TEMPORARY' WHEN 2 THEN 'PUBLIC_EMPLOYMENT' ELSE 'SELECTION' END AS employment_type, o_orderkey % 3 = 0 OR o_orderkey % 10 = 0 AS assignment,
    o_orderkey % 3 = 1 AND o_orderkey % 10 <> 0 AS exam_only, CAST(CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_positions, true AS material,
    CAST(CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE 1 END + CASE WHEN o_orderkey % 3 = 1 AND o_orderkey % 10 <> 0 THEN 1 ELSE 0 END AS INT) AS reasons FROM orders""")
def drafts_built(spark, sf):
    """Drafts from notices and tables: tables win over text, municipal bodies imply the city."""
    day = F.add_months(F.to_date("o_orderdate"), 12 * 26)
    at = lambda n: F.date_format(F.date_add(day, n), "dd/MM/yyyy")
    k = F.col("id")
    docs = notices(spark, sf).select(
        k.alias("doc"), F.lit("Aviso").alias("title"), "text", F.when(k % 10 == 0, "Prefeitura Municipal de Rio Branco").otherwise("Tribunal de Justiça").alias("institution"),
        F.lit(None).cast("string").alias("board"), F.lit(None).cast("string").alias("header_date"), F.lit("http://x.example/a").alias("url"), F.lit("html").alias("media_type"))
    plan = _table(0, _row("Evento", "Início", "Fim"), F.when(_k() % 2 == 0, _row("Período de inscrições", at(5), at(9))), F.when(_k() % 3 == 0, _row("Realização das provas", at(60), "")))
    fee = _table(1, _row("Cargo", F.when(_k() % 5 == 0, "Valor da inscrição").otherwise("Outro")), _row("Nível médio", F.concat(F.lit("R$ "), present.number(F.lit(80) + _k() % 10))))
    posts = _table(2, _row("Cargo", F.when(_k() % 7 == 0, "Vagas").otherwise("Sala")), _row("Agente Administrativo", "3"))
    got = builder.build(docs, _rendered(spark, sf, plan, fee, posts), "Rio Branco")
    return got.select("doc", "edital_number", "registration_start", "registration_deadline", "exam_date", F.col("application_fee").cast("double").alias("fee"), "employment_type", "assignment", "exam_only", "n_positions", "material", F.size("review_reasons").alias("reasons"))


@q("b_answers", f"""WITH {_PAIRS}, w AS (SELECT *, lower(concat(cargo, ' ', institution, ' ', name)) AS hay, state NOT IN ('CANCELLED', 'SUSPENDED', 'HOMOLOGATED', 'EXPIRED', 'REGISTRATION_CLOSED', 'EXAM_SCHEDULED') AND coalesce(deadline >= DATE '1998-06-15', true) AS accepting FROM pairs),
    h AS (SELECT 1 AS request, 'salary' AS fact, w.* FROM w WHERE contains(hay, 'red') AND contains(hay, 'anvil') UNION ALL SELECT 2, 'weekly', w.* FROM w WHERE eligible AND accepting),
    n AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY eligible DESC, score DESC, deadline ASC NULLS LAST, position) AS n, count(*) OVER (PARTITION BY request) AS total FROM h)
    SELECT CAST(request AS INT) AS request, fact, CASE WHEN max(total) = 1 THEN 'card' ELSE 'choices' END AS answer, string_agg(position, ',' ORDER BY n) AS positions FROM n WHERE n <= 5 GROUP BY request, fact UNION ALL SELECT 3, 'exam', 'none', ''""")
def answers_given(spark, sf):
    """Questions that name a position, none in particular, or one that does not exist; small talk gets no row."""
    asked = spark.createDataFrame([(1, "Qual o salário do RED anvil?"), (2, "Qual a jornada?"), (3, "Quando é a prova de astronauta?"), (4, "Bom dia")], "request int, text string")
    p = pairs(spark, sf).withColumn("accepting", accepting(F.col("state"), F.col("deadline"), TODAY))
    return serve.answered(asked, p).select("request", "fact", "answer", F.array_join("positions", ",").alias("positions"))


@q("b_notes", """WITH p AS (SELECT position, substr(position, 1, 8) AS head, row_number() OVER (ORDER BY position) AS r FROM (SELECT DISTINCT position FROM v_position)), one AS (SELECT head FROM p GROUP BY head HAVING count(*) = 1)
    SELECT position AS request, position, CASE WHEN CAST(split_part(position, '-', 1) AS BIGINT) % 2 = 0 THEN 'REGISTERED' ELSE 'INTERESTED' END AS status, concat('estudar ', position) AS note FROM p WHERE length(position) >= 8""")
def notes_taken(spark, sf):
    """A note on every position by its whole code; codes of fewer than eight characters say nothing."""
    from tidemark.plans.views import view

    positions = view(spark, sf, "v_position").select("position").distinct()
    asked = positions.select(F.col("position").alias("request"), F.concat(F.lit(" "), "position", F.lit("  estudar "), "position", F.lit(" ")).alias("argument"))
    held = positions.where(F.substring_index("position", "-", 1).cast("long") % 2 == 0).select("position", F.lit("REGISTERED").alias("status"))
    return serve.noted(asked, positions, held)


@q("v_lookup_by_name", """SELECT l_orderkey AS doc, concat('Analista ', l_partkey % 5) AS name, CASE WHEN l_partkey % 5 = 0 THEN 'ANALISTA 0' WHEN l_partkey % 5 = 1 THEN 'analista 1 - direito' WHEN l_partkey % 5 = 2 THEN 'Analista 2' END AS found FROM lineitem GROUP BY ALL""")
def looked_up(spark, sf):
    """Positions among a document's located names: equal ones first, then those around or inside."""
    li = spread(spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").alias("doc"), F.concat(F.lit("Analista "), F.col("l_partkey") % 5).alias("name")), "doc", 500_000).distinct()
    names = F.array(F.lit("ANALISTA 0"), F.lit("analista 1 - direito"), F.lit("Analista 2 e mais"), F.lit("Analista 2"), F.lit(""))
    offered = li.select("doc").distinct().select("doc", F.posexplode(names).alias("place", "other"))
    return resolve.by_name(li, offered)


@q("a14_uncached", "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 2 = 0")
def uncached(spark, sf):
    """Documents to ask a model about: those answered under another model or during an outage are asked again."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.sha2(F.concat_ws("-", "doc_id", F.coalesce("text", F.lit(""))), 256).alias("content_hash"), F.lit("p1").alias("prompt_version"), F.lit("m").alias("model"), F.lit("1").alias("model_version"))
    cache = d.where("doc_id % 3 = 0").withColumn("status", F.when(F.col("doc_id") % 2 == 0, "UNAVAILABLE").otherwise("OK"))
    old = d.where("doc_id % 3 = 1").withColumn("model_version", F.lit("0")).withColumn("status", F.lit("OK"))
    return resolve.uncached(d, cache.unionByName(old)).select("doc_id")
