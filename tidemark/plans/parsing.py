"""Queries over the parsing, text, URL and table functions: notices are rendered from orders and
read back, so that SQL can say from the orders what must come out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import cells, origins, parse, present, score, text, urls, verify
from tidemark.sources import pages
from tidemark.plans.relational import _CASES, _DAY_OF, _MONEY, _PAIRS, _PERIOD, _RANK, _SURE, pairs, q
from tidemark.plans.views import spread


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def notices(spark: SparkSession, sf: str) -> DataFrame:
    """id and the text of a notice for each order: dates 26 years later, a fee, hours, vacancies."""
    k = F.col("o_orderkey")
    day = F.add_months(F.to_date("o_orderdate"), 12 * 26)
    shown = lambda d: F.date_format(d, "dd/MM/yyyy")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    fee = F.concat(present.number((cents % 100_000_000 / 100).cast("decimal(20,2)")))
    kind = F.element_at(F.array(*[F.lit(x) for x in (
        "Concurso Público para cargos efetivos", "Processo seletivo simplificado para contratação temporária",
        "Emprego público, regime da CLT", "Seleção pública")]), (k % 4 + 1).cast("int"))
    level = F.element_at(F.array(*[F.lit(x) for x in ("Ensino Médio completo", "Nível Superior em Administração", "Ensino fundamental", "Sem exigência")]), (k % 4 + 1).cast("int"))
    place = F.element_at(F.array(*[F.lit(x) for x in (
        "A lotação será em Rio Branco", "As provas serão aplicadas na cidade de Rio Branco", "Lotação: Cruzeiro do Sul")]), (k % 3 + 1).cast("int"))
    gain = F.when(k % 5 == 0, "Auxílio-alimentação e vale transporte. ").otherwise("")
    free = F.when(k % 6 == 0, "Poderá solicitar isenção o doador de sangue ou desempregado. ").otherwise("")
    hours = F.when(k % 10 == 9, F.concat(F.lit("6 horas diárias, 5 dias por semana"))).otherwise(F.concat((F.lit(10) + k % 40).cast("string"), F.lit(" horas semanais")))
    body = F.concat(
        F.lit("EDITAL Nº "), (k % 97 + 1).cast("string"), F.lit("/"), F.year(day).cast("string"), F.lit(". "), kind, F.lit(". Inscrições de "), shown(day),
        F.lit(" a "), shown(F.date_add(day, 30)), F.lit(". Taxa de inscrição: R$ "), fee, F.lit(". Carga horária de "), hours, F.lit("; "),
        (k % 30).cast("string"), F.lit(" vagas. "), place, F.lit(". "), level, F.lit(". "), gain, free, F.lit("Validade deste concurso: 2 anos."))
    orders = spread(_table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"), "o_orderkey")
    return orders.select(k.alias("id"), body.alias("text"))


_DAY = "CAST(CAST(o_orderdate AS DATE) + INTERVAL 26 YEAR AS DATE)"


def _body():
    return F.col("text")


@q("f06_parse_dates", f"SELECT o_orderkey AS id, {_DAY} AS first, {_DAY} AS start, {_DAY} + 30 AS end_, CAST(2 AS INT) AS n FROM orders")
def dates(spark, sf):
    found = notices(spark, sf).select("id", parse.dates(_body()).alias("d"))
    return found.select("id", F.col("d.first").alias("first"), F.col("d.start").alias("start"), F.col("d.end").alias("end_"), F.size("d.all").alias("n"))


@q("f09_parse_money", "SELECT o_orderkey AS id, CAST(CAST(round(o_totalprice * 100) AS BIGINT) % 100000000 AS DECIMAL(20,2)) / 100 AS fee FROM orders")
def fees(spark, sf):
    return notices(spark, sf).select("id", parse.parse_money(_body()).cast("double").alias("fee"))


@q("f10_workload", "SELECT o_orderkey AS id, CAST(CASE WHEN o_orderkey % 10 = 9 THEN 30 ELSE 10 + o_orderkey % 40 END AS DOUBLE) AS weekly, CAST(CASE WHEN o_orderkey % 10 = 9 THEN 6 END AS DOUBLE) AS daily FROM orders")
def workloads(spark, sf):
    return notices(spark, sf).select("id", parse.weekly_workload(_body()).alias("weekly"), parse.daily_workload(_body()).alias("daily"))


@q("f12_vacancies_number", f"SELECT o_orderkey AS id, CAST(o_orderkey % 30 AS INT) AS vacancies, concat(lpad(CAST(o_orderkey % 97 + 1 AS VARCHAR), 2, '0'), '/', year({_DAY})) AS number FROM orders")
def numbers(spark, sf):
    return notices(spark, sf).select("id", parse.vacancies(_body()).alias("vacancies"), parse.edital_number(_body()).alias("number"))


@q("f14_classes", """SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'high_school' WHEN 1 THEN 'higher_education' WHEN 2 THEN 'primary' END AS education,
    CASE o_orderkey % 4 WHEN 0 THEN 'PERMANENT' WHEN 1 THEN 'TEMPORARY' WHEN 2 THEN 'PUBLIC_EMPLOYMENT' ELSE 'SELECTION' END AS employment,
    CASE o_orderkey % 4 WHEN 1 THEN 'Temporário' WHEN 2 THEN 'CLT' END AS regime,
    CASE WHEN o_orderkey % 5 = 0 THEN 'Auxílio-alimentação; Auxílio-transporte' END AS benefits,
    CASE WHEN o_orderkey % 6 = 0 THEN 'Doador de sangue; Desempregado' END AS exemption, '2 ano(s)' AS validity FROM orders""")
def classes(spark, sf):
    n, low = F.col("normal"), F.col("low")
    read = notices(spark, sf).withColumn("low", parse.folded(_body())).withColumn("normal", text.spaced(low))
    return read.select(
        "id", parse.education(_body(), n).alias("education"), parse.employment_type(_body(), n).alias("employment"), parse.employment_regime(_body(), n).alias("regime"),
        parse.benefits(_body(), n).alias("benefits"), parse.fee_exemption(_body(), low).alias("exemption"), parse.validity(_body(), low).alias("validity"))


@q("f16_location_context", "SELECT o_orderkey AS id, o_orderkey % 3 = 0 AS assignment, o_orderkey % 3 = 1 AS exam_only FROM orders")
def locations(spark, sf):
    where = notices(spark, sf).select("id", parse.location_context(_body(), "Rio Branco").alias("w"))  # judged once for both
    return where.select("id", F.col("w.assignment").alias("assignment"), F.col("w.exam_only").alias("exam_only"))


@q("f17_institution_city", "SELECT n_nationkey AS id, concat('Prefeitura Municipal de ', n_name) AS institution, n_name = 'NATION_7' OR starts_with(n_name, 'NATION_7') AS implied FROM nation WHERE n_name IS NOT NULL")
def implied(spark, sf):
    name = F.concat(F.lit("Prefeitura Municipal de "), "n_name")
    return _table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), name.alias("institution"), parse.institution_implies_city(name, "Nation 7").alias("implied"))


@q("f23_classify_document", """SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN 'CANCELLATION' WHEN 1 THEN 'RECTIFICATION' WHEN 2 THEN 'EXTENSION' WHEN 3 THEN 'RESULT' WHEN 4 THEN 'OPENING' WHEN 5 THEN 'SUMMONS' ELSE 'OPENING' END AS kind, true AS job FROM orders""")
def documents(spark, sf):
    title = F.element_at(F.array(*[F.lit(x) for x in (
        "Cancelamento do certame", "Retificação nº 2", "Prorrogação de prazo", "Resultado final", "Edital de Abertura: cronograma", "Convocação", "Aviso")]), (F.col("id") % 7 + 1).cast("int"))
    read = notices(spark, sf).withColumn("low", parse.folded(F.substring(_body(), 1, 20000)))  # one fold for both
    return read.select("id", parse.classify_document(title, _body(), F.col("low")).alias("kind"), parse.is_job_selection(title, _body(), F.col("low")).alias("job"))


@q("f24_publication_date", f"SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN {_DAY} - 3 ELSE {_DAY} END AS published FROM orders")
def published(spark, sf):
    day = F.date_sub(F.add_months(F.to_date("o_orderdate"), 12 * 26), 3)
    both = notices(spark, sf).join(_table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), day.alias("day")), "id")
    said = F.when(F.col("id") % 2 == 0, F.concat(_body(), F.lit(" Publicado em "), F.date_format("day", "yyyy-MM-dd"), F.lit("."))).otherwise(_body())
    return both.select("id", parse.publication_date(F.lit("Aviso"), said).alias("published"))


@q("f26_qualification", """SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'HIGH SCHOOL ONLY' WHEN 1 THEN 'HIGH SCHOOL + TECHNICAL QUALIFICATION' WHEN 2 THEN 'HIGH SCHOOL + PROFESSIONAL REGISTRATION'
    WHEN 3 THEN 'HIGH SCHOOL + DRIVER/LICENSE REQUIREMENT' WHEN 4 THEN 'OTHER ADDITIONAL REQUIREMENT' ELSE 'UNKNOWN' END AS category,
    CASE WHEN o_orderkey % 6 < 4 THEN 'high_school' WHEN o_orderkey % 6 = 4 THEN 'higher_education' END AS education,
    CAST(CASE o_orderkey % 6 WHEN 0 THEN 0 WHEN 5 THEN 0 ELSE 1 END AS INT) AS extras FROM orders""")
def qualifications(spark, sf):
    wants = F.element_at(F.array(*[F.lit(x) for x in (
        "Ensino Médio completo", "Ensino médio e curso técnico", "Ensino médio com registro no Conselho", "Nível médio e CNH B", "Graduação em Direito", "")]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    got = score.qualification(wants)
    return _table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), got["category"].alias("category"), got["education"].alias("education"), F.size(got["extras"]).alias("extras"))


@q("f27_selection_name", f"SELECT o_orderkey AS id, concat(CASE o_orderkey % 4 WHEN 0 THEN 'Concurso Público para cargos efetivos' WHEN 1 THEN 'Processo seletivo simplificado para contratação temporária' WHEN 2 THEN 'Aviso' ELSE 'Seleção pública' END, ' — Edital ', lpad(CAST(o_orderkey % 97 + 1 AS VARCHAR), 2, '0'), '/', year({_DAY})) AS name FROM orders")
def names(spark, sf):
    return notices(spark, sf).select("id", parse.selection_name(F.lit("Aviso"), _body(), F.lit("Prefeitura"), parse.edital_number(_body())).alias("name"))


@q("f28_stages_schedule", f"""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN {_DAY} + 60 END AS exam, {_DAY} AS start, {_DAY} + 30 AS deadline,
    concat_ws('; ', CASE WHEN o_orderkey % 3 = 0 THEN 'Prova objetiva' END, CASE WHEN o_orderkey % 4 = 0 THEN 'Prova discursiva' END, CASE WHEN o_orderkey % 5 = 0 THEN 'Prova de títulos' END, CASE WHEN o_orderkey % 7 = 0 THEN 'Entrevista' END) AS stages FROM orders""")
def stages(spark, sf):
    """Stages in their own order, and the dates of labelled windows."""
    k = F.col("o_orderkey")
    day = F.add_months(F.to_date("o_orderdate"), 12 * 26)
    at = lambda n: F.date_format(F.date_add(day, n), "dd/MM/yyyy")
    said = F.concat(F.when(k % 7 == 0, "Haverá entrevista. ").otherwise(""), F.when(k % 5 == 0, "Avaliação de Títulos. ").otherwise(""), F.when(k % 4 == 0, "PROVA DE REDAÇÃO. ").otherwise(""), F.when(k % 3 == 0, "Provas objetivas. ").otherwise(""),
                    F.lit("Período de inscrições: "), at(0), F.lit(" a "), at(30), F.lit(". "), F.lit("x" * 450), F.when(k % 2 == 0, F.concat(F.lit(" Data da prova: "), at(60))).otherwise(""))
    when = parse.schedule_from_text(F.col("said"), F.col("low"))
    orders = spread(_table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey")
    read = orders.select(k.alias("id"), said.alias("said")).withColumn("low", parse.folded(F.col("said")))  # one fold for both
    got = read.select("id", when.alias("w"), F.array_join(parse.stages(F.col("said"), text.spaced(F.col("low"))), "; ").alias("stages"))
    return got.select("id", F.col("w.exam").alias("exam"), F.col("w.start").alias("start"), F.col("w.deadline").alias("deadline"), "stages")


@q("f36_build_opportunity", f"""SELECT o_orderkey AS id, lpad(CAST(o_orderkey % 97 + 1 AS VARCHAR), 2, '0') || '/' || year({_DAY}) AS number, {_DAY} AS start, {_DAY} + 30 AS deadline,
    CAST(CAST(CASE WHEN o_orderkey % 10 = 9 THEN 30 ELSE 10 + o_orderkey % 40 END AS DOUBLE) AS DOUBLE) AS weekly, true AS material FROM orders""")
def build(spark, sf):
    """The draft record of each notice; material if it has a number or a deadline and offers work."""
    read = notices(spark, sf).select("id", parse.edital_number(_body()).alias("number"), parse.parse_period(_body()).alias("p"), parse.weekly_workload(_body()).alias("weekly"),
                                     parse.is_job_selection(F.lit(""), _body()).alias("work"))
    return read.select("id", "number", F.col("p.start").alias("start"), F.col("p.end").alias("deadline"), "weekly",
                       ((F.col("number").isNotNull() | F.col("p.end").isNotNull()) & F.col("work")).alias("material"))


@q("f34_classify_row", """SELECT l_orderkey AS k, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp, concat('Agente ', p_name) AS name, CAST(floor(l_extendedprice) AS DOUBLE) AS salary, CAST(l_quantity AS DOUBLE) AS weekly,
    CAST(l_suppkey % 20 AS INT) AS vacancies, CASE WHEN l_partkey % 3 = 0 THEN 'Rio Branco' ELSE '' END AS location FROM lineitem JOIN part ON l_partkey = p_partkey""")
def rows(spark, sf):
    """Table rows rendered from line items and read back cell by cell."""
    items = _table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    both = spread(items, "l_orderkey").join(_table(spark, sf, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    row = F.array(F.concat(F.lit("Agente "), "p_name"), (F.col("l_suppkey") % 20).cast("string"), F.concat(F.lit("R$ "), present.number(F.floor("l_extendedprice"))),
                  F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" horas semanais")), F.when(F.col("l_partkey") % 3 == 0, "Rio Branco").otherwise("-"))
    got = cells.classify_row(row, F.lit("high_school"), "Rio Branco")
    return both.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), got.alias("g")).select(
        "k", "line", "part", "supp", F.col("g.name").alias("name"), F.col("g.salary").cast("double").alias("salary"), F.col("g.weekly").alias("weekly"), F.col("g.vacancies").alias("vacancies"), F.col("g.location").alias("location"))


@q("f35_level_carry", """WITH r AS (SELECT o_custkey AS sheet, o_orderkey AS n, CASE WHEN o_orderkey % 10 = 0 THEN 'superior' WHEN o_orderkey % 10 = 5 THEN 'medio' END AS l FROM orders)
    SELECT sheet, n, CASE last_value(l IGNORE NULLS) OVER (PARTITION BY sheet ORDER BY n) WHEN 'superior' THEN 'higher_education' WHEN 'medio' THEN 'high_school' END AS level FROM r""")
def levels(spark, sf):
    """Section levels carried to the rows below."""
    from pyspark.sql import Window

    head = F.when(F.col("n") % 10 == 0, "Cargos de Nível Superior").when(F.col("n") % 10 == 5, "CARGO DE NÍVEL MÉDIO").otherwise("Agente")
    rows_ = _table(spark, sf, "orders").select(F.col("o_custkey").alias("sheet"), F.col("o_orderkey").alias("n")).withColumn("l", cells.level_of(F.array(head)))
    return rows_.select("sheet", "n", F.last("l", ignorenulls=True).over(Window.partitionBy("sheet").orderBy("n")).alias("level"))


@q("f01_normalise", "SELECT doc_id, md5(trim(regexp_replace(lower(strip_accents(replace(text, 'ß', 'ss'))), '[^a-z0-9]+', ' ', 'g'))) AS digest FROM documents")
def normalised(spark, sf):
    """The normal form of every text; that of a null is null."""
    return _table(spark, sf, "documents").select("doc_id", F.md5(text.normalise(_body())).alias("digest"))


@q("f02_locate_marker", "SELECT doc_id, CAST(nullif(instr(lower(strip_accents(text)), 'license'), 0) AS INT) AS place FROM documents")
def located(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", text.locate(text.fold(_body()), ("license",)).alias("place"))


@q("f05_tidy", "SELECT doc_id, CAST(length(trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[ \\t]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10))) AS INT) AS n, false AS truncated FROM documents")
def tidied(spark, sf):
    t = text.tidy(_body(), limit=None)
    return _table(spark, sf, "documents").select("doc_id", F.length(t["text"]).alias("n"), t["truncated"].alias("truncated"))


@q("f03_content_digest", "SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents")
def digests(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", F.sha2(F.coalesce(_body(), F.lit("")), 256).alias("digest"))


@q("k08_redact", r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\b\d{8,12}:[A-Za-z0-9_-]{30,}\b', '[REDACTED]', 'g'), '\b(?:sk|rk|gh[pousr])[-_][A-Za-z0-9_-]{16,}\b', '[REDACTED]', 'g'), '(?i)(postgres(?:ql)?(?:\+\w+)?://[^:@\s]+:)[^@\s]+(@)', '\1[REDACTED]\2', 'g'), '(?i)\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b', '[REDACTED]', 'g')) AS digest FROM documents")
def redacted(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", F.md5(text.redact(_body())).alias("digest"))


@q("f39_present", "SELECT o_orderkey AS id, concat('R$ ', replace(replace(replace(format('{:,.2f}', CAST(o_totalprice AS DECIMAL(20,2))::DOUBLE), ',', '_'), '.', ','), '_', '.')) AS money, strftime(o_orderdate, '%d/%m/%Y') AS day FROM orders")
def shown(spark, sf):
    return _table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), present.money(F.col("o_totalprice")).alias("money"), present.day(F.to_date("o_orderdate")).alias("day"))


@q("f40_idempotency_key", "SELECT c_custkey AS id, concat('deadline:', substr(sha256(concat_ws(chr(31), 'DEADLINE', lower(replace(c_name, '#', ' ')), lower(c_mktsegment))), 1, 32)) AS key FROM customer")
def keys(spark, sf):
    return _table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), text.idempotency_key(F.lit("DEADLINE"), F.col("c_name"), F.col("c_mktsegment")).alias("key"))


@q("f42_utf16_units", "SELECT doc_id, CAST(length(text) AS INT) AS units FROM documents")
def units(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", text.utf16_units(_body()).alias("units"))


_LINES = {
    "Instituição:": "institution", "Certame:": "name", "Cargo:": "cargo", "Tipo de vínculo:": _CASES(present.EMPLOYMENT, "employment_type"), "Escolaridade:": _CASES(present.EDUCATION, "education"),
    "Qualificação adicional:": f"CASE WHEN only_school THEN 'Nenhuma' ELSE {_CASES(present.QUALIFICATION, 'qualification')} END",
    "Lotação:": "CASE WHEN assignment_confirmed THEN concat(location, '/AC') ELSE coalesce(location, 'não confirmada') END", "Carga horária:": "coalesce(weekly || 'h/semana', 'não confirmada — em investigação')",
    "Remuneração:": _MONEY.format("salary"), "Vagas:": "coalesce(CAST(vacancies AS VARCHAR), 'não informado')", "Inscrições:": _PERIOD, "Taxa de inscrição:": _MONEY.format("fee"), "Prova:": _DAY_OF.format("exam"),
    "Situação:": _CASES(present.STATUS, "status"), "Classificação de carga horária:": _CASES(present.WORKLOAD, "workload"), "Compatibilidade:": f"concat(score, '/100 (', {_RANK}, ')')", "Confiança da informação:": _SURE}


@q("f43_messages", f"""WITH {_PAIRS} SELECT id, position, concat('{present.TITLES["NEW_OPPORTUNITY"]}', chr(10), chr(10), concat_ws(concat(chr(10), chr(10)), {", ".join(f"concat('{k}', chr(10), {v})" for k, v in _LINES.items())})) AS message
    FROM pairs WHERE eligible AND actionable AND dated AND trust_level <= 2 AND conflicts = 0""")
def messages(spark, sf):
    """Alerts of the eligible pairs as text."""
    p = pairs(spark, sf).where("primary_alert")
    o = {c: F.col(c) for c in ("institution", "name", "employment_type", "education", "assignment_confirmed", "location", "weekly", "salary", "vacancies", "start", "deadline", "fee", "exam", "status", "workload", "score", "rank", "confidence")}
    o |= {"position": F.col("cargo"), "qualification_category": F.col("qualification"), "additional_qualifications": F.array().cast("array<string>")}
    return p.select("id", "position", present.opportunity_message(o).alias("message"))


@q("f44_verify_claims", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 2 THEN 'QUOTE_NOT_FOUND' WHEN o_orderkey % 10 <> 9 AND o_orderkey % 3 = 0 THEN 'CONFIRMED' WHEN o_orderkey % 10 = 9 THEN 'PARSER_DISAGREES' ELSE 'PARSER_DISAGREES' END AS status FROM orders")
def claims(spark, sf):
    """Claims about hours with a quote: true ones, wrong values, and invented quotes."""
    k = F.col("id")
    hours = (F.lit(10) + k % 40).cast("string")
    quote = F.when(k % 3 == 2, "Jornada de vinte horas que ninguém escreveu").otherwise(F.regexp_extract("text", r"Carga horária de [^;]+; \d+ vagas", 0))
    proposed = F.when(k % 10 == 9, F.lit("99")).when(k % 3 == 0, hours).otherwise("99")
    return notices(spark, sf).select("id", verify.verify("weekly_workload", proposed, quote, _body())["status"].alias("status"))


@q("f47_focus_excerpt", """WITH d AS (SELECT doc_id, text, string_split(lower(text), 'license') AS parts FROM documents),
    h AS (SELECT doc_id, text, unnest(list_transform(range(1, least(len(parts) - 1, 40) + 1), lambda i: list_sum(list_transform(list_slice(parts, 1, i), lambda x: length(x))) + 7 * (i - 1))) AS pos FROM d),
    g AS (SELECT *, coalesce(pos - 600 > lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 2400, true) AS opens FROM h),
    i AS (SELECT *, sum(CAST(opens AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM g),
    p AS (SELECT doc_id, island, least(length(any_value(text)), max(pos) + 2400) - greatest(min(pos) - 600, 0) AS size FROM i GROUP BY ALL),
    u AS (SELECT doc_id, greatest(0, least(size, 22000 - coalesce(sum(size) OVER (PARTITION BY doc_id ORDER BY island ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS part FROM p),
    e AS (SELECT doc_id, sum(part) + 7 * (count(*) FILTER (part > 0) - 1) AS n FROM u GROUP BY doc_id)
    SELECT doc_id, CAST(coalesce(e.n, least(length(text), 22000)) AS INT) AS n FROM documents LEFT JOIN e USING (doc_id)""")
def excerpts(spark, sf):
    """The regions of every document around a name, whatever its length."""
    low = text.fold(_body())
    got = verify.focus_excerpt(_body(), low, F.array(F.lit(text.marker_pattern("license"))))
    return _table(spark, sf, "documents").select("doc_id", F.length(got).alias("n"))


@q("f38_evaluate", f"""WITH {_PAIRS} SELECT id, position, score, eligible, eligible AND actionable AND dated AND trust_level <= 2 AND conflicts = 0 AS primary_alert,
    NOT local OR NOT school OR weekly IS NULL OR conflicts > 0 OR NOT dated AS needs_review,
    CASE WHEN trust_level <= 2 AND conflicts = 0 AND 2 + CAST(location IS NOT NULL AS INT) + CAST(weekly IS NOT NULL AS INT) >= 3 THEN 'HIGH' WHEN trust_level <= 2 AND conflicts = 0 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM pairs""")
def evaluated(spark, sf):
    return pairs(spark, sf).select("id", "position", "score", "eligible", "primary_alert", F.col("needs_review_pair").alias("needs_review"), "confidence")


_URL = r"""regexp_extract(url, '^(https?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?', {})"""


@q("p03_canonical_url", f"""SELECT page_id, concat({_URL.format(1)}, '://', lower({_URL.format(2)}), CASE WHEN {_URL.format(3)} IN ('', '/') THEN '/' ELSE rtrim({_URL.format(3)}, '/') END,
      CASE WHEN q <> '' THEN concat('?', q) ELSE '' END) AS canonical
    FROM (SELECT page_id, url, array_to_string(list_sort(list_filter(string_split({_URL.format(4)}, '&'), lambda p: p <> '' AND split_part(p, '=', 1) NOT IN ('ref', 'origin', '_ga') AND NOT starts_with(p, 'utm_'))), '&') AS q FROM pages)""")
def canonical_urls(spark, sf):
    return _table(spark, sf, "pages").select("page_id", urls.canonical(F.col("url")).alias("canonical"))


@q("p02_host_allowed", "SELECT page_id, h = 'example.com' OR ends_with(h, '.example.com') OR ends_with(h, '.example.org') OR h = 'example.org' AS allowed FROM (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) AS h FROM pages)")
def hosts_allowed(spark, sf):
    return _table(spark, sf, "pages").select("page_id", urls.host_allowed(F.col("url"), F.array(F.lit("example.com"), F.lit("example.org"))).alias("allowed"))


@q("p01_relevant_links", "SELECT page_id, regexp_matches(url, '/(fr|de)/') AS relevant FROM pages")
def relevant_links(spark, sf):
    return _table(spark, sf, "pages").select("page_id", urls.relevant(F.regexp_replace("url", "#.*$", ""), F.lit(""), "/(fr|de)/").alias("relevant"))


@q("p04_media_type", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'pdf' WHEN 2 THEN 'json' WHEN 3 THEN 'xml' WHEN 4 THEN 'html' ELSE 'unknown' END AS kind FROM events")
def media_types(spark, sf):
    k = F.col("event_id") % 6
    kind = F.element_at(F.array(*[F.lit(x) for x in ("text/plain", "application/octet-stream", "application/json", "application/rss+xml", "text/html; charset=utf-8", "")]), (k + 1).cast("int"))
    url = F.when(k == 1, "http://x.example/a.PDF").otherwise("http://x.example/a")
    return _table(spark, sf, "events").select("event_id", urls.media_type(url, kind, F.when(k == 0, F.lit("%PDF-1.7")).otherwise("<html>").cast("binary")).alias("kind"))


@q("s07_should_escalate", "SELECT event_id, event_id % 5 = 0 OR event_type = 'error' OR event_id % 3 = 0 AS escalate FROM events")
def escalations(spark, sf):
    k = F.col("event_id")
    status = F.when(F.col("event_type") == "error", 403).otherwise(200)
    return _table(spark, sf, "events").select("event_id", urls.should_escalate(status, F.lit(None).cast("string"), F.when(k % 3 == 0, 0).otherwise(4), k % 5 == 0).alias("escalate"))


_WALLS = ("Please solve the CAPTCHA", "Acesso  Restrito!", "Bem-vindo", "Verifique que você NÃO é um robô", "checking your browser...", "cf-challenge", "Faça login para continuar", "hCaptcha", "reCAPTCHA e acesso restrito", "Verifying you are human")


@q("p11_wall", """SELECT event_id, CASE event_id % 11 WHEN 0 THEN 'captcha' WHEN 1 THEN 'acesso restrito' WHEN 3 THEN 'verifique que voce nao e um robo' WHEN 4 THEN 'checking your browser' WHEN 6 THEN 'faca login para continuar' WHEN 7 THEN 'captcha' WHEN 8 THEN 'captcha' WHEN 9 THEN 'verifying you are human' END AS wall FROM events""")
def walls(spark, sf):
    """Every marker, case and accents, a marker beyond the first 4000 characters, and one that the normal form cannot hold."""
    n = (F.col("event_id") % 11).cast("int")
    t = F.when(n == 10, F.concat(F.repeat(F.lit("a "), 2000), F.lit("captcha"))).otherwise(F.get(F.array(*[F.lit(w) for w in _WALLS]), n))
    return _table(spark, sf, "events").select("event_id", parse.wall(t).alias("wall"))


@q("s13_html_pages")
def html_pages(spark, sf):
    """Title, number of links, text length and shape of every page."""
    p = pages.parsed(_table(spark, sf, "pages"))
    return p.select("page_id", F.col("page.title").alias("title"), F.size("page.links").alias("links"), F.length("page.text").alias("n_chars"), pages.fingerprint(F.col("page.shape")).alias("shape"))


@q("s08_link_discovery")
def link_discovery(spark, sf):
    """Allowed canonical links of all pages, once for each page."""
    p = pages.parsed(_table(spark, sf, "pages"))
    return pages.links(p, F.array(F.lit("example.com"), F.lit("example.net"), F.lit("example.org")))


@q("s10_sitemap", "SELECT page_id, CAST(CASE WHEN page_id % 3 = 0 THEN 0 ELSE 1 + page_id % 3 END AS INT) AS n, CASE WHEN page_id % 3 <> 0 THEN url END AS first, CASE WHEN page_id % 3 = 2 THEN 'https://b.example/2' WHEN page_id % 3 = 1 THEN 'https://b.example/1' END AS last FROM pages")
def sitemaps(spark, sf):
    k = F.col("page_id") % 3
    more = F.when(k == 2, "<LOC>https://b.example/1</LOC><loc>https://b.example/2</loc>").otherwise("<url><loc>\nhttps://b.example/1</loc></url>")
    found = urls.sitemap_links(F.when(k == 0, "<urlset><loc></loc></urlset>").otherwise(F.concat(F.lit("<urlset><url><loc> "), "url", F.lit(" </loc></url>"), more)))
    return _table(spark, sf, "pages").select("page_id", F.size(found).alias("n"), F.get(found, F.lit(0)).alias("first"), F.try_element_at(found, F.lit(-1)).alias("last"))


@q("s19_tidy_rows", """SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN concat('Cargo|Vagas#', o_orderkey, '|3') WHEN 1 THEN concat('Cargo#', o_orderkey) ELSE concat('Cargo||x#', o_orderkey, '|y z|') END AS cells FROM orders""")
def tidy_tables(spark, sf):
    """Ragged tables with empty rows and columns, and cells of white space."""
    k, key = F.col("o_orderkey") % 3, F.col("o_orderkey").cast("string")
    row = lambda *c: F.array(*[x if not isinstance(x, str) else F.lit(x) for x in c])
    none = F.lit(None).cast("string")
    t = (F.when(k == 0, F.array(row(" Cargo ", "", "Vagas"), row("", " "), row(key, "", "3"))).when(k == 1, F.array(row("Cargo", " \t", ""), row(key), row(none)))
         .otherwise(F.array(row("Cargo", "", "x"), row(key, "y\n z"))))
    got = cells.tidy_rows(t)
    return _table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.array_join(F.transform(got, lambda r: F.array_join(r, "|")), "#").alias("cells"))


@q("f51_utc_schedule", """SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN concat(event_id % 60, ' ', (event_id % 24 + 5) % 24, ' * * *') END AS western, CASE WHEN event_id % 10 <> 0 THEN concat((event_id % 60 + 30) % 60, ' ', (event_id % 24 + 18 + (event_id % 60 + 30) // 60) % 24, ' * * *') END AS eastern FROM events""")
def cron(spark, sf):
    """Every minute of a day in two zones, one of half an hour; nonsense has no line."""
    e = F.col("event_id")
    local = F.when(e % 10 != 0, F.format_string("%02d:%02d", e % 24, e % 60)).otherwise("25:61")
    return _table(spark, sf, "events").select("event_id", present.utc_cron(local, "America/Rio_Branco").alias("western"), present.utc_cron(local, "Asia/Kolkata").alias("eastern"))


@q("f02_origins", """WITH d AS (SELECT doc_id, text, replace(text, 'ss', 'ß') AS shown FROM documents),
    n AS (SELECT *, trim(regexp_replace(lower(strip_accents(replace(text, 'ß', 'ss'))), '[^a-z0-9]+', ' ', 'g')) AS form FROM d)
    SELECT doc_id, CAST(coalesce(nullif(instr(form, 'license'), 0), nullif(instr(form, 'the'), 0), 0) - 1 AS INT) AS place,
        CAST(CASE WHEN contains(form, 'license') THEN length(string_split(lower(shown), 'license')[1]) + 1 WHEN contains(form, 'the') THEN length(string_split(lower(shown), 'the')[1]) + 1 ELSE 0 END - 1 AS INT) AS origin FROM n""")
def origins_of(spark, sf):
    """Where the first of two markers is in the normal form and in the text, of texts whose form is longer than they are."""
    rows = _table(spark, sf, "documents").select("doc_id", F.replace(_body(), F.lit("ss"), F.lit("ß")).alias("text"))
    at = origins.located(F.col("form"), ("license", "the"))
    return rows.select("doc_id", origins.form(F.col("text")).alias("form")).select("doc_id", at.alias("x")).select(
        "doc_id", F.coalesce("x.place", F.lit(-1)).alias("place"), F.coalesce("x.origin", F.lit(-1)).alias("origin"))


@q("f30_board", """WITH p AS (SELECT p_partkey AS id, upper(p_name) AS n, concat(upper(substr(p_name, 1, 1)), upper(substr(split_part(p_name, ' ', 2), 1, 1)), chr(CAST(65 + p_partkey % 26 AS INT))) AS short FROM part)
    SELECT id, CASE id % 7 WHEN 0 THEN short WHEN 3 THEN concat('reserva ', id % 5) WHEN 4 THEN concat('INSTITUTO ', n, ' - ', short) WHEN 6 THEN concat('reserva ', id % 5) ELSE concat('INSTITUTO ', n) END AS board FROM p""")
def boards(spark, sf):
    """Organising bodies with an acronym after a dash, alone, after a heading, without a label, with a hyphen, over two lines, and too far
    from the label."""
    k, name = F.col("p_partkey"), F.upper("p_name")
    short = F.concat(F.upper(F.substring("p_name", 1, 1)), F.upper(F.substring(F.substring_index("p_name", " ", -1), 1, 1)), F.char(F.lit(65) + k % 26))
    body, label = F.concat(F.lit("INSTITUTO "), name), F.element_at(F.array(*[F.lit(x) for x in ("A Banca Examinadora é", "Empresa organizadora:", "a responsabilidade técnica e operacional caberá ao")]), (k % 3 + 1).cast("int"))
    said = lambda *parts: F.concat(F.lit("Seleção de 2026. "), *[F.lit(x) if isinstance(x, str) else x for x in parts])
    shown = (F.when(k % 7 == 0, said(label, " o ", body, " – ", short, ", na forma da lei")).when(k % 7 == 1, said(label, " o ", body, ", na forma da lei"))
             .when(k % 7 == 2, said(label, " no EDITAL DE ABERTURA; o ", body, ".")).when(k % 7 == 3, said("o ", body, " fará as provas")).when(k % 7 == 4, said(label, " ", body, " - ", short, ";"))
             .when(k % 7 == 5, said(label, "\n  ", F.replace(body, F.lit(" "), F.lit("\n ")), "; e outros")).otherwise(said(label, F.repeat(F.lit(" texto comum"), 30), " ", body, ".")))
    return _table(spark, sf, "part").select(k.alias("id"), parse.board(shown, F.concat(F.lit("reserva "), (k % 5).cast("string"))).alias("board"))


@q("f52_lock_key", """WITH RECURSIVE r AS (SELECT n_name, CAST(0 AS BIGINT) AS i, CAST(4294967295 AS BIGINT) AS c FROM nation
      UNION ALL SELECT n_name, i + 1, xor(x >> 1, CASE WHEN x % 2 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END) FROM (SELECT *, CASE WHEN i % 8 = 0 THEN xor(c, CAST(ascii(substr(n_name, i // 8 + 1, 1)) AS BIGINT)) ELSE c END AS x FROM r WHERE i < 8 * length(n_name)))
    SELECT n_name, CAST(xor(c, CAST(4294967295 AS BIGINT)) & 2147483647 AS BIGINT) AS key FROM r WHERE i = 8 * length(n_name)""")
def lock_keys(spark, sf):
    return _table(spark, sf, "nation").select("n_name", text.lock_key(F.col("n_name")).alias("key"))
