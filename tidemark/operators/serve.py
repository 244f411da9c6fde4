"""The query surface: routing of requests, search pages, cards, histories, decisions and the report.

Requests are rows, so answers are joins: a batch of messages is answered in one plan, and the same
expressions serve a stream through foreachBatch. No request is executed one by one.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import present
from tidemark.functions.text import fold, has_any, normalise, spaced, utf16_units
from tidemark.operators import index
from tidemark.sources.store import staged

#: Commands, and plain phrases that mean one.
COMMANDS = ("vagas", "meus", "prazos", "status", "fontes", "buscar", "cargo", "historico", "nota", "esquecer", "salvar", "inscrito", "descartar", "ajuda")
ALIASES = {"start": "ajuda", "help": "ajuda"}
PHRASES = {"oi": "ajuda", "ola": "ajuda", "ajuda": "ajuda", "vagas": "vagas", "quais vagas": "vagas", "quais as vagas": "vagas", "prazos": "prazos",
           "quais os prazos": "prazos", "status": "status"}
DECISIONS = {"salvar": "INTERESTED", "inscrito": "REGISTERED", "descartar": "DISMISSED"}
QUESTION_STOPWORDS = (
    "qual quais quanto quantos quando onde como que o a os as e do da dos das de em no na para por um uma tem ter precisa preciso sao sera ser "
    "saber salario salarios ganha remuneracao requisitos requisito jornada horas prova taxa isencao lotacao inscricao data valor cargo me diga "
    "favor quero semanal semanas semana pagar vale pena acha melhor sobre concurso concursos cargos voce eu meu minha diferenca entre mais menos "
    "posso devo fazer ultimo ultima").split()
FACTS = (("salary", ("salario", "ganha", "remuneracao")), ("weekly", ("jornada", "horas", "carga horaria")), ("exam", ("prova",)), ("fee", ("taxa",)),
         ("deadline", ("inscricao", "inscricoes", "prazo")), ("location", ("lotacao", "onde")))
PAGE_SIZE = 5
#: What a summary reads.
SUMMARY = ("cargo", "institution", "eligible", "state", "salary", "weekly", "start", "deadline")


def route(text: Column) -> Column:
    """(command, argument) of a message: a command, a phrase that means one, a question about a fact,
    else free text for a model. A decision is only ever made by its command."""
    trimmed = F.trim(F.coalesce(text, F.lit("")))
    word = F.substring_index(F.lower(F.regexp_extract(trimmed, r"^(\S+)", 1)), "@", 1)
    name = F.regexp_replace(word, "^/", "")
    for a, b in ALIASES.items():
        name = F.when(name == a, b).otherwise(name)
    plain = normalise(trimmed)
    phrase = F.try_element_at(F.create_map(*[F.lit(x) for p in PHRASES.items() for x in p]), plain)
    fact = has_any(plain, [m for _, ms in FACTS for m in ms]) & (F.size(subject(text)) > 0)
    command = (F.when(word.startswith("/"), F.when(name.isin(*COMMANDS), name).otherwise("unknown"))
               .when(phrase.isNotNull(), phrase).when(trimmed == "", "unknown").when(fact, "question").otherwise("free"))
    return F.struct(command.alias("command"), F.trim(F.regexp_replace(trimmed, r"^/\S+\s*", "")).alias("argument"))


def subject(question: Column) -> Column:
    """The words of a question that may name a position."""
    return F.filter(F.split(normalise(F.coalesce(question, F.lit(""))), " "), lambda w: (w != "") & ~w.isin(*QUESTION_STOPWORDS))


def asked_fact(question: Column) -> Column:
    n = normalise(F.coalesce(question, F.lit("")))
    out = F.lit(None).cast("string")
    for field, markers in reversed(FACTS):
        out = F.when(has_any(n, markers), field).otherwise(out)
    return out


def page_request(argument: Column) -> Column:
    """(term, page) of a search argument; a page below one is null."""
    page = F.coalesce(F.nullif(F.regexp_extract(argument, r"--pagina\s+(\d+)\s*$", 1), F.lit("")).try_cast("int"), F.lit(1))
    return F.struct(F.trim(F.regexp_replace(argument, r"\s*--pagina\s+\d+\s*$", "")).alias("term"), F.when(page >= 1, page).alias("page"))


#: What ranks positions.
RANKS = ("eligible", "score", "deadline")


def _order() -> list[Column]:
    return [F.desc("eligible"), F.desc("score"), F.asc_nulls_last("deadline"), F.asc("position")]


def _haystack(pairs: DataFrame) -> DataFrame:
    # words hold no white space, so one normal form of all three serves as well as three
    hay = spaced(F.concat_ws(" ", *[fold(F.col(c)) for c in ("cargo", "institution", "name")]))
    return pairs.select("position", hay.alias("hay"), *RANKS, *[c for c in ("accepting",) if c in pairs.columns])


def haystack(pairs: DataFrame) -> DataFrame:
    """What searches read of ``pairs``, written once: position, hay (the normal form they look into), and what ranks."""
    return staged(_haystack(pairs))


def indexed(looked: DataFrame, only: DataFrame | None = None) -> index.Index:
    """The index that searches of a :func:`haystack` read; kept, it serves any number of batches. ``only`` restricts it
    to grams."""
    return index.build(looked.select("position", "hay"), "position", "hay", only, written=True)


def _holding(asked: DataFrame, looked: DataFrame, kept: index.Index | None) -> DataFrame:
    """(request, position, what ranks) of the positions that hold all words of ``asked`` (request, words, not empty). A batch
    of few words looks into every text once, others into an index."""
    asked = staged(asked.select("request", "words"))
    small = index.few(asked) if kept is None else None
    if small is not None:
        wanted = [(r.request, index.holds(F.col("hay"), r.words)) for r in small]
        return index.scanned(looked, wanted, asked.schema["request"].dataType).select("request", "position", *RANKS)
    found = index.lookup(kept or indexed(looked, index.asked_grams(asked).select("gram").distinct()), asked).withColumnRenamed("key", "position")
    return found.join(looked.select("position", *RANKS), "position").select("request", "position", *RANKS)


def _first(hit: DataFrame, by: str, most: int, name: str) -> DataFrame:
    """The best ``most`` of ``hit`` for each ``by``, with their place: no task sorts more than those."""
    return hit.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*_order()))).where(F.col(name) <= most)


def _ranked(hit: DataFrame, most: int) -> DataFrame:
    """The best ``most`` of ``hit`` for each request, with each position's place among the request's, and their number."""
    hit = staged(hit)
    total = hit.groupBy("request").agg(F.count(F.lit(1)).alias("total"))
    return _first(hit, "request", most, "n").join(total, "request").select("request", "position", "n", "total")


def search(requests: DataFrame, pairs: DataFrame, kept: index.Index | None = None) -> DataFrame:
    """(request, n, total, position): the rows of the page each request (request, argument) asks for.

    All words of the term must occur, inside other words too; an identifier prefix of eight characters or more matches
    alone; no term means all positions. A batch of few words is one pass over the pairs; else words are looked up in an
    index (``kept``, or one of the grams asked for), prefixes by their first eight characters. Requests without a term
    share one order.
    """
    asked = requests.select("request", page_request(F.col("argument")).alias("p")).select("request", normalise(F.col("p.term")).alias("term"), F.col("p.term").alias("raw"), F.col("p.page").alias("page"))
    asked = staged(asked.select("request", "raw", "page", F.filter(F.split("term", " "), lambda w: w != "").alias("words")))
    last, special = asked.where((F.size("words") == 0) & F.col("page").isNotNull()).agg(F.max("page")).first()[0], asked.where((F.size("words") > 0) | (F.length("raw") >= 8))
    small = index.few(special) if kept is None else None
    # a single pass needs no table of the pairs
    looked = _haystack(pairs) if small is not None and last is None else haystack(pairs)
    if small is not None:
        wanted = [(r.request, meets) for r in small for meets in [index.holds(F.col("hay"), r.words)] * bool(r.words) + [F.startswith("position", F.lit(r.raw))] * (len(r.raw) >= 8)]
        hit = index.scanned(looked, wanted, asked.schema["request"].dataType).select("request", "position", *RANKS)
    else:
        words = _holding(asked.where(F.size("words") > 0), looked, kept)
        heads = asked.where(F.length("raw") >= 8).select("request", "raw", F.substring("raw", 1, 8).alias("head"))
        by_id = looked.select("position", *RANKS, F.substring("position", 1, 8).alias("head")).join(heads, "head").where(F.startswith("position", F.col("raw"))).select("request", "position", *RANKS)
        # rows that words and prefix both find are one; rows of one position stay as many as there are
        both = words.select("request", "position").union(by_id.select("request", "position")).distinct()
        hit = both.join(looked.select("position", *RANKS), "position").select("request", "position", *RANKS)
    most = (asked.where(F.col("page").isNotNull()).agg(F.max("page")).first()[0] or 0) * PAGE_SIZE
    ranked = _ranked(hit, most).join(asked.select("request", "page"), "request")
    paged = ranked.where((F.col("n") > (F.col("page") - 1) * PAGE_SIZE) & (F.col("n") <= F.col("page") * PAGE_SIZE)).select("request", "n", "total", "position")
    if last is None:
        return paged
    general = asked.where((F.size("words") == 0) & F.col("page").isNotNull()).select("request", "page")
    top = looked.orderBy(*_order()).limit(last * PAGE_SIZE)  # the pages asked for, and no more
    order = Window.orderBy(*_order())
    total = looked.count()
    rows = top.select("position", F.row_number().over(order).alias("n")).withColumn("page", F.ceil(F.col("n") / PAGE_SIZE).cast("int"))
    return paged.union(general.join(rows, "page").select("request", "n", F.lit(total).cast("long").alias("total"), "position"))


def answered(questions: DataFrame, pairs: DataFrame, choices: int = PAGE_SIZE, kept: index.Index | None = None) -> DataFrame:
    """(request, fact, answer, positions) of factual questions (request, text): the card of the one position
    that a question names, a choice of the best few if it names several, else none. A question that names
    none is about the positions that still accept candidates; nothing is guessed."""
    pairs = haystack(pairs)
    asked = questions.select("request", asked_fact(F.col("text")).alias("fact"), subject(F.col("text")).alias("words")).where("fact is not null")
    ranked = _ranked(_holding(asked.where(F.size("words") > 0), pairs, kept), choices)
    open_ = pairs.where(F.col("eligible") & F.col("accepting")).orderBy(F.desc("score"), F.asc_nulls_last("deadline"), "position")
    few = [r.position for r in open_.select("position", "score", "deadline").limit(choices + 1).collect()]      # choices + 1 rows
    hits = ranked.groupBy("request").agg(F.max("total").alias("total"), F.transform(F.array_sort(F.collect_list(F.struct("n", "position"))), lambda x: x["position"]).alias("positions"))
    general = asked.where(F.size("words") == 0).select("request", "fact", F.lit(len(few)).cast("long").alias("total"), F.array(*[F.lit(p) for p in few[:choices]]).cast("array<string>").alias("positions"))
    special = asked.where(F.size("words") > 0).join(hits, "request", "left").select("request", "fact", F.coalesce("total", F.lit(0)).alias("total"), "positions")
    both = special.union(general)
    kind = F.when(F.col("total") == 0, "none").when(F.col("total") == 1, "card").otherwise("choices")
    return both.select("request", "fact", kind.alias("answer"), F.coalesce("positions", F.array().cast("array<string>")).alias("positions"))


#: Fixed values of a model's context: positions that accept candidates, positions that a question cites, letters from
#: which a word alone may cite, characters.
CONTEXT_OPEN, CONTEXT_CITED, CITING, CONTEXT_CHARS = 10, 6, 4, 24_000


def cited(questions: DataFrame, pairs: DataFrame, most: int = CONTEXT_CITED, kept: index.Index | None = None) -> DataFrame:
    """(request, position, n) of the positions (a :func:`haystack`) that a question (request, text) seems to mention, best
    first: those that hold all its words, or where none does, those of its longer words one after another, each once."""
    asked = staged(questions.select("request", subject(F.col("text")).alias("words")).where(F.size("words") > 0))
    whole = staged(_first(_holding(asked, pairs, kept), "request", most, "n").select("request", "position", "n"))
    single = staged(asked.join(whole.select("request"), "request", "left_anti").select("request", F.posexplode("words").alias("place", "word")).where(F.length("word") >= CITING))
    words = single.select("word").distinct()
    held = _holding(words.select(F.col("word").alias("request"), F.array("word").alias("words")), pairs, kept).withColumnRenamed("request", "word")
    # an ordered union of ``most`` takes at most twice as many of each word: the others may repeat earlier ones
    first = _first(held, "word", 2 * most, "k").select("word", "position", "k")
    each = single.join(first, "word").groupBy("request", "position").agg(F.min(F.struct("place", "k")).alias("at"))
    ranked = each.withColumn("n", F.row_number().over(Window.partitionBy("request").orderBy("at", "position"))).where(F.col("n") <= most)
    return whole.union(ranked.select("request", "position", "n"))


def context(questions: DataFrame, pairs: DataFrame, chars: int = CONTEXT_CHARS, kept: index.Index | None = None) -> DataFrame:
    """(request, positions, context) of free questions (request, text): what a model is told, and nothing else.

    First the best positions that accept candidates, then those the question cites, each once; summaries are joined
    in this order while they fit into ``chars`` characters.
    """
    looked = haystack(pairs)
    open_ = looked.where(F.col("eligible") & F.col("accepting")).orderBy(F.desc("score"), F.asc_nulls_last("deadline"), "position")
    few = [r.position for r in open_.select("position", "score", "deadline").limit(CONTEXT_OPEN).collect()]      # CONTEXT_OPEN rows
    best = questions.select("request", F.posexplode(F.array(*[F.lit(p) for p in few]).cast("array<string>")).alias("n", "position")).select("request", "position", "n")
    rest = cited(questions, looked, kept=kept).where(~F.col("position").isin(few)).select("request", "position", (F.col("n") + CONTEXT_OPEN).alias("n"))
    chosen = staged(best.union(rest))
    some = chosen.select("position").distinct()
    named = [r.position for r in some.limit(index.FEW + 1).collect()]      # FEW + 1 rows at most
    # a filter on few positions goes down to where positions are read, before the rules look at the pairs
    said = pairs.where(F.col("position").isin(named)) if len(named) <= index.FEW else pairs.join(F.broadcast(some) if chosen.count() <= index.SMALL else some, "position", "left_semi")
    lines = chosen.join(said.select("position", summary({c: F.col(c) for c in SUMMARY}).alias("said")), "position").groupBy("request").agg(F.array_sort(F.collect_list(F.struct("n", "position", "said"))).alias("all"))
    zero = F.struct(F.lit(0).alias("used"), F.array().cast("array<struct<position:string,said:string>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        now = a["used"] + F.length(x["said"]) + 2
        fits = (now <= chars + 2) & (a["used"] >= 0)
        return F.struct(F.when(fits, now).otherwise(-1).alias("used"), F.when(fits, F.concat(a["out"], F.array(F.struct(x["position"].alias("position"), x["said"].alias("said"))))).otherwise(a["out"]).alias("out"))

    out = lines.select("request", F.aggregate("all", zero, step)["out"].alias("out"))
    return questions.select("request").join(out, "request", "left").select(
        "request", F.coalesce(F.col("out.position"), F.array().cast("array<string>")).alias("positions"), F.coalesce(F.array_join(F.col("out.said"), "\n\n"), F.lit("")).alias("context"))


def noted(requests: DataFrame, positions: DataFrame, tracking: DataFrame) -> DataFrame:
    """(request, position, status, note) of notes (request, argument: a code and a text): the code is the
    beginning, of eight characters or more, of one position's identifier; a position without a decision
    becomes INTERESTED; a note is 1000 characters at most.

    Codes and identifiers meet in one order: those that begin with a code follow it, so the code's position is the next
    one, unless the one after that begins with it as well. Nothing is paired, and rows move once."""
    trimmed = F.trim("argument")
    code = F.regexp_extract(trimmed, r"^(\S+)", 1)
    asked = requests.select(code.alias("code"), F.lit(False).alias("known"), "request", F.substring(F.regexp_replace(trimmed, r"^\S+\s*", ""), 1, 1000).alias("note")).where("length(code) >= 8 and note <> ''")
    known = positions.where("length(position) >= 8").select("position").distinct().join(tracking.select("position", "status"), "position", "left")
    lines = asked.unionByName(known.select(F.col("position").alias("code"), F.lit(True).alias("known"), "status"), allowMissingColumns=True).withColumn("head", F.substring("code", 1, 8))
    down = Window.partitionBy("head").orderBy(F.desc("code"), F.desc("known")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # the last of the rows so far is the row's own where it is a position, and then knows the one before it
    after = lines.withColumn("other", F.last(F.when(F.col("known"), F.col("code")), True).over(down.rowsBetween(Window.unboundedPreceding, -1)))
    one = F.last(F.when(F.col("known"), F.struct(F.col("code").alias("position"), "status", "other")), True).over(down)
    found = after.withColumn("one", one).where(~F.col("known"))
    only = F.startswith("one.position", F.col("code")) & ~F.coalesce(F.startswith("one.other", F.col("code")), F.lit(False))
    return found.where(only).select("request", "one.position", F.coalesce("one.status", F.lit("INTERESTED")).alias("status"), "note")


def summary(p: dict[str, Column]) -> Column:
    """Five lines about a position."""
    hours = F.coalesce(F.concat(present.short_number(p["weekly"]), F.lit("h/semana")), F.lit("CH não informada"))
    return F.concat_ws("\n", F.concat(F.lit("• "), shortened(p["cargo"], 90)), F.concat(F.lit("  "), shortened(p["institution"], 100)),
                       F.concat(F.lit("  "), F.when(p["eligible"], "compatível com o filtro").otherwise("fora do filtro ou não confirmado"), F.lit(" · "), present.label(p["state"], present.STATUS)),
                       F.concat(F.lit("  "), present.money(p["salary"]), F.lit(" · "), hours),
                       F.concat(F.lit("  Inscrições: "), present.period(p["start"], p["deadline"])))


def shortened(value: Column, limit: int) -> Column:
    """White space collapsed; a longer text ends in an ellipsis."""
    v = F.trim(F.regexp_replace(value, r"\s+", " "))
    return F.when(F.length(v) <= limit, v).otherwise(F.concat(F.rtrim(F.substring(v, 1, limit - 1)), F.lit("…")))


def card(p: dict[str, Column]) -> Column:
    """All that is known of a position, within a reply's units: lines that do not fit are left out
    from the end, the link stays."""
    body = F.array_compact(F.array(
        shortened(p["cargo"], 100), shortened(p["institution"], 140), F.concat(F.lit("Situação: "), present.label(p["state"], present.STATUS)),
        F.concat(F.lit("Salário: "), present.money(p["salary"]), F.lit(" · Jornada: "), F.coalesce(F.concat(present.short_number(p["weekly"]), F.lit("h/semana")), F.lit("não informada"))),
        F.concat(F.lit("Lotação: "), F.coalesce(p["location"], F.lit("não confirmada")), F.when(p["assignment_confirmed"], " (confirmada)").otherwise(" (sem confirmação)")),
        F.concat(F.lit("Vagas: "), F.coalesce(p["vacancies"].cast("string"), F.lit("não informadas"))),
        F.concat(F.lit("Inscrições: "), present.period(p["start"], p["deadline"])), F.concat(F.lit("Prova: "), present.day(p["exam"])),
        F.concat(F.lit("Taxa: "), present.money(p["fee"])), F.concat(F.lit("Vínculo: "), present.label(p["employment_type"], present.EMPLOYMENT)),
        F.concat(F.lit("Avaliação: "), p["score"].cast("string"), F.lit("/100 · confiança "), p["confidence"])))
    return fit(body, F.array(F.lit("Use o código para a ficha completa.")))


def fit(body: Column, tail: Column, limit: int = present.REPLY_UNITS) -> Column:
    """Lines of ``body`` while they fit beside ``tail``, then ``tail``."""
    room = F.lit(limit) - utf16_units(F.array_join(tail, "\n")) - 1
    zero = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("out"), F.lit(True).alias("open"))

    def step(a: Column, line: Column) -> Column:
        n = a["used"] + utf16_units(line) + 1
        take = a["open"] & (n <= room)
        return F.struct(F.when(take, n).otherwise(a["used"]).alias("used"), F.when(take, F.concat(a["out"], F.array(line))).otherwise(a["out"]).alias("out"), take.alias("open"))

    return F.array_join(F.concat(F.aggregate(body, zero, step)["out"], tail), "\n")


def marks(requests: DataFrame, tracking: DataFrame) -> DataFrame:
    """The tracking table after a batch of (position, command, at): marked, or forgotten."""
    new = requests.where(F.col("command").isin(*DECISIONS, "esquecer")).select(
        "position", F.try_element_at(F.create_map(*[F.lit(x) for p in DECISIONS.items() for x in p]), F.col("command")).alias("status"), "at")
    all_ = tracking.select("position", "status", "at").union(new)
    last = all_.groupBy("position").agg(F.max_by(F.struct("status"), "at").alias("s"), F.max("at").alias("at"))
    return last.select("position", F.col("s.status").alias("status"), "at").where("status is not null")


def open_issues(needed: DataFrame, existing: DataFrame) -> DataFrame:
    """One new issue for each source that needs one and has none open."""
    return needed.join(existing.where("open").select("source_id"), "source_id", "left_anti").dropDuplicates(["source_id"]).withColumn(
        "title", F.concat(F.lit("Fonte com problema: "), "source_id"))


def report(pairs: DataFrame, today: date) -> DataFrame:
    """The sections of the daily report as Markdown lines: (section, line, text), from one pass over
    the pairs."""
    t = F.lit(today)
    o = {c: F.col(c) for c in ("cargo", "institution", "eligible", "state", "salary", "weekly", "start", "deadline")}
    line = F.regexp_replace(F.regexp_replace(summary(o), "^• ", "- "), "\n *", " · ")
    wanted = F.array_compact(F.array(
        F.when(F.col("eligible") & (F.col("state") == "REGISTRATION_OPEN"), F.lit("1 Inscrições abertas")),
        F.when(F.col("eligible") & F.col("deadline").between(t, F.date_add(t, 30)), F.lit("2 Prazos em 30 dias")),
        F.when(F.col("eligible") & (F.col("state") == "EXAM_SCHEDULED"), F.lit("3 Provas marcadas")),
        F.when(F.col("eligible") & (F.col("rank") == "EXCELLENT"), F.lit("4 Excelentes")),
        F.when(F.col("eligible") & (F.col("workload") == "UNKNOWN"), F.lit("5 Carga horária desconhecida"))))
    rows = pairs.select(F.explode(wanted).alias("section"), line.alias("text"), "score", "position")
    w = Window.partitionBy("section").orderBy(F.desc("score"), "position")
    return rows.select("section", F.row_number().over(w).alias("line"), "text").where("line <= 25")
