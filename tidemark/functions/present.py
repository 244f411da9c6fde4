"""Values and messages as people read them (Brazilian Portuguese), as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import utf16_units

# ---------------------------------------------------------------- fixed values
WORKLOAD = {"PERFECT": "PERFEITA (≤20h)", "GOOD": "BOA (21–30h)", "UNKNOWN": "NÃO CONFIRMADA", "OUTSIDE TARGET": "FORA DO ALVO (>30h)"}
EMPLOYMENT = {
    "PERMANENT": "Cargo público efetivo", "PUBLIC_EMPLOYMENT": "Emprego público (CLT)", "SELECTION": "Processo seletivo",
    "TEMPORARY": "CONTRATO TEMPORÁRIO", "UNKNOWN": "Vínculo não confirmado"}
QUALIFICATION = {
    "HIGH SCHOOL ONLY": "Nenhuma além do ensino médio",
    "HIGH SCHOOL + TECHNICAL QUALIFICATION": "Ensino médio + curso técnico",
    "HIGH SCHOOL + PROFESSIONAL REGISTRATION": "Ensino médio + registro profissional",
    "HIGH SCHOOL + DRIVER/LICENSE REQUIREMENT": "Ensino médio + CNH",
    "OTHER ADDITIONAL REQUIREMENT": "Outra exigência adicional", "UNKNOWN": "Não confirmada"}
EDUCATION = {"primary": "Ensino fundamental", "high_school": "Ensino médio", "higher_education": "Ensino superior"}
STATUS = {
    "EXPECTED": "Previsto", "AUTHORIZED": "Autorizado", "BOARD_SELECTED": "Banca definida", "EDITAL_PUBLISHED": "Edital publicado",
    "REGISTRATION_OPEN": "Inscrições abertas", "REGISTRATION_CLOSED": "Inscrições encerradas", "EXAM_SCHEDULED": "Prova marcada",
    "IN_PROGRESS": "Em andamento", "HOMOLOGATED": "Homologado", "SUSPENDED": "SUSPENSO", "CANCELLED": "CANCELADO", "EXPIRED": "Expirado"}
TITLES = {
    "NEW_OPPORTUNITY": "NOVA OPORTUNIDADE — RIO BRANCO", "REGISTRATION_OPEN": "INSCRIÇÕES ABERTAS", "CHANGE": "ALTERAÇÃO EM OPORTUNIDADE",
    "DEADLINE": "PRAZO SE APROXIMANDO", "WORKLOAD_KNOWN": "CARGA HORÁRIA CONFIRMADA", "SYSTEM": "PROBLEMA NA INFRAESTRUTURA"}
DEADLINES = {
    "registration": "ENCERRAMENTO DAS INSCRIÇÕES", "exam": "DATA DA PROVA", "fee_exemption": "PRAZO DE ISENÇÃO DA TAXA",
    "payment": "PRAZO DE PAGAMENTO DA TAXA"}
UNSAID = "não informado"
MESSAGE_UNITS, REPLY_UNITS = 4096, 3900


def stripped(text: Column) -> Column:
    """Without the white space at its end, line ends included."""
    return F.regexp_replace(text, r"\s+$", "")


def label(code: Column, table: dict[str, str]) -> Column:
    """The label of a code; an unknown code stays as it is."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), code), code)


def number(value: Column) -> Column:
    """Two decimals, comma, points between thousands."""
    return F.translate(F.format_number(value.cast("decimal(20,2)"), 2), ",.", ".,")


def money(value: Column) -> Column:
    return F.coalesce(F.concat(F.lit("R$ "), number(value)), F.lit(UNSAID))


def day(value: Column) -> Column:
    return F.coalesce(F.date_format(value, "dd/MM/yyyy"), F.lit(UNSAID))


def period(start: Column, end: Column) -> Column:
    return (F.when(start.isNotNull() & end.isNotNull(), F.concat_ws(" a ", day(start), day(end)))
            .when(end.isNotNull(), F.concat(F.lit("até "), day(end)))
            .when(start.isNotNull(), F.concat(F.lit("a partir de "), day(start))).otherwise(UNSAID))


def short_number(value: Column) -> Column:
    """A number without needless zeros."""
    return F.regexp_replace(F.regexp_replace(number(value), "0+$", ""), ",$", "")


def flag(value: Column) -> Column:
    return F.when(value.isNull(), UNSAID).when(value, "sim").otherwise("não")


def local_time(moment: Column, zone: str) -> Column:
    return F.date_format(F.from_utc_timestamp(moment, zone), "dd/MM/yyyy HH:mm")


def utc_cron(local: Column | str, zone: str, day: str = "2026-09-14") -> Column:
    """A local HH:MM as a daily UTC cron line, by the zone's offset on ``day``; null for what is no time."""
    said = F.lit(local) if isinstance(local, str) else local
    at = F.to_utc_timestamp(F.try_to_timestamp(F.concat(F.lit(f"{day} "), said), F.lit("yyyy-MM-dd HH:mm")), zone)
    return F.when(at.isNotNull(), F.concat_ws(" ", F.minute(at).cast("string"), F.hour(at).cast("string"), F.lit("* * *")))


def truncate(message: Column, limit: int = MESSAGE_UNITS) -> Column:
    """A message within the limit of UTF-16 units; a longer one is cut and says so."""
    cut = stripped(F.decode(F.substring(F.encode(message, "UTF-16LE"), 1, 2 * (limit - 30)), "UTF-16LE"))
    return F.when(utf16_units(message) <= limit, message).otherwise(F.concat(cut, F.lit("\n\n[mensagem truncada]")))


def lines(*rows: tuple[str, Column]) -> Column:
    """Label and value on lines of their own, an empty line after each; null values are left out."""
    return F.array_join(F.filter(F.array(*[F.concat(F.lit(f"{name}\n"), value, F.lit("\n")) for name, value in rows]), lambda x: x.isNotNull()), "\n")


def opportunity_message(o: dict[str, Column], category: str = "NEW_OPPORTUNITY") -> Column:
    """The alert about one position; ``o`` gives the columns by name."""
    extras = F.array_join(o["additional_qualifications"], "; ")
    qualification = F.when(o["qualification_category"] == "HIGH SCHOOL ONLY", "Nenhuma").otherwise(
        F.concat_ws(" — ", label(o["qualification_category"], QUALIFICATION), F.nullif(extras, F.lit(""))))
    body = lines(
        ("Instituição:", o["institution"]), ("Certame:", o["name"]), ("Cargo:", o["position"]),
        ("Tipo de vínculo:", label(o["employment_type"], EMPLOYMENT)),
        ("Escolaridade:", F.coalesce(label(o["education"], EDUCATION), F.lit("não confirmada"))),
        ("Qualificação adicional:", qualification),
        ("Lotação:", F.when(o["assignment_confirmed"], F.concat(o["location"], F.lit("/AC"))).otherwise(F.coalesce(o["location"], F.lit("não confirmada")))),
        ("Carga horária:", F.coalesce(F.concat(short_number(o["weekly"]), F.lit("h/semana")), F.lit("não confirmada — em investigação"))),
        ("Remuneração:", money(o["salary"])), ("Vagas:", F.coalesce(o["vacancies"].cast("string"), F.lit(UNSAID))),
        ("Inscrições:", period(o["start"], o["deadline"])), ("Taxa de inscrição:", money(o["fee"])), ("Prova:", day(o["exam"])),
        ("Situação:", label(o["status"], STATUS)), ("Classificação de carga horária:", label(o["workload"], WORKLOAD)),
        ("Compatibilidade:", F.concat(o["score"].cast("string"), F.lit("/100 ("), o["rank"], F.lit(")"))), ("Confiança da informação:", o["confidence"]))
    return truncate(F.concat(F.lit(TITLES[category] + "\n\n"), stripped(body)))


def deadline_message(institution: Column, name: Column, kind: Column, due: Column, days: Column) -> Column:
    when = F.when(days == 0, "é hoje").when(days == 1, "em 1 dia").otherwise(F.concat(F.lit("em "), days.cast("string"), F.lit(" dias")))
    head = F.concat(F.lit(TITLES["DEADLINE"] + "\n"), label(kind, DEADLINES), F.lit(" "), when, F.lit("\n\n"))
    return truncate(F.concat(head, stripped(lines(("Instituição:", institution), ("Certame:", name), ("Data:", day(due))))))


def system_message(title: Column, detail: Column, actions: Column) -> Column:
    todo = F.when(F.size(actions) > 0, F.concat(F.lit("\n\nO que fazer:\n"), F.array_join(F.transform(actions, lambda a: F.concat(F.lit("- "), a)), "\n"))).otherwise("")
    return truncate(F.concat(F.lit(TITLES["SYSTEM"] + "\n\n"), title, F.lit("\n\n"), F.trim(detail), todo))
