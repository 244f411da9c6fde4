"""Status, qualification and eligibility rules as column expressions; ``today`` is an argument."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import has_any, normalise, plain

#: Fixed values.
TERMINAL = ("CANCELLED", "SUSPENDED", "HOMOLOGATED", "EXPIRED")
CLOSED = ("REGISTRATION_CLOSED", "EXAM_SCHEDULED")
CITY, IDEAL_HOURS, GOOD_HOURS, FRESH_DAYS, ACCEPTED = "Rio Branco", 20, 30, 90, ("high_school",)
THRESHOLDS = {"registration": (7, 3, 1, 0), "exam": (14, 7, 3, 1, 0), "fee_exemption": (3, 1, 0), "payment": (1, 0)}


def effective_status(status: Column, start: Column, deadline: Column, exam: Column, today: date) -> Column:
    """Terminal states stay; a past deadline means exam ahead or closed; an interval that holds today means open."""
    t = F.lit(today)
    return (F.when(status.isin(*TERMINAL), status).when((t > deadline) & (t <= exam), "EXAM_SCHEDULED").when(t > deadline, "REGISTRATION_CLOSED")
            .when(t.between(start, deadline), "REGISTRATION_OPEN").otherwise(status))


def accepting(effective: Column, deadline: Column, today: date) -> Column:
    """Candidates may still apply: neither ended nor past its deadline."""
    return ~effective.isin(*TERMINAL, *CLOSED) & F.coalesce(deadline >= F.lit(today), F.lit(True))


def status_escalated(before: Column, now: Column) -> Column:
    return F.coalesce(now.isin("CANCELLED", "SUSPENDED", "REGISTRATION_OPEN", "EXAM_SCHEDULED") & ~now.eqNullSafe(before), F.lit(False))


def qualification(requirements: Column) -> Column:
    """(category, education, extras) of a requirement text."""
    t = normalise(F.coalesce(requirements, F.lit("")))
    higher = has_any(t, ("nivel superior", "graduacao", "licenciatura", "bacharel"))
    school = has_any(t, ("ensino medio", "nivel medio", "2 grau"))
    technical = has_any(t, ("tecnico em", "curso tecnico", "formacao tecnica"))
    registered = has_any(t, ("registro", "conselho", "corem", "coren")) & has_any(t, ("conselho", "orgao de classe", "registro profissional"))
    licence = has_any(t, ("cnh", "habilitacao categoria", "carteira nacional"))
    other = has_any(t, ("prolibras", "proficiencia", "experiencia", "curso de formacao", "educacao profissional", "residir", "idade maxima"))
    category = (F.when(licence, "HIGH SCHOOL + DRIVER/LICENSE REQUIREMENT").when(registered, "HIGH SCHOOL + PROFESSIONAL REGISTRATION")
                .when(technical, "HIGH SCHOOL + TECHNICAL QUALIFICATION").when(other, "OTHER ADDITIONAL REQUIREMENT").otherwise("HIGH SCHOOL ONLY"))
    extras = F.array_compact(F.array(
        F.when(technical, "Curso técnico"), F.when(registered, "Registro profissional"), F.when(licence, "CNH/licença"),
        F.when(other, "Qualificação/condição adicional: consultar requisito integral")))
    none = F.array().cast("array<string>")
    return F.struct(
        F.when(t == "", "UNKNOWN").when(higher, "OTHER ADDITIONAL REQUIREMENT").when(school, category).otherwise("UNKNOWN").alias("category"),
        F.when(t == "", None).when(higher, "higher_education").when(school, "high_school").when(t.contains("fundamental"), "primary").alias("education"),
        F.when(t == "", none).when(higher, F.array(requirements)).when(school, extras).otherwise(none).alias("extras"))


def workload(hours: Column) -> Column:
    return F.when(hours.isNull(), "UNKNOWN").when(hours <= IDEAL_HOURS, "PERFECT").when(hours <= GOOD_HOURS, "GOOD").otherwise("OUTSIDE TARGET")


def rank(score: Column) -> Column:
    return F.when(score >= 90, "EXCELLENT").when(score >= 75, "VERY GOOD").when(score >= 60, "REVIEW").otherwise("LOW PRIORITY")


def evaluate(o: dict[str, Column], today: date, city: str = CITY) -> Column:
    """All that the filter says of one position of one opportunity, as a struct.

    ``o``: weekly, location, possible_locations, assignment_confirmed, education,
    qualification_category, additional_qualifications, status, start, deadline, exam,
    publication_date, employment_type, conflicts (a number), trust_level, evidence (status and
    confidence of education, requirements, location and workload: an array of structs, or a list of pairs
    of columns). possible_locations may be left out.
    """
    t, no = F.lit(today), F.lit(False)
    truth = lambda c: F.coalesce(c, no)
    kind = workload(o["weekly"])
    there = normalise(o["location"]).contains(plain(city))
    if "possible_locations" in o:
        there = truth(there) | truth(F.exists(F.array_compact(o["possible_locations"]), lambda p: normalise(p).contains(plain(city))))
    local = truth(o["assignment_confirmed"] & there)
    school = truth(o["education"].isin(*ACCEPTED))
    only = truth(o["qualification_category"] == "HIGH SCHOOL ONLY")
    if "additional_qualifications" in o:
        only = only & truth(F.size(o["additional_qualifications"]) == 0)
    state = effective_status(o["status"], o["start"], o["deadline"], o["exam"], today)
    doubt, sure, least_sure = _weighed(o["evidence"])
    conflict = truth(o["conflicts"] > 0) | truth(doubt)
    dated = truth(o["publication_date"] <= t)
    fresh = dated & truth(F.datediff(t, o["publication_date"]) <= FRESH_DAYS)
    open_now = state == "REGISTRATION_OPEN"
    actionable = open_now | ((state == "EDITAL_PUBLISHED") & fresh & F.coalesce(o["deadline"] >= t, F.lit(True)))
    points = lambda c, n, m=0: F.when(c, n).otherwise(m)
    raw = (points(local, 30, -20) + points(school & only, 25) + points(only, 0, -15)
           + F.when(kind == "PERFECT", 25).when(kind == "GOOD", 15).when(kind == "UNKNOWN", 5).otherwise(-25)
           + F.when(o["employment_type"] == "PERMANENT", 10).when(o["employment_type"] == "TEMPORARY", -10).otherwise(0)
           + points(open_now, 7) + points(o["exam"].isNotNull(), 3))
    score = F.greatest(F.lit(0), F.least(F.lit(100), raw))
    trusted = truth(o["trust_level"] <= 2)
    eligible = local & school & only & (kind != "OUTSIDE TARGET")
    reasons = F.array_compact(F.array(
        F.when(local, f"Lotação confirmada em {city}").otherwise(f"Lotação em {city} não confirmada"),
        F.when(school & only, "Ensino médio sem qualificação adicional").otherwise("Escolaridade/requisitos fora do filtro principal ou não confirmados"),
        F.concat(F.lit("Carga horária: "), _workload_label(kind)),
        F.when(conflict, "Conflito de evidências: revisão necessária"),
        F.when(~actionable, "Sem inscrições abertas ou edital recente acionável"),
        F.when(~dated, "Data de publicação não confirmada")))
    return F.struct(
        eligible.alias("eligible"), (eligible & actionable & dated & trusted & ~conflict).alias("primary_alert"), kind.alias("workload"),
        score.alias("score"), rank(score).alias("rank"), state.alias("state"),
        F.when(trusted & (sure >= 3) & truth(least_sure >= 0.9) & ~conflict, "HIGH").when(trusted & (sure >= 1) & ~conflict, "MEDIUM").otherwise("LOW").alias("confidence"),
        (~local | ~school | o["weekly"].isNull() | conflict | ~dated).alias("needs_review"), reasons.alias("reasons"))


def _weighed(evidence) -> tuple[Column, Column, Column]:
    """Whether any evidence is in doubt, how many facts were found, and the least confidence of those."""
    truth = lambda c: F.coalesce(c, F.lit(False))
    doubted, found = (lambda s: truth(s.isin("CONFLICTING", "AMBIGUOUS"))), (lambda s: truth(s == "FOUND"))
    if isinstance(evidence, list):
        doubt, sure = F.lit(False), F.lit(0)
        for status, _ in evidence:
            doubt, sure = doubt | doubted(status), sure + F.when(found(status), 1).otherwise(0)
        return doubt, sure, F.least(*[F.when(found(s), c) for s, c in evidence], F.lit(None).cast("double"))
    known = F.transform(F.filter(evidence, lambda e: found(e["status"])), lambda e: e["confidence"])
    return F.exists(evidence, lambda e: doubted(e["status"])), F.size(known), F.array_min(known)


def _workload_label(kind: Column) -> Column:
    from tidemark.functions.present import WORKLOAD, label

    return label(kind, WORKLOAD)


def fired_threshold(kind: Column, due: Column, today: date, catch_up: bool = False) -> Column:
    """The reminder threshold that a due date meets today; null if none. ``catch_up`` also gives
    the next lower threshold to a day between two."""
    left = F.datediff(due, F.lit(today))
    out = F.lit(None).cast("int")
    for name, days in THRESHOLDS.items():
        hit = F.when(left.isin(*days), left)
        if catch_up:
            hit = F.array_min(F.filter(F.array(*[F.lit(d) for d in days]), lambda d: d >= left))
        out = F.when((kind == name) & (left >= 0), hit).otherwise(out)
    return out
