"""Answers of a model, as column expressions: the contract, and what an answer may fill in.

An answer is data from outside: each level is read by its own schema, and what is not of the expected
shape is null there, so a malformed answer yields nothing and never fails a query.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import parse, verify
from tidemark.functions.text import let

# ---------------------------------------------------------------- fixed values
FILLABLE = (
    "edital_number", "publication_date", "registration_start", "registration_deadline", "exam_date", "application_fee",
    "fee_exemption_deadline", "payment_deadline", "organizing_board", "validity", "official_application_url")
NOT_JSON, NOT_AN_OBJECT = "Resposta nao e JSON valido", "Resposta JSON nao e um objeto"
MOST_SURE, QUOTE, LEAST_QUOTE, POSITIONS, LOCATED = 0.9, 400, 25, 60, 0.85


def _problem(raw: Column) -> Column:
    broken = F.try_parse_json(raw).isNull()
    return F.when(broken, NOT_JSON).when(~F.ltrim(raw).startswith("{"), NOT_AN_OBJECT)


def _positions(raw: Column) -> Column:
    """The first objects of the answer's list, as JSON."""
    all_ = F.from_json(F.get_json_object(raw, "$.positions"), "array<string>")
    return F.slice(F.filter(F.coalesce(all_, F.array().cast("array<string>")), lambda p: F.coalesce(F.ltrim(p).startswith("{"), F.lit(False))), 1, POSITIONS)


def payload(raw: Column) -> Column:
    """(fields, positions, problem) of an answer. Fields are the known ones that were found and come with
    a quote: value, confidence (at most 0.9) and evidence (400 characters)."""
    entries = F.map_entries(F.coalesce(F.from_json(F.get_json_object(raw, "$.fields"), "map<string,string>"), F.create_map().cast("map<string,string>")))
    read = F.transform(entries, lambda e: F.struct(e["key"].alias("name"), F.from_json(e["value"], "value string, status string, confidence string, raw_evidence string").alias("c")))
    usable = F.filter(read, lambda e: e["name"].isin(*FILLABLE) & (F.upper(F.coalesce(e["c"]["status"], F.lit(""))) == "FOUND")
                      & ~F.coalesce(e["c"]["value"], F.lit("")).isin("", "[]") & (F.coalesce(e["c"]["raw_evidence"], F.lit("")) != ""))
    fields = F.map_from_entries(F.transform(usable, lambda e: F.struct(e["name"], F.struct(
        e["c"]["value"].alias("value"), F.greatest(F.lit(0.0), F.least(F.lit(MOST_SURE), F.coalesce(e["c"]["confidence"].try_cast("double"), F.lit(0.0)))).alias("confidence"),
        F.substring(e["c"]["raw_evidence"], 1, QUOTE).alias("evidence")))))
    return F.struct(fields.alias("fields"), _positions(raw).alias("positions"), _problem(raw).alias("problem"))


def located(raw: Column) -> Column:
    """(name, claims) of the positions that a model says it has found; a claim (value, evidence) is kept
    if it quotes 25 characters or more, a position if any claim is."""

    def claims(p: Column) -> Column:
        entries = F.map_entries(F.coalesce(F.from_json(F.get_json_object(p, "$.fields"), "map<string,string>"), F.create_map().cast("map<string,string>")))
        read = F.transform(entries, lambda e: F.struct(e["key"].alias("k"), F.from_json(e["value"], "value string, raw_evidence string").alias("c")))
        kept = F.filter(read, lambda e: F.coalesce(F.length(e["c"]["raw_evidence"]) >= LEAST_QUOTE, F.lit(False)))
        return F.map_from_entries(F.transform(kept, lambda e: F.struct(e["k"], F.struct(e["c"]["value"].alias("value"), F.substring(e["c"]["raw_evidence"], 1, QUOTE).alias("evidence")))))

    found = F.transform(_positions(raw), lambda p: F.struct(F.trim(F.coalesce(F.get_json_object(p, "$.name"), F.lit(""))).alias("name"), claims(p).alias("claims")))
    return F.filter(found, lambda p: (p["name"] != "") & (F.size(p["claims"]) > 0))


def fill_gaps(record: dict[str, Column], fields: Column) -> Column:
    """(values, applied): every field of ``record`` as text, gaps filled from an answer's ``fields``; dates
    must be readable as dates. ``applied`` names what was filled."""
    offered = {}
    for name in record:
        said = F.try_element_at(fields, F.lit(name))["value"] if name in FILLABLE else F.lit(None).cast("string")
        offered[name] = parse.parse_date(said).cast("string") if name.endswith(("_date", "_start", "_deadline")) else said
    values = F.struct(*[F.coalesce(now.cast("string"), offered[name]).alias(name) for name, now in record.items()])
    applied = F.array_compact(F.array(*[F.when(now.isNull() & offered[name].isNotNull(), name) for name, now in record.items()]))
    return F.struct(values.alias("values"), applied.alias("applied"))


def apply_to_position(position: dict[str, Column], claims: Column, document: Column) -> Column:
    """An array of (field, status, value, confidence), one for each claim about a field that ``position``
    lacks: only what the document says and the field's own parser reads is confirmed, at 0.85."""

    def judged(field: str, now: Column) -> Column:
        claim = F.try_element_at(claims, F.lit(field))
        return F.when(now.isNull() & claim.isNotNull(), let(verify.verify(field, claim["value"], claim["evidence"], document), lambda v: F.struct(
            F.lit(field).alias("field"), v["status"].alias("status"), v["value"].alias("value"), F.when(v["status"] == "CONFIRMED", LOCATED).alias("confidence"))))

    return F.array_compact(F.array(*[judged(f, now) for f, now in position.items() if f in verify.VERIFIERS]))
