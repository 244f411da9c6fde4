"""Checks of claims against a document's own words, and excerpts for a model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import parse
from tidemark.functions.text import let, normalise

MIN_QUOTE, MAX_QUOTE = 25, 400
BEFORE, AFTER, BUDGET, SPANS = 600, 2400, 22_000, 40

#: Fields that a claim may be about, with the parser that must agree, and the tolerance.
VERIFIERS: dict[str, tuple[Callable[[Column], Column], float | None]] = {
    "weekly_workload": (parse.weekly_workload, 0.01),
    "education": (parse.education, None),
    "salary": (parse.parse_money, 0.05),
    "vacancies": (parse.vacancies, 0.01),
}


def quote_is_real(document: Column, quote: Column) -> Column:
    """A quote of 25 characters or more whose normal form the document's holds. One that the document holds as it is
    needs no normal form of the document."""
    def held(said: Column) -> Column:
        return let(normalise(said), lambda needle: (needle != "") & (F.contains(document, said) | normalise(document).contains(needle)))

    return F.coalesce((F.length(quote) >= MIN_QUOTE) & let(F.substring(quote, 1, MAX_QUOTE), held), F.lit(False))


def verify(field: str, proposed: Column, quote: Column, document: Column) -> Column:
    """(status, value): CONFIRMED, PARSER_DISAGREES, QUOTE_NOT_FOUND, or REJECTED for other fields."""
    if field not in VERIFIERS:
        return F.struct(F.lit("REJECTED").alias("status"), F.lit(None).cast("string").alias("value"))
    parser, tolerance = VERIFIERS[field]

    def judged(quote: Column, read: Column) -> Column:
        if tolerance is None:
            same = normalise(proposed) == normalise(read)
        else:
            same = F.abs(proposed.try_cast("double") - read.cast("double")) < tolerance
        agrees = read.isNotNull() & (proposed.isNull() | F.coalesce(same, F.lit(False)))
        status = F.when(~quote_is_real(document, quote), "QUOTE_NOT_FOUND").when(agrees, "CONFIRMED").otherwise("PARSER_DISAGREES")
        return let(status, lambda s: F.struct(s.alias("status"), F.when(s == "CONFIRMED", read.cast("string")).alias("value")))

    return let(quote, lambda said: let(parser(said), lambda read: judged(said, read)))


def merged_spans(spans: Column) -> Column:
    """Overlapping (a, b) pairs merged, in order, in one fold over the sorted array."""
    start = F.array().cast("array<struct<a:int,b:int>>")

    def add(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], s["b"]).alias("b"))))
        return F.when((F.size(done) > 0) & (s["a"] <= last["b"]), joined).otherwise(F.concat(done, F.array(F.struct(s["a"].alias("a"), s["b"].alias("b")))))

    return F.aggregate(F.array_sort(spans), start, add)


def focus_excerpt(document: Column, folded: Column, patterns: Column, budget: int = BUDGET) -> Column:
    """The regions of a document around the places where any of ``patterns`` (over the fold)
    occurs, merged, at most ``budget`` characters; its beginning where none occurs."""
    found = F.flatten(F.transform(patterns, lambda p: F.transform(
        F.slice(_places(folded, p), F.lit(1), F.lit(SPANS)),
        lambda at: F.struct(F.greatest(F.lit(0), at - BEFORE).cast("int").alias("a"), (at + AFTER).cast("int").alias("b")))))
    spans = merged_spans(F.slice(found, F.lit(1), F.lit(SPANS)))
    pieces = F.transform(spans, lambda s: F.substring(document, s["a"] + 1, s["b"] - s["a"]))
    zero = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("out"))

    def take(acc: Column, p: Column) -> Column:
        part = F.substring(p, F.lit(1), F.greatest(F.lit(0), F.lit(budget) - acc["used"]))
        return F.struct((acc["used"] + F.length(part)).alias("used"), F.when(part == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(part))).alias("out"))

    joined = F.array_join(F.aggregate(pieces, zero, take)["out"], "\n[...]\n")
    return F.when(F.size(found) > 0, joined).otherwise(F.substring(document, 1, budget))


def _places(folded: Column, pattern: Column) -> Column:
    """0-based offsets of all matches: lengths of what a split leaves, summed with the matches'."""
    parts, hits = F.split(folded, pattern), F.regexp_extract_all(folded, pattern, F.lit(0))
    steps = F.zip_with(F.slice(parts, F.lit(1), F.size(hits)), hits, lambda p, h: F.struct(F.length(p).alias("p"), F.length(h).alias("h")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(steps, zero, lambda acc, s: F.struct((acc["at"] + s["p"] + s["h"]).alias("at"), F.concat(acc["out"], F.array(acc["at"] + s["p"])).alias("out")))["out"]


#: Outcomes of a check, in the order they are counted.
OUTCOMES = ("CONFIRMED", "QUOTE_NOT_FOUND", "PARSER_DISAGREES", "REJECTED")


def outcomes(status: Column) -> list[Column]:
    """Aggregates that count checks by outcome; those that do not occur are 0, other statuses are not counted."""
    return [F.count_if(status == name).alias(name.lower()) for name in OUTCOMES]
