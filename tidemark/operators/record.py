"""The record of an opportunity after all documents about it, and its snapshots.

``drafts`` is one row a document: entity, seq (order of arrival), trust, source_id, has_table, document_type,
employment_type, stages, name, institution, evidence, content_hash, and the columns of FIELDS. What a
document may overwrite follows from its authority; the rules of a sequential fold are windows here.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.score import effective_status
from tidemark.operators import history, merge

#: Fields that documents fill and contest.
FIELDS = (
    "edital_number", "publication_date", "employment_regime", "organizing_board", "registration_start", "registration_deadline",
    "exam_date", "exam_location", "application_fee", "fee_exemption", "fee_exemption_deadline", "payment_deadline", "validity",
    "official_edital_url", "official_institution_url", "official_application_url", "organizing_board_url")
EVENTS = {"CANCELLATION": "CANCELLED", "SUSPENSION": "SUSPENDED", "REOPENING": "", "EXTENSION": ""}


def claims(drafts: DataFrame) -> DataFrame:
    """The contested fields of all drafts in the long form of :mod:`merge`."""
    there = [c for c in FIELDS if c in drafts.columns]
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in there])
    return drafts.select("entity", "seq", merge.authority(F.col("trust"), F.col("has_table")).cast("int").alias("authority"), F.explode(pairs).alias("p")).select(
        "entity", "seq", "authority", "p.field", "p.value")


def _wide(long: DataFrame, keys: list[str]) -> DataFrame:
    return long.groupBy(*keys).pivot("field", list(FIELDS)).agg(F.first("value"))


def merged(drafts: DataFrame, today: date) -> DataFrame:
    """One row an entity: FIELDS (text), employment_type, stages, name, institution, evidence, sources,
    content_hash, best_trust, best_authority, version, status and conflicts (a number).

    Status follows from the merged record: a cancellation or suspension holds until a reopening or
    extension; otherwise the dates decide, and where they do not, what they decided last."""
    order = Window.partitionBy("entity").orderBy("seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    authority = merge.authority(F.col("trust"), F.col("has_table")).cast("int")
    rows = drafts.withColumn("authority", authority).withColumn("better", F.col("authority") <= F.coalesce(F.min("authority").over(before), F.col("authority")))
    typed = F.col("employment_type") != "UNKNOWN"
    rows = rows.withColumn("_type", typed & (F.col("better") | (F.coalesce(F.max(typed.cast("int")).over(before), F.lit(0)) == 0)))
    named = F.coalesce(F.col("name"), F.lit("")) != ""
    rows = rows.withColumn("_name", named & (F.col("better") | (F.coalesce(F.max(named.cast("int")).over(before), F.lit(0)) == 0)))
    last = lambda c, where: F.max_by(F.col(c), F.when(where, F.col("seq"))).alias(c)
    one = rows.groupBy("entity").agg(
        last("employment_type", F.col("_type")), last("stages", F.size("stages") > 0), last("name", F.col("_name")),
        F.min_by("institution", F.when(F.coalesce("institution", F.lit("")) != "", F.col("seq"))).alias("institution"),
        F.max_by("evidence", "seq").alias("evidence"), F.array_sort(F.collect_set("source_id")).alias("sources"),
        F.max_by("content_hash", "seq").alias("content_hash"), F.min("trust").alias("best_trust"), F.min("authority").alias("best_authority"),
        F.count(F.lit(1)).alias("version")).withColumn("employment_type", F.coalesce("employment_type", F.lit("UNKNOWN")))
    long = claims(drafts)
    clashes = merge.conflicts(long).groupBy("entity").agg(F.count(F.lit(1)).alias("conflicts"))
    state = _status(drafts, long, today)
    return (one.join(_wide(merge.merged(long), ["entity"]), "entity", "left").join(clashes, "entity", "left").join(state, "entity")
            .withColumn("conflicts", F.coalesce("conflicts", F.lit(0))))


def _status(drafts: DataFrame, long: DataFrame, today: date) -> DataFrame:
    dates = ("registration_start", "registration_deadline", "exam_date")
    held = merge.running(long.where(F.col("field").isin(*dates))).groupBy("entity", "seq").pivot("field", list(dates)).agg(F.first("value"))
    kinds = F.create_map(*[F.lit(x) for p in EVENTS.items() for x in p])
    rows = drafts.select("entity", "seq", F.try_element_at(kinds, F.col("document_type")).alias("event")).join(held, ["entity", "seq"], "left")
    derived = effective_status(F.lit("-"), *[F.col(c).cast("date") for c in dates], today)
    rows = rows.withColumn("derived", F.nullif(derived, F.lit("-")))
    last = rows.groupBy("entity").agg(F.max_by(F.struct("event", "seq"), F.when(F.col("event").isNotNull(), F.col("seq"))).alias("e"))
    since = rows.join(last, "entity").where(F.col("e.seq").isNull() | (F.col("seq") >= F.col("e.seq")))
    return since.groupBy("entity").agg(
        F.coalesce(F.nullif(F.first("e.event"), F.lit("")), F.max_by("derived", F.when(F.col("derived").isNotNull(), F.col("seq"))), F.lit("EDITAL_PUBLISHED")).alias("status"))


def snapshots(drafts: DataFrame) -> DataFrame:
    """(scope, entity, version, field, value): the contested fields as they stood after every document,
    which is what :func:`history.changes` compares."""
    n = F.dense_rank().over(Window.partitionBy("entity").orderBy("seq"))
    return merge.running(claims(drafts)).select(F.lit("opportunity").alias("scope"), "entity", n.alias("version"), "field", "value")


def changes(drafts: DataFrame) -> DataFrame:
    """Field changes between consecutive states of the record."""
    return history.changes(snapshots(drafts))


def snapshot(record: DataFrame, positions: DataFrame) -> DataFrame:
    """(entity, snapshot): the record and its positions (entity, slug, ...) as JSON, by slug, nulls kept."""
    own = ["slug", *[c for c in positions.columns if c not in ("entity", "slug")]]
    lists = positions.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct(*own))).alias("positions"))
    both = record.join(lists, "entity", "left")
    body = F.struct(*[F.col(c) for c in record.columns if c != "entity"], "positions")
    return both.select("entity", F.to_json(body, {"ignoreNullFields": "false"}).alias("snapshot"))
