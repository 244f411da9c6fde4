"""Source registry: reconciliation, promotion, and what a configuration row means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.urls import canonical, host_allowed, ok


def problems(specs: DataFrame) -> DataFrame:
    """(id, problem): duplicate ids, unparseable base URLs, empty host lists."""
    twice = specs.groupBy("id").count().where("count > 1").select("id", F.lit("duplicate_id").alias("problem"))
    url = specs.where(~F.coalesce(F.col("base_url").rlike(r"^https?://[^/\s]+"), F.lit(False))).select("id", F.lit("bad_url").alias("problem"))
    hosts = specs.where(F.coalesce(F.size("allowed_hosts"), F.lit(0)) == 0).select("id", F.lit("no_hosts").alias("problem"))
    return twice.union(url).union(hosts)


def reconcile(specs: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, action, enabled): created, updated, unchanged or disabled; nothing is ever deleted."""
    s, t = specs.select("id", F.col("name").alias("n"), F.col("enabled").alias("e")), stored.select("id", F.col("name").alias("m"), F.col("enabled").alias("f"))
    action = (F.when(F.col("m").isNull(), "created").when(F.col("n").isNull(), F.when(F.col("f"), "disabled").otherwise("unchanged"))
              .when((F.col("n") != F.col("m")) | (F.col("e") != F.col("f")), "updated").otherwise("unchanged"))
    return s.join(t, "id", "full_outer").select("id", action.alias("action"), F.coalesce("e", F.lit(False)).alias("enabled"))


def register_candidates(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """Unknown sources to append, with trust 3 and status CANDIDATE."""
    return candidates.join(stored.select("id"), "id", "left_anti").dropDuplicates(["id"]).withColumn("trust_level", F.lit(3)).withColumn("trust_status", F.lit("CANDIDATE"))


def promote(stored: DataFrame, ids: DataFrame) -> DataFrame:
    hit = stored.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    return hit.withColumn("trust_status", F.when(F.col("_hit"), "TRUSTED").otherwise(F.col("trust_status"))).drop("_hit")


def decoded(stored: DataFrame) -> DataFrame:
    """Configuration with defaults for what is absent or zero."""
    return stored.select("id", F.coalesce(F.nullif("max_documents", F.lit(0)), F.lit(40)).alias("max_documents"),
                         F.coalesce(F.nullif("expected_min", F.lit(0)), F.lit(1)).alias("expected_min"))


def candidates_per_source(links: DataFrame, limit: str = "max_documents") -> DataFrame:
    """Links kept of each source: distinct URLs in order of appearance, at most its limit."""
    from pyspark.sql import Window

    first = links.groupBy("source_id", "url").agg(F.min("place").alias("place"), F.first(limit).alias(limit))
    return first.withColumn("n", F.row_number().over(Window.partitionBy("source_id").orderBy("place", "url"))).where(F.col("n") <= F.col(limit))


def index_pages(specs: DataFrame) -> DataFrame:
    """(source_id, place, url): where a source (id, base_url, seed_urls, allowed_hosts) is entered: base and
    seeds in their canonical form, allowed hosts only, each once, in order."""
    all_ = F.concat(F.array("base_url"), F.coalesce("seed_urls", F.array().cast("array<string>")))
    rows = specs.select(F.col("id").alias("source_id"), "allowed_hosts", F.posexplode(all_).alias("place", "raw")).withColumn("url", canonical(F.col("raw")))
    good = rows.where((F.col("url") != "") & host_allowed(F.col("url"), F.col("allowed_hosts")))
    return good.groupBy("source_id", "url").agg(F.min("place").alias("place")).select("source_id", "place", "url")


#: Where a source that yields nothing is looked for, in this order.
RECOVERY = (("rss", "/feed"), ("rss", "/rss"), ("rss", "/feed/"), ("rss", "/index.xml"), ("rss", "/rss.xml"), ("sitemap", "/sitemap.xml"), ("sitemap", "/sitemap_index.xml"))


def recovery_requests(sources: DataFrame) -> DataFrame:
    """(source_id, step, method, url) of every alternative entrance of sources (id, base_url)."""
    steps = F.array(*[F.struct(F.lit(m).alias("method"), F.lit(p).alias("path")) for m, p in RECOVERY])
    root = F.regexp_extract("base_url", r"^(https?://[^/?#]+)", 1)
    rows = sources.select(F.col("id").alias("source_id"), root.alias("root"), F.posexplode(steps).alias("step", "s"))
    return rows.where("root <> ''").select("source_id", "step", F.col("s.method").alias("method"), F.concat("root", F.col("s.path")).alias("url"))


def recovered(answers: DataFrame) -> DataFrame:
    """(source_id, method, links): of the answers (source_id, step, method, status, links) to those requests
    the first good one with links."""
    good = answers.where(ok(F.col("status")) & (F.size("links") > 0))
    return good.groupBy("source_id").agg(F.min_by(F.struct("method", "links"), "step").alias("f")).select("source_id", "f.method", "f.links")


def stored_form(sources: DataFrame) -> DataFrame:
    """The registry as it is written back: a JSON object a source, keys in order, by priority and id."""
    return sources.orderBy("priority", "id").select(F.to_json(F.struct(*sorted(sources.columns))).alias("line"))


def budgeted(sources: DataFrame, budget: int) -> DataFrame:
    """What is left of a run's document budget when each source, by priority, has its turn.

    What lower priorities want is summed by level first; only the sources of levels that begin within
    the budget are ordered among themselves, all others get nothing."""
    from pyspark.sql import Window

    levels = sources.groupBy("priority").agg(F.sum("wanted").alias("_sum"))
    ahead = levels.select("priority", F.coalesce(F.sum("_sum").over(Window.orderBy("priority").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    placed = sources.join(ahead, "priority")
    inside = Window.partitionBy("priority").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    within = placed.where(F.col("_ahead") < budget).withColumn("_used", F.col("_ahead") + F.coalesce(F.sum("wanted").over(inside), F.lit(0)))
    late = placed.where(F.col("_ahead") >= budget).withColumn("_used", F.lit(budget).cast(within.schema["_used"].dataType))
    both = within.unionByName(late)
    return both.select(*sources.columns, F.greatest(F.lit(0), F.least(F.col("wanted"), F.lit(budget) - F.col("_used"))).alias("granted"))
