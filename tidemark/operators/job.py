"""A run as resumable stages: every stage's table is written under the run's identifier, once.

A stage that has its table is not computed again, so a run that was cut off goes on at the stage that was lost.
A stage that fails costs what needs it, not the run; after the timebox no stage begins. Rows that a stage
cannot use stay in its table with a status and a reason, and are left out by the stages behind it.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import urls
from tidemark.operators import registry
from tidemark.sources import pages
from tidemark.sources.fetch import HttpSource

#: Seconds and documents of a run.
TIMEBOX, BUDGET = 2400, 160


@dataclass(frozen=True)
class Stage:
    """``make`` gets the tables of ``needs`` by name, in order."""

    name: str
    make: Callable[..., DataFrame]
    needs: tuple[str, ...] = ()


@dataclass
class Run:
    spark: SparkSession
    folder: str
    run_id: str
    timebox: float = TIMEBOX
    clock: Callable[[], float] = time.monotonic
    report: list[dict] = field(default_factory=list)

    def path(self, stage: str) -> str:
        return f"{self.folder.rstrip('/')}/run={self.run_id}/{stage}"

    def done(self, stage: str) -> bool:
        """Spark's own mark of a whole table."""
        mark = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path(stage)}/_SUCCESS")
        return mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(mark)

    def execute(self, stages: Sequence[Stage]) -> dict[str, DataFrame]:
        """The tables there are in the end, by stage; ``report`` says of each: DONE, KEPT, FAILED, SKIPPED (something it
        needs is not there) or LATE (the timebox was over)."""
        began, tables = self.clock(), {}
        self.report = []
        for stage in stages:
            state, error, at = "DONE", None, self.clock()
            if self.done(stage.name):
                state = "KEPT"
            elif any(n not in tables for n in stage.needs):
                state = "SKIPPED"
            elif at - began > self.timebox:
                state = "LATE"
            else:
                try:
                    stage.make(*[tables[n] for n in stage.needs]).write.mode("overwrite").parquet(self.path(stage.name))
                except Exception as e:  # noqa: BLE001 - one stage must not stop those that do not need it
                    state, error = "FAILED", f"{type(e).__name__}: {e}"[:500]
            if state in ("DONE", "KEPT"):
                tables[stage.name] = self.spark.read.parquet(self.path(stage.name))
            self.report.append({"run_id": self.run_id, "stage": stage.name, "state": state, "seconds": round(self.clock() - at, 3), "error": error})
        return tables

    def log(self) -> DataFrame:
        return self.spark.createDataFrame([tuple(r.values()) for r in self.report], "run_id string, stage string, state string, seconds double, error string")


def fetched(requests: DataFrame, url: str = "url", **options: str) -> DataFrame:
    """The responses to ``requests``, a partition a host; rows that failed carry their error. The requests of a run are
    within its budget, so their list is small."""
    spark = requests.sparkSession
    spark.dataSource.register(HttpSource)
    wanted = [{"url": r[0]} for r in requests.select(url).distinct().orderBy(url).collect()]      # the run's budget of rows
    return spark.read.format(HttpSource.name()).option("urls", json.dumps(wanted)).options(**options).load()


def _answered(status: Column, error: Column) -> Column:
    return F.when(urls.ok(status), "OK").when(urls.unchanged(status), "UNCHANGED").when(error == "not allowed", "REFUSED").otherwise("FAILED")


def _links(answers: DataFrame, hosts: Column) -> DataFrame:
    """(source_id, place, link, label) of the links on pages that answered, in the order of pages and places."""
    read = pages.parsed(answers.where("state = 'OK'").withColumn("html", F.decode("content", "UTF-8")))
    found = pages.links(read, hosts)
    return found.join(read.select(F.col("url").alias("page_url"), "source_id", F.col("place").alias("page_place")).distinct(), "page_url").select(
        "source_id", (F.col("page_place") * 10_000 + F.col("place")).alias("place"), "link", "label")


def collection(spark: SparkSession, sources: DataFrame, wanted: Callable[[Column, Column], Column], hosts: list[str], budget: int = BUDGET, extract: Callable[[DataFrame], DataFrame] | None = None, **options: str) -> list[Stage]:
    """The stages of a collection over ``sources`` (id, base_url, seed_urls, allowed_hosts, priority, max_documents): entrances, their
    pages, links (filtered by ``wanted`` of link and label), other entrances of sources without links, the budget, documents
    and what ``extract`` makes of those with text."""
    allowed = F.array(*[F.lit(h) for h in hosts])
    options = {"allowed": json.dumps(hosts)} | options

    def answers(requests: DataFrame) -> DataFrame:
        got = fetched(requests, **options).select("url", "status", "content", "content_type", "error")
        return requests.join(got, "url").withColumn("state", _answered(F.col("status"), F.col("error")))

    def links(index: DataFrame) -> DataFrame:
        return _links(index, allowed).where(wanted(F.col("link"), F.col("label")))

    def recovery(found: DataFrame) -> DataFrame:
        """Entrances of the ladder, for sources without links only, and the links of the first that has any."""
        lost = sources.join(found.select(F.col("source_id").alias("id")).distinct(), "id", "left_anti")
        asked = registry.recovery_requests(lost)
        got = asked.join(fetched(asked, **options).select("url", "status", "content"), "url")
        text = F.decode(F.coalesce("content", F.lit(b"")), "UTF-8")
        at = F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1)), F.regexp_extract_all(text, F.lit(r"<link>\s*([^<\s]+)\s*</link>"), F.lit(1))))
        best = registry.recovered(got.select("source_id", "step", "method", "status", at.alias("links")))
        rows = best.select("source_id", F.posexplode("links").alias("place", "raw")).select("source_id", F.col("place").cast("int").alias("place"), urls.canonical(F.col("raw")).alias("link"), F.lit("").alias("label"))
        return rows.where((F.col("link") != "") & urls.host_allowed(F.col("link"), allowed))

    def planned(found: DataFrame, ladder: DataFrame) -> DataFrame:
        """Links of each source within its own limit and what the run's budget grants it."""
        limits = sources.select(F.col("id").alias("source_id"), "max_documents", "priority")
        all_ = found.select("source_id", F.col("link").alias("url"), "place").union(ladder.select("source_id", F.col("link").alias("url"), "place")).join(limits, "source_id")
        chosen = registry.candidates_per_source(all_)
        asks = chosen.groupBy("source_id").agg(F.count(F.lit(1)).alias("wanted")).join(limits, "source_id").select(F.col("source_id").alias("id"), "priority", "wanted")
        grant = registry.budgeted(asks, budget).select(F.col("id").alias("source_id"), "granted")
        return chosen.join(grant, "source_id").where(F.col("n") <= F.col("granted")).groupBy("url").agg(F.min_by("source_id", F.struct("place", "source_id")).alias("source_id"))

    def documents(plan: DataFrame) -> DataFrame:
        got = answers(plan)
        read = pages.parsed(got.withColumn("html", F.when(F.col("state") == "OK", F.decode("content", "UTF-8"))))
        text = F.col("page.text")
        state = F.when((F.col("state") == "OK") & (F.coalesce(F.length(text), F.lit(0)) == 0), "EMPTY").otherwise(F.col("state"))
        return read.select("url", "source_id", "status", state.alias("state"), "error", F.col("page.title").alias("title"), text.alias("text"), F.sha2("content", 256).alias("content_hash"))

    out = [
        Stage("entrances", lambda: registry.index_pages(sources)),
        Stage("index", answers, ("entrances",)),
        Stage("links", links, ("index",)),
        Stage("recovery", recovery, ("links",)),
        Stage("plan", planned, ("links", "recovery")),
        Stage("documents", documents, ("plan",)),
    ]
    return out + ([Stage("records", lambda d: extract(d.where("state = 'OK'")), ("documents",))] if extract else [])
