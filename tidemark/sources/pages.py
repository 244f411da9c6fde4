"""HTML pages as a source: text, title, links, tables and a shape fingerprint, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.urls import canonical, host_allowed

SCHEMA = ("text string, title string, links array<struct<url:string,label:string>>, tables array<struct<caption:string,rows:array<array<string>>>>, "
          "shape struct<links:int,tables:int,lists:int,headings:int,forms:int>")
SKIPPED = ("script", "style", "noscript", "template", "svg")
MAX_TITLE, MAX_TABLES, MAX_ROWS = 300, 60, 400
#: Pages of an Arrow batch that are held in parsed form at a time.
PART = 100
BREAKS = frozenset("p div br li tr td th h1 h2 h3 h4 h5 h6 section article header footer nav ul ol table title".split())


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.text: list[str] = []
        self.title: list[str] = []
        self.links: list[dict] = []
        self.tables: list[dict] = []
        self.shape = dict.fromkeys(("links", "tables", "lists", "headings", "forms"), 0)
        self.skip = 0
        self.inside: list[str] = []
        self.open: list[dict] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SKIPPED:
            self.skip += 1
        if tag in BREAKS:
            self.text.append("\n")
        kind = {"a": "links", "table": "tables", "ul": "lists", "ol": "lists", "form": "forms"}.get(tag) or ("headings" if tag in ("h1", "h2", "h3", "h4") else None)
        if kind:
            self.shape[kind] += 1
        if tag == "a":
            self.links.append({"url": dict(attrs).get("href") or "", "label": ""})
            self.inside.append("a")
        elif tag == "title":
            self.inside.append("title")
        elif tag == "table":
            self.open.append({"caption": "", "rows": []})
        elif self.open and tag == "tr" and len(self.open[-1]["rows"]) < MAX_ROWS:
            self.open[-1]["rows"].append([])
        elif self.open and tag in ("td", "th") and self.open[-1]["rows"]:
            self.open[-1]["rows"][-1].append("")
            self.inside.append("cell")
        elif self.open and tag == "caption":
            self.inside.append("caption")

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        if tag in BREAKS:
            self.text.append("\n")
        name = {"td": "cell", "th": "cell"}.get(tag, tag)
        if name in self.inside:
            while self.inside.pop() != name:
                pass
        if tag == "table" and self.open:
            done = self.open.pop()
            if len(self.tables) < MAX_TABLES:
                self.tables.append(done)

    def handle_data(self, data: str) -> None:
        if self.skip:
            return
        if "title" in self.inside:
            self.title.append(data)
            return
        self.text.append(data)
        if "a" in self.inside and self.links:
            self.links[-1]["label"] += data
        if self.open and "cell" in self.inside and self.open[-1]["rows"] and self.open[-1]["rows"][-1]:
            self.open[-1]["rows"][-1][-1] += f" {data}"
        if self.open and "caption" in self.inside:
            self.open[-1]["caption"] += data


def _parsed(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for part in (batch.iloc[at:at + PART] for batch in pages for at in range(0, len(batch), PART)):
        out = []
        for page in part:
            p = _Page()
            p.feed(page or "")
            p.close()
            lines = (" ".join(x.split()) for x in "".join(p.text).split("\n"))
            out.append({
                "text": "\n".join(x for x in lines if x), "title": " ".join("".join(p.title).split())[:MAX_TITLE],
                "links": [{"url": x["url"], "label": " ".join(x["label"].split())} for x in p.links],
                "tables": [{"caption": " ".join(t["caption"].split()), "rows": [[" ".join(c.split()) for c in r] for r in t["rows"]]} for t in p.tables],
                "shape": p.shape})
        yield pd.DataFrame(out, columns=["text", "title", "links", "tables", "shape"])


def parsed(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with the struct column ``page``: text, title, links, tables, shape."""
    return pages.withColumn("page", F.pandas_udf(_parsed, SCHEMA)(html))


def _joined(bases: pd.Series, hrefs: pd.Series) -> pd.Series:
    def one(base, href):
        try:
            return urljoin(base or "", href or "")
        except ValueError:
            return ""
    return pd.Series([one(b, h) for b, h in zip(bases, hrefs)])


def links(pages: DataFrame, allowed: Column, url: str = "url") -> DataFrame:
    """(url of the page, place, link, label): canonical allowed links, each once, where first seen."""
    rows = pages.select(F.col(url).alias("page_url"), F.posexplode("page.links").alias("place", "l"))
    rows = rows.select("page_url", "place", F.col("l.label").alias("label"), canonical(F.pandas_udf(_joined, "string")("page_url", F.col("l.url"))).alias("link"))
    return rows.where((F.col("link") != "") & host_allowed(F.col("link"), allowed)).groupBy("page_url", "link").agg(
        F.min("place").alias("place"), F.min_by("label", "place").alias("label"))


def fingerprint(shape: Column) -> Column:
    """Of the shape alone: contents change daily, structure should not."""
    return F.sha2(F.to_json(shape), 256)


def usable(text: Column, status: Column) -> Column:
    return (status == "OK") & (F.length(F.trim(F.coalesce(text, F.lit("")))) >= 80)


def first_usable(*methods: Column) -> Column:
    """The first of several extractions (status, text, method) that is usable; an encrypted document
    ends the search; a text below the limit is marked."""
    stop = F.lit(False)
    out = F.lit(None).cast("struct<status:string,text:string,method:string>")
    picks = []
    for m in methods:
        picks.append(F.when(~stop & ((m["status"] == "ENCRYPTED") | usable(m["text"], m["status"])), m))
        stop = stop | F.coalesce(m["status"] == "ENCRYPTED", F.lit(False))
    short = [F.when(m["status"] == "OK", F.struct(F.lit("TOO_SHORT").alias("status"), m["text"].alias("text"), m["method"].alias("method"))) for m in methods]
    return F.coalesce(*picks, *short, out)
