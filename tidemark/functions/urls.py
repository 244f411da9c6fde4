"""URLs, hosts and media types as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "msclkid", "_ga", "ref", "origin")
NOISE = (r"(?i)(?:^|/)(?:login|entrar|webmail|intranet|carrinho|whatsapp|facebook|twitter|instagram|youtube|linkedin|mailto:|javascript:|tel:|#)")
ESCALATE = (403, 429, 503, 520, 521, 522, 525, 526)
RETRY = (408, 425, 429, 500, 502, 503, 504, 507, 509)
URL = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#;]*)(?:;[^?#]*)?(?:\?([^#]*))?"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(F.trim(url), URL, group)


def canonical(url: Column) -> Column:
    """http(s) only, host lower-case, no fragment, no tracking parameters, query pieces sorted, no
    slash at the end; anything else is the empty string. Null stays null."""
    scheme, host, path, query = F.lower(_part(url, 1)), F.lower(_part(url, 2)), _part(url, 3), _part(url, 4)
    pieces = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(*TRACKING)))
    path = F.when(path.isin("", "/"), "/").otherwise(F.regexp_replace(path, "/+$", ""))
    tail = F.when(F.size(pieces) > 0, F.concat(F.lit("?"), F.array_join(pieces, "&"))).otherwise("")
    return F.when(url.isNull(), F.lit(None).cast("string")).when(scheme.isin("http", "https"), F.concat(scheme, F.lit("://"), host, path, tail)).otherwise("")


def host(url: Column) -> Column:
    """Host without its port; empty if there is none."""
    return F.substring_index(F.lower(_part(url, 2)), ":", 1)


def host_allowed(url: Column, allowed: Column) -> Column:
    """The host is one of ``allowed`` (an array) or below one."""
    h = host(url)
    return (h != "") & F.exists(allowed, lambda a: (h == F.lower(a)) | F.endswith(h, F.concat(F.lit("."), F.lower(a))))


def relevant(url: Column, label: Column, pattern: str) -> Column:
    return ~url.rlike(NOISE) & (url.rlike(pattern) | F.coalesce(label, F.lit("")).rlike(pattern))


def media_type(url: Column, content_type: Column, head: Column) -> Column:
    base = F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    return (F.when(F.startswith(F.coalesce(head.cast("string"), F.lit("")), F.lit("%PDF-")), "pdf")
            .when(base.contains("pdf") | F.lower(_part(url, 3)).endswith(".pdf"), "pdf")
            .when(base.contains("json"), "json").when(base.contains("xml"), "xml")
            .when(base.startswith("text/") | base.contains("html"), "html")
            .when(base == "", "unknown").otherwise(base))


def ok(status: Column) -> Column:
    return F.coalesce(status.between(200, 299), F.lit(False))


def unchanged(status: Column) -> Column:
    return F.coalesce(status == 304, F.lit(False))


def retryable(status: Column) -> Column:
    return F.coalesce(status.isin(*RETRY), F.lit(False))


def backoff(attempt: Column, jitter: Column) -> Column:
    """Seconds before the next attempt: doubling, 20 at most, and jitter."""
    return F.least(F.pow(F.lit(2.0), attempt), F.lit(20.0)) + jitter


def should_escalate(status: Column, error: Column, candidates: Column, forced: Column) -> Column:
    """Whether a browser should try what a plain request did not get."""
    return (forced | F.coalesce(status.isin(*ESCALATE), F.lit(False)) | (status.isNull() & error.isNotNull()) | (ok(status) & (candidates == 0)))


def sitemap_links(xml: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.substring(xml, 1, 400_000), F.lit(r"(?i)<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1)))
