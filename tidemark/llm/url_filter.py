"""Operator 12: URL filters by pattern rules, indexed by their rarest literal token.

Rules are of two kinds. A prefix rule is ``host/path``: its host with all subdomains, paths that
start with its path; the longest that fits decides. A pattern is wildcard text for URLs that no
prefix rule fits: ``*`` is anything, ``^`` a place between letters or digits and something else, ``|``
at an end the end of the URL. Both become regular expressions over host and path.

A rule can only fit where every literal token of it (letters and digits between other characters)
occurs, so it is looked up by the one that the URLs hold least often. A URL's tokens fetch the rules
filed under them, and only those run their expression. Verdicts belong to distinct URLs: one shuffle
by URL serves the fetching and the join back.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut

#: The prefix rules of the query, and its patterns for all other URLs: hosts named after what is sold by spam.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
PATTERNS = (("block", "^casino^"), ("block", "^bets^"), ("block", "^spam^"), ("block", "^adult^"))
SMALL = 1_000_000
_WORD = re.compile("[a-z0-9]+")


def _folded(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _low(text: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in text)


def prefix_expression(rule: str) -> tuple[str, list[str]]:
    """Regular expression over host and path, and the tokens without which it cannot fit. The token a path
    ends in may go on in a URL and does not count."""
    host = _low(rule.partition("/")[0])
    path = rule[len(host):]
    whole = re.sub("[a-z0-9]+$", "", _low(path))
    return rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path) if path else r'(?:/|\z)'}", _WORD.findall(host) + _WORD.findall(whole)


def pattern_expression(pattern: str) -> tuple[str, list[str]]:
    """The same for wildcard text. A token counts if a literal that is neither letter nor digit, a ``^`` or
    a ``|`` bounds it on both sides."""
    text = _low(pattern)
    sure = [m[0] for m in _WORD.finditer(text) if text[m.start() - 1: m.start()] not in ("", "*") and text[m.end(): m.end() + 1] not in ("", "*")]
    out = [{"*": r"[\s\S]*", "^": r"(?:[^a-z0-9]|\A|\z)"}.get(c) or re.escape(c) for c in text]
    if text.startswith("|"):
        out[0] = r"\A"
    if text.endswith("|") and len(text) > 1:
        out[-1] = r"\z"
    return "".join(out), sure


def rules_of(spark: SparkSession, prefixes=RULES, patterns=PATTERNS) -> DataFrame:
    """Rules from lists, as a table: verdict, rule, prefix (whether it is a prefix rule)."""
    return spark.createDataFrame([(v, r, True) for v, r in prefixes] + [(v, p, False) for v, p in patterns], "verdict string, rule string, prefix boolean")


def _compiled(rules: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [(prefix_expression if p else pattern_expression)(r) for r, p in zip(f["_rule"], f["_prefix"])]
            yield f.assign(_expression=[m[0] for m in made], _sure=[sorted(set(m[1])) for m in made])

    return rules.select(F.col("verdict").alias("_verdict"), F.col("rule").alias("_rule"), F.col("prefix").alias("_prefix")).where("_rule is not null").distinct().mapInPandas(
        run, "_verdict string, _rule string, _prefix boolean, _expression string, _sure array<string>")


def parts(url: Column) -> tuple[Column, Column]:
    """Host (letters of ASCII lower-cased) and path of a URL; empty where it is null or has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    return _folded(host), F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def url_filter(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", small: int = SMALL) -> DataFrame:
    """The rows of ``pages`` with host, path, rule (the longest prefix rule that fits; ties by its text), pattern
    (where no rule fits: the pattern that decides, an allowing one before a blocking one) and verdict.

    Both sides of a lookup are joined by token; the index is broadcast up to ``small`` counted rules and shuffled
    beyond. Defined cases: null and malformed URLs have empty host and path and no rule; an empty pattern or rule
    without a literal token is tried on every URL; repeated URLs are judged once and rows repeated as they
    are; no rules or an empty table give the default or nothing; columns of the result that ``pages`` also has are
    replaced, others pass through.
    """
    made = ("host", "path", "rule", "pattern", "verdict")
    pages = pages.select(*[c for c in pages.columns if c not in made], F.coalesce(F.col(url_col), F.lit("")).alias("_url"))
    host, path = parts(F.col("_url"))
    urls = pages.select("_url").distinct().select("_url", host.alias("host"), path.alias("path"))
    tokens = urls.withColumn("_tokens", F.array_distinct(F.regexp_extract_all(_folded(F.concat("host", "path")), F.lit("[a-z0-9]+"), F.lit(0))))
    rules = cut(_compiled(rules), "rules")
    few = rules.count() <= small
    sure = rules.select(F.explode("_sure").alias("_token")).distinct()
    said = tokens.select(F.explode("_tokens").alias("_token")).join(F.broadcast(sure) if few else sure, "_token", "left_semi").groupBy("_token").agg(F.count(F.lit(1)).alias("_n"))
    # a token that no URL holds is the rarest of all
    filed = rules.select("*", F.explode_outer("_sure").alias("_token")).join(said, "_token", "left").groupBy("_verdict", "_rule", "_prefix", "_expression").agg(
        F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("_n"), F.coalesce("_token", F.lit("")).alias("_token")))["_token"].alias("_token"))
    index = cut(filed, "index")
    if index.where("_token = ''").limit(1).count():
        tokens = tokens.withColumn("_tokens", F.array_append("_tokens", F.lit("")))
    fetched = tokens.select("_url", F.concat("host", "path").alias("_target"), F.explode("_tokens").alias("_token")).join(F.broadcast(index) if few else index, "_token")
    fits = fetched.where("case when _prefix then _target else translate(_target, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') end rlike _expression")
    rank = F.struct((~F.col("_prefix")).alias("_p"), F.when(F.col("_prefix"), -F.length("_rule")).otherwise(0).alias("_n"), "_verdict", "_rule")
    best = fits.groupBy("_url").agg(F.min(rank).alias("_best"))
    judged = urls.join(best, "_url", "left")
    named = ~F.col("_best._p")
    return pages.join(judged, "_url", "left").select(
        *[c for c in pages.columns if c != "_url"], "host", "path",
        F.when(named, F.col("_best._rule")).alias("rule"), F.when(~named, F.col("_best._rule")).alias("pattern"),
        F.coalesce("_best._verdict", F.lit(default)).alias("verdict"))
