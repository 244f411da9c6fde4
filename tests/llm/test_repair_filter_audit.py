"""Conversation repair, URL filters and the audit of sources against plain recomputations, with their edge cases."""

import functools
import hashlib
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import conversations, divergence, url_filter

sys.setrecursionlimit(20_000)  # the plain search of long conversations
SOLID = re.compile(r"[^\x20\x09-\x0D]")
TURNS = "conv_id long, turn long, role string, text string"


# ------------------------------------------------------------- 11 conversations
def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text, do = " " if role is None else role, " " if text is None else text, zlib.crc32(key.encode()) % 20
        if do == 1:
            text = ""
        if do == 2:
            text = re.sub("[.!?]", "", text)
        if do == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if do == 0 else 2 if do == 3 else 1)
    return out


def brute(rows):
    """The result of one conversation's rows, in order, by a search over whole edit sequences."""
    seen, codes, counts = set(), [], Counter()
    for _, _, role, text in rows:
        solid = SOLID.findall(text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        counts[fault] += 1
        seen.add((role, text))
        codes.append((role[:1], fault))

    def step(state, c):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, c))

    @functools.cache
    def best(i, state, inserted):
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        arcs = [("I", c, 2, i, inserted + 1) for c in "ua" if inserted < 3]
        if i < len(rows):
            initial, fault = codes[i]
            arcs.append(("D", None, 3, i + 1, 0))
            if fault not in ("blank", "duplicate"):
                arcs += [("K", initial, fault == "truncated", i + 1, 0)] + [("R", c, 2 + (fault == "truncated"), i + 1, 0) for c in "ua"]
        for letter, c, cost, j, k in arcs:
            to = state if c is None else step(state, c)
            rest = best(j, to, k) if to is not None else None
            if rest:
                name = {"u": "user", "a": "assistant"}.get(c)
                line = () if c is None else ((rows[i][2] if letter == "K" else name) + ":" + ("" if letter == "I" else rows[i][3]),)
                found.append((cost + rest[0], letter + rest[1], line + rest[2]))
        return min(found, default=None)

    cost, audit, lines = best(0, "", 0)
    turns = {r[1] for r in rows if r[1] is not None}
    said = [c[0] for c in codes]
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, counts["blank"], counts["duplicate"], counts["truncated"],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(said, said[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def expected(rows):
    by = defaultdict(list)
    for r in damage(rows):
        by[r[0]].append(r)
    return {c: brute(tuple(sorted(by[c], key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])))) for c in {r[0] for r in rows}}


def talk(rng, convs, longest):
    texts = ["Yes.", "No!", "cut", "", " \n", "Why?", "é", "a.b", "End. ", None]
    rows = []
    for c in range(convs):
        roles = [rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "s"]) for _ in range(rng.randint(1, longest))]
        rows += [(c, rng.choice([t, t, t + 1]) if rng.random() < 0.98 else None, r, rng.choice(texts)) for t, r in enumerate(roles)]
    return rows


def results(df):
    return {r.conv_id: tuple(r)[1:] for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


@pytest.mark.parametrize("block", [16, 1])
def test_conversations_equal_search(spark, monkeypatch, block):
    monkeypatch.setattr(conversations, "BLOCK", block)
    monkeypatch.setattr(conversations, "_STRETCH", 3)
    rows = talk(random.Random(block), 160, 9) + [(None, 0, "user", "Hi."), (None, 1, "assistant", "Yo."), (None, None, None, None)]
    df = spark.createDataFrame(rows, TURNS).repartition(5)
    df = df.select("*", *[F.lit(3).alias(c) for c in ("_c", "_at", "at", "part", "cost", "audit", "_do", "_copy", "_k", "_s")])
    got = results(conversations.repaired(df))
    want = expected(rows)
    assert got.keys() == want.keys() and not {c: (got[c], want[c]) for c in want if got[c] != want[c]}


def test_conversations_one_long(spark, monkeypatch):
    """One conversation with most rows lies in several partitions, with one text of several pieces."""
    monkeypatch.setattr(conversations, "BLOCK", 4)
    rng = random.Random(2)
    rows = [(7, t, rng.choice(["user", "assistant"]), rng.choice(["a.", "b.", f"{t}.", "open", " "])) for t in range(240)]
    rows += [(8, t, "user" if t % 2 == 0 else "assistant", f"{t} " + "long. " * (400_000 if t == 4 else 1)) for t in range(6)]
    got = results(conversations.repaired(spark.createDataFrame(rows, TURNS).repartition(6)))
    assert got == expected(rows)


def test_conversations_rows_and_nothing(spark):
    df = spark.createDataFrame([(1, 0, "system", "S."), (1, 1, "user", "Q?"), (1, 2, "user", "More."), (1, 3, "assistant", "A.")], TURNS)
    found, rows = conversations.repair(df)
    assert [tuple(r) for r in found.collect()] == [(1, 0, 0, 0, 0, 1, 2, "KKIKK")]
    assert [(r.role, r.text) for r in rows.orderBy("at", "part").collect()] == [("system", "S."), ("user", "Q?"), ("assistant", ""), ("user", "More."), ("assistant", "A.")]
    assert conversations.repaired(df.limit(0)).count() == 0
    dropped = next(t for t in range(999) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    assert results(conversations.repaired(spark.createDataFrame([(5, dropped, "user", "x.")], TURNS))) == {5: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_least_edits_long():
    """Thousands of rows, at the default stretches: the cost of independent parts adds up."""
    cost, edits = conversations.least_edits("dg" * 9000)
    assert cost == 0 and edits == ["K"] * 18_000
    cost, edits = conversations.least_edits("d" * 9000)
    assert cost == 9000 and edits == ["K", "A"] * 4500


# ------------------------------------------------------------------ 12 url filter
def fits(rule, host, path):
    cut = rule.index("/") if "/" in rule else len(rule)
    h, p = rule[:cut], rule[cut:]
    return (host == h or host.endswith("." + h)) and (path.startswith(p) if p else True)


def split(url):
    if url is None or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
    return "".join(c.lower() if c.isascii() else c for c in m[1]), m[2]


PREFIXES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"), ("block", "a-b.org"), ("allow", "a-b.org/x"), ("block", "é.fr/É")]
GLOBS = [("block", "^casino^"), ("block", "|bad*.zip|"), ("allow", "^casino^ok^"), ("block", "tra"), ("block", "^x*y^")]
HOSTS = ["example.com", "WWW.example.com", "x.www.example.com", "notexample.com", "net", "a.net", "a-b.org", "c.a-b.org", "bad.org", "casino.org", "é.fr", "com", "tra.se", "example.com:80", ""]
PATHS = ["", "/", "/en", "/en/", "/en/1", "/EN/1", "/es/2", "/fr/", "/fr", "/x1", "/casino/ok", "/a.zip", "/q/xy", "/x/y", "/xtray", "/É/1", "/a://b"]


def glob(pattern, target):
    """Wildcard text over characters, by a search of its own."""
    target = "".join(c.lower() if c.isascii() else c for c in target)
    head, tail = pattern.startswith("|"), pattern.endswith("|")
    body = pattern[head: len(pattern) - tail]

    @functools.cache
    def at(i, j):
        if i == len(body):
            return j == len(target) or not tail
        c = body[i]
        if c == "*":
            return any(at(i + 1, k) for k in range(j, len(target) + 1))
        if c == "^" and (j in (0, len(target)) and at(i + 1, j)):
            return True
        if j == len(target):
            return False
        return (target[j] not in "abcdefghijklmnopqrstuvwxyz0123456789" if c == "^" else target[j] == c) and at(i + 1, j + 1)

    return any(at(0, j) for j in ([0] if head else range(len(target) + 1)))


@pytest.mark.parametrize("small", [1000, 0])
def test_url_filter_equals_every_rule(spark, small):
    urls = [f"http{'s' * (i % 2)}://{h}{p}{q}" for i, (h, p, q) in enumerate((h, p, q) for h in HOSTS for p in PATHS for q in ("", "?a=/en/", "#x"))]
    urls += [None, "", "example.com/en/", "://", "a://b://c/d"] + urls[:40]
    rows = [(i, u) for i, u in enumerate(urls)]
    df = spark.createDataFrame(rows, "page_id long, url string").repartition(4)
    df = df.select("*", *[F.lit("clash").alias(c) for c in ("host", "rule", "_url", "_token", "verdict", "prefix") if c != "_url"])
    got = {r.page_id: (r.host, r.path, r.rule, r.pattern, r.verdict) for r in url_filter.url_filter(df, url_filter.rules_of(spark, PREFIXES, GLOBS), small=small).collect()}
    want = {}
    for i, u in rows:
        host, path = split(u)
        rule = min(((-len(r), v, r) for v, r in PREFIXES if fits(r, host, path)), default=None)
        other = min(((v, g) for v, g in GLOBS if glob(g, host + path)), default=None)
        want[i] = (host, path, rule[2], None, rule[1]) if rule else (host, path, None, other[1], other[0]) if other else (host, path, None, None, "allow")
    assert not {i: (urls[i], got[i], want[i]) for i in want if got[i] != want[i]} and len(got) == len(want)


def test_url_filter_index_and_nothing(spark):
    assert url_filter.prefix_expression("example.com/en/")[1] == ["example", "com", "en"]
    assert url_filter.prefix_expression("example.com/en")[1] == ["example", "com"]
    assert url_filter.pattern_expression("ads*banner^x^")[1] == ["x"] and url_filter.pattern_expression("|bad^")[1] == ["bad"]
    df = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    none = url_filter.rules_of(spark).limit(0)
    assert [tuple(r) for r in url_filter.url_filter(df, none).collect()] == [(1, "http://a.com/", "a.com", "/", None, None, "allow")]
    assert url_filter.url_filter(df, none).first().verdict == "allow"
    assert url_filter.url_filter(df.limit(0), url_filter.rules_of(spark)).count() == 0


# ------------------------------------------------------------------ 13 divergence
def audit(rows, least, top):
    term = re.compile(divergence.TERM)
    docs = [(lang or "", source or "", [("".join(c.lower() if c.isascii() else c for c in w)) for w in term.findall(text or "")]) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        held = Counter(w for d in mine for w in set(d[2]))
        kept = sorted(w for w, n in held.items() if n >= least)
        by = {s: Counter(w for d in mine if d[1] == s for w in d[2] if held[w] >= least) for s in {d[1] for d in mine}}
        everywhere = sum(by.values(), Counter())

        def share(c):
            n = sum(c.values())
            return {w: 1 + 10**9 * (c[w] + 2) // (n + 2 * len(kept)) for w in kept}

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        shares, q = {s: share(c) for s, c in by.items()}, share(everywhere)
        for s in by:
            pairs = [(t, sum(f(shares[s][w], shares[t][w]) for w in kept)) for t in by if t != s]
            words = [(w, f(shares[s][w], q[w])) for w in kept if by[s][w] > 0 and shares[s][w] > q[w]]
            for part, items in (("pair", pairs), ("term", words)):
                for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode())), 1):
                    if part == "pair" or rank <= top:
                        out.append((lang, s, part, item, value, rank))
    return sorted(out)


def test_divergence_equals_counting(spark):
    rng = random.Random(4)
    vocabulary = ["The", "the", "été", "ÉTÉ", "a1b", "naïve", "x-y", "日本", "über", "w", "z"]
    rows = [(" ".join(rng.choices(vocabulary, k=rng.randint(0, 12))), rng.choice(["en", "en", "fr", None]), f"s{min(rng.randrange(9), 4)}") for _ in range(150)]
    rows += [(None, "en", "s0"), ("", None, None), ("rare words", "xx", "a"), ("", "xx", "b"), ("1 2 3", "yy", "only"), ("the", "en", "null"), *rows[:5]]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string").repartition(5)
    df = df.select("*", *[F.lit(1).alias(c) for c in ("part", "item", "value", "rank", "_lang", "_term", "_p", "_words")])
    got = divergence.divergence(df, top=4)
    assert [(c, t) for c, t in got.dtypes] == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    assert sorted(tuple(r) for r in got.collect()) == audit(rows, 10, 4)
    assert sorted(tuple(r) for r in divergence.divergence(df, least=1).collect()) == audit(rows, 1, 10)
    assert divergence.divergence(df.limit(0)).count() == 0


def test_divergence_shares_are_exact(spark):
    """Counts beyond what a double, or a long times 10^9, can hold."""
    c, n, v = 9_007_199_254_740_993, 36_028_797_018_963_971, 12_345
    row = spark.range(1).select(divergence._share(F.lit(c), F.lit(n), F.lit(v)).alias("p"), divergence._distance(F.lit(1_000_000_001).cast("long"), F.lit(1).cast("long")).alias("f")).first()
    assert row.p == 1 + 10**9 * (c + 2) // (n + 2 * v) and row.f == 10**18 // 1_000_000_002
