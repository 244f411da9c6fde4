"""Entity resolution: keys, token similarity, and the match cascade as blocked joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import normalise
from tidemark.sources.store import staged

#: Fixed values.
NAME_STOPWORDS = (
    "de da do das dos e para com no na nos nas o a os as um uma em por edital concurso publico publica processo seletivo simplificado "
    "abertura vagas cargo cargos nivel provimento municipio estado prefeitura camara secretaria").split()
INSTITUTION_NOISE = (
    "prefeitura municipal camara municipio governo estado secretaria de do da dos das e instituto tribunal conselho regional federal "
    "fundacao universidade empresa companhia banco publica publico").split()
NAME_THRESHOLD, INSTITUTION_THRESHOLD, NUMBER_THRESHOLD, SAME_BOARD = 0.62, 0.5, 0.34, 0.08
#: Hubs of a batch are broadcast up to this number, counted, and shuffled beyond.
SMALL = 200_000


def _words(col: Column) -> Column:
    return F.filter(F.split(normalise(F.coalesce(col, F.lit(""))), " "), lambda w: w != "")


def _institution_key(words: Column) -> Column:
    head = F.get(words, F.lit(0))
    others = F.filter(words, lambda w: ~w.isin(*INSTITUTION_NOISE) & (w != head))
    key = F.substring(F.array_join(F.slice(F.concat(F.array(head), others), 1, 4), "-"), 1, 60)
    return F.when(F.size(words) == 0, "desconhecida").otherwise(key)


def institution_key(institution: Column) -> Column:
    """The first word and up to three distinctive others, so that two bodies of a city differ."""
    return _institution_key(_words(institution))


def _token_set(words: Column) -> Column:
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(*NAME_STOPWORDS) & (F.length(w) > 2)))


def token_set(name: Column) -> Column:
    return _token_set(_words(name))


def jaccard(left: Column, right: Column) -> Column:
    """Of two token arrays; 0 where either is empty."""
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(left, right)) / F.size(F.array_union(left, right)))


def _dedup_key(base: Column, number: Column, published: Column, tokens: Column) -> Column:
    signature = F.coalesce(F.nullif(F.array_join(F.slice(F.array_sort(tokens), 1, 6), "-"), F.lit("")), F.lit("sem-nome"))
    numbered = F.concat_ws(":", base, F.lit("edital"), F.replace(normalise(number), F.lit(" "), F.lit("/")))
    dated = F.concat_ws(":", base, F.coalesce(F.year(published), F.lit(1900)).cast("string"), signature)
    return F.substring(F.when(F.coalesce(number, F.lit("")) != "", numbered).otherwise(dated), 1, 128)


def dedup_key(institution: Column, number: Column, published: Column, name: Column) -> Column:
    """institution:edital:number where there is one, else institution:year:first six sorted tokens."""
    return _dedup_key(institution_key(institution), number, published, token_set(name))


def position_slug(name: Column) -> Column:
    return F.coalesce(F.nullif(F.substring(F.replace(normalise(name), F.lit(" "), F.lit("-")), 1, 160), F.lit("")), F.lit("cargo"))


def _prefixed(rows: DataFrame, words: str, rare: DataFrame, least: float, name: str) -> DataFrame:
    """Each of distinct rows once for every token that it may share with a set of Jaccard ``least`` or more: its rarest
    |x| - ceil(least |x|) + 1. ``rare``: t, f, how often a token occurs."""
    keep = rows.columns
    ranked = rows.select("*", F.explode(words).alias("t")).join(rare, "t", "left").groupBy(*keep).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "t"))).alias("o"))
    n = F.size(words)
    return ranked.select(*keep, F.explode(F.slice("o", F.lit(1), (n - F.ceil(n * least) + 1).cast("int"))).alias("p")).select(*keep, F.col("p.t").alias(name))


def _often(rows: DataFrame, words: str) -> DataFrame:
    return rows.select(F.explode(words).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("f"))


def _similar(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """Pairs of distinct combinations (it, nt, year, nboard) and (kit, knt, kyear, kboard) that the similarity rule
    accepts, with their score. First without the boards, by a rare token of the names, one of the institutions and the year: a
    year that is not known meets all of them, so either side says whom it may meet, and a pair agrees on one word."""
    least = NAME_THRESHOLD - SAME_BOARD
    lefts, rights = mine.select("it", "nt", "year").distinct(), theirs.select("kit", "knt", "kyear").distinct()
    names, bodies = _often(rights, "knt"), _often(rights, "kit")

    def keyed(rows: DataFrame, nt: str, it: str, side: str, years: Column) -> DataFrame:
        both = _prefixed(_prefixed(rows, nt, names, least, side + "n"), it, bodies, INSTITUTION_THRESHOLD, side + "i")
        return both.withColumn(side + "y", F.explode(years))

    year, kyear = F.col("year").cast("string"), F.col("kyear").cast("string")
    left = keyed(lefts, "nt", "it", "l", F.when(year.isNull(), F.array(F.lit("any"))).otherwise(F.array(year, F.lit("none"))))
    right = keyed(rights, "knt", "kit", "r", F.when(kyear.isNull(), F.array(F.lit("any"), F.lit("none"))).otherwise(F.array(kyear, F.lit("any"))))
    near = (left.join(right, (F.col("ln") == F.col("rn")) & (F.col("li") == F.col("ri")) & (F.col("ly") == F.col("ry")))
            .where(jaccard(F.col("it"), F.col("kit")) >= INSTITUTION_THRESHOLD).withColumn("alike", jaccard(F.col("nt"), F.col("knt"))).where(F.col("alike") >= least - 1e-9))
    near = near.drop("ln", "rn", "li", "ri", "ly", "ry").distinct()
    own = near.withColumnsRenamed({"it": "it0", "nt": "nt0", "year": "year0"}).join(mine, (F.col("it") == F.col("it0")) & (F.col("nt") == F.col("nt0")) & F.col("year").eqNullSafe(F.col("year0"))).drop("it0", "nt0", "year0")
    both = own.withColumnsRenamed({"kit": "kit0", "knt": "knt0", "kyear": "kyear0"}).join(theirs, (F.col("kit") == F.col("kit0")) & (F.col("knt") == F.col("knt0")) & F.col("kyear").eqNullSafe(F.col("kyear0"))).drop("kit0", "knt0", "kyear0")
    score = F.col("alike") + F.when(F.col("nboard") == F.col("kboard"), SAME_BOARD).otherwise(0.0)
    return both.withColumn("score", score).drop("alike").where(F.col("score") >= NAME_THRESHOLD)


def _by_name(d: DataFrame, k: DataFrame, first: Column) -> DataFrame:
    """(id, one, score) of drafts and stored rows with similar institutions and names, by distinct combinations of
    what the rule looks at."""
    mine = d.select("it", "nt", F.year("published").alias("year"), normalise(F.col("board")).alias("nboard")).distinct().where(F.size("nt") > 0)
    theirs = k.groupBy("kit", "knt", "kyear", "kboard").agg(first).where(F.size("knt") > 0)
    best = _similar(mine, theirs).groupBy("it", "nt", "year", "nboard").agg(
        F.min_by(F.struct("one", "score"), F.struct(-F.col("score"), "one")).alias("b")).select("it", "nt", F.col("year").alias("y"), F.col("nboard").alias("nb"), "b.one", "b.score")
    own = d.withColumn("y0", F.year("published")).withColumn("nb0", normalise(F.col("board"))).select("id", F.col("it").alias("it0"), F.col("nt").alias("nt0"), "y0", "nb0")
    return own.join(best, (F.col("it0") == F.col("it")) & (F.col("nt0") == F.col("nt")) & F.col("y0").eqNullSafe(F.col("y")) & F.col("nb0").eqNullSafe(F.col("nb"))).select("id", "one", "score")


def _seen(drafts: DataFrame) -> DataFrame:
    """Drafts with their key and word sets; a text is split into words once."""
    words = drafts.select("*", _words(F.col("institution")).alias("iw"), token_set(F.col("name")).alias("nt"))
    key = _dedup_key(_institution_key(F.col("iw")), F.col("number"), F.col("published"), F.col("nt"))
    return words.select(*drafts.columns, key.alias("key"), _token_set(F.col("iw")).alias("it"), "nt")


def _stored(known: DataFrame) -> DataFrame:
    seen = _seen(known.select("id", "first_seen", "institution", "name", "number", "published", "board", "urls", "hashes"))
    return seen.select(F.col("id").alias("kid"), "first_seen", F.col("number").alias("knumber"), F.year("published").alias("kyear"), normalise(F.col("board")).alias("kboard"),
                       "urls", "hashes", F.col("key").alias("kkey"), F.col("it").alias("kit"), F.col("nt").alias("knt"))


def _numbered(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of rows with one number (n, kn) and institutions similar enough (it, kit). Everybody has a first notice, so
    the join is on the number and a rare word of the institution: sets of Jaccard t or more share one of their
    rarest |x| - ceil(t |x|) + 1 words. Both sides hold distinct rows."""
    rare = _often(right, "kit")
    both = _prefixed(left, "it", rare, NUMBER_THRESHOLD, "t1").join(_prefixed(right, "kit", rare, NUMBER_THRESHOLD, "t2"), (F.col("n") == F.col("kn")) & (F.col("t1") == F.col("t2")))
    return both.where(jaccard(F.col("it"), F.col("kit")) >= NUMBER_THRESHOLD).drop("t1", "t2").distinct()


def _matches(d: DataFrame, k: DataFrame) -> DataFrame:
    """(id, kid, first_seen, rule, score): for each rule, the best stored opportunity of each draft. Both sides (:func:`_seen`
    and :func:`_stored`) are staged, as five rules read them."""
    # one stored row speaks for all that a rule cannot tell apart: the first seen of them
    first = F.min(F.struct("first_seen", "kid")).alias("one")

    def hits(joined: DataFrame, rule: str, score: Column | float = 0.0) -> DataFrame:
        score = F.lit(score) if isinstance(score, float) else score
        return joined.select("id", "one.kid", "one.first_seen", F.lit(RULES[rule][0]).alias("rule"), score.alias("score"))

    by_key = hits(d.join(k.groupBy("kkey").agg(first), F.col("key") == F.col("kkey")), "key")
    by_hash = hits(d.where("document_hash <> ''").join(k.withColumn("h", F.explode("hashes")).groupBy("h").agg(first), F.col("document_hash") == F.col("h")), "hash")
    by_url = hits(d.where("url <> ''").join(k.withColumn("u", F.explode("urls")).groupBy("u").agg(first), F.col("url") == F.col("u")), "url")
    mine = d.where("number <> ''").withColumn("n", normalise(F.col("number")))
    theirs = k.where("knumber <> ''").groupBy(normalise(F.col("knumber")).alias("kn"), "kit").agg(first)
    pairs = _numbered(mine.select("n", "it").distinct(), theirs).select(F.col("n").alias("n0"), F.col("it").alias("it0"), "one")
    by_number = hits(mine.join(pairs, (F.col("n") == F.col("n0")) & (F.col("it") == F.col("it0"))), "number")
    by_name = _by_name(d, k, first)
    return by_key.union(by_hash).union(by_url).union(by_number).union(hits(by_name, "name", F.col("score")))


#: Rules by their order; what drafts of one batch share or are similar in.
RULES = {"key": (1, "dedup_key"), "hash": (2, "document_hash"), "url": (3, "url"), "number": (4, "edital_number"), "name": (5, "similarity")}


def _best(found: DataFrame) -> DataFrame:
    """(id, m): the best of what was found for a draft."""
    return found.groupBy("id").agg(F.min(F.struct("rule", (-F.col("score")).alias("order"), "first_seen", "kid")).alias("m"))


def _told(rows: DataFrame, best: Column) -> DataFrame:
    reason = F.create_map(*[F.lit(x) for n, t in RULES.values() for x in (n, t)])
    return rows.select(F.col("id").alias("draft"), best["kid"].alias("known"), F.coalesce(reason[best["rule"]], F.lit("new")).alias("reason"))


def match(drafts: DataFrame, known: DataFrame) -> DataFrame:
    """(draft, known, reason): the stored opportunity each draft belongs to.

    Drafts: id, institution, name, number, published, board, url, document_hash. Known: the same with
    urls and hashes as arrays, and first_seen. The order of the rules is the reason order; ties go to
    the earliest first_seen, then the smallest id. The similarity rule joins on the rarest tokens of
    names and institutions, so it never compares everything with everything.
    """
    d = staged(_seen(drafts.select("id", "institution", "name", "number", "published", "board", "url", "document_hash")).drop("institution", "name"))
    return _told(d.select("id").join(_best(_matches(d, staged(_stored(known)))), "id", "left"), F.col("m"))


def _hub_texts() -> dict[str, Column]:
    """What a rule can tell of a draft (:func:`_seen`), by rule: null where it has nothing to tell."""
    # the text of a hub: its parts, none of which holds a tab
    text = lambda *parts: F.concat_ws("\t", *[F.coalesce(p, F.lit("-")) for p in parts])
    words = lambda c: F.array_join(F.array_sort(c), " ")
    return {"key": F.col("key"), "hash": F.when(F.col("document_hash") != "", F.col("document_hash")), "url": F.when(F.col("url") != "", F.col("url")),
            "number": F.when((F.col("number") != "") & (F.size("it") > 0), text(normalise(F.col("number")), words("it"))),
            "name": F.when((F.size("nt") > 0) & (F.size("it") > 0), text(words("it"), words("nt"), F.year("published").cast("string"), normalise(F.col("board"))))}


def _beside(rows: DataFrame, table: DataFrame, hub: str, value: str, few: bool) -> DataFrame:
    """Rows whose columns named as the rules, their hubs, give way to what ``table`` (rule, hub, value) says of them."""
    for r in RULES:
        # numbers of hubs differ between rules: the table is broadcast once for all of them
        own = (table if few and hub == "hub" else table.where(F.col("rule") == r)).select(F.col(hub).alias("_hub"), F.col(value).alias("_value"))
        rows = rows.join(F.broadcast(own) if few else own, F.col(r) == F.col("_hub"), "left").drop(r, "_hub").withColumnRenamed("_value", r)
    return rows


def _hubs(d: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """(members, links, few) of a batch. members: id, seq, first_seen and the number of a draft's hub, by rule. links: rule, hub,
    other, score: hubs whose drafts belong together, themselves included; so drafts are never paired with drafts."""
    texts = staged(d.select("id", "seq", "first_seen", *[h.alias(r) for r, h in _hub_texts().items()]))
    told = texts.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("text")) for r in RULES])).alias("m")).select("m.*").where("text is not null")
    hubs = staged(told.distinct().withColumn("hub", F.monotonically_increasing_id()))
    few = hubs.count() <= SMALL
    members = staged(_beside(texts, hubs, "text", "hub", few))
    same = hubs.where("rule in ('key', 'hash', 'url')").select("rule", "hub", F.col("hub").alias("other"), F.lit(0.0).alias("score"))
    part, words = F.split("text", "\t"), lambda c: F.split(c, " ")
    numbers = hubs.where("rule = 'number'").select("hub", part[0].alias("n"), words(part[1]).alias("it"))
    near = _numbered(numbers, numbers.select(F.col("hub").alias("other"), F.col("n").alias("kn"), F.col("it").alias("kit")))
    numbered = near.select(F.lit("number").alias("rule"), "hub", "other", F.lit(0.0).alias("score"))
    said = lambda c: F.when(c != "-", c)
    names = hubs.where("rule = 'name'").select("hub", words(part[0]).alias("it"), words(part[1]).alias("nt"), said(part[2]).cast("int").alias("year"), said(part[3]).alias("nboard"))
    theirs = names.select(F.col("hub").alias("other"), F.col("it").alias("kit"), F.col("nt").alias("knt"), F.col("year").alias("kyear"), F.col("nboard").alias("kboard"))
    similar = _similar(names, theirs).select(F.lit("name").alias("rule"), "hub", "other", "score")
    return members, staged(same.union(numbered).union(similar)), few


def match_batch(drafts: DataFrame, known: DataFrame, rounds: int = 200) -> DataFrame:
    """(draft, known, reason) where each draft that founds an opportunity is one for the drafts after it.

    Drafts as in :func:`match`, with ``seq``, their order (unique), and first_seen. A draft that matches nothing stored
    and no earlier founder is a founder itself ('new', known is null); every other one belongs to the best match among
    stored opportunities and earlier founders, in the rules' order.

    Founders are found in rounds over all drafts at once: drafts beside an earlier founder of the last round drop out, then
    those without an undecided draft before them are founders; the others wait. A draft is one row with the numbers of its hubs;
    a round asks of each hub the earliest draft in those linked with it, so a key that a third of all drafts
    share costs a minimum, not pairs; every hub has one founder at most. The number of rounds is the
    longest chain of drafts that wait for each other, a few in practice; beyond ``rounds`` an error is raised.
    """
    d = staged(_seen(drafts.select("id", "seq", "first_seen", "institution", "name", "number", "published", "board", "url", "document_hash")).drop("institution", "name"))
    k = staged(_stored(known))
    stored = None if k.isEmpty() else staged(_best(_matches(d, k)))
    members, links, few = _hubs(d)

    def by_hub(rows: DataFrame) -> DataFrame:
        return rows.select("*", F.explode(F.array(*RULES)).alias("other")).where("other is not null").drop(*RULES)

    def free(rows: DataFrame, others: DataFrame, itself: bool) -> DataFrame:
        """Rows without one of ``others`` before them in the hubs linked with theirs; ``itself`` counts as one before."""
        least = by_hub(others.select("seq", *RULES)).groupBy("other").agg(F.min("seq").alias("least"))
        near = staged(links.join(least, "other").groupBy("rule", "hub").agg(F.min("least").alias("least")))
        told = _beside(rows.select("*", *[F.col(r).alias(f"_{r}") for r in RULES]), near, "hub", "least", few)
        first = F.least(*[F.col(r) for r in RULES])
        before = first <= F.col("seq") if itself else first < F.col("seq")
        return told.where(~F.coalesce(before, F.lit(False))).select("id", "seq", "first_seen", *[F.col(f"_{r}").alias(r) for r in RULES])

    state, found = members if stored is None else staged(members.join(stored.select("id"), "id", "left_anti")), members.limit(0)
    for _ in range(rounds):
        if state.isEmpty():
            break
        founders = staged(free(state, state, False))
        found, state = found.union(founders), staged(free(state, founders, True))
    else:
        raise RuntimeError("drafts of this batch wait for each other in longer chains than rounds")

    founders = by_hub(found.withColumnsRenamed({"id": "kid", "seq": "kseq"}))
    # of a hub's founders, the best first, one that comes after a better one is nobody's match
    better = Window.partitionBy("hub").orderBy("order", "first_seen", "kid").rowsBetween(Window.unboundedPreceding, -1)
    reached = links.join(founders, "other").withColumn("order", -F.col("score")).withColumn("before", F.min("kseq").over(better)).where("before is null or kseq < before")
    steps = staged(reached.groupBy("rule", "hub").agg(F.array_sort(F.collect_list(F.struct("order", "first_seen", "kid", "kseq"))).alias("steps")))

    def inside(rule: str) -> Column:
        one = F.get(F.filter(F.col(rule), lambda f: f["kseq"] < F.col("seq")), F.lit(0))
        return F.when(one.isNotNull(), F.struct(F.lit(RULES[rule][0]).alias("rule"), one["order"].alias("order"), one["first_seen"].alias("first_seen"), one["kid"].alias("kid")))

    best = _beside(members, steps, "hub", "steps", few).select("id", F.coalesce(*[inside(r) for r in RULES]).alias("b"))
    return _told(best, F.col("b")) if stored is None else _told(best.join(stored, "id", "left").select("id", F.least("b", "m").alias("b")), F.col("b"))


def by_name(wanted: DataFrame, offered: DataFrame) -> DataFrame:
    """(doc, name, found) for names of a document (doc, name) among those offered for it (doc, other): equal
    in normal form, else the first in order of ``place`` that contains it or is contained."""
    w = wanted.select("doc", "name", normalise(F.col("name")).alias("n"))
    o = offered.select("doc", "place", "other", normalise(F.col("other")).alias("m")).where("m <> ''").groupBy("doc").agg(F.collect_list(F.struct("place", "other", "m")).alias("offers"))
    # a document's offers meet its names as one row: no pairs of both are sorted
    n = F.col("n")
    fits = F.filter("offers", lambda o: (n == o["m"]) | F.contains(n, o["m"]) | F.contains(o["m"], n))
    found = F.array_min(F.transform(fits, lambda o: F.struct((n != o["m"]).alias("x"), o["place"], o["other"])))["other"]
    return w.join(o, "doc", "left").select("doc", "name", found.alias("found"))


def uncached(documents: DataFrame, cache: DataFrame, keys: tuple[str, ...] = ("content_hash", "prompt_version", "model", "model_version")) -> DataFrame:
    """Documents whose answer is not in the cache under all of its keys. Outages are answers that were
    never remembered, so they are asked again."""
    return documents.join(cache.where("status <> 'UNAVAILABLE'").select(*keys).distinct(), list(keys), "left_anti")
