"""An inverted index of character grams, for words that are looked for inside others.

Every text is filed under its distinct grams of one to three characters; a gram's texts are kept in posting
lists, cut into blocks by a hash of the key so that a gram of every text stays a bounded row. A request is
looked up by the rarest gram of all its words, and only the texts filed there are searched for the words. So
both steps are joins on keys, and what they read grows with what is found rather than with requests times texts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from tidemark.sources import store

LONGEST, LIST = 3, 65_536
#: Counted rows up to which grams and requests are broadcast.
SMALL = 200_000
#: Asked grams, or words of a batch without a kept index, up to which each is looked for in every text.
FEW = 200


def grams(text: Column, lengths: tuple[int, ...] = (1, 2, 3)) -> Column:
    """The distinct grams of a text, of every length that it has."""
    size = F.length(text)
    each = [F.when(size >= n, F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>")) for n in lengths]
    return F.array_distinct(F.concat(*each))


def word_grams(word: Column) -> Column:
    """The grams a word is looked up by: the longest it has."""
    return F.when(F.length(word) >= LONGEST, grams(word, (LONGEST,))).otherwise(F.array(word))


@dataclass(frozen=True)
class Index:
    """texts: key, hay. postings: gram, block, n, keys; both written tables."""

    texts: DataFrame
    postings: DataFrame


def build(texts: DataFrame, key: str, hay: str, only: DataFrame | None = None, written: bool = False) -> Index:
    """An index of ``hay`` by ``key``; with ``only`` (gram), of the grams that some requests ask for. Lists are sorted by
    gram, so a read of a few grams skips the row groups of all others. Null texts are in no list. ``written``: the texts
    are a stored table already."""
    rows = texts.select(F.col(key).alias("key"), F.col(hay).alias("hay"))
    rows = rows if written else store.staged(rows)
    blocks = max(1, -(-rows.count() // LIST))
    few = [] if only is None else [r.gram for r in only.limit(FEW + 1).collect()]      # FEW + 1 rows at most
    if 0 < len(few) <= FEW:
        # some grams are sooner looked for in a text than picked out of all of its grams
        each = rows.select("key", F.explode(F.filter(F.array(*[F.lit(g) for g in few]), lambda g: F.contains("hay", g))).alias("gram"))
    else:
        each = rows.where("hay is not null").select("key", F.explode(grams(F.col("hay"))).alias("gram"))
    if len(few) > FEW:
        each = each.join(F.broadcast(only) if only.count() <= SMALL else only, "gram", "left_semi")
    lists = each.groupBy("gram", F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block")).agg(F.collect_set("key").alias("keys"))
    lists = lists.select("gram", "block", F.size("keys").alias("n"), "keys").repartitionByRange("gram", "block").sortWithinPartitions("gram", "block")
    return Index(rows, store.staged(lists))


def asked_grams(asked: DataFrame) -> DataFrame:
    """(request, gram): all grams that a request (request, words) could be looked up by."""
    return asked.select("request", F.explode(F.flatten(F.transform("words", word_grams))).alias("gram")).distinct()


def lookup(index: Index, asked: DataFrame) -> DataFrame:
    """(request, key) of the texts that hold every word of a request (request, words: normal forms, not empty)."""
    by_gram = store.staged(asked_grams(asked))
    few = by_gram.count() <= SMALL
    wanted = by_gram.select("gram").distinct()
    counted = index.postings.join(F.broadcast(wanted) if few else wanted, "gram", "left_semi").groupBy("gram").agg(F.sum("n").alias("n"))
    # a gram without a list answers at once: nothing holds the word
    rarest = by_gram.join(counted, "gram", "left").groupBy("request").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))["gram"].alias("gram"))
    probes = store.staged(rarest.join(asked.select("request", "words"), "request"))
    lists = index.postings.select("gram", "keys")
    found = lists.join(F.broadcast(probes) if few else probes, "gram").select("request", "words", F.explode("keys").alias("key"))
    return found.join(index.texts, "key").where(F.forall("words", lambda w: F.contains("hay", w))).select("request", "key")


def few(asked: DataFrame) -> list[Row] | None:
    """The rows of a batch of requests (words among their columns) that hold few words in all, else None."""
    rows = asked.limit(FEW + 1).collect()      # FEW + 1 rows at most
    return rows if len(rows) <= FEW and sum(len(r.words or ()) for r in rows) <= FEW else None


def holds(hay: Column, words: list[str]) -> Column:
    return reduce(and_, [hay.contains(w) for w in words], F.lit(True))


def scanned(texts: DataFrame, wanted: list[tuple[object, Column]], kind: DataType) -> DataFrame:
    """``texts`` with the ``request``s (of type ``kind``) whose condition they meet: one pass without lists or joins, for
    a batch of few words."""
    met = F.array_compact(F.array(*[F.when(cond, F.lit(request).cast(kind)) for request, cond in wanted]).cast(f"array<{kind.simpleString()}>"))
    return texts.withColumn("request", F.explode(F.array_distinct(met)))
