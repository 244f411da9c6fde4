"""Operator 13: how far the sources of a language diverge in their words, by wide term vectors.

Words are counted by language, source and term with partial aggregates in front of the one shuffle of
terms. Each kept term is then pivoted into an array with a place for every source of its language;
higher-order functions turn the counts into smoothed shares and emit the contributions of pairs of sources,
which partial sums fold before they are shuffled. A row is as wide as its language has sources, and an
emission as the sources behind one of them; the pairs themselves are the result asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut

#: The contract's term: letters of ASCII and everything beyond it.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
NOT_TERM = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000
SMALL = 1_000_000


def _share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(10^9 * (count + 2) / (n + 2v)), in decimals of 38 digits: exact at any size of a corpus."""
    up = (count.cast("decimal(18,0)") + 2) * F.lit(SCALE).cast("decimal(10,0)")
    return 1 + F.call_function("div", up, n.cast("decimal(19,0)") + 2 * v.cast("decimal(17,0)"))


def _distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of longs of at most 10^9 + 1: the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def terms(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(lang, source, term, count, docs): occurrences, and documents that hold the term. A document's terms are sorted,
    so that a term's first occurrence shows without a shuffle by document."""
    blank = F.lit("")
    words = F.split(F.translate(F.coalesce(F.col(text_col), blank), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), NOT_TERM)
    rows = docs.select(F.coalesce(F.col(lang_col), blank).alias("_lang"), F.coalesce(F.col(source_col), blank).alias("_source"), F.sort_array(words).alias("_words"))
    first = F.transform("_words", lambda w, i: F.struct(w.alias("_term"), (i == 0) | (w != F.get("_words", i - 1))))
    return rows.select("_lang", "_source", F.inline(first).alias("_term", "_new")).where("_term <> ''").groupBy("_lang", "_source", "_term").agg(
        F.count(F.lit(1)).alias("_count"), F.count_if("_new").alias("_docs"))


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = 10, top: int = 10) -> DataFrame:
    """One row per language, source and item: part 'pair' (every other source of the language, by distance) and
    part 'term' (the terms that set the source apart most, ``top`` of them), with value and rank.

    Defined cases: a null text, language or source is the empty string, which is a language or source like any other;
    a source without terms has pairs but no terms; a language with one source has no pairs, one without kept terms
    has distances of 0; repeated rows are documents of their own; ties go by the item's bytes; an empty table
    gives an empty one; other columns are ignored, whatever their names.
    """
    blank = F.lit("")
    groups = docs.select(F.coalesce(F.col(lang_col), blank).alias("_lang"), F.coalesce(F.col(source_col), blank).alias("_source")).distinct()
    groups = cut(groups, "groups")
    found = cut(terms(docs, text_col, lang_col, source_col), "terms")
    known = found.groupBy("_lang", "_term").agg(F.sum("_docs").alias("_docs"), F.collect_list(F.struct("_source", "_count")).alias("_by")).where(F.col("_docs") >= least)
    known = cut(known.select("_lang", "_term", F.map_from_entries("_by").alias("_by"), F.aggregate("_by", F.lit(0).cast("long"), lambda s, x: s + x["_count"]).alias("_all")), "vectors")
    sizes = known.select("_lang", F.explode("_by").alias("_source", "_count")).groupBy("_lang", "_source").agg(F.sum("_count").alias("_n"))
    kept = known.groupBy("_lang").agg(F.count(F.lit(1)).alias("_v"))
    # one row a language: its sources in order, and their sizes
    axis = groups.join(sizes, ["_lang", "_source"], "left").groupBy("_lang").agg(
        F.array_sort(F.collect_list(F.struct("_source", F.coalesce("_n", F.lit(0)).alias("_n")))).alias("_axis"))
    axis = cut(axis.join(kept, "_lang", "left").select(
        "_lang", F.col("_axis._source").alias("_sources"), F.col("_axis._n").alias("_sizes"), F.coalesce("_v", F.lit(0)).alias("_v"),
        F.aggregate("_axis", F.lit(0).cast("long"), lambda s, x: s + x["_n"]).alias("_total")), "axis")
    few = groups.count() <= SMALL
    wide = known.join(F.broadcast(axis) if few else axis, "_lang").select(
        "_lang", "_term", "_sources",
        F.transform("_sources", lambda s: F.coalesce(F.element_at("_by", s), F.lit(0).cast("long"))).alias("_counts"), "_sizes", "_v",
        _share(F.col("_all"), F.col("_total"), F.col("_v")).alias("_q"))
    wide = cut(wide.select(
        "_lang", "_term", "_sources", "_counts", "_q",
        F.zip_with("_counts", "_sizes", lambda c, n: _share(c, n, F.col("_v"))).alias("_p")), "shares")

    one = wide.select("_lang", F.posexplode("_p").alias("_i", "_pi"), "_p")
    behind = F.transform(F.slice("_p", F.col("_i") + 2, F.size("_p")), lambda q, k: F.struct(k + F.col("_i") + 1, _distance(F.col("_pi"), q)))
    sums = one.select("_lang", "_i", F.inline(behind).alias("_j", "_f")).groupBy("_lang", "_i", "_j").agg(F.sum("_f").alias("_f"))
    sums = sums.select("_lang", F.explode(F.array(F.struct("_i", "_j", "_f"), F.struct(F.col("_j").alias("_i"), F.col("_i").alias("_j"), "_f"))).alias("_s")).select("_lang", "_s.*")
    places = axis.select("_lang", F.posexplode("_sources").alias("_i", "_source"), "_sources").select("_lang", "_i", "_source", F.posexplode("_sources").alias("_j", "_item")).where("_i <> _j")
    pairs = places.join(sums, ["_lang", "_i", "_j"], "left").select(
        "_lang", "_source", F.lit("pair").alias("_part"), "_item", F.coalesce("_f", F.lit(0)).cast("long").alias("_value"))

    apart = wide.select("_lang", "_term", "_q", F.inline(F.arrays_zip("_sources", "_counts", "_p")).alias("_source", "_count", "_p")).where("_count > 0 and _p > _q")
    marked = apart.select("_lang", "_source", F.lit("term").alias("_part"), F.col("_term").alias("_item"), _distance(F.col("_p"), F.col("_q")).alias("_value"))
    order = Window.partitionBy("_lang", "_source").orderBy(F.desc("_value"), F.asc("_item"))
    ranked = pairs.withColumn("_rank", F.row_number().over(order)).unionByName(marked.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= top))
    return ranked.select(*[F.col(f"_{c}").alias(c) for c in ("lang", "source", "part", "item", "value")], F.col("_rank").cast("int").alias("rank"))
