"""The operators' queries, op1 to op13, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import (
    conversations, cover_tree, divergence, exact_dedup, html_text, minhash, mixing, packing, quality, suffix_dedup, tokens, toxicity, url_filter)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="largest").drop("row_key")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_dedup(table(spark, sf_dir, "documents"), n=3, percent=85)


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_vectors(table(spark, sf_dir, "embeddings"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repaired(table(spark, sf_dir, "conversations"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages").select("page_id", "url"), url_filter.rules_of(spark)).drop("url")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_mixing": op2_mixing,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_packing": op4_packing,
        "op5_quality": op5_quality,
        "op6_token_counts": op6_token_counts,
        "op7_minhash": op7_minhash,
        "op8_html": op8_html,
        "op9_toxicity": op9_toxicity,
        "op10_cover_tree": op10_cover_tree,
        "op11_conversations": op11_conversations,
        "op12_url_filter": op12_url_filter,
        "op13_divergence": op13_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_exact_dedup": """
            select doc_id,
                   max(doc_id) over same as keep_id,
                   count(*) over same as group_size,
                   doc_id = max(doc_id) over same as kept,
                   sha256(coalesce(text, '')) as text_sha256
            from documents window same as (partition by coalesce(text, ''))""",
        "op12_url_filter": r"""
            with rules (verdict, host_is, path_is) as (values
                ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
            said as (
                select page_id, case when instr(coalesce(url, ''), '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
            parts as (
                select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                       regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path, row_number() over () as n
                from said),
            best as (
                select n, arg_max(host_is || path_is, length(host_is || path_is)) as rule, arg_max(verdict, length(host_is || path_is)) as verdict
                from parts join rules on (host = host_is or ends_with(host, '.' || host_is)) and starts_with(path, path_is) group by n),
            named as (
                select n, (select min(w) from (values ('adult'), ('bets'), ('casino'), ('spam')) as t(w)
                           where regexp_matches(lower(host || path), '(^|[^a-z0-9])' || w || '([^a-z0-9]|$)')) as word from parts)
            select page_id, host, path, rule, case when rule is null then '^' || word || '^' end as pattern,
                   coalesce(best.verdict, case when word is null then 'allow' else 'block' end) as verdict
            from parts left join best using (n) left join named using (n)""",
        "op13_divergence": r"""
            with docs as (
                select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as n,
                       regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as words
                from documents),
            words as (select lang, source, n, unnest(words) as term from docs),
            kept as (select lang, term, count(*) as everywhere from words group by all having count(distinct n) >= 10),
            langs as (select lang, count(*) as v, sum(everywhere) as n from kept group by lang),
            counts as (select lang, source, term, count(*) as c from words semi join kept using (lang, term) group by all),
            groups as (select distinct lang, source from docs),
            sizes as (select lang, source, coalesce(sum(c), 0) as n from groups left join counts using (lang, source) group by all),
            shares as (
                select g.lang, g.source, k.term, coalesce(c.c, 0) as c,
                       1 + (1000000000 * (coalesce(c.c, 0) + 2)::hugeint) // (g.n + 2 * l.v)::hugeint as p,
                       1 + (1000000000 * (k.everywhere + 2)::hugeint) // (l.n + 2 * l.v)::hugeint as q
                from sizes g join langs l using (lang) join kept k using (lang) left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term),
            pairs as (
                select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as f
                from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
            parts as (
                select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f, 0)::bigint as value
                from groups a join groups b on a.lang = b.lang and a.source <> b.source
                left join pairs p on p.lang = a.lang and p.source = a.source and p.item = b.source
                union all
                select lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::bigint from shares where c > 0 and p > q),
            ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from parts)
            select * from ranked where part = 'pair' or rank <= 10""",
    }
