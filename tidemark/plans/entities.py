"""Queries over resolution, merge, history, alerting and interval operators."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import history, intervals, merge, outbox, resolve
from tidemark.plans.relational import _PAIRS, note, opp, pairs, q
from tidemark.plans.views import spread


@q("e01_institution_key", "SELECT o_orderkey AS id, concat('prefeitura-', replace(lower(n_name), '_', '-')) AS key FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def institution_keys(spark, sf):
    return opp(spark, sf).select("id", resolve.institution_key(F.col("institution")).alias("key"))


@q("e02_token_sets", "SELECT p_partkey, list_sort(list_distinct(list_filter(string_split(lower(p_name), ' '), lambda w: length(w) > 2))) AS tokens FROM part")
def tokens(spark, sf):
    return view_part(spark, sf).select("p_partkey", F.array_sort(resolve.token_set(F.col("p_name"))).alias("tokens"))


def view_part(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/part.parquet")


@q("e03_jaccard", """WITH t AS (SELECT p_partkey, list_distinct(list_filter(string_split(lower(p_name), ' '), lambda w: length(w) > 2)) AS a, list_distinct(list_filter(string_split(lower(concat(p_name, ' ', p_type)), ' '), lambda w: length(w) > 2)) AS b FROM part)
    SELECT p_partkey, round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 6) AS similarity FROM t""")
def similarities(spark, sf):
    both = F.concat_ws(" ", "p_name", "p_type")
    return view_part(spark, sf).select("p_partkey", F.round(resolve.jaccard(resolve.token_set(F.col("p_name")), resolve.token_set(both)), 6).alias("similarity"))


@q("e04_dedup_key", """SELECT id, CASE WHEN number IS NOT NULL THEN concat(k, ':edital:', number) ELSE concat(k, ':', coalesce(year(published), 1900), ':', sig) END AS key FROM
    (SELECT *, concat('prefeitura-', replace(lower(substr(institution, 25)), '_', '-')) AS k,
        array_to_string(list_sort(list_filter(list_distinct(string_split(lower(regexp_replace(name, '[^A-Za-z0-9]+', ' ', 'g')), ' ')), lambda w: length(w) > 2 AND w NOT IN ('concurso', 'blico', 'publico', 'p'))), '-') AS sig FROM v_opportunity)""")
def dedup_keys(spark, sf):
    return opp(spark, sf).select("id", resolve.dedup_key(F.col("institution"), F.col("number"), F.col("published"), F.col("name")).alias("key"))


@q("e06_position_slug", "SELECT p_partkey, replace(lower(p_name), ' ', '-') AS slug FROM part")
def slugs(spark, sf):
    return view_part(spark, sf).select("p_partkey", resolve.position_slug(F.col("p_name")).alias("slug"))


@q("e05_match_cascade", """WITH o AS (SELECT CAST(id AS VARCHAR) AS id, id AS n, number, year(published) AS y, employment_type AS board, start AS seen, id % 5000 AS u, id % 4000 AS h,
        CASE WHEN number IS NOT NULL THEN concat(k, ':edital:', number) ELSE concat(k, ':', coalesce(year(published), 1900), ':', array_to_string(list_sort(t), '-')) END AS key, t
    FROM (SELECT *, concat('prefeitura-', replace(lower(substr(institution, 25)), '_', '-')) AS k,
        list_filter(list_distinct(string_split(lower(regexp_replace(name, '[^A-Za-z0-9]+', ' ', 'g')), ' ')), lambda w: length(w) > 2 AND w NOT IN ('concurso', 'blico', 'publico', 'p')) AS t FROM v_opportunity)),
    d AS (SELECT * FROM o WHERE n % 2 = 1), k AS (SELECT * FROM o WHERE n % 2 = 0),
    c AS (SELECT t, y, board, min({'seen': seen, 'id': id}) AS one FROM k GROUP BY ALL), dc AS (SELECT DISTINCT t, y, board FROM d),
    s AS (SELECT dc.*, c.one, len(list_intersect(dc.t, c.t))::DOUBLE / len(list_distinct(list_concat(dc.t, c.t))) + CASE WHEN dc.board = c.board THEN 0.08::DOUBLE ELSE 0.0::DOUBLE END AS score FROM dc JOIN c ON coalesce(dc.y = c.y, true)),
    hit AS (SELECT d.id, 1 AS rule, 'dedup_key' AS reason, 0.0::DOUBLE AS score, k.seen, k.id AS kid FROM d JOIN k ON d.key = k.key
        UNION ALL SELECT d.id, 2, 'document_hash', 0.0, k.seen, k.id FROM d JOIN k ON d.h = k.h UNION ALL SELECT d.id, 3, 'url', 0.0, k.seen, k.id FROM d JOIN k ON d.u = k.u
        UNION ALL SELECT d.id, 4, 'edital_number', 0.0, k.seen, k.id FROM d JOIN k ON d.number = k.number
        UNION ALL SELECT d.id, 5, 'similarity', s.score, s.one.seen, s.one.id FROM d JOIN s ON d.t = s.t AND d.y IS NOT DISTINCT FROM s.y AND d.board = s.board WHERE s.score >= 0.62)
    SELECT d.id AS draft, kid AS known, coalesce(reason, 'new') AS reason FROM d LEFT JOIN (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY id ORDER BY rule, score DESC, seen, kid) = 1) b ON b.id = d.id""")
def matches(spark, sf):
    """Even orders are stored, odd ones are drafts; each draft finds its opportunity and the rule."""
    o = opp(spark, sf).select(F.col("id").cast("string").alias("id"), "institution", "name", "number", "published", F.col("employment_type").alias("board"),
                              F.concat(F.lit("u"), F.col("id") % 5000).alias("url"), F.concat(F.lit("h"), F.col("id") % 4000).alias("document_hash"), F.col("start").alias("first_seen"), F.col("id").alias("n"))
    o = spread(o, "id", 500_000)
    known = o.where("n % 2 = 0").withColumn("urls", F.array("url")).withColumn("hashes", F.array("document_hash"))
    return resolve.match(o.where("n % 2 = 1"), known)


_TOKENS = """list_sort(list_filter(list_distinct(string_split(lower(regexp_replace({}, '[^A-Za-z0-9]+', ' ', 'g')), ' ')), lambda w: length(w) > 2 AND w NOT IN ('concurso', 'blico', 'publico', 'p', 'prefeitura')))"""
_JACCARD = "len(list_intersect({0}, {1}))::DOUBLE / len(list_distinct(list_concat({0}, {1})))"


@q("e05_batch_cascade", f"""WITH RECURSIVE o AS (SELECT CAST(id AS VARCHAR) AS id, start AS seen, number, year(published) AS y, employment_type AS board, id % 97 AS u, id % 211 AS h, it, nt,
        grp, institution, CASE WHEN number IS NOT NULL THEN concat(k, ':edital:', number) ELSE concat(k, ':', coalesce(year(published), 1900), ':', array_to_string(nt, '-')) END AS key,
        row_number() OVER (PARTITION BY grp ORDER BY id) AS pos
        FROM (SELECT *, {_TOKENS.format("institution")} AS it, {_TOKENS.format("name")} AS nt, concat('prefeitura-', grp) AS k FROM (SELECT * REPLACE (CASE WHEN id % 2 = 0 THEN concat('Prefeitura Municipal de ', grp) ELSE concat('Prefeitura de ', grp) END AS institution)
            FROM (SELECT *, translate(replace(institution, 'Prefeitura Municipal de NATION_', 'city'), '0123456789', 'abcdefghij') AS grp FROM v_opportunity)))),
    r AS (SELECT grp, pos, id AS draft, CAST(NULL AS VARCHAR) AS known, 'new' AS reason, [{{'id': id, 'seen': seen, 'number': number, 'y': y, 'board': board, 'u': u, 'h': h, 'it': it, 'nt': nt, 'inst': institution, 'key': key}}] AS founders FROM o WHERE pos = 1
        UNION ALL SELECT grp, pos, id, best.id, coalesce(['dedup_key', 'document_hash', 'url', 'edital_number', 'similarity'][best.rule], 'new'),
            CASE WHEN best IS NULL THEN list_append(founders, {{'id': id, 'seen': seen, 'number': number, 'y': y, 'board': board, 'u': u, 'h': h, 'it': it, 'nt': nt, 'inst': institution, 'key': key}}) ELSE founders END
        FROM (SELECT c.*, r.founders, list_sort(list_filter(list_transform(r.founders, lambda f: {{'rule': CASE WHEN c.key = f.key THEN 1 WHEN c.institution = f.inst AND c.h = f.h THEN 2 WHEN c.institution = f.inst AND c.u = f.u THEN 3
                WHEN c.number = f.number AND {_JACCARD.format("c.it", "f.it")} >= 0.34 THEN 4
                WHEN {_JACCARD.format("c.it", "f.it")} >= 0.5 AND coalesce(c.y = f.y, true) AND {_JACCARD.format("c.nt", "f.nt")} + CASE WHEN c.board = f.board THEN 0.08::DOUBLE ELSE 0.0::DOUBLE END >= 0.62 THEN 5 END,
                'score': CASE WHEN c.key = f.key OR c.institution = f.inst AND (c.h = f.h OR c.u = f.u) OR c.number = f.number AND {_JACCARD.format("c.it", "f.it")} >= 0.34 THEN 0.0::DOUBLE
                ELSE -({_JACCARD.format("c.nt", "f.nt")} + CASE WHEN c.board = f.board THEN 0.08::DOUBLE ELSE 0.0::DOUBLE END) END, 'seen': f.seen, 'id': f.id}}), lambda x: x.rule IS NOT NULL))[1] AS best
            FROM r JOIN o c ON c.grp = r.grp AND c.pos = r.pos + 1))
    SELECT draft, known, reason FROM r""")
def batch_matches(spark, sf):
    """All orders as drafts of one batch, in order: each founds an opportunity or belongs to an earlier one."""
    city = F.translate(F.replace("institution", F.lit("Prefeitura Municipal de NATION_"), F.lit("city")), "0123456789", "abcdefghij")
    body = F.concat(F.when(F.col("id") % 2 == 0, "Prefeitura Municipal de ").otherwise("Prefeitura de "), city)
    o = opp(spark, sf).withColumn("institution", body).select(F.col("id").cast("string").alias("id"), F.col("id").alias("seq"), "institution", "name", "number", "published", F.col("employment_type").alias("board"),
                              F.concat("institution", F.lit("/u"), F.col("id") % 97).alias("url"), F.concat("institution", F.lit("/h"), F.col("id") % 211).alias("document_hash"), F.col("start").alias("first_seen"))
    none = o.limit(0).withColumn("urls", F.array("url")).withColumn("hashes", F.array("document_hash"))
    return resolve.match_batch(spread(o, "id", 500_000), none)


def claims(spark: SparkSession, sf: str) -> DataFrame:
    """Field values of a customer's orders as documents of one entity, with their authority."""
    o = spark.read.parquet(f"{sf}/orders.parquet").select(
        F.col("o_custkey").alias("entity"), F.col("o_orderkey").alias("seq"), merge.authority(1 + F.col("o_orderkey") % 4, F.col("o_orderkey") % 2 == 0).alias("authority"),
        F.when(F.col("o_orderkey") % 6 != 0, F.to_date("o_orderdate").cast("string")).alias("registration_deadline"),
        F.when(F.col("o_orderkey") % 5 != 0, F.floor(F.col("o_totalprice") / 100000).cast("string")).alias("application_fee"),
        F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")).alias("validity"))
    return o.selectExpr("entity", "seq", "cast(authority as int) as authority", "stack(3, 'registration_deadline', registration_deadline, 'application_fee', application_fee, 'validity', validity) as (field, value)")


_FOLD = """WITH RECURSIVE o AS (SELECT o_custkey AS entity, o_orderkey AS seq, (1 + o_orderkey % 4) * 10 + CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 5 END AS authority,
        unnest(['registration_deadline', 'application_fee', 'validity']) AS field,
        unnest([CASE WHEN o_orderkey % 6 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(CAST(floor(o_totalprice / 100000) AS BIGINT) AS VARCHAR) END, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END]) AS value FROM orders),
    c AS (SELECT *, row_number() OVER (PARTITION BY entity, field ORDER BY seq) AS n FROM o),
    f AS (SELECT entity, field, n, seq AS now, value AS said, CAST(NULL AS VARCHAR) AS was, true AS won, value AS cur, CASE WHEN value IS NOT NULL THEN authority END AS auth, CASE WHEN value IS NOT NULL THEN seq END AS since, authority AS best FROM c WHERE n = 1
        UNION ALL SELECT c.entity, c.field, c.n, c.seq, c.value, f.cur, c.authority <= f.best,
            CASE WHEN takes(c.value, f.cur, c.authority, f.best) THEN c.value ELSE f.cur END, CASE WHEN takes(c.value, f.cur, c.authority, f.best) THEN c.authority ELSE f.auth END,
            CASE WHEN takes(c.value, f.cur, c.authority, f.best) THEN c.seq ELSE f.since END, least(f.best, c.authority)
        FROM f JOIN c ON c.entity = f.entity AND c.field = f.field AND c.n = f.n + 1)
    """
_FOLD = re.sub(r"takes\((\S+), (\S+), (\S+), (\S+)\)", r"(\1 IS NOT NULL AND (\2 IS NULL OR (\1 <> \2 AND \3 <= \4)))", _FOLD)


@q("e09_merged_fields", _FOLD + "SELECT entity, field, cur AS value, CAST(auth AS INT) AS authority, since AS seq FROM f WHERE cur IS NOT NULL QUALIFY n = max(n) OVER (PARTITION BY entity, field)")
def merged(spark, sf):
    return merge.merged(claims(spark, sf))


@q("e09_conflicts", _FOLD + "SELECT entity, now AS seq, field, was AS old_value, said AS new_value, won AS replaced FROM f WHERE n > 1 AND said <> was AND field <> 'validity' QUALIFY row_number() OVER (PARTITION BY entity ORDER BY now DESC, field DESC) <= 60")
def conflicts(spark, sf):
    return merge.conflicts(claims(spark, sf))


@q("e15_changes", """WITH v AS (SELECT o_custkey AS entity, o_orderkey, o_orderpriority AS value, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version FROM orders),
    w AS (SELECT *, lag(value) OVER (PARTITION BY entity ORDER BY version) AS old FROM v)
    SELECT entity, CAST(version AS INT) AS version, old AS raw_old, value AS raw_new, false AS information_lost, false AS alertable FROM w WHERE version > 1 AND old <> value""")
def changes(spark, sf):
    from pyspark.sql import Window

    o = spark.read.parquet(f"{sf}/orders.parquet")
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    snaps = o.select(F.lit("opportunity").alias("scope"), F.col("o_custkey").alias("entity"), n.alias("version"), F.lit("validity").alias("field"), F.col("o_orderpriority").alias("value"))
    return history.changes(snaps).select("entity", "version", "raw_old", "raw_new", "information_lost", "alertable")


@q("e16_position_changes", """WITH b AS (SELECT DISTINCT l_orderkey AS entity, l_partkey AS slug FROM lineitem WHERE l_linenumber <= 4), a AS (SELECT DISTINCT l_orderkey AS entity, l_partkey AS slug FROM lineitem WHERE l_linenumber >= 4)
    SELECT coalesce(a.entity, b.entity) AS entity, coalesce(a.slug, b.slug) AS slug, b.slug IS NULL AS alertable, a.slug IS NULL AS information_lost FROM a FULL JOIN b ON a.entity = b.entity AND a.slug = b.slug WHERE a.slug IS NULL OR b.slug IS NULL""")
def position_changes(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").alias("entity"), F.col("l_partkey").alias("slug"), F.col("l_partkey").cast("string").alias("name"), "l_linenumber")
    pick = lambda c: li.where(c).dropDuplicates(["entity", "slug"])
    return history.position_changes(pick("l_linenumber <= 4"), pick("l_linenumber >= 4")).select("entity", "slug", "alertable", "information_lost")


@q("e12_merge_positions", """WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem),
    p AS (SELECT l_orderkey AS entity, l_partkey % 3 AS slug, n, n % 3 = 0 AS synthetic, concat('cargo ', l_partkey) AS name, CASE WHEN n % 2 = 0 THEN l_extendedprice END AS salary, CASE WHEN l_linestatus = 'O' THEN l_quantity END AS weekly,
        CASE WHEN n > 2 THEN l_suppkey END AS vacancies, l_linestatus = 'O' AS confirmed FROM l), r AS (SELECT *, bool_or(NOT synthetic) OVER (PARTITION BY entity) AS has_real FROM p)
    SELECT entity, slug, arg_min(name, n) AS name, arg_min(salary, n) FILTER (salary IS NOT NULL) AS salary, arg_min(weekly, n) FILTER (weekly IS NOT NULL) AS weekly, arg_min(vacancies, n) FILTER (vacancies IS NOT NULL) AS vacancies, bool_or(confirmed) AS confirmed
    FROM r WHERE NOT (synthetic AND has_real) GROUP BY entity, slug""")
def merged_positions(spark, sf):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    li = spark.read.parquet(f"{sf}/lineitem.parquet").withColumn("n", n).select(
        F.col("l_orderkey").alias("entity"), (F.col("l_partkey") % 3).alias("slug"), F.col("n").alias("seq"), (F.col("n") % 3 == 0).alias("synthetic"), F.concat(F.lit("cargo "), "l_partkey").alias("name"),
        F.when(F.col("n") % 2 == 0, F.col("l_extendedprice")).alias("salary"), F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).alias("weekly"), F.when(F.col("n") > 2, F.col("l_suppkey")).alias("vacancies"), (F.col("l_linestatus") == "O").alias("confirmed"))
    return merge.merge_positions(li)


@q("e20_deadlines", "SELECT id, 'registration' AS kind, deadline AS due FROM v_opportunity WHERE deadline IS NOT NULL UNION ALL SELECT id, 'exam', exam FROM v_opportunity WHERE exam IS NOT NULL UNION ALL SELECT id, 'fee_exemption', exemption FROM v_opportunity WHERE exemption IS NOT NULL UNION ALL SELECT id, 'payment', payment FROM v_opportunity WHERE payment IS NOT NULL")
def deadlines(spark, sf):
    return history.deadlines(opp(spark, sf))


@q("a01_queue", "SELECT concat(c, ':', event_id % 700) AS key, c AS channel FROM events, (VALUES ('console'), ('markdown')) t(c) WHERE event_type = 'purchase' AND concat(c, ':', event_id % 700) NOT IN (SELECT key FROM v_notification) GROUP BY ALL")
def queue(spark, sf):
    new = spark.read.parquet(f"{sf}/events.parquet").where("event_type = 'purchase'").select((F.col("event_id") % 700).cast("string").alias("key"), F.col("ts").alias("created_at"))
    return outbox.queue(new, ("console", "markdown"), note(spark, sf)).select("key", "channel")


@q("a02_alerts", f"""WITH {_PAIRS}, t AS (SELECT id AS entity, position, eligible AND actionable AND dated AND conflicts = 0 AS first FROM pairs WHERE trust_level <= 2),
    n AS (SELECT entity, position FROM t WHERE first AND entity % 13 <> 0)
    SELECT entity, 'NEW_OPPORTUNITY' AS category, position AS subject FROM n UNION SELECT entity, 'CHANGE', 'weekly_workload' FROM t WHERE entity % 2 = 0 AND entity NOT IN (SELECT entity FROM n)
    UNION SELECT entity, 'WORKLOAD_KNOWN', 'weekly_workload' FROM t""")
def alerts(spark, sf):
    """Alerts of a run in which every thirteenth entity was announced before."""
    p = pairs(spark, sf).select(F.col("id").alias("entity"), "position", "trust_level", "primary_alert")
    changed = p.select("entity").distinct().select("entity", F.lit("weekly_workload").alias("field"), F.lit(None).cast("string").alias("raw_old"), F.lit("20").alias("raw_new"), (F.col("entity") % 2 == 0).alias("alertable"))
    return outbox.alerts(p, changed, p.select("entity").where("entity % 13 = 0").distinct())


@q("v_interval_merge", """WITH i AS (SELECT o_custkey AS customer, CAST(o_orderdate AS DATE) AS start, CAST(o_orderdate AS DATE) + 60 AS end_ FROM orders), r AS (SELECT *, max(end_) OVER (PARTITION BY customer ORDER BY start, end_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
    g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY customer ORDER BY start, end_ ROWS UNBOUNDED PRECEDING) AS island FROM r) SELECT customer, min(start) AS start, max(end_) AS end_, count(*) AS merged FROM g GROUP BY customer, island""")
def merged_intervals(spark, sf):
    i = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").alias("customer"), F.to_date("o_orderdate").alias("start"), F.date_add(F.to_date("o_orderdate"), 60).alias("end_"))
    return intervals.merge(i, ["customer"], "start", "end_")


@q("v_budget", "SELECT customer, id FROM (SELECT o_custkey AS customer, o_orderkey AS id, sum(CAST(floor(o_totalprice) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS used FROM orders) WHERE used <= 900000")
def budgeted(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("id"), F.floor("o_totalprice").alias("size"))
    return intervals.within_budget(o, ["customer"], ["id"], "size", 900_000).select("customer", "id")


@q("e10_equal_lists", """SELECT o_orderkey AS id, o_orderpriority = before.p AND o_orderstatus = before.s AS equal FROM (SELECT *, lag({'p': o_orderpriority, 's': o_orderstatus}) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders) WHERE before IS NOT NULL""")
def equal_lists(spark, sf):
    """Lists of two values against those of the customer's order before, written in another case and with other spaces."""
    from pyspark.sql import Window

    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey", F.to_json(F.array("o_orderpriority", "o_orderstatus")).alias("now"))
    before = F.lag("now").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = o.withColumn("before", F.replace(F.lower(before), F.lit('","'), F.lit('" , "'))).where("before is not null")
    return rows.select(F.col("o_orderkey").alias("id"), merge.same(F.col("before"), F.col("now"), F.lit("selection_stages")).alias("equal"))
