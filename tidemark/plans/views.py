"""The driver's tables seen as the domain's: text of SELECTs that Spark and DuckDB both read.

Mappings are fixed integer arithmetic on keys, so that all branches of the rules occur.
"""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import DataFrame, SparkSession

TODAY = date(1998, 6, 15)

SOURCE = """
    SELECT concat('s', s_suppkey) AS id, s_name AS name, n_name AS institution, CAST(1 + s_suppkey % 4 AS INT) AS trust_level,
           s_nationkey AS priority, s_suppkey % 10 <> 0 AS enabled,
           CASE WHEN s_suppkey % 4 = 2 THEN 'CANDIDATE' ELSE 'TRUSTED' END AS trust_status,
           concat('https://www.', lower(replace(n_name, ' ', '-')), '.example/', s_suppkey) AS base_url,
           CAST(s_suppkey % 5 AS INT) AS expected_min, CAST(s_suppkey % 7 * 10 AS INT) AS max_documents
    FROM supplier JOIN nation ON s_nationkey = n_nationkey"""

OPPORTUNITY = """
    SELECT o_orderkey AS id, concat('Prefeitura Municipal de ', n_name) AS institution,
           concat('Concurso Público ', o_orderpriority, ' ', c_mktsegment) AS name,
           CASE WHEN o_orderkey % 3 = 0 THEN concat(CAST(o_custkey % 90 + 10 AS STRING), '/', CAST(year(o_orderdate) AS STRING)) END AS number,
           CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) - 10 END AS published,
           CAST(o_orderdate AS DATE) AS start,
           CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + 30 END AS deadline,
           CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + 60 END AS exam,
           CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) + 5 END AS exemption,
           CAST(o_orderdate AS DATE) + 31 AS payment,
           CAST(floor(o_totalprice / 1000) AS INT) AS fee,
           CASE o_orderstatus WHEN 'O' THEN 'EDITAL_PUBLISHED' WHEN 'F' THEN 'HOMOLOGATED' ELSE 'SUSPENDED' END AS status,
           CASE o_orderkey % 4 WHEN 0 THEN 'PERMANENT' WHEN 1 THEN 'TEMPORARY' WHEN 2 THEN 'SELECTION' ELSE 'UNKNOWN' END AS employment_type,
           CAST(CASE WHEN o_orderkey % 17 = 0 THEN 2 ELSE 0 END AS INT) AS conflicts,
           o_orderkey % 13 = 0 AS needs_review, CAST(o_orderkey % 9 AS INT) AS attempts,
           CAST(1 + o_custkey % 4 AS INT) AS trust_level, concat('s', o_custkey % 40) AS source_id,
           CAST(o_orderdate AS TIMESTAMP) AS updated_at
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""

POSITION = """
    SELECT l_orderkey AS opportunity, concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS position, p_name AS cargo,
           CASE WHEN l_linenumber = 6 THEN NULL ELSE CAST(l_quantity AS INT) END AS weekly,
           CAST(floor(l_extendedprice) AS INT) AS salary,
           CASE l_returnflag WHEN 'N' THEN 'higher_education' ELSE 'high_school' END AS education,
           l_linestatus = 'O' AS assignment_confirmed,
           CASE l_partkey % 3 WHEN 0 THEN 'Rio Branco' WHEN 1 THEN 'Cruzeiro do Sul' END AS location,
           CASE l_partkey % 4 WHEN 3 THEN 'OTHER ADDITIONAL REQUIREMENT' ELSE 'HIGH SCHOOL ONLY' END AS qualification,
           CAST(l_suppkey % 20 AS INT) AS vacancies
    FROM lineitem JOIN part ON l_partkey = p_partkey"""

ATTEMPT = """
    SELECT concat('s', user_id % 40) AS source_id, event_id AS seq, CAST(ts AS TIMESTAMP) AS moment, event_type <> 'error' AS success,
           CAST(CASE WHEN event_type = 'error' THEN 0 ELSE floor(value) END AS INT) AS found,
           CAST(CASE WHEN event_type <> 'error' THEN 200 WHEN event_id % 2 = 0 THEN 503 END AS INT) AS status,
           CAST(0 AS INT) AS expected_min, CAST(ts AS DATE) AS day
    FROM events"""

NOTIFICATION = """
    SELECT concat('console:', event_id) AS key, CASE WHEN event_type = 'purchase' THEN 'CHANGE' ELSE 'DEADLINE' END AS category,
           CASE event_id % 6 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'RETRY' WHEN 2 THEN 'SENT' WHEN 3 THEN 'FAILED' WHEN 4 THEN 'UNCERTAIN' ELSE 'SENT' END AS status,
           CAST(event_id % 5 AS INT) AS attempts, CAST(ts AS TIMESTAMP) AS created_at,
           CASE WHEN event_id % 4 = 0 THEN CAST(ts AS TIMESTAMP) + INTERVAL 3 DAY END AS not_before
    FROM events WHERE event_type IN ('purchase', 'signup')"""

TRACKING = """
    SELECT event_id % 4999 AS opportunity, event_id AS note, CAST(ts AS TIMESTAMP) AS updated_at,
           CASE event_id % 3 WHEN 0 THEN 'INTERESTED' WHEN 1 THEN 'REGISTERED' ELSE 'DISMISSED' END AS decision
    FROM events WHERE event_type = 'click'"""

VERSION = """
    SELECT concat('doc://', source, '/', doc_id % 50) AS url, doc_id, text, coalesce(n_chars, 0) AS n_chars
    FROM documents"""

VIEWS = {"v_source": SOURCE, "v_opportunity": OPPORTUNITY, "v_position": POSITION, "v_attempt": ATTEMPT,
         "v_notification": NOTIFICATION, "v_tracking": TRACKING, "v_version": VERSION}
_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain view over the tables in a folder; no temporary views are left behind."""
    used = {t for t in _TABLES if re.search(rf"\b{t}\b", VIEWS[name].split("FROM")[1])}
    text = VIEWS[name]
    head, tail = text.rsplit("FROM", 1)
    for t in used:
        tail = re.sub(rf"\b{t}\b", f"{{{t}}}", tail)
    return spark.sql(f"{head}FROM{tail}", **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def spread(rows: DataFrame, key: str, each: int | None = None) -> DataFrame:
    """Rows dealt to all cores by a key. A table in one file of one row group is read by one task, which must not be left
    alone with long work on each row; only the columns that the work needs should come here. ``each``: counted rows that
    a task may hold, so that its memory does not grow with the table."""
    spark = rows.sparkSession
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts if each is None else max(parts, -(-rows.count() // each)), key)


def with_views(sql: str) -> str:
    """DuckDB SQL with the views it names in front."""
    used = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    if not used:
        return sql
    parts = ", ".join(f"{n} AS ({VIEWS[n]})" for n in used)
    head = re.match(r"(?i)\s*with( recursive)?\s", sql)
    return f"WITH{head[1] or ''} {parts}, {sql[head.end():]}" if head else f"WITH {parts} {sql}"
