"""The fixed relational queries (Q1 to Q53) over the domain views, and their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.score import TERMINAL, accepting, effective_status, evaluate, rank
from tidemark.functions.text import normalise, plain
from tidemark.operators import health, outbox, registry
from tidemark.plans.views import TODAY, view

NOW = datetime(2024, 1, 29, 12)


def _today():
    return F.lit(TODAY)


#: What the SQL of the scored pairs and of the effective status says, once.
_STATE = """CASE WHEN status IN ('CANCELLED', 'SUSPENDED', 'HOMOLOGATED', 'EXPIRED') THEN status
    WHEN deadline < DATE '1998-06-15' AND exam >= DATE '1998-06-15' THEN 'EXAM_SCHEDULED'
    WHEN deadline < DATE '1998-06-15' THEN 'REGISTRATION_CLOSED'
    WHEN start <= DATE '1998-06-15' AND deadline >= DATE '1998-06-15' THEN 'REGISTRATION_OPEN' ELSE status END"""
_PAIRS = f"""
    facts AS (SELECT *, {_STATE} AS state,
            coalesce(assignment_confirmed AND location = 'Rio Branco', false) AS local, education = 'high_school' AS school,
            qualification = 'HIGH SCHOOL ONLY' AS only_school, coalesce(published <= DATE '1998-06-15', false) AS dated,
            CASE WHEN weekly IS NULL THEN 'UNKNOWN' WHEN weekly <= 20 THEN 'PERFECT' WHEN weekly <= 30 THEN 'GOOD' ELSE 'OUTSIDE TARGET' END AS workload
        FROM v_opportunity JOIN v_position ON id = opportunity),
    pairs AS (SELECT *,
            CAST(greatest(0, least(100, CASE WHEN local THEN 30 ELSE -20 END + CASE WHEN school AND only_school THEN 25 ELSE 0 END
              + CASE WHEN only_school THEN 0 ELSE -15 END
              + CASE workload WHEN 'PERFECT' THEN 25 WHEN 'GOOD' THEN 15 WHEN 'UNKNOWN' THEN 5 ELSE -25 END
              + CASE employment_type WHEN 'PERMANENT' THEN 10 WHEN 'TEMPORARY' THEN -10 ELSE 0 END
              + CASE WHEN state = 'REGISTRATION_OPEN' THEN 7 ELSE 0 END + CASE WHEN exam IS NOT NULL THEN 3 ELSE 0 END)) AS INT) AS score,
            local AND school AND only_school AND workload <> 'OUTSIDE TARGET' AS eligible,
            state = 'REGISTRATION_OPEN' OR (state = 'EDITAL_PUBLISHED' AND dated AND published >= DATE '1998-06-15' - 90
              AND coalesce(deadline >= DATE '1998-06-15', true)) AS actionable
        FROM facts)"""


_MONEY = "concat('R$ ', replace(format('{{:,}}', {}), ',', '.'), ',00')"
_DAY_OF = "coalesce(strftime({}, '%d/%m/%Y'), 'não informado')"
_CASES = lambda table, code: f"CASE {code} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {code} END"
_PERIOD = f"""CASE WHEN start IS NOT NULL AND deadline IS NOT NULL THEN concat({_DAY_OF.format('start')}, ' a ', {_DAY_OF.format('deadline')}) WHEN deadline IS NOT NULL THEN concat('até ', {_DAY_OF.format('deadline')})
    WHEN start IS NOT NULL THEN concat('a partir de ', {_DAY_OF.format('start')}) ELSE 'não informado' END"""
_SURE = """CASE WHEN trust_level <= 2 AND conflicts = 0 AND 2 + CAST(location IS NOT NULL AS INT) + CAST(weekly IS NOT NULL AS INT) >= 3 THEN 'HIGH' WHEN trust_level <= 2 AND conflicts = 0 THEN 'MEDIUM' ELSE 'LOW' END"""
_RANK = "CASE WHEN score >= 90 THEN 'EXCELLENT' WHEN score >= 75 THEN 'VERY GOOD' WHEN score >= 60 THEN 'REVIEW' ELSE 'LOW PRIORITY' END"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opportunities with their positions and all that the rules say of each."""
    joined = view(spark, sf_dir, "v_opportunity").join(view(spark, sf_dir, "v_position"), F.col("id") == F.col("opportunity"))
    found = lambda known: (F.when(known, "FOUND").otherwise("NOT_FOUND"), F.lit(0.95))
    names = ("weekly", "location", "assignment_confirmed", "education", "status", "start", "deadline", "exam", "employment_type", "conflicts", "trust_level")
    o = {c: F.col(c) for c in names} | {
        "qualification_category": F.col("qualification"), "publication_date": F.col("published"),
        "evidence": [found(F.col("education").isNotNull()), found(F.lit(True)), found(F.col("location").isNotNull()), found(F.col("weekly").isNotNull())]}
    e = ("eligible", "primary_alert", "workload", "score", "rank", "state", "confidence")
    return joined.withColumn("e", evaluate(o, TODAY)).select("*", *[F.col(f"e.{c}").alias(c) for c in e], F.col("e.needs_review").alias("needs_review_pair")).drop("e")


def _v(name):
    return lambda spark, sf: view(spark, sf, name)


opp, src, att, note, track = (_v(n) for n in ("v_opportunity", "v_source", "v_attempt", "v_notification", "v_tracking"))
Q: dict[str, tuple] = {}


def q(name: str, sql: str | None = None):
    def add(f):
        Q[name] = (f, sql)
        return f

    return add


@q("q01_eligible_pairs", f"""WITH {_PAIRS} SELECT id, position, score, CASE WHEN score >= 90 THEN 'EXCELLENT' WHEN score >= 75 THEN 'VERY GOOD' WHEN score >= 60 THEN 'REVIEW' ELSE 'LOW PRIORITY' END AS rank, state
    FROM pairs WHERE eligible AND state NOT IN ('CANCELLED', 'SUSPENDED', 'HOMOLOGATED', 'EXPIRED', 'REGISTRATION_CLOSED', 'EXAM_SCHEDULED')
      AND coalesce(deadline >= DATE '1998-06-15', true)""")
def eligible_pairs(spark, sf):
    return pairs(spark, sf).where("eligible").where(accepting(F.col("state"), F.col("deadline"), TODAY)).select("id", "position", "score", "rank", "state").orderBy(F.desc("score"), "id", "position")


@q("q02_deadlines_45_days", f"""WITH {_PAIRS} SELECT DISTINCT id, institution, deadline FROM pairs WHERE eligible AND deadline BETWEEN DATE '1998-06-15' AND DATE '1998-06-15' + 45
    AND status NOT IN ('CANCELLED', 'SUSPENDED', 'HOMOLOGATED', 'EXPIRED')""")
def deadlines_45(spark, sf):
    near = F.col("deadline").between(_today(), F.date_add(_today(), 45)) & ~F.col("status").isin(*TERMINAL)
    return pairs(spark, sf).where("eligible").where(near).select("id", "institution", "deadline").distinct()


def runs(spark, sf):
    """Monitoring runs: one a day, their status by the run rule."""
    return att(spark, sf).groupBy("day").agg(
        F.count(F.lit(1)).alias("attempted"), F.count_if("success").alias("successful"), F.count_if(~F.col("success")).alias("errors")).withColumn(
        "run_status", health.run_status(F.col("attempted"), F.lit(0), F.col("successful"), F.col("errors")))


_RUNS = """runs AS (SELECT day, count(*) AS attempted, count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS errors FROM v_attempt GROUP BY day),
    judged AS (SELECT *, CASE WHEN successful = 0 THEN 'FAILED' WHEN errors > 0 THEN 'PARTIAL' ELSE 'SUCCESS' END AS run_status FROM runs)"""


@q("q03_latest_good_run", f"WITH {_RUNS} SELECT day, attempted, successful, run_status FROM judged WHERE run_status IN ('SUCCESS', 'PARTIAL') ORDER BY day DESC LIMIT 1")
def latest_run(spark, sf):
    return runs(spark, sf).where(F.col("run_status").isin("SUCCESS", "PARTIAL")).select("day", "attempted", "successful", "run_status").orderBy(F.desc("day")).limit(1)


_STATES = """v AS (SELECT *, sum(CAST(success AS INT)) OVER (PARTITION BY source_id ORDER BY moment, seq) AS island FROM v_attempt),
    s AS (SELECT *, count(*) OVER (PARTITION BY source_id, island ORDER BY moment, seq) - CASE WHEN island > 0 THEN 1 ELSE 0 END AS k,
        list(found) FILTER (success) OVER (PARTITION BY source_id ORDER BY moment, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM v),
    d AS (SELECT *, list_filter(list_slice(coalesce(h, []), -20, -1), lambda x: x > 0) AS u FROM s),
    j AS (SELECT *, CASE WHEN coalesce(status >= 400, false) THEN false WHEN found = 0 AND len(u) > 0 THEN true
        WHEN len(u) >= 3 AND list_median(u) >= 4 AND found < list_median(u) * 0.25 THEN true ELSE false END AS drifts FROM d),
    line AS (SELECT source_id, moment, seq, success, CASE WHEN success THEN 0 ELSE k END AS streak, drifts,
        CASE WHEN success AND NOT drifts THEN 'HEALTHY' WHEN success THEN 'DEGRADED' WHEN k >= 3 THEN 'OPEN' ELSE 'DEGRADED' END AS state FROM j),
    last AS (SELECT * FROM line QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY moment DESC, seq DESC) = 1)"""


def line(spark, sf):
    return health.timeline(att(spark, sf).withColumnRenamed("moment", "at"))


def states(spark, sf):
    """(source_id, state) after the last attempt of each source."""
    return health.current(att(spark, sf).withColumnRenamed("moment", "at"))


@q("a06_health_timeline", f"WITH {_STATES} SELECT source_id, seq, CAST(streak AS BIGINT) AS streak, drifts, state FROM line")
def health_line(spark, sf):
    return line(spark, sf).select("source_id", "seq", F.col("streak").cast("long").alias("streak"), F.col("drift").isNotNull().alias("drifts"), "state")


@q("q04_health_histogram", f"WITH {_STATES} SELECT state, count(*) AS n FROM last GROUP BY state")
def health_histogram(spark, sf):
    return states(spark, sf).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@q("q05_review_queue", "SELECT count(*) AS n FROM v_opportunity WHERE needs_review AND attempts < 6")
def review_queue(spark, sf):
    return opp(spark, sf).agg(F.count_if(F.col("needs_review") & (F.col("attempts") < 6)).alias("n"))


@q("q06_unhealthy_sources", f"WITH {_STATES} SELECT id, name, state FROM last JOIN v_source ON id = source_id WHERE state <> 'HEALTHY'")
def unhealthy(spark, sf):
    return states(spark, sf).where("state <> 'HEALTHY'").join(src(spark, sf), F.col("source_id") == F.col("id")).select("id", "name", "state").orderBy("state", "id")


@q("q07_next_deadlines", "SELECT id, deadline FROM v_opportunity WHERE deadline BETWEEN DATE '1998-06-15' AND DATE '1998-06-15' + 60 AND status NOT IN ('CANCELLED', 'SUSPENDED', 'HOMOLOGATED', 'EXPIRED') ORDER BY deadline, id LIMIT 8")
def next_deadlines(spark, sf):
    return opp(spark, sf).where(F.col("deadline").between(_today(), F.date_add(_today(), 60)) & ~F.col("status").isin(*TERMINAL)).select("id", "deadline").orderBy("deadline", "id").limit(8)


@q("q08_position_search", "SELECT position, cargo, institution FROM v_position JOIN v_opportunity ON id = opportunity WHERE contains(lower(concat(cargo, ' ', institution, ' ', name)), 'red') AND contains(lower(concat(cargo, ' ', institution, ' ', name)), 'prefeitura')")
def search(spark, sf, term: str = "Red, PREFEITURA"):
    """A word has no spaces, so it is in the whole normal form if it is in that of a part: each side of the join
    is brought to normal form once, and only tells which words it holds."""
    words = plain(term).split()
    held = lambda: F.array(*[F.contains(F.col("n"), F.lit(w)) for w in words])
    mine = view(spark, sf, "v_position").select("opportunity", "position", "cargo", normalise(F.col("cargo")).alias("n")).select("*", held().alias("a")).drop("n")
    theirs = opp(spark, sf).select("id", "institution", normalise(F.concat_ws(" ", "institution", "name")).alias("n")).select("*", held().alias("b")).drop("n")
    both = mine.join(theirs, F.col("id") == F.col("opportunity"))
    return both.where(F.forall(F.zip_with("a", "b", lambda x, y: x | y), lambda x: x)).select("position", "cargo", "institution")


@q("q09_version_history", """WITH h AS (SELECT doc_id, url, sha256(coalesce(text, '')) AS s FROM v_version), f AS (SELECT url, s, min(doc_id) AS doc_id FROM h GROUP BY url, s)
    SELECT url, CAST(row_number() OVER (PARTITION BY url ORDER BY doc_id) AS INT) AS version, doc_id FROM f""")
def version_history(spark, sf):
    from tidemark.operators import history

    rows = view(spark, sf, "v_version").select("url", "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))
    return history.versions(rows, "url", ("doc_id",)).select("url", "version", "doc_id").orderBy("url", F.desc("version"))


@q("q10_opportunities_listing", f"WITH {_PAIRS} SELECT id, position, score, deadline FROM pairs WHERE trust_level <= 2 ORDER BY score DESC, deadline ASC NULLS LAST, id, position LIMIT 100")
def listing(spark, sf):
    return pairs(spark, sf).where("trust_level <= 2").select("id", "position", "score", "deadline").orderBy(F.desc("score"), F.asc_nulls_last("deadline"), "id", "position").limit(100)


@q("q11_deadlines_30_days", "SELECT id, 'registration' AS kind, deadline AS due FROM v_opportunity WHERE deadline BETWEEN DATE '1998-06-15' AND DATE '1998-06-15' + 30 UNION ALL SELECT id, 'exam', exam FROM v_opportunity WHERE exam BETWEEN DATE '1998-06-15' AND DATE '1998-06-15' + 30 UNION ALL SELECT id, 'fee_exemption', exemption FROM v_opportunity WHERE exemption BETWEEN DATE '1998-06-15' AND DATE '1998-06-15' + 30 UNION ALL SELECT id, 'payment', payment FROM v_opportunity WHERE payment BETWEEN DATE '1998-06-15' AND DATE '1998-06-15' + 30")
def deadlines_30(spark, sf):
    from tidemark.operators import history

    return history.deadlines(opp(spark, sf)).where(F.col("due").between(_today(), F.date_add(_today(), 30))).orderBy("due", "id", "kind")


@q("q12_sources_listing", f"WITH {_STATES} SELECT id, name, priority, coalesce(state, 'HEALTHY') AS state FROM v_source LEFT JOIN last ON id = source_id WHERE coalesce(state, 'HEALTHY') <> 'HEALTHY'")
def sources_listing(spark, sf):
    both = src(spark, sf).join(states(spark, sf).select("source_id", "state"), F.col("id") == F.col("source_id"), "left")
    return both.select("id", "name", "priority", F.coalesce("state", F.lit("HEALTHY")).alias("state")).where("state <> 'HEALTHY'").orderBy("priority", "id")


@q("q13_outbox_histogram", "SELECT status, count(*) AS n FROM v_notification GROUP BY status")
def outbox_histogram(spark, sf):
    return note(spark, sf).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@q("q14_state_summary", f"WITH {_STATES} SELECT count(*) FILTER (state = 'HEALTHY') AS healthy, count(*) FILTER (state = 'DEGRADED') AS degraded, count(*) FILTER (state = 'OPEN') AS open, count(*) FILTER (state = 'RECOVERING') AS recovering, count(*) FILTER (state = 'DISABLED') AS disabled FROM last")
def state_summary(spark, sf):
    return health.histogram(states(spark, sf))


@q("q15_stuck_documents", "SELECT id, attempts FROM v_opportunity WHERE needs_review AND attempts < 6 ORDER BY updated_at DESC, id LIMIT 40")
def stuck(spark, sf):
    return opp(spark, sf).where("needs_review and attempts < 6").orderBy(F.desc("updated_at"), "id").select("id", "attempts").limit(40)


@q("q16_enabled_sources", "SELECT id, trust_level FROM v_source WHERE enabled")
def enabled(spark, sf):
    return src(spark, sf).where("enabled").select("id", "trust_level")


@q("q17_expire", f"""SELECT id, CASE WHEN greatest(coalesce(exam, DATE '1900-01-01'), coalesce(deadline, DATE '1900-01-01'), coalesce(published, DATE '1900-01-01')) < DATE '1998-06-15' - 90
      AND (exam IS NOT NULL OR deadline IS NOT NULL OR published IS NOT NULL) THEN 'EXPIRED' ELSE {_STATE} END AS new_status
    FROM v_opportunity WHERE status NOT IN ('CANCELLED', 'SUSPENDED', 'HOMOLOGATED', 'EXPIRED')""")
def expire(spark, sf):
    rows = opp(spark, sf).where(~F.col("status").isin(*TERMINAL))
    last = F.greatest("exam", "deadline", "published")
    state = effective_status(F.col("status"), F.col("start"), F.col("deadline"), F.col("exam"), TODAY)
    return rows.select("id", F.when(last < F.date_sub(_today(), 90), "EXPIRED").otherwise(state).alias("new_status"))


@q("q18_unknown_workloads", "SELECT count(*) FILTER (weekly IS NULL) AS n FROM v_position")
def unknown_workloads(spark, sf):
    return view(spark, sf, "v_position").agg(F.count_if(F.col("weekly").isNull()).alias("n"))


@q("q19_links_to_verify", "SELECT id, base_url FROM v_source WHERE enabled ORDER BY id LIMIT 60")
def links_to_verify(spark, sf):
    return src(spark, sf).where("enabled").select("id", "base_url").orderBy("id").limit(60)


@q("q20_known_hosts", "SELECT DISTINCT split_part(split_part(base_url, '//', 2), '/', 1) AS host FROM v_source")
def known_hosts(spark, sf):
    from tidemark.functions.urls import host

    return src(spark, sf).withColumn("hosts", F.array(host(F.col("base_url")))).select(F.explode("hosts").alias("host")).distinct()


@q("q21_discovery_seeds", "SELECT id, priority FROM v_source WHERE enabled AND trust_level <= 2 ORDER BY priority, id LIMIT 8")
def seeds(spark, sf):
    return src(spark, sf).where("enabled and trust_level <= 2").select("id", "priority").orderBy("priority", "id").limit(8)


@q("q22_open_conflicts", "SELECT count(*) FILTER (conflicts > 0) AS n FROM v_opportunity")
def open_conflicts(spark, sf):
    return opp(spark, sf).agg(F.count_if(F.col("conflicts") > 0).alias("n"))


@q("q23_sources_needing_issue", f"WITH {_STATES} SELECT id, CAST(moment AS DATE) AS day, state, CAST(streak AS BIGINT) AS streak FROM line JOIN v_source ON id = source_id WHERE streak >= 2 OR state = 'OPEN' QUALIFY row_number() OVER (PARTITION BY id, CAST(moment AS DATE) ORDER BY moment DESC, seq DESC) = 1")
def needing_issue(spark, sf):
    """Sources that failed twice or more in a row, or whose circuit is open, as of the last such attempt of each day."""
    bad = line(spark, sf).where("streak >= 2 or state = 'OPEN'").groupBy("source_id", F.to_date("at").alias("day")).agg(F.max_by(F.struct("state", "streak"), F.struct("at", "seq")).alias("last"))
    return bad.join(src(spark, sf), F.col("source_id") == F.col("id")).select("id", "day", "last.state", F.col("last.streak").cast("long").alias("streak"))


@q("q24_report_pairs", f"WITH {_PAIRS} SELECT id, position, score, workload, state FROM pairs WHERE eligible")
def report_pairs(spark, sf):
    return pairs(spark, sf).where("eligible").select("id", "position", "score", "workload", "state").orderBy(F.desc("score"), "id", "position")


@q("q25_new_in_26_hours", "SELECT id, institution FROM v_opportunity WHERE updated_at BETWEEN TIMESTAMP '1998-06-14 00:00:00' AND TIMESTAMP '1998-06-15 02:00:00'")
def new_26h(spark, sf):
    until = F.lit(datetime(1998, 6, 15, 2))
    return opp(spark, sf).where(F.col("updated_at").between(until - F.expr("interval 26 hours"), until)).select("id", "institution").orderBy("id")


@q("q26_registrations_open", "SELECT id, start, deadline FROM v_opportunity WHERE DATE '1998-06-15' BETWEEN start AND deadline AND status NOT IN ('CANCELLED', 'SUSPENDED', 'HOMOLOGATED', 'EXPIRED')")
def registrations_open(spark, sf):
    return opp(spark, sf).where(_today().between(F.col("start"), F.col("deadline")) & ~F.col("status").isin(*TERMINAL)).select("id", "start", "deadline")


@q("q27_report_deadlines", "SELECT id, deadline, CAST(deadline - DATE '1998-06-15' AS INT) AS days FROM v_opportunity WHERE deadline BETWEEN DATE '1998-06-15' AND DATE '1998-06-15' + 30")
def report_deadlines(spark, sf):
    return opp(spark, sf).where(F.col("deadline").between(_today(), F.date_add(_today(), 30))).select("id", "deadline", F.datediff("deadline", _today()).alias("days")).orderBy("deadline", "id")


@q("q28_report_sections", f"WITH {_PAIRS} SELECT count(*) FILTER (state = 'EXAM_SCHEDULED') AS exams, count(*) FILTER (score >= 90) AS excellent, count(*) FILTER (score >= 75 AND score < 90) AS very_good, count(*) FILTER (workload = 'UNKNOWN') AS unknown_workload FROM pairs WHERE eligible")
def report_sections(spark, sf):
    return pairs(spark, sf).where("eligible").agg(
        F.count_if(F.col("state") == "EXAM_SCHEDULED").alias("exams"), F.count_if(F.col("rank") == "EXCELLENT").alias("excellent"),
        F.count_if(F.col("rank") == "VERY GOOD").alias("very_good"), F.count_if(F.col("workload") == "UNKNOWN").alias("unknown_workload"))


@q("q29_amendments", "SELECT id, status FROM v_opportunity WHERE status IN ('SUSPENDED', 'EDITAL_PUBLISHED') AND updated_at >= TIMESTAMP '1998-06-01 00:00:00' AND updated_at <= TIMESTAMP '1998-06-15 00:00:00' ORDER BY updated_at DESC, id LIMIT 25")
def amendments(spark, sf):
    until = F.lit(datetime(1998, 6, 15))
    rows = opp(spark, sf).where(F.col("status").isin("SUSPENDED", "EDITAL_PUBLISHED") & F.col("updated_at").between(until - F.expr("interval 14 days"), until))
    return rows.orderBy(F.desc("updated_at"), "id").select("id", "status").limit(25)


@q("q30_review_list", f"WITH {_PAIRS} SELECT id, position FROM pairs WHERE NOT local OR NOT school OR weekly IS NULL OR conflicts > 0 OR NOT dated ORDER BY id, position LIMIT 30")
def review_list(spark, sf):
    return pairs(spark, sf).where("needs_review_pair").select("id", "position").orderBy("id", "position").limit(30)


@q("q31_source_health_table", f"WITH {_STATES}, r AS (SELECT source_id, round(avg(CAST(success AS INT)), 3) AS rate, count(*) AS attempts FROM v_attempt GROUP BY source_id) SELECT id, state, rate, attempts FROM v_source JOIN last ON id = last.source_id JOIN r ON id = r.source_id")
def health_table(spark, sf):
    rate = att(spark, sf).groupBy("source_id").agg(health.rate(F.count_if("success"), F.count(F.lit(1))).alias("rate"), F.count(F.lit(1)).alias("attempts"))
    return src(spark, sf).join(states(spark, sf).select("source_id", "state"), F.col("id") == F.col("source_id")).drop("source_id").join(rate, F.col("id") == F.col("source_id")).select("id", "state", "rate", "attempts")


@q("q32_last_run", f"WITH {_RUNS} SELECT max(day) AS day, arg_max(run_status, day) AS run_status FROM judged")
def last_run(spark, sf):
    return runs(spark, sf).agg(F.max("day").alias("day"), F.max_by("run_status", "day").alias("run_status"))


@q("q33_recent_errors", "SELECT seq, source_id FROM v_attempt WHERE NOT success AND moment >= TIMESTAMP '2024-01-27 12:00:00' AND moment <= TIMESTAMP '2024-01-29 12:00:00' ORDER BY moment DESC, seq LIMIT 12")
def recent_errors(spark, sf):
    now = F.lit(NOW)
    return att(spark, sf).where(~F.col("success") & F.col("moment").between(now - F.expr("interval 2 days"), now)).orderBy(F.desc("moment"), "seq").select("seq", "source_id").limit(12)


@q("q34_totals", f"WITH {_PAIRS} SELECT count(*) AS total, count(*) FILTER (eligible) AS eligible FROM pairs")
def totals(spark, sf):
    return pairs(spark, sf).agg(F.count(F.lit(1)).alias("total"), F.count_if("eligible").alias("eligible"))


_DISMISSED = "d AS (SELECT opportunity AS id FROM (SELECT p.opportunity, t.decision FROM v_position p LEFT JOIN v_tracking t ON t.opportunity = p.opportunity) GROUP BY opportunity HAVING bool_and(coalesce(decision = 'DISMISSED', false)))"


def dismissed(spark, sf):
    positions = view(spark, sf, "v_position").select(F.col("opportunity").alias("id"), F.col("opportunity").alias("position"))
    return outbox.dismissed_throughout(positions, track(spark, sf).select(F.col("opportunity").alias("position"), F.col("decision").alias("status")))


@q("q35_dismissed_throughout", f"WITH {_DISMISSED} SELECT id FROM d")
def dismissed_all(spark, sf):
    return dismissed(spark, sf)


@q("q36_followed", "SELECT note, opportunity, institution, decision <> 'DISMISSED' AS active FROM v_tracking JOIN v_opportunity ON id = opportunity")
def followed(spark, sf):
    return track(spark, sf).withColumnRenamed("updated_at", "decided_at").join(opp(spark, sf), F.col("id") == F.col("opportunity")).orderBy(F.desc("decided_at"), "note").select("note", "opportunity", "institution", (F.col("decision") != "DISMISSED").alias("active"))


@q("q37_tracking_by_ids", "SELECT note, decision FROM v_tracking WHERE opportunity IN (SELECT id FROM v_opportunity WHERE needs_review)")
def tracking_by_ids(spark, sf):
    """Decisions about a set of opportunities: those that wait for a review."""
    ids = opp(spark, sf).where("needs_review").select(F.col("id").alias("opportunity"))
    return track(spark, sf).join(ids, "opportunity", "left_semi").select("note", "decision")


@q("q38_watchdog_counters", "SELECT count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (status = 'UNCERTAIN') AS uncertain, count(*) FILTER (status = 'PENDING' AND created_at < TIMESTAMP '2024-01-28 12:00:00') AS overdue FROM v_notification")
def watchdog_counters(spark, sf):
    late = F.col("created_at") < F.lit(NOW) - F.expr("interval 1 day")
    return note(spark, sf).agg(F.count_if(F.col("status") == "FAILED").alias("failed"), F.count_if(F.col("status") == "UNCERTAIN").alias("uncertain"), F.count_if((F.col("status") == "PENDING") & late).alias("overdue"))


@q("q39_unqueued_keys", "SELECT concat('console:', event_id) AS key FROM events e WHERE event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM v_notification n WHERE n.key = concat('console:', e.event_id) AND n.status = 'SENT')")
def unqueued(spark, sf):
    new = spark.read.parquet(f"{sf}/events.parquet").where("event_type = 'purchase'").select(F.concat(F.lit("console:"), "event_id").alias("key"))
    return new.join(note(spark, sf).where("status = 'SENT'").select("key"), "key", "left_anti")


@q("q40_documents_by_url", """WITH known AS (SELECT url, min(doc_id) AS document FROM v_version GROUP BY url),
    asked AS (SELECT doc_id, concat('doc://', source, '/', doc_id % 60) AS url FROM documents)
    SELECT asked.doc_id, asked.url, known.document FROM asked LEFT JOIN known ON asked.url = known.url""")
def documents_by_url(spark, sf):
    """The stored document of every collected URL, null for a new one."""
    known = view(spark, sf, "v_version").groupBy("url").agg(F.min("doc_id").alias("document"))
    asked = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.concat(F.lit("doc://"), "source", F.lit("/"), F.col("doc_id") % 60).alias("url"))
    return asked.join(known, "url", "left").select("doc_id", "url", "document")


@q("q41_versions_by_hash", "SELECT sha256(coalesce(text, '')) AS content_hash, count(DISTINCT url) AS urls, count(*) AS n FROM v_version GROUP BY 1 HAVING count(*) > 1")
def versions_by_hash(spark, sf):
    return view(spark, sf, "v_version").groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash")).agg(F.countDistinct("url").alias("urls"), F.count(F.lit(1)).alias("n")).where("n > 1")


@q("q43_deadline_by_kind", "SELECT id, exam AS due FROM v_opportunity WHERE exam IS NOT NULL")
def deadline_by_kind(spark, sf):
    from tidemark.operators import history

    return history.deadlines(opp(spark, sf)).where("kind = 'exam'").select("id", "due")


@q("q44_announced", "SELECT id FROM v_opportunity o WHERE NOT EXISTS (SELECT 1 FROM v_tracking t WHERE t.opportunity = o.id)")
def unannounced(spark, sf):
    return opp(spark, sf).join(track(spark, sf).select(F.col("opportunity").alias("id")), "id", "left_anti").select("id")


@q("q45_due_reminders", f"""WITH {_DISMISSED}, k AS (SELECT id, 'registration' AS kind, deadline AS due, [7, 3, 1, 0] AS days, status FROM v_opportunity UNION ALL SELECT id, 'exam', exam, [14, 7, 3, 1, 0], status FROM v_opportunity
      UNION ALL SELECT id, 'fee_exemption', exemption, [3, 1, 0], status FROM v_opportunity UNION ALL SELECT id, 'payment', payment, [1, 0], status FROM v_opportunity)
    SELECT id, kind, due, CAST(due - DATE '1998-06-15' AS INT) AS threshold FROM k WHERE list_contains(days, due - DATE '1998-06-15') AND status NOT IN ('CANCELLED', 'SUSPENDED', 'HOMOLOGATED', 'EXPIRED') AND id NOT IN (SELECT id FROM d)""")
def due_reminders(spark, sf):
    from tidemark.operators import history

    o = opp(spark, sf)
    return outbox.reminders(history.deadlines(o), o, dismissed(spark, sf), TODAY).select("id", "kind", "due", "threshold")


@q("q46_pending", "SELECT key, attempts FROM v_notification WHERE status IN ('PENDING', 'RETRY') AND (not_before IS NULL OR not_before <= TIMESTAMP '2024-01-29 12:00:00') ORDER BY created_at, key LIMIT 200")
def pending(spark, sf):
    return outbox.pending(note(spark, sf), NOW).select("key", "attempts")


@q("q47_cache_probe", "SELECT v.doc_id FROM v_version v WHERE NOT EXISTS (SELECT 1 FROM v_version c WHERE c.doc_id % 2 = 0 AND sha256(coalesce(c.text, '')) = sha256(coalesce(v.text, '')))")
def cache_probe(spark, sf):
    """Documents without a cached extraction: no even-numbered document has their contents."""
    v = view(spark, sf, "v_version").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    return v.join(v.where("doc_id % 2 = 0").select("h"), "h", "left_anti").select("doc_id")


@q("q48_stamp", "SELECT doc_id, CASE WHEN n_chars > 2000 THEN 'v2' ELSE 'v1' END AS semantic_version FROM v_version")
def stamp(spark, sf):
    v = view(spark, sf, "v_version")
    return v.select("doc_id", F.when(F.col("n_chars") > 2000, "v2").otherwise("v1").alias("semantic_version"))


@q("q49_run_sources", "SELECT id, priority FROM v_source WHERE enabled")
def run_sources(spark, sf, ids: tuple[str, ...] = ()):
    """The sources of a run in their order; ``ids`` chooses some."""
    chosen = F.col("id").isin(*ids) if ids else F.lit(True)
    return src(spark, sf).where(F.col("enabled") & chosen).select("id", "priority").orderBy("priority", "id")


@q("q50_registry_reconcile", """WITH a AS (SELECT id, name, enabled FROM v_source WHERE priority < 15), b AS (SELECT id, CASE WHEN trust_level = 1 THEN 'old' ELSE name END AS name, enabled FROM v_source WHERE priority > 5)
    SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.name IS NULL THEN 'created' WHEN a.name IS NULL AND b.enabled THEN 'disabled' WHEN a.name IS NULL THEN 'unchanged' WHEN a.name <> b.name OR a.enabled <> b.enabled THEN 'updated' ELSE 'unchanged' END AS action, coalesce(a.enabled, false) AS enabled
    FROM a FULL JOIN b ON a.id = b.id""")
def reconcile(spark, sf):
    s = src(spark, sf)
    return registry.reconcile(s.where("priority < 15"), s.where("priority > 5").withColumn("name", F.when(F.col("trust_level") == 1, "old").otherwise(F.col("name"))))


_DUMPED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@q("q51_table_dump", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS row_count FROM {t}" for t in _DUMPED))
def table_dump(spark, sf):
    """What the manifest of a backup of all tables says."""
    from tidemark.sources import store

    return store.counts({t: spark.read.parquet(f"{sf}/{t}.parquet") for t in _DUMPED})


@q("q53_recent_runs", f"WITH {_RUNS} SELECT day, run_status, attempted - successful AS failed FROM judged ORDER BY day DESC LIMIT 10")
def recent_runs(spark, sf):
    return runs(spark, sf).select("day", "run_status", (F.col("attempted") - F.col("successful")).alias("failed")).orderBy(F.desc("day")).limit(10)


@q("q53_json_props", "SELECT CAST(props->>'k' AS INT) AS k, count(*) AS n FROM events GROUP BY 1 HAVING count(*) >= 10")
def json_props(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    return spark.read.parquet(f"{sf}/events.parquet").groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n")).where("n >= 10")


@q("q_page_two", f"WITH {_PAIRS}, n AS (SELECT id, position, row_number() OVER (ORDER BY score DESC, id, position) AS n FROM pairs WHERE eligible) SELECT id, position FROM n WHERE n BETWEEN 6 AND 10")
def page_two(spark, sf, page: int = 2, size: int = 5):
    """A page of the ranked eligible pairs."""
    return pairs(spark, sf).where("eligible").orderBy(F.desc("score"), "id", "position").select("id", "position").offset((page - 1) * size).limit(size)


@q("p16_freshness", f"WITH {_RUNS} SELECT CASE WHEN max(day) IS NULL THEN 'MISSING' WHEN max(day) <> DATE '2024-01-29' THEN 'STALE' WHEN arg_max(successful, day) >= greatest(1, arg_max(attempted, day) // 2) THEN 'SUCCESS' ELSE 'PARTIAL' END AS freshness FROM judged")
def run_freshness(spark, sf):
    last = runs(spark, sf).agg(F.max("day").alias("day"), F.max_by("attempted", "day").alias("a"), F.max_by("successful", "day").alias("s"))
    return last.select(health.freshness(F.col("day"), F.col("a"), F.col("s"), NOW).alias("freshness"))


@q("s02_candidates_per_source", "SELECT source_id, url, CAST(n AS INT) AS n FROM (SELECT concat('src', doc_id % 20) AS source_id, url, row_number() OVER (PARTITION BY doc_id % 20 ORDER BY min(doc_id), url) AS n FROM v_version GROUP BY doc_id % 20, url) WHERE n <= 3")
def per_source(spark, sf):
    links = view(spark, sf, "v_version").select(F.concat(F.lit("src"), F.col("doc_id") % 20).alias("source_id"), "url", F.col("doc_id").alias("place"), F.lit(3).alias("max_documents"))
    return registry.candidates_per_source(links).select("source_id", "url", "n")


@q("s_budget_carry", "SELECT id, CAST(greatest(0, least(max_documents, 160 - coalesce(sum(max_documents) OVER (ORDER BY priority, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS granted FROM v_source WHERE enabled")
def budget(spark, sf):
    return registry.budgeted(src(spark, sf).where("enabled").select("id", "priority", F.col("max_documents").alias("wanted")), 160).select("id", F.col("granted").cast("long").alias("granted"))


@q("a04_dispatch", """SELECT key, CASE WHEN r = 'SENT' THEN 'SENT' WHEN r = 'RETRY' AND attempts + 1 < 5 THEN 'RETRY' WHEN r = 'RETRY' THEN 'FAILED' ELSE r END AS new_status, CAST(CASE WHEN r = 'UNCONFIGURED' THEN attempts ELSE attempts + 1 END AS INT) AS new_attempts
    FROM (SELECT *, CASE CAST(substr(key, 9) AS BIGINT) % 5 WHEN 0 THEN 'SENT' WHEN 1 THEN 'RETRY' WHEN 2 THEN 'UNCERTAIN' WHEN 3 THEN 'BLOCKED' ELSE 'UNCONFIGURED' END AS r FROM v_notification)""")
def dispatch(spark, sf):
    n = F.substring("key", 9, 20).cast("long") % 5
    result = F.when(n == 0, "SENT").when(n == 1, "RETRY").when(n == 2, "UNCERTAIN").when(n == 3, "BLOCKED").otherwise("UNCONFIGURED")
    return outbox.delivered(note(spark, sf).withColumn("result", result).withColumn("retry_after", F.lit(None).cast("int")), NOW).select("key", "new_status", "new_attempts")


@q("a09_watchdog", f"WITH {_STATES}, {_RUNS}, o AS (SELECT count(*) FILTER (state IN ('OPEN', 'DISABLED')) AS open_sources FROM last), f AS (SELECT count(*) FILTER (status IN ('FAILED', 'UNCERTAIN')) AS failed FROM v_notification), h AS (SELECT max(day) AS d FROM judged WHERE run_status IN ('SUCCESS', 'PARTIAL')) SELECT CASE WHEN d IS NULL OR date_diff('hour', CAST(d AS TIMESTAMP), TIMESTAMP '2024-01-29 12:00:00') > 30 THEN 'CRITICAL' WHEN open_sources > 0 OR failed > 0 THEN 'WARNING' ELSE 'OK' END AS severity, open_sources, failed AS failed_messages FROM o, f, h")
def watchdog(spark, sf):
    r = runs(spark, sf).select(F.col("day").cast("timestamp").alias("started_at"), F.col("run_status").alias("status"))
    return health.watchdog(r, states(spark, sf), note(spark, sf), NOW).select("severity", "open_sources", "failed_messages")
