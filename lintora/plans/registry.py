"""All queries outside the llm subpackage, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintora import settings
from lintora.functions import scalars as S
from lintora.operators import code_rules, commands, dashboards, explain, learning, rules, scan, sessions
from lintora.plans import duck as D
from lintora.sources import sinks
from lintora.sources import tables as T
from lintora.streaming import streams

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _now():
    return F.lit("2025-01-01 00:00:00").cast("timestamp")


# ---- dashboards ----


@_query(D.with_(D.FINDINGS, D.STATS) + "SELECT * FROM stats")
def dev_stats(spark: SparkSession, sf: str) -> DataFrame:
    return dashboards.developer_stats(T.findings(spark, sf))


@_query(D.with_(D.FINDINGS, D.STATS) + "SELECT CAST(coalesce(sum(total), 0) AS BIGINT) AS total, CAST(coalesce(sum(n_critical), 0) AS BIGINT) AS n_critical, coalesce(CAST(floor(avg(score) + 0.5) AS BIGINT), 100) AS avg_score, count(*) AS n_developers FROM stats")
def team_totals(spark, sf):
    return dashboards.team_totals(dashboards.developer_stats(T.findings(spark, sf)))


@_query(D.with_(D.FINDINGS) + f"SELECT count(*) AS total, {D.COUNTS} FROM findings")
def findings_summary(spark, sf):
    return dashboards.summary(T.findings(spark, sf))


@_query(D.with_(D.FINDINGS) + "SELECT vuln_type, count(*) AS n FROM findings GROUP BY vuln_type")
def summary_by_type(spark, sf):
    return dashboards.by_type(T.findings(spark, sf))


@_query(D.with_(D.FINDINGS) + "SELECT vuln_type, n, CAST(floor(n / sum(n) OVER () * 100 + 0.5) AS BIGINT) AS pct, CAST(row_number() OVER (ORDER BY n DESC, first_seq) AS INTEGER) AS position FROM (SELECT vuln_type, count(*) AS n, min(seq) AS first_seq FROM findings GROUP BY vuln_type)")
def type_breakdown_pct(spark, sf):
    return dashboards.type_breakdown(T.findings(spark, sf))


@_query(D.with_(D.SESSIONS, D.SESSION_FINDINGS, D.SUMMARIES) + "SELECT trend, count(*) AS n FROM summaries WHERE total > 0 GROUP BY trend")
def score_bands(spark, sf):
    found = sessions.summaries(T.sessions(spark, sf), T.session_findings(spark, sf), _now(), with_files=False)
    return found.filter("total > 0").groupBy("trend").agg(F.count("*").alias("n"))


_RANK = "CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 WHEN 'INFO' THEN 4 ELSE 99 END"


@_query(D.with_(D.FINDINGS) + f"SELECT seq, severity, line_number, vuln_type FROM findings ORDER BY {_RANK}, line_number, seq LIMIT 20")
def severity_sort_top20(spark, sf):
    return T.findings(spark, sf).orderBy(S.severity_rank(F.col("severity")), "line_number", "seq").select("seq", "severity", "line_number", "vuln_type").limit(20)


@_query(D.with_(D.FINDINGS) + "SELECT seq, developer_id, severity, vuln_type FROM findings WHERE severity IN ('CRITICAL', 'HIGH')")
def alerts_high_critical(spark, sf):
    return T.findings(spark, sf).filter(F.col("severity").isin("CRITICAL", "HIGH")).select("seq", "developer_id", "severity", "vuln_type")


_ROSTER = "SELECT user_id, username, role, upper(left(username, 1)) AS initial, coalesce(total, 0) AS total, coalesce(score, 100) AS score, CASE WHEN coalesce(score, 100) >= 80 THEN 'improving' WHEN coalesce(score, 100) >= 50 THEN 'stable' ELSE 'declining' END AS band, coalesce(total, 0) > 50 AS highlight, CASE WHEN coalesce(total, 0) = 0 THEN '\u2014' ELSE CAST(total AS VARCHAR) END AS shown FROM users LEFT JOIN stats ON user_id = developer_id"


@_query(D.with_(D.FINDINGS, D.STATS, D.USERS) + _ROSTER + " WHERE role = 'developer'")
def roster_with_stats(spark, sf):
    return dashboards.roster(T.users(spark, sf), dashboards.developer_stats(T.findings(spark, sf)))


@_query(D.with_(D.FINDINGS, D.STATS, D.USERS) + _ROSTER)
def admin_users_with_stats(spark, sf):
    return dashboards.roster(T.users(spark, sf), dashboards.developer_stats(T.findings(spark, sf)), None)


@_query(D.with_(D.PROJECTS, D.SHIFTS) + "SELECT p.project_id, p.name, count(s.shift_id) AS n_shifts, " + ", ".join(f"count(*) FILTER (s.status = '{x}') AS n_{x}" for x in ("scheduled", "active", "completed")) + " FROM projects p LEFT JOIN shifts s USING (project_id) GROUP BY ALL")
def project_shift_counts(spark, sf):
    return dashboards.project_shift_counts(T.projects(spark, sf), T.shifts(spark, sf))


@_query(D.with_(D.SHIFTS, D.SESSIONS) + "SELECT h.shift_id, h.name, count(*) FILTER (s.session_id IS NOT NULL AND s.ended_at IS NULL) AS n_active, count(s.ended_at) AS n_completed FROM shifts h LEFT JOIN sessions s USING (shift_id) GROUP BY ALL")
def shift_session_counts(spark, sf):
    return dashboards.shift_session_counts(T.shifts(spark, sf), T.sessions(spark, sf))


@_query(D.with_(D.USERS, D.SHIFTS, D.SESSIONS) + "SELECT 'users ' || role AS name, count(*) AS n FROM users GROUP BY role UNION ALL SELECT 'shifts ' || status, count(*) FROM shifts GROUP BY status UNION ALL SELECT 'live sessions', count(*) FROM sessions WHERE ended_at IS NULL")
def status_counters(spark, sf):
    return dashboards.status_counters(T.users(spark, sf), T.shifts(spark, sf), T.sessions(spark, sf))


@_query(D.with_(D.FINDINGS) + "SELECT file_name, seq, severity FROM findings QUALIFY rank() OVER (PARTITION BY file_name ORDER BY seq DESC) = 1")
def latest_per_file(spark, sf):
    return dashboards.latest_by_file(T.findings(spark, sf)).select("file_name", "seq", "severity")


@_query(D.with_(D.FINDINGS) + "SELECT seq, developer_id, vuln_type, severity, confidence FROM findings ORDER BY seq DESC LIMIT 10")
def live_stream_last10(spark, sf):
    return T.findings(spark, sf).orderBy(F.desc("seq")).limit(10).select("seq", "developer_id", "vuln_type", "severity", "confidence")


@_query(D.with_(D.FINDINGS) + "SELECT seq, line_number, vuln_type FROM findings WHERE line_number BETWEEN 10 AND 20")
def findings_at_lines(spark, sf):
    return dashboards.at_line(T.findings(spark, sf), 10, 20).select("seq", "line_number", "vuln_type")


@_query(D.with_(D.PROJECTS) + "SELECT supervisor_id, project_id, name FROM projects WHERE status = 'active'")
def supervisor_projects(spark, sf):
    """Active projects of every supervisor."""
    return T.projects(spark, sf).filter("status = 'active'").select("supervisor_id", "project_id", "name")


@_query(D.with_(D.SHIFTS) + "SELECT unnest(assigned) AS developer_id, shift_id, name, status FROM shifts")
def shifts_of_developer(spark, sf):
    """Shifts of every developer."""
    return T.shifts(spark, sf).select(F.explode("assigned").alias("developer_id"), "shift_id", "name", "status")


_ADMINISTRATORS = "(SELECT count(*) FROM users WHERE role = 'administrator')"


@_query(D.with_(D.USERS) + f"SELECT user_id, username, role, {_ADMINISTRATORS} AS n_administrators, role <> 'administrator' OR {_ADMINISTRATORS} > 1 AS may_go FROM users")
def last_administrator_guard(spark, sf):
    return dashboards.administrators_left(T.users(spark, sf))


@_query(D.with_(D.USERS) + "SELECT username, min(id) AS user_id FROM (SELECT username || CASE WHEN user_id % 5 = 0 THEN '' ELSE 'x' || user_id % 100 END AS username, user_id + 1000000 AS id FROM users) n WHERE username NOT IN (SELECT username FROM users) GROUP BY username")
def added_users(spark, sf):
    users = T.users(spark, sf)
    suffix = F.when(F.col("user_id") % 5 == 0, "").otherwise(F.concat(F.lit("x"), (F.col("user_id") % 100).cast("string")))
    new = users.select(F.concat("username", suffix).alias("username"), (F.col("user_id") + 1000000).alias("user_id"))
    return dashboards.added_users(users, new)


@_query(D.with_(D.USERS) + ", u AS (SELECT *, CASE WHEN user_id % 3 = 0 THEN 'gh' || user_id END AS github_username FROM users), logins AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'gh' || user_id ELSE username END AS label FROM users) SELECT label, coalesce(g.user_id, n.user_id) AS user_id, CASE WHEN g.user_id IS NOT NULL THEN 'external' WHEN n.user_id IS NOT NULL THEN 'username' ELSE 'provisioned' END AS matched_by FROM logins LEFT JOIN u g ON label = g.github_username LEFT JOIN u n ON label = n.username")
def user_match_cascade(spark, sf):
    gh = F.concat(F.lit("gh"), F.col("user_id").cast("string"))
    users = T.users(spark, sf).withColumn("github_username", F.when(F.col("user_id") % 3 == 0, gh))
    logins = T.users(spark, sf).select(F.when(F.col("user_id") % 2 == 0, gh).otherwise(F.col("username")).alias("label"))
    return dashboards.matched_users(logins, users)


# ---- sessions ----

_SUMMARY = ["session_id", "total", "n_critical", "n_high", "n_medium", "n_low", "n_info", "minutes", "score", "trend"]


@_query(D.with_(D.SESSIONS, D.SESSION_FINDINGS, D.SUMMARIES) + f"SELECT {', '.join(_SUMMARY)}, by_type, array_to_string(files, ',') AS files, len(files) AS n_files, array_to_string(files[1:5], ',') || CASE WHEN len(files) > 5 THEN ' +' || (len(files) - 5) || ' more' ELSE '' END AS shown_files FROM summaries")
def session_summary(spark, sf):
    found = sessions.summaries(T.sessions(spark, sf), T.session_findings(spark, sf), _now())
    more = F.when(F.size("files") > 5, F.concat(F.lit(" +"), (F.size("files") - 5).cast("string"), F.lit(" more"))).otherwise("")
    by_type = F.array_join(F.transform(F.map_entries("by_type"), lambda x: F.concat_ws(":", x["key"], x["value"].cast("string"))), ",")
    return found.select(*_SUMMARY, by_type.alias("by_type"), F.array_join("files", ",").alias("files"), F.size("files").cast("long").alias("n_files"), F.concat(F.array_join(F.slice("files", 1, 5), ","), more).alias("shown_files"))


_TESTS = {"sql": "t_sql_injection >= 2", "xss": "t_xss >= 1", "secret": "t_hardcoded_secret >= 1", "command": "t_command_injection >= 1", "dense": "total > 15", "clean": "minutes > 0 AND total = 0"}
_ADVICE = dict(sessions.ADVICE)


@_query(D.with_(D.SESSIONS, D.SESSION_FINDINGS, D.SUMMARIES) + "SELECT session_id, coalesce(nullif(concat_ws('|', " + ", ".join(f"CASE WHEN {t} THEN '{_ADVICE[k]}' END" for k, t in _TESTS.items()) + f"), ''), '{_ADVICE['other']}') AS recommendations FROM summaries")
def session_recommendations(spark, sf):
    found = sessions.recommendations(sessions.summaries(T.sessions(spark, sf), T.session_findings(spark, sf), _now(), with_files=False))
    return found.select("session_id", F.array_join("recommendations", "|").alias("recommendations"))


@_query(D.with_(D.SESSIONS) + "SELECT session_id, CAST(floor((epoch_ms(coalesce(ended_at, TIMESTAMP '2025-01-01')) - epoch_ms(started_at)) / 60000 + 0.5) AS BIGINT) AS minutes FROM sessions")
def session_duration(spark, sf):
    return T.sessions(spark, sf).select("session_id", S.minutes_between(F.col("started_at"), F.col("ended_at"), _now()).alias("minutes"))


@_query(D.with_(D.SESSIONS) + "SELECT session_id, developer_id, epoch_ms(coalesce(ended_at, lead(started_at) OVER (PARTITION BY developer_id ORDER BY started_at, session_id))) AS end_ms FROM sessions")
def implicit_session_end(spark, sf):
    return sessions.implicit_ends(T.sessions(spark, sf)).select("session_id", "developer_id", F.unix_millis("effective_end").alias("end_ms"))


@_query(D.with_(D.SHIFTS, D.SESSIONS) + "SELECT h.shift_id, count(s.ended_at) AS ended, len(assigned) AS n_assigned, count(s.ended_at) >= len(assigned) AND count(s.ended_at) > 0 AS completed FROM shifts h LEFT JOIN sessions s USING (shift_id) GROUP BY h.shift_id, assigned")
def shift_completion(spark, sf):
    return sessions.completion(T.shifts(spark, sf), T.sessions(spark, sf))


@_query(D.with_(D.SHIFTS, D.SESSIONS) + "SELECT h.shift_id, count(DISTINCT CASE WHEN ended_at IS NOT NULL THEN developer_id END) AS ended, len(assigned) AS n_assigned, count(DISTINCT CASE WHEN ended_at IS NOT NULL THEN developer_id END) >= len(assigned) AND count(s.ended_at) > 0 AS completed FROM shifts h LEFT JOIN sessions s USING (shift_id) GROUP BY h.shift_id, assigned")
def shift_completion_distinct(spark, sf):
    return sessions.completion(T.shifts(spark, sf), T.sessions(spark, sf), True)


@_query(D.with_(D.SESSIONS) + "SELECT session_id, developer_id, epoch_ms(started_at) AS started_ms FROM sessions ORDER BY started_at DESC, session_id LIMIT 10")
def recent_sessions_top10(spark, sf):
    return T.sessions(spark, sf).orderBy(F.desc("started_at"), "session_id").limit(10).select("session_id", "developer_id", F.unix_millis("started_at").alias("started_ms"))


@_query(D.with_(D.SESSIONS) + "SELECT developer_id, session_id FROM sessions WHERE ended_at IS NULL QUALIFY row_number() OVER (PARTITION BY developer_id ORDER BY started_at, session_id) = 1")
def active_sessions(spark, sf):
    return sessions.active_session(T.sessions(spark, sf)).select("developer_id", "session_id")


_OPEN = "open_sessions AS (SELECT developer_id, session_id, shift_id AS open_shift FROM sessions WHERE ended_at IS NULL QUALIFY row_number() OVER (PARTITION BY developer_id ORDER BY started_at, session_id) = 1)"


@_query(D.with_(D.SHIFTS, D.SESSIONS, _OPEN) + "SELECT h.developer_id, h.shift_id, h.name, CASE WHEN open_shift = h.shift_id THEN 'can_end' WHEN status <> 'completed' AND o.session_id IS NULL THEN 'can_start' WHEN status = 'completed' THEN 'done' ELSE 'waiting' END AS state FROM (SELECT *, unnest(assigned) AS developer_id FROM shifts) h LEFT JOIN open_sessions o USING (developer_id)")
def shift_action_state(spark, sf):
    """For every developer and assigned shift."""
    return sessions.shift_action(T.shifts(spark, sf), sessions.active_session(T.sessions(spark, sf)))


_LOG = """log AS (
  SELECT session_id, developer_id, shift_id, 'start' AS op, started_at AS "at", session_id * 10 AS seq FROM sessions
  UNION ALL SELECT session_id, developer_id, shift_id, 'end', ended_at, session_id * 10 + 1 FROM sessions WHERE ended_at IS NOT NULL
  UNION ALL SELECT session_id, developer_id, shift_id, 'end', ended_at + INTERVAL 5 MINUTE, session_id * 10 + 2 FROM sessions WHERE ended_at IS NOT NULL AND session_id % 7 = 0
  UNION ALL SELECT session_id + 1000000000, developer_id, shift_id, 'end', started_at, session_id * 10 + 3 FROM sessions WHERE session_id % 9 = 0)"""


def _session_log(spark, sf):
    s = T.sessions(spark, sf)
    row = lambda df, op, at, n: df.select("session_id", "developer_id", "shift_id", F.lit(op).alias("op"), at.alias("at"), (F.col("seq") * 10 + n).alias("seq"))
    s, ended = s.withColumn("seq", F.col("session_id")), s.withColumn("seq", F.col("session_id")).filter("ended_at is not null")
    again = row(ended.filter("session_id % 7 = 0"), "end", F.col("ended_at") + F.expr("interval 5 minutes"), 2)
    stray = row(s.filter("session_id % 9 = 0").withColumn("session_id", F.col("session_id") + 1000000000), "end", F.col("started_at"), 3)
    return row(s, "start", F.col("started_at"), 0).unionByName(row(ended, "end", F.col("ended_at"), 1)).unionByName(again).unionByName(stray)


@_query(D.with_(D.SESSIONS, _LOG) + ", r AS (SELECT session_id, any_value(developer_id) AS developer_id, min(\"at\") FILTER (op = 'start') AS started_at, max_by(\"at\", seq) FILTER (op = 'end') AS ended_at FROM log GROUP BY session_id HAVING min(\"at\") FILTER (op = 'start') IS NOT NULL) SELECT session_id, developer_id, epoch_ms(started_at) AS started_ms, epoch_ms(ended_at) AS ended_ms, epoch_ms(coalesce(ended_at, lead(started_at) OVER (PARTITION BY developer_id ORDER BY started_at, session_id))) AS effective_ms FROM r")
def session_log_fold(spark, sf):
    """Starts, ends and repeated ends folded to sessions."""
    found = sessions.from_log(_session_log(spark, sf))
    return found.select("session_id", "developer_id", *[F.unix_millis(c).alias(n) for c, n in (("started_at", "started_ms"), ("ended_at", "ended_ms"), ("effective_end", "effective_ms"))])


_LATE = """l AS (SELECT session_id, started_at, ended_at, session_id * 100 AS first_seq, lead(started_at) OVER w AS next_at, lead(session_id * 100) OVER w AS next_seq FROM sessions WINDOW w AS (PARTITION BY developer_id ORDER BY started_at, session_id)),
f AS (SELECT CASE WHEN l_partkey % 50 = 0 THEN l_orderkey + 1000000000 ELSE l_orderkey END AS session_id, 'f' || l_partkey % 3 AS finding_id, started_at + to_minutes(CAST((l_linenumber * 131) % 700 AS BIGINT)) AS "at", l_orderkey * 100 + 10 + l_linenumber AS seq FROM lineitem JOIN sessions ON l_orderkey = session_id)"""


@_query(D.with_(D.SESSIONS, _LATE) + "SELECT session_id, finding_id, epoch_ms(min(\"at\")) AS added_ms FROM f JOIN l USING (session_id) WHERE (\"at\" > started_at OR \"at\" = started_at AND seq > first_seq) AND (ended_at IS NULL OR \"at\" < ended_at OR \"at\" = ended_at AND seq < session_id * 100 + 1) AND (next_at IS NULL OR \"at\" < next_at OR \"at\" = next_at AND seq < next_seq) GROUP BY ALL")
def session_findings_of_log(spark, sf):
    """Findings that are added to open sessions; a part of the log's findings
    come after the end, again, or for sessions that never began."""
    log = _session_log(spark, sf).withColumns({"seq": F.col("session_id") % 1000000000 * 100 + F.col("seq") % 10, "finding_id": F.lit(None).cast("string")})
    late = T.table(spark, sf, "lineitem").join(T.sessions(spark, sf), F.col("l_orderkey") == F.col("session_id"))
    at = F.timestamp_seconds(F.unix_seconds("started_at") + F.col("l_linenumber") * 131 % 700 * 60)
    session = F.when(F.col("l_partkey") % 50 == 0, F.col("session_id") + 1000000000).otherwise(F.col("session_id"))
    found = late.select(session.alias("session_id"), "developer_id", "shift_id", F.lit("finding").alias("op"), at.alias("at"), (F.col("l_orderkey") * 100 + 10 + F.col("l_linenumber")).alias("seq"), F.concat(F.lit("f"), (F.col("l_partkey") % 3).cast("string")).alias("finding_id"))
    return sessions.findings_of_log(log.unionByName(found)).select("session_id", "finding_id", F.unix_millis("at").alias("added_ms"))


@_query(D.with_(D.SHIFTS, D.SESSIONS) + "SELECT h.shift_id, h.name, CASE WHEN count(s.ended_at) >= len(assigned) AND count(s.ended_at) > 0 THEN 'completed' WHEN count(s.session_id) > 0 THEN 'active' ELSE status END AS status FROM shifts h LEFT JOIN sessions s USING (shift_id) GROUP BY h.shift_id, h.name, h.status, assigned")
def shift_states(spark, sf):
    return sessions.shift_states(T.shifts(spark, sf), T.sessions(spark, sf))


@_query(D.with_(D.SESSIONS, D.SESSION_FINDINGS, D.SUMMARIES) + "SELECT session_id, total, score FROM summaries WHERE ended_at IS NOT NULL ORDER BY session_id LIMIT 20")
def completed_reports(spark, sf):
    """The first 20 reports in the order in which they came."""
    found = sessions.summaries(T.sessions(spark, sf), T.session_findings(spark, sf), _now(), with_files=False)
    return sessions.completed_reports(found).orderBy("session_id").limit(20).select("session_id", "total", "score")


@_query(D.with_(D.SHIFTS, D.SESSIONS) + "SELECT h.project_id, s.shift_id, s.session_id FROM sessions s JOIN shifts h USING (shift_id)")
def sessions_of_shifts(spark, sf):
    """Sessions of the shifts of all projects."""
    return sessions.of_shifts(T.sessions(spark, sf), T.shifts(spark, sf)).select("project_id", "shift_id", "session_id")


@_query(D.with_(D.SHIFTS, D.SESSIONS) + "SELECT s.shift_id, s.session_id FROM sessions s JOIN shifts h USING (shift_id) WHERE project_id = 8")
def sessions_of_project(spark, sf):
    """Sessions of the shifts of one project."""
    return sessions.of_shifts(T.sessions(spark, sf), T.shifts(spark, sf), F.lit(8)).select("shift_id", "session_id")


# ---- learning ----


def _events(spark, sf):
    return T.findings(spark, sf).withColumn("snippet_hash", S.snippet_hash(F.col("code_snippet")))


@_query(D.with_(D.FINDINGS, D.BY_TYPE) + "SELECT * REPLACE (epoch_us(first_seen) // 1000 AS first_seen, epoch_us(last_seen) // 1000 AS last_seen) FROM by_type")
def learning_counters(spark, sf):
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    return learning.counters(T.findings(spark, sf)).withColumns({c: ms(c) for c in ("first_seen", "last_seen")})


@_query(D.with_(D.FINDINGS) + "SELECT developer_id, vuln_type, rule_id, count(*) FILTER (kind = 'FIXED') AS fixed, count(*) FILTER (kind = 'IGNORED') AS ignored, count(*) FILTER (kind = 'FALSE_POSITIVE') AS false_positives, epoch_us(max(ts)) // 1000 AS last_updated FROM findings GROUP BY ALL")
def rule_counters(spark, sf):
    return learning.rule_counters(T.findings(spark, sf)).withColumn("last_updated", F.unix_millis(F.col("last_updated").cast("timestamp")))


@_query(D.with_(D.FINDINGS, D.ADJUSTED) + "SELECT * FROM adjusted")
def adjusted_confidence(spark, sf):
    return learning.adjusted_confidence(T.findings(spark, sf))


@_query(D.with_(D.FINDINGS, D.SUPPRESSED) + "SELECT * FROM suppressed")
def suppressed_types(spark, sf):
    return learning.suppressed(T.findings(spark, sf))


@_query(D.with_(D.FINDINGS, D.hashes(5)) + "SELECT developer_id, array_to_string(hashes, ',') AS hashes FROM hashes")
def fp_window(spark, sf):
    """With a window of 5, so that entries are evicted here."""
    return learning.false_positive_hashes(_events(spark, sf), 5).select("developer_id", F.array_join("hashes", ",").alias("hashes"))


@_query(D.with_(D.FINDINGS, D.BY_TYPE) + "SELECT developer_id, vuln_type, CASE WHEN detections > 0 THEN CAST(floor(fixes / detections * 100 + 0.5) AS BIGINT) ELSE 0 END AS fix_rate FROM by_type")
def fix_rate(spark, sf):
    return learning.fix_rate(learning.counters(T.findings(spark, sf))).select("developer_id", "vuln_type", "fix_rate")


_WEAK = "weak AS (SELECT developer_id, list(vuln_type ORDER BY first_seen, vuln_type) AS weaknesses FROM by_type WHERE detections >= 3 AND fixes < detections * 0.5 GROUP BY developer_id)"


@_query(D.with_(D.FINDINGS, D.BY_TYPE, _WEAK) + "SELECT developer_id, array_to_string(weaknesses, ',') AS weaknesses FROM weak")
def recurring_weaknesses(spark, sf):
    return learning.weaknesses(learning.counters(T.findings(spark, sf))).select("developer_id", F.array_join("weaknesses", ",").alias("weaknesses"))


_PASSED = f"passed AS (SELECT f.* FROM findings f ANTI JOIN suppressed s USING (developer_id, vuln_type) WHERE confidence >= 0.7 AND NOT EXISTS (SELECT 1 FROM hashes h WHERE h.developer_id = f.developer_id AND list_contains(h.hashes, {D.HASH})))"


@_query(D.with_(D.FINDINGS, D.SUPPRESSED, D.hashes(100), _PASSED) + "SELECT seq, developer_id, vuln_type, confidence FROM passed")
def learning_filter(spark, sf):
    e = _events(spark, sf)
    return learning.learning_filter(e, learning.suppressed(e), learning.false_positive_hashes(e)).select("seq", "developer_id", "vuln_type", "confidence")


@_query(D.with_(D.FINDINGS, D.ADJUSTED) + "SELECT seq, coalesce(adjusted_confidence, confidence) AS confidence FROM findings LEFT JOIN adjusted USING (developer_id, vuln_type, rule_id)")
def confidence_override(spark, sf):
    e = T.findings(spark, sf)
    return learning.confidence_override(e, learning.adjusted_confidence(e)).select("seq", "confidence")


_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"


@_query(D.with_(D.FINDINGS, D.BY_TYPE, D.SUPPRESSED, _WEAK) + f", wanted AS (SELECT DISTINCT user_id AS developer_id, unnest({D.TYPES}) AS vuln_type FROM events) SELECT w.developer_id, w.vuln_type, CASE WHEN b.detections IS NULL THEN 'First time with ' || w.vuln_type || '.' ELSE concat_ws(chr(10), 'History of ' || w.vuln_type || ':', '  detections: ' || detections, '  fixes: ' || fixes, '  fix rate %: ' || CASE WHEN detections > 0 THEN CAST(floor(fixes / detections * 100 + 0.5) AS BIGINT) ELSE 0 END, '  ignored: ' || ignored, '  false positives: ' || b.false_positives, '  first seen: ' || {_ISO.format('first_seen')}, '  last seen: ' || {_ISO.format('last_seen')}, CASE WHEN s.false_positives IS NOT NULL THEN '  suppressed after repeated false positives' END, '  recurring: ' || array_to_string(weaknesses, ', ')) END AS context FROM wanted w LEFT JOIN by_type b USING (developer_id, vuln_type) LEFT JOIN suppressed s USING (developer_id, vuln_type) LEFT JOIN weak USING (developer_id)")
def learning_context(spark, sf):
    e = T.findings(spark, sf)
    by_type = learning.counters(e)
    wanted = e.select("developer_id").distinct().select("developer_id", F.explode(F.array(*[F.lit(t) for t in T.VULNERABILITY_TYPES])).alias("vuln_type"))
    return learning.context(by_type, learning.suppressed(e), learning.weaknesses(by_type), wanted)


@_query(D.with_(D.FINDINGS) + f"SELECT seq, {D.HASH} AS snippet_hash FROM findings")
def snippet_hash(spark, sf):
    return _events(spark, sf).select("seq", "snippet_hash")


def _halves(spark, sf):
    """The events until the middle of their time, and the later ones."""
    e = _events(spark, sf)
    middle = e.agg(F.timestamp_micros(F.floor((F.unix_micros(F.min("ts").cast("timestamp")) + F.unix_micros(F.max("ts").cast("timestamp"))) / 2)).alias("m")).first()["m"]
    later = F.col("ts").cast("timestamp") > F.lit(middle)
    return e.filter(~later), e.filter(later)


def _resumed(spark, sf, window=learning.HASH_WINDOW):
    first, then = _halves(spark, sf)
    return learning.profile(then, learning.profile(first, window=window), window)


@_query(D.with_(D.FINDINGS, D.BY_TYPE) + "SELECT * REPLACE (epoch_us(first_seen) // 1000 AS first_seen, epoch_us(last_seen) // 1000 AS last_seen), false_positives >= 3 AS suppressed FROM by_type")
def resumed_counters(spark, sf):
    """Counters of the later events, added to a profile of the earlier ones."""
    counts = [F.get("counts", i).alias(c) for i, c in enumerate(learning.COUNTS)]
    ms = [F.unix_millis(F.col(c).cast("timestamp")).alias(c) for c in ("first_seen", "last_seen")]
    rows = _resumed(spark, sf).filter("part = 'type'").select("developer_id", "vuln_type", *counts, *ms)
    return rows.withColumn("suppressed", F.col("false_positives") >= learning.SUPPRESS_AFTER)


@_query(D.with_(D.FINDINGS, D.ADJUSTED) + "SELECT * FROM adjusted")
def resumed_confidence(spark, sf):
    """The fold of the later actions, from the confidences of the earlier ones."""
    return _resumed(spark, sf).filter("part = 'rule'").select("developer_id", "vuln_type", "rule_id", "adjusted_confidence", "n_actions")


@_query(D.with_(D.FINDINGS, D.hashes(5)) + "SELECT developer_id, array_to_string(hashes, ',') AS hashes FROM hashes")
def resumed_fp_window(spark, sf):
    """The window of the later false positives, from that of the earlier ones."""
    return _resumed(spark, sf, 5).filter("part = 'hashes'").select("developer_id", F.array_join("hashes", ",").alias("hashes"))


_PASSES = """f AS (SELECT DISTINCT file_name AS document, seq // 200 AS pass, vuln_type || ':' || line_number AS finding_key FROM findings),
o AS (SELECT *, lag(pass) OVER w AS before, lead(pass) OVER w AS after FROM (SELECT DISTINCT document, pass FROM f) WINDOW w AS (PARTITION BY document ORDER BY pass)),
diff AS (
  SELECT f.document, f.pass, f.finding_key, CASE WHEN b.pass IS NULL THEN 'new' ELSE 'still' END AS status FROM f JOIN o USING (document, pass) LEFT JOIN f b ON b.document = f.document AND b.finding_key = f.finding_key AND b.pass = o.before
  UNION ALL SELECT f.document, o.after, f.finding_key, 'gone' FROM f JOIN o USING (document, pass) LEFT JOIN f a ON a.document = f.document AND a.finding_key = f.finding_key AND a.pass = o.after WHERE o.after IS NOT NULL AND a.pass IS NULL)"""


def _differences(spark, sf):
    """Every 200 events of a file count as one analysis of it."""
    found = T.findings(spark, sf).select(F.col("file_name").alias("document"), F.floor(F.col("seq") / 200).alias("pass"), F.concat_ws(":", "vuln_type", F.col("line_number").cast("string")).alias("finding_key"))
    return learning.pass_differences(found, found)


@_query(D.with_(D.FINDINGS, _PASSES) + "SELECT document, pass, finding_key, status FROM diff")
def pass_differences(spark, sf):
    """What is new, still there, and gone in each analysis of a file."""
    return _differences(spark, sf)


@_query(D.with_(D.FINDINGS, _PASSES) + "SELECT document, count(*) AS n_reference, count(DISTINCT finding_key) AS n_dedup FROM f GROUP BY document")
def detections_by_mode(spark, sf):
    """Detections of each file when every pass counts, and when each finding does once."""
    diff = _differences(spark, sf)
    count = lambda mode: learning.detection_events(diff, mode).groupBy("document").agg(F.count("*").alias(f"n_{mode}"))
    return count("reference").join(count("dedup"), "document")


# ---- the scan ----

_SCANNED = ["finding_key", "file_name", "language_id", "type", "severity", "confidence", "message", "line_number", "column_number", "code_snippet", "rule_id", "pattern_id", "range_start", "range_end"]


def _scan(spark, sf, which=rules.RULES):
    return scan.scan(T.code_corpus(spark, sf), which)


def _scan_sql(which=rules.RULES) -> str:
    return D.with_(D.DOCS, scan.sql(which).strip())


@_query(_scan_sql((rules.SQL,)) + f"SELECT {', '.join(_SCANNED)} FROM findings")
def scan_sql(spark, sf):
    return _scan(spark, sf, (rules.SQL,)).select(*_SCANNED)


@_query(_scan_sql((rules.XSS,)) + f"SELECT {', '.join(_SCANNED)} FROM findings")
def scan_xss(spark, sf):
    return _scan(spark, sf, (rules.XSS,)).select(*_SCANNED)


@_query(_scan_sql((rules.SECRET,)) + f"SELECT {', '.join(_SCANNED)} FROM findings")
def scan_secret(spark, sf):
    return _scan(spark, sf, (rules.SECRET,)).select(*_SCANNED)


@_query(_scan_sql() + f"SELECT {', '.join(_SCANNED)} FROM findings")
def scan_all(spark, sf):
    return _scan(spark, sf).select(*_SCANNED)


_CATALOGUE = "catalogue(rule_id, rule_name, type, pattern_id, pattern_index, base, languages, n_keywords) AS (VALUES " + ", ".join(f"('{r.id}', '{r.name}', '{r.type}', '{p.id}', {j}, {p.base}::DOUBLE, '{','.join(r.languages)}', {len(p.keywords)})" for r in rules.RULES for j, p in enumerate(r.patterns)) + ")"


@_query(_scan_sql() + f", {_CATALOGUE} SELECT c.*, count(f.finding_key) AS n_findings, count(DISTINCT f.file_name) AS n_files FROM catalogue c LEFT JOIN findings f USING (rule_id, pattern_id) GROUP BY ALL")
def rule_catalog(spark, sf):
    """Every rule and pattern with what it finds in all files."""
    return scan.by_entry(spark, _scan(spark, sf))


@_query(_scan_sql() + "SELECT finding_key, file_name, confidence FROM findings WHERE confidence >= 0.9")
def findings_under_settings(spark, sf):
    """The scan under a session's settings, here a higher least confidence."""
    return scan.under(settings.Settings(min_confidence=0.9), T.code_corpus(spark, sf)).select("finding_key", "file_name", "confidence")


def _odd_quotes(text: str, file_name: str, language_id: str):
    for n, line in enumerate(text.split("\n"), 1):
        if line.count('"') % 2:
            yield {"line_number": n, "code_snippet": line.strip(), "message": "A quotation mark is left open."}


def _calls(text: str, file_name: str, language_id: str):
    for n, line in enumerate(text.split("\n"), 1):
        at = line.find("execute(")
        if at >= 0:
            yield {"line_number": n, "column_number": at, "code_snippet": line.strip(), "message": "A statement is executed.", "confidence": 0.65, "severity": "LOW"}


def _lines(text: str, file_name: str, language_id: str):
    n = text.count("\n") + 1
    if language_id == "rust":
        raise ValueError(f"no lines of {language_id}")
    if n > 2:
        yield {"line_number": n, "code_snippet": text.split("\n")[-1].strip(), "message": "The file has several lines."}


_CODE_RULES = (code_rules.CodeRule("LINT-CODE-001", "Open quotation", "MISSING_INPUT_VALIDATION", (), _odd_quotes), code_rules.CodeRule("LINT-CODE-002", "Lines", "INSECURE_AUTH", (), _lines), code_rules.CodeRule("LINT-CODE-003", "Executed", "COMMAND_INJECTION", ("python",), _calls))


@_query(_scan_sql() + """, lines AS (SELECT file_name, language_id, len(string_split(text, chr(10))) AS n_lines, unnest(string_split(text, chr(10))) AS line, CAST(unnest(range(1, len(string_split(text, chr(10))) + 1)) AS INTEGER) AS n FROM docs)
SELECT file_name, rule_id, type, severity, confidence, line_number, column_number, code_snippet, NULL::VARCHAR AS error FROM findings
UNION ALL SELECT file_name, 'LINT-CODE-001', 'MISSING_INPUT_VALIDATION', 'HIGH', 0.8::DOUBLE, n, 0, trim(line), NULL FROM lines WHERE (length(line) - length(replace(line, '"', ''))) % 2 = 1
UNION ALL SELECT file_name, 'LINT-CODE-002', 'INSECURE_AUTH', 'HIGH', 0.8::DOUBLE, n, 0, trim(line), NULL FROM lines WHERE n = n_lines AND n > 2 AND language_id <> 'rust'
UNION ALL SELECT file_name, 'LINT-CODE-003', 'COMMAND_INJECTION', 'LOW', 0.65::DOUBLE, n, CAST(position('execute(' IN line) - 1 AS INTEGER), trim(line), NULL FROM lines WHERE contains(line, 'execute(') AND language_id = 'python'
UNION ALL SELECT DISTINCT file_name, 'LINT-CODE-002', 'INSECURE_AUTH', NULL, NULL::DOUBLE, NULL::INTEGER, NULL::INTEGER, NULL, 'ValueError: no lines of rust' FROM docs WHERE language_id = 'rust'""")
def code_and_pattern_rules(spark, sf):
    """Rules of both kinds, one of which raises on some files."""
    return code_rules.scan(T.code_corpus(spark, sf), _CODE_RULES).select("file_name", "rule_id", "type", "severity", "confidence", "line_number", "column_number", "code_snippet", "error")


@_query(_scan_sql() + "SELECT file_name, pattern_id, range_start, CAST(coalesce(boost, 0) AS INTEGER) AS boost FROM live WHERE len(keywords) > 0")
def keyword_boost(spark, sf):
    hits = scan.raw_matches(T.code_corpus(spark, sf)).filter("not comment")
    some = F.lit(None).cast("string")
    for i, r in enumerate(rules.RULES):
        for j, p in enumerate(r.patterns):
            if p.keywords:
                some = F.when((F.col("rule_index") == i) & (F.col("pattern_index") == j), p.id).otherwise(some)
    return hits.withColumn("pattern_id", some).filter("pattern_id is not null").select("file_name", "pattern_id", "range_start", "boost")


@_query(_scan_sql() + "SELECT file_name, rule_index, pattern_index, range_start, range_end, line_number, column_number FROM lined")
def finding_positions(spark, sf):
    return scan.raw_matches(T.code_corpus(spark, sf)).select("file_name", "rule_index", "pattern_index", "range_start", "range_end", "line_number", "column_number")


@_query(_scan_sql() + "SELECT CAST(rule_index AS INTEGER) AS rule_index, count(*) AS n_raw, (SELECT count(*) FROM live WHERE live.rule_index = lined.rule_index) AS n_live, (SELECT count(*) FROM findings WHERE findings.rule_index = lined.rule_index) AS n_findings FROM lined GROUP BY rule_index")
def comment_filter_and_line_dedup(spark, sf):
    """How many matches of each rule are left outside comments, and one for each line."""
    hits = scan.raw_matches(T.code_corpus(spark, sf))
    live = ~F.col("comment")
    return hits.groupBy("rule_index").agg(F.count("*").alias("n_raw"), F.count_if(live).alias("n_live"), F.count_distinct(F.when(live, F.struct("file_name", "line_number"))).alias("n_findings"))


_RANKED = f", ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY file_name ORDER BY {_RANK}, line_number, rule_index, pattern_index, range_start) AS INTEGER) AS position FROM findings)"


def _answers() -> dict:
    escalation = F.when(F.col("severity") == "CRITICAL", "CRITICAL_PATTERN").when(F.col("position") == 2, "REPEATED").when(F.col("position") == 3, "PERSISTENT").when(F.col("boosted_name"), "OTHER")
    return {"explanation": F.concat(F.lit("note on "), "pattern_id"), "escalation": escalation}


def _enriched(spark, sf):
    found = _scan(spark, sf).withColumn("boosted_name", F.contains("pattern_id", F.lit("react")))
    return dashboards.enrich_top(found, _answers(), ["file_name"], scan.severity_order())


@_query(_scan_sql() + _RANKED + " SELECT finding_key, file_name, position, CASE WHEN position <= 3 THEN 'note on ' || pattern_id END AS explanation FROM ranked")
def enrich_top3(spark, sf):
    return _enriched(spark, sf).select("finding_key", "file_name", "position", "explanation")


@_query(_scan_sql() + _RANKED + ", e AS (SELECT *, CASE WHEN position <= 3 THEN CASE WHEN severity = 'CRITICAL' THEN 'Critical pattern: ' WHEN position = 2 THEN 'Repeated: ' WHEN position = 3 THEN 'Persistent: ' WHEN contains(pattern_id, 'react') THEN '' END END AS prefix FROM ranked) SELECT file_name, count(*) FILTER (position <= 3) AS n_enriched, min_by(prefix || 'note on ' || pattern_id, position) FILTER (prefix IS NOT NULL) AS notice FROM e GROUP BY file_name")
def enrichment_summary(spark, sf):
    """Enriched findings of each file, and its first escalation."""
    return dashboards.enrichment(_enriched(spark, sf))


_ICON = "CASE severity WHEN 'CRITICAL' THEN '\U0001f6a8' WHEN 'HIGH' THEN '\U0001f534' WHEN 'MEDIUM' THEN '\U0001f7e0' WHEN 'LOW' THEN '\U0001f7e1' ELSE '\u2139\ufe0f' END"
_LINE = f"{_ICON} || ' [' || severity || '] ' || type || ', line ' || line_number || ' (' || CAST(floor(confidence * 100 + 0.5) AS BIGINT) || ' %)' AS line, CASE WHEN length(code_snippet) > 80 THEN left(code_snippet, 80) || '...' ELSE code_snippet END AS snippet"


@_query(_scan_sql() + f"SELECT finding_key, file_name, {_LINE} FROM findings")
def log_rows(spark, sf):
    return dashboards.log_rows(_scan(spark, sf))


@_query(_scan_sql() + f"SELECT finding_key, file_name, {_LINE} FROM findings WHERE severity IN ('CRITICAL', 'HIGH')")
def alert_rows(spark, sf):
    return dashboards.alert_rows(_scan(spark, sf))


@_query(_scan_sql() + "SELECT d.file_name, count(f.finding_key) AS n, string_split(d.file_name, '/')[-1] || CASE WHEN count(f.finding_key) = 0 THEN ': no findings' ELSE ': ' || count(f.finding_key) || ' found' END AS line FROM docs d LEFT JOIN findings f USING (file_name) GROUP BY d.file_name")
def log_heads(spark, sf):
    return dashboards.log_heads(T.code_corpus(spark, sf), _scan(spark, sf))


@_query(_scan_sql() + "SELECT sha256('s1|' || finding_key) AS record_id, 'DEV001' AS developer_id, NULL::VARCHAR AS github_username, 's1' AS session_id, type AS vulnerability_type, severity, confidence, file_name, line_number, column_number, code_snippet, rule_id AS detected_by_rule, finding_key AS finding_id FROM findings")
def finding_records(spark, sf):
    return dashboards.records(_scan(spark, sf), F.lit(settings.Settings().developer_id), F.lit(None).cast("string"), F.lit("s1"))


@_query(_scan_sql() + "SELECT finding_key AS id, type, severity, confidence, file_name, line_number, code_snippet, CASE WHEN line_number % 2 = 0 THEN rule_id ELSE 'unknown' END AS rule_id FROM findings")
def session_finding_rows(spark, sf):
    return dashboards.session_rows(_scan(spark, sf).withColumn("rule_id", F.when(F.col("line_number") % 2 == 0, F.col("rule_id"))))


@_query(_scan_sql() + ", probes AS (SELECT file_name, CAST(unnest([5, 30, 60]) AS INTEGER) AS \"offset\" FROM docs) SELECT file_name, \"offset\", min_by(finding_key, (range_start, rule_index, pattern_index)) AS finding_key FROM probes JOIN findings USING (file_name) WHERE range_start <= \"offset\" AND range_end >= \"offset\" GROUP BY ALL")
def hover(spark, sf):
    """What stands at three offsets of every file."""
    probes = T.code_corpus(spark, sf).select("file_name", F.explode(F.array(F.lit(5), F.lit(30), F.lit(60))).alias("offset"))
    return dashboards.hover(_scan(spark, sf), probes).select("file_name", "offset", "finding_key")


_META = "meta(type, title, description, recommendation) AS (VALUES " + ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in row) + ")" for row in explain.METADATA) + ")"


@_query(_scan_sql().rstrip() + ", " + _META + " SELECT finding_key, coalesce(title, replace(type, '_', ' ')) AS title, coalesce(description, message) AS description, coalesce(recommendation, 'Follow secure coding practice.') AS recommendation FROM findings LEFT JOIN meta USING (type)")
def metadata_join(spark, sf):
    return explain.with_metadata(_scan(spark, sf)).select("finding_key", "title", "description", "recommendation")


_SLUG = "CASE type WHEN 'SQL_INJECTION' THEN 'SQL_Injection' WHEN 'XSS' THEN 'Cross_Site_Scripting_(XSS)' WHEN 'HARDCODED_SECRET' THEN 'Use_of_Hard-coded_Cryptographic_Key' ELSE type END"


@_query(_scan_sql() + f"SELECT finding_key, '[' || type || ']' || chr(10) || message || chr(10) || 'Severity: ' || severity || ' | Confidence: ' || CAST(floor(confidence * 100 + 0.5) AS BIGINT) || '%' AS text, CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 'Error' ELSE 'Hint' END AS level, CASE severity WHEN 'CRITICAL' THEN '🚨' ELSE '🔴' END AS icon, 'https://owasp.org/www-community/attacks/' || {_SLUG} AS target FROM findings")
def diagnostic_rows(spark, sf):
    return dashboards.diagnostics(_scan(spark, sf)).select("finding_key", "text", "level", "icon", "target")


def _first(code: str, *patterns: str, default: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({code}, '{p}', 1), '')" for p in patterns) + f", '{default}')"


_FIXED = """)
SELECT finding_key, variable, query_kind, language, "column", query_variable, CASE WHEN query_kind = 'SELECT' THEN first_query END AS attack_query,
  CASE language WHEN 'csharp' THEN 'string ' || query_variable || ' = "' || regexp_replace(regexp_replace(coalesce(base, 'SELECT * FROM Table WHERE ' || "column" || '='), '\\s+$', ''), '=\\s*["'']?\\s*$', '=@' || "column") || '"; add @' || "column" || ' = ' || variable
    WHEN 'python' THEN 'cursor.execute("... WHERE ' || "column" || ' = %s", (' || variable || ',))'
    WHEN 'javascript' THEN 'const ' || query_variable || ' = "... WHERE ' || "column" || ' = ?"; execute(' || query_variable || ', [' || variable || '])'
    ELSE 'PREPARE with ?; EXECUTE USING ' || variable END AS fixed_code
FROM e"""


@_query(_scan_sql((rules.SQL,)).rstrip() + f""", e AS (SELECT finding_key, {_first("code_snippet", r"\+\s*(\w+)\s*;?$", default="userInput")} AS variable,
  CASE WHEN code_snippet ILIKE '%INSERT%' THEN 'INSERT' WHEN code_snippet ILIKE '%UPDATE%' THEN 'UPDATE' WHEN code_snippet ILIKE '%DELETE%' THEN 'DELETE' ELSE 'SELECT' END AS query_kind,
  CASE WHEN regexp_matches(code_snippet, '(?:string|var)\\s+\\w+\\s*=') THEN 'csharp' WHEN regexp_matches(code_snippet, 'f["'']') OR contains(code_snippet, '%') THEN 'python' WHEN contains(code_snippet, '`') OR regexp_matches(code_snippet, 'const|let') THEN 'javascript' ELSE 'generic' END AS language,
  {_first("code_snippet", r"(?i)WHERE\s+(\w+)\s*=", default="id")} AS "column", {_first("code_snippet", r"(?:string|var|let|const|query)\s+(\w+)\s*=", default="query")} AS query_variable,
  {_first("code_snippet", r"""["''`]([^"''`]+)["''`]""", default="SELECT * FROM table WHERE id=")} || '1 OR 1=1 --' AS first_query, nullif(regexp_extract(code_snippet, '["'']([^"'']+)["'']\\s*\\+', 1), '') AS base FROM findings""" + _FIXED)
def explain_sql(spark, sf):
    return explain.explain(_scan(spark, sf, (rules.SQL,))).select("finding_key", "variable", "query_kind", "language", "column", "query_variable", "attack_query", "fixed_code")


@_query(_scan_sql((rules.XSS,)) + f"""SELECT finding_key, headline, attack, fixed_code FROM (
  SELECT finding_key, v || ' is written to the page unescaped' AS headline, CASE sink WHEN 'eval' THEN 'Code in ' || v || ' runs at once.' WHEN 'react' THEN 'React''s escaping is bypassed.' ELSE 'Markup in ' || v || ' may run scripts.' END AS attack,
    CASE sink WHEN 'innerHTML' THEN 'element.textContent = ' || v WHEN 'eval' THEN 'JSON.parse(' || v || ')' ELSE 'sanitize(' || v || ')' END AS fixed_code FROM (
    SELECT *, {_first("code_snippet", r"=\s*(\w+)\s*;?\s*$", r"\((\w+)\)", r"\{(\w+)\}", default="userInput")} AS v,
      CASE WHEN contains(code_snippet, 'innerHTML') THEN 'innerHTML' WHEN regexp_matches(code_snippet, '\\beval\\s*\\(') THEN 'eval' WHEN contains(code_snippet, 'dangerouslySetInnerHTML') THEN 'react' ELSE 'other' END AS sink FROM findings))""")
def explain_xss(spark, sf):
    return explain.explain(_scan(spark, sf, (rules.XSS,))).select("finding_key", "headline", "attack", "fixed_code")


@_query(_scan_sql((rules.SECRET,)) + f"""SELECT finding_key, CASE WHEN regexp_matches(code_snippet, 'AKIA|(?i:aws)') THEN 'AWS key' WHEN regexp_matches(code_snippet, 'eyJ|(?i:jwt|token)') THEN 'Token' WHEN regexp_matches(code_snippet, '(?i)api_?key') THEN 'API key' WHEN regexp_matches(code_snippet, '(?i)password|passwd|pwd') THEN 'Password' ELSE 'Credential' END AS secret_kind,
  {_first("code_snippet", r"(?:const|let|var|private|string)\s+(\w+)\s*=", default="secret")} || ' = env.' || upper({_first("code_snippet", r"(?:const|let|var|private|string)\s+(\w+)\s*=", default="secret")}) AS fixed_code FROM findings""")
def explain_secret(spark, sf):
    return explain.explain(_scan(spark, sf, (rules.SECRET,))).select("finding_key", "secret_kind", "fixed_code")


_OTHER = "'run(\"ls \" + ' || c_name || ')'"


@_query(f"""WITH f AS (SELECT c_custkey AS id, ['COMMAND_INJECTION', 'PATH_TRAVERSAL', 'INSECURE_AUTH'][c_custkey % 3 + 1] AS type, 'run("ls " + name' || c_custkey || ')' AS code FROM customer), v AS (SELECT *, {_first("code", r"\+\s*(\w+)", r"\$\{(\w+)\}", default="userInput")} AS v FROM f)
SELECT id, CASE type WHEN 'COMMAND_INJECTION' THEN 'A command is joined with ' || v WHEN 'PATH_TRAVERSAL' THEN 'A path is joined with ' || v ELSE replace(type, '_', ' ') || ' detected' END AS headline, CASE type WHEN 'COMMAND_INJECTION' THEN 'execFile(program, [' || v || '])' WHEN 'PATH_TRAVERSAL' THEN 'resolve(base, ' || v || '), then check that it starts with base' ELSE 'See the guidelines on ' || replace(type, '_', ' ') END AS fixed_code FROM v""")
def explain_others(spark, sf):
    kinds = F.array(*[F.lit(t) for t in ("COMMAND_INJECTION", "PATH_TRAVERSAL", "INSECURE_AUTH")])
    c = T.table(spark, sf, "customer")
    found = c.select(F.col("c_custkey").alias("id"), F.element_at(kinds, (F.col("c_custkey") % 3 + 1).cast("int")).alias("type"), F.concat(F.lit('run("ls " + name'), F.col("c_custkey").cast("string"), F.lit(")")).alias("code_snippet"))
    return explain.explain(found).select("id", "headline", "fixed_code")


# ---- events, state, functions ----


@_query(D.with_(D.FINDINGS) + "SELECT CAST(seq AS VARCHAR) AS event_id, developer_id, vuln_type, severity, confidence, file_name, line_number, action, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS \"timestamp\" FROM findings")
def event_projection(spark, sf):
    return T.findings(spark, sf).select(F.col("seq").cast("string").alias("event_id"), "developer_id", "vuln_type", "severity", "confidence", "file_name", "line_number", "action", S.iso(F.col("ts").cast("timestamp")).alias("timestamp"))


@_query(D.with_(D.FINDINGS) + ", e AS (SELECT developer_id || ':' || vuln_type AS event_id, action, ts FROM findings), d AS (SELECT event_id, min(ts) AS seen FROM e WHERE action = 'DETECTED' GROUP BY event_id) SELECT event_id, action, epoch_us(ts) // 1000 - epoch_us(seen) // 1000 AS response_ms FROM e JOIN d USING (event_id) WHERE action <> 'DETECTED'")
def response_time(spark, sf):
    """Beyond the declared contract: nothing computed it before."""
    e = T.findings(spark, sf).select(F.concat_ws(":", F.col("developer_id").cast("string"), "vuln_type").alias("event_id"), "action", "ts")
    return dashboards.response_times(e)


_BURSTS = """WITH e AS (SELECT user_id AS document, ts, CASE WHEN event_type = 'purchase' THEN 'save' ELSE 'change' END AS kind, CAST(event_id AS VARCHAR) AS text FROM events),
p AS (SELECT *, CASE WHEN lag(kind) OVER w IS NULL OR lag(kind) OVER w = 'save' OR epoch_us(ts) // 1000 - epoch_us(lag(ts) OVER w) // 1000 >= {gap} THEN 1 ELSE 0 END AS opens FROM e WINDOW w AS (PARTITION BY document ORDER BY ts, kind)),
b AS (SELECT *, sum(opens) OVER (PARTITION BY document ORDER BY ts, kind) AS burst FROM p)
SELECT document, max_by(kind, (ts, kind)) AS kind, max_by(text, (ts, kind)) AS text, count(*) AS n_changes, epoch_us(max(ts)) // 1000 AS changed_ms, epoch_us(max(ts)) // 1000 + CASE WHEN max_by(kind, (ts, kind)) = 'save' THEN 0 ELSE {gap} END AS fires_ms FROM b GROUP BY document, burst"""


@_query(_BURSTS.format(gap=3_600_000))
def debounce_sessions(spark, sf):
    """Changes of a document (here: a user's events) within an hour count as
    one; a save (here: a purchase) ends them at once."""
    kind = F.when(F.col("event_type") == "purchase", "save").otherwise("change")
    e = T.table(spark, sf, "events").select(F.col("user_id").alias("document"), "ts", kind.alias("kind"), F.col("event_id").cast("string").alias("text"))
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    return streams.debounced(e, "1 hour").select("document", "kind", "text", "n_changes", ms("changed_at").alias("changed_ms"), ms("fires_at").alias("fires_ms"))


@_query(D.with_(D.FINDINGS) + f", a AS (SELECT seq, ['FIXED', 'IGNORED', 'FALSE_POSITIVE', 'DISMISSED', 'SECURE_EXAMPLE_VIEWED'][seq % 5 + 1] AS action, code_snippet FROM findings) SELECT seq, CASE action WHEN 'FIXED' THEN 'FIXED' WHEN 'SECURE_EXAMPLE_VIEWED' THEN 'FIXED' WHEN 'FALSE_POSITIVE' THEN 'FALSE_POSITIVE' ELSE 'IGNORED' END AS kind, {D.HASH} AS snippet_hash FROM a")
def learning_kinds(spark, sf):
    names = F.array(*[F.lit(a) for a in ("FIXED", "IGNORED", "FALSE_POSITIVE", "DISMISSED", "SECURE_EXAMPLE_VIEWED")])
    actions = T.findings(spark, sf).select("seq", F.element_at(names, (F.col("seq") % 5 + 1).cast("int")).alias("action"), "code_snippet")
    return learning.events_of_actions(actions).select("seq", "kind", "snippet_hash")


@_query(D.with_(D.FINDINGS) + "SELECT seq, vuln_type, severity FROM findings ORDER BY seq LIMIT 8")
def first_findings(spark, sf):
    return T.findings(spark, sf).orderBy("seq").limit(8).select("seq", "vuln_type", "severity")


@_query(D.with_(D.FINDINGS) + "SELECT seq, developer_id, vuln_type FROM findings WHERE seq = 77")
def finding_by_id(spark, sf):
    return T.findings(spark, sf).filter("seq = 77").select("seq", "developer_id", "vuln_type")


@_query(D.with_(D.PROJECTS, D.SHIFTS) + "SELECT p.project_id, p.name, s.shift_id, s.name AS shift_name FROM projects p JOIN shifts s USING (project_id)")
def shifts_with_project(spark, sf):
    shifts = T.shifts(spark, sf).select("project_id", "shift_id", F.col("name").alias("shift_name"))
    return commands.with_parent(shifts, T.projects(spark, sf), "project_id", "name").select("project_id", "name", "shift_id", "shift_name")


@_query(D.with_(D.FINDINGS) + f", latest AS (SELECT * FROM findings QUALIFY rank() OVER (PARTITION BY file_name ORDER BY seq DESC) = 1) SELECT count(*) AS total, {D.COUNTS} FROM latest")
def dashboard_summary(spark, sf):
    """Counts over what the last analysis of each file found."""
    return dashboards.summary(dashboards.latest_by_file(T.findings(spark, sf)))


@_query(D.with_(D.FINDINGS) + "SELECT string_agg(vuln_type || ':' || n, ',' ORDER BY vuln_type) AS by_type FROM (SELECT vuln_type, count(*) AS n FROM findings GROUP BY vuln_type)")
def summary_type_map(spark, sf):
    entries = F.transform(F.map_entries("by_type"), lambda x: F.concat_ws(":", x["key"], x["value"].cast("string")))
    return dashboards.type_map(T.findings(spark, sf)).select(F.array_join(entries, ",").alias("by_type"))


@_query(D.with_(D.FINDINGS) + "SELECT DISTINCT ON (developer_id, file_name) developer_id, file_name FROM findings")
def once_for_each_file(spark, sf):
    """Findings without repeats of (session, finding), here developer and file."""
    rows = T.findings(spark, sf).select(F.col("developer_id").alias("session_id"), F.col("file_name").alias("finding_id"))
    return streams.without_repeats(rows).select(F.col("session_id").alias("developer_id"), F.col("finding_id").alias("file_name"))


@_query(D.with_(D.FINDINGS) + "SELECT developer_id, seq, vuln_type FROM (SELECT *, kind = 'IGNORED' AS deleted FROM findings QUALIFY row_number() OVER (PARTITION BY developer_id ORDER BY ts DESC, seq DESC) = 1) WHERE NOT deleted")
def live_after_closings(spark, sf):
    """What the last analysis of each document (here: of each developer) found,
    unless it was closed since (here: an ignored finding)."""
    rows = T.findings(spark, sf).select("developer_id", "seq", "vuln_type", F.struct("ts", "seq").alias("at"), (F.col("kind") == "IGNORED").alias("deleted"))
    return sinks.latest(rows, "developer_id", "at", "deleted").select("developer_id", "seq", "vuln_type")


@_query(D.with_(D.SHIFTS) + "SELECT shift_id, array_to_string(CASE WHEN shift_id % 3 = 0 THEN [shift_id * 7, shift_id * 7 + 1] WHEN shift_id % 5 = 0 THEN [] ELSE assigned END, ',') AS ids, array_to_string(list_transform(CASE WHEN shift_id % 3 = 0 THEN [shift_id * 7, shift_id * 7 + 1] WHEN shift_id % 5 = 0 THEN [] ELSE assigned END, lambda x: 'dev' || x), ',') AS names FROM shifts WHERE shift_id % 11 <> 0")
def shift_assignments(spark, sf):
    """Both arrays of a shift's developers, replaced together by the last change."""
    s = T.shifts(spark, sf)
    names = lambda ids: F.transform(ids, lambda x: F.concat(F.lit("dev"), x.cast("string")))

    def said(df, seq, op, ids):
        return df.select("shift_id", F.lit(seq).alias("seq"), F.lit(op).alias("op"), ids.alias("ids"), names(ids).alias("names"))

    pair, none = F.array(F.col("shift_id") * 7, F.col("shift_id") * 7 + 1), F.array().cast("array<bigint>")
    log = said(s, 1, "create", F.col("assigned")).unionByName(said(s.filter("shift_id % 3 = 0 or shift_id % 5 = 0"), 2, "update", none)).unionByName(said(s.filter("shift_id % 3 = 0"), 3, "update", pair))
    log = log.unionByName(said(s.filter("shift_id % 11 = 0"), 4, "delete", F.lit(None).cast("array<bigint>")))
    return commands.fold(log, "shift_id", ["ids", "names"]).select("shift_id", F.array_join("ids", ",").alias("ids"), F.array_join("names", ",").alias("names"))


@_query(D.with_(D.SHIFTS) + "SELECT shift_id, name FROM shifts WHERE project_id = 8")
def shifts_of_project(spark, sf):
    return sessions.shifts_of(T.shifts(spark, sf), 8).select("shift_id", "name")


@_query(D.with_(D.USERS) + "SELECT user_id, 'user-' || left(role, 3) || '-' || left(sha256(username), 12) AS id, 'proj-' || left(sha256(username || '|' || user_id), 12) AS project FROM users")
def prefixed_ids(spark, sf):
    """Ids with a prefix that follow from what they are of."""
    return T.users(spark, sf).select("user_id", S.user_id(F.col("role"), F.col("username")).alias("id"), S.prefixed_id("proj-", F.col("username"), F.col("user_id").cast("string")).alias("project"))


_COMMANDS = "c AS (SELECT n_nationkey AS project_id, 1 AS seq, 'create' AS op, n_name AS name, 'active' AS status FROM nation UNION ALL SELECT n_nationkey, 2, 'update', NULL, 'archived' FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_nationkey, 3, 'delete', NULL, NULL FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT n_nationkey, 4, 'create', 'again', 'active' FROM nation WHERE n_nationkey % 6 = 0)"


@_query(D.with_(_COMMANDS) + "SELECT project_id, CASE WHEN project_id % 6 = 0 THEN 'again' ELSE name END AS name, CASE WHEN project_id % 6 = 0 THEN 'active' WHEN project_id % 2 = 0 THEN 'archived' ELSE 'active' END AS status FROM c WHERE seq = 1 AND (project_id % 3 <> 0 OR project_id % 6 = 0)")
def command_log_fold(spark, sf):
    n = T.table(spark, sf, "nation").select(F.col("n_nationkey").alias("project_id"), F.col("n_name").alias("name"))
    null = F.lit(None).cast("string")

    def said(df, seq, op, name, status):
        return df.select("project_id", F.lit(seq).alias("seq"), F.lit(op).alias("op"), name.alias("name"), status.alias("status"))

    log = said(n, 1, "create", F.col("name"), F.lit("active"))
    log = log.unionByName(said(n.filter("project_id % 2 = 0"), 2, "update", null, F.lit("archived"))).unionByName(said(n.filter("project_id % 3 = 0"), 3, "delete", null, null)).unionByName(said(n.filter("project_id % 6 = 0"), 4, "create", F.lit("again"), F.lit("active")))
    return commands.fold(log, "project_id", ["name", "status"])


@_query("""SELECT p_partkey, CASE WHEN length(p_name) > 8 THEN left(p_name, 8) || '...' ELSE p_name END AS shortened, replace(replace(replace(replace('<' || p_brand || '> & "x"', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped,
  'part' || p_partkey || '.ts' AS base, 'ts' AS ext, replace('A_' || p_size, '_', ' ') AS label, CAST(floor(p_retailprice + 0.5) AS BIGINT) AS rounded, floor(p_retailprice / 7 * 100 + 0.5) / 100 AS rounded2, sha256(p_name) AS sha, upper(left(p_name, 1)) AS initial,
  coalesce(CASE WHEN p_size % 3 = 0 THEN p_brand END, CASE WHEN p_size % 2 = 0 THEN p_type END, 'DEV_UNKNOWN') AS identity, CASE WHEN p_size % 2 = 0 THEN '' ELSE 'b' END AS last_part,
  ['#f47067', '#e09b3d', '#d29922', '#3fb950', '#3fb950'][p_size % 5 + 1] AS colour, CASE WHEN p_size >= 80 THEN '#3fb950' WHEN p_size >= 50 THEN '#d29922' ELSE '#f47067' END AS score_colour,
  ['Critical pattern: ', 'Persistent: ', 'Repeated: ', '', ''][p_size % 5 + 1] AS prefix, ['Error', 'Error', 'Warning', 'Information', 'Hint'][p_size % 5 + 1] AS level, coalesce(strftime(TIMESTAMP '2025-03-04 05:06:00' + to_days(CASE WHEN p_size % 4 > 0 THEN CAST(p_size AS INTEGER) END), '%d %b %Y, %H:%M'), 'Invalid Date') AS shown_date FROM part""")
def scalar_functions(spark, sf):
    p = T.table(spark, sf, "part")
    severity = F.element_at(F.array(*[F.lit(x) for x in S.SEVERITIES]), (F.col("p_size") % 5 + 1).cast("int"))
    levels = F.array(*[F.lit(x) for x in ("CRITICAL_PATTERN", "PERSISTENT", "REPEATED", "FIRST", "OTHER")])
    path = F.concat(F.lit("src/a/part"), F.col("p_partkey").cast("string"), F.lit(".TS"))
    return p.select(
        "p_partkey", S.truncated(F.col("p_name"), 8, "...").alias("shortened"), S.html_escaped(F.concat(F.lit("<"), "p_brand", F.lit('> & "x"'))).alias("escaped"),
        S.basename(F.replace(path, F.lit(".TS"), F.lit(".ts"))).alias("base"), S.extension(path).alias("ext"), S.label(F.concat(F.lit("A_"), F.col("p_size").cast("string"))).alias("label"),
        S.js_round(F.col("p_retailprice")).alias("rounded"), S.js_round(F.col("p_retailprice") / 7, 2).alias("rounded2"), F.sha2("p_name", 256).alias("sha"), S.initial(F.col("p_name")).alias("initial"),
        S.developer_identity(F.when(F.col("p_size") % 3 == 0, F.col("p_brand")), F.when(F.col("p_size") % 2 == 0, F.col("p_type"))).alias("identity"),
        S.last_part(F.when(F.col("p_size") % 2 == 0, "a/b/").otherwise("a/b")).alias("last_part"), S.severity_colour(severity).alias("colour"), S.score_colour(F.col("p_size")).alias("score_colour"),
        S.escalation_prefix(F.element_at(levels, (F.col("p_size") % 5 + 1).cast("int"))).alias("prefix"), S.diagnostic_level(severity).alias("level"), S.display_date(F.when(F.col("p_size") % 4 > 0, F.timestamp_add("DAY", F.col("p_size").cast("int"), F.lit("2025-03-04 05:06:00").cast("timestamp")))).alias("shown_date"),
    )
