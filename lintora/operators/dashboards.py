"""The tables behind the dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintora.functions import scalars as S
from lintora.operators.sessions import severity_counts


def summary(findings: DataFrame) -> DataFrame:
    """Counts of a finding set; INFO counts in the total only."""
    return findings.agg(F.count("*").alias("total"), *severity_counts())


def by_type(findings: DataFrame) -> DataFrame:
    return findings.groupBy("vuln_type").agg(F.count("*").alias("n"))


def type_map(findings: DataFrame) -> DataFrame:
    """The same as one map."""
    return by_type(findings).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("vuln_type", "n")))).alias("by_type"))


def type_breakdown(findings: DataFrame) -> DataFrame:
    """Types by falling count with whole percents; ties in the order first seen.
    One row for each type, so the unpartitioned window is small."""
    counts = findings.groupBy("vuln_type").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))
    total = F.sum("n").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "first_seq"))
    return counts.select("vuln_type", "n", S.js_round(F.col("n") / total * 100).alias("pct"), rank.alias("position"))


def developer_stats(findings: DataFrame) -> DataFrame:
    """By developer; everything below MEDIUM counts as low, INFO too."""
    n = lambda s: F.count_if(F.col("severity") == s)
    rows = findings.groupBy("developer_id").agg(F.count("*").alias("total"), n("CRITICAL").alias("n_critical"), n("HIGH").alias("n_high"), n("MEDIUM").alias("n_medium"), F.count_if(~F.col("severity").isin("CRITICAL", "HIGH", "MEDIUM")).alias("n_low"))
    return rows.withColumn("score", S.dashboard_score(*[F.col(c) for c in ("n_critical", "n_high", "n_medium", "n_low")]))


def team_totals(stats: DataFrame) -> DataFrame:
    return stats.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.coalesce(F.sum("n_critical"), F.lit(0)).alias("n_critical"), F.coalesce(S.js_round(F.avg("score")), F.lit(100).cast("long")).alias("avg_score"), F.count("*").alias("n_developers"))


def roster(users: DataFrame, stats: DataFrame, role: str | None = "developer") -> DataFrame:
    """Users with their statistics; without any: score 100, total 0."""
    if role:
        users = users.filter(F.col("role") == role)
    joined = users.join(stats.withColumnRenamed("developer_id", "user_id"), "user_id", "left")
    score = F.coalesce("score", F.lit(100).cast("long"))
    return joined.select("user_id", "username", "role", S.initial(F.col("username")).alias("initial"), F.coalesce("total", F.lit(0).cast("long")).alias("total"), score.alias("score"), S.trend(score).alias("band"), (F.coalesce("total", F.lit(0)) > 50).alias("highlight"), F.when(F.coalesce("total", F.lit(0)) == 0, "\u2014").otherwise(F.col("total").cast("string")).alias("shown"))


def project_shift_counts(projects: DataFrame, shifts: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s}")
    counts = shifts.groupBy("project_id").agg(F.count("*").alias("n_shifts"), n("scheduled"), n("active"), n("completed"))
    return projects.select("project_id", "name").join(counts, "project_id", "left").fillna(0)


def shift_session_counts(shifts: DataFrame, sessions: DataFrame) -> DataFrame:
    counts = sessions.groupBy("shift_id").agg(F.count_if(F.col("ended_at").isNull()).alias("n_active"), F.count("ended_at").alias("n_completed"))
    return shifts.select("shift_id", "name").join(counts, "shift_id", "left").fillna(0, ["n_active", "n_completed"])


def status_counters(users: DataFrame, shifts: DataFrame, sessions: DataFrame) -> DataFrame:
    """Counts on top of the dashboards, as (name, n)."""
    named = lambda df, prefix, c: df.groupBy(F.concat(F.lit(prefix), c).alias("name")).agg(F.count("*").alias("n"))
    live = sessions.filter("ended_at is null").agg(F.lit("live sessions").alias("name"), F.count("*").alias("n"))
    return named(users, "users ", "role").unionByName(named(shifts, "shifts ", "status")).unionByName(live)


def latest_by_file(findings: DataFrame) -> DataFrame:
    """The findings of each file's last analysis (seq), as diagnostics show them:
    an analysis may have several, so all that share the last seq stay."""
    last = Window.partitionBy("file_name").orderBy(F.desc("seq"))
    return findings.withColumn("nth", F.rank().over(last)).filter("nth = 1").drop("nth")


def diagnostics(findings: DataFrame, source: str = "lintora") -> DataFrame:
    message = F.concat(F.lit("["), "type", F.lit("]\n"), "message", F.lit("\nSeverity: "), "severity", F.lit(" | Confidence: "), S.percent(F.col("confidence")).cast("string"), F.lit("%"))
    return findings.select("finding_key", "file_name", "range_start", "range_end", message.alias("text"), S.diagnostic_level(F.col("severity")).alias("level"), S.severity_icon(F.col("severity")).alias("icon"), F.lit(source).alias("source"), F.concat(F.lit("https://owasp.org/www-community/attacks/"), S.owasp_slug(F.col("type"))).alias("target"))


def at_line(findings: DataFrame, first: int, last: int) -> DataFrame:
    """Findings whose line lies in a range of lines: what code actions ask for."""
    return findings.filter(F.col("line_number").between(first, last))


def hover(findings: DataFrame, probes: DataFrame) -> DataFrame:
    """The first finding whose stretch holds the offset, for each probe
    (file_name, offset); probes on nothing have no row."""
    inside = (F.col("range_start") <= F.col("offset")) & (F.col("range_end") >= F.col("offset"))
    met = probes.join(findings, "file_name").filter(inside)
    first = F.min_by(F.struct(*[c for c in findings.columns if c != "file_name"]), F.struct("range_start", "rule_index", "pattern_index"))
    return met.groupBy("file_name", "offset").agg(first.alias("f")).select("file_name", "offset", "f.*")


def log_rows(findings: DataFrame) -> DataFrame:
    """Two lines for each finding: what and where, and the snippet, cut at 80."""
    what = F.concat(S.severity_icon(F.col("severity")), F.lit(" ["), "severity", F.lit("] "), "type", F.lit(", line "), F.col("line_number").cast("string"), F.lit(" ("), S.percent(F.col("confidence")).cast("string"), F.lit(" %)"))
    return findings.select("finding_key", "file_name", what.alias("line"), S.truncated(F.col("code_snippet"), 80, "...").alias("snippet"))


def log_heads(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """A line for each file with its number of findings, or that there are none."""
    counts = findings.groupBy("file_name").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    text = F.when(n == 0, F.concat(S.last_part(F.col("file_name")), F.lit(": no findings"))).otherwise(F.concat(S.last_part(F.col("file_name")), F.lit(": "), n.cast("string"), F.lit(" found")))
    return docs.select("file_name").distinct().join(counts, "file_name", "left").select("file_name", n.alias("n"), text.alias("line"))


def alert_rows(findings: DataFrame) -> DataFrame:
    """What is shown at once: findings of the two highest severities."""
    return log_rows(findings.filter(F.col("severity").isin("CRITICAL", "HIGH")))


def records(findings: DataFrame, developer_id: Column, github_username: Column, session_id: Column) -> DataFrame:
    """Findings as rows of the record files; the id is a hash of session and finding."""
    return findings.select(
        F.sha2(F.concat_ws("|", session_id, "finding_key"), 256).alias("record_id"), developer_id.alias("developer_id"), github_username.alias("github_username"), session_id.alias("session_id"), F.col("type").alias("vulnerability_type"),
        "severity", "confidence", "file_name", "line_number", "column_number", "code_snippet", F.col("rule_id").alias("detected_by_rule"), F.col("finding_key").alias("finding_id"),
    )


def session_rows(findings: DataFrame) -> DataFrame:
    """Findings as sessions hold them; a finding without a rule has an unknown one."""
    return findings.select(F.col("finding_key").alias("id"), "type", "severity", "confidence", "file_name", "line_number", "code_snippet", F.coalesce("rule_id", F.lit("unknown")).alias("rule_id"))


def administrators_left(users: DataFrame) -> DataFrame:
    """May a user go? Not the last administrator. One row is joined to all."""
    n = users.agg(F.count_if(F.col("role") == "administrator").alias("n_administrators"))
    return users.join(F.broadcast(n)).select("user_id", "username", "role", "n_administrators", ((F.col("role") != "administrator") | (F.col("n_administrators") > 1)).alias("may_go"))


def added_users(users: DataFrame, new: DataFrame) -> DataFrame:
    """New users whose name nobody has; of several with one name the smallest id."""
    first = new.groupBy("username").agg(F.min_by(F.struct(*[c for c in new.columns if c != "username"]), "user_id").alias("row"))
    return first.join(users.select("username"), "username", "left_anti").select("username", "row.*")


def matched_users(logins: DataFrame, users: DataFrame) -> DataFrame:
    """Logins matched by external name, else by user name, else provisioned."""
    by_label = users.select(F.col("github_username").alias("label"), F.col("user_id").alias("by_label")).filter("label is not null")
    by_name = users.select(F.col("username").alias("label"), F.col("user_id").alias("by_name"))
    found = logins.join(by_label, "label", "left").join(by_name, "label", "left")
    how = F.when(F.col("by_label").isNotNull(), "external").when(F.col("by_name").isNotNull(), "username").otherwise("provisioned")
    return found.select("label", F.coalesce("by_label", "by_name").alias("user_id"), how.alias("matched_by"))


def response_times(events: DataFrame) -> DataFrame:
    """Milliseconds from a detection to the actions with the same event id."""
    detected = events.filter("action = 'DETECTED'").groupBy("event_id").agg(F.min("ts").alias("detected_at"))
    acted = events.filter("action <> 'DETECTED'").select("event_id", "action", "ts")
    return acted.join(detected, "event_id").select("event_id", "action", (F.unix_millis(F.col("ts").cast("timestamp")) - F.unix_millis(F.col("detected_at").cast("timestamp"))).alias("response_ms"))


def enrich_top(findings: DataFrame, answers: dict[str, Column], partition: list[str], order: list, n: int = 3) -> DataFrame:
    """The answers, columns of a finding and its position, for the first n
    findings of each group alone; the others have nulls."""
    ranked = findings.withColumn("position", F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))
    return ranked.select("*", *[F.when(F.col("position") <= n, answer).alias(name) for name, answer in answers.items()])


def enrichment(enriched: DataFrame, by: str = "file_name") -> DataFrame:
    """How many findings of each group have an explanation, and the notice of
    the first one with an escalation."""
    notice = F.concat(S.escalation_prefix(F.col("escalation")), "explanation")
    first = F.min_by(notice, F.when(F.col("escalation").isNotNull(), F.col("position")))
    return enriched.groupBy(by).agg(F.count("explanation").alias("n_enriched"), first.alias("notice"))
