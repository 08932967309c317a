"""Work sessions: summaries, scores, recommendations, completion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintora.functions import scalars as S
from lintora.sources.tables import VULNERABILITY_TYPES


def severity_counts(prefix: str = "n_") -> list[Column]:
    return [F.count_if(F.col("severity") == s).alias(f"{prefix}{s.lower()}") for s in S.SEVERITIES[:4]]


def _counter(kind: str) -> str:
    return f"t_{kind.lower()}"


def summaries(sessions: DataFrame, findings: DataFrame, now: Column, with_files: bool = True) -> DataFrame:
    """One row for each session, empty ones too: counts, by_type (a map), files
    in the order first seen, minutes, score, trend. Unknown severities count as
    info.

    The counts are one aggregation by session; the files are a narrow one of
    their own, by session and file and then by session, which with_files=False
    leaves out. Each is partial before it is shuffled, so that a session of very
    many findings is in no single task."""
    types = [F.count_if(F.col("vuln_type") == t).alias(_counter(t)) for t in VULNERABILITY_TYPES]
    counts = findings.groupBy("session_id").agg(F.count("*").alias("total"), *severity_counts(), *types)
    numbers = [c for c in counts.columns if c != "session_id"]
    rows = sessions.join(counts, "session_id", "left").fillna(0, numbers)
    none = F.array().cast("array<string>")
    if with_files:
        seen = findings.groupBy("session_id", S.basename(F.col("file_name")).alias("file")).agg(F.min(F.struct("position", "part", "supplier")).alias("at"))
        rows = rows.join(seen.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("at", "file"))).alias("f")), "session_id", "left")
        none = F.coalesce(F.transform("f", lambda x: x["file"]), none)
    score = S.shift_score(*[F.col(f"n_{s.lower()}") for s in S.SEVERITIES[:4]])
    by_type = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(t).alias("type"), F.col(_counter(t)).alias("n")) for t in VULNERABILITY_TYPES]), lambda x: x["n"] > 0))
    return rows.select(
        "session_id", "developer_id", "shift_id", "started_at", "ended_at", *numbers,
        (F.col("total") - F.col("n_critical") - F.col("n_high") - F.col("n_medium") - F.col("n_low")).alias("n_info"), by_type.alias("by_type"),
        none.alias("files"),
        S.minutes_between(F.col("started_at"), F.col("ended_at"), now).alias("minutes"),
        score.alias("score"), S.trend(score).alias("trend"),
    )


ADVICE = (
    ("sql", "Use bound parameters in all database calls."),
    ("xss", "Set text instead of HTML, or sanitize it first."),
    ("secret", "Keep secrets in the environment or in a vault."),
    ("command", "Run programs with argument lists, without a shell."),
    ("dense", "Many findings: plan a review of this code."),
    ("clean", "No findings in this session. Well done."),
    ("other", "Keep going over the common weakness lists."),
)


def recommendations(summary: DataFrame) -> DataFrame:
    """Advice by rule, with a fallback if none applies."""
    advice = dict(ADVICE)
    tests = {"sql": F.col("t_sql_injection") >= 2, "xss": F.col("t_xss") >= 1, "secret": F.col("t_hardcoded_secret") >= 1, "command": F.col("t_command_injection") >= 1, "dense": F.col("total") > 15, "clean": (F.col("minutes") > 0) & (F.col("total") == 0)}
    found = F.filter(F.array(*[F.when(test, advice[k]) for k, test in tests.items()]), lambda x: x.isNotNull())
    return summary.withColumn("recommendations", F.when(F.size(found) == 0, F.array(F.lit(advice["other"]))).otherwise(found))


def implicit_ends(sessions: DataFrame) -> DataFrame:
    """A developer's open session ends when the next one starts."""
    by = Window.partitionBy("developer_id").orderBy("started_at", "session_id")
    return sessions.withColumn("effective_end", F.coalesce("ended_at", F.lead("started_at").over(by)))


def completion(shifts: DataFrame, sessions: DataFrame, distinct_developers: bool = False) -> DataFrame:
    """Shifts with as many ended sessions as assigned developers, and one at
    least. It counts sessions; distinct_developers counts developers instead."""
    ended = F.count_distinct(F.when(F.col("ended_at").isNotNull(), F.col("developer_id"))) if distinct_developers else F.count("ended_at")
    counts = sessions.groupBy("shift_id").agg(ended.alias("ended"))
    rows = shifts.join(counts, "shift_id", "left").withColumn("ended", F.coalesce("ended", F.lit(0).cast("long")))
    return rows.select("shift_id", "ended", F.size("assigned").cast("long").alias("n_assigned"), ((F.col("ended") >= F.size("assigned")) & (F.col("ended") > 0)).alias("completed"))


def active_session(sessions: DataFrame) -> DataFrame:
    """The first open session of each developer."""
    first = Window.partitionBy("developer_id").orderBy("started_at", "session_id")
    return sessions.filter("ended_at is null").withColumn("nth", F.row_number().over(first)).filter("nth = 1").drop("nth")


def shift_action(shifts: DataFrame, active: DataFrame) -> DataFrame:
    """What each developer may do with each assigned shift: end, start, done or wait."""
    assigned = shifts.select("shift_id", "name", "status", F.explode("assigned").alias("developer_id"))
    joined = assigned.join(active.select("developer_id", F.col("shift_id").alias("open_shift"), "session_id"), "developer_id", "left")
    state = F.when(F.col("open_shift") == F.col("shift_id"), "can_end").when((F.col("status") != "completed") & F.col("session_id").isNull(), "can_start").when(F.col("status") == "completed", "done").otherwise("waiting")
    return joined.select("developer_id", "shift_id", "name", state.alias("state"))


def _lives(log: DataFrame) -> DataFrame:
    """Of each session of a log its first start, with its place (at, seq), its
    last end, and where it closed: at its first end or when its developer started
    the next one. Only ends after the start count; sessions that never began are
    nothing."""
    place = F.struct("at", "seq")
    start = F.min(F.when(F.col("op") == "start", F.struct("at", "seq", "developer_id", "shift_id"))).over(Window.partitionBy("session_id"))
    rows = log.withColumns({"start": start, "place": place}).filter("start is not null")
    end = F.when((F.col("op") == "end") & (F.col("place") > F.struct("start.at", "start.seq")), F.col("place"))
    lives = rows.groupBy("session_id").agg(F.min("start").alias("start"), F.max(end).alias("last_end"), F.min(end).alias("first_end"))
    lives = lives.select("session_id", "start.developer_id", "start.shift_id", F.struct("start.at", "start.seq").alias("start"), "last_end", "first_end")
    following = F.lead("start").over(Window.partitionBy("developer_id").orderBy("start"))
    return lives.withColumn("next_start", following).withColumn("closed", F.least("first_end", "next_start"))


def from_log(log: DataFrame) -> DataFrame:
    """Sessions from a log (session_id, developer_id, shift_id, op, at, seq) of
    starts and ends. The last end counts; a session without one ends when its
    developer starts the next. An end without a start before it is nothing."""
    ended, following = F.col("last_end.at"), F.col("next_start.at")
    return _lives(log).select("session_id", "developer_id", "shift_id", F.col("start.at").alias("started_at"), ended.alias("ended_at"), F.coalesce(ended, following).alias("effective_end"))


def findings_of_log(log: DataFrame) -> DataFrame:
    """session_id, finding_id, at: the findings that the log (as for from_log,
    with op finding and finding_id) adds to sessions. A finding is added once, to
    the session that it names and only while that is open: not before its start,
    after its first end, or after its developer's next start."""
    lives = _lives(log.filter("op in ('start', 'end')")).select("session_id", "start", "closed")
    found = log.filter("op = 'finding' and finding_id is not null").select("session_id", "finding_id", F.struct("at", "seq").alias("place"))
    live = found.join(lives, "session_id").filter((F.col("place") > F.col("start")) & (F.col("closed").isNull() | (F.col("place") < F.col("closed"))))
    return live.groupBy("session_id", "finding_id").agg(F.min("place.at").alias("at"))


def shift_states(shifts: DataFrame, sessions: DataFrame) -> DataFrame:
    """Shifts with their status: a started session makes a shift active, as many
    ended ones as it has developers make it completed."""
    started = sessions.groupBy("shift_id").agg(F.count("*").alias("started"))
    done = completion(shifts, sessions).select("shift_id", "completed")
    rows = shifts.join(started, "shift_id", "left").join(done, "shift_id", "left")
    return rows.select("shift_id", "name", F.when(F.col("completed"), "completed").when(F.col("started") > 0, "active").otherwise(F.col("status")).alias("status"))


def completed_reports(summary: DataFrame) -> DataFrame:
    """Summaries of ended sessions, also of those without findings."""
    return summary.filter("ended_at is not null")


def shifts_of(shifts: DataFrame, project_id=None) -> DataFrame:
    """Shifts of a project; of all if it is null or empty."""
    return shifts if project_id in (None, "") else shifts.filter(F.col("project_id") == project_id)


def of_shifts(sessions: DataFrame, shifts: DataFrame, project_id: Column | None = None) -> DataFrame:
    """Sessions of the shifts, of one project's if it is given."""
    if project_id is not None:
        shifts = shifts.filter(F.col("project_id") == project_id)
    return sessions.join(shifts.select("shift_id", "project_id"), "shift_id")
