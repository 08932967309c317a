"""State as an append-only log of commands, folded to the latest by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fold(commands: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows (key, seq, op, fields...) with op create, update or delete. Of each
    field the last value that is not null since the last create; deleted keys
    and keys that were never created are gone. Deleting cascades nowhere."""
    after = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lives = commands.withColumn("life", F.max(F.when(F.col("op").isin("create", "delete"), F.col("seq"))).over(after))
    last = lives.groupBy(key).agg(F.max("life").alias("life"))
    now = lives.join(last, [key, "life"]).groupBy(key).agg(F.min_by("op", "seq").alias("first_op"), *[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f) for f in fields])
    return now.filter("first_op = 'create'").drop("first_op")


def valid(commands: DataFrame, required: list[str], min_lengths: dict[str, int] | None = None) -> DataFrame:
    """Commands whose required fields are filled, blanks not counting."""
    good = F.lit(True)
    for field in required:
        good = good & (F.length(F.trim(F.coalesce(F.col(field).cast("string"), F.lit("")))) > 0)
    for field, least in (min_lengths or {}).items():
        good = good & (F.length(field) >= least)
    return commands.filter(good)


def with_parent(children: DataFrame, parents: DataFrame, key: str, name: str) -> DataFrame:
    """Children whose parent exists, with the parent's name put in."""
    return children.join(parents.select(key, F.col("name").alias(name)), key)


def add_to_open_session(found: DataFrame, sessions: DataFrame, held: DataFrame) -> DataFrame:
    """Findings that may be added: the session is open and does not hold the id."""
    open_ = sessions.filter("ended_at is null").select("session_id")
    return found.join(open_, "session_id", "left_semi").join(held.select("session_id", "finding_id"), ["session_id", "finding_id"], "left_anti").dropDuplicates(["session_id", "finding_id"])
