"""Sinks: appended records, replaced tables, latest state by key."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Up to so many developers in an append only their partitions of the history are read.
MAX_PARTITIONS = 1000


def history_of(records: DataFrame, path: str, max_partitions: int = MAX_PARTITIONS) -> DataFrame | None:
    """developer_id, session_id and finding_id of the stored records that the new
    ones may repeat: those of their developers' partitions, which the scan prunes
    by name, and of the range of their sessions, which prunes row groups. Records
    of more developers than the bound are held against all partitions. None where
    nothing is stored."""
    try:
        held = records.sparkSession.read.parquet(path).select("developer_id", "session_id", "finding_id")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    developers = [r[0] for r in records.select("developer_id").distinct().limit(max_partitions + 1).collect()]
    if len(developers) <= max_partitions:
        held = held.filter(F.col("developer_id").isin([d for d in developers if d is not None]) | (F.col("developer_id").isNull() if None in developers else F.lit(False)))
    least, most = records.agg(F.min("session_id"), F.max("session_id")).first()
    return held.filter(F.col("session_id").between(least, most) | F.col("session_id").isNull()) if least is not None else held


def append_records(records: DataFrame, path: str, max_partitions: int = MAX_PARTITIONS) -> None:
    """Records appended by developer, each finding of a developer's session once:
    repeats in these records, and those that an earlier call has appended, are
    left out. One writer at a time."""
    keys = ["developer_id", "session_id", "finding_id"]
    new, held = records.dropDuplicates(keys), history_of(records, path, max_partitions)
    if held is not None:
        kind = new.schema["developer_id"].dataType  # partition values come back as what they look like
        new = new.join(held.withColumn("developer_id", F.col("developer_id").cast(kind)), keys, "left_anti")
    new.write.mode("append").partitionBy("developer_id").parquet(path)


def write_json(rows: DataFrame, path: str) -> None:
    """A table of JSON lines in place of what was there."""
    rows.write.mode("overwrite").json(path)


def replace_table(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def latest(rows: DataFrame, key: str, at: str, deleted: str | None = None) -> DataFrame:
    """The last snapshot of each key, all its rows; keys whose last row is a
    tombstone are gone."""
    last = rows.withColumn("_nth", F.rank().over(Window.partitionBy(key).orderBy(F.desc(at)))).filter("_nth = 1").drop("_nth")
    return last.filter(~F.col(deleted)).drop(deleted) if deleted else last


def cleared(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows without those of some keys."""
    return rows.join(keys.select(key), key, "left_anti")
