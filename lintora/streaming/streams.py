"""The same computations on streams.

Event time with a watermark is an extension: the batch forms know no lateness.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent import futures

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lintora.functions import scalars as S
from lintora.operators import learning, scan
from lintora.settings import Settings
from lintora.streaming import stateful

DEBOUNCE = "400 milliseconds"


def only_files(changes: DataFrame) -> DataFrame:
    return changes.filter("scheme = 'file'")


def read_changes(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    """A stream of the JSON files that come into a folder, some in each batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


def _gap_ms(gap: str) -> int:
    number, unit = gap.split()
    return int(number) * {"millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000}[unit.rstrip("s")]


def debounced(changes: DataFrame, gap: str = DEBOUNCE, watermark: str = "10 seconds", with_closings: bool = False) -> DataFrame:
    """Changes (document, ts, kind, text), kind change or save, to document, kind,
    text, n_changes, changed_at, fires_at: one row for each burst, with its last
    text. A burst ends a gap after its last change, or at once with a save, which
    takes the place of the changes before it. Other kinds, such as close, cancel
    nothing; closings() has them, and with_closings passes them on, as bursts of
    their own at their time that leave pending ones alone. As a stream the burst
    is state of its document."""
    kinds = ["change", "save"] + ["close"] * with_closings
    changes = changes.filter(F.col("kind").isin(kinds)).select("document", "ts", "kind", "text")
    if changes.isStreaming:
        timed = changes.withWatermark("ts", watermark).groupBy("document")
        return timed.transformWithStateInPandas(statefulProcessor=stateful.Bursts(_gap_ms(gap)), outputStructType=stateful.BURST, outputMode="Append", timeMode="eventTime")
    closed = changes.filter("kind = 'close'").select("document", "kind", F.lit(None).cast("string").alias("text"), F.lit(1).cast("long").alias("n_changes"), F.col("ts").alias("changed_at"), F.col("ts").alias("fires_at"))
    changes = changes.filter("kind <> 'close'")
    order = Window.partitionBy("document").orderBy("ts", "kind")
    ms, last = F.unix_millis(F.col("ts").cast("timestamp")), F.lag("kind").over(order)
    opens = last.isNull() | (last == "save") | (ms - F.lag(ms).over(order) >= _gap_ms(gap))
    rows = changes.withColumn("burst", F.sum(opens.cast("int")).over(order))
    ended = rows.groupBy("document", "burst").agg(F.max_by(F.struct("kind", "text", "ts"), F.struct("ts", "kind")).alias("x"), F.count("*").alias("n_changes"))
    fires = F.when(F.col("x.kind") == "save", F.col("x.ts")).otherwise(F.col("x.ts") + F.expr(f"interval {gap}"))
    bursts = ended.select("document", "x.kind", "x.text", "n_changes", F.col("x.ts").alias("changed_at"), fires.alias("fires_at"))
    return bursts.unionByName(closed) if with_closings else bursts


def closings(changes: DataFrame) -> DataFrame:
    """Tombstones of closed documents: their findings are shown no more. See
    sinks.latest, which drops keys whose last row is one."""
    return changes.filter("kind = 'close'").select("document", "ts", F.lit(True).alias("deleted"))


def without_repeats(records: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Each finding of a session once."""
    if not records.isStreaming:
        return records.dropDuplicates(["session_id", "finding_id"])
    return records.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["session_id", "finding_id"])


def profiles(events: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Learning profiles as state by developer: see stateful.Profiles. Within a
    batch the events are put in order; across batches they must arrive in order.
    stored: profiles (learning.profile) that a new checkpoint goes on from."""
    rows = events.select(*learning.BY_RULE, "kind", "ts", "seq", "snippet_hash").groupBy("developer_id")
    before = stored.groupBy("developer_id") if stored is not None else None
    return rows.transformWithStateInPandas(statefulProcessor=stateful.Profiles(), outputStructType=stateful.PROFILE, outputMode="Update", timeMode="None", initialState=before)


def adjusted_confidence(events: DataFrame) -> DataFrame:
    """The learned confidence of the rules that a batch touched."""
    return profiles(events.withColumn("snippet_hash", F.lit(""))).filter("n_actions > 0").select(*learning.BY_RULE, "adjusted_confidence", "n_actions")


def session_state(log: DataFrame, keep: str = "168 hours") -> DataFrame:
    """Sessions as state by developer, from a log (developer_id, session_id, op,
    finding_id, ts, seq): see stateful.Sessions. Ended sessions are held for
    `keep`. The batch forms are sessions.from_log and sessions.findings_of_log."""
    rows = log.filter("session_id is not null").select("developer_id", "session_id", "op", "finding_id", "ts", "seq").groupBy("developer_id")
    return rows.transformWithStateInPandas(statefulProcessor=stateful.Sessions(_gap_ms(keep)), outputStructType=stateful.SESSION, outputMode="Update", timeMode="None")


def live_findings(analyses: DataFrame, mode: str = "Update") -> DataFrame:
    """The findings that documents have now, as state by document, from rows
    (document, ts, seq, kind analysis or close, findings): see
    stateful.LiveFindings. sinks.latest of what it gives, by document and (at,
    seq), is what is shown."""
    rows = analyses.select("document", "ts", "seq", "kind", "findings").groupBy("document")
    return rows.transformWithStateInPandas(statefulProcessor=stateful.LiveFindings(), outputStructType=stateful.SNAPSHOT, outputMode=mode, timeMode="None")


def read_live_findings(spark: SparkSession, checkpoint: str, operator: int = 0) -> DataFrame:
    """document and findings as they are in the state of a stopped or running
    query, without its output."""
    state = spark.read.format("statestore").option("path", checkpoint).option("operatorId", operator).option("stateVarName", "findings").option("flattenCollectionTypes", True).load()
    return state.select(F.col("key.document").alias("document"), "list_element.*")


_FOUND = f"array<struct<{stateful.FINDING.replace(' ', ':').replace(',:', ',')}>>"


def analyses(texts: DataFrame, rules: Sequence[scan.Rule] = scan.RULES) -> DataFrame:
    """Texts and closings (document, ts, seq, kind, language_id, text) as rows for
    live_findings(): the scan of each text in its own row, with all its findings,
    also where there are none."""
    found = scan.scan_rows(texts, [c.split()[0] for c in stateful.FINDING.split(", ")], rules)
    kind = F.when(F.col("kind") == "close", "close").otherwise("analysis").alias("kind")
    return found.select("document", "ts", "seq", kind, F.when(F.col("kind") != "close", F.col("findings")).cast(_FOUND).alias("findings"))


def live_scan(changes: DataFrame, language_by_extension: dict[str, str], gap: str = DEBOUNCE, watermark: str = "10 seconds", settings: Settings | None = None) -> DataFrame:
    """Changes (document, ts, kind, text) of files to what is shown of them, as a
    stream in append mode: bursts, the scan of their last texts, and the
    replacement of a document's findings, one query with one checkpoint. A close
    drops them. settings: whether there are findings at all, the gap, and the
    least confidence."""
    language = F.lit("plaintext")
    for end, name in language_by_extension.items():
        language = F.when(S.extension(F.col("document")) == end, name).otherwise(language)
    settings = settings or Settings(debounce_ms=_gap_ms(gap))
    bursts = debounced(changes.filter("scheme = 'file'") if "scheme" in changes.columns else changes, settings.debounce, watermark, with_closings=True)
    texts = bursts.select("document", F.col("fires_at").alias("ts"), F.lit(0).cast("long").alias("seq"), "kind", language.alias("language_id"), "text")
    sure = F.filter("findings", lambda x: x["confidence"] >= settings.min_confidence)
    found = analyses(texts).withColumn("findings", sure if settings.enabled else F.lit(None).cast(_FOUND))
    return live_findings(found, "Append")


def response_times(detections: DataFrame, actions: DataFrame, within: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """Milliseconds from a detection to the actions with its event id that follow
    within a time: an interval join, whose state ends with the watermark.
    detections: event_id, ts; actions: event_id, action, ts."""
    first = detections.select(F.col("event_id").alias("detected_id"), F.col("ts").alias("detected_at")).withWatermark("detected_at", watermark)
    then = actions.select("event_id", "action", "ts").withWatermark("ts", watermark)
    met = (F.col("event_id") == F.col("detected_id")) & (F.col("ts") >= F.col("detected_at")) & (F.col("ts") <= F.col("detected_at") + F.expr(f"interval {within}"))
    return then.join(first, met).select("event_id", "action", (F.unix_millis("ts") - F.unix_millis("detected_at")).alias("response_ms"))


def deliver(batch: DataFrame, write: Callable[[DataFrame], None], dead_letters: Callable[[DataFrame], None], attempts: int = 4, wait: float = 5.0) -> bool:
    """Writes a whole batch, trying again a few times; what still fails goes to
    the dead letters, nothing is lost. `write` must accept repeats and limits its
    own time: the next attempt begins when the last has ended. For sinks that
    take single events see deliveries()."""
    for attempt in range(attempts):
        try:
            write(batch)
            return True
        except Exception as error:  # noqa: BLE001  any failure of the sink counts
            last = f"{type(error).__name__}: {error}"
            if attempt + 1 < attempts:
                time.sleep(wait)
    dead_letters(batch.withColumns({"error": F.lit(last[:500]), "attempts": F.lit(attempts)}))
    return False


def event_sink(events: DataFrame, write, dead_letters, checkpoint: str, interval: str = "1 second", attempts: int = 4, wait: float = 5.0) -> DataStreamWriter:
    """A writer that collects events for an interval and delivers each batch."""
    return events.writeStream.trigger(processingTime=interval).option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: deliver(batch, write, dead_letters, attempts, wait))


def deliveries(events: DataFrame, post: Callable[[dict], None], attempts: int = 4, wait: str = "5 seconds") -> DataFrame:
    """Sends events (event_id and more columns) one by one, from the executors,
    and gives what became of them: event_id, status, attempts, error.

    An event that fails is held as state and sent again by a later batch, a wait
    after its last attempt; new events and those of other keys don't wait for it.
    After `attempts` it is given out as dead, with its payload. The state is in
    the checkpoint: a restart loses nothing, and repeats only what the batch that
    was cut short had sent. `post` raises where it fails and limits its own time;
    it must accept repeats. The stream runs until it is stopped."""
    payload = F.to_json(F.struct(*[F.col(f"`{c}`") for c in events.columns]))
    rows = events.select(F.col("event_id").cast("string").alias("event_id"), payload.alias("payload")).groupBy("event_id")
    processor = stateful.Deliveries(post, attempts, _gap_ms(wait))
    return rows.transformWithStateInPandas(statefulProcessor=processor, outputStructType=stateful.DELIVERY, outputMode="Update", timeMode="ProcessingTime")


def _settled(client: Callable[[dict], str | None], rows: list[dict], limit: float | None, calls: int) -> list[tuple[str | None, str | None]]:
    """(answer, error) of each row, no more than `calls` at a time. Each has its
    own limit, from when it is called; one that is late is left to end by itself."""
    out = []
    for at in range(0, len(rows), calls):
        pool = futures.ThreadPoolExecutor(calls)
        asked = [pool.submit(client, row) for row in rows[at : at + calls]]
        futures.wait(asked, limit)
        for x in asked:
            if not x.done():
                out.append((None, f"TimeoutError: more than {limit} s"))
            elif error := x.exception():
                out.append((None, f"{type(error).__name__}: {error}"[:500]))
            else:
                out.append((x.result(), None))
        pool.shutdown(wait=False)
    return out


def enriched(findings: DataFrame, client: Callable[[dict], str | None], wanted: str | None = None, limit: float | None = 4.0, calls: int = 8) -> DataFrame:
    """Findings with the answer of a client that is called for each row in the
    executors, some rows at a time: explanation, and enrichment_error. A call that
    fails, or takes longer than `limit` seconds, leaves its own row without an
    answer and no other. wanted: a boolean column; the client sees no others."""

    def ask(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            asked = frame[frame[wanted].fillna(False).astype(bool)] if wanted else frame
            found = pd.DataFrame(_settled(client, asked.to_dict("records"), limit, calls), index=asked.index, columns=["explanation", "enrichment_error"], dtype="object")
            yield frame.join(found.reindex(frame.index))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in findings.schema.fields)
    return findings.mapInPandas(ask, f"{schema}, explanation string, enrichment_error string")
