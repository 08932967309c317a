import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lintora.functions import scalars as S
from lintora.operators import learning, scan, sessions
from lintora.sources import sinks
from lintora.sources import tables as T
from lintora.streaming import stateful, streams

SF = "/root/testdata/sf0.001"


def drain(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return q


@pytest.fixture(autouse=True)
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.ROCKSDB)
    spark.conf.set("spark.sql.streaming.forceDeleteTempCheckpointLocation", "true")


def fed(spark, tmp_path, parts, build):
    """What a query writes when its input comes in several batches."""
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = build(spark.readStream.schema(part.schema).parquet(f"{tmp_path}/in"))
        q = stream.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).foreachBatch(lambda b, _: b.write.mode("append").parquet(f"{tmp_path}/out")).start()
        assert q.awaitTermination(60) and q.exception() is None
    return spark.read.parquet(f"{tmp_path}/out")


def test_streamed_profiles_equal_batch(spark, tmp_path):
    events = T.findings(spark, SF).select("developer_id", "vuln_type", "rule_id", "kind", "ts", "seq", "code_snippet").filter("developer_id < 40")
    events = events.withColumn("snippet_hash", S.snippet_hash(F.col("code_snippet"))).drop("code_snippet")
    events = events.withColumn("seq", F.row_number().over(Window.orderBy("ts", "seq")).cast("long")).cache()
    n = events.count()
    got = fed(spark, tmp_path, [events.filter(F.col("seq") <= n // 2), events.filter(F.col("seq") > n // 2)], streams.profiles)
    last = {}
    for r in got.collect():
        key = r.developer_id, r.vuln_type, r.rule_id
        if key not in last or r.detections + r.fixes + r.ignored + r.false_positives > sum(last[key][:4]):
            last[key] = (r.detections, r.fixes, r.ignored, r.false_positives, r.adjusted_confidence, r.n_actions)
    assert {k[:2]: v[:4] for k, v in last.items()} == {(r.developer_id, r.vuln_type): (r.detections, r.fixes, r.ignored, r.false_positives) for r in learning.counters(events).collect()}
    assert {k: v[4:] for k, v in last.items() if v[5]} == {tuple(r[:3]): (r.adjusted_confidence, r.n_actions) for r in learning.adjusted_confidence(events).collect()}
    off = {(r.developer_id, r.vuln_type) for r in got.filter("suppressed").collect()}
    assert off == {(r.developer_id, r.vuln_type) for r in learning.suppressed(events).collect()}
    held = {r.developer_id: max((x.hashes for x in got.filter(F.col("developer_id") == r.developer_id).collect()), key=len) for r in got.select("developer_id").distinct().collect()}
    assert {d: h for d, h in held.items() if h} == {r.developer_id: r.hashes for r in learning.false_positive_hashes(events).collect()}


def test_profiles_go_on_from_stored_ones(spark, tmp_path):
    events = T.findings(spark, SF).select("developer_id", "vuln_type", "rule_id", "kind", "ts", "seq", "code_snippet").filter("developer_id < 25")
    events = events.withColumn("snippet_hash", S.snippet_hash(F.col("code_snippet"))).drop("code_snippet")
    events = events.withColumn("seq", F.row_number().over(Window.orderBy("ts", "seq")).cast("long")).cache()
    first, then = events.filter("seq <= 300"), events.filter("seq > 300")
    learning.profile(first).write.parquet(f"{tmp_path}/stored")
    stored = spark.read.parquet(f"{tmp_path}/stored")
    plain = lambda df: sorted(map(str, df.select("developer_id", "part", "vuln_type", "rule_id", "counts", "first_seen", "last_seen", "adjusted_confidence", "n_actions", "hashes").collect()))
    assert plain(learning.profile(then, stored)) == plain(learning.profile(events))
    assert plain(learning.profile(then, learning.profile(first, window=2), window=2)) == plain(learning.profile(events, window=2))  # entries were evicted
    half = then.count() // 2
    got = fed(spark, tmp_path, [then.filter(F.col("seq") <= 300 + half), then.filter(F.col("seq") > 300 + half)], lambda e: streams.profiles(e, stored if not (tmp_path / "cp").exists() else None)).collect()
    want = {tuple(r[:3]): (r.adjusted_confidence, r.n_actions) for r in learning.adjusted_confidence(events).collect()}
    touched = {tuple(r) for r in then.select(*learning.BY_RULE).distinct().collect()}
    last = {}
    for r in got:
        key = tuple(r[:3])
        if key not in last or r.n_actions >= last[key][1]:
            last[key] = (r.adjusted_confidence, r.n_actions)
    assert set(last) == touched and {k: v for k, v in last.items() if v[1]} == {k: v for k, v in want.items() if k in touched}
    counts = {(r.developer_id, r.vuln_type): r.detections + r.fixes + r.ignored + r.false_positives for r in learning.counters(events).collect()}
    most = {}
    for r in got:
        key = r.developer_id, r.vuln_type
        most[key] = max(most.get(key, 0), r.detections + r.fixes + r.ignored + r.false_positives)
    assert most == {k: n for k, n in counts.items() if k in most}


LOG = "developer_id long, session_id long, op string, finding_id string, ts timestamp, seq long"


def minute(m):
    return dt.datetime(2025, 1, 1, 9) + dt.timedelta(minutes=m)


def ended_and_found(rows):
    """Last end and number of findings of each ended session, and all findings."""
    ends = {}
    for r in rows:
        if r.ended_at:
            ends[r.session_id] = max(ends.get(r.session_id, (r.started_at, r.ended_at, r.n_findings)), (r.started_at, r.ended_at, r.n_findings))
    return ends, {(r.session_id, r.finding_id) for r in rows if r.finding_id}


def test_sessions_as_state(spark, tmp_path):
    log = [
        (1, 10, "start", None, 0), (1, 10, "finding", "f", 1), (1, 10, "finding", "f", 2), (1, 10, "end", None, 3), (1, 10, "finding", "g", 4), (1, 11, "start", None, 5), (1, 10, "finding", "h", 6), (1, 11, "finding", "f", 6),
        (1, 12, "start", None, 7), (1, 11, "end", None, 8), (1, 11, "end", None, 9), (1, 12, "finding", "f", 9), (1, 99, "end", None, 9), (1, 99, "finding", "x", 9), (1, 10, "start", None, 10), (1, 12, "finding", "z", 11), (2, 20, "end", None, 0), (2, 20, "start", None, 1),
    ]
    rows = spark.createDataFrame([(d, s, op, f, minute(m), i) for i, (d, s, op, f, m) in enumerate(log)], LOG)
    got = fed(spark, tmp_path, [rows.filter("seq <= 6"), rows.filter("seq between 7 and 9"), rows.filter("seq > 9")], streams.session_state).collect()
    ends, found = ended_and_found(got)
    assert ends == {10: (minute(0), minute(3), 1), 11: (minute(5), minute(9), 1)}  # the second end counts, the repeated start of 10 does not
    assert found == {(10, "f"), (11, "f"), (12, "f"), (12, "z")}  # what comes late, or for another session than the open one, is in none


def test_session_state_equals_the_batch_forms(spark, tmp_path):
    import random

    rng, log, open_ = random.Random(4), [], {}
    for i in range(400):
        d = rng.randint(1, 4)
        op = rng.choices(("start", "finding", "end"), (2, 6, 2))[0]
        session = i if op == "start" else rng.choice([*open_.get(d, []), 100_000 + d])
        if op == "start":
            open_.setdefault(d, []).append(i)
        log.append((d, session, op, f"f{rng.randint(1, 4)}" if op == "finding" else None, minute(i), i))
    rows = spark.createDataFrame(log, LOG)
    ends, found = ended_and_found(fed(spark, tmp_path, [rows.filter(F.col("seq").between(a, a + 99)) for a in (0, 100, 200, 300)], streams.session_state).collect())
    batch = rows.withColumns({"at": F.col("ts"), "shift_id": F.lit(1)})
    listed = sessions.from_log(batch).filter("effective_end is not null").collect()
    assert {s: x[:2] for s, x in ends.items()} == {r.session_id: (r.started_at, r.effective_end) for r in listed}
    assert found == {(r.session_id, r.finding_id) for r in sessions.findings_of_log(batch).collect()}


SNAPSHOTS = f"document string, ts timestamp, seq long, kind string, findings array<struct<{stateful.FINDING.replace(' ', ':').replace(',:', ',')}>>"


def shown(rows):
    return sorted((r.document, r.finding_key, r.line_number) for r in rows if r.finding_key is not None)


def test_live_findings_equal_the_latest_of_every_prefix(spark, tmp_path):
    import random

    rng, log = random.Random(9), []
    for i in range(60):
        kind = "close" if rng.random() < 0.2 else "analysis"
        found = [(f"k{k}", "XSS", "HIGH", 0.9, k, "R") for k in rng.sample(range(6), rng.randint(0, 3))]
        log.append((f"d{rng.randint(1, 5)}", minute(i), i, kind, None if kind == "close" else found))
    rows = spark.createDataFrame(log, SNAPSHOTS)
    parts = [rows.filter(F.col("seq").between(a, a + 14)) for a in (0, 15, 30, 45)]
    for n in range(1, 5):
        out = fed(spark, tmp_path, [parts[n - 1]], streams.live_findings)
        last = sinks.latest(out.withColumn("place", F.struct("at", "seq")), "document", "place", "deleted")
        last_of, now = {}, []
        for r in log[: 15 * n]:
            last_of[r[0]] = r
        now = sorted((d, f[0], f[4]) for d, r in last_of.items() for f in r[4] or ())
        assert shown(last.collect()) == now
    late = spark.createDataFrame([("d1", minute(-5), 0, "analysis", [("old", "XSS", "HIGH", 0.9, 1, "R")])], SNAPSHOTS)
    fed(spark, tmp_path, [late], streams.live_findings)
    assert shown(streams.read_live_findings(spark, f"{tmp_path}/cp").collect()) == now  # from the state itself


def test_changes_to_live_findings_in_one_query(spark, tmp_path):
    """Bursts of changes, their scan, and the replacement of a document's rows."""
    bad, good = "el.innerHTML = userInput;", "el.textContent = userInput;"
    rows = [change("a.js", 0, "change", bad), change("a.js", 100, "change", bad + "\n" + bad), change("b.js", 0, "save", bad), change("c.js", 0, "save", bad)]
    more = [change("b.js", 20_000, "save", good), change("c.js", 20_000, "close", None), change("z.js", 40_000, "save", good)]
    for name, part in (("1", rows), ("2", more), ("3", [change("z.js", 80_000, "save", good)])):
        spark.createDataFrame(part, CHANGES).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        stream = streams.live_scan(streams.read_changes(spark, f"{tmp_path}/in", CHANGES), {"js": "javascript"}, watermark="1 second")
        q = stream.writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).foreachBatch(lambda b, _: b.write.mode("append").parquet(f"{tmp_path}/out")).start()
        assert q.awaitTermination(60) and q.exception() is None, name
    last = sinks.latest(spark.read.parquet(f"{tmp_path}/out").withColumn("place", F.struct("at", "seq")), "document", "place", "deleted").collect()
    assert sorted((r.document, r.type, r.line_number) for r in last) == [("a.js", "XSS", 1), ("a.js", "XSS", 2)]
    found = scan.scan(spark.createDataFrame([("a.js", "javascript", bad + "\n" + bad)], "file_name string, language_id string, text string")).collect()
    assert {(r.finding_key, r.confidence, r.rule_id) for r in last} == {(r.finding_key, r.confidence, r.rule_id) for r in found}


def change(document, ms, kind, text):
    return document, dt.datetime(2025, 1, 1) + dt.timedelta(milliseconds=ms), kind, text


CHANGES = "document string, ts timestamp, kind string, text string"


BURST_ROWS = [
    change("a", 0, "change", "1"), change("a", 300, "change", "2"), change("a", 600, "change", "3"), change("a", 1500, "change", "4"), change("a", 1900, "change", "5"),
    change("b", 100, "change", "6"), change("b", 150, "save", "7"), change("b", 160, "change", "8"), change("b", 200, "close", None), change("c", 0, "change", "9"), change("c", 500, "save", "10"), change("c", 510, "save", "11"),
]
BURSTS = [("a", "change", "3", 3, 1000), ("a", "change", "4", 1, 1900), ("a", "change", "5", 1, 2300), ("b", "change", "8", 1, 560), ("b", "save", "7", 2, 150), ("c", "change", "9", 1, 400), ("c", "save", "10", 1, 500), ("c", "save", "11", 1, 510)]


def fired(rows):
    return sorted((r.document, r.kind, r.text, r.n_changes, round((r.fires_at - dt.datetime(2025, 1, 1)).total_seconds() * 1000)) for r in rows)


def test_debounce_takes_the_last_change_and_a_save_the_place_of_pending_ones(spark):
    changes = spark.createDataFrame(BURST_ROWS, CHANGES)
    assert fired(streams.debounced(changes).collect()) == sorted(BURSTS)
    assert [(r.document, r.deleted) for r in streams.closings(changes).collect()] == [("b", True)]


def test_debounce_as_a_stream(spark, tmp_path):
    early = [r for r in BURST_ROWS if r[1] <= dt.datetime(2025, 1, 1, 0, 0, 0, 300_000)]
    late = [r for r in BURST_ROWS if r not in early] + [change("z", 60_000, "change", "end")]
    for name, rows in (("1", early), ("2", late), ("3", [change("z", 90_000, "save", "end")])):
        spark.createDataFrame(rows, CHANGES).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        stream = streams.debounced(streams.read_changes(spark, f"{tmp_path}/in", CHANGES), watermark="1 second")
        q = stream.writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).foreachBatch(lambda b, _: b.write.mode("append").parquet(f"{tmp_path}/out")).start()
        q.awaitTermination(120)
        assert q.exception() is None, name
    got = [r for r in spark.read.parquet(f"{tmp_path}/out").collect() if r.document != "z"]
    assert fired(got) == sorted(BURSTS)


def test_response_times_join_two_streams(spark, tmp_path):
    at = lambda m: dt.datetime(2025, 1, 1, 9, m)
    spark.createDataFrame([("e1", at(0)), ("e2", at(1))], "event_id string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/d")
    spark.createDataFrame([("e1", "FIXED", at(2)), ("e2", "IGNORED", at(0)), ("e3", "FIXED", at(5))], "event_id string, action string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/a")
    seen = [spark.readStream.schema(spark.read.parquet(f"{tmp_path}/{x}").schema).parquet(f"{tmp_path}/{x}") for x in "da"]
    drain(streams.response_times(*seen), "responses", "append")
    assert [tuple(r) for r in spark.table("responses").collect()] == [("e1", "FIXED", 120_000)]


def test_delivery_retries_and_keeps_dead_letters(spark):
    batch = spark.createDataFrame([(1,), (2,)], "event_id long")
    calls, dead = [], []

    def flaky(df):
        calls.append(df.count())
        if len(calls) < 3:
            raise OSError("down")

    assert streams.deliver(batch, flaky, dead.append, wait=0) and len(calls) == 3 and not dead

    def broken(df):
        calls.append(0)
        raise OSError("gone")

    calls.clear()
    assert not streams.deliver(batch, broken, dead.append, wait=0) and len(calls) == 4
    assert [(r.event_id, r.error, r.attempts) for r in dead[0].collect()] == [(1, "OSError: gone", 4), (2, "OSError: gone", 4)]


def test_events_that_fail_are_sent_again_by_later_batches(spark, tmp_path):
    """Others are delivered at once; attempts are four; a restart goes on."""
    import time
    from pathlib import Path

    calls = tmp_path / "calls"
    calls.mkdir()

    def post(event):
        n = event["n"]
        (calls / f"{event['event_id']}-{time.time_ns()}").write_text("")
        if n == 1 or n == 2 and len(list(calls.glob(f"{event['event_id']}-*"))) < 3:
            raise OSError("refused")

    def sent(*ids):
        return {i: len(list(calls.glob(f"{i}-*"))) for i in ids}

    schema = "event_id long, n int"

    def start():
        stream = streams.deliveries(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), post, wait="300 milliseconds")
        writer = stream.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="200 milliseconds")
        return writer.foreachBatch(lambda b, _: b.write.mode("append").parquet(f"{tmp_path}/out")).start()

    def until(done, q):
        for _ in range(300):
            assert q.exception() is None
            if Path(f"{tmp_path}/out").exists() and done(spark.read.schema(stateful.DELIVERY).parquet(f"{tmp_path}/out").collect()):
                q.stop()
                return
            time.sleep(0.2)
        q.stop()
        raise AssertionError("not done in time")

    spark.createDataFrame([(1, 0), (2, 1), (3, 2), (4, 0), (4, 0)], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    until(lambda rows: len(rows) >= 4, start())  # stopped after the first attempts
    first = {r.event_id: (r.status, r.attempts) for r in spark.read.parquet(f"{tmp_path}/out").collect() if r.attempts == 1}
    assert first == {"1": ("delivered", 1), "2": ("again", 1), "3": ("again", 1), "4": ("delivered", 1)}
    spark.createDataFrame([(5, 0)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    until(lambda rows: {r.event_id for r in rows if r.status in ("delivered", "dead")} == set("12345"), start())
    ended = {r.event_id: (r.status, r.attempts, r.error, r.payload) for r in spark.read.parquet(f"{tmp_path}/out").collect() if r.status != "again"}
    assert ended == {"1": ("delivered", 1, None, None), "2": ("dead", 4, "OSError: refused", '{"event_id":2,"n":1}'), "3": ("delivered", 3, None, None), "4": ("delivered", 1, None, None), "5": ("delivered", 1, None, None)}
    assert all(n >= least for n, least in zip(sent(1, 2, 3, 4, 5).values(), (1, 4, 3, 1, 1)))  # at least once


def test_enrichment_is_settled_row_by_row(spark):
    import time

    found = spark.createDataFrame([(f"k{i}", i != 5) for i in range(6)], "finding_key string, top boolean").coalesce(1)

    def client(row):
        if row["finding_key"] == "k1":
            raise ValueError("no answer")
        if row["finding_key"] == "k2":
            time.sleep(3)
        return f"about {row['finding_key']}" if row["finding_key"] != "k3" else None

    for calls in (1, 8):
        rows = {r.finding_key: (r.explanation, r.enrichment_error) for r in streams.enriched(found, client, wanted="top", limit=0.5, calls=calls).collect()}
        assert rows == {"k0": ("about k0", None), "k1": (None, "ValueError: no answer"), "k2": (None, "TimeoutError: more than 0.5 s"), "k3": (None, None), "k4": ("about k4", None), "k5": (None, None)}
    assert streams.enriched(found.filter("false"), client).collect() == []


def test_an_append_reads_the_partitions_of_its_developers_only(spark, tmp_path):
    path = f"{tmp_path}/history"
    old = spark.range(400).select((F.col("id") % 20).alias("developer_id"), (F.col("id") % 40).alias("session_id"), F.concat(F.lit("f"), (F.col("id") % 7).cast("string")).alias("finding_id"))
    sinks.append_records(old, path)
    new = spark.range(60).select((F.col("id") % 3).alias("developer_id"), (F.col("id") % 40).alias("session_id"), F.concat(F.lit("f"), (F.col("id") % 11).cast("string")).alias("finding_id"))
    held = sinks.history_of(new, path)
    read = {f.split("developer_id=")[1].split("/")[0] for f in held.inputFiles()}
    assert read >= {"0", "1", "2"} and "PartitionFilters: [developer_id" in held._jdf.queryExecution().toString()
    assert held.select("developer_id").distinct().count() == 3
    stored = spark.read.parquet(path)
    want = {tuple(r) for r in new.select("developer_id", "session_id", "finding_id").collect()} - {tuple(r) for r in stored.select("developer_id", "session_id", "finding_id").collect()}
    before = stored.count()
    sinks.append_records(new, path)
    rows = [tuple(r) for r in spark.read.parquet(path).select("developer_id", "session_id", "finding_id").collect()]
    assert len(rows) == len(set(rows)) == before + len(want) and want <= set(rows)
    sinks.append_records(new, path, max_partitions=1)  # more developers than the bound: held against all
    assert spark.read.parquet(path).count() == len(rows)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "s", "f1", 1, False), (1, "s", "f1", 1, False), (2, "s", "f2", 2, True)], "developer_id long, session_id string, finding_id string, at int, gone boolean")
    sinks.append_records(rows, f"{tmp_path}/r")
    more = spark.createDataFrame([(2, "s", "f2", 2, True), (2, "s", "f3", 2, True)], rows.schema)
    sinks.append_records(more, f"{tmp_path}/r")
    assert spark.read.parquet(f"{tmp_path}/r").groupBy("developer_id").count().orderBy("developer_id").collect() == [(1, 1), (2, 2)]
    sinks.write_json(rows, f"{tmp_path}/j")
    assert spark.read.schema(rows.schema).json(f"{tmp_path}/j").count() == 3
    sinks.replace_table(rows, f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 3
    assert {r.developer_id for r in sinks.latest(rows, "developer_id", "at", "gone").collect()} == {1}
    assert sinks.cleared(rows, rows.filter("developer_id = 1").distinct(), "developer_id").count() == 1
    assert streams.without_repeats(rows).count() == 2


def test_files_only(spark):
    assert streams.only_files(spark.createDataFrame([("file",), ("git",)], "scheme string")).count() == 1


@pytest.mark.parametrize("kind", sorted(T.SCHEMAS))
def test_missing_json_is_an_empty_table(spark, tmp_path, kind):
    assert T.read_json(spark, f"{tmp_path}/none.json", kind).count() == 0


def test_json_tables(spark, tmp_path):
    import json

    record = {"recordId": "r", "developerId": "D1", "confidence": 0.9, "lineNumber": 3, "findingId": "f", "unknown": 1}
    (tmp_path / "D1_vulnerability_records.json").write_text(json.dumps([record, record]))
    (tmp_path / "D2_vulnerability_records.json").write_text("{ broken")
    got = T.read_records(spark, f"{tmp_path}/*_vulnerability_records.json").collect()
    assert [(r.developer_id, r.lineNumber) for r in got] == [("D1", 3), ("D1", 3)]
    (tmp_path / "users.json").write_text(json.dumps([{"id": "1", "username": "u", "passwordHash": "x", "role": "developer"}]))
    assert "passwordHash" not in T.read_users(spark, f"{tmp_path}/users.json").columns
    (tmp_path / "a.ts").write_text("eval(x)\n")
    doc = T.read_documents(spark, f"{tmp_path}/a.ts", {"ts": "typescript"}).first()
    assert (doc.scheme, doc.language_id, doc.text) == ("file", "typescript", "eval(x)\n")
