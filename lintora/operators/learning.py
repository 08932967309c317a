"""What is learned from developers' actions: counters, ordered folds, filters.

Events: developer_id, vuln_type, rule_id, kind, ts, seq, snippet_hash. The order
of events is (ts, seq).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lintora.functions import scalars as S

# What an action does to a rule's confidence, and the bounds.
START_CONFIDENCE, LEAST_CONFIDENCE, MOST_CONFIDENCE = 0.80, 0.10, 0.99
DELTAS = {"FIXED": 0.02, "IGNORED": -0.01, "FALSE_POSITIVE": -0.08}
SUPPRESS_AFTER, HASH_WINDOW = 3, 100

COUNTS = ("detections", "fixes", "ignored", "false_positives")
BY_TYPE, BY_RULE = ["developer_id", "vuln_type"], ["developer_id", "vuln_type", "rule_id"]


def _n(kind: str) -> Column:
    return F.count_if(F.col("kind") == kind)


def counters(events: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """By developer and type; first and last seen count events of every kind.
    before: a stored profile() to which the events are added."""
    now = events.groupBy(*BY_TYPE).agg(_n("DETECTED").alias("detections"), _n("FIXED").alias("fixes"), _n("IGNORED").alias("ignored"), _n("FALSE_POSITIVE").alias("false_positives"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    if before is None:
        return now
    held = before.filter("part = 'type'").select(*BY_TYPE, *[F.get("counts", i).alias(c) for i, c in enumerate(COUNTS)], "first_seen", "last_seen")
    return now.unionByName(held).groupBy(*BY_TYPE).agg(*[F.sum(c).alias(c) for c in COUNTS], F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def rule_counters(events: DataFrame) -> DataFrame:
    return events.groupBy(*BY_RULE).agg(_n("FIXED").alias("fixed"), _n("IGNORED").alias("ignored"), _n("FALSE_POSITIVE").alias("false_positives"), F.max("ts").alias("last_updated"))


def _cents(x: float) -> int:
    return round(x * 100)


def adjusted_confidence(events: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """The fold of a rule's actions in order, clamped and rounded at every step;
    rules without an action have no row (their confidence is null). before: a
    stored profile() whose confidences the events, all of them later, go on from.

    In whole cents a step is x -> min(hi, max(lo, x + d)), and steps in turn are
    such a step again. So the actions of each hour are folded to one (d, lo, hi),
    and the hours of a rule to its confidence: a rule with many actions is in no
    single task or row, as long as one hour of it is."""
    least, most = F.lit(_cents(LEAST_CONFIDENCE)), F.lit(_cents(MOST_CONFIDENCE))
    delta = F.lit(None).cast("int")
    for kind, d in DELTAS.items():
        delta = F.when(F.col("kind") == kind, _cents(d)).otherwise(delta)
    acted = events.select(*BY_RULE, "ts", "seq", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour"), delta.alias("delta")).filter("delta is not null")
    clamp = lambda x, lo, hi: F.least(hi, F.greatest(lo, x))

    def step(f: Column, d: Column, lo: Column, hi: Column) -> Column:
        return F.struct((f["d"] + d).alias("d"), clamp(f["lo"] + d, lo, hi).alias("lo"), clamp(f["hi"] + d, lo, hi).alias("hi"))

    none = F.struct(F.lit(0).alias("d"), least.alias("lo"), most.alias("hi"))
    hours = acted.groupBy(*BY_RULE, "hour").agg(F.array_sort(F.collect_list(F.struct("ts", "seq", "delta"))).alias("steps"))
    hours = hours.select(*BY_RULE, "hour", F.size("steps").cast("long").alias("n"), F.aggregate("steps", none, lambda f, x: step(f, x["delta"], least, most)).alias("f"))
    hours = hours.withColumn("start", F.lit(None).cast("int"))
    if before is not None:
        held = before.filter("part = 'rule'").select(*BY_RULE, F.col("n_actions").alias("n"), F.round(F.col("adjusted_confidence") * 100).cast("int").alias("start"))
        hours = hours.unionByName(held, allowMissingColumns=True)
    whole = hours.groupBy(*BY_RULE).agg(F.array_sort(F.collect_list(F.when(F.col("f").isNotNull(), F.struct("hour", "f")))).alias("hours"), F.sum("n").alias("n_actions"), F.coalesce(F.max("start"), F.lit(_cents(START_CONFIDENCE))).alias("start"))
    cents = F.aggregate("hours", F.col("start"), lambda x, h: clamp(x + h["f"]["d"], h["f"]["lo"], h["f"]["hi"]))
    return whole.select(*BY_RULE, (cents / 100).alias("adjusted_confidence"), "n_actions")


def kind_of_action(action: Column) -> Column:
    """FIXED, FALSE_POSITIVE, and IGNORED for whatever else; null stays null."""
    return F.when(action.isin("FIXED", "FALSE_POSITIVE"), action).when(action.isNotNull(), "IGNORED")


def events_of_actions(actions: DataFrame) -> DataFrame:
    """Learning events of the actions (action, code_snippet and more columns).
    Viewing the fix counts as FIXED."""
    viewed = F.when(F.col("action") == "SECURE_EXAMPLE_VIEWED", "FIXED").otherwise(F.col("action"))
    return actions.withColumns({"kind": kind_of_action(viewed), "snippet_hash": S.snippet_hash(F.col("code_snippet"))})


def suppressed(events: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Types that a developer has called false positives often enough; for good."""
    called = events.groupBy(*BY_TYPE).agg(_n("FALSE_POSITIVE").alias("false_positives")) if before is None else counters(events, before).select(*BY_TYPE, "false_positives")
    return called.filter(F.col("false_positives") >= SUPPRESS_AFTER)


def false_positive_hashes(events: DataFrame, window: int = HASH_WINDOW, before: DataFrame | None = None) -> DataFrame:
    """The last `window` distinct snippet hashes a developer called false
    positives, first in first out; one that is held is not moved, one that fell
    out may come again. What is held depends on all before, so a developer's
    rows pass through one task, sorted, of which it keeps the window alone. With
    a stored profile() before, only what came since is read: its hashes go first."""
    called = events.filter("kind = 'FALSE_POSITIVE'").select("developer_id", "ts", "seq", "snippet_hash")
    if before is not None:
        held = before.filter("part = 'hashes'").select("developer_id", F.posexplode("hashes").alias("at", "snippet_hash"))
        none = F.lit(None).cast(called.schema["ts"].dataType)  # sorted before all times
        called = called.unionByName(held.select("developer_id", none.alias("ts"), F.col("at").cast(called.schema["seq"].dataType).alias("seq"), "snippet_hash"))
    out = T.StructType([called.schema["developer_id"], T.StructField("hashes", T.ArrayType(T.StringType()))])
    fields = pa.schema([("developer_id", to_arrow_type(called.schema["developer_id"].dataType)), ("hashes", pa.list_(pa.string()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def developers():
            developer, held = None, None
            for batch in batches:
                for d, h in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                    if held is None or d != developer:
                        if held is not None:
                            yield developer, list(held)
                        developer, held = d, {}
                    if h not in held:
                        held[h] = None
                        if len(held) > window:
                            del held[next(iter(held))]
            if held is not None:
                yield developer, list(held)

        for developer, held in developers():
            yield pa.RecordBatch.from_pylist([{"developer_id": developer, "hashes": held}], schema=fields)

    return called.repartition("developer_id").sortWithinPartitions("developer_id", "ts", "seq").mapInArrow(run, out)


def profile(events: DataFrame, before: DataFrame | None = None, window: int = HASH_WINDOW) -> DataFrame:
    """Learning profiles as a table to be stored: rows by part, type (counts in
    the order of COUNTS, first and last seen), rule (confidence and number of
    actions) and hashes. before: the stored profile; all events are later."""
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    types = counters(events, before).select("developer_id", F.lit("type").alias("part"), "vuln_type", null("string", "rule_id"), F.array(*COUNTS).alias("counts"), "first_seen", "last_seen", null("double", "adjusted_confidence"), null("long", "n_actions"), null("array<string>", "hashes"))
    rules = adjusted_confidence(events, before).withColumn("part", F.lit("rule"))
    hashes = false_positive_hashes(events, window, before).withColumn("part", F.lit("hashes"))
    return types.unionByName(rules, allowMissingColumns=True).unionByName(hashes, allowMissingColumns=True)


def pass_differences(passes: DataFrame, found: DataFrame) -> DataFrame:
    """What changed between successive analyses of a document: document, pass,
    finding_key, status new, still or gone. passes: (document, pass), also those
    that found nothing; found: (document, pass, finding_key), with repeats. A key
    that is missing from one pass is gone in it and new when it comes again."""
    near = Window.partitionBy("document").orderBy("pass")
    order = passes.select("document", "pass").distinct().withColumns({"before": F.lag("pass").over(near), "after": F.lead("pass").over(near)})
    by_key = Window.partitionBy("document", "finding_key").orderBy("pass")
    seen = found.select("document", "pass", "finding_key").distinct().join(order, ["document", "pass"])
    seen = seen.withColumns({"seen_before": F.lag("pass").over(by_key), "seen_after": F.lead("pass").over(by_key)})
    status = F.when(F.col("seen_before").eqNullSafe(F.col("before")) & F.col("before").isNotNull(), "still").otherwise("new")
    leaves = F.col("after").isNotNull() & ~F.col("seen_after").eqNullSafe(F.col("after"))
    rows = F.array_compact(F.array(F.struct("pass", status.alias("status")), F.when(leaves, F.struct(F.col("after").alias("pass"), F.lit("gone").alias("status")))))
    return seen.select("document", "finding_key", F.inline(rows)).select("document", "pass", "finding_key", "status")


def detection_events(differences: DataFrame, mode: str = "reference") -> DataFrame:
    """Rows of pass_differences() that count as detections. reference: every pass
    counts all it finds again; dedup: each finding of a document counts once, when
    it is first there."""
    there = differences.filter("status <> 'gone'")
    if mode == "reference":
        return there
    if mode != "dedup":
        raise ValueError("mode is reference or dedup")
    return there.groupBy("document", "finding_key").agg(F.min("pass").alias("pass")).withColumn("status", F.lit("new")).select("document", "pass", "finding_key", "status")


def fix_rate(by_type: DataFrame) -> DataFrame:
    rate = F.when(F.col("detections") > 0, S.js_round(F.col("fixes") / F.col("detections") * 100)).otherwise(F.lit(0).cast("long"))
    return by_type.withColumn("fix_rate", rate)


def weaknesses(by_type: DataFrame) -> DataFrame:
    """Types seen three times or more and fixed in under half the cases."""
    weak = (F.col("detections") >= 3) & (F.col("fixes") < F.col("detections") * 0.5)
    return by_type.filter(weak).groupBy("developer_id").agg(F.array_sort(F.collect_list(F.struct("first_seen", "vuln_type"))).alias("w")).select("developer_id", F.transform("w", lambda x: x["vuln_type"]).alias("weaknesses"))


def context(by_type: DataFrame, off: DataFrame, weak: DataFrame, wanted: DataFrame) -> DataFrame:
    """A text on the learning history for each wanted (developer_id, vuln_type)."""
    known = by_type.select("developer_id").distinct().withColumn("known", F.lit(True))
    history = fix_rate(by_type).join(off.select(*BY_TYPE, F.lit(True).alias("off")), BY_TYPE, "left")
    rows = wanted.join(known, "developer_id", "left").join(history, BY_TYPE, "left").join(weak, "developer_id", "left")
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit("History of "), "vuln_type", F.lit(":")),
        *[F.concat(F.lit(f"  {name}: "), F.col(c).cast("string")) for name, c in (("detections", "detections"), ("fixes", "fixes"), ("fix rate %", "fix_rate"), ("ignored", "ignored"), ("false positives", "false_positives"))],
        F.concat(F.lit("  first seen: "), S.iso(F.col("first_seen").cast("timestamp"))),
        F.concat(F.lit("  last seen: "), S.iso(F.col("last_seen").cast("timestamp"))),
        F.when(F.col("off"), "  suppressed after repeated false positives"),
        F.when(F.size("weaknesses") > 0, F.concat(F.lit("  recurring: "), F.array_join("weaknesses", ", "))),
    )
    text = F.when(F.col("known").isNull(), "No history of this developer.").when(F.col("detections").isNull(), F.concat(F.lit("First time with "), "vuln_type", F.lit("."))).otherwise(lines)
    return rows.select(*BY_TYPE, text.alias("context"))


def learning_filter(findings: DataFrame, off: DataFrame, hashes: DataFrame, min_confidence: float = 0.70) -> DataFrame:
    """Findings with the rule's own confidence at least, of no suppressed type
    and of no snippet called a false positive."""
    held = hashes.select("developer_id", F.explode("hashes").alias("snippet_hash"))
    return findings.filter(F.col("confidence") >= min_confidence).join(off.select(*BY_TYPE), BY_TYPE, "left_anti").join(held, ["developer_id", "snippet_hash"], "left_anti")


def confidence_override(findings: DataFrame, adjusted: DataFrame) -> DataFrame:
    """The learned confidence where there is one, even below the threshold."""
    return findings.join(adjusted.select(*BY_RULE, "adjusted_confidence"), BY_RULE, "left").withColumn("confidence", F.coalesce("adjusted_confidence", "confidence")).drop("adjusted_confidence")
