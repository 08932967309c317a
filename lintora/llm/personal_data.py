"""Personal data: base patterns, and bootstrapping from their contexts.

Base spans (e-mail, IP and card numbers, phone numbers) are seed entities. What
stands around them, two words to the left, two to the right, or one to each
side, is a lexical pattern. Patterns and the identifier-like strings between
their words form a bipartite graph that Spark scores in rounds:

- a pattern's confidence is the mean confidence of its distinct instances,
  seeds counting 1;
- an instance's confidence is that of one of its trusted patterns at least
  being right, 1 - prod(1 - confidence).

A pattern is trusted with MIN_SEEDS distinct instances that are seeds or trusted
themselves, and a confidence of MIN_CONFIDENCE. Strings that look like
identifiers of a kind, are no base spans, and reach MIN_CONFIDENCE are trusted:
they are added wherever they occur, and count as seeds of further patterns. The
rounds end when no pattern and no instance is trusted anew.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintora.llm.common import discard, rows_of, to_batches, written

KINDS = ("email", "ip", "card", "phone")
MIN_SEEDS, MIN_CONFIDENCE = 3, 0.75

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9.]+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")
#: Looser shapes: what may be an identifier of a kind in a trusted context. Each
#: is bounded in length, and can't begin inside another of its kind.
_SHAPES = (
    ("ip", re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![\w:])")),
    ("card", re.compile(r"(?<![\w.+-])[0-9](?:[ -]?[0-9]){11,18}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w.+-])\(?[0-9]{2,4}\)?(?:[ ./-][0-9]{2,4}){1,5}(?![\w-])")),
)
#: Addresses that are spelled out: the sign, then labels with at least one dot.
_AT = re.compile(r" ?(?:\[at\]|\(at\)) ?| at | ?@ ?")
_SPELLED = re.compile(r"[\w-]+(?: ?(?:\[dot\]|\(dot\)| dot ) ?[\w-]+)+")
_DOTTED_LABELS = re.compile(r"[\w-]+(?:\.[\w-]+)+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            yield start, free
        at = text.find("@", at + 1)


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, in code points, ordered by start
    and then by kind as listed."""
    found = [(*span, 0) for span in _emails(text)]
    if _NO_DIGIT.fullmatch(text) is None and text:
        for run in _DOTTED.finditer(text):
            if run[0].count(".") >= 3:
                found += [(*m.span(), 1) for m in _IP.finditer(text, *run.span()) if all(int(x) <= 255 for x in m[0].split(".") if len(x.lstrip("0")) < 4) and all(len(x.lstrip("0")) < 4 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(digits := _NO_DIGIT.sub("", m[0])) <= 19 and _luhn(digits):
                found.append((*m.span(), 2))
        if "+" in text:
            found += [(*m.span(), 3) for m in _PHONE.finditer(text) if 10 <= len(_NO_DIGIT.sub("", m[0])) <= 15]
    return [(s, e, KINDS[k]) for s, e, k in sorted(found, key=lambda x: (x[0], x[2]))]


def _spelled_emails(text: str) -> Iterator[tuple[int, int]]:
    """From each sign, the local part to its left and the labels to its right;
    no character is walked over twice."""
    free = 0
    for at in _AT.finditer(text):
        start = at.start()
        while start > free and (text[start - 1].isalnum() or text[start - 1] in "_.%+-"):
            start -= 1
        if start < at.start():
            domain = _SPELLED.match(text, at.end()) or (_DOTTED_LABELS.match(text, at.end()) if "at" in at[0] and at[0].strip() != "at" else None)
            if domain:
                yield start, domain.end()
        free = at.end()


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Identifier-like strings apart from base spans and from each other, leftmost first."""
    loose = []
    if "(at)" in text or "[at]" in text or "dot" in text:
        loose += [(s, e, "email") for s, e in _spelled_emails(text)]
    if _NO_DIGIT.fullmatch(text) is None:
        for kind, shape in _SHAPES:
            for m in shape.finditer(text):
                n = len(_NO_DIGIT.sub("", m[0]))
                if kind == "ip" or kind == "card" and 12 <= n <= 19 or kind == "phone" and 7 <= n <= 15:
                    loose.append((*m.span(), kind))
    out, free, taken = [], 0, iter([*base, (len(text) + 1, len(text) + 1, "")])
    edge = next(taken)
    for s, e, kind in sorted(loose, key=lambda x: (x[0], -x[1])):
        while edge[1] <= s:
            edge = next(taken, (len(text) + 1, len(text) + 1, ""))
        if s >= free and e <= edge[0]:
            out.append((s, e, kind))
            free = e
    return out


def _contexts(text: str, start: int, end: int) -> list[str]:
    """Patterns around a span: a word that is longer than what is looked at
    (80 characters to the left, 40 to the right) stands for itself cut there."""
    left = text[max(0, start - 80) : start].lower().split()[-2:]
    right = text[end : end + 40].lower().split()[:2]
    out = [f"{left[0]} {left[1]} _"] if len(left) == 2 else []
    out += [f"{left[-1]} _ {right[0]}"] if left and right else []
    return out + ([f"_ {right[0]} {right[1]}"] if len(right) == 2 else [])


_MARK = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])
_SEEN = pa.struct([("kind", pa.string()), ("instance", pa.string()), ("pattern", pa.string()), ("seed", pa.bool_()), ("start", pa.int64()), ("end", pa.int64())])
_FOUND = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("base", pa.list_(_MARK)), ("seen", pa.list_(_SEEN))])
_FOUND_DDL = "row long, doc_id long, text_hash long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, base array<struct<start: long, end: long, kind: string>>, seen array<struct<kind: string, instance: string, pattern: string, seed: boolean, start: long, end: long>>"


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 40

    def rows():
        nonlocal row
        for doc_id, text, text_hash in rows_of(batches):
            text = text or ""
            base = base_spans(text)
            counts = [sum(k == kind for _, _, k in base) for kind in KINDS]
            digest = hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in base).encode()).hexdigest()
            seen = [(k, text[s:e].lower(), p, seed, s, e) for spans, seed in ((base, True), (candidates(text, base), False)) for s, e, k in spans for p in _contexts(text, s, e)]
            yield row, doc_id, text_hash, *counts, digest, base, seen
            row += 1

    yield from to_batches(rows(), _FOUND)


def trusted_instances(seen: DataFrame, min_seeds: int = MIN_SEEDS, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """kind, instance, confidence of the unseen identifiers, from rows (kind,
    instance, pattern, seed).

    Confidences never fall from round to round, so the rounds end: at the latest
    when as many have been trusted as there are. Each round reads written tables
    of the graph's edges, which are distinct; a pattern of many instances is
    aggregated before it is shuffled, and joined as a skewed key."""
    edges = seen.groupBy("kind", "pattern", "instance").agg(F.max("seed").alias("seed"))
    support = edges.groupBy("kind", "pattern").agg(F.count("*").alias("n"), F.count_if("seed").alias("n_seeds"))
    worth = written(support.filter((F.col("n") >= min_seeds) & (F.col("n") > F.col("n_seeds"))), "patterns")
    unseen = written(edges.filter(~F.col("seed")).join(worth.select("kind", "pattern"), ["kind", "pattern"]), "pattern-graph")
    n_patterns, n_instances, confidence = 0, 0, None
    while True:
        held = worth.withColumns({"mass": F.lit(0.0), "more": F.lit(0)})
        if confidence is not None:
            gained = unseen.join(confidence, ["kind", "instance"]).groupBy("kind", "pattern").agg(F.sum("confidence").alias("mass"), F.count_if(F.col("confidence") >= min_confidence).alias("more"))
            held = worth.join(gained, ["kind", "pattern"], "left").fillna(0)
        sure = held.select("kind", "pattern", ((F.col("n_seeds") + F.col("mass")) / F.col("n")).alias("p"), (F.col("n_seeds") + F.col("more")).alias("support"))
        sure = written(sure.filter((F.col("p") >= min_confidence) & (F.col("support") >= min_seeds)).select("kind", "pattern", "p"), "trusted-patterns")
        wrong = F.exp(F.sum(F.log(F.greatest(1 - F.col("p"), F.lit(1e-12)))))
        old, confidence = confidence, written(unseen.join(sure, ["kind", "pattern"]).groupBy("kind", "instance").agg((1 - wrong).alias("confidence")), "instances")
        counts = sure.count(), confidence.filter(F.col("confidence") >= min_confidence).count()
        discard(sure, *([old] if old is not None else []))
        if counts == (n_patterns, n_instances):
            return confidence.filter(F.col("confidence") >= min_confidence)
        n_patterns, n_instances = counts


def _order(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_seeds: int = MIN_SEEDS, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """row (a key), doc_id, text_hash, n_<kind> and base_sha256 of the base spans,
    spans: an array of (start, end, kind) of all spans, base and discovered,
    ordered by start and kind, and n_found: how many of them were discovered.
    Every row of docs gives one row.

    Null and empty texts have no spans; rows with null or equal ids are kept,
    each with its own spans; other columns are ignored; no rows give no rows.
    Copies of a text count once in the graph, whose edges are distinct."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    found = written(texts.mapInArrow(_scan, _FOUND_DDL), "base-spans")
    seen = found.filter(F.size("seen") > 0).select("row", F.inline("seen"))
    trusted = trusted_instances(seen.select("kind", "pattern", "instance", "seed"), min_seeds, min_confidence)
    new = seen.filter(~F.col("seed")).select("row", "kind", "instance", "start", "end").distinct().join(trusted, ["kind", "instance"])
    added = new.groupBy("row").agg(F.collect_list(F.struct("start", "end", "kind")).alias("added"))
    ordered = F.array_sort(F.transform(F.concat("base", F.coalesce("added", F.array())), lambda x: F.struct(x["start"].alias("start"), _order(x["kind"]).alias("at"), x["end"].alias("end"), x["kind"].alias("kind"))))
    spans = F.transform(ordered, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    n_found = F.size(F.coalesce("added", F.array())).cast("long")
    return found.drop("seen").join(added, "row", "left").select("row", "doc_id", "text_hash", *[f"n_{k}" for k in KINDS], "base_sha256", spans.alias("spans"), n_found.alias("n_found"))


def redact(text: str, spans: list) -> str:
    """The text with each stretch of overlapping spans replaced by its first kind."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the spans of find() replaced in the text by their kinds; all
    rows and columns stay. Rows are matched by id and text, so rows that repeat
    both share their spans. Null texts stay null."""
    spans = find(docs, id_col, text_col).filter(F.size("spans") > 0).groupBy("doc_id", "text_hash").agg(F.min("spans").alias("_lintora_spans"))
    spans = spans.select(F.col("doc_id").alias("_lintora_id"), F.col("text_hash").alias("_lintora_hash"), "_lintora_spans")
    same = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("_lintora_id")) & (F.xxhash64(f"`{text_col}`") == F.col("_lintora_hash"))
    marked = docs.join(spans, same, "left").select(*[F.col(f"`{c}`") for c in docs.columns], "_lintora_spans")
    place = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *columns, marks = batch.columns
            if marks.null_count < len(marks):
                texts = [redact(t, [(x["start"], x["end"], x["kind"]) for x in m]) if m else t for t, m in zip(columns[place].to_pylist(), marks.to_pylist())]
                columns[place] = pa.array(texts, columns[place].type)
            yield pa.record_batch(columns, names=batch.schema.names[:-1])

    return marked.mapInArrow(run, docs.schema)
