"""The rule scan: documents to findings, one document at a time.

Every pattern is a literal whose matches are an array of the document's row; a
cheap look for a string that each match must contain goes before the regex. Where
matches stand, their lines, what is near them, and which of them is the first of
its line and type are worked out in arrays of the same row, so nothing is
shuffled. Places are found by sums over blocks: the work grows with the text and
the number of matches, not with their product.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintora.functions import scalars as S
from lintora.operators.rules import RULES, Pattern, Rule
from lintora.settings import Settings

_BLANKS = r"^\s+|\s+$"
#: Elements of an array that are summed one by one; whole blocks are summed once.
_BLOCK = 64
#: Put around matches: a code point that no text is meant to hold.
_MARK = "\ufdd0"
#: Characters of a piece of text from which contexts are cut.
_PIECE = 4096


def _once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x that is computed once: the variable of a lambda is a value."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda acc, n: acc + n)


def _sums(numbers: Column, f: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """f(before), where before(i) is the sum of the elements before i (from 1)."""
    blocks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(numbers), F.lit(1)), F.lit(_BLOCK)), lambda i: _sum(F.slice(numbers, i, F.lit(_BLOCK))))
    sums = _once(blocks, lambda b: F.transform(F.sequence(F.lit(1), F.size(b)), lambda i: _sum(F.slice(b, F.lit(1), i - 1))))

    def before(sums: Column, i: Column) -> Column:
        block = F.floor((i - 1) / _BLOCK).cast("int")
        return F.element_at(sums, block + 1) + _sum(F.slice(numbers, block * _BLOCK + 1, i - 1 - block * _BLOCK))

    return _once(sums, lambda sums: f(lambda i: before(sums, i)))


def _cut(text: Column, lower: Column, marked: Column, language: Column, rule_at: int, rule: Rule, at: int, p: Pattern) -> Column:
    """The matches m of a pattern and the text g around them; null if there are none.

    The regex goes over the text once: it puts marks around its matches, and the
    text is cut at the marks, into what stands between matches and the matches in
    turn. Only texts in which a mark stands already are searched three times."""
    regex = ("(?i)" if rule.ignore_case else "") + p.regex
    gate = language.isin(*rule.languages) if rule.languages else F.lit(True)
    if p.needs:
        some = F.lit(False)
        for s in p.needs:
            some = some | F.contains(lower, F.lit(s))
        gate = gate & some
    place = (F.lit(rule_at).alias("rule_index"), F.lit(at).alias("pattern_index"))
    odd = lambda parts, first: F.filter(parts, lambda _, i: i % 2 == first)
    parts = F.split(F.regexp_replace(text, f"(?:{regex})", f"{_MARK}$0{_MARK}"), _MARK, -1)
    once = _once(parts, lambda x: F.when(F.size(x) > 1, F.struct(*place, odd(x, 1).alias("m"), odd(x, 0).alias("g"))))
    thrice = F.when(text.rlike(regex), F.struct(*place, F.regexp_extract_all(text, F.lit(regex), 0).alias("m"), F.split(text, regex, -1).alias("g")))
    return F.when(gate, F.when(marked, thrice).otherwise(once))


def _placed(x: Column) -> Column:
    """Each match of a pattern with its first character and its length."""
    m, gaps = x["m"], x["g"]
    lengths = F.zip_with(gaps, m, lambda g, m: F.coalesce(F.length(g), F.lit(0)) + F.coalesce(F.length(m), F.lit(0)))

    def place(i: Column, before: Column) -> Column:
        start = before + F.length(F.element_at(gaps, i))
        return F.struct(x["rule_index"].alias("rule_index"), x["pattern_index"].alias("pattern_index"), start.alias("range_start"), F.length(F.element_at(m, i)).alias("n"))

    return _once(lengths, lambda n: _sums(n, lambda before: F.transform(F.sequence(F.lit(1), F.size(m)), lambda i: place(i, before(i)))))


def usable(spark: SparkSession, rules: Sequence[Rule] = RULES) -> list[Rule]:
    """The rules without the patterns that are no regular expressions, so that
    one of them doesn't stop the others. Places of patterns in their rules stay:
    a broken one becomes a pattern that matches nothing."""
    from dataclasses import replace

    def sound(p: Pattern) -> Pattern:
        try:
            spark._jvm.java.util.regex.Pattern.compile(p.regex)
            return p
        except Exception:  # noqa: BLE001  whatever the compiler says
            return replace(p, regex=r"(?!)", portable="", needs=("\0",))

    return [replace(r, patterns=tuple(sound(p) for p in r.patterns)) for r in rules]


def _details(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """One row for each pattern, to be broadcast: a few dozen."""
    rows = [(i, j, r.type, r.severity, p.message, r.id, p.id, p.base, r.step, bool(p.keywords)) for i, r in enumerate(rules) for j, p in enumerate(r.patterns)]
    return spark.createDataFrame(rows, "rule_index int, pattern_index int, type string, severity string, message string, rule_id string, pattern_id string, base double, step double, boosted boolean")


def is_comment(line: Column, language: Column, style: str) -> Column:
    """by_language: # in Python and Ruby, else //, *, /* or <!--. any: //, *, <!-- or # everywhere."""
    if style == "none":
        return F.lit(False)
    bare = F.regexp_replace(line, _BLANKS, "")
    if style == "any":
        return bare.rlike(r"^(?://|\*|<!--|#)")
    return F.when(language.isin("python", "ruby"), bare.startswith("#")).otherwise(bare.rlike(r"^(?://|\*|/\*|<!--)"))


def _by_rule(rule_index: Column, values: list[Column], default: Column) -> Column:
    out = default
    for i, value in enumerate(values):
        out = F.when(rule_index == i, value).otherwise(out)
    return out


def boosts(near: Column, rule_index: Column, pattern_index: Column, rules: Sequence[Rule]) -> Column:
    """How many of the pattern's keywords stand in the lower-cased context."""
    out = F.lit(0)
    for i, rule in enumerate(rules):
        for j, p in enumerate(rule.patterns):
            if p.keywords:
                n = F.lit(0)
                for word in p.keywords:
                    n = n + F.contains(near, F.lit(word.lower())).cast("int")
                out = F.when((rule_index == i) & (pattern_index == j), n).otherwise(out)
    return out


def _near(pieces: Column, start: Column, end: Column, context: Column) -> Column:
    """The text from `context` characters before start to as many after end."""
    first = F.greatest(start - context, F.lit(0))
    piece = F.floor(first / _PIECE).cast("int")
    last = F.floor((end + context) / _PIECE).cast("int")
    return F.lower(F.substring(F.array_join(F.slice(pieces, piece + 1, last - piece + 1), ""), first - piece * _PIECE + 1, end + context - first))


def _rank(starts: Column, coarse: Column, at: Column) -> Column:
    """How many of the sorted starts are no larger than `at`."""
    full = F.greatest(F.size(F.filter(coarse, lambda s: s <= at)) - 1, F.lit(0)) * _BLOCK
    return full + F.size(F.filter(F.slice(starts, full + 1, F.lit(_BLOCK)), lambda s: s <= at))


def raw_matches(docs: DataFrame, rules: Sequence[Rule] = RULES, first_only: bool = False) -> DataFrame:
    """Every match of every pattern with its place: file_name, language_id,
    rule_index, pattern_index, range_start, range_end, line_number (from 1),
    column_number (from 0), line, comment (whether the line is one), boost.
    Offsets count characters. first_only: of the matches outside comments, the
    first by pattern and place of each line and type."""
    return _matches(docs, ["file_name", "language_id"], rules, first_only, True).select("file_name", "language_id", F.inline("hits")).drop("type_index")


def _matches(docs: DataFrame, kept: list[str], rules: Sequence[Rule], first_only: bool, only_found: bool) -> DataFrame:
    """Some columns of each document, which need language_id among them, and its
    matches as an array; null where there are none, unless only_found."""
    # generators in between, so that what comes before is computed once
    docs = docs.select(*kept, F.inline(F.array(F.struct("text", F.lower("text").alias("lower_text"), F.contains("text", F.lit(_MARK)).alias("marked")))))
    cut = [_cut(F.col("text"), F.col("lower_text"), F.col("marked"), F.col("language_id"), i, rule, j, p) for i, rule in enumerate(rules) for j, p in enumerate(rule.patterns)]
    held = docs.select(*kept, "text", F.inline(F.array(F.struct(F.array_compact(F.array(*cut)).alias("cut")))))
    if only_found:
        held = held.filter(F.size("cut") > 0)
    found = F.flatten(F.transform("cut", _placed))
    lines = _once(F.split("text", "\n", -1), lambda x: F.struct(x.alias("lines"), _once(F.transform(x, lambda s: F.length(s) + 1), lambda n: _sums(n, lambda before: F.transform(F.sequence(F.lit(1), F.size(n)), lambda i: before(i)))).alias("starts")))
    lines = _once(lines, lambda x: F.struct(x["lines"].alias("lines"), x["starts"].alias("starts"), F.transform(F.sequence(F.lit(1), F.size(x["starts"]), F.lit(_BLOCK)), lambda i: F.element_at(x["starts"], i)).alias("coarse")))
    pieces = F.regexp_extract_all("text", F.lit("(?s).{1,%d}" % _PIECE), 0)
    some = F.size("cut") > 0
    held = held.select(*kept, F.inline(F.array(F.struct(*[(x if only_found else F.when(some, x)).alias(name) for x, name in ((found, "found"), (lines, "l"), (pieces, "pieces"))]))))
    types = {t: i for i, t in enumerate(dict.fromkeys(r.type for r in rules))}

    def whole(x: Column) -> Column:
        rule, start = x["rule_index"], x["range_start"]
        end = start + x["n"]
        context = _by_rule(rule, [F.lit(r.context) for r in rules], F.lit(0))
        boosted = F.lit(False)
        for i, r in enumerate(rules):
            for j, p in enumerate(r.patterns):
                if p.keywords:
                    boosted = boosted | ((rule == i) & (x["pattern_index"] == j))
        boost = F.when(boosted, _once(_near(F.col("pieces"), start, end, context), lambda near: boosts(near, rule, x["pattern_index"], rules))).otherwise(0)

        def at_line(n: Column) -> Column:
            line = F.element_at("l.lines", n)
            comment = _by_rule(rule, [is_comment(line, F.col("language_id"), r.comments) for r in rules], F.lit(False))
            return F.struct(
                _by_rule(rule, [F.lit(types[r.type]) for r in rules], F.lit(-1)).alias("type_index"), n.alias("line_number"), rule.alias("rule_index"), x["pattern_index"].alias("pattern_index"), start.alias("range_start"),
                end.alias("range_end"), (start - F.element_at("l.starts", n)).alias("column_number"), line.alias("line"), comment.alias("comment"), boost.alias("boost"),
            )

        return _once(_rank(F.col("l.starts"), F.col("l.coarse"), start), at_line)

    hits = F.transform("found", whole)
    if first_only:  # sorted by type, line, pattern and place: a finding is what differs from the one before
        live = F.array_sort(F.filter(hits, lambda x: ~x["comment"]))
        hits = _once(live, lambda a: F.filter(a, lambda x, i: (i == 0) | ~F.struct(x["type_index"], x["line_number"]).eqNullSafe(_key(F.get(a, i - 1)))))
    return held.select(*kept, hits.alias("hits"))


def _key(x: Column) -> Column:
    return F.struct(x["type_index"], x["line_number"])


def _confidence(boosted: Column, base: Column, boost: Column, step: Column) -> Column:
    return S.js_round(F.when(boosted, F.least(F.lit(0.99), base + boost * step)).otherwise(base), 2)


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES, enabled: bool = True) -> DataFrame:
    """Findings of documents (file_name, language_id, text): at most one for
    each document, line and type, the first by pattern and place outside
    comments. A file name is one document."""
    if not enabled:
        docs = docs.filter(F.lit(False))
    rules = usable(docs.sparkSession, rules)
    hits = raw_matches(docs, rules, first_only=True).join(F.broadcast(_details(docs.sparkSession, rules)), ["rule_index", "pattern_index"])
    return hits.select(
        S.finding_key(F.col("file_name"), F.col("line_number"), F.col("type"), F.col("rule_id")).alias("finding_key"),
        "file_name", "language_id", "type", "severity", _confidence(F.col("boosted"), F.col("base"), F.col("boost"), F.col("step")).alias("confidence"), "message", "line_number", "column_number",
        S.trimmed(F.col("line")).alias("code_snippet"), "rule_id", "pattern_id", "range_start", "range_end", "rule_index", "pattern_index",
    )


def scan_rows(docs: DataFrame, columns: Sequence[str], rules: Sequence[Rule] = RULES) -> DataFrame:
    """The scan of documents (document, ts, seq, kind, language_id, text), each in
    its own row: document, ts, seq, kind, findings (an array with some columns of
    scan(), by line and type; null where nothing is found). It needs no join and so
    fits a stream."""
    rules = usable(docs.sparkSession, rules)
    kept = ["document", "ts", "seq", "kind", "language_id"]
    known = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in (("type", r.type), ("severity", r.severity), ("message", p.message), ("rule_id", r.id), ("pattern_id", p.id), ("base", p.base), ("step", r.step), ("boosted", bool(p.keywords)))]) for r in rules for p in r.patterns])
    first = [sum(len(r.patterns) for r in rules[:i]) for i in range(len(rules))]

    def finding(x: Column) -> Column:
        def described(d: Column) -> Column:
            values = {
                "finding_key": S.finding_key(F.col("document"), x["line_number"], d["type"], d["rule_id"]), "confidence": _confidence(d["boosted"], d["base"], x["boost"], d["step"]), "code_snippet": S.trimmed(x["line"]),
                **{c: d[c] for c in ("type", "severity", "message", "rule_id", "pattern_id")}, **{c: x[c] for c in ("line_number", "column_number", "range_start", "range_end")},
            }
            return F.struct(*[values[c].alias(c) for c in columns])

        return _once(F.get(known, _by_rule(x["rule_index"], [F.lit(n) for n in first], F.lit(0)) + x["pattern_index"]), described)

    return _matches(docs, kept, rules, True, False).select("document", "ts", "seq", "kind", F.transform("hits", finding).alias("findings"))


def under(settings: Settings, docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The scan as a session has set it: nothing where it is switched off, and no
    findings below its least confidence."""
    return scan(docs, rules, settings.enabled).filter(F.col("confidence") >= settings.min_confidence)


def by_entry(spark: SparkSession, findings: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The catalogue, each entry with what it has found: n_findings, n_files."""
    found = findings.groupBy("rule_id", "pattern_id").agg(F.count("*").alias("n_findings"), F.count_distinct("file_name").alias("n_files"))
    return F.broadcast(catalogue(spark, rules)).join(found, ["rule_id", "pattern_id"], "left").fillna(0, ["n_findings", "n_files"])


def severity_order() -> list[Column]:
    """Findings by severity and line; ties in the order in which rules emit them."""
    return [S.severity_rank(F.col("severity")), F.col("line_number"), F.col("rule_index"), F.col("pattern_index"), F.col("range_start")]


def catalogue(spark: SparkSession, rules: Sequence[Rule] = RULES) -> DataFrame:
    rows = [(r.id, r.name, r.type, p.id, j, p.base, ",".join(r.languages), len(p.keywords)) for r in rules for j, p in enumerate(r.patterns)]
    return spark.createDataFrame(rows, "rule_id string, rule_name string, type string, pattern_id string, pattern_index int, base double, languages string, n_keywords int")


def sql(rules: Sequence[Rule] = RULES) -> str:
    """The scan as DuckDB SQL over a relation docs(file_name, language_id, text)."""
    quote = lambda s: "'" + str(s).replace("'", "''") + "'"
    rows = []
    for i, r in enumerate(rules):
        for j, p in enumerate(r.patterns):
            regex = ("(?i)" if r.ignore_case else "") + (p.portable or p.regex)
            words = "[" + ", ".join(quote(k.lower()) for k in p.keywords) + "]::VARCHAR[]"
            languages = "[" + ", ".join(map(quote, r.languages)) + "]::VARCHAR[]"
            rows.append(f"({i}, {j}, {quote(regex)}, {p.base}::DOUBLE, {words}, {r.context}, {r.step}::DOUBLE, {quote(r.type)}, {quote(r.id)}, {quote(p.id)}, {quote(r.severity)}, {quote(r.comments)}, {quote(p.message)}, {languages})")
    return f"""
patterns(rule_index, pattern_index, regex, base, keywords, context, step, type, rule_id, pattern_id, severity, comments, message, languages) AS (VALUES {', '.join(rows)}),
extracted AS (
  SELECT d.*, p.*, regexp_extract_all(text, regex) AS m, regexp_split_to_array(text, regex) AS g
  FROM docs d JOIN patterns p ON (len(languages) = 0 OR list_contains(languages, language_id)) AND regexp_matches(text, regex)
), placed AS (
  SELECT *, m[i] AS matched,
    CAST(list_sum(list_transform(g[1:i], lambda s: length(s))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda s: length(s))), 0) AS INTEGER) AS range_start
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM extracted)
), hits AS (
  SELECT *, CAST(range_start + length(matched) AS INTEGER) AS range_end, string_split(left(text, range_start), chr(10)) AS before
  FROM placed WHERE NOT (pattern_id = 'xss-innerhtml' AND regexp_matches(matched, '["''`]<[^>]+>["''`]$'))
), lined AS (
  SELECT *, CAST(len(before) AS INTEGER) AS line_number, CAST(length(before[-1]) AS INTEGER) AS column_number, regexp_replace(string_split(text, chr(10))[len(before)], '^\\s+|\\s+$', '', 'g') AS bare,
    lower(substr(text, greatest(range_start - context, 0) + 1, range_end + context - greatest(range_start - context, 0))) AS near
  FROM hits
), live AS (
  SELECT *, list_sum(list_transform(keywords, lambda k: CAST(contains(near, k) AS INTEGER))) AS boost FROM lined
  WHERE NOT (CASE comments WHEN 'none' THEN false WHEN 'any' THEN regexp_matches(bare, '^(?://|\\*|<!--|#)')
    ELSE CASE WHEN language_id IN ('python', 'ruby') THEN starts_with(bare, '#') ELSE regexp_matches(bare, '^(?://|\\*|/\\*|<!--)') END END)
), findings AS (
  SELECT sha256(file_name || '|' || line_number || '|' || type || '|' || rule_id) AS finding_key, file_name, language_id, type, severity,
    floor(CASE WHEN len(keywords) > 0 THEN least(0.99, base + boost * step) ELSE base END * 100 + 0.5) / 100 AS confidence,
    message, line_number, column_number, bare AS code_snippet, rule_id, pattern_id, range_start, range_end, rule_index, pattern_index
  FROM live QUALIFY row_number() OVER (PARTITION BY file_name, type, line_number ORDER BY rule_index, pattern_index, range_start) = 1
)"""
