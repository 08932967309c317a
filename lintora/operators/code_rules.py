"""Rules as code, beside the rules that are patterns.

A code rule is given a whole document and gives rows. All code rules are one
table function that Spark joins laterally to the documents: it runs where the
documents are, in Arrow batches, and needs no shuffle. A rule that raises gives a
row with its error for that document; its findings there until then, and those of
all other rules, stay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintora.functions import scalars as S
from lintora.operators import scan as patterns
from lintora.operators.rules import RULES, Rule

_ROW = "rule_index int, rule_id string, type string, severity string, confidence double, message string, line_number int, column_number int, code_snippet string, pattern_id string, range_start int, range_end int, error string"


@dataclass(frozen=True)
class CodeRule:
    """analyze(text, file_name, language_id) gives dictionaries with line_number
    (from 1), column_number (from 0), code_snippet, message, and, where they are
    not the rule's own, severity, confidence, pattern_id, range_start, range_end.
    No languages: all."""

    id: str
    name: str
    type: str
    languages: tuple[str, ...]
    analyze: Callable[[str, str, str], Iterable[dict]]
    severity: str = "HIGH"
    confidence: float = 0.8


def _rows(index: int, rule: CodeRule, file_name: str, language_id: str, text: str):
    try:
        for x in rule.analyze(text, file_name, language_id):
            yield (
                index, rule.id, rule.type, x.get("severity", rule.severity), float(x.get("confidence", rule.confidence)), str(x["message"]), int(x["line_number"]), int(x.get("column_number", 0)),
                str(x["code_snippet"]), x.get("pattern_id", rule.id), x.get("range_start"), x.get("range_end"), None,
            )
    except Exception as error:  # noqa: BLE001  a rule may raise anything; the others go on
        yield index, rule.id, rule.type, None, None, None, None, None, None, None, None, None, f"{type(error).__name__}: {error}"[:500]


def analyze(docs: DataFrame, rules: Sequence[CodeRule], first_index: int = 0) -> DataFrame:
    """What the rules give for documents (file_name, language_id, text), with the
    columns of scan() and `error`: rows with an error are no findings. Null texts
    are not analyzed."""

    @F.udtf(returnType=_ROW, useArrow=True)
    class Analysis:
        def eval(self, file_name: str, language_id: str, text: str):
            if text is not None:
                for i, rule in enumerate(rules):
                    if not rule.languages or language_id in rule.languages:
                        yield from _rows(first_index + i, rule, file_name, language_id, text)

    docs = docs.select("file_name", "language_id", "text")
    found = docs.lateralJoin(Analysis(F.col("file_name").outer(), F.col("language_id").outer(), F.col("text").outer()))
    key = F.when(F.col("error").isNull(), S.finding_key(F.col("file_name"), F.col("line_number"), F.col("type"), F.col("rule_id")))
    return found.select(
        key.alias("finding_key"), "file_name", "language_id", "type", "severity", "confidence", "message", "line_number", "column_number", "code_snippet",
        "rule_id", "pattern_id", "range_start", "range_end", "rule_index", F.lit(0).alias("pattern_index"), "error",
    )


def scan(docs: DataFrame, code_rules: Sequence[CodeRule], rules: Sequence[Rule] = RULES) -> DataFrame:
    """All findings, of patterns and of code, with an `error` that is null, and a
    row for each document and code rule that raised. They come in the order of
    the rules: patterns first."""
    found = patterns.scan(docs, rules).withColumn("error", F.lit(None).cast("string"))
    return found.unionByName(analyze(docs, code_rules, len(rules)))
