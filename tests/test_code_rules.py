from lintora.operators import code_rules, rules, scan
from lintora.operators.code_rules import CodeRule
from lintora.settings import Settings

DOCS = "file_name string, language_id string, text string, error string, rule_id string"


def made():
    def words(text, file_name, language_id):
        for n, line in enumerate(text.split("\n"), 1):
            if "todo" in line:
                yield {"line_number": n, "column_number": line.index("todo"), "code_snippet": line, "message": f"in {file_name}", "range_start": 0, "range_end": 4}

    def breaks(text, file_name, language_id):
        yield {"line_number": 1, "code_snippet": text[:5], "message": "before it breaks", "confidence": 0.5, "severity": "LOW"}
        if "boom" in text:
            raise RuntimeError("boom")

    def misses(text, file_name, language_id):
        yield {"line_number": 1}

    return (CodeRule("C1", "words", "XSS", (), words), CodeRule("C2", "breaks", "XSS", ("go", "java"), breaks), CodeRule("C3", "misses", "XSS", ("java",), misses))


RULES = made()


def docs(spark, rows):
    return spark.createDataFrame([(f, lang, t, "e", "r") for f, lang, t in rows], DOCS)


def test_a_rule_that_raises_is_isolated_by_document(spark):
    table = docs(spark, [("a", "go", "x todo\ny\ntodo"), ("b", "go", "boom todo"), ("c", "java", "ok"), ("d", "go", None), ("e", None, "todo"), ("a", "go", "x todo\ny\ntodo")])
    got = code_rules.analyze(table, RULES).collect()
    found = sorted((r.file_name, r.rule_id, r.line_number, r.column_number, r.confidence, r.severity) for r in got if r.error is None)
    a = [("a", "C1", 1, 2, 0.8, "HIGH"), ("a", "C1", 3, 0, 0.8, "HIGH"), ("a", "C2", 1, 0, 0.5, "LOW")]
    assert found == sorted([*a, *a, ("b", "C1", 1, 5, 0.8, "HIGH"), ("b", "C2", 1, 0, 0.5, "LOW"), ("c", "C2", 1, 0, 0.5, "LOW"), ("e", "C1", 1, 0, 0.8, "HIGH")])
    assert sorted((r.file_name, r.rule_id, r.error.split(":")[0], r.finding_key) for r in got if r.error) == [("b", "C2", "RuntimeError", None), ("c", "C3", "KeyError", None)]
    assert code_rules.analyze(docs(spark, []), RULES).collect() == []


def test_both_kinds_of_rules(spark):
    table = docs(spark, [("a.js", "javascript", "eval(x) // todo"), ("b.js", "javascript", "boom")])
    got = code_rules.scan(table, RULES).collect()
    assert sorted((r.file_name, r.rule_id, r.rule_index) for r in got) == [("a.js", "C1", len(rules.RULES)), ("a.js", rules.XSS.id, 1)]
    assert len({r.finding_key for r in got}) == 2


def test_no_shuffle_and_arrow(spark):
    plan = code_rules.analyze(docs(spark, [("a", "go", "todo")]), RULES)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPythonUDTF" in plan and "Exchange" not in plan


def test_a_text_that_holds_the_mark_is_scanned_all_the_same(spark):
    text = "el.innerHTML = userInput;\n﷐ el.outerHTML = other; el.outerHTML = more;"
    plain = docs(spark, [("a", "javascript", text.replace("﷐", "?"))])
    columns = ["rule_index", "pattern_index", "range_start", "range_end", "line_number", "column_number"]
    rows = lambda df: sorted(map(tuple, scan.raw_matches(df).select(*columns).collect()))
    assert rows(docs(spark, [("a", "javascript", text)])) == rows(plain) and len(rows(plain)) == 3


def test_the_scan_under_settings(spark):
    table = docs(spark, [("a.js", "javascript", "el.innerHTML = y;\nimg.src = z;")])
    assert {r.confidence for r in scan.under(Settings(min_confidence=0.9), table).collect()} == {0.92}
    assert len(scan.under(Settings(min_confidence=0.0), table).collect()) == 2
    assert scan.under(Settings(enabled=False), table).collect() == []
