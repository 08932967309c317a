"""Explanations of findings: features of the snippet by regular expressions,
put into templates. The wording is our own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintora.functions import scalars as S

#: type, title, what it is, what to do
METADATA = (
    ("SQL_INJECTION", "SQL injection", "Input becomes part of the text of a query.", "Bind parameters."),
    ("XSS", "Cross-site scripting", "Input becomes part of a page's markup.", "Set text, or sanitize markup."),
    ("HARDCODED_SECRET", "Hardcoded secret", "A credential stands in the source.", "Read it from the environment or a vault."),
    ("COMMAND_INJECTION", "Command injection", "Input becomes part of a shell command.", "Pass arguments as a list."),
    ("PATH_TRAVERSAL", "Path traversal", "Input becomes part of a file path.", "Resolve the path and check where it lies."),
)


def metadata(spark: SparkSession) -> DataFrame:
    """Five rows."""
    return spark.createDataFrame(METADATA, "type string, title string, description string, recommendation string")


def with_metadata(findings: DataFrame) -> DataFrame:
    """Findings with title and description of their type, or their own message."""
    joined = findings.join(F.broadcast(metadata(findings.sparkSession)), "type", "left")
    return joined.withColumns({"title": F.coalesce("title", S.label(F.col("type"))), "description": F.coalesce("description", "message"), "recommendation": F.coalesce("recommendation", F.lit("Follow secure coding practice."))})


def _first(code: Column, *patterns: str, default: str) -> Column:
    """Group 1 of the first pattern that matches."""
    found = [F.nullif(F.regexp_extract(code, p, 1), F.lit("")) for p in patterns]
    return F.coalesce(*found, F.lit(default))


def features(code: Column, kind: Column) -> dict[str, Column]:
    """What the templates take from a snippet."""
    # The expressions by which features are found, and their defaults.
    variable = (
        F.when(kind == "SQL_INJECTION", _first(code, r"\+\s*(\w+)\s*;?$", default="userInput"))
        .when(kind == "XSS", _first(code, r"=\s*(\w+)\s*;?\s*$", r"\((\w+)\)", r"\{(\w+)\}", default="userInput"))
        .when(kind == "HARDCODED_SECRET", _first(code, r"(?:const|let|var|private|string)\s+(\w+)\s*=", default="secret"))
        .otherwise(_first(code, r"\+\s*(\w+)", r"\$\{(\w+)\}", default="userInput"))
    )
    query = F.when(code.rlike("(?i)INSERT"), "INSERT").when(code.rlike("(?i)UPDATE"), "UPDATE").when(code.rlike("(?i)DELETE"), "DELETE").otherwise("SELECT")
    language = F.when(code.rlike(r"(?:string|var)\s+\w+\s*="), "csharp").when(code.rlike("f[\"']") | F.contains(code, F.lit("%")), "python").when(F.contains(code, F.lit("`")) | code.rlike("const|let"), "javascript").otherwise("generic")
    sink = F.when(F.contains(code, F.lit("innerHTML")), "innerHTML").when(code.rlike(r"\beval\s*\("), "eval").when(F.contains(code, F.lit("dangerouslySetInnerHTML")), "react").otherwise("other")
    secret = F.when(code.rlike("AKIA|(?i:aws)"), "AWS key").when(code.rlike("eyJ|(?i:jwt|token)"), "Token").when(code.rlike("(?i)api_?key"), "API key").when(code.rlike("(?i)password|passwd|pwd"), "Password").otherwise("Credential")
    return {
        "variable": variable,
        "query_kind": F.when(kind == "SQL_INJECTION", query),
        "language": F.when(kind == "SQL_INJECTION", language),
        "column": F.when(kind == "SQL_INJECTION", _first(code, r"(?i)WHERE\s+(\w+)\s*=", default="id")),
        "query_variable": F.when(kind == "SQL_INJECTION", _first(code, r"(?:string|var|let|const|query)\s+(\w+)\s*=", default="query")),
        "attack_query": F.when((kind == "SQL_INJECTION") & (query == "SELECT"), F.concat(_first(code, "[\"'`]([^\"'`]+)[\"'`]", default="SELECT * FROM table WHERE id="), F.lit("1 OR 1=1 --"))),
        "sink": F.when(kind == "XSS", sink),
        "secret_kind": F.when(kind == "HARDCODED_SECRET", secret),
    }


def _csharp_sql(code: Column, column: Column) -> Column:
    base = F.coalesce(F.nullif(F.regexp_extract(code, "[\"']([^\"']+)[\"']\\s*\\+", 1), F.lit("")), F.concat(F.lit("SELECT * FROM Table WHERE "), column, F.lit("=")))
    return F.regexp_replace(F.regexp_replace(base, r"\s+$", ""), F.lit("=\\s*[\"']?\\s*$"), F.concat(F.lit("=@"), column))


def explain(findings: DataFrame, kind_col: str = "type", code_col: str = "code_snippet") -> DataFrame:
    """findings with the features and headline, danger, attack, vulnerable_code,
    fixed_code, fix."""
    kind, code = F.col(kind_col), F.col(code_col)
    f = features(code, kind)
    rows = findings.withColumns(f)
    v, say = F.col("variable"), F.concat
    lit = F.lit
    attack = (
        F.when(kind == "SQL_INJECTION", F.when(F.col("attack_query").isNotNull(), say(lit("The query may become: "), "attack_query")).otherwise(say(v, lit(" may change or destroy data."))))
        .when(kind == "XSS", F.when(F.col("sink") == "eval", say(lit("Code in "), v, lit(" runs at once."))).when(F.col("sink") == "react", lit("React's escaping is bypassed.")).otherwise(say(lit("Markup in "), v, lit(" may run scripts."))))
        .when(kind == "HARDCODED_SECRET", lit("The history of the repository keeps the value."))
        .when(kind == "COMMAND_INJECTION", say(lit("A second command may follow in "), v, lit(".")))
        .when(kind == "PATH_TRAVERSAL", say(lit("../ in "), v, lit(" leaves the folder.")))
        .otherwise(lit("The weakness may be exploited."))
    )
    sql_fix = (
        F.when(F.col("language") == "csharp", say(lit("string "), "query_variable", lit(' = "'), _csharp_sql(code, F.col("column")), lit('"; add @'), "column", lit(" = "), v))
        .when(F.col("language") == "python", say(lit('cursor.execute("... WHERE '), "column", lit(' = %s", ('), v, lit(",))")))
        .when(F.col("language") == "javascript", say(lit("const "), "query_variable", lit(' = "... WHERE '), "column", lit(' = ?"; execute('), "query_variable", lit(", ["), v, lit("])")))
        .otherwise(say(lit("PREPARE with ?; EXECUTE USING "), v))
    )
    xss_fix = F.when(F.col("sink") == "innerHTML", say(lit("element.textContent = "), v)).when(F.col("sink") == "eval", say(lit("JSON.parse("), v, lit(")"))).otherwise(say(lit("sanitize("), v, lit(")")))
    fixed = (
        F.when(kind == "SQL_INJECTION", sql_fix)
        .when(kind == "XSS", xss_fix)
        .when(kind == "HARDCODED_SECRET", say(v, lit(" = env."), F.upper(v)))
        .when(kind == "COMMAND_INJECTION", say(lit("execFile(program, ["), v, lit("])")))
        .when(kind == "PATH_TRAVERSAL", say(lit("resolve(base, "), v, lit("), then check that it starts with base")))
        .otherwise(say(lit("See the guidelines on "), S.label(kind)))
    )
    headline = (
        F.when(kind == "SQL_INJECTION", say(lit("A query is joined with "), v))
        .when(kind == "XSS", say(v, lit(" is written to the page unescaped")))
        .when(kind == "HARDCODED_SECRET", say("secret_kind", lit(" in the source as "), v))
        .when(kind == "COMMAND_INJECTION", say(lit("A command is joined with "), v))
        .when(kind == "PATH_TRAVERSAL", say(lit("A path is joined with "), v))
        .otherwise(say(S.label(kind), lit(" detected")))
    )
    return rows.withColumns({"headline": headline, "attack": attack, "vulnerable_code": code, "fixed_code": fixed})
