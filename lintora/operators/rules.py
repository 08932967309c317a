"""Rules as data: a rule is a list of patterns, a pattern a row."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Pattern:
    id: str
    regex: str
    base: float
    message: str
    needs: tuple[str, ...] = ()  # lower-case strings, one of which every match contains
    keywords: tuple[str, ...] = ()
    portable: str = ""  # the same for engines without lookahead, where it differs


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    type: str
    languages: tuple[str, ...]
    patterns: tuple[Pattern, ...]
    ignore_case: bool
    context: int
    step: float
    comments: str  # which lines are comments: "by_language", "any" or "none"
    severity: str = "HIGH"
    extras: dict = field(default_factory=dict, hash=False)


# Languages, patterns, base confidences, boosting keywords and steps.
SQL_LANGUAGES = ("csharp", "java", "javascript", "typescript", "python", "php", "ruby", "go", "plaintext")
XSS_LANGUAGES = ("javascript", "typescript", "javascriptreact", "typescriptreact", "html", "php", "plaintext", "vue", "svelte")

SQL = Rule(
    "LINT-SQL-001", "SQL injection", "SQL_INJECTION", SQL_LANGUAGES,
    (
        Pattern("sql-concat-select", r"""["'`]SELECT\s+.+\s+FROM\s+\w+\s+WHERE\s+\w+\s*=\s*["'`]\s*\+""", 0.95, "A SELECT statement is joined with a value by +.", ("select",), ("userId", "username", "email", "id", "request", "input", "param")),
        Pattern("sql-concat-insert", r"""["'`]INSERT\s+INTO\s+.+VALUES\s*\(.+["'`]\s*\+""", 0.92, "An INSERT statement is joined with a value by +.", ("insert",)),
        Pattern("sql-concat-update", r"""["'`]UPDATE\s+\w+\s+SET\s+.+["'`]\s*\+""", 0.90, "An UPDATE statement is joined with a value by +.", ("update",)),
        Pattern("sql-concat-delete", r"""["'`]DELETE\s+FROM\s+\w+\s+WHERE\s+.+["'`]\s*\+""", 0.93, "A DELETE statement is joined with a value by +.", ("delete",)),
        Pattern("sql-generic-concat", r"""(?:SELECT|INSERT|UPDATE|DELETE|DROP|ALTER|EXEC|EXECUTE)\s+[^;]+["'`]\s*\+\s*\w+""", 0.82, "SQL text is joined with a variable.", ("select", "insert", "update", "delete", "drop", "alter", "exec")),
        Pattern("sql-like-injection", r"""LIKE\s+["'`]%\s*["'`]\s*\+\s*\w+\s*\+\s*["'`]%["'`]""", 0.88, "A LIKE pattern is put together from a variable.", ("like",)),
        Pattern("sql-orderby-injection", r"""["'`]ORDER\s+BY\s*["'`]\s*\+\s*\w+""", 0.91, "ORDER BY takes a variable, which parameters cannot protect.", ("order",)),
        Pattern("sql-js-template", r"""`\s*(?:SELECT|INSERT|UPDATE|DELETE|DROP|EXEC)\s+[^`]*\$\{[^}]+\}""", 0.90, "A template literal puts a value into SQL.", ("${",), ("req.body", "req.query", "req.params", "userInput", "userId")),
        Pattern("sql-python-fstring", r"""f["'](?:SELECT|INSERT|UPDATE|DELETE|EXEC|DROP)\s+[^"']*\{[^}]+\}""", 0.88, "An f-string puts a value into SQL.", ("{",)),
        Pattern("sql-python-percent", r"""["'](?:SELECT|INSERT|UPDATE|DELETE)\s+[^"']*["']\s*%\s*(?:\(|\w)""", 0.85, "The % operator puts a value into SQL.", ("%",)),
        Pattern("sql-string-format", r"""String\.Format\s*\(\s*["'](?:SELECT|INSERT|UPDATE|DELETE)""", 0.88, "String.Format builds SQL.", ("string.format",)),
        Pattern("sql-sqlalchemy-text", r"""text\s*\(\s*f["'](?:SELECT|INSERT|UPDATE|DELETE)\s+[^"']*\{[^}]+\}""", 0.93, "text() is given an f-string.", ("text",)),
        Pattern("sql-django-raw", r"""\.raw\s*\(\s*f["'](?:SELECT|INSERT|UPDATE|DELETE)|\.raw\s*\(\s*["'](?:SELECT|INSERT|UPDATE|DELETE)[^"']*["']\s*%""", 0.91, "raw() is given a formatted string.", (".raw",)),
        Pattern("sql-jdbc-concat", r"""createStatement\s*\(\s*\)[\s\S]{0,60}execute(?:Query|Update)\s*\(\s*["'](?:SELECT|INSERT|UPDATE|DELETE)[^"']*["']\s*\+""", 0.94, "A plain JDBC statement runs joined SQL.", ("createstatement",)),
        Pattern("sql-php-mysql", r"""(?:mysql_query|mysqli_query|pg_query)\s*\(\s*(?:\$\w+\s*,\s*)?["'](?:SELECT|INSERT|UPDATE|DELETE)[^"']*["']\s*\.\s*\$\w+""", 0.93, "A PHP query function runs joined SQL.", ("_query",)),
        Pattern("sql-exec-sp", r"""EXEC(?:UTE)?\s*\(\s*["'`]?\s*(?:sp_|xp_)\w+|EXEC\s*\(\s*@\w+\s*\+""", 0.89, "A stored procedure is run dynamically.", ("exec",)),
        Pattern("sql-pdo-query-concat", r"""\$(?:pdo|db|conn)\s*->\s*query\s*\(\s*["'](?:SELECT|INSERT|UPDATE|DELETE)[^"']*["']\s*\.\s*\$""", 0.90, "PDO query() runs joined SQL.", ("query",)),
    ),
    True, 150, 0.01, "by_language",
)

XSS = Rule(
    "LINT-XSS-001", "Cross-site scripting", "XSS", XSS_LANGUAGES,
    (
        Pattern("xss-innerhtml", r"""\.innerHTML\s*=\s*(?!["'`]<[^>]+>["'`])\S""", 0.92, "innerHTML is set to something that is not constant.", ("innerhtml",), ("req.body", "req.query", "userInput", "location.hash", "search", "URLSearchParams"), r"""\.innerHTML\s*=\s*(?:["'`]<[^>]+>["'`]|\S)"""),
        Pattern("xss-outerhtml", r"""\.outerHTML\s*=\s*\w""", 0.90, "outerHTML is set to a variable.", ("outerhtml",)),
        Pattern("xss-insertadjacenthtml", r"""\.insertAdjacentHTML\s*\(\s*["'`][^"'`]+["'`]\s*,\s*\w""", 0.91, "insertAdjacentHTML() is given a variable.", ("insertadjacenthtml",)),
        Pattern("xss-docwrite", r"""document\.write\s*\(\s*(?!\s*["'`][^"'`]*["'`]\s*\))\w""", 0.89, "document.write() is given a variable.", ("document.write",), (), r"""document\.write\s*\(\s*\w"""),
        Pattern("xss-docwriteln", r"""document\.writeln\s*\(\s*\w""", 0.89, "document.writeln() is given a variable.", ("document.writeln",)),
        Pattern("xss-eval", r"""\beval\s*\(\s*\w""", 0.97, "eval() is given a variable.", ("eval",)),
        Pattern("xss-function-ctor", r"""new\s+Function\s*\(\s*\w[^)]*\)""", 0.93, "A function is built from a variable.", ("function",)),
        Pattern("xss-settimeout-string", r"""(?:setTimeout|setInterval)\s*\(\s*\w[^,)]+,""", 0.78, "A timer may evaluate a string.", ("settimeout", "setinterval")),
        Pattern("xss-react-dangerous", r"""dangerouslySetInnerHTML\s*=\s*\{\s*\{""", 0.82, "React is told to set raw HTML.", ("dangerouslysetinnerhtml",)),
        Pattern("xss-angular-bypass-trust", r"""bypassSecurityTrust(?:Html|Script|Style|Url|ResourceUrl)\s*\(\s*\w""", 0.94, "Angular's sanitizer is bypassed.", ("bypasssecuritytrust",)),
        Pattern("xss-angular-innerhtml-binding", r"""\[innerHTML\]\s*=\s*["'`][^"'`]*["'`]""", 0.79, "An Angular template binds innerHTML.", ("[innerhtml]",)),
        Pattern("xss-vue-html", r"""v-html\s*=\s*["'`][^"'`]*["'`]""", 0.86, "A Vue template renders raw HTML.", ("v-html",)),
        Pattern("xss-svelte-html", r"""\{@html\s+\w""", 0.88, "A Svelte template renders raw HTML.", ("{@html",)),
        Pattern("xss-jquery-html", r"""\$\([^)]+\)\.html\s*\(\s*\w""", 0.87, "jQuery html() is given a variable.", (".html",)),
        Pattern("xss-jquery-append", r"""\$\([^)]+\)\.(?:append|prepend|after|before)\s*\(\s*\w""", 0.83, "jQuery inserts a variable.", (".append", ".prepend", ".after", ".before")),
        Pattern("xss-location-assign", r"""(?:window\.)?location\s*(?:\.href|\.assign|\.replace)\s*=\s*\w""", 0.80, "The location is set to a variable.", ("location",)),
        Pattern("xss-script-src", r"""\.src\s*=\s*(?!["'`]https?://[^"'`]*["'`])\w""", 0.76, "A src is set to a variable.", (".src",), (), r"""\.src\s*=\s*\w"""),
        Pattern("xss-postmessage-sink", r"""addEventListener\s*\(\s*["'`]message["'`][\s\S]{0,200}innerHTML\s*=""", 0.88, "A message is written to innerHTML.", ("addeventlistener",)),
    ),
    False, 200, 0.015, "any",
)

#: Own design: no rule of this kind could be read anywhere.
SECRET = Rule(
    "LINT-SECRET-001", "Hardcoded secret", "HARDCODED_SECRET", (),
    (
        Pattern("secret-aws-key", r"""\bAKIA[A-Z0-9]{16}\b""", 0.96, "An access key stands in the text.", ("akia",)),
        Pattern("secret-assignment", r"""(?i)\b(?:password|passwd|pwd|secret|token|api_?key)\s*[=:]\s*["']?[A-Za-z0-9_/+.-]{8,}["']?""", 0.90, "A credential is assigned a constant.", ("password", "passwd", "pwd", "secret", "token", "api")),
        Pattern("secret-private-key", r"""-----BEGIN [A-Z ]*PRIVATE KEY-----""", 0.99, "A private key stands in the text.", ("private key",)),
    ),
    False, 0, 0.0, "none", "CRITICAL",
)

RULES = (SQL, XSS, SECRET)
