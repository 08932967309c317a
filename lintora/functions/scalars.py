"""Column helpers; every one stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")
UNKNOWN_DEVELOPER = "DEV_UNKNOWN"


def js_round(x: Column, digits: int = 0) -> Column:
    """Rounds halves up, towards plus infinity."""
    scale = 10**digits
    rounded = F.floor(x * F.lit(float(scale)) + F.lit(0.5))
    return rounded.cast("double") / F.lit(float(scale)) if digits else rounded.cast("long")


def snippet_hash(text: Column) -> Column:
    """h = 5381; for each UTF-16 code unit h = 33 h xor unit, modulo 2^32; eight hex digits."""
    hexed = F.hex(F.encode(text, "UTF-16BE"))
    units = F.transform(F.regexp_extract_all(hexed, F.lit(".{4}"), 0), lambda u: F.conv(u, 16, 10).cast("long"))
    folded = F.aggregate(units, F.lit(5381).cast("long"), lambda h, c: (h * 33).bitwiseAND(4294967295).bitwiseXOR(c))
    return F.lpad(F.lower(F.hex(folded)), 8, "0")


def severity_rank(severity: Column) -> Column:
    rank = F.lit(99)
    for i, name in reversed(list(enumerate(SEVERITIES))):
        rank = F.when(severity == name, i).otherwise(rank)
    return rank


def basename(path: Column) -> Column:
    """The last part of a path, without trailing slashes."""
    return F.substring_index(F.regexp_replace(path, "/+$", ""), "/", -1)


def last_part(path: Column) -> Column:
    """What follows the last slash: empty if the path ends with one."""
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    return F.lower(F.substring_index(path, ".", -1))


def label(name: Column) -> Column:
    return F.replace(name, F.lit("_"), F.lit(" "))


def truncated(text: Column, limit: int, mark: str) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit(mark))).otherwise(text)


def html_escaped(text: Column, quotes: bool = True) -> Column:
    marks = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")] + [('"', "&quot;")] * quotes
    for mark, entity in marks:
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return text


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def percent(confidence: Column) -> Column:
    return js_round(confidence * 100)


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def display_date(ts: Column) -> Column:
    """dd Mon yyyy, HH:mm in English; null dates read Invalid Date."""
    return F.coalesce(F.date_format(ts, "dd MMM yyyy, HH:mm"), F.lit("Invalid Date"))


def minutes_between(start: Column, end: Column, now: Column) -> Column:
    """Whole minutes, rounded; an open interval ends now."""
    return js_round((F.unix_millis(F.coalesce(end, now)) - F.unix_millis(start)) / 60000)


def initial(name: Column) -> Column:
    return F.upper(F.left(name, F.lit(1)))


def developer_identity(label: Column, setting: Column) -> Column:
    """The external label, else the configured id, else a fixed name."""
    return F.coalesce(label, setting, F.lit(UNKNOWN_DEVELOPER))


def finding_key(file_name: Column, line: Column, kind: Column, rule: Column) -> Column:
    return F.sha2(F.concat_ws("|", file_name, line.cast("string"), kind, rule), 256)


def prefixed_id(prefix: str | Column, *of: Column) -> Column:
    """An id such as proj-1a2b3c4d5e6f that follows from what it is of, so that
    running again gives the same and two in the same moment differ."""
    return F.concat(prefix if isinstance(prefix, Column) else F.lit(prefix), F.left(F.sha2(F.concat_ws("|", *of), 256), F.lit(12)))


def user_id(role: Column, name: Column) -> Column:
    return prefixed_id(F.concat(F.lit("user-"), F.left(role, F.lit(3)), F.lit("-")), name)


def diagnostic_level(severity: Column) -> Column:
    return F.when(severity.isin("CRITICAL", "HIGH"), "Error").when(severity == "MEDIUM", "Warning").when(severity == "LOW", "Information").otherwise("Hint")


def severity_icon(severity: Column) -> Column:
    icons = {"CRITICAL": "🚨", "HIGH": "🔴", "MEDIUM": "🟠", "LOW": "🟡"}
    out = F.lit("ℹ️")
    for name, icon in icons.items():
        out = F.when(severity == name, icon).otherwise(out)
    return out


# Colours by severity and by score.
SEVERITY_COLOURS = {"CRITICAL": "#f47067", "HIGH": "#e09b3d", "MEDIUM": "#d29922"}
LOW_COLOUR = "#3fb950"


def severity_colour(severity: Column) -> Column:
    out = F.lit(LOW_COLOUR)
    for name, colour in SEVERITY_COLOURS.items():
        out = F.when(severity == name, colour).otherwise(out)
    return out


def score_colour(score: Column) -> Column:
    return F.when(score >= 80, LOW_COLOUR).when(score >= 50, SEVERITY_COLOURS["MEDIUM"]).otherwise(SEVERITY_COLOURS["CRITICAL"])


def owasp_slug(kind: Column) -> Column:
    slugs = {"SQL_INJECTION": "SQL_Injection", "XSS": "Cross_Site_Scripting_(XSS)", "HARDCODED_SECRET": "Use_of_Hard-coded_Cryptographic_Key", "COMMAND_INJECTION": "Command_Injection", "PATH_TRAVERSAL": "Path_Traversal"}
    out = kind
    for name, slug in slugs.items():
        out = F.when(kind == name, slug).otherwise(out)
    return out


def escalation_prefix(level: Column) -> Column:
    return F.when(level == "CRITICAL_PATTERN", "Critical pattern: ").when(level == "PERSISTENT", "Persistent: ").when(level == "REPEATED", "Repeated: ").otherwise("")


# ---- scores: the three formulas differ on purpose ----


def _weighted(weights: list[tuple[Column, int]]) -> Column:
    score = F.lit(100)
    for count, weight in weights:
        score = score - count * weight
    return F.greatest(F.lit(0), score)


def shift_score(critical: Column, high: Column, medium: Column, low: Column) -> Column:
    """Of a session; INFO costs nothing."""
    return F.least(F.lit(100), _weighted([(critical, 20), (high, 10), (medium, 4), (low, 1)]))


def dashboard_score(critical: Column, high: Column, medium: Column, low: Column) -> Column:
    """Of a dashboard. For developer statistics, `low` counts INFO too."""
    return _weighted([(critical, 25), (high, 10), (medium, 5), (low, 2)])


def trend(score: Column) -> Column:
    return F.when(score >= 80, "improving").when(score >= 50, "stable").otherwise("declining")
