"""The adapters of lintora.sources.tables as DuckDB common table expressions."""

from __future__ import annotations

from lintora.sources.tables import CORPUS, VULNERABILITY_TYPES


def quoted(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def _banded(value: str, bands) -> str:
    names = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
    return "CASE " + " ".join(f"WHEN {value} >= {b} THEN '{n}'" for n, b in zip(names, bands)) + " ELSE 'INFO' END"


TYPES = quoted(VULNERABILITY_TYPES)
KIND = "CASE event_type WHEN 'purchase' THEN 'FIXED' WHEN 'error' THEN 'IGNORED' WHEN 'signup' THEN 'FALSE_POSITIVE' ELSE 'DETECTED' END"
FINDINGS = f"""findings AS (
  SELECT event_id AS seq, ts, user_id AS developer_id, CAST(json_extract_string(props, '$.k') AS INTEGER) + 1 AS line_number, {TYPES}[event_id % 10 + 1] AS vuln_type,
    'RULE-' || (event_id % 10) AS rule_id, {_banded("value", (150, 80, 40, 10))} AS severity, floor((event_id % 40 + 60) / 100 * 100 + 0.5) / 100 AS confidence,
    'src/file' || (event_id % 20) || '.ts' AS file_name, 'snippet ' || (event_id % 500) AS code_snippet, {KIND} AS kind,
    CASE event_type WHEN 'view' THEN 'EXPLANATION_VIEWED' ELSE {KIND} END AS action
  FROM events)"""
SESSIONS = """sessions AS (
  SELECT o_orderkey AS session_id, o_custkey AS developer_id, o_custkey % 50 AS shift_id, o_orderdate AS started_at,
    CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + to_minutes(CAST(o_orderkey % 600 AS BIGINT)) END AS ended_at
  FROM orders)"""
SESSION_FINDINGS = f"""session_findings AS (
  SELECT l_orderkey AS session_id, l_linenumber AS position, l_partkey AS part, l_suppkey AS supplier, {TYPES}[l_partkey % 10 + 1] AS vuln_type,
    {_banded("l_quantity", (48, 40, 25, 10))} AS severity, 'src/file' || (l_suppkey % 20) || '.ts' AS file_name
  FROM lineitem)"""
USERS = "users AS (SELECT c_custkey AS user_id, c_name AS username, CASE c_custkey % 50 WHEN 0 THEN 'supervisor' WHEN 1 THEN 'administrator' ELSE 'developer' END AS role FROM customer)"
PROJECTS = "projects AS (SELECT n_nationkey AS project_id, n_name AS name, n_regionkey AS supervisor_id, CASE WHEN n_nationkey % 4 = 0 THEN 'archived' ELSE 'active' END AS status FROM nation)"
SHIFTS = """shifts AS (
  SELECT s_suppkey AS shift_id, s_nationkey AS project_id, s_name AS name, ['scheduled', 'active', 'completed'][s_suppkey % 3 + 1] AS status,
    list_transform(range(1, s_suppkey % 4 + 1), lambda i: s_suppkey * 10 + i) AS assigned
  FROM supplier)"""
DOCS = f"""docs AS (
  SELECT 'src/part' || p_partkey || '.txt' AS file_name, {quoted(lang for lang, _ in CORPUS)}[p_partkey % {len(CORPUS)} + 1] AS language_id,
    replace({quoted(t.format(v="@@") for _, t in CORPUS)}[p_partkey % {len(CORPUS)} + 1], '@@', 'userInput' || p_partkey) AS text
  FROM part)"""
_N = lambda s: f"count(*) FILTER (severity = '{s}')"
COUNTS = ", ".join(f"{_N(s)} AS n_{s.lower()}" for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW"))
STATS = f"""stats AS (
  SELECT *, greatest(0, 100 - n_critical * 25 - n_high * 10 - n_medium * 5 - n_low * 2) AS score FROM (
    SELECT developer_id, count(*) AS total, {_N("CRITICAL")} AS n_critical, {_N("HIGH")} AS n_high, {_N("MEDIUM")} AS n_medium,
      count(*) FILTER (severity NOT IN ('CRITICAL', 'HIGH', 'MEDIUM')) AS n_low FROM findings GROUP BY developer_id))"""
SUMMARIES = f"""counts AS (
  SELECT session_id, count(*) AS total, {COUNTS}, {', '.join(f"count(*) FILTER (vuln_type = '{t}') AS t_{t.lower()}" for t in VULNERABILITY_TYPES)}
  FROM session_findings GROUP BY session_id
), files AS (
  SELECT session_id, list(file ORDER BY seen) AS files FROM (
    SELECT session_id, string_split(file_name, '/')[-1] AS file, min((position, part, supplier)) AS seen FROM session_findings GROUP BY ALL) GROUP BY session_id
), summaries AS (
  SELECT *, CASE WHEN score >= 80 THEN 'improving' WHEN score >= 50 THEN 'stable' ELSE 'declining' END AS trend FROM (
    SELECT s.*, coalesce(total, 0) AS total, coalesce(n_critical, 0) AS n_critical, coalesce(n_high, 0) AS n_high, coalesce(n_medium, 0) AS n_medium, coalesce(n_low, 0) AS n_low,
      coalesce(total - n_critical - n_high - n_medium - n_low, 0) AS n_info, {', '.join(f"coalesce(t_{t.lower()}, 0) AS t_{t.lower()}" for t in VULNERABILITY_TYPES)}, coalesce(files, []) AS files,
      concat_ws(',', {', '.join(f"CASE WHEN t_{t.lower()} > 0 THEN '{t}:' || t_{t.lower()} END" for t in VULNERABILITY_TYPES)}) AS by_type,
      CAST(floor((epoch_ms(coalesce(ended_at, TIMESTAMP '2025-01-01')) - epoch_ms(started_at)) / 60000 + 0.5) AS BIGINT) AS minutes,
      least(100, greatest(0, 100 - coalesce(n_critical, 0) * 20 - coalesce(n_high, 0) * 10 - coalesce(n_medium, 0) * 4 - coalesce(n_low, 0))) AS score
    FROM sessions s LEFT JOIN counts USING (session_id) LEFT JOIN files USING (session_id)))"""
BY_TYPE = """by_type AS (
  SELECT developer_id, vuln_type, count(*) FILTER (kind = 'DETECTED') AS detections, count(*) FILTER (kind = 'FIXED') AS fixes, count(*) FILTER (kind = 'IGNORED') AS ignored,
    count(*) FILTER (kind = 'FALSE_POSITIVE') AS false_positives, min(ts) AS first_seen, max(ts) AS last_seen FROM findings GROUP BY ALL)"""
SUPPRESSED = "suppressed AS (SELECT developer_id, vuln_type, count(*) AS false_positives FROM findings WHERE kind = 'FALSE_POSITIVE' GROUP BY ALL HAVING count(*) >= 3)"
ADJUSTED = """adjusted AS (
  SELECT developer_id, vuln_type, rule_id, list_reduce(list_prepend(0.80::DOUBLE, steps), lambda c, d: floor(greatest(0.10::DOUBLE, least(0.99::DOUBLE, c + d)) * 100 + 0.5) / 100) AS adjusted_confidence, len(steps) AS n_actions FROM (
    SELECT developer_id, vuln_type, rule_id, list(CASE kind WHEN 'FIXED' THEN 0.02::DOUBLE WHEN 'IGNORED' THEN -0.01::DOUBLE ELSE -0.08::DOUBLE END ORDER BY ts, seq) AS steps
    FROM findings WHERE kind <> 'DETECTED' GROUP BY ALL))"""
#: FNV-like hash of FN-01 for ASCII text.
HASH = "lpad(printf('%x', list_reduce(list_prepend(5381::UBIGINT, list_transform(string_split(code_snippet, ''), lambda c: ascii(c)::UBIGINT)), lambda h, c: xor((h * 33) % 4294967296, c))), 8, '0')"


def hashes(window: int) -> str:
    return f"""called AS (
  SELECT developer_id, list([{HASH}] ORDER BY ts, seq) AS called FROM findings WHERE kind = 'FALSE_POSITIVE' GROUP BY developer_id
), hashes AS (
  SELECT developer_id, list_reduce(list_prepend([]::VARCHAR[], called), lambda held, x: CASE WHEN list_contains(held, x[1]) THEN held ELSE list_concat(held, x)[-{window}:] END) AS hashes FROM called)"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
