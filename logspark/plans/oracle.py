"""The registered queries in DuckDB's SQL, written apart from the Spark operators."""

from __future__ import annotations

from collections.abc import Mapping

from ..functions import prompts as P
from ..functions import text as X
from ..operators.exclude import LineFilter
from . import adapters as A
from . import catalog as Q

NOW = f"TIMESTAMP '{A.NOW}'"
ORACLE: dict[str, str] = {}


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _with(*ctes: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + "\n"


# ---- inputs ---------------------------------------------------------------------------------

EVENT_LOGS = """logs AS (
  SELECT CAST(user_id AS VARCHAR) AS container_id, 'app/user-' || user_id AS name,
         CAST(0 AS BIGINT) AS segment, event_id AS seq,
         strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS ts_raw, ts, 'stdout' AS stream,
         event_type AS message
  FROM events)"""
ORDER_LOGS = """logs AS (
  SELECT o_orderpriority AS container_id, o_orderpriority AS name, CAST(0 AS BIGINT) AS segment,
         o_orderkey AS seq, '' AS ts_raw, o_orderdate AS ts, 'stdout' AS stream,
         o_orderstatus AS message
  FROM orders)"""
DOC_LINES = """doc_lines AS (
  SELECT source AS container_id, source AS name, doc_id // 4096 AS segment,
         (doc_id % 4096) * 2147483648 + no AS seq, value
  FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS value,
               generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no
        FROM documents))"""
DOC_LOGS = DOC_LINES + """,
logs AS (
  SELECT container_id, name, segment, seq, '' AS ts_raw, CAST(NULL AS TIMESTAMP) AS ts,
         'stdout' AS stream, value AS message
  FROM doc_lines)"""
CONVERSATION_LOGS = """logs AS (
  SELECT CAST(conv_id AS VARCHAR) AS container_id, 'conv-' || conv_id AS name,
         CAST(0 AS BIGINT) AS segment, turn AS seq, '' AS ts_raw, CAST(NULL AS TIMESTAMP) AS ts,
         role AS stream, text AS message
  FROM conversations)"""
STATE = """state AS (
  SELECT CAST(user_id AS VARCHAR) AS container_id, 'app/user-' || user_id AS name,
         max(ts) FILTER (event_type = 'signup') AS last_scan, '' AS log_cursor
  FROM events GROUP BY user_id
  HAVING max(ts) FILTER (event_type = 'signup') IS NOT NULL
         AND arg_max(event_type, event_id) <> 'error')"""
LIVE = f"""live AS (
  SELECT DISTINCT CAST(user_id AS VARCHAR) AS container_id FROM events
  WHERE ts >= TIMESTAMP '{A.LIVE_SINCE}')"""
STORES = ",\n".join(f"""{store} AS (
  SELECT 'app_user-' || user_id AS name, event_id AS entry FROM events
  WHERE event_type IN ({kinds}))""" for store, kinds in (
    ("kb", "'error', 'signup'"), ("reports", "'purchase', 'view'"), ("llm_logs", "'click'")))
IGNORE = """ignored AS (
  SELECT 'app_user-' || user_id AS file_stem,
         'Skip routine ' || kind || ' entries.' AS instructions
  FROM (SELECT user_id, arg_max(event_type, event_id) AS last,
               arg_max(event_type, (value, event_id)) AS kind
        FROM events GROUP BY user_id)
  WHERE last <> 'click')"""
ANALYSES = """analyses AS (
  SELECT 'app/user-' || user_id AS name,
         CASE kind
           WHEN 'error' THEN 'Report' || chr(10) || '  **Summary**: ' || n || ' entries, bad end '
             || chr(10) || '**Errors**: ' || buys || ' orders lost' || chr(10) || chr(10)
             || '**Warnings**: none' || chr(10)
           WHEN 'purchase' THEN 'Warning: ' || buys || ' purchases among ' || n
             || ' entries of this container, see below' || chr(10) || 'nothing else'
           WHEN 'click' THEN '**Summary**: quiet, ' || n || ' entries'
           WHEN 'view' THEN 'Viewed ' || n || ' pages'
           ELSE 'CRITICAL signup spree after ' || n || ' entries' END AS analysis
  FROM (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS buys,
               arg_max(event_type, event_id) AS kind
        FROM events GROUP BY user_id))"""
HISTORY = """history AS (
  SELECT 'app/user-' || user_id AS name,
         CASE WHEN event_type = 'view' THEN 'unknown'
              ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS scan_ts_raw,
         CASE WHEN event_type <> 'view' THEN date_trunc('second', ts) END AS scan_ts,
         CASE event_type WHEN 'error' THEN '🔴 Issues Detected' WHEN 'purchase' THEN '🟡 Warnings'
                         ELSE '🟢 Healthy' END AS status, 'entry ' || event_id AS analysis
  FROM events)"""

# ---- steps ----------------------------------------------------------------------------------

DEDUP = """marked AS (
  SELECT *, CASE WHEN message IS NOT DISTINCT FROM lag(message) OVER w
                  AND lag(seq) OVER w IS NOT NULL THEN 0 ELSE 1 END AS starts
  FROM logs WINDOW w AS (PARTITION BY container_id ORDER BY segment, seq)),
runs AS (
  SELECT *, sum(starts) OVER (PARTITION BY container_id ORDER BY segment, seq
                              ROWS UNBOUNDED PRECEDING) AS run
  FROM marked),
sized AS (
  SELECT *, count(*) OVER (PARTITION BY container_id, run) AS n,
         row_number() OVER (PARTITION BY container_id, run ORDER BY segment, seq) AS pos
  FROM runs),
dedup AS (
  SELECT container_id, name, segment, seq, ts_raw, ts, stream,
         CASE WHEN n >= 3 THEN '[REPEAT x' || n || '] ' || message ELSE message END AS message,
         CASE WHEN n >= 3 THEN n ELSE 1 END AS run_len
  FROM sized WHERE n < 3 OR pos = 1)"""


def flagged(filters: Mapping[str, LineFilter]) -> str:
    cases = " ".join(
        f"WHEN {_text(name)} THEN " + " OR ".join(
            f"regexp_matches(message, {_text(p)})" for p in rule.patterns)
        for name, rule in filters.items() if rule.enabled and rule.patterns)
    case = f"CASE name {cases} ELSE false END" if cases else "false"
    return f"flagged AS (SELECT *, {case} AS excluded FROM dedup)"


KEPT = """kept AS (
  SELECT *, row_number() OVER (PARTITION BY container_id ORDER BY segment, seq) AS rn,
         CASE WHEN ts_raw = '' THEN message || chr(10)
              ELSE '[' || ts_raw || '] ' || message || chr(10) END AS line,
         CAST(floor(strlen('[' || ts_raw || '] ' || message || chr(10)) * 0.25) AS BIGINT) AS tokens
  FROM flagged WHERE NOT excluded)"""


def packed(lines: str, limit: str, out: str) -> str:
    """Greedy packing of ``lines(container_id, rn, tokens)``, all containers in step."""
    return f"""{out}_walk AS (
  SELECT container_id, rn, tokens AS open, CAST(0 AS BIGINT) AS chunk_index
  FROM {lines} WHERE rn = 1
  UNION ALL
  SELECT k.container_id, k.rn,
         CASE WHEN w.open + k.tokens > {limit} THEN k.tokens ELSE w.open + k.tokens END,
         CASE WHEN w.open + k.tokens > {limit} THEN w.chunk_index + 1 ELSE w.chunk_index END
  FROM {out}_walk w JOIN {lines} k ON k.container_id = w.container_id AND k.rn = w.rn + 1),
{out} AS (
  SELECT k.container_id, k.name, w.chunk_index,
         1 + max(w.chunk_index) OVER (PARTITION BY k.container_id) AS chunk_total,
         k.tokens, k.line, k.rn
  FROM {lines} k JOIN {out}_walk w ON k.container_id = w.container_id AND k.rn = w.rn)"""


CHUNK_ROWS = """SELECT container_id, name, chunk_index, chunk_total,
       CAST(sum(tokens) AS BIGINT) AS token_count, count(*) AS n_logs,
       string_agg(line, '' ORDER BY rn) AS text
FROM packed GROUP BY container_id, name, chunk_index, chunk_total"""


def tokens(expr: str) -> str:
    return f"CAST(floor(strlen({expr}) * 0.25) AS BIGINT)"


def filled(template: str, **fields: str) -> str:
    """A prompt template as a SQL expression."""
    sql = _text(template)
    for name, value in fields.items():
        sql = sql.replace("{{." + name + "}}", f"' || {value} || '")
    return f"({sql})"


def system(instructions: str) -> str:
    return (f"({_text(P.SYSTEM)} || CASE WHEN {instructions} = '' THEN '' ELSE "
            f"{_text(P.INSTRUCTIONS_HEADING)} || {instructions} END)")


ALL_LINES = [EVENT_LOGS, DEDUP]


def budget_ctes(lines: list[str] = ALL_LINES) -> list[str]:
    base = filled(P.ANALYSIS, ContainerName="name", Logs="''", LogCount="processed_count")
    return [*lines, flagged(A.EVENT_FILTERS), IGNORE, KEPT, f"""stats AS (
  SELECT f.container_id, f.name, CAST(sum(run_len) AS BIGINT) AS original_count,
         count(*) AS lines_total, count(*) FILTER (excluded) AS lines_filtered,
         count(*) FILTER (NOT excluded) AS lines_kept, count(*) FILTER (NOT excluded)
           AS processed_count, count(*) < sum(run_len) AS deduplicated
  FROM flagged f GROUP BY f.container_id, f.name),
texts AS (SELECT container_id, string_agg(line, '' ORDER BY rn) AS text FROM kept
          GROUP BY container_id),
priced AS (
  SELECT s.*, coalesce(i.instructions, '') AS instructions, coalesce(t.text, '') AS text
  FROM stats s LEFT JOIN ignored i ON replace(s.name, '/', '_') = i.file_stem
       LEFT JOIN texts t ON t.container_id = s.container_id),
sizes AS (
  SELECT *, {tokens(system('instructions'))} + 4 AS system_tokens, {tokens(base)} AS base_tokens,
         {tokens('text')} AS logs_tokens FROM priced),
budgets AS (
  SELECT *, system_tokens + base_tokens + logs_tokens AS total_tokens,
         CASE WHEN system_tokens + base_tokens + logs_tokens + 4000 <= {Q.MAX_TOKENS}
                THEN 'direct' WHEN lines_kept = 0 THEN 'empty' ELSE 'chunked' END AS strategy,
         CASE WHEN system_tokens + base_tokens + logs_tokens + 4000 > {Q.MAX_TOKENS}
              THEN CAST(trunc(({Q.MAX_TOKENS} - 4000 - system_tokens) / 2) AS BIGINT) END
           AS chunk_limit
  FROM sizes)"""]


def request_ctes(lines: list[str] = ALL_LINES) -> list[str]:
    """Budgets, chunks of the chunked containers, first requests and their answers."""
    analysis = filled(P.ANALYSIS, ContainerName="name", Logs="text", LogCount="processed_count")
    chunk = filled(P.CHUNK_SUMMARY, ContainerName="c.name", ChunkNum="(chunk_index + 1)",
                   TotalChunks="chunk_total", Logs="c.text")
    return budget_ctes(lines) + [
        """to_pack AS (
  SELECT k.container_id, k.name, k.rn, k.tokens, k.line, b.chunk_limit
  FROM kept k JOIN budgets b ON b.container_id = k.container_id AND b.strategy = 'chunked')""",
        packed("to_pack", "k.chunk_limit", "packed"),
        f"chunk_rows AS ({CHUNK_ROWS})",
        f"""requests AS (
  SELECT 'scan/' || container_id || '/direct/0' AS request_id, container_id, name,
         'direct' AS kind, CAST(0 AS BIGINT) AS chunk_index, CAST(1 AS BIGINT) AS chunk_total,
         {system('instructions')} AS system_text, {analysis} AS user_text,
         CAST(4000 AS BIGINT) AS max_tokens,
         lines_kept AS n_logs, text AS logs_text,
         (SELECT coalesce(sum(tokens), 0) FROM kept k WHERE k.container_id = b.container_id)
           AS token_count
  FROM budgets b WHERE strategy = 'direct'
  UNION ALL
  SELECT 'scan/' || c.container_id || '/chunk/' || chunk_index, c.container_id, c.name, 'chunk',
         chunk_index, chunk_total, {system('b.instructions')}, {chunk}, 2000, n_logs, c.text,
         token_count
  FROM chunk_rows c JOIN budgets b ON b.container_id = c.container_id),
answers AS (
  SELECT *, CASE WHEN n_logs <> 1 THEN '**Summary**: ' || n_logs || ' lines, ' || token_count
                 || ' tokens' END AS content, token_count + n_logs AS usage_tokens FROM requests),
summaries AS (
  SELECT container_id, name, chunk_index, chunk_total, content FROM answers a
  WHERE kind = 'chunk' AND NOT EXISTS (
    SELECT 1 FROM answers o WHERE o.container_id = a.container_id AND o.content IS NULL))"""]


PARTS = ("string_agg(chr(10) || '--- Chunk ' || (chunk_index + 1) || ' Summary ---' || chr(10)"
         " || content || chr(10), '' ORDER BY chunk_index)")


def synthesis_ctes(lines: list[str] = ALL_LINES) -> list[str]:
    user = filled(P.SYNTHESIS, ContainerName="s.name", Summaries="s.parts")
    return request_ctes(lines) + [f"""synthesis AS (
  SELECT 'scan/' || s.container_id || '/synthesis/0' AS request_id, s.container_id, s.name,
         'synthesis' AS kind, CAST(0 AS BIGINT) AS chunk_index, CAST(1 AS BIGINT) AS chunk_total,
         {system('b.instructions')} AS system_text, {user} AS user_text,
         CAST(4000 AS BIGINT) AS max_tokens
  FROM (SELECT container_id, name, {PARTS} AS parts FROM summaries GROUP BY container_id, name) s
       JOIN budgets b ON b.container_id = s.container_id)""",
        """final AS (
  SELECT request_id, container_id, name, user_text,
         '**Summary**: all of ' || length(user_text) || ' characters' AS content,
         length(user_text) + 7 AS usage_tokens
  FROM synthesis)"""]


def results_ctes(lines: list[str] = ALL_LINES) -> list[str]:
    return synthesis_ctes(lines) + [f"""spent AS (
  SELECT container_id,
         CASE WHEN kind = 'direct' THEN usage_tokens
              ELSE {tokens('logs_text')} + {tokens('content')} END AS spent, 1 AS used,
         CASE WHEN kind = 'direct' THEN content END AS analysis, content IS NULL AS failed
  FROM answers
  UNION ALL SELECT container_id, usage_tokens, 0, content, false FROM final),
results AS (
  SELECT b.container_id, b.name, max(s.analysis) AS analysis,
         CAST(sum(s.spent) AS BIGINT) AS tokens_used, CAST(sum(s.used) AS BIGINT) AS chunks_used,
         b.deduplicated, b.original_count, b.processed_count, b.lines_total, b.lines_filtered,
         b.lines_kept
  FROM budgets b JOIN spent s ON s.container_id = b.container_id
  GROUP BY ALL HAVING NOT bool_or(s.failed))"""]


HAS_ISSUES = "(contains(lower(analysis), 'critical') OR contains(lower(analysis), 'error'))"
HAS_WARNINGS = "contains(lower(analysis), 'warning')"
ALERT = "(" + " OR ".join(f"contains(lower(analysis), '{w}')" for w in (
    "error", "failed", "exception", "critical", "warning", "issue", "problem", "alert", "urgent",
    "attention")) + ")"
DASHBOARD = (f"CASE WHEN {HAS_ISSUES} THEN '🔴 Issues' WHEN {HAS_WARNINGS} THEN '🟡 Warning' "
             "ELSE '🟢 OK' END")
SERVICE = (f"CASE WHEN {HAS_ISSUES} THEN '🔴 Issues Detected' WHEN {HAS_WARNINGS} "
           "THEN '🟡 Warnings' ELSE '🟢 Healthy' END")
SUMMARY_LINE = ("list_filter(string_split(analysis, chr(10)), "
                "lambda l: contains(l, '**Summary**'))[1]")
FIRST_LINE = "string_split(analysis, chr(10))[1]"
SUMMARY = (f"CASE WHEN {SUMMARY_LINE} IS NOT NULL THEN trim(replace({SUMMARY_LINE}, "
           f"'**Summary**:', '')) WHEN length({FIRST_LINE}) > 50 "
           f"THEN left({FIRST_LINE}, 50) || '...' ELSE {FIRST_LINE} END")
ERRORS = ("CASE WHEN contains(analysis, '**Errors**') THEN rtrim(string_split("
          "substr(analysis, strpos(analysis, '**Errors**')), '**Warnings**')[1], "
          "' ' || chr(10)) ELSE 'Issues detected but could not parse specific errors.' END")
HEALTH = (f"CASE WHEN count(*) FILTER ({HAS_ISSUES}) > 0 THEN '⚠️ ' || "
          f"count(*) FILTER ({HAS_ISSUES}) || ' Service(s) Reporting Issues' "
          "ELSE '🟢 All Systems Operational' END")
STATE_HIT = r"(regexp_matches(name, 'user-1.*|^2\d$') OR regexp_matches(container_id, 'user-1.*|^2\d$'))"

# ---- queries --------------------------------------------------------------------------------

NEW_LINES = f"""new_lines AS (
  SELECT l.* FROM logs l LEFT JOIN state s ON s.container_id = l.container_id
  WHERE l.ts >= coalesce(s.last_scan, {NOW} - INTERVAL 1 HOUR))"""

ORACLE["q01_incremental_scan"] = _with(EVENT_LOGS, STATE, NEW_LINES) + (
    "SELECT container_id, name, seq, ts_raw, ts, message FROM new_lines")
RAW_EVENTS = """
SELECT CAST(user_id AS VARCHAR) AS container_id, event_id AS seq,
  CASE event_type
    WHEN 'click' THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ')
    WHEN 'view' THEN strftime(ts + INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S.%f') || '+02:00'
    WHEN 'error' THEN strftime(ts - INTERVAL 5 HOUR, '%Y-%m-%dT%H:%M:%S.%f') || '789-05:00'
    WHEN 'signup' THEN '' ELSE strftime(ts, '%Y/%m/%d') END AS ts_raw,
  CASE event_type WHEN 'click' THEN date_trunc('second', ts) WHEN 'view' THEN ts
    WHEN 'error' THEN ts END AS ts,
  CASE event_type WHEN 'click' THEN 'click' WHEN 'view' THEN 'view' WHEN 'error' THEN ' error'
    WHEN 'signup' THEN 'signup' ELSE props END AS message
FROM events"""
ORACLE["q01b_untimed_lines"] = _with(STATE, f"raw AS ({RAW_EVENTS})", f"""placed AS (
  SELECT r.*, s.last_scan, last_value(r.ts IGNORE NULLS) OVER (
           PARTITION BY r.container_id ORDER BY r.seq ROWS UNBOUNDED PRECEDING) AS place
  FROM raw r LEFT JOIN state s ON s.container_id = r.container_id
  WHERE r.ts IS NULL OR r.ts >= least((SELECT min(last_scan) FROM state), {NOW} - INTERVAL 1 HOUR))""") + f"""
SELECT container_id, seq, ts_raw, ts, message FROM placed
WHERE CASE WHEN place IS NULL THEN last_scan IS NULL
           ELSE place >= coalesce(last_scan, {NOW} - INTERVAL 1 HOUR) END"""
ORACLE["q02_lookback_scan"] = _with(EVENT_LOGS) + (
    f"SELECT container_id, name, seq, ts, message FROM logs WHERE ts >= {NOW} - INTERVAL 7 DAY")
ORACLE["q02b_log_frames"] = _with(EVENT_LOGS) + f"""
SELECT message AS container_id, ts_raw, ts, stream,
       CASE WHEN message = 'error' THEN 'stderr' ELSE 'stdout' END AS stream_decoded,
       name AS message, lag(name) OVER (PARTITION BY message ORDER BY seq) AS message_before
FROM logs WHERE ts >= {NOW} - INTERVAL {Q.LOOKBACK.days} DAY"""
ORACLE["q03_parse_lines"] = _with(DOC_LINES) + r"""
SELECT container_id, segment, seq,
       CASE WHEN contains(value, ' ') THEN split_part(value, ' ', 1) ELSE '' END AS ts_raw,
       try_cast(CASE WHEN regexp_matches(value,
         '^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z ') THEN split_part(value, ' ', 1) END
         AS TIMESTAMP) AS ts,
       'stdout' AS stream,
       CASE WHEN contains(value, ' ') THEN substr(value, strpos(value, ' ') + 1)
            ELSE value END AS message
FROM doc_lines"""
ORACLE["q03b_parse_timestamps"] = RAW_EVENTS
ORACLE["q03c_frame_headers"] = _with(EVENT_LOGS) + """
SELECT container_id, seq, stream, CASE message WHEN 'click' THEN 'stdout' WHEN 'error' THEN 'stderr' END
       AS stream_decoded, ts, message FROM logs"""
ORACLE["q03d_log_files"] = _with(f"raw AS ({RAW_EVENTS})") + """
SELECT container_id, ts_raw, ts, message,
       lag(message) OVER (PARTITION BY container_id ORDER BY seq) AS message_before FROM raw"""
ORACLE["q04_run_dedup"] = _with(EVENT_LOGS, DEDUP) + (
    "SELECT container_id, name, seq, ts_raw, ts, stream, message, run_len FROM dedup")
ORACLE["q04b_dedup_stats"] = _with(DOC_LOGS, DEDUP) + """
SELECT container_id, name, CAST(sum(run_len) AS BIGINT) AS original_count,
       count(*) AS deduplicated_count, CAST(sum(run_len) - count(*) AS BIGINT) AS saved_count,
       count(*) < sum(run_len) AS deduplicated
FROM dedup GROUP BY container_id, name"""
ORACLE["q04c_run_dedup_orders"] = _with(ORDER_LOGS, DEDUP) + (
    "SELECT container_id, seq, ts, message, run_len FROM dedup")
ORACLE["q04d_run_dedup_documents"] = _with(DOC_LOGS, DEDUP) + (
    "SELECT container_id, segment, seq, message, run_len FROM dedup")
ORACLE["q05_regex_exclude"] = _with(EVENT_LOGS, DEDUP, flagged(A.EVENT_FILTERS)) + (
    "SELECT container_id, name, seq, message, run_len FROM flagged WHERE NOT excluded")
ORACLE["q05b_regex_exclude_documents"] = _with(DOC_LOGS, DEDUP, flagged(A.DOC_FILTERS)) + (
    "SELECT container_id, segment, seq, message, run_len FROM flagged WHERE NOT excluded")
ORACLE["q05c_exclude_by_table"] = _with(EVENT_LOGS, DEDUP, """rules AS (
  SELECT 'app/user-' || user_id AS name, arg_max(event_type, event_id) AS last,
         arg_min(event_type, event_id) AS first,
         arg_max(event_type, (value, event_id)) <> 'view' AS enabled
  FROM events GROUP BY user_id)""") + """
SELECT d.container_id, d.name, d.seq, d.message, d.run_len FROM dedup d JOIN rules r ON r.name = d.name
WHERE NOT (enabled AND (message = last
           OR regexp_matches(message, '^\\[REPEAT x[[:digit:]]+\\] ' || first)))"""
ORACLE["q05d_exclude_by_large_table"] = _with(DOC_LOGS, DEDUP, r"""picked AS (
  SELECT source AS name, regexp_extract_all(text, '[A-Za-z]{5,}') AS ws
  FROM documents WHERE source <> 'src4'),
words AS (
  SELECT DISTINCT name, lower(word) AS word
  FROM (SELECT name, unnest([ws[1], ws[-1]]) AS word FROM picked WHERE len(ws) > 0)),
hits AS (
  SELECT DISTINCT container_id, segment, seq
  FROM (SELECT container_id, segment, seq, unnest(regexp_extract_all(lower(message), '[0-9a-z_]+')) AS word
        FROM dedup) AS tokens JOIN words ON name = container_id AND words.word = tokens.word)""") + """
SELECT container_id, segment, seq, message, run_len FROM dedup
ANTI JOIN hits USING (container_id, segment, seq)"""
ORACLE["q06_filter_stats"] = _with(DOC_LOGS, DEDUP, flagged(A.DOC_FILTERS)) + """,
counted AS (
  SELECT container_id, name, count(*) AS lines_total, count(*) FILTER (excluded) AS lines_filtered,
         count(*) FILTER (NOT excluded) AS lines_kept
  FROM flagged GROUP BY container_id, name),
reduced AS (
  SELECT *, CAST(lines_total - lines_kept AS DOUBLE) / lines_total * 100.0 AS filter_reduction,
         lines_filtered * 20 AS tokens_saved
  FROM counted)
SELECT *, printf('%.1f', filter_reduction) AS reduction_text FROM reduced"""
for _name, _logs, _filters, _limit in (
        ("q07_greedy_chunks", EVENT_LOGS, A.EVENT_FILTERS, Q.EVENT_CHUNK),
        ("q07b_greedy_chunks_documents", DOC_LOGS, A.DOC_FILTERS, Q.DOC_CHUNK),
        ("q07c_greedy_chunks_conversations", CONVERSATION_LOGS, {}, Q.DOC_CHUNK)):
    ORACLE[_name] = _with(_logs, DEDUP, flagged(_filters), KEPT,
                          packed("kept", str(_limit), "packed"), recursive=True) + CHUNK_ROWS
ORACLE["q08_prompt_budget"] = _with(*budget_ctes()) + """
SELECT container_id, name, original_count, processed_count, deduplicated, system_tokens,
       base_tokens, logs_tokens, total_tokens, strategy, chunk_limit FROM budgets"""
ORACLE["q08b_fits"] = f"""
SELECT doc_id, {tokens('text')} + 4 AS tokens, {tokens('text')} <= {Q.DOC_CHUNK} AS fits FROM documents"""
ORACLE["q09_first_requests"] = _with(*request_ctes(), recursive=True) + """
SELECT request_id, container_id, name, kind, chunk_index, chunk_total, system_text, user_text,
       CAST(0.3 AS DOUBLE) AS temperature, max_tokens FROM requests"""
ORACLE["q09b_synthesis_requests"] = _with(*synthesis_ctes(), recursive=True) + """
SELECT request_id, container_id, name, kind, chunk_index, chunk_total, system_text, user_text,
       CAST(0.3 AS DOUBLE) AS temperature, max_tokens FROM synthesis"""
_PART = ("chr(10) || '--- Chunk ' || (chunk_index + 1) || ' Summary ---' || chr(10) || content"
         " || chr(10)")
ORACLE["q09c_synthesis_packed"] = _with(*request_ctes(), f"""parts AS (
  SELECT container_id, name, chunk_index + 1 AS rn, {_PART} AS line, {tokens(_PART)} AS tokens
  FROM summaries)""", packed("parts", str(Q.SYNTHESIS_TOKENS), "bundles"), recursive=True) + f"""
SELECT container_id, chunk_index, chunk_total,
       {filled(P.SYNTHESIS, ContainerName="name", Summaries="text")} AS user_text
FROM (SELECT container_id, name, chunk_index, chunk_total,
             string_agg(line, '' ORDER BY rn) AS text
      FROM bundles GROUP BY container_id, name, chunk_index, chunk_total)"""
ORACLE["q09d_results"] = _with(*results_ctes(), recursive=True) + "SELECT * FROM results"
ORACLE["q09e_failed_containers"] = _with(*request_ctes(), recursive=True) + (
    "SELECT DISTINCT container_id, name FROM answers WHERE content IS NULL")
def reduction_ctes(levels: int) -> list[str]:
    """Packs of each level: what is packed, the packs with their texts, and the replies to them."""
    out, source = [], "summaries"
    for level in range(levels):
        part = _PART
        out += [f"""parts{level} AS (
  SELECT container_id, name, chunk_index + 1 AS rn, {part} AS line, {tokens(part)} AS tokens
  FROM {source})""", packed(f"parts{level}", str(Q.REDUCTION_TOKENS), f"bundles{level}"), f"""packs{level} AS (
  SELECT container_id, name, chunk_index, chunk_total, n_logs,
         {filled(P.SYNTHESIS, ContainerName="name", Summaries="text")} AS user_text
  FROM (SELECT container_id, name, chunk_index, chunk_total, count(*) AS n_logs,
               string_agg(line, '' ORDER BY rn) AS text
        FROM bundles{level} GROUP BY container_id, name, chunk_index, chunk_total)),
replies{level} AS (
  SELECT p.*, '**Summary**: all of ' || length(user_text) || ' characters' AS content
  FROM packs{level} p WHERE chunk_total > 1 AND container_id IN (
    SELECT container_id FROM packs{level} GROUP BY container_id HAVING count(*) < sum(n_logs)))"""]
        source = f"replies{level}"
    return out


_SMALLER = [cte.replace(str(Q.MAX_TOKENS), str(Q.REDUCTION_CONTEXT)) for cte in request_ctes()]
ORACLE["q09g_reduction"] = _with(*_SMALLER, *reduction_ctes(4), recursive=True) + " UNION ALL ".join(
    f"SELECT container_id, CAST({k} AS BIGINT) AS level, chunk_index, chunk_total, user_text "
    f"FROM packs{k}" for k in range(4))
ORACLE["q09h_repeated_responses"] = _with(*results_ctes(), recursive=True) + (
    "SELECT container_id, analysis, tokens_used, chunks_used FROM results")
ORACLE["q09f_interactions"] = _with(*synthesis_ctes(), recursive=True) + f"""
SELECT request_id, name, {NOW} AS ts, user_text AS original_input, content AS reply,
       user_text AS sent, CAST(usage_tokens AS BIGINT) AS total_tokens
FROM (SELECT request_id, name, user_text, content, usage_tokens FROM answers
      UNION ALL SELECT request_id, name, user_text, content, usage_tokens FROM final)
WHERE content IS NOT NULL"""
ORACLE["q09i_provider_responses"] = """
WITH e AS (
  SELECT event_id, event_id % 13 AS kind, event_id % 100 AS given, event_id % 7 AS made,
         coalesce(props, '') AS words
  FROM events)
SELECT CAST(event_id AS VARCHAR) AS request_id,
       CASE WHEN kind IN (5, 6, 7) THEN 'no choices in response' WHEN kind = 8 THEN words
            WHEN kind = 9 THEN given || ': ' || words
            WHEN kind = 10 THEN 'the response is no JSON object' END AS failure,
       CASE WHEN kind IN (0, 1, 3, 4, 12) THEN words WHEN kind = 2 THEN words || '; end'
            WHEN kind = 11 THEN '' END AS content,
       CASE WHEN kind IN (0, 1, 2, 5, 6, 7) THEN given + made WHEN kind = 4 THEN given
            ELSE 0 END AS usage_tokens
FROM e"""
ORACLE["q10_classify_extract"] = _with(ANALYSES) + f"""
SELECT name, {HAS_ISSUES} AS has_issues, {HAS_WARNINGS} AS has_warnings, {ALERT} AS needs_alert,
       {SERVICE} AS service_status, {DASHBOARD} AS dashboard_status, {SUMMARY} AS summary,
       {ERRORS} AS errors,
       CASE WHEN length(analysis) > 10 THEN left(analysis, 10) || '...' ELSE analysis END
         AS short_text
FROM analyses"""
ORACLE["q11_health"] = _with(ANALYSES) + f"""
SELECT count(*) AS services, count(*) FILTER ({HAS_ISSUES}) AS services_with_issues,
       {HEALTH} AS health, coalesce(bool_or({ALERT}), false) AS issues_found FROM analyses"""
ORACLE["q11b_service_status"] = _with(ANALYSES) + f"""
SELECT name, {HAS_ISSUES} AS has_issues, {DASHBOARD} AS status, {SUMMARY} AS summary,
       CASE WHEN {HAS_ISSUES} THEN {ERRORS} END AS errors FROM analyses"""
ORACLE["q11c_dashboard"] = _with(ANALYSES) + f"""
SELECT 0 AS section, '' AS name,
       '# 🌍 Global System Summary' || chr(10) || chr(10) || '**Last Updated:** '
       || strftime({NOW}, '%a, %d %b %Y %H:%M:%S UTC') || chr(10) || chr(10)
       || '## System Health: ' || {HEALTH} || chr(10) || chr(10) || '## Service Status' || chr(10)
       || chr(10) || '| Service | Status | Last Analysis |' || chr(10)
       || '|---------|--------|---------------|' || chr(10) AS piece FROM analyses
UNION ALL
SELECT 1, name, '| ' || name || ' | ' || {DASHBOARD} || ' | ' || {SUMMARY} || ' |' || chr(10)
FROM analyses
UNION ALL
SELECT 2, '', chr(10) || '## Recent Critical Issues' || chr(10) || chr(10)
       || CASE WHEN count(*) FILTER ({HAS_ISSUES}) = 0
          THEN '*No critical issues reported in the last scan.*' ELSE '' END FROM analyses
UNION ALL
SELECT 3, name, '### ' || name || chr(10) || {ERRORS} || chr(10) FROM analyses WHERE {HAS_ISSUES}"""
ORACLE["q12_scan_totals"] = _with(EVENT_LOGS, STATE, NEW_LINES) + (
    "SELECT count(DISTINCT container_id) AS scanned_containers, count(*) AS total_logs "
    "FROM new_lines")
ORACLE["q12c_pass_totals"] = _with(*budget_ctes(), """totals AS (
  SELECT count(*) AS scanned_containers, CAST(sum(original_count) AS BIGINT) AS total_logs,
         CAST(sum(lines_total) AS BIGINT) AS lines_total,
         CAST(sum(lines_filtered) AS BIGINT) AS lines_filtered,
         CAST(sum(lines_kept) AS BIGINT) AS lines_kept
  FROM budgets)""") + """
SELECT *, CAST(lines_total - lines_kept AS DOUBLE) / lines_total * 100.0 AS filter_reduction,
       lines_filtered * 20 AS tokens_saved,
       printf('%.1f', CAST(lines_total - lines_kept AS DOUBLE) / lines_total * 100.0)
       AS reduction_text
FROM totals"""
ORACLE["q12b_reports"] = _with(*results_ctes(), recursive=True) + """
SELECT name, '/reports/' || replace(name, '/', '_') || '/2024-01-31_00-00-00.md' AS path,
  '# Scan Report: ' || name || chr(10) || chr(10)
  || '**Date:** Wed, 31 Jan 2024 00:00:00 UTC  ' || chr(10)
  || '**Container:** `' || name || '`  ' || chr(10)
  || '**Log Entries:** ' || original_count || '  ' || chr(10)
  || '**Tokens Used:** ' || tokens_used || chr(10) || chr(10)
  || '## 🤖 AI Analysis' || chr(10) || chr(10) || analysis || chr(10) || chr(10)
  || '## 🔍 Pre-Processing Statistics' || chr(10) || chr(10)
  || '| Metric | Value |' || chr(10) || '|--------|-------|' || chr(10)
  || '| Total Log Lines | ' || lines_total || ' |' || chr(10)
  || '| Lines Filtered (Regexp) | ' || lines_filtered || ' |' || chr(10)
  || '| Lines Kept | ' || lines_kept || ' |' || chr(10)
  || '| Filter Reduction | '
  || printf('%.1f', CAST(lines_total - lines_kept AS DOUBLE) / lines_total * 100.0) || '% |'
  || chr(10) || '| Est. Tokens Saved | ~' || (lines_filtered * 20) || ' |' || chr(10)
  || chr(10) || '**Cost Impact:** By filtering log lines before LLM processing, approximately '
  || (lines_filtered * 20)
  || ' tokens were saved. This reduces API costs and improves processing speed.'
  || chr(10) || chr(10)
  || '## 📊 Statistics' || chr(10) || chr(10)
  || '| Metric | Value |' || chr(10) || '|--------|-------|' || chr(10)
  || '| Original Logs | ' || original_count || ' |' || chr(10)
  || '| Processed Logs | ' || processed_count || ' |' || chr(10)
  || CASE WHEN deduplicated THEN '| Deduplication | ' || printf('%.1f',
       CAST(original_count - processed_count AS DOUBLE) / original_count * 100.0) || '% |'
       || chr(10) ELSE '' END
  || '| Tokens | ' || tokens_used || ' |' || chr(10)
  || '| Chunks | ' || chunks_used || ' |' || chr(10) AS content
FROM results"""
ORACLE["q13_retention"] = _with(ANALYSES, HISTORY) + f"""
SELECT * FROM history h
WHERE NOT EXISTS (SELECT 1 FROM analyses a WHERE a.name = h.name) OR scan_ts IS NULL
   OR scan_ts >= {NOW} - INTERVAL {Q.RETENTION_DAYS} DAY
UNION ALL
SELECT name, strftime({NOW}, '%Y-%m-%dT%H:%M:%SZ'), {NOW}, {SERVICE}, analysis FROM analyses"""
ORACLE["q13b_kb_ingest"] = _with(HISTORY) + "SELECT * FROM history"
ORACLE["q13c_history_documents"] = _with(HISTORY, """entries AS (
  SELECT *, chr(10) || '### Scan: ' || scan_ts_raw || chr(10) || '**Status:** ' || status || chr(10)
         || chr(10) || analysis || chr(10) || chr(10) || '---' || chr(10) AS entry
  FROM history)""") + """
SELECT name, replace(name, '/', '_') AS storage_name,
       '# Knowledge Base: ' || name || chr(10) || chr(10) || '## Service History' || chr(10)
       || string_agg(entry, '' ORDER BY scan_ts NULLS FIRST, scan_ts_raw, entry) AS content
FROM entries GROUP BY name"""
ORACLE["q13d_status_trend"] = _with(HISTORY, f"""counts AS (
  SELECT name, count(*) FILTER (late) AS recent, count(*) FILTER (late AND issue) AS recent_issues,
         count(*) FILTER (NOT late) AS earlier,
         count(*) FILTER (NOT late AND issue) AS earlier_issues
  FROM (SELECT name, scan_ts >= {NOW} - INTERVAL {Q.LOOKBACK.days} DAY AS late,
               status = '🔴 Issues Detected' AS issue FROM history WHERE scan_ts IS NOT NULL)
  GROUP BY name)""") + """
SELECT *, CASE WHEN earlier = 0 THEN 'new'
               WHEN recent_issues * earlier > earlier_issues * recent THEN 'worse'
               WHEN recent_issues * earlier < earlier_issues * recent THEN 'better'
               ELSE 'same' END AS trend FROM counts"""
ORACLE["q14_cursor_upsert"] = _with(EVENT_LOGS, STATE, NEW_LINES, """moved AS (
  SELECT container_id, arg_max(name, seq) AS name, arg_max(ts, seq) AS last_scan, '' AS log_cursor
  FROM new_lines GROUP BY container_id)""") + """
SELECT container_id, name, last_scan, log_cursor FROM moved
UNION ALL
SELECT * FROM state s WHERE NOT EXISTS (
  SELECT 1 FROM moved m WHERE m.container_id = s.container_id)"""
ORACLE["q14b_last_times"] = """
SELECT container_id, container_id AS name,
       CASE event_type WHEN 'signup' THEN TIMESTAMP '0001-01-01 00:00:00'
                       WHEN 'click' THEN date_trunc('second', ts) ELSE ts END AS last_scan,
       '' AS log_cursor
FROM (SELECT CAST(user_id AS VARCHAR) AS container_id, arg_max(event_type, event_id) AS event_type,
             arg_max(ts, event_id) AS ts FROM events GROUP BY user_id)
WHERE event_type <> 'purchase'"""
# A stream that finds all files at once is one scan; a second one would start at the moved cursors.
ORACLE["q25_stream_scan"] = _with(EVENT_LOGS, STATE, NEW_LINES, DEDUP.replace(
    "FROM logs WINDOW", "FROM new_lines WINDOW")) + (
    "SELECT container_id, name, seq, ts, message, run_len FROM dedup")
ORACLE["q25b_stream_state"] = ORACLE["q14_cursor_upsert"]
_ANALYSIS_PART = "'### ' || name || chr(10) || analysis || chr(10) || chr(10)"
_EXECUTIVE = f"""
SELECT 'scan//executive/' || chunk_index AS request_id, '' AS container_id, '' AS name,
       'executive' AS kind, chunk_index, chunk_total, {_text(P.SYSTEM)} AS system_text,
       {filled(P.EXECUTIVE, ContainerCount="n", ContainerAnalyses="text")} AS user_text,
       CAST(0.3 AS DOUBLE) AS temperature, CAST(4000 AS BIGINT) AS max_tokens
FROM """
ORACLE["q15_executive_request"] = _with(ANALYSES) + _EXECUTIVE + f"""(
  SELECT CAST(0 AS BIGINT) AS chunk_index, CAST(1 AS BIGINT) AS chunk_total, count(*) AS n,
         string_agg({_ANALYSIS_PART}, '' ORDER BY name) AS text FROM analyses)"""
ORACLE["q15b_executive_packed"] = _with(ANALYSES, f"""parts AS (
  SELECT '' AS container_id, '' AS name, row_number() OVER (ORDER BY a.name) AS rn,
         {_ANALYSIS_PART.replace(' name ', ' a.name ')} AS line,
         {tokens(_ANALYSIS_PART.replace(' name ', ' a.name '))} AS tokens FROM analyses a)""",
    packed("parts", str(Q.EXECUTIVE_TOKENS), "bundles"), recursive=True) + _EXECUTIVE + """(
  SELECT chunk_index, chunk_total, count(*) AS n, string_agg(line, '' ORDER BY rn) AS text
  FROM bundles GROUP BY chunk_index, chunk_total)"""
ORACLE["q16_system_prompt"] = _with(IGNORE) + f"""
SELECT CAST(user_id AS VARCHAR) AS container_id, 'app/user-' || user_id AS name,
       {system("coalesce(instructions, '')")} AS system_text
FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN ignored ON file_stem = 'app_user-' || user_id"""
_SUPPLIERS = """
SELECT CAST(s_suppkey AS VARCHAR) AS container_id, s_name AS name,
       CASE WHEN s_acctbal > 0 THEN 'running' ELSE 'exited' END AS state,
       'nation:' || s_nationkey AS image FROM supplier"""
ORACLE["q17_container_filter"] = _SUPPLIERS + (
    " WHERE s_acctbal > 0 AND regexp_matches(s_name, '#0+[1-9]*[13579]$')")
ORACLE["q17b_container_all"] = _SUPPLIERS
OBSOLETE = f"""dead AS (
  SELECT s.* FROM state s WHERE NOT EXISTS (
    SELECT 1 FROM live l WHERE l.container_id = s.container_id)),
names AS (SELECT name FROM kb UNION SELECT name FROM reports UNION SELECT name FROM llm_logs),
obsolete AS (
  SELECT container_id AS id, name, true AS in_state,
         replace(name, '/', '_') IN (SELECT name FROM kb) AS in_kb,
         replace(name, '/', '_') IN (SELECT name FROM reports) AS in_reports,
         replace(name, '/', '_') IN (SELECT name FROM llm_logs) AS in_llm_logs
  FROM dead
  UNION ALL
  SELECT 'orphaned-' || name, replace(name, '_', '/'), false, name IN (SELECT name FROM kb),
         name IN (SELECT name FROM reports), name IN (SELECT name FROM llm_logs)
  FROM names n WHERE NOT EXISTS (
    SELECT 1 FROM state s JOIN live l ON l.container_id = s.container_id
    WHERE replace(s.name, '/', '_') = n.name))"""
ORACLE["q18_obsolete"] = _with(STATE, LIVE, STORES, OBSOLETE) + """
SELECT *, CASE WHEN starts_with(id, 'orphaned-') THEN id ELSE left(id, 12) END AS short_id
FROM obsolete"""
ORACLE["q19_cleanup_state"] = _with(STATE, LIVE) + (
    "SELECT * FROM state WHERE container_id IN (SELECT container_id FROM live)")
ORACLE["q19b_cleanup_stores"] = _with(STATE, LIVE, STORES, OBSOLETE) + " UNION ALL ".join(
    f"SELECT '{s}' AS store, name, entry FROM {s} WHERE name NOT IN "
    f"(SELECT replace(name, '/', '_') FROM obsolete WHERE in_{s})"
    for s in ("kb", "reports", "llm_logs"))
SCAN_LINES = [EVENT_LOGS, STATE, NEW_LINES, DEDUP.replace("FROM logs WINDOW", "FROM new_lines WINDOW")]
MOVED = """moved AS (
  SELECT container_id, arg_max(name, seq) AS name, arg_max(ts, seq) AS last_scan, '' AS log_cursor
  FROM new_lines GROUP BY container_id),
after_scan AS (
  SELECT * FROM moved
  UNION ALL
  SELECT * FROM state s WHERE NOT EXISTS (
    SELECT 1 FROM moved m WHERE m.container_id = s.container_id))"""
ORACLE["q26_whole_scan"] = _with(*results_ctes(SCAN_LINES), recursive=True) + "SELECT * FROM results"
ORACLE["q26c_dry_run"] = ORACLE["q26_whole_scan"]
ORACLE["q26b_whole_scan_state"] = _with(EVENT_LOGS, STATE, NEW_LINES, MOVED) + (
    "SELECT container_id, name, last_scan, log_cursor FROM after_scan")
SCANNED = [*results_ctes(SCAN_LINES), MOVED, LIVE, """kb AS (
  SELECT replace(name, '/', '_') AS name FROM results), reports AS (SELECT name FROM kb),
llm_logs AS (
  SELECT DISTINCT replace(name, '/', '_') AS name FROM answers WHERE content IS NOT NULL
  UNION SELECT replace(name, '/', '_') FROM final)""",
           OBSOLETE.replace("state s", "after_scan s")]
ORACLE["q18b_obsolete_after_scan"] = _with(*SCANNED, recursive=True) + "SELECT * FROM obsolete"
ORACLE["q19c_cleanup_after_scan"] = _with(*SCANNED, recursive=True) + """
SELECT 'state' AS store, name FROM after_scan WHERE container_id IN (SELECT container_id FROM live)
UNION ALL """ + " UNION ALL ".join(
    f"SELECT DISTINCT '{s}', replace(name, '_', '/') FROM {s} WHERE name NOT IN "
    f"(SELECT replace(name, '/', '_') FROM obsolete WHERE in_{s})"
    for s in ("kb", "reports", "llm_logs"))
ORACLE["q20d_state_json"] = _with(STATE) + "SELECT * FROM state"
ORACLE["q20g_state_documents"] = _with(STATE, """ids AS (
  SELECT *, CAST(container_id AS BIGINT) % 7 AS kind, CAST(container_id AS BIGINT) // 64 % 4 AS form
  FROM state)""") + """
SELECT container_id, CASE WHEN kind < 3 THEN name END AS name,
       CASE WHEN kind IN (0, 1, 3) THEN last_scan END AS last_scan,
       CASE WHEN kind = 0 THEN 'c' || container_id ELSE '' END AS log_cursor
FROM ids WHERE kind < 5 AND form <> 3"""
ORACLE["q20e_reset_all"] = _with(STATE) + "SELECT * FROM state WHERE false"
ORACLE["q20f_remove"] = _with(STATE) + "SELECT * FROM state WHERE container_id <> '5'"
ORACLE["q20_state_reset"] = _with(STATE) + f"SELECT * FROM state WHERE NOT {STATE_HIT}"
ORACLE["q20b_state_reset_count"] = _with(STATE) + (
    f"SELECT count(*) AS containers FROM state WHERE {STATE_HIT}")
ORACLE["q20c_state_list"] = _with(STATE) + """
SELECT left(container_id, 12) AS short_id, name, strftime(last_scan, '%Y-%m-%d %H:%M:%S')
       AS last_scan, '-' AS log_cursor FROM state"""
ORACLE["q21_preview"] = _with(EVENT_LOGS, """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY container_id ORDER BY seq) AS line_no,
         count(*) OVER (PARTITION BY container_id) AS n FROM logs)""") + """
SELECT container_id, line_no, ts_raw, message, greatest(n - 10, 0) AS more_lines
FROM ranked WHERE line_no <= 10"""
ORACLE["q22_text_functions"] = """
WITH c AS (
  SELECT c_custkey, c_name, c_mktsegment || '/' || c_name || ':*?"<>|\\' AS path,
         CASE WHEN c_acctbal < 0 THEN '' WHEN c_acctbal < 5000 THEN c_mktsegment ELSE c_name END
           AS secret,
         CASE WHEN c_acctbal < 0 THEN '' WHEN c_acctbal < 5000
              THEN lower(c_mktsegment) || '://' || c_name || '@x://y' ELSE c_name END AS url
  FROM customer)
SELECT c_custkey, replace(path, '/', '_') AS storage_name,
       translate(path, '/\\:*?"<>|', '_________') AS file_name,
       replace(replace(path, '#', '_'), '_', '/') AS display_name,
       left(c_name, 12) AS short_name, 'orphaned-' || c_name AS short_orphan,
       CASE WHEN secret = '' THEN '❌ Not set' WHEN length(secret) <= 8 THEN '***'
            ELSE left(secret, 4) || repeat('*', length(secret) - 8) || right(secret, 4) END
         AS secret,
       CASE WHEN url = '' THEN '❌ Not configured'
            WHEN NOT contains(url, '://') THEN '✅ Configured (invalid format)'
            ELSE '✅ Configured (' || split_part(url, '://', 1) || '://***)' END AS url
FROM c"""
ORACLE["q23_latest_per_name"] = """
SELECT event_type AS name, max(event_id) AS seq, CAST(0 AS BIGINT) AS segment,
       CAST(arg_max(user_id, event_id) AS VARCHAR) AS container_id
FROM events GROUP BY event_type"""
ORACLE["q24_alert"] = _with(*results_ctes(), f"""prompt AS (
  SELECT {filled(P.EXECUTIVE, ContainerCount="n", ContainerAnalyses="text")} AS user_text
  FROM (SELECT count(*) AS n, string_agg({_ANALYSIS_PART}, '' ORDER BY name) AS text FROM results)),
health AS (SELECT count(*) AS services, coalesce(bool_or({ALERT}), false) AS issues_found
           FROM results)""", recursive=True) + """
SELECT 'Scan Complete' || chr(10) || '📅 Time: 2024-01-31 00:00:00' || chr(10)
       || '📦 Containers: ' || services || chr(10)
       || CASE WHEN issues_found THEN '⚠️  Issues detected' ELSE '✅ No critical issues' END
       || chr(10) || chr(10) || '**Summary**: all of ' || length(user_text) || ' characters'
         AS message, issues_found, services AS containers
FROM health, prompt"""


def _masked(text: str) -> str:
    for pattern, mask in X.PERSONAL:
        text = f"regexp_replace({text}, {_text(pattern)}, {_text(mask.replace('$1', chr(92) + '1'))}, 'g')"
    return text


ORACLE["q27_mask_personal"] = f"SELECT doc_id, {_masked('text')} AS text FROM documents"
ORACLE["q01c_zone_map"] = ORACLE["q01_incremental_scan"]
ORACLE["q13f_history_by_day"] = ORACLE["q13_retention"]
ORACLE["q14c_state_deltas"] = ORACLE["q14_cursor_upsert"]
ORACLE["q26d_committed_scan"] = _with(*SCANNED, recursive=True) + """
SELECT 'state' AS store, name FROM after_scan
UNION ALL """ + " UNION ALL ".join(f"SELECT '{s}', name FROM {s}" for s in ("kb", "reports", "llm_logs"))
ORACLE["q05e_rule_problems"] = """
WITH users AS (
  SELECT user_id, arg_max(event_type, (value, event_id)) <> 'view' AS enabled
  FROM events GROUP BY user_id)
SELECT 'app/user-' || user_id AS name, CAST(1 AS INTEGER) AS pattern_no, pattern, problem
FROM users JOIN (VALUES (0, '(', 'missing closing '')'': ''('''),
  (1, '*', 'bad repetition operator: ''*'''),
  (2, '(?=x)', 'look-around and atomic groups are not supported: ''(?=x)'''),
  (3, '[z-', 'missing closing bracket: ''[z-'''), (4, 'a{2000}', 'bad repetition count: ''a{2000}'''))
  AS k(n, pattern, problem) ON user_id // 5 % 5 = n, range(2)
WHERE enabled AND user_id % 5 = 0"""
ORACLE["q13e_status_intervals"] = _with(HISTORY, f"""times AS (
  SELECT name, scan_ts, count(*) AS n, arg_min(status, CASE status
           WHEN '🔴 Issues Detected' THEN 0 WHEN '🟡 Warnings' THEN 1 ELSE 2 END) AS status
  FROM history WHERE scan_ts <= {NOW} AND scan_ts >= {NOW} - INTERVAL {Q.RETENTION_DAYS} DAY
  GROUP BY name, scan_ts),
marked AS (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY scan_ts)
            - row_number() OVER (PARTITION BY name, status ORDER BY scan_ts) AS island
  FROM times),
runs AS (
  SELECT name, status, min(scan_ts) AS since, CAST(sum(n) AS BIGINT) AS entries
  FROM marked GROUP BY name, status, island)""") + f"""
SELECT name, status, lag(status) OVER w AS previous_status, since, lead(since) OVER w AS until, entries,
       date_diff('second', since, coalesce(lead(since) OVER w, {NOW})) AS seconds
FROM runs WINDOW w AS (PARTITION BY name ORDER BY since)"""
ORACLE["q28_durations"] = """
SELECT o_orderkey, CASE WHEN k % 13 = 0 THEN text || 'x' WHEN k % 17 = 0 THEN '0' ELSE text END AS text,
       CASE WHEN k % 13 = 0 THEN NULL WHEN k % 17 = 0 THEN 0 ELSE CAST(CASE WHEN k % 3 = 0 THEN -1 ELSE 1 END
         * ((k % 30) * 3600000000 + (k % 61) * 60000000 + (k % 10) * 6000000 + (k % 7) * 100000
            + k % 1000) AS BIGINT) END AS micros
FROM (SELECT o_orderkey, o_orderkey AS k, CASE k % 3 WHEN 0 THEN '-' WHEN 1 THEN '+' ELSE '' END
        || k % 30 || 'h' || k % 61 || '.' || k % 10 || 'm.' || k % 7 || 's' || k % 1000 || 'us' AS text
      FROM orders)"""
ORACLE["q25c_stream_runs"] = ORACLE["q04_run_dedup"]
