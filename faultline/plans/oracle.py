"""DuckDB text used to check the Spark results: expressions and common table expressions."""

from __future__ import annotations

import re

from faultline.functions import vocab as V
from faultline.functions.text import WHITESPACE
from faultline.plans import views

REF = f"TIMESTAMP '{views.REF_TIME}'"
NL = "chr(10)"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lits(words) -> str:
    return ", ".join(lit(w) for w in words)


def rx(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {lit(pattern)})"


_WORD = r"\p{L}\p{N}_"


def any_script(pattern: str) -> str:
    """Word boundaries for all scripts: DuckDB's ``\\b`` only knows ASCII letters."""
    out = pattern.replace(r"\b.*\b", f"[^{_WORD}](?:.*[^{_WORD}])?")
    out = re.sub(r"\\b(?=[A-Za-z0-9(])", lambda m: f"(?:^|[^{_WORD}])", out)
    return re.sub(r"\\b", lambda m: f"(?:$|[^{_WORD}])", out)


def rx_any(c: str, patterns, flags="(?i)") -> str:
    return rx(c, flags + "|".join(f"(?:{any_script(p)})" for p in patterns))


def first_line(c: str) -> str:
    return f"split_part({c}, {NL}, 1)"


def strip(c: str) -> str:
    return f"trim({c}, {lit(WHITESPACE)})"


def basename(c: str) -> str:
    return f"regexp_extract({c}, '[^/\\\\]*$')"


def case(key: str, mapping: dict, default: str) -> str:
    arms = " ".join(f"WHEN {lit(k) if isinstance(k, str) else k} THEN {lit(v) if isinstance(v, str) else v}"
                    for k, v in mapping.items())
    return f"CASE {key} {arms} ELSE {default} END"


def rules(c: str, table, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {rx(c, p)} THEN {lit(s)}" for s, p in table) + f" ELSE {lit(default)} END"


def ingest_severity(c: str) -> str:
    return rules(c, V.INGEST_SEVERITY, "info")


def severity(c: str) -> str:
    return rules(first_line(c), V.ANALYSIS_SEVERITY, "unknown")


def entry_ts(c: str) -> str:
    return f"try_strptime(replace(regexp_extract({first_line(c)}, {lit(V.TIMESTAMP)}, 1), 'T', ' '), '%Y-%m-%d %H:%M:%S')"


def ts_text(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


def find_all(c: str, p: str, g: int = 0) -> str:
    return f"regexp_extract_all({c}, {lit(p)}, {g})"


def normalise(c: str) -> str:
    out = f"substring({first_line(c)}, 1, 200)"
    for p, r in V.NORMALISE:
        out = f"regexp_replace({out}, {lit(p)}, {lit(r)}, 'g')"
    return f"lower({strip(out)})"


def exception_type(c: str) -> str:
    return (f"coalesce(list_filter(list_transform({find_all(c, V.EXCEPTION, 1)}, lambda h: {strip('split_part(h, chr(58), 1)')}), "
            f"lambda b: lower(b) NOT IN ({lits(V.LEVEL_WORDS)}))[1], '')")


def frames(c: str) -> str:
    return f"list_transform({find_all(c, V.STACK_FRAME)}, lambda m: lower({strip('m')}))"


def ref_files(c: str) -> str:
    return find_all(c, V.FILE_LINE, 1)


def ref_lines(c: str) -> str:
    return find_all(c, V.FILE_LINE, 2)


def methods(c: str) -> str:
    """'owner.method' strings of allowed owners."""
    return (f"list_filter({find_all(c, V.CLASS_METHOD)}, lambda p: split_part(p, '.', 1) NOT IN ({lits(V.STOP_CLASSES)}))")


def functions(c: str) -> str:
    return (f"list_distinct(list_concat({find_all(c, V.FUNCTION_WORD, 1)}, "
            f"list_transform({methods(c)}, lambda p: split_part(p, '.', 2))))")


def signature(c: str) -> str:
    msg = f"regexp_replace(regexp_replace({normalise(c)}, {lit(V.LEVEL_PREFIX)}, ''), {lit(V.TS_PREFIX)}, '')"
    return (f"CASE WHEN {exception_type(c)} <> '' THEN 'exc:' || {exception_type(c)} "
            f"WHEN {msg} <> '' THEN 'msg:' || substring({msg}, 1, 100) "
            f"WHEN len({ref_files(c)}) > 0 THEN 'loc:' || {ref_files(c)}[1] || ':' || CAST({ref_lines(c)}[1] AS BIGINT) "
            f"ELSE 'raw:' || lower({strip(f'substring({c}, 1, 50)')}) END")


def failure(c: str) -> str:
    tidy = f"list_transform({find_all(c, V.EXCEPTION_NO_PANIC, 1)}, lambda h: substring(regexp_replace({strip('h')}, '\\s+', ' ', 'g'), 1, 120))"
    named = f"list_filter({tidy}, lambda s: lower(s) NOT IN ({lits(V.LEVEL_WORDS)}))[1]"
    status = f"regexp_extract({c}, {lit(V.HTTP_STATUS)}, 1)"
    return (f"CASE WHEN {named} IS NOT NULL THEN {named} WHEN {status} <> '' THEN 'HTTP ' || {status} "
            f"WHEN {rx(c, V.TIMED_OUT)} THEN 'Connection timeout' END")


def keywords(c: str) -> str:
    return (f"list_filter(list_distinct(list_transform({find_all(c, V.KEYWORD_TOKEN)}, lambda t: lower(t))), "
            f"lambda t: t NOT IN ({lits(V.KEYWORD_STOPWORDS)}))")


def lines(c: str) -> str:
    return f"string_split({c}, {NL})"


def extension(path: str) -> str:
    return f"lower(regexp_extract({basename(path)}, '^.+(\\.[^.]+)$', 1))"


# ---- views ------------------------------------------------------------------------------

LOG_VIEW = """
log_raw AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
log_view AS (
  SELECT 'ns' || (user_id % 3) AS namespace, 'logs/svc' || (user_id % 20) || '.log' AS source_file, event_id AS ord,
    strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z ' ||
    CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARNING' ELSE 'INFO' END || ' ' ||
    CASE
      WHEN event_type = 'error' AND k % 5 = 0 THEN 'NullPointerException: value of user ' || user_id || ' is null at mod' || (k % 7) || '.py:' || (k + 1)
      WHEN event_type = 'error' AND k % 5 = 1 THEN 'ValueError: bad input ' || (k + 10000) || ' at parser.py:' || (k % 3 + 1)
      WHEN event_type = 'error' AND k % 5 = 2 THEN 'Connection refused to service svc' || (k % 3)
      WHEN event_type = 'error' AND k % 5 = 3 THEN 'java.lang.OutOfMemoryError: heap space' || chr(10) || '  at com.app.Service' || (k % 4) || '.run(Service.java:' || (k + 1) || ')' || chr(10) || '  File "src/mod' || (k % 7) || '.py", line ' || (k + 1) || ', in fn' || (k % 5)
      WHEN event_type = 'error' THEN 'Request failed: GET /api/item/' || (event_id + 10000) || ' - 500'
      WHEN event_type = 'purchase' AND k % 2 = 0 THEN 'Connection timeout after 5000 ms'
      WHEN event_type = 'purchase' THEN 'Slow query on table t' || (k % 6)
      ELSE 'Session created for user ' || user_id END AS text
  FROM log_raw)"""

LOG_UNTIMED = LOG_VIEW + """,
log_mixed AS (
  SELECT namespace, source_file, ord, CASE WHEN ord % 50 = 0 THEN substring(text, 22) ELSE text END AS text FROM log_view)"""

LOG_LINES = LOG_VIEW + """,
log_split AS (
  SELECT namespace, source_file, ord, unnest(string_split(text, chr(10))) AS text,
    generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM log_view),
log_lines AS (
  SELECT namespace, source_file, row_number() OVER (PARTITION BY namespace, source_file ORDER BY ord, pos) AS line_no, text
  FROM log_split)"""

DOC_FILES = """
doc_files AS (
  SELECT 'ns' || (doc_id % 3) AS namespace, source || '/' || lang || '/' || doc_id || '.txt' AS source_file, text FROM documents)"""


def windows(source: str, name: str, size: int = V.WINDOW_LINES, step: int = V.WINDOW_STEP) -> str:
    return f"""
{name}_l AS (SELECT namespace, source_file, {lines('text')} AS l FROM {source}),
{name} AS (
  SELECT namespace, source_file, i + 1 AS line_start, least(i + {size}, len(l)) AS line_end,
    array_to_string(l[i + 1 : least(i + {size}, len(l))], chr(10)) AS text
  FROM (SELECT *, unnest(range(0, len(l), {step})) AS i FROM {name}_l)
  WHERE length({strip(f"array_to_string(l[i + 1 : least(i + {size}, len(l))], chr(10))")}) >= {V.MIN_CHUNK_CHARS})"""


DOC_CHUNKS = DOC_FILES + "," + windows("doc_files", "doc_windows") + f""",
doc_chunks AS (
  SELECT *, sha256(namespace || ':' || source_file || ':' || line_start || ':' || line_end) AS chunk_id,
    {ingest_severity('text')} AS severity FROM doc_windows)"""

VEC_CHUNKS = """
vec_chunks AS (
  SELECT 'ns' || (label % 3) AS namespace, vec_id, 'src' || label || '.py' AS source_file,
    CAST(vec_id * 4 + 1 AS BIGINT) AS line_start, CAST(vec_id * 4 + 15 AS BIGINT) AS line_end,
    CASE WHEN vec_id % 2 = 1 THEN 'log' ELSE 'code' END AS source_type,
    CASE WHEN vec_id % 3 = 0 THEN 'function' ELSE '' END AS chunk_kind,
    CASE WHEN vec_id % 3 = 0 THEN 'fn' || (vec_id % 11) ELSE '' END AS function_name,
    CASE WHEN vec_id % 5 = 0 THEN 'Explains the unit.' ELSE '' END AS docstring,
    ['fn' || (vec_id % 13), 'fn' || (vec_id % 7)] AS imported,
    CASE WHEN vec_id % 4 = 1 THEN '2024-01-30T' ELSE '2024-01-20T' END || lpad(CAST(vec_id % 24 AS VARCHAR), 2, '0') || ':00:00Z ' ||
    CASE vec_id % 4 WHEN 1 THEN 'ERROR' WHEN 3 THEN 'WARNING' ELSE 'INFO' END || ' unit ' || vec_id || chr(10) || '  at run(x.js:' || label || ')' AS text,
    embedding
  FROM embeddings)"""

VEC = VEC_CHUNKS.replace("vec_chunks AS", "vec_base AS") + f""",
vec_chunks AS (SELECT *, sha256(namespace || ':' || source_file || ':' || line_start || ':' || line_end) AS chunk_id,
  {ingest_severity('text')} AS severity, {entry_ts('text')} AS ts FROM vec_base),
vec_questions AS (SELECT vec_id AS query_id, namespace, {case('vec_id % 4', dict(enumerate(views.VECTOR_QUESTIONS)), "''")} AS question, embedding FROM vec_base),
kn AS (SELECT q.query_id, c.chunk_id, round(1 - list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 9) AS distance
  FROM vec_questions q JOIN vec_chunks c USING (namespace)),
knn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM kn QUALIFY rank <= 8)"""

_N = len(views.PHRASES)
LOG_CHUNKS = LOG_VIEW + f""",
log_chunks AS (SELECT namespace, source_file, ord AS line_start, ord AS line_end, text,
  sha256(namespace || ':' || source_file || ':' || ord || ':' || ord) AS chunk_id, {ingest_severity('text')} AS severity, 'log' AS source_type FROM log_view)"""

QUESTIONS = f"""
questions AS (
  SELECT conv_id * 1000 + turn AS query_id, 'ns' || (conv_id % 3) AS namespace,
    CASE WHEN (conv_id * 7 + turn) % {_N} IN ({', '.join(str(i) for i, (_, w) in enumerate(views.PHRASES) if w)})
      THEN {case(f'(conv_id * 7 + turn) % {_N}', {i: p for i, (p, _) in enumerate(views.PHRASES)}, "''")} || ' ' || text
      ELSE {case(f'(conv_id * 7 + turn) % {_N}', {i: p for i, (p, _) in enumerate(views.PHRASES)}, "''")} END AS question
  FROM conversations WHERE role = 'user')"""

TURNS = """
turns AS (
  SELECT 'conv' || u.conv_id AS namespace, u.turn AS ord, u.text AS question, coalesce(a.text, '') AS answer,
    ['src/mod' || (u.turn % 7) || '.py', 'logs/svc' || (u.conv_id % 5) || '.log'] AS source_files,
    CASE u.turn % 4 WHEN 0 THEN 'log_analysis' WHEN 2 THEN 'general' ELSE 'root_cause' END AS question_type
  FROM (SELECT * FROM conversations WHERE role = 'user') u
  LEFT JOIN (SELECT * FROM conversations WHERE role = 'assistant') a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1)"""

PATHS = f"""
paths AS (
  SELECT 'ns' || (page_id % 3) AS namespace,
    {case('(page_id // 3) % 8', dict(enumerate(views.PATH_FOLDERS)), "''")} || '/' ||
    regexp_replace(regexp_extract(url, '^https?://[^/]*/([^?#]*)', 1), '/+$', '') || '/' || page_id || '/' ||
    {case('(page_id // 5) % 8', dict(enumerate(views.PATH_NAMES)), "''")} ||
    {case('page_id % 8', dict(enumerate(views.PATH_SUFFIXES)), "''")} AS path,
    CAST(length(html) * 400 AS BIGINT) AS length
  FROM pages)"""

REPOS = """
repos AS (
  SELECT page_id AS repo_id,
    CASE WHEN page_id % 9 = 0 THEN 'git' ELSE 'https' END || '://' || CASE WHEN page_id % 2 = 0 THEN 'bot:secret@' ELSE '' END ||
    regexp_extract(url, '^https?://([^/]*)', 1) ||
    CASE WHEN page_id % 7 = 0 THEN '' WHEN page_id % 7 = 1 THEN '/solo' || page_id || '.git'
      ELSE '/team' || (page_id % 11) || '/digit' || page_id || CASE WHEN page_id % 3 = 0 THEN '.git' ELSE '' END END AS url,
    CASE WHEN page_id % 5 = 0 THEN 'HEAD' ELSE 'main' END AS branch, sha1(url) AS commit_sha, html AS commit_message,
    'author' || (page_id % 17) AS author
  FROM pages)"""

CODE_CHUNKS = """
code_chunks AS (
  SELECT ns AS namespace,
    CASE WHEN p_partkey % 9 < 7 THEN 'src/mod' || (p_partkey % 9) || '.py' WHEN p_partkey % 9 = 7 THEN 'app/Service.java' ELSE 'lib/parser.py' END AS source_file,
    p_partkey * 10 AS line_start, p_partkey * 10 + 9 AS line_end,
    CASE WHEN p_partkey % 2 = 0 THEN 'fn' || (p_partkey % 5) ELSE '' END AS function_name,
    CASE WHEN p_partkey % 3 = 0 THEN 'Service' || (p_partkey % 4) ELSE '' END AS class_name, p_name AS text
  FROM part, (VALUES ('ns0'), ('ns1'), ('ns2')) v(ns))"""

UNITS = """
unit_docs AS (
  SELECT *, 'ns' || (doc_id % 3) AS namespace,
    source || '/u' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.js' ELSE '.java' END AS source_file,
    CASE doc_id % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' ELSE 'java' END AS language,
    'Service' || (doc_id % 4) AS service, 'run' || (doc_id % 19) AS run, 'fn' || (doc_id % 11) AS meth
  FROM documents),
units AS (
  SELECT namespace, source_file, language, doc_id, 'class' AS kind, service AS name, 3 AS start_line, 20 AS end_line, '' AS class_name, 'Service of ' || source AS docstring, 'class' AS text FROM unit_docs
  UNION ALL SELECT namespace, source_file, language, doc_id, 'method', meth, 5, 12, service, '', 'def f(self): return helper' || (doc_id % 6) || '(len(x))' FROM unit_docs
  UNION ALL SELECT namespace, source_file, language, doc_id, 'function', run, 22, 40, '', text, run || '(1); ' || meth || ' (2); ' || text FROM unit_docs
  UNION ALL SELECT namespace, source_file, language, doc_id, 'module', '<module>', 1, 60, '', '', 'import' FROM unit_docs)"""


def code_files_cte() -> str:
    arms, exts = [], []
    for i, (ext, template) in enumerate(views.CODE_TEMPLATES):
        parts = []
        for piece in re.split(r"(\{d(?:%\d+)?\}|<<[^\n]*?>>)", template):
            if piece.startswith("<<"):
                parts.append(f"array_to_string(list_transform({lines('text')}, lambda x: {lit(piece[2:-2])} || x), chr(10))")
            elif re.fullmatch(r"\{d(%\d+)?\}", piece):
                mod = piece[3:-1]
                parts.append(f"CAST(doc_id % {mod} AS VARCHAR)" if mod else "CAST(doc_id AS VARCHAR)")
            elif piece:
                parts.append(lit(piece))
        arms.append(f"WHEN {i} THEN {' || '.join(parts)}")
        exts.append(f"WHEN {i} THEN {lit(ext)}")
    n = len(views.CODE_TEMPLATES)
    return f"""
code_files AS (
  SELECT 'ns' || (doc_id % 3) AS namespace, source || '/' || lang || '/f' || doc_id || CASE doc_id % {n} {' '.join(exts)} END AS source_file,
    CASE doc_id % {n} {' '.join(arms)} END AS text
  FROM documents)"""


def sql(ctes: str, body: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{body}"
