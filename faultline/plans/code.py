"""Registered queries: code units and chunks, log-to-code links, symbol graph, architecture."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.functions import text as T
from faultline.functions import vocab as V
from faultline.operators import codeunits as U
from faultline.operators import graph as G
from faultline.operators import linking as L
from faultline.plans import oracle as O
from faultline.plans import views
from faultline.plans.registry import Catalog, big, joined
from faultline.session import cut

C = Catalog()
NS = "namespace"
FILE = [NS, "source_file"]


def _lang_sql(path: str) -> str:
    name = f"lower({O.basename(path)})"
    return (f"CASE WHEN ends_with({name}, '.env.example') THEN 'config' ELSE "
            + O.case(f"regexp_extract({name}, '(\\.[^.]+)$', 1)", V.LANGUAGE_BY_EXTENSION, "'text'") + " END")


_CODE = O.code_files_cte() + f""",
cf AS (SELECT *, {_lang_sql('source_file')} AS language FROM code_files),
cl0 AS (SELECT namespace, source_file, language, unnest({O.lines('text')}) AS text, generate_subscripts({O.lines('text')}, 1) AS line_no, len({O.lines('text')}) AS n FROM cf),
cl AS (SELECT * FROM cl0 WHERE NOT (line_no = n AND text = ''))"""


def _files(spark, sf):
    """The derived source files, written once: the block rules read them several times."""
    return cut(views.code_files(spark, sf), "files")


def _lines(spark, sf):
    return U.code_lines(U.with_language(_files(spark, sf)))


@C.add("P1_detect_language", O.sql(O.code_files_cte() + "," + O.PATHS, f"""
SELECT path, {_lang_sql('path')} AS language FROM (SELECT source_file AS path FROM code_files UNION ALL SELECT path FROM paths)"""))
def detect_language(spark, sf):
    p = views.code_files(spark, sf).select(F.col("source_file").alias("path")).unionByName(views.paths(spark, sf).select("path"))
    return p.select("path", T.detect_language(F.col("path")).alias("language"))


_STARTS = " UNION ALL ".join(
    f"SELECT namespace, source_file, language, line_no, {O.lit(kind)} AS kind, regexp_extract(text, {O.lit(p)}, {g}) AS name FROM cl WHERE language IN ({O.lits(langs)}) AND {O.rx('text', p)}"
    for langs, kind, p, g in V.UNIT_PATTERNS)


@C.add("P2_unit_starts", O.sql(_CODE, f"SELECT namespace, source_file, line_no, kind, name FROM ({_STARTS})"))
def unit_starts(spark, sf):
    return U.unit_starts(_lines(spark, sf)).select(*FILE, "line_no", "kind", "name")


_SP = O.lit(T.WHITESPACE)


@C.add("P3_indent_blocks", O.sql(_CODE + f""",
st AS (SELECT DISTINCT namespace, source_file, line_no FROM ({_STARTS}) WHERE language = 'python'),
pl AS (SELECT *, length(text) - length(ltrim(text, {_SP})) AS indent FROM cl WHERE language = 'python' AND trim(text, {_SP}) <> '')""", """
SELECT s.namespace, s.source_file, s.line_no, max(l.line_no) AS "end" FROM st s JOIN pl me USING (namespace, source_file, line_no)
JOIN pl l ON l.namespace = s.namespace AND l.source_file = s.source_file AND l.line_no >= s.line_no
WHERE NOT EXISTS (SELECT 1 FROM pl x WHERE x.namespace = s.namespace AND x.source_file = s.source_file AND x.line_no > s.line_no AND x.line_no <= l.line_no AND x.indent <= me.indent)
GROUP BY ALL"""))
def indent_blocks(spark, sf):
    lines = cut(_lines(spark, sf), "lines")
    return U.indent_ends(lines, U.unit_starts(lines)).select(*FILE, *big("line_no", "end"))


@C.add("P4_brace_blocks", O.sql(_CODE + f""",
st AS (SELECT DISTINCT namespace, source_file, line_no FROM ({_STARTS}) WHERE language NOT IN ('python', 'ruby')),
ev0 AS (SELECT namespace, source_file, line_no, unnest(regexp_extract_all(text, '[{{}}]')) AS c, generate_subscripts(regexp_extract_all(text, '[{{}}]'), 1) AS p FROM cl WHERE language NOT IN ('python', 'ruby')),
ev AS (SELECT *, sum(CASE c WHEN '{{' THEN 1 ELSE -1 END) OVER w AS depth, row_number() OVER w AS seq FROM ev0 WINDOW w AS (PARTITION BY namespace, source_file ORDER BY line_no, p)),
base AS (SELECT s.*, coalesce((SELECT sum(CASE e.c WHEN '{{' THEN 1 ELSE -1 END) FROM ev e WHERE e.namespace = s.namespace AND e.source_file = s.source_file AND e.line_no < s.line_no), 0) AS base,
  (SELECT min(e.seq) FROM ev e WHERE e.namespace = s.namespace AND e.source_file = s.source_file AND e.line_no >= s.line_no AND e.c = '{{') AS opened,
  (SELECT max(l.line_no) FROM cl l WHERE l.namespace = s.namespace AND l.source_file = s.source_file) AS last FROM st s)""", """
SELECT namespace, source_file, line_no, coalesce((SELECT min(e.line_no) FROM ev e WHERE e.namespace = b.namespace AND e.source_file = b.source_file AND e.c = '}' AND e.depth = b.base AND e.seq > b.opened), last) AS "end" FROM base b"""))
def brace_blocks(spark, sf):
    lines = cut(_lines(spark, sf), "lines")
    return U.brace_ends(lines, U.unit_starts(lines)).select(*FILE, *big("line_no", "end"))


@C.add("P5_end_blocks", O.sql(_CODE + f""",
st AS (SELECT DISTINCT namespace, source_file, line_no FROM ({_STARTS}) WHERE language = 'ruby'),
rb AS (SELECT *, CASE WHEN starts_with(t, '#') THEN 0 WHEN {O.rx('t', V.RUBY_OPEN)} THEN 1 WHEN t = 'end' THEN -1 ELSE 0 END AS step FROM (SELECT *, trim(text, {_SP}) AS t FROM cl WHERE language = 'ruby')),
ac AS (SELECT s.namespace, s.source_file, s.line_no, l.line_no AS spot, l.t, 1 + sum(l.step) OVER (PARTITION BY s.namespace, s.source_file, s.line_no ORDER BY l.line_no) AS depth
  FROM st s JOIN rb l ON l.namespace = s.namespace AND l.source_file = s.source_file AND l.line_no > s.line_no)""", """
SELECT namespace, source_file, line_no, coalesce(min(spot) FILTER (WHERE t = 'end' AND depth = 0), max(spot)) AS "end" FROM ac GROUP BY ALL"""))
def end_blocks(spark, sf):
    lines = cut(_lines(spark, sf), "lines")
    return U.end_blocks(lines, U.unit_starts(lines)).select(*FILE, *big("line_no", "end"))


@C.add("P6_unit_claims")
def unit_claims(spark, sf):
    claims = U.unit_claims(cut(U.unit_ranges(_lines(spark, sf)), "ranges"))
    return claims.select(*FILE, F.explode("units").alias("u")).select(
        *FILE, "u.kind", "u.name", "u.class_name", F.col("u.head").alias("start_line"), F.col("u.end").alias("end_line"))


def _units(spark, sf):
    return U.code_units(_files(spark, sf))


@C.add("P7_module_unit")
def module_unit(spark, sf):
    return _units(spark, sf).where(F.col("kind") == "module").select(
        *FILE, "language", "start_line", "end_line", F.sha2("text", 256).alias("text_hash"))


@C.add("P8_unit_docs")
def unit_docs(spark, sf):
    return _units(spark, sf).where("docstring <> '' or comments <> '' or size(decorators) > 0").select(
        *FILE, "name", "docstring", joined("decorators"), "comments")


_IMPORTS = "CASE " + " ".join(
    f"WHEN language IN ({O.lits(langs)}) THEN list_transform(regexp_extract_all(text, {O.lit('(?m)' + (p if langs != ['go'] else chr(94) + 'import' + chr(92) + 's+(?:' + chr(92) + '([' + chr(92) + 's' + chr(92) + 'S]*?' + chr(92) + ')|' + chr(34) + '.+' + chr(34) + ')'))}), lambda x: trim(x, {_SP}))"
    for langs, p in V.IMPORT_PATTERNS) + " ELSE CAST([] AS VARCHAR[]) END"


@C.add("P9_file_imports", O.sql(_CODE, f"SELECT namespace, source_file, array_to_string({_IMPORTS}, '|') AS imports FROM cf"))
def file_imports(spark, sf):
    f = U.with_language(views.code_files(spark, sf))
    return f.select(*FILE, joined(U.file_imports(F.col("text"), F.col("language")), "imports"))


_SECTION = "CASE language WHEN 'yaml' THEN " + O.lit(V.SECTION_PATTERNS["yaml"]) + " ELSE " + O.lit(V.SECTION_PATTERNS["toml"]) + " END"


@C.add("P10_config_sections", O.sql(_CODE + f""",
sec AS (SELECT *, CASE WHEN language = 'yaml' THEN regexp_extract(text, {O.lit(V.SECTION_PATTERNS['yaml'])}, 1) ELSE regexp_extract(text, {O.lit(V.SECTION_PATTERNS['toml'])}, 1) END AS name FROM cl
  WHERE (language = 'yaml' AND {O.rx('text', V.SECTION_PATTERNS['yaml'])}) OR (language IN ('toml', 'config') AND {O.rx('text', V.SECTION_PATTERNS['toml'])})),
spn AS (SELECT s.*, coalesce(lead(s.line_no) OVER (PARTITION BY s.namespace, s.source_file ORDER BY s.line_no), m.last + 1) - 1 AS stop FROM sec s
  JOIN (SELECT namespace, source_file, max(line_no) AS last FROM cl GROUP BY ALL) m USING (namespace, source_file))""", """
SELECT s.namespace, s.source_file, s.name, s.line_no AS start_line, s.stop AS end_line, string_agg(l.text, chr(10) ORDER BY l.line_no) AS text
FROM spn s JOIN cl l ON l.namespace = s.namespace AND l.source_file = s.source_file AND l.line_no BETWEEN s.line_no AND s.stop GROUP BY ALL"""))
def config_sections(spark, sf):
    s = U.config_sections(U.with_language(views.code_files(spark, sf)))
    return s.select(*FILE, "name", "start_line", "end_line", "text")


@C.add("P11_json_blocks", O.sql(_CODE + """,
js AS (SELECT namespace, source_file, text, unnest(json_keys(text)) AS name FROM cf WHERE language = 'json')""", """
SELECT j.namespace, j.source_file, j.name, min(l.line_no) AS start_line FROM js j JOIN cl l ON l.namespace = j.namespace AND l.source_file = j.source_file
  AND regexp_matches(l.text, '^\\s*"' || j.name || '"\\s*:') GROUP BY ALL"""))
def json_blocks(spark, sf):
    return U.json_blocks(U.with_language(views.code_files(spark, sf))).select(*FILE, "name", "start_line")


@C.add("P12_unit_chunks")
def unit_chunks(spark, sf):
    c = U.unit_chunks(_units(spark, sf))
    return c.select(*FILE, "line_start", "line_end", "chunk_kind", "function_name", "class_name", F.sha2("text", 256).alias("text_hash"))


@C.add("P13_parse_fallback", O.sql(_CODE, f"""
SELECT namespace, source_file, '<module>' AS name, CAST(1 AS BIGINT) AS start_line, CAST(len({O.lines('text')}) AS BIGINT) AS end_line, text FROM cf
WHERE language = 'text' AND length({O.strip('text')}) >= {V.MIN_MODULE_CHARS}"""))
def parse_fallback(spark, sf):
    f = U.with_language(views.code_files(spark, sf)).where(F.col("language") == "text")
    return U.whole_file_units(f).select(*FILE, "name", "start_line", "end_line", "text")


@C.add("P14_ingest_stats")
def ingest_stats(spark, sf):
    return U.ingest_stats(U.code_chunks(_files(spark, sf))).withColumn("rank", F.col("rank").cast("bigint"))


@C.add("F17_repo_urls", O.sql(O.REPOS, """
SELECT repo_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) IN ('http', 'https') AND regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) <> ''
  AND trim(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/') <> '' AS ok,
  regexp_replace(url, '^([A-Za-z][A-Za-z0-9+.-]*://)[^/?#@]*@', '\\1') AS redacted FROM repos"""))
def repo_urls(spark, sf):
    r = views.repos(spark, sf)
    return r.select("repo_id", T.repo_url_ok(F.col("url")).alias("ok"), T.redact_url(F.col("url")).alias("redacted"))


@C.add("F18_path_language", O.sql(O.PATHS, f"""
SELECT path, {O.case(O.extension('path'), V.DISPLAY_LANGUAGE, "''")} AS language, {O.basename('path')} AS name FROM paths"""))
def path_language(spark, sf):
    return views.paths(spark, sf).select("path", T.display_language(F.col("path")).alias("language"), T.basename(F.col("path")).alias("name"))


# ---- links ------------------------------------------------------------------------------


def _all(p: str, g: int, c: str = "text") -> str:
    return f"regexp_extract_all({c}, {O.lit(p)}, {g})"


def _refs_part(order: int, p: str, key: str, file: str, line: str, fn: str, owner: str, conf: float, groups: int) -> str:
    cols = ", ".join(f"unnest({_all(p, g)}) AS g{g}" for g in range(groups + 1))
    return (f"SELECT namespace, source_file, ord, {order} AS step, i, {key} AS key, {file} AS file_path, CAST({line} AS BIGINT) AS line_number, {fn} AS function_name, {owner} AS class_name, "
            f"{conf}::DOUBLE AS confidence, g0 AS source_text FROM (SELECT namespace, source_file, ord, {cols}, generate_subscripts({_all(p, 0)}, 1) AS i FROM log_view)")


_REFS = O.LOG_VIEW + ",\nraw_refs AS (" + " UNION ALL ".join([
    _refs_part(1, V.PY_FRAME, "g1 || ':' || g2 || ':' || g3", "g1", "g2", "g3", "''", 0.95, 3),
    _refs_part(2, V.JAVA_FRAME, "g3 || ':' || g4 || ':' || g2", "g3", "g4", "g2", "regexp_extract(g1, '[^.]*$')", 0.90, 4),
    _refs_part(3, V.JS_FRAME, "g2 || ':' || g3 || ':' || g1", "g2", "g3", "g1", "''", 0.90, 3),
    _refs_part(4, V.FILE_LINE, "g1 || ':' || g2", "g1", "g2", "''", "''", 0.80, 2),
    _refs_part(5, V.CLASS_METHOD, "'cm:' || g1 || '.' || g2", "''", "0", "g2", "g1", 0.70, 2) + f" WHERE g1 NOT IN ({O.lits(V.STOP_CLASSES)})",
    _refs_part(6, V.FUNCTION_WORD, "'func:' || g1", "''", "0", "g1", "''", 0.50, 1)]) + """),
refs AS (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY step, i) - 1 AS ref_no FROM (SELECT * FROM raw_refs QUALIFY row_number() OVER (PARTITION BY ord, key ORDER BY step, i) = 1))"""


@C.add("L1_code_refs", O.sql(_REFS, "SELECT namespace, ord, ref_no, file_path, line_number, function_name, class_name, confidence, source_text FROM refs"))
def code_refs(spark, sf):
    r = L.code_refs(views.log_view(spark, sf))
    return r.select(NS, "ord", *big("ref_no"), "file_path", "line_number", "function_name", "class_name", "confidence", "source_text")


_LINKS = _REFS + "," + O.CODE_CHUNKS + """,
want AS (
  SELECT namespace, ord, ref_no, 1 AS step, 'file' AS kind, regexp_extract(file_path, '[^/\\\\]*$') AS key FROM refs UNION ALL
  SELECT namespace, ord, ref_no, 2, 'file', file_path FROM refs UNION ALL SELECT namespace, ord, ref_no, 3, 'function', function_name FROM refs UNION ALL
  SELECT namespace, ord, ref_no, 4, 'class', class_name FROM refs),
have AS (
  SELECT DISTINCT * FROM (
  SELECT namespace, 'file' AS kind, regexp_extract(source_file, '[^/]*$') AS key, source_file, line_start FROM code_chunks UNION ALL
  SELECT namespace, 'file', source_file, source_file, line_start FROM code_chunks UNION ALL
  SELECT namespace, 'function', function_name, source_file, line_start FROM code_chunks UNION ALL
  SELECT namespace, 'class', class_name, source_file, line_start FROM code_chunks) WHERE key <> ''),
-- one entry needs only the places its distinct keys give, so keys are resolved once per distinct reference list
sig AS (SELECT ord, namespace, string_agg(kind || key, '|' ORDER BY ref_no, step) AS s, list(struct_pack(r := ref_no, t := step, kind := kind, key := key)) AS l FROM want WHERE key <> '' GROUP BY ALL),
usig AS (SELECT namespace, s, any_value(l) AS l FROM sig GROUP BY ALL),
uw AS (SELECT namespace, s, unnest(l) AS w FROM usig),
met AS (SELECT uw.namespace, uw.s, h.source_file AS code_file, h.line_start AS code_start, min(struct_pack(r := w.r, t := w.t, f := h.source_file, l := h.line_start)) AS seen
  FROM uw JOIN have h ON h.namespace = uw.namespace AND h.kind = w.kind AND h.key = w.key GROUP BY ALL),
place AS (SELECT *, row_number() OVER (PARTITION BY namespace, s ORDER BY seen) AS link_no FROM met QUALIFY link_no <= 5)"""


@C.add("L2_link_logs_code", O.sql(_LINKS, "SELECT sig.namespace, sig.ord, p.link_no, p.code_file, p.code_start FROM sig JOIN place p ON p.namespace = sig.namespace AND p.s = sig.s"))
def link_logs_code(spark, sf):
    links = L.link_logs_code(cut(L.code_refs(views.log_view(spark, sf)), "refs"), views.code_chunks(spark, sf))
    return links.select(NS, "ord", *big("link_no"), "code_file", "code_start")


_CROSS = _LINKS + """,
linked AS (SELECT sig.namespace, sig.ord, p.link_no, p.code_file, p.code_start FROM sig JOIN place p ON p.namespace = sig.namespace AND p.s = sig.s),
heads AS (SELECT namespace, ord, row_number() OVER (PARTITION BY namespace ORDER BY ord) AS no FROM (SELECT DISTINCT namespace, ord FROM linked) QUALIFY no <= 5),
rt AS (SELECT r.namespace, r.ord, string_agg('  - ' || concat_ws(', ', CASE WHEN file_path <> '' THEN 'file: ' || file_path END, CASE WHEN line_number <> 0 THEN 'line: ' || line_number END,
  CASE WHEN function_name <> '' THEN 'function: ' || function_name END, CASE WHEN class_name <> '' THEN 'class: ' || class_name END), chr(10) ORDER BY ref_no) AS refs
  FROM refs r JOIN heads USING (namespace, ord) GROUP BY ALL),
ct AS (SELECT l.namespace, l.ord, string_agg('*' || l.code_file || CASE WHEN c.function_name <> '' THEN ' → ' || c.function_name || '()' ELSE '' END || CASE WHEN c.class_name <> '' THEN ' [class: ' || c.class_name || ']' ELSE '' END
  || '* (lines ' || l.code_start || '–' || c.line_end || '):' || chr(10) || '```' || chr(10) || substring(c.text, 1, 800) || chr(10) || '```' || chr(10), chr(10) ORDER BY link_no) AS code
  FROM linked l JOIN heads USING (namespace, ord) JOIN code_chunks c ON c.namespace = l.namespace AND c.source_file = l.code_file AND c.line_start = l.code_start GROUP BY ALL)"""


@C.add("L3_cross_context", O.sql(_CROSS, """
SELECT h.namespace, string_agg('## Error #' || no || chr(10) || '**Log entry** (' || v.source_file || ', lines ' || h.ord || '–' || h.ord || '):' || chr(10) || '```' || chr(10) || substring(v.text, 1, 800) || chr(10) || '```' || chr(10) || chr(10)
  || '**Extracted references:**' || chr(10) || refs || chr(10) || chr(10) || '**Related source code:**' || chr(10) || chr(10) || code, chr(10) ORDER BY no) AS context
FROM heads h JOIN log_view v ON v.namespace = h.namespace AND v.ord = h.ord JOIN rt ON rt.namespace = h.namespace AND rt.ord = h.ord JOIN ct ON ct.namespace = h.namespace AND ct.ord = h.ord GROUP BY ALL"""))
def cross_context(spark, sf):
    log, code = cut(views.log_view(spark, sf), "log"), views.code_chunks(spark, sf)
    refs = cut(L.code_refs(log), "refs")
    links = cut(L.link_logs_code(refs, code), "links")
    return L.cross_context(log, refs, links, code)


# ---- symbol graph -----------------------------------------------------------------------


@C.add("G1_graph_nodes", O.sql(O.UNITS, """
SELECT DISTINCT namespace, 'file:' || source_file AS key, regexp_extract(source_file, '[^/]*$') AS name, 'file' AS kind, source_file, CAST(0 AS BIGINT) AS line_start, CAST(0 AS BIGINT) AS line_end, language, '' AS docstring, '' AS parent FROM units
UNION ALL SELECT namespace, 'symbol:' || name || '@' || source_file, name, kind, source_file, start_line, end_line, language, substring(docstring, 1, 200), class_name FROM units WHERE kind <> 'module'"""))
def graph_nodes(spark, sf):
    return G.graph_nodes(views.units(spark, sf))


@C.add("G2_edge_defines_contains", O.sql(O.UNITS, """
SELECT namespace, 'file:' || source_file AS source, 'symbol:' || name || '@' || source_file AS target, 'defines' AS relation FROM units WHERE kind <> 'module'
UNION ALL SELECT namespace, 'symbol:' || class_name || '@' || source_file, 'symbol:' || name || '@' || source_file, 'contains' FROM units WHERE kind = 'method' AND class_name <> ''"""))
def edge_defines(spark, sf):
    u = views.units(spark, sf)
    return G.edge_defines(u).unionByName(G.edge_contains(u))


_CALLS = O.UNITS + f""",
called AS (SELECT namespace, source_file, name AS caller, unnest(list_filter(list_distinct(regexp_extract_all(text, {O.lit(V.CALL)}, 1)), lambda n: n NOT IN ({O.lits(V.CALL_IGNORE)}) AND n <> name)) AS callee FROM units WHERE kind <> 'module')"""


@C.add("G3_edge_calls", O.sql(_CALLS, "SELECT namespace, 'symbol:' || caller || '@' || source_file AS source, 'symbol:' || callee AS target, 'calls' AS relation FROM called"))
def edge_calls(spark, sf):
    return G.edge_calls(views.units(spark, sf))


_IMP = _CALLS + """,
imported AS (SELECT DISTINCT namespace, source_file, unnest(['lib' || (doc_id % 5), 'fn' || (doc_id % 3), 'Service' || (doc_id % 4), 'mod' || (doc_id % 7), 'os', 'util' || (doc_id % 4)]) AS name FROM units WHERE kind = 'module')"""


@C.add("G4_edge_imports", O.sql(_IMP, "SELECT namespace, 'file:' || source_file AS source, 'module:' || name AS target, 'imports' AS relation FROM imported"))
def edge_imports(spark, sf):
    return G.edge_imports(views.units(spark, sf))


_TARGETS = _IMP + """,
targets AS (SELECT DISTINCT namespace, name FROM units WHERE kind <> 'module' UNION SELECT DISTINCT namespace, name FROM imported UNION SELECT DISTINCT namespace, callee FROM called)"""


def _targets(units):
    names = G.symbols(units).select(NS, "name").unionByName(G.file_imports(units).select(NS, "name")).unionByName(
        G.calls(units).select(NS, F.col("callee").alias("name")))
    return names.distinct()


@C.add("G5_files_importing", O.sql(_TARGETS + """,
defined AS (SELECT namespace, name AS caller, max(source_file) AS source_file FROM units WHERE kind <> 'module' GROUP BY ALL)""", """
SELECT namespace, name, source_file FROM targets JOIN imported USING (namespace, name)
UNION ALL SELECT DISTINCT t.namespace, t.name, d.source_file FROM targets t JOIN called c ON c.namespace = t.namespace AND c.callee = t.name JOIN defined d ON d.namespace = c.namespace AND d.caller = c.caller
WHERE NOT EXISTS (SELECT 1 FROM imported i WHERE i.namespace = t.namespace AND i.name = t.name)"""))
def files_importing(spark, sf):
    u = views.units(spark, sf)
    return G.files_importing(u, _targets(u))


@C.add("G6_symbols_in", O.sql(O.UNITS + """,
asked AS (SELECT DISTINCT namespace, regexp_extract(source_file, '[^/]*$') AS name FROM units)""", """
SELECT a.namespace, a.name, u.source_file, u.kind, u.name AS symbol, CAST(u.start_line AS BIGINT) AS start_line, CAST(u.end_line AS BIGINT) AS end_line
FROM asked a JOIN units u ON u.namespace = a.namespace AND contains(u.source_file, a.name) WHERE u.kind <> 'module'"""))
def symbols_in(spark, sf):
    u = views.units(spark, sf)
    asked = u.select(NS, T.basename(F.col("source_file")).alias("name")).distinct()
    return G.symbols_in(u, asked).select(NS, "name", "source_file", "kind", "symbol", "start_line", "end_line")


@C.add("G7_dependents_of", O.sql(_TARGETS, """
SELECT DISTINCT t.namespace, t.name, i.source_file FROM targets t JOIN imported i ON i.namespace = t.namespace AND contains(i.name, t.name)"""))
def dependents_of(spark, sf):
    u = views.units(spark, sf)
    return G.dependents_of(u, _targets(u))


@C.add("G7_dependents_by_stem", O.sql(_IMP + """,
asked AS (SELECT DISTINCT namespace, 'pkg/' || name || '.py' AS path FROM imported)""",
    "SELECT DISTINCT a.namespace, a.path, i.source_file FROM asked a JOIN imported i ON i.namespace = a.namespace AND a.path = 'pkg/' || i.name || '.py'"))
def dependents_by_stem(spark, sf):
    u = views.units(spark, sf)
    asked = G.file_imports(u).select(NS, F.concat(F.lit("pkg/"), "name", F.lit(".py")).alias("path")).distinct()
    return G.dependents_by_stem(u, asked)


@C.add("G8_methods_of", O.sql(O.UNITS, """
SELECT DISTINCT namespace, lower(class_name) AS name, class_name, name AS method FROM units WHERE kind = 'method' AND class_name <> ''"""))
def methods_of(spark, sf):
    u = views.units(spark, sf)
    asked = u.where("class_name <> ''").select(NS, F.lower("class_name").alias("name")).distinct()
    return G.methods_of(u, asked)


@C.add("G9_graph_summary", O.sql(_IMP, """
SELECT namespace, 'node' AS part, kind AS value, count(*) AS n FROM units WHERE kind <> 'module' GROUP BY ALL
UNION ALL SELECT namespace, 'node', 'file', count(DISTINCT source_file) FROM units GROUP BY ALL
UNION ALL SELECT namespace, 'edge', 'defines', count(*) FROM units WHERE kind <> 'module' GROUP BY ALL
UNION ALL SELECT namespace, 'edge', 'contains', count(*) FROM units WHERE kind = 'method' GROUP BY ALL
UNION ALL SELECT namespace, 'edge', 'calls', count(*) FROM called GROUP BY ALL
UNION ALL SELECT namespace, 'edge', 'imports', count(*) FROM imported GROUP BY ALL"""))
def graph_summary(spark, sf):
    u = views.units(spark, sf)
    return G.graph_counts(G.graph_nodes(u), G.graph_edges(u))


@C.add("G9_top_files", O.sql(O.UNITS, """
SELECT namespace, source_file, count(DISTINCT name) AS symbols, row_number() OVER (PARTITION BY namespace ORDER BY count(DISTINCT name) DESC, source_file) AS rank
FROM units WHERE kind <> 'module' GROUP BY namespace, source_file QUALIFY rank <= 20"""))
def top_files(spark, sf):
    return G.top_files(views.units(spark, sf)).withColumn("rank", F.col("rank").cast("bigint"))


_EVID = _IMP + """,
evid AS (SELECT CAST(substring(namespace, 3) AS BIGINT) AS query_id, namespace, source_file, name AS function_name, row_number() OVER (PARTITION BY namespace ORDER BY source_file, start_line, name) AS rank
  FROM units WHERE kind = 'method')"""


@C.add("G10_evidence_deps", O.sql(_EVID, """
SELECT DISTINCT e.query_id, e.namespace, i.source_file AS dependency FROM evid e JOIN imported i ON i.namespace = e.namespace AND (contains(i.name, e.source_file) OR i.name = e.function_name) WHERE e.rank <= 10"""))
def evidence_deps(spark, sf):
    u = views.units(spark, sf)
    methods = u.where(F.col("kind") == "method").select(
        F.expr("cast(substring(namespace, 3) as bigint)").alias("query_id"), *FILE, F.col("name").alias("function_name"), "start_line")
    evidence = G.first_n(methods, [NS], [F.col("source_file"), F.col("start_line"), F.col("function_name")], 10)
    return G.evidence_deps(u, evidence)


_LOOK = " ".join(f"WHEN {O.rx('q', p)} THEN {O.lit(k)}" for k, p in V.STRUCTURAL_LOOKUPS)
_ARG = " ".join(
    f"WHEN {O.rx('q', p)} THEN " + (f"trim({O.strip(f'regexp_extract(q, {O.lit(p)}, 1)')}, '''\"')" if k == "symbols" else f"regexp_extract(q, {O.lit(p)}, 1)")
    for k, p in V.STRUCTURAL_LOOKUPS)


@C.add("G11_structural_lookups", O.sql(O.QUESTIONS + f", qq AS (SELECT *, lower({O.strip('question')}) AS q FROM questions)", f"""
SELECT query_id, namespace, CASE {_LOOK} END AS lookup, CASE {_ARG} END AS name FROM qq WHERE CASE {_LOOK} END IS NOT NULL"""))
def structural_lookups(spark, sf):
    return G.structural_lookups(views.questions(spark, sf))


_ANSWERS = O.QUESTIONS + "," + _IMP.replace("unit_docs AS", "unit_docs AS", 1) + f""",
qq AS (SELECT *, lower({O.strip('question')}) AS q FROM questions),
look AS (SELECT DISTINCT namespace, CASE {_LOOK} END AS lookup, CASE {_ARG} END AS name FROM qq WHERE CASE {_LOOK} END IS NOT NULL),
defined AS (SELECT namespace, name AS caller, max(source_file) AS source_file FROM units WHERE kind <> 'module' GROUP BY ALL),
owned AS (SELECT DISTINCT namespace, class_name, name FROM units WHERE kind = 'method' AND class_name <> ''),
infile AS (SELECT l.namespace, l.name, min(u.source_file) AS source_file FROM look l JOIN units u ON u.namespace = l.namespace AND u.kind <> 'module' AND contains(u.source_file, l.name) WHERE l.lookup = 'symbols' AND l.name <> '' GROUP BY ALL)"""


@C.add("G11_structural_answers", O.sql(_ANSWERS, """
SELECT DISTINCT l.namespace, l.lookup, l.name, i.source_file AS item FROM look l JOIN imported i USING (namespace, name) WHERE lookup = 'importers'
UNION SELECT l.namespace, l.lookup, l.name, d.source_file FROM look l JOIN called c ON c.namespace = l.namespace AND c.callee = l.name JOIN defined d ON d.namespace = c.namespace AND d.caller = c.caller
  WHERE l.lookup = 'importers' AND NOT EXISTS (SELECT 1 FROM imported i WHERE i.namespace = l.namespace AND i.name = l.name)
UNION SELECT l.namespace, l.lookup, l.name, i.source_file FROM look l JOIN imported i ON i.namespace = l.namespace AND contains(i.name, l.name) WHERE lookup = 'dependents'
UNION SELECT l.namespace, l.lookup, l.name, o.name || '()' FROM look l JOIN owned o ON o.namespace = l.namespace AND lower(o.class_name) = l.name WHERE lookup = 'methods'
UNION SELECT f.namespace, 'symbols', f.name, u.kind || ': ' || u.name || ' (lines ' || u.start_line || '–' || u.end_line || ')' FROM infile f JOIN units u ON u.namespace = f.namespace AND u.source_file = f.source_file AND u.kind <> 'module'"""))
def structural_answers(spark, sf):
    lookups = cut(G.structural_lookups(views.questions(spark, sf)), "lookups")
    return G.structural_answers(views.units(spark, sf), lookups)


@C.add("G12_languages", O.sql(O.PATHS, f"""
SELECT namespace, language, count(*) AS files FROM (SELECT namespace, {O.case(O.extension('path'), V.DISPLAY_LANGUAGE, "''")} AS language FROM paths) WHERE language <> '' GROUP BY ALL"""))
def languages(spark, sf):
    return G.languages(views.paths(spark, sf))


@C.add("G12_entry_points", O.sql(O.PATHS, f"""
SELECT DISTINCT namespace, path FROM paths WHERE {O.rx(O.basename('path'), V.ENTRY_POINT_NAMES)} OR {O.rx('path', V.ENTRY_POINT_NAMES)} OR {O.rx('path', V.ENTRY_POINT_PATHS)}"""))
def entry_points(spark, sf):
    return G.entry_points(views.paths(spark, sf))


@C.add("G12_config_files", O.sql(O.PATHS, f"SELECT DISTINCT namespace, path FROM paths WHERE {O.rx(O.basename('path'), V.CONFIG_NAMES)}"))
def config_files(spark, sf):
    return G.config_files(views.paths(spark, sf))


_PURPOSE = "CASE " + " ".join(f"WHEN lower(module) IN ({O.lits(n)}) THEN {O.lit(t)}" for t, n in V.MODULE_PURPOSE) + " ELSE '' END"


@C.add("G13_modules", O.sql(O.UNITS + """,
mp AS (SELECT DISTINCT namespace, source_file AS path, split_part(source_file, '/', 1) AS module FROM units),
sized AS (SELECT namespace, module, count(*) AS files, row_number() OVER (PARTITION BY namespace ORDER BY count(*) DESC, module) AS rank FROM mp GROUP BY namespace, module QUALIFY rank <= 15),
named AS (SELECT namespace, split_part(source_file, '/', 1) AS module, kind, name, row_number() OVER (PARTITION BY namespace, split_part(source_file, '/', 1), kind ORDER BY source_file, start_line, name) AS p FROM units WHERE kind IN ('class', 'function') QUALIFY p <= 10)""", f"""
SELECT s.namespace, s.rank, s.module, s.files, (SELECT string_agg(l, '|' ORDER BY l) FROM (SELECT DISTINCT {O.case(O.extension('path'), V.DISPLAY_LANGUAGE, "''")} AS l FROM mp WHERE mp.namespace = s.namespace AND mp.module = s.module)) AS languages,
  (SELECT string_agg(name, '|' ORDER BY p) FROM named n WHERE n.namespace = s.namespace AND n.module = s.module AND kind = 'class') AS classes,
  (SELECT string_agg(name, '|' ORDER BY p) FROM named n WHERE n.namespace = s.namespace AND n.module = s.module AND kind = 'function') AS functions, {_PURPOSE} AS description
FROM sized s"""))
def modules(spark, sf):
    u = views.units(spark, sf)
    paths = u.select(NS, F.col("source_file").alias("path")).distinct()
    return G.modules(paths, u).select(NS, *big("rank"), "module", "files", joined("languages"), joined("classes"), joined("functions"), "description")


@C.add("G14_core_deps", O.sql(_IMP, """
SELECT namespace, name, count(*) AS files, row_number() OVER (PARTITION BY namespace ORDER BY count(*) DESC, name) AS rank FROM imported GROUP BY namespace, name QUALIFY rank <= 15"""))
def core_deps(spark, sf):
    return G.core_deps(views.units(spark, sf)).withColumn("rank", F.col("rank").cast("bigint"))


@C.add("G15_dir_tree", O.sql(O.PATHS + """,
parts AS (SELECT namespace, string_split(path, '/') AS p FROM paths),
folders AS (SELECT DISTINCT namespace, array_to_string(p[1:i], '/') AS folder FROM (SELECT namespace, p, unnest(range(1, least(len(p), 4))) AS i FROM parts))""", """
SELECT namespace, row_number() OVER (PARTITION BY namespace ORDER BY folder) AS rank, folder,
  repeat('  ', len(string_split(folder, '/')) - 1) || string_split(folder, '/')[-1] || CASE WHEN contains(string_split(folder, '/')[-1], '.') THEN '' ELSE '/' END AS line
FROM folders QUALIFY rank <= 40"""))
def dir_tree(spark, sf):
    return G.dir_tree(views.paths(spark, sf)).select(NS, *big("rank"), "folder", "line")


@C.add("G16_architecture_totals", O.sql(O.UNITS, """
SELECT namespace, count(DISTINCT source_file) AS total_files, count(*) FILTER (WHERE kind IN ('function', 'method')) AS total_functions, count(*) FILTER (WHERE kind = 'class') AS total_classes FROM units GROUP BY ALL"""))
def architecture_totals(spark, sf):
    u = views.units(spark, sf)
    return G.architecture_totals(u.select(NS, F.col("source_file").alias("path")).distinct(), u)


@C.add("G16_architecture_report")
def architecture_report(spark, sf):
    u = views.units(spark, sf)
    return G.architecture_report(u.select(NS, F.col("source_file").alias("path")).distinct(), u)
