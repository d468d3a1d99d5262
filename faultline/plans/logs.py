"""Registered queries over log entries: sources, text features, clusters, incidents, trends, scores."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions import text as T
from faultline.functions import vocab as V
from faultline.operators import errors, incidents, scoring, trends
from faultline.plans import oracle as O
from faultline.plans import views
from faultline.plans.registry import Catalog, big, joined, stamp
from faultline.session import cut, scratch_root
from faultline.sources import chunks, files, logs
from faultline.sources.chunktable import ChunkTable

C = Catalog()
NS = "namespace"


def stored(view: DataFrame) -> DataFrame:
    """The derived log, written once where a query reads it several times (real logs are stored anyway)."""
    return cut(view, "log")


# ---- sources ----------------------------------------------------------------------------


@C.add("S1_scan_project")
def scan_project(spark: SparkSession, sf: str) -> DataFrame:
    return files.scan_project(spark, sf, "given").select("namespace", "path", "length")


_IN = O.lits
_FOLDERS = "string_split(path, '/')[:-2]"
_LISTED = f"""NOT list_bool_or(list_transform({_FOLDERS}, lambda d: starts_with(d, '.') OR d IN ({_IN(V.SKIP_DIRS)})))
  AND {O.extension('path')} NOT IN ({_IN(V.SKIP_EXTENSIONS)})
  AND ({O.extension('path')} IN ({_IN(V.TEXT_EXTENSIONS)}) OR ends_with(lower(path), '.env.example')) AND length <= {V.MAX_FILE_BYTES}"""
_BUNDLE = " OR ".join(f"ends_with(lower(path), {O.lit(s)})" for s in V.SKIP_SUFFIXES)


@C.add("S2_filter_paths", O.sql(O.PATHS, f"""
SELECT namespace, path, length FROM paths WHERE {_LISTED}
  AND {O.basename('path')} NOT IN ({_IN(V.SKIP_FILENAMES)}) AND NOT ({_BUNDLE})"""))
def filter_paths(spark, sf):
    return files.filter_paths(views.paths(spark, sf))


@C.add("S3_list_indexed", O.sql(O.PATHS, f"SELECT DISTINCT namespace, path FROM paths WHERE {_LISTED} ORDER BY ALL"))
def list_indexed(spark, sf):
    return files.list_indexed(views.paths(spark, sf)).orderBy("namespace", "path")


@C.add("S4_decode_text", f"SELECT doc_id, text, length(text) AS chars FROM documents WHERE {O.strip('text')} <> ''")
def decode_text(spark, sf):
    d = views.table(spark, sf, "documents")
    latin = (F.col("doc_id") % 3 == 0) & (F.decode(F.encode("text", "ISO-8859-1"), "ISO-8859-1") == F.col("text"))
    content = F.when(latin, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    raw = d.select(F.lit("ns").alias("namespace"), F.col("doc_id").cast("string").alias("path"), content.alias("content"))
    return files.decode_text(raw).select(
        F.col("source_file").cast("bigint").alias("doc_id"), "text", F.length("text").cast("bigint").alias("chars"))


@C.add("S5_route_files", O.sql(O.PATHS, f"""
SELECT namespace, path, CASE WHEN {O.extension("replace(path, '.md', '.log')")} IN ('.log', '.out') THEN 'log' ELSE 'code' END AS route FROM paths"""))
def route_files(spark, sf):
    p = views.paths(spark, sf).withColumn("_p", F.regexp_replace("path", r"\.md", ".log"))
    logs_, code = p.where(files.is_log_file(F.col("_p"))), p.where(~files.is_log_file(F.col("_p")))
    return logs_.withColumn("route", F.lit("log")).unionByName(code.withColumn("route", F.lit("code"))).drop("_p", "length")


_ENTRIES = O.LOG_LINES + f""",
marked AS (SELECT *, {O.rx('text', V.ENTRY_START)} AS opens FROM log_lines),
numbered AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY namespace, source_file ORDER BY line_no) AS entry FROM marked),
parted AS (SELECT *, (line_no - min(line_no) OVER (PARTITION BY namespace, source_file, entry)) // {V.MAX_ENTRY_LINES} AS part FROM numbered),
blocks AS (SELECT namespace, source_file, min(line_no) AS line_start, max(line_no) AS line_end,
  {O.strip("string_agg(text, chr(10) ORDER BY line_no)")} AS text FROM parted GROUP BY namespace, source_file, entry, part),
log_entries AS (SELECT *, {O.ingest_severity('text')} AS severity, {O.entry_ts('text')} AS ts FROM blocks WHERE length(text) >= {V.MIN_CHUNK_CHARS})"""


@C.add("S6_log_entries", O.sql(_ENTRIES, f"""
SELECT namespace, source_file, line_start, line_end, text, severity, {O.ts_text('ts')} AS detected_timestamp, {O.basename('source_file')} AS file_name
FROM log_entries"""))
def log_entries(spark, sf):
    out = logs.log_entries(views.log_lines(spark, sf))
    return out.withColumn("detected_timestamp", F.date_format("detected_timestamp", "yyyy-MM-dd HH:mm:ss"))


@C.add("S8_log_dir", O.sql(_ENTRIES, """
SELECT source_file, line_start, line_end, text, severity, dense_rank() OVER (ORDER BY source_file) AS file_no FROM (
  SELECT namespace || '/' || source_file AS source_file, line_start, line_end, text, severity FROM log_entries)"""))
def log_dir(spark, sf):
    """The log lines written as text files, one folder per log, read back in byte ranges."""
    lines = views.log_lines(spark, sf).withColumn("file", F.concat_ws("/", "namespace", "source_file"))
    root = f"{scratch_root(spark)}/faultline-logs-{uuid.uuid4().hex}"
    ordered = lines.repartition("file").sortWithinPartitions("file", "line_no")
    ordered.select("file", "text").write.partitionBy("file").text(root)
    found = logs.log_dir_chunks(logs.read_log_lines(spark, root, "logs"))
    name = F.url_decode(F.regexp_extract("source_file", r"file=([^/]+)/", 1))  # the folder's name is escaped
    file_no = F.shiftright("ord", 40).cast("bigint").alias("file_no")
    return found.select(name.alias("source_file"), *big("line_start", "line_end"), "text", "severity", file_no)


_SPARSE = O.DOC_FILES + """,
sparse_files AS (SELECT namespace, source_file, repeat(chr(10), 60) || array_to_string(string_split(substring(regexp_replace(text, '[^a-z]', 'x', 'g'), 1, 40), ''), chr(10)) || repeat(chr(10), 40) AS text FROM doc_files),
sparse_lines AS (SELECT namespace, source_file, text, string_split(substring(text, 1, length(text) - 1), chr(10)) AS l FROM sparse_files),
sparse_windows AS (SELECT namespace, source_file, i + 1 AS line_start, least(i + 40, len(l)) AS line_end, array_to_string(l[i + 1 : i + 40], chr(10)) AS text FROM (SELECT *, unnest(range(0, len(l), 32)) AS i FROM sparse_lines))"""


@C.add("S7_log_fallback", O.sql(_SPARSE, f"""
SELECT namespace, source_file, line_start, line_end, text, {O.ingest_severity('text')} AS severity FROM sparse_windows w WHERE length({O.strip('text')}) >= {V.MIN_CHUNK_CHARS}
AND NOT EXISTS (SELECT 1 FROM sparse_lines f WHERE f.namespace = w.namespace AND f.source_file = w.source_file AND (
  list_bool_or(list_transform(l, lambda x: {O.rx('x', V.ENTRY_START)}))
  OR len(list_filter(list_transform(range(0, len(l), 80), lambda i: array_to_string(l[i + 1 : i + 80], chr(10))), lambda t: length({O.strip('t')}) >= {V.MIN_CHUNK_CHARS})) > 0))"""))
def log_fallback(spark, sf):
    lines = logs.number_lines(views.sparse_files(spark, sf))
    out = logs.log_fallback(lines, logs.log_entries(lines))
    return out.select("namespace", "source_file", *big("line_start", "line_end"), "text", "severity")


@C.add("S9_line_windows", O.sql(O.DOC_FILES + "," + O.windows("doc_files", "w"), """
SELECT namespace, source_file, CAST(line_start AS BIGINT) AS line_start, CAST(line_end AS BIGINT) AS line_end, text FROM w"""))
def line_windows(spark, sf):
    return chunks.line_windows(views.doc_files(spark, sf))


@C.add("S9_line_windows_of_numbered_lines", O.sql(O.LOG_LINES + f""",
spread AS (SELECT *, unnest([(line_no - 1) // 32, (line_no - 1) // 32 - 1]) AS w FROM log_lines),
inside AS (SELECT * FROM spread WHERE w >= 0 AND line_no - 1 < w * 32 + 40)""", f"""
SELECT namespace, source_file, min(line_no) AS line_start, max(line_no) AS line_end, string_agg(text, chr(10) ORDER BY line_no) AS text
FROM inside GROUP BY namespace, source_file, w HAVING length({O.strip("string_agg(text, chr(10) ORDER BY line_no)")}) >= {V.MIN_CHUNK_CHARS}"""))
def numbered_windows(spark, sf):
    return logs.windows_of_lines(views.log_lines(spark, sf)).select(
        "namespace", "source_file", *big("line_start", "line_end"), "text")


def doc_chunks(spark: SparkSession, sf: str) -> DataFrame:
    w = chunks.with_ids(chunks.line_windows(views.doc_files(spark, sf)))
    return w.withColumn("severity", T.ingest_severity(F.col("text")))


@C.add("S10_upsert_chunks", O.sql(O.DOC_CHUNKS, """
SELECT namespace, chunk_id, source_file, CAST(line_start AS BIGINT) AS line_start,
  CASE WHEN line_start % 64 = 1 THEN 'v2 ' || text ELSE text END AS text, CASE WHEN line_start % 64 = 1 THEN 2 ELSE 1 END AS load_ts
FROM doc_chunks"""))
def upsert_chunks(spark, sf):
    old = doc_chunks(spark, sf).select("namespace", "chunk_id", "source_file", "line_start", "text", F.lit(1).alias("load_ts"))
    new = old.where(F.col("line_start") % 64 == 1).select(
        "namespace", "chunk_id", "source_file", "line_start", F.concat(F.lit("v2 "), F.col("text")).alias("text"), F.lit(2).alias("load_ts"))
    return chunks.upsert_chunks(old, new)


@C.add("S10_versioned_table", O.sql(O.DOC_CHUNKS, """
SELECT namespace, chunk_id, source_file, CAST(line_start AS BIGINT) AS line_start, CASE WHEN line_start % 64 = 1 THEN 'v2 ' || text ELSE text END AS text, CAST(2 AS BIGINT) AS version
FROM doc_chunks WHERE namespace <> 'ns1'"""))
def versioned_table(spark, sf):
    """Two loads, one that changes nothing, a namespace ended: what the table holds, and the version each namespace is of."""
    held = ChunkTable(spark, f"{scratch_root(spark)}/faultline-chunks-{uuid.uuid4().hex}")
    first = cut(doc_chunks(spark, sf).select("namespace", "chunk_id", "source_file", "line_start", "text", F.lit(1).alias("load_ts")), "chunks")
    again = F.col("line_start") % 64 == 1
    held.upsert(first)
    held.upsert(first.where(again).withColumn("text", F.concat(F.lit("v2 "), F.col("text"))).withColumn("load_ts", F.lit(2)))
    held.upsert(first.where(~again).withColumn("load_ts", F.lit(3)))
    held.delete("ns1")
    return held.read().join(held.current(), NS).select(NS, "chunk_id", "source_file", "line_start", "text", "version")


@C.add("S11_delete_namespace", O.sql(O.DOC_CHUNKS, """
SELECT namespace, chunk_id FROM doc_chunks WHERE namespace <> 'ns1'"""))
def delete_namespace(spark, sf):
    return chunks.delete_namespace(doc_chunks(spark, sf), "ns1").select("namespace", "chunk_id")


_TRIMMED = "regexp_replace(trim(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), '\\.git$', '')"


@C.add("S12_repo_metadata", O.sql(O.REPOS, f"""
SELECT repo_id, CASE WHEN len(string_split({_TRIMMED}, '/')) >= 2 THEN string_split({_TRIMMED}, '/')[-2] END AS repo_owner,
  nullif(string_split({_TRIMMED}, '/')[-1], '') AS repo_name, CASE WHEN branch = 'HEAD' THEN 'default' ELSE branch END AS branch,
  substring(commit_sha, 1, 12) AS commit_hash, substring({O.strip('commit_message')}, 1, 200) AS commit_message, author AS commit_author
FROM repos"""))
def repo_metadata(spark, sf):
    m = chunks.repo_metadata(views.repos(spark, sf))
    keys = ("repo_owner", "repo_name", "branch", "commit_hash", "commit_message", "commit_author")
    return m.select("repo_id", *[F.try_element_at("repo", F.lit(k)).alias(k) for k in keys])


# ---- text features ----------------------------------------------------------------------


def _feature(name: str, out: str, spark_expr, duck: str, untimed: bool = False) -> None:
    source = views.log_view_untimed if untimed else views.log_view
    cte, view = (O.LOG_UNTIMED, "log_mixed") if untimed else (O.LOG_VIEW, "log_view")

    @C.add(name, O.sql(cte, f"SELECT ord, {duck} AS {out} FROM {view}"))
    def run(spark, sf):
        return source(spark, sf).select("ord", spark_expr(F.col("text")).alias(out))


_feature("F1_ingest_severity", "severity", T.ingest_severity, O.ingest_severity("text"))
_feature("F2_severity", "severity", T.severity, O.severity("text"))
_feature("F3_entry_timestamp", "ts", lambda c: T.ts_text(T.entry_timestamp(c)), O.ts_text(O.entry_ts("text")), True)
_feature("F4_normalise_error", "norm", T.normalise_error, O.normalise("text"))
_feature("F5_exception_type", "exception_type", T.exception_type, O.exception_type("text"))
_feature("F6_stack_frames", "frames", lambda c: joined(T.stack_frames(c)), f"array_to_string({O.frames('text')}, '|')")
_feature("F7_file_line_refs", "refs",
         lambda c: F.array_join(F.transform(T.file_line_refs(c), lambda r: F.concat(r["file"], F.lit("#"), r["line"].cast("string"))), "|"),
         f"array_to_string(list_transform(list_zip({O.ref_files('text')}, {O.ref_lines('text')}), lambda r: r[1] || '#' || CAST(r[2] AS BIGINT)), '|')")
_feature("F8_function_refs", "functions", lambda c: joined(F.array_sort(T.function_refs(c))),
         f"array_to_string(list_sort({O.functions('text')}), '|')")
_feature("F9_error_signature", "signature", T.error_signature, O.signature("text"), True)
_feature("F10_failure_signature", "signature", T.failure_signature, O.failure("text"))
_feature("F12_keywords", "words", lambda c: joined(F.array_sort(T.keywords(c))), f"array_to_string(list_sort({O.keywords('text')}), '|')")


@C.add("F12_keywords_of_documents", f"SELECT doc_id, array_to_string(list_sort({O.keywords('text')}), '|') AS words FROM documents")
def document_keywords(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", joined(F.array_sort(T.keywords(F.col("text"))), "words"))


# ---- error clusters ---------------------------------------------------------------------


def _similarity(a: str, b: str) -> str:
    va, vb = f"substring({a}, 5)", f"substring({b}, 5)"
    ta, tb = (f"list_distinct(list_filter(string_split_regex({v}, '\\s+'), lambda t: t <> ''))" for v in (va, vb))
    return (f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN left({a}, 4) <> left({b}, 4) THEN 0.0 "
            f"WHEN left({a}, 4) = 'exc:' THEN CASE WHEN contains({va}, {vb}) OR contains({vb}, {va}) THEN 0.8 ELSE 0.0 END "
            f"WHEN left({a}, 4) = 'msg:' THEN len(list_intersect({ta}, {tb}))::DOUBLE / len(list_distinct(list_concat({ta}, {tb}))) ELSE 0.0 END")


_SEV_RANK = O.case("sev", V.SEVERITY_ORDER, "0")
_LE = O.LOG_VIEW + f""",
le AS (
  SELECT *, {_SEV_RANK} AS rk FROM (
    SELECT namespace, source_file, ord, text, {O.severity('text')} AS sev, {O.entry_ts('text')} AS ts, {O.signature('text')} AS sig,
      {O.exception_type('text')} AS exc, {O.frames('text')} AS frames, {O.ref_files('text')} AS rfiles, {O.functions('text')} AS funcs,
      {O.normalise('text')} AS norm FROM log_view)
  WHERE sev IN ({O.lits(V.CLUSTERED_SEVERITIES)})),
sg AS (SELECT namespace, sig, count(*) AS n, min(ord) AS pos, min(ts) AS first_ts, max(ts) AS last_ts, arg_max(sev, rk) AS sev, max(rk) AS rk FROM le GROUP BY ALL),
sf AS (SELECT DISTINCT namespace, sig, unnest(frames) AS frame FROM le),
shared AS (SELECT a.namespace, a.sig AS sig_a, b.sig AS sig_b, count(*) AS c FROM sf a JOIN sf b USING (namespace, frame) WHERE a.sig <> b.sig GROUP BY ALL),
spairs AS (
  SELECT x.namespace, x.pos AS a, y.pos AS b, x.sig AS sig_a, y.sig AS sig_b, {_similarity('x.sig', 'y.sig')} AS similarity
  FROM sg x JOIN sg y ON x.namespace = y.namespace AND x.pos < y.pos
  LEFT JOIN shared s ON s.namespace = x.namespace AND s.sig_a = x.sig AND s.sig_b = y.sig
  WHERE {_similarity('x.sig', 'y.sig')} >= 0.5 OR coalesce(s.c, 0) >= 2)"""
_MERGED = _LE + """,
nodes AS (
  SELECT g.namespace, g.sig, g.pos, row_number() OVER (PARTITION BY g.namespace ORDER BY g.pos) AS i, coalesce(p.near, CAST([] AS BIGINT[])) AS near
  FROM sg g LEFT JOIN (SELECT namespace, b, list(a) AS near FROM spairs GROUP BY ALL) p ON p.namespace = g.namespace AND p.b = g.pos),
walk AS (
  SELECT DISTINCT namespace, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS led FROM nodes
  UNION ALL
  SELECT w.namespace, n.i, CASE WHEN list_has_any(w.led, n.near) THEN w.led ELSE list_append(w.led, n.pos) END
  FROM walk w JOIN nodes n ON n.namespace = w.namespace AND n.i = w.i + 1),
leads AS (SELECT namespace, unnest(led) AS leader FROM (SELECT namespace, arg_max(led, i) AS led FROM walk GROUP BY namespace)),
member AS (
  SELECT n.namespace, n.sig, n.pos, min(l.leader) AS leader FROM nodes n JOIN leads l ON l.namespace = n.namespace
    AND (l.leader = n.pos OR list_contains(n.near, l.leader)) GROUP BY ALL),
clustered AS (SELECT *, dense_rank() OVER (PARTITION BY namespace ORDER BY leader) AS cluster_id FROM member),
ce AS (SELECT le.*, c.cluster_id, c.pos FROM le JOIN clustered c ON c.namespace = le.namespace AND c.sig = le.sig),
core AS (
  SELECT c.namespace, c.cluster_id, CAST(sum(g.n) AS BIGINT) AS count, arg_max(g.sig, struct_pack(n := g.n, p := -g.pos)) AS primary_signature,
    coalesce(arg_max(substring(g.sig, 5), struct_pack(n := g.n, p := -g.pos)) FILTER (WHERE g.sig LIKE 'exc:%'), '') AS exception_type,
    min(g.first_ts) AS first_seen, max(g.last_ts) AS last_seen, arg_max(g.sev, g.rk) AS severity
  FROM clustered c JOIN sg g ON g.namespace = c.namespace AND g.sig = c.sig GROUP BY ALL),
cfiles AS (SELECT namespace, cluster_id, list_sort(list_distinct(list(f)))[1:10] AS v FROM (
  SELECT namespace, cluster_id, unnest(list_concat([regexp_extract(source_file, '[^/]*$')], list_transform(rfiles, lambda r: regexp_extract(r, '[^/\\\\]*$')))) AS f FROM ce) GROUP BY ALL),
cfuncs AS (SELECT namespace, cluster_id, list_sort(list_distinct(list(f)))[1:10] AS v FROM (SELECT namespace, cluster_id, unnest(funcs) AS f FROM ce) GROUP BY ALL),
cmsg AS (SELECT namespace, cluster_id, norm, arg_min(substring(split_part(text, chr(10), 1), 1, 150), struct_pack(p := pos, o := ord)) AS sample, min(struct_pack(p := pos, o := ord)) AS seen FROM ce GROUP BY ALL),
csamp AS (SELECT *, row_number() OVER (PARTITION BY namespace, cluster_id ORDER BY seen) AS rank FROM cmsg QUALIFY rank <= 3),
cfr0 AS (SELECT namespace, cluster_id, pos, ord, unnest(frames) AS frame, generate_subscripts(frames, 1) AS idx FROM ce),
cfr1 AS (SELECT namespace, cluster_id, frame, count(*) AS hits, min(struct_pack(p := pos, o := ord, i := idx)) AS seen FROM cfr0 GROUP BY ALL),
cframes AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY namespace, cluster_id ORDER BY hits DESC, seen) AS rank FROM cfr1) WHERE rank <= 5 AND hits >= 2)"""


@C.add("E1_error_entries", O.sql(_LE, f"""
SELECT namespace, ord, sev AS severity, {O.ts_text('ts')} AS ts, sig AS signature, exc AS exception_type, array_to_string(frames, '|') AS frames,
  array_to_string(rfiles, '|') AS ref_files, array_to_string(list_sort(funcs), '|') AS functions, norm FROM le"""))
def error_entries(spark, sf):
    e = errors.error_entries(views.log_view(spark, sf))
    return e.select(NS, "ord", "severity", stamp("ts"), "signature", "exception_type", joined("frames"),
                    joined(F.col("refs.file"), "ref_files"), joined(F.array_sort("functions"), "functions"), "norm")


def _facts(spark, sf):
    return errors.signature_facts(errors.error_entries(stored(views.log_view(spark, sf))))


@C.add("E2_signature_groups", O.sql(_LE, f"""
SELECT namespace, sig AS signature, n, pos, {O.ts_text('first_ts')} AS first_ts, {O.ts_text('last_ts')} AS last_ts, sev AS severity FROM sg"""))
def signature_groups(spark, sf):
    g = errors.signature_groups(_facts(spark, sf))
    return g.select(NS, "signature", "n", "pos", stamp("first_ts"), stamp("last_ts"), "severity")


@C.add("E3_signature_pairs", O.sql(_LE, "SELECT namespace, sig_a, sig_b, round(similarity, 6) AS similarity FROM spairs"))
def signature_pairs(spark, sf):
    return errors.signature_pairs(cut(_facts(spark, sf), "facts")).withColumn("similarity", F.round("similarity", 6))


@C.add("F11_signature_similarity", O.sql(_LE + """,
seq AS (SELECT namespace, sig AS a, lead(sig) OVER (PARTITION BY namespace ORDER BY pos) AS b FROM sg)""",
    f"SELECT namespace, a, b, round({_similarity('a', 'b')}, 6) AS similarity FROM seq WHERE b IS NOT NULL"))
def signature_similarity(spark, sf):
    from pyspark.sql import Window

    g = errors.signature_groups(_facts(spark, sf))
    w = Window.partitionBy(NS).orderBy("pos")
    g = g.select(NS, F.col("signature").alias("a"), F.lead("signature").over(w).alias("b")).where("b is not null")
    return g.withColumn("similarity", F.round(T.signature_similarity(F.col("a"), F.col("b")), 6))


def _clusters(spark, sf):
    return errors.cluster_errors(stored(views.log_view(spark, sf)))


@C.add("E4_leader_merge", O.sql(_MERGED, "SELECT namespace, sig AS signature, leader, cluster_id FROM clustered"))
def leader_merge(spark, sf):
    return _clusters(spark, sf).members.select(NS, "signature", "leader", *big("cluster_id"))


@C.add("E5_cluster_profile", O.sql(_MERGED, f"""
SELECT namespace, cluster_id, count, primary_signature, substring(primary_signature, 5) AS error_signature, exception_type,
  {O.ts_text('first_seen')} AS first_seen, {O.ts_text('last_seen')} AS last_seen FROM core"""))
def cluster_profile(spark, sf):
    c = errors.cluster_core(_clusters(spark, sf))
    return c.select(NS, *big("cluster_id", "count"), "primary_signature", "error_signature", "exception_type",
                    stamp("first_seen"), stamp("last_seen"))


@C.add("E6_cluster_files", O.sql(_MERGED, "SELECT namespace, cluster_id, array_to_string(v, '|') AS files FROM cfiles"))
def cluster_files(spark, sf):
    v = errors.cluster_values(_clusters(spark, sf), "file")
    return v.groupBy(NS, "cluster_id").agg(joined(errors.ordered_list("rank", "value"), "files")).withColumn(
        "cluster_id", F.col("cluster_id").cast("bigint"))


@C.add("E6_cluster_functions", O.sql(_MERGED, "SELECT namespace, cluster_id, array_to_string(v, '|') AS functions FROM cfuncs"))
def cluster_functions(spark, sf):
    v = errors.cluster_values(_clusters(spark, sf), "function")
    return v.groupBy(NS, "cluster_id").agg(joined(errors.ordered_list("rank", "value"), "functions")).withColumn(
        "cluster_id", F.col("cluster_id").cast("bigint"))


@C.add("E7_cluster_severity", O.sql(_MERGED, "SELECT namespace, cluster_id, severity FROM core"))
def cluster_severity(spark, sf):
    return errors.cluster_core(_clusters(spark, sf)).select(NS, *big("cluster_id"), "severity")


@C.add("E8_cluster_samples", O.sql(_MERGED, "SELECT namespace, cluster_id, rank, sample FROM csamp"))
def cluster_samples(spark, sf):
    return errors.cluster_samples(_clusters(spark, sf)).select(NS, *big("cluster_id", "rank"), "sample")


@C.add("E9_common_frames", O.sql(_MERGED, "SELECT namespace, cluster_id, rank, frame, hits FROM cframes"))
def common_frames(spark, sf):
    return errors.common_frames(_clusters(spark, sf)).select(NS, *big("cluster_id", "rank", "hits"), "frame")


@C.add("E10_cluster_report", O.sql(_MERGED, """
SELECT l.namespace, l.n AS total_entries, c.k AS cluster_count, l.n - c.s AS unclustered_count, dom.cluster_id AS dominant_cluster_id,
  substring(dom.primary_signature, 5) AS dominant_signature, dom.count AS dominant_count
FROM (SELECT namespace, count(*) AS n FROM log_view GROUP BY ALL) l
JOIN (SELECT namespace, count(*) AS k, CAST(sum(count) AS BIGINT) AS s FROM core GROUP BY ALL) c USING (namespace)
JOIN (SELECT * FROM core QUALIFY row_number() OVER (PARTITION BY namespace ORDER BY count DESC, cluster_id) = 1) dom USING (namespace)"""))
def cluster_report(spark, sf):
    log = stored(views.log_view(spark, sf))
    out = errors.cluster_report(log, errors.cluster_core(errors.cluster_errors(log)))
    return out.select(NS, *big("total_entries", "cluster_count", "unclustered_count", "dominant_cluster_id"),
                      "dominant_signature", *big("dominant_count"))


# ---- trends -----------------------------------------------------------------------------

_ERR = O.lits(V.ERROR_SEVERITIES)
_TS = O.LOG_UNTIMED + f""",
st AS (SELECT *, {O.severity('text')} AS sev, {O.entry_ts('text')} AS ts FROM log_mixed),
hourly AS (SELECT namespace, date_trunc('hour', ts) AS hour, count(*) AS errors FROM st WHERE sev IN ({_ERR}) AND ts IS NOT NULL GROUP BY ALL),
spikes AS (SELECT *, avg(errors) OVER (PARTITION BY namespace) AS mean, count(*) OVER (PARTITION BY namespace) AS hours FROM hourly
  QUALIFY errors >= 2 * mean AND errors >= 2 AND hours >= 2),
repeats AS (SELECT namespace, signature, count(*) AS occurrences, min(ts) AS first_seen, max(ts) AS last_seen FROM (
  SELECT namespace, ts, {O.failure('text')} AS signature FROM st WHERE sev IN ({O.lits(V.CLUSTERED_SEVERITIES)})) WHERE signature IS NOT NULL
  GROUP BY ALL HAVING count(*) >= 2),
totals AS (SELECT namespace, count(*) AS entries, count(*) FILTER (WHERE sev IN ({_ERR})) AS total_errors,
  count(*) FILTER (WHERE sev = 'warning') AS total_warnings, min(ts) AS range_start, max(ts) AS range_end FROM st GROUP BY ALL)"""


@C.add("T1_hourly_errors", O.sql(_TS, f"SELECT namespace, {O.ts_text('hour')} AS hour, errors FROM hourly"))
def hourly_errors(spark, sf):
    return trends.hourly_errors(views.log_view_untimed(spark, sf)).select(NS, stamp("hour"), "errors")


@C.add("T2_severity_totals", O.sql(_TS, f"""
SELECT namespace, entries, total_errors, total_warnings, {O.ts_text('range_start')} AS range_start, {O.ts_text('range_end')} AS range_end FROM totals"""))
def severity_totals(spark, sf):
    t = trends.severity_totals(views.log_view_untimed(spark, sf))
    return t.select(NS, "entries", "total_errors", "total_warnings", stamp("range_start"), stamp("range_end"))


@C.add("T3_spikes", O.sql(_TS, f"""
SELECT namespace, {O.ts_text('hour')} AS start, {O.ts_text('hour + INTERVAL 1 HOUR')} AS "end", errors, round(mean, 2) AS avg_rate,
  CASE WHEN errors / mean >= 3 THEN 'spike' ELSE 'elevated' END AS severity FROM spikes"""))
def spikes(spark, sf):
    s = trends.spikes(trends.hourly_errors(views.log_view_untimed(spark, sf)))
    return s.select(NS, stamp("start"), stamp("end"), "errors", "avg_rate", "severity")


@C.add("T4_repeating_failures", O.sql(_TS, f"""
SELECT namespace, signature, occurrences, {O.ts_text('first_seen')} AS first_seen, {O.ts_text('last_seen')} AS last_seen FROM repeats"""))
def repeating_failures(spark, sf):
    r = trends.repeating_failures(views.log_view_untimed(spark, sf))
    return r.select(NS, "signature", "occurrences", stamp("first_seen"), stamp("last_seen"))


@C.add("T5_trend_report", O.sql(_TS, f"""
SELECT t.namespace, entries, total_errors, total_warnings, coalesce(s.n, 0) AS spikes, coalesce(r.n, 0) AS repeating,
  coalesce(s.n, 0) + coalesce(r.n, 0) > 0 AS has_trends,
  'Time Range: ' || {O.ts_text('range_start')} || ' → ' || {O.ts_text('range_end')} || chr(10) || 'Totals: ' || total_errors || ' error(s), ' ||
  total_warnings || ' warning(s) across ' || entries || ' log entries' AS summary
FROM totals t LEFT JOIN (SELECT namespace, count(*) AS n FROM spikes GROUP BY ALL) s USING (namespace)
LEFT JOIN (SELECT namespace, count(*) AS n FROM repeats GROUP BY ALL) r USING (namespace)"""))
def trend_report(spark, sf):
    return trends.trend_report(views.log_view_untimed(spark, sf))


_TIMES = _MERGED + f""",
sts AS (SELECT namespace, substring({O.signature('text')}, 5) AS clean, {O.entry_ts('text')} AS ts FROM log_view),
gaps AS (SELECT *, date_diff('second', lag(ts) OVER (PARTITION BY namespace, clean ORDER BY ts), ts) AS gap FROM sts WHERE ts IS NOT NULL),
stat AS (SELECT namespace, clean, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, max(gap) AS max_gap_s,
  count(*) FILTER (WHERE ts >= {O.REF} - INTERVAL 1 HOUR) AS last_1h, count(*) FILTER (WHERE ts >= {O.REF} - INTERVAL 24 HOUR) AS last_24h,
  count(*) FILTER (WHERE ts >= {O.REF} - INTERVAL 48 HOUR AND ts < {O.REF} - INTERVAL 24 HOUR) AS prev_24h FROM gaps GROUP BY ALL),
ctimes AS (SELECT c.namespace, c.cluster_id, c.count AS total, s.* EXCLUDE (namespace, clean) FROM core c
  LEFT JOIN stat s ON s.namespace = c.namespace AND s.clean = substring(c.primary_signature, 5)),
cpct AS (SELECT *, CASE WHEN n IS NULL THEN 0.0 WHEN prev_24h > 0 THEN (last_24h - prev_24h) / prev_24h * 100.0 WHEN last_24h > 0 THEN 100.0 ELSE 0.0 END AS pct_change FROM ctimes),
ctrend AS (SELECT *, CASE WHEN n IS NULL THEN 'unknown'
  WHEN last_1h >= 2.0 * (total / greatest(1.0, date_diff('second', first_ts, last_ts) / 3600.0)) AND last_1h >= 2 THEN 'spike'
  WHEN first_ts >= {O.REF} - INTERVAL 24 HOUR THEN 'new' WHEN n < 2 THEN 'stable'
  WHEN max_gap_s / 3600.0 >= 6 AND last_ts >= {O.REF} - INTERVAL 24 HOUR THEN 'regression'
  WHEN pct_change <= -30 THEN 'declining' WHEN pct_change >= 50 THEN 'spike' ELSE 'stable' END AS trend_label FROM cpct)"""


def _trends(spark, sf):
    log = stored(views.log_view(spark, sf))
    return trends.cluster_trends(errors.cluster_core(errors.cluster_errors(log)), log, views.ref_time())


@C.add("T6_cluster_timestamps", O.sql(_TIMES, f"""
SELECT namespace, cluster_id, total, n, {O.ts_text('first_ts')} AS first_ts, {O.ts_text('last_ts')} AS last_ts FROM ctimes"""))
def cluster_timestamps(spark, sf):
    log = stored(views.log_view(spark, sf))
    core = errors.cluster_core(errors.cluster_errors(log))
    t = trends.cluster_times(core, trends.signature_times(log, views.ref_time()))
    return t.select(NS, *big("cluster_id", "total", "n"), stamp(F.timestamp_seconds("first_s"), "first_ts"),
                    stamp(F.timestamp_seconds("last_s"), "last_ts"))


@C.add("T7_window_counts", O.sql(_TIMES, "SELECT namespace, cluster_id, coalesce(last_1h, 0) AS last_1h, coalesce(last_24h, 0) AS last_24h, coalesce(prev_24h, 0) AS prev_24h FROM ctrend"))
def window_counts(spark, sf):
    return _trends(spark, sf).select(NS, *big("cluster_id", "last_1h", "last_24h", "prev_24h"))


@C.add("T8_pct_change_max_gap", O.sql(_TIMES, "SELECT namespace, cluster_id, round(pct_change, 6) AS pct_change, max_gap_s FROM ctrend"))
def pct_change(spark, sf):
    return _trends(spark, sf).select(NS, *big("cluster_id"), F.round("pct_change", 6).alias("pct_change"), *big("max_gap_s"))


@C.add("T9_trend_label", O.sql(_TIMES, "SELECT namespace, cluster_id, trend_label, trend_label = 'spike' AS spike_detected, trend_label = 'new' AS is_new, trend_label = 'regression' AS is_regression FROM ctrend"))
def trend_label(spark, sf):
    return _trends(spark, sf).select(NS, *big("cluster_id"), "trend_label", "spike_detected", "is_new", "is_regression")


_ALERTS = """SELECT namespace, count(*) FILTER (WHERE trend_label = 'spike') AS spike_count, count(*) FILTER (WHERE trend_label = 'regression') AS regression_count,
  count(*) FILTER (WHERE trend_label = 'new') AS new_error_count FROM ctrend GROUP BY ALL"""


@C.add("T10_trend_alerts", O.sql(_TIMES, f"SELECT *, spike_count + regression_count + new_error_count > 0 AS has_alerts FROM ({_ALERTS})"))
def trend_alerts(spark, sf):
    return trends.trend_alerts(_trends(spark, sf))


# ---- files and scores -------------------------------------------------------------------

_FILES = O.LOG_VIEW + f""",
fstat AS (SELECT namespace, regexp_extract(source_file, '[^/]*$') AS file_name, count(*) FILTER (WHERE sev = 'error') AS error_count,
  count(*) FILTER (WHERE sev = 'warning') AS warning_count, count(*) FILTER (WHERE sev NOT IN ('error', 'warning')) AS info_count, count(*) AS total_chunks
  FROM (SELECT namespace, source_file, {O.ingest_severity('text')} AS sev FROM log_view) GROUP BY ALL)"""


def _file_stats(spark, sf):
    log = views.log_view(spark, sf)
    return scoring.file_error_stats(log.select(
        NS, "source_file", F.lit("").alias("file_name"), T.ingest_severity(F.col("text")).alias("severity")), [NS])


@C.add("A1_file_error_stats", O.sql(_FILES, "SELECT *, error_count * 3 + warning_count AS severity_score FROM fstat"))
def file_error_stats(spark, sf):
    return _file_stats(spark, sf)


_PART = "concat_ws(', ', CASE WHEN error_count > 0 THEN error_count || ' error' || CASE WHEN error_count > 1 THEN 's' ELSE '' END END, CASE WHEN warning_count > 0 THEN warning_count || ' warning' || CASE WHEN warning_count > 1 THEN 's' ELSE '' END END)"


@C.add("A2_file_lines", O.sql(_FILES, f"""
SELECT namespace, file_name, error_count, warning_count, '  ' || file_name || ' — ' || CASE WHEN {_PART} = '' THEN 'info only' ELSE {_PART} END AS line FROM fstat"""))
def file_lines(spark, sf):
    return scoring.file_lines(_file_stats(spark, sf), [NS])


@C.add("A2_file_report", O.sql(_FILES + """,
ft AS (SELECT namespace, count(*) AS files_affected, CAST(sum(error_count) AS BIGINT) AS total_errors, CAST(sum(warning_count) AS BIGINT) AS total_warnings,
  count(*) FILTER (WHERE error_count > 0) AS files_with_errors, max(error_count) AS top_errors FROM fstat GROUP BY ALL),
dom AS (SELECT namespace, file_name FROM fstat WHERE error_count > 0 QUALIFY row_number() OVER (PARTITION BY namespace ORDER BY error_count DESC, warning_count DESC, file_name) = 1)""", """
SELECT ft.namespace, files_affected, total_errors, total_warnings, files_with_errors, dom.file_name AS dominant_file,
  CASE WHEN files_affected > 1 AND total_errors > 0 THEN 'Dominant error source: ' || dom.file_name || ' (' || top_errors || '/' || total_errors || ' errors)' END AS closing_line
FROM ft LEFT JOIN dom USING (namespace)"""))
def file_report(spark, sf):
    return scoring.file_report(_file_stats(spark, sf), [NS])


_SEVS = ", ".join(f"count(*) FILTER (WHERE sev = '{s}') AS {s}" for s in V.SEVERITY_WEIGHT)


@C.add("A3_severity_distribution", O.sql(O.LOG_UNTIMED, f"""
SELECT *, fatal + critical + error AS high_severity FROM (SELECT namespace, {_SEVS} FROM (SELECT namespace, {O.severity('text')} AS sev FROM log_mixed) GROUP BY ALL)"""))
def severity_distribution(spark, sf):
    return scoring.severity_distribution(views.log_view_untimed(spark, sf), [NS])


def _profile_and_trends(spark, sf):
    log = stored(views.log_view(spark, sf))
    clusters = errors.cluster_errors(log)
    profile = cut(errors.cluster_profile(clusters), "profile")
    return log, profile, cut(trends.cluster_trends(profile, log, views.ref_time()), "trends")


_CAUSAL = _TIMES + f""",
prof AS (SELECT c.*, t.trend_label, t.last_1h, t.last_24h, t.pct_change, coalesce(len(f.v), 0) AS nfiles, coalesce(len(u.v), 0) AS nfuncs, coalesce(fr.k, 0) AS nframes
  FROM core c JOIN ctrend t USING (namespace, cluster_id) LEFT JOIN cfiles f USING (namespace, cluster_id) LEFT JOIN cfuncs u USING (namespace, cluster_id)
  LEFT JOIN (SELECT namespace, cluster_id, count(*) AS k FROM cframes GROUP BY ALL) fr USING (namespace, cluster_id)),
agg AS (SELECT namespace, count(*) AS k, sum(count) AS s, count(*) FILTER (WHERE nframes > 0) AS wf, count(*) FILTER (WHERE nfuncs > 0) AS wn,
  count(*) FILTER (WHERE trend_label = 'spike') AS spikes FROM prof GROUP BY ALL),
dm AS (SELECT * FROM prof QUALIFY row_number() OVER (PARTITION BY namespace ORDER BY count DESC, cluster_id) = 1),
cf AS (SELECT namespace, cluster_id AS dominant_cluster_id, substring(primary_signature, 5) AS dominant_error,
  CASE WHEN count >= 5 THEN least(1.0, count / s + 0.1) ELSE count / s END AS frequency,
  least(1.0, 0.4 * wf / k + 0.3 * wn / k + 0.3 * least(1.0, nframes / 3)) AS stack_trace,
  CASE WHEN nfiles > 0 THEN 0.1 ELSE 0.0 END AS code_match, 0.1 AS dependency,
  least(1.0, least(1.0, {O.case('trend_label', V.TREND_CAUSAL_SCORE, '0.3')} + CASE WHEN last_1h > 0 THEN 0.1 ELSE 0 END) + CASE WHEN spikes > 0 THEN 0.1 ELSE 0 END) AS trend
  FROM dm JOIN agg USING (namespace)),
cs AS (SELECT *, CAST(round_even(greatest(0, least(100, (0.25 * frequency + 0.20 * stack_trace + 0.25 * code_match + 0.10 * dependency + 0.20 * trend) * 100)), 0) AS INTEGER) AS score FROM cf),
ranked AS (SELECT *, 3.0 * {O.case('severity', V.SEVERITY_RANK_SCORE, '1')} + 2.0 * log2(greatest(1, count)) + 2.5 * {O.case('trend_label', V.TREND_RANK_SCORE, '1')}
  + 1.5 * (least(1.0, nfiles / 3) + least(1.0, nfuncs / 3) + least(1.0, nframes / 2)) AS rank_score FROM prof)"""
_FACTORS = ["frequency", "stack_trace", "code_match", "dependency", "trend"]


@C.add("A6_causal_factors", O.sql(_CAUSAL, "SELECT namespace, dominant_cluster_id, dominant_error, "
       + ", ".join(f"CAST(round({f}, 6) AS DOUBLE) AS {f}" for f in _FACTORS) + " FROM cf"))
def causal_factors(spark, sf):
    _, profile, tr = _profile_and_trends(spark, sf)
    f = scoring.causal_factors(profile, tr)
    return f.select(NS, *big("dominant_cluster_id"), "dominant_error", *[F.round(c, 6).alias(c) for c in _FACTORS])


@C.add("A7_causal_confidence", O.sql(_CAUSAL, "SELECT namespace, score, CASE WHEN score >= 80 THEN 'high' WHEN score >= 50 THEN 'medium' ELSE 'low' END AS level FROM cs"))
def causal_confidence(spark, sf):
    _, profile, tr = _profile_and_trends(spark, sf)
    return scoring.causal_confidence(scoring.causal_factors(profile, tr)).select(NS, "score", "level")


_BARS = " || chr(10) || ".join(
    f"'  ' || repeat('█', CAST(floor({n} * 10) AS INTEGER)) || repeat('░', 10 - CAST(floor({n} * 10) AS INTEGER)) || ' {label}: ' || CAST(round_even({n} * 100, 0) AS INTEGER) || '% (contributes ' || "
    f"CAST(round_even(round_even({n} * {V.CAUSAL_WEIGHTS[n]} * 100, 1), 0) AS INTEGER) || ' pts)'" for n, label in V.CAUSAL_LABELS.items())
_EXPLAINED = _CAUSAL + f""",
alerts AS ({_ALERTS}),
ex AS (SELECT s.namespace, s.score, CASE WHEN score >= 80 THEN 'high' WHEN score >= 50 THEN 'medium' ELSE 'low' END AS level, d.count, d.severity, s.dominant_error,
  spike_count, regression_count, new_error_count, {_BARS} AS bars
  FROM (SELECT * REPLACE (CAST(frequency AS DOUBLE) AS frequency, CAST(stack_trace AS DOUBLE) AS stack_trace, CAST(code_match AS DOUBLE) AS code_match, CAST(dependency AS DOUBLE) AS dependency, CAST(trend AS DOUBLE) AS trend) FROM cs) s
  JOIN dm d USING (namespace) LEFT JOIN alerts USING (namespace)),
expl AS (SELECT namespace, score, level, 'Causal Confidence: ' || score || '/100 (' || level || ')' || chr(10) || bars || chr(10) || chr(10) || 'Dominant failure: "' || dominant_error || '" (' || count || ' occurrences, ' || severity || ')' ||
  CASE WHEN spike_count + regression_count + new_error_count > 0 THEN chr(10) || 'Active alerts: ' || concat_ws(', ', CASE WHEN spike_count > 0 THEN spike_count || ' spike(s)' END,
    CASE WHEN regression_count > 0 THEN regression_count || ' regression(s)' END, CASE WHEN new_error_count > 0 THEN new_error_count || ' new error(s)' END) ELSE '' END AS explanation FROM ex)"""


@C.add("A8_explain_confidence", O.sql(_EXPLAINED, "SELECT namespace, score, level, explanation FROM expl"))
def explain_confidence(spark, sf):
    _, profile, tr = _profile_and_trends(spark, sf)
    scored = scoring.causal_confidence(scoring.causal_factors(profile, tr))
    return scoring.explain_confidence(scored, trends.trend_alerts(tr))


@C.add("X1_cluster_rank", O.sql(_CAUSAL, "SELECT namespace, cluster_id, round(rank_score, 6) AS rank_score FROM ranked"))
def cluster_rank(spark, sf):
    _, profile, tr = _profile_and_trends(spark, sf)
    return scoring.cluster_rank(profile, tr).select(NS, *big("cluster_id"), F.round("rank_score", 6).alias("rank_score"))


_TOP = """
SELECT namespace, rank, cluster_id, substring(primary_signature, 5) AS error_signature, exception_type, severity, count, last_1h, last_24h,
  round(pct_change, 2) AS pct_change, trend_label, round(rank_score, 6) AS rank_score, share AS dominant_share_pct
FROM (SELECT r.*, row_number() OVER (PARTITION BY namespace ORDER BY round(rank_score, 9) DESC, cluster_id) AS rank, t.share FROM ranked r
  JOIN (SELECT namespace, round(max(count) / sum(count) * 100, 1) AS share FROM core GROUP BY ALL) t USING (namespace)) WHERE rank <= 5"""


def top_clusters_of(spark: SparkSession, sf: str) -> DataFrame:
    """What is failing, and is it getting worse: the five worst clusters of each namespace."""
    _, profile, tr = _profile_and_trends(spark, sf)
    top = scoring.top_clusters(scoring.cluster_rank(profile, tr))
    return top.select(NS, *big("rank", "cluster_id"), "error_signature", "exception_type", "severity",
                      *big("count", "last_1h", "last_24h"), F.round("pct_change", 2).alias("pct_change"), "trend_label",
                      F.round("rank_score", 6).alias("rank_score"), "dominant_share_pct")


C.add("X2_top_clusters", O.sql(_CAUSAL, _TOP))(top_clusters_of)


_BLOCK = _EXPLAINED + f""",
tp AS (SELECT r.*, substring(r.primary_signature, 5) AS sg5, row_number() OVER (PARTITION BY r.namespace ORDER BY round(rank_score, 9) DESC, r.cluster_id) AS rank,
  array_to_string(f.v, ', ') AS files, array_to_string(u.v, ', ') AS funcs FROM ranked r LEFT JOIN cfiles f USING (namespace, cluster_id) LEFT JOIN cfuncs u USING (namespace, cluster_id) QUALIFY rank <= 5),
tx AS (SELECT namespace,
  max(CASE WHEN rank = 1 THEN chr(10) || '## Dominant Failure Pattern' || chr(10) || '- **Error**: ' || sg5 || chr(10) || '- **Exception type**: ' || exception_type || chr(10) || '- **Occurrences**: ' || count || chr(10)
    || '- **Severity**: ' || severity || chr(10) || '- **First seen**: ' || {O.ts_text('first_seen')} || chr(10) || '- **Last seen**: ' || {O.ts_text('last_seen')} || chr(10) || '- **Related files**: ' || coalesce(files, '') || chr(10)
    || '- **Related functions**: ' || coalesce(funcs, '') || chr(10) || '- **Trend**: ' || trend_label END) AS first,
  string_agg('  • Cluster ' || cluster_id || ': total=' || count || ', 1h=' || last_1h || ', 24h=' || last_24h || ', change=' || CASE WHEN round_even(pct_change, 0) >= 0 THEN '+' ELSE '' END || CAST(round_even(pct_change, 0) AS INTEGER)
    || '%, trend=' || trend_label, chr(10) ORDER BY cluster_id) AS trend_lines,
  string_agg('- "' || sg5 || '" × ' || count || ' (severity: ' || severity || ', trend: ' || trend_label || ')', chr(10) ORDER BY rank) FILTER (WHERE rank > 1) AS others FROM tp GROUP BY ALL),
fr AS (SELECT namespace, count(*) AS k, round(max(count) / sum(count) * 100, 1) AS share FROM core GROUP BY ALL),
ln AS (SELECT namespace, count(*) AS total FROM log_view GROUP BY ALL)"""


@C.add("X3_reasoning_block", O.sql(_BLOCK, """
SELECT namespace, score, level, concat_ws(chr(10), '## Causal Confidence Score: ' || score || '/100 (' || level || ')', first,
  chr(10) || '## Error Frequency Statistics' || chr(10) || '- Total clusters: ' || k || chr(10) || '- Total error entries: ' || total || chr(10) || '- Dominant pattern share: ' || CAST(round_even(share, 0) AS INTEGER) || '%',
  chr(10) || '## Time-Based Trends' || chr(10) || concat_ws(chr(10), CASE WHEN spike_count > 0 THEN '- ⚠ ' || spike_count || ' spike(s) detected' END, CASE WHEN regression_count > 0 THEN '- 🔙 ' || regression_count || ' regression(s)' END,
    CASE WHEN new_error_count > 0 THEN '- 🆕 ' || new_error_count || ' newly introduced error(s)' END, trend_lines),
  chr(10) || '## Other Error Clusters' || chr(10) || others, chr(10) || '## Confidence Breakdown' || chr(10) || explanation) AS block
FROM tx JOIN expl USING (namespace) JOIN alerts USING (namespace) JOIN fr USING (namespace) JOIN ln USING (namespace)"""))
def reasoning_block(spark, sf):
    log, profile, tr = _profile_and_trends(spark, sf)
    alerts = trends.trend_alerts(tr)
    explained = scoring.explain_confidence(scoring.causal_confidence(scoring.causal_factors(profile, tr)), alerts)
    return scoring.reasoning_block(scoring.top_clusters(scoring.cluster_rank(profile, tr)), explained, alerts,
                                   errors.cluster_report(log, profile))


@C.add("X4_tool_confidence", """
WITH g AS (SELECT l_orderkey AS query_id, count(*) AS calls, count(*) FILTER (WHERE l_returnflag <> 'R') AS ok FROM lineitem GROUP BY ALL)
SELECT o_orderkey AS query_id, coalesce(calls, 0) AS calls, coalesce(ok, 0) AS successful,
  coalesce(round_even(CASE WHEN ok >= 3 THEN least(1.0, ok / calls + 0.1) ELSE ok / calls END, 2), 0.5) AS confidence
FROM orders LEFT JOIN g ON query_id = o_orderkey""")
def tool_confidence(spark, sf):
    asked = views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("query_id"))
    return scoring.tool_confidence(views.tool_calls(spark, sf), asked)


# ---- incidents --------------------------------------------------------------------------

_SESS = O.LOG_UNTIMED + f""",
ie AS (SELECT namespace, ord, text, {O.entry_ts('text')} AS ts FROM log_mixed),
brk AS (SELECT *, CASE WHEN date_diff('second', lag(ts) OVER (PARTITION BY namespace ORDER BY ts, ord), ts) <= 300 THEN 0 ELSE 1 END AS b FROM ie WHERE ts IS NOT NULL),
sess AS (SELECT *, CAST(sum(b) OVER (PARTITION BY namespace ORDER BY ts, ord ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM brk),
sitems AS (SELECT DISTINCT namespace, session, unnest(list_concat(list_transform({O.keywords('text')}, lambda k: 'k:' || k), list_transform({O.frames('text')}, lambda f: 'f:' || f))) AS item FROM sess)"""


@C.add("I1_time_sessions", O.sql(_SESS, f"""
SELECT namespace, session, count(*) AS entries, {O.ts_text('min(ts)')} AS start_time, {O.ts_text('max(ts)')} AS end_time FROM sess GROUP BY namespace, session"""))
def time_sessions(spark, sf):
    log = views.log_view_untimed(spark, sf)
    s = incidents.time_sessions(log)
    rows = incidents.entries(log).where("ts is not null").withColumn("sec", F.col("ts").cast("long")).join(s, [NS, "sec"])
    return rows.groupBy(NS, "session").agg(F.count(F.lit(1)).alias("entries"), stamp(F.min("ts"), "start_time"), stamp(F.max("ts"), "end_time"))


_INC = _SESS + """,
lab AS (
  SELECT DISTINCT namespace, session, session AS inc, 0 AS it FROM sess
  UNION ALL
  SELECT l.namespace, l.session, coalesce(e.y, l.inc), l.it + 1 FROM lab l LEFT JOIN (
    SELECT namespace, x, min(y) AS y FROM (
      SELECT a.namespace, a.inc AS x, b.inc AS y FROM
        (SELECT DISTINCT l2.namespace, l2.inc, i.item FROM lab l2 JOIN sitems i ON i.namespace = l2.namespace AND i.session = l2.session) a JOIN
        (SELECT DISTINCT l3.namespace, l3.inc, i.item FROM lab l3 JOIN sitems i ON i.namespace = l3.namespace AND i.session = l3.session) b
        ON a.namespace = b.namespace AND a.item = b.item AND b.inc < a.inc
      GROUP BY a.namespace, a.inc, b.inc HAVING count(*) FILTER (WHERE a.item LIKE 'k:%') >= 2 OR count(*) FILTER (WHERE a.item LIKE 'f:%') >= 1)
    GROUP BY namespace, x) e ON e.namespace = l.namespace AND e.x = l.inc
  WHERE l.it < 8),
final AS (SELECT namespace, session, inc FROM lab WHERE it = 8),
inc AS (SELECT *, dense_rank() OVER (PARTITION BY namespace ORDER BY f) AS incident_id FROM (SELECT *, min(session) OVER (PARTITION BY namespace, inc) AS f FROM final)),
iw AS (SELECT DISTINCT i.namespace, i.incident_id, substring(s.item, 3) AS word FROM sitems s JOIN inc i USING (namespace, session) WHERE s.item LIKE 'k:%'),
un AS (SELECT namespace, ord, unnest(""" + O.keywords("text") + """) AS word FROM ie WHERE ts IS NULL),
asg AS (SELECT * FROM (SELECT u.namespace, u.ord, w.incident_id, count(*) AS overlap FROM un u JOIN iw w USING (namespace, word) GROUP BY ALL HAVING count(*) >= 2)
  QUALIFY row_number() OVER (PARTITION BY namespace, ord ORDER BY overlap DESC, incident_id) = 1),
im AS (SELECT s.namespace, i.incident_id, s.ord, s.text, s.ts FROM sess s JOIN inc i USING (namespace, session)
  UNION ALL SELECT e.namespace, a.incident_id, e.ord, e.text, e.ts FROM ie e JOIN asg a USING (namespace, ord)),
ims AS (SELECT *, """ + O.severity("text") + " AS sev, " + O.failure("text") + """ AS sig FROM im),
icore AS (SELECT namespace, incident_id, count(*) AS entries, min(ts) AS start_time, max(ts) AS end_time FROM ims GROUP BY ALL),
isev AS (SELECT namespace, incident_id, sev, count(*) AS n, min(struct_pack(l := ts IS NULL, t := ts, o := ord)) AS seen FROM ims GROUP BY ALL),
idom AS (SELECT namespace, incident_id, sig FROM (SELECT namespace, incident_id, sig, count(*) AS n, min(struct_pack(l := ts IS NULL, t := ts, o := ord)) AS seen FROM ims WHERE sig IS NOT NULL GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY namespace, incident_id ORDER BY n DESC, seen) = 1),
iword AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY namespace, incident_id ORDER BY n DESC, word) AS rank FROM
  (SELECT namespace, incident_id, word, count(*) AS n FROM (SELECT namespace, incident_id, unnest(""" + O.keywords("text") + """) AS word FROM ims) GROUP BY ALL)) WHERE rank <= 10 AND n >= 2),
iprof AS (SELECT c.*, d.sig AS dominant_error, s.counts, s.top_sev, coalesce(w.words, '') AS shared_keywords FROM icore c
  JOIN (SELECT namespace, incident_id, string_agg(sev || '=' || n, '|' ORDER BY sev) AS counts, arg_min(sev, struct_pack(n := -n, s := seen)) AS top_sev, coalesce(sum(n) FILTER (WHERE sev = 'error'), 0) AS errs FROM isev GROUP BY ALL) s USING (namespace, incident_id)
  LEFT JOIN idom d USING (namespace, incident_id)
  LEFT JOIN (SELECT namespace, incident_id, string_agg(word, '|' ORDER BY rank) AS words FROM iword GROUP BY ALL) w USING (namespace, incident_id)),
ilab AS (SELECT *, CASE WHEN dominant_error IS NOT NULL THEN substring(dominant_error, 1, 60) WHEN counts LIKE '%error=%' THEN 'Error cluster at ' || """ + O.ts_text("start_time") + """
  ELSE upper(top_sev[1]) || top_sev[2:] || ' cluster at ' || """ + O.ts_text("start_time") + """ END AS label FROM iprof)"""


@C.add("I2_merge_incidents", O.sql(_INC, "SELECT namespace, session, incident_id FROM inc"))
def merge_incidents(spark, sf):
    return incidents.Incidents(stored(views.log_view_untimed(spark, sf))).order.select(NS, *big("session", "incident_id"))


@C.add("I3_incident_order", O.sql(_INC, "SELECT namespace, incident_id, min(session) AS first_session, count(*) AS sessions FROM inc GROUP BY ALL"))
def incident_order(spark, sf):
    o = incidents.Incidents(stored(views.log_view_untimed(spark, sf))).order
    return o.groupBy(NS, F.col("incident_id").cast("bigint").alias("incident_id")).agg(
        F.min("session").cast("bigint").alias("first_session"), F.count(F.lit(1)).alias("sessions"))


@C.add("I4_assign_untimed", O.sql(_INC, "SELECT namespace, ord, incident_id, overlap FROM asg"))
def assign_untimed(spark, sf):
    a = incidents.Incidents(stored(views.log_view_untimed(spark, sf))).assigned()
    return a.select(NS, "ord", *big("incident_id", "overlap"))


@C.add("I5_incident_profile", O.sql(_INC, f"""
SELECT namespace, incident_id, entries, {O.ts_text('start_time')} AS start_time, {O.ts_text('end_time')} AS end_time, counts AS severity_counts,
  dominant_error, shared_keywords, label FROM ilab"""))
def incident_profile(spark, sf):
    p = incidents.Incidents(stored(views.log_view_untimed(spark, sf))).profile()
    counts = F.array_join(F.transform(F.map_entries("severity_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), "|")
    return p.select(NS, *big("incident_id", "entries"), stamp("start_time"), stamp("end_time"), counts.alias("severity_counts"),
                    "dominant_error", joined("shared_keywords"), "label")


@C.add("I6_incident_report", O.sql(_INC, """
SELECT l.namespace, l.n AS total_entries, c.k AS incident_count, l.n - c.s AS unclustered_count FROM (SELECT namespace, count(*) AS n FROM ie GROUP BY ALL) l
JOIN (SELECT namespace, count(*) AS k, CAST(sum(entries) AS BIGINT) AS s FROM icore GROUP BY ALL) c USING (namespace)"""))
def incident_report(spark, sf):
    log = stored(views.log_view_untimed(spark, sf))
    return incidents.incident_report(log, incidents.Incidents(log).profile())


@C.add("I6_incident_lines", O.sql(_INC, f"""
SELECT namespace, incident_id, '[' || label || '] ' || entries || ' entries' || CASE WHEN start_time = end_time THEN ' at ' || {O.ts_text('start_time')}
  ELSE ' from ' || {O.ts_text('start_time')} || ' to ' || {O.ts_text('end_time')} END ||
  CASE WHEN dominant_error IS NOT NULL THEN ', dominant: "' || dominant_error || '"' ELSE '' END AS line FROM ilab"""))
def incident_lines(spark, sf):
    p = incidents.Incidents(stored(views.log_view_untimed(spark, sf))).profile()
    return incidents.incident_lines(p).select(NS, *big("incident_id"), "line")
