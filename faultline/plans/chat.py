"""Registered queries over questions and conversations, and the whole evidence chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.functions import text as T
from faultline.functions import vocab as V
from faultline.operators import questions as P
from faultline.operators import scoring
from faultline.plans import oracle as O
from faultline.plans import views
from faultline.plans.registry import Catalog, big, joined, stamp

C = Catalog()
NS, Q = "namespace", "query_id"
_QS = O.QUESTIONS + f", qq AS (SELECT *, {O.strip('question')} AS q, lower(question) AS low FROM questions)"


@C.add("C1_query_category", O.sql(_QS, f"""
SELECT query_id, CASE WHEN q = '' THEN 'project' WHEN length(q) < 60 AND {O.rx_any('q', V.GREETINGS)} THEN 'greeting' WHEN {O.rx_any('q', V.STRONG_PROJECT)} THEN 'project'
  WHEN {O.rx_any('q', V.OFF_TOPIC)} THEN 'off_topic' WHEN {O.rx_any('q', V.CONVERSATIONAL)} THEN 'conversational' ELSE 'project' END AS category FROM qq"""))
def query_category(spark, sf):
    return views.questions(spark, sf).select(Q, P.query_category(F.col("question")).alias("category"))


_HITS = " + ".join(f"CAST(contains(lower(q), {O.lit(k)}) AS INTEGER)" for k in V.ROUTE_KEYWORDS)


@C.add("C2_route_intent", O.sql(_QS + f", rr AS (SELECT *, {_HITS} AS hits, length(q) < 60 AND {O.rx_any('q', V.GREETINGS)} AS g, {O.rx_any('q', V.CONVERSATIONAL)} AS c, {O.rx_any('q', V.OFF_TOPIC)} AS u FROM qq)", f"""
SELECT query_id, CASE WHEN q = '' THEN 'project_query' WHEN g OR c THEN 'conversational' WHEN u THEN 'unrelated' ELSE 'project_query' END AS intent,
  CAST(CASE WHEN q = '' THEN 0.5 WHEN g THEN 0.95 WHEN c THEN 0.9 WHEN u THEN 0.85 WHEN hits >= 3 THEN round(least(0.95, 0.60 + hits * 0.07), 2)
    WHEN hits >= 1 THEN round(least(0.80, 0.50 + hits * 0.10), 2) WHEN {O.rx_any('q', V.ROUTE_PATTERNS)} THEN 0.7 ELSE 0.5 END AS DOUBLE) AS confidence FROM rr"""))
def route_intent(spark, sf):
    return P.route_intent(views.questions(spark, sf))


_LOGQ = "(" + " OR ".join(f"contains(low, {O.lit(w)})" for w in V.LOG_QUESTION_WORDS) + f" OR {O.rx('low', V.LOG_WORD)})"
_TYPE = (f"CASE WHEN {O.rx_any('low', V.ROOT_CAUSE, '')} THEN 'root_cause' WHEN {O.rx_any('low', V.ARCHITECTURE, '')} THEN 'architecture' "
         f"WHEN {O.rx_any('low', V.STRUCTURAL, '')} THEN 'structural' WHEN {_LOGQ} THEN 'log_analysis' WHEN {O.rx_any('low', V.CODE_REVIEW, '')} THEN 'code_review' "
         f"WHEN {O.rx_any('low', V.CODE_QUESTION, '')} THEN 'code_analysis' ELSE 'general' END")


@C.add("C3_question_type", O.sql(_QS, f"SELECT query_id, {_TYPE} AS question_type FROM qq"))
def question_type(spark, sf):
    return views.questions(spark, sf).select(Q, P.question_type(F.col("question")).alias("question_type"))


_PLAN = ", ".join(f"({O.lit(k)}, {str(k in V.FAST_TYPES).lower()}, {i + 1}, {O.lit(s)}, {O.lit(d) if d else 'NULL'})"
                  for k, plan in V.PLANS.items() for i, (s, d) in enumerate(plan))


@C.add("C4_retrieval_plan", O.sql(_QS, f"""
SELECT query_id, p.question_type, p.fast_path, p.step_no, p.step, p.depends_on FROM (SELECT query_id, {_TYPE} AS question_type FROM qq) t
JOIN (VALUES {_PLAN}) p(question_type, fast_path, step_no, step, depends_on) ON p.question_type = t.question_type"""))
def retrieval_plan(spark, sf):
    return P.retrieval_plan(views.questions(spark, sf))


@C.add("C5_query_kind_flags", O.sql(_QS, f"""
SELECT query_id, {_LOGQ} AS is_log, {O.rx_any('low', V.ARCHITECTURE, '')} AS is_architecture, {O.rx_any('low', V.STRUCTURAL, '')} AS is_structural FROM qq"""))
def query_kind_flags(spark, sf):
    q = F.col("question")
    return views.questions(spark, sf).select(
        Q, P.is_log_question(q).alias("is_log"), P.is_architecture_question(q).alias("is_architecture"),
        P.is_structural_question(q).alias("is_structural"))


@C.add("A5_is_broad", O.sql(_QS, f"SELECT query_id, {O.rx_any('question', V.BROAD)} AS broad FROM qq"))
def is_broad(spark, sf):
    return views.questions(spark, sf).select(Q, scoring.is_broad(F.col("question")).alias("broad"))


@C.add("C6_last_turns", O.sql(O.TURNS, """
SELECT namespace, ord, question, substring(answer, 1, 300) AS answer_summary, row_number() OVER (PARTITION BY namespace ORDER BY ord DESC) AS age FROM turns QUALIFY age <= 10"""))
def last_turns(spark, sf):
    return P.last_turns(views.turns(spark, sf)).select(NS, "ord", "question", "answer_summary", *big("age"))


_LOWQ = f"lower({O.strip('question')})"


@C.add("C7_follow_up", O.sql(O.TURNS, f"""
SELECT namespace, ord, ord > min(ord) OVER (PARTITION BY namespace) AND (len(list_filter(string_split_regex({_LOWQ}, '\\s+'), lambda w: w <> '')) <= 4 OR
  {' OR '.join(f"contains({_LOWQ}, {O.lit(m)})" for m in V.FOLLOW_UP_MARKERS)}) AS follow_up FROM turns"""))
def follow_up(spark, sf):
    t = views.turns(spark, sf)
    return P.follow_up(t, t)


@C.add("C8_recent_files", O.sql(O.TURNS, """
SELECT namespace, row_number() OVER (PARTITION BY namespace ORDER BY seen, file) AS rank, file FROM (
  SELECT namespace, file, min(struct_pack(a := age, i := i)) AS seen FROM (
    SELECT namespace, age, unnest(source_files) AS file, generate_subscripts(source_files, 1) AS i FROM (
      SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY ord DESC) AS age FROM turns QUALIFY age <= 10)) GROUP BY ALL) QUALIFY rank <= 20"""))
def recent_files(spark, sf):
    return P.recent_files(views.turns(spark, sf)).select(NS, *big("rank"), "file")


@C.add("C8_recent_types", O.sql(O.TURNS, """
SELECT namespace, ord, question_type FROM turns QUALIFY row_number() OVER (PARTITION BY namespace ORDER BY ord DESC) <= 5"""))
def recent_types(spark, sf):
    return P.recent_types(views.turns(spark, sf))


@C.add("C9_prior_context", O.sql(O.TURNS + """,
lt AS (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY ord DESC) AS age FROM turns QUALIFY age <= 3),
ln AS (SELECT *, count(*) OVER (PARTITION BY namespace) - age + 1 AS no FROM lt)""", """
SELECT namespace, '## Prior Conversation Context' || chr(10) || chr(10) || string_agg('**Q' || no || '**: ' || question || chr(10) || '**A' || no || '** (summary): ' || substring(answer, 1, 300) || chr(10)
  || 'Files: ' || array_to_string(source_files[1:5], ', ') || chr(10) || 'Type: ' || question_type || chr(10), chr(10) ORDER BY no) AS context FROM ln GROUP BY ALL"""))
def prior_context(spark, sf):
    return P.prior_context(views.turns(spark, sf))


@C.add("C9_last_turn", O.sql(O.TURNS, """
SELECT namespace, question AS prior_question, question_type AS prior_type, array_to_string(source_files, '|') AS prior_files FROM turns
QUALIFY row_number() OVER (PARTITION BY namespace ORDER BY ord DESC) = 1"""))
def last_turn(spark, sf):
    return P.last_turn(views.turns(spark, sf)).select(NS, "prior_question", "prior_type", joined("prior_files"))


@C.add("C10_recent_projects", """
SELECT 'p' || o_custkey AS namespace, o_orderkey AS run_id, '/srv/' || o_custkey AS project_path, CASE o_orderstatus WHEN 'F' THEN 'local' WHEN 'O' THEN 'github' ELSE 'upload' END AS source_type,
  CAST(floor(o_totalprice) AS BIGINT) AS chunks_stored, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS last_indexed
FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10""")
def recent_projects(spark, sf):
    return P.recent_projects(views.index_runs(spark, sf)).select(
        NS, "run_id", "project_path", "source_type", "chunks_stored", stamp("last_indexed"))


_TAIL = f"lower(right(rtrim(answer, {O.lit(T.WHITESPACE)}), 120))"
_END = f"rtrim(answer, {O.lit(T.WHITESPACE)})"


@C.add("F19_answer_flags", f"""
SELECT conv_id, turn, (length({_END}) > 60 AND NOT contains({O.lit(V.TERMINAL_CHARS)}, right({_END}, 1))) OR {' OR '.join(f"contains({_TAIL}, {O.lit(s.lower())})" for s in V.TRUNCATION_SIGNALS)} AS truncated,
  length({O.strip('answer')}) < 120 AS too_short FROM (SELECT conv_id, turn, text AS answer FROM conversations WHERE role = 'assistant')""")
def answer_flags(spark, sf):
    a = F.col("answer")
    return views.answers(spark, sf).select("conv_id", "turn", T.looks_truncated(a).alias("truncated"), T.too_short(a).alias("too_short"))
