"""Question routing and conversation memory over tables of questions and turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions import text as T
from faultline.functions import vocab as V
from faultline.functions.groups import first_n, ordered_list

NS, Q = "namespace", "query_id"
MAX_TURNS = 10


# ---- routing ----------------------------------------------------------------------------


def query_category(question: Column) -> Column:
    q = T.strip(question)
    return (
        F.when(q == "", "project")
        .when((F.length(q) < 60) & T.matches_any(q, V.GREETINGS), "greeting")
        .when(T.matches_any(q, V.STRONG_PROJECT), "project")
        .when(T.matches_any(q, V.OFF_TOPIC), "off_topic")
        .when(T.matches_any(q, V.CONVERSATIONAL), "conversational")
        .otherwise("project"))


def route_intent(questions: DataFrame) -> DataFrame:
    """(query_id, intent, confidence): rules only; a keyword counts once however often it occurs."""
    q = T.strip(F.col("question"))
    low = F.lower(q)
    rows = questions.select(
        Q, q.alias("q"),
        F.aggregate(F.array(*[F.lit(k) for k in V.ROUTE_KEYWORDS]), F.lit(0),
                    lambda n, k: n + F.contains(low, k).cast("int")).alias("hits"))
    q, hits = F.col("q"), F.col("hits")
    greeting = (F.length(q) < 60) & T.matches_any(q, V.GREETINGS)
    chatting, unrelated = T.matches_any(q, V.CONVERSATIONAL), T.matches_any(q, V.OFF_TOPIC)
    intent = (
        F.when(q == "", "project_query").when(greeting | chatting, "conversational").when(unrelated, "unrelated")
        .otherwise("project_query"))
    confidence = (
        F.when(q == "", 0.5).when(greeting, 0.95).when(chatting, 0.90).when(unrelated, 0.85)
        .when(hits >= 3, F.round(F.least(F.lit(0.95), 0.60 + hits * 0.07), 2))
        .when(hits >= 1, F.round(F.least(F.lit(0.80), 0.50 + hits * 0.10), 2))
        .when(T.matches_any(q, V.ROUTE_PATTERNS), 0.70).otherwise(0.50))
    return rows.select(Q, intent.alias("intent"), confidence.alias("confidence"))


def is_log_question(question: Column) -> Column:
    q = F.lower(question)
    return T.contains_any(q, V.LOG_QUESTION_WORDS) | q.rlike(T.unicode_words(V.LOG_WORD))


def is_architecture_question(question: Column) -> Column:
    return T.matches_any(F.lower(question), V.ARCHITECTURE, "")


def is_structural_question(question: Column) -> Column:
    return T.matches_any(F.lower(question), V.STRUCTURAL, "")


def question_type(question: Column) -> Column:
    q = F.lower(question)
    return (
        F.when(T.matches_any(q, V.ROOT_CAUSE, ""), "root_cause")
        .when(is_architecture_question(question), "architecture")
        .when(is_structural_question(question), "structural")
        .when(is_log_question(question), "log_analysis")
        .when(T.matches_any(q, V.CODE_REVIEW, ""), "code_review")
        .when(T.matches_any(q, V.CODE_QUESTION, ""), "code_analysis")
        .otherwise("general"))


def retrieval_plan(questions: DataFrame) -> DataFrame:
    """(query_id, question_type, fast_path, step_no, step, depends_on); the plans are one constant map."""
    typed = questions.select(Q, question_type(F.col("question")).alias("question_type"))
    steps = F.create_map(*[c for kind, plan in V.PLANS.items() for c in (
        F.lit(kind), F.array(*[F.struct(F.lit(s).alias("step"), F.lit(d).cast("string").alias("depends_on")) for s, d in plan]))])
    rows = typed.select(Q, "question_type", F.col("question_type").isin(V.FAST_TYPES).alias("fast_path"),
                        F.posexplode(F.element_at(steps, F.col("question_type"))).alias("p", "s"))
    return rows.select(Q, "question_type", "fast_path", (F.col("p") + 1).alias("step_no"), "s.step", "s.depends_on")


# ---- conversation memory ----------------------------------------------------------------


def last_turns(turns: DataFrame, n: int = MAX_TURNS) -> DataFrame:
    """The newest ``n`` turns of each namespace, answers cut to 300 characters; ``age`` 1 is the newest."""
    cut = turns.withColumn("answer_summary", F.substring("answer", 1, 300)).drop("answer")
    return first_n(cut, [NS], [F.col("ord").desc()], n, rank="age")


def follow_up(questions: DataFrame, turns: DataFrame) -> DataFrame:
    """(namespace, ord, follow_up): short or pronoun-like questions after an earlier turn.

    Whether an earlier turn exists only needs the first turn of the namespace.
    """
    first = turns.groupBy(NS).agg(F.min("ord").alias("first_ord"))
    q = F.lower(T.strip(F.col("question")))
    words = F.size(F.filter(F.split(q, r"\s+"), lambda w: w != ""))
    hint = (words <= 4) | T.contains_any(q, V.FOLLOW_UP_MARKERS)
    rows = questions.join(first, NS, "left")
    earlier = F.coalesce(F.col("first_ord") < F.col("ord"), F.lit(False))
    return rows.select(NS, "ord", (earlier & hint).alias("follow_up"))


def recent_files(turns: DataFrame, n: int = 20) -> DataFrame:
    """Distinct files of the remembered turns, newest turn first."""
    rows = last_turns(turns).select(NS, "age", F.posexplode("source_files").alias("i", "file"))
    first = rows.groupBy(NS, "file").agg(F.min(F.struct("age", "i")).alias("seen"))
    return first_n(first, [NS], [F.col("seen"), F.col("file")], n).select(NS, "rank", "file")


def recent_types(turns: DataFrame, n: int = 5) -> DataFrame:
    """Types of the last turns, oldest of them first."""
    rows = last_turns(turns, n)
    return rows.select(NS, "ord", "question_type")


def prior_context(turns: DataFrame, n: int = 3) -> DataFrame:
    """Text of the last ``n`` turns of each namespace."""
    rows = last_turns(turns, n)
    w = Window.partitionBy(NS)
    number = F.count(F.lit(1)).over(w) - F.col("age") + 1
    files = F.when(F.size("source_files") > 0, F.array_join(F.slice("source_files", 1, 5), ", ")).otherwise("none")
    rows = rows.withColumn("no", number)
    no = F.col("no").cast("string")
    line = F.concat(F.lit("**Q"), no, F.lit("**: "), F.col("question"), F.lit("\n**A"), no, F.lit("** (summary): "),
                    F.col("answer_summary"), F.lit("\nFiles: "), files, F.lit("\nType: "), F.col("question_type"), F.lit("\n"))
    return rows.select(NS, "no", line.alias("t")).groupBy(NS).agg(F.concat(
        F.lit("## Prior Conversation Context\n\n"), F.array_join(ordered_list("no", "t"), "\n")).alias("context"))


def last_turn(turns: DataFrame) -> DataFrame:
    return last_turns(turns, 1).select(NS, F.col("question").alias("prior_question"), F.col("question_type").alias("prior_type"),
                                       F.col("source_files").alias("prior_files"))


def recent_projects(runs: DataFrame, n: int = 10) -> DataFrame:
    """Newest run per namespace, then the newest ``n`` namespaces overall (a top-n, no single window)."""
    newest = F.struct("last_indexed", "run_id")
    columns = [c for c in runs.columns if c != NS]
    latest = runs.groupBy(NS).agg(F.max_by(F.struct(*columns), newest).alias("r")).select(NS, "r.*")
    return latest.orderBy(F.col("last_indexed").desc(), F.col("run_id").desc()).limit(n)
