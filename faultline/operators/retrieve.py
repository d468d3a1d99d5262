"""Vectors and searches: nearest neighbours, keywords, severity, query variants, rank fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import IDF, HashingTF, IDFModel, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions import text as T
from faultline.functions import vocab as V
from faultline.functions.groups import FEW_KEYS, containment_pairs, first_few, first_n
from faultline.operators.vectorindex import build_index, search_index
from faultline.session import cut

NS, Q = "namespace", "query_id"
ORDER = ["source_file", "line_start", "chunk_id"]
#: Tokens that may be sent to the tasks.
FEW_TOKENS = FEW_KEYS


# ---- vectors ----------------------------------------------------------------------------


def _term_counts(rows: DataFrame, text: str, dims: int) -> DataFrame:
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    return HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dims).transform(rows.withColumn("_words", words))


def rarities(rows: DataFrame, text: str = "text", dims: int = 384) -> IDFModel:
    """How rare each hashed term is among all rows."""
    return _rarities(_term_counts(rows.select(text), text, dims))


def _rarities(counted: DataFrame) -> IDFModel:
    return IDF(inputCol="_tf", outputCol="_idf").fit(counted)


def vectorise(rows: DataFrame, text: str = "text", dims: int = 384, rare: IDFModel | None = None) -> DataFrame:
    """Add ``embedding``: hashed term weights scaled by rarity (``rare``, else that among the rows), unit length (all zero without words)."""
    return _weighted(_term_counts(rows, text, dims), rare or rarities(rows, text, dims))


def _weighted(counted: DataFrame, rare: IDFModel) -> DataFrame:
    """Add ``embedding`` to rows with their term counts."""
    out = Normalizer(inputCol="_idf", outputCol="_unit").transform(rare.transform(counted))
    return out.withColumn("embedding", vector_to_array("_unit", "float32")).drop("_words", "_tf", "_idf", "_unit")


def embed_with(rows: DataFrame, model, text: str = "text", dims: int = 384) -> DataFrame:
    """Hook for an outside model: ``model(list[str]) -> array (n, dims)``, called per Arrow batch."""
    schema = rows.select("*").schema.add("embedding", "array<float>")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vectors = np.asarray(model(pdf[text].tolist()), dtype=np.float32).reshape(len(pdf), dims)
            norms = np.linalg.norm(vectors, axis=1, keepdims=True)
            yield pdf.assign(embedding=list(vectors / np.where(norms == 0, 1, norms)))

    return rows.mapInPandas(run, schema)


def knn(chunks: DataFrame, queries: DataFrame, k: int = 8) -> DataFrame:
    """(query_id, chunk_id, distance, rank): the k nearest chunks of each query in its namespace, exact."""
    return search_index(build_index(chunks), queries, k)[0]


# ---- keyword and severity search --------------------------------------------------------


def _vocabulary() -> list[str]:
    return sorted({t for terms in V.SEARCH_TERMS.values() for t in terms} | set(V.DEFAULT_SEARCH_TERMS))


def _rank_terms(wanted: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Wanted (query_id, namespace, pos, term) against each term's first k chunks: first hit per chunk, k per query."""
    hits = wanted.join(found, [NS, "term"])
    once = hits.groupBy(Q, "chunk_id").agg(F.min(F.struct("pos", "place")).alias("seen"))
    return first_n(once, [Q], [F.col("seen"), F.col("chunk_id")], k).select(
        Q, "chunk_id", "rank", F.lit(V.KEYWORD_DISTANCE).alias("distance"))


def question_terms(questions: DataFrame) -> DataFrame:
    return questions.select(Q, NS, F.posexplode(T.search_terms(F.col("question"))).alias("pos", "term"))


def keyword_search(chunks: DataFrame, questions: DataFrame, k: int = 8) -> DataFrame:
    """Chunks holding a search word of the question; at most k per word and k in all, fixed distance.

    The words come from one fixed list, so each chunk is tested once against that list and only the
    first k chunks per namespace and word meet the questions.
    """
    words = F.array(*[F.lit(w) for w in _vocabulary()])
    held = chunks.select(NS, *ORDER, F.explode(F.filter(words, lambda w: F.contains(F.col("text"), w))).alias("term"))
    found = first_few(held, [NS, "term"], ORDER, k, rank="place")
    return _rank_terms(question_terms(questions), found.select(NS, "term", "chunk_id", "place"), k)


def term_search(chunks: DataFrame, wanted: DataFrame, k: int, token: str = r"[\p{L}\p{N}_]+") -> DataFrame:
    """Substring search for any terms made of ``token`` characters: (query_id, namespace, pos, term).

    A term lies inside one token of the text. The distinct tokens are matched with the distinct terms; tokens that hold a
    term keep their first k chunks, and a term's first k chunks are among those of its tokens. Only these tokens are ordered:
    a task does not sort every token of its texts.
    """
    tokens = chunks.select(NS, *ORDER, F.explode(F.array_distinct(
        F.regexp_extract_all("text", F.lit(token), F.lit(0)))).alias("token"))
    distinct_tokens = cut(tokens.select("token").distinct(), "tokens")
    pairs = cut(containment_pairs(distinct_tokens, "token", wanted.select("term").distinct(), "term"), "token-terms")
    met = pairs.select("token").distinct()
    if met.limit(FEW_TOKENS + 1).count() <= FEW_TOKENS:
        # Sent to the tasks, so that tokens without a term are dropped where they are read. More of them hold most tokens anyway.
        tokens = tokens.join(F.broadcast(met), "token", "left_semi")
    firsts = cut(first_n(tokens, [NS, "token"], [F.col(c) for c in ORDER], k, rank="_place").drop("_place"), "first-chunks")
    held = pairs.join(firsts, "token").select(NS, "term", *ORDER).distinct()
    found = first_n(held, [NS, "term"], [F.col(c) for c in ORDER], k, rank="place")
    return _rank_terms(wanted, found.select(NS, "term", "chunk_id", "place"), k)


def severity_search(chunks: DataFrame, severity: str = "error", k: int = 20) -> DataFrame:
    """First k chunks of a stored severity per namespace, fixed distance."""
    rows = chunks.where(F.col("severity") == severity).select(NS, *ORDER)
    return first_few(rows, [NS], ORDER, k).withColumn("distance", F.lit(V.SEVERITY_DISTANCE))


def merge_hits(semantic: DataFrame, keyword: DataFrame, severity: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, chunk_id, distance, pos): semantic, then keyword, then severity hits."""
    per_query = severity.join(questions.select(Q, NS), NS)
    lists = [df.select(Q, "chunk_id", "distance", "rank", F.lit(i).alias("list"))
             for i, df in enumerate((semantic, keyword, per_query))]
    rows = lists[0].unionByName(lists[1]).unionByName(lists[2])
    w = Window.partitionBy(Q).orderBy("list", "rank")
    return rows.withColumn("pos", F.row_number().over(w)).select(Q, "chunk_id", "distance", "pos")


# ---- several phrasings ------------------------------------------------------------------


def query_variants(questions: DataFrame) -> DataFrame:
    """(query_id, namespace, variant_no, variant): up to four phrasings, repeats (ignoring case) removed."""
    q = F.col("question")
    keyword = T.keyword_variant(q)
    options = F.array(
        q,
        F.when(keyword != F.lower(T.strip(q)), keyword).otherwise(""),
        T.synonym_variant(q),
        T.technical_variant(q))
    key = F.transform(options, lambda v: F.lower(T.strip(v)))
    kept = F.filter(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.struct(
        i.alias("i"), F.element_at(F.col("_o"), i).alias("v"), F.array_position(F.col("_k"), F.element_at(F.col("_k"), i)).alias("f"),
        F.element_at(F.col("_k"), i).alias("k"))), lambda s: (s["k"] != "") & (s["f"] == s["i"]))
    out = questions.withColumn("_o", options).withColumn("_k", key).select(Q, NS, F.posexplode(kept).alias("n", "s"))
    return out.select(Q, NS, (F.col("n") + 1).alias("variant_no"), F.col("s.v").alias("variant"))


def rrf_fuse(lists: DataFrame, key: list[str]) -> DataFrame:
    """Fuse ranked lists (query_id, list_no, rank from 1, distance, key…): score, lowest distance, rank."""
    first = F.struct("list_no", "rank")
    fused = lists.groupBy(Q, *key).agg(
        F.sum(F.lit(1.0) / (V.RRF_K + F.col("rank"))).alias("score"), F.min("distance").alias("distance"),
        F.min(first).alias("seen"))
    w = Window.partitionBy(Q).orderBy(F.round("score", 12).desc(), "seen")
    return fused.withColumn("fused_rank", F.row_number().over(w)).drop("seen")


def same_texts(counted: DataFrame, k: int) -> DataFrame:
    """(namespace, chunk_id, place, same, _tf): the first k chunks of each text (``_text``, its digest); ``same`` names the text: its first
    chunk (in front, as ties go by chunk), its digest and the namespace. The first one keeps the term counts."""
    before = Window.partitionBy(NS, "_text").orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tagged = counted.withColumn("_first", F.first("chunk_id").over(before))
    firsts = first_n(tagged, [NS, "_text"], [F.col("chunk_id")], k, rank="place")
    return firsts.select(NS, "chunk_id", "place", F.concat_ws("\0", "_first", "_text", NS).alias("same"),
                         F.when(F.col("place") == 1, F.col("_tf")).alias("_tf"))


def multi_query_knn(chunks: DataFrame, questions: DataFrame, k: int = 8, dims: int = 384) -> DataFrame:
    """Variants of each question, vectorised like the chunks, searched together and fused.

    Chunks of one text have one vector: it is searched once, in the place of its first chunk. A chunk among the k nearest is
    among the first k of its text, and that text is among the k nearest, as ties go by chunk. Terms are counted once; the
    counts are moved, not the texts.
    """
    counted = _term_counts(chunks.select(NS, F.col("chunk_id").cast("string").alias("chunk_id"), "text"), "text", dims)
    counted = cut(counted.select(NS, "chunk_id", F.sha2("text", 256).alias("_text"), "_tf"), "term-counts")
    rare = _rarities(counted)
    variants = query_variants(questions)
    coded = variants.select((F.col(Q) * 4 + F.col("variant_no") - 1).alias(Q), NS, F.col("variant").alias("text"))
    vectors = vectorise(coded, dims=dims, rare=rare)
    alike = cut(same_texts(counted, k), "same-texts")
    heads = alike.where("place = 1").select(NS, F.col("same").alias("chunk_id"), "_tf")
    stored = cut(_weighted(heads, rare).select(NS, "chunk_id", "embedding"), "vectors")
    near = knn(stored, cut(vectors.select(Q, NS, "embedding"), "query-vectors"), k).withColumnRenamed("chunk_id", "same").drop("rank")
    hits = first_n(near.join(alike.select("same", "chunk_id"), "same"), [Q], [F.col("distance"), F.col("chunk_id")], k)
    lists = hits.select(F.floor(F.col(Q) / 4).alias(Q), F.pmod(F.col(Q), F.lit(4)).alias("list_no"), "rank", "chunk_id", "distance")
    return rrf_fuse(lists, ["chunk_id"])


# ---- reports ----------------------------------------------------------------------------


def collection_stats(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy(NS, "source_type").agg(F.count(F.lit(1)).alias("chunks"))


def collection_samples(chunks: DataFrame, n: int = 10) -> DataFrame:
    rows = first_n(chunks, [NS], [F.col(c) for c in ORDER], n)
    return rows.select(NS, "rank", "source_file", "source_type", "line_start", "line_end",
                       F.substring("text", 1, 300).alias("text_preview"))


def first_wins(hits: DataFrame, key: list[str]) -> DataFrame:
    """Distinct hits per query, the first one kept."""
    others = [c for c in hits.columns if c not in (Q, "pos", *key)]
    rows = hits.groupBy(Q, *key).agg(F.min_by(F.struct(*others), "pos").alias("row"), F.min("pos").alias("pos"))
    return rows.select(Q, *key, "row.*", "pos")


def retrieval_diagnostics(semantic: DataFrame, keyword: DataFrame, ranked: DataFrame, questions: DataFrame) -> DataFrame:
    """Per question: hits of each search, distinct hits, whether the best one passes the threshold."""
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(Q).agg(F.count(F.lit(1)).alias(name))

    out = questions.select(Q)
    for df, name in ((semantic, "semantic_results"), (keyword, "keyword_results"), (ranked, "merged_results")):
        out = out.join(counted(df, name), Q, "left").fillna(0, [name])
    best = ranked.groupBy(Q).agg(F.min_by("confidence", "rank").alias("best"))
    return out.join(best, Q, "left").withColumn("has_relevant", F.coalesce(F.col("best") >= V.RELEVANT, F.lit(False)))


def identifiers_of(refs: DataFrame, n: int = 10) -> DataFrame:
    """First n distinct function and class names of each query's references (query_id, namespace, ord, …)."""
    names = refs.select(Q, NS, "ord", F.posexplode(F.array("function_name", "class_name")).alias("i", "term")).where(
        F.col("term") != "")
    firsts = names.groupBy(Q, NS, "term").agg(F.min(F.struct("ord", "i")).alias("seen"))
    return first_n(firsts, [Q], [F.col("seen"), F.col("term")], n, rank="pos").select(Q, NS, "pos", "term")


def not_in_evidence(hits: DataFrame, evidence: DataFrame, key: list[str]) -> DataFrame:
    """Hits without those in the evidence, which may be a whole table: both are shuffled, none is sent to the driver."""
    return hits.join(evidence.select(Q, *key).distinct().hint("merge"), [Q, *key], "left_anti")


