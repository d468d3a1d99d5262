"""Documents to training tokens: five stages, each on all rows that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of documents. Empty tables pass through every stage; a row with a
null id is a document that nothing else is linked with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import jaccard, mixing, pieces, repeats, toxicity
from faultline.llm.common import keep, table
from faultline.plans.registry import Catalog

KEY = "_document_key"

def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity of 0.5 or more go; the model learns from labelled rows that are not held out."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "toxic", 5, 0)
    return toxicity.reject(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles with a similarity of 0.8 or more, the one with the smallest
    id stays (ties: smallest hash of the text). Rows are told apart by id and text, so another text under a repeated id is
    a document of its own; of rows equal in both one stays. Documents without words are linked with nothing, null ids and
    their rows stay."""
    key = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text"))
    keyed = docs.withColumn(KEY, key)
    classes = jaccard.similarity_classes(keyed, n=5, num=80, den=100, id_col=KEY)
    ids = docs.where("doc_id is not null").select("doc_id", key.alias("key")).distinct()
    groups = ids.join(classes.select(F.col("doc_id").alias("key"), "component_id").distinct(), "key")
    stay = groups.groupBy("component_id").agg(F.min(F.struct("doc_id", "key")).alias("first"))
    kept = keyed.join(stay.select(F.col("first.key").alias(KEY)), KEY, "left_semi").dropDuplicates([KEY])
    return kept.unionByName(keyed.where("doc_id is null")).select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 50-byte strings that start in a document with a smaller id are removed, characters cut in two with
    them; n_chars follows the text. A text without any removal stays as it is, null included; replacement characters
    of the text itself stay."""
    others = [c for c in docs.columns if c != "doc_id"]
    left = repeats.without_repeats(docs, carry=others, as_text=True)
    text = F.when(F.size("spans") == 0, F.col("text")).otherwise(F.col("kept_text"))
    out = left.withColumn("text", text)
    if "n_chars" in docs.columns:
        length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.size("spans") == 0, F.col("n_chars")).otherwise(length))
    return out.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a source's words come to its target, no document more than twice.
    Rows equal in id, source and size are taken alike."""
    mixture = mixing.mix(docs)
    copies = mixture.groupBy("doc_id", "source").agg(F.max("copies").alias("copies")).where("copies > 0").select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), "copies")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source"))
    taken = docs.join(copies, same).withColumn("_pass", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return taken.select(*docs.columns)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, round_trip for every row."""
    return pieces.encoded(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("sentencepiece", to_tokens),
]

#: Learned scores, byte positions and tokens have no SQL form; tests hold every stage against plain models.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


C = Catalog()
C.add("pipeline", ORACLE_SQL)(run)
