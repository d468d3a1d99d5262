"""The registered corpus queries: thin digests of the operators over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.llm import (chat, jaccard, language, manifest, mixing, neighbours, pieces, quality, repeats, shards, topk,
                           toxicity, whitening)
from faultline.llm.common import held_out, table
from faultline.plans.registry import Catalog

C = Catalog()


@C.add("op1_sentencepiece")
def op1_sentencepiece(spark, sf):
    return pieces.encoded(table(spark, sf, "documents")).select("doc_id", "n_tokens", "ids", "round_trip")


@C.add("op2_toxicity")
def op2_toxicity(spark, sf):
    scored = toxicity.toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", "passages")


@C.add("op5_sharding")
def op5_sharding(spark, sf):
    placed = shards.shard_documents(table(spark, sf, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


@C.add("op7_mixing")
def op7_mixing(spark, sf):
    mixture = mixing.mix(table(spark, sf, "documents"))
    return mixture.select("doc_id", "size", "source_size", "target", "taken", "source", "copies", "shards")


@C.add("op8_ngram_jaccard")
def op8_ngram_jaccard(spark, sf):
    return jaccard.similarity_classes(table(spark, sf, "documents"))


@C.add("op3_suffix_dedup")
def op3_suffix_dedup(spark, sf):
    left = repeats.without_repeats(table(spark, sf, "documents"))
    return left.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
                       F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@C.add("op9_quality")
def op9_quality(spark, sf):
    return quality.quality(table(spark, sf, "documents"))


@C.add("op10_language")
def op10_language(spark, sf):
    found = language.languages(table(spark, sf, "documents"))
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


@C.add("op4_exact_topk")
def op4_exact_topk(spark, sf):
    return topk.top_products(table(spark, sf, "embeddings"))


@C.add("op6_embedding_dedup")
def op6_embedding_dedup(spark, sf):
    return neighbours.near_duplicates(table(spark, sf, "embeddings"))


@C.add("op11_whitening")
def op11_whitening(spark, sf):
    model, whitened = whitening.whiten(table(spark, sf, "embeddings"))
    return whitening.component_rows(model, whitened)


CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
_FIRST = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
_LEAF = f"sha256({_FIRST} || {_FIELD.format('text')})"
_LOWER = f"sha256({_FIRST} || {_FIELD.format(f"translate(text, '{CAPITALS}', '{CAPITALS.lower()}')")})"
#: CRC-32 of an ASCII text: bytes from the left, each eight steps of the reflected polynomial.
_CRC32 = """xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT),
  lambda crc, byte: list_reduce([xor(crc, byte)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda v, step: xor(v >> 1, (v & 1) * 3988292384))))"""


def _levels(name: str, start: str) -> str:
    """Nodes of all levels of the trees in ``start`` (tree, pos, h)."""
    return f"""{name}(tree, lv, pos, h, n) AS (
  SELECT tree, 0, pos, h, count(*) OVER (PARTITION BY tree) FROM ({start})
  UNION ALL
  SELECT tree, lv + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 15) // 16 FROM {name} WHERE n > 1 GROUP BY tree, lv, pos // 16)"""


def _walk(name: str, nodes: str, start: str) -> str:
    """For each (key, tree, pos, v) of ``start``: its siblings and the value that v folds to, level by level."""
    return f"""{name}(key, tree, lv, pos, v, seen, n) AS (
  SELECT key, s.tree, 0, s.pos, v, '', t.n FROM ({start}) s JOIN {nodes} t ON t.tree = s.tree AND t.lv = 0 AND t.pos = s.pos
  UNION ALL
  SELECT w.key, w.tree, w.lv + 1, w.pos // 16,
    sha256(coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos < w.pos), '') || any_value(w.v) || coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos > w.pos), '')),
    any_value(w.seen) || coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos <> w.pos), ''), (any_value(w.n) + 15) // 16
  FROM {name} w JOIN {nodes} t ON t.tree = w.tree AND t.lv = w.lv AND t.pos // 16 = w.pos // 16 WHERE w.n > 1 GROUP BY w.key, w.tree, w.lv, w.pos)"""


@C.add("op12_manifest", f"""WITH RECURSIVE leaves AS (
  SELECT doc_id, leaf, dense_rank() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS tree, CASE WHEN {_CRC32} % 5 = 0 THEN {_LOWER} ELSE leaf END AS claim
  FROM (SELECT *, {_LEAF} AS leaf FROM documents)),
placed AS (SELECT *, row_number() OVER (ORDER BY tree, doc_id NULLS FIRST, leaf) AS key, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
{_levels("nodes", "SELECT tree, pos, leaf AS h FROM placed")},
subroots AS (SELECT tree, h FROM nodes WHERE n = 1),
{_levels("forest", "SELECT 0 AS tree, tree AS pos, h FROM subroots")},
{_walk("low", "nodes", "SELECT key, tree, pos, claim AS v FROM placed")},
{_walk("high", "forest", "SELECT key, 0 AS tree, tree AS pos, v FROM low WHERE n = 1")},
whole AS (SELECT h AS root FROM forest WHERE n = 1)
SELECT doc_id, leaf, s.h AS subroot, root, sha256(low.seen || high.seen) AS proof_sha256, high.v AS folded_root, high.v = root AS verified
FROM placed JOIN low ON low.key = placed.key AND low.n = 1 JOIN high ON high.key = placed.key AND high.n = 1 JOIN subroots s ON s.tree = placed.tree, whole""")
def op12_manifest(spark, sf):
    docs = table(spark, sf, "documents")
    lower = F.translate("text", CAPITALS, CAPITALS.lower())
    tampered = manifest.leaf(*[lower if f == "text" else F.col(f) for f in manifest.FIELDS])
    whole = manifest.build(docs, F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, tampered))
    return manifest.audit(whole, dict(docs.dtypes)["doc_id"]).select(
        F.col("id").alias("doc_id"), "leaf", "subroot", F.lit(whole.root).alias("root"), "proof_sha256", "folded_root", "verified")


def _escaped_length(text: str) -> str:
    """Characters of an escaped text: one more for each backslash and control string."""
    gone = " + ".join(f"(length({text}) - length(replace({text}, '{c}', ''))) // {len(c)}" for c in ["\\", *chat.CONTROLS])
    return f"(length({text}) + {gone})"


#: Characters around a turn's texts by role.
_AROUND = {role: len("".join(p for p, _ in chat.Template().render([{"role": role, "text": ""}]))) - len("<s>")
           for role in ("user", "system", "assistant", "")}


@C.add("op13_chat_format", f"""
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum({_escaped_length("text")} + CASE role {" ".join(f"WHEN '{r}' THEN {n}" for r, n in _AROUND.items() if r)} ELSE {_AROUND[""]} + {_escaped_length("role")} END) AS BIGINT) AS formatted_chars
FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')))
GROUP BY conv_id""")
def op13_chat_format(spark, sf):
    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    found = chat.read_back(chat.format_conversations(rows.unionByName(extra)))
    return found.withColumn("conv_id", F.col("conv_id").cast("long"))
