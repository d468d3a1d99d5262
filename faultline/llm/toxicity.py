"""Toxicity by maximum-scoring segments.

Fit: labelled documents that are not held out give, per hashed token and class, the number of documents that use it;
of near copies (equal smallest hash of a word pair) one counts, the one whose id has the smallest hash. A token's score is its log-odds ratio between the
classes with a Dirichlet prior in proportion to its frequency; ratios that are not significant count as nothing, and every token pays a small drift, so that random text scores below zero. Under the
token distribution of clean text the scores have a decay rate ``lam`` (root of E[exp(lam * s)] = 1) and the number of
chance passages scoring S or more in n tokens is about ``K * n * exp(-lam * S)``: the E-value. K is measured on clean
documents the counts have not seen.

Scan: one linear pass finds all maximal scoring segments of a text (each segment that no neighbour can extend
to a better score). Those with an E-value below 1 are its significant passages; the sum of their -ln E is the
document's evidence, which a logistic curve, fitted on documents the counts have not seen, turns into a probability.

Bounds: counts and curve are fitted on at most ``fit_rows`` labelled documents per class, chosen by hash of the id; class
shares come from all labels. The model is one number per bucket. Scoring reads every whole text, one at a time.

Defined results: null, empty and wordless texts have no passages and the lowest score; a document with several labels
is toxic if one of them says so; null labels and ids in no label row teach nothing; without labels of both classes every
score is the share of toxic labels (0 without any). Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import held_out, keep, spread_seed

BUCKETS = 1 << 18
PRIOR = 1000.0
SIGNIFICANT = 2.5
DRIFT = 0.5
FIT_ROWS = 1 << 14
SURE_SCORE = 1.0
CACHE = 1 << 20

TOKEN = re.compile(r"\w+")


def token_buckets(text: str | None, cache: dict[str, int]) -> np.ndarray:
    if not text:
        return np.empty(0, np.int64)
    words = TOKEN.findall(text.lower())
    try:
        return np.array([cache[w] for w in words], np.int64)
    except KeyError:
        if len(cache) > CACHE:
            cache.clear()
        for w in set(words):
            if w not in cache:
                cache[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS
        return np.array([cache[w] for w in words], np.int64)


def signed(batches):
    """Adds ``pair``, the smallest hash of two neighbouring words: near copies mostly agree in it."""
    cache: dict[str, int] = {}
    for pdf in batches:
        pairs = []
        for text in pdf["text"]:
            ids = token_buckets(text, cache).astype(np.uint64)
            if len(ids) > 1:
                mixed = (ids[:-1] * np.uint64(BUCKETS) + ids[1:] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
                pairs.append(int((mixed >> np.uint64(1)).min()))
            else:
                pairs.append(-1 - int(ids.sum()))
        yield pdf.assign(pair=pairs)


def token_scores(toxic: np.ndarray, clean: np.ndarray) -> tuple[np.ndarray, float]:
    """Score per bucket and the decay rate of scores in clean text."""
    both = toxic + clean
    prior = PRIOR * (both + 1 / BUCKETS) / (both.sum() + 1)
    n_t, n_c = toxic.sum() + prior.sum(), clean.sum() + prior.sum()
    t, c = toxic + prior, clean + prior
    ratio = np.log(t / (n_t - t)) - np.log(c / (n_c - c))
    ratio[np.abs(ratio) < SIGNIFICANT * np.sqrt(1 / t + 1 / c)] = 0
    scores = ratio - DRIFT
    share = c / c.sum()
    if scores.max() <= 0:
        return scores.astype(np.float32), 1.0
    lo, hi = 0.0, 50.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (share * np.exp(np.minimum(mid * scores, 500))).sum() < 1 else (lo, mid)
    return scores.astype(np.float32), lo


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(start, end, score)``, end exclusive, in order; linear in the length."""
    hits = np.flatnonzero(scores > 0)
    if not len(hits):
        return []
    right = np.cumsum(scores, dtype=np.float64)
    # Candidate: [start, end, sum before it, sum at its end, index of the nearest earlier one with a lower sum before].
    kept: list[list] = []
    for at in hits.tolist():
        end_sum = right[at]
        start, before = at, end_sum - scores[at]
        j = len(kept) - 1
        while True:
            while j >= 0 and kept[j][2] >= before:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= end_sum:
                break
            start, before = kept[j][0], kept[j][2]
            del kept[j:]
            j = len(kept) - 1
        kept.append([start, at + 1, before, end_sum, j])
    return [(s, e, float(r - b)) for s, e, b, r, _ in kept]


@dataclass
class Model:
    scores: np.ndarray
    lam: float = 1.0
    k: float = 1.0
    slope: float = 0.0
    bias: float = -50.0

    def passages(self, buckets: np.ndarray) -> list[tuple[int, int, float, float]]:
        """Significant passages: first token, last token + 1, score, E-value."""
        found = []
        for start, end, score in maximal_segments(self.scores[buckets]):
            chance = self.k * len(buckets) * np.exp(-self.lam * score)
            if chance < 1:
                found.append((start, end, score, float(chance)))
        return found

    def probability(self, evidence):
        return 1 / (1 + np.exp(-(self.slope * np.log1p(evidence) + self.bias)))


def evidence_of(passages) -> float:
    return float(sum(-np.log(max(p[3], 1e-300)) for p in passages))


def logistic_fit(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Weighted one-dimensional logistic regression by damped Newton steps, slope kept at 0 or above."""
    a, b = 0.0, float(np.log((w * y).sum() / (w * (1 - y)).sum()))
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * x + b)))
        g = w * (y - p)
        h = w * p * (1 - p) + 1e-9
        ga, gb = (g * x).sum() - 1e-3 * a, g.sum()
        haa, hab, hbb = (h * x * x).sum() + 1e-3, (h * x).sum(), h.sum() + 1e-9
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = min(1.0, 2.0 / (abs(da) + abs(db) + 1e-12))
        a, b = max(0.0, a + step * da), b + step * db
        if abs(da) + abs(db) < 1e-9:
            break
    return a, b


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, modulus: int, remainder: int,
        fit_rows: int = FIT_ROWS) -> Model:
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    known = known.where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", modulus, remainder))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    shares = {r["y"]: r["n"] for r in known.where("y in (0, 1)").groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    model = Model(np.full(BUCKETS, -DRIFT, np.float32))
    if len(shares) < 2:
        model.bias = 50.0 if 1 in shares else -50.0
        return model
    order = spread_seed("doc_id", seed=2)
    chosen = [known.where(F.col("y") == y).orderBy(order, "doc_id").limit(fit_rows) for y in (0, 1)]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * fit_rows ids
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(chosen, "doc_id")
    # Of near copies the smallest hash of the id stays, whatever the layout of the rows: ties go to the text.
    texts = texts.select("text", "y", spread_seed("doc_id", seed=3).alias("place"))
    signs = texts.mapInPandas(signed, "text string, y int, place long, pair long")
    first = signs.groupBy("y", "pair").agg(F.min(F.struct("place", "text")).alias("first")).select("y", "first.*")
    texts = keep(first.select("text", "y", (F.pmod("place", F.lit(2)) == 0).alias("counted")), "toxic-fit")

    def count(batches):
        cache: dict[str, int] = {}
        sums = np.zeros((2, BUCKETS), np.int64)
        for pdf in batches:
            for text, y in zip(pdf["text"], pdf["y"], strict=True):
                sums[y][np.unique(token_buckets(text, cache))] += 1
        used = np.flatnonzero(sums.any(axis=0))
        yield pd.DataFrame({"bucket": used, "clean": sums[0, used], "toxic": sums[1, used]})

    counted = texts.where("counted").select("text", "y").mapInPandas(count, "bucket long, clean long, toxic long")
    per = counted.groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toPandas()
    toxic, clean = np.zeros(BUCKETS), np.zeros(BUCKETS)
    toxic[per["bucket"]], clean[per["bucket"]] = per["toxic"], per["clean"]
    model.scores, model.lam = token_scores(toxic, clean)
    scores = docs.sparkSession.sparkContext.broadcast(model.scores)

    def scan(batches):
        cache: dict[str, int] = {}
        for pdf in batches:
            rows = []
            for text, y in zip(pdf["text"], pdf["y"], strict=True):
                ids = token_buckets(text, cache)
                rows.append((y, len(ids), [s for _, _, s in maximal_segments(scores.value[ids])]))
            yield pd.DataFrame(rows, columns=["y", "n", "segments"])

    unseen = texts.where("not counted").select("text", "y").mapInPandas(scan, "y int, n long, segments array<double>")
    unseen = unseen.toPandas()  # at most 2 * fit_rows documents
    # Sums of floats depend on their order: it must not follow the layout.
    order = sorted(range(len(unseen)), key=lambda i: (unseen["y"][i], unseen["n"][i], tuple(unseen["segments"][i])))
    unseen = unseen.iloc[order]
    quiet = unseen[unseen["y"] == 0]
    chance = sum(int((np.asarray(s) >= SURE_SCORE).sum()) for s in quiet["segments"])
    model.k = (chance + 0.5) * np.exp(model.lam * SURE_SCORE) / max(1.0, float(quiet["n"].sum()))
    proof = np.array([
        sum(max(0.0, -np.log(max(model.k * n, 1e-300)) + model.lam * s) for s in segments)
        for n, segments in zip(unseen["n"], unseen["segments"], strict=True)])
    y = unseen["y"].to_numpy(float)
    if 0 < y.sum() < len(y):
        total = shares[0] + shares[1]
        weight = np.where(y == 1, shares[1] / total / y.sum(), shares[0] / total / (1 - y).sum()) * len(y)
        model.slope, model.bias = logistic_fit(np.log1p(proof), y, weight)
    else:
        model.bias = float(np.log(shares[1] / shares[0]))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, evidence, passages (first token, end token, score, e_value) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[id_col].dataType.simpleString()

    def scan(batches):
        cache: dict[str, int] = {}
        for pdf in batches:
            found = [shared.value.passages(token_buckets(t, cache)) for t in pdf["text"]]
            proof = np.array([evidence_of(p) for p in found])
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"], "score": shared.value.probability(proof), "evidence": proof,
                "passages": [[{"first": a, "end": b, "score": s, "e_value": e} for a, b, s, e in p] for p in found]})

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(
        scan, f"doc_id {id_type}, score double, evidence double, "
              "passages array<struct<first:long,end:long,score:double,e_value:double>>")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "toxic", modulus: int = 5, remainder: int = 0, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Fit on labelled rows whose id hash does not leave ``remainder``, then score every row."""
    return score(docs, fit(docs, labels, id_col, text_col, label_col, modulus, remainder, fit_rows), id_col, text_col)


def reject(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that score below ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        cache: dict[str, int] = {}
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            proof = np.array([evidence_of(shared.value.passages(token_buckets(t, cache))) for t in texts])
            yield batch.filter(pa.array(shared.value.probability(proof) < threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
