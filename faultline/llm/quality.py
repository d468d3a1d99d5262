"""Quality by weak labels.

Nine heuristic labellers look at each whole text and say good (1), poor (0) or nothing (-1). How often each combination of
answers occurs is counted over all documents; expectation-maximisation on these counts estimates how the labellers answer
for good and for poor documents, and so how likely a document with some answers is good. A linear scorer on
hashed words and word shapes then learns those posteriors, on at most about ``fit_rows`` documents chosen by hash, and
scores every document.

Defined results: null, empty and blank texts have score 0; without any text all scores are 0; repeated rows count
as often as they occur; an empty table gives no rows; other columns are not read. No given label is used.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import keep, spread_seed

BUCKETS = 1 << 17
FIT_ROWS = 1 << 14
ROUNDS = 200
EPOCHS = 3
RATE = 0.5

MARKS = re.compile(r"[^\w\s]")
RUNS = re.compile(r"(.)\1+", re.DOTALL)


_kinds: list[np.ndarray] = []


def character_kinds() -> np.ndarray:
    """Per code point: 1 letter, 2 upper case, 4 neither letter, digit, underscore nor white space."""
    if not _kinds:
        _kinds.append(np.fromiter((
            (c.isalpha()) + 2 * c.isupper() + 4 * (not (c.isalnum() or c == "_" or c.isspace()))
            for c in map(chr, range(0x110000))), np.uint8, 0x110000))
    return _kinds[0]


def vote(good: bool, poor: bool) -> int:
    return 0 if poor else 1 if good else -1


def answers(text: str | None) -> list[int] | None:
    """What each labeller says of a text; None for texts without words."""
    words = text.split() if text else []
    if not words:
        return None
    n, chars = len(words), sum(map(len, words))
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    kinds = character_kinds()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    alpha, upper, marks = (int(np.count_nonzero(kinds & bit)) for bit in (1, 2, 4))
    flags = Counter(words)
    bare = sum(k for w, k in flags.items() if not any(map(str.isalnum, w)))
    solid = sum(k for w, k in flags.items() if w.isalnum() or len(MARKS.findall(w)) <= 1)
    return [
        vote(40 <= n <= 20000, n < 8),
        vote(marks < 0.06 * chars, marks > 0.1 * chars),
        vote(alpha > 0.93 * chars, alpha < 0.9 * chars),
        vote(upper < 0.15 * max(1, alpha), upper > 0.4 * max(1, alpha)),
        vote(len(lines) > 2 and len(set(lines)) > 0.9 * len(lines), len(lines) > 4 and len(set(lines)) < 0.6 * len(lines)),
        vote(n > 60 and len(set(words)) > 0.35 * n, n > 60 and len(set(words)) < 0.2 * n),
        vote(3 <= chars / n <= 10, chars / n > 16 or chars / n < 2),
        vote(solid > 0.95 * n, solid < 0.7 * n),
        vote(bare < 0.02 * n, bare > 0.15 * n),
    ]


LABELLERS = 9


def estimate(votes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of good per combination of answers, and the answers' chances (class, labeller, answer + 1)."""
    given = np.stack([votes == a for a in (-1, 0, 1)], axis=2).astype(float)  # combination, labeller, answer
    chances = np.empty((2, votes.shape[1], 3))
    chances[0], chances[1] = [0.3, 0.5, 0.2], [0.3, 0.1, 0.6]
    prior = np.array([0.2, 0.8])
    for _ in range(ROUNDS):
        logs = np.log(prior)[None, :] + np.einsum("pla,cla->pc", given, np.log(chances))
        post = np.exp(logs - logs.max(axis=1, keepdims=True))
        post /= post.sum(axis=1, keepdims=True)
        mass = post * counts[:, None]
        before = chances.copy()
        prior = (mass.sum(axis=0) + 1) / (counts.sum() + 2)
        chances = np.einsum("pc,pla->cla", mass, given) + np.array([[[1, 3, 1]], [[1, 1, 3]]])
        chances /= chances.sum(axis=2, keepdims=True)
        if np.abs(chances - before).max() < 1e-9:
            break
    return post[:, 1], chances


def shape(word: str) -> str:
    out = "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in word)
    return RUNS.sub(r"\1", out)


def hashed(text: str, cache: dict[str, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words and word shapes with their shares of the text."""
    if len(cache) > 1 << 18:
        cache.clear()
    ids = []
    for w in text.split():
        pair = cache.get(w)
        if pair is None:
            pair = cache[w] = (zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) % BUCKETS,
                               zlib.crc32(b"\0" + shape(w).encode("utf-8", "surrogatepass")) % BUCKETS)
        ids += pair
    where, counts = np.unique(np.array(ids, np.int64), return_counts=True)
    x = np.sqrt(counts / max(1, len(ids)))
    return np.append(where, BUCKETS), np.append(x, 1.0)


def train(texts: list[str], target: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Logistic weights (bias last) for soft targets, by adaptive gradient steps."""
    cache: dict[str, tuple[int, int]] = {}
    rows = [hashed(t, cache) for t in texts]
    w, g2 = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-6)
    for _ in range(EPOCHS):
        for i in np.argsort(order, kind="stable"):
            where, x = rows[i]
            g = (1 / (1 + np.exp(-(x @ w[where]))) - target[i]) * x + 1e-6 * w[where]
            g2[where] += g * g
            w[where] -= RATE * g / np.sqrt(g2[where])
    return w


def per_row(texts: DataFrame, schema: str, make: Callable) -> DataFrame:
    def run(batches):
        for pdf in batches:
            yield make(pdf)

    return texts.mapInPandas(run, schema)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, votes, weak (posterior of good), score, keep for every row."""
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def answered(pdf):
        codes = []
        for text in pdf["text"]:
            a = answers(text)
            codes.append(-1 if a is None else sum((v + 1) * 3 ** k for k, v in enumerate(a)))
        return pd.DataFrame({"doc_id": pdf["doc_id"], "code": codes})

    judged = keep(per_row(rows, f"doc_id {id_type}, code long", answered), "answers")
    counts = judged.where("code >= 0").groupBy("code").agg(F.count(F.lit(1)).alias("n")).orderBy("code").toPandas()
    if not len(counts):
        none = F.lit(0.0)
        return judged.select("doc_id", F.expr("cast(array() as array<int>)").alias("votes"), none.alias("weak"),
                             none.alias("score"), F.lit(False).alias("keep"))
    codes = counts["code"].to_numpy()  # at most 3 ** LABELLERS
    votes = np.stack([codes // 3 ** k % 3 - 1 for k in range(LABELLERS)], axis=1)
    posterior, _ = estimate(votes, counts["n"].to_numpy(float))
    weak = dict(zip(codes.tolist(), posterior.tolist(), strict=True))
    order = spread_seed("doc_id", seed=9)
    share = min(1.0, fit_rows / float(counts["n"].sum()))
    shared = spark.sparkContext.broadcast(weak)
    sample = rows.where(F.pmod(order, F.lit(1 << 20)) < share * (1 << 20))

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        said = [answers(t) for t in pdf["text"]]
        have = [i for i, a in enumerate(said) if a is not None]
        target = np.array([shared.value[sum((v + 1) * 3 ** k for k, v in enumerate(said[i]))] for i in have])
        w = train([pdf["text"].iloc[i] for i in have], target, pdf["order"].to_numpy()[have])
        return pd.DataFrame({"weights": [w.tobytes()]})

    # The sample is bounded by fit_rows, so one task holds it.
    learned = sample.select(F.lit(0).alias("one"), "text", order.alias("order")).groupBy("one").applyInPandas(
        learn, "weights binary").first()
    weights = np.frombuffer(learned["weights"]) if learned else np.zeros(BUCKETS + 1)
    model = spark.sparkContext.broadcast((weak, weights))

    def scored(batches):
        known, w = model.value
        cache: dict[str, tuple[int, int]] = {}
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                a = answers(text)
                if a is None:
                    out.append(([], 0.0, 0.0))
                    continue
                where, x = hashed(text, cache)
                code = sum((v + 1) * 3 ** k for k, v in enumerate(a))
                out.append((a, known[code], float(1 / (1 + np.exp(-(x @ w[where]))))))
            frame = pd.DataFrame(out, columns=["votes", "weak", "score"])
            frame.insert(0, "doc_id", pdf["doc_id"].values)
            yield frame

    result = rows.mapInPandas(scored, f"doc_id {id_type}, votes array<int>, weak double, score double")
    return result.withColumn("keep", F.col("score") >= 0.5)
