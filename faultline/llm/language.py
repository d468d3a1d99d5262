"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, everything but letters becomes a blank, and all n-grams of 1 to 3 characters are hashed. A feature is the
n-gram's share of the text times its inverse document frequency; document frequencies are counted over all learnable
rows. The weights are trained by follow-the-regularised-leader with elastic-net penalties (most stay zero) on at
most about ``fit_rows`` rows per language, chosen by hash of the id; a fifth of those is left out of the training and
gives the temperature that calibrates the probabilities. Whole texts are scored.

Defined results: null texts and texts without a letter are ``und`` with score 0; without learnable rows every text is; rows
with a null language teach nothing; a null id is never held out; repeated rows count as often as they occur; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import held_out, spread_seed

BUCKETS = 1 << 16
SIZES = (1, 2, 3)
FIT_ROWS = 1500
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.001
PIECE = 1 << 20
UNKNOWN = "und"
PRIMES = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(text: str | None) -> np.ndarray:
    """Buckets of all n-grams of a text, with repeats; empty without letters."""
    if not text:
        return np.empty(0, np.int64)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[codes]
    if not is_letter.any():
        return np.empty(0, np.int64)
    codes = np.concatenate([[32], np.where(is_letter, codes, 32), [32]]).astype(np.uint64)
    out = []
    for n in SIZES:
        h = np.full(len(codes) - n + 1, n, np.uint64)
        for k in range(n):
            h = (h ^ codes[k:len(codes) - n + 1 + k]) * np.uint64(PRIMES[k])
            h ^= h >> np.uint64(15)
        out.append(h % np.uint64(BUCKETS))
    return np.concatenate(out).astype(np.int64)


def features(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ids = grams(text)
    where, counts = np.unique(ids, return_counts=True)
    return where, counts / max(1, len(ids)) * idf[where]


class Ftrl:
    """Follow-the-regularised-leader with per-coordinate rates and elastic net, one row of weights per bucket."""

    def __init__(self, classes: int) -> None:
        self.z = np.zeros((BUCKETS + 1, classes))
        self.n = np.zeros((BUCKETS + 1, classes))

    def weights(self, rows: np.ndarray) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def learn(self, rows: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(rows)
        p = softmax(x @ w)
        p[label] -= 1
        g = x[:, None] * p[None, :]
        grown = self.n[rows] + g * g
        self.z[rows] += g - (np.sqrt(grown) - np.sqrt(self.n[rows])) / ALPHA * w
        self.n[rows] = grown


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


SCALE = 50.0  # shares are small numbers; the penalties are set for features of this size


def with_bias(rows: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.append(rows, BUCKETS).astype(np.int32), np.append(x * SCALE, 1.0).astype(np.float32)


def train(texts: list[str], labels: np.ndarray, order: np.ndarray, idf: np.ndarray, classes: int) -> tuple[np.ndarray, float]:
    """Weights (bias in the last row) and temperature; ``order`` is a hash per row that mixes and splits the rows."""
    turn = np.argsort(order, kind="stable")
    rows = [with_bias(*features(texts[i], idf)) for i in turn]
    y = labels[turn]
    fit, proof = [i for i in range(len(turn)) if i % 5], [i for i in range(len(turn)) if i % 5 == 0]
    model = Ftrl(classes)
    for _ in range(EPOCHS):
        for i in fit or proof:
            if len(rows[i][0]) > 1:
                model.learn(*rows[i], y[i])
    w = model.weights(np.arange(BUCKETS + 1))
    scores = np.array([x @ w[r] for r, x in (rows[i] for i in proof)])
    best, temperature = np.inf, 1.0
    for t in np.exp(np.linspace(0, 4, 81)):
        loss = -np.log(softmax(scores / t)[np.arange(len(proof)), y[proof]] + 1e-12).mean()
        if loss < best - 1e-12:
            best, temperature = loss, float(t)
    return w, temperature


@dataclass
class Model:
    names: list[str] = field(default_factory=list)
    weights: np.ndarray | None = None  # inverse document frequencies multiplied in
    bias: np.ndarray | None = None
    temperature: float = 1.0

    def predict(self, text: str | None) -> tuple[str, float]:
        ids = grams(text)
        if not self.names or not len(ids):
            return UNKNOWN, 0.0
        total = np.zeros(len(self.names))
        for at in range(0, len(ids), PIECE):
            total += self.weights[ids[at:at + PIECE]].sum(axis=0, dtype=np.float64)
        p = softmax((total / len(ids) + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.names[best], float(p[best])


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, modulus: int, remainder: int,
        fit_rows: int = FIT_ROWS) -> Model:
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & ~held_out("doc_id", modulus, remainder))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model()
    names = sorted(sizes)

    def count(batches):
        df, n = np.zeros(BUCKETS, np.int64), 0
        for pdf in batches:
            for text in pdf["text"]:
                df[np.unique(grams(text))] += 1
                n += 1
        used = np.flatnonzero(df)
        yield pd.DataFrame({"bucket": np.append(used, -1), "df": np.append(df[used], n)})

    counted = rows.select("text").mapInPandas(count, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df"))
    counted = counted.toPandas()  # a row per bucket
    total = int(counted["df"][counted["bucket"] == -1].sum())
    df = np.zeros(BUCKETS)
    known = counted[counted["bucket"] >= 0]
    df[known["bucket"]] = known["df"]
    idf = np.log((1 + total) / (1 + df)) + 1

    share = F.create_map(*[x for name in names for x in (F.lit(name), F.lit(min(1.0, fit_rows / sizes[name])))])
    order = spread_seed("doc_id", seed=10)
    chosen = rows.where(F.pmod(order, F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    shared = spark.sparkContext.broadcast((names, idf))

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        langs, weights = shared.value
        labels = pdf["lang"].map({name: i for i, name in enumerate(langs)}).to_numpy()
        w, t = train(pdf["text"].tolist(), labels, pdf["order"].to_numpy(), weights, len(langs))
        return pd.DataFrame({"weights": [w.astype(np.float64).tobytes()], "temperature": [t]})

    # The sample is bounded by fit_rows per language, so one task holds it.
    learned = chosen.select(F.lit(0).alias("one"), "text", "lang", order.alias("order")).groupBy("one").applyInPandas(
        learn, "weights binary, temperature double").first()
    if learned is None:
        return Model()
    w = np.frombuffer(learned["weights"], np.float64).reshape(BUCKETS + 1, len(names))
    return Model(names, (w[:-1] * idf[:, None] * SCALE).astype(np.float32), w[-1], learned["temperature"])


def languages(docs: DataFrame, modulus: int = 4, remainder: int = 2, id_col: str = "doc_id", text_col: str = "text",
              lang_col: str = "lang", fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, lang_pred, score for every row; rows whose id hash leaves ``remainder`` teach nothing."""
    model = fit(docs, id_col, text_col, lang_col, modulus, remainder, fit_rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            found = [shared.value.predict(t) for t in pdf["text"]]
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"], "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]})

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"doc_id {id_type}, lang_pred string, score double")
