"""Exact top-k inner products with multi-resolution segment statistics.

Components become integers, floor(scale * x). A vector is cut into segments; each segment is known by its mean and its
deviation, at several resolutions. By the Cauchy-Schwarz inequality the inner product of two segments of length m is
at most m * (mean * mean + deviation * deviation), which bounds the score (for vectors of given norms: bounds
the distance from below). Blocks of candidates meet blocks of queries; bounds go from coarse to fine, and only
pairs that can still reach a query's k-th score are computed exactly. That score starts from the queries of the
query's own block, and only candidates at or above it leave a task.

Queries stand in blocks of ``QUERIES``; a candidate block is read once per query block, as searching all rows for all
queries requires. Query blocks are broadcast while they are few (counted), else joined by number.

Defined results: vectors that are null or empty or hold null or non-finite components, and null ids, take no part; shorter
vectors count as padded with zeros; of rows with equal ids each is a candidate, and the
queries among them are asked once per different vector; a query never finds rows with its own id; ties go to the smaller id; with fewer than k others all are returned; an empty table gives no rows. Sums are exact
while they stay below 2**63.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import keep
from faultline.llm.vectors import matrix, rows_of, usable

QUERIES = 2048
CANDIDATES = 4096
SEGMENTS = (4, 16)
FEW_BLOCKS = 16
DENSE = 0.1


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Weighted means and deviations per segment: inner products of these rows bound inner products of ``x``."""
    parts = np.array_split(x, min(segments, x.shape[1]), axis=1)
    root = [np.sqrt(p.shape[1]) for p in parts]
    means = [p.mean(axis=1) * r for p, r in zip(parts, root, strict=True)]
    deviations = [p.std(axis=1) * r for p, r in zip(parts, root, strict=True)]
    return np.stack(means + deviations, axis=1)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of ``a`` with all rows of ``b``."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < 2**53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties to smaller ids."""
    return np.lexsort((ids, -scores))[:k]


def starting_scores(ids: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
    """A score that k other queries of the block reach (the smallest number if there are too few)."""
    if len(ids) <= k:
        return np.full(len(ids), np.iinfo(np.int64).min)
    s = exact(q, q)
    s[ids[:, None] == ids[None, :]] = np.iinfo(np.int64).min
    return np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k]


def survivors(q: np.ndarray, x: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate) whose bounds reach the query's score, coarse to fine."""
    alive = None
    slack = 1e-9 * (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1).max(initial=0) + 1)
    floor_f = floor.astype(np.float64)
    for segments in SEGMENTS:
        fq, fx = statistics(q, segments), statistics(x, segments)
        if alive is None or len(alive[0]) > DENSE * len(q) * len(x):
            found = fq @ fx.T + slack >= floor_f[:, None]
            alive = np.nonzero(found if alive is None else found & _mask(alive, found.shape))
        else:
            i, j = alive
            ok = np.einsum("ij,ij->i", fq[i], fx[j]) + slack[i, 0] >= floor_f[i]
            alive = i[ok], j[ok]
    return alive


def _mask(pairs, shape) -> np.ndarray:
    out = np.zeros(shape, bool)
    out[pairs] = True
    return out


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """ids, data (int64 rows), dim: up to ``size`` vectors per row."""
    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), size):
                part = pdf.iloc[at:at + size]
                m = matrix(part["v"].tolist()).astype(np.int64)
                yield pd.DataFrame({"ids": [part["id"].to_numpy(np.int64).tobytes()], "data": [m.tobytes()], "dim": [m.shape[1]]})

    return rows.mapInPandas(run, "ids binary, data binary, dim int")


def unpack(ids: bytes, data: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(data, np.int64).reshape(-1, dim)


def top_products(embeddings: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, id_col: str = "vec_id",
                 vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score for queries (ids divisible by ``every``) against all rows."""
    rows = rows_of(embeddings, id_col, vec_col).where(F.col("id").isNotNull() & usable("v"))
    rows = rows.select("id", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("v"))
    rows = keep(rows, "integers")
    asked = rows.where(F.col("id") % every == 0).distinct()
    parts = -(-asked.count() // QUERIES)
    dealt = asked.repartition(max(1, parts), F.xxhash64("id"))
    queries = keep(blocks(dealt, QUERIES), "queries").withColumn("q", F.monotonically_increasing_id())
    queries = keep(queries, "queries")
    numbers = [r["q"] for r in queries.select("q").collect()]  # a number per QUERIES queries
    if not numbers:
        return rows.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"),
                           F.col("id").alias("score")).limit(0)
    all_q = F.array(*[F.lit(n).cast("long") for n in numbers])
    candidates = blocks(rows, CANDIDATES).withColumn("q", F.explode(all_q))
    side = queries.select("q", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.col("dim").alias("q_dim"))
    met = candidates.join(F.broadcast(side) if len(numbers) <= FEW_BLOCKS else side, "q")

    def search(batches):
        known: dict[int, tuple] = {}
        for pdf in batches:
            for ids, data, dim, number, q_ids, q_data, q_dim in pdf[
                    ["ids", "data", "dim", "q", "q_ids", "q_data", "q_dim"]].itertuples(index=False):
                if number not in known:
                    known.clear()
                    qi, q = unpack(q_ids, q_data, q_dim)
                    known[number] = (qi, q, starting_scores(qi, q, k))
                qi, q, floor = known[number]
                ci, x = unpack(ids, data, dim)
                width = max(q.shape[1], x.shape[1])
                q, x = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (q, x))
                i, j = survivors(q.astype(np.float64), x.astype(np.float64), floor)
                out = []
                for row in np.unique(i):
                    at = j[i == row] if len(i) < 1 << 16 else j[np.searchsorted(i, row):np.searchsorted(i, row, "right")]
                    at = at[ci[at] != qi[row]]
                    scores = exact(q[row:row + 1], x[at])[0]
                    good = scores >= floor[row]
                    at, scores = at[good], scores[good]
                    top = best_of(ci[at], scores, k)
                    if len(top):
                        out.append(pd.DataFrame({"query_id": qi[row], "vec_id": ci[at][top], "score": scores[top]}))
                if out:
                    yield pd.concat(out, ignore_index=True)

    columns = ["ids", "data", "dim", "q", "q_ids", "q_data", "q_dim"]
    found = met.select(*columns).mapInPandas(search, "query_id long, vec_id long, score long")
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
