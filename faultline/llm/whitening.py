"""Embedding whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

Components become integers x = floor(scale * c) + offset. Two passes gather, in exact integers, the sums per dimension
and the scatter of x centred on the integers nearest to the means; what is left of the means (at most one half) is
taken off exactly. Neither depends on how rows are dealt out. The covariance V is one correctly rounded matrix of
dims x dims numbers on the driver: its size follows the dimensions, not the rows.

Cholesky with diagonal pivots gives V = L L' with as many columns as V has rank: a dimension is used up once no more
than rounding is left of its own variance, so dimensions of very different spread keep theirs. Jacobi rotations make
L's columns orthogonal; their squared norms are the eigenvalues, the normalised columns the components.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do those with a component
that scales to 2**40 or more; shorter vectors count as padded with zeros, an empty one as all zeros; every row counts,
repeated and null ids included; there are at most as many components as the covariance has rank (none for one row or
equal rows: no whitened values then); equal eigenvalues stand in any order, the same for all rows; a deviation that
no long holds is null; an empty table gives no rows. Columns other than id and vector are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import drop_kept, keep

LARGEST = float(1 << 40)
SWEEPS = 60


@dataclass
class Whitening:
    """n rows with the given sums; unit components (rows of a matrix) by falling eigenvalue, and V's trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    scale: int
    offset: int

    @property
    def centre(self) -> np.ndarray:
        """The integers nearest to the means."""
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)

    @property
    def explained(self) -> list[float]:
        return [float(e / self.trace) for e in self.eigenvalues]


# ---- small dense matrices ---------------------------------------------------------------


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """L (rows in the order of v, one column per pivot) with v = L L' up to rounding."""
    d = len(v)
    left, floor = v.diagonal().copy(), v.diagonal() * d * np.finfo(float).eps
    columns: list[np.ndarray] = []
    open_ = left > floor
    while open_.any():
        at = int(np.argmax(np.where(open_, left, -1.0)))
        column = v[:, at] - sum((c * c[at] for c in columns), np.zeros(d))
        column = np.where(open_, column, 0.0) / math.sqrt(left[at])
        column[at] = math.sqrt(left[at])
        columns.append(column)
        left = left - column**2
        open_[at] = False
        open_ &= left > floor
    return np.stack(columns, axis=1) if columns else np.zeros((d, 0))


def rounds(r: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of r columns in rounds of disjoint pairs (a tournament's order)."""
    players = [*range(r), *[-1] * (r % 2)]
    for _ in range(len(players) - 1):
        half = len(players) // 2
        pairs = [(a, b) for a, b in zip(players[:half], players[:half - 1:-1], strict=True) if a >= 0 and b >= 0]
        yield tuple(np.array(side, int) for side in zip(*pairs, strict=True)) if pairs else (np.zeros(0, int),) * 2
        players = [players[0], players[-1], *players[1:-1]]


def one_sided_jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (rows) of factor factor', by rotating pairs of its columns."""
    a = factor.copy()
    small = np.finfo(float).eps * math.sqrt(max(1, len(a)))
    for _ in range(SWEEPS):
        turned = False
        for p, q in rounds(a.shape[1]):
            x, y = a[:, p], a[:, q]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            turn = np.abs(xy) > small * np.sqrt(xx * yy)
            if not turn.any():
                continue
            turned = True
            zeta = np.where(turn, yy - xx, 0.0) / np.where(turn, 2 * xy, 1.0)
            t = np.where(turn, np.copysign(1.0, zeta) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            c = 1 / np.hypot(1.0, t)
            a[:, p], a[:, q] = c * x - c * t * y, c * t * x + c * y
        if not turned:
            break
    values = (a * a).sum(0)
    order = np.argsort(-values, kind="stable")
    order = order[values[order] > 0]
    return values[order], (a[:, order] / np.sqrt(values[order])).T


# ---- passes over the rows ---------------------------------------------------------------


def fit_rows(embeddings: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """id, v (doubles) of the rows that take part."""
    rows = embeddings.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    held = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * abs(scale) < LARGEST))
    return rows.where(F.coalesce(held, F.lit(False)))


def integers(column: pa.Array, d: int, scale: int, offset: int) -> np.ndarray:
    """x of a column of lists, as a matrix of d columns."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), d))
    out[np.arange(d)[None, :] < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return np.floor(out * scale).astype(np.int64) + offset


def exact_gram(z: np.ndarray) -> np.ndarray:
    """z' z in exact integers."""
    most = int(np.abs(z).max(initial=0)) ** 2 * len(z)
    if most < 1 << 53:
        f = z.astype(np.float64)
        return (f.T @ f).astype(np.int64)
    z = z if most < 1 << 62 else z.astype(object)
    return z.T.dot(z)


def _sums(rows: DataFrame, d: int, scale: int, offset: int) -> tuple[int, list[int]]:
    def run(batches):
        n, total = 0, [0] * d
        for b in batches:
            x = integers(b.column(0), d, scale, offset)
            n, total = n + len(x), [t + int(s) for t, s in zip(total, x.sum(0), strict=True)]
        yield pa.RecordBatch.from_pydict({"i": [*range(-1, d)], "s": [str(s) for s in (n, *total)]})

    found = rows.select("v").mapInArrow(run, "i long, s string")
    found = found.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).cast("string").alias("s")).collect()
    by = {r["i"]: int(r["s"]) for r in found}
    return by.get(-1, 0), [by.get(i, 0) for i in range(d)]


def _scatter(rows: DataFrame, d: int, scale: int, offset: int, centre: np.ndarray) -> list[list[int]]:
    """Upper triangle, row by row: sums of products of x - centre."""
    def run(batches):
        total, bound = np.zeros((d, d), np.int64), 0
        for b in batches:
            z = integers(b.column(0), d, scale, offset) - centre
            bound += int(np.abs(z).max(initial=0)) ** 2 * len(z)
            total = (total if bound < 1 << 62 else total.astype(object)) + exact_gram(z)
        yield pa.RecordBatch.from_pydict({"i": [*range(d)], "s": [[str(s) for s in total[i, i:]] for i in range(d)]},
                                         pa.schema([("i", pa.int64()), ("s", pa.list_(pa.string()))]))

    parts = rows.select("v").mapInArrow(run, "i long, s array<string>").select("i", F.posexplode("s").alias("j", "s"))
    sums = parts.groupBy("i", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).cast("string").alias("s"))
    lines = sums.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "s"))), lambda c: c["s"]).alias("s"))
    by = {r["i"]: [int(s) for s in r["s"]] for r in lines.collect()}
    return [by.get(i, [0] * (d - i)) for i in range(d)]


def fit(rows: DataFrame, k: int, scale: int, offset: int) -> Whitening:
    """The whitening of rows (id, v) by their own covariance."""
    d = rows.agg(F.max(F.size("v"))).first()[0] or 0
    n, sums = _sums(rows, d, scale, offset)
    model = Whitening(n, sums, np.zeros((0, d)), np.zeros(0), 0.0, scale, offset)
    if not n or not d:
        return model
    upper = _scatter(rows, d, scale, offset, model.centre)
    left = [s - n * int(c) for s, c in zip(sums, model.centre, strict=True)]
    v = np.zeros((d, d))
    for i, line in enumerate(upper):
        for j, total in enumerate(line, i):
            v[i, j] = v[j, i] = (n * total - left[i] * left[j]) / (n * n)  # integers: rounded once
    model.trace = math.fsum(v.diagonal())
    values, vectors = one_sided_jacobi(pivoted_cholesky(v))
    model.eigenvalues, model.components = values[:k], vectors[:k]
    return model


def transform(rows: DataFrame, model: Whitening) -> DataFrame:
    """id, deviation, whitened (one number per component)."""
    d, k, n = len(model.sums), len(model.eigenvalues), model.n
    kind = dict(rows.dtypes)["id"]
    if not n:
        return rows.select("id", F.lit(0).cast("long").alias("deviation"), F.array().cast("array<double>").alias("whitened")).limit(0)
    centre, scale, offset = model.centre, model.scale, model.offset
    left = [s - n * int(c) for s, c in zip(model.sums, centre, strict=True)]
    turn = (model.components / np.sqrt(model.eigenvalues)[:, None]).T
    fraction = np.array([t / n for t in left])

    def run(batches):
        for b in batches:
            z = integers(b.column(1), d, scale, offset) - centre
            most = int(np.abs(z).max(initial=0)) * n + max(map(abs, left), default=0)
            whole = z * n - np.array(left, np.int64) if most * most * max(d, 1) < 1 << 63 else z.astype(object) * n - np.array(left, object)
            deviation = [int(t) if t < 1 << 63 else None for t in (whole * whole).sum(1)]
            w = ((z - fraction) @ turn).reshape(-1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * k, pa.int32()), pa.array(w))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(deviation, pa.int64()), lists], names=["id", "deviation", "whitened"])

    return rows.select("id", "v").mapInArrow(run, f"id {kind}, deviation long, whitened array<double>")


def identity_error(whitened: DataFrame, k: int) -> float | None:
    """Largest absolute entry of the covariance of ``whitened`` minus the identity, measured on the rows.

    Tasks centre their rows on their own means; the parts are then moved to the common mean.
    """
    if not k:
        return None

    def run(batches):
        n, mean, scatter = 0, np.zeros(k), np.zeros((k, k))
        for b in batches:
            w = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            if not len(w):
                continue
            own = w.mean(0)
            off, more, c = own - mean, len(w), w - own
            scatter += c.T @ c + np.outer(off, off) * (n * more / (n + more))
            mean, n = mean + off * (more / (n + more)), n + more
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "mean": [mean.tolist()], "scatter": [scatter.reshape(-1).tolist()]})

    parts = keep(whitened.select("whitened").mapInArrow(run, "n long, mean array<double>, scatter array<double>"), "covariances")
    n = parts.agg(F.sum("n")).first()[0]
    means = parts.select("n", F.posexplode("mean").alias("i", "m")).groupBy("i").agg((F.sum(F.col("n") * F.col("m")) / n).alias("m"))
    m = F.array(*[F.lit(r["m"]) for r in sorted(means.collect(), key=lambda r: r["i"])])
    i, j = F.floor(F.col("at") / k).cast("int"), F.pmod("at", F.lit(k))
    off = [F.get("mean", x) - F.get(m, x) for x in (i, j)]
    moved = parts.select("n", "mean", F.posexplode("scatter").alias("at", "s")).groupBy("at").agg(
        (F.sum(F.col("s") + F.col("n") * off[0] * off[1]) / n).alias("c"))
    error = moved.agg(F.max(F.abs(F.col("c") - F.when(F.col("at") % (k + 1) == 0, 1.0).otherwise(0.0)))).first()[0]
    drop_kept(parts)
    return error


def whiten(embeddings: DataFrame, k: int = 32, scale: int = 64, offset: int = 1_000_000, id_col: str = "vec_id",
           vec_col: str = "embedding") -> tuple[Whitening, DataFrame]:
    """The whitening fitted on all usable rows, and those rows as (id, deviation, whitened)."""
    rows = fit_rows(embeddings, id_col, vec_col, scale)
    model = fit(rows, k, scale, offset)
    return model, transform(rows, model)


def component_rows(model: Whitening, whitened: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """One row per vector and component, with what the fit says of the component."""
    k = len(model.eigenvalues)
    error = identity_error(whitened, k)
    share = F.array(*[F.lit(e) for e in model.explained]).cast("array<double>")
    long = whitened.select(F.col("id").alias(id_col), "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return long.select(id_col, (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
                       "whitened", F.get(share, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
