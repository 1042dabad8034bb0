"""Whitening of embeddings by their leading components, found with FEAST (operator 13).

Vectors become integers x = floor(scale * c) + shift.  One job sums them by
dimension, a second multiplies x less the rounded mean, in integers; the rest of
the mean, at most one half, is taken off in exact arithmetic on the d x d sums,
so the covariance is exact up to its last rounding.  Each task sends d and
d(d+1)/2 sums, whatever its rows, and Spark adds them by position.

Components come from the covariance V (d x d, the one thing the driver works
on).  ``inertia`` counts the eigenvalues above a number from the signs of an
LDL' factorisation.  Bisection on that count finds intervals that together hold
the k largest eigenvalues, few in each.  For an interval, contour integration
projects a block of vectors onto its eigenspace: at the nodes z of a
Gauss-Legendre rule on the circle through its ends, the systems (zI - V)Y = Q
are solved and summed.  Rayleigh-Ritz turns the projected block into eigenpairs,
and both are repeated until the residuals are at rounding level.  An interval
that yields another number of eigenvalues than its inertia counts is refused.

A last pass projects each centred vector and divides by the root of the
eigenvalue; the covariance of what it wrote is compared with the identity.

Edge cases: vectors that are null, or hold a null, non-finite or (as double,
scaled) not exactly representable component, are dropped; of vectors of several
lengths those of the most common one remain (ties: the longer); repeated rows
count each time, a row without id is a row; fewer dimensions than components
give fewer; components without variance (e at most d * 2^-52 of the largest) are
not whitened and give no rows; a deviation beyond a long is null; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DecimalType, DoubleType, IntegerType, LongType, StructType

SCALE, SHIFT = 1024, 100_000
#: Nodes of the quadrature on the half circle, eigenvalues asked of one interval at most, and rounds.
NODES, PER_INTERVAL, ROUNDS = 8, 8, 40


# ------------------------------------------------------------- vectors and moments
def quantised(vectors: DataFrame, embedding: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """The rows whose vectors remain, with ``x``: their integers."""
    e = F.col(embedding)
    bound = float(1 << 52)
    fits = F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * scale) < bound))
    rows = vectors.where(e.isNotNull() & F.coalesce(fits, F.lit(False)) & (F.size(e) > 0))
    lengths = rows.groupBy(F.size(embedding).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return rows.where(F.lit(False)).withColumn("x", F.array().cast("array<bigint>"))
    return (rows.where(F.size(embedding) == lengths["d"])
            .withColumn("x", F.transform(e, lambda c: F.floor(c.cast("double") * F.lit(float(scale))) + F.lit(shift).cast("long"))))


def _matrix(column, d: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, d)


def _add_up(rows: DataFrame, partial) -> dict[int, int]:
    """Sums by position of what ``partial`` (matrix -> integers by position) gives for the rows; exact."""
    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                part = partial(_matrix(batch["x"], len(batch["x"][0])))
                total = part if total is None else [a + b for a, b in zip(total, part)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total, pa.decimal128(38, 0))], names=["at", "sum"])

    sums = rows.select("x").mapInArrow(run, StructType().add("at", IntegerType()).add("sum", DecimalType(38, 0)))
    return {r["at"]: int(r["total"]) for r in sums.groupBy("at").agg(F.sum("sum").alias("total")).collect()}  # d or d(d+1)/2 rows


@dataclass
class Moments:
    """Count, sums by dimension, and the covariance, exactly rounded."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    trace: float


def _products(x: np.ndarray, centre: np.ndarray) -> list[int]:
    y = x - centre
    top = int(np.abs(y).max(initial=0))
    kind = np.int64 if top * top * len(y) < 1 << 63 else object
    if top * top * len(y) < 1 << 53:
        g = y.astype(np.float64)
        g = (g.T @ g).astype(np.int64)  # every partial sum is an exact double
    else:
        g = y.astype(kind).T @ y.astype(kind)
    return [int(v) for v in g[np.triu_indices(x.shape[1])]]


def moments(rows: DataFrame) -> Moments | None:
    """The moments of all ``x`` of ``rows`` (None for no rows)."""
    first = _add_up(rows, lambda x: [len(x), *(int(v) for v in (x.sum(0) if np.abs(x).max(initial=0) < (1 << 62) // max(1, len(x)) else x.astype(object).sum(0)))])
    if not first:
        return None
    n, sums = first[0], [first[i + 1] for i in range(len(first) - 1)]
    d = len(sums)
    centre = [round(Fraction(s, n)) for s in sums]
    middle = np.array(centre, np.int64)
    products = _add_up(rows, lambda x: _products(x, middle))
    rest = [s - n * c for s, c in zip(sums, centre)]
    v = np.zeros((d, d))
    exact = [Fraction(n * products[at] - rest[i] * rest[j], n * n) for at, (i, j) in enumerate(zip(*np.triu_indices(d)))]
    for (i, j), value in zip(zip(*np.triu_indices(d)), exact):
        v[i, j] = v[j, i] = float(value)
    return Moments(n, sums, v, float(sum(value for i, j, value in zip(*np.triu_indices(d), exact) if i == j)))


# ------------------------------------------------------------- FEAST
def inertia(v: np.ndarray, at: float) -> int:
    """How many eigenvalues of a symmetric matrix lie above ``at``: positive pivots of V - at I, by symmetric
    elimination with 1 x 1 and 2 x 2 pivots (a 2 x 2 one has one of each sign)."""
    m = v - at * np.eye(len(v))
    above = 0
    while len(m):
        diagonal, off = np.abs(np.diag(m)), np.abs(m - np.diag(np.diag(m)))
        i = int(np.argmax(diagonal))
        if diagonal[i] >= 0.64 * off.max(initial=0):
            above += m[i, i] > 0
            if m[i, i] == 0:
                return above  # nothing but zeros is left
            rest = np.delete(np.arange(len(m)), i)
            m = m[np.ix_(rest, rest)] - np.outer(m[rest, i], m[i, rest]) / m[i, i]
        else:
            i, j = np.unravel_index(int(np.argmax(off)), off.shape)
            above += 1
            rest = np.delete(np.arange(len(m)), [i, j])
            c = m[np.ix_(rest, [i, j])]
            m = m[np.ix_(rest, rest)] - c @ np.linalg.solve(m[np.ix_([i, j], [i, j])], c.T)
        m = (m + m.T) / 2
    return above


def intervals(v: np.ndarray, k: int) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues inside) from the largest on, holding the k largest or, where they cannot be told from the next, more."""
    radius = np.abs(v).sum(1).max(initial=0.0)
    if radius == 0:
        return []
    top = radius * (1 + 1e-9)
    floor = len(v) * np.finfo(float).eps * radius  # below it an eigenvalue is none
    k = min(k, inertia(v, floor))
    out, work = [], [(floor, top, inertia(v, floor), 0)]  # low, high, eigenvalues above each
    while work:
        low, high, above_low, above_high = work.pop()
        inside = above_low - above_high
        if inside == 0 or above_high >= k:
            continue
        middle = (low + high) / 2
        narrow = high - low <= 64 * floor
        # an interval is taken whole when it holds few and a gap to its neighbours can be seen
        if narrow or (inside <= PER_INTERVAL and above_low <= k and _clear(v, low, high, above_low)):
            out.append((low, high, inside))
            continue
        half = inertia(v, middle)
        work += [(low, middle, above_low, half), (middle, high, half, above_high)]
    return sorted(out, reverse=True)


def _clear(v: np.ndarray, low: float, high: float, above_low: int) -> bool:
    """Whether no eigenvalue lies just outside the lower end, in a tenth of the interval's width."""
    return inertia(v, low - (high - low) / 10) == above_low


def contour(v: np.ndarray, low: float, high: float, block: np.ndarray) -> np.ndarray:
    """``block`` projected onto the eigenspace of [low, high]: the sum over the nodes of a circle through its ends."""
    node, weight = np.polynomial.legendre.leggauss(NODES)
    centre, radius = (low + high) / 2, (high - low) / 2
    out = np.zeros_like(block)
    for t, w in zip(node, weight):  # the lower half circle gives the complex conjugates
        turn = np.exp(1j * math.pi * (t + 1) / 2)
        out += (w / 2) * np.real(radius * turn * np.linalg.solve((centre + radius * turn) * np.eye(len(v)) - v, block.astype(complex)))
    return out


def feast(v: np.ndarray, low: float, high: float, inside: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``inside`` eigenvalues of (low, high] and their unit vectors (columns), by falling eigenvalue."""
    d = len(v)
    size = min(d, max(inside + 4, 2 * inside))
    block = np.random.default_rng(d).standard_normal((d, size))
    best, found, scale = math.inf, None, np.abs(v).sum(1).max()
    for _ in range(ROUNDS):
        q, _ = np.linalg.qr(contour(v, low, high, block))
        ritz, turn = np.linalg.eigh(q.T @ v @ q)
        vectors = q @ turn
        mine = np.flatnonzero((ritz > low) & (ritz <= high))
        residual = np.linalg.norm(v @ vectors[:, mine] - vectors[:, mine] * ritz[mine], axis=0).max(initial=0) / scale
        if len(mine) == inside:
            if residual < best:
                found = ritz[mine][::-1], vectors[:, mine][:, ::-1]
            if residual >= best / 2 and best < 1e-10:  # no longer improving
                return found
            best = min(best, residual)
        block = vectors
    if found is None or best > 1e-10:
        raise ArithmeticError(f"{inside} eigenvalues lie in ({low}, {high}], {len(mine)} were found; residual {best}")
    return found


def components(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues (fewer if the rest are 0) and their unit vectors, as columns."""
    parts = [feast(v, *interval) for interval in intervals(v, k)]
    if not parts:
        return np.zeros(0), np.zeros((len(v), 0))
    e, u = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts], axis=1)
    if len(parts) > 1:  # vectors of neighbouring intervals are made orthogonal to the last digit
        u, r = np.linalg.qr(u)
        u = u * np.sign(np.diag(r))
    return e[:k], u[:, :k]


# ------------------------------------------------------------- whitening
@dataclass
class Whitener:
    """Maps integer vectors to whitened coordinates and exact deviations."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    vectors: np.ndarray

    def _centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, in integers."""
        top = max(int(np.abs(x).max(initial=0)) * self.n, *(abs(s) for s in self.sums)) * 2
        kind = np.int64 if top < 1 << 62 else object
        return x.astype(kind) * self.n - np.array(self.sums, kind)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (self._centred(x) / self.n).astype(float) @ (self.vectors / np.sqrt(self.eigenvalues))

    def deviation(self, x: np.ndarray) -> list:
        z = self._centred(x)
        top = int(np.abs(z).max(initial=0))
        if top * top * z.shape[1] >= 1 << 63:
            z = z.astype(object)
        return [int(s) if s < 1 << 63 else None for s in (z * z).sum(1)]


def fit(rows: DataFrame, k: int = 8) -> tuple[Whitener, Moments] | None:
    m = moments(rows)
    if m is None:
        return None
    e, u = components(m.covariance, k)
    return Whitener(m.n, m.sums, e, u), m


def transform(rows: DataFrame, model: Whitener) -> DataFrame:
    """``rows`` with ``whitened`` (array) and ``deviation``, replacing columns of these names."""
    rest = rows.drop("whitened", "deviation")
    d = len(model.sums)

    def run(batches):
        for batch in batches:
            x = _matrix(batch["x"], d)
            w = model.whitened(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(model.deviation(x), pa.int64())],
                                             names=[*batch.schema.names, "whitened", "deviation"])

    schema = StructType(list(rest.schema.fields)).add("whitened", ArrayType(DoubleType())).add("deviation", LongType())
    return rest.mapInArrow(run, schema)


def identity_error(whitened: DataFrame, k: int) -> float:
    """The largest entry of the covariance of a ``whitened`` column less the identity, in two passes."""
    if not k:
        return 0.0
    pos = whitened.select(F.posexplode("whitened").alias("i", "w"))
    mean = {r["i"]: r["m"] for r in pos.groupBy("i").agg(F.avg("w").alias("m")).collect()}
    centred = whitened.select(F.array(*[F.col("whitened")[i] - F.lit(mean[i]) for i in range(k)]).alias("w"))
    row = centred.agg(*[F.avg(F.col("w")[i] * F.col("w")[j]).alias(f"{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    return max(abs(row[f"{i}_{j}"] - (i == j)) for i in range(k) for j in range(i, k))


def op13_feast_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight whitened coordinates of every vector."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    rows = quantised(table).select("vec_id", "x")
    fitted = fit(rows)
    kind = table.schema["vec_id"].dataType.simpleString()
    if fitted is None:
        return spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    model, m = fitted
    out = transform(rows, model).drop("x")
    error = identity_error(out, len(model.eigenvalues))
    share = F.array(*[F.lit(float(e / m.trace)) for e in model.eigenvalues]).cast("array<double>")
    return (out.select("vec_id", "deviation", F.posexplode("whitened").alias("__i", "whitened"))
            .select("vec_id", (F.col("__i") + 1).alias("component"), F.lit(m.n).cast("long").alias("n"), "deviation", "whitened",
                    F.get(share, F.col("__i")).alias("explained"), F.lit(float(error)).alias("identity_error")))


QUERIES = {"op13_feast_whitening": (op13_feast_whitening, None)}
