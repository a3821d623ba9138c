"""Embedding whitening from a scatter matrix that is exact.

Entries become integers, x = floor(scale * c) + shift. The scatter of the distinct x vectors, each with a leading 1, holds
their number, sums and products. Every partition multiplies residues modulo several primes below 2**20: products of
centred residues of 4096 rows stay below 2**51, so doubles and BLAS give them exactly. Residues of the partitions are
added by Spark, cell by cell, and Chinese remaindering gives the integers; so many primes are taken that their product is
above twice the largest cell there can be. Covariances are exact fractions, rounded once, and go through a double eigh.

Bounds: the driver and every task hold d * d numbers and no more, d being the vectors' length; a partition sends
primes * (d + 1) * (d + 2) / 2 cells, which are added up before they are shuffled. Equal vectors meet in a distinct, which combines
them before the shuffle, so a vector that many rows share costs a row for each task.

Edge cases: rows are dropped whose vector is null or empty, holds null or non-finite entries, holds an entry beyond
2**61 / scale (which is no long), or is not of the length that most rows have (the larger of two). Components whose
eigenvalue is not above the rounding error of the largest are left out, as they can't be scaled: one distinct vector has
none, so it has no rows. Repeated rows, null ids and ties are rows like others; tied eigenvalues have any basis, the
same for all rows. An empty table gives an empty result; extra columns are ignored. There are no texts.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean

COMPONENTS, SCALE, SHIFT = 16, 64, 1_000_000
#: Rows of one exact product: rows * (prime / 2) ** 2 < 2 ** 53.
BLOCK_ROWS = 4096
PRIMES_BELOW = 1 << 20

_OUT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def primes_for(bound: int) -> list[int]:
    """The largest primes below 2**20 whose product is above twice the bound."""
    sieve = np.ones(PRIMES_BELOW, dtype=bool)
    sieve[:2] = False
    for i in range(2, 1 << 10):
        if sieve[i]:
            sieve[i * i :: i] = False
    out, product = [], 1
    for p in np.flatnonzero(sieve)[::-1].tolist():
        if product > 2 * bound:
            break
        out.append(p)
        product *= p
    return out


def reconstruct(residues: dict[int, np.ndarray]) -> np.ndarray:
    """The integers, positive or negative, that have these residues: Garner's mixed radix, all cells at once."""
    value, product = None, 1
    for p, r in residues.items():
        r = r.astype(object)
        value = r if value is None else value + product * (((r - value) * pow(product, -1, p)) % p)
        product *= p
    return np.where(value > product // 2, value - product, value)


def integers(vector: Column, scale: int = SCALE, shift: int = SHIFT) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))) + F.lit(shift).cast("long"))


def usable(vector: Column, scale: int = SCALE) -> Column:
    """Whether every entry becomes a long. False for null and empty vectors. A NaN is above every number."""
    inside = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(float((1 << 61) // scale))))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(inside, F.lit(False))


def _matrix(column: pa.Array, d: int, dtype) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(-1, d)


def scatter(fit: DataFrame, column: str, d: int, primes: list[int]) -> np.ndarray:
    """Exact sums of products of the rows' integers with a leading 1: (d + 1) x (d + 1) Python integers."""
    upper = np.triu_indices(d + 1)

    def run(tables):
        sums = np.zeros((len(primes), d + 1, d + 1), dtype=np.int64)
        for t in tables:
            rows = _matrix(t.column(0), d, np.int64)
            for i in range(0, len(rows), BLOCK_ROWS):
                block = rows[i : i + BLOCK_ROWS]
                for k, p in enumerate(primes):
                    r = np.ones((len(block), d + 1))
                    r[:, 1:] = np.mod(block, p)
                    r[r > p // 2] -= p
                    sums[k] = (sums[k] + (r.T @ r).astype(np.int64)) % p
        for k in range(len(primes)):
            yield pa.record_batch([pa.array(np.full(len(upper[0]), k, dtype=np.int32)), pa.array(np.arange(len(upper[0]))), pa.array(sums[k][upper])], ["k", "cell", "r"])

    parts = fit.select(column).mapInArrow(lean(run), "k int, cell long, r long")
    # A residue is below 2**20: a long holds the sum over 2**43 partitions.
    cells = parts.groupBy("k", "cell").agg(F.sum("r").alias("r")).toArrow()
    k, cell, r = (c.to_numpy() for c in cells.columns)
    residues = np.zeros((len(primes), len(upper[0])), dtype=np.int64)
    residues[k, cell] = r % np.array(primes)[k]
    out = np.zeros((d + 1, d + 1), dtype=object)
    out[upper] = reconstruct(dict(zip(primes, residues)))
    out.T[upper] = out[upper]
    return out


class Whitener:
    """What the fit list tells: n, sums, covariance, eigenvectors. ``apply`` whitens any rows with it."""

    def __init__(self, vectors: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT):
        self.vector_col, self.scale, self.shift = vector_col, scale, shift
        x = vectors.select(F.col(vector_col).alias("v")).filter(usable(F.col("v"), scale)).select(integers(F.col("v"), scale, shift).alias("x"))
        sizes = x.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("rows"), F.max(F.array_max(F.transform("x", F.abs))).alias("most"))
        best = sizes.orderBy(F.desc("rows"), F.desc("d")).first()
        self.d = best["d"] if best else 0
        self.n, self.count = 0, 0
        if not best:
            return
        fit = x.filter(F.size("x") == self.d).distinct()
        full = scatter(fit, "x", self.d, primes_for(best["rows"] * max(1, best["most"]) ** 2))
        self.n, self.sums = int(full[0, 0]), [int(s) for s in full[0, 1:]]
        n, s = self.n, np.array(self.sums, dtype=object)
        centred = full[1:, 1:] * n - np.outer(s, s)
        # Python divides integers with one rounding.
        self.covariance = np.array([int(c) / (n * n) for c in centred.ravel()]).reshape(self.d, self.d)
        values, columns = np.linalg.eigh(self.covariance)
        order = np.argsort(-values, kind="stable")[:components]
        order = order[values[order] > max(values[-1], 0.0) * self.d * np.finfo(np.float64).eps]
        self.trace = sum(int(c) for c in np.diag(centred)) / (n * n)
        self.values, self.axes = values[order], columns[:, order]
        self.count = len(order)
        scaled = self.axes / np.sqrt(self.values)
        self.scaled = scaled
        self.identity_error = float(np.abs(scaled.T @ self.covariance @ scaled - np.eye(self.count)).max()) if self.count else 0.0

    def apply(self, vectors: DataFrame, id_col: str = "vec_id") -> DataFrame:
        """A row for each usable row and component."""
        spark = vectors.sparkSession
        if not self.count:
            return spark.createDataFrame([], _OUT)
        n, d, k = self.n, self.d, self.count
        # n * x - S is n * u - r, with x = m + u for whole means m, and remainders r below n.
        means, rest = zip(*(divmod(s, n) for s in self.sums))
        fixed = sum(r * r for r in rest)
        scale, shift, scaled, shares = self.scale, self.shift, self.scaled, self.values / self.trace
        error = self.identity_error
        m, r = np.array(means, dtype=np.int64), np.array(rest, dtype=np.int64)

        def run(tables):
            for t in tables:
                for i in range(0, t.num_rows, BLOCK_ROWS):
                    part = t.slice(i, BLOCK_ROWS)
                    c = _matrix(part.column(1), d, np.float64)
                    u = np.floor(c * scale).astype(np.int64) + (shift - m)
                    most = max(1, abs(int(u.max())), abs(int(u.min())))
                    wide = d * most * max(most, n) >= 1 << 63
                    v, q = (u.astype(object), r.astype(object)) if wide else (u, r)
                    squares, crossed = (v * v).sum(axis=1), v @ q
                    if wide or n * n * d * most * most + 2 * n * d * most * n + fixed >= 1 << 63:
                        squares, crossed = squares.astype(object), crossed.astype(object)
                    exact = n * n * squares - 2 * n * crossed + fixed
                    kept = [Decimal(int(e)) if int(e) < 10**38 else None for e in exact]
                    white = (u - r / n) @ scaled
                    rows = len(u)
                    yield pa.record_batch([
                        part.column(0).take(pa.array(np.repeat(np.arange(rows), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                        pa.array(np.full(rows * k, n, dtype=np.int64)), pa.array(kept, pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(rows), k))),
                        pa.array(white.ravel()), pa.array(np.tile(shares, rows)), pa.array(np.full(rows * k, error))],
                        ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

        rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(self.vector_col).alias("v"))
        return rows.filter(usable(F.col("v"), scale) & (F.size("v") == d)).mapInArrow(lean(run), _OUT)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """Rows whitened by their own fit list. deviation is exact up to 38 digits, null beyond."""
    return Whitener(vectors, vector_col, components, scale, shift).apply(vectors, id_col)
