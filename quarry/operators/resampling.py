"""Stratified bootstrap of fixed size: in each iteration a stratum of n rows is drawn from n times, with replacement.

No row is copied. Rows have places in their stratum, LEAF of them are a leaf, and the n draws of every iteration are split over a tree of
leaves: a node's draws go to its left half by a binomial of the half's share of rows. Each node has its own random
stream, named by seed, stratum and node, so any task that needs a node draws the same numbers, and a lost task draws
them again. A leaf draws its rows uniformly. Tasks add up their leaves and send a row for each iteration and stratum.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.sources import shared

ITERATIONS, SEED, LEAF = 2000, 7, 1024
#: Draws that a task makes at once.
BLOCK_DRAWS = 1 << 20

_SUMS = "stratum string, iteration int, drawn long, total double"


def _stream(seed: int, stratum: int, first: int, last: int, leaf: bool) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(key=[(seed & 0x7FFFFFFF) << 33 | int(leaf) << 32 | stratum, (first << 32) | (last - first)]))


class _Tree:
    """How many draws of each iteration a leaf of a stratum gets. Nodes above the last leaf asked for are remembered."""

    def __init__(self, seed: int, stratum: str | None, rows: int, iterations: int, width: int, block: int):
        self.seed, self.rows, self.width, self.block, self.key = seed, rows, width, block, zlib.crc32(repr(stratum).encode())
        self.path = [(0, -(-rows // width), np.full(iterations, rows, dtype=np.int64))]

    def _size(self, first: int, last: int) -> int:
        return min(last * self.width, self.rows) - first * self.width

    def draws(self, leaf: int) -> np.ndarray:
        while not self.path[-1][0] <= leaf < self.path[-1][1]:
            self.path.pop()
        while (node := self.path[-1])[1] - node[0] > 1:
            first, last, n = node
            middle = (first + last) // 2
            left = _stream(self.seed, self.key, first, last, False).binomial(n, self._size(first, middle) / self._size(first, last))
            self.path.append((first, middle, left) if leaf < middle else (middle, last, n - left))
        return self.path[-1][2]

    def counts(self, leaf: int):
        """(first iteration, how often each of the leaf's rows is drawn in these iterations) in blocks."""
        n, size = self.draws(leaf), self._size(leaf, leaf + 1)
        rng, i = _stream(self.seed, self.key, leaf, leaf + 1, True), 0
        while i < len(n):
            j = max(i + 1, i + int(np.searchsorted(np.cumsum(n[i:]), self.block)))
            own = np.repeat(np.arange(j - i), n[i:j])
            yield i, np.bincount(own * size + rng.integers(0, size, len(own)), minlength=(j - i) * size).reshape(j - i, size)
            i = j


def bootstrap_sums(pairs: DataFrame, iterations: int = ITERATIONS, seed: int = SEED) -> DataFrame:
    """stratum, iteration, drawn, total: how many rows were drawn (the stratum's size) and what their x - y sum to. pairs:
    stratum, id (distinct), x, y; a null difference counts as 0."""
    rows = pairs.select(F.col("stratum").cast("string").alias("stratum"), F.struct(F.coalesce(F.col("stratum").cast("string"), F.lit("")).alias("s"), F.col("stratum").isNull().alias("n"), F.col("id").alias("i")).alias("at"),
                        F.coalesce((F.col("x") - F.col("y")).cast("double"), F.lit(0.0)).alias("d"), F.lit(1).cast("long").alias("one"))
    placed = shared.stored(shared.prefix_sums(rows, "at", "one", "place").select("stratum", "place", "d"), "bootstrap-rows")
    strata = placed.groupBy("stratum").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("size")).withColumnRenamed("stratum", "s")
    width, block = LEAF, BLOCK_DRAWS
    leaves = placed.join(strata, F.col("stratum").eqNullSafe(F.col("s"))).select(
        "stratum", "size", F.expr(f"(place - first) div {width}").alias("leaf"), F.expr(f"cast((place - first) % {width} as int)").alias("nth"), "d")

    def run(tables):
        sums: dict = {}
        tree, held = None, None

        def finish(key, values):
            nonlocal tree
            stratum, size, leaf = key
            if tree is None or tree[0] != stratum:
                tree = (stratum, _Tree(seed, stratum, size, iterations, width, block))
            drawn, total = sums.setdefault(stratum, (np.zeros(iterations, dtype=np.int64), np.zeros(iterations)))
            for i, counts in tree[1].counts(leaf):
                drawn[i : i + len(counts)] += counts.sum(axis=1)
                total[i : i + len(counts)] += counts @ values

        for t in tables:
            stratum, size, leaf, d = (t.column(c) for c in ("stratum", "size", "leaf", "d"))
            number, values = leaf.to_numpy(), d.to_numpy()
            names = stratum.to_pylist()
            edges = [0, *(i for i in range(1, len(names)) if number[i] != number[i - 1] or names[i] != names[i - 1]), len(names)]
            for a, b in zip(edges[:-1], edges[1:]):
                if b == a:
                    continue
                key = (names[a], int(size[a].as_py()), int(number[a]))
                if held is not None and held[0] == key:
                    held = (key, np.concatenate([held[1], values[a:b]]))
                    continue
                if held is not None:
                    finish(*held)
                held = (key, values[a:b])
        if held is not None:
            finish(*held)
        for stratum, (drawn, total) in sums.items():
            yield pa.record_batch([pa.array([stratum] * iterations, pa.string()), pa.array(np.arange(iterations, dtype=np.int32)), pa.array(drawn), pa.array(total)], ["stratum", "iteration", "drawn", "total"])

    parts = leaves.repartition("stratum", "leaf").sortWithinPartitions("stratum", "leaf", "nth").select("stratum", "size", "leaf", "d").mapInArrow(run, _SUMS)
    return parts.groupBy("stratum", "iteration").agg(F.sum("drawn").alias("drawn"), F.sum("total").alias("total"))


def bootstrap_interval(pairs: DataFrame, iterations: int = ITERATIONS, seed: int = SEED) -> DataFrame:
    """lower and upper: the 2.5 and 97.5 percentiles of the resampled means of x - y, by linear interpolation; without rows 0
    and 0 of no iterations."""
    means = bootstrap_sums(pairs, iterations, seed).groupBy("iteration").agg((F.sum("total") / F.sum("drawn")).alias("mean"))
    at = lambda p: F.coalesce(F.percentile("mean", F.lit(p)), F.lit(0.0))
    return means.agg(at(0.025).alias("lower"), at(0.975).alias("upper"), F.count(F.lit(1)).alias("iterations"))
