"""An inverted file of vectors: cells of k-means, exact scores inside the cells that a query probes, filters before scores.

Cells are fitted by Spark's k-means on a bounded sample (SAMPLE rows, those of the smallest hash of their id), and the number
of cells to probe is the least that finds the wanted share of the true neighbours in that sample. Every usable row is in the index.
A query's scores are exact inside the cells it probes. ``exact=True`` probes a second time: all cells that can hold
something better than the k-th best so far, as for any x in a cell of centre c and radius r, q.x <= q.c + |q| r.

Rows are read where they lie and never shuffled; a task sends at most k rows a query. Queries are held by the tasks in
blocks of bounded size, more blocks make more passes. A cell may hold any number of rows: rows of a cell are spread over files.

Null or empty vectors, vectors with null or non-finite entries or of another length than most are left out. A query without
a usable vector finds nothing. Scores are rounded to six decimals, ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.sources import shared

#: Rows that k-means and the number of probes are fitted on, queries among them that measure recall, bytes of queries held at once.
SAMPLE, TRIALS, HELD_BYTES = 20_000, 200, 1 << 23
DIGITS, SLACK = 6, 1e-6
#: Scores that a task makes at once, and candidates that it gathers beside the best of its queries.
BLOCK_SCORES, GATHERED = 1 << 20, 1 << 18


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(fine, F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


class VectorIndex:
    """Vectors (id_col, vector_col) with the columns to filter by (keep), stored by cells in the shared folder."""

    def __init__(self, vectors: DataFrame, id_col: str = "doc_id", vector_col: str = "embedding", keep: tuple[str, ...] = (), cells: int | None = None,
                 recall: float = 0.95, k: int = 10, seed: int = 17):
        rows = vectors.select(F.col(id_col).alias("doc_id"), F.col(vector_col).alias("v"), *keep).filter(usable(F.col("v")))
        size = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
        self.dim, self.n, self.keep = (size["dim"], size["n"], keep) if size else (0, 0, keep)
        self.id_type = dict(rows.dtypes)["doc_id"]
        self.spark = vectors.sparkSession
        if not self.n:
            return
        rows = rows.filter(F.size("v") == self.dim)
        # One file: a bounded sample.
        sample = shared.stored(rows.select("doc_id", "v").orderBy(F.xxhash64("doc_id")).limit(SAMPLE).coalesce(1), "vector-sample")
        count = cells or max(1, min(int(self.n**0.5), min(self.n, SAMPLE) // 20))
        model = KMeans(k=count, initMode="random", maxIter=10, seed=seed).fit(sample.select(array_to_vector(F.col("v").cast("array<double>")).alias("features"))) if count > 1 else None
        held = _matrix(sample.select("v").toArrow().column(0).combine_chunks(), self.dim)
        self.centres = np.array(model.clusterCenters()) if model else held.mean(axis=0, keepdims=True)
        self.probes = self._probes(held, recall, k)
        centres, dim = self.centres, self.dim
        names = ["doc_id", "v", *keep]
        schema = ", ".join(f"`{c}` {t}" for c, t in rows.select(*names).dtypes) + ", cell int, away double"

        def placed(tables):
            for t in tables:
                for i in range(0, t.num_rows, max(1, BLOCK_SCORES // len(centres))):
                    part = t.slice(i, max(1, BLOCK_SCORES // len(centres)))
                    x = _matrix(part.column(1), dim)
                    cell = _nearest(x, centres)
                    yield pa.record_batch([*part.columns, pa.array(cell.astype(np.int32)), pa.array(np.linalg.norm(x - centres[cell], axis=1))], [*names, "cell", "away"])

        made = rows.select(*names).mapInArrow(placed, schema)
        self.rows = shared.stored(made.repartitionByRange("cell", F.xxhash64("doc_id")).sortWithinPartitions("cell"), "vector-cells")
        self.radius = np.zeros(len(centres))
        for cell, away in self.rows.groupBy("cell").agg(F.max("away")).collect():  # a row for each cell
            self.radius[cell] = away

    def _probes(self, held: np.ndarray, recall: float, k: int) -> int:
        """The least number of cells by which sampled queries find that share of their neighbours in the sample."""
        cell, asked = _nearest(held, self.centres), held[:: max(1, len(held) // TRIALS)]
        places = np.argsort(np.argsort(-(asked @ self.centres.T), axis=1), axis=1)
        best = np.argpartition(-(asked @ held.T), min(k, len(held)) - 1, axis=1)[:, :k]
        needed = np.sort(np.take_along_axis(places, cell[best], axis=1).ravel()) + 1
        return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None, exact: bool = False, match: tuple[str, ...] = (), within: tuple[str, str, str] | None = None) -> DataFrame:
        """query_id, doc_id, score, rank of queries (query_id, query). match: columns in which a row must equal its query (null
        asks for nothing); within: a column, and the queries' columns that bound it, both included (null is no bound)."""
        rows = None
        size = max(1, HELD_BYTES // (8 * max(1, self.dim)))
        passes = max(1, -(-queries.count() // size)) if self.n else 0
        for p in range(passes):
            part = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == p) if passes > 1 else queries
            block = _Block(self, part, k, match, within)
            found = block.found(block.first(probes or self.probes))
            if exact:
                found = shared.stored(found, "vector-first")
                place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))
                least = found.withColumn("place", place).filter(F.col("place") == k).select("query", "score").collect()  # a row a query
                found = found.unionByName(block.found(block.rest(probes or self.probes, dict(least))))
            order = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
            found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            found = block.named(found)
            rows = found if rows is None else rows.unionByName(found)
        if rows is None:
            kind = dict(queries.dtypes)["query_id"]
            return self.spark.createDataFrame([], f"query_id {kind}, doc_id {self.id_type}, score double, rank int")
        return rows


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x @ centres.T - 0.5 * (centres * centres).sum(axis=1)).argmax(axis=1)


class _Block:
    """Queries that tasks hold at once, numbered."""

    def __init__(self, index: VectorIndex, queries: DataFrame, k: int, match: tuple, within: tuple | None):
        self.index, self.k, self.match, self.within = index, k, match, within
        bounds = list(within[1:]) if within else []
        good = usable(F.col("query")) & (F.size("query") == index.dim)
        table = queries.filter(good).select("query_id", "query", *match, *bounds).toArrow().combine_chunks()
        self.ids = table.column("query_id").combine_chunks()
        self.q = _matrix(table.column("query").combine_chunks(), index.dim)
        self.length = np.linalg.norm(self.q, axis=1)
        self.sets = {c: table.column(c).combine_chunks() for c in match}
        self.low, self.high = (table.column(c).combine_chunks() for c in bounds) if within else (None, None)

    def first(self, probes: int) -> np.ndarray:
        """Whether a query probes a cell."""
        near = self.q @ self.index.centres.T
        out = np.zeros(near.shape, dtype=bool)
        best = np.argsort(-near, axis=1, kind="stable")[:, :probes]
        out[np.arange(len(near))[:, None], best] = True
        return out

    def rest(self, probes: int, least: dict[int, float]) -> np.ndarray:
        """Whether a cell that a query hasn't probed can hold something better than its least score."""
        near = self.q @ self.index.centres.T
        limit = np.array([least.get(i, -np.inf) for i in range(len(near))])
        return (near + self.length[:, None] * self.index.radius >= limit[:, None] - SLACK) & ~self.first(probes)

    def named(self, found: DataFrame) -> DataFrame:
        spark = self.index.spark
        kind = pa.table({"query": pa.array(np.arange(len(self.ids), dtype=np.int32)), "query_id": self.ids})
        return found.join(F.broadcast(spark.createDataFrame(kind)), "query").select("query_id", "doc_id", "score", "rank")  # HELD_BYTES bound it

    def found(self, asked: np.ndarray) -> DataFrame:
        """query (its number), doc_id, score: a task's best of the cells that are asked for."""
        index, k, dim, q, match, within = self.index, self.k, self.index.dim, self.q, self.match, self.within
        columns = ["doc_id", "v", "cell", *match, *([within[0]] if within else [])]
        cells = [int(c) for c in np.flatnonzero(asked.any(axis=0))]
        sets, low, high = {c: pc.unique(v.drop_null()) for c, v in self.sets.items()}, self.low, self.high
        codes = {c: np.where(v.is_null().to_numpy(zero_copy_only=False), -2, pc.fill_null(pc.index_in(v, sets[c]), -2).to_numpy(zero_copy_only=False)) for c, v in self.sets.items()}
        if within:
            low, high = (_numbers(x, d) for x, d in ((low, -np.inf), (high, np.inf)))
        held = index.spark.sparkContext.broadcast((asked, q, sets, codes, low, high))

        def run(tables):
            asked, q, sets, codes, low, high = held.value
            best = _Best(len(q), k)
            for t in tables:
                doc_type = t.column(0).type
                cell = t.column(2).to_numpy()
                x = _matrix(t.column(1), dim)
                own = {c: pc.fill_null(pc.index_in(t.column(3 + i), sets[c]), -1).to_numpy(zero_copy_only=False) for i, c in enumerate(match)}
                at = _numbers(t.column(len(columns) - 1), np.nan) if within else None
                for c in np.unique(cell).tolist():
                    who, here = np.flatnonzero(asked[:, c]), np.flatnonzero(cell == c)
                    step = max(1, BLOCK_SCORES // max(1, len(who)))
                    for i in range(0, len(here) if len(who) else 0, step):
                        rows = here[i : i + step]
                        score = np.round(q[who] @ x[rows].T, DIGITS)
                        fits = score >= best.least[who][:, None]
                        for name in match:
                            want = codes[name][who][:, None]
                            fits &= (want == -2) | (want == own[name][rows])
                        if within:
                            # An unknown value fits where nothing is asked of it.
                            free = ((low[who] == -np.inf) & (high[who] == np.inf))[:, None]
                            fits &= free | ((at[rows] >= low[who][:, None]) & (at[rows] <= high[who][:, None]))
                        a, b = np.nonzero(fits)
                        best.add(who[a], t.column(0).take(pa.array(rows[b])), score[a, b])
            number, ids, score = best.taken()
            if ids is not None:
                yield pa.record_batch([pa.array(number.astype(np.int32)), ids.cast(doc_type), pa.array(score)], ["query", "doc_id", "score"])

        rows = index.rows.filter(F.col("cell").isin(cells)) if len(cells) < len(index.centres) else index.rows
        return rows.select(*columns).mapInArrow(run, f"query int, doc_id {index.id_type}, score double")


def _numbers(column: pa.Array, none: float) -> np.ndarray:
    """A column that can be put in order (numbers, dates, times) as doubles."""
    if pa.types.is_date32(column.type):
        column = column.cast(pa.int32())
    elif pa.types.is_timestamp(column.type):
        column = column.cast(pa.int64())
    return pc.fill_null(column.cast(pa.float64()), none).to_numpy(zero_copy_only=False)


class _Best:
    """The best k of each query so far: candidates are gathered and cut down when there are many."""

    def __init__(self, queries: int, k: int):
        self.k, self.least = k, np.full(queries, -np.inf)
        self.most = max(GATHERED, 2 * k * queries)
        self.parts, self.size = [], 0

    def add(self, query: np.ndarray, ids: pa.Array, score: np.ndarray) -> None:
        if len(query):
            self.parts.append((query, ids, score))
            self.size += len(query)
            if self.size > self.most:
                self._cut()

    def _cut(self) -> None:
        query, score = (np.concatenate([p[i] for p in self.parts]) for i in (0, 2))
        ids = pa.concat_arrays([p[1] for p in self.parts])
        rank = np.empty(len(ids), dtype=np.int64)
        rank[pc.sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
        order = np.lexsort((rank, -score, query))
        query, score = query[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        full, kept = place == self.k - 1, place < self.k
        self.least[query[full]] = score[full]
        self.parts, self.size = [(query[kept], ids.take(pa.array(order[kept])), score[kept])], int(kept.sum())

    def taken(self):
        if not self.parts:
            return None, None, None
        self._cut()
        return self.parts[0]
