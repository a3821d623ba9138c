"""Ranked text search (BM25) over an index of posting blocks, with upper bounds: the exact best k without a row for each
query term and document.

Documents lie in shards of bounded size. A shard holds, for each of its terms, the postings in blocks of falling impact
(128, 256, 512, ... postings, each in order of documents) and the largest impact of each block; impact is the
BM25 weight without the term's idf. A task walks through the shards it was dealt, with a threshold for each query: the
score of the k-th best document it has met. In a shard

1. terms are taken by falling bound (idf * largest impact). A document whose first term in this order stands in a block
   of impact m has at most idf * m plus the bounds of all later terms; from the block on where that lies below a share of
   the threshold, nothing is read, and of the later terms mostly nothing at all;
2. what was met is held against the threshold: its weights so far, plus for each term the largest impact that was not
   read. Most goes here;
3. what is left looks up the blocks that were not read, term by term, and goes as soon as it can't reach the threshold.

Tasks send at most k rows a query. Sums run in one order of terms, so scores don't depend on shards.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.sources import shared

K1, B = 1.2, 0.75
WORDS = "[a-z0-9]+"
#: A shard has at most so many documents, and texts of so many bytes or one text.
SHARD_DOCS, SHARD_BYTES = 16_384, 1 << 23
FIRST_BLOCK = 128
#: The share of the threshold from which documents are let in. Less lets more in and leaves less to look up.
LET_IN = 0.6
#: Scores are compared as rounded to six decimals.
DIGITS, SLACK = 6, 1e-6
#: Query terms that tasks hold at once; more queries run in several passes.
HELD_TERMS = 200_000

_INDEX = "shard long, term string, n int, most binary, docs binary, impacts binary"
_FOUND = "query_id {kind}, doc_id {doc}, score double, postings long, read long"

_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[[*range(48, 58), *range(97, 123)]] = True


def words(lowered: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The words of texts in lower case, end to end, and the offsets of each text's words."""
    raw = np.frombuffer(b"\n".join(lowered) + b"\n", dtype=np.uint8)
    inside = _IS_WORD[raw]
    starts = np.flatnonzero(inside & np.concatenate(([True], ~inside[:-1])))
    before = np.concatenate(([0], np.cumsum(inside)))
    places = np.concatenate((before[starts], before[-1:])).astype(np.int64)
    data = np.ascontiguousarray(raw[inside])
    edges = np.cumsum([0] + [len(t) + 1 for t in lowered])
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(data)]), np.searchsorted(starts, edges)


def block_edges(n: int) -> np.ndarray:
    """Where n postings are cut into blocks, each twice as large as the one before."""
    out, size = [0], FIRST_BLOCK
    while out[-1] < n:
        out.append(min(n, out[-1] + size))
        size *= 2
    return np.array(out)


def _shard_rows(number: int, kept: list[pa.Array], lowered: list[bytes], mean_length: float, wanted: set | None, batch: int = 4096):
    """Rows of the index for one shard. The row without a term holds its documents' ids and what else is kept of them."""
    coded, offsets = (x := words(lowered))[0].dictionary_encode(), x[1]
    names, lengths = coded.dictionary, np.diff(offsets)
    size = max(1, len(names))
    doc = np.repeat(np.arange(len(lowered)), lengths)
    cells, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(lowered) + doc, return_counts=True)
    term, doc = cells // len(lowered), (cells % len(lowered)).astype(np.int32)
    impact = tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[doc] / mean_length))
    edges = np.searchsorted(term, np.arange(size + 1))
    kinds = [k.type for k in kept]
    yield _batch([(number, None, len(lowered), None, None, None, *(k.to_pylist() for k in kept))], kinds)
    rows = []
    for k, name in enumerate(names.to_pylist()):
        if wanted is not None and name not in wanted:
            continue
        a, b = edges[k], edges[k + 1]
        order = a + np.lexsort((doc[a:b], -impact[a:b]))
        cuts, most = block_edges(b - a), []
        for i, j in zip(cuts[:-1], cuts[1:]):
            most.append(impact[order[i]])
            order[i:j] = np.sort(order[i:j])
        rows.append((number, name, int(b - a), np.array(most).tobytes(), doc[order].tobytes(), impact[order].tobytes(), *[None] * len(kept)))
        if len(rows) == batch:
            yield _batch(rows, kinds)
            rows = []
    if rows:
        yield _batch(rows, kinds)


def _batch(rows: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
    types = (pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), *map(pa.list_, kinds))
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["shard", "term", "n", "most", "docs", "impacts", *(f"own{i}" for i in range(len(kinds)))])


class TextIndex:
    """An index of docs (id_col, text_col), stored in the shared folder. wanted: only these terms (a set), else all. keep:
    columns that searches can filter by."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", wanted: set | None = None, keep: tuple[str, ...] = ()):
        spark = docs.sparkSession
        lowered = F.lower(F.col(text_col))
        sizes = docs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce(F.regexp_count(lowered, F.lit(WORDS)), F.lit(0))).alias("mean")).first()
        self.n_docs, mean = sizes["n"], sizes["mean"] or 1.0
        self.doc_type = docs.schema[id_col].dataType.simpleString()
        self.narrow, self.keep = wanted is not None, keep
        held = spark.sparkContext.broadcast(wanted)

        def run(tables):
            number = TaskContext.get().partitionId() << 32
            own, texts, size = [], [], 0

            def shard():
                columns = [pa.concat_arrays([o[c] for o in own]) for c in range(len(own[0]))]
                return _shard_rows(number, columns, texts, mean, held.value)

            for t in tables:
                first = 0
                for i, text in enumerate(t.column(0)):
                    raw = (text.as_py() or "").encode()
                    if texts and (len(texts) >= SHARD_DOCS or size + len(raw) > SHARD_BYTES):
                        own.append([c.slice(first, i - first) for c in t.columns[1:]])
                        yield from shard()
                        number, own, texts, size, first = number + 1, [], [], 0, i
                    texts.append(raw)
                    size += len(raw)
                own.append([c.slice(first) for c in t.columns[1:]])
            if texts:
                yield from shard()
            own, texts, t = [], [], None
            shared.give_back()

        columns = [id_col, *keep]
        kinds = [docs.schema[c].dataType.simpleString() for c in columns]
        made = docs.select(lowered, *columns).mapInArrow(run, _INDEX + "".join(f", own{i} array<{k}>" for i, k in enumerate(kinds)))
        self.rows = shared.stored(made, "text-index")

    def _passes(self, terms: DataFrame) -> int:
        return max(1, -(-terms.count() // HELD_TERMS))

    def _found(self, queries: DataFrame, k: int, match: tuple = (), within: tuple | None = None) -> DataFrame:
        """query_id, doc_id, score: a task's best; and for each query and task how many postings there were and were read."""
        kind = queries.schema["query_id"].dataType.simpleString()
        terms = shared.stored(query_terms(queries), "query-terms")
        passes, out = self._passes(terms), None
        for p in range(passes):
            part = terms.filter(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == p) if passes > 1 else terms
            rows = self.rows.filter("term is not null")
            if not self.narrow:  # an index of few terms is read whole
                rows = rows.join(part.select("term").distinct(), "term", "left_semi")
            df = rows.groupBy("term").agg(F.sum("n").alias("df"))
            idf = F.log(1 + (F.lit(self.n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
            weighted = part.join(df, "term").select("query_id", "term", idf.alias("idf")).toArrow()  # HELD_TERMS rows or so
            limits = queries.select("query_id", *match, *(within[1:] if within else ())).join(part.select("query_id").distinct(), "query_id", "left_semi").toArrow() if match or within else None
            filters = _Filters([self.keep.index(c) + 1 for c in match], self.keep.index(within[0]) + 1 if within else None, limits)
            held = queries.sparkSession.sparkContext.broadcast((_by_query(weighted), weighted.schema.field("query_id").type, filters))
            shards = rows.unionByName(self.rows.filter("term is null")).repartition("shard").sortWithinPartitions("shard")

            def run(tables, held=held):
                yield from _search(tables, *held.value, k)
                shared.give_back()

            found = shards.mapInArrow(run, _FOUND.format(kind=kind, doc=self.doc_type))
            out = found if out is None else out.unionByName(found)
        return out

    def search(self, queries: DataFrame, k: int = 20, match: tuple[str, ...] = (), within: tuple[str, str, str] | None = None) -> DataFrame:
        """query_id, doc_id, score, rank: the k best documents of each query (query_id, text), by score (six decimals)
        and then id. Queries without a known term have none. match: kept columns in which a document must equal its query
        (null asks for nothing); within: a kept column, and the queries' columns that bound it, both included (null is no
        bound). Filters come before scores; idf and lengths are those of all documents. Filtered queries have distinct ids."""
        found = self._found(queries, k, match, within).filter("doc_id is not null").select("query_id", "doc_id", "score")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    def work(self, queries: DataFrame, k: int = 20) -> DataFrame:
        """query_id, postings (those of all its terms), read (those that the search read or looked up)."""
        return self._found(queries, k).filter("postings is not null").groupBy("query_id").agg(F.sum("postings").alias("postings"), F.sum("read").alias("read"))


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term; each term once."""
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORDS), F.lit(0)))
    return queries.select("query_id", F.explode(found).alias("term"))


def _by_query(t: pa.Table) -> list[tuple]:
    out: dict = {}
    for q, term, idf in zip(*(c.to_pylist() for c in t.columns)):
        out.setdefault(q, []).append((term, idf))
    return [(q, sorted(x)) for q, x in out.items()]


class _Postings:
    def __init__(self, most: bytes, docs: bytes, impacts: bytes):
        self.most, self.docs, self.impacts = np.frombuffer(most), np.frombuffer(docs, dtype=np.int32), np.frombuffer(impacts)
        self.cuts = block_edges(len(self.docs))

    def weights(self, asked: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Impacts of the asked documents in these blocks (0 where they don't stand), and whether they stand there."""
        w, there = np.zeros(len(asked)), np.zeros(len(asked), dtype=bool)
        for a, b in zip(self.cuts[first:last], self.cuts[first + 1 : last + 1]):
            at = np.minimum(np.searchsorted(self.docs[a:b], asked), b - a - 1) + a
            hit = self.docs[at] == asked
            w[hit] = self.impacts[at[hit]]
            there |= hit
        return w, there


class _Filters:
    """Which documents of a shard a query may find. Columns by their number in the shard's own row; limits: a row a query."""

    def __init__(self, match: list[int], within: int | None, limits: pa.Table | None):
        self.match, self.within = match, within
        self.limits = {row[0]: row[1:] for row in zip(*(c.to_pylist() for c in limits.columns))} if limits is not None else {}
        self.masks: dict = {}

    def shard(self, own: list[list]) -> None:
        self.own, self.masks = own, {}

    def allowed(self, query) -> np.ndarray | None:
        """None: all of them."""
        asked = self.limits.get(query)
        if asked is None:
            return None
        out = None
        for column, value in zip(self.match, asked):
            if value is not None:
                key = (column, value)
                if key not in self.masks:
                    self.masks[key] = np.array([x == value for x in self.own[column]], dtype=bool)
                out = self.masks[key] if out is None else out & self.masks[key]
        if self.within is not None and (asked[-2] is not None or asked[-1] is not None):
            key = (None, asked[-2], asked[-1])
            if key not in self.masks:
                low, high = asked[-2:]
                self.masks[key] = np.array([x is not None and (low is None or x >= low) and (high is None or x <= high) for x in self.own[self.within]], dtype=bool)
            out = self.masks[key] if out is None else out & self.masks[key]
        return out


def _in_shard(terms: list, shard: dict, n: int, least: float, k: int, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Documents that may be among the k best and reach the least score, their scores, postings of all terms, and how many
    were read."""
    held = sorted(((idf * p.most[0], idf, p, term) for term, idf in terms if (p := shard.get(term)) is not None), key=lambda x: (-x[0], x[3]))
    postings, none = sum(len(p.docs) for _, _, p, _ in held), np.zeros(0, dtype=np.int64)
    bounds = np.array([x[0] for x in held])
    rest = np.concatenate((np.cumsum(bounds[::-1])[::-1], [0.0]))
    if not held or rest[0] < least:
        return none, np.zeros(0), postings, 0
    gate = LET_IN * least if least > 0 else -1.0
    taken = [int(np.searchsorted(-(idf * p.most + rest[i + 1]), -gate, side="right")) for i, (_, idf, p, _) in enumerate(held)]
    unread = [idf * p.most[t] if t < len(p.most) else 0.0 for t, (_, idf, p, _) in zip(taken, held)]
    bound, met, read = np.full(n, sum(unread)), np.zeros(n, dtype=bool), 0
    for t, u, (_, idf, p, _) in zip(taken, unread, held):
        if t:
            docs = p.docs[: p.cuts[t]]
            bound[docs] += idf * p.impacts[: p.cuts[t]] - u
            met[docs] = True
            read += len(docs)
    alive = np.flatnonzero(met & (bound >= least) if allowed is None else met & allowed & (bound >= least))
    bound = bound[alive]
    for i in sorted((i for i, u in enumerate(unread) if u > 0), key=lambda i: -unread[i]):
        if not len(alive):
            break
        _, idf, p, _ = held[i]
        read += 2 * len(alive) * (len(p.cuts) - 1)
        _, known = p.weights(alive, 0, taken[i])
        w, _ = p.weights(alive, taken[i], len(p.most))
        bound = bound + np.where(known, 0.0, idf * w - unread[i])
        stay = bound >= least
        alive, bound = alive[stay], bound[stay]
    if len(alive) > k:  # bounds are scores by now, but for the order in which they were summed
        alive = alive[bound >= np.partition(bound, -k)[-k] - SLACK]
    score = np.zeros(len(alive))
    for _, idf, p, _ in sorted(held, key=lambda x: x[3]):
        if len(alive):
            score += idf * p.weights(alive, 0, len(p.most))[0]
    return alive, score, postings, read


def _search(tables, queries: list[tuple], query_type: pa.DataType, filters: _Filters, k: int):
    best = [[] for _ in queries]  # heaps of (score, order of the id turned round, id), the worst first
    counts = np.zeros((len(queries), 2), dtype=np.int64)
    number, own, shard = None, None, {}
    doc_type = None

    def finish():
        ids = own[0]
        filters.shard(own)
        for i, (query, terms) in enumerate(queries):
            allowed, heap = filters.allowed(query), best[i]
            if allowed is not None and not allowed.any():
                continue
            least = heap[0].score - SLACK if len(heap) == k else -np.inf
            docs, scores, postings, read = _in_shard(terms, shard, len(ids), least, k, allowed)
            counts[i] += postings, read
            scores = np.round(scores, DIGITS)
            if len(docs) > k:
                first = scores >= np.partition(scores, -k)[-k]
                docs, scores = docs[first], scores[first]
            for d, s in zip(docs.tolist(), scores.tolist()):
                item = _Item(s, ids[d])
                if len(heap) < k:
                    heapq.heappush(heap, item)
                elif heap[0] < item:
                    heapq.heapreplace(heap, item)

    for t in tables:
        doc_type = t.schema.field("own0").type.value_type
        columns = (t.column(c) for c in ("shard", "term", "most", "docs", "impacts", *sorted((c for c in t.schema.names if c.startswith("own")), key=lambda c: int(c[3:]))))
        for s, term, most, docs, impacts, *rest in zip(*columns):
            if (s := s.as_py()) != number:
                if number is not None:
                    finish()
                number, own, shard = s, None, {}
            if term.as_py() is None:
                own = [x.as_py() for x in rest]
            else:
                shard[term.as_py()] = _Postings(most.as_py(), docs.as_py(), impacts.as_py())
    if number is None:
        return
    finish()
    for i, (q, _) in enumerate(queries):
        out = sorted(best[i], reverse=True)
        yield pa.record_batch([
            pa.array([q] * (len(out) + 1), query_type), pa.array([x.doc for x in out] + [None], doc_type), pa.array([x.score for x in out] + [None], pa.float64()),
            pa.array([None] * len(out) + [int(counts[i, 0])], pa.int64()), pa.array([None] * len(out) + [int(counts[i, 1])], pa.int64())],
            ["query_id", "doc_id", "score", "postings", "read"])


class _Item:
    """A document found; less is worse: a smaller score, then a larger id. A null id is the smallest."""

    __slots__ = ("score", "doc")

    def __init__(self, score: float, doc):
        self.score, self.doc = score, doc

    def __lt__(self, other):
        if self.score != other.score:
            return self.score < other.score
        if self.doc is None or other.doc is None:
            return other.doc is None and self.doc is not None
        return self.doc > other.doc


def bm25(docs: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, doc_id, score, rank for docs (doc_id, text) and queries (query_id, text), by an index of its own: of the
    queries' terms alone, if tasks can hold them, else of all."""
    asked = query_terms(queries).select("term").distinct().limit(HELD_TERMS + 1).toArrow().column(0).to_pylist()
    return TextIndex(docs, wanted=set(asked) if len(asked) <= HELD_TERMS else None).search(queries, k)
