"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source is one line of words: its documents in a seeded order, end to end, cut into blocks. The quota of a
source is a whole number of passes over its blocks and one partial pass, exact to the word. The block draws of all
sources are divided among output shards by a binary tree: every node deals its sources' exact quotas to its halves by
a multivariate hypergeometric draw, as if all blocks had been shuffled at once. A shard then takes the next blocks
of each source's permutation, which no other shard takes, and shuffles them locally.

Edge cases: null text has no words, and texts without words are never taken; a null source is a source of its own,
the last; rows that repeat, or share a doc_id, are placed separately; an empty table gives an empty result; extra
columns stay. The result depends on the rows and the seed only, not on their order or partitions.
"""

from __future__ import annotations

import zlib
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BREAK, batches, lean, sliced, stored

BLOCK_WORDS = 2048
SHARD_WORDS = 1 << 22
#: Documents of a source that are ordered together, about; and cells whose sizes are added up together.
CELL_DOCS, GROUP_CELLS = 256, 4096
#: Sources are listed on the driver; a table with more is refused.
MOST_SOURCES = 100_000
#: Nodes of the tree that a worker remembers.
KNOWN_NODES = 1 << 14
#: Pieces of a document that are cut in one go, and characters of cut text after which a batch ends.
PIECES_AT_ONCE, BATCH_CHARS = 64, 4_000_000
#: numpy draws from populations below this size.
_LIBRARY = 10**9


def targets(sizes: list[int], weights: list[float], total: float, most: float = 2.0) -> list[float]:
    """Shares of total by weight, none above most times its size; what is cut off is shared anew by weight."""
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while open_:
        weight = sum(weights[i] for i in open_)
        full = {i for i in open_ if left * weights[i] / weight >= most * sizes[i]}
        if not full:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in full:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in full)
        open_ -= full
    return out


def permuted(i: int, n: int, key: int) -> int:
    """The place of i in a keyed permutation of range(n): a Feistel network, walked until it lands inside."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        a, b = i >> half, i & mask
        for r in range(4):
            a, b = b, a ^ (((b + key + r * 0x9E3779B97F4A7C15) * 0xD6E8FEB86659FD93 & (1 << 64) - 1) >> 40 & mask)
        i = a << half | b
        if i < n:
            return i


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n drawn without replacement are good. Populations beyond numpy's are drawn by inversion: the
    probabilities of all counts within twelve standard deviations of the mean, from their ratios."""
    total = good + bad
    if total < _LIBRARY:
        return int(rng.hypergeometric(good, bad, n)) if n else 0
    mean = n * good / total
    spread = 12 * sqrt(mean * (bad / total) * ((total - n) / (total - 1))) + 2
    lo, hi = max(0, n - bad, int(mean - spread)), min(good, n, int(mean + spread) + 1)
    x = np.arange(lo, hi, dtype=np.float64)
    steps = np.concatenate(([0.0], np.cumsum(np.log((good - x) / (x + 1)) + np.log((n - x) / (bad - n + x + 1)))))
    sums = np.cumsum(np.exp(steps - steps.max()))
    return lo + int(np.searchsorted(sums, rng.random() * sums[-1], side="right"))


class Tree:
    """Divides the block draws of all sources among shards. A node deals its sources' counts to its halves by a
    multivariate hypergeometric draw of its own seed, so each task finds the shards it needs by itself."""

    def __init__(self, quotas: list[int], shards: int, seed: int):
        self.quotas, self.shards, self.seed = list(quotas), shards, seed
        self.known: dict[tuple[int, int], list[int]] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def left(self, lo: int, hi: int, counts: list[int]) -> list[int]:
        """What the first half of the shards [lo, hi) gets of each source's counts."""
        if (lo, hi) not in self.known:
            if len(self.known) >= KNOWN_NODES:
                self.known.clear()
            rng = np.random.default_rng([self.seed, lo, hi])
            rest = sum(counts)
            n, out = rest * ((lo + hi) // 2 - lo) // (hi - lo), []
            for c in counts:
                rest -= c
                out.append(hypergeometric(rng, c, rest, n) if n and c else 0)
                n -= out[-1]
            self.known[lo, hi] = out
        return self.known[lo, hi]

    def shard(self, k: int, place: int) -> int:
        """The shard of source k's draw number place: a shard's draws follow those of the shards before it."""
        lo, hi, counts = 0, self.shards, self.quotas
        while hi - lo > 1:
            left, mid = self.left(lo, hi, counts), (lo + hi) // 2
            if place < left[k]:
                hi, counts = mid, left
            else:
                place -= left[k]
                lo, counts = mid, [c - x for c, x in zip(counts, left)]
        return lo


def split_tree(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """Block draws by shard and source, all of them."""
    tree = Tree(quotas, shards, seed)

    def deal(lo: int, hi: int, counts: list[int]) -> list[list[int]]:
        if hi - lo == 1:
            return [counts]
        left, mid = tree.left(lo, hi, counts), (lo + hi) // 2
        return deal(lo, mid, left) + deal(mid, hi, [c - x for c, x in zip(counts, left)])

    return np.array(deal(0, shards, list(quotas)), dtype=np.int64)


class Plan:
    """What is drawn of each source: passes, the partial pass, and the tree that deals the block draws to shards."""

    def __init__(self, names, sizes, weights, share, seed, block_words, shard_words, most=2.0):
        total = sum(sizes)
        self.names, self.sizes, self.seed = names, sizes, seed
        self.block = block_words
        self.targets = targets(sizes, weights, share * total, most)
        self.blocks = [ceil(s / self.block) for s in sizes]
        self.passes, self.full, self.part = [], [], []
        for k, (size, target) in enumerate(zip(sizes, self.targets)):
            words = round(target)
            passes, rest = divmod(words, size) if size else (0, 0)
            n, short = self.blocks[k], size - (self.blocks[k] - 1) * self.block
            q = min(n, rest // self.block) if size else 0
            if size and self.rank(k, passes, n - 1) <= q:  # the short block is among those taken
                q = min(n, (rest + self.block - short) // self.block)
                if self.rank(k, passes, n - 1) >= q:
                    q = self.rank(k, passes, n - 1)
                    part = rest - q * self.block
                else:
                    part = rest - (q * self.block - (self.block - short))
            else:
                part = rest - q * self.block
            self.passes.append(passes)
            self.full.append(q)
            self.part.append(part)
        draws = [p * n + q + (r > 0) for p, n, q, r in zip(self.passes, self.blocks, self.full, self.part)]
        self.shards = max(1, ceil(sum(self.targets) / shard_words))
        self.tree = Tree(draws, self.shards, seed)

    def rank(self, k: int, turn: int, block: int) -> int:
        key = zlib.crc32(f"{self.seed}/{self.names[k]!r}/{turn}".encode()) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
        return permuted(block, self.blocks[k], key)

    def pieces(self, k: int, start: int, size: int) -> list[tuple[int, int, int, int, int]]:
        """(shard, pass, place in the source's draws, first word, words) of a document at start of its line."""
        out = []
        for block in range(start // self.block, (start + size - 1) // self.block + 1) if size else ():
            lo, hi = max(start, block * self.block), min(start + size, (block + 1) * self.block)
            for turn in range(self.passes[k] + 1):
                rank = self.rank(k, turn, block)
                end = hi
                if turn == self.passes[k]:
                    if rank > self.full[k]:
                        continue
                    if rank == self.full[k]:
                        end = min(hi, block * self.block + self.part[k])
                if end <= lo:
                    continue
                place = turn * self.blocks[k] + rank
                out.append((self.tree.shard(k, place), turn, place, lo - start, end - lo))
        return out


_PIECE = pa.struct([("shard", pa.int64()), ("pass", pa.int64()), ("place", pa.int64()), ("first", pa.int64()), ("words", pa.int64())])
_PIECES = "array<struct<shard:long,pass:long,place:long,first:long,words:long>>"
#: Where a row stands: its source's number, its cell, its place in the cell, its first word's place in the source's line.
KEY = ["__k", "__cell", "__nth"]


class Mixture:
    """The plan of a table, and where each of its rows stands in its source's line. A row's place follows from what the
    row holds (doc_id, source, text) and the seed, so the table may be read again at any time, in any partitions; rows
    that are alike in all three may stand for one another."""

    def __init__(self, docs: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (5, 2, 1), seed: int = 17, most: float = 2.0,
                 block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS):
        spark, self.seed = docs.sparkSession, seed
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), *self._measures())
        self.sizes = stored(rows, "mix-sizes")
        found = self.sizes.groupBy("source").agg(F.sum("__size").alias("size"), F.count(F.lit(1)).alias("n")).limit(MOST_SOURCES + 1).collect()
        if len(found) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources")
        found.sort(key=lambda r: (r.source is None, r.source or ""))
        self.plan = Plan([r.source for r in found], [r["size"] for r in found], [weights[i % len(weights)] for i in range(len(found))],
                         share, seed, block_words, shard_words, most)
        self.listed = spark.createDataFrame([(i, r.source, ceil(r.n / CELL_DOCS)) for i, r in enumerate(found)], "__k int, __source string, __cells long")
        cells = self._celled(self.sizes).groupBy("__k", "__cell").agg(F.sum("__size").alias("n"))
        # Prefix sums in two steps, so that no source's cells meet in one task.
        cells = cells.withColumn("group", F.expr(f"__cell div {GROUP_CELLS}"))
        groups = cells.groupBy("__k", "group").agg(F.sum("n").alias("n"))
        before = lambda n, *keys, by: F.coalesce(F.sum(n).over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        groups = groups.select("__k", "group", before("n", "__k", by="group").alias("outer"))
        cells = cells.join(groups, ["__k", "group"])
        self.bases = stored(cells.select("__k", "__cell", (F.col("outer") + before("n", "__k", "group", by="__cell")).alias("__base")), "mix-cells")

    @staticmethod
    def _measures() -> list:
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        return [F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("__size"), F.xxhash64(text).alias("__mark")]

    def _celled(self, rows: DataFrame) -> DataFrame:
        """rows with their source's number, their cell, and their order in it."""
        order = F.shiftrightunsigned(F.xxhash64(F.lit(self.seed), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), "__mark"), 33)
        # The list of sources is bounded by MOST_SOURCES.
        rows = rows.join(F.broadcast(self.listed), F.col("source").cast("string").eqNullSafe(F.col("__source"))).drop("__source")
        return rows.withColumn("__order", order).withColumn("__cell", F.shiftright(F.col("__order") * F.col("__cells"), 31)).drop("__cells")

    def placed(self, rows: DataFrame) -> DataFrame:
        """rows (with __size and __mark) with KEY and __start. Whatever else they hold goes through one shuffle, by cell."""
        line = Window.partitionBy("__k", "__cell").orderBy("__order", F.col("doc_id").cast("long"), "__mark")
        rows = self._celled(rows).withColumns({"__nth": F.row_number().over(line), "__inner": F.coalesce(F.sum("__size").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
        return rows.join(self.bases, ["__k", "__cell"]).withColumn("__start", F.col("__base") + F.col("__inner")).drop("__order", "__inner", "__base", "__mark")

    def pieces(self) -> DataFrame:
        """A row per document: KEY, doc_id, source, size, source_size, target and pieces."""
        shared = self.listed.sparkSession.sparkContext.broadcast(self.plan)

        def draw(tables):
            plan = shared.value
            for t in tables:
                k, start, size = (t.column(c).to_pylist() for c in ("__k", "__start", "__size"))
                pieces = [[dict(zip(("shard", "pass", "place", "first", "words"), p)) for p in plan.pieces(*x)] for x in zip(k, start, size)]
                yield pa.record_batch([*(t.column(c) for c in (*KEY, "doc_id", "source", "__size")), pa.array([plan.sizes[i] for i in k], pa.int64()),
                                       pa.array([plan.targets[i] for i in k], pa.float64()), pa.array(pieces, pa.list_(_PIECE))],
                                      [*KEY, "doc_id", "source", "size", "source_size", "target", "pieces"])

        return self.placed(self.sizes).mapInArrow(lean(draw), "__k int, __cell long, __nth int, doc_id long, source string, size long, source_size long, "
                                                              f"target double, pieces {_PIECES}")


def plan_mix(docs: DataFrame, **options) -> DataFrame:
    """A row per document: doc_id, source, size, source_size, target, and pieces, an array of (shard, pass, place,
    first word, words). weights repeat over the sources in order of code points, null last. options: as of Mixture."""
    return Mixture(docs, **options).pieces().drop(*KEY)


def cut_words(text: str, pieces: list[tuple[int, int]], size: int) -> list[str]:
    """For each (first, words): words words of text from the first-th on, with what stands between them.
    The words are found once, however many pieces a text has."""
    if all(first == 0 and words == size for first, words in pieces):
        return [text] * len(pieces)
    raw = text.encode("utf-8", "surrogatepass")
    gap = BREAK[np.frombuffer(raw, dtype=np.uint8)]
    edge = np.diff(gap.astype(np.int8), prepend=1, append=1)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    return [text if first == 0 and words == size else raw[starts[first] : ends[first + words - 1]].decode("utf-8", "surrogatepass")
            for first, words in pieces]


def mix(docs: DataFrame, mixture: Mixture | None = None, keyed: bool = False, **options) -> DataFrame:
    """The mix itself: rows with the columns of docs (doc_id, text, source, n_chars and others), a row for each piece
    taken, text and n_chars being the piece's; shards are partitions, each in a local random order. mixture: of the same
    docs, made before. keyed: with the columns KEY of the row that each piece is from."""
    mixture = mixture or Mixture(docs, **options)
    # Columns of docs go by numbers meanwhile: their names may be those used here.
    names = docs.columns
    own = {c: f"c{i}" for i, c in enumerate(names)}
    rows = docs.select("doc_id", "source", "text", *(F.col(f"`{c}`").alias(x) for c, x in own.items() if c not in ("doc_id", "source", "text")))
    placed = mixture.placed(rows.select("*", *mixture._measures()))
    carried = [own.get(c) if c not in ("doc_id", "source", "text") else c for c in names]
    placed = placed.select(*carried, *KEY, "__start", "__size")
    shared = docs.sparkSession.sparkContext.broadcast(mixture.plan)

    def cut(tables):
        plan = shared.value
        for t in sliced(tables, "text"):
            k, start, size = (t.column(c).to_pylist() for c in ("__k", "__start", "__size"))
            for group in batches((i, x) for i, x in enumerate(t.column("text").to_pylist())):
                at, texts, shards, places, held = [], [], [], [], 0
                for i, text in group:
                    pieces = plan.pieces(k[i], start[i], size[i])
                    for lo in range(0, len(pieces), PIECES_AT_ONCE):
                        part = pieces[lo : lo + PIECES_AT_ONCE]
                        texts += cut_words(text, [(first, words) for *_, first, words in part], size[i])
                        at += [i] * len(part)
                        shards += [p[0] for p in part]
                        places += [p[2] for p in part]
                        held += sum(map(len, texts[-len(part) :]))
                        if held > BATCH_CHARS:
                            yield batch(t, at, texts, shards, places)
                            at, texts, shards, places, held = [], [], [], [], 0
                if at:
                    yield batch(t, at, texts, shards, places)

    def batch(t, at, texts, shards, places):
        rows = pa.array(at, pa.int64())
        columns = {c: t.column(c).take(rows) for c in [*carried, *KEY] if c not in ("text", own.get("n_chars"))}
        columns["text"] = pa.array(texts, t.column("text").type)
        if "n_chars" in own:
            columns[own["n_chars"]] = pa.array([len(x) for x in texts], t.column(own["n_chars"]).type)
        return pa.record_batch([*(columns[c] for c in [*carried, *KEY]), pa.array(shards, pa.int64()), pa.array(places, pa.int64())], [*carried, *KEY, "__shard", "__place"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.select(*carried, *KEY).schema.fields)
    out = placed.mapInArrow(lean(cut), f"{fields}, __shard long, __place long")
    out = out.repartition("__shard").sortWithinPartitions("__shard", F.xxhash64(F.lit(mixture.seed), "__shard", "source", "__place"), "__place", "__cell", "__nth")
    return out.select(*(F.col(x).alias(c) for c, x in zip(names, carried)), *(KEY if keyed else ()))
