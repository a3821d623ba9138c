"""Exact Jaccard self-join on word shingles, with adaptive multi-match prefixes.

A document is its set of distinct shingles; equal sets are one node. If two sets are similar enough, prefixes of
length n - ceil(t n) + l of the two, under one global order of shingles, share at least l shingles. So:

1. Every node hands on a prefix in order of hashes, long enough for l = 1 + n // 10 matches. A node of whose prefix
   fewer shingles occur elsewhere than any partner would share is done: it has no link.
2. What is left is stored as sorted arrays, counted, and ordered by frequency. Each node now takes the prefix length
   whose estimated candidate cost is least, and asks for as many shared shingles as that length warrants.
3. Nodes that share a prefix shingle are verified against a few pivots of its group, and linked nodes are merged.
4. Shingles whose nodes are of several components are indexed in sorted arrays, mapped into memory. A node looks up
   its own there and finds the nodes of components that aren't smaller than its own; those that share enough prefix
   shingles are verified by their whole sets, the most promising first, until one links the two components.

Steps 3 and 4 lose no link between components, and no list of pairs is made: members of a large group of copies are
merged by way of its pivots, and only what is left outside is compared with it. Sets are compared by 64-bit shingle hashes.

Edge cases: null text, or text without words, has an empty set and no link; fewer words than a shingle make one
shingle; repeated rows share a node; a null doc_id takes part but names no component while another id is there; an
empty table gives an empty result; extra columns are ignored or, in ``keep_one``, returned untouched.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, batches, fresh, lean, mix, mounted, numbered, shared_dir, sliced, stored, word_hashes
from .components import components

WORDS, PERCENT = 5, 75
#: Survivors up to this number are broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_NODES = 500_000
#: Estimated cost of verifying a candidate, in postings read.
VERIFY_COST = 20
#: Pivots of a group, and postings that a lookup gathers before it adds them up.
PIVOTS, GATHER = 6, 1 << 20

_U = np.uint64


def shingle_sets(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and offsets."""
    hashes, edges, _ = word_hashes(texts)
    counts = np.diff(edges)
    n = len(hashes)
    width = np.where(counts >= words, counts - words + 1, (counts > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(texts)), width)
    starts = np.arange(len(owner)) - np.repeat(np.cumsum(width) - width, width) + edges[owner]
    key = np.zeros(len(owner), dtype=np.uint64)
    for k in range(words):
        there = starts + k < edges[owner + 1]
        nxt = hashes[np.minimum(starts + k, n - 1)] if n else hashes
        key = np.where(there, mix(key * _U(0x9E3779B97F4A7C15) + nxt), key)
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    first = np.ones(len(key), dtype=bool)
    first[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    key, owner = key[first], owner[first]
    return key, np.searchsorted(owner, np.arange(len(texts) + 1))


def node_ids(keys: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit name for each set; equal sets, and only they (but for 2**-64), have one."""
    sizes = np.diff(offsets)
    out = np.zeros(len(sizes), dtype=np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        out[full] = np.add.reduceat(mix(keys ^ _U(0x5851F42D4C957F2D)), offsets[full])
        out[full] = mix(out[full] + mix(sizes[full].astype(np.uint64)))
    return out.view(np.int64)


def least_overlap(n, percent: int = PERCENT):
    return (percent * n + 99) // 100


def _first_l(n):
    return 1 + n // 10


def _bucketed(tokens: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """A shingle's range, by its leading bits, and its last 32 bits."""
    return ((tokens >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64), (tokens & _U(0xFFFFFFFF)).astype(np.uint32)


def _postings(tokens, owners, nodes, sizes, lengths, buckets: int) -> pa.Table:
    """Packed rows (bucket, data): last bits of shingles, their nodes, and the nodes' sizes and prefix lengths."""
    bucket, low = _bucketed(tokens, buckets)
    order = np.lexsort((low, bucket))
    bucket, low, owners = bucket[order], low[order], owners[order]
    edges = np.searchsorted(bucket, np.arange(buckets + 1))
    rows = []
    for b in np.flatnonzero(np.diff(edges)).tolist():
        who, index = np.unique(owners[edges[b] : edges[b + 1]], return_inverse=True)
        head = np.array([edges[b + 1] - edges[b], len(who)], dtype="<u4").tobytes()
        rows.append((b, head + low[edges[b] : edges[b + 1]].tobytes() + index.astype("<u4").tobytes() + nodes[who].tobytes()
                     + sizes[who].astype("<u4").tobytes() + lengths[who].astype("<u4").tobytes()))
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "data": pa.array([r[1] for r in rows], pa.binary())})


def _read_postings(table: pa.Table):
    """All of a range: last bits and node index, sorted by bits, without repeats; nodes, sizes, prefix lengths."""
    lows, owners, nodes, sizes, lengths, base = [], [], [], [], [], 0
    for data in table.column("data").to_pylist():
        n, m = np.frombuffer(data[:8], dtype="<u4").tolist()
        at = 8
        for size, kind, out in ((n, "<u4", lows), (n, "<u4", owners), (m, "<i8", nodes), (m, "<u4", sizes), (m, "<u4", lengths)):
            width = np.dtype(kind).itemsize
            out.append(np.frombuffer(data[at : at + width * size], dtype=kind))
            at += width * size
        owners[-1] = owners[-1].astype(np.int64) + base
        base += m
    low, owner, nodes, sizes, lengths = map(np.concatenate, (lows, owners, nodes, sizes, lengths))
    nodes, first, back = np.unique(nodes, return_index=True, return_inverse=True)
    owner = back[owner]
    order = np.lexsort((owner, low))
    low, owner = low[order], owner[order]
    keep = np.ones(len(low), dtype=bool)
    keep[1:] = (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])
    return low[keep], owner[keep], nodes, sizes[first].astype(np.int64), lengths[first].astype(np.int64)


def _groups(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of two or more."""
    starts = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
    ends = np.append(starts[1:], len(low))
    many = ends - starts > 1
    return starts[many], ends[many]


class Sets:
    """Shards of sorted arrays in the shared folder, mapped into memory. known: the shards of each kind that were
    written; one of them that can't be opened is an error, and any other is empty."""

    def __init__(self, folder: str, shards: int):
        self.folder, self.shards = folder, shards
        self.known: dict[str, frozenset[int]] = {}

    def path(self, kind: str, k: int) -> str:
        return f"{self.folder}/{kind}-{k:06d}.npy"

    def write(self, kind: str, k: int, array: np.ndarray) -> None:
        os.makedirs(self.folder, exist_ok=True)
        tmp = f"{self.folder}/.{uuid.uuid4().hex}"
        with open(tmp, "wb") as f:
            np.save(f, array)
        os.replace(tmp, self.path(kind, k))

    def read(self, kind: str, k: int) -> np.ndarray | None:
        if k not in self.known[kind]:
            return None
        path = self.path(kind, k)
        if path not in _maps:
            if len(_maps) > 4096:
                _maps.clear()
            _maps[path] = np.load(path, mmap_mode="r")
        return _maps[path]

    def wrote(self, kind: str, rows) -> None:
        """The shards that a job has written: one small row for each, whatever they hold."""
        self.known[kind] = frozenset(r[0] for r in rows)

    def shard(self, nodes: np.ndarray) -> np.ndarray:
        return (nodes.view(np.uint64) % _U(self.shards)).astype(np.int64)

    def load(self, k: int):
        """Nodes (sorted), offsets and shingles of a shard."""
        a = self.read("sets", k)
        n = int(a[0])
        return a[1 : 1 + n].view(np.int64), a[1 + n : 2 + 2 * n].astype(np.int64), a[2 + 2 * n :]

    def set_of(self, node: int, held: dict) -> np.ndarray:
        k = int((node & (1 << 64) - 1) % self.shards)
        if k not in held:
            held[k] = self.load(k)
        nodes, offsets, keys = held[k]
        i = int(np.searchsorted(nodes, node))
        return keys[offsets[i] : offsets[i + 1]]


_maps: dict[str, np.ndarray | None] = {}


def _scan(docs: DataFrame, row_col: str | None, id_col: str, text_col: str, words: int, make, schema: str) -> DataFrame:
    """make(rows' keys, shingles, offsets, nodes) gives record batches for about a megabyte of text."""

    def run(tables):
        for t in sliced(tables, 2):
            for group in batches(zip(t.column(0).to_pylist(), t.column(1).to_pylist(), (x.encode() if x else b"" for x in t.column(2).to_pylist()))):
                keys, offsets = shingle_sets([g[-1] for g in group], words)
                yield from make(group, keys, offsets, node_ids(keys, offsets))

    row = F.col(row_col) if row_col else F.monotonically_increasing_id()  # the members' numbers are stored once
    rows = docs.select(row.alias("__row"), F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(lean(run), schema)


def _links(pairs: DataFrame, sets: Sets, percent: int) -> DataFrame:
    """Those pairs (a, b) whose whole sets are similar enough."""

    def verify(tables):
        held: dict = {}
        for t in tables:
            a, b = (c.to_numpy() for c in t.columns)
            good = np.zeros(len(a), dtype=bool)
            order, last, mine = np.argsort(a, kind="stable"), None, None
            for i in order.tolist():
                if a[i] != last:
                    last, mine = a[i], sets.set_of(int(a[i]), held)
                good[i] = _alike(mine, sets.set_of(int(b[i]), held), percent)
            yield pa.record_batch([pa.array(a[good]), pa.array(b[good])], ["a", "b"])

    return pairs.select("a", "b").mapInArrow(lean(verify), "a long, b long")


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT,
            row_col: str | None = None) -> DataFrame:
    """A row per row of docs: __row (row_col's number), doc_id, n_shingles, node (null for an empty set), component_id
    and first_row, the row of the component's least (doc_id, row). docs is read three times; nodes are named by content."""
    spark = docs.sparkSession
    n_parts = max(2, docs.rdd.getNumPartitions())
    buckets, shards = 4 * n_parts, 2 * n_parts
    sets = Sets(mounted(shared_dir(spark, "jaccard")), shards)

    def member(group, keys, offsets, nodes):
        sizes = np.diff(offsets)
        yield pa.record_batch([pa.array([g[0] for g in group], pa.int64()), pa.array([g[1] for g in group], pa.int64()),
                               pa.array(sizes, pa.int64()), pa.array(nodes, mask=sizes == 0)], ["__row", "doc_id", "n_shingles", "node"])

    members = stored(_scan(docs, row_col, id_col, text_col, words, member, "__row long, doc_id long, n_shingles long, node long"), "jaccard-members")

    # 1. Prefixes by hash; nodes with enough shingles that occur elsewhere.
    def prefix(group, keys, offsets, nodes):
        sizes = np.diff(offsets)
        take = np.where(sizes > 0, sizes - least_overlap(sizes, percent) + _first_l(sizes), 0)
        _, first = np.unique(nodes, return_index=True)
        once = np.zeros(len(nodes), dtype=bool)
        once[first] = True
        take = np.minimum(np.where(once, take, 0), sizes)
        owners = np.repeat(np.arange(len(nodes)), take)
        at = np.arange(len(owners)) - np.repeat(np.cumsum(take) - take, take) + offsets[owners]
        yield from _postings(keys[at], owners, nodes, sizes, np.zeros(len(nodes), dtype=np.int64), buckets).to_batches()

    def met(table):
        low, owner, nodes, sizes, _ = _read_postings(table)
        starts, ends = _groups(low)
        mark = np.zeros(len(low) + 1, dtype=np.int64)
        np.add.at(mark, starts, 1)
        np.add.at(mark, ends, -1)
        count = np.bincount(owner[np.cumsum(mark[:-1]) > 0], minlength=len(nodes))
        some = count > 0
        return pa.table({"node": nodes[some], "n": sizes[some], "met": count[some].astype(np.int64)})

    first = _scan(docs, row_col, id_col, text_col, words, prefix, "bucket int, data binary").groupBy("bucket").applyInArrow(met, "node long, n long, met long")
    # The least partner has ceil(t n) shingles and so asks for this many matches.
    least = F.lit(1) + F.floor(F.floor((F.lit(percent) * F.col("n") + 99) / 100) / 10)
    left = stored(first.groupBy("node", "n").agg(F.sum("met").alias("met")).filter(F.col("met") >= least).select(F.col("node").alias("__node")), "jaccard-left")

    # 2. The sets of those nodes, once each, as sorted arrays.
    def whole(group, keys, offsets, nodes):
        raw = keys.tobytes()
        _, once = np.unique(nodes, return_index=True)
        once = [i for i in once.tolist() if offsets[i + 1] > offsets[i]]
        yield pa.record_batch([pa.array(sets.shard(nodes[once]), pa.int32()), pa.array(nodes[once], pa.int64()),
                               pa.array([raw[8 * offsets[i] : 8 * offsets[i + 1]] for i in once], pa.binary())], ["shard", "node", "data"])

    full = _scan(docs, row_col, id_col, text_col, words, whole, "shard int, node long, data binary")
    known = F.broadcast(left) if left.count() <= BROADCAST_NODES else left
    full = full.join(known, F.col("node") == F.col("__node"), "left_semi")

    def write(key, table):
        nodes, first = np.unique(table.column("node").to_numpy(), return_index=True)
        data = table.column("data")
        parts = [np.frombuffer(data[i].as_py(), dtype=np.uint64) for i in first.tolist()]
        offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.uint64)
        sets.write("sets", key[0].as_py(), np.concatenate([np.array([len(nodes)], dtype=np.uint64), nodes.view(np.uint64), offsets, *parts]))
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([len(nodes)], pa.int64())})

    # One row for each shard.
    shard_list = full.groupBy("shard").applyInArrow(write, "shard int, n long").select("shard").collect()
    sets.wrote("sets", shard_list)
    result_none = members.select("__row", "doc_id", "n_shingles", "node")
    if not shard_list:
        return _named(result_none, None)
    listed = spark.createDataFrame(spark.sparkContext.parallelize([(r.shard,) for r in shard_list], len(shard_list)), "shard int")

    def count(tables):
        for t in tables:
            for k in t.column(0).to_pylist():
                _, _, keys = sets.load(k)
                bucket, low = _bucketed(np.asarray(keys), buckets)
                order = np.lexsort((low, bucket))
                bucket, low = bucket[order], low[order]
                edges = np.searchsorted(bucket, np.arange(buckets + 1))
                full = np.flatnonzero(np.diff(edges)).tolist()
                yield pa.record_batch([pa.array(full, pa.int32()), pa.array([low[edges[b] : edges[b + 1]].tobytes() for b in full], pa.binary())], ["bucket", "data"])

    def frequent(key, table):
        low = np.sort(np.concatenate([np.frombuffer(x, dtype=np.uint32) for x in table.column("data").to_pylist()]))
        starts, ends = _groups(low)
        sets.write("df", key[0].as_py(), np.stack([low[starts], (ends - starts).astype(np.uint32)]))
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32())})

    sets.wrote("df", listed.mapInArrow(lean(count), "bucket int, data binary").groupBy("bucket").applyInArrow(frequent, "bucket int").collect())

    def chosen(tables):
        for t in tables:
            for k in t.column(0).to_pylist():
                nodes, offsets, keys = sets.load(k)
                keys = np.asarray(keys)
                df = np.ones(len(keys), dtype=np.int64)
                bucket, low = _bucketed(keys, buckets)
                order = np.lexsort((low, bucket))
                edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(edges)).tolist():
                    table = sets.read("df", b)
                    if table is None or not table.shape[1]:
                        continue
                    mine = order[edges[b] : edges[b + 1]]
                    at = np.searchsorted(table[0], low[mine])
                    at[at == table.shape[1]] = 0
                    df[mine] = np.where(table[0][at] == low[mine], table[1][at], 1)
                sizes = np.diff(offsets)
                owner = np.repeat(np.arange(len(nodes)), sizes)
                order = np.lexsort((keys, df, owner))
                cost = np.concatenate(([0], np.cumsum((df - 1)[order])))
                base = sizes - least_overlap(sizes, percent)
                take, best = base + 1, None
                level = 1
                while level <= max(1, int(sizes.max(initial=0))):
                    ok = level <= least_overlap(sizes, percent)
                    length = np.where(ok, base + level, 1)
                    read = cost[offsets[:-1] + length] - cost[offsets[:-1]]
                    price = np.where(ok, read + VERIFY_COST * read / level, np.inf)
                    if best is None:
                        best = price
                    else:
                        better = price < best
                        take, best = np.where(better, length, take), np.where(better, price, best)
                    level *= 2
                who = np.repeat(np.arange(len(nodes)), take)
                at = order[np.arange(len(who)) - np.repeat(np.cumsum(take) - take, take) + offsets[who]]
                seen = df[at] > 1
                yield from _postings(keys[at[seen]], who[seen], np.asarray(nodes), sizes, take, buckets).to_batches()

    # 3. Pivots for each group of nodes that share a prefix shingle.
    postings = stored(listed.mapInArrow(lean(chosen), "bucket int, data binary"), "jaccard-postings")

    def pivots(table):
        low, owner, nodes, sizes, _ = _read_postings(table)
        starts, ends = _groups(low)
        length = ends - starts
        at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(starts, length)
        a, b = [], []
        for k in range(PIVOTS):
            place = starts + (length - 1) * k // (PIVOTS - 1)
            a.append(owner[at])
            b.append(np.repeat(owner[place], length))
        a, b = np.concatenate(a), np.concatenate(b)
        return _pairs(a, b, sizes, nodes, percent)

    tried = postings.groupBy("bucket").applyInArrow(pivots, "a long, b long").distinct()
    links = stored(_links(tried, sets, percent), "jaccard-links")
    found = stored(components(links), "jaccard-components")

    # 4. Lookups between components.
    members_of = found.groupBy(F.col("root").alias("__root")).agg(F.count(F.lit(1)).alias("members"))
    counted = found.join(apart(members_of, "__root"), F.col("root") == F.col("__root"))

    def place(key, table):
        nodes, roots, members = (table.column(c).to_numpy() for c in ("node", "root", "members"))
        order = np.argsort(nodes)
        sets.write("root", key[0].as_py(), np.stack([nodes[order], roots[order], members[order]]))
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32())})

    shard = F.pmod(F.col("node"), F.lit(shards)).cast("int")
    sets.wrote("root", counted.select("node", "root", "members", shard.alias("shard")).groupBy("shard").applyInArrow(place, "shard int").collect())

    def rooted(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nodes' components and their sizes, as far as the pivots showed them."""
        root, size = np.array(nodes), np.ones(len(nodes), dtype=np.int64)
        at_shard = np.mod(nodes, shards)
        for k in np.unique(at_shard).tolist():
            known = sets.read("root", k)
            if known is None:
                continue
            mine = np.flatnonzero(at_shard == k)
            at = np.searchsorted(known[0], nodes[mine])
            at[at == known.shape[1]] = 0
            hit = known[0][at] == nodes[mine]
            root[mine[hit]], size[mine[hit]] = known[1][at[hit]], known[2][at[hit]]
        return root, size

    def index(key, table):
        """Stores the range's shingles that lie in several components; a row for each node that has to look some up."""
        low, owner, nodes, sizes, lengths = _read_postings(table)
        root, members = rooted(nodes)
        starts, ends = _groups(low)
        its = root[owner]
        change = np.concatenate(([0], np.cumsum(its[1:] != its[:-1])))
        mixed = change[ends - 1] > change[starts]
        starts, ends = starts[mixed], ends[mixed]
        if not len(starts):
            return _no_lookups()
        width = ends - starts
        at = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + np.repeat(starts, width)
        who, rank = owner[at], members[owner[at]]
        first = np.cumsum(width) - width
        b = key[0].as_py()
        sets.write("token", b, np.stack([low[starts].astype(np.int64), first, first + width]))
        sets.write("posting", b, np.stack([nodes[who], root[who], rank, sizes[who], lengths[who]]))
        # Whose component is the largest, alone, has nothing to look up.
        top = np.maximum.reduceat(rank, first)
        is_top = rank == np.repeat(top, width)
        lone = np.repeat(np.minimum.reduceat(np.where(is_top, root[who], np.iinfo(np.int64).max), first)
                         == np.maximum.reduceat(np.where(is_top, root[who], np.iinfo(np.int64).min), first), width)
        ask = np.flatnonzero(~(is_top & lone))
        ask = ask[np.argsort(who[ask], kind="stable")]
        token = np.repeat(np.arange(len(starts)), width)[ask].astype("<u4")
        cut = np.flatnonzero(np.concatenate(([True], who[ask][1:] != who[ask][:-1])))
        asks = nodes[who[ask][cut]]
        bounds = np.append(cut, len(ask)).tolist()
        return pa.table({"shard": pa.array(sets.shard(asks), pa.int32()), "node": pa.array(asks, pa.int64()), "bucket": pa.array([b] * len(asks), pa.int32()),
                         "n": pa.array(sizes[who[ask][cut]], pa.int64()), "length": pa.array(lengths[who[ask][cut]], pa.int64()),
                         "tokens": pa.array([token[lo:hi].tobytes() for lo, hi in zip(bounds, bounds[1:])], pa.binary())})

    def look_up(key, table):
        table = table.sort_by("node")
        held: dict = {}
        out_a, out_b = [], []
        nodes = table.column("node").to_numpy()
        own_root, own_size = rooted(nodes)
        lists = {c: table.column(c).to_pylist() for c in ("bucket", "n", "length", "tokens")}
        edges = np.flatnonzero(np.concatenate(([True], nodes[1:] != nodes[:-1], [True]))).tolist()
        for lo, hi in zip(edges, edges[1:]):
            node, root, size, n, length = int(nodes[lo]), own_root[lo], own_size[lo], lists["n"][lo], lists["length"][lo]
            parts, gathered, waiting = None, [], 0

            def add_up(parts, gathered):
                rows = np.concatenate(gathered + ([parts] if parts is not None else []), axis=1)
                order = np.argsort(rows[0], kind="stable")
                rows = rows[:, order]
                first = np.flatnonzero(np.concatenate(([True], rows[0][1:] != rows[0][:-1])))
                shared = np.add.reduceat(rows[4], first)
                rows = rows[:, first].copy()
                rows[4] = shared
                return rows

            for i in range(lo, hi):
                tokens, postings = sets.read("token", lists["bucket"][i]), sets.read("posting", lists["bucket"][i])
                for t in np.frombuffer(lists["tokens"][i], dtype="<u4").tolist():
                    p = postings[:, tokens[1][t] : tokens[2][t]]
                    there = (p[1] != root) & (p[2] >= size) & (100 * np.minimum(p[3], n) >= percent * np.maximum(p[3], n))
                    if there.any():
                        p = p[:, there]
                        gathered.append(np.stack([p[0], p[1], p[3], p[4], np.ones(p.shape[1], dtype=np.int64)]))
                        waiting += p.shape[1]
                        if waiting > GATHER:
                            parts, gathered, waiting = add_up(parts, gathered), [], 0
            if gathered:
                parts = add_up(parts, gathered)
            if parts is None:
                continue
            # Shingles that both share beyond either prefix are at most as many as stand there.
            need = -(-percent * (parts[2] + n) // (100 + percent)) - np.maximum(parts[2] - parts[3], n - length)
            parts = parts[:, parts[4] >= np.maximum(need, 1)]
            mine, linked = sets.set_of(node, held), set()
            for i in np.argsort(-parts[4], kind="stable").tolist():
                if int(parts[1][i]) not in linked and _alike(mine, sets.set_of(int(parts[0][i]), held), percent):
                    linked.add(int(parts[1][i]))
                    out_a.append(node)
                    out_b.append(int(parts[0][i]))
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    asked = postings.groupBy("bucket").applyInArrow(index, _LOOKUP)
    # All of the index is written before the first lookup.
    asked = stored(asked, "jaccard-lookups")
    # A range that stored an index asks for something.
    for kind in ("token", "posting"):
        sets.wrote(kind, asked.select("bucket").distinct().collect())
    more = stored(asked.groupBy("shard").applyInArrow(look_up, "a long, b long"), "jaccard-more")
    if not more.isEmpty():
        # Components of the first links are stars; the new links join them.
        found = stored(components(more.unionByName(found.select(F.col("node").alias("a"), F.col("root").alias("b")))), "jaccard-components")
    return _named(result_none, found)


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Are two sorted sets similar enough?"""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


_LOOKUP = "shard int, node long, bucket int, n long, length long, tokens binary"


def _no_lookups() -> pa.Table:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.table({c.split()[0]: pa.array([], kind) for c, kind in zip(_LOOKUP.split(", "), kinds)})


def _pairs(a, b, sizes, nodes, percent: int) -> pa.Table:
    """Distinct pairs of node indexes that lengths allow."""
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    ok = (lo != hi) & (100 * np.minimum(sizes[lo], sizes[hi]) >= percent * np.maximum(sizes[lo], sizes[hi]))
    key = np.unique(lo[ok] * len(nodes) + hi[ok])
    return pa.table({"a": pa.array(nodes[key // max(1, len(nodes))], pa.int64()), "b": pa.array(nodes[key % max(1, len(nodes))], pa.int64())})


def _named(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The least id and row of each component, brought back to the members by way of the nodes."""
    nodes = members.filter("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row")).alias("first"))
    if roots is None:
        named = nodes.select(F.col("node").alias("__n"), F.col("least").alias("component_id"), F.col("first.__row").alias("first_row"))
    else:
        rooted = nodes.join(roots.withColumnRenamed("node", "__n"), F.col("node") == F.col("__n"), "left").select(
            "node", F.coalesce("root", "node").alias("root"), "least", "first")
        least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.min("first").alias("first"))
        named = rooted.select(F.col("node").alias("__n"), "root").join(apart(least, "root"), "root").select("__n", "component_id", F.col("first.__row").alias("first_row"))
    out = members.join(apart(named, "__n"), F.col("node") == F.col("__n"), "left")
    return out.select("__row", "doc_id", "n_shingles", "node", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
                      F.coalesce("first_row", "__row").alias("first_row"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay, one of each component, with all their columns."""
    row, mate, own = fresh(docs, "__row", "__mate", "__own")
    rows = numbered(docs, row)
    stays = similar(rows, row_col=row, **options).filter("__row = first_row").select(F.col("__row").alias(mate), F.col("doc_id").alias(own))
    same = F.col(options.get("id_col", "doc_id")).cast("long").eqNullSafe(F.col(own))
    return rows.join(stays, (F.col(row) == F.col(mate)) & same, "left_semi").drop(row)
