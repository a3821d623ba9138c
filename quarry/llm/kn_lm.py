"""Language-model scoring: an interpolated modified Kneser-Ney n-gram model.

Counting is a Spark job: partitions combine their n-grams, ranges of contexts add them up, and each order hands its
distinct n-grams to the order below, whose counts are continuation counts. Every range is one file in the shared folder:
sorted arrays of n-gram hashes with their counts and context totals. To score, workers map those files into memory and
find a batch's n-grams by binary search, so a model need not fit into memory.

In its range an n-gram is told apart by 48 bits of its hash: one that was never seen is taken for one that was with a
chance of n / 2**48 in a range of n. Words and contexts are told apart by 64 bits. A context that was seen once is not
stored: it is known by its own n-gram, one order below. Files are written under another name and then renamed: an attempt
that is repeated writes the same bytes, a reader never sees half a file, and a range's file that is missing is an error.

Edge cases: null text is empty, one end token; words are split at ASCII white space after lower-casing A-Z; texts that
repeat are counted and scored as often as they occur; with nothing to learn from, every token has probability 1
(an empty vocabulary plus one); extra columns stay, but for those of the results' names, which are replaced.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, mix, mounted, shared_dir, sliced, text_bytes, text_groups, words_of

#: Orders beyond this need more disk than the check tool allows on texts of many rare words; see the README for figures.
ORDER = 2
#: Tokens that a partition combines at once before it hands them on; bytes of text that are scored together.
COMBINE_TOKENS, SCORE_BYTES = 2_000_000, 1 << 21

_U = np.uint64
BEGIN, END = _U(0xB5297A4D3F84D5B5), _U(0x68E31DA41B56C4E9)
_BLOBS = "bucket int, level int, data binary"


def chain(context: np.ndarray | np.uint64, word: np.ndarray) -> np.ndarray:
    """The hash of an n-gram from that of its first words and its last word."""
    return mix(context * _U(0x9E3779B97F4A7C15) + word)


def chains(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of contexts and of n-grams, whose words are given by place."""
    key = np.zeros(len(words[0]), dtype=np.uint64)
    for w in words[:-1]:
        key = chain(key, w)
    return key, chain(key, words[-1])


def token_stream(buf: np.ndarray, edges: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts with order-1 begin marks before and an end after each; the texts' offsets."""
    hashes, words = words_of(buf, edges)
    counts = np.diff(words)
    offsets = np.concatenate(([0], np.cumsum(counts + order)))
    seq = np.full(offsets[-1], BEGIN, dtype=np.uint64)
    owner = np.repeat(np.arange(len(counts)), counts)
    seq[np.arange(len(hashes)) - words[owner] + offsets[owner] + order - 1] = hashes
    seq[offsets[1:] - 1] = END
    return seq, offsets


def ngrams(seq: np.ndarray, offsets: np.ndarray, order: int) -> list[np.ndarray]:
    """Words by place of the n-gram that ends at each token (begin marks are no tokens)."""
    ends = np.ones(len(seq), dtype=bool)
    for k in range(order - 1):
        ends[offsets[:-1] + k] = False
    at = np.flatnonzero(ends)
    return [seq[at - order + 1 + k] for k in range(order)]


def _small(values: np.ndarray) -> bytes:
    """Counts, most of which fit one byte."""
    big = values >= 255
    return np.where(big, 255, values).astype(np.uint8).tobytes() + values[big].astype("<u8").tobytes()


def _from_small(data: bytes, n: int) -> tuple[np.ndarray, int]:
    values = np.frombuffer(data[:n], dtype=np.uint8).astype(np.int64)
    big = np.flatnonzero(values == 255)
    values[big] = np.frombuffer(data[n : n + 8 * len(big)], dtype="<u8").astype(np.int64)
    return values, n + 8 * len(big)


def combine(words: list[np.ndarray], cont: np.ndarray, raw: np.ndarray):
    """Adds up equal n-grams; sorted by context, then n-gram. Contexts, keys, words, cont, raw."""
    context, key = chains(words)
    order = np.argsort(key) if len(words) == 1 else np.lexsort((key, context))
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, dtype=np.int64)
    add = (lambda x: np.add.reduceat(x[order], first)) if len(first) else (lambda x: x)
    pick = order[first]
    return context[pick], key[first], [w[pick] for w in words], add(cont), add(raw)


def _pack(context: np.ndarray, words: list[np.ndarray], cont: np.ndarray, raw: np.ndarray) -> bytes:
    """Rows sorted by context: its distinct words, then by their numbers each context's words once for its run, and the
    last words; then lengths of runs and counts, a byte each where that will do."""
    n, width = len(context), len(words)
    first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1]))) if width > 1 else np.zeros(0, dtype=np.int64)
    same = bool((cont == raw).all())
    if width == 1:
        known, body = words[0], b""
    else:
        known, number = np.unique(np.concatenate([w[first] for w in words[:-1]] + [words[-1]]), return_inverse=True)
        body = number.astype("<u2" if len(known) <= 1 << 16 else "<u4").tobytes() + _small(np.diff(np.append(first, n)))
    head = np.array([n, len(first), width, same, len(known)], dtype="<u8").tobytes()
    return head + known.tobytes() + body + _small(raw) + (b"" if same else _small(cont))


def _unpack(data: bytes):
    n, m, width, same, distinct = np.frombuffer(data[:40], dtype="<u8").astype(np.int64).tolist()
    known = np.frombuffer(data[40 : 40 + 8 * distinct], dtype=np.uint64)
    at = 40 + 8 * distinct
    if width == 1:
        words = [known]
    else:
        kind = np.dtype("<u2" if distinct <= 1 << 16 else "<u4")
        size = (width - 1) * m + n
        number = np.frombuffer(data[at : at + kind.itemsize * size], dtype=kind)
        at += kind.itemsize * size
        runs, used = _from_small(data[at:], m)
        at += used
        words = [np.repeat(known[number[k * m : (k + 1) * m]], runs) for k in range(width - 1)] + [known[number[(width - 1) * m :]]]
    raw, used = _from_small(data[at:], n)
    cont = raw if same else _from_small(data[at + used :], n)[0]
    return words, cont, raw


def _dealt(words, cont, raw, buckets: int, level: int):
    """A record batch of packed rows for each range of contexts (of words, at level 1)."""
    context, key, words, cont, raw = combine(words, cont, raw)
    by = context if level > 1 else key
    bucket = ((by >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
    edges = np.searchsorted(bucket, np.arange(buckets + 1))
    rows = [(b, _pack(context[lo:hi], [w[lo:hi] for w in words], cont[lo:hi], raw[lo:hi]))
            for b, (lo, hi) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())) if hi > lo]
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "level": pa.array([level] * len(rows), pa.int32()),
                     "data": pa.array([r[1] for r in rows], pa.binary())})


_KINDS = [np.dtype(x) for x in ("u1", "<u4", "<u8", "<f8")]


def _save(path: str, arrays: list[np.ndarray]) -> None:
    """One file: for each array its kind and size, then their bytes, each from a multiple of eight on."""
    tmp = f"{path}.{uuid.uuid4().hex}"
    with open(tmp, "wb") as f:
        f.write(np.array([len(arrays), *(x for a in arrays for x in (_KINDS.index(a.dtype), a.size))], dtype="<u8").tobytes())
        for a in arrays:
            f.write(a.tobytes() + bytes(-a.nbytes % 8))
    os.replace(tmp, path)


def _load(path: str) -> list[np.ndarray]:
    data = np.memmap(path, dtype="u1", mode="r")
    n = int(data[:8].view("<u8")[0])
    head = data[8 : 8 + 16 * n].view("<u8").astype(np.int64).reshape(n, 2).tolist()
    at, out = 8 + 16 * n, []
    for kind, size in head:
        width = _KINDS[kind].itemsize * size
        out.append(data[at : at + width].view(_KINDS[kind]))
        at += width + -width % 8
    return out


def _sorted(keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The order of keys by 16 middle bits and the last 32; a directory of the first of these, and the others."""
    kept = min(16, max(0, len(keys).bit_length() - 5))
    slot = (keys >> _U(32) & _U(0xFFFF)) >> _U(16 - kept)
    low = (keys & _U(0xFFFFFFFF)).astype("<u4")
    order = np.lexsort((low, slot))
    return order, [np.searchsorted(slot[order], np.arange((1 << kept) + 1)).astype("<u4"), low[order]]


def _seek(directory: np.ndarray, lows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each key, and whether it is there: a binary search in each key's part of the directory."""
    kept = (len(directory) - 1).bit_length() - 1
    slot = ((keys >> _U(32) & _U(0xFFFF)) >> _U(16 - kept)).astype(np.int64)
    want = (keys & _U(0xFFFFFFFF)).astype("<u4")
    at = directory[slot].astype(np.int64)
    left = directory[slot + 1].astype(np.int64) - at
    some = left > 0
    for _ in range(int(left.max(initial=1)).bit_length()):
        half = left >> 1
        at += half * (lows[np.minimum(at + half, len(lows) - 1)] <= want) * (half > 0)
        left -= half
    at = np.minimum(at, len(lows) - 1)
    return at, some & (lows[at] == want)


def _bytes(values: np.ndarray) -> list[np.ndarray]:
    """Counts of a byte each, 255 for those that stand in the two arrays after it: their places, their values."""
    big = np.flatnonzero(values >= 255)
    return [np.minimum(values, 255).astype("u1"), big.astype("<u4"), values[big].astype("<u8")]


def _whole(parts: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    values = parts[0][at].astype(np.float64)
    big = np.flatnonzero(values == 255)
    if len(big):
        values[big] = parts[2][np.searchsorted(parts[1], at[big])]
    return values


def _kinds(counts: np.ndarray, n: int) -> list[int]:
    return [int((counts == k).sum()) for k in range(1, n + 1)]


def _path(folder: str, level: int, bucket: int) -> str:
    return f"{folder}/{level}-{bucket:06d}.kn"


def _store(folder: str, level: int, bucket: int, words, cont, raw) -> tuple:
    """Writes a range's file; the combined rows, and the range's sums."""
    context, key, words, cont, raw = combine(words, cont, raw)
    os.makedirs(folder, exist_ok=True)
    order, arrays = _sorted(key)
    arrays += _bytes(cont[order])
    if level == 1:
        arrays += _bytes(raw[order])
    else:
        first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
        totals = np.stack([np.add.reduceat(x.astype(np.int64), first) for x in (cont, cont == 1, cont == 2, cont >= 3)], axis=1)
        # A context of one n-gram, seen once, is told by its own n-gram one order below; one that ends with a mark is none.
        held = (totals[:, 0] > 1) | (totals[:, 1] != 1) | (words[-2][first] == BEGIN)
        order, found = _sorted(context[first][held])
        totals = totals[held][order]
        big = np.flatnonzero((totals >= 255).any(axis=1))
        small = np.minimum(totals, 254).astype("u1")
        small[big, 0] = 255
        arrays += found + [small.reshape(-1), big.astype("<u4"), totals[big].astype("<f8").reshape(-1)]
    _save(_path(folder, level, bucket), arrays)
    return words, cont, raw, np.array([*_kinds(cont, 4), int((cont >= 3).sum()), cont.sum(), raw.sum(), len(key)], dtype="<i8")


class Trained:
    """Where a model is, and its few global numbers. sums: of each range that was written, by level and bucket."""

    def __init__(self, folder: str, order: int, buckets: int, sums: dict[tuple[int, int], np.ndarray]):
        self.folder, self.order, self.buckets = folder, order, buckets
        self.written = np.zeros((order + 1, buckets), dtype=bool)
        for at in sums:
            self.written[at] = True
        self.discounts, self.root, self.tokens, self.words = {}, (0, 0, 0, 0), 0, 0
        for level in range(1, order + 1):
            n = sum((x for (at, _), x in sums.items() if at == level), np.zeros(8, dtype=np.int64))
            n1, n2, n3, n4 = n[:4].tolist()
            y = n1 / (n1 + 2 * n2) if n1 else 0.5
            raw = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
            self.discounts[level] = tuple(min(max(d, 0.05), k + 0.95) for k, d in enumerate(raw))
            if level == 1:
                self.root = (int(n[5]), n1, n2, int(n[4]))
                self.tokens, self.words = int(n[6]), int(n[7])

    def arrays(self, level: int, bucket: int) -> list[np.ndarray] | None:
        """A range's arrays; None for a range that holds nothing."""
        if not self.written[level, bucket]:
            return None
        path = _path(self.folder, level, bucket)
        if path not in _maps:
            if len(_maps) > 4096:
                _maps.clear()
            _maps[path] = _load(path)
        return _maps[path]

    def find(self, level: int, context: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each n-gram: its count, and at level 1 its raw count, 0 where it is not there; and its context's totals
        as far as they are stored."""
        by = context if level > 1 else key
        bucket = ((by >> _U(32)) * _U(self.buckets) >> _U(32)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        count, raw, totals = np.zeros(len(by)), np.zeros(len(by) if level == 1 else 0), np.zeros((len(by) if level > 1 else 0, 4))
        for b in np.flatnonzero(np.diff(edges)).tolist():
            held = self.arrays(level, b)
            if held is None:
                continue
            mine = order[edges[b] : edges[b + 1]]
            at, hit = _seek(held[0], held[1], key[mine])
            at, some = at[hit], mine[hit]
            count[some] = _whole(held[2:5], at)
            if level == 1:
                raw[some] = _whole(held[5:8], at)
            elif len(held[6]):
                at, hit = _seek(held[5], held[6], context[mine])
                at, some = at[hit], mine[hit]
                found = held[7].reshape(-1, 4)[at].astype(np.float64)
                big = np.flatnonzero(found[:, 0] == 255)
                if len(big):
                    found[big] = held[9].reshape(-1, 4)[np.searchsorted(held[8], at[big])]
                totals[some] = found
        return count, raw, totals

    def _share(self, level: int, counts: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The discounted part of each probability, and the weight of the order below."""
        d = self.discounts[level]
        cut = np.where(counts >= 3, d[2], np.where(counts == 2, d[1], np.where(counts == 1, d[0], 0.0)))
        total, n1, n2, n3 = (totals[..., k] for k in range(4))
        seen = total > 0
        safe = np.where(seen, total, 1.0)
        return np.where(seen, (counts - cut) / safe, 0.0), np.where(seen, (d[0] * n1 + d[1] * n2 + d[2] * n3) / safe, 1.0)

    def score(self, buf: np.ndarray, text_edges: np.ndarray) -> list[np.ndarray]:
        """Tokens, known tokens, the base score and the model's log10 probability of each text."""
        seq, offsets = token_stream(buf, text_edges, self.order)
        grams = ngrams(seq, offsets, self.order)
        counts = np.diff(offsets) - (self.order - 1)
        edges = np.concatenate(([0], np.cumsum(counts)))
        p = np.full(edges[-1], 1.0 / (self.words + 1))
        raw, known = np.zeros(len(p)), np.zeros(len(p), dtype=bool)
        for level in range(1, self.order + 1):
            context, key = chains(grams[self.order - level :])
            cont, found, totals = self.find(level, context, key)
            if level == 1:
                raw = found
                totals = np.array(self.root, dtype=np.float64)[None, :]
            else:
                # A context that is an n-gram of the order below and has no totals stored was seen once.
                once = np.concatenate(([False], known[:-1]))
                once[edges[:-1]] = False
                totals[once & (totals[:, 0] == 0)] = (1, 1, 0, 0)
            part, rest = self._share(level, cont, totals)
            p, known = part + rest * p, cont > 0
        base = np.log10((raw + 0.5) / (self.tokens + 0.5 * (self.words + 1)))
        return [counts, *(np.add.reduceat(x, edges[:-1]) for x in ((raw > 0).astype(np.int64), base, np.log10(p)))]


_maps: dict[str, list[np.ndarray]] = {}


def train(docs: DataFrame, text_col: str = "text", order: int = ORDER) -> Trained:
    """Counts all texts of docs and stores the model."""
    folder = mounted(shared_dir(docs.sparkSession, "kn-lm"))
    # Ranges follow the number of input partitions, so each stays of a size.
    buckets = max(8, 2 * docs.rdd.getNumPartitions())

    def count(tables):
        held, size = [], 0

        def flush():
            words = [np.concatenate([h[k] for h in held]) for k in range(order)]
            ones = np.ones(len(words[0]), dtype=np.int64)
            held.clear()
            return _dealt(words, ones, ones, buckets, order).to_batches()

        for t in sliced(tables, 0):
            buf, edges = text_bytes(t.column(0))
            for i, j in text_groups(edges):
                held.append(ngrams(*token_stream(buf[edges[i] : edges[j]], edges[i : j + 1] - edges[i], order), order))
                size += len(held[-1][0])
                if size >= COMBINE_TOKENS:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    def add(level: int):
        def run(key, table):
            bucket, levels, data = key[0].as_py(), table.column("level").to_pylist(), table.column("data").to_pylist()
            # Sums of ranges of higher orders, under their levels below 0, only pass through.
            done = [(k, x) for k, x in zip(levels, data) if k < 0]
            parts = [_unpack(x) for k, x in zip(levels, data) if k > 0]
            out = []
            if parts:
                words = [np.concatenate([p[0][k] for p in parts]) for k in range(level)]
                cont, raw = (np.concatenate([p[k] for p in parts]) for k in (1, 2))
                del parts, data, table
                words, cont, raw, sums = _store(folder, level, bucket, words, cont, raw)
                done.append((-level, sums.tobytes()))
                if level > 1:
                    # Each distinct n-gram is one continuation of what remains without its first word.
                    out = [_dealt(words[1:], np.ones(len(cont), dtype=np.int64), raw, buckets, level - 1)]
            told = pa.table({"bucket": pa.array([bucket] * len(done), pa.int32()), "level": pa.array([x[0] for x in done], pa.int32()), "data": pa.array([x[1] for x in done], pa.binary())})
            return pa.concat_tables([*out, told])

        return run

    rows = docs.select(F.col(text_col).cast("string")).mapInArrow(lean(count), _BLOBS)
    for level in range(order, 0, -1):
        rows = rows.groupBy("bucket").applyInArrow(add(level), _BLOBS)
    os.makedirs(folder, exist_ok=True)
    # A row of eight numbers for each range and order.
    sums = {(-r.level, r.bucket): np.frombuffer(r.data, dtype="<i8") for r in rows.collect()}
    return Trained(folder, order, buckets, sums)


def score(docs: DataFrame, model: Trained, text_col: str = "text") -> DataFrame:
    """docs with n_tokens, n_known, base_score and score."""
    docs = docs.drop("n_tokens", "n_known", "base_score", "score")  # columns of these names are replaced
    names = docs.columns

    def run(tables):
        for t in sliced(tables, text_col):
            buf, edges = text_bytes(t.column(text_col))
            found = [model.score(buf[edges[i] : edges[j]], edges[i : j + 1] - edges[i]) for i, j in text_groups(edges, SCORE_BYTES)]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
            columns = [pa.array(np.concatenate([x[k] for x in found]) if found else [], kind) for k, kind in enumerate(kinds)]
            yield pa.record_batch([*t.columns, *columns], [*names, "n_tokens", "n_known", "base_score", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(lean(run), f"{fields}, n_tokens long, n_known long, base_score double, score double")


def train_and_score(docs: DataFrame, held_out: Column, text_col: str = "text", order: int = ORDER) -> DataFrame:
    """All of docs, scored by a model of those rows that aren't held out."""
    model = train(docs.filter(~held_out), text_col, order)
    return score(docs, model, text_col).withColumn("train_tokens", F.lit(model.tokens).cast("long"))
