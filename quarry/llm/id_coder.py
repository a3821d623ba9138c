"""Token-id files: an adaptive context-mixing range coder in independent, checksummed blocks.

An id is coded in one step from a mixture of three predictions: the id that last followed the two ids before it
(order 2), the id that last followed the one before it (order 1), and adaptive frequencies of groups of ids
(order 0; ids in a group are alike). The weights adapt to how often predictions of the same confidence were right.
Every block starts anew, so blocks are coded side by side: all blocks of a file advance one id at a time, as vectors.

File: ``MAGIC``; then chunks, each with the documents' ids and counts, and its blocks with their counts, sizes and
crc32. Integers are little-endian. A damaged block fails its checksum when it is read.

Edge cases: null text is empty and holds the end id alone; documents are in ascending doc_id order, null last;
repeated rows are written as often as they occur; an empty table writes no file and reads as no rows; extra columns are ignored.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, mounted, shared_dir, sliced, text_bytes, text_groups
from .tokens import encoder, with_end

MAGIC = b"IDCM2\n"
#: Ids of a block. Larger blocks code a little better (2048 ids by 1% against 1024), and fewer lie side by side.
BLOCK_IDS = 1024
#: Ids of one chunk at most (but for one longer document): they and their models are in memory together.
CHUNK_IDS = 6_000_000
#: Contexts of one order that a block remembers (a power of two).
SLOTS = 256
GROUPS = 64
#: Steps after which order 0's shares are set anew from its counts; at first they are set more often.
REFRESH, EARLY = 32, (4, 8, 16)

_u = np.uint64
_ONE, _BOT, _SHIFT, _TOP = 1 << 16, _u(1 << 48), _u(16), _u(48)
_HALF = 1 << 15
#: How often a prediction of each confidence is right, of 65536, at first.
_START = np.array([0, 12000, 26000, 36000, 44000, 50000, 56000, 60000], dtype=np.int32)
# What a slot's sureness changes by: on a miss (halved) and on a hit (one more, 7 at most).
_STEP = np.array([0, 0, -1, -2, -2, -3, -3, -4, 1, 1, 1, 1, 1, 1, 1, 0], dtype=np.int32)
_RANK = np.arange(GROUPS, dtype=np.int32)


def _count_true(rows: np.ndarray) -> np.ndarray:
    """How many of each row's eight booleans are true."""
    return np.bitwise_count(rows.view(np.uint64)[:, 0]).astype(np.int64)


class _Model:
    """The three predictions for a number of lanes, one for each block."""

    def __init__(self, lanes: int, vocabulary: int):
        # Groups are as wide as a power of two: the leading bits of id + 1, as many as give GROUPS groups at most.
        top = int(vocabulary).bit_length()
        kept = next(m for m in range(5, -1, -1) if sum(1 << min(e, m) for e in range(top)) <= GROUPS)
        exponent = np.repeat(np.arange(top), [1 << min(e, kept) for e in range(top)])
        self.bits = np.maximum(exponent - kept, 0).astype(np.uint64)
        self.edges = np.concatenate(([0], np.cumsum(1 << self.bits.astype(np.int64))))
        self.groups = len(exponent)
        self.group_of = np.repeat(np.arange(self.groups), np.diff(self.edges))
        self.n, self.steps = lanes, 0
        self.base = np.arange(2 * lanes).reshape(2, lanes)
        self.lane = np.arange(lanes)
        self.prev1 = np.zeros(lanes, dtype=np.int64)
        self.prev2 = np.zeros(lanes, dtype=np.int64)
        # Rows are orders 2 and 1. A slot holds the id that came last, times 8, and how sure it is (0: empty).
        self.slots = np.zeros(2 * lanes * SLOTS, dtype=np.int32)
        self.right = np.tile(_START, 2 * lanes)
        self.counts = np.zeros((lanes, GROUPS), dtype=np.int32)
        self.counts[:, : self.groups] = 8
        self._refresh()

    def shrink(self, lanes: int) -> None:
        """The last lanes have ended."""
        self.n = lanes
        for name in ("lane", "prev1", "prev2", "counts"):
            setattr(self, name, getattr(self, name)[:lanes])
        self.base = np.ascontiguousarray(self.base[:, :lanes])
        self._refresh()

    def _refresh(self) -> None:
        """Order 0: shares of 32768 from counts; no share is 0."""
        ends = self.counts.cumsum(axis=1, dtype=np.int64)
        full = np.flatnonzero(ends[:, -1] > _ONE)
        if len(full):
            self.counts[full, : self.groups] = self.counts[full, : self.groups] + 1 >> 1
            ends[full] = self.counts[full].cumsum(axis=1)
        ends *= (((_HALF - GROUPS) << 16) // ends[:, -1])[:, None]
        ends >>= 16
        starts = np.zeros((len(ends), GROUPS + 1), dtype=np.int32)
        starts[:, 1:] = ends
        starts[:, 1:] += _RANK + 1
        self.own = np.diff(starts, axis=1).reshape(-1)
        self.starts = starts[:, :-1].reshape(-1)
        self.rows = self.starts.reshape(-1, 8)
        self.firsts = np.ascontiguousarray(self.starts.reshape(-1, GROUPS)[:, ::8])

    def predict(self) -> None:
        """p: the ids that orders 2 and 1 predict; f2, f1: their parts of 65536, the rest being order 0's."""
        at = self.base * SLOTS
        one = self.prev1 * 40503
        at[0] += (one + self.prev2 * 60493 >> 4) & (SLOTS - 1)
        at[1] += (one >> 3) & (SLOTS - 1)
        self.at = at
        self.entry = self.slots.take(at)
        self.p = self.entry >> 3
        self.c = self.entry & 7
        self.r = self.base * 8
        self.r += self.c
        self.a = self.right.take(self.r)
        a2, a1 = self.a.astype(np.int64)
        share = (_ONE - a2) * a1 >> 16
        both = share * (self.p[0] == self.p[1])
        both *= a2 > 0
        self.f2 = a2 + both
        self.f1 = share - both
        self.f = self.f2 + self.f1

    def update(self, ids: np.ndarray) -> None:
        hit = self.p == ids
        a = self.a
        goal = hit * np.int32(62000)
        goal += np.int32(1024)
        goal -= a
        goal >>= 4
        goal += a
        self.right[self.r] = goal
        # The chance of the empty class stays 0.
        self.right[::8] = 0
        k = hit * np.int32(8)
        k += self.c
        self.slots[self.at] = np.where(k <= 1, (ids * 8 + 1).astype(np.int32), self.entry + _STEP.take(k))
        self.prev2, self.prev1 = self.prev1, ids
        self.steps += 1
        if self.steps % REFRESH == 0 or self.steps in EARLY:
            self._refresh()

    def count(self, at: np.ndarray) -> None:
        self.counts.reshape(-1)[at] += 24

    def locate(self, lanes: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The group that each lane's value of 32768 falls in."""
        value = value[:, None]
        row = _count_true(self.firsts.take(lanes, axis=0) <= value) - 1
        return row * 8 + _count_true(self.rows.take(lanes * 8 + row, axis=0) <= value) - 1


def encode_blocks(ids: np.ndarray, vocabulary: int, block: int = BLOCK_IDS) -> list[bytes]:
    """The code of each block of ids."""
    n = len(ids)
    lanes = -(-n // block)
    if not lanes:
        return []
    grid = np.zeros(lanes * block, dtype=np.int32)
    grid[:n] = ids
    grid = grid.reshape(lanes, block).T.copy()
    last = n - (lanes - 1) * block
    model = _Model(lanes, vocabulary)
    low, span = np.zeros(lanes, dtype=np.uint64), np.full(lanes, (1 << 64) - 1, dtype=np.uint64)
    # An id takes less than four words of 16 bits.
    width = 4 * block + 8
    out, at = np.zeros(lanes * width, dtype=np.uint16), np.arange(lanes) * width

    def add(lo, amount, at):
        lo += amount
        over = np.flatnonzero(lo < amount)
        # A carry goes into the words before, as far as they are full.
        where = at[over]
        while len(where):
            where = where - 1
            out[where] += 1
            where = where[out[where] == 0]

    for t in range(block):
        if t == last:
            model.shrink(lanes - 1)
            if lanes == 1:
                break
        k = model.n
        now = grid[t, :k].astype(np.int64)
        model.predict()
        hit2 = (now == model.p[0]) & (model.f2 > 0)
        hit1 = (now == model.p[1]) & (model.f1 > 0)
        hit1 &= ~hit2
        r = span[:k] >> _SHIFT
        start = np.where(hit2, 0, np.where(hit1, model.f2, model.f)).view(np.uint64)
        part = np.where(hit2, model.f2, np.where(hit1, model.f1, _ONE - model.f)).view(np.uint64)
        start *= r
        part *= r
        rest = np.flatnonzero(~(hit2 | hit1))
        if len(rest):
            ids_ = now.take(rest)
            group = model.group_of.take(ids_)
            cell = rest * GROUPS + group
            r2 = part.take(rest) >> _u(15)
            r3 = r2 * model.own.take(cell).astype(np.uint64) >> model.bits.take(group)
            start[rest] += r2 * model.starts.take(cell).astype(np.uint64) + r3 * (ids_ - model.edges.take(group)).view(np.uint64)
            part[rest] = r3
            model.count(cell)
        add(low[:k], start, at)
        span[:k] = part
        few = np.flatnonzero(part < _BOT)
        while len(few):
            x, y, where = low[few], span[few] << _SHIFT, at[few]
            out[where] = x >> _TOP
            at[few] = where + 1
            low[few] = x << _SHIFT
            span[few] = y
            few = few[y < _BOT]
        model.update(now)
    # One more word tells a number in the last span.
    add(low, (_u(0) - low) & (_BOT - _u(1)), at)
    out[at] = low >> _TOP
    out = out.astype(">u2")
    return [out[k * width : end + 1].tobytes() for k, end in enumerate(at.tolist())]


def decode_blocks(codes: list[bytes], counts: list[int], vocabulary: int) -> np.ndarray:
    """The ids of blocks, all of one length but the last."""
    lanes, block = len(codes), max(counts, default=0)
    if not lanes:
        return np.zeros(0, dtype=np.uint32)
    width = max(map(len, codes)) // 2 + 8
    data = np.frombuffer(b"".join(c.ljust(2 * width, b"\0") for c in codes), dtype=">u2").astype(np.uint64)
    at = np.arange(lanes) * width
    code, span = np.zeros(lanes, dtype=np.uint64), np.full(lanes, (1 << 64) - 1, dtype=np.uint64)
    for _ in range(4):
        code = code << _SHIFT | data[at]
        at += 1
    grid = np.zeros((block, lanes), dtype=np.uint32)
    model = _Model(lanes, vocabulary)
    for t in range(block):
        if t == counts[-1]:
            model.shrink(lanes - 1)
            if lanes == 1:
                break
        k = model.n
        model.predict()
        r = span[:k] >> _SHIFT
        v = (code[:k] // r).view(np.int64)
        miss2, miss = v >= model.f2, v >= model.f
        start = np.where(miss, model.f, model.f2 * miss2).view(np.uint64)
        part = np.where(miss, _ONE - model.f, np.where(miss2, model.f1, model.f2)).view(np.uint64)
        start *= r
        part *= r
        now = np.where(miss2, model.p[1], model.p[0]).astype(np.int64)
        left = code[:k]
        left -= start
        rest = np.flatnonzero(miss)
        if len(rest):
            mine = left.take(rest)
            r2 = part.take(rest) >> _u(15)
            group = model.locate(rest, (mine // r2).astype(np.int32))
            cell = rest * GROUPS + group
            mine -= r2 * model.starts.take(cell).astype(np.uint64)
            r3 = r2 * model.own.take(cell).astype(np.uint64) >> model.bits.take(group)
            inner = mine // r3
            mine -= r3 * inner
            left[rest] = mine
            now[rest] = model.edges.take(group) + inner.view(np.int64)
            part[rest] = r3
            model.count(cell)
        span[:k] = part
        few = np.flatnonzero(part < _BOT)
        while len(few):
            y, where = span[few] << _SHIFT, at[few]
            code[few] = code[few] << _SHIFT | data[where]
            at[few] = where + 1
            span[few] = y
            few = few[y < _BOT]
        grid[t, :k] = now
        model.update(now)
    return grid.T.reshape(-1)[: sum(counts)].astype("<u4")


def write_chunk(f, keys: list[int | None], counts: list[int], ids: np.ndarray, vocabulary: int) -> None:
    size = BLOCK_IDS
    blocks = encode_blocks(ids, vocabulary, size)
    known = np.array([k is not None for k in keys], dtype=np.uint8).tobytes()
    table = np.array([k or 0 for k in keys], dtype="<i8").tobytes() + known + np.array(counts, dtype="<u4").tobytes()
    f.write(struct.pack("<IQIII", len(keys), len(ids), len(blocks), vocabulary, zlib.crc32(table)) + table)
    for k, b in enumerate(blocks):
        f.write(struct.pack("<III", min(size, len(ids) - k * size), len(b), zlib.crc32(b)))
    for b in blocks:
        f.write(b)


def read_chunks(path: str):
    """(doc ids, counts, ids) of each chunk of a file; ValueError where a checksum fails."""
    with open(path, "rb") as f:
        if f.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{path} is no token-id file")
        while head := f.read(24):
            n, total, blocks, vocabulary, crc = struct.unpack("<IQIII", head)
            table = f.read(13 * n)
            if zlib.crc32(table) != crc:
                raise ValueError(f"{path}: a document table is damaged")
            keys = np.frombuffer(table[: 8 * n], dtype="<i8").tolist()
            keys = [k if known else None for k, known in zip(keys, table[8 * n : 9 * n])]
            heads = [struct.unpack("<III", f.read(12)) for _ in range(blocks)]
            codes = [f.read(h[1]) for h in heads]
            for k, (h, c) in enumerate(zip(heads, codes)):
                if zlib.crc32(c) != h[2]:
                    raise ValueError(f"{path}: block {k} is damaged")
            ids = decode_blocks(codes, [h[0] for h in heads], vocabulary)
            if len(ids) != total:
                raise ValueError(f"{path}: {len(ids)} ids instead of {total}")
            yield keys, np.frombuffer(table[9 * n :], dtype="<u4").tolist(), ids


def write_ids(docs: DataFrame, vocabulary: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, list]:
    """Writes all documents' ids, in ascending doc_id order over the files and in them. The folder, and a row per
    file in order: range, path, ids in it."""
    spark = docs.sparkSession
    folder = mounted(shared_dir(spark, "token-ids"))
    n = max(2, docs.rdd.getNumPartitions())
    # As many ranges as input partitions, so a range stays of a size.
    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text"))
    rows = rows.repartitionByRange(n, F.col("key").asc_nulls_last()).sortWithinPartitions(F.col("key").asc_nulls_last(), F.xxhash64("text"))

    def run(tables):
        enc = encoder(vocabulary)
        size = max(enc.model.get_vocab_size(), end_id + 1)
        os.makedirs(folder, exist_ok=True)
        part, tmp, held, total = TaskContext.get().partitionId(), f"{folder}/.{uuid.uuid4().hex}", 0, 0
        keys, counts, parts = [], [], []
        with open(tmp, "wb") as f:
            f.write(MAGIC)

            def flush():
                if keys:
                    write_chunk(f, keys, counts, np.concatenate(parts), size)
                    keys.clear(), counts.clear(), parts.clear()

            for t in sliced(tables, 1):
                buf, edges = text_bytes(t.column(1))
                names = t.column(0).to_pylist()
                for i, j in text_groups(edges):
                    ids, ends = with_end(*enc.ids(buf[edges[i] : edges[j]], edges[i : j + 1] - edges[i]), end_id)
                    if held and held + len(ids) > CHUNK_IDS:
                        flush()
                        held = 0
                    keys += names[i:j]
                    counts += np.diff(ends).tolist()
                    parts.append(ids)
                    held += len(ids)
                    total += len(ids)
            flush()
        # An attempt that fails leaves no file of this name.
        final = f"{folder}/ids-{part:06d}-{uuid.uuid4().hex[:8]}.idcm"
        os.replace(tmp, final)
        yield pa.record_batch([pa.array([part], pa.int32()), pa.array([final]), pa.array([total], pa.int64())], ["range", "path", "n"])

    # One row for each file; later parts of the work read files of these names only.
    files = sorted(rows.mapInArrow(lean(run), "range int, path string, n long").collect())
    return folder, files


def read_ids(spark, files: list) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ids of every document, read from the files."""
    before, listed = 0, []
    for r in files:
        if r.n:
            listed.append((r.path, before))
        before += r.n
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"
    if not listed:
        return spark.createDataFrame([], schema)

    def run(tables):
        for t in tables:
            for path, at in zip(*(c.to_pylist() for c in t.columns)):
                for keys, counts, ids in read_chunks(path):
                    raw = ids.astype("<u4").tobytes()
                    ends = np.cumsum(counts)
                    parts = [raw[4 * (e - c) : 4 * e] for e, c in zip(ends.tolist(), counts)]
                    yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(at + ends - counts, pa.int64()), pa.array(counts, pa.int64()),
                                           pa.array([zlib.crc32(p) for p in parts], pa.int64()), pa.array(parts, pa.binary())],
                                          ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])
                    at += int(ends[-1])

    paths = spark.sparkContext.parallelize(listed, len(listed))
    return spark.createDataFrame(paths, "path string, at long").mapInArrow(lean(run), schema)
