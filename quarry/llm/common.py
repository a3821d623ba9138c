"""What the operators of this subpackage share: word rules, vectorised hashing, the shared folder."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes that are none of these: space, and tab to carriage return.
WORD_BREAKS = b" \t\n\x0b\x0c\r"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_U = np.uint64


def crc_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. Texts that Unicode lower-casing treats alike skip the slow mapping."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir. The setting is read from the session; where it is unset and
    everything runs in one process (tests), a folder in the working directory is set. On a cluster it must be set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + os.path.abspath("spark-warehouse/shared")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def mounted(path: str) -> str:
    """The path by which Python opens a file of the shared folder. Memory mapping needs a mounted file system."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"memory-mapped arrays need a mounted shared folder in spark.checkpoint.dir, not {path}")
    return path


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Names like these that docs has no column of."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read again: lineage ends here, lost executors cost no rerun."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame, column: str) -> DataFrame:
    """docs with a number for each row that is the same whenever the rows are read, and whatever the cluster has become
    by then: in a Parquet scan it is made of the row's file and place in it; any other docs are stored first. Two rows
    have one number with a chance of 2**-64, so rows are told apart by it and their id together."""

    def placed(df: DataFrame) -> DataFrame:
        place = df.metadataColumn("_metadata")
        return df.withColumn(column, F.xxhash64(place["file_path"], place["row_index"]))

    try:
        out = placed(docs)
        _ = out.schema
    except AnalysisException:  # no Parquet scan
        out = placed(stored(docs, "numbered"))
    return out


def apart(df: DataFrame, *keys: str) -> DataFrame:
    """df, dealt out once more, evenly: a join on keys then stands in another stage than the aggregate or window that
    made df, and Spark can split a hot key of the other side."""
    return df.repartition(F.xxhash64(*keys))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_STEP = 0x9E3779B97F4A7C15 | 1
_STEP_INV = pow(_STEP, -1, 1 << 64)
_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1B54A32D192ED03))
BREAK = np.zeros(256, dtype=bool)
BREAK[list(WORD_BREAKS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, step in enumerate((_STEP, _STEP_INV)):
            x = np.full(max(n, 1 << 20), step, dtype=np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[start:end]. Equal spans have equal hashes; two different ones meet with a chance of
    2**-64. A polynomial over the bytes, taken for all spans at once from its prefix sums."""
    up, down = _power(len(buf))
    sums = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_TABLE[buf] * up, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _U(0x2545F4914F6CDD1D))


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start and size, end to end."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column of texts, end to end, and their edges; null is the empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    edges = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return buf[edges[0] : edges[-1]], edges - edges[0]


def sliced(tables, column: str | int, limit: int = 1 << 22):
    """The tables in slices of at most limit bytes of a text column, or one row: what is made of them in Python stays small."""
    for t in tables:
        sizes = pc.fill_null(pc.binary_length(t.column(column)), 0).to_numpy(zero_copy_only=False)
        for i, j in text_groups(np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), limit):
            yield t.slice(i, j - i)


def binary(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """values[edges[i]:edges[i + 1]] as bytes, a row for each i."""
    offsets = (edges * values.itemsize).astype(np.int64 if len(values) * values.itemsize >= 1 << 31 else np.int32)
    kind = pa.binary() if offsets.dtype == np.int32 else pa.large_binary()
    return pa.Array.from_buffers(kind, len(edges) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def text_groups(edges: np.ndarray, limit: int = 1 << 20):
    """Ranges (first, end) of consecutive texts with at most limit bytes, or one text."""
    i, n = 0, len(edges) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(edges, edges[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def word_hashes(texts: list[bytes | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, in order; offsets of each text's words (len(texts) + 1);
    and the words' lengths in bytes. Equal words have equal hashes; two different ones meet with a chance of
    2**-64."""
    texts = [t or b"" for t in texts]
    buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    if lower:
        buf = _LOWER[buf]
    gap = BREAK[buf]
    inner = ~gap
    starts = np.flatnonzero(inner & np.concatenate(([True], gap[:-1])))
    ends = np.flatnonzero(gap & np.concatenate(([False], inner[:-1])))
    edges = np.cumsum([0] + [len(t) + 1 for t in texts])
    return span_hashes(buf, starts, ends), np.searchsorted(starts, edges), ends - starts


def words_of(buf: np.ndarray, edges: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of the texts buf[edges[i]:edges[i + 1]], in order, as ``word_hashes`` gives them, and
    the offsets of each text's words."""
    if not len(buf):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(edges), dtype=np.int64)
    buf = _LOWER[buf] if lower else buf
    gap = BREAK[buf]
    first, last = np.concatenate(([True], gap[:-1])), np.concatenate((gap[1:], [True]))
    full = np.flatnonzero(np.diff(edges) > 0)
    first[edges[full]] = True
    last[edges[full + 1] - 1] = True
    starts, ends = np.flatnonzero(~gap & first), np.flatnonzero(~gap & last) + 1
    return span_hashes(buf, starts, ends), np.searchsorted(starts, edges)


def batches(rows, limit: int = 1 << 20):
    """Groups of consecutive items (key, text) with at most limit bytes of text, or one item."""
    group, size = [], 0
    for row in rows:
        n = len(row[-1] or b"")
        if group and size + n > limit:
            yield group
            group, size = [], 0
        group.append(row)
        size += n
    if group:
        yield group


def lean(run):
    """A function for mapInArrow whose worker gives freed memory back to the system when its task ends: workers live
    on for other work, beside it."""

    def inner(tables):
        try:
            yield from run(tables)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):
                pass  # only glibc has it

    return inner
