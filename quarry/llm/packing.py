"""Packing by concatenating and cutting.

First pass: every partition's documents are turned into ids, each with the number of ids before it in the
partition, and the partitions' totals are known. Prefix sums over those totals give every document its place in one
global stream. Second pass: the stream is cut at multiples of the window; a document that crosses a cut gives a
boundary record on either side. Only the last window needs padding.

Edge cases: null text is empty and gives the end id alone; repeated rows are packed as often as they occur; any
doc_id, null too, is carried through; an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary, lean, sliced, stored, text_bytes, text_groups
from .tokens import encoder, release, with_end

WINDOW = 1024

_TOKENS = "part int, before long, doc_id long, doc_tokens long, ids binary"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def token_stream(docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every document (16 bits each where the vocabulary allows it), and the ids before it in its partition."""

    def run(tables):
        enc = encoder(vocabulary)
        wide = "<u4" if max(enc.model.get_vocab_size(), end_id + 1) > 1 << 16 else "<u2"
        part, before = TaskContext.get().partitionId(), 0
        for table in sliced(tables, 1):
            buf, edges = text_bytes(table.column(1))
            for i, j in text_groups(edges):
                ids, ends = with_end(*enc.ids(buf[edges[i] : edges[j]], edges[i : j + 1] - edges[i]), end_id)
                yield pa.record_batch([pa.array(np.full(j - i, part, dtype=np.int32)), pa.array(before + ends[:-1]), table.column(0).slice(i, j - i),
                                       pa.array(np.diff(ends)), binary(ids.astype(wide), ends)], ["part", "before", "doc_id", "doc_tokens", "ids"])
                before += int(ends[-1])
        release()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(lean(run), _TOKENS)


def pack(docs: DataFrame, vocabulary: str, end_id: int = 0, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: its document, the ids before it there, its place (sequence_id, offset), crc32 and ids."""
    stream = stored(token_stream(docs, vocabulary, end_id, id_col, text_col), "pack-stream")
    # One number for each partition of the input: its size doesn't depend on the documents.
    totals = {r.part: r.n for r in stream.groupBy("part").agg(F.sum("doc_tokens").alias("n")).collect()}
    base = np.zeros(max(totals, default=0) + 2, dtype=np.int64)
    for part, n in totals.items():
        base[part + 1] = n
    bases = docs.sparkSession.sparkContext.broadcast(np.cumsum(base))

    def cut(tables):
        for table in sliced(tables, 4, 1 << 20):
            out = [[] for _ in range(8)]
            for part, before, doc_id, n, raw in zip(*(c.to_pylist() for c in table.columns)):
                ids = np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * n else "<u4").astype("<u4").tobytes()
                at, start = int(bases.value[part]) + before, 0
                while start < n:
                    take = min(window - at % window, n - start)
                    piece = ids[4 * start : 4 * (start + take)]
                    for column, value in zip(out, (doc_id, start, take, zlib.crc32(piece), n, at // window, at % window, piece)):
                        column.append(value)
                    start, at = start + take, at + take
            yield pa.record_batch([pa.array(c, pa.binary() if k == 7 else pa.int64()) for k, c in enumerate(out)],
                                  ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    return stream.select("part", "before", "doc_id", "doc_tokens", "ids").mapInArrow(lean(cut), _PIECES)


def sequences(pieces: DataFrame) -> DataFrame:
    """Whole windows from their pieces: sequence_id, n_tokens and ids. A window has at most its size of pieces."""
    return pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"),
        F.aggregate(F.sort_array(F.collect_list(F.struct("offset", "ids"))), F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
    )
