"""Pairs of vectors of one label whose product is large: all of them, exactly.

Without clusters no pair can be ruled out before its product is known, so the work is that of all pairs of a label. Labels are
cut into blocks of bounded size, small ones share a group; a task holds two blocks and takes their products as a matrix, in strips.
A row is sent once for each block of its label. Pairs near the bound are multiplied again, in the order of their entries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a block as doubles, products made at once, bytes of pairs multiplied again at once.
BLOCK_BYTES, STRIP, AGAIN_BYTES = 1 << 22, 1 << 20, 1 << 25


def near_pairs(vectors: DataFrame, least: float, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """a, b, cosine of the pairs a < b of one label with a product over least, taken to six decimals. vectors: id, label, v (of
    unit length). A null label or vector, or a null entry, has no pairs; vectors of different lengths have none either. cosine isn't rounded."""
    kind, v = dict(vectors.dtypes)["id"], F.col("v")
    rows = vectors.select("id", "label", F.transform(v, lambda x: x.cast("double")).alias("v"), F.size(v).alias("dim"))
    rows = rows.filter(F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull()))
    counts = rows.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))
    size = F.greatest(F.lit(1), F.expr(f"{block_bytes} div (8 * greatest(1, dim))"))
    groups = counts.agg(F.ceil(F.coalesce(F.sum(F.col("n") / size), F.lit(1))).alias("groups")).first()["groups"]
    # At most as many rows as there are blocks.
    large = counts.filter(F.col("n") > size).select("label", "dim", F.ceil(F.col("n") / size).cast("int").alias("blocks"))
    dealt = rows.join(F.broadcast(large), ["label", "dim"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    mark = F.xxhash64("label", "dim")
    home = F.when(F.col("blocks") > 1, mark).otherwise(F.pmod(mark, F.lit(groups)))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    sent = dealt.select(home.alias("home"), "id", "label", "v", "block", other.alias("other"))
    sent = sent.select("home", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "label", "v", "block")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches).combine_chunks()
        low, high, block = (t.column(c).to_numpy() for c in ("i", "j", "block"))
        ids, held = t.column("id").combine_chunks(), t.column("v").combine_chunks()
        label = t.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
        dims = np.diff(held.offsets.to_numpy())
        for mark in np.unique(np.stack([label, dims]), axis=1).T:
            own = (label == mark[0]) & (dims == mark[1])
            left, right = (np.flatnonzero(own & (block == side)) for side in (low, high))
            x, y = (held.take(pa.array(at)).flatten().to_numpy().reshape(len(at), mark[1]) for at in (left, right))
            for p, q, cosine in _near(x, y, least, low[0] == high[0]):
                yield pa.record_batch([ids.take(pa.array(left[p])), ids.take(pa.array(right[q])), pa.array(cosine)], ["p", "q", "cosine"])

    found = sent.groupBy("home", "i", "j").applyInArrow(pairs, f"p {kind}, q {kind}, cosine double")
    found = found.filter((F.col("p") != F.col("q")) & (F.round("cosine", 6) > least))
    return found.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "cosine")


def _near(x: np.ndarray, y: np.ndarray, least: float, same: bool):
    """Places in x and y whose product may be over least when rounded, and the product; of x with itself each pair once."""
    lengths = [np.linalg.norm(m, axis=1) for m in (x, y)]
    most = [max(n[np.isfinite(n)], default=0.0) for n in lengths]
    limit = least - 1e-6 - 1e-13 * x.shape[1] * most[0] * most[1]
    step, again = max(1, STRIP // max(1, len(y))), max(1, AGAIN_BYTES // (8 * max(1, x.shape[1])))
    for i in range(0, len(x), step):
        start = i if same else 0
        # A product that is no number is looked at again.
        p, q = np.nonzero(~(x[i : i + step] @ y[start:].T < limit))
        p, q = p + i, q + start
        if same:
            p, q = p[p < q], q[p < q]
        for k in range(0, len(p), again):
            a, b = p[k : k + again], q[k : k + again]
            products, total = x[a] * y[b], np.zeros(len(a))
            for d in range(x.shape[1]):
                total += products[:, d]
            yield a, b, total
