"""Pairs of near vectors against all products, and the query against its SQL where a second rounding would show."""

import duckdb
import numpy as np

from quarry.operators import vector_pairs
from quarry.plans import corpus


def test_all_pairs_over_blocks(spark):
    rng = np.random.default_rng(3)
    heart = rng.normal(size=(6, 8))
    v = heart[rng.integers(0, 6, 400)] + rng.normal(scale=0.15, size=(400, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    label = [None if i % 50 == 0 else "large" if i % 3 else f"small{i % 5}" for i in range(400)]
    rows = [(i, label[i], [float(x) for x in v[i]]) for i in range(400)]
    rows += [(1000 + i, f"alone{i}", rows[1][2]) for i in range(30)] + [(2000, "large", None), (2001, "large", [None] * 8), (2002, "large", []), (2003, "large", [1.0]), (2004, "large", [1.0])]
    frame = spark.createDataFrame(rows, "id long, label string, v array<double>").repartition(3)
    product = np.round(v @ v.T, 6)
    want = {(i, j) for i in range(400) for j in range(i + 1, 400) if label[i] is not None and label[i] == label[j] and product[i, j] > 0.92} | {(2003, 2004)}
    for held in (1 << 22, 8 * 8 * 37):  # one block a label, several
        found = [tuple(r) for r in vector_pairs.near_pairs(frame, 0.92, held).collect()]
        assert len(found) == len(want) and {(a, b) for a, b, _ in found} == want
        assert all(b == 2004 or abs(c - v[a] @ v[b]) < 1e-12 for a, b, c in found)


def test_cosine_is_rounded_once(spark, tmp_path):
    rng = np.random.default_rng(4)
    heart = rng.normal(size=(4, 16))
    v = heart[rng.integers(0, 4, 600)] + rng.normal(scale=0.2, size=(600, 16))
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    spark.createDataFrame([(i, i % 3, [float(x) for x in v[i]]) for i in range(600)], "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    embeddings = duckdb.sql(f"SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")  # noqa: F841
    want = sorted(duckdb.sql(corpus.ORACLE_SQL["semantic_dedup_cosine"]).fetchall())
    assert want and sorted(tuple(r) for r in corpus.QUERIES["semantic_dedup_cosine"](spark, str(tmp_path)).collect()) == want
