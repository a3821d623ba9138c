"""The vector index against brute force: exact search, recall of probed cells, filters, passes, unusable vectors."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import search, vector_index
from quarry.operators.vector_index import VectorIndex

SCHEMA = "doc_id long, embedding array<float>, kind string, day date, score double"


@pytest.fixture(scope="module")
def rows():
    """Clusters of very unlike size, a group of copies, and rows that can't be used."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 16)) * 3
    x = np.concatenate([c + rng.normal(size=(n, 16)) for c, n in zip(centres, [900, 300] + [60] * 10)]).astype(np.float32)
    out = [(i, [float(c) for c in v], ("a", "b", None)[i % 3], None if i % 50 == 7 else datetime.date(2024, 1, 1 + i % 28), 0.5) for i, v in enumerate(x)]
    out += [(5000 + i, out[4][1], "a", datetime.date(2024, 1, 9), 0.5) for i in range(300)]
    bad = [None, [], [1.0] * 15 + [None], [float("nan")] * 16, [float("inf")] + [0.0] * 15, [1.0]]
    return out + [(9000 + i, v, "a", None, None) for i, v in enumerate(bad)]


@pytest.fixture(scope="module")
def vectors(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("v") / "v")
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def index(vectors):
    return VectorIndex(vectors, keep=("kind", "day"), k=10)


def brute(rows, asked, k, fits=lambda q, r: True):
    good = [r for r in rows if r[1] and len(r[1]) == 16 and all(c is not None and math.isfinite(c) for c in r[1])]
    m = np.array([r[1] for r in good])
    out = set()
    for q in asked:
        s = np.round(m @ np.array(q[1]), 6)
        order = sorted((-v, r[0]) for v, r in zip(s.tolist(), good) if fits(q, r))[:k]
        out |= {(q[0], i, round(-v, 4), n + 1) for n, (v, i) in enumerate(order)}
    return out


def got(found):
    rows = found.collect()
    out = {(r.query_id, r.doc_id, round(r.score, 4), r["rank"]) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("held, scores", [(1 << 25, 1 << 22), (2000, 500)])
def test_exact(spark, rows, index, monkeypatch, held, scores):
    monkeypatch.setattr(vector_index, "HELD_BYTES", held)
    monkeypatch.setattr(vector_index, "BLOCK_SCORES", scores)
    asked = [(f"q{i}", rows[i][1]) for i in range(0, len(rows) - 6, 40)]
    q = spark.createDataFrame(asked + [("none", None), ("short", [1.0])], "query_id string, query array<float>")
    for k in (1, 10):
        assert got(index.search(q, k, exact=True)) == brute(rows, asked, k)
    assert got(index.search(q, 3, probes=1, exact=True)) == brute(rows, asked, 3)


def test_recall_of_probed_cells(spark, rows, index):
    asked = [(i, rows[i][1]) for i in range(0, len(rows) - 6, 20)]
    q = spark.createDataFrame(asked, "query_id long, query array<float>")
    pair = lambda x: {(a, b) for a, b, *_ in x}
    true, found = pair(brute(rows, asked, 10)), pair(got(index.search(q, 10)))
    assert len(true & found) >= 0.9 * len(true) and index.probes < 0.5 * len(index.centres)


def test_every_usable_row_is_indexed(rows, index):
    assert index.rows.count() == len(rows) - 6 and index.radius.min() >= 0


def test_filters(spark, rows, index):
    days = [datetime.date(2024, 1, d) for d in (3, 9, 20)]
    asked = [(i, rows[i][1], ("a", "b", "c", None)[i % 4], days[i % 3] if i % 5 else None, days[i % 3] + datetime.timedelta(4) if i % 7 else None) for i in range(0, 900, 30)]
    q = spark.createDataFrame(asked, "query_id long, query array<float>, kind string, since date, till date")

    def fits(q, r):
        inside = (r[3] is not None or (q[3] is None and q[4] is None)) and (q[3] is None or r[3] >= q[3]) and (q[4] is None or r[3] <= q[4])
        return (q[2] is None or q[2] == r[2]) and inside

    found = index.search(q, 7, exact=True, match=("kind",), within=("day", "since", "till"))
    assert got(found) == brute(rows, asked, 7, fits)


def test_no_rows(spark, vectors, index):
    none = spark.createDataFrame([], "query_id long, query array<float>")
    assert index.search(none, 3).collect() == [] and index.search(none, 3, exact=True).collect() == []
    some = spark.createDataFrame([(1, [1.0] * 16)], "query_id long, query array<float>")
    assert VectorIndex(vectors.limit(0)).search(some, 3).collect() == []
    one = VectorIndex(vectors.filter("doc_id = 3")).search(some, 3, exact=True).collect()
    assert [(r.query_id, r.doc_id, r["rank"]) for r in one] == [(1, 3, 1)]


def test_as_the_plain_join(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    v, q = e.select(F.col("vec_id").alias("doc_id"), "embedding"), e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    assert got(VectorIndex(v).search(q, 10, exact=True)) == got(search.nearest(v, q, 10))


def test_candidates_are_bounded():
    """A task holds at most twice the best of its queries and one block of scores more."""
    best, rng = vector_index._Best(30_000, 10), np.random.default_rng(1)
    for _ in range(4):
        best.add(rng.integers(0, 30_000, 500_000), vector_index.pa.array(rng.integers(0, 10**6, 500_000)), rng.random(500_000))
        assert best.size <= 2 * 10 * 30_000
    assert vector_index.BLOCK_SCORES <= 1 << 20
