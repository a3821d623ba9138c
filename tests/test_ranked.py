"""Ranked text search against brute force: scores, order, ties, shards, thresholds, passes and how much is read."""

import collections
import math
import random
import re

import pytest

from quarry.operators import ranked
from quarry.plans import catalogue
from quarry.sources import tables
from pyspark.sql import functions as F


def terms_of(text):
    return re.findall("[a-z0-9]+", (text or "").lower())


def brute(docs, queries, k):
    """Scores as the definition has them, all of them."""
    held = {i: collections.Counter(terms_of(t)) for i, t in docs}
    n, mean = len(docs), sum(sum(c.values()) for c in held.values()) / max(1, len(docs))
    df = collections.Counter(t for c in held.values() for t in c)
    out = set()
    for q, text in queries:
        found = []
        for i, c in held.items():
            size = sum(c.values())
            parts = [math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * size / mean)) for t in sorted(set(terms_of(text))) if c[t]]
            if parts:
                found.append((round(sum(parts), 6), i))
        found.sort(key=lambda x: (-x[0], x[1]))
        out |= {(q, i, s, r + 1) for r, (s, i) in enumerate(found[:k])}
    return out


def zipf_text(rng, n):
    return " ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(n))


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(8)
    out = [(i, zipf_text(rng, rng.choice([0, 1, 5, 40, 40, 200]))) for i in range(1500)]
    out += [(2000 + i, out[7][1]) for i in range(30)]  # ties
    return out + [(3000, None), (3001, ""), (3002, "É w1 \0 W2!w3"), (3003, "w1 " * 20_000 + "w2")]


@pytest.fixture(scope="module")
def queries(docs):
    rng = random.Random(9)
    out = [(i, zipf_text(rng, rng.choice([1, 3, 30]))) for i in range(40)]
    return out + [(50, docs[9][1]), (51, docs[7][1]), (52, None), (53, ""), (54, "unseen words"), (55, "w1"), (56, "W1 w1, w2")]


def frames(spark, docs, queries):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(queries, "query_id long, text string")


@pytest.mark.parametrize("shard, block, k, held", [(16_384, 128, 10, 200_000), (90, 4, 3, 200_000), (40, 1, 1, 200_000), (300, 16, 25, 20)])
def test_against_brute_force(spark, docs, queries, monkeypatch, shard, block, k, held):
    monkeypatch.setattr(ranked, "SHARD_DOCS", shard)
    monkeypatch.setattr(ranked, "FIRST_BLOCK", block)
    monkeypatch.setattr(ranked, "HELD_TERMS", held)
    d, q = frames(spark, docs, queries)
    found = ranked.bm25(d, q, k).collect()
    got = {(r.query_id, r.doc_id, r.score, r["rank"]) for r in found}
    assert len(found) == len(got) and got == brute(docs, queries, k)


def test_one_index_for_many_searches(spark, docs, queries):
    d, q = frames(spark, docs, queries)
    index = ranked.TextIndex(d)
    for k in (1, 7):
        assert {(r.query_id, r.doc_id, r.score, r["rank"]) for r in index.search(q, k).collect()} == brute(docs, queries, k)
    text_ids = spark.createDataFrame([("a", "w1 w9"), ("b", "w2")], "query_id string, text string")
    assert {(r.query_id, r.doc_id, r.score, r["rank"]) for r in index.search(text_ids, 4).collect()} == brute(docs, [("a", "w1 w9"), ("b", "w2")], 4)


def test_empty_tables(spark, docs, queries):
    d, q = frames(spark, docs, queries)
    assert ranked.bm25(d.limit(0), q).collect() == [] and ranked.bm25(d, q.limit(0)).collect() == []


def test_bounds_save_reading(spark, monkeypatch):
    """Of the postings of all query terms a part is read, and a smaller part where there are more documents."""
    monkeypatch.setattr(ranked, "SHARD_DOCS", 250)
    rng, shares = random.Random(4), []
    queries = [(i, zipf_text(rng, 12)) for i in range(30)]
    docs = [(i, zipf_text(rng, 60)) for i in range(8000)]
    for n in (500, 8000):
        d, q = frames(spark, docs[:n], queries)
        work = ranked.TextIndex(d.coalesce(1)).work(q, 10).collect()
        shares.append(sum(r.read for r in work) / sum(r.postings for r in work))
        want = collections.Counter(t for _, x in docs[:n] for t in set(terms_of(x)))
        assert {r.query_id: r.postings for r in work} == {i: sum(want[t] for t in set(terms_of(x))) for i, x in queries}
    assert shares[1] < 0.6 * shares[0] and shares[1] < 0.5


def test_plan_has_no_row_for_each_query_and_document(spark):
    sf = "/root/testdata/sf0.001"
    docs = tables.table(spark, sf, "documents").select("doc_id", "text")
    asked = tables.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    plan = ranked.TextIndex(docs).search(asked, 10)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_hybrid_against_brute_force(spark):
    """Reciprocal ranks of the two lists, each by brute force."""
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in tables.table(spark, sf, "documents").collect()]
    asked = [(r.item_id, r.text) for r in tables.table(spark, sf, "benchmark").collect()]
    vectors = {r.vec_id: r.embedding for r in tables.table(spark, sf, "embeddings").collect()}
    parts = collections.defaultdict(list)
    for q, i, _, rank in brute(docs, asked, 20):
        parts[q, i].append(1 / (60 + rank))
    for q in (i for i in vectors if i % 20 == 0):
        near = sorted((-round(sum(x * y for x, y in zip(vectors[q], v)), 6), i) for i, v in vectors.items())[:20]
        for rank, (_, i) in enumerate(near, 1):
            parts[q, i].append(1 / (60 + rank))
    got = {(r.query_id, r.doc_id): (r.score, r.n_lists) for r in catalogue.QUERIES["rrf_hybrid"](spark, sf).collect()}
    assert set(got) == set(parts) and all(got[x][1] == len(p) and got[x][0] == pytest.approx(sum(p), abs=2e-9) for x, p in parts.items())


def test_filters_before_scores(spark, docs, queries, monkeypatch):
    """Equal columns and ranges, null in documents and in queries, over several shards."""
    monkeypatch.setattr(ranked, "SHARD_DOCS", 200)
    rng = random.Random(12)
    kept = {i: (rng.choice(["A", "B", None]), rng.choice([None, 1, 2, 3, 4, 5]), rng.choice([True, False])) for i, _ in docs}
    asked = {q: (rng.choice(["A", "B", "C", None]), rng.choice([None, True]), rng.choice([None, 2, 3]), rng.choice([None, 3, 4, 1])) for q, _ in queries}
    d = spark.createDataFrame([(i, t, *kept[i]) for i, t in docs], "doc_id long, text string, ticker string, day int, fresh boolean").repartition(3)
    q = spark.createDataFrame([(i, t, *asked[i]) for i, t in queries], "query_id long, text string, ticker string, fresh boolean, since int, till int")
    whole = collections.defaultdict(list)
    for a, i, s, _ in brute(docs, queries, len(docs)):
        ticker, fresh, since, till = asked[a]
        day = kept[i][1]
        inside = (since is None and till is None) or (day is not None and (since is None or day >= since) and (till is None or day <= till))
        if inside and ticker in (None, kept[i][0]) and fresh in (None, kept[i][2]):
            whole[a].append((-s, i))
    want = {(a, i, -s, n + 1) for a, rows in whole.items() for n, (s, i) in enumerate(sorted(rows)[:6])}
    found = ranked.TextIndex(d, keep=("day", "ticker", "fresh")).search(q, 6, match=("ticker", "fresh"), within=("day", "since", "till"))
    assert {(r.query_id, r.doc_id, r.score, r["rank"]) for r in found.collect()} == want and want
