"""Groups of duplicates against union-find and all pairs."""

import collections
import datetime as dt
import random

from quarry.operators import duplicates
from quarry.functions import text
from pyspark.sql import functions as F

SCHEMA = "asset_id long, url string, title string, ticker string, published timestamp, source_type string, body string"


def find(links, nodes):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_connected(spark):
    rng = random.Random(3)
    long = [(i, i + 1) for i in range(1000, 1400)]  # a chain
    star = [(5000, 5000 + i) for i in range(1, 300)]
    loose = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(250)]
    links = long + star + loose + [(7, 7)]
    got = duplicates.connected(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert {r.node: r.group for r in got} == find(links, nodes) and len(got) == len(nodes)
    assert duplicates.connected(spark.createDataFrame([], "a long, b long")).collect() == []


def test_groups_against_all_pairs(spark):
    rng = random.Random(5)
    t0 = dt.datetime(2026, 1, 1)
    titles, kinds = ["One title", "one  TITLE", "Other", "", None, "third!"], ["polygon_news", "fmp_news", "gdelt_news", "blog"]
    rows = []
    for i in range(260):
        at = t0 + dt.timedelta(seconds=rng.choice([rng.randint(0, 90_000), 14_400 * rng.randint(0, 5), 14_400 * rng.randint(0, 5) - 1]))
        rows.append((i * 2, rng.choice([None, None, f"u{rng.randint(0, 60)}"]), rng.choice(titles), rng.choice(["A", "B", None]), at, rng.choice(kinds), rng.choice(["", "text", "longer text", None])))
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    norm = {r.asset_id: r.t for r in df.select("asset_id", text.normalized_title(F.col("title")).alias("t")).collect()}
    near = lambda x, y: (x[1] is not None and x[1] == y[1]) or (norm[x[0]] is not None and norm[x[0]] == norm[y[0]] and x[3] is not None and x[3] == y[3] and abs((x[4] - y[4]).total_seconds()) < 14_400)
    links = [(x[0], y[0]) for x in rows for y in rows if x[0] != y[0] and near(x, y)]
    group, degree = find(links, [r[0] for r in rows]), collections.Counter(a for a, _ in links)
    size = collections.Counter(group.values())
    got = {r.asset_id: (r.group_id, r["size"], r.n_links) for r in duplicates.duplicate_groups(df).collect()}
    assert got == {r[0]: (group[r[0]], size[group[r[0]]], degree[r[0]]) for r in rows} and max(size.values()) > 10
    kept = {r.group_id: r.asset_id for r in duplicates.duplicate_groups(df).filter("kept").collect()}
    assert set(kept) == set(size)
    for g, best in kept.items():
        members = [r for r in rows if group[r[0]] == g]
        first = min((kinds.index(r[5]), r[4]) for r in members)
        mine = next(r for r in members if r[0] == best)
        assert (kinds.index(mine[5]), mine[4]) == first


def test_hot_title(spark):
    """One title of thousands of articles in one second."""
    rows = [(i, None, "hot", "A", dt.datetime(2026, 1, 1), "blog", "x") for i in range(3000)] + [(9000, None, "hot", "A", dt.datetime(2026, 1, 1, 3, 59, 59), "blog", "x"), (9001, None, "hot", "A", dt.datetime(2026, 1, 1, 4), "blog", "x")]
    got = {r.asset_id: (r.group_id, r["size"], r.n_links) for r in duplicates.duplicate_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[5] == (0, 3002, 3000) and got[9000] == (0, 3002, 3001) and got[9001] == (0, 3002, 1)
