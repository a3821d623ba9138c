"""Followed pages against a walk, page by page."""

import pathlib
import random

from quarry.sources import paging


def walk(first, following):
    seen, at = [], first
    while at in following and at not in seen:
        seen.append(at)
        at = following[at]
    if not seen:
        return seen, "broken"
    return seen, "complete" if at is None else "loop" if at in following else "broken"


def test_against_a_walk(spark):
    rng = random.Random(2)
    following = {f"p{i}": (f"p{rng.randint(0, 90)}" if rng.random() < 0.9 else None) for i in range(80)}  # merges, loops, unknown addresses
    following |= {f"long{i}": f"long{i + 1}" for i in range(1500)} | {"long1500": None, "self": "self"}
    following |= {f"ring{i}": f"ring{(i + 1) % 37}" for i in range(37)} | {"into": "ring5"}
    firsts = [*[f"p{i}" for i in range(0, 85, 3)], "long0", "long1499", "self", "ring3", "into", None, "none", "long0"]
    requests = spark.createDataFrame(list(enumerate(firsts)), "request_id long, url string").repartition(3)
    seen, ended = paging.followed(requests, spark.createDataFrame(list(following.items()), "url string, next_url string").repartition(3))
    got = {}
    for r in sorted(seen.collect(), key=lambda r: (r.request_id, r.nth)):
        got.setdefault(r.request_id, []).append((r.nth, r.url))
    ends = {r.request_id: (r.n_pages, r.ended) for r in ended.collect()}
    for i, first in enumerate(firsts):
        pages, how = walk(first, following)
        assert got.get(i, []) == list(enumerate(pages)) and ends[i] == (len(pages), how), first


def test_nothing(spark):
    none = spark.createDataFrame([], "url string, next_url string")
    seen, ended = paging.followed(spark.createDataFrame([(1, "a")], "request_id long, url string"), none)
    assert seen.collect() == [] and [tuple(r) for r in ended.collect()] == [(1, 0, "broken")]


def test_any_range(spark):
    """Requests that cross ranges, come back into one, and meet their own way or another's there."""
    rng = random.Random(5)
    following = {f"a{i:03}": f"a{i + 1:03}" for i in range(120)} | {"a120": "a007"}  # comes back behind its start
    following |= {f"b{i:03}": f"b{i + 1:03}" for i in range(100)} | {"b100": "a050", "c": "nowhere", "b101": None}
    following |= {f"x{i}": f"x{rng.randint(0, 70)}" for i in range(60)} | {f"n{i}": f"n{i + 1}" for i in range(130)} | {"n130": "n9"}
    firsts = [*following, None, "none"]
    requests = spark.createDataFrame(list(enumerate(firsts)), "request_id long, url string").repartition(2)
    pages = spark.createDataFrame(list(following.items()), "url string, next_url string").repartition(3)
    for held in (13, 150):
        seen, ended = paging.followed(requests, pages, held)
        got = {}
        for r in sorted(seen.collect(), key=lambda r: (r.request_id, r.nth)):
            got.setdefault(r.request_id, []).append((r.nth, r.url))
        ends = {r.request_id: (r.n_pages, r.ended) for r in ended.collect()}
        for i, first in enumerate(firsts):
            pages_of, how = walk(first, following)
            assert got.get(i, []) == list(enumerate(pages_of)) and ends[i] == (len(pages_of), how), (held, first)


def test_pages_of_a_range_are_not_doubled(spark):
    place = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(place.glob("jumps-*"))
    pages = spark.range(300).selectExpr("concat('p', id) AS url", "CASE WHEN id < 299 THEN concat('p', id + 1) END AS next_url")
    _, ended = paging.followed(spark.createDataFrame([(1, "p0")], "request_id long, url string"), pages)
    assert [tuple(r) for r in ended.collect()] == [(1, 300, "complete")]
    assert sum(spark.read.parquet(str(p)).count() for p in set(place.glob("jumps-*")) - before) == 0
