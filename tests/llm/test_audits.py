"""License scan, whitening and source divergence against brute force, on nulls, clashes, ties, repeats, long texts and no rows."""

import collections
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import divergence, license_scan, queries, whitening
from .test_operators import SCHEMA, texts


def notices():
    rng = random.Random(2)
    fill = [f"w{k}" for k in range(9)]
    say = ["GNU General Public License", "gnu-general/public\nlicense", "Apache License", "CC BY", "cc-by-nc 4.0", "MIT License", "mit licenses", "Xmit license", "cc  by", "É MIT License É",
           "# SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause", "License: GPL", '"license": "ISC"', "license: anything goes here"]
    out = [" ".join(rng.choices(fill, k=rng.randint(0, 30))) + rng.choice([" ", "\n", ", "]) + rng.choice(say) + " " + " ".join(rng.choices(fill + say, k=rng.randint(0, 8))) for _ in range(150)]
    return out + ["cc by cc by cc by", "cc", "by", "mit", "license", "", None, "\0\0", "mit license " * 30_000]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    rows = [(i * 3, t, ("en", "fr", None, "")[i % 4], ("b", "a", None, "é", "")[i % 5], 1, "r", 1, 2, 3) for i, t in enumerate(texts() + notices())]
    rows += [rows[5], rows[5], (None, "no id cc by", "only", "one", 1, "r", 1, 2, 3), (None,) * 9]
    path = str(tmp_path_factory.mktemp("in") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(path)
    return spark.read.parquet(path)


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_license_base_against_brute_force(docs):
    got = collections.Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_scan.scan(docs).collect())
    want = collections.Counter()
    for r in docs.collect():
        words = words_of(r.text)
        at = [(i, label) for phrase, label in license_scan.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        want[r.doc_id, len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))] += 1
    assert got == want and len(want) > 100


def test_license_findings(spark):
    def one(text):
        return license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()

    r = one("é x\n// SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception OR GPL-3.0-or-later */ tail")
    assert r.labels == "apache,gpl" and r.base_labels == "" and r.permission == 1.0 and 0.9 < r.score <= 1
    f = r.findings[0]
    assert "é x\n// SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception OR GPL-3.0-or-later */ tail".encode()[f.begin : f.end] == b"SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception OR GPL-3.0-or-later"
    assert one("SPDX-License-Identifier: Weird-1 AND MIT").labels == "mit,other"
    assert one("license: weird").labels == "" and one("license mit").labels == ""
    assert one("License: MIT License").labels == "mit"
    r = one("Licensed under CC BY-NC 4.0.")
    assert (r.base_labels, r.labels, r.permission) == ("cc-by", "cc-by,cc-by-nc", 0.1)
    assert one("the apache licenses, a public general gnu license").score == 0


def test_expressions():
    order = license_scan.postfix("mit or apache-2.0 and ( gpl-2.0 with x or isc )".split())
    assert order == "mit apache-2.0 gpl-2.0 x with isc or and or".split()
    assert license_scan.evaluate(order) == ({"mit", "apache", "gpl", "isc"}, 0.9)
    assert license_scan.postfix("mit license text".split()) == ["mit"] and license_scan.postfix("mit and".split()) == ["mit"]
    assert license_scan.postfix("( mit or isc".split()) == [] and license_scan.postfix(["and", "mit"]) == [] and license_scan.evaluate([]) is None
    assert license_scan.evaluate(license_scan.postfix("( mit or isc ) with x".split())) is None
    assert license_scan.evaluate(license_scan.postfix("gpl-2.0 and mit".split())) == ({"gpl", "mit"}, 0.3)
    deep = ["("] * 50_000 + ["mit"] + [")"] * 50_000
    assert license_scan.postfix(deep) == ["mit"]
    # Random trees keep their value through text, postfix and evaluation.
    rng = random.Random(3)

    def tree(depth):
        if depth == 0 or rng.random() < 0.3:
            name = rng.choice(["mit", "gpl-3.0", "cc0-1.0", "mpl-2.0", "lgpl-2.1"])
            return [name], license_scan.PERMISSION[license_scan.label_of(name)]
        op = rng.choice(["and", "or"])
        (a, x), (b, y) = tree(depth - 1), tree(depth - 1)
        return ["(", *a, op, *b, ")"], (min if op == "and" else max)(x, y)

    for _ in range(200):
        tokens, value = tree(6)
        assert license_scan.evaluate(license_scan.postfix(tokens))[1] == value


def test_license_empty(spark):
    assert license_scan.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 20)) @ rng.normal(size=(20, 20))
    rows = [(i, [float(c) for c in v], 0, 1) for i, v in enumerate(base)]
    rows += [(900 + i, rows[3][1], 0, 1) for i in range(200)] + [rows[0], (None, rows[5][1], 0, 1)]
    bad = [(1, None, 0, 1), (2, [], 0, 1), (3, [1.0] * 19 + [None], 0, 1), (4, [float("nan")] * 20, 0, 1), (5, [float("inf")] + [0.0] * 19, 0, 1), (6, [1.0], 0, 1), (7, [1e30] * 20, 0, 1)]
    schema = "vec_id long, embedding array<float>, n int, component int"
    return spark.createDataFrame(rows + bad, schema).repartition(5), rows


def test_whitening_against_brute_force(vectors):
    df, rows = vectors
    got = collections.defaultdict(dict)
    repeats = collections.Counter()
    for r in whitening.whiten(df).collect():
        got[r.vec_id][r.component] = r
        repeats[r.vec_id, r.component] += 1
    x = {(i, tuple(math.floor(64 * np.float32(c).astype(float)) + 1_000_000 for c in v)) for i, v, *_ in rows}
    fit = np.array(sorted({v for _, v in x}), dtype=np.int64)
    n, s = len(fit), fit.sum(axis=0)
    v = np.cov(fit.T.astype(float), bias=True)
    e = np.sort(np.linalg.eigvalsh(v))[::-1]
    white = []
    for i, vector in x:
        assert set(got[i]) == set(range(1, 17))
        r = got[i][1]
        assert r.n == n and int(r.deviation) == sum((n * a - int(b)) ** 2 for a, b in zip(vector, s)) and r.identity_error < 1e-9
        assert all(abs(got[i][k].explained - e[k - 1] / np.trace(v)) < 1e-9 for k in range(1, 17))
    by_vector = {vector: [got[i][k].whitened for k in range(1, 17)] for i, vector in x}
    white = np.array(list(by_vector.values()))
    assert np.abs(white.T @ white / n - np.eye(16)).max() < 1e-8 and np.abs(white.mean(axis=0)).max() < 1e-9
    assert sum(repeats.values()) == 16 * len(rows) and set(got) == {i for i, *_ in rows}


def test_exact_scatter_of_any_size(spark):
    """Integers far beyond doubles, one of them negative, over several partitions."""
    rng = random.Random(1)
    rows = [[rng.randint(-(1 << 55), 1 << 55) for _ in range(4)] for _ in range(50)]
    df = spark.createDataFrame([(r,) for r in rows], "x array<long>").repartition(7)
    full = whitening.scatter(df, "x", 4, whitening.primes_for(50 << 110))
    wide = [[1, *r] for r in rows]
    assert [[int(c) for c in line] for line in full] == [[sum(r[i] * r[j] for r in wide) for j in range(5)] for i in range(5)]


def test_deviation_beyond_longs(spark):
    rows = [(1, [2.0**50, 1.0]), (2, [-(2.0**50), 3.0]), (3, [0.0, 2.0])]
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), components=1).collect()
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    s = [sum(c) for c in zip(*x)]
    assert {r.vec_id: int(r.deviation) for r in out} == {i: sum((3 * a - b) ** 2 for a, b in zip(v, s)) for (i, _), v in zip(rows, x)}


def test_whitening_without_spread(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect() == []
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], schema)).collect()
    assert {r.component for r in flat} == {1} and all(r.explained == 1 for r in flat)


def brute_divergence(rows, least):
    counts, held, groups = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), set()
    for r in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        lang, source = r.lang or "", r.source or ""
        groups.add((lang, source))
        counts[lang, source].update(terms)
        held[lang].update(set(terms))
    out = set()
    for lang in {a for a, _ in groups}:
        kept = [t for t, n in held[lang].items() if n >= least]
        share = lambda c: {t: 1 + (10**9 * (c[t] + 5)) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}  # noqa: B023, E731
        whole = share(sum((counts[g] for g in groups if g[0] == lang), collections.Counter()))
        p = {s: share(counts[lang, s]) for a, s in groups if a == lang}
        for s in p:
            parts = {"pair": [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in p if o != s],
                     "term": [(p[s][t] - whole[t], t) for t in kept if counts[lang, s][t] and p[s][t] > whole[t]]}
            for part, found in parts.items():
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found if part == "pair" else found[:50])}
    return out


@pytest.mark.parametrize("least, block", [(3, 256), (1, 2), (10_000, 256)])
def test_divergence_against_brute_force(docs, least, block, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_SOURCES", block)
    got = [tuple(r) for r in divergence.audit(docs, least_docs=least).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_divergence(docs.collect(), least) and got


def test_divergence_shares_of_huge_counts(spark):
    row = spark.range(1).select(divergence.share(F.lit(5 * 10**17), F.lit(9 * 10**17), F.lit(10**12)).alias("p"), divergence.share(F.lit(0), F.lit(0), F.lit(0)).alias("none")).first()
    assert row.p == 1 + 10**9 * (5 * 10**17 + 5) // (9 * 10**17 + 5 * 10**12) and row.none is None


def test_divergence_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in queries.op13_source_divergence(spark, sf).collect())
    assert got == sorted(con.execute(queries.ORACLE_SQL["op13_source_divergence"]).fetchall()) and got


def test_divergence_empty(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("name", ["op11_license_scan", "op12_whitening"])
def test_whole_tables(spark, name):
    sf = "/root/testdata/sf0.001"
    table = "documents" if name.startswith("op11") else "embeddings"
    n = spark.read.parquet(f"{sf}/{table}.parquet").count()
    out = queries.QUERIES[name](spark, sf)
    assert out.count() == n * (1 if table == "documents" else 16)
    if table == "embeddings":
        assert dict(out.dtypes)["deviation"] == "bigint" and out.agg(F.max("identity_error")).first()[0] < 1e-4
    else:
        assert out.filter("not (score between 0 and 1)").count() == 0 and out.filter("n_base > 0 and score < 0.5").count() == 0
