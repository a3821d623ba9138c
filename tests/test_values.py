"""Exact values of statistics, responses, payloads, reports and stored artifacts."""

import hashlib
import itertools
import json
import math

import pytest
from pyspark.sql import functions as F

from quarry.functions import answers, markdown
from quarry.operators import cases, evaluation, evidence, ranked, resampling, retrieval, search
from quarry.plans import catalogue
from quarry.sources import payloads, shared, sinks, tables

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head().x


def test_wilcoxon_exact():
    """Against all signs of small samples."""
    for n in (1, 4, 7):
        for plus in ((1,), (2, 3), tuple(range(1, n + 1))):
            plus = [k for k in plus if k <= n]
            w_plus, total = sum(plus), n * (n + 1) // 2
            w = min(w_plus, total - w_plus)
            sums = [sum(k + 1 for k in range(n) if s[k]) for s in itertools.product((0, 1), repeat=n)]
            expected = min(1.0, 2 * sum(x <= w for x in sums) / 2**n)
            assert evaluation.wilcoxon(w_plus, total - w_plus, n) == (w, pytest.approx(expected))
    assert evaluation.wilcoxon(0, 0, 0) == (0.0, 1.0)
    # Normal approximation with ties: mean and spread by hand.
    w, p = evaluation.wilcoxon(30.0, 25.0, 10, 8 - 2 + 27 - 3 + 125 - 5)
    spread = math.sqrt(10 * 11 * 21 / 24 - (8 - 2 + 27 - 3 + 125 - 5) / 48)
    assert w == 25.0 and p == pytest.approx(math.erfc((27.5 - 25) / spread / math.sqrt(2)))


def test_effect_sizes():
    assert evaluation.wilcoxon_r(0.05, 25) == pytest.approx(1.959964 / 5, abs=1e-5) and evaluation.wilcoxon_r(0.0, 4) == 4.0 and evaluation.wilcoxon_r(0.5, 0) == 0.0


def test_bootstrap(spark):
    """Resampled means spread as the strata's own variances say."""
    rows = [(s, i, float((i * 7 + ord(s)) % 11), float(i % 5)) for s in "ab" for i in range(300)]
    d = {s: [x - y for t, _, x, y in rows if t == s] for s in "ab"}
    mean = sum(map(sum, d.values())) / len(rows)
    var = sum(len(v) * sum((x - sum(v) / len(v)) ** 2 for x in v) / len(v) for v in d.values()) / len(rows) ** 2
    pairs = spark.createDataFrame(rows, "stratum string, id long, x double, y double")
    r = resampling.bootstrap_interval(pairs, 2000).head()
    assert r.iterations == 2000 and r.lower == pytest.approx(mean - 1.96 * math.sqrt(var), abs=0.2 * math.sqrt(var)) and r.upper == pytest.approx(mean + 1.96 * math.sqrt(var), abs=0.2 * math.sqrt(var))
    assert resampling.bootstrap_interval(pairs.repartition(3), 2000).head() == r


def test_bootstrap_draws_each_stratum_whole(spark, monkeypatch):
    """In each iteration a stratum is drawn as often as it has rows, over leaves of any number; draws don't depend on
    partitions; a row's share and spread are those of a multinomial."""
    monkeypatch.setattr(resampling, "LEAF", 7)
    monkeypatch.setattr(resampling, "BLOCK_DRAWS", 50)
    sizes = {"a": 100, "b": 1, None: 30, "": 8}
    rows = [(s, i + 1000 * k, float(i), 0.0) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    pairs = spark.createDataFrame(rows, "stratum string, id long, x double, y double")
    got = resampling.bootstrap_sums(pairs, 400).collect()
    assert {(r.stratum, r.iteration): r.drawn for r in got} == {(s, i): n for s, n in sizes.items() for i in range(400)}
    again = resampling.bootstrap_sums(pairs.repartition(5, "x"), 400).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    totals = [r.total for r in got if r.stratum == "a"]
    mean, var = sum(totals) / 400, 100 * (100**2 - 1) / 12
    assert abs(mean - 4950) < 4 * math.sqrt(var / 400) and 0.8 < sum((x - mean) ** 2 for x in totals) / 400 / var < 1.25
    none = resampling.bootstrap_interval(pairs.limit(0)).head()
    assert (none.lower, none.upper, none.iterations) == (0.0, 0.0, 0)


def test_paired_tests(spark):
    got = {r.test: r for r in catalogue.QUERIES["paired_tests"](spark, SF).collect()}
    assert set(got) == {"wilcoxon", "bowker", "mcnemar"} and all(0 <= r.p <= 1 for r in got.values())
    xy = [(r.p_size, r.p_partkey % 50 + 1) for r in tables.table(spark, SF, "part").collect()]
    d = sorted((abs(x - y), x > y) for x, y in xy if x != y)
    ranks = {k: sum(1 for m, _ in d if m < k) + (sum(1 for m, _ in d if m == k) + 1) / 2 for k, _ in d}
    plus = sum(ranks[m] for m, up in d if up)
    assert got["wilcoxon"].statistic == min(plus, sum(ranks[m] for m, _ in d) - plus)


def test_attribution_query(spark):
    """Greedy matches by hand, over whole texts."""
    def words(t):
        return {w for w in t.lower().split() if w}

    got = {r.case_id: r.f1 for r in catalogue.QUERIES["attribution_f1"](spark, SF).collect()}
    for r in tables.table(spark, SF, "benchmark").collect():
        lines = [x for x in r.text.replace("\n", ".").split(".") if x.strip()]
        golden = [x if i % 2 == 0 else x + " and more" for i, x in enumerate(lines)][::-1]
        left, hits = list(range(len(golden))), 0
        for p in lines:
            scored = [(len(words(p) & words(golden[i])) / len(words(p) | words(golden[i])) if words(p) | words(golden[i]) else 1.0, -i) for i in left]
            if scored and max(scored)[0] > 0.26:
                left.remove(-max(scored)[1])
                hits += 1
        assert got[r.item_id] == pytest.approx(round(2 * hits / (len(lines) + len(golden)), 6), abs=2e-6)


def test_rerank_query(spark):
    """Each score by hand, and its candidates are those of the text search."""
    import re

    terms = lambda x: set(re.findall(r"\w+", (x or "").lower()))
    docs = {r.doc_id: r.text for r in tables.table(spark, SF, "documents").collect()}
    items = {r.item_id: r.text for r in tables.table(spark, SF, "benchmark").collect()}
    rows = catalogue.QUERIES["rerank_overlap"](spark, SF).collect()
    assert rows and all(r.overlap == pytest.approx(len(terms(items[r.query_id]) & terms(docs[r.doc_id])) / max(1, len(terms(items[r.query_id]))), abs=1e-6) for r in rows)
    found = ranked.bm25(tables.table(spark, SF, "documents").select("doc_id", "text"), tables.table(spark, SF, "benchmark").select(F.col("item_id").alias("query_id"), "text"), 10).collect()
    assert {(r.query_id, r.doc_id) for r in rows} == {(r.query_id, r.doc_id) for r in found}


def test_html_query(spark):
    rows = catalogue.QUERIES["html_clean"](spark, SF).collect()
    pages = {r.page_id: r.html for r in tables.table(spark, SF, "pages").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        assert "track(" not in r.markdown and "<p>" not in r.markdown and "margin:0" not in r.markdown and r.markdown
        assert not any(line != line.strip() for line in r.markdown.split("\n"))


def test_recovered_chunks(spark):
    rows = catalogue.QUERIES["recovered_chunks"](spark, SF).collect()
    assert any(r.is_fallback for r in rows) and all(r.chunk_id.endswith("::lost") for r in rows if r.is_fallback)
    chunks = {r.chunk_id: len(r.content) for r in evidence.chunks(tables.assets(spark, SF)).collect()}
    assert all(chunks[r.chunk_id] == r.chars for r in rows if not r.chunk_id.endswith("::lost"))


def test_reports(spark):
    rows = {r.config: r for r in catalogue.QUERIES["report_json"](spark, SF).collect()}
    assert rows["direct"].missing == "" and rows["full"].missing == "tokens"
    body = json.loads(rows["direct"].json)
    assert list(body["metrics"]) == sorted(body["metrics"]) and body["schema_version"] == "1.0"


def test_digests(spark, tmp_path):
    files = {"b.txt": b"two", "a.txt": b"one", "sub/a.txt": b"", "sub-x/a.txt": b"three"}
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    got = sinks.digests(spark, str(tmp_path))
    assert {r.name: r.sha256 for r in got.collect()} == {k: hashlib.sha256(v).hexdigest() for k, v in files.items()}
    whole = b"".join(k.encode() + b"\0" + hashlib.sha256(files[k]).digest() + b"\0" for k in sorted(files))
    assert sinks.folder_digest(got).head() == (hashlib.sha256(whole).hexdigest(), 4)
    one = sinks.digests(spark, str(tmp_path / "sub"), str(tmp_path)).collect()
    assert [r.name for r in one] == ["sub/a.txt"]
    # Contents that change places change the digest.
    (tmp_path / "a.txt").write_bytes(b"two")
    (tmp_path / "b.txt").write_bytes(b"one")
    assert sinks.folder_digest(sinks.digests(spark, str(tmp_path))).head().sha256 != hashlib.sha256(whole).hexdigest()


def test_digest_query(spark):
    names = ("benchmark.parquet", "labels.parquet")
    whole = b"".join(n.encode() + b"\0" + hashlib.sha256(open(f"{SF}/{n}", "rb").read()).digest() + b"\0" for n in names)
    assert catalogue.QUERIES["folder_digest"](spark, SF).head() == (hashlib.sha256(whole).hexdigest(), 2)


def test_freeze_manifest(spark):
    a, b = (catalogue.QUERIES["freeze_manifest"](spark, SF).head() for _ in range(2))
    toxic = tables.table(spark, SF, "labels").filter("toxic = 1").count()
    assert a == b and a.effective_n == tables.table(spark, SF, "documents").count() - toxic


def test_matrix_faults(spark):
    v = spark.createDataFrame([(0, [1.0, 2.0]), (2, [1.0]), (2, [float("nan"), 1.0])], "id long, embedding array<float>")
    r = sinks.matrix_manifest(v, 2).head()
    assert (r.n, r.contiguous, r.right_dim, r.finite) == (3, False, False, False)
    assert sinks.matrix_manifest(v.filter("id = 0"), 2).drop("digest").head() == (1, 2, True, True, True)


def test_positions_over_partitions(spark):
    ids = spark.createDataFrame([(f"k{i:03d}",) for i in range(97)], "asset_id string").repartition(7)
    vectors = spark.range(97).select("id", F.array(F.col("id").cast("float")).alias("embedding"))
    assert {r.asset_id: r.id for r in sinks.position_join(ids, vectors).collect()} == {f"k{i:03d}": i for i in range(97)}


def test_responses(spark):
    good = '{"chunk_id": "c", "relevance": 0.4, "category": "Macro", "temporal_match": true, "reasoning": "r"}'
    parsed = lambda x: one(spark, answers.parsed_grades(F.lit(x)))
    assert parsed('{"graded_chunks": [], "reasoning": "x"}').mode == "strict" and parsed("[]").mode is None
    assert parsed('{"graded_chunks": [' + good + ']}').mode == "chunk_salvage"
    r = parsed("```\n[" + good + "]\n```")
    assert r.mode == "strict" and r.chunks[0].category == "macro" and r.chunks[0].relevance == 0.4
    assert parsed("nothing").mode is None and parsed(good.replace("0.4", "1.4")).mode is None


def test_markdown_reading(spark):
    md = "## AB: A: title \n*Source: me | 2024 | Category: news*\n\nbody ## x\n\n## References\n[1] u"
    assert one(spark, markdown.title(F.lit(md))) == "A: title" and one(spark, markdown.source(F.lit(md))) == "me" and one(spark, markdown.published(F.lit(md))) == "2024"
    assert one(spark, markdown.body(F.lit(md))) == "news*\n\nbody ## x" and one(spark, markdown.body(F.lit(""))) == "" and one(spark, markdown.title(F.lit("no header"))) is None
    assert one(spark, markdown.headline(F.lit(md))) == "A: title" and one(spark, markdown.snippet(F.lit("plain text"), 5)) == "plain"
    title, source = markdown.news_lines(F.lit("## one\n## two\n*Source: s | d | Category: news*\n## three"))
    assert one(spark, title) == "two" and one(spark, source) == "Source: s | d | Category: news"


def test_payload_faults(spark):
    bar = lambda x: one(spark, payloads.first_bar(F.lit(x)))
    assert bar('{"results": []}') is None and bar("{}") is None and bar('{"results": [{"o": "1", "h": "x", "l": "1", "c": "1", "v": "1"}]}') is None
    assert tuple(bar('{"results": [{"o": 1, "h": 2, "l": 0.5, "c": 1.5, "v": 9}]}')) == (1.0, 2.0, 0.5, 1.5, 9.0)


def test_layers(spark):
    assets = spark.createDataFrame([(1, "t", "fred_macro", False), (2, "t", "sec_filing", False), (3, "u", "polygon_news", False), (4, "t", "polygon_news", True), (5, "t", "weather", False)], "asset_id long, ticker string, source_type string, is_duplicate boolean")
    assets = assets.withColumn("reference_date", F.lit("2024-01-02").cast("date"))
    ids = lambda layer: [r.asset_id for r in evidence.scoped(assets, "t", "2024-01-01", "2024-01-03", layer).collect()]
    assert ids("direct") == [2] and ids("macro") == [1]
    with pytest.raises(ValueError):
        retrieval.candidates(assets, assets, "related")


def test_strict_labels(spark):
    c = spark.createDataFrame([(1, None, True)], "case_id int, expected_status string, should_refuse boolean")
    assert cases.backfilled(c).head() == (1, "INSUFFICIENT", True)
    with pytest.raises(Exception, match="case without a label: 1"):
        cases.backfilled(c, strict=True).collect()


def test_upsert_keeps_one(spark):
    path = shared.folder(spark, "t")
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").write.parquet(path)
    new = sinks.upsert_table(path, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"])
    assert sorted(map(tuple, spark.read.parquet(new).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    many = spark.createDataFrame([(2, "x", 1), (2, "b", 3), (2, "a", 3), (9, None, None)], "k int, v string, at int").repartition(3)
    spark.createDataFrame([(1, "a", 0)], "k int, v string, at int").write.parquet(path + "-v")
    new = sinks.upsert_table(path + "-v", many, ["k"], "at")
    assert sorted(map(str, spark.read.parquet(new).select("k", "v").collect())) == ["Row(k=1, v='a')", "Row(k=2, v='b')", "Row(k=9, v=None)"]


def test_grades_are_parsed_once(spark):
    """A response is read once by each schema, however many fields are taken from the result."""
    p = spark.range(3).select(answers.parsed_grades(F.concat(F.lit("["), F.col("id").cast("string"))).alias("p"))
    fields = p.select("p.mode", F.size("p.chunks").alias("n"), F.transform("p.chunks", lambda c: c["category"]).alias("c"))
    plan = fields._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") + plan.count("jsontostructs") <= 3, plan
