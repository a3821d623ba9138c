"""Every registered query against its SQL, and exact values of operators."""

import collections
import datetime as dt
import math
import re
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import html, text
from quarry.operators import decision, evaluation, evidence, search, timeseries
from quarry.plans import catalogue
from quarry.sources import tables
from quarry.streaming import stateful, streams

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def shown(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return repr(float(v) + 0.0)
    if isinstance(v, dt.datetime):
        return str(v.replace(tzinfo=None))
    return str(v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    rows = df.collect()
    if name in catalogue.ORACLE_SQL:
        cur = con.execute(catalogue.ORACLE_SQL[name])
        columns = [x[0] for x in cur.description]
        assert sorted(columns) == sorted(df.columns)
        expected = sorted(tuple(shown(r[columns.index(c)]) for c in df.columns) for r in cur.fetchall())
        assert sorted(tuple(shown(v) for v in r) for r in rows) == expected


def test_markdown_fields_of_odd_texts(spark, tmp_path):
    """Blank titles, characters that end a line in Java but not here, headings and source lines inside texts, and no or empty sources."""
    odd = [" ", "\t", "\r", "\f", "\x0b", "\x85", "\u2028", "\u2029", "\xa0", "\n", "\r\n", ""]
    texts = [a + b + c for a in odd for b in ("", "ab: c", "q\nbody") for c in odd] + [f"a{x}b \n c{y}{x}" for x in odd for y in odd]
    texts += ["## References\nx", "x\n## References\ny", "x\n## References", "\n## References\n", "x\n*Source: a | b | Category: c\ny", "\n## a: b\n", " " * 2_000 + "x" + " " * 2_000 + "y\nz"]
    texts += [f"\U0001f600 *Source: s | 2024-01-{i % 30 + 1:02d}T{i * 37 % 1440 // 60:02d}:{i * 37 % 60:02d}:00Z | Category: b\nc" for i in range(len(texts), len(texts) + 3)]
    rows = [(i, x, "s") for i, x in enumerate(texts)] + [(1000 + i, x, s) for i, x in enumerate(("", "\n", "a: b\nc", "d")) for s in (None, "")] + [(2000, None, "s")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    df, c = catalogue.QUERIES["markdown_fields"](spark, str(tmp_path)), duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    expected = c.execute(f"SELECT {', '.join(df.columns)} FROM ({catalogue.ORACLE_SQL['markdown_fields']})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, expected)) and len(expected) == len(rows) - 1


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head().x


def test_canonical_url(spark):
    clean = lambda u: one(spark, text.canonical_url(F.lit(u)))
    assert clean("HTTP://Shop.Example:8080/a/?z=%7E1&A=x+y&UTM_term=q&mc_=1&b&ref=keep#top") == "http://shop.example:8080/a?A=x+y&b=&ref=keep&z=~1"
    assert clean("https://u:p@news.example/") == "https://news.example" and clean("https://news.example/a/b/") == "https://news.example/a/b/"
    assert clean("https://news.example/?ref_a=1&utm_=2") == "https://news.example"
    assert clean("https://news.example/x?b=2&b=10&a=*") == "https://news.example/x?a=%2A&b=10&b=2"
    for u in ("https://a.example/p?q=%C3%A9&x=1%202", "https://a.example/?a=b=c"):
        assert clean(clean(u)) == clean(u)


def test_fingerprint_windows(spark):
    at = lambda h, m: text.fingerprint(F.lit("Same, Title!"), F.lit(f"2026-01-15 {h}:{m}:00").cast("timestamp_ntz"))
    assert one(spark, at(10, "00") == at(11, 59)) is True
    assert one(spark, at(10, "00") == at(12, "00")) is False


def test_alignment(spark):
    days = spark.createDataFrame([(dt.date(2025, 7, d),) for d in (2, 3, 7)], "day date")
    # Summer: the close is at 20:00 UTC. The 4th is a holiday, the 5th and 6th are a weekend.
    times = spark.createDataFrame([(1, "2025-07-02 20:00:00"), (2, "2025-07-05 03:10:00"), (3, "2025-07-07 20:00:01"), (4, "2025-07-02 19:59:59")], "id int, at string")
    rows = times.select("id", timeseries.candidate_date(F.col("at").cast("timestamp_ntz")).alias("c"))
    got = {r.id: r.trade_date for r in timeseries.as_of_forward(rows, "c", days).collect()}
    assert got == {1: dt.date(2025, 7, 3), 2: dt.date(2025, 7, 7), 3: None, 4: dt.date(2025, 7, 2)}


def test_returns(spark):
    bars = spark.createDataFrame([("a", dt.date(2025, 3, d), c) for d, c in ((3, 80.0), (4, 64.0), (6, 72.0))], "symbol string, date date, close double")
    r = timeseries.forward_returns(bars).filter("date = '2025-03-04'").head()
    assert (r.ret_t0, r.ret_t1, r.ret_t3) == (-16 / 80, 8 / 64, None)


def test_hybrid_answers_all(spark, con):
    """Both sides by brute force: every benchmark item, and every vector whose id is divisible by 20."""
    docs = {i: re.findall("[a-z0-9]+", (x or "").lower()) for i, x in con.execute("SELECT doc_id, text FROM documents").fetchall()}
    tf = {i: collections.Counter(x) for i, x in docs.items()}
    df = collections.Counter(w for x in tf.values() for w in x)
    mean = sum(map(len, docs.values())) / len(docs)
    idf = {w: math.log(1 + (len(docs) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    expected = {}

    def ranked(query, scores):
        for k, (_, i) in enumerate(sorted((-round(x, 6), i) for i, x in scores.items())[:20]):
            n, score = expected.get((query, i), (0, 0.0))
            expected[query, i] = n + 1, score + 1 / (60 + k + 1)

    items = con.execute("SELECT item_id, text FROM benchmark").fetchall()
    for q, body in items:
        terms = set(re.findall("[a-z0-9]+", body.lower()))
        ranked(q, {i: sum(idf[w] * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * len(docs[i]) / mean)) for w in terms if w in c) for i, c in tf.items() if any(w in c for w in terms)})
    ids, vectors = zip(*con.execute("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall())
    m = np.array(vectors, dtype=np.float64)
    for q in (i for i in ids if i % 20 == 0):
        ranked(q, dict(zip(ids, (m @ m[ids.index(q)]).tolist())))
    got = {(r.query_id, r.doc_id): (r.n_lists, r.score) for r in catalogue.QUERIES["rrf_hybrid"](spark, SF).collect()}
    queries = {q for q, _ in got}
    assert queries == {q for q, _ in items} | {i for i in ids if i % 20 == 0} and len(queries) > 20
    # Sums in another order may exchange neighbours of one rounded score.
    assert len(set(got) ^ set(expected)) <= 0.002 * len(expected)
    assert sum(abs(got[k][1] - expected[k][1]) > 1e-6 for k in set(got) & set(expected)) <= 0.002 * len(expected)
    assert {r.query_id for r in catalogue.QUERIES["sufficiency"](spark, SF).collect()} == queries


def test_nearest_in_blocks(spark):
    e = tables.table(spark, SF, "embeddings")
    vectors = e.select(F.col("vec_id").alias("doc_id"), "embedding")
    some = e.filter("vec_id < 60").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    whole = search.nearest(vectors, some, 3)
    cut = search.nearest(vectors, some, 3, most=25)
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, whole.collect())) and whole.count() == 180


def test_fusion(spark):
    ranked = lambda ids: spark.createDataFrame([(1, i, k + 1) for k, i in enumerate(ids)], "query_id int, doc_id string, rank int")
    assert search.fuse([ranked(["a1"])]).head().score == round(1 / 61, 9)
    best = search.fuse([ranked(["a1", "a2", "a3"]), ranked(["a2", "a3", "a4"])]).orderBy(F.desc("score")).head()
    assert best.doc_id == "a2"


def test_sentence_chunks(spark):
    a = spark.createDataFrame([(7, "t", "polygon_news", "First sentence here. Short. Second sentence here.")], "asset_id long, ticker string, source_type string, body string")
    assert {r.chunk_id for r in evidence.chunks(a).collect()} == {"7", "7::l2s0001", "7::l2s0002"}


def test_quality_reasons(spark):
    long = "x" * 300
    rows = [(i, "Same title", "a", "2024-01-01", long) for i in range(5)] + [(10, "T", "a", "2024-01-01", ""), (11, "T", None, "2024-01-01", "short"), (12, "", "a", "2024-01-01", long), (13, "U", "a", None, long),
                                                                            (14, "V", "a", "2024-01-01", "short"), (15, "W", "a", "2024-01-01", "\u4e2d" * 300), (16, "X", "a", "2024-01-01", long), (17, "Y", "a", "2024-01-01", None)]
    a = spark.createDataFrame([(i, "t", "s", *r) for i, *r in rows], "asset_id long, ticker string, source_type string, title string, source string, published string, body string")
    got = {r.asset_id: (r.reason, r.score) for r in evidence.quality_flags(a).collect()}
    assert {got[i] for i in range(5)} == {("template_spam", 0.833)}
    assert [got[i][0] for i in range(10, 18)] == ["short_text", "missing_fields", "missing_fields", "missing_fields", "short_text", "non_target_language", None, "short_text"]
    assert got[16][1] == 1.0 and got[11][1] == 0.667


def test_fallback(spark):
    reason = lambda n, f, m, g: one(spark, evidence.fallback_reason(*map(F.lit, (n, f, m, g))))
    assert reason(0, 0, 0.031, 0) == "empty_primary_with_big_move"
    assert reason(0, 0, 0.02, 0) is None
    assert reason(3, 0, 0.0, 0) == "all_articles_fail_quality"


def test_greedy_f1(spark):
    c = spark.createDataFrame([(1, ["rates rose", "sales fell"], ["rates rose", "sales fell"]), (2, [], ["a b"]), (3, ["a b"], [])], "case_id int, predicted array<string>, golden array<string>")
    assert {r.case_id: r.f1 for r in evaluation.attribution_f1(c).collect()} == {1: 1.0, 2: 0.0, 3: 0.0}


def test_router(spark):
    schema = "error boolean, ticker_consistent boolean, session_valid boolean, magnitude_plausible boolean, next_action string, n_graded int, expansions int"
    rows = [(False, None, None, None, "proceed", 2, 0), (False, False, True, True, "proceed", 2, 0), (True, False, True, True, None, 0, 0), (False, None, True, None, None, 1, 0), (False, True, True, True, "proceed", 0, 0),
            (False, True, True, True, "expand_macro", 0, 1), (False, True, True, True, "expand_macro", 0, 2), (False, True, True, True, "expand_related", 0, None), (False, True, True, True, "refuse", 0, 0), (False, True, False, False, "proceed", 1, 0), (False, True, True, False, "proceed", 1, 0)]
    got = [(r.edge, r.edge_reason) for r in decision.route(spark.createDataFrame(rows, schema).coalesce(1)).collect()]
    assert [e for e, _ in got] == ["judge", "insufficient", "system_error", "insufficient", "insufficient", "expand_macro", *["insufficient"] * 5]
    assert [r for _, r in got][3:] == ["missing_critic_decision", "empty_graded_evidence_guard", "critic_expand_macro", "expansions_exhausted", "layer3_not_implemented", "critic_refused", "market_session_guard", "magnitude_guard"]


def test_critic(spark):
    chunks = {1: [(0.5, True)], 2: [(0.26, True)], 3: [(0.9, False)], 4: [(0.24, True)], 5: [(0.28, False), (0.9, True)], 6: [(0.27, None), (0.28, True)]}
    g = spark.createDataFrame([(k, r, x) for k, v in chunks.items() for r, x in v], "case_id int, relevance double, temporal_match boolean")
    got = {r.case_id: (r.n, r.coverage, r.decision, r.next_action) for r in decision.critic(g).collect()}
    assert got[1] == (1, 0.5, "sufficient", "proceed") and got[2] == (1, 0.26, "partial", "proceed") and got[3][:3] == (1, 0.81, "sufficient")
    assert got[4] == (0, 0.0, "insufficient", "refuse") and got[5][2] == "sufficient" and got[6][2] == "partial"


def test_tails():
    assert evaluation.mcnemar_p(0, 0) == 1.0
    assert abs(evaluation.mcnemar_p(1, 9) - 22 / 1024) < 1e-12
    # The values that leave a twentieth above them.
    for df, x in {1: 3.841458820694124, 2: 5.991464547107979, 3: 7.814727903251179, 4: 9.487729036781154, 7: 14.067140449340169, 10: 18.307038053275146}.items():
        assert abs(evaluation.chi2_tail(x, df) - 0.05) < 1e-9
    assert evaluation.chi2_tail(0, 5) == 1.0 and evaluation.chi2_tail(2000.0, 30) < 1e-300
    with pytest.raises(ValueError):
        evaluation.chi2_tail(1.0, 0)


def test_wilcoxon_of_all_pairs(spark):
    """The effect is taken over all pairs, those without a difference too."""
    of = evaluation.differences(spark.createDataFrame([(1, 1), (2, 2), (3, 1), (4, 6), (5, 5), (1, 2)], "x int, y int")).head()
    assert (of.pairs, of.n, of.ties) == (6, 3, 6.0)
    assert evaluation.differences(spark.createDataFrame([], "x int, y int")).head() == (0, 0, 0.0)


def test_language_of_white_space(spark):
    rows = [("\n\t \u00a0\u2003\x1f", "unknown"), ("", "unknown"), (None, "unknown"), ("\n.", "en"), ("a 漢", "non_target_language")]
    got = spark.createDataFrame(rows, "t string, want string").select(text.language(F.col("t")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_grid(spark):
    """Every triple one step away, against its definition."""
    for now in ((2, 1, 0.5), (1, 1, 0.0), (5, 5, 0.95)):
        around = {(a, b, min(1.0, max(0.0, round(now[2] + c / 10, 2)))) for a in (now[0] - 1, now[0], now[0] + 1) for b in (now[1] - 1, now[1], now[1] + 1) for c in (-1, 0, 1)}
        assert {tuple(r) for r in evaluation.grid(spark, now).collect()} == {x for x in around if x[0] > x[1] >= 1}


def test_html():
    page = ("<html><head><title>T</title><meta x></head><body><header>Top</header><nav>skip<p>this</nav><!-- no --><p>Hello <a href='https://a.example/x'>there <b>you</b></a></p><a href='/rel'>rel</a>"
            "<a href='https://a.example/x'>again</a><iframe>in</iframe><form>f<aside>g</form><script>no</script> end <a href='http://b.example'></a></body></html>")
    text_, n = html.to_markdown(page)
    assert text_ == "T\nTop\nHello\nthere\nyou\nrel\nagain\nend\n\n## References\n\n[1] https://a.example/x: thereyou\n[2] http://b.example" and n == 2
    assert html.to_markdown("<div><nav>a<p>b</div>c") == ("c", 0) and html.to_markdown(None) == ("", 0) and html.to_markdown("<p>x") == ("x", 0)


def test_upsert(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    b = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(tuple(r) for r in tables.upsert(a, b, ["k"]).collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_streams_agree_with_batch(spark, tmp_path):
    events = tables.table(spark, SF, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = streams.windowed_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = events.groupBy(F.window("ts", "1 day").start.alias("start"), "event_type").count()
    assert {tuple(r) for r in spark.table("counts").collect()} == {tuple(r) for r in batch.collect()}


def test_stream_health_and_dedup(spark, tmp_path):
    rows = spark.createDataFrame([("n", i, i % 2 == 0, 200, 0.0) for i in range(30)] + [("m", i, i < 25, 200, 0.0) for i in range(40)] + [("w", 0, False, 429, 301.0)],
                                 "node string, seq long, ok boolean, status int, retry_after double").repartition(3)
    rows.write.parquet(str(tmp_path / "h"))
    with stateful.state_store(spark):
        got = streams.result(stateful.health(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "h"))), "update", ["node"])
    assert {tuple(r) for r in got.collect()} == {("n", 30, 10, False), ("m", 40, 5, True), ("w", 1, 0, True)}
    news = spark.createDataFrame([(1, "A b", "2026-01-01 10:00:00"), (2, "a B!", "2026-01-01 11:59:00"), (3, "a b", "2026-01-01 12:00:00")], "id int, title string, at string")
    news.select("id", "title", F.col("at").cast("timestamp").alias("published")).coalesce(1).write.parquet(str(tmp_path / "n"))
    stream = spark.readStream.schema("id int, title string, published timestamp").parquet(str(tmp_path / "n"))
    streams.drained(streams.deduplicated(stream), str(tmp_path / "c"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_stream_sinks(spark, tmp_path):
    """A batch that is repeated changes nothing; of a key the latest version stays, across batches too."""
    rows = lambda *r: spark.createDataFrame([(k, dt.date(2026, 1, d), v, x) for k, d, v, x in r], "k int, day date, version int, x string")
    first, second = rows((1, 1, 1, "a"), (1, 1, 2, "b"), (2, 2, 1, "c")), rows((2, 2, 2, "d"), (3, 1, 1, "e"))
    write = streams.compensated_sink(str(tmp_path / "t"), ["k", "day"], "day")
    for batch, k in ((first, 0), (first, 0), (second, 1), (second, 1)):
        write(batch, k)
    got = spark.read.parquet(str(tmp_path / "t")).select("k", "x").collect()
    assert sorted(map(tuple, got)) == [(1, "b"), (2, "d"), (3, "e")]


def test_stream_timeout(spark, tmp_path):
    at = lambda s: dt.datetime(2026, 1, 1) + dt.timedelta(seconds=s)
    rows = [("slow", 0, at(0), "start"), ("late", 0, at(0), "start"), ("late", 1, at(301), "end"), ("fine", 0, at(0), "start"), ("fine", 1, at(300), "end"), ("fresh", 0, at(900), "start"), ("idle", 0, at(1000), "queue"),
            ("gone", 0, at(5), "cancel"), ("gone", 1, at(6), "start")]
    df = spark.createDataFrame(rows, "run_id string, seq long, at timestamp, command string").coalesce(1)
    df.write.parquet(str(tmp_path / "r"))
    with stateful.state_store(spark):
        got = streams.result(stateful.run_status(spark.readStream.schema(df.schema).parquet(str(tmp_path / "r"))), "update", ["run_id"])
    assert {r.run_id: r.status for r in got.collect()} == {"slow": "FAILED_SYSTEM", "late": "FAILED_SYSTEM", "fine": "SUCCEEDED", "fresh": "RUNNING", "idle": "QUEUED", "gone": "CANCELLED"}


def test_placed_over_buckets(spark):
    """Places, rolling windows and budgets don't depend on how wide the buckets and blocks are."""
    import random

    rng = random.Random(4)
    rows = [(r, k, rng.choice("ab"), rng.random() < 0.5, 429 if rng.random() < 0.02 else 200, 400.0, rng.random()) for r in range(60) for k in range(rng.randint(1, 9))]
    e = spark.createDataFrame(rows, "run_id long, event_seq long, node string, ok boolean, status int, retry_after double, cost double").repartition(5)
    expected, seen, spent = {}, collections.defaultdict(list), collections.defaultdict(float)
    kept = set()
    for r, k, node, ok, status, _, cost in sorted(rows):
        seen[node].append(ok)
        last = seen[node][-20:]
        expected[r, k] = (len(last), round(sum(last) / len(last), 9), (len(last) == 20 and sum(last) < 10) or status == 429)
        if spent[node] <= 7.5:
            kept.add((r, k))
        spent[node] += cost
    for block in (20, 64, 4096):
        assert {(r.run_id, r.event_seq): (r.seen, round(r.ok_rate, 9), r.incident) for r in decision.rolling_health(e, block=block).collect()} == expected
    for width in (1, 7, 1024):
        assert {(r.run_id, r.event_seq) for r in decision.within_budget(e, 7.5, width).collect()} == kept


def test_source_counts_are_of_all_assets(spark):
    """No window leaves an asset out."""
    counted = catalogue.QUERIES["source_counts"](spark, SF).agg(F.sum("n").alias("n")).head().n
    assert counted == spark.read.parquet(f"{SF}/documents.parquet").count()
