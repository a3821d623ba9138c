"""Queries over runs and streams, and the entry points by name, with their SQL. A stream is run over what is there; its
result is held against SQL over the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import markdown
from quarry.operators import cases as ops
from quarry.operators import decision
from quarry.plans.cases import COMMANDS, _commands
from quarry.plans.corpus import FP, NORM, PAGE_URL
from quarry.plans.ingest import ORACLE_SQL as _INGEST
from quarry.plans.ingest import _list_news
from quarry.plans.market import ARTICLES, BARS, NEWS
from quarry.plans.runs import TRACE
from quarry.sources import shared, sinks, surface
from quarry.sources import tables as t
from quarry.streaming import stateful, streams
from quarry.streaming.store import KeyedStore


def _pick(values, column):
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(column, F.lit(len(values))) + 1).cast("int"))


def _streamed(df, parts=1):
    """A stream of a table's rows: they are stored as files, and the files are the stream."""
    path = shared.folder(df.sparkSession, "source")
    df.repartition(parts).write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _events(s, d):
    return t.table(s, d, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "value")


def _stages(s, d):
    e = t.trace_events(s, d)
    k = F.col("event_seq")
    return e.select("*", F.when(k % 3 != 0, _pick(("m1", "m2"), k)).alias("model"), F.when(k % 4 != 1, "RUNNING").alias("before"), F.when(k % 5 == 2, "FAILED_SYSTEM").when(k % 4 != 1, "PARTIAL").alias("after"))


STAGES = TRACE + """, sg AS (SELECT *, CASE WHEN event_seq % 3 <> 0 THEN ['m1', 'm2'][event_seq % 2 + 1] END AS model, CASE WHEN event_seq % 4 <> 1 THEN 'RUNNING' END AS b, CASE WHEN event_seq % 5 = 2 THEN 'FAILED_SYSTEM' WHEN event_seq % 4 <> 1 THEN 'PARTIAL' END AS a FROM trace)"""


def _calls(s, d):
    """Calls of each provider in order, good if their value is small."""
    e = _events(s, d)
    return e.select(F.col("event_type").alias("node"), F.col("event_id").alias("seq"), (F.col("value") < 20).alias("ok"), F.when(F.col("value") < 20, 200).when(F.col("event_id") % 2 == 0, 429).otherwise(500).alias("status"), (F.col("value") * 3).alias("retry_after"))


def _call_batches(s, d):
    """Calls in four batches, in order."""
    c = _calls(s, d)
    return c.withColumn("batch", F.expr(f"seq * 4 div {max(1, c.count())}").cast("int"))


def _timed(s, d):
    """Commands of each run, some of them far apart."""
    c = _commands(s, d)
    k = F.col("run_id").cast("long")
    at = F.timestamp_seconds(F.lit(1_700_000_000) + k % 50 * 20 + F.col("seq") * (F.lit(40) + k % 7 * 60))
    return c.select("run_id", "seq", at.alias("at"), F.when(F.col("command") == "retry", "queue").otherwise(F.col("command")).alias("command"))


def _timed_batches(s, d):
    """Commands by their time in four batches; the end of every ninth run comes a batch late."""
    k = F.col("run_id").cast("long")
    late = ((k % 9 == 0) & (F.col("command") == "end")).cast("int")
    return _timed(s, d).withColumn("batch", F.least(F.lit(3), F.floor((F.unix_seconds("at") - 1_700_000_000) / 400).cast("int") + late))


def _news_batches(s, d):
    """Articles by day in four batches; some come one or two batches late, before or after the watermark."""
    k = F.col("asset_id")
    pages = t.table(s, d, "pages").select("page_id", "url")
    n = pages.agg(F.count(F.lit(1)).alias("n"))
    rows = t.news(s, d).crossJoin(F.broadcast(n)).withColumn("page_id", k % F.col("n")).join(pages, "page_id", "left")  # n is one row
    late = F.when(k % 23 == 0, 2).when(k % 11 == 0, 1).otherwise(0)
    return rows.select("asset_id", "title", "ticker", "url", F.col("published").cast("timestamp").alias("published"),
                       F.least(F.lit(3), F.expr("(day(published) - 1) div 8").cast("int") + late).alias("batch"))


def _event_batches(s, d, late=13):
    """The log of a user's run in four batches; every late-th event comes a batch late."""
    e = _events_of_users(s, d)
    n = max(1, e.count())
    return e.withColumn("batch", F.least(F.lit(3), F.expr(f"event_id * 4 div {n}").cast("int") + (F.col("event_id") % late == 0).cast("int")))


def _events_of_users(s, d):
    return t.table(s, d, "events").select(F.col("user_id").alias("run_id"), "event_id", F.col("event_type").alias("node"), F.col("ts").cast("timestamp").alias("at"), "value")


def _checkpoints(s, d):
    """Attempts by run, source, ticker and date. version: the attempt."""
    e = _event_batches(s, d)
    k = F.col("run_id")
    return e.select(F.concat(F.lit("r"), k % 7).alias("run_id"), F.col("node").alias("source"), F.concat(F.lit("T"), k % 50).alias("ticker"), F.to_date("at").alias("date"),
                    F.when(F.col("value") < 20, "success").otherwise("failed").alias("status"), F.when(F.col("value") >= 20, "timeout").alias("error_class"), (F.col("event_id") % 4).alias("retries"), F.col("event_id").alias("version"), "batch")


def _store(s, d):
    """A store that two streams wrote to, one of them in turned order, with a compaction and a repeated batch between."""
    rows = shared.stored(_checkpoints(s, d), "attempts")
    store = KeyedStore(s, shared.folder(s, "checkpoints"), rows.drop("batch").schema.simpleString()[7:-1].replace(":", " "), ["run_id", "source", "ticker", "date"], "version")
    stateful.replay(rows.filter("version % 2 = 0"), "batch", lambda x: x, store.sink("daily"), "append")
    store.compact()
    turned = rows.filter("version % 2 = 1").withColumn("batch", 3 - F.col("batch"))
    stateful.replay(turned, "batch", lambda x: x, store.sink("backfill"), "append")
    again = rows.filter("version % 2 = 0 and batch = 0").drop("batch")
    store.sink("daily")(again, 0)
    return store


def _daily(s, d):
    """Increments: of each day's bars, a first count, and later ones of the two days before it. version: the day of writing."""
    b = t.bars(s, d).select("symbol", "date", "volume")
    days = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("late")
    return b.select("symbol", "date", days, "volume").select("symbol", "date", F.date_add("date", F.col("late")).alias("version"), (F.col("volume") * 10 + F.col("late")).alias("n"))


def _compensated(s, d):
    path, out = shared.folder(s, "daily"), shared.folder(s, "compensated")
    rows = _daily(s, d)
    rows.repartition(4, "version").sortWithinPartitions("version").write.parquet(path)
    stream = s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    # Files may come in any order: what a later batch brings must not be older, so each batch is merged by version.
    write = streams.compensated_sink(out, ["symbol", "date"], "date")
    streams.run_to_end(stream, lambda batch, k: write(_newest(s, out, batch), k), "append")
    return s.read.parquet(out).select("symbol", F.col("date").cast("date").alias("date"), "version", "n")


def _newest(s, path, batch):
    """A batch without the rows that the table has newer ones of."""
    if not shared.exists(s, path):
        return batch
    old = s.read.schema(batch.schema).parquet(path).select("symbol", "date", F.col("version").alias("__v"))
    return batch.join(old, ["symbol", "date"], "left").filter(F.col("__v").isNull() | (F.col("version") >= F.col("__v"))).select(*batch.columns)


def _runs(s, d):
    return t.trace_events(s, d).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.max("event_seq").alias("high")).withColumn("status", _pick(("RUNNING", "SUCCEEDED", "QUEUED"), F.col("run_id")))


def _queue(s, d):
    return t.table(s, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("queued_at"), _pick(("RUNNING", "QUEUED", "SUCCEEDED"), F.col("o_orderkey")).alias("status"))


def _fundamentals(s, d, ticker, day):
    """The latest statement of a ticker on or before a day, and its metrics."""
    a = t.assets(s, d).filter((F.col("ticker") == ticker) & (F.col("source_type") == "fmp_fundamentals") & (F.col("reference_date") <= F.lit(day).cast("date")))
    best = a.agg(F.max_by(F.struct("asset_id", "reference_date"), F.struct("reference_date", "asset_id")).alias("b")).select("b.*")
    md = markdown.flat_table(F.create_map(F.lit("revenue"), F.col("asset_id").cast("string")))
    return best.filter("asset_id is not null").select("asset_id", "reference_date", markdown.table_metrics(md)["revenue"].alias("revenue"))


def _called(sql):
    """A query in SQL over the entry points by name."""
    def run(s, d):
        surface.register(s, d)
        return s.sql(sql)

    return run


#: Every symbol with ranges that are open, closed, turned round and empty; symbols that nobody knows among them.
_ASKED = """(SELECT ticker, r.since, r.till FROM (SELECT ticker FROM api_tickers() UNION ALL SELECT 'NONE') AS x
    CROSS JOIN VALUES (DATE '2024-01-05', DATE '2024-01-12'), (NULL, DATE '2024-01-03'), (DATE '2024-01-20', NULL), (DATE '2024-01-09', DATE '2024-01-02') AS r(since, till)) AS a"""


QUERIES = {
    "trace_export": lambda s, d: _export(s, d),
    "stage_rollup": lambda s, d: decision.stages(_stages(s, d)),
    "event_numbers": lambda s, d: decision.numbered(t.table(s, d, "events").select(F.col("event_type").alias("run_id"), F.col("ts").alias("at"), "event_id")).select("event_id", "event_seq"),
    "queue_head": lambda s, d: decision.queue_head(_queue(s, d)),
    "daily_budget": lambda s, d: decision.budget_days(t.table(s, d, "events").select(F.col("event_type").alias("provider"), F.col("ts").alias("at")), 8),
    "high_water_marks": lambda s, d: _runs(s, d).select("run_id", F.col("high").alias("after_seq"), (~F.col("status").isin(ops.TERMINAL)).alias("poll")),
    "latest_header": lambda s, d: t.table(s, d, "orders").agg(F.max(F.concat(F.lit("freeze-"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit(".json"))).alias("name")),
    "stream_node_counts": lambda s, d: streams.result(streams.windowed_counts(_streamed(_events(s, d), 3)), "complete").select(F.to_date("start").alias("day"), "event_type", "n"),
    "stream_event_log": lambda s, d: stateful.replayed(_event_batches(s, d).drop("value"), "batch", stateful.event_log, "append"),
    "stream_dedup": lambda s, d: stateful.replayed(_news_batches(s, d).filter("title is not null").select("asset_id", "title", "published", "batch"), "batch", lambda x: streams.deduplicated(x, "2 days"), "append").select("fp"),
    "stream_proximity": lambda s, d: stateful.replayed(_news_batches(s, d), "batch", lambda x: stateful.near_copies(x, "2 days"), "append"),
    "stream_health": lambda s, d: stateful.replayed(_call_batches(s, d), "batch", stateful.health, "update", ["node"]),
    "stream_run_status": lambda s, d: stateful.replayed(_timed_batches(s, d), "batch", stateful.run_status, "update", ["run_id"]).select("run_id", "status"),
    "stream_upserts": _compensated,
    "stream_checkpoints": lambda s, d: _store(s, d).snapshot(),
    "resume_pending": lambda s, d: _store(s, d).pending(_checkpoints(s, d).select("run_id", "source", "ticker", "date").distinct(), "status = 'success'"),
    "fn_ohlcv": _called(f"SELECT a.ticker, a.since, a.till, o.date, round(o.close, 6) AS close, o.volume FROM {_ASKED}, LATERAL api_ohlcv(a.ticker, a.since, a.till) AS o"),
    "fn_news": _called("SELECT a.ticker, n.nth, n.asset_id, n.reference_date FROM (SELECT DISTINCT ticker FROM quarry_news UNION ALL SELECT 'NONE') AS a, LATERAL api_news(a.ticker, till => DATE '2024-01-20', days => 15, most => 4) AS n"),
    "fn_fundamentals": _called("SELECT a.ticker, a.day, f.asset_id, f.reference_date FROM (SELECT DISTINCT ticker, date_add(DATE '2024-01-01', CAST(asset_id % 40 AS INT)) AS day FROM quarry_news) AS a, LATERAL api_fundamentals(a.ticker, a.day) AS f"),
    "fn_run_events": _called("SELECT r.run_id, e.event_seq, e.node, e.latency_ms FROM (SELECT DISTINCT run_id FROM quarry_events) AS r, LATERAL api_run_events(r.run_id, after_seq => 0, most => 3) AS e"),
    "api_tickers": lambda s, d: t.bars(s, d).select(F.upper("symbol").alias("ticker")).distinct().orderBy("ticker"),
    "api_ohlcv": lambda s, d: t.bars(s, d).filter("symbol = 'view' and date >= '2024-01-10'").orderBy("date").select("date", *(F.round(c, 6).alias(c) for c in ("open", "high", "low", "close")), "volume"),
    "api_range_local": lambda s, d: t.bars(s, d).agg(F.min("date").alias("min_date"), F.max("date").alias("max_date"), F.countDistinct("symbol").alias("n_symbols"), F.count(F.lit(1)).alias("n_rows")),
    "api_news": lambda s, d: _list_news(s, d, "src6", "2024-01-28", 30, 100),
    "api_fundamentals": lambda s, d: _fundamentals(s, d, "src1", "2024-01-20"),
    "api_run": lambda s, d: t.trace_events(s, d).groupBy("run_id").agg(F.max_by("node", "event_seq").alias("last_node")).join(_runs(s, d).select("run_id", "status"), "run_id").select("run_id", "status", "last_node", ops.next_node(F.col("last_node"), F.col("status")).alias("next_node")),
    "api_run_events": lambda s, d: t.trace_events(s, d).filter("run_id = 3 and event_seq > 0").orderBy("event_seq").select("run_id", "event_seq", "node", "latency_ms"),
    "api_run_artifacts": lambda s, d: ops.artifacts(t.trace_events(s, d).filter("run_id = 3").withColumn("node", _pick(("miner", "critic"), F.col("event_seq")))).select("event_seq", "artifact_type"),
    "api_cancel_all": lambda s, d: _queue(s, d).select("run_id", F.when(F.col("status").isin("QUEUED", "RUNNING"), "CANCELLED").otherwise(F.col("status")).alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n")),
    "api_retry": lambda s, d: _queue(s, d).select("run_id", F.when(F.col("status").isin("QUEUED", "RUNNING"), "run_not_terminal").otherwise("ok").alias("answer")),
    "api_health": lambda s, d: ops.health(t.table(s, d, "region").select(F.lit("runtime").alias("group"), F.when(F.col("r_regionkey") == 1, "degraded").otherwise("ready").alias("status"), F.lit(64).alias("vector_dim"))),
    "api_models": lambda s, d: s.createDataFrame([(k, *v) for k, v in decision.PRICES.items()], "model string, per_million_in double, per_million_out double"),
}


def _export(s, d):
    e = t.trace_events(s, d).select("run_id", "event_seq", "node", "latency_ms")
    return sinks.export_runs(_runs(s, d).select("run_id", "status"), e)


EVENT_BATCHES = "eb AS (SELECT *, least(3, event_id * 4 // (SELECT count(*) FROM events) + (event_id % 13 = 0)::INT) AS batch FROM events)"
CHECKPOINTS = """cp AS (SELECT 'r' || user_id % 7 AS run_id, event_type AS source, 'T' || user_id % 50 AS ticker, CAST(ts AS DATE) AS date, CASE WHEN value < 20 THEN 'success' ELSE 'failed' END AS status,
    CASE WHEN value >= 20 THEN 'timeout' END AS error_class, event_id % 4 AS retries, event_id AS version FROM events)"""
# What a stream takes of articles: those later than the watermark, two days before the latest of all batches before, are dropped.
TAKEN = f"""{NEWS}, pg AS (SELECT page_id, {PAGE_URL} AS url FROM pages),
    nb AS (SELECT n.*, pg.url, least(3, (day(published) - 1) // 8 + CASE WHEN asset_id % 23 = 0 THEN 2 WHEN asset_id % 11 = 0 THEN 1 ELSE 0 END) AS batch FROM news n LEFT JOIN pg ON asset_id % (SELECT count(*) FROM pages) = page_id),
    taken AS (SELECT * FROM (SELECT *, max(epoch_ms(published)) OVER (ORDER BY batch GROUPS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 172800000 AS mark FROM nb) WHERE mark IS NULL OR epoch_ms(published) > mark)"""

ORACLE_SQL = {
    "trace_export": f"""WITH {TRACE} SELECT run_id, '{{"run_id":' || run_id || ',"status":"' || ['RUNNING', 'SUCCEEDED', 'QUEUED'][run_id % 3 + 1] || '","events":[' || string_agg('{{"event_seq":' || event_seq || ',"node":"' || node || '","latency_ms":' || latency_ms || '}}', ',' ORDER BY event_seq) || ']}}' AS json FROM trace GROUP BY run_id""",
    "stage_rollup": f"""WITH {STAGES} SELECT run_id, node, count(*) AS calls, CAST(sum(latency_ms) AS BIGINT) AS latency_ms, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, arg_max(model, event_seq) FILTER (model IS NOT NULL) AS model,
        coalesce(string_agg(coalesce(b, '—') || ' → ' || coalesce(a, '—'), '; ' ORDER BY event_seq) FILTER (a IS NOT NULL OR b IS NOT NULL), '') AS transitions, CASE WHEN last(coalesce(a, '') ORDER BY event_seq) LIKE '%FAILED%' THEN 'error' ELSE 'completed' END AS stage_status FROM sg GROUP BY 1, 2""",
    "event_numbers": "SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS event_seq FROM events",
    "queue_head": "SELECT o_orderkey AS run_id, o_orderdate AS queued_at FROM orders WHERE o_orderkey % 3 = 1 ORDER BY o_orderdate, o_orderkey LIMIT 1",
    "daily_budget": """WITH r AS (SELECT event_type AS provider, CAST(ts AS DATE) AS day, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts) AS gap FROM events)
        SELECT provider, day, count(*) AS n, greatest(count(*) - 8, 0) AS over, round(min(gap) / 1e6, 3) AS least_gap FROM r GROUP BY 1, 2""",
    "high_water_marks": f"WITH {TRACE} SELECT run_id, max(event_seq) AS after_seq, run_id % 3 <> 1 AS poll FROM trace GROUP BY 1",
    "latest_header": "SELECT 'freeze-' || strftime(max(o_orderdate), '%Y%m%d') || '.json' AS name FROM orders",
    "stream_node_counts": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_event_log": f"""WITH {EVENT_BATCHES} SELECT user_id AS run_id, event_id, event_type AS node, row_number() OVER (PARTITION BY user_id ORDER BY batch, ts, event_id) AS event_seq,
        row_number() OVER (PARTITION BY user_id, event_type ORDER BY batch, ts, event_id) AS node_seq FROM eb""",
    "stream_checkpoints": f"""WITH {CHECKPOINTS} SELECT run_id, source, ticker, date, arg_max(status, version) AS status, arg_max(error_class, version) FILTER (version = top) AS error_class, arg_max(retries, version) AS retries, max(version) AS version
        FROM (SELECT *, max(version) OVER (PARTITION BY run_id, source, ticker, date) AS top FROM cp) GROUP BY ALL""",
    "resume_pending": f"""WITH {CHECKPOINTS} SELECT run_id, source, ticker, date FROM cp GROUP BY ALL HAVING arg_max(status, version) <> 'success'""",
    "stream_health": """WITH r AS (SELECT event_type AS node, event_id, value, sum((value < 20)::INT) OVER w AS ok, count(*) OVER w AS c FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
        SELECT node, count(*) AS seen, CAST(arg_max(ok, event_id) AS BIGINT) AS ok_of_last, bool_or((c = 20 AND ok < 10) OR (value >= 20 AND event_id % 2 = 0 AND value * 3 > 300)) AS incident FROM r GROUP BY 1""",
    "stream_upserts": f"WITH {BARS} SELECT symbol, date, CAST(date + 2 AS DATE) AS version, volume * 10 + 2 AS n FROM bars",
    "fn_ohlcv": f"""WITH {BARS}, r(since, till) AS (VALUES (DATE '2024-01-05', DATE '2024-01-12'), (NULL, DATE '2024-01-03'), (DATE '2024-01-20', NULL), (DATE '2024-01-09', DATE '2024-01-02'))
        SELECT upper(symbol) AS ticker, since, till, date, round(close, 6) AS close, volume FROM bars, r WHERE (since IS NULL OR date >= since) AND (till IS NULL OR date <= till)""",
    "fn_news": f"""WITH {NEWS} SELECT ticker, CAST(nth AS INTEGER) AS nth, asset_id, reference_date FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY reference_date DESC, published DESC, asset_id) AS nth FROM news
        WHERE source_type = 'polygon_news' AND reference_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20') WHERE nth <= 4""",
    "fn_fundamentals": f"""WITH {NEWS}, a AS (SELECT DISTINCT ticker, CAST(DATE '2024-01-01' + CAST(asset_id % 40 AS INTEGER) AS DATE) AS day FROM news)
        SELECT ticker, day, asset_id, reference_date FROM (SELECT a.ticker, a.day, n.asset_id, n.reference_date, row_number() OVER (PARTITION BY a.ticker, a.day ORDER BY n.reference_date DESC, n.asset_id DESC) AS k
            FROM a JOIN news n ON n.ticker = a.ticker AND n.source_type = 'fmp_fundamentals' AND n.reference_date <= a.day) WHERE k = 1""",
    "fn_run_events": f"""WITH {TRACE} SELECT run_id, event_seq, node, latency_ms FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY event_seq) AS nth FROM trace WHERE event_seq > 0) WHERE nth <= 3""",
    "api_tickers": "SELECT DISTINCT upper(event_type) AS ticker FROM events",
    "api_ohlcv": f"WITH {BARS} SELECT date, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM bars WHERE symbol = 'view' AND date >= DATE '2024-01-10'",
    "api_range_local": f"WITH {BARS} SELECT min(date) AS min_date, max(date) AS max_date, count(DISTINCT symbol) AS n_symbols, count(*) AS n_rows FROM bars",
    "api_fundamentals": f"WITH {ARTICLES} SELECT asset_id, reference_date, CAST(asset_id AS VARCHAR) AS revenue FROM arts WHERE ticker = 'src1' AND source_type = 'fmp_fundamentals' AND reference_date <= DATE '2024-01-20' ORDER BY reference_date DESC, asset_id DESC LIMIT 1",
    "api_run": f"""WITH {TRACE}, l AS (SELECT run_id, arg_max(node, event_seq) AS last_node FROM trace GROUP BY 1) SELECT run_id, ['RUNNING', 'SUCCEEDED', 'QUEUED'][run_id % 3 + 1] AS status, last_node, CASE WHEN run_id % 3 <> 1 THEN 'miner' END AS next_node FROM l""",
    "api_run_events": f"WITH {TRACE} SELECT run_id, event_seq, node, latency_ms FROM trace WHERE run_id = 3 AND event_seq > 0",
    "api_run_artifacts": f"""WITH {TRACE} SELECT event_seq, unnest(CASE event_seq % 2 WHEN 0 THEN ['retrieved_chunks', 'reranked_chunks', 'state_snapshot'] ELSE ['graded_evidence', 'all_graded_chunks', 'critic_decision', 'raw_llm_response', 'state_snapshot'] END) AS artifact_type FROM trace WHERE run_id = 3""",
    "api_cancel_all": "SELECT CASE o_orderkey % 3 WHEN 2 THEN 'SUCCEEDED' ELSE 'CANCELLED' END AS status, count(*) AS n FROM orders GROUP BY 1",
    "api_retry": "SELECT o_orderkey AS run_id, CASE o_orderkey % 3 WHEN 2 THEN 'ok' ELSE 'run_not_terminal' END AS answer FROM orders",
    "api_health": "SELECT 'runtime' AS \"group\", 'degraded' AS status, false AS dim_mismatch",
    "api_models": "SELECT * FROM (VALUES ('user', 3.0, 15.0), ('assistant', 0.8, 4.0)) m(model, per_million_in, per_million_out)",
}
ORACLE_SQL["stream_dedup"] = f"WITH {TAKEN.replace('FROM nb)', 'FROM nb WHERE title IS NOT NULL)')} SELECT DISTINCT {FP} AS fp FROM taken"
ORACLE_SQL["stream_proximity"] = f"""WITH {TAKEN}, r AS (SELECT asset_id, 'url' AS rule, url AS a, '' AS b, batch, epoch(published) AS at_ FROM taken UNION ALL SELECT asset_id, 'title', {NORM}, ticker, batch, epoch(published) FROM taken)
    SELECT asset_id, rule, CASE rule WHEN 'url' THEN row_number() OVER o > 1 ELSE coalesce(at_ - max(at_) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 14400, false) END AS is_near
    FROM r WHERE a IS NOT NULL AND b IS NOT NULL WINDOW o AS (PARTITION BY rule, a, b ORDER BY batch, at_, asset_id)"""
ORACLE_SQL["api_news"] = _INGEST["news_list"].replace("'src1'", "'src6'").replace("DATE '2024-01-05' AND DATE '2024-01-20'", "DATE '2023-12-29' AND DATE '2024-01-28'").replace("LIMIT 20", "LIMIT 100")
ORACLE_SQL["stream_run_status"] = f"""WITH RECURSIVE {COMMANDS}, tm AS (SELECT run_id, seq, CASE command WHEN 'retry' THEN 'queue' ELSE command END AS command, 1700000000 + conv_id % 50 * 20 + seq * (40 + conv_id % 7 * 60) AS at_, least(3, (conv_id % 50 * 20 + seq * (40 + conv_id % 7 * 60)) // 400 + (conv_id % 9 = 0 AND command = 'end')::INT) AS batch FROM cm),
    tk AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY batch, at_, seq) AS k FROM (SELECT *, max(at_) OVER (ORDER BY batch GROUPS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 60 AS mark FROM tm) WHERE mark IS NULL OR at_ > mark),
    step AS (SELECT run_id, 0 AS k, 'QUEUED' AS status, -1::BIGINT AS started FROM tk WHERE k = 1
        UNION ALL SELECT s.run_id, t.k, CASE WHEN s.status NOT IN ('QUEUED', 'RUNNING') THEN s.status WHEN s.status = 'RUNNING' AND t.at_ - s.started > 300 THEN 'FAILED_SYSTEM' WHEN t.command = 'end' THEN 'SUCCEEDED' WHEN t.command = 'cancel' THEN 'CANCELLED'
            WHEN t.command = 'start' THEN 'RUNNING' ELSE s.status END, CASE WHEN s.status = 'QUEUED' AND t.command = 'start' THEN t.at_ ELSE s.started END FROM step s JOIN tk t ON t.run_id = s.run_id AND t.k = s.k + 1),
    fin AS (SELECT run_id, arg_max(status, k) AS status, max(started) AS started FROM step GROUP BY 1)
    SELECT run_id, CASE WHEN status = 'RUNNING' AND (started + 301) < (SELECT max(at_) FROM tm) - 60 THEN 'FAILED_SYSTEM' ELSE status END AS status FROM fin"""
