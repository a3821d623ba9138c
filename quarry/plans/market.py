"""Queries over bars, returns and evidence windows, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import evidence, timeseries
from quarry.sources import sinks
from quarry.sources import tables as t

BARS = """bars AS (SELECT event_type AS symbol, CAST(ts AS DATE) AS date, first(value ORDER BY ts, event_id) AS open, max(value) AS high,
    min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*) AS volume FROM events GROUP BY 1, 2)"""
LONG = """longs AS (SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS date, last(o_totalprice ORDER BY o_orderkey) AS close FROM orders GROUP BY 1, 2)"""
ASSETS = """assets AS (SELECT doc_id AS asset_id, source AS ticker, ['polygon_news', 'fmp_fundamentals', 'fred_macro', 'gdelt_news'][doc_id // 20 % 4 + 1] AS source_type,
    CAST(DATE '2024-01-01' + CAST(doc_id % 30 AS INT) AS DATE) AS reference_date, split_part(text, chr(10), 1) AS title, text AS body, doc_id % 29 = 0 AS is_duplicate FROM documents)"""
NEWS = ASSETS + """, news AS (SELECT *, CAST(reference_date AS TIMESTAMP) + to_minutes(CAST(asset_id * 37 % 1440 AS INT)) AS published FROM assets)"""
CASES = BARS + """, cases AS (SELECT symbol, date, (close - open) / open AS move FROM bars WHERE open <> 0 AND abs((close - open) / open) > 0.5)"""
RETURNS = LONG + """, rets AS (SELECT * FROM (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS r0,
    (close - lag(close) OVER (PARTITION BY symbol ORDER BY date)) / lag(close) OVER (PARTITION BY symbol ORDER BY date) AS ret FROM longs) WHERE ret IS NOT NULL)"""
ARTICLES = NEWS + """, arts AS (SELECT asset_id, ticker, source_type, reference_date, title, body, CASE WHEN asset_id % 37 <> 0 THEN ticker END AS source,
    CASE WHEN asset_id % 41 <> 0 THEN strftime(published, '%Y-%m-%dT%H:%M:%SZ') END AS published FROM news)"""
# Source types by evidence layer.
DIRECT = "('polygon_news', 'fmp_news', 'finnhub_company_news', 'fmp_fundamentals', 'sec_filing')"
MACRO = "('macro_news', 'market_news', 'geopolitical_news', 'fred_rates', 'fred_macro', 'gdelt_news', 'policy_news')"
LAYER = f"CASE WHEN source_type IN {MACRO} THEN 'macro' WHEN source_type IN {DIRECT} THEN 'direct' ELSE 'other' END"
# The endpoints of each logical source.
ENDPOINTS = """MAP {'fmp_fundamentals': ['income_statement', 'balance_sheet', 'cash_flow'], 'yfinance_fundamentals': ['income_statement', 'balance_sheet', 'cash_flow'],
    'polygon_news': ['news'], 'polygon_ohlcv': ['ohlcv'], 'fred_macro': ['DFF', 'DGS10', 'VIXCLS', 'UNRATE', 'CPIAUCSL']}"""


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


def _days(spark, d):
    return t.bars(spark, d).select(F.col("date").alias("day")).distinct().filter(F.weekday("day") < 5)


def _shifted_cases(spark, d):
    """Cases moved to the assets' month, with a ticker, so that windows meet documents."""
    c = t.cases(spark, d)
    return c.withColumn("date", F.date_add(F.lit("2024-01-01").cast("date"), F.dayofmonth("date") - 1)).distinct()


SHIFTED = CASES + """, shifted AS (SELECT DISTINCT symbol, CAST(DATE '2024-01-01' + CAST(day(date) - 1 AS INT) AS DATE) AS date, move FROM cases)"""

QUERIES = {
    "bars_daily": lambda s, d: t.bars(s, d),
    "bars_range_summary": lambda s, d: t.bars(s, d).agg(F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.countDistinct("symbol").alias("symbols"), F.count(F.lit(1)).alias("n")),
    "symbols_distinct": lambda s, d: t.table(s, d, "events").select(F.col("event_type").alias("symbol")).filter("symbol is not null and symbol <> ''").distinct(),
    "symbol_bounds": lambda s, d: t.bars(s, d).groupBy("symbol").agg(F.min("date").alias("first_day"), F.max("date").alias("last_day")),
    "bars_range_read": lambda s, d: t.bars(s, d).filter("symbol = 'click' and date between '2024-01-05' and '2024-01-15'").select("date", "close"),
    "forward_returns": lambda s, d: timeseries.forward_returns(t.bars(s, d)).select("symbol", "date", *r6("ret_t0", "ret_t1", "ret_t3", "ret_t5")),
    "day_change": lambda s, d: timeseries.forward_returns(t.bars(s, d), ()).select("symbol", "date", F.round(F.coalesce(F.col("ret_t0") * 100, F.lit(0.0)), 6).alias("change_pct")),
    "intraday_move": lambda s, d: timeseries.intraday_move(t.bars(s, d)).select("symbol", "date", *r6("move_pct")),
    "event_detection": lambda s, d: timeseries.detected_events(t.long_bars(s, d), "1995-01-01").select("symbol", "date", *r6("ret"), F.col("place").cast("long").alias("place")),
    "big_move_events": lambda s, d: timeseries.big_moves(t.long_bars(s, d)).select("symbol", "date", *r6("ret"), "nth"),
    "abnormal_return_ols": lambda s, d: timeseries.abnormal_returns(t.long_bars(s, d)).select("symbol", "date", F.round("alpha", 5).alias("alpha"), F.round("beta", 5).alias("beta"), F.round("ar", 5).alias("ar"), timeseries.weight_tier(F.round("ar", 5)).alias("tier")),
    "ar_top_n": lambda s, d: timeseries.abnormal_returns(t.long_bars(s, d)).select("symbol", "date", F.round("ar", 5).alias("ar")).orderBy(F.desc(F.abs("ar")), "symbol", "date").limit(20),
    "align_trade_date": lambda s, d: timeseries.as_of_forward(t.news(s, d).select("asset_id", timeseries.candidate_date(F.col("published")).alias("candidate")), "candidate", _days(s, d)),
    "latest_snapshot_asof": lambda s, d: timeseries.as_of_latest(
        t.assets(s, d).filter("source_type = 'polygon_news'").select("asset_id", "ticker", "reference_date"),
        t.assets(s, d).filter("source_type = 'fmp_fundamentals'").groupBy("ticker", "reference_date").agg(F.max("asset_id").alias("snapshot")),
        "ticker", "reference_date", "reference_date", "snapshot"),
    "evidence_window_sql": lambda s, d: evidence.scoped(t.assets(s, d), "src1", "2024-01-05", "2024-01-20").select("asset_id", "source_type", "reference_date", *r6("score")),
    "evidence_layers": lambda s, d: evidence.scoped(t.assets(s, d), "src1", "2024-01-05", "2024-01-20", "macro").select("asset_id", "source_type", *r6("score")),
    "evidence_top_k": lambda s, d: evidence.scoped(t.assets(s, d), "src1", "2024-01-05", "2024-01-20", "macro", top=12).select("asset_id", "rank"),
    "coverage_audit": lambda s, d: evidence.coverage(_shifted_cases(s, d).select("symbol", "date").distinct(), t.assets(s, d)),
    "direct_min_per_ticker": lambda s, d: t.assets(s, d).filter(evidence.layer(F.col("source_type")) == "direct").groupBy("ticker", "reference_date").agg(F.countDistinct("asset_id").alias("n")).groupBy("ticker").agg(F.min("n").alias("least")),
    "macro_distinct_docs": lambda s, d: evidence.window_join(_shifted_cases(s, d).select("date").distinct(), t.assets(s, d).filter(evidence.layer(F.col("source_type")) == "macro")).agg(F.countDistinct("asset_id").alias("n_docs")),
    "session_guard": lambda s, d: t.assets(s, d).select("asset_id", "reference_date").join(t.bars(s, d).select(F.col("date").alias("reference_date")).distinct(), "reference_date", "left_semi"),
    "request_validation": lambda s, d: t.bars(s, d).groupBy("symbol").agg(F.min("date").alias("lo"), F.max("date").alias("hi")).join(
        t.table(s, d, "events").select(F.col("event_type").alias("symbol"), F.col("event_id"), F.date_add(F.to_date("ts"), ((F.col("event_id") % 5) - 2).cast("int")).alias("day")), "symbol").select(
        "event_id", F.when(F.col("day") < F.col("lo"), "before_range").when(F.col("day") > F.col("hi"), "after_range").otherwise("ok").alias("verdict")),
    "provenance_superset": lambda s, d: t.superset_check(t.assets(s, d), t.table(s, d, "labels").select(F.col("doc_id").alias("asset_id")), ["asset_id"]),
    "resume_antijoin": lambda s, d: t.assets(s, d).select("asset_id").join(t.table(s, d, "labels").select(F.col("doc_id").alias("asset_id")), "asset_id", "left_anti"),
    "upsert_latest": lambda s, d: t.upsert(t.bars(s, d).select("symbol", "date", "close"), t.bars(s, d).filter("volume > 50").select("symbol", "date", (F.col("close") + 1).alias("close")), ["symbol", "date"]).select("symbol", "date", *r6("close")),
    "corpus_pivot_totals": lambda s, d: t.assets(s, d).cube("ticker", "source_type").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("ticker", F.lit("total")).alias("ticker"), F.coalesce("source_type", F.lit("total")).alias("source_type"), "n"),
    "source_counts": lambda s, d: t.assets(s, d).groupBy("source_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source_type"),
    "provenance_manifest": lambda s, d: sinks.provenance({
        "assets": (t.assets(s, d), t.assets(s, d).filter("not is_duplicate"), ["asset_id"], "reference_date"), "bars": (t.bars(s, d), t.bars(s, d).filter("date >= '2024-01-10'"), ["symbol", "date"], "date"),
        "labels": (t.table(s, d, "labels"), t.assets(s, d).withColumnRenamed("asset_id", "doc_id"), ["doc_id"], None)}),
    "logical_source_fanout": lambda s, d: t.endpoints(t.table(s, d, "documents").select("doc_id", F.element_at(F.array(*map(F.lit, (*t.LOGICAL_SOURCES, "other"))), (F.col("doc_id") % 6 + 1).cast("int")).alias("source"))),
    "experiment_matrix": lambda s, d: t.table(s, d, "region").select("r_name").crossJoin(t.table(s, d, "nation").select("n_name")).crossJoin(s.createDataFrame([("full",), ("no_rerank",)], "profile string")),
    "config_compare_full_outer": lambda s, d: t.assets(s, d).groupBy("ticker").agg(F.count(F.lit(1)).alias("n_a")).join(
        t.assets(s, d).filter("source_type = 'fred_macro' and ticker <> 'src1'").groupBy("ticker").agg(F.count(F.lit(1)).alias("n_b")), "ticker", "full_outer").select("ticker", "n_a", "n_b", F.col("n_b").isNull().alias("missing_b")),
}

_AR = RETURNS + """, market AS (SELECT date, avg(ret) AS market FROM rets GROUP BY date), fit AS (
    SELECT r.symbol, r.date, r.ret, m.market, count(r.ret) OVER w AS n, regr_slope(r.ret, m.market) OVER w AS beta, regr_intercept(r.ret, m.market) OVER w AS alpha
    FROM rets r JOIN market m USING (date) WINDOW w AS (PARTITION BY r.symbol ORDER BY r.date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
    ars AS (SELECT symbol, date, round(alpha, 5) AS alpha, round(beta, 5) AS beta, round(ret - (alpha + beta * market), 5) AS ar FROM fit WHERE n = 60)"""

ORACLE_SQL = {
    "bars_daily": f"WITH {BARS} SELECT * FROM bars",
    "bars_range_summary": f"WITH {BARS} SELECT min(date) AS first_day, max(date) AS last_day, count(DISTINCT symbol) AS symbols, count(*) AS n FROM bars",
    "symbols_distinct": "SELECT DISTINCT event_type AS symbol FROM events WHERE event_type <> ''",
    "symbol_bounds": f"WITH {BARS} SELECT symbol, min(date) AS first_day, max(date) AS last_day FROM bars GROUP BY 1",
    "bars_range_read": f"WITH {BARS} SELECT date, close FROM bars WHERE symbol = 'click' AND date BETWEEN DATE '2024-01-05' AND DATE '2024-01-15'",
    "forward_returns": f"""WITH {BARS} SELECT symbol, date, round((close - lag(close) OVER w) / lag(close) OVER w, 6) AS ret_t0, round((lead(close) OVER w - close) / close, 6) AS ret_t1,
        round((lead(close, 3) OVER w - close) / close, 6) AS ret_t3, round((lead(close, 5) OVER w - close) / close, 6) AS ret_t5 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)""",
    "day_change": f"WITH {BARS} SELECT symbol, date, round(coalesce((close - lag(close) OVER w) / lag(close) OVER w * 100, 0.0), 6) AS change_pct FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)",
    "intraday_move": f"WITH {BARS} SELECT symbol, date, round(CASE WHEN open <> 0 THEN (close - open) / open * 100 END, 6) AS move_pct FROM bars",
    "event_detection": """WITH l AS (SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS date, arg_max(o_totalprice, o_orderkey) AS close FROM orders GROUP BY 1, 2),
        c AS (SELECT date, lag(date) OVER (ORDER BY date) AS before FROM (SELECT DISTINCT date FROM l)),
        r AS (SELECT l.symbol, l.date, (l.close - p.close) / p.close AS ret FROM l JOIN c ON c.date = l.date JOIN l p ON p.symbol = l.symbol AND p.date = c.before WHERE p.close <> 0),
        w AS (SELECT date FROM r GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT symbol) FROM l)),
        k AS (SELECT r.*, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS place FROM r WHERE date IN (SELECT date FROM w))
        SELECT symbol, date, round(ret, 6) AS ret, place FROM k WHERE abs(ret) > 0.03 AND place >= 60 AND date >= DATE '1995-01-01'""",
    "big_move_events": f"WITH {RETURNS}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS nth FROM rets) SELECT symbol, date, round(ret, 6) AS ret, nth FROM n WHERE abs(ret) > 0.03 AND nth > 60",
    "abnormal_return_ols": f"WITH {_AR} SELECT symbol, date, alpha, beta, ar, CASE WHEN abs(ar) > 0.05 THEN 'high' WHEN abs(ar) > 0.02 THEN 'medium' ELSE 'low' END AS tier FROM ars",
    "ar_top_n": f"WITH {_AR} SELECT symbol, date, ar FROM ars ORDER BY abs(ar) DESC, symbol, date LIMIT 20",
    "align_trade_date": f"""WITH {BARS}, {NEWS}, days AS (SELECT DISTINCT date AS day FROM bars WHERE isodow(date) < 6),
        c AS (SELECT asset_id, timezone('America/New_York', timezone('UTC', published)) AS local FROM news),
        d AS (SELECT asset_id, CAST(CAST(local AS DATE) + CASE WHEN hour(local) >= 16 THEN 1 ELSE 0 END AS DATE) AS candidate FROM c)
        SELECT asset_id, candidate, (SELECT min(day) FROM days WHERE day >= candidate) AS trade_date FROM d""",
    "latest_snapshot_asof": f"""WITH {ASSETS}, snaps AS (SELECT ticker, reference_date, max(asset_id) AS snapshot FROM assets WHERE source_type = 'fmp_fundamentals' GROUP BY 1, 2)
        SELECT a.asset_id, a.ticker, a.reference_date, s.snapshot AS latest_snapshot FROM (SELECT * FROM assets WHERE source_type = 'polygon_news') a
        ASOF LEFT JOIN snaps s ON a.ticker = s.ticker AND a.reference_date >= s.reference_date""",
    "evidence_window_sql": f"""WITH {ASSETS} SELECT asset_id, source_type, reference_date, round(1 / row_number() OVER (ORDER BY reference_date DESC, asset_id), 6) AS score
        FROM assets WHERE ticker = 'src1' AND source_type IN {DIRECT} AND NOT coalesce(is_duplicate, false) AND reference_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'""",
    "evidence_layers": f"""WITH {ASSETS} SELECT asset_id, source_type, round(1 / row_number() OVER (ORDER BY reference_date DESC, asset_id), 6) AS score
        FROM assets WHERE reference_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND source_type IN {MACRO} AND NOT coalesce(is_duplicate, false)""",
    "evidence_top_k": f"""WITH {ASSETS} SELECT asset_id, row_number() OVER (ORDER BY reference_date DESC, asset_id) AS rank FROM assets
        WHERE reference_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND source_type IN {MACRO} AND NOT coalesce(is_duplicate, false) ORDER BY reference_date DESC, asset_id LIMIT 12""",
    "coverage_audit": f"""WITH {SHIFTED}, {ASSETS}, c AS (SELECT DISTINCT symbol, date FROM shifted)
        SELECT c.symbol, c.date, count(*) FILTER ({LAYER} = 'direct' AND asset_id IS NOT NULL) AS n_direct, count(*) FILTER ({LAYER} = 'macro' AND asset_id IS NOT NULL) AS n_macro, count(asset_id) AS n_any
        FROM c LEFT JOIN assets a ON a.reference_date BETWEEN c.date - 3 AND c.date + 3 GROUP BY 1, 2""",
    "direct_min_per_ticker": f"WITH {ASSETS}, g AS (SELECT ticker, reference_date, count(DISTINCT asset_id) AS n FROM assets WHERE {LAYER} = 'direct' GROUP BY 1, 2) SELECT ticker, min(n) AS least FROM g GROUP BY 1",
    "macro_distinct_docs": f"WITH {SHIFTED}, {ASSETS} SELECT count(DISTINCT asset_id) AS n_docs FROM shifted c JOIN assets a ON a.reference_date BETWEEN c.date - 3 AND c.date + 3 WHERE {LAYER} = 'macro'",
    "session_guard": f"WITH {BARS}, {ASSETS} SELECT reference_date, asset_id FROM assets WHERE reference_date IN (SELECT date FROM bars)",
    "request_validation": f"""WITH {BARS}, b AS (SELECT symbol, min(date) AS lo, max(date) AS hi FROM bars GROUP BY 1),
        e AS (SELECT event_id, event_type AS symbol, CAST(CAST(ts AS DATE) + CAST(event_id % 5 - 2 AS INT) AS DATE) AS day FROM events)
        SELECT event_id, CASE WHEN day < lo THEN 'before_range' WHEN day > hi THEN 'after_range' ELSE 'ok' END AS verdict FROM e JOIN b USING (symbol)""",
    "provenance_superset": "SELECT (SELECT count(DISTINCT doc_id) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS missing, (SELECT count(DISTINCT doc_id) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS extra",
    "resume_antijoin": "SELECT doc_id AS asset_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "upsert_latest": f"WITH {BARS} SELECT symbol, date, round(CASE WHEN volume > 50 THEN close + 1 ELSE close END, 6) AS close FROM bars",
    "corpus_pivot_totals": f"WITH {ASSETS} SELECT coalesce(ticker, 'total') AS ticker, coalesce(source_type, 'total') AS source_type, count(*) AS n FROM assets GROUP BY CUBE (ticker, source_type)",
    "source_counts": f"WITH {ASSETS} SELECT source_type, count(*) AS n FROM assets GROUP BY 1",
    "provenance_manifest": f"""WITH {ASSETS}, {BARS}, f AS (SELECT * FROM assets WHERE NOT is_duplicate), b AS (SELECT * FROM bars WHERE date >= DATE '2024-01-10')
        SELECT 'assets' AS name, (SELECT count(*) FROM assets) AS n_source, (SELECT count(*) FROM f) AS n_target, (SELECT count(*) FROM (SELECT asset_id FROM assets EXCEPT SELECT asset_id FROM f)) AS missing, 0 AS extra, false AS superset,
            (SELECT min(reference_date) FROM f) AS first, (SELECT max(reference_date) FROM f) AS last
        UNION ALL SELECT 'bars', (SELECT count(*) FROM bars), (SELECT count(*) FROM b), (SELECT count(*) FROM (SELECT symbol, date FROM bars EXCEPT SELECT symbol, date FROM b)), 0, (SELECT count(*) FROM bars) = (SELECT count(*) FROM b), (SELECT min(date) FROM b), (SELECT max(date) FROM b)
        UNION ALL SELECT 'labels', (SELECT count(*) FROM labels), (SELECT count(*) FROM assets), (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT asset_id FROM assets)), (SELECT count(*) FROM (SELECT asset_id FROM assets EXCEPT SELECT doc_id FROM labels)),
            (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT asset_id FROM assets)) = 0, NULL, NULL""",
    "logical_source_fanout": f"""WITH r AS (SELECT doc_id, ['fmp_fundamentals', 'yfinance_fundamentals', 'polygon_news', 'polygon_ohlcv', 'fred_macro', 'other'][doc_id % 6 + 1] AS source FROM documents)
        SELECT doc_id, source, unnest(coalesce(({ENDPOINTS})[source], [source])) AS endpoint FROM r""",
    "experiment_matrix": "SELECT r_name, n_name, profile FROM region, nation, (VALUES ('full'), ('no_rerank')) p(profile)",
    "config_compare_full_outer": f"""WITH {ASSETS}, a AS (SELECT ticker, count(*) AS n_a FROM assets GROUP BY 1),
        b AS (SELECT ticker, count(*) AS n_b FROM assets WHERE source_type = 'fred_macro' AND ticker <> 'src1' GROUP BY 1) SELECT ticker, n_a, n_b, n_b IS NULL AS missing_b FROM a FULL JOIN b USING (ticker)""",
}
