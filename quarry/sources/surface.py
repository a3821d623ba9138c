"""The entry points as SQL table functions of a session: called by name with named arguments, defaults and parameter
markers, joined to tables of arguments by LATERAL, and optimised with the query around them.

    surface.register(spark, sf_dir)
    spark.sql("SELECT * FROM api_ohlcv(:ticker, since => :since)", args={"ticker": "view", "since": "2024-01-10"})

A null bound is no bound, both bounds are included; an unknown ticker or run and a turned range give no rows."""

from __future__ import annotations

from pyspark.sql import SparkSession

from quarry.sources import tables as t

#: Name: arguments, columns, body. Views are the engine's own tables.
FUNCTIONS = {
    "api_tickers": ("", "ticker STRING, first DATE, last DATE", "SELECT upper(symbol), min(date), max(date) FROM quarry_bars GROUP BY upper(symbol)"),
    "api_ohlcv": ("ticker STRING, since DATE DEFAULT NULL, till DATE DEFAULT NULL", "date DATE, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume BIGINT",
                  "SELECT date, open, high, low, close, volume FROM quarry_bars b WHERE b.symbol = lower(api_ohlcv.ticker) AND (api_ohlcv.since IS NULL OR date >= api_ohlcv.since) AND (api_ohlcv.till IS NULL OR date <= api_ohlcv.till)"),
    "api_range": ("ticker STRING", "min_date DATE, max_date DATE, n_rows BIGINT", "SELECT min(date), max(date), count(*) FROM quarry_bars b WHERE b.symbol = lower(api_range.ticker)"),
    "api_news": ("ticker STRING, till DATE, days INT DEFAULT 3, most INT DEFAULT 20", "asset_id BIGINT, reference_date DATE, title STRING, nth INT",
                 """SELECT asset_id, reference_date, title, nth FROM (
                        SELECT asset_id, reference_date, title, row_number() OVER (ORDER BY reference_date DESC, published DESC, asset_id) AS nth
                        FROM quarry_news n WHERE n.ticker = api_news.ticker AND n.source_type = 'polygon_news' AND reference_date BETWEEN date_sub(api_news.till, api_news.days) AND api_news.till) AS l
                    WHERE nth <= api_news.most"""),
    "api_fundamentals": ("ticker STRING, day DATE", "asset_id BIGINT, reference_date DATE",
                         """SELECT best.asset_id, best.reference_date FROM (
                                SELECT max(struct(reference_date, asset_id)) AS best FROM quarry_news n
                                WHERE n.ticker = api_fundamentals.ticker AND n.source_type = 'fmp_fundamentals' AND reference_date <= api_fundamentals.day) AS b WHERE best IS NOT NULL"""),
    "api_run_events": ("run BIGINT, after_seq BIGINT DEFAULT -1, most INT DEFAULT 1000", "event_seq BIGINT, node STRING, latency_ms BIGINT",
                       """SELECT event_seq, node, latency_ms FROM (
                              SELECT event_seq, node, latency_ms, row_number() OVER (ORDER BY event_seq) AS nth FROM quarry_events e WHERE e.run_id = api_run_events.run AND event_seq > api_run_events.after_seq) AS l
                          WHERE nth <= api_run_events.most"""),
}


def register(spark: SparkSession, sf_dir: str) -> list[str]:
    """Makes the functions and their views known to the session; returns their names. Calling it again with other data replaces them."""
    t.bars(spark, sf_dir).createOrReplaceTempView("quarry_bars")
    t.news(spark, sf_dir).select("asset_id", "ticker", "source_type", "reference_date", "title", "published").createOrReplaceTempView("quarry_news")
    t.trace_events(spark, sf_dir).createOrReplaceTempView("quarry_events")
    for name, (arguments, columns, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS TABLE ({columns}) RETURN {body}")
    return list(FUNCTIONS)
