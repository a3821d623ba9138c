"""The entry points by name: arguments, defaults, markers, and what nobody knows."""

import datetime as dt

import pytest

from quarry.sources import surface, tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql(spark):
    names = surface.register(spark, SF)
    assert set(names) == set(surface.FUNCTIONS)
    return lambda text, **args: [tuple(r) for r in spark.sql(text, args=args).collect()]


def test_bounds(spark, sql):
    want = sorted((r.date, r.volume) for r in tables.bars(spark, SF).filter("symbol = 'view'").collect())
    days = [d for d, _ in want]
    call = lambda more="", **args: sorted(sql(f"SELECT date, volume FROM api_ohlcv(:t{more})", t="VIEW", **args))
    assert call() == want
    assert call(", since => :s", s=days[3]) == want[3:] and call(", till => :u", u=days[3]) == want[:4]
    assert call(", :s, :u", s=days[2], u=days[5]) == want[2:6] and call(", :s, :u", s=days[5], u=days[2]) == []
    assert call(", since => :s", s=dt.date(2099, 1, 1)) == []
    for ticker in ("nobody", "", None, "view' OR '1'='1"):
        assert sql("SELECT * FROM api_ohlcv(:t)", t=ticker) == []
    assert sql("SELECT * FROM api_range(:t)", t="nobody") == [(None, None, 0)] and sql("SELECT * FROM api_range('view')") == [(days[0], days[-1], sum(1 for _ in want))]
    assert {r[0] for r in sql("SELECT * FROM api_tickers()")} == {r.symbol.upper() for r in tables.bars(spark, SF).select("symbol").distinct().collect()}


def test_limits_and_cursors(spark, sql):
    events = sorted((r.event_seq, r.node) for r in tables.trace_events(spark, SF).filter("run_id = 3").collect())
    call = lambda **args: [x[:2] for x in sql(f"SELECT * FROM api_run_events({', '.join(f'{k} => :{k}' for k in args)})", **args)]
    assert sorted(call(run=3)) == events and sorted(call(run=3, after_seq=0)) == [e for e in events if e[0] > 0] and call(run=-99) == []
    assert sorted(call(run=3, most=1)) == events[:1] and call(run=3, most=0) == [] and call(run=3, after_seq=10**6) == []
    news = sql("SELECT nth, asset_id, reference_date FROM api_news('src1', DATE'2024-01-20', days => 30, most => 2)")
    assert [n[0] for n in sorted(news)] == list(range(1, len(news) + 1)) and len(news) <= 2
    assert sql("SELECT * FROM api_fundamentals('src1', DATE'1999-01-01')") == []


def test_joined_to_a_table_of_arguments(spark, sql):
    plan = spark.sql("SELECT a.t, o.* FROM VALUES ('view'), ('nobody') AS a(t), LATERAL api_ohlcv(a.t) AS o")
    assert plan.count() == tables.bars(spark, SF).filter("symbol = 'view'").count()
    assert "CartesianProduct" not in plan._jdf.queryExecution().toString()


def test_other_data_replaces_views(spark, sql):
    before = sql("SELECT count(*) FROM api_run_events(3)")
    surface.register(spark, "/root/testdata/sf0.01")
    assert sql("SELECT sum(n_rows) FROM api_tickers(), LATERAL api_range(ticker)")[0][0] == tables.bars(spark, "/root/testdata/sf0.01").count()
    surface.register(spark, SF)
    assert sql("SELECT count(*) FROM api_run_events(3)") == before
