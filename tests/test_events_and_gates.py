"""Detected events against pandas, and gates by hand."""

import datetime as dt
import random

import pandas as pd
import pytest

from quarry.operators import grounding, timeseries


def test_events_against_pandas(spark):
    """Days on which a symbol has no return are left out for all of them; so is a return over a day without a close."""
    rng = random.Random(6)
    start = dt.date(2024, 1, 1)
    rows = [(s, start + dt.timedelta(days=i), round(rng.uniform(50, 60), 2)) for i in range(160) for s in "abc" if rng.random() > 0.04]
    close = pd.DataFrame(rows, columns=["s", "d", "c"]).pivot(index="d", columns="s", values="c")
    returns = close.pct_change(fill_method=None).dropna()
    want = {(s, d): (round(v, 9), i) for s in "abc" for i, (d, v) in enumerate(returns[s].items()) if abs(v) > 0.03 and i >= 20 and d >= dt.date(2024, 3, 1)}
    bars = spark.createDataFrame(rows, "symbol string, date date, close double").repartition(4)
    got = {(r.symbol, r.date): (round(r.ret, 9), r.place) for r in timeseries.detected_events(bars, "2024-03-01", history=20).collect()}
    assert got == want and len(want) > 20 and len(returns) < len(close) - 1
    zero = spark.createDataFrame([("a", start, 0.0), ("a", start + dt.timedelta(days=1), 5.0)], bars.schema)
    assert timeseries.detected_events(zero, "2024-01-01", history=0).collect() == [] and timeseries.common_returns(bars.limit(0)).collect() == []


RESULTS = "config string, run_id long, output_status string, should_refuse boolean, cited array<long>, retrieved array<long>, latency_ms double, cost_usd double, tokens double"


def test_gate_measures(spark):
    rows = [("direct", 1, "SUFFICIENT", False, [1, 2, 9], [1, 2, 3], 1.0, 1.0, 1.0), ("direct", 2, "INSUFFICIENT", True, [], [], 1.0, 0.0, 0.0), ("direct", 3, "PARTIAL", True, [7], None, 1.0, 1.0, 1.0),
            ("full", 4, "MAYBE", False, None, [1], 1.0, 1.0, 1.0), ("full", 1, None, True, [5], [5], None, 1.0, 1.0)]
    traces = spark.createDataFrame([(1,), (1,), (2,), (77,)], "run_id long")
    statuses = ["SUFFICIENT", "PARTIAL", "INSUFFICIENT"]
    got = grounding.gate_measures(spark.createDataFrame(rows, RESULTS), traces, statuses).head()
    assert tuple(got) == (3 / 5, 2 / 5, 3 / 5, 0.0, False)
    none = grounding.gate_measures(spark.createDataFrame([], RESULTS), traces, statuses).head()
    assert tuple(none) == (1.0, 0.0, 0.0, 0.0, True)


def test_gate_report(spark):
    one = spark.createDataFrame([(0.5, 0.3, True, None)], "a double, b double, c boolean, d double")
    report = lambda *rules: {r.gate: (r.value, r.verdict) for r in grounding.gate_report(one, list(rules)).collect()}
    assert report(("a", ">=", 0.5), ("b", "==", 0.3), ("c", "==", 1)) == {"a": (0.5, "PASS"), "b": (0.3, "PASS"), "c": (1.0, "PASS"), "overall": (3.0, "PASS")}
    assert report(("a", "==", 0.6), ("d", ">=", 0), ("c", ">=", 1)) == {"a": (0.5, "FAIL"), "d": (None, "FAIL"), "c": (1.0, "PASS"), "overall": (1.0, "FAIL")}
    with pytest.raises(ValueError):
        grounding.gate_report(one, [("a", ">", 1)])
