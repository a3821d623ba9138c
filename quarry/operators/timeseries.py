"""Returns, events, rolling regressions and as-of alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _line() -> Window:
    return Window.partitionBy("symbol").orderBy("date")


def forward_returns(bars: DataFrame, steps: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """ret_t0 from the session before, ret_tN to N sessions later; null where a session is missing."""
    close = F.col("close")
    out = {"ret_t0": F.try_divide(close - F.lag(close).over(_line()), F.lag(close).over(_line()))}
    out |= {f"ret_t{n}": F.try_divide(F.lead(close, n).over(_line()) - close, close) for n in steps}
    return bars.withColumns(out)


def intraday_move(bars: DataFrame) -> DataFrame:
    return bars.withColumn("move_pct", F.when(F.col("open") != 0, (F.col("close") - F.col("open")) / F.col("open") * 100))


def daily_returns(bars: DataFrame) -> DataFrame:
    before = F.lag("close").over(_line())
    return bars.withColumn("ret", F.try_divide(F.col("close") - before, before)).filter("ret is not null")


def big_moves(bars: DataFrame, threshold: float = 0.03, history: int = 60) -> DataFrame:
    """Returns beyond the threshold that have enough returns before them."""
    return daily_returns(bars).withColumn("nth", F.row_number().over(_line())).filter((F.abs("ret") > threshold) & (F.col("nth") > history))


def common_returns(bars: DataFrame) -> DataFrame:
    """Returns (symbol, date, ret, place) of the days on which every symbol has one. A day's return is taken over the day before it
    in the calendar of all symbols, so it takes a close on both; place counts a symbol's days from 0. The calendar has a
    row a day."""
    days = bars.select("date").distinct()
    calendar = days.select("date", F.lag("date").over(Window.orderBy("date")).alias("before")).filter("before is not null")
    last = bars.select("symbol", F.col("date").alias("before"), F.col("close").alias("last"))
    own = bars.join(F.broadcast(calendar), "date").join(last, ["symbol", "before"])
    own = own.select("symbol", "date", F.try_divide(F.col("close") - F.col("last"), F.col("last")).alias("ret")).filter("ret is not null")
    symbols = bars.agg(F.countDistinct("symbol").alias("symbols"))
    whole = own.groupBy("date").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(symbols)).filter("n = symbols").select("date")  # symbols is one row
    return own.join(F.broadcast(whole), "date", "left_semi").withColumn("place", F.row_number().over(_line()) - 1)


def detected_events(bars: DataFrame, since: str, threshold: float = 0.03, history: int = 60) -> DataFrame:
    """Days from a date on whose return is beyond the threshold, with enough days before them to estimate from."""
    return common_returns(bars).filter((F.abs("ret") > threshold) & (F.col("place") >= history) & (F.col("date") >= F.lit(since).cast("date")))


def abnormal_returns(bars: DataFrame, window: int = 60) -> DataFrame:
    """alpha, beta over the window before each day, against the mean return of all symbols; ar is what they don't explain."""
    own = daily_returns(bars)
    market = own.groupBy("date").agg(F.avg("ret").alias("market"))
    joined = own.join(market, "date")
    frame = _line().rowsBetween(-window, -1)
    joined = joined.withColumns({"n": F.count("ret").over(frame), "beta": F.regr_slope("ret", "market").over(frame),
                                 "alpha": F.regr_intercept("ret", "market").over(frame)}).filter(F.col("n") == window)
    return joined.withColumn("ar", F.col("ret") - (F.col("alpha") + F.col("beta") * F.col("market")))


def weight_tier(ar: Column) -> Column:
    return F.when(F.abs(ar) > 0.05, "high").when(F.abs(ar) > 0.02, "medium").otherwise("low")


def candidate_date(published: Column) -> Column:
    """New York's date of a UTC time, the next one from 16:00 on."""
    local = F.from_utc_timestamp(published.cast("timestamp"), "America/New_York")
    return F.date_add(F.to_date(local), F.when(F.hour(local) >= 16, 1).otherwise(0))


def as_of_forward(left: DataFrame, date_col: str, days: DataFrame, out: str = "trade_date") -> DataFrame:
    """The first of days on or after the date. Each calendar date is listed once with its day, so this is an equi-join;
    Spark broadcasts the list while it is small. A calendar's rows follow time, not data."""
    line = Window.orderBy("day")  # the calendar, a row a day
    spans = days.select("day").distinct().select("day", F.lag("day").over(line).alias("before"))
    dates = spans.select(F.explode(F.sequence(F.coalesce(F.date_add("before", 1), "day"), "day")).alias("__date"), F.col("day").alias("__next"))
    first = days.agg(F.min("day").alias("__first"))  # one row
    joined = left.crossJoin(F.broadcast(first)).join(dates, F.col(date_col) == F.col("__date"), "left")
    return joined.withColumn(out, F.coalesce("__next", F.when(F.col(date_col) < F.col("__first"), F.col("__first")))).drop("__date", "__next", "__first")


def as_of_latest(left: DataFrame, right: DataFrame, key: str, left_date: str, right_date: str, value: str) -> DataFrame:
    """The value of right's latest row on or before left's date, by key: a union and a window inside each month of a key,
    and what the months before left off with; no range join, and no window over all of a key."""
    columns = left.columns
    month = F.trunc("__at", "month")
    a = left.select(*columns, F.col(left_date).alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast(right.schema[value].dataType).alias("__value"))
    empty = [F.lit(None).cast(left.schema[c].dataType).alias(c) if c != key else F.col(key) for c in columns]
    b = right.select(*empty, F.col(right_date).alias("__at"), F.lit(0).alias("__side"), F.col(value).alias("__value"))
    rows = a.unionByName(b).withColumn("__month", month)
    # A row for each month of a key.
    ends = rows.groupBy(F.col(key).alias("__key"), F.col("__month").alias("__m")).agg(F.max_by("__value", F.when(F.col("__value").isNotNull(), F.struct("__at", "__value"))).alias("__end"))
    before = Window.partitionBy("__key").orderBy("__m").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("__carried", F.last("__end", ignorenulls=True).over(before)).drop("__end")
    frame = Window.partitionBy(key, "__month").orderBy("__at", "__side", "__value").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("__own", F.last("__value", ignorenulls=True).over(frame)).filter("__side = 1")
    found = found.join(ends, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__month") == F.col("__m")), "left")
    return found.withColumn(f"latest_{value}", F.coalesce("__own", "__carried")).drop("__at", "__side", "__value", "__month", "__own", "__key", "__m", "__carried")
