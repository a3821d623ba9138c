"""Raw payloads of endpoints: reading bars, articles, statements and observations out of JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.sources.tables import LOGICAL_SOURCES

BAR = "struct<t:long,o:string,h:string,l:string,c:string,v:string>"
ARTICLE = ("struct<title:string,published_utc:string,source:string,publisher:struct<name:string>,url:string,article_url:string,"
           "content:string,description:string>")
# Which connector serves an endpoint.
CONNECTORS = {"polygon": ["ohlcv", "news"], "fmp": ["income_statement", "balance_sheet", "cash_flow"], "fred": ["DFF", "DGS10", "VIXCLS", "UNRATE", "CPIAUCSL"]}


def usable(responses: DataFrame) -> DataFrame:
    """Responses (endpoint, status, payload) that came with status 200 and a payload."""
    return responses.filter((F.col("status") == 200) & F.col("payload").isNotNull())


def ingested(responses: DataFrame, *keys: str) -> DataFrame:
    """Per key: how many endpoints answered, and whether any did."""
    good = (F.col("status") == 200) & F.col("payload").isNotNull()
    return responses.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(good).alias("n_ok")).withColumn("ok", F.col("n_ok") > 0)


def connector(endpoint: Column) -> Column:
    """The connector of an endpoint; null if there is none."""
    out = F.lit(None).cast("string")
    for name, some in CONNECTORS.items():
        out = F.when(endpoint.isin(some), name).otherwise(out)
    return out


def bars(payloads: DataFrame) -> DataFrame:
    """symbol, date and prices of payloads (symbol, payload) with ``results`` of bars by epoch milliseconds; of a day's
    bars the last counts, and a bar with a missing or bad number is null in it."""
    rows = payloads.select("symbol", F.explode(F.from_json("payload", f"results array<{BAR}>")["results"]).alias("b"))
    rows = rows.withColumn("date", F.to_date(F.timestamp_millis("b.t")))
    last = F.max_by(F.col("b"), F.col("b.t")).alias("b")
    return rows.groupBy("symbol", "date").agg(last).select("symbol", "date", *(F.col(f"b.{k}").try_cast("double").alias(name) for k, name in zip("ohlcv", ("open", "high", "low", "close", "volume"))))


def first_bar(payload: Column) -> Column:
    """open, high, low, close and volume of a payload's first bar; null if it has none or a number is missing or bad."""
    b = F.get(F.from_json(payload, f"results array<{BAR}>")["results"], 0)
    values = {name: b[k].try_cast("double") for k, name in zip("ohlcv", ("open", "high", "low", "close", "volume"))}
    whole = F.lit(True)
    for v in values.values():
        whole &= v.isNotNull()
    return F.when(whole, F.struct(*(v.alias(k) for k, v in values.items())))


def articles(payload: Column) -> Column:
    """The articles of a payload: a lone key around an object is taken off; then ``articles`` or else ``results``, or the
    payload itself if it is a list; one object counts as a list of one; what is no object is dropped."""
    document = F.try_parse_json(payload)
    only = F.from_json(payload, "map<string,string>")
    inner = F.when((F.size(only) == 1) & F.get(F.map_values(only), 0).startswith("{"), F.get(F.map_values(only), 0)).otherwise(payload)
    found = F.from_json(inner, "articles string, results string")
    some = lambda x: F.when(~x.isin("", "[]", "{}", "null", '""'), x)
    listed = F.coalesce(some(found["articles"]), some(found["results"]), F.when(F.ltrim(payload).startswith("["), payload))
    wrapped = F.when(F.ltrim(listed).startswith("{"), F.concat(F.lit("["), listed, F.lit("]"))).otherwise(listed)
    entries = F.filter(F.from_json(wrapped, "array<string>"), lambda x: F.ltrim(x).startswith("{"))
    # A publisher is an object with a name, or a name.
    def entry(x):
        a = F.from_json(x, "title string, published_utc string, source string, publisher string, url string, article_url string, content string, description string")
        name = F.when(a["publisher"].startswith("{"), F.get_json_object(a["publisher"], "$.name")).otherwise(a["publisher"])
        return a.withField("publisher", name)

    return F.when(document.isNotNull(), F.coalesce(F.transform(entries, entry), F.array().cast("array<struct<title:string,published_utc:string,source:string,publisher:string,url:string,article_url:string,content:string,description:string>>")))


def first_of_lists(payload: Column) -> Column:
    """A map of a payload's keys, the first entry standing for a list that has one."""
    found = F.from_json(payload, "map<string,string>")
    return F.transform_values(found, lambda _, v: F.when(v.startswith("["), F.coalesce(F.get(F.from_json(v, "array<string>"), 0), v)).otherwise(v))


def kind(source_type: Column) -> Column:
    """Which cleaner and renderer a source type takes."""
    return F.when(F.contains(source_type, F.lit("news")), "news").when(F.contains(source_type, F.lit("fmp")) | F.contains(source_type, F.lit("fundamentals")), "fundamentals").otherwise("generic")


def observations(rows: DataFrame, asked: Column, days: int = 30) -> DataFrame:
    """Observations (date, value) of the days up to the one asked for; a value of "." is no value."""
    return rows.filter((F.col("value") != ".") & F.col("date").between(F.date_sub(asked, days), asked)).withColumn("value", F.col("value").try_cast("double"))


def unknown_sources(wanted: DataFrame) -> DataFrame:
    """Wanted sources (column source) that no endpoint stands for."""
    known = wanted.sparkSession.createDataFrame([(k,) for k in LOGICAL_SOURCES], "source string")
    return wanted.join(F.broadcast(known), "source", "left_anti")
