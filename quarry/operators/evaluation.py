"""Metrics over graded causes, paired statistics, calibration."""

from __future__ import annotations

from math import comb, erfc, exp, lgamma, log, sqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.text import jaccard, words
from quarry.sources import shared


def greedy_matches(predicted: Column, golden: Column, threshold: float = 0.26) -> Column:
    """How many predicted texts find a golden one of their own, in order, the most alike first. Arrays of arrays of words."""
    state = F.struct(F.lit(0).alias("hits"), F.sequence(F.lit(0), F.size(golden) - 1).alias("left"))

    def step(s, p):
        best = F.array_max(F.transform(s["left"], lambda i: F.struct(jaccard(p, golden[i]).alias("j"), (-i).alias("i"))))
        hit = F.coalesce(best["j"] > threshold, F.lit(False))
        return F.struct((s["hits"] + hit.cast("int")).alias("hits"), F.when(hit, F.array_remove(s["left"], -best["i"])).otherwise(s["left"]).alias("left"))

    return F.when((F.size(golden) == 0) | (F.size(predicted) == 0), 0).otherwise(F.aggregate(predicted, state, step)["hits"])


def attribution_f1(cases: DataFrame) -> DataFrame:
    """case_id and f1 of arrays of texts predicted and golden."""
    p, g = (F.transform(c, words) for c in ("predicted", "golden"))
    hits = greedy_matches(p, g)
    return cases.select("case_id", F.round(F.coalesce(F.try_divide(2 * hits, F.size("predicted") + F.size("golden")), F.lit(0.0)), 6).alias("f1"))


def contingency(pairs: DataFrame, values: list) -> DataFrame:
    return pairs.groupBy("a").pivot("b", values).count().na.fill(0)


def discordance(pairs: DataFrame) -> DataFrame:
    return pairs.agg(*(F.count_if((F.col("a") == i) & (F.col("b") == j)).alias(f"n{i}{j}") for i in (0, 1) for j in (0, 1)))


def mcnemar_p(n01: int, n10: int) -> float:
    n = n01 + n10
    if n == 0:
        return 1.0
    if n < 25:
        return min(1.0, 2 * sum(comb(n, k) for k in range(min(n01, n10) + 1)) / 2**n)
    return erfc(sqrt((abs(n01 - n10) - 1) ** 2 / n / 2))


def chi2_tail(x: float, df: int) -> float:
    """The share of the chi-square distribution above x, for any whole number of degrees of freedom."""
    if df < 1:
        raise ValueError(f"degrees of freedom: {df}")
    if x <= 0:
        return 1.0
    # Two degrees more add (x / 2) ** (df / 2) * exp(-x / 2) / gamma(df / 2 + 1).
    tail, at = (erfc(sqrt(x / 2)), 1) if df % 2 else (exp(-x / 2), 2)
    while at < df:
        tail += exp(at / 2 * log(x / 2) - x / 2 - lgamma(at / 2 + 1))
        at += 2
    return min(1.0, tail)


def bowker(pairs: DataFrame) -> DataFrame:
    """The symmetry statistic and its degrees of freedom."""
    n = pairs.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(
        F.count_if(F.col("a") < F.col("b")).alias("up"), F.count_if(F.col("a") > F.col("b")).alias("down")).filter("lo <> hi")
    return n.agg(F.round(F.coalesce(F.sum(F.pow(F.col("up") - F.col("down"), 2) / (F.col("up") + F.col("down"))), F.lit(0.0)), 6).alias("statistic"), F.count(F.lit(1)).alias("df"))


def wilcoxon_w(pairs: DataFrame) -> DataFrame:
    """Rank sums of positive and negative differences x - y; zeros are dropped, ties share their mean rank. Ranks
    come from counts of distinct differences, added up over ranges."""
    d = pairs.select((F.col("x") - F.col("y")).alias("d")).filter("d <> 0").groupBy(F.abs("d").alias("m")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("d") > 0).alias("up"))
    r = shared.prefix_sums(d, "m", "n", "before").withColumn("rank", F.col("before") + (F.col("n") + 1) / 2)
    return r.agg(F.coalesce(F.sum(F.col("rank") * F.col("up")), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum(F.col("rank") * (F.col("n") - F.col("up"))), F.lit(0.0)).alias("w_minus"))


def cohens_dz(pairs: DataFrame) -> DataFrame:
    d = F.col("x") - F.col("y")
    return pairs.agg(F.round(F.coalesce(F.try_divide(F.avg(d), F.stddev_samp(d)), F.lit(0.0)), 6).alias("dz"))


def holm(p_values: DataFrame) -> DataFrame:
    """Adjusted p by family: (m - rank + 1) p, never falling, at most 1."""
    w = Window.partitionBy("family").orderBy("p", "name")
    m = F.count(F.lit(1)).over(Window.partitionBy("family"))
    raw = (m - F.row_number().over(w) + 1) * F.col("p")
    return p_values.withColumn("raw", raw).withColumn("adjusted", F.round(F.least(F.lit(1.0), F.max("raw").over(w.rowsBetween(Window.unboundedPreceding, 0))), 6)).drop("raw")


def calibrate(observations: DataFrame, ks: list[int], ms: list[float]) -> DataFrame:
    """Accuracy of every pair of thresholds (a stated grid) on observations (n, coverage, expected)."""
    spark = observations.sparkSession
    grid = spark.createDataFrame([(k, m) for k in ks for m in ms], "k int, m double")
    predicted = F.when((F.col("n") >= F.col("k")) & (F.col("coverage") >= F.col("m")), "sufficient").when(F.col("n") == 0, "insufficient").otherwise("partial")
    return observations.crossJoin(F.broadcast(grid)).groupBy("k", "m").agg(F.round(F.avg(F.when(predicted == F.col("expected"), 1.0).otherwise(0.0)), 6).alias("accuracy"))


def buckets(rows: DataFrame, n: int = 4) -> DataFrame:
    """Confidence buckets (half-open): mean confidence, accuracy and their distance. rows: confidence, correct."""
    b = F.least(F.floor(F.col("confidence") * n), F.lit(n - 1))
    out = rows.groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("c"), F.avg(F.col("correct").cast("double")).alias("a"))
    return out.select("bucket", "n", F.round("c", 6).alias("mean_confidence"), F.round("a", 6).alias("accuracy"), F.round(F.abs(F.col("c") - F.col("a")), 6).alias("error"))


def calibration_score(rows: DataFrame, n: int = 4) -> DataFrame:
    """Per case, 1 less the mean distance of confidence and accuracy over its buckets. rows: case_id, confidence, correct."""
    b = F.least(F.floor(F.col("confidence") * n), F.lit(n - 1))
    errors = rows.groupBy("case_id", b.alias("bucket")).agg(F.abs(F.avg("confidence") - F.avg(F.col("correct").cast("double"))).alias("e"))
    return errors.groupBy("case_id").agg(F.round(F.greatest(F.lit(0.0), 1 - F.avg("e")), 6).alias("score"))


def wilcoxon(w_plus: float, w_minus: float, n: int, ties: float = 0) -> tuple[float, float]:
    """The signed-rank statistic and its two-sided p, of n differences that aren't zero. ties: the sum of c**3 - c over the
    numbers c of differences that share a size. Exact up to 50 differences without ties, else by the normal approximation."""
    if not n:
        return 0.0, 1.0
    w = min(w_plus, w_minus)
    if n <= 50 and not ties:
        ways = [1] + [0] * (n * (n + 1) // 2)
        for k in range(1, n + 1):
            for s in range(len(ways) - 1, k - 1, -1):
                ways[s] += ways[s - k]
        return w, min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**n)
    spread = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return w, erfc(abs(w - n * (n + 1) / 4) / sqrt(spread) / sqrt(2))


def normal_quantile(p: float) -> float:
    """z of which a share p of a normal distribution lies above, by bisection."""
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if erfc(mid / sqrt(2)) / 2 > p else (lo, mid)
    return (lo + hi) / 2


def wilcoxon_r(p: float, n: int) -> float:
    """Effect size |z| / sqrt(n) of a two-sided p; z is 8 for a p of 0."""
    return 0.0 if n <= 0 else abs(8.0 if p <= 0 else normal_quantile(p / 2)) / sqrt(n)


def differences(pairs: DataFrame) -> DataFrame:
    """One row: pairs (all, which an effect size is taken over), n (differences x - y that aren't zero), and ties, the sum of
    c**3 - c over the numbers c of differences of one size."""
    sizes = pairs.groupBy(F.abs(F.col("x") - F.col("y")).alias("size")).agg(F.count(F.lit(1)).cast("decimal(20,0)").alias("c"))
    moved = F.when(F.col("size") != 0, F.col("c"))
    return sizes.agg(F.coalesce(F.sum("c"), F.lit(0)).cast("long").alias("pairs"), F.coalesce(F.sum(moved), F.lit(0)).cast("long").alias("n"),
                     F.coalesce(F.sum(moved.cast("double") * (moved.cast("double") * moved.cast("double") - 1)), F.lit(0.0)).alias("ties"))


def percentiles(values: DataFrame, key: str, value: str, p: float) -> DataFrame:
    """Three percentiles of each group: ``floor`` takes the value at int(n p), ``nearest`` the one at round((n - 1) p),
    halves to the even place, and ``linear`` interpolates. Places come from counts of distinct values."""
    counts = values.groupBy(key, value).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("c").over(Window.partitionBy(key))
    rows = counts.withColumns({"upto": upto, "n": total})
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col(value)))
    floor = F.least(F.floor(F.col("n") * p), F.col("n") - 1)
    nearest = F.bround((F.col("n") - 1) * F.lit(p), 0)
    picked = rows.groupBy(key).agg(at(floor).alias("floor"), at(nearest).alias("nearest"), F.max("n").alias("n"))
    linear = values.groupBy(F.col(key).alias("__k")).agg(F.percentile(value, F.lit(p)).alias("linear"))
    return picked.join(linear, F.col(key) == F.col("__k")).drop("__k")


def class_balance(statuses: DataFrame, classes: list[str], least: int = 10) -> DataFrame:
    """How many rows each class has, and whether the rarest has too few."""
    n = [F.count_if(F.col("status") == c).alias(c.lower()) for c in classes]
    return statuses.agg(*n).withColumn("warning", F.least(*(F.col(c.lower()) for c in classes)) < least)


def status_by(n: Column, coverage: Column, k_sufficient: Column, k_partial: Column, m: Column) -> Column:
    """The status that three thresholds give a case."""
    return (F.when((n >= k_sufficient) & (coverage >= m), "SUFFICIENT").when(n == 0, "INSUFFICIENT")
            .when((n >= k_partial) | (coverage < m), "PARTIAL").otherwise("INSUFFICIENT"))


def grid(spark: SparkSession, current: tuple[int, int, float]) -> DataFrame:
    """The thresholds one step around the current triple: 27 offsets, of which those stay that ask at least one piece of
    evidence and more for sufficient than for partial. Shares beyond 0 and 1 fall together there."""
    step = lambda place: F.floor(F.col("id") / 3**place) % 3 - 1
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(float(current[2])) + step(0) * F.lit(0.1)))
    around = spark.range(27).select((current[0] + step(2)).cast("int").alias("k_sufficient"), (current[1] + step(1)).cast("int").alias("k_partial"), F.round(share, 2).alias("m"))
    return around.filter("k_partial >= 1 and k_sufficient > k_partial").distinct()


def calibrated(observations: DataFrame, current: tuple[int, int, float]) -> DataFrame:
    """Accuracy of every triple around the current one (a stated grid) on observations (n, coverage, expected), and
    which is chosen: of the most accurate the nearest to the current one, then the strictest."""
    spark = observations.sparkSession
    triples = grid(spark, current)
    # Observations are counted by what a rule looks at first, so that the grid meets few rows.
    counts = observations.groupBy("n", "coverage", "expected").agg(F.count(F.lit(1)).alias("c"))
    right = status_by(*map(F.col, ("n", "coverage", "k_sufficient", "k_partial", "m"))) == F.col("expected")
    scored = counts.crossJoin(F.broadcast(triples)).groupBy("k_sufficient", "k_partial", "m").agg(
        F.round(F.coalesce(F.sum(F.when(right, F.col("c")).otherwise(0)) / F.sum("c"), F.lit(0.0)), 6).alias("accuracy"))
    order = Window.orderBy(F.desc("accuracy"), F.abs(F.col("k_sufficient") - current[0]), F.abs(F.col("k_partial") - current[1]), F.round(F.abs(F.col("m") - current[2]), 6),
                           F.desc("k_sufficient"), "k_partial", F.desc("m"))
    return scored.withColumn("chosen", F.row_number().over(order) == 1)  # a row a triple


def spearman(pairs: DataFrame) -> DataFrame:
    """Pearson's and Spearman's correlation of x and y, share of one quarter bucket, and the number of pairs. Mean ranks
    come from counts of distinct values, which are sorted by value across ranges."""
    def ranks(column: str) -> DataFrame:
        c = pairs.groupBy(F.col(column).alias(f"__{column}")).agg(F.count(F.lit(1)).alias("n"))
        return shared.prefix_sums(c, f"__{column}", "n", "before").select(f"__{column}", (F.col("before") + (F.col("n") + 1) / 2).alias(f"{column}_rank"))

    rows = pairs.join(ranks("x"), F.col("x") == F.col("__x")).join(ranks("y"), F.col("y") == F.col("__y"))
    bucket = lambda c: F.least(F.floor(F.col(c) * 4), F.lit(3))
    return rows.agg(F.round(F.corr("x", "y"), 6).alias("pearson"), F.round(F.corr("x_rank", "y_rank"), 6).alias("spearman"), F.round(F.avg((bucket("x") == bucket("y")).cast("double")), 6).alias("bucket_agreement"), F.count(F.lit(1)).alias("aligned_pairs"))


def consistency(runs: DataFrame) -> DataFrame:
    """Per profile: share of cases with one status over all runs, share with one refusal flag, and how often a status
    changed from a run to the next. runs: profile, case_id, run, status, refused."""
    line = Window.partitionBy("profile", "case_id").orderBy("run")
    rows = runs.withColumn("changed", (F.lag("status").over(line) != F.col("status")).cast("int"))
    cases = rows.groupBy("profile", "case_id").agg((F.countDistinct("status") == 1).cast("double").alias("s"), (F.countDistinct("refused") == 1).cast("double").alias("r"), F.coalesce(F.sum("changed"), F.lit(0)).alias("t"))
    return cases.groupBy("profile").agg(F.count(F.lit(1)).alias("n_cases"), F.round(F.avg("s"), 6).alias("status_consistency"), F.round(F.avg("r"), 6).alias("refusal_consistency"), F.sum("t").alias("transitions"))


def report(scores: DataFrame, metrics: list[str]) -> DataFrame:
    """Means of metrics by configuration: config, metric, value. scores: config, and a column for each metric."""
    long = scores.unpivot("config", [*metrics], "metric", "score")
    return long.groupBy("config", "metric").agg(F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 6).alias("value"))


def evaluate(cases: DataFrame, metrics: dict, by: list[str]) -> DataFrame:
    """Means of any metrics by configuration. metrics: names and expressions over a case's columns (or UDFs of them)."""
    return cases.groupBy(*by).agg(*(F.round(F.coalesce(F.avg(m), F.lit(0.0)), 6).alias(k) for k, m in metrics.items()), F.count(F.lit(1)).alias("n"))


def set_f1(predicted: Column, golden: Column) -> Column:
    """F1 of two sets, 0 if either is empty."""
    p, g = F.array_distinct(predicted), F.array_distinct(golden)
    return F.coalesce(F.try_divide(2.0 * F.size(F.array_intersect(p, g)), F.size(p) + F.size(g)), F.lit(0.0))


def token_cosine(a: Column, b: Column) -> Column:
    """Cosine of two texts' sets of words."""
    x, y = words(a), words(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.sqrt(F.size(x) * F.size(y))), F.lit(0.0))


def backoff(attempt: Column, base: Column, least: Column, most: Column, retry_after: Column) -> Column:
    """Seconds to wait before an attempt: what the server asked for, or base doubled each time, within bounds."""
    own = F.when(base == 0, 0.0).otherwise(F.greatest(base * F.pow(F.lit(2.0), attempt - 1), least))
    return F.least(F.when(retry_after > 0, F.greatest(retry_after, least)).otherwise(own), most)


def http_class(status: Column, timed_out: Column) -> Column:
    """What an HTTP status calls for."""
    # Statuses by class.
    return F.when(status.isin(401, 403), "immediate_fallback").when(status.isin(429, 500, 502, 503, 504) | timed_out, "retryable").otherwise("no_fallback")


def run_cost(runs: Column, tokens: Column, per_1k: Column, gpu_hourly: Column, seconds: Column) -> Column:
    """Dollars of a dry run: api, infra and total."""
    api, infra = runs * tokens / 1000.0 * per_1k, runs * gpu_hourly * seconds / 3600.0
    return F.struct(api.alias("api"), infra.alias("infra"), (api + infra).alias("total"))


def projected(costs: DataFrame, warmup: int = 2, full: int = 10, factor: float = 1.5, cap: float = 20.0) -> DataFrame:
    """Per model: cost of its first cases carried on to the full run, and whether another model must take over. costs: model, nth (from 1), cost."""
    first = costs.filter(F.col("nth") <= warmup).groupBy("model").agg(F.sum("cost").alias("seen"), F.count(F.lit(1)).alias("n"))
    total = F.when(F.col("n") >= warmup, F.col("seen") * (full / warmup) * factor)
    return first.select("model", F.round(total, 6).alias("projected"), F.coalesce(total > cap, F.lit(False)).alias("substitute"))


def provider_audit(calls: DataFrame, least_chars: int = 200) -> DataFrame:
    """Per provider: rates of calls and of articles, sizes, duplicates, and a recommendation. calls: source, is_news, ok,
    endpoint_ok, latency_ms, bytes, chars (null: no article), eligible, has_title, is_duplicate."""
    rate = lambda c: F.round(F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)), 6)
    out = calls.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.max("is_news").alias("is_news"), rate("ok").alias("run_ok_rate"), rate("endpoint_ok").alias("endpoint_ok_rate"), F.round(F.avg("latency_ms"), 4).alias("mean_latency"),
        F.round(F.avg("bytes"), 4).alias("mean_bytes"), F.median("chars").alias("median_chars"), rate("eligible").alias("eligible_rate"), F.round(F.avg((~F.col("has_title")).cast("double")), 6).alias("missing_title_rate"), rate("is_duplicate").alias("duplicate_rate"))
    advice = (F.when((F.col("run_ok_rate") < 0.7) | (F.col("endpoint_ok_rate") < 0.7), "fallback_only_unstable").when(~F.col("is_news"), "primary_candidate")
              .when(F.col("median_chars").isNull(), "fallback_no_coverage").when((F.col("eligible_rate") < 0.35) | (F.col("median_chars") < least_chars * 0.6), "fallback_low_text_quality").otherwise("primary_candidate"))
    return out.withColumn("recommendation", advice)
