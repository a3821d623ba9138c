"""Checks of judged causes: citations against evidence, validation, category and date metrics, overlap of causes, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import jaccard, words

#: Sweep of the false-positive threshold. Fixed values.
SWEEP = [0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50]
#: Statuses that are never tried again, and the reasons that decide for the others. Fixed values.
FINAL = ["QUEUED", "RUNNING", "SUCCEEDED", "FAILED_REQUEST"]
TRY_PARTIAL_AGAIN = ["INCONCLUSIVE"]
LEAVE_INSUFFICIENT = ["NON_MATERIAL_MOVE"]


def cited(citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """citations (case_id, cause_id, asset_id) with found and reference_date of the case's evidence
    (case_id, asset_id, reference_date; one row each)."""
    known = evidence.select("case_id", "asset_id", "reference_date", F.lit(True).alias("found"))
    return citations.join(known, ["case_id", "asset_id"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def grounding_rate(citations: DataFrame) -> DataFrame:
    """Share of a case's causes that cite evidence it has. A cause without citations has a row of null asset_id."""
    causes = citations.groupBy("case_id", "cause_id").agg(F.max("found").alias("grounded"))
    return causes.groupBy("case_id").agg(F.round(F.avg(F.col("grounded").cast("double")), 6).alias("grounding_rate"))


def citation_precision(citations: DataFrame) -> DataFrame:
    """Share of a case's distinct cited ids that are evidence; 1 if it cites none."""
    ids = citations.groupBy("case_id", "asset_id").agg(F.max("found").alias("found"))
    n = F.count("asset_id")
    rate = F.coalesce(F.try_divide(F.count_if(F.col("found") & F.col("asset_id").isNotNull()).cast("double"), n), F.lit(1.0))
    return ids.groupBy("case_id").agg(n.alias("n_cited"), F.round(rate, 6).alias("citation_precision"))


def validation_failure(cases: DataFrame, citations: DataFrame, days: int = 3, least_coverage: float = 0.3) -> DataFrame:
    """The first check that a case fails, null if none. cases: case_id, trade_date, schema_ok, sufficient, coverage."""
    dated = citations.filter("asset_id is not null").join(cases.select("case_id", "trade_date"), "case_id")
    outside = F.coalesce(F.abs(F.datediff("reference_date", "trade_date")) > days, F.lit(True))
    found = dated.groupBy("case_id").agg(F.max(~F.col("found")).alias("missing"), F.max(outside).alias("outside"))
    failure = (F.when(F.col("missing"), "evidence_id_missing").when(F.col("outside"), "time_window_violation").when(~F.col("schema_ok"), "schema_invalid")
               .when(F.col("sufficient") & (F.col("coverage") < least_coverage), "magnitude_sanity_failed"))
    return cases.join(found, "case_id", "left").select("case_id", failure.alias("failure"))


def run_state(status: Column) -> Column:
    """The run's status for a decision's status."""
    return F.when(status == "SUFFICIENT", "SUCCEEDED").when(status == "SYSTEM_ERROR", "FAILED_SYSTEM").otherwise(F.coalesce(status, F.lit("UNKNOWN")))


def retryable(status: Column, reason: Column) -> Column:
    state = run_state(status)
    return (F.when(state.isin(FINAL), False).when(state == "FAILED_SYSTEM", True).when(state == "PARTIAL", F.coalesce(reason.isin(TRY_PARTIAL_AGAIN), F.lit(False)))
            .when(state == "INSUFFICIENT", F.coalesce(~reason.isin(LEAVE_INSUFFICIENT), F.lit(True))).otherwise(False))


def category_accuracy(predicted: DataFrame, golden: DataFrame) -> DataFrame:
    """Share of a case's predicted categories that are golden ones, whatever their case. Both: case_id, category."""
    known = golden.select("case_id", F.lower("category").alias("c")).distinct().withColumn("known", F.lit(1.0))
    hits = predicted.select("case_id", F.lower("category").alias("c")).join(known, ["case_id", "c"], "left")
    return hits.groupBy("case_id").agg(F.round(F.avg(F.coalesce("known", F.lit(0.0))), 6).alias("category_accuracy"))


def parsed_date(value: Column) -> Column:
    """The date of an ISO-like text, null if there is none."""
    v = F.trim(value)
    plain = v.rlike(r"^\d{4}-\d{1,2}-\d{1,2}(T\d{2}:\d{2}:\d{2}([+-]\d{2}:?\d{2}|Z)?)?$") | v.rlike(r"^\d{4}/\d{1,2}/\d{1,2}$")
    return F.when(plain, F.regexp_replace(F.regexp_extract(v, r"^[\d/-]+", 0), "/", "-").try_cast("date"))


def same_date(a: Column, b: Column) -> Column:
    return F.coalesce((parsed_date(a) == parsed_date(b)).cast("double"), F.lit(0.0))


def cause_pairs(causes: DataFrame) -> DataFrame:
    """Word overlap of each two causes of an event (an event has few). causes: event_id, nth, text."""
    c = causes.select("event_id", "nth", words(F.col("text")).alias("w"))
    return c.alias("a").join(c.alias("b"), (F.col("a.event_id") == F.col("b.event_id")) & (F.col("a.nth") < F.col("b.nth"))).select(
        "a.event_id", F.col("a.nth").alias("i"), F.col("b.nth").alias("j"), F.round(jaccard(F.col("a.w"), F.col("b.w")), 6).alias("jaccard"))


def sweep(pairs: DataFrame, thresholds: list[float] = SWEEP) -> DataFrame:
    """Pairs above each threshold, their share, and the least threshold that none is above. One pass over the pairs."""
    counts = pairs.agg(*(F.count_if(F.col("jaccard") > t).alias(f"n{k}") for k, t in enumerate(thresholds)),
                       F.count(F.lit(1)).alias("n"), F.coalesce(F.max("jaccard"), F.lit(0.0)).alias("top"))
    rows = F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"n{k}").alias("above")) for k, t in enumerate(thresholds))))
    return counts.select(rows.alias("r"), "n", "top").select("r.threshold", "r.above", F.round(F.coalesce(F.try_divide(F.lit(100.0) * F.col("r.above"), "n"), F.lit(0.0)), 4).alias("percent"),
                                                             F.round(F.col("top") + 0.01, 2).alias("safe"))


def gates(metrics: DataFrame, thresholds: list[tuple[str, float]]) -> DataFrame:
    """PASS or FAIL for each gate; metrics is one row with a column per gate."""
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("gate"), F.col(k).cast("double").alias("value"), F.lit(v).alias("least")) for k, v in thresholds)))
    return metrics.select(rows.alias("g")).select("g.gate", F.round("g.value", 6).alias("value"), F.when(F.col("g.value") >= F.col("g.least"), "PASS").otherwise("FAIL").alias("verdict"))


def gate_measures(results: DataFrame, traces: DataFrame, statuses: list[str]) -> DataFrame:
    """One row of what gates look at. results: config, run_id, output_status, should_refuse, cited and retrieved (arrays of ids),
    latency_ms, cost_usd, tokens; traces: run_id. evidence_validity: the share of cited ids that were retrieved (1 where
    none is cited); schema_validity: the share of results with a known status and both arrays; trace_completeness: the
    share of results whose run has a trace; should_refuse_hit_rate: the least share, over configs, of refusals among the
    cases to refuse (0 without any); cost_latency_reported: whether every result tells all three."""
    one = F.lit(1).cast("double")
    known = traces.select("run_id").distinct().withColumn("traced", one)
    met = F.size(F.filter("cited", lambda i: F.array_contains(F.coalesce("retrieved", F.array().cast("array<long>")), i)))
    valid = F.coalesce(F.col("output_status").isin(statuses), F.lit(False)) & F.col("cited").isNotNull() & F.col("retrieved").isNotNull()
    told = F.col("latency_ms").isNotNull() & F.col("cost_usd").isNotNull() & F.col("tokens").isNotNull()
    rows = results.join(known, "run_id", "left")
    configs = rows.groupBy("config").agg(
        F.sum(F.coalesce(met, F.lit(0))).alias("met"), F.sum(F.coalesce(F.size("cited"), F.lit(0))).alias("cited"), F.count(F.lit(1)).alias("n"), F.sum(valid.cast("long")).alias("valid"),
        F.sum(F.coalesce("traced", F.lit(0.0))).alias("traced"), F.min(told).alias("told"),
        F.coalesce(F.avg(F.when(F.col("should_refuse"), (F.col("output_status") == "INSUFFICIENT").cast("double"))), F.lit(0.0)).alias("refused"))
    share = lambda a, b, none: F.coalesce(F.try_divide(F.sum(a), F.sum(b)), F.lit(none))
    return configs.agg(share("met", "cited", 1.0).alias("evidence_validity"), share("valid", "n", 0.0).alias("schema_validity"), share("traced", "n", 0.0).alias("trace_completeness"),
                       F.coalesce(F.min("refused"), F.lit(0.0)).alias("should_refuse_hit_rate"), F.coalesce(F.min("told"), F.lit(True)).alias("cost_latency_reported"))


def gate_report(metrics: DataFrame, rules: list[tuple[str, str, float]]) -> DataFrame:
    """A row for each rule (gate, ">=" or "==", bound) on one row of metrics, and a row overall, which passes where all of
    them do: gate, rule, bound, value, verdict. A value that is missing fails. Booleans count as 0 and 1."""
    if any(op not in (">=", "==") for _, op, _ in rules):
        raise ValueError("a rule is >= or ==")
    value = lambda g: F.round(F.col(g).cast("double"), 6)
    holds = [F.coalesce(value(g) >= b if op == ">=" else value(g) == b, F.lit(False)) for g, op, b in rules]
    verdict = lambda h: F.when(h, "PASS").otherwise("FAIL").alias("verdict")
    cell = lambda g, op, b, v, h: F.struct(F.lit(g).alias("gate"), F.lit(op).alias("rule"), F.lit(float(b)).alias("bound"), v.alias("value"), verdict(h))
    rows = [cell(g, op, b, value(g), h) for (g, op, b), h in zip(rules, holds)]
    passed = sum((h.cast("double") for h in holds), F.lit(0.0))
    rows.append(cell("overall", "==", len(rules), passed, passed == len(rules)))
    return metrics.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
