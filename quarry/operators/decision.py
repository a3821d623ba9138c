"""Grading, routing and status of cases, and roll-ups of run traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.sources import shared

# Thresholds of grading and the number of expansions of a search.
THRESHOLD, PENALTY, K_SUFFICIENT, K_PARTIAL, M_THRESHOLD, MAX_EXPANSIONS = 0.25, 0.9, 1, 1, 0.3, 2
# Dollars for a million tokens, in and out.
PRICES = {"user": (3.0, 15.0), "assistant": (0.8, 4.0)}


def penalised(relevance: Column, temporal_match: Column) -> Column:
    return F.greatest(F.lit(0.0), F.when(temporal_match == F.lit(False), relevance * PENALTY).otherwise(relevance))


def magnitude_coverage(mean: Column, n: Column) -> Column:
    return F.least(F.lit(1.0), F.coalesce(mean, F.lit(0.0)) * F.least(F.lit(1.0), n / K_PARTIAL))


def critic(graded: DataFrame) -> DataFrame:
    """case_id, n, coverage, decision and next_action of graded chunks (case_id, relevance, temporal_match)."""
    rows = graded.withColumn("r", penalised(F.col("relevance"), F.col("temporal_match")))
    kept = F.col("r") > THRESHOLD
    # A single chunk decides by itself if it is relevant enough and of the right time.
    sure = kept & (F.col("r") >= 0.8) & F.coalesce("temporal_match", F.lit(False))
    out = rows.groupBy("case_id").agg(F.count_if(kept).alias("n"), F.avg(F.when(kept, F.col("r"))).alias("mean"), F.max(sure).alias("sure"))
    out = out.withColumn("coverage", F.round(magnitude_coverage(F.col("mean"), F.col("n")), 6))
    enough = (F.col("n") >= K_SUFFICIENT) & (F.col("coverage") >= M_THRESHOLD)
    decision = F.when(F.col("n") == 0, "insufficient").when((F.col("n") == 1) & F.col("sure"), "sufficient").when(enough, "sufficient").otherwise("partial")
    return out.select("case_id", "n", "coverage", decision.alias("decision"), F.when(decision == "insufficient", "refuse").otherwise("proceed").alias("next_action"))


def route(guards: DataFrame) -> DataFrame:
    """The edge each case takes, and why. Guards are nullable; only a false one stops a case. guards: error,
    ticker_consistent, session_valid, magnitude_plausible, next_action (null: no decision), n_graded, expansions."""
    false = F.lit(False)
    used = F.coalesce("expansions", F.lit(0))
    rules = [
        (F.col("error") == F.lit(True), "system_error", "upstream_system_error"),
        (F.col("ticker_consistent") == false, "insufficient", "ticker_mismatch_guard"),
        (F.col("session_valid") == false, "insufficient", "market_session_guard"),
        (F.col("magnitude_plausible") == false, "insufficient", "magnitude_guard"),
        (F.col("next_action").isNull(), "insufficient", "missing_critic_decision"),
        ((F.col("next_action") == "proceed") & (F.coalesce("n_graded", F.lit(0)) == 0), "insufficient", "empty_graded_evidence_guard"),
        (F.col("next_action") == "proceed", "judge", "critic_proceed"),
        ((F.col("next_action") == "expand_macro") & (used < MAX_EXPANSIONS), "expand_macro", "critic_expand_macro"),
        (F.col("next_action") == "expand_macro", "insufficient", "expansions_exhausted"),
        (F.col("next_action") == "expand_related", "insufficient", "layer3_not_implemented"),
    ]
    out = F.struct(F.lit("insufficient").alias("edge"), F.lit("critic_refused").alias("edge_reason"))
    for when, edge, reason in reversed(rules):
        out = F.when(when, F.struct(F.lit(edge).alias("edge"), F.lit(reason).alias("edge_reason"))).otherwise(out)
    return guards.withColumn("__to", out).withColumns({"edge": F.col("__to.edge"), "edge_reason": F.col("__to.edge_reason")}).drop("__to")


def expand(cases: DataFrame) -> DataFrame:
    """Cases that are to search once more: the macro layer, one expansion more, and the reason kept once."""
    again = F.col("edge") == "expand_macro"
    reasons = F.coalesce("expansion_reasons", F.array().cast("array<string>"))
    return cases.withColumns({
        "layer": F.when(again, "macro").otherwise(F.col("layer")),
        "expansions": F.coalesce("expansions", F.lit(0)) + again.cast("int"),
        "expansion_reasons": F.when(again, F.array_union(reasons, F.array(F.lit("critic_expand_macro")))).otherwise(reasons)})


def final_status(decision: Column, failure: Column) -> Column:
    return (F.when(failure == "timeout", "SYSTEM_ERROR").when(failure.isNotNull(), "PARTIAL")
            .when(decision == "sufficient", "SUFFICIENT").when(decision == "partial", "PARTIAL").otherwise("INSUFFICIENT"))


def node_rollup(events: DataFrame) -> DataFrame:
    """Per node: calls, sums of latency, tokens and cost, the longest first."""
    sums = [F.sum(c).alias(c) for c in ("latency_ms", "input_tokens", "output_tokens")]
    return events.groupBy("node").agg(F.count(F.lit(1)).alias("calls"), *sums, F.round(F.sum("cost"), 6).alias("cost")).orderBy(F.desc("latency_ms"), "node")


def costed(events: DataFrame) -> DataFrame:
    """Each event's cost by its node's price; unknown nodes cost nothing."""
    price = lambda k: F.coalesce(F.try_element_at(F.create_map(*[x for n, p in PRICES.items() for x in (F.lit(n), F.lit(p[k]))]), F.col("node")), F.lit(0.0))
    return events.withColumn("cost", (F.col("input_tokens") * price(0) + F.col("output_tokens") * price(1)) / 1e6)


def last_events(events: DataFrame) -> DataFrame:
    last = F.max_by(F.struct("event_seq", "node", "latency_ms"), "event_seq")
    return events.groupBy("run_id").agg(last.alias("e"), F.count(F.lit(1)).alias("n_events")).select("run_id", "e.*", "n_events")


def _bases(events: DataFrame, value: Column) -> DataFrame:
    """What a node's value sums to before each bucket of its runs: node, bucket, base. A bucket is a row here."""
    sums = events.groupBy("node", "bucket").agg(F.sum(value).alias("n"))
    before = F.sum("n").over(Window.partitionBy("node").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    return sums.select(F.col("node").alias("__node"), F.col("bucket").alias("__bucket"), F.coalesce(before, F.lit(0)).alias("base"))


def _with_base(events: DataFrame, value: Column) -> DataFrame:
    bases = _bases(events, value)
    return events.join(bases, F.col("node").eqNullSafe(F.col("__node")) & (F.col("bucket") == F.col("__bucket"))).drop("__node", "__bucket")


def placed(events: DataFrame, width: int = 1024) -> DataFrame:
    """events with their place (from 0) among their node's, by run and sequence. Places come from counts of buckets of
    runs, so that a node with most of the log is spread over many tasks."""
    rows = _with_base(events.withColumn("bucket", F.floor(F.col("run_id") / width)), F.lit(1))
    inside = F.row_number().over(Window.partitionBy("node", "bucket").orderBy("run_id", "event_seq")) - 1
    return rows.withColumn("place", F.col("base") + inside).drop("bucket", "base")


def rolling_health(events: DataFrame, last: int = 20, block: int = 4096) -> DataFrame:
    """Share of good events (column ok) among the last ones of each node. An incident: a full window with fewer than
    half of them good, or an event with status 429 that asks to wait over 300 seconds (columns status, retry_after).
    Each block of places, of at least last rows, also holds the last rows before it, so blocks are judged apart."""
    p, block = F.col("place"), max(block, last)
    homes = F.when((p % block >= block - last + 1), F.array(F.floor(p / block), F.floor(p / block) + 1)).otherwise(F.array(F.floor(p / block)))
    rows = placed(events).withColumn("home", F.explode(homes))
    frame = Window.partitionBy("node", "home").orderBy("place").rowsBetween(1 - last, 0)
    rows = rows.withColumns({"seen": F.least(p + 1, F.lit(last)), "ok_rate": F.avg(F.col("ok").cast("double")).over(frame)}).filter(F.floor(p / block) == F.col("home"))
    asked = (F.col("status") == 429) & (F.col("retry_after") > 300)
    return rows.withColumn("incident", ((F.col("seen") == last) & (F.col("ok_rate") < 0.5)) | F.coalesce(asked, F.lit(False))).drop("home", "place")


def within_budget(costs: DataFrame, cap: float, width: int = 1024) -> DataFrame:
    """Runs in order until their cost exceeds the cap; the one that exceeds it is still in."""
    rows = _with_base(costs.withColumn("bucket", F.floor(F.col("run_id") / width)), F.col("cost"))
    inside = F.sum("cost").over(Window.partitionBy("node", "bucket").orderBy("run_id", "event_seq").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("before", F.col("base") + F.coalesce(inside, F.lit(0.0))).filter(F.col("before") <= cap).drop("bucket", "base")


def stages(events: DataFrame) -> DataFrame:
    """Per run and node: calls, sums, the last model that was named, its status changes in order, and whether it failed."""
    sums = [F.sum(c).alias(c) for c in ("latency_ms", "input_tokens", "output_tokens")]
    step = F.when(F.col("before").isNotNull() | F.col("after").isNotNull(), F.struct("event_seq", F.concat(F.coalesce("before", F.lit("—")), F.lit(" → "), F.coalesce("after", F.lit("—"))).alias("s")))
    out = events.groupBy("run_id", "node").agg(F.count(F.lit(1)).alias("calls"), *sums, F.max_by("model", F.when(F.col("model").isNotNull(), F.col("event_seq"))).alias("model"),
                                               F.array_join(F.transform(F.sort_array(F.collect_list(step)), lambda x: x["s"]), "; ").alias("transitions"), F.max_by("after", "event_seq").alias("last"))
    return out.withColumn("stage_status", F.when(F.upper("last").rlike("FAILED|ERROR"), "error").otherwise("completed")).drop("last")


def numbered(events: DataFrame) -> DataFrame:
    """events (run_id, at, event_id: distinct) with event_seq: their place in their run. Places are taken in one order of all
    events, range by range, less the run's first: a run of any length is spread over tasks."""
    rows = events.withColumns({"__at": F.struct("run_id", "at", "event_id"), "__one": F.lit(1).cast("long")})
    placed = shared.stored(shared.prefix_sums(rows, "__at", "__one", "__place"), "numbered")
    firsts = placed.groupBy(F.col("run_id").alias("__run")).agg(F.min("__place").alias("__first"))
    out = placed.join(firsts, F.col("run_id").eqNullSafe(F.col("__run")))
    return out.withColumn("event_seq", F.col("__place") - F.col("__first") + 1).drop("__at", "__one", "__place", "__run", "__first")


def queue_head(runs: DataFrame) -> DataFrame:
    """The oldest queued run."""
    return runs.filter("status = 'QUEUED'").agg(F.min(F.struct("queued_at", "run_id")).alias("h")).select("h.run_id", "h.queued_at").filter("run_id is not null")


def budget_days(calls: DataFrame, budget: int) -> DataFrame:
    """Per provider and UTC day: calls, calls beyond the budget, and the least gap between calls in seconds. calls: provider, at (a time)."""
    line = Window.partitionBy("provider", "day").orderBy("at")
    rows = calls.withColumn("day", F.to_date("at"))
    rows = rows.withColumn("gap", F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.lag("at").over(line).cast("timestamp")))
    return rows.groupBy("provider", "day").agg(F.count(F.lit(1)).alias("n"), F.greatest(F.count(F.lit(1)) - budget, F.lit(0)).alias("over"), F.round(F.min("gap") / 1e6, 3).alias("least_gap"))


def allocated(events: DataFrame, infra: float = 1.0) -> DataFrame:
    """A run's infrastructure cost, shared among its events by latency."""
    total = F.sum("latency_ms").over(Window.partitionBy("run_id"))
    return events.withColumn("infra_cost", F.when(total == 0, 0.0).otherwise(infra * F.col("latency_ms") / total))
