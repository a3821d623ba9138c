"""Queries over decisions, traces, metrics and statistics, with their SQL; and streams, compared with batches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import decision, evaluation, grounding
from quarry.sources import tables as t

GRADED = """graded AS (SELECT doc_id // 3 AS case_id, CAST(doc_id * 31 % 100 AS DOUBLE) / 100 * CASE WHEN doc_id % 5 < 2 THEN CAST(0.3 AS DOUBLE) ELSE 1 END AS relevance, doc_id % 4 <> 0 AS temporal_match FROM documents),
    pen AS (SELECT case_id, temporal_match, relevance, greatest(0.0, CASE WHEN NOT temporal_match THEN relevance * CAST(0.9 AS DOUBLE) ELSE relevance END) AS r FROM graded),
    agg AS (SELECT case_id, count(*) FILTER (r > 0.25) AS n, avg(r) FILTER (r > 0.25) AS mean, bool_or(r >= 0.8 AND temporal_match) AS sure FROM pen GROUP BY 1),
    cov AS (SELECT *, round(CASE WHEN n = 0 THEN 0.0 ELSE least(1.0, mean * least(1.0, n / 1)) END, 6) AS coverage FROM agg),
    dec AS (SELECT case_id, n, coverage, CASE WHEN n = 1 AND sure THEN 'sufficient' WHEN n >= 1 AND coverage >= 0.3 THEN 'sufficient' WHEN n = 0 THEN 'insufficient' ELSE 'partial' END AS decision FROM cov),
    critic AS (SELECT *, CASE decision WHEN 'insufficient' THEN 'refuse' ELSE 'proceed' END AS next_action FROM dec)"""
TRACE = """trace AS (SELECT conv_id AS run_id, turn AS event_seq, role AS node, CAST(length(text) * 3 AS BIGINT) AS latency_ms, CAST(length(text) AS BIGINT) AS input_tokens, CAST(length(text) % 97 AS BIGINT) AS output_tokens FROM conversations)"""
PAIRED = "paired AS (SELECT doc_id, quality AS a, toxic AS b FROM labels)"
THREE = "three AS (SELECT doc_id % 3 AS a, (doc_id // 3) % 3 AS b, n_chars FROM documents)"
COST = TRACE + """, costs AS (SELECT *, (input_tokens * CASE node WHEN 'user' THEN 3.0::DOUBLE WHEN 'assistant' THEN 0.8::DOUBLE ELSE 0 END + output_tokens * CASE node WHEN 'user' THEN 15.0::DOUBLE WHEN 'assistant' THEN 4.0::DOUBLE ELSE 0 END) / 1e6 AS cost FROM trace)"""


def _graded(s, d):
    k = F.col("doc_id")
    return t.table(s, d, "documents").select(F.expr("doc_id div 3").alias("case_id"), ((k * 31 % 100) / 100 * F.when(k % 5 < 2, 0.3).otherwise(1.0)).alias("relevance"), (k % 4 != 0).alias("temporal_match"))


def _paired(s, d):
    return t.table(s, d, "labels").select("doc_id", F.col("quality").alias("a"), F.col("toxic").alias("b"))


def _three(s, d):
    return t.table(s, d, "documents").select((F.col("doc_id") % 3).alias("a"), F.expr("(doc_id div 3) % 3").alias("b"), "n_chars")


def _xy(s, d):
    return t.table(s, d, "part").select(F.col("p_size").alias("x"), F.expr("cast(p_partkey % 50 + 1 as int)").alias("y"))


def _f1_cases(s, d):
    b = t.table(s, d, "benchmark")
    lines = F.filter(F.split("text", r"[.\n]"), lambda x: x.rlike(r"\S"))
    return b.select(F.col("item_id").alias("case_id"), lines.alias("predicted"), F.reverse(F.transform(lines, lambda x, i: F.when(i % 2 == 0, x).otherwise(F.concat(x, F.lit(" and more"))))).alias("golden"))


def _confidence(s, d):
    return t.table(s, d, "labels").select(((F.col("doc_id") % 100) / 100).alias("confidence"), (F.col("quality") == 1).alias("correct"))


def _p_values(s, d):
    return t.table(s, d, "nation").select(F.col("n_regionkey").alias("family"), F.col("n_name").alias("name"), ((F.col("n_nationkey") + 1) / 500).alias("p"))


def _guards(s, d):
    c = decision.critic(_graded(s, d))
    k = F.col("case_id")
    action = F.when(k % 23 == 0, None).when(k % 13 == 0, "expand_macro").when(k % 17 == 0, "expand_related").otherwise(F.col("next_action"))
    return c.select("case_id", (k % 31 == 0).alias("error"), F.when(k % 5 == 0, k % 2 == 0).alias("ticker_consistent"), (k % 7 != 0).alias("session_valid"), F.when(k % 3 == 0, k % 11 != 0).alias("magnitude_plausible"),
                    action.alias("next_action"), F.when(k % 19 == 0, 0).otherwise(F.col("n")).alias("n_graded"), (k % 4).cast("int").alias("expansions"))


STATE = GRADED + """, state AS (SELECT case_id, case_id % 31 = 0 AS error, CASE WHEN case_id % 5 = 0 THEN case_id % 2 = 0 END AS ticker_consistent, case_id % 7 <> 0 AS session_valid,
    CASE WHEN case_id % 3 = 0 THEN case_id % 11 <> 0 END AS magnitude_plausible, CASE WHEN case_id % 23 = 0 THEN NULL WHEN case_id % 13 = 0 THEN 'expand_macro' WHEN case_id % 17 = 0 THEN 'expand_related' ELSE next_action END AS next_action,
    CASE WHEN case_id % 19 = 0 THEN 0 ELSE n END AS n_graded, case_id % 4 AS expansions FROM critic),
    routed AS (SELECT *, CASE WHEN error THEN 'upstream_system_error' WHEN ticker_consistent = false THEN 'ticker_mismatch_guard' WHEN session_valid = false THEN 'market_session_guard'
        WHEN magnitude_plausible = false THEN 'magnitude_guard' WHEN next_action IS NULL THEN 'missing_critic_decision' WHEN next_action = 'proceed' AND n_graded = 0 THEN 'empty_graded_evidence_guard'
        WHEN next_action = 'proceed' THEN 'critic_proceed' WHEN next_action = 'expand_macro' AND expansions < 2 THEN 'critic_expand_macro' WHEN next_action = 'expand_macro' THEN 'expansions_exhausted'
        WHEN next_action = 'expand_related' THEN 'layer3_not_implemented' ELSE 'critic_refused' END AS edge_reason FROM state)"""
_EDGE = "CASE edge_reason WHEN 'upstream_system_error' THEN 'system_error' WHEN 'critic_proceed' THEN 'judge' WHEN 'critic_expand_macro' THEN 'expand_macro' ELSE 'insufficient' END"


def _calls(s, d):
    """Calls with a status: quick ones are good, others fail, some with a long wait asked for."""
    e = t.trace_events(s, d)
    ok = F.col("latency_ms") < 3000
    return e.select("run_id", "event_seq", "node", ok.alias("ok"), F.when(ok, 200).when(F.col("latency_ms") % 2 == 0, 429).otherwise(500).alias("status"), (F.col("latency_ms") / 10).alias("retry_after"))


QUERIES = {
    "relevance_filter": lambda s, d: _graded(s, d).withColumn("r", F.round(decision.penalised(F.col("relevance"), F.col("temporal_match")), 6)).filter("r > 0.25").select("case_id", "r", F.round("relevance", 6).alias("original")),
    "critic_decision": lambda s, d: decision.critic(_graded(s, d)),
    "router_edges": lambda s, d: decision.route(_guards(s, d)).select("case_id", "edge", "edge_reason"),
    "final_status": lambda s, d: decision.critic(_graded(s, d)).select("case_id", decision.final_status(F.col("decision"), F.when(F.col("case_id") % 11 == 0, "timeout").when(F.col("case_id") % 13 == 0, "schema_invalid")).alias("status")),
    "trace_node_rollup": lambda s, d: decision.node_rollup(decision.costed(t.trace_events(s, d))),
    "run_summary": lambda s, d: t.trace_events(s, d).groupBy("run_id").agg(F.sum("latency_ms").alias("latency_ms"), F.count(F.lit(1)).alias("n_events")),
    "last_event": lambda s, d: decision.last_events(t.trace_events(s, d)),
    "rolling_health": lambda s, d: decision.rolling_health(_calls(s, d)).select("run_id", "event_seq", "node", "seen", F.round("ok_rate", 6).alias("ok_rate"), "incident"),
    "cost_by_model": lambda s, d: decision.costed(t.trace_events(s, d)).groupBy("node").agg(F.round(F.sum("cost"), 6).alias("cost")),
    "cost_cap": lambda s, d: decision.within_budget(decision.costed(t.trace_events(s, d)), 0.05).select("run_id", "event_seq", "node"),
    "infra_allocation": lambda s, d: decision.allocated(t.trace_events(s, d)).select("run_id", "event_seq", F.round("infra_cost", 6).alias("infra_cost")),
    "events_after_cursor": lambda s, d: t.trace_events(s, d).filter("event_seq > 2").select("run_id", "event_seq"),
    "run_status_normalize": lambda s, d: t.table(s, d, "orders").groupBy(grounding.run_state(F.element_at(F.array(*map(F.lit, ("SUFFICIENT", "PARTIAL", "QUEUED", "SYSTEM_ERROR"))), (F.col("o_orderkey") % 4 + 1).cast("int"))).alias("status")).agg(F.count(F.lit(1)).alias("n")),
    "attribution_f1": lambda s, d: evaluation.attribution_f1(_f1_cases(s, d)),
    "confidence_calibration": lambda s, d: evaluation.buckets(_confidence(s, d)),
    "status_accuracy": lambda s, d: _three(s, d).groupBy("a").agg(F.round(F.avg((F.col("a") == F.col("b")).cast("double")), 6).alias("accuracy")),
    "profile_aggregate": lambda s, d: _three(s, d).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_chars"), F.count_if(F.col("n_chars") > 1000).alias("n_long")),
    "case_distribution": lambda s, d: _paired(s, d).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")),
    "contingency_3x3": lambda s, d: evaluation.contingency(_three(s, d), [0, 1, 2]).select("a", F.col("0").alias("b0"), F.col("1").alias("b1"), F.col("2").alias("b2")),
    "bowker_stat": lambda s, d: evaluation.bowker(_three(s, d)),
    "mcnemar_table": lambda s, d: evaluation.discordance(_paired(s, d)),
    "wilcoxon_w": lambda s, d: evaluation.wilcoxon_w(_xy(s, d)),
    "cohens_dz": lambda s, d: evaluation.cohens_dz(_xy(s, d)),
    "holm_adjust": lambda s, d: evaluation.holm(_p_values(s, d)).select("family", "name", "adjusted"),
    "calibrate_thresholds": lambda s, d: evaluation.calibrate(decision.critic(_graded(s, d)).withColumn("expected", F.when(F.col("case_id") % 2 == 0, "sufficient").otherwise("partial")), [1, 2, 4, 8], [0.2, 0.4, 0.6]),
    "correlation": lambda s, d: _xy(s, d).agg(F.round(F.corr("x", "y"), 6).alias("pearson")),
    "taxonomy_share": lambda s, d: t.table(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6)),
}

ORACLE_SQL = {
    "relevance_filter": f"WITH {GRADED} SELECT case_id, round(r, 6) AS r, round(relevance, 6) AS original FROM pen WHERE round(r, 6) > 0.25",
    "critic_decision": f"WITH {GRADED} SELECT * FROM critic",
    "router_edges": f"WITH {STATE} SELECT case_id, {_EDGE} AS edge, edge_reason FROM routed",
    "final_status": f"WITH {GRADED} SELECT case_id, CASE WHEN case_id % 11 = 0 THEN 'SYSTEM_ERROR' WHEN case_id % 13 = 0 THEN 'PARTIAL' WHEN decision = 'sufficient' THEN 'SUFFICIENT' WHEN decision = 'partial' THEN 'PARTIAL' ELSE 'INSUFFICIENT' END AS status FROM critic",
    "trace_node_rollup": f"WITH {COST} SELECT node, count(*) AS calls, CAST(sum(latency_ms) AS BIGINT) AS latency_ms, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(sum(cost), 6) AS cost FROM costs GROUP BY 1",
    "run_summary": f"WITH {TRACE} SELECT run_id, CAST(sum(latency_ms) AS BIGINT) AS latency_ms, count(*) AS n_events FROM trace GROUP BY 1",
    "last_event": f"WITH {TRACE} SELECT run_id, event_seq, node, latency_ms, n_events FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY event_seq DESC) AS k, count(*) OVER (PARTITION BY run_id) AS n_events FROM trace) WHERE k = 1",
    "rolling_health": f"""WITH {TRACE}, w AS (SELECT run_id, event_seq, node, latency_ms, count(*) OVER f AS seen, avg(CASE WHEN latency_ms < 3000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) OVER f AS ok FROM trace WINDOW f AS (PARTITION BY node ORDER BY run_id, event_seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
        SELECT run_id, event_seq, node, seen, round(ok, 6) AS ok_rate, (seen = 20 AND ok < 0.5) OR (latency_ms >= 3000 AND latency_ms % 2 = 0 AND latency_ms / 10 > 300) AS incident FROM w""",
    "cost_by_model": f"WITH {COST} SELECT node, round(sum(cost), 6) AS cost FROM costs GROUP BY 1",
    "cost_cap": f"WITH {COST}, b AS (SELECT *, coalesce(sum(cost) OVER (PARTITION BY node ORDER BY run_id, event_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM costs) SELECT run_id, event_seq, node FROM b WHERE spent <= 0.05",
    "infra_allocation": f"WITH {TRACE} SELECT run_id, event_seq, round(CASE WHEN sum(latency_ms) OVER (PARTITION BY run_id) = 0 THEN 0.0 ELSE latency_ms / sum(latency_ms) OVER (PARTITION BY run_id) END, 6) AS infra_cost FROM trace",
    "events_after_cursor": f"WITH {TRACE} SELECT run_id, event_seq FROM trace WHERE event_seq > 2",
    "run_status_normalize": "SELECT ['SUCCEEDED', 'PARTIAL', 'QUEUED', 'FAILED_SYSTEM'][o_orderkey % 4 + 1] AS status, count(*) AS n FROM orders GROUP BY 1",
    "confidence_calibration": """WITH r AS (SELECT (doc_id % 100) / 100 AS c, quality = 1 AS ok FROM labels) SELECT CAST(least(floor(c * 4), 3) AS BIGINT) AS bucket, count(*) AS n, round(avg(c), 6) AS mean_confidence,
        round(avg(ok::INT), 6) AS accuracy, round(abs(avg(c) - avg(ok::INT)), 6) AS error FROM r GROUP BY 1""",
    "status_accuracy": f"WITH {THREE} SELECT a, round(avg((a = b)::INT), 6) AS accuracy FROM three GROUP BY 1",
    "profile_aggregate": f"WITH {THREE} SELECT a, b, count(*) AS n, round(avg(n_chars), 6) AS mean_chars, count(*) FILTER (n_chars > 1000) AS n_long FROM three GROUP BY 1, 2",
    "case_distribution": f"WITH {PAIRED} SELECT a, b, count(*) AS n FROM paired GROUP BY 1, 2",
    "contingency_3x3": f"WITH {THREE} SELECT a, count(*) FILTER (b = 0) AS b0, count(*) FILTER (b = 1) AS b1, count(*) FILTER (b = 2) AS b2 FROM three GROUP BY 1",
    "bowker_stat": f"""WITH {THREE}, n AS (SELECT least(a, b) AS lo, greatest(a, b) AS hi, count(*) FILTER (a < b) AS up, count(*) FILTER (a > b) AS down FROM three WHERE a <> b GROUP BY 1, 2)
        SELECT round(coalesce(sum((up - down) * (up - down) / (up + down)), 0), 6) AS statistic, count(*) AS df FROM n""",
    "mcnemar_table": f"WITH {PAIRED} SELECT count(*) FILTER (a = 0 AND b = 0) AS n00, count(*) FILTER (a = 0 AND b = 1) AS n01, count(*) FILTER (a = 1 AND b = 0) AS n10, count(*) FILTER (a = 1 AND b = 1) AS n11 FROM paired",
    "wilcoxon_w": """WITH d AS (SELECT p_size - CAST(p_partkey % 50 + 1 AS INT) AS d FROM part), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS k FROM d WHERE d <> 0)
        SELECT CAST(sum(k) FILTER (d > 0) AS DOUBLE) AS w_plus, CAST(sum(k) FILTER (d < 0) AS DOUBLE) AS w_minus FROM r""",
    "cohens_dz": "WITH d AS (SELECT p_size - CAST(p_partkey % 50 + 1 AS INT) AS d FROM part) SELECT round(avg(d) / stddev_samp(d), 6) AS dz FROM d",
    "holm_adjust": """WITH p AS (SELECT n_regionkey AS family, n_name AS name, (n_nationkey + 1) / 500 AS p FROM nation), r AS (SELECT *, (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p, name) + 1) * p AS raw FROM p)
        SELECT family, name, round(least(1.0, max(raw) OVER (PARTITION BY family ORDER BY p, name ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS adjusted FROM r""",
    "calibrate_thresholds": f"""WITH {GRADED}, g AS (SELECT k, m FROM (VALUES (1), (2), (4), (8)) a(k), (VALUES (0.2::DOUBLE), (0.4::DOUBLE), (0.6::DOUBLE)) b(m))
        SELECT k, m, round(avg((CASE WHEN n >= k AND coverage >= m THEN 'sufficient' WHEN n = 0 THEN 'insufficient' ELSE 'partial' END = CASE WHEN case_id % 2 = 0 THEN 'sufficient' ELSE 'partial' END)::INT), 6) AS accuracy FROM critic, g GROUP BY 1, 2""",
    "correlation": "SELECT round(corr(p_size, CAST(p_partkey % 50 + 1 AS INT)), 6) AS pearson FROM part",
    "taxonomy_share": "SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY 1",
}
