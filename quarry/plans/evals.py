"""Queries over statistics, calibration, evaluation reports, comparisons and recovered chunks, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import answers, text
from quarry.operators import decision, evidence, grounding, resampling
from quarry.operators import evaluation as ev
from quarry.plans.corpus import QUALITY
from quarry.plans.market import ASSETS, LAYER, SHIFTED, _shifted_cases
from quarry.plans.runs import GRADED, _graded
from quarry.sources import sinks
from quarry.sources import tables as t

# Statuses by class, in order.
_CLASSES = ["SUFFICIENT", "PARTIAL", "INSUFFICIENT"]


def _pick(values, column):
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(column, F.lit(len(values))) + 1).cast("int"))


def _xy(s, d):
    return t.table(s, d, "part").select(F.col("p_size").alias("x"), F.expr("cast(p_partkey % 50 + 1 as int)").alias("y"))


def _paired(s, d):
    """Metrics of two systems on labelled documents, by class."""
    k = F.col("doc_id")
    return t.table(s, d, "labels").select(_pick(_CLASSES, k).alias("stratum"), k.alias("id"), (k % 10 / 10).alias("x"), (k * 7 % 10 / 10).alias("y"))


PAIRED = "pr AS (SELECT ['SUFFICIENT', 'PARTIAL', 'INSUFFICIENT'][doc_id % 3 + 1] AS stratum, doc_id AS id, doc_id % 10 / 10 AS x, doc_id * 7 % 10 / 10 AS y FROM labels)"


def _tests(s, d):
    """Statistics and p of the paired tests, from rows of counts: their tails are a few numbers on the driver."""
    of = ev.differences(_xy(s, d)).first()
    w = ev.wilcoxon_w(_xy(s, d)).first()
    stat, p = ev.wilcoxon(w.w_plus, w.w_minus, of.n, of.ties)
    b = ev.bowker(t.table(s, d, "documents").select((F.col("doc_id") % 3).alias("a"), F.expr("(doc_id div 3) % 3").alias("b"))).first()
    m = ev.discordance(t.table(s, d, "labels").select(F.col("quality").alias("a"), F.col("toxic").alias("b"))).first()
    found = [("wilcoxon", float(stat), p, ev.wilcoxon_r(p, of.pairs)), ("bowker", float(b.statistic), ev.chi2_tail(b.statistic, b.df) if b.df else 1.0, 0.0), ("mcnemar", float(min(m.n01, m.n10)), ev.mcnemar_p(m.n01, m.n10), 0.0)]
    return s.createDataFrame(found, "test string, statistic double, p double, effect double")


def _observed(s, d):
    c = decision.critic(_graded(s, d))
    return c.select("n", "coverage", F.when(F.col("case_id") % 4 == 0, "PARTIAL").when(F.col("coverage") > 0.45, "SUFFICIENT").when(F.col("n") == 0, "INSUFFICIENT").otherwise("PARTIAL").alias("expected"))


def _runs3(s, d):
    """Three runs of each case under two profiles."""
    k = F.col("doc_id")
    rows = t.table(s, d, "documents").select(k.alias("case_id"), _pick(("full", "lean"), k).alias("profile"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("run"))
    c, r = F.col("case_id"), F.col("run")
    return rows.select("*", F.when((c % 5 == 0) & (r == 2), "PARTIAL").when((c % 7 == 0) & (r == 1), "INSUFFICIENT").otherwise("SUFFICIENT").alias("status"), ((c % 11 == 0) & (r == 0)).alias("refused"))


def _graders(s, d):
    """Two graders of one document: pairs that both have graded."""
    k = F.col("doc_id")
    a = t.table(s, d, "documents").filter(k % 7 != 0).select(k.alias("chunk_id"), (k * 13 % 20 / 20).alias("x"))
    b = t.table(s, d, "documents").filter(k % 5 != 0).select(k.alias("chunk_id"), ((k * 13 % 20 + k % 3) / 22).alias("y"))
    return a.join(b, "chunk_id").select("x", "y")


def _configs(s, d):
    """Rows of two configurations on the same cases."""
    k = F.col("doc_id")
    rows = t.table(s, d, "documents").select(k.alias("case_id"), F.explode(F.array(F.lit("direct"), F.lit("full"))).alias("config"), F.col("n_chars"))
    j = F.col("case_id") + F.length("config")
    return rows.select("case_id", "config", _pick(_CLASSES, j).alias("output_status"), _pick(_CLASSES, F.col("case_id")).alias("expected_status"), (F.col("case_id") % 6 == 0).alias("should_refuse"),
                       (j % 10 / 10).alias("attribution_f1"), (j % 4 / 4).alias("grounding_rate"), (j % 9 * 100).cast("double").alias("latency_ms"), (j % 5 / 100).alias("cost_usd"), F.col("n_chars").cast("double").alias("tokens"))


CONFIGS = """cf AS (SELECT doc_id AS case_id, config, ['SUFFICIENT', 'PARTIAL', 'INSUFFICIENT'][(doc_id + length(config)) % 3 + 1] AS output_status, ['SUFFICIENT', 'PARTIAL', 'INSUFFICIENT'][doc_id % 3 + 1] AS expected_status, doc_id % 6 = 0 AS should_refuse,
    (doc_id + length(config)) % 10 / 10 AS attribution_f1, (doc_id + length(config)) % 4 / 4 AS grounding_rate, CAST((doc_id + length(config)) % 9 * 100 AS DOUBLE) AS latency_ms, (doc_id + length(config)) % 5 / 100 AS cost_usd, CAST(n_chars AS DOUBLE) AS tokens
    FROM documents, (VALUES ('direct'), ('full')) c(config))"""
_METRICS = ["attribution_f1", "grounding_rate", "latency_ms", "cost_usd", "tokens"]


def _profiles(s, d):
    """Ablation rows by variant and profile, nested as a run writes them."""
    c = _configs(s, d)
    k = F.col("case_id")
    return c.select(_pick(("l1", "l1_l2"), k).alias("variant"), F.col("config").alias("profile"), F.struct("expected_status", "should_refuse").alias("case"), F.struct("output_status").alias("judge"),
                    F.struct("attribution_f1", "grounding_rate").alias("metrics"), F.struct((k % 4).alias("l2"), (k % 5).alias("total")).alias("retrieved"), F.struct("latency_ms", "tokens", "cost_usd").alias("cost"))


def _aggregate(s, d):
    ratio = F.coalesce(F.try_divide(F.col("retrieved.l2").cast("double"), F.col("retrieved.total")), F.lit(0.0))
    mean = lambda c, name: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(name)
    return _profiles(s, d).groupBy("variant", "profile").agg(
        F.count(F.lit(1)).alias("n_cases"), mean((F.col("judge.output_status") == F.col("case.expected_status")).cast("double"), "status_accuracy"),
        mean(F.when(F.col("case.should_refuse"), (F.col("judge.output_status") == "INSUFFICIENT").cast("double")), "refuse_hit_rate"),
        *(mean(F.col(f"metrics.{m}"), f"avg_{m}") for m in ("attribution_f1", "grounding_rate")), *(mean(F.col(f"cost.{m}"), f"avg_{m}") for m in ("latency_ms", "tokens", "cost_usd")), mean(ratio, "avg_l2_ratio"))


def _gates(s, d):
    c = _configs(s, d)
    rates = c.groupBy("config").agg(F.coalesce(F.avg(F.when(F.col("should_refuse"), (F.col("output_status") == "INSUFFICIENT").cast("double"))), F.lit(0.0)).alias("r"))
    cited = t.table(s, d, "labels").select((F.col("doc_id") + 1_000_003 * F.col("toxic")).alias("doc_id")).join(t.table(s, d, "documents").select("doc_id", F.lit(1).alias("known")), "doc_id", "left")
    valid = cited.agg(F.coalesce(F.avg(F.coalesce("known", F.lit(0)).cast("double")), F.lit(1.0)).alias("evidence_validity"))
    whole = c.agg(F.min(F.col("latency_ms").isNotNull() & F.col("cost_usd").isNotNull() & F.col("tokens").isNotNull()).cast("double").alias("cost_latency_reported"))
    return grounding.gates(valid.crossJoin(whole).crossJoin(rates.agg(F.min("r").alias("refuse_hit_rate"))), [("evidence_validity", 0.85), ("cost_latency_reported", 1.0), ("refuse_hit_rate", 0.5)])  # one row each


def _results(s, d):
    """Results of two configurations: ids cited and retrieved follow from the texts' sizes; some have no status, arrays or cost."""
    c = _configs(s, d).join(t.table(s, d, "documents").select(F.col("doc_id").alias("case_id"), "lang"), "case_id")
    k, n = F.col("case_id"), F.col("tokens").cast("long")
    cited = F.when(n % 97 != 0, F.transform(F.sequence(F.lit(0).cast("long"), n % 4), lambda i: k + i * (n % 3)))
    retrieved = F.when(n % 101 != 0, F.array(k, k + 1, k + n % 5))
    return c.select("config", (k % 400).alias("run_id"), F.when(n % 89 != 0, F.col("output_status")).alias("output_status"), (F.col("lang") == "de").alias("should_refuse"), cited.alias("cited"), retrieved.alias("retrieved"),
                    "latency_ms", F.when(n % 1009 != 0, F.col("cost_usd")).alias("cost_usd"), "tokens")


_RULES = [("evidence_validity", ">=", 0.5), ("schema_validity", "==", 1.0), ("trace_completeness", ">=", 0.2), ("should_refuse_hit_rate", ">=", 0.3), ("cost_latency_reported", "==", 1.0)]


def _preflight(s, d):
    """Three counts against their thresholds, and whether all hold."""
    a = t.assets(s, d)
    days = _shifted_cases(s, d).select("date").distinct()
    hits = evidence.window_join(days, a.filter(evidence.layer(F.col("source_type")) == "macro"))
    macro = hits.agg(F.countDistinct("asset_id").alias("macro"), F.countDistinct(F.when(F.col("body").rlike(answers.GEO), F.col("asset_id"))).alias("geo"))
    direct = a.filter(evidence.layer(F.col("source_type")) == "direct").groupBy("ticker").agg(F.countDistinct("asset_id").alias("n")).agg(F.min("n").alias("direct"))
    row = macro.crossJoin(direct)  # one row each
    return row.withColumn("ready", (F.col("macro") >= 50) & (F.col("direct") >= 3) & (F.col("geo") >= 10))


def _tiers(s, d):
    """Status accuracy by tier: all cases, and those with evidence, for configurations over one set of cases."""
    c = _configs(s, d)
    n = F.col("case_id") % 4
    tiers = c.withColumn("tier", F.explode(F.when(n > 0, F.array(F.lit("all"), F.lit("with_evidence"))).otherwise(F.array(F.lit("all")))))
    return tiers.groupBy("tier", "config").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("output_status") == F.col("expected_status")).cast("double")), 6).alias("accuracy"))


def _universe(s, d):
    """Cases that one configuration has and the other hasn't."""
    c = _configs(s, d).filter(~((F.col("config") == "full") & (F.col("case_id") % 50 == 3))).select("config", "case_id")
    a, b = (c.filter(F.col("config") == x).select("case_id") for x in ("direct", "full"))
    return a.exceptAll(b).withColumn("lacks", F.lit("full")).unionByName(b.exceptAll(a).withColumn("lacks", F.lit("direct")))


def _recovered(s, d):
    """The text of each chunk id by its parent: a sentence of it, or the parent itself where the id names none."""
    a = t.assets(s, d)
    ids = evidence.chunks(a).select("chunk_id").withColumn("chunk_id", F.when(F.crc32("chunk_id") % 9 == 0, F.concat("chunk_id", F.lit("::lost"))).otherwise(F.col("chunk_id")))
    parts = ids.select("chunk_id", F.split("chunk_id", "::").alias("p")).select("chunk_id", F.col("p")[0].cast("long").alias("asset_id"), F.regexp_extract(F.concat_ws("::", "p"), r"^\d+::l2s(\d+)$", 1).alias("nth"))
    rows = parts.join(a.select("asset_id", "body"), "asset_id", "left")
    found = F.when(F.col("nth") != "", F.get(text.sentences(F.col("body")), F.col("nth").cast("int") - 1))
    return rows.select("chunk_id", F.length(F.coalesce(found, "body")).alias("chars"), (found.isNull() & F.contains("chunk_id", F.lit("::"))).alias("is_fallback"))


def _profile_row(s, d):
    return t.table(s, d, "documents").select("source", F.col("source").isin("src1", "src2", "src3").alias("is_news"), (F.col("doc_id") % 9 != 0).alias("ok"), (F.col("doc_id") % F.when(F.col("source") == "src5", 2).otherwise(7) != 0).alias("endpoint_ok"), (F.col("doc_id") % 90).cast("double").alias("latency_ms"),
                                             F.length("text").cast("double").alias("bytes"), F.when(F.col("source") != "src3", F.length("text")).alias("chars"), (F.length("text") >= 200).alias("eligible"), (F.col("doc_id") % 13 != 0).alias("has_title"), (F.col("doc_id") % 29 == 0).alias("is_duplicate"))


QUERIES = {
    "paired_tests": _tests,
    "bootstrap_interval": lambda s, d: resampling.bootstrap_interval(_paired(s, d)),
    "percentiles_three": lambda s, d: ev.percentiles(t.table(s, d, "documents"), "source", "n_chars", 0.9).select("source", "floor", "nearest", F.round("linear", 4).alias("linear"), "n"),
    "class_balance": lambda s, d: ev.class_balance(_paired(s, d).select(F.col("stratum").alias("status")), _CLASSES),
    "calibrated_triples": lambda s, d: ev.calibrated(_observed(s, d), (2, 1, 0.4)),
    "confidence_scores": lambda s, d: ev.calibration_score(t.table(s, d, "labels").select((F.col("doc_id") % 97).alias("case_id"), (F.col("doc_id") % 101 / 100).alias("confidence"), (F.col("quality") == 1).alias("correct"))),
    "rank_correlation": lambda s, d: ev.spearman(_graders(s, d)),
    "consistency_rate": lambda s, d: ev.consistency(_runs3(s, d)),
    "metric_means": lambda s, d: ev.report(_configs(s, d), _METRICS),
    "config_pivot": lambda s, d: ev.report(_configs(s, d), _METRICS).groupBy("config").pivot("metric", _METRICS).agg(F.first("value")),
    "cost_latency_block": lambda s, d: _configs(s, d).groupBy("config").agg(*(F.round(F.avg(c), 6).alias(f"avg_{c}") for c in ("cost_usd", "latency_ms", "tokens"))),
    "comparison_per_case": lambda s, d: _configs(s, d).filter("config = 'direct'").select("case_id", F.col("output_status").alias("direct_status"), "expected_status").join(_configs(s, d).filter("config = 'full'").select("case_id", F.col("output_status").alias("full_status")), "case_id"),
    "ablation_aggregate": _aggregate,
    "case_flattening": lambda s, d: _profiles(s, d).select("variant", "profile", "case.expected_status", "judge.output_status", "cost.latency_ms", (F.col("retrieved.total") > 0).alias("has_evidence")).groupBy("profile", "expected_status", "output_status", "has_evidence").agg(F.count(F.lit(1)).alias("n"), F.sum("latency_ms").alias("latency_ms")),
    "gate_aggregates": _gates,
    "gate_report": lambda s, d: grounding.gate_report(grounding.gate_measures(_results(s, d), t.table(s, d, "conversations").select(F.col("conv_id").alias("run_id")), _CLASSES), _RULES),
    "preflight_verdict": _preflight,
    "coverage_by_case": lambda s, d: _coverage(s, d),
    "tiered_comparison": _tiers,
    "case_universe": _universe,
    "evidence_eligibility": lambda s, d: t.table(s, d, "labels").select(F.when(F.col("doc_id") % 4 == 0, "no_reranked_chunks").when(F.col("toxic") == 1, "refused").otherwise("eligible").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n")),
    "search_corpus": lambda s, d: t.table(s, d, "labels").select(F.col("doc_id").alias("case_id"), F.explode(F.array(F.lit("full"), F.lit("lean"))).alias("profile")).join(t.assets(s, d).select(F.col("asset_id").alias("case_id"), F.col("ticker").alias("origin")), "case_id").select("case_id", "profile", "origin"),
    "recovered_chunks": _recovered,
    "freeze_manifest": lambda s, d: t.table(s, d, "documents").select("doc_id", "source").join(t.table(s, d, "labels").filter("toxic = 1").select("doc_id"), "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("effective_n"), F.sum(F.crc32(F.concat_ws("|", F.col("doc_id").cast("string"), "source"))).alias("digest")),
    "audit_bundle": lambda s, d: _configs(s, d).agg((F.max("attribution_f1") > 0).alias("has_metric"), F.max(F.col("case_id") % 4 > 0).alias("has_tier")).withColumn("passes", F.col("has_metric") & F.col("has_tier")),
    "data_rates": lambda s, d: _rates(s, d),
    "category_f1": lambda s, d: t.table(s, d, "conversations").select("conv_id", "turn", F.round(ev.set_f1(F.array(F.col("role"), _pick(("user", "macro"), F.col("turn"))), F.array(F.lit("user"), F.lit("sector"))), 6).alias("f1")),
    "text_similarity": lambda s, d: t.table(s, d, "benchmark").select("item_id", F.round(ev.token_cosine(F.col("text"), F.concat("text", F.lit(" and some more"))), 6).alias("cosine")),
    "backoff_delays": lambda s, d: t.table(s, d, "events").select("event_id", ev.backoff(F.col("event_id") % 5 + 1, F.when(F.col("event_id") % 3 == 0, 0.0).otherwise(2.0), F.lit(1.5), F.lit(12.0), F.when(F.col("event_id") % 7 == 0, 9.0)).alias("seconds")),
    "http_classes": lambda s, d: t.table(s, d, "events").groupBy(ev.http_class(_pick((200, 401, 403, 404, 429, 500, 503, 0), F.col("event_id")), F.col("event_id") % 16 == 7).alias("kind")).agg(F.count(F.lit(1)).alias("n")),
    "dry_run_cost": lambda s, d: t.table(s, d, "part").select("p_partkey", ev.run_cost(F.col("p_size"), F.lit(1500.0), F.lit(0.02), F.lit(1.2), F.lit(30.0)).alias("c")).select("p_partkey", *(F.round(f"c.{x}", 6).alias(x) for x in ("api", "infra", "total"))),
    "cost_projection": lambda s, d: ev.projected(t.table(s, d, "orders").select(F.col("o_orderpriority").alias("model"), F.row_number().over(Window.partitionBy("o_orderpriority").orderBy("o_orderkey")).alias("nth"), (F.col("o_orderkey") % 7 / 2).alias("cost"))),
    "provider_advice": lambda s, d: ev.provider_audit(_profile_row(s, d)),
    "latest_per_model": lambda s, d: _latest(s, d),
    "sequential_ids": lambda s, d: t.long_bars(s, d).withColumn("n", F.row_number().over(Window.partitionBy("symbol").orderBy("date"))).select("symbol", "date", F.format_string("g%03d", F.col("n") + 5).alias("id")),
    "chunk_merge": lambda s, d: _merged(s, d),
    "model_union": lambda s, d: t.table(s, d, "orders").select(F.col("o_orderpriority").alias("model")).union(t.table(s, d, "events").select("event_type")).distinct(),
    "missing_requested": lambda s, d: s.createDataFrame([(3,), (10**9,), (7,), (10**9 + 1,)], "doc_id long").subtract(t.table(s, d, "documents").select("doc_id")),
    "reliability_compare": lambda s, d: _single(s, d),
    "report_json": lambda s, d: sinks.report_rows(ev.report(_configs(s, d), _METRICS).filter("not (config = 'full' and metric = 'tokens')"), _METRICS),
    "report_markdown": lambda s, d: sinks.report_markdown(ev.report(_configs(s, d), _METRICS), ["attribution_f1", "grounding_rate"]),
}


def _coverage(s, d):
    """Counts by layer and the source types seen in each case's window; politics by words of the text. Assets are counted by day first."""
    a = t.assets(s, d)
    daily = a.groupBy("reference_date", "source_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col("body").rlike(answers.GEO), F.lit(False))).alias("geo"))
    cases = _shifted_cases(s, d).select("symbol", "date").distinct()
    hits = evidence.window_join(cases, daily).groupBy("symbol", "date").agg(
        *(F.coalesce(F.sum(F.when(evidence.layer(F.col("source_type")) == k, F.col("n"))), F.lit(0)).alias(f"n_{k}") for k in ("direct", "macro")), F.sum("geo").alias("n_geo"), F.array_join(F.array_sort(F.collect_set("source_type")), ",").alias("sources"))
    return cases.join(hits, ["symbol", "date"], "left").select("symbol", "date", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_direct", "n_macro", "n_geo")), F.coalesce("sources", F.lit("")).alias("sources"))


def _rates(s, d):
    a = t.articles(s, d)
    flags = evidence.quality_flags(a)
    return flags.agg(F.round(F.avg(F.col("reason").isNull().cast("double")), 6).alias("eligibility_rate"), F.round(1 - F.avg(F.col("reason").isNull().cast("double")), 6).alias("noise_reduction_ratio")).crossJoin(
        a.agg(F.round(F.avg((F.col("asset_id") % 29 == 0).cast("double")), 6).alias("duplicate_rate"))).crossJoin(
        _coverage(s, d).agg(F.round(F.avg((F.col("n_direct") > 0).cast("double")), 6).alias("coverage_rate"), F.round(F.avg((F.col("n_direct") + F.col("n_macro") == 0).cast("double")), 6).alias("empty_on_big_move_rate")))  # one row each


def _latest(s, d):
    """The summary that counts for each model: of the wanted tag, else the newest."""
    rows = t.table(s, d, "orders").select(F.col("o_orderpriority").alias("model"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"), _pick(("run-a", "run-b", "run-ab"), F.col("o_orderkey")).alias("tag")).filter(F.contains("tag", F.lit("run-a")))
    best = F.max_by(F.struct("id", "tag"), F.struct(F.col("tag") == "run-a", "at", "id"))
    return rows.groupBy("model").agg(best.alias("b")).select("model", "b.id", "b.tag")


def _merged(s, d):
    """Chunks of two searches, the first of each id staying; chunks without an id all stay."""
    k = F.col("doc_id")
    one = t.table(s, d, "documents").filter(k % 3 != 0).select(F.lit(0).alias("search"), k.alias("place"), F.when(k % 5 != 0, k % 100).alias("asset_id"))
    two = t.table(s, d, "documents").filter(k % 4 == 0).select(F.lit(1).alias("search"), k.alias("place"), F.when(k % 5 != 0, k % 130).alias("asset_id"))
    return evidence.first_seen(one.unionByName(two), "asset_id", ["search", "place"])


def _single(s, d):
    """One grounded result against many direct ones: aligned by model, or if there is but one, against all."""
    direct = t.table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("model")).agg(F.count(F.lit(1)).alias("direct_n"))
    ours = t.table(s, d, "events").filter("event_type = 'click'").groupBy(F.col("event_type").alias("our_model")).agg(F.count(F.lit(1)).alias("our_n"))
    lone = ours.count() == 1
    rows = direct.crossJoin(F.broadcast(ours)) if lone else direct.join(ours, F.col("model") == F.col("our_model"), "full_outer")  # one row
    return rows.select(F.coalesce("model", "our_model").alias("model"), "direct_n", "our_n", F.lit("single" if lone else "aligned").alias("mode"), F.col("our_n").isNull().alias("missing"), (F.col("our_n") - F.col("direct_n")).alias("delta"))


ORACLE_SQL = {
    "percentiles_three": """WITH r AS (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars) - 1 AS k, count(*) OVER (PARTITION BY source) AS n FROM documents)
        SELECT source, max(n_chars) FILTER (k = least(floor(n * 0.9), n - 1)) AS floor, max(n_chars) FILTER (k = round_even((n - 1) * 0.9, 0)) AS nearest, round(quantile_cont(n_chars, 0.9), 4) AS linear, max(n) AS n FROM r GROUP BY 1""",
    "class_balance": f"WITH {PAIRED} SELECT count(*) FILTER (stratum = 'SUFFICIENT') AS sufficient, count(*) FILTER (stratum = 'PARTIAL') AS partial, count(*) FILTER (stratum = 'INSUFFICIENT') AS insufficient, least(count(*) FILTER (stratum = 'SUFFICIENT'), count(*) FILTER (stratum = 'PARTIAL'), count(*) FILTER (stratum = 'INSUFFICIENT')) < 10 AS warning FROM pr",
    "calibrated_triples": f"""WITH {GRADED}, ob AS (SELECT n, coverage, CASE WHEN case_id % 4 = 0 THEN 'PARTIAL' WHEN coverage > 0.45 THEN 'SUFFICIENT' WHEN n = 0 THEN 'INSUFFICIENT' ELSE 'PARTIAL' END AS expected FROM critic),
        g AS (SELECT a AS k_sufficient, b AS k_partial, c AS m FROM (VALUES (1), (2), (3)) x(a), (VALUES (1), (2)) y(b), (VALUES (0.3::DOUBLE), (0.4::DOUBLE), (0.5::DOUBLE)) z(c) WHERE b < a),
        sc AS (SELECT k_sufficient, k_partial, m, round(avg((CASE WHEN n >= k_sufficient AND coverage >= m THEN 'SUFFICIENT' WHEN n = 0 THEN 'INSUFFICIENT' WHEN n >= k_partial OR coverage < m THEN 'PARTIAL' ELSE 'INSUFFICIENT' END = expected)::INT), 6) AS accuracy FROM ob, g GROUP BY 1, 2, 3)
        SELECT *, row_number() OVER (ORDER BY accuracy DESC, abs(k_sufficient - 2), abs(k_partial - 1), round(abs(m - 0.4), 6), k_sufficient DESC, k_partial, m DESC) = 1 AS chosen FROM sc""",
    "confidence_scores": """WITH r AS (SELECT doc_id % 97 AS case_id, doc_id % 101 / 100 AS c, quality = 1 AS ok FROM labels), e AS (SELECT case_id, least(floor(c * 4), 3) AS b, abs(avg(c) - avg(ok::INT)) AS e FROM r GROUP BY 1, 2)
        SELECT case_id, round(greatest(0, 1 - avg(e)), 6) AS score FROM e GROUP BY 1""",
    "rank_correlation": """WITH p AS (SELECT doc_id * 13 % 20 / 20 AS x, (doc_id * 13 % 20 + doc_id % 3) / 22 AS y FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 5 <> 0),
        r AS (SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM p)
        SELECT round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman, round(avg((least(floor(x * 4), 3) = least(floor(y * 4), 3))::INT), 6) AS bucket_agreement, count(*) AS aligned_pairs FROM r""",
    "consistency_rate": """WITH r AS (SELECT doc_id AS c, ['full', 'lean'][doc_id % 2 + 1] AS profile, run, CASE WHEN doc_id % 5 = 0 AND run = 2 THEN 'PARTIAL' WHEN doc_id % 7 = 0 AND run = 1 THEN 'INSUFFICIENT' ELSE 'SUFFICIENT' END AS status, doc_id % 11 = 0 AND run = 0 AS refused FROM documents, (SELECT unnest([0, 1, 2]) AS run)),
        l AS (SELECT *, (lag(status) OVER (PARTITION BY c ORDER BY run) <> status)::INT AS ch FROM r), k AS (SELECT profile, c, (count(DISTINCT status) = 1)::INT AS s, (count(DISTINCT refused) = 1)::INT AS f, coalesce(sum(ch), 0) AS t FROM l GROUP BY 1, 2)
        SELECT profile, count(*) AS n_cases, round(avg(s), 6) AS status_consistency, round(avg(f), 6) AS refusal_consistency, CAST(sum(t) AS BIGINT) AS transitions FROM k GROUP BY 1""",
    "metric_means": f"WITH {CONFIGS}, u AS (UNPIVOT (SELECT config, {', '.join(_METRICS)} FROM cf) ON {', '.join(_METRICS)} INTO NAME metric VALUE v) SELECT config, metric, round(avg(v), 6) AS value FROM u GROUP BY 1, 2",
    "config_pivot": f"WITH {CONFIGS} SELECT config, {', '.join(f'round(avg({m}), 6) AS {m}' for m in _METRICS)} FROM cf GROUP BY 1",
    "cost_latency_block": f"WITH {CONFIGS} SELECT config, round(avg(cost_usd), 6) AS avg_cost_usd, round(avg(latency_ms), 6) AS avg_latency_ms, round(avg(tokens), 6) AS avg_tokens FROM cf GROUP BY 1",
    "comparison_per_case": f"WITH {CONFIGS} SELECT a.case_id, a.output_status AS direct_status, a.expected_status, b.output_status AS full_status FROM cf a JOIN cf b ON a.case_id = b.case_id AND a.config = 'direct' AND b.config = 'full'",
    "ablation_aggregate": f"""WITH {CONFIGS} SELECT ['l1', 'l1_l2'][case_id % 2 + 1] AS variant, config AS profile, count(*) AS n_cases, round(avg((output_status = expected_status)::INT), 6) AS status_accuracy, round(coalesce(avg((output_status = 'INSUFFICIENT')::INT) FILTER (should_refuse), 0), 6) AS refuse_hit_rate,
        round(avg(attribution_f1), 6) AS avg_attribution_f1, round(avg(grounding_rate), 6) AS avg_grounding_rate, round(avg(latency_ms), 6) AS avg_latency_ms, round(avg(tokens), 6) AS avg_tokens, round(avg(cost_usd), 6) AS avg_cost_usd,
        round(avg(CASE WHEN case_id % 5 = 0 THEN 0 ELSE (case_id % 4) / (case_id % 5) END), 6) AS avg_l2_ratio FROM cf GROUP BY 1, 2""",
    "case_flattening": f"WITH {CONFIGS} SELECT config AS profile, expected_status, output_status, case_id % 5 > 0 AS has_evidence, count(*) AS n, sum(latency_ms) AS latency_ms FROM cf GROUP BY 1, 2, 3, 4",
    "gate_report": f"""WITH {CONFIGS}, rs AS (SELECT cf.config, case_id % 400 AS run_id, CASE WHEN n_chars % 89 <> 0 THEN output_status END AS st, lang = 'de' AS refuse, CASE WHEN n_chars % 97 <> 0 THEN list_transform(range(0, n_chars % 4 + 1), lambda i: case_id + i * (n_chars % 3)) END AS cited,
            CASE WHEN n_chars % 101 <> 0 THEN [case_id, case_id + 1, case_id + n_chars % 5] END AS got, latency_ms, CASE WHEN n_chars % 1009 <> 0 THEN cost_usd END AS cost, tokens FROM cf JOIN documents ON doc_id = case_id),
        ms AS (SELECT coalesce(sum(coalesce(len(list_filter(cited, lambda x: list_contains(coalesce(got, []), x))), 0)) / sum(coalesce(len(cited), 0)), 1) AS v, avg((st IS NOT NULL AND cited IS NOT NULL AND got IS NOT NULL)::INT) AS sv,
            avg((run_id IN (SELECT conv_id FROM conversations))::INT) AS tc, bool_and(latency_ms IS NOT NULL AND cost IS NOT NULL AND tokens IS NOT NULL)::INT AS told FROM rs),
        rf AS (SELECT min(r) AS r FROM (SELECT coalesce(avg((st = 'INSUFFICIENT')::INT) FILTER (refuse), 0) AS r FROM rs GROUP BY config)),
        g AS (SELECT 'evidence_validity' AS gate, '>=' AS rule, 0.5::DOUBLE AS bound, round(v, 6) AS value FROM ms UNION ALL SELECT 'schema_validity', '==', 1.0, round(sv, 6) FROM ms UNION ALL SELECT 'trace_completeness', '>=', 0.2, round(tc, 6) FROM ms
            UNION ALL SELECT 'should_refuse_hit_rate', '>=', 0.3, round(r, 6) FROM rf UNION ALL SELECT 'cost_latency_reported', '==', 1.0, told FROM ms),
        j AS (SELECT *, CASE WHEN (rule = '>=' AND value >= bound) OR (rule = '==' AND value = bound) THEN 'PASS' ELSE 'FAIL' END AS verdict FROM g)
        SELECT * FROM j UNION ALL SELECT 'overall', '==', 5.0, count(*) FILTER (verdict = 'PASS')::DOUBLE, CASE WHEN count(*) FILTER (verdict = 'PASS') = 5 THEN 'PASS' ELSE 'FAIL' END FROM j""",
    "gate_aggregates": f"""WITH {CONFIGS}, r AS (SELECT config, coalesce(avg((output_status = 'INSUFFICIENT')::INT) FILTER (should_refuse), 0) AS r FROM cf GROUP BY 1), m AS (SELECT (SELECT avg((d.doc_id IS NOT NULL)::INT) FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id + 1000003 * l.toxic) AS v, (SELECT min(r) FROM r) AS r)
        SELECT 'evidence_validity' AS gate, round(v, 6) AS value, CASE WHEN v >= 0.85 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM m UNION ALL SELECT 'cost_latency_reported', 1.0, 'PASS' UNION ALL SELECT 'refuse_hit_rate', round(r, 6), CASE WHEN r >= 0.5 THEN 'PASS' ELSE 'FAIL' END FROM m""",
    "preflight_verdict": f"""WITH {SHIFTED}, {ASSETS}, h AS (SELECT DISTINCT asset_id, body FROM shifted c JOIN assets a ON a.reference_date BETWEEN c.date - 3 AND c.date + 3 WHERE {LAYER} = 'macro'), dd AS (SELECT min(n) AS direct FROM (SELECT ticker, count(DISTINCT asset_id) AS n FROM assets WHERE {LAYER} = 'direct' GROUP BY 1)),
        x AS (SELECT count(*) AS macro, count(*) FILTER (regexp_matches(body, '(?i)(tariff|policy|fed|rate|inflation|export|ban|sanction|trade|war)')) AS geo FROM h) SELECT macro, geo, direct, macro >= 50 AND direct >= 3 AND geo >= 10 AS ready FROM x, dd""",
    "coverage_by_case": f"""WITH {SHIFTED}, {ASSETS}, c AS (SELECT DISTINCT symbol, date FROM shifted) SELECT c.symbol, c.date, count(*) FILTER ({LAYER} = 'direct') AS n_direct, count(*) FILTER ({LAYER} = 'macro') AS n_macro,
        count(*) FILTER (regexp_matches(body, '(?i)(tariff|policy|fed|rate|inflation|export|ban|sanction|trade|war)')) AS n_geo, coalesce(string_agg(DISTINCT source_type, ',' ORDER BY source_type), '') AS sources FROM c LEFT JOIN assets a ON a.reference_date BETWEEN c.date - 3 AND c.date + 3 GROUP BY 1, 2""",
    "tiered_comparison": f"""WITH {CONFIGS} SELECT 'all' AS tier, config, count(*) AS n, round(avg((output_status = expected_status)::INT), 6) AS accuracy FROM cf GROUP BY 2 UNION ALL SELECT 'with_evidence', config, count(*), round(avg((output_status = expected_status)::INT), 6) FROM cf WHERE case_id % 4 > 0 GROUP BY 2""",
    "case_universe": "SELECT doc_id AS case_id, 'full' AS lacks FROM documents WHERE doc_id % 50 = 3",
    "evidence_eligibility": "SELECT CASE WHEN doc_id % 4 = 0 THEN 'no_reranked_chunks' WHEN toxic = 1 THEN 'refused' ELSE 'eligible' END AS reason, count(*) AS n FROM labels GROUP BY 1",
    "search_corpus": "SELECT l.doc_id AS case_id, p.profile, d.source AS origin FROM labels l JOIN documents d USING (doc_id), (VALUES ('full'), ('lean')) p(profile)",
    "audit_bundle": f"WITH {CONFIGS} SELECT max(attribution_f1) > 0 AS has_metric, bool_or(case_id % 4 > 0) AS has_tier, max(attribution_f1) > 0 AND bool_or(case_id % 4 > 0) AS passes FROM cf",
    "category_f1": "SELECT conv_id, turn, round(2.0 * len(list_intersect(list_distinct([role, ['user', 'macro'][turn % 2 + 1]]), ['user', 'sector'])) / (len(list_distinct([role, ['user', 'macro'][turn % 2 + 1]])) + 2), 6) AS f1 FROM conversations",
    "text_similarity": """WITH w AS (SELECT item_id, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS a, list_distinct(list_filter(string_split_regex(lower(text || ' and some more'), '\\s+'), lambda x: x <> '')) AS b FROM benchmark)
        SELECT item_id, round(len(list_intersect(a, b)) / sqrt(len(a) * len(b)), 6) AS cosine FROM w""",
    "backoff_delays": "SELECT event_id, least(12.0::DOUBLE, CASE WHEN event_id % 7 = 0 THEN 9.0::DOUBLE WHEN event_id % 3 = 0 THEN 0.0::DOUBLE ELSE greatest(2.0::DOUBLE * pow(2, event_id % 5), 1.5::DOUBLE) END) AS seconds FROM events",
    "http_classes": "SELECT CASE WHEN event_id % 8 IN (1, 2) THEN 'immediate_fallback' WHEN event_id % 8 IN (4, 5, 6) OR event_id % 16 = 7 THEN 'retryable' ELSE 'no_fallback' END AS kind, count(*) AS n FROM events GROUP BY 1",
    "dry_run_cost": "SELECT p_partkey, round(p_size * 1.5::DOUBLE * 0.02::DOUBLE, 6) AS api, round(p_size * 1.2::DOUBLE * 30::DOUBLE / 3600::DOUBLE, 6) AS infra, round(p_size * 1.5::DOUBLE * 0.02::DOUBLE + p_size * 1.2::DOUBLE * 30::DOUBLE / 3600::DOUBLE, 6) AS total FROM part",
    "cost_projection": """WITH r AS (SELECT o_orderpriority AS model, o_orderkey % 7 / 2 AS cost, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS k FROM orders)
        SELECT model, round(sum(cost) * 5 * 1.5::DOUBLE, 6) AS projected, sum(cost) * 5 * 1.5::DOUBLE > 20 AS substitute FROM r WHERE k <= 2 GROUP BY 1""",
    "provider_advice": """WITH p AS (SELECT source, source IN ('src1', 'src2', 'src3') AS is_news, avg((doc_id % 9 <> 0)::INT) AS ro, avg((doc_id % CASE WHEN source = 'src5' THEN 2 ELSE 7 END <> 0)::INT) AS eo, avg(doc_id % 90) AS ml, avg(length(text)) AS mb, median(CASE WHEN source <> 'src3' THEN length(text) END) AS mc,
            avg(coalesce((length(text) >= 200)::INT, NULL)) AS el, avg((doc_id % 13 = 0)::INT) AS mt, avg((doc_id % 29 = 0)::INT) AS du, count(*) AS n FROM documents GROUP BY 1),
        q AS (SELECT source, n, is_news, round(ro, 6) AS run_ok_rate, round(eo, 6) AS endpoint_ok_rate, round(ml, 4) AS mean_latency, round(mb, 4) AS mean_bytes, mc AS median_chars, round(coalesce(el, 0), 6) AS eligible_rate, round(mt, 6) AS missing_title_rate, round(du, 6) AS duplicate_rate FROM p)
        SELECT *, CASE WHEN run_ok_rate < 0.7 OR endpoint_ok_rate < 0.7 THEN 'fallback_only_unstable' WHEN NOT is_news THEN 'primary_candidate' WHEN median_chars IS NULL THEN 'fallback_no_coverage' WHEN eligible_rate < 0.35 OR median_chars < 120 THEN 'fallback_low_text_quality' ELSE 'primary_candidate' END AS recommendation FROM q""",
    "latest_per_model": """WITH r AS (SELECT o_orderpriority AS model, o_orderkey AS id, o_orderdate AS at_, ['run-a', 'run-b', 'run-ab'][o_orderkey % 3 + 1] AS tag FROM orders WHERE o_orderkey % 3 <> 1)
        SELECT model, id, tag FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY tag = 'run-a' DESC, at_ DESC, id DESC) AS k FROM r) WHERE k = 1""",
    "sequential_ids": "WITH l AS (SELECT DISTINCT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS date FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS n FROM l) SELECT symbol, date, printf('g%03d', n + 5) AS id FROM r",
    "chunk_merge": """WITH u AS (SELECT 0 AS search, doc_id AS place, CASE WHEN doc_id % 5 <> 0 THEN doc_id % 100 END AS asset_id FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT 1, doc_id, CASE WHEN doc_id % 5 <> 0 THEN doc_id % 130 END FROM documents WHERE doc_id % 4 = 0)
        SELECT search, place, asset_id FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY search, place) AS k FROM u) WHERE k = 1 OR asset_id IS NULL""",
    "model_union": "SELECT o_orderpriority AS model FROM orders UNION SELECT event_type FROM events",
    "missing_requested": "SELECT unnest([3, 1000000000, 7, 1000000001])::BIGINT AS doc_id EXCEPT SELECT doc_id FROM documents",
    "reliability_compare": """WITH a AS (SELECT o_orderpriority AS model, count(*) AS direct_n FROM orders GROUP BY 1), b AS (SELECT count(*) AS our_n FROM events WHERE event_type = 'click')
        SELECT model, direct_n, our_n, 'single' AS mode, false AS missing, our_n - direct_n AS delta FROM a, b""",
    "report_markdown": f"""WITH {CONFIGS}, r AS (SELECT config, '| ' || config || ' | ' || printf('%.4f', round(avg(attribution_f1), 6)) || ' | ' || printf('%.4f', round(avg(grounding_rate), 6)) || ' |' AS line FROM cf GROUP BY 1)
        SELECT 0 AS nth, '| config | attribution_f1 | grounding_rate |' AS line UNION ALL SELECT 1, '|---|---|---|' UNION ALL SELECT row_number() OVER (ORDER BY config) + 1, line FROM r""",
}
ORACLE_SQL["data_rates"] = f"""WITH {QUALITY}, cv AS (SELECT * FROM ({ORACLE_SQL['coverage_by_case']})) SELECT round(avg((reason IS NULL)::INT), 6) AS eligibility_rate, round(1 - avg((reason IS NULL)::INT), 6) AS noise_reduction_ratio, round(avg((asset_id % 29 = 0)::INT), 6) AS duplicate_rate,
    (SELECT round(avg((n_direct > 0)::INT), 6) FROM cv) AS coverage_rate, (SELECT round(avg((n_direct + n_macro = 0)::INT), 6) FROM cv) AS empty_on_big_move_rate FROM flags"""
