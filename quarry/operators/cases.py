"""Cases: guards from the question, graders that stand in for a model, validation, outputs, and lifecycle of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import answers
from quarry.operators import grounding

# The node that follows each, and the statuses that end a run.
NEXT_NODE = {"miner": "critic", "critic": "decision_router", "decision_router": "judge", "judge": "validator", "validator": "finalizer",
             "baseline_prepare_evidence": "judge", "expand_macro": "miner"}
TERMINAL = ["SUCCEEDED", "PARTIAL", "INSUFFICIENT", "SYSTEM_ERROR", "FAILED_SYSTEM", "FAILED_REQUEST", "CANCELLED"]
# What a refusal says for each guard.
GUARD_TEXT = {"ticker_mismatch_guard": "Query ticker does not match resolved ticker.", "market_session_guard": "No trading session on requested date for this ticker.",
              "magnitude_guard": "Claimed price move is inconsistent with OHLCV data."}
# Summaries of a case without evidence and of one that failed, with places for its own words.
LACKING = ("No evidence meeting the relevance threshold (>%s) was found for %s on %s. This may indicate the price move was driven by "
           "factors outside our data coverage (private information, market microstructure, or sources we do not ingest).")
BROKEN = ("**System error** during attribution for %s on %s. The Critic node failed to produce a valid response: %s. "
          "This is an infrastructure issue, not an evidence gap.")
# Reasons for which a request itself is at fault.
REQUEST_FAULTS = ["unsupported_ticker", "date_out_of_range", "missing_trading_day_context", "invalid_query_type", "empty_query", "query_too_long", "invalid_trade_date"]
# Artifacts that each node leaves.
ARTIFACTS = {
    "miner": ["retrieved_chunks", "reranked_chunks", "state_snapshot"],
    "critic": ["graded_evidence", "all_graded_chunks", "critic_decision", "raw_llm_response", "state_snapshot"],
    "decision_router": ["state_snapshot"], "expand_macro": ["state_snapshot"],
    "judge": ["judge_causes", "judge_summary", "raw_llm_response", "state_snapshot"],
    "validator": ["validator_decision", "raw_llm_response", "state_snapshot"],
    "finalizer": ["state_snapshot"], "insufficient_handler": ["state_snapshot"], "system_error_handler": ["error_snapshot"], "baseline_prepare_evidence": ["state_snapshot"],
}
MOST_TICKERS = 100_000


def guards(requests: DataFrame, bars: DataFrame, aliases: dict[str, str] = answers.ALIASES, tolerance: float = 10.0) -> DataFrame:
    """requests (case_id, ticker, trade_date, query) with three nullable guards. bars: ticker, date, open, close."""
    tickers = bars.select("ticker").distinct()
    if tickers.count() > MOST_TICKERS:
        raise ValueError(f"more than {MOST_TICKERS} tickers")
    known = tickers.agg(F.collect_set("ticker").alias("__known"))  # one row, whose list is bounded
    move = F.when(F.col("open") != 0, (F.col("close") - F.col("open")) / F.col("open") * 100)
    priced = bars.select(F.col("ticker").alias("__t"), F.col("date").alias("__d"), move.alias("__move"), F.lit(True).alias("__session"))
    rows = requests.crossJoin(F.broadcast(known)).join(priced, (F.col("ticker") == F.col("__t")) & (F.col("trade_date") == F.col("__d")), "left")
    named, claimed = answers.query_ticker(F.col("query"), F.col("__known"), aliases), answers.claimed_percent(F.col("query"))
    out = rows.withColumns({"query_ticker": named, "claimed_pct": claimed, "actual_pct": F.col("__move")})
    return out.withColumns({
        "ticker_consistent": F.col("query_ticker") == F.col("ticker"), "session_valid": F.coalesce("__session", F.lit(False)),
        "magnitude_plausible": F.abs(F.col("claimed_pct") - F.col("actual_pct")) <= tolerance}).drop("__known", "__t", "__d", "__move", "__session")


def validated(requests: DataFrame, bars: DataFrame, most_chars: int = 500) -> DataFrame:
    """The first fault of each request (request_id, ticker, day, query: texts), or null. bars: ticker, date."""
    clean = F.upper(F.trim("ticker"))
    day = F.when(F.col("day").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("day").try_cast("date"))
    rows = requests.withColumns({"__ticker": clean, "__day": day})
    bounds = bars.groupBy(F.col("ticker").alias("__b")).agg(F.min("date").alias("__lo"), F.max("date").alias("__hi"))
    sessions = bars.select(F.col("ticker").alias("__st"), F.col("date").alias("__sd")).distinct().withColumn("__open", F.lit(True))
    rows = rows.join(bounds, F.col("__ticker") == F.col("__b"), "left").join(sessions, (F.col("__ticker") == F.col("__st")) & (F.col("__day") == F.col("__sd")), "left")
    said = F.trim("query")
    fault = (F.when(F.col("__b").isNull(), "unsupported_ticker").when(F.col("__day").isNull(), "invalid_trade_date")
             .when(~F.col("__day").between(F.col("__lo"), F.col("__hi")), "date_out_of_range").when(F.col("__open").isNull(), "missing_trading_day_context")
             .when(said == "", "empty_query").when(F.length(said) > most_chars, "query_too_long"))
    return rows.select(*requests.columns, fault.alias("fault"))


def graded_by_status(chunks: DataFrame) -> DataFrame:
    """Grades without a model: the first four (SUFFICIENT) or two (PARTIAL) chunks of a case are relevant. chunks:
    case_id, nth (from 0), expected_status."""
    n = F.when(F.col("expected_status") == "SUFFICIENT", 4).when(F.col("expected_status") == "PARTIAL", 2).otherwise(0)
    high = F.when(F.col("expected_status") == "SUFFICIENT", 0.72).when(F.col("expected_status") == "PARTIAL", 0.55).otherwise(0.2)
    return chunks.withColumns({"relevance": F.when(F.col("nth") < n, high).otherwise(0.24), "temporal_match": F.lit(True)})


def graded_by_source(source_type: Column, nth: Column) -> Column:
    """Grades without a model, by source and place."""
    relevance = F.when(F.contains(source_type, F.lit("news")), 0.8).when(F.contains(source_type, F.lit("fundamentals")), 0.7).otherwise(0.3)
    return F.struct(relevance.alias("relevance"), F.element_at(F.array(F.lit("sector"), F.lit("earnings"), F.lit("macro")), (nth % 3 + 1).cast("int")).alias("category"))


def direction(move: Column) -> Column:
    return F.when(move.isNull(), "unknown").when(move > 0, "positive").when(move < 0, "negative").otherwise("neutral")


def judged_by_golden(golden: Column, evidence: Column, refuse: Column, move: Column) -> Column:
    """Causes without a model: the first two golden texts, each with a piece of evidence by place; none on refusal."""
    def cause(text, i):
        at = F.least(i, F.size(evidence) - 1).cast("int")
        return F.struct(text.alias("text"), (F.lit(0.79) - i * 0.05).alias("confidence"), F.array(F.get(evidence, at)).alias("evidence_ids"), direction(move).alias("direction"))

    none = F.array().cast("array<struct<text:string,confidence:double,evidence_ids:array<bigint>,direction:string>>")
    return F.when(refuse | (F.size(evidence) == 0), none).otherwise(F.transform(F.slice(golden, 1, 2), cause))


def forwarded(rerank: Column, fused: Column) -> Column:
    """A chunk's relevance where there is no critic."""
    return F.coalesce(rerank, fused, F.lit(1.0))


def first_causes(causes: DataFrame, most: int = 5) -> DataFrame:
    """The first causes of each case: case_id, nth, cause_id."""
    nth = F.row_number().over(Window.partitionBy("case_id").orderBy("nth"))
    return causes.withColumn("__n", nth).filter(F.col("__n") <= most).drop("__n")


def corrected(cases: DataFrame) -> DataFrame:
    """Status and error after at most one correction. cases: case_id, decision, n_causes, first_failure, second_failure
    (null: mended), has_correction, timed_out (the correction never came)."""
    status = F.when(F.col("decision").isNull(), F.when(F.col("n_causes") > 0, "SUFFICIENT").otherwise("INSUFFICIENT")).when(F.col("decision") == "sufficient", "SUFFICIENT").when(F.col("decision") == "partial", "PARTIAL").otherwise("INSUFFICIENT")
    failure = F.when(F.col("first_failure").isNull(), None).when(~F.col("has_correction"), F.col("first_failure")).when(F.col("timed_out"), "model_timeout").otherwise(F.col("second_failure"))
    attempts = F.when(F.col("first_failure").isNull() | ~F.col("has_correction"), 0).otherwise(1)
    return cases.select("case_id", F.when(failure.isNull(), status).when(failure == "model_timeout", "SYSTEM_ERROR").otherwise("PARTIAL").alias("status"), failure.alias("validation_error"), attempts.alias("attempts"))


def refusal(ticker: Column, day: Column, edge: Column, reason: Column, said: Column, threshold: float = 0.25) -> Column:
    """Status, number of causes and summary of a case that no judge sees."""
    guard = F.lit("")
    for name, text in GUARD_TEXT.items():
        guard = F.when(reason == name, F.lit(text + " ")).otherwise(guard)
    lacking = F.concat(guard, F.format_string(LACKING, F.lit(str(threshold)), ticker, day.cast("string")))
    broken = F.format_string(BROKEN, ticker, day.cast("string"), F.coalesce(said, F.lit("Unknown error")))
    return (F.when(edge == "system_error", F.struct(F.lit("SYSTEM_ERROR").alias("status"), F.lit(0).alias("n_causes"), broken.alias("summary")))
            .when(edge == "insufficient", F.struct(F.lit("INSUFFICIENT").alias("status"), F.lit(1).alias("n_causes"), lacking.alias("summary"))))


def run_states(log: DataFrame) -> DataFrame:
    """Each run's status from its log of commands (run_id, seq, command, result): a run is queued, started, ended with a
    result, or cancelled while it is neither; what comes after its end changes nothing."""
    ends = F.col("command").isin("end", "cancel")
    first_end = F.min_by(F.struct("command", "result"), F.when(ends, F.col("seq")))
    out = log.groupBy("run_id").agg(first_end.alias("e"), F.max(F.col("command") == "start").alias("started"), F.min(F.when(ends, F.col("seq"))).alias("at"), F.count(F.lit(1)).alias("n"))
    status = F.when(F.col("at").isNull(), F.when(F.col("started"), "RUNNING").otherwise("QUEUED")).when(F.col("e.command") == "cancel", "CANCELLED").otherwise(grounding.run_state(F.col("e.result")))
    return out.select("run_id", status.alias("status"), F.when(F.col("e.command") == "cancel", "user_cancelled").alias("error_type"), F.col("at").alias("ended_seq"))


def retried(log: DataFrame, states: DataFrame) -> DataFrame:
    """Links of retries (run_id: the new run, parent_run_id) of runs that had ended. log: retry commands with the new run's id in result."""
    asked = log.filter("command = 'retry'").select(F.col("run_id").alias("parent_run_id"), F.col("result").alias("run_id"), "seq")
    ended = states.filter("ended_seq is not null").select(F.col("run_id").alias("__p"), "ended_seq")
    return asked.join(ended, F.col("parent_run_id") == F.col("__p")).filter("seq > ended_seq").select("run_id", "parent_run_id", F.lit("retry").alias("link_type"))


def next_node(last: Column, status: Column) -> Column:
    """The node expected next; null for a run that has ended."""
    nodes = F.create_map(*[F.lit(x) for kv in NEXT_NODE.items() for x in kv])
    return F.when(~status.isin(TERMINAL), F.coalesce(F.try_element_at(nodes, last), F.lit("miner")))


def failure_of(run_status: Column, run_error: Column, event_error: Column, node: Column) -> Column:
    """struct<status, reason, source, node, retryable> of a run that failed, else null: an event's error first."""
    def payload(status, reason, source, at):
        return F.struct(grounding.run_state(F.lit(status)).alias("status"), reason.alias("reason"), F.lit(source).alias("source"), at.alias("node"), grounding.retryable(F.lit(status), reason).alias("retryable"))

    none = F.lit(None).cast("string")
    return (F.when(event_error.isNotNull() & (event_error != ""), payload("FAILED_SYSTEM", event_error, "trace_events", node))
            .when(run_error.isin(REQUEST_FAULTS) | (run_status == "FAILED_REQUEST"), payload("FAILED_REQUEST", run_error, "agent_runs", none))
            .when(run_error.isNotNull() | (run_status == "SYSTEM_ERROR"), payload("SYSTEM_ERROR", F.coalesce(run_error, F.lit("system_error")), "agent_runs", none)))


def artifacts(events: DataFrame) -> DataFrame:
    """A row for each artifact that an event's node leaves: run_id, event_seq, node, artifact_type."""
    kinds = F.create_map(*[x for k, v in ARTIFACTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return events.select("run_id", "event_seq", "node", F.explode(F.try_element_at(kinds, F.col("node"))).alias("artifact_type"))


def projected_chunks(chunks: DataFrame, most: int = 20) -> DataFrame:
    """A case's first chunks as one JSON text of trimmed fields: case_id, n, json. chunks: case_id, rank, asset_id, source_type, score, headline, snippet."""
    kept = chunks.filter(F.col("rank") <= most)
    entry = F.struct("rank", "asset_id", "source_type", F.round("score", 6).alias("score"), "headline", F.substring("snippet", 1, 200).alias("snippet"))
    return kept.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.to_json(F.struct(F.sort_array(F.collect_list(entry)).alias("chunks"))).alias("json"))


def more_reliable(direct_status: Column, hallucinated: Column, status: Column, grounding_rate: Column, precision: Column) -> Column:
    """Is the grounded answer reliable and the direct one not? False where either is missing."""
    ours = (status == "INSUFFICIENT") | (F.coalesce(grounding_rate >= 0.6, F.lit(False)) & F.coalesce(precision >= 0.6, F.lit(False)))
    theirs = (direct_status == "SUFFICIENT") & ~F.coalesce(hallucinated, F.lit(False))
    return F.when(direct_status.isNull() | status.isNull(), False).otherwise(F.coalesce(ours & ~theirs, F.lit(False)))


def sanitised(causes: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per case, what remains of its causes' citations: status, n_causes, n_valid, n_cited. causes: case_id, cause_id, asset_id (null: cites nothing)."""
    known = evidence.select(F.col("asset_id").alias("__a")).distinct().withColumn("__known", F.lit(1))
    rows = causes.join(known, F.col("asset_id") == F.col("__a"), "left")
    out = rows.groupBy("case_id").agg(F.countDistinct("cause_id").alias("n_causes"), F.count("__known").alias("n_valid"), F.count("asset_id").alias("n_cited"))
    status = F.when(F.col("n_causes") == 0, "INSUFFICIENT").when(F.col("n_valid") < F.col("n_cited"), "PARTIAL").otherwise("SUFFICIENT")
    return out.withColumn("status", status)


def backfilled(cases: DataFrame, strict: bool = False) -> DataFrame:
    """Cases with expected_status and should_refuse filled in; strict: a case that lacks one stops the job, by name."""
    if strict:
        lacks = F.col("expected_status").isNull() | F.col("should_refuse").isNull()
        cases = cases.withColumn("expected_status", F.when(lacks, F.raise_error(F.concat(F.lit("case without a label: "), F.col("case_id").cast("string")))).otherwise(F.col("expected_status")))
    refuse = F.coalesce("should_refuse", F.lit(False))
    return cases.withColumns({"should_refuse": refuse, "expected_status": F.coalesce("expected_status", F.when(refuse, "INSUFFICIENT").otherwise("SUFFICIENT"))})


def health(components: DataFrame) -> DataFrame:
    """The worst status of each group's components (ready, degraded, failed), and whether vector sizes disagree, which fails it."""
    level = F.when(F.col("status") == "failed", 2).when(F.col("status") == "degraded", 1).otherwise(0)
    out = components.groupBy("group").agg(F.max(level).alias("worst"), F.countDistinct("vector_dim").alias("dims"))
    return out.select("group", F.when((F.col("worst") == 2) | (F.col("dims") > 1), "failed").when(F.col("worst") == 1, "degraded").otherwise("ready").alias("status"), (F.col("dims") > 1).alias("dim_mismatch"))


def pricing_id(model: Column, known: list[str], families: list[str]) -> Column:
    """The model that prices are listed under: itself, else the family its name begins with, else itself."""
    out = model
    for f in families:
        out = F.when(model.startswith(f), f).otherwise(out)
    return F.when(model.isin(known), model).otherwise(out)


def resolved(ids: DataFrame, chunks: DataFrame) -> DataFrame:
    """Which chunk a cited id means: the exact one, else by the id's cleaned alias (``n``, ``chunk_n``, ``evidence_n``)
    the n-th, else by its first number the n-th, else the first chunk whose id contains it. ids: case_id, cited; chunks:
    case_id, nth (from 1), chunk_id. A case has few chunks: they are joined by case, and the best match is kept."""
    alias = F.regexp_replace(F.lower("cited"), "[^a-z0-9_]", "")
    place = F.regexp_extract(alias, r"^(?:chunk_|evidence_)?(\d{1,9})$", 1)
    number = F.regexp_extract("cited", r"(\d{1,9})", 1)
    rows = ids.withColumns({"__place": F.nullif(place, F.lit("")).cast("int"), "__number": F.nullif(number, F.lit("")).cast("int")}).join(chunks, "case_id", "left")
    step = (F.when(F.col("chunk_id") == F.col("cited"), 1).when(F.col("nth") == F.col("__place"), 2).when(F.col("nth") == F.col("__number"), 3).when(F.contains("chunk_id", "cited"), 4))
    best = F.min(F.when(step.isNotNull(), F.struct(step.alias("step"), "nth", "chunk_id")))
    return rows.groupBy("case_id", "cited").agg(best.alias("b")).select("case_id", "cited", F.col("b.chunk_id").alias("chunk_id"), F.col("b.step").alias("step"))


def contract_errors(payloads: DataFrame, contract: list[tuple[str, str]]) -> DataFrame:
    """A row for each rule (key path, type) that a JSON payload breaks: missing_key or type_mismatch. A whole number is a
    float too; a boolean is no number."""
    kinds = {"BIGINT": "int", "DECIMAL": "float", "DOUBLE": "float", "STRING": "str", "BOOLEAN": "bool", "VOID": "null"}
    found = payloads.withColumn("__v", F.try_parse_json("payload"))
    rules = []
    for path, kind in contract:
        at = F.try_variant_get("__v", "$." + path, "variant")
        shown = F.regexp_extract(F.schema_of_variant(at), "^([A-Z]+)", 1)
        actual = F.lit(None).cast("string")
        for name, short in {**kinds, "OBJECT": "dict", "ARRAY": "list"}.items():
            actual = F.when(shown == name, short).otherwise(actual)
        fine = actual.isin("int", "float") if kind == "float" else actual == kind
        error = F.when(at.isNull(), F.lit("missing_key")).when(~F.coalesce(fine, F.lit(False)), "type_mismatch")
        rules.append(F.when(error.isNotNull(), F.struct(F.lit(path).alias("key_path"), error.alias("error_kind"), F.lit(kind).alias("expected"), F.when(at.isNotNull(), actual).alias("actual"))))
    return found.select("payload_id", F.explode(F.filter(F.array(*rules), lambda x: x.isNotNull())).alias("e")).select("payload_id", "e.*")


def lint(cases: DataFrame, tickers: DataFrame, holidays: list[str]) -> DataFrame:
    """Faults of refusal cases (case_id, ticker, day, query, expected_status, should_refuse): case_id, level, code."""
    known = tickers.agg(F.collect_set("ticker").alias("__known"))  # one row: the tickers there are
    day = F.when(F.col("day").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("day").try_cast("date"))
    rows = cases.withColumn("__day", day).crossJoin(F.broadcast(known))
    named = F.get(F.filter(answers.capitals(F.col("query")), lambda w: F.array_contains("__known", w)), 0)
    rule = lambda bad, level, code: F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(level).alias("level"), F.lit(code).alias("code")))
    faults = [rule(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", "error", f"missing_{c}") for c in ("ticker", "day", "query", "expected_status", "should_refuse")]
    faults += [
        rule(F.col("__day").isNull(), "error", "trade_date_format_invalid"),
        rule((F.weekday("__day") >= 5) | F.col("__day").cast("string").isin(holidays), "warning", "market_closed_date"),
        rule(~F.array_contains("__known", F.coalesce("ticker", F.lit(""))), "error", "ticker_not_in_db"),
        rule(~F.col("expected_status").eqNullSafe("INSUFFICIENT"), "error", "expected_status_not_insufficient"),
        rule(~F.col("should_refuse").eqNullSafe(F.lit(True)), "error", "should_refuse_not_true"),
        rule(named != F.coalesce("ticker", F.lit("")), "error", "query_ticker_mismatch")]
    return rows.select("case_id", F.explode(F.filter(F.array(*faults), lambda x: x.isNotNull())).alias("f")).select("case_id", "f.level", "f.code")
