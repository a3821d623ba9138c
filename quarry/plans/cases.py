"""Queries over requests, guards, layered retrieval, graders, validation and outputs, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import answers, text
from quarry.operators import cases as ops
from quarry.operators import decision, retrieval
from quarry.plans.market import ASSETS, BARS, DIRECT, MACRO
from quarry.plans.runs import STATE, _guards
from quarry.sources import tables as t

_ALIASES = {"APPLE": "CLICK"}
_HOLIDAYS = ["2024-01-01", "2024-01-15"]


def _pick(values, column):
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(column, F.lit(len(values))) + 1).cast("int"))


def _tickered(s, d):
    return t.bars(s, d).withColumn("ticker", F.upper("symbol"))


def _requests(s, d):
    """A case for each bar; its question names its ticker and move, another's, an alias, no one, or is missing."""
    b = _tickered(s, d)
    k = F.dayofmonth("date") + F.length("symbol")
    move = F.round((F.col("close") - F.col("open")) / F.col("open") * 100).cast("long")
    said = [F.lit(None).cast("string"), F.lit(""), F.concat(F.lit("Why did "), F.col("ticker"), F.lit(" move "), move.cast("string"), F.lit("% today?")),
            F.lit("Why did APPLE jump 250%?"), F.lit("did View fall -3.5 % or so"), F.lit("what happened there")]
    query = F.lit(None).cast("string")
    for i, x in enumerate(said):
        query = F.when(k % 6 == i, x).otherwise(query)
    return b.select(F.concat_ws("/", "ticker", F.col("date").cast("string")).alias("case_id"), "ticker", F.date_add("date", F.when(k % 6 == 5, 40).otherwise(0)).alias("trade_date"), query.alias("query"))


REQUESTS = BARS + """, tb AS (SELECT *, upper(symbol) AS ticker FROM bars), rq AS (SELECT ticker || '/' || date AS case_id, ticker, CAST(date + CASE WHEN (day(date) + length(symbol)) % 6 = 5 THEN 40 ELSE 0 END AS DATE) AS trade_date,
    CASE (day(date) + length(symbol)) % 6 WHEN 1 THEN '' WHEN 2 THEN 'Why did ' || ticker || ' move ' || CAST(round((close - open) / open * 100) AS BIGINT) || '% today?' WHEN 3 THEN 'Why did APPLE jump 250%?'
        WHEN 4 THEN 'did View fall -3.5 % or so' WHEN 5 THEN 'what happened there' END AS query,
    CASE (day(date) + length(symbol)) % 6 WHEN 2 THEN ticker WHEN 3 THEN 'CLICK' WHEN 4 THEN 'VIEW' END AS named,
    CASE (day(date) + length(symbol)) % 6 WHEN 2 THEN round((close - open) / open * 100) WHEN 3 THEN 250 WHEN 4 THEN -3.5 END AS claimed FROM tb),
    gd AS (SELECT r.*, b.close IS NOT NULL AS session_valid, (b.close - b.open) / b.open * 100 AS move FROM rq r LEFT JOIN tb b ON r.ticker = b.ticker AND r.trade_date = b.date)"""


def _live(s, d):
    """Live requests with each kind of fault."""
    k = F.col("event_id")
    e = t.table(s, d, "events")
    day = F.date_format(F.to_date("ts"), "yyyy-MM-dd")
    query = F.when(k % 11 == 0, "  ").when(k % 13 == 0, F.repeat(F.lit("long "), 200)).when(k % 2 == 0, F.lit("why?"))
    return e.select(k.alias("request_id"), F.when(k % 17 == 0, "nowhere").otherwise(F.concat(F.lit(" "), F.col("event_type"))).alias("ticker"),
                    F.when(k % 7 == 0, "2024-13-01").when(k % 5 == 0, "2031-01-01").when(k % 9 == 0, "2024-01-06").otherwise(day).alias("day"), query.alias("query"))


def _bars_without_weekends(s, d):
    return _tickered(s, d).filter(F.weekday("date") < 5).select("ticker", "date")


def _retrieval_cases(s, d):
    """A case for each source: a day in January, and a question or none."""
    n = F.regexp_extract("ticker", r"(\d+)", 1).cast("int")
    rows = t.assets(s, d).select("ticker").distinct()
    day = F.date_add(F.lit("2024-01-08").cast("date"), n % 10)
    return rows.select(F.col("ticker").alias("case_id"), "ticker", day.alias("trade_date"), answers.question(F.when(n % 3 != 0, F.lit("the of and de la et der und")), F.col("ticker"), day).alias("query"))


def _hits(s, d, layer, mode="rag_rerank"):
    vectors = t.table(s, d, "embeddings").select(F.col("vec_id").alias("asset_id"), "embedding")
    return retrieval.hybrid(_retrieval_cases(s, d), t.assets(s, d), vectors, layer, 64, mode=mode)


def _layered(s, d):
    c = _retrieval_cases(s, d)
    return retrieval.bookkeeping(_hits(s, d, "direct"), c, "direct").unionByName(retrieval.bookkeeping(_hits(s, d, "macro"), c, "macro"))


def hits_sql(layer: str) -> str:
    """The common table expressions of a layer's hits."""
    kinds, same = (DIRECT, "AND a.ticker = c.ticker") if layer == "direct" else (MACRO, "")
    terms = lambda x: f"list_distinct(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]+'))"
    return ASSETS + f""", nums AS (SELECT DISTINCT ticker, CAST(regexp_extract(ticker, '[0-9]+') AS INT) AS n FROM assets),
        cs AS (SELECT ticker AS case_id, ticker, DATE '2024-01-08' + n % 10 AS trade_date, CASE WHEN n % 3 <> 0 THEN 'the of and de la et der und' ELSE 'Why did ' || ticker || ' move on ' || CAST(DATE '2024-01-08' + n % 10 AS DATE) || '?' END AS query FROM nums),
        qv AS (SELECT case_id, list_transform(range(0, 64), lambda i: ((instr('0123456789abcdef', substr(sha256(query), CAST(2 * (i % 32) + 1 AS INT), 1)) - 1) * 16 + instr('0123456789abcdef', substr(sha256(query), CAST(2 * (i % 32) + 2 AS INT), 1)) - 1) / 255.0::DOUBLE - 0.5) AS v FROM cs),
        pool AS (SELECT c.case_id, c.query, a.asset_id, a.reference_date, a.body, round(list_dot_product(CAST(e.embedding AS DOUBLE[]), q.v), 6) AS vec,
            round(len(list_intersect({terms('c.query')}, {terms('a.body')})) / greatest(1, len({terms('c.query')})), 6) AS f FROM cs c JOIN qv q USING (case_id)
            JOIN assets a ON a.reference_date BETWEEN c.trade_date - 3 AND c.trade_date + 3 {same} LEFT JOIN embeddings e ON e.vec_id = a.asset_id WHERE a.source_type IN {kinds} AND NOT a.is_duplicate),
        rk AS (SELECT *, CASE WHEN f > 0 THEN row_number() OVER (PARTITION BY case_id ORDER BY nullif(f, 0) DESC NULLS LAST, asset_id) END AS fr,
            CASE WHEN vec IS NOT NULL THEN row_number() OVER (PARTITION BY case_id ORDER BY vec DESC NULLS LAST, asset_id) END AS vr FROM pool),
        fu AS (SELECT *, round(coalesce(1 / (60 + vr), 0) + coalesce(1 / (60 + fr), 0), 9) AS rrf FROM rk WHERE fr IS NOT NULL OR vr IS NOT NULL),
        hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY rrf DESC, vr NULLS LAST, fr NULLS LAST, asset_id) AS rank FROM fu) WHERE rank <= 12)"""


def book_sql(layer: str) -> str:
    return f"""SELECT c.case_id, '{layer}' AS layer, coalesce(h.n, 0) AS n, coalesce(h.n, 0) < 12 AS shortfall, coalesce(h.mean, 0) AS mean, CASE WHEN h.n >= 5 AND h.mean >= 0.02 THEN 'sufficiency_reached' END AS stop_reason
        FROM cs c LEFT JOIN (SELECT case_id, count(*) AS n, round(avg(rrf), 6) AS mean FROM hits GROUP BY 1) h USING (case_id)"""


def _labelled(s, d):
    """Causes: a labelled document is one, of the case of its source."""
    return t.table(s, d, "labels").join(t.table(s, d, "documents").select("doc_id", "source"), "doc_id").select(F.col("source").alias("case_id"), F.col("doc_id").alias("cause_id"), F.col("doc_id").alias("nth"), "quality", "toxic")


LABELLED = "lab AS (SELECT d.source AS case_id, d.doc_id AS cause_id, l.quality, l.toxic FROM labels l JOIN documents d USING (doc_id))"


def _chunks(s, d):
    """Chunks of a case: a source's labelled documents in order."""


    w = Window.partitionBy("case_id").orderBy("cause_id")
    return _labelled(s, d).withColumns({"nth": F.row_number().over(w) - 1, "expected_status": _pick(("SUFFICIENT", "PARTIAL", "INSUFFICIENT"), F.length("case_id") + F.regexp_extract("case_id", r"(\d+)", 1).cast("int"))})


CHUNKS = LABELLED + """, ch AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY cause_id) - 1 AS nth,
    ['SUFFICIENT', 'PARTIAL', 'INSUFFICIENT'][(length(case_id) + CAST(regexp_extract(case_id, '[0-9]+') AS INT)) % 3 + 1] AS expected_status FROM lab)"""


def _corrections(s, d):
    k = F.col("doc_id")
    fault = lambda n, m: F.when(k % n == 0, _pick(("evidence_id_missing", "schema_invalid", "time_window_violation"), F.floor(k / m)))
    return t.table(s, d, "documents").select(k.alias("case_id"), _pick(("sufficient", "partial", "insufficient", None), k).alias("decision"), (k % 3).alias("n_causes"), fault(2, 2).alias("first_failure"),
                                             fault(3, 3).alias("second_failure"), (k % 5 != 0).alias("has_correction"), (k % 7 == 0).alias("timed_out"))


def _commands(s, d):
    """A log of commands for each conversation's run, by turn."""
    k = F.col("conv_id") + F.col("turn")
    command = F.when(F.col("turn") == 0, "queue").when(k % 3 == 0, "start").when(k % 5 == 0, "end").when(k % 7 == 0, "cancel").when(k % 2 == 0, "retry").otherwise("start")
    result = F.when(command == "end", _pick(("SUFFICIENT", "PARTIAL", "SYSTEM_ERROR"), F.col("conv_id"))).when(command == "retry", F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")))
    return t.table(s, d, "conversations").select(F.col("conv_id").cast("string").alias("run_id"), F.col("turn").alias("seq"), command.alias("command"), result.alias("result"))


COMMANDS = """cm AS (SELECT CAST(conv_id AS VARCHAR) AS run_id, conv_id, turn AS seq, CASE WHEN turn = 0 THEN 'queue' WHEN (conv_id + turn) % 3 = 0 THEN 'start' WHEN (conv_id + turn) % 5 = 0 THEN 'end' WHEN (conv_id + turn) % 7 = 0 THEN 'cancel'
    WHEN (conv_id + turn) % 2 = 0 THEN 'retry' ELSE 'start' END AS command FROM conversations),
    fi AS (SELECT run_id, min(seq) FILTER (command IN ('end', 'cancel')) AS fin, bool_or(command = 'start') AS started, any_value(conv_id) AS c FROM cm GROUP BY 1),
    st AS (SELECT f.run_id, f.fin, CASE WHEN f.fin IS NULL THEN CASE WHEN started THEN 'RUNNING' ELSE 'QUEUED' END WHEN k.command = 'cancel' THEN 'CANCELLED' ELSE ['SUCCEEDED', 'PARTIAL', 'FAILED_SYSTEM'][c % 3 + 1] END AS status,
        CASE WHEN k.command = 'cancel' THEN 'user_cancelled' END AS error_type FROM fi f LEFT JOIN cm k ON k.run_id = f.run_id AND k.seq = f.fin)"""


def _payloads(s, d):
    """Payloads for a contract: whole, lacking a key, or of another type."""
    k = F.col("o_orderkey")
    cost = F.when(k % 4 == 0, F.lit('"12"')).when(k % 4 == 1, F.lit("true")).when(k % 4 == 2, F.lit("3")).otherwise("1.5")
    node = F.when(k % 3 == 0, F.lit("{}")).when(k % 3 == 1, F.lit('{"miner": 7}')).otherwise(F.lit('{"miner": 7.25}'))
    return t.table(s, d, "orders").select(k.alias("payload_id"), F.concat(F.lit('{"run_cost_usd": {"api_total": '), cost, F.lit('}, "node_latency_ms": '), node, F.lit(', "tags": ["a"], "name": '), F.when(k % 5 == 0, F.lit("null")).otherwise(F.lit('"x"')), F.lit("}")).alias("payload"))


_CONTRACT = [("run_cost_usd.api_total", "float"), ("node_latency_ms.miner", "int"), ("tags", "list"), ("name", "str"), ("meta", "dict")]


def _lint_cases(s, d):
    k = F.col("doc_id")
    return t.table(s, d, "documents").select(
        k.alias("case_id"), _pick(("CLICK", "VIEW", "APPL", ""), k).alias("ticker"), _pick(("2024-01-05", "2024-01-06", "2024-01-15", "5.1.2024", ""), k).alias("day"),
        _pick(("Why did CLICK fall", "why did view fall", "VIEW or CLICK?", None), F.floor(k / 2)).alias("query"), _pick(("INSUFFICIENT", "SUFFICIENT", None), k).alias("expected_status"), F.when(k % 4 != 3, k % 4 != 1).alias("should_refuse"))


LINT = """lc AS (SELECT doc_id AS case_id, ['CLICK', 'VIEW', 'APPL', ''][doc_id % 4 + 1] AS ticker, ['2024-01-05', '2024-01-06', '2024-01-15', '5.1.2024', ''][doc_id % 5 + 1] AS day,
    ['Why did CLICK fall', 'why did view fall', 'VIEW or CLICK?', NULL][doc_id // 2 % 4 + 1] AS query, ['INSUFFICIENT', 'SUFFICIENT', NULL][doc_id % 3 + 1] AS expected_status, CASE WHEN doc_id % 4 <> 3 THEN doc_id % 4 <> 1 END AS should_refuse,
    ['CLICK', NULL, 'VIEW', NULL][doc_id // 2 % 4 + 1] AS named FROM documents)"""

QUERIES = {
    "guards": lambda s, d: ops.guards(_requests(s, d), _tickered(s, d), _ALIASES).select("case_id", "query_ticker", F.round("claimed_pct", 4).alias("claimed_pct"), "ticker_consistent", "session_valid", "magnitude_plausible"),
    "live_request_faults": lambda s, d: ops.validated(_live(s, d), _bars_without_weekends(s, d)).select("request_id", "fault"),
    "question_built": lambda s, d: _requests(s, d).select("case_id", answers.question(F.col("query"), F.col("ticker"), F.col("trade_date"), F.when(F.dayofmonth("trade_date") % 10 == 0, "given")).alias("question")),
    "hybrid_direct": lambda s, d: _hits(s, d, "direct").select("case_id", "asset_id", "rank", "rrf"),
    "hybrid_reranked": lambda s, d: retrieval.reranked(_hits(s, d, "direct"), text.overlap).select("case_id", "asset_id", "place", "rerank"),
    "retrieval_layers": _layered,
    "retrieval_sql_only": lambda s, d: _hits(s, d, "direct", "sql_only").select("case_id", "asset_id", "rank"),
    "retrieval_modes": lambda s, d: t.table(s, d, "events").groupBy(retrieval.resolved_mode(_pick(("sql_only", "rag_only", "rag_rerank"), F.col("event_id")), F.col("event_id") % 4 != 0).alias("mode")).agg(F.count(F.lit(1)).alias("n")),
    "evidence_lookup": lambda s, d: retrieval.looked_up(_labelled(s, d).select(F.col("cause_id").alias("chunk_id"), "case_id"), t.assets(s, d).filter("not is_duplicate").select(F.col("asset_id").alias("chunk_id"), F.col("body").alias("content"))).select("chunk_id", "case_id", F.sha2("content", 256).alias("sha256")),
    "unique_evidence": lambda s, d: _hits(s, d, "direct").select("case_id", "asset_id").unionByName(_hits(s, d, "macro").select("case_id", "asset_id")).groupBy("case_id").agg(F.countDistinct("asset_id").alias("n_unique")),
    "hashed_embedding": lambda s, d: retrieval.encode(t.table(s, d, "benchmark"), lambda c: retrieval.hashed_embedding(c, 64)).select("item_id", F.round(F.col("embedding")[0], 6).alias("x0"), F.round(F.col("embedding")[33], 6).alias("x33"), F.size("embedding").alias("dim")),
    "search_mock": lambda s, d: _labelled(s, d).withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy("nth"))).select("case_id", "cause_id", F.round(1 / (60 + F.col("rank")), 9).alias("score")),
    "macro_expansion": lambda s, d: decision.route(decision.expand(decision.route(_guards(s, d).withColumns({"layer": F.lit("direct"), "expansion_reasons": F.lit(None).cast("array<string>")})))).select("case_id", "layer", "expansions", F.size("expansion_reasons").alias("n_reasons"), "edge", "edge_reason"),
    "baseline_relevance": lambda s, d: _labelled(s, d).select("cause_id", ops.forwarded(F.when(F.col("quality") == 1, 0.9), F.when(F.col("toxic") == 1, 0.4)).alias("relevance")),
    "first_causes": lambda s, d: ops.first_causes(_labelled(s, d)).select("case_id", "cause_id"),
    "correction_pass": lambda s, d: ops.corrected(_corrections(s, d)),
    "refusal_outputs": lambda s, d: decision.route(_guards(s, d)).select("case_id", ops.refusal(F.lit("T"), F.lit("2024-01-05"), F.col("edge"), F.col("edge_reason"), F.lit(None).cast("string")).alias("o")).select("case_id", "o.status", "o.n_causes", "o.summary"),
    "fixture_grades": lambda s, d: ops.graded_by_status(_chunks(s, d)).select("case_id", "cause_id", "relevance"),
    "drill_grades": lambda s, d: t.assets(s, d).select("asset_id", ops.graded_by_source(F.col("source_type"), F.col("asset_id")).alias("g")).select("asset_id", "g.relevance", "g.category"),
    "fixture_causes": lambda s, d: _fixture_causes(s, d),
    "move_direction": lambda s, d: t.bars(s, d).groupBy(ops.direction(F.when(F.col("volume") > 3, F.round(F.col("close") - F.col("open"), 0))).alias("direction")).agg(F.count(F.lit(1)).alias("n")),
    "run_lifecycle": lambda s, d: ops.run_states(_commands(s, d)),
    "run_links": lambda s, d: ops.retried(_commands(s, d), ops.run_states(_commands(s, d))),
    "next_node": lambda s, d: t.table(s, d, "events").select("event_id", ops.next_node(_pick((*ops.NEXT_NODE, "unknown"), F.col("event_id")), _pick(("RUNNING", "QUEUED", "SUCCEEDED"), F.floor(F.col("event_id") / 8))).alias("node")),
    "run_failure": lambda s, d: t.table(s, d, "events").select("event_id", ops.failure_of(_pick(("SUCCEEDED", "FAILED_REQUEST", "SYSTEM_ERROR"), F.col("event_id")), _pick((None, "empty_query", "boom"), F.floor(F.col("event_id") / 3)),
                                                                                        _pick((None, "timeout", ""), F.floor(F.col("event_id") / 9)), F.lit("critic")).alias("f")).select("event_id", "f.status", "f.reason", "f.source", "f.node", "f.retryable"),
    "node_artifacts": lambda s, d: ops.artifacts(t.table(s, d, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("event_seq"), _pick(tuple(ops.ARTIFACTS), F.col("turn")).alias("node"))),
    "artifact_filter": lambda s, d: ops.artifacts(t.table(s, d, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("event_seq"), _pick(tuple(ops.ARTIFACTS), F.col("turn")).alias("node"))).filter("event_seq = 1 and artifact_type = 'state_snapshot'"),
    "projected_chunks": lambda s, d: ops.projected_chunks(_hits(s, d, "direct").withColumns({"score": F.col("rrf"), "headline": F.col("ticker"), "snippet": F.col("source_type")}), 8).select("case_id", "n", F.length("json").alias("json_chars")),
    "reliability_verdict": lambda s, d: t.table(s, d, "events").select("event_id", ops.more_reliable(_pick(("SUFFICIENT", "INSUFFICIENT", None), F.col("event_id")), F.col("event_id") % 4 == 0, _pick(("INSUFFICIENT", "SUFFICIENT", "PARTIAL"), F.floor(F.col("event_id") / 3)),
                                                                                                     _pick((0.7, 0.5, None), F.floor(F.col("event_id") / 9)), F.lit(0.6)).alias("better")),
    "sanitised_causes": lambda s, d: ops.sanitised(_labelled(s, d).withColumn("asset_id", F.explode(F.array(F.col("cause_id"), F.col("cause_id") + 1_000_003 * F.col("toxic")))), t.assets(s, d)),
    "golden_backfill": lambda s, d: ops.backfilled(_lint_cases(s, d).select("case_id", "expected_status", "should_refuse")),
    "dependency_health": lambda s, d: ops.health(t.table(s, d, "nation").select(F.col("n_regionkey").alias("group"), F.when(F.col("n_nationkey") == 7, "failed").when(F.col("n_nationkey") % 5 == 1, "degraded").otherwise("ready").alias("status"), F.when(F.col("n_regionkey") == 3, F.col("n_nationkey") % 2).alias("vector_dim"))),
    "pricing_ids": lambda s, d: t.table(s, d, "events").groupBy(ops.pricing_id(_pick(("small-2", "small-2-preview", "other-1"), F.col("event_id")), ["small-2-preview-exact", "other-1"], ["small-2"]).alias("model")).agg(F.count(F.lit(1)).alias("n")),
    "evidence_resolution": lambda s, d: ops.resolved(_cited_ids(s, d), _chunks(s, d).select("case_id", (F.col("nth") + 1).alias("nth"), F.concat(F.lit("doc-"), F.col("cause_id").cast("string")).alias("chunk_id"))),
    "contract_errors": lambda s, d: ops.contract_errors(_payloads(s, d), _CONTRACT),
    "case_lint": lambda s, d: ops.lint(_lint_cases(s, d), _tickered(s, d).select("ticker").distinct(), _HOLIDAYS),
    "market_closed_days": lambda s, d: _lint_cases(s, d).select("case_id", F.when(F.col("day").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("day").try_cast("date")).alias("d")).select("case_id", F.coalesce((F.weekday("d") >= 5) | F.col("d").cast("string").isin(_HOLIDAYS), F.lit(False)).alias("closed")),
    "prompt_chunks": lambda s, d: _prompts(s, d),
    "answer_classes": lambda s, d: t.table(s, d, "events").select("event_id", _pick(_ANSWERS, F.col("event_id")).alias("a")).select("event_id", answers.answer_status(F.col("a")).alias("status"), answers.hallucinates(F.lit("fell 45% and 3%"), F.col("a")).alias("hallucinates")),
    "response_grades": lambda s, d: t.table(s, d, "events").select("event_id", answers.parsed_grades(_pick(_RESPONSES, F.col("event_id"))).alias("p")).select("event_id", "p.mode", F.size("p.chunks").alias("n"), F.array_join(F.transform("p.chunks", lambda c: c["category"]), ",").alias("categories")),
    "response_relevance": lambda s, d: t.table(s, d, "events").select("event_id", answers.relevance(_pick(_SCORES, F.col("event_id"))).alias("relevance")),
    "categories": lambda s, d: t.table(s, d, "events").groupBy(answers.category(_pick((" Macro ", "EARNINGS", "gossip", None, ""), F.col("event_id"))).alias("category")).agg(F.count(F.lit(1)).alias("n")),
    "news_sentiment": lambda s, d: t.table(s, d, "events").select("event_id", answers.sentiment(_pick(_HEADLINES, F.col("event_id"))).alias("mood"), _pick(_HEADLINES, F.col("event_id")).rlike(answers.GEO).alias("geo")),
    "shown_amounts": lambda s, d: t.table(s, d, "orders").select("o_orderkey", answers.usd(_pick(("0", "-12.3", "4567", "7800000", "416161000000", "2500000000000", "n/a"), F.col("o_orderkey"))).alias("usd"), answers.percent_of(F.col("o_orderkey").cast("string"), _pick(("8", "0", "x"), F.col("o_orderkey"))).alias("share"),
                                                               answers.duration(F.col("o_orderkey") % 5 * 700).alias("took")),
    "text_previews": lambda s, d: t.table(s, d, "documents").select("doc_id", F.sha2(answers.preview(F.col("text")), 256).alias("preview"), F.length(answers.truncated(F.col("text"))).alias("cut_chars")),
    "key_marks": lambda s, d: t.table(s, d, "nation").select("n_nationkey", answers.key_mark(F.col("n_name")).alias("mark")),
}


def _cited_ids(s, d):
    c = _chunks(s, d).filter("nth < 6")
    said = F.when(F.col("nth") == 0, F.concat(F.lit("doc-"), F.col("cause_id").cast("string"))).when(F.col("nth") == 1, F.lit("chunk_2")).when(F.col("nth") == 2, F.lit("Evidence 1")).when(F.col("nth") == 3, F.lit("see no. 3")).when(F.col("nth") == 4, F.lit("oc-")).otherwise(F.lit("nothing"))
    return c.select("case_id", said.alias("cited")).distinct()


def _fixture_causes(s, d):
    rows = _labelled(s, d).groupBy("case_id").agg(F.slice(F.sort_array(F.collect_list("cause_id")), 1, 3).alias("ids"), F.max("toxic").alias("toxic"))
    n = F.size("ids")
    golden = F.transform("ids", lambda i: F.concat(F.lit("cause "), i.cast("string")))
    causes = ops.judged_by_golden(golden, F.when(n > 1, F.slice("ids", 1, n - 1)).otherwise(F.col("ids")), F.col("case_id").endswith("7"), F.when(n != 2, n - 2).cast("double"))
    return rows.select("case_id", F.posexplode_outer(causes).alias("i", "c")).select("case_id", "i", "c.text", F.round("c.confidence", 4).alias("confidence"), F.get("c.evidence_ids", F.lit(0)).alias("evidence"), "c.direction")


def _prompts(s, d):
    c = _chunks(s, d).join(t.assets(s, d).select(F.col("asset_id").alias("cause_id"), "source_type", "reference_date", F.col("body").alias("content")), "cause_id").filter("nth < 6")
    entry = F.struct("nth", F.col("cause_id").cast("string").alias("asset_id"), "source_type", "reference_date", "content")
    p = c.groupBy("case_id").agg(answers.prompt_chunks(F.sort_array(F.collect_list(entry))).alias("p"), F.count(F.lit(1)).alias("n"))
    return p.select("case_id", F.sha2("p", 256).alias("prompt"), F.size(F.split(answers.fewer_chunks(F.col("p"), F.lit(1)), "### Chunk ")).alias("n_first"), F.size(F.split(answers.fewer_chunks(F.col("p"), F.lit(2)), "### Chunk ")).alias("n_second"))


_ANSWERS = ("It fell on earnings.", "I cannot verify that.", "There is not enough evidence.", "Up 45% as asked", "Up 77% overnight", "See 0001234-24-000123 now: 0001234567-24-000123", "The acquisition of OpenAI did it", "Filing 1234567-24-000123")
_ONE = '{"chunk_id": "c1", "relevance": 0.7, "category": "Macro", "temporal_match": true, "reasoning": "r"}'
_TWO = '{"chunk_id": "c2", "relevance": 0.2, "category": "gossip", "temporal_match": false, "reasoning": "r"}'
_RESPONSES = ('{"graded_chunks": [' + _ONE + ", " + _TWO + '], "reasoning": "x"}', "```json\n{\"graded_chunks\": [" + _ONE + '], "reasoning": "x"}\n```', "[" + _ONE + ", " + _TWO + "]", '{"graded_chunks": [' + _ONE + ", " + _TWO + ", {\"chunk_id\": ",
              "no grades at all", '{"graded_chunks": [' + _ONE + ', {"chunk_id": "c3", "relevance": 7}], "reasoning": "x"}')
_SCORES = ('{"relevance": 0.73}', '```json\n{"relevance": 0.61}\n```', 'Here: {"relevance": 0.44} thanks.', "about 0.27 given this", "not-json", "0.5", "7 of 10")
_HEADLINES = ("Record profit", "Shares fall after warning", "A quiet day", "War and strong growth", "gain and loss", "Surge, then crash and slump")

ORACLE_SQL = {
    "guards": f"WITH {REQUESTS} SELECT case_id, named AS query_ticker, round(claimed, 4) AS claimed_pct, named = ticker AS ticker_consistent, session_valid, abs(claimed - move) <= 10 AS magnitude_plausible FROM gd",
    "live_request_faults": f"""WITH {BARS}, tb AS (SELECT upper(symbol) AS ticker, date FROM bars WHERE isodow(date) < 6), bo AS (SELECT ticker, min(date) AS lo, max(date) AS hi FROM tb GROUP BY 1),
        r AS (SELECT event_id AS k, upper(CASE WHEN event_id % 17 = 0 THEN 'nowhere' ELSE event_type END) AS ticker, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 5 = 0 THEN DATE '2031-01-01' WHEN event_id % 9 = 0 THEN DATE '2024-01-06' ELSE CAST(ts AS DATE) END AS day FROM events)
        SELECT k AS request_id, CASE WHEN lo IS NULL THEN 'unsupported_ticker' WHEN day IS NULL THEN 'invalid_trade_date' WHEN day NOT BETWEEN lo AND hi THEN 'date_out_of_range' WHEN tb.date IS NULL THEN 'missing_trading_day_context'
            WHEN k % 11 = 0 THEN 'empty_query' WHEN k % 13 = 0 THEN 'query_too_long' END AS fault FROM r LEFT JOIN bo USING (ticker) LEFT JOIN tb ON tb.ticker = r.ticker AND tb.date = r.day""",
    "question_built": f"WITH {REQUESTS} SELECT case_id, CASE WHEN day(trade_date) % 10 = 0 THEN 'given' WHEN coalesce(query, '') <> '' THEN query ELSE 'Why did ' || ticker || ' move on ' || trade_date || '?' END AS question FROM rq",
    "hybrid_direct": f"WITH {hits_sql('direct')} SELECT case_id, asset_id, rank, rrf FROM hits",
    "hybrid_reranked": f"WITH {hits_sql('direct')} SELECT case_id, asset_id, place, f AS rerank FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY f DESC, rank) AS place FROM hits) WHERE place <= 5",
    "retrieval_layers": f"SELECT * FROM (WITH {hits_sql('direct')} {book_sql('direct')}) UNION ALL SELECT * FROM (WITH {hits_sql('macro')} {book_sql('macro')})",
    "retrieval_sql_only": f"WITH {hits_sql('direct')} SELECT case_id, asset_id, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY reference_date DESC, asset_id) AS k FROM pool) WHERE k <= 12",
    "unique_evidence": f"SELECT case_id, count(DISTINCT asset_id) AS n_unique FROM (SELECT * FROM (WITH {hits_sql('direct')} SELECT case_id, asset_id FROM hits) UNION ALL SELECT * FROM (WITH {hits_sql('macro')} SELECT case_id, asset_id FROM hits)) GROUP BY 1",
    "hashed_embedding": """WITH h AS (SELECT item_id, sha256(text) AS x FROM benchmark), b AS (SELECT item_id, list_transform([0, 1], lambda i: (instr('0123456789abcdef', substr(x, CAST(2 * i + 1 AS INT), 1)) - 1) * 16 + instr('0123456789abcdef', substr(x, CAST(2 * i + 2 AS INT), 1)) - 1) AS v FROM h)
        SELECT item_id, round(v[1] / 255.0::DOUBLE - 0.5, 6) AS x0, round(v[2] / 255.0::DOUBLE - 0.5, 6) AS x33, 64 AS dim FROM b""",
    "retrieval_modes": "SELECT CASE WHEN event_id % 3 = 0 OR event_id % 4 = 0 THEN 'sql_only' WHEN event_id % 3 = 2 THEN 'rag_rerank' ELSE 'rag_only' END AS mode, count(*) AS n FROM events GROUP BY 1",
    "evidence_lookup": f"WITH {LABELLED}, {ASSETS} SELECT cause_id AS chunk_id, case_id, sha256(coalesce(body, '[content not found]')) AS sha256 FROM lab LEFT JOIN assets ON asset_id = cause_id AND NOT is_duplicate",
    "search_mock": f"WITH {LABELLED} SELECT case_id, cause_id, round(1 / (60 + row_number() OVER (PARTITION BY case_id ORDER BY cause_id)), 9) AS score FROM lab",
    "macro_expansion": f"""WITH {STATE}, ex AS (SELECT *, edge_reason = 'critic_expand_macro' AS again FROM routed)
        SELECT case_id, CASE WHEN again THEN 'macro' ELSE 'direct' END AS layer, expansions + again::INT AS expansions, again::INT AS n_reasons,
            CASE WHEN again THEN CASE WHEN expansions + 1 < 2 THEN 'critic_expand_macro' ELSE 'expansions_exhausted' END ELSE edge_reason END AS edge_reason,
            CASE WHEN again THEN CASE WHEN expansions + 1 < 2 THEN 'expand_macro' ELSE 'insufficient' END WHEN edge_reason = 'upstream_system_error' THEN 'system_error' WHEN edge_reason = 'critic_proceed' THEN 'judge' ELSE 'insufficient' END AS edge FROM ex""",
    "baseline_relevance": f"WITH {LABELLED} SELECT cause_id, CASE WHEN quality = 1 THEN 0.9 WHEN toxic = 1 THEN 0.4 ELSE 1.0 END AS relevance FROM lab",
    "first_causes": f"WITH {CHUNKS} SELECT case_id, cause_id FROM ch WHERE nth < 5",
    "correction_pass": """WITH k AS (SELECT doc_id AS case_id, ['sufficient', 'partial', 'insufficient', NULL][doc_id % 4 + 1] AS dec, doc_id % 3 AS n, CASE WHEN doc_id % 2 = 0 THEN ['evidence_id_missing', 'schema_invalid', 'time_window_violation'][doc_id // 2 % 3 + 1] END AS f1,
            CASE WHEN doc_id % 3 = 0 THEN ['evidence_id_missing', 'schema_invalid', 'time_window_violation'][doc_id // 3 % 3 + 1] END AS f2, doc_id % 5 <> 0 AS has, doc_id % 7 = 0 AS late FROM documents),
        e AS (SELECT *, CASE WHEN f1 IS NULL THEN NULL WHEN NOT has THEN f1 WHEN late THEN 'model_timeout' ELSE f2 END AS err FROM k)
        SELECT case_id, CASE WHEN err = 'model_timeout' THEN 'SYSTEM_ERROR' WHEN err IS NOT NULL THEN 'PARTIAL' WHEN dec IS NULL THEN CASE WHEN n > 0 THEN 'SUFFICIENT' ELSE 'INSUFFICIENT' END ELSE upper(dec) END AS status, err AS validation_error,
            CASE WHEN f1 IS NULL OR NOT has THEN 0 ELSE 1 END AS attempts FROM e""",
    "refusal_outputs": f"""WITH {STATE} SELECT case_id, CASE WHEN edge_reason = 'upstream_system_error' THEN 'SYSTEM_ERROR' WHEN edge_reason IN ('critic_proceed', 'critic_expand_macro') THEN NULL ELSE 'INSUFFICIENT' END AS status,
        CASE WHEN edge_reason = 'upstream_system_error' THEN 0 WHEN edge_reason IN ('critic_proceed', 'critic_expand_macro') THEN NULL ELSE 1 END AS n_causes,
        CASE WHEN edge_reason = 'upstream_system_error' THEN '**System error** during attribution for T on 2024-01-05. The Critic node failed to produce a valid response: Unknown error. This is an infrastructure issue, not an evidence gap.'
            WHEN edge_reason IN ('critic_proceed', 'critic_expand_macro') THEN NULL ELSE CASE edge_reason WHEN 'ticker_mismatch_guard' THEN 'Query ticker does not match resolved ticker. ' WHEN 'market_session_guard' THEN 'No trading session on requested date for this ticker. '
                WHEN 'magnitude_guard' THEN 'Claimed price move is inconsistent with OHLCV data. ' ELSE '' END || 'No evidence meeting the relevance threshold (>0.25) was found for T on 2024-01-05. This may indicate the price move was driven by factors outside our data coverage (private information, market microstructure, or sources we do not ingest).' END AS summary FROM routed""",
    "fixture_grades": f"WITH {CHUNKS} SELECT case_id, cause_id, CASE WHEN expected_status = 'SUFFICIENT' AND nth < 4 THEN 0.72 WHEN expected_status = 'PARTIAL' AND nth < 2 THEN 0.55 ELSE 0.24 END AS relevance FROM ch",
    "drill_grades": f"WITH {ASSETS} SELECT asset_id, CASE WHEN source_type LIKE '%news%' THEN 0.8 WHEN source_type LIKE '%fundamentals%' THEN 0.7 ELSE 0.3 END AS relevance, ['sector', 'earnings', 'macro'][asset_id % 3 + 1] AS category FROM assets",
    "fixture_causes": f"""WITH {CHUNKS}, g AS (SELECT case_id, least(3, count(*)) AS n FROM ch GROUP BY 1), c AS (SELECT ch.*, g.n FROM ch JOIN g USING (case_id) WHERE nth < 2 AND nth < n AND case_id NOT LIKE '%7')
        SELECT g.case_id, c.nth AS i, 'cause ' || c.cause_id AS text, round(0.79::DOUBLE - c.nth * 0.05::DOUBLE, 4) AS confidence, (SELECT e.cause_id FROM ch e WHERE e.case_id = c.case_id AND e.nth = least(c.nth, greatest(g.n - 1, 1) - 1)) AS evidence,
            CASE WHEN c.nth IS NULL THEN NULL WHEN g.n = 2 THEN 'unknown' WHEN g.n > 2 THEN 'positive' ELSE 'negative' END AS direction FROM g LEFT JOIN c USING (case_id)""",
    "move_direction": f"WITH {BARS} SELECT CASE WHEN volume <= 3 THEN 'unknown' WHEN round(close - open, 0) > 0 THEN 'positive' WHEN round(close - open, 0) < 0 THEN 'negative' ELSE 'neutral' END AS direction, count(*) AS n FROM bars GROUP BY 1",
    "run_lifecycle": f"WITH {COMMANDS} SELECT run_id, status, error_type, fin AS ended_seq FROM st",
    "run_links": f"WITH {COMMANDS} SELECT cm.run_id || '-' || cm.seq AS run_id, cm.run_id AS parent_run_id, 'retry' AS link_type FROM cm JOIN st USING (run_id) WHERE command = 'retry' AND cm.seq > st.fin",
    "next_node": """SELECT event_id, CASE WHEN event_id // 8 % 3 < 2 THEN ['critic', 'decision_router', 'judge', 'validator', 'finalizer', 'judge', 'miner', 'miner'][event_id % 8 + 1] END AS node FROM events""",
    "run_failure": """WITH r AS (SELECT event_id, ['SUCCEEDED', 'FAILED_REQUEST', 'SYSTEM_ERROR'][event_id % 3 + 1] AS s, [NULL, 'empty_query', 'boom'][event_id // 3 % 3 + 1] AS e, [NULL, 'timeout', ''][event_id // 9 % 3 + 1] AS v FROM events),
        k AS (SELECT *, CASE WHEN v = 'timeout' THEN 1 WHEN e = 'empty_query' OR s = 'FAILED_REQUEST' THEN 2 WHEN e IS NOT NULL OR s = 'SYSTEM_ERROR' THEN 3 END AS w FROM r)
        SELECT event_id, CASE w WHEN 1 THEN 'FAILED_SYSTEM' WHEN 2 THEN 'FAILED_REQUEST' WHEN 3 THEN 'FAILED_SYSTEM' END AS status, CASE w WHEN 1 THEN v WHEN 2 THEN e WHEN 3 THEN coalesce(e, 'system_error') END AS reason,
            CASE w WHEN 1 THEN 'trace_events' WHEN 2 THEN 'agent_runs' WHEN 3 THEN 'agent_runs' END AS source, CASE w WHEN 1 THEN 'critic' END AS node, CASE w WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN true END AS retryable FROM k""",
    "reliability_verdict": """WITH r AS (SELECT event_id, ['SUFFICIENT', 'INSUFFICIENT', NULL][event_id % 3 + 1] AS d, event_id % 4 = 0 AS h, ['INSUFFICIENT', 'SUFFICIENT', 'PARTIAL'][event_id // 3 % 3 + 1] AS s, [0.7, 0.5, NULL][event_id // 9 % 3 + 1] AS g FROM events)
        SELECT event_id, CASE WHEN d IS NULL THEN false ELSE (s = 'INSUFFICIENT' OR coalesce(g >= 0.6, false)) AND NOT (d = 'SUFFICIENT' AND NOT h) END AS better FROM r""",
    "sanitised_causes": f"""WITH {LABELLED}, c AS (SELECT case_id, cause_id, unnest([cause_id, cause_id + 1000003 * toxic]) AS a FROM lab)
        SELECT case_id, count(DISTINCT cause_id) AS n_causes, count(d.doc_id) AS n_valid, count(a) AS n_cited, CASE WHEN count(d.doc_id) < count(a) THEN 'PARTIAL' ELSE 'SUFFICIENT' END AS status FROM c LEFT JOIN documents d ON d.doc_id = c.a GROUP BY 1""",
    "golden_backfill": f"WITH {LINT} SELECT case_id, coalesce(expected_status, CASE WHEN coalesce(should_refuse, false) THEN 'INSUFFICIENT' ELSE 'SUFFICIENT' END) AS expected_status, coalesce(should_refuse, false) AS should_refuse FROM lc",
    "dependency_health": """SELECT n_regionkey AS "group", CASE WHEN bool_or(n_nationkey = 7) OR (n_regionkey = 3 AND count(DISTINCT n_nationkey % 2) > 1) THEN 'failed' WHEN bool_or(n_nationkey % 5 = 1) THEN 'degraded' ELSE 'ready' END AS status,
        n_regionkey = 3 AND count(DISTINCT n_nationkey % 2) > 1 AS dim_mismatch FROM nation GROUP BY 1""",
    "pricing_ids": "SELECT ['small-2', 'small-2', 'other-1'][event_id % 3 + 1] AS model, count(*) AS n FROM events GROUP BY 1",
    "evidence_resolution": f"""WITH {CHUNKS}, k AS (SELECT case_id, max(nth) + 1 AS n, arg_min(cause_id, nth) AS first FROM ch GROUP BY 1), c AS (SELECT case_id, nth, cause_id, n, first FROM ch JOIN k USING (case_id) WHERE nth < 6)
        SELECT case_id, CASE nth WHEN 0 THEN 'doc-' || cause_id WHEN 1 THEN 'chunk_2' WHEN 2 THEN 'Evidence 1' WHEN 3 THEN 'see no. 3' WHEN 4 THEN 'oc-' ELSE 'nothing' END AS cited,
            CASE nth WHEN 0 THEN 'doc-' || cause_id WHEN 1 THEN 'doc-' || cause_id WHEN 2 THEN 'doc-' || first WHEN 3 THEN 'doc-' || (SELECT x.cause_id FROM ch x WHERE x.case_id = c.case_id AND x.nth = 2) WHEN 4 THEN 'doc-' || first END AS chunk_id,
            CASE nth WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 3 WHEN 4 THEN 4 END AS step FROM c""",
    "contract_errors": """SELECT o_orderkey AS payload_id, 'run_cost_usd.api_total' AS key_path, 'type_mismatch' AS error_kind, 'float' AS expected, CASE o_orderkey % 4 WHEN 0 THEN 'str' ELSE 'bool' END AS actual FROM orders WHERE o_orderkey % 4 < 2
        UNION ALL SELECT o_orderkey, 'node_latency_ms.miner', CASE o_orderkey % 3 WHEN 0 THEN 'missing_key' ELSE 'type_mismatch' END, 'int', CASE o_orderkey % 3 WHEN 2 THEN 'float' END FROM orders WHERE o_orderkey % 3 <> 1
        UNION ALL SELECT o_orderkey, 'name', 'type_mismatch', 'str', 'null' FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT o_orderkey, 'meta', 'missing_key', 'dict', NULL FROM orders""",
    "case_lint": f"""WITH {LINT} SELECT case_id, 'error' AS level, 'missing_' || c AS code FROM lc, (SELECT unnest(['ticker', 'day', 'query', 'expected_status', 'should_refuse']) AS c)
            WHERE coalesce(CASE c WHEN 'ticker' THEN ticker WHEN 'day' THEN day WHEN 'query' THEN query WHEN 'expected_status' THEN expected_status ELSE should_refuse::VARCHAR END, '') = ''
        UNION ALL SELECT case_id, 'error', 'trade_date_format_invalid' FROM lc WHERE day IN ('5.1.2024', '') UNION ALL SELECT case_id, 'warning', 'market_closed_date' FROM lc WHERE day IN ('2024-01-06', '2024-01-15')
        UNION ALL SELECT case_id, 'error', 'ticker_not_in_db' FROM lc WHERE ticker NOT IN ('CLICK', 'VIEW') UNION ALL SELECT case_id, 'error', 'expected_status_not_insufficient' FROM lc WHERE coalesce(expected_status, '') <> 'INSUFFICIENT'
        UNION ALL SELECT case_id, 'error', 'should_refuse_not_true' FROM lc WHERE NOT coalesce(should_refuse, false) UNION ALL SELECT case_id, 'error', 'query_ticker_mismatch' FROM lc WHERE named <> ticker""",
    "market_closed_days": f"WITH {LINT} SELECT case_id, day IN ('2024-01-06', '2024-01-15') AS closed FROM lc",
    "prompt_chunks": f"""WITH {CHUNKS}, {ASSETS}, p AS (SELECT case_id, nth, '### Chunk ' || (nth + 1) || ' (ID: ' || cause_id || ')' || chr(10) || 'Source: ' || source_type || ' | Date: ' || reference_date || chr(10) || chr(10) || substr(coalesce(body, ''), 1, 600) AS x FROM ch JOIN assets ON asset_id = cause_id WHERE nth < 6)
        SELECT case_id, sha256(string_agg(x, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY nth)) AS prompt, least(4, count(*)) + 1 AS n_first, least(2, count(*)) + 1 AS n_second FROM p GROUP BY 1""",
    "answer_classes": "SELECT event_id, ['SUFFICIENT', 'INSUFFICIENT', 'INSUFFICIENT', 'SUFFICIENT', 'SUFFICIENT', 'SUFFICIENT', 'SUFFICIENT', 'SUFFICIENT'][event_id % 8 + 1] AS status, [false, false, false, false, true, true, true, true][event_id % 8 + 1] AS hallucinates FROM events",
    "response_grades": "SELECT event_id, ['strict', 'strict', 'strict', 'chunk_salvage', NULL, 'chunk_salvage'][event_id % 6 + 1] AS mode, [2, 1, 2, 2, 0, 1][event_id % 6 + 1] AS n, ['macro,other', 'macro', 'macro,other', 'macro,other', '', 'macro'][event_id % 6 + 1] AS categories FROM events",
    "response_relevance": "SELECT event_id, CAST([0.73, 0.61, 0.44, 0.27, NULL, 0.5, NULL][event_id % 7 + 1] AS DOUBLE) AS relevance FROM events",
    "categories": "SELECT ['macro', 'earnings', 'other', 'other', 'other'][event_id % 5 + 1] AS category, count(*) AS n FROM events GROUP BY 1",
    "news_sentiment": "SELECT event_id, ['positive', 'negative', 'neutral', 'positive', 'neutral', 'negative'][event_id % 6 + 1] AS mood, [false, true, false, true, false, false][event_id % 6 + 1] AS geo FROM events",
    "shown_amounts": """SELECT o_orderkey, ['$0', '-$12.30', '$4.6K', '$7.8M', '$416.2B', '$2.5T', 'n/a'][o_orderkey % 7 + 1] AS usd, CASE WHEN o_orderkey % 3 = 0 THEN printf('%.1f%%', o_orderkey / 8 * 100) ELSE '--' END AS share,
        ['0ms', '700ms', '1.4s', '2.1s', '2.8s'][o_orderkey % 5 + 1] AS took FROM orders""",
    "text_previews": """WITH f AS (SELECT doc_id, text, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS x FROM documents)
        SELECT doc_id, sha256(CASE WHEN length(x) <= 250 THEN x ELSE regexp_replace(substr(x, 1, 250), ' [^ ]*$', '') || ' ...' END) AS preview, CASE WHEN length(text) > 400 THEN 400 + length(chr(10) || '... [' || (length(text) - 400) || ' more chars truncated]') ELSE length(text) END AS cut_chars FROM f""",
    "key_marks": "SELECT n_nationkey, substr(sha256(n_name), 1, 12) AS mark FROM nation",
}
_ARTIFACT_ROWS = ", ".join(f"({i}, '{k}', '{a}')" for i, (k, v) in enumerate(ops.ARTIFACTS.items()) for a in v)
ORACLE_SQL["node_artifacts"] = f"SELECT conv_id AS run_id, turn AS event_seq, node, artifact_type FROM conversations JOIN (VALUES {_ARTIFACT_ROWS}) a(i, node, artifact_type) ON i = turn % {len(ops.ARTIFACTS)}"
ORACLE_SQL["artifact_filter"] = f"SELECT * FROM ({ORACLE_SQL['node_artifacts']}) WHERE event_seq = 1 AND artifact_type = 'state_snapshot'"
ORACLE_SQL["projected_chunks"] = f"""WITH {hits_sql('direct')}, e AS (SELECT h.case_id, h.rank, '{{"rank":' || h.rank || ',"asset_id":' || h.asset_id || ',"source_type":"' || a.source_type || '","score":' || round(h.rrf, 6) || ',"headline":"' || a.ticker || '","snippet":"' || a.source_type || '"}}' AS j
    FROM hits h JOIN assets a USING (asset_id) WHERE h.rank <= 8) SELECT case_id, count(*) AS n, length('{{"chunks":[' || string_agg(j, ',' ORDER BY rank) || ']}}') AS json_chars FROM e GROUP BY 1"""
