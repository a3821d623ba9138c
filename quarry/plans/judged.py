"""Queries over judged causes and their citations, with their SQL. A labelled document is a cause of the case its
source and day make up, and cites itself and another document; documents are the evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import evaluation, grounding
from quarry.plans.market import ASSETS
from quarry.sources import tables as t

CITED = ASSETS + """, ev AS (SELECT asset_id % 97 AS case_id, asset_id, reference_date FROM assets),
    ci AS (SELECT doc_id % 97 AS case_id, doc_id AS cause_id, unnest([doc_id, doc_id + 97 * toxic * quality, doc_id * (1 + 999983 * toxic)]) AS asset_id FROM labels),
    cited AS (SELECT ci.*, ev.asset_id IS NOT NULL AS found, reference_date FROM ci LEFT JOIN ev USING (case_id, asset_id))"""
WORDS = "list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> ''))"
PAIRS = f"""c AS (SELECT conv_id, turn, {WORDS} AS w FROM conversations),
    pairs AS (SELECT a.conv_id AS event_id, a.turn AS i, b.turn AS j, round(CASE WHEN len(a.w) + len(b.w) = 0 THEN 1.0::DOUBLE
        ELSE len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))) END, 6) AS jaccard FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.turn < b.turn)"""
_STATUS, _REASON = ("SUFFICIENT", "PARTIAL", "INSUFFICIENT", "SYSTEM_ERROR", "FAILED_REQUEST"), ("INCONCLUSIVE", "NON_MATERIAL_MOVE", "thin_evidence")
GATES = [("grounded", 0.85), ("accurate", 0.70), ("clean", 0.95)]


def _cited(s, d):
    ids = F.array(F.col("doc_id"), F.col("doc_id") + 97 * F.col("toxic") * F.col("quality"), F.col("doc_id") * (1 + 999983 * F.col("toxic").cast("long")))
    citations = t.table(s, d, "labels").select((F.col("doc_id") % 97).alias("case_id"), F.col("doc_id").alias("cause_id"), F.explode(ids).alias("asset_id"))
    return grounding.cited(citations, t.assets(s, d).select((F.col("asset_id") % 97).alias("case_id"), "asset_id", "reference_date"))


def _cases(s, d):
    k = F.col("case_id")
    return t.table(s, d, "labels").select((F.col("doc_id") % 97).alias("case_id")).distinct().select(
        "case_id", F.date_add(F.lit("2024-01-16").cast("date"), (k % 3).cast("int")).alias("trade_date"), (k % 7 != 0).alias("schema_ok"), (k % 2 == 0).alias("sufficient"), (k % 10 / 10).alias("coverage"))


def _categories(s, d, column, labelled=False):
    docs = t.table(s, d, "documents")
    docs = docs.join(t.table(s, d, "labels"), "doc_id", "left_semi") if labelled else docs
    return docs.select((F.col("doc_id") % 97).alias("case_id"), column.alias("category"))


def _pairs(s, d):
    return grounding.cause_pairs(t.table(s, d, "conversations").select(F.col("conv_id").alias("event_id"), F.col("turn").alias("nth"), "text"))


def _picked(values, column):
    return F.element_at(F.array(*map(F.lit, values)), (column % len(values) + 1).cast("int"))


def _runs(s, d):
    key = F.col("o_orderkey")
    return t.table(s, d, "orders").select(_picked(_STATUS, key).alias("status"), _picked(_REASON, F.floor(key / 5)).alias("reason"))


def _quality(s, d):
    q, x = F.col("quality"), F.col("toxic")
    return t.table(s, d, "labels").agg(F.coalesce(F.avg(((q == 1) | (x == 0)).cast("double")), F.lit(1.0)).alias("grounded"),
                                       F.coalesce(F.avg((q == 1).cast("double")), F.lit(0.0)).alias("accurate"), F.coalesce(F.avg((x == 0).cast("double")), F.lit(1.0)).alias("clean"))


def _date_texts(s, d):
    day = F.date_format(F.to_date("ts"), "yyyy-MM-dd")
    k = F.col("event_id") % 4
    return t.table(s, d, "events").select("event_id", day.alias("a"), F.when(k == 0, F.concat(day, F.lit("T10:00:00"))).when(k == 1, F.translate(day, "-", "/")).when(k == 2, F.concat(F.lit("on "), day)).otherwise("2024-01-09").alias("b"))


def _p_values(s, d):
    """Tails of the paired statistics, from single rows of counts."""
    n = evaluation.discordance(t.table(s, d, "labels").select(F.col("quality").alias("a"), F.col("toxic").alias("b"))).first()
    return s.createDataFrame([("mcnemar", float(evaluation.mcnemar_p(n.n01, n.n10)))], "test string, p double")


QUERIES = {
    "grounding_rate": lambda s, d: grounding.grounding_rate(_cited(s, d)),
    "citation_precision": lambda s, d: grounding.citation_precision(_cited(s, d)),
    "validator_failures": lambda s, d: grounding.validation_failure(_cases(s, d), _cited(s, d)),
    "category_accuracy": lambda s, d: grounding.category_accuracy(_categories(s, d, F.upper("source")), _categories(s, d, F.col("source"), labelled=True)),
    "temporal_precision": lambda s, d: _date_texts(s, d).select("event_id", grounding.same_date(F.col("a"), F.col("b")).alias("score")),
    "jaccard_pairs": lambda s, d: _pairs(s, d),
    "threshold_sweep": lambda s, d: grounding.sweep(_pairs(s, d)),
    "retryable": lambda s, d: _runs(s, d).groupBy("status", "reason", grounding.run_state(F.col("status")).alias("run_status"), grounding.retryable(F.col("status"), F.col("reason")).alias("retryable")).agg(F.count(F.lit(1)).alias("n")),
    "refuse_hit_rate": lambda s, d: t.table(s, d, "labels").agg(F.round(F.coalesce(F.avg(F.when(F.col("toxic") == 1, (F.col("quality") == 0).cast("double"))), F.lit(0.0)), 6).alias("refuse_hit_rate"), F.count_if(F.col("toxic") == 1).alias("n_should_refuse")),
    "gates": lambda s, d: grounding.gates(_quality(s, d), GATES),
    "html_links": lambda s, d: t.table(s, d, "pages").select("page_id", F.size(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit("<a\\s+[^>]*href="), F.lit(0))).cast("long").alias("n_links")),
    "mcnemar_p": _p_values,
}

ORACLE_SQL = {
    "grounding_rate": f"WITH {CITED}, g AS (SELECT case_id, cause_id, bool_or(found) AS ok FROM cited GROUP BY 1, 2) SELECT case_id, round(avg(ok::INT), 6) AS grounding_rate FROM g GROUP BY 1",
    "citation_precision": f"""WITH {CITED}, g AS (SELECT case_id, asset_id, bool_or(found) AS ok FROM cited GROUP BY 1, 2)
        SELECT case_id, count(*) AS n_cited, round(avg(ok::INT), 6) AS citation_precision FROM g GROUP BY 1""",
    "validator_failures": f"""WITH {CITED}, k AS (SELECT DISTINCT doc_id % 97 AS case_id FROM labels)
        SELECT k.case_id, CASE WHEN bool_or(NOT found) THEN 'evidence_id_missing'
            WHEN bool_or(coalesce(abs(date_diff('day', DATE '2024-01-16' + CAST(k.case_id % 3 AS INT), reference_date)) > 3, true)) THEN 'time_window_violation'
            WHEN k.case_id % 7 = 0 THEN 'schema_invalid' WHEN k.case_id % 2 = 0 AND (k.case_id % 10) / 10 < 0.3 THEN 'magnitude_sanity_failed' END AS failure
        FROM k JOIN cited USING (case_id) GROUP BY 1""",
    "category_accuracy": """WITH g AS (SELECT DISTINCT doc_id % 97 AS case_id, lower(source) AS c FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))
        SELECT doc_id % 97 AS case_id, round(avg((g.c IS NOT NULL)::INT), 6) AS category_accuracy FROM documents LEFT JOIN g ON g.case_id = doc_id % 97 AND g.c = lower(source) GROUP BY 1""",
    "temporal_precision": "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.0 ELSE (CAST(ts AS DATE) = DATE '2024-01-09')::INT END::DOUBLE AS score FROM events",
    "jaccard_pairs": f"WITH {PAIRS} SELECT * FROM pairs",
    "threshold_sweep": f"""WITH {PAIRS}, v AS (SELECT unnest([0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50]::DOUBLE[]) AS threshold)
        SELECT threshold, count(*) FILTER (jaccard > threshold) AS above, round(100.0 * count(*) FILTER (jaccard > threshold) / count(*), 4) AS percent, round(max(jaccard) + 0.01, 2) AS safe FROM pairs, v GROUP BY 1""",
    "retryable": """WITH r AS (SELECT ['SUFFICIENT', 'PARTIAL', 'INSUFFICIENT', 'SYSTEM_ERROR', 'FAILED_REQUEST'][o_orderkey % 5 + 1] AS status, ['INCONCLUSIVE', 'NON_MATERIAL_MOVE', 'thin_evidence'][o_orderkey // 5 % 3 + 1] AS reason FROM orders)
        SELECT status, reason, CASE status WHEN 'SUFFICIENT' THEN 'SUCCEEDED' WHEN 'SYSTEM_ERROR' THEN 'FAILED_SYSTEM' ELSE status END AS run_status,
            CASE status WHEN 'SYSTEM_ERROR' THEN true WHEN 'PARTIAL' THEN reason = 'INCONCLUSIVE' WHEN 'INSUFFICIENT' THEN reason <> 'NON_MATERIAL_MOVE' ELSE false END AS retryable, count(*) AS n FROM r GROUP BY 1, 2, 3, 4""",
    "refuse_hit_rate": "SELECT round(coalesce(avg((quality = 0)::INT) FILTER (toxic = 1), 0), 6) AS refuse_hit_rate, count(*) FILTER (toxic = 1) AS n_should_refuse FROM labels",
    "gates": """WITH m AS (SELECT coalesce(avg((quality = 1 OR toxic = 0)::INT), 1) AS grounded, coalesce(avg((quality = 1)::INT), 0) AS accurate, coalesce(avg((toxic = 0)::INT), 1) AS clean FROM labels),
        g AS (SELECT 'grounded' AS gate, grounded AS value, 0.85 AS least FROM m UNION ALL SELECT 'accurate', accurate, 0.70 FROM m UNION ALL SELECT 'clean', clean, 0.95 FROM m)
        SELECT gate, round(value, 6) AS value, CASE WHEN value >= least THEN 'PASS' ELSE 'FAIL' END AS verdict FROM g""",
    "html_links": "SELECT page_id, CAST(len(regexp_extract_all(coalesce(html, ''), '<a\\s+[^>]*href=')) AS BIGINT) AS n_links FROM pages",
}
