"""The registered queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, divergence, exact_dedup, id_coder, jaccard_join, kn_lm, langid, license_scan, line_dedup, mixing, packing, quality, whitening
from .common import BREAK, crc_bucket, lean, text_bytes

def vocabulary(name: str) -> str:
    """Where a vocabulary file of the public tokenizers is."""
    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", (crc_bucket(F.col("doc_id"), 5) == 1).alias("held_out"))
    scored = kn_lm.train_and_score(docs, F.col("held_out"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "source", "text")
    mixture, key = mixing.Mixture(docs), mixing.KEY

    def counted(tables):
        for t in tables:
            buf, edges = text_bytes(t.column("text"))
            gap = np.concatenate(([True], BREAK[buf]))
            starts = gap[:-1] & ~gap[1:]
            starts[edges[:-1][np.diff(edges) > 0]] = ~BREAK[buf[edges[:-1][np.diff(edges) > 0]]]
            words = np.diff(np.concatenate(([0], np.cumsum(starts)))[edges])
            yield pa.record_batch([*(t.column(c) for c in key), pa.array(words.astype(np.int64))], [*key, "words"])

    # What was taken is counted in the mix itself: the words of each piece, by the row it came from. Counted in Python, in
    # the mix's order: under an aggregate alone Spark would leave out the local shuffle.
    words = mixing.mix(docs, mixture, keyed=True).mapInArrow(lean(counted), "__k int, __cell long, __nth int, words long")
    taken = words.groupBy(*key).agg(F.sum("words").alias("taken"))
    rows = mixture.pieces().drop("pieces").join(taken, key, "left")
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "text", "n_lines", "n_removed")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), vocabulary("byte_bpe_50k.json")).drop("ids")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held_out = crc_bucket(F.col("doc_id"), 5) == 0
    prototypes = langid.train(docs.filter(~held_out))
    found = langid.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), prototypes)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(_documents(spark, sf_dir))
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    chats = chat.format_chats(turns.unionByName(extra))
    read = chats.select("conv_id", "formatted", chat.parse_chats(F.col("formatted")).alias("turns"),
                        chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("masked"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.length("masked").cast("long").alias("loss_chars"), F.sha2("masked", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"), vocabulary("byte_bpe_50k.json"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar(_documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, files = id_coder.write_ids(_documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))
    return id_coder.read_ids(spark, files).drop("ids")


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_documents(spark, sf_dir)).drop("findings")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return white.withColumn("deviation", F.col("deviation").cast("long"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    op1_lm_scoring, op2_mixing, op3_line_dedup, op4_packing, op5_language_id, op6_exact_dedup, op7_chat_formatting,
    op8_quality_rules, op9_jaccard_join, op10_token_ids, op11_license_scan, op12_whitening, op13_source_divergence)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op3_line_dedup": r"""
        WITH cut AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
        windows AS (
            SELECT doc_id, pos, lines[pos + 1] || chr(10) || lines[pos + 2] || chr(10) || lines[pos + 3] AS w
            FROM (SELECT doc_id, lines, unnest(range(0, len(lines) - 2)) AS pos FROM cut WHERE len(lines) >= 3)),
        ranked AS (
            SELECT doc_id, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id NULLS LAST, pos) AS nth
            FROM windows WHERE regexp_matches(w, '[^ \t-\r]')),
        covered AS (SELECT DISTINCT doc_id, pos + unnest([0, 1, 2]) AS line FROM ranked WHERE nth > 1),
        marked AS (SELECT doc_id, list(line) AS gone FROM covered GROUP BY doc_id)
        SELECT c.doc_id,
               CASE WHEN m.gone IS NULL THEN c.text
                    ELSE coalesce(array_to_string([c.lines[i + 1] FOR i IN range(0, len(c.lines)) IF NOT list_contains(m.gone, i)], chr(10)), '') END AS text,
               CASE WHEN c.text IS NULL THEN 0 ELSE CAST(len(c.lines) AS BIGINT) END AS n_lines,
               CAST(coalesce(len(m.gone), 0) AS BIGINT) AS n_removed
        FROM cut c LEFT JOIN marked m ON c.doc_id = m.doc_id""",
    "op6_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {_LOWER} AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm)""",
    "op7_chat_formatting": """
        WITH all_turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        escaped AS (
            SELECT *, replace(replace(replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<|', '&#60;|'), '<s>', '&#60;s>'),
                '</s>', '&#60;/s>'), '<<SYS>>', '&#60;<SYS>>'), '<</SYS>>', '&#60;</SYS>>'), '[INST]', '&#91;INST]'), '[/INST]', '&#91;/INST]') AS safe
            FROM all_turns)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
               sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
               CAST(sum(length(safe) + length(role) + 23) AS BIGINT) AS formatted_chars
        FROM escaped GROUP BY conv_id""",
    "op13_source_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
            FROM documents),
        t AS (SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT doc) AS docs FROM t GROUP BY ALL),
        k AS (SELECT lang, term, sum(n) AS lang_n FROM c GROUP BY ALL HAVING sum(docs) >= 30),
        v AS (SELECT lang, count(*) AS terms, sum(lang_n) AS lang_total FROM k GROUP BY lang),
        g AS (SELECT DISTINCT lang, source FROM d),
        cells AS (
            SELECT g.lang, g.source, k.term, k.lang_n, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total
            FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        p AS (
            SELECT cells.*, 1 + CAST(1000000000 AS HUGEINT) * (n + 5) // (total + 5 * terms) AS p,
                   1 + CAST(1000000000 AS HUGEINT) * (lang_n + 5) // (lang_total + 5 * terms) AS q
            FROM cells JOIN v ON cells.lang = v.lang),
        sums AS (
            SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
            FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        parts AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
            UNION ALL
            SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS nth FROM parts)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(nth AS INTEGER) AS rank
        FROM ranked WHERE part = 'pair' OR nth <= 50""",
}
