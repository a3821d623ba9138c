"""Queries over documents and pages, search included, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import html, text
from quarry.operators import duplicates, evidence, ranked, retrieval, search, sentences, vector_pairs
from quarry.operators.vector_index import VectorIndex
from quarry.plans.market import ARTICLES, ASSETS, NEWS, r6
from quarry.sources import tables as t

NORM = "nullif(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), '')"
FP = """substr(sha256(regexp_replace(lower(regexp_replace(title, '[^\\p{L}\\p{N}_\\s]', '', 'g')), '^\\s+|\\s+$', '', 'g') || '|' ||
    strftime(date_trunc('hour', published) - to_hours(hour(published) % 2), '%Y-%m-%dT%H:%M:%S') || '+00:00'), 1, 16)"""
# Anything but white space.
INKED = r"[^\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
QUALITY = ARTICLES + f""", q AS (SELECT *, {NORM} AS t, coalesce(length(body), 0) AS size, CASE WHEN NOT coalesce(regexp_matches(body, '{INKED}'), false) THEN 'unknown' WHEN regexp_matches(body, '[㐀-鿿]') THEN 'other' ELSE 'en' END AS tongue FROM arts),
    c AS (SELECT t, count(*) AS same FROM q WHERE t IS NOT NULL GROUP BY 1),
    f AS (SELECT q.*, coalesce(c.same, 0) AS same FROM q LEFT JOIN c USING (t)),
    flags AS (SELECT asset_id, ticker, source_type, CASE WHEN size = 0 THEN 'short_text' WHEN coalesce(title, '') = '' OR published IS NULL OR coalesce(source, '') = '' THEN 'missing_fields'
        WHEN size < 200 THEN 'short_text' WHEN tongue <> 'en' THEN 'non_target_language' WHEN same >= 5 THEN 'template_spam' END AS reason,
    round(((size >= 200)::INT + (coalesce(title, '') <> '')::INT + (published IS NOT NULL)::INT + (coalesce(source, '') <> '')::INT + (tongue = 'en')::INT + (same < 5)::INT) / 6, 3) AS score FROM f)"""
_BARE, _PATH = "regexp_replace(url, '#.*$', '')", "regexp_extract(regexp_replace(url, '#.*$', ''), '^https?://[^/?]*([^?]*)', 1)"
_QUERY = f"""array_to_string(list_sort(list_transform(list_filter(string_split(regexp_extract({_BARE}, '[?](.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(split_part(x, '=', 1)), '^(utm_|ref_|mc_)')),
    lambda x: url_encode(url_decode(split_part(x, '=', 1))) || '=' || url_encode(url_decode(CASE WHEN contains(x, '=') THEN substr(x, instr(x, '=') + 1) ELSE '' END)))), '&')"""
PAGE_URL = f"""(lower(regexp_extract({_BARE}, '^https?://[^/?]*')) || CASE WHEN {_PATH} = '/' THEN '' WHEN length({_PATH}) - length(replace({_PATH}, '/', '')) = 2 AND {_PATH} LIKE '%/' THEN rtrim({_PATH}, '/') ELSE {_PATH} END
    || CASE WHEN {_QUERY} = '' THEN '' ELSE '?' || {_QUERY} END)"""
TOKS = "regexp_extract_all(lower(text), '[a-z0-9]+')"


def _queries(s, d):
    return t.table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _vector_queries(s, d):
    e = t.table(s, d, "embeddings").filter("vec_id % 20 = 0")
    return e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def _vectors(s, d):
    return t.table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def _hybrid(s, d):
    return search.fuse([VectorIndex(_vectors(s, d)).search(_vector_queries(s, d), 20, exact=True), ranked.bm25(t.table(s, d, "documents").select("doc_id", "text"), _queries(s, d))])


def _prefiltered(s, d):
    """The nearest vectors of the query's label, of the days around its own; every third query asks for any day."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("vec_id") % 30).cast("int"))
    e = t.table(s, d, "embeddings").select("vec_id", "embedding", "label", day.alias("day"))
    asked = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), "label",
                                              F.when(F.col("vec_id") % 60 != 0, F.date_sub("day", 3)).alias("since"), F.when(F.col("vec_id") % 60 != 0, F.date_add("day", 3)).alias("till"))
    return VectorIndex(e, "vec_id", keep=("label", "day")).search(asked, 5, exact=True, match=("label",), within=("day", "since", "till"))


def _recall(s, d):
    """How many of each query's true neighbours the probed cells hold."""
    index, asked = VectorIndex(_vectors(s, d)), _vector_queries(s, d)
    true, found = index.search(asked, 10, exact=True), index.search(asked, 10)
    both = true.select("query_id", "doc_id").join(found.select("query_id", "doc_id", F.lit(1).alias("hit")), ["query_id", "doc_id"], "left")
    return both.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("n_found"))


def _search_cases(s, d):
    """Benchmark items as cases: a ticker (not for each fourth), two weeks around a day, and the vector of their number."""
    k = F.col("item_id")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (k % 30).cast("int"))
    rows = t.table(s, d, "benchmark").select(k.alias("query_id"), "text", F.when(k % 4 != 0, F.concat(F.lit("src"), k % 20)).alias("ticker"), F.date_sub(day, 7).alias("since"), F.date_add(day, 7).alias("till"))
    return rows.join(t.table(s, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), "query_id")


def _prefiltered_hybrid(s, d):
    a = t.assets(s, d).select(F.col("asset_id").alias("doc_id"), "ticker", "reference_date", F.col("body").alias("text"))
    cases, keep = _search_cases(s, d), ("ticker", "reference_date")
    vectors = VectorIndex(_vectors(s, d).join(a.drop("text"), "doc_id"), keep=keep)
    hits = retrieval.prefiltered(cases, ranked.TextIndex(a, keep=keep), vectors, ("ticker",), ("reference_date", "since", "till"))
    return retrieval.kept_places(hits, cases, a.select("doc_id", F.col("text").alias("body")), text.overlap)


def _abbreviated(s, d):
    """Documents in which a word that is always shortened stands before common words."""
    return t.table(s, d, "documents").select("doc_id", F.regexp_replace("text", " (the|der|la|le) ", " apr. $1 ").alias("text"))


def _split(s, d):
    """How many sentences a text has with what was learned from all of them, and a digest of them."""
    rows = _abbreviated(s, d)
    said = sentences.split(rows, sentences.abbreviations(sentences.word_counts(rows)))
    line = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "sentence"))), lambda x: x["sentence"]), "|")
    return said.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sha2(line, 256).alias("sha256"))


def _articles(s, d):
    pages = t.table(s, d, "pages").select("page_id", text.canonical_url(F.col("url")).alias("url"))
    n = pages.agg(F.count(F.lit(1)).alias("n"))
    a = t.news(s, d).crossJoin(F.broadcast(n))  # one row
    return a.withColumn("page_id", F.col("asset_id") % F.col("n")).join(pages, "page_id", "left").drop("n", "page_id")


def _tracked(s, d):
    """Page addresses with tracking parameters, a user, capitals and codes in them."""
    url = F.regexp_replace("url", "#.*$", "")
    more = F.lit("utm_source=x&b=2&A=%7e+z&a=1&UTM_x=1&ref_src=y&c&mc_cid=9#frag")
    url = F.concat(F.regexp_replace(url, "^https?://", "HTTPS://me@WWW."), F.when(F.contains(url, F.lit("?")), "&").otherwise("?"), more)
    return t.table(s, d, "pages").select("page_id", url.alias("url"))


_MESSAGES = ("HTTP 429", "Rate limit hit", "Read timeout", "HTTP 503", "502 bad gateway", "ingest: no rows", "clean: bad JSON", "transform: no text", "storage: disk full", "no route to host", "")

QUERIES = {
    "dedup_hard_fingerprint": lambda s, d: t.news(s, d).select("asset_id", text.fingerprint(F.col("title"), F.col("published")).alias("fp")),
    "dedup_first_fingerprint": lambda s, d: evidence.first_seen(t.news(s, d).select("asset_id", F.when(F.col("asset_id") % 37 != 0, text.fingerprint(F.col("title"), F.col("published"))).alias("fp")), "fp", ["asset_id"]),
    "dedup_first_seen": lambda s, d: evidence.first_seen(t.news(s, d).select("asset_id", text.normalized_title(F.col("title")).alias("t")), "t", ["asset_id"]),
    "dedup_stats": lambda s, d: evidence.hard_duplicates(t.news(s, d)).agg(F.sum("n").alias("articles"), F.count(F.lit(1)).alias("distinct_articles")),
    "canonical_url": lambda s, d: _tracked(s, d).select("page_id", text.canonical_url(F.col("url")).alias("url")),
    "cross_source_pairs": lambda s, d: evidence.cross_source_pairs(_articles(s, d)),
    "duplicate_groups": lambda s, d: duplicates.duplicate_groups(_articles(s, d)),
    "select_canonical": lambda s, d: evidence.canonical(t.news(s, d).withColumn("g", text.normalized_title(F.col("title"))).filter("g is not null"), "g").select("asset_id", "source_type"),
    "title_counts": lambda s, d: t.assets(s, d).select(text.normalized_title(F.col("title")).alias("t")).filter("t is not null").groupBy("t").agg(F.count(F.lit(1)).alias("n")),
    "quality_flags": lambda s, d: evidence.quality_flags(t.articles(s, d)),
    "eligibility_rate": lambda s, d: evidence.quality_flags(t.articles(s, d)).groupBy("source_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("reason").isNull().cast("double")), 6).alias("rate")),
    "fallback_trigger": lambda s, d: evidence.quality_flags(t.articles(s, d)).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("reason").isNull()).alias("good"), F.count_if(F.col("reason") == "short_text").alias("bad")).select(
        "ticker", evidence.fallback_reason(F.col("n"), F.col("bad"), F.lit(0.05), F.col("good")).alias("reason")),
    "language_profile": lambda s, d: t.table(s, d, "documents").groupBy(text.language(F.col("text")).alias("detected"), "lang").agg(F.count(F.lit(1)).alias("n")),
    "provider_audit": lambda s, d: t.table(s, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.median("n_chars").alias("median_chars"), F.round(F.avg("n_chars"), 6).alias("mean_chars"), F.count_if(F.col("n_chars") < 200).alias("n_short")),
    "chunks_l1_l2": lambda s, d: evidence.chunks(t.assets(s, d)).select("chunk_id", "level", "nth", F.sha2("content", 256).alias("sha256")),
    "chunk_layer_counts": lambda s, d: evidence.chunks(t.assets(s, d)).groupBy("level").agg(F.count(F.lit(1)).alias("n")),
    "chunk_source_counts": lambda s, d: evidence.chunks(t.assets(s, d)).join(t.assets(s, d).select("asset_id", "source_type"), "asset_id").groupBy("source_type").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("level") == "l1").alias("l1"), F.count_if(F.col("level") == "l2").alias("l2")).orderBy(F.desc("total"), "source_type"),
    "abbreviations": lambda s, d: sentences.abbreviations(sentences.word_counts(_abbreviated(s, d))).select("word", F.round("score", 6).alias("score")),
    "learned_sentences": _split,
    "html_clean": lambda s, d: html.clean_pages(t.table(s, d, "pages")),
    "md_table_render": lambda s, d: t.table(s, d, "nation").select(text.markdown_row(F.col("n_name"), F.col("n_regionkey").cast("string")).alias("line")),
    "news_markdown": lambda s, d: t.news(s, d).filter("source_type = 'polygon_news'").select("asset_id", F.sha2(F.concat(F.lit("## "), F.col("ticker"), F.lit(": "), F.col("title"), F.lit("\n\n"), F.col("body")), 256).alias("sha256")),
    "error_classes": lambda s, d: t.table(s, d, "events").select("event_id", text.error_class(F.element_at(F.array(*map(F.lit, _MESSAGES)), (F.col("event_id") % len(_MESSAGES) + 1).cast("int"))).alias("kind")),
    "bm25_topk": lambda s, d: ranked.bm25(t.table(s, d, "documents").select("doc_id", "text"), _queries(s, d), 10).select("query_id", "doc_id", "rank", "score"),
    "vector_topk": lambda s, d: VectorIndex(_vectors(s, d)).search(_vector_queries(s, d), 10, exact=True),
    "vector_prefiltered": lambda s, d: _prefiltered(s, d),
    "vector_recall": lambda s, d: _recall(s, d),
    "rrf_hybrid": lambda s, d: _hybrid(s, d),
    "hybrid_prefiltered": _prefiltered_hybrid,
    "sufficiency": lambda s, d: search.sufficient(_hybrid(s, d)),
    "rerank_overlap": lambda s, d: ranked.bm25(t.table(s, d, "documents").select("doc_id", "text"), _queries(s, d), 10).join(t.table(s, d, "documents").select("doc_id", F.col("text").alias("body")), "doc_id").join(_queries(s, d), "query_id").select(
        "query_id", "doc_id", F.round(text.overlap(F.col("text"), F.col("body")), 6).alias("overlap")),
    "semantic_dedup_cosine": lambda s, d: _semantic(s, d),
    "semantic_dedup_day": lambda s, d: _semantic_day(s, d),
}


def _semantic_day(s, d):
    """Vectors of articles, and whether one of the same ticker and day with a smaller id is nearer than a cosine of 0.3. A
    ticker has few articles a day."""
    e = t.table(s, d, "embeddings").select((F.col("vec_id") % 40).alias("ticker"), (F.col("vec_id") % 30).alias("day"), F.col("vec_id").alias("asset_id"), "embedding")
    other = e.select("ticker", "day", F.col("asset_id").alias("b"), F.col("embedding").alias("y"))
    near = e.join(other, ["ticker", "day"]).filter("b < asset_id").filter(F.round(search.dot(F.col("embedding"), F.col("y")), 6) > 0.3).groupBy("asset_id").agg(F.count(F.lit(1)).alias("n_before"))
    return e.join(near, "asset_id", "left").select("asset_id", F.col("n_before").isNull().alias("kept"), F.coalesce("n_before", F.lit(0)).alias("n_before"))


def _semantic(s, d):
    """Pairs of one label with a cosine over 0.92: only vectors that share a label meet."""
    e = t.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v"))
    return vector_pairs.near_pairs(e, 0.92).select("a", "b", F.round("cosine", 4).alias("cosine"))


ORACLE_SQL = {
    "dedup_hard_fingerprint": f"WITH {NEWS} SELECT asset_id, {FP} AS fp FROM news",
    "dedup_first_fingerprint": f"WITH {NEWS}, n AS (SELECT asset_id, CASE WHEN asset_id % 37 <> 0 THEN {FP} END AS fp FROM news) SELECT asset_id, fp FROM (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY asset_id) AS k FROM n) WHERE k = 1 OR fp IS NULL",
    "dedup_first_seen": f"WITH {ASSETS}, n AS (SELECT asset_id, {NORM} AS t FROM assets) SELECT asset_id, t FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY asset_id) AS k FROM n) WHERE k = 1 OR t IS NULL",
    "dedup_stats": f"WITH {NEWS} SELECT count(*) AS articles, count(DISTINCT {FP}) AS distinct_articles FROM news",
    "canonical_url": r"""WITH u AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS url FROM pages), parts AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?]*)', 1)) AS host,
            regexp_extract(url, '^https?://[^/?]*([^?]*)', 1) AS path, regexp_extract(url, '[?](.*)$', 1) AS q FROM u),
        pairs AS (SELECT page_id, host, path, unnest(list_filter(string_split(q, '&'), lambda x: x <> '') || ['b=2', 'A=~ z', 'a=1', 'c=']) AS kv FROM parts),
        kept AS (SELECT page_id, host, path, url_decode(split_part(kv, '=', 1)) AS k, url_decode(substr(kv, instr(kv, '=') + 1)) AS v FROM pairs)
        SELECT page_id, 'https://www.' || host || CASE WHEN path = '/' THEN '' WHEN length(path) - length(replace(path, '/', '')) = 2 AND path LIKE '%/' THEN rtrim(path, '/') ELSE path END || '?' ||
            string_agg(replace(url_encode(k), '%20', '+') || '=' || replace(url_encode(v), '%20', '+'), '&' ORDER BY k, v) AS url
        FROM kept WHERE NOT regexp_matches(lower(k), '^(utm_|ref_|mc_)') GROUP BY page_id, host, path""",
    "cross_source_pairs": f"""WITH {NEWS}, p AS (SELECT page_id, {PAGE_URL} AS url FROM pages), a AS (SELECT n.asset_id, n.ticker, {NORM} AS t, n.published, p.url FROM news n LEFT JOIN p ON n.asset_id % (SELECT count(*) FROM pages) = p.page_id),
        f AS (SELECT min(asset_id) OVER (PARTITION BY url) AS asset_id, asset_id AS b_asset_id FROM a WHERE url IS NOT NULL),
        l AS (SELECT lag(asset_id) OVER w AS x, asset_id AS y, epoch(published) - lag(epoch(published)) OVER w AS gap FROM a WHERE t IS NOT NULL AND ticker IS NOT NULL WINDOW w AS (PARTITION BY t, ticker ORDER BY published, asset_id))
        SELECT asset_id, b_asset_id FROM f WHERE asset_id <> b_asset_id UNION SELECT least(x, y), greatest(x, y) FROM l WHERE gap < 14400""",
    "duplicate_groups": f"""WITH RECURSIVE {NEWS}, p AS (SELECT page_id, {PAGE_URL} AS url FROM pages),
        a AS (SELECT n.*, {NORM} AS t, p.url, coalesce(list_position(['polygon_news', 'fmp_news', 'finnhub_company_news', 'gdelt_news'], source_type), 5) AS prio FROM news n LEFT JOIN p ON n.asset_id % (SELECT count(*) FROM pages) = p.page_id),
        l AS (SELECT x.asset_id AS x, y.asset_id AS y FROM a x JOIN a y ON x.asset_id <> y.asset_id AND (x.url = y.url OR (x.t = y.t AND x.ticker = y.ticker AND abs(epoch(x.published) - epoch(y.published)) < 14400))),
        reach AS (SELECT asset_id AS x, asset_id AS y FROM a UNION SELECT r.x, l.y FROM reach r JOIN l ON l.x = r.y),
        g AS (SELECT x AS asset_id, min(y) AS group_id, count(*) AS size FROM reach GROUP BY 1), d AS (SELECT x AS asset_id, count(*) AS n FROM l GROUP BY 1)
        SELECT a.asset_id, g.group_id, g.size, coalesce(d.n, 0) AS n_links, row_number() OVER (PARTITION BY g.group_id ORDER BY prio, published, length(body) DESC, a.asset_id) = 1 AS kept
        FROM a JOIN g USING (asset_id) LEFT JOIN d USING (asset_id)""",
    "select_canonical": f"""WITH {NEWS}, n AS (SELECT *, {NORM} AS g, coalesce(list_position(['polygon_news', 'fmp_news', 'finnhub_company_news', 'gdelt_news'], source_type), 5) AS p FROM news)
        SELECT asset_id, source_type FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY p, published, length(body) DESC, asset_id) AS k FROM n WHERE g IS NOT NULL) WHERE k = 1""",
    "title_counts": f"WITH {ASSETS} SELECT {NORM} AS t, count(*) AS n FROM assets GROUP BY 1 HAVING t IS NOT NULL",
    "quality_flags": f"WITH {QUALITY} SELECT * FROM flags",
    "eligibility_rate": f"WITH {QUALITY} SELECT source_type, count(*) AS n, round(avg((reason IS NULL)::INT), 6) AS rate FROM flags GROUP BY 1",
    "fallback_trigger": f"WITH {QUALITY} SELECT ticker, CASE WHEN count(*) FILTER (reason = 'short_text') >= 3 THEN 'connectivity_failures' WHEN count(*) FILTER (reason IS NULL) = 0 THEN 'all_articles_fail_quality' END AS reason FROM flags GROUP BY 1",
    "language_profile": f"SELECT CASE WHEN NOT coalesce(regexp_matches(text, '{INKED}'), false) THEN 'unknown' WHEN regexp_matches(text, '[㐀-鿿]') THEN 'non_target_language' ELSE 'en' END AS detected, lang, count(*) AS n FROM documents GROUP BY 1, 2",
    "provider_audit": "SELECT source, count(*) AS n, median(n_chars) AS median_chars, round(avg(n_chars), 6) AS mean_chars, count(*) FILTER (n_chars < 200) AS n_short FROM documents GROUP BY 1",
    "chunks_l1_l2": f"""WITH {ASSETS}, l2 AS (SELECT asset_id, list_slice(list_filter(list_transform(regexp_extract_all(body, '[^.!?]+[.!?]*'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) >= 12), 1, 30) AS s FROM assets WHERE source_type = 'polygon_news'),
        l AS (SELECT asset_id, unnest(s) AS c, unnest(range(1, len(s) + 1)) AS n FROM l2)
        SELECT CAST(asset_id AS VARCHAR) AS chunk_id, 'l1' AS level, 0 AS nth, sha256(body) AS sha256 FROM assets UNION ALL SELECT asset_id || '::l2s' || lpad(CAST(n AS VARCHAR), 4, '0'), 'l2', n, sha256(c) FROM l""",
    "md_table_render": "SELECT '| ' || n_name || ' | ' || n_regionkey || ' |' AS line FROM nation",
    "news_markdown": f"WITH {ASSETS} SELECT asset_id, sha256('## ' || ticker || ': ' || title || chr(10) || chr(10) || body) AS sha256 FROM assets WHERE source_type = 'polygon_news'",
    "error_classes": f"""WITH m AS (SELECT event_id, lower({list(_MESSAGES)}[event_id % {len(_MESSAGES)} + 1]) AS m FROM events)
        SELECT event_id, CASE WHEN m = '' THEN NULL WHEN contains(m, '429') OR contains(m, 'rate') THEN 'rate_limit' WHEN contains(m, 'timeout') THEN 'timeout'
            WHEN contains(m, '500') OR contains(m, '502') OR contains(m, '503') OR contains(m, '504') THEN 'server_error' WHEN starts_with(m, 'ingest:') THEN 'ingest' WHEN starts_with(m, 'clean:') THEN 'clean'
            WHEN starts_with(m, 'transform:') THEN 'transform' WHEN starts_with(m, 'storage:') THEN 'storage' ELSE 'fetch' END AS kind FROM m""",
    "bm25_topk": f"""WITH d AS (SELECT doc_id, {TOKS} AS toks FROM documents), s AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM d),
        q AS (SELECT DISTINCT item_id AS query_id, unnest({TOKS}) AS term FROM benchmark),
        p AS (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM d), tf AS (SELECT term, doc_id, dl, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
        r AS (SELECT q.query_id, tf.doc_id, round(sum(ln(1 + (s.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN tf USING (term) JOIN df USING (term), s GROUP BY 1, 2)
        SELECT query_id, doc_id, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r) WHERE rank <= 10""",
    "vector_topk": """WITH r AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0)
        SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r) WHERE rank <= 10""",
    "vector_prefiltered": """WITH e AS (SELECT *, DATE '2024-01-01' + CAST(vec_id % 30 AS INTEGER) AS day, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
        r AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, round(list_dot_product(q.v, e.v), 6) AS score FROM e q JOIN e ON q.label = e.label AND (q.vec_id % 60 = 0 OR abs(e.day - q.day) <= 3) WHERE q.vec_id % 20 = 0)
        SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r) WHERE rank <= 5""",
    "hybrid_prefiltered": f"""WITH {ASSETS}, d AS (SELECT asset_id AS doc_id, ticker, reference_date, body, regexp_extract_all(lower(body), '[a-z0-9]+') AS toks FROM assets), s AS (SELECT count(*) AS n, avg(coalesce(len(toks), 0)) AS avgdl FROM d),
        c AS (SELECT item_id AS query_id, b.text, CASE WHEN item_id % 4 <> 0 THEN 'src' || item_id % 20 END AS tk, DATE '2024-01-01' + CAST(item_id % 30 AS INTEGER) AS day, CAST(embedding AS DOUBLE[]) AS v FROM benchmark b JOIN embeddings ON vec_id = item_id),
        q AS (SELECT DISTINCT query_id, unnest({TOKS}) AS term FROM c),
        p AS (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM d), tf AS (SELECT term, doc_id, dl, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
        ok AS (SELECT c.query_id, d.doc_id FROM c JOIN d ON (c.tk IS NULL OR c.tk = d.ticker) AND abs(d.reference_date - c.day) <= 7),
        r AS (SELECT q.query_id, tf.doc_id, round(sum(ln(1 + (s.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN tf USING (term) JOIN df USING (term) JOIN ok ON ok.query_id = q.query_id AND ok.doc_id = tf.doc_id, s GROUP BY 1, 2),
        f AS (SELECT query_id, doc_id, 1 AS list, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS k FROM r QUALIFY k <= 12
            UNION ALL SELECT ok.query_id, ok.doc_id, 0, row_number() OVER (PARTITION BY ok.query_id ORDER BY round(list_dot_product(c.v, CAST(e.embedding AS DOUBLE[])), 6) DESC, ok.doc_id) AS k FROM ok JOIN embeddings e ON e.vec_id = ok.doc_id JOIN c ON c.query_id = ok.query_id QUALIFY k <= 12),
        fu AS (SELECT query_id, doc_id, round(sum(1 / (60 + k)), 9) AS score, min(list * 1000 + k) AS seen FROM f GROUP BY 1, 2),
        h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, doc_id) AS rank FROM fu QUALIFY rank <= 12),
        o AS (SELECT h.query_id, h.doc_id, h.score, h.rank, c.text, d.body FROM h JOIN c USING (query_id) JOIN d USING (doc_id)),
        w AS (SELECT *, list_distinct(regexp_extract_all(lower(text), '[\\pL\\pN\\pM_]+')) AS a, list_distinct(regexp_extract_all(lower(body), '[\\pL\\pN\\pM_]+')) AS b FROM o)
        SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank, round(len(list_intersect(a, coalesce(b, []))) / greatest(1, len(a)), 6) AS rerank, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(len(list_intersect(a, coalesce(b, []))) / greatest(1, len(a)), 6) DESC, rank) AS INTEGER) AS place
        FROM w QUALIFY place <= 5""",
    "semantic_dedup_cosine": """SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 4) AS cosine FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id
        WHERE round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) > 0.92""",
}
ORACLE_SQL["semantic_dedup_day"] = """WITH e AS (SELECT vec_id AS asset_id, vec_id % 40 AS ticker, vec_id % 30 AS day, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    n AS (SELECT a.asset_id, count(*) AS c FROM e a JOIN e b ON a.ticker = b.ticker AND a.day = b.day AND b.asset_id < a.asset_id WHERE round(list_dot_product(a.v, b.v), 6) > 0.3 GROUP BY 1)
    SELECT e.asset_id, n.c IS NULL AS kept, coalesce(n.c, 0) AS n_before FROM e LEFT JOIN n USING (asset_id)"""
ORACLE_SQL["chunk_layer_counts"] = f"SELECT level, count(*) AS n FROM ({ORACLE_SQL['chunks_l1_l2']}) GROUP BY 1"
ORACLE_SQL["chunk_source_counts"] = f"""SELECT ['polygon_news', 'fmp_fundamentals', 'fred_macro', 'gdelt_news'][CAST(split_part(chunk_id, '::', 1) AS BIGINT) // 20 % 4 + 1] AS source_type, count(*) AS total,
    count(*) FILTER (level = 'l1') AS l1, count(*) FILTER (level = 'l2') AS l2 FROM ({ORACLE_SQL['chunks_l1_l2']}) GROUP BY 1"""
_LEARNED = r"""ab AS (SELECT doc_id, regexp_replace(text, ' (the|der|la|le) ', ' apr. \1 ', 'g') AS text FROM documents),
    wd AS (SELECT unnest(regexp_extract_all(lower(text), '\pL[\pL.]*')) AS w FROM ab),
    wc AS (SELECT regexp_replace(w, '[.]$', '') AS word, count(*) FILTER (w LIKE '%.') AS stopped, count(*) FILTER (w NOT LIKE '%.') AS plain FROM wd GROUP BY 1),
    tot AS (SELECT sum(stopped + plain) AS n, sum(stopped) AS stops FROM wc),
    sc AS (SELECT word, stopped, plain, length(word) - length(replace(word, '.', '')) AS dots, length(replace(word, '.', '')) AS letters, stops / n AS p FROM wc, tot WHERE stopped > 0 AND stops < n),
    ln AS (SELECT word, round(-2 * (stopped * ln(p) + plain * ln(1 - p) - stopped * ln(0.99) - plain * ln(0.01)) * exp(-letters) * (dots + 1) * pow(letters, -plain), 9) AS score FROM sc),
    le AS (SELECT * FROM ln WHERE score >= 0.3)"""
ORACLE_SQL["abbreviations"] = f"WITH {_LEARNED} SELECT word, round(score, 6) AS score FROM le"
ORACLE_SQL["learned_sentences"] = rf"""WITH {_LEARNED}, pc AS (SELECT doc_id, list_filter(string_split(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS ps FROM ab),
    x AS (SELECT doc_id, unnest(ps) AS piece, unnest(range(0, len(ps))) AS at_ FROM pc),
    m AS (SELECT x.*, le.word IS NOT NULL AS goes_on FROM x LEFT JOIN le ON le.word = regexp_extract(lower(piece), '(\pL[\pL.]*)\.$', 1)),
    b AS (SELECT *, coalesce(NOT lag(goes_on) OVER (PARTITION BY doc_id ORDER BY at_), true)::INT AS begins FROM m), g AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY at_) AS nth FROM b),
    st AS (SELECT doc_id, nth, string_agg(piece, ' ' ORDER BY at_) AS sentence FROM g GROUP BY 1, 2)
    SELECT doc_id, count(*) AS n, sha256(string_agg(sentence, '|' ORDER BY nth)) AS sha256 FROM st GROUP BY 1"""
