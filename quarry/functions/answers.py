"""Expressions over questions and answers: what a question names, how an answer is classed, how a response is read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that stand for tickers.
ALIASES = {"APPLE": "AAPL", "MICROSOFT": "MSFT", "TESLA": "TSLA", "GOOGLE": "GOOGL", "ALPHABET": "GOOGL", "NVIDIA": "NVDA", "META": "META", "AMAZON": "AMZN", "JPMORGAN": "JPM"}
# Words of an answer that refuses, and of one that finds too little.
REFUSALS = ["knowledge cutoff", "date is in the future", "future relative to my knowledge", "cannot verify", "can't verify", "no data available", "no market data",
            "cannot provide real causes", "cannot access real-time", "outside my training data", "i don't have access to", "has not yet occurred"]
TOO_LITTLE = ["insufficient", "not enough evidence", "cannot determine", "no evidence"]
# Made-up deals that an answer may tell of.
MADE_UP = ["acquired openai", "acquisition of openai"]
# Words of good and bad news.
GOOD = ["surge", "beat", "record", "growth", "rally", "gain", "upgrade", "strong", "bullish", "outperform", "positive", "profit"]
BAD = ["drop", "fall", "miss", "decline", "loss", "cut", "downgrade", "weak", "bearish", "slump", "warning", "negative", "crash"]
# Categories of a cause.
CATEGORIES = ["earnings", "macro", "geopolitical", "sector", "technical", "regulatory", "other"]
# Words of world politics and policy.
GEO = r"(?i)(tariff|policy|fed|rate|inflation|export|ban|sanction|trade|war)"


def query_ticker(query: Column, known: Column, aliases: dict[str, str] = ALIASES) -> Column:
    """The first word of up to 12 letters that is a known ticker, else the first that stands for one; else null."""
    words = F.transform(F.regexp_extract_all(query, F.lit(r"\b[A-Za-z]{1,12}\b"), F.lit(0)), F.upper)
    names = F.create_map(*[x for k, v in aliases.items() for x in (F.lit(k), F.lit(v))])
    direct = F.filter(words, lambda w: F.array_contains(known, w))
    mapped = F.filter(F.transform(words, lambda w: F.try_element_at(names, w)), lambda w: F.coalesce(F.array_contains(known, w), F.lit(False)))
    return F.coalesce(F.get(direct, 0), F.get(mapped, 0))


def claimed_percent(query: Column) -> Column:
    """The first signed number before a percent sign."""
    return F.nullif(F.regexp_extract(query, r"(-?\d+(?:\.\d+)?)\s*%", 1), F.lit("")).try_cast("double")


def capitals(query: Column) -> Column:
    """Words of two to five capitals."""
    return F.regexp_extract_all(F.coalesce(query, F.lit("")), F.lit(r"\b[A-Z]{2,5}\b"), F.lit(0))


def has_any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out |= F.contains(F.lower(text), F.lit(w))
    return out


def refuses(answer: Column) -> Column:
    return has_any(answer, REFUSALS)


def answer_status(answer: Column) -> Column:
    return F.when(refuses(answer) | has_any(answer, TOO_LITTLE), "INSUFFICIENT").otherwise("SUFFICIENT")


def hallucinates(query: Column, answer: Column) -> Column:
    """Does an answer that doesn't refuse name a filing number, or a percentage of 40 or more that the question lacks?"""
    percents = lambda x: F.regexp_extract_all(x, F.lit(r"\b\d+(?:\.\d+)?%"), F.lit(0))
    large = F.exists(F.array_except(percents(answer), percents(query)), lambda p: F.rtrim(p, F.lit("%")).cast("double") >= 40.0)
    return ~refuses(answer) & (answer.rlike(r"\b\d{7}-\d{2}-\d{6}\b") | large | has_any(answer, MADE_UP))


def sentiment(text: Column) -> Column:
    """Good words less bad words that a text has, each once."""
    score = F.lit(0)
    for w in GOOD:
        score += F.contains(F.lower(text), F.lit(w)).cast("int")
    for w in BAD:
        score -= F.contains(F.lower(text), F.lit(w)).cast("int")
    return F.when(score > 0, "positive").when(score < 0, "negative").otherwise("neutral")


def category(name: Column) -> Column:
    clean = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    return F.when(clean.isin(CATEGORIES), clean).otherwise("other")


def without_fence(text: Column) -> Column:
    """The text inside a Markdown fence, or the text."""
    clean = F.regexp_replace(text, r"^\s+|\s+$", "")
    lines = F.split(clean, "\n")
    closed = F.trim(F.element_at(lines, -1)) == "```"
    inner = F.slice(lines, 2, F.greatest(F.size(lines) - F.when(closed, 2).otherwise(1), F.lit(0)))
    return F.when(clean.startswith("```"), F.array_join(inner, "\n")).otherwise(clean)


GRADED = "struct<chunk_id:string,relevance:double,category:string,temporal_match:boolean,reasoning:string>"


def _valid(chunk: Column) -> Column:
    return ((F.length(chunk["chunk_id"]) > 0) & chunk["relevance"].between(0.0, 1.0) & chunk["temporal_match"].isNotNull() & (F.length(chunk["reasoning"]) > 0))


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once however often it is named."""
    return F.get(F.transform(F.array(value), then), 0)


def parsed_grades(text: Column) -> Column:
    """struct<mode, chunks>: graded chunks of a response read strictly, all of them valid (strict), or each innermost
    object that is a valid one (chunk_salvage); mode is null if there is none."""
    read = lambda x, kind: F.from_json(x, kind, {"mode": "PERMISSIVE"})

    def strictly(clean: Column) -> Column:
        listed = lambda: _once(read(clean, f"array<{GRADED}>"), lambda x: F.struct(x.alias("grades"), (F.size(x) > 0).alias("fine")))
        held = lambda: _once(read(clean, f"graded_chunks array<{GRADED}>, reasoning string"), lambda x: F.struct(x["graded_chunks"].alias("grades"), (F.length(x["reasoning"]) > 0).alias("fine")))
        return F.when(clean.startswith("["), listed()).otherwise(held())

    def chosen(clean: Column) -> Column:
        proper = lambda x: F.coalesce(F.try_parse_json(clean).isNotNull() & x["grades"].isNotNull() & F.forall(x["grades"], lambda c: F.coalesce(_valid(c), F.lit(False))) & x["fine"], F.lit(False))
        pieces = F.transform(F.regexp_extract_all(clean, F.lit(r"\{[^{}]*\}"), F.lit(0)), lambda x: read(x, GRADED))
        saved = F.filter(pieces, lambda c: F.coalesce(_valid(c), F.lit(False)))
        strict = _once(strictly(clean), lambda x: F.when(proper(x), x["grades"]))
        kept = _once(strict, lambda x: F.struct(x.isNotNull().alias("strict"), F.coalesce(x, saved).alias("chunks")))
        return _once(kept, lambda x: F.struct(F.when(x["strict"], "strict").when(F.size(x["chunks"]) > 0, "chunk_salvage").alias("mode"), x["chunks"].alias("chunks")))

    known = lambda some: F.transform(some, lambda c: c.withField("category", category(c["category"])))
    return _once(_once(without_fence(text), chosen), lambda x: F.struct(x["mode"].alias("mode"), known(x["chunks"]).alias("chunks")))


def relevance(text: Column) -> Column:
    """A relevance from 0 to 1 of a response: a JSON number or object, fenced or among other words, else a free number."""
    clean = without_fence(text)
    field = lambda x: F.regexp_extract(x, r'"relevance"\s*:\s*(-?\d+(?:\.\d+)?)', 1)
    found = F.coalesce(clean.try_cast("double"), F.nullif(field(clean), F.lit("")).try_cast("double"), F.nullif(F.regexp_extract(clean, r"(-?\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double"))
    return F.when(found.between(0.0, 1.0), found)


def usd(text: Column) -> Column:
    """Dollars with a letter for their size; what is no number stays as it is."""
    n = text.try_cast("double")
    size = F.abs(n)
    sign = F.when(n < 0, "-").otherwise("")
    out = F.format_string("%s$%.2f", sign, size)
    for least, letter in ((1e3, "K"), (1e6, "M"), (1e9, "B"), (1e12, "T")):
        out = F.when(size >= least, F.format_string(f"%s$%.1f{letter}", sign, size / least)).otherwise(out)
    return F.when(n.isNull(), text).when(n == 0, "$0").otherwise(out)


def percent_of(part: Column, whole: Column) -> Column:
    p, w = part.try_cast("double"), whole.try_cast("double")
    return F.when(p.isNull() | w.isNull() | (w == 0), "--").otherwise(F.format_string("%.1f%%", p / F.nullif(w, F.lit(0.0)) * 100))


def duration(ms: Column) -> Column:
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).otherwise(F.format_string("%.1fs", ms / 1000))


def preview(text: Column, most: int = 250) -> Column:
    """White space collapsed, cut at the last space before the limit."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    cut = F.substring(flat, 1, most)
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.regexp_replace(cut, r" [^ ]*$", ""), F.lit(" ...")))


def truncated(text: Column, most: int = 400) -> Column:
    """Cut after some characters, with how many are left out."""
    more = F.length(text) - most
    return F.when(more <= 0, text).otherwise(F.concat(F.substring(text, 1, most), F.lit("\n... ["), more.cast("string"), F.lit(" more chars truncated]")))


def prompt_chunks(chunks: Column, most: int = 600) -> Column:
    """Numbered sections of chunks (asset_id, source_type, reference_date, content), each cut, with a rule between."""
    one = lambda c, i: F.concat(
        F.lit("### Chunk "), (i + 1).cast("string"), F.lit(" (ID: "), c["asset_id"], F.lit(")\nSource: "), F.coalesce(c["source_type"], F.lit("unknown")),
        F.lit(" | Date: "), F.coalesce(c["reference_date"].cast("string"), F.lit("unknown")), F.lit("\n\n"), F.substring(F.coalesce(c["content"], F.lit("")), 1, most))
    return F.array_join(F.transform(chunks, one), "\n\n---\n\n")


def fewer_chunks(prompt: Column, attempt: Column) -> Column:
    """A prompt's sections cut to 4 at the first further attempt and to 2 after it."""
    parts = F.filter(F.split(prompt, "\n\n---\n\n"), lambda x: F.trim(x) != "")
    return F.array_join(F.slice(parts, F.lit(1), F.when(attempt == 1, 4).otherwise(2)), "\n\n---\n\n")


def key_mark(key: Column) -> Column:
    """Twelve hex digits that tell keys apart without showing them."""
    return F.substring(F.sha2(key, 256), 1, 12)


def question(query: Column, ticker: Column, day: Column, override: Column | None = None) -> Column:
    """An override, else the query, else the plain question about a ticker and a day; empty counts as absent."""
    plain = F.concat(F.lit("Why did "), ticker, F.lit(" move on "), day.cast("string"), F.lit("?"))
    some = [F.nullif(c, F.lit("")) for c in (override, query) if c is not None]
    return F.coalesce(*some, plain)
