"""Text expressions: titles, fingerprints, URLs, sentences, sets of words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized_title(title: Column) -> Column:
    """Lower case, letters and digits with single spaces between; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", " ")), F.lit(""))


def fingerprint(title: Column, published: Column, offset: str = "+00:00") -> Column:
    """16 hex digits of the title without punctuation and its two-hour window, an ISO time with its offset."""
    clean = F.regexp_replace(F.lower(F.regexp_replace(title, r"(?U)[^\w\s]", "")), r"(?U)^\s+|\s+$", "")
    hour = F.concat(F.date_format(F.date_trunc("hour", published) - F.make_dt_interval(hours=F.hour(published) % 2), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(offset))
    return F.substring(F.sha2(F.concat(clean, F.lit("|"), hour), 256), 1, 16)


def language(text: Column) -> Column:
    """unknown for a text of nothing but white space, in the wide sense of Unicode and with the ASCII separators."""
    return F.when(~F.coalesce(text.rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(False)), "unknown").when(text.rlike("[㐀-鿿]"), "non_target_language").otherwise("en")


#: Prefixes of parameters that only track a visitor. Fixed values.
TRACKING = ["utm_", "ref_", "mc_"]


def _encoded(part: Column) -> Column:
    """A part of a query as a form writes it."""
    return F.replace(F.replace(F.url_encode(part), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host (with its port, without a user), no fragment, no tracking parameters, parameters
    written in one way and sorted by name and value, no trailing slash on short paths."""
    bare = F.regexp_replace(url, "#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/?]*)", 1))
    path = F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1)
    slashes = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    path = F.when(path == "/", "").when((slashes == 2) & path.endswith("/"), F.regexp_replace(path, "/$", "")).otherwise(path)
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.struct(
        F.substring_index(p, "=", 1).alias("k"), F.when(F.instr(p, "=") > 0, F.substring(p, F.instr(p, "=") + 1, F.length(p))).otherwise("").alias("v")))
    kept = F.filter(pairs, lambda p: ~F.lower(F.coalesce(F.try_url_decode(p["k"]), p["k"])).rlike("^(" + "|".join(TRACKING) + ")"))
    kept = F.array_sort(F.transform(kept, lambda p: F.struct(F.coalesce(F.try_url_decode(p["k"]), p["k"]).alias("k"), F.coalesce(F.try_url_decode(p["v"]), p["v"]).alias("v"))))
    joined = F.array_join(F.transform(kept, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    return F.concat(scheme, F.lit("://"), host, path, F.when(joined == "", "").otherwise(F.concat(F.lit("?"), joined)))


def sentences(text: Column, least: int = 12, most: int = 30) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(r"[^.!?]+[.!?]*"), F.lit(0)), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.slice(F.filter(found, lambda s: F.length(s) >= least), 1, most)


def words(text: Column) -> Column:
    """Distinct lower-case words between white space, punctuation and all."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != ""))


def terms(text: Column) -> Column:
    """Distinct lower-case runs of letters, digits and underscores of any script."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0)))


def overlap(query: Column, text: Column) -> Column:
    """Share of the query's terms that the text has."""
    return F.size(F.array_intersect(terms(query), terms(text))) / F.greatest(F.lit(1), F.size(terms(query)))


def jaccard(a: Column, b: Column) -> Column:
    """Of sets of words; two empty sets are alike, one empty set is like nothing."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def markdown_row(*columns: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *columns), F.lit(" |"))


def error_class(message: Column) -> Column:
    """The class of an error message by ordered rules; null for no message."""
    m, out = F.lower(message), F.lit("fetch")
    # Patterns and classes, the first that matches decides.
    rules = [("429|rate", "rate_limit"), ("timeout", "timeout"), ("50[0234]", "server_error"), ("^ingest:", "ingest"), ("^clean:", "clean"),
             ("^transform:", "transform"), ("^storage:", "storage")]
    for pattern, name in reversed(rules):
        out = F.when(m.rlike(pattern), name).otherwise(out)
    return F.when(F.coalesce(message, F.lit("")) != "", out)
