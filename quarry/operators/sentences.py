"""Sentence splitting with abbreviations learned from the texts, without labels.

A word that is mostly followed by a full stop is an abbreviation rather than a word that ends many sentences. How much more often than
by chance is told by Dunning's likelihood ratio, weighed as Kiss and Strunk (2006) do: short words more, words with full stops inside more,
words that also come without one less. Counts are taken by Spark over all texts; what is learned is a table, and
splitting joins it to the last words of what could be sentences.

Edge cases: null and blank texts have no sentences; texts without an end are one; repeated rows are counted and split as rows of
their own; an empty table teaches nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the published method: from which score on a word is an abbreviation; how often an abbreviation has its full stop.
LEAST_SCORE, STOPPED = 0.3, 0.99
#: Keys that the pieces ending in one word are dealt over.
SALTS = 64

_WORD = r"\p{L}[\p{L}.]*"
_ENDS = r"(?<=[.!?])\s+"


def word_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """word, stopped, plain: how often a word (lower case, without its last full stop) comes with one and without."""
    found = texts.select(F.explode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(_WORD), F.lit(0))).alias("w"))
    ends = F.endswith("w", F.lit("."))
    return found.select(F.when(ends, F.expr("substring(w, 1, length(w) - 1)")).otherwise(F.col("w")).alias("word"), ends.cast("long").alias("stopped")).groupBy("word").agg(
        F.sum("stopped").alias("stopped"), F.sum(1 - F.col("stopped")).alias("plain"))


def abbreviations(counts: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """word and score of the abbreviations among counted words."""
    sums = counts.agg(F.sum(F.col("stopped") + F.col("plain")).alias("n"), F.sum("stopped").alias("stops"))  # one row
    by_chance = F.col("stops") / F.col("n")
    hits = lambda p: F.col("stopped") * F.log(p) + F.col("plain") * F.log(1 - p)
    ratio = -2 * (hits(by_chance) - hits(F.lit(STOPPED)))
    dots = F.length("word") - F.length(F.regexp_replace("word", r"\.", ""))
    letters = F.length("word") - dots
    score = ratio * F.exp(-letters) * (dots + 1) * F.pow(letters, -F.col("plain"))
    held = counts.filter("stopped > 0").crossJoin(F.broadcast(sums)).filter("stops < n")
    return held.select("word", F.round(score, 9).alias("score")).filter(F.col("score") >= least)


def last_word(piece: Column) -> Column:
    """The word before the full stop at a piece's end, in lower case; empty if it doesn't end in one."""
    return F.regexp_extract(F.lower(piece), rf"({_WORD})\.$", 1)


def split(texts: DataFrame, learned: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, nth (from 1), sentence, for texts with distinct ids. A piece that ends in a learned abbreviation goes on with the
    next one, a space between them. Rows of one text meet, never those of two."""
    pieces = texts.select(id_col, F.posexplode(F.filter(F.split(F.trim(F.regexp_replace(text_col, r"^\s+|\s+$", "")), _ENDS), lambda x: x != "")).alias("at", "piece"))
    # A word may end most pieces: its rows are dealt over SALTS keys, those without a word over all tasks.
    salt = F.when(F.col("word") == "", F.xxhash64(id_col, "at")).otherwise(F.pmod(F.xxhash64(id_col, "at"), F.lit(SALTS)))
    known = learned.filter("word <> ''").select("word", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"), F.lit(1).alias("goes_on"))
    marked = pieces.withColumn("word", last_word(F.col("piece"))).withColumn("salt", salt).join(known, ["word", "salt"], "left")
    before = Window.partitionBy(id_col).orderBy("at")
    begins = F.coalesce(F.lag(F.coalesce("goes_on", F.lit(0))).over(before) == 0, F.lit(True)).cast("int")
    numbered = marked.withColumn("begins", begins).withColumn("nth", F.sum("begins").over(before))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]), " ")
    return numbered.groupBy(id_col, "nth").agg(joined.alias("sentence")).select(id_col, F.col("nth").cast("int").alias("nth"), "sentence")
