"""Source divergence audit: how far the term shares of the sources of one language lie apart.

A language keeps the terms that occur in at least ``least_docs`` of its documents. A group (a source in a language, or
the language as a whole) gives each kept term the share p = 1 + floor(10**9 * (count + 5) / (N + 5 * V)); the distance of two
sources is the sum of abs(p - q) over all kept terms.

No pair of sources goes over the vocabulary. The supports of two sources A and B split the kept terms in four, and the
sum follows from inclusion and exclusion:

    sum = sum over A of |p - z_b|  +  sum over B of |z_a - q|                  one-sided, z being a group's share of count 0
        + sum over A and B of (|p - q| - |p - z_b| - |z_a - q|)                corrections
        + (V - |A| - |B| + |A and B|) * |z_a - z_b|                            terms that neither has

The one-sided sums depend on counts only: a group's histogram of counts is put in order of shares together with the other
groups' z, and running sums price them all in one window. Corrections come from a join of postings (term, source, share).
The postings of a term that many sources have are dealt out in blocks, so that no task pairs more than a block of them
with the others. Terms are counted in the partitions and combined before each shuffle: a source with a third of all rows sends
a row for each of its terms and tasks. What is kept of the counts is stored once in the shared folder.

Distances to all other sources are the result: its rows grow with the square of a language's sources.

Edge cases: null text, lang and source are the empty string, a language and source like any other; texts without terms count as
documents; a group without kept terms has shares and distances too; without kept terms distances are 0 and there are
no term rows; repeated rows are documents of their own; ties are ordered by item; an empty table gives an empty
result; extra columns are ignored. Texts are read whole, in slices of 4 MB or one text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, sliced, stored, text_bytes

LEAST_DOCS, TOP_TERMS, SMOOTHING, UNIT = 30, 50, 5, 1_000_000_000
#: Postings of a term are paired in blocks of so many sources.
BLOCK_SOURCES = 256

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_COUNTS = "lang string, source string, term string, n long, docs long"


def _terms(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts, end to end, and the offsets of each text's terms."""
    buf, edges = text_bytes(column)
    letter = _LETTER[buf]
    first = letter & np.concatenate(([True], ~letter[:-1])) if len(buf) else letter
    inner = edges[:-1][np.diff(edges) > 0]
    first[inner] = letter[inner]
    starts = np.flatnonzero(first)
    before = np.concatenate(([0], np.cumsum(letter)))
    places = np.concatenate((before[starts], before[-1:])).astype(np.int64)
    data = np.ascontiguousarray(_LOWER[buf[letter]])
    terms = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(data)])
    return terms, np.searchsorted(starts, edges)


def _counted(tables):
    """Counts of each slice, by lang, source and term."""
    for t in sliced(tables, 2):
        terms, offsets = _terms(t.column(2))
        lang, source, term = (c.dictionary_encode() for c in (t.column(0), t.column(1), terms))
        n_sources, n_terms = max(1, len(source.dictionary)), max(1, len(term.dictionary))
        group = lang.indices.to_numpy().astype(np.int64) * n_sources + source.indices.to_numpy()
        groups, group = np.unique(group, return_inverse=True)
        doc = np.repeat(np.arange(t.num_rows), np.diff(offsets))
        in_doc, n = np.unique(doc * n_terms + term.indices.to_numpy(), return_counts=True)
        cells, where = np.unique(group[in_doc // n_terms] * n_terms + in_doc % n_terms, return_inverse=True)
        total = np.zeros(len(cells), dtype=np.int64)
        np.add.at(total, where, n)
        of = groups[cells // n_terms]
        yield pa.record_batch([lang.dictionary.take(pa.array(of // n_sources)), source.dictionary.take(pa.array(of % n_sources)), term.dictionary.take(pa.array(cells % n_terms)).cast(pa.string()),
                               pa.array(total), pa.array(np.bincount(where, minlength=len(cells)).astype(np.int64))], ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that have it)."""
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang_col, source_col)), F.col(text_col).cast("string"))
    return rows.mapInArrow(lean(_counted), _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10**9 * (n + 5) / (total + 5 * terms)), exactly, for any counts; null without terms."""
    whole = (n + F.lit(SMOOTHING)).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    below = F.when(terms > 0, (total + terms * F.lit(SMOOTHING)).cast("decimal(31,0)"))
    return F.call_function("div", whole, below) + F.lit(1).cast("long")


def _blocks(sources: str) -> Column:
    return F.ceil(F.col(sources) / F.lit(BLOCK_SOURCES)).cast("long")


def _block(sources: str) -> Column:
    """The block of one side of a join of sources ..."""
    return F.pmod(F.xxhash64("source"), _blocks(sources))


def _all_blocks(sources: str) -> Column:
    """... and a row of the other side for each block."""
    return F.explode(F.sequence(F.lit(0).cast("long"), _blocks(sources) - 1))


class Audit:
    """The tables that the parts share. ``pairs`` and ``terms`` give the parts, ``report`` both with their ranks."""

    def __init__(self, docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS):
        all_sources = Window.partitionBy("lang", "term")
        counts = term_counts(docs, lang_col, source_col, text_col).withColumns({
            "lang_docs": F.sum("docs").over(all_sources), "lang_n": F.sum("n").over(all_sources), "holders": F.count(F.lit(1)).over(all_sources)})
        kept = counts.filter(F.col("lang_docs") >= least_docs).select("lang", "source", "term", "n", "lang_n", "holders")
        self.kept = kept = stored(kept, "divergence-counts")
        groups = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source")).distinct()
        sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("support"))
        langs = kept.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n")).groupBy("lang").agg(
            F.sum("lang_n").alias("lang_total"), F.count(F.lit(1)).alias("terms"))
        sources = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
        made = groups.join(sources, "lang").join(sums, ["lang", "source"], "left").join(langs, "lang", "left").select(
            "lang", "source", "sources", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("total", "support", "lang_total", "terms")))
        self.groups = stored(made.withColumn("zero", share(F.lit(0).cast("long"), F.col("total"), F.col("terms"))), "divergence-groups")
        shares = kept.join(self.groups, ["lang", "source"])
        self.postings = shares.select("lang", "source", "term", "n", "lang_n", "holders", "zero", "lang_total", "terms", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"))

    def _partners(self) -> DataFrame:
        """Each group of a language with each other one."""
        left = self.groups.select("lang", "source", _block("sources").alias("block"))
        right = self.groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("item_zero"), _all_blocks("sources").alias("block"))
        return left.join(right, ["lang", "block"]).filter("source <> item").drop("block")

    def one_sided(self) -> DataFrame:
        """lang, source, item, priced: the sum over the source's own terms of abs(p - z), z being the item's share of count 0."""
        marks = self.postings.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("h")).select(
            "lang", "source", F.lit(None).cast("string").alias("item"), "p", "h", (F.col("p") * F.col("h")).alias("hp"))
        asks = self._partners().select("lang", "source", "item", F.col("item_zero").alias("p"), F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("hp"))
        whole = Window.partitionBy("lang", "source")
        below = whole.orderBy("p").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        at = marks.unionByName(asks).select(
            "lang", "source", "item", "p", F.sum("h").over(below).alias("h_below"), F.sum("hp").over(below).alias("hp_below"), F.sum("h").over(whole).alias("h_all"), F.sum("hp").over(whole).alias("hp_all"))
        under = F.col("p") * F.col("h_below") - F.col("hp_below")
        over = (F.col("hp_all") - F.col("hp_below")) - F.col("p") * (F.col("h_all") - F.col("h_below"))
        return at.filter("item is not null").select("lang", "source", "item", F.coalesce(under + over, F.lit(0).cast("long")).alias("priced"))

    def overlaps(self) -> DataFrame:
        """lang, source < item, common (terms that both have), correction."""
        left = self.postings.select("lang", "term", "source", "p", "zero", _block("holders").alias("block"))
        right = self.postings.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("zero").alias("item_zero"), _all_blocks("holders").alias("block"))
        both = left.join(right, ["lang", "term", "block"]).filter("source < item")
        fix = F.abs(F.col("p") - F.col("q")) - F.abs(F.col("p") - F.col("item_zero")) - F.abs(F.col("zero") - F.col("q"))
        return both.groupBy("lang", "source", "item").agg(F.count(F.lit(1)).alias("common"), F.sum(fix).alias("correction"))

    def pairs(self) -> DataFrame:
        """lang, source, item, value: the distance of each source to each other one of its language."""
        low, high = F.least("source", "item"), F.greatest("source", "item")
        priced = self.one_sided().groupBy("lang", low.alias("source"), high.alias("item")).agg(F.sum("priced").alias("priced"))
        side = lambda c, *more: self.groups.select("lang", F.col("source").alias(c), F.col("support").alias(f"{c}_support"), F.col("zero").alias(f"{c}_zero"), *more)
        known = priced.join(self.overlaps(), ["lang", "source", "item"], "left").join(side("source", "terms"), ["lang", "source"]).join(side("item"), ["lang", "item"])
        none = F.lit(0).cast("long")
        neither = F.col("terms") - F.col("source_support") - F.col("item_support") + F.coalesce("common", none)
        value = F.col("priced") + F.coalesce("correction", none) + neither * F.abs(F.col("source_zero") - F.col("item_zero"))
        once = known.select("lang", "source", "item", F.when(F.col("terms") > 0, value).otherwise(none).alias("value"))
        both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("pair")
        return once.select("lang", "value", both).select("lang", "pair.source", "pair.item", "value")

    def terms(self) -> DataFrame:
        """lang, source, item, value: terms of a source that it has more of than its language."""
        over = F.col("p") - share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
        return self.postings.select("lang", "source", F.col("term").alias("item"), over.alias("value")).filter("value > 0")

    def report(self, top_terms: int = TOP_TERMS) -> DataFrame:
        """lang, source, part, item, value, rank: all pairs, and the first terms of each group."""
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
        return ranked(self.pairs(), "pair").unionByName(ranked(self.terms(), "term").filter(F.col("rank") <= top_terms))


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    return Audit(docs, lang_col, source_col, text_col, least_docs).report(top_terms)
