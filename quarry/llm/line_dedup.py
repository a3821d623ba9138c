"""Line deduplication by overlapping windows of three lines.

Every three consecutive lines of a text are hashed. A window found before - in an earlier document, or earlier in
the same one - marks its three lines; marked positions of overlapping windows merge, and the marked lines go. The
first occurrence of a window, by (doc_id, row, line), always stays.

Edge cases: null text stays null and has no lines; texts of fewer than three lines have no window; windows without
any word are ignored, so blank lines never match; a null doc_id comes last; repeated rows count as later copies;
an empty table gives an empty result; extra columns are returned untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, fresh, numbered

WINDOW_LINES = 3


def repeated_positions(docs: DataFrame, row_col: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW_LINES) -> DataFrame:
    """__row (row_col's number), __id and lines (sorted distinct line numbers from 0 that later occurrences cover), for
    rows that have any."""
    lines = F.split(F.col(text_col), "\n")
    rows = docs.select(
        F.col(row_col).alias("__row"), F.col(id_col).alias("__id"), lines.alias("__lines")
    ).filter(F.size("__lines") >= window)
    # 96 bits of hash over a window: unequal windows meet with a chance of 2**-96.
    cut = lambda i: F.slice("__lines", i + 1, F.lit(window))
    keys = F.transform(F.sequence(F.lit(0), F.size("__lines") - window), lambda i: F.when(
        F.exists(cut(i), lambda x: x.rlike(r"[^ \t-\r]")), F.struct(F.xxhash64(cut(i)).alias("a"), F.hash(cut(i), F.lit(7)).alias("b"))))
    found = rows.select("__row", "__id", F.posexplode(keys).alias("__at", "__key")).filter("__key is not null").select(
        "__row", "__id", "__at", "__key.a", "__key.b", F.struct(F.col("__id").isNull().alias("n"), F.col("__id").alias("i"), F.col("__row").alias("r"), F.col("__at").alias("p")).alias("__place"))
    # Counts and first places are combined before they are shuffled; a common window costs a row for each task.
    firsts = found.groupBy("a", "b").agg(F.min("__place").alias("__first"), F.count(F.lit(1)).alias("__n")).filter("__n > 1").drop("__n")
    later = found.join(apart(firsts, "a", "b"), ["a", "b"]).filter(F.col("__place") != F.col("__first"))
    covered = later.select("__row", "__id", F.explode(F.sequence(F.col("__at"), F.col("__at") + window - 1)).alias("__line"))
    return covered.groupBy("__row", "__id").agg(F.sort_array(F.collect_set("__line")).alias("lines"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW_LINES) -> DataFrame:
    """docs with text_col without its repeated lines, n_lines and n_removed (columns of these names are replaced)."""
    row, marked, own, gone = fresh(docs, "__row", "__marked", "__own", "__gone")
    rows = numbered(docs, row)
    marks = repeated_positions(rows, row, id_col, text_col, window).select(F.col("__row").alias(marked), F.col("__id").alias(own), F.col("lines").alias(gone))
    lines = F.split(F.col(text_col), "\n")
    # The lines that stay are the places that are left when the marked ones are taken away: two sets, no search per line.
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    left = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    out = rows.join(marks, (F.col(row) == F.col(marked)) & F.col(id_col).eqNullSafe(F.col(own)), "left")
    return out.withColumns({
        "n_lines": F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long"),
        "n_removed": F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long"),
        text_col: F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(left),
    }).drop(row, marked, own, gone)
