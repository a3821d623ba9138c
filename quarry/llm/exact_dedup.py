"""Exact deduplication by deterministic block naming.

Each normalised text is cut into blocks of a fixed number of bytes. Distinct blocks, compared by their whole
content, are sorted and numbered inside ranges of a hash (a name is the range and the place there, not a place in one order
of all blocks); then pairs of adjacent names are numbered the same way, level by level, until each document has one
name. Two texts are equal exactly when they have as many blocks and the same name.

Rows and edge cases: null text counts as the empty text, which is one empty block. A null doc_id is below every
other id. Repeated rows are separate rows of one group, of which one stays. An empty table gives an empty result.
Extra columns of any name are ignored or, in ``keep_one``, returned untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import apart, ascii_lower, fresh, numbered, stored

BLOCK_BYTES = 8192
#: Names are numbered inside so many ranges of sorted keys, many of which share a task.
NAME_RANGES = 1 << 20


def _numbered(keys: DataFrame, columns: list[str], order: list[str] | None = None) -> DataFrame:
    """One integer name for each row of keys, whose rows are distinct: the range's number, then the rank in it."""
    part = F.pmod(F.xxhash64(*columns), F.lit(NAME_RANGES))
    window = Window.partitionBy("__range").orderBy(*(order or columns))
    return (
        keys.withColumn("__range", part)
        .withColumn("__name", F.col("__range") * F.lit(1 << 42) + F.row_number().over(window))
        .drop("__range")
    )


def _bytes(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit(""))).cast("binary")


def _blocks(raw: Column, n: Column, block_bytes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(raw, i * block_bytes + 1, F.lit(block_bytes)))


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, row_col: str | None = None) -> DataFrame:
    """A row per row of docs: __row (row_col's number), doc_id, text_sha256, n_blocks, name. Equal texts share
    (n_blocks, name)."""
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()  # stored below, and read from there
    size = F.greatest(F.lit(1), F.ceil(F.octet_length("__raw") / F.lit(block_bytes))).cast("int")
    raw = docs.select(
        row.alias("__row"), F.col(id_col).alias("doc_id"), _bytes(F.col(text_col)).alias("__raw")
    ).withColumn("n_blocks", size)
    blocks = _blocks(F.col("__raw"), F.col("n_blocks"), block_bytes)

    # Content crosses the network here only, and once for each distinct block and map task.
    content = raw.select(F.explode(blocks).alias("__block")).groupBy("__block").agg(F.lit(1).alias("__one"))
    keys = content.select(F.unhex(F.sha2("__block", 256)).alias("__key"))
    level = Window.partitionBy("__key")
    named = _numbered(keys, ["__key"])
    # Names are given to contents; the digest only carries a name back to its blocks, so it must be unique.
    clash = F.when(F.count(F.lit(1)).over(level) > 1, F.raise_error(F.lit("two blocks share a digest"))).otherwise(F.col("__name"))
    named = named.select("__key", clash.cast("long").alias("__name"))

    base = stored(
        raw.select("__row", "doc_id", "n_blocks", F.sha2("__raw", 256).alias("text_sha256"),
                   F.transform(blocks, lambda b: F.unhex(F.sha2(b, 256))).alias("__keys")),
        "exact-base",
    )
    cells = base.select("__row", "n_blocks", F.posexplode("__keys").alias("__pos", "__key"))
    current = cells.join(apart(named, "__key"), "__key").select("__row", F.col("n_blocks").alias("__left_over"), "__pos", "__name")
    done = None
    while True:
        current = stored(current, "exact-level")
        finished = current.filter("__left_over = 1").select("__row", F.col("__name").alias("name"))
        done = finished if done is None else done.unionByName(finished)
        current = current.filter("__left_over > 1")
        if current.isEmpty():
            break
        odd = F.col("__pos") % 2 == 1
        pairs = current.groupBy("__row", "__left_over", F.expr("__pos div 2").cast("int").alias("__pos")).agg(
            F.max(F.when(~odd, F.col("__name"))).alias("__a"), F.coalesce(F.max(F.when(odd, F.col("__name"))), F.lit(0)).alias("__b")
        )
        pairs = stored(pairs, "exact-pairs")
        names = _numbered(pairs.select("__a", "__b").distinct(), ["__a", "__b"])
        current = pairs.join(apart(names, "__a", "__b"), ["__a", "__b"]).select(
            "__row", F.expr("(__left_over + 1) div 2").cast("int").alias("__left_over"), "__pos", "__name"
        )
    return base.select("__row", "doc_id", "text_sha256", "n_blocks").join(done, "__row")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, row_col: str | None = None) -> DataFrame:
    """A row per row of docs: __row, doc_id, keep_id, group_size, kept, text_sha256. Of equal texts the row with
    the largest id stays (of rows with that id, the one of the largest number: row_col's, or as the table was read)."""
    rows = stored(identities(docs, id_col, text_col, block_bytes, row_col), "exact-identities")
    groups = rows.groupBy("n_blocks", "name").agg(
        F.max(F.struct("doc_id", "__row")).alias("__best"), F.count(F.lit(1)).alias("group_size")
    )
    return rows.join(apart(groups, "n_blocks", "name"), ["n_blocks", "name"]).select(
        "__row", "doc_id", F.col("__best.doc_id").alias("keep_id"), "group_size",
        (F.col("__row") == F.col("__best.__row")).alias("kept"), "text_sha256",
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    row, mate, own = fresh(docs, "__row", "__mate", "__own")
    rows = numbered(docs, row)
    stays = exact_groups(rows, id_col, text_col, row_col=row).filter("kept").select(F.col("__row").alias(mate), F.col("doc_id").alias(own))
    return rows.join(stays, (F.col(row) == F.col(mate)) & F.col(id_col).eqNullSafe(F.col(own)), "left_semi").drop(row)
