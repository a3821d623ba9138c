"""Following pages: recorded pages that name the next one, put in order from where a request starts.

Pages are cut into ranges of their address, as the pages of a list have addresses near each other. A task follows the pages of a
range as far as they stay in it, so each page is sent twice, however long the lists are. What is left are entries: the pages that
another range or a request leads to. Among them pointers are doubled: in round k each entry knows the one 2**k further on, and each
request, which knows its first 2**k entries, learns as many again. Then the ranges write out the pages behind the entries
that requests see. Where next pages lie anywhere (addresses in no order), most pages are entries and are doubled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.sources import shared

#: Pages of a range, which a task holds; rows that it writes at once.
HELD, WRITTEN = 1 << 17, 1 << 16


def followed(requests: DataFrame, pages: DataFrame, held: int = HELD) -> tuple[DataFrame, DataFrame]:
    """The pages of each request in order, and how each request ended.

    requests: request_id, url (of the first page); pages: url (distinct), next_url (null: the last page). First table: request_id,
    nth (from 0), url; second: request_id, n_pages, ended, which is complete (a last page), broken (an address that no
    page has; with a null or unknown first address n_pages is 0) or loop (the next page has been seen: it is not taken again)."""
    pages = shared.stored(pages.select("url", "next_url").filter("url is not null"), "pages")
    inside = shared.stored(_inside(pages, held), "inside")
    # Stored, so that few are broadcast.
    entries = shared.stored(inside.select(F.col("exit").alias("url")).unionByName(requests.select("url")).filter("url is not null").distinct(), "entries")
    entries = shared.stored(inside.drop("next_url").join(entries, "url", "left_semi"), "entries")
    seen = shared.stored(_doubled(requests, entries), "followed")
    # Two entries of a request share pages only if the last one meets, in the same range, the one that had the same exit before.
    last = seen.groupBy("request_id").agg(F.max(F.struct("nth", "url")).alias("last")).select("request_id", "last.*").join(entries, "url").select("request_id", "nth", "exit", "ended")
    again = last.select("request_id", F.col("nth").alias("last"), F.col("exit").alias("url")).join(seen, ["request_id", "url"]).select("request_id", "last", F.col("nth").alias("at"))
    met = seen.join(again, "request_id").filter("nth < at").groupBy("request_id", F.col("last").alias("nth")).agg(F.max_by("url", "nth").alias("until"))
    visits = seen.join(met, ["request_id", "nth"], "left").join(entries.select("url", "part"), "url")
    out = shared.stored(_written(inside, shared.stored(visits, "visits")), "seen")
    count = out.groupBy("request_id").agg((F.max("nth") + 1).alias("n_pages"))
    known = entries.select(F.col("url").alias("known"))
    how = F.coalesce("ended", F.when(F.col("known").isNull(), "broken").otherwise("loop"))
    ends = last.join(known, F.col("exit") == F.col("known"), "left").select("request_id", how.alias("ended"))
    ended = requests.select("request_id").join(ends.join(count, "request_id"), "request_id", "left")
    return out, ended.select("request_id", F.coalesce("n_pages", F.lit(0).cast("long")).alias("n_pages"), F.coalesce("ended", F.lit("broken")).alias("ended"))


def _inside(pages: DataFrame, held: int) -> DataFrame:
    """Pages with their range (part), and what following them inside it leads to: exit, an address outside, after so many steps,
    or, where they end inside, how (ended)."""
    parts = max(1, -(-pages.count() // held))
    ranged = pages.repartitionByRange(parts, "url").withColumn("part", F.spark_partition_id())

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not sum(b.num_rows for b in got):
            return
        t = pa.Table.from_batches(got).combine_chunks()
        own = np.arange(t.num_rows)
        to = _places(t)
        stays = to >= 0
        # A page without a next one inside stays where it is.
        end, steps = np.where(stays, to, own), stays.astype(np.int64)
        for _ in range(t.num_rows.bit_length()):
            steps, end = steps + steps[end], end[end]
        exits = t.column("next_url").take(pa.array(end))
        loop = pa.array(stays[end])
        how = pc.if_else(loop, "loop", pc.if_else(exits.is_null(), "complete", pa.scalar(None, pa.string())))
        exits = pc.if_else(loop, pa.scalar(None, exits.type), exits)
        for b in t.append_column("exit", exits).append_column("steps", pa.array(steps + 1)).append_column("ended", how).to_batches(WRITTEN):
            yield b

    return ranged.mapInArrow(inside, "url string, next_url string, part int, exit string, steps long, ended string")


def _places(t: pa.Table) -> np.ndarray:
    """Where in a table each page's next one is, or -1."""
    return _found(t.column("next_url"), t.column("url").combine_chunks())


def _found(wanted: pa.Array | pa.ChunkedArray, urls: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.index_in(wanted, value_set=urls, skip_nulls=True), -1).to_numpy().astype(np.int64)


def _doubled(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """request_id, nth, url: the entries that requests see, and how many pages come before."""
    known = entries.select(F.col("url").alias("known"))
    jumps = entries.join(known, F.col("exit") == F.col("known"), "left_semi").select("url", F.col("exit").alias("to"), "steps")
    jumps = shared.stored(jumps, "jumps")
    firsts = requests.join(known, F.col("url") == F.col("known"), "left_semi").select("request_id", F.lit(0).cast("long").alias("nth"), "url")
    seen = shared.stored(firsts, "followed")
    n = seen.count()
    while not jumps.isEmpty():
        on = seen.join(jumps.withColumnRenamed("url", "at"), F.col("url") == F.col("at")).select("request_id", (F.col("nth") + F.col("steps")).alias("nth"), F.col("to").alias("url"))
        # An entry that a request sees again, in a loop, stays where it was seen first.
        both = seen.unionByName(on).groupBy("request_id", "url").agg(F.min("nth").alias("nth")).select("request_id", "nth", "url")
        seen = shared.stored(both, "followed")
        now = seen.count()
        if now == n:
            break
        n = now
        first = jumps.select(F.col("url").alias("from"), F.col("to").alias("url"), F.col("steps").alias("before"))
        jumps = shared.stored(first.join(jumps, "url").select(F.col("from").alias("url"), "to", (F.col("before") + F.col("steps")).alias("steps")), "jumps")
    return seen


def _written(inside: DataFrame, visits: DataFrame) -> DataFrame:
    """request_id, nth, url: the pages behind each entry (url) that a request sees, up to the first that is also behind another (until)."""
    kind = dict(visits.dtypes)["request_id"]
    used = visits.select("part").distinct()  # a row a range
    asked = visits.select("part", F.lit(1).alias("kind"), "url", F.lit(None).cast("string").alias("next_url"), "request_id", "nth", "until")
    rows = inside.join(F.broadcast(used), "part", "left_semi").select("part", F.lit(0).alias("kind"), "url", "next_url", F.lit(None).cast(kind).alias("request_id"), F.lit(None).cast("long").alias("nth"), F.lit(None).cast("string").alias("until"))
    dealt = rows.unionByName(asked).repartition("part").sortWithinPartitions("part", "kind", F.when(F.col("kind") == 1, F.col("url")))

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, pieces, walk = None, [], None
        for b in batches:
            parts, kinds = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(parts) != 0) | (np.diff(kinds) != 0)) + 1
            for i, j in zip([0, *cuts], [*cuts, b.num_rows]):
                if i == j:
                    continue
                if parts[i] != part:
                    part, pieces, walk = parts[i], [], None
                if kinds[i] == 0:
                    pieces.append(b.slice(i, j - i).select(["url", "next_url"]))
                    continue
                walk = walk or _Walk(pieces)
                pieces = []
                own = b.slice(i, j - i)
                for k, (first, nth, until) in enumerate(zip(walk.places(own.column("url")), own.column("nth").to_pylist(), walk.places(own.column("until")))):
                    at = walk.behind(first, until)
                    for a in range(0, len(at), WRITTEN):
                        some = at[a : a + WRITTEN]
                        who = own.column("request_id").take(pa.array(np.full(len(some), k)))
                        yield pa.record_batch([who, pa.array(nth + a + np.arange(len(some))), walk.urls.take(pa.array(some))], ["request_id", "nth", "url"])

    return dealt.mapInArrow(written, f"request_id {kind}, nth long, url string")


class _Walk:
    """The pages of a range, and the walks through it; the last one is kept."""

    def __init__(self, pieces: list[pa.RecordBatch]):
        t = pa.Table.from_batches(pieces).combine_chunks()
        self.urls, self.to = t.column("url").combine_chunks(), _places(t).tolist()
        self.last = (-1, None)

    def places(self, urls: pa.Array) -> list[int]:
        return _found(urls, self.urls).tolist()

    def behind(self, first: int, until: int) -> np.ndarray:
        """Places of the pages from one on, up to the first that is also behind another (-1: none)."""
        if self.last[0] != first:
            at, seen, out = first, bytearray(len(self.to)), []
            while at >= 0 and not seen[at]:
                seen[at] = 1
                out.append(at)
                at = self.to[at]
            self.last = (first, np.array(out, dtype=np.int64))
        walk = self.last[1]
        if until < 0:
            return walk
        met = np.isin(walk, self.behind(until, -1))
        return walk[: met.argmax()] if met.any() else walk
