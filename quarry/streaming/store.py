"""A keyed store that streams commit to: a log of batches, snapshots that compaction makes, and reads of the two together.

    <path>/log/stream=<name>/batch=<id>    the best row of each key in a batch; a batch that is repeated replaces itself
    <path>/base/<n>/rows, <path>/base/<n>/members    a snapshot, and the batches that it holds

Of all rows of a key the one of the largest version counts, and of equal versions the largest row, column by column: the
table is the same however batches are repeated, cut, or put in order, and whichever stream brings them. A folder counts
once its writer has marked it as done, so a writer that dies leaves nothing. Readers and compaction list the log's folders,
as many as there were batches since the last compaction. One process compacts at a time; streams may write meanwhile.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources import shared


class KeyedStore:
    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], version: str):
        self.spark, self.path, self.keys, self.version = spark, path.rstrip("/"), keys, version
        self.schema = spark.createDataFrame([], schema).schema
        names = self.schema.names
        self.rest = [version] + [c for c in names if c not in keys and c != version]

    def _best(self, rows: DataFrame) -> DataFrame:
        """The row that counts of each key; combined before the shuffle."""
        return rows.groupBy(*self.keys).agg(F.max(F.struct(*self.rest)).alias("row")).select(*self.keys, "row.*").select(*self.schema.names)

    def sink(self, stream: str) -> Callable[[DataFrame, int], None]:
        """A foreachBatch function for the stream of this name."""
        if not stream or "/" in stream or "=" in stream:
            raise ValueError(f"a stream's name is part of a path: {stream!r}")

        def write(batch: DataFrame, number: int) -> None:
            self._best(batch.select(*self.schema.names)).write.mode("overwrite").parquet(f"{self.path}/log/stream={stream}/batch={number}")

        return write

    def _log(self) -> dict[tuple[str, str], str]:
        """The folders of the log that are done, by stream and batch."""
        out = {}
        for stream in shared.folders(self.spark, f"{self.path}/log"):
            for batch in shared.folders(self.spark, f"{self.path}/log/{stream}"):
                place = f"{self.path}/log/{stream}/{batch}"
                if shared.exists(self.spark, f"{place}/_SUCCESS"):
                    out[stream.split("=", 1)[1], batch.split("=", 1)[1]] = place
        return out

    def _bases(self) -> list[int]:
        """Numbers of the snapshots that are done, the newest last. A snapshot's members are written after its rows."""
        found = (int(n) for n in shared.folders(self.spark, f"{self.path}/base") if n.isdigit())
        return sorted(n for n in found if shared.exists(self.spark, f"{self.path}/base/{n}/members/_SUCCESS"))

    def _state(self) -> tuple[DataFrame, dict[tuple[str, str], str], set[tuple[str, str]], list[int]]:
        log, bases = self._log(), self._bases()
        rows, members = self.spark.createDataFrame([], self.schema), set()
        if bases:
            rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/base/{bases[-1]}/rows")
            members = {tuple(r) for r in self.spark.read.parquet(f"{self.path}/base/{bases[-1]}/members").select("stream", "batch").collect()}
        return rows, {k: v for k, v in log.items() if k not in members}, members, bases

    def snapshot(self) -> DataFrame:
        """The table as of now: what was committed later is not in it."""
        rows, fresh, _, _ = self._state()
        if fresh:
            rows = rows.unionByName(self.spark.read.schema(self.schema).parquet(*fresh.values()))
        return self._best(rows)

    def compact(self) -> int:
        """Writes a snapshot of all that is committed; returns its number. Nothing is deleted: readers go on."""
        rows, fresh, members, bases = self._state()
        if bases and not fresh:
            return bases[-1]
        if fresh:
            rows = rows.unionByName(self.spark.read.schema(self.schema).parquet(*fresh.values()))
        number = (bases[-1] if bases else 0) + 1
        self._best(rows).write.mode("overwrite").parquet(f"{self.path}/base/{number}/rows")
        held = self.spark.createDataFrame(sorted(members | set(fresh)), "stream string, batch string")
        held.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/base/{number}/members")
        return number

    def vacuum(self) -> int:
        """Deletes snapshots but the newest, and the log's rows that it holds; for when no reader uses them. A batch of
        those that is repeated later comes back to the log, is a member still, and changes nothing."""
        bases, gone = self._bases(), 0
        if bases:
            members = self._state()[2]
            log = self._log()
            for place in [log[m] for m in members if m in log] + [f"{self.path}/base/{n}" for n in bases[:-1]]:
                shared.delete(self.spark, place)
                gone += 1
        return gone

    def pending(self, wanted: DataFrame, done: str) -> DataFrame:
        """Rows of wanted (with the keys) that have no row here for which the condition holds: what a resumed run still does."""
        return wanted.join(self.snapshot().filter(done).select(*self.keys), self.keys, "left_anti")
