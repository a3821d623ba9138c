"""Stateful operators over many batches, each a StatefulProcessor on the RocksDB state store: numbered event logs, rolling health,
proximity of articles, run status with timeouts. State is dealt over tasks by key; a batch's rows of one key are put in order
there, so batches bound the memory (``maxFilesPerTrigger``). A stream that is ended goes on from its checkpoint.

Where keys are as many as rows (numbered logs, proximity), they are dealt into buckets: a call handles a bucket's keys at once and
holds their state as one Arrow table. A bucket's table is read and written by each batch that has rows of it; more buckets
make it smaller. Their number belongs to a stream's checkpoint: it must stay as it was."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from quarry.functions.text import canonical_url, normalized_title
from quarry.sources import shared

# Seconds a run may take, hours within which a title repeats itself, calls that health looks back on.
TIMEOUT_S, NEAR_HOURS, LAST = 300, 4, 20
#: Buckets that keys are dealt into.
BUCKETS = 256
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession):
    """The state store that these operators need, for the streams started inside; the session's own is put back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def _ordered(frames: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(by, kind="stable")


def _packed(table: pd.DataFrame) -> bytes:
    made, sink = pa.Table.from_pandas(table, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, made.schema) as out:
        out.write_table(made)
    return sink.getvalue().to_pybytes()


def _unpacked(held: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(held).read_all().to_pandas()


class _Numbers(StatefulProcessor):
    """State of a bucket: events so far of each run and node."""

    def init(self, handle) -> None:
        self.held = handle.getValueState("held", "nodes binary")

    def handleInputRows(self, key, rows, timerValues):
        batch = _ordered(rows, ["at", "event_id"])
        both = ["run", "node"]
        new = batch.groupby(both, dropna=False, sort=False).size().rename("n").reset_index()
        event_seq, node_seq = (batch.groupby(k, dropna=False, sort=False).cumcount().to_numpy() + 1 for k in ("run", both))
        if self.held.exists():
            held = _unpacked(self.held.get()[0])
            runs = held.groupby("run", dropna=False, sort=False)["n"].sum().reset_index()
            before = lambda some, k: batch[k].merge(some, "left", on=k)["n"].fillna(0).to_numpy(dtype=np.int64)
            event_seq, node_seq = event_seq + before(runs, ["run"]), node_seq + before(held, both)
            new = pd.concat([held, new]).groupby(both, dropna=False, sort=False)["n"].sum().reset_index()
        self.held.update((_packed(new),))
        yield pd.DataFrame({"run": batch["run"], "event_id": batch["event_id"], "node": batch["node"], "event_seq": event_seq, "node_seq": node_seq})

    def close(self) -> None:
        pass


def event_log(events: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """An append-only log: each event with its number in the run and in the run's node, from 1, in the order in which
    batches come, and inside a batch of (at, event_id). events: run_id, event_id, node, at. A null node counts as ''.
    Tasks tell runs apart by what their ids are as strings."""
    kind = dict(events.dtypes)
    rows = events.select(F.col("run_id").cast("string").alias("run"), "event_id", F.coalesce("node", F.lit("")).alias("node"), "at")
    numbered = rows.withColumn("bucket", F.pmod(F.xxhash64("run"), F.lit(buckets))).groupBy("bucket").transformWithStateInPandas(
        _Numbers(), f"run string, event_id {kind['event_id']}, node string, event_seq long, node_seq long", "append", "none")
    return numbered.select(F.col("run").cast(kind["run_id"]).alias("run_id"), "event_id", "node", "event_seq", "node_seq")


class _Health(StatefulProcessor):
    """State: the ring of the last flags, which may go after a time without calls; calls so far, and incidents."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.ring = handle.getListState("ring", "ok boolean", self.ttl_ms)
        self.total = handle.getValueState("total", "seen long, incident boolean")

    def handleInputRows(self, key, rows, timerValues):
        batch = _ordered(rows, ["seq"])
        seen, incident = self.total.get() if self.total.exists() else (0, False)
        held = [bool(x[0]) for x in self.ring.get()] if self.ring.exists() else []
        ok = np.concatenate([np.array(held, dtype=bool), batch["ok"].to_numpy(dtype=bool)])
        sums = np.concatenate(([0], np.cumsum(ok)))
        full = sums[LAST:] - sums[:-LAST] if len(ok) >= LAST else np.zeros(0)
        waits = ((batch["status"] == 429) & (batch["retry_after"] > 300)).any()
        # A full ring that was there before the batch has been judged with the batch that filled it.
        incident = bool(incident or waits or (full[1 if len(held) == LAST else 0 :] * 2 < LAST).any())
        last = ok[-LAST:].tolist()
        self.ring.put([(x,) for x in last])
        self.total.update((seen + len(batch), incident))
        yield pd.DataFrame({"node": [key[0]], "seen": [seen + len(batch)], "ok_of_last": [sum(last)], "incident": [incident]})

    def close(self) -> None:
        pass


def health(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Per node, how many calls came, how many of the last ones were ok, and whether there has been an incident: a full ring
    with fewer than half ok, or a 429 that asks to wait over 300 seconds. events: node, seq, ok, status, retry_after. With a
    ttl_ms the ring of a node that isn't called for so long is empty again; such a stream runs on the clock and never ends."""
    mode = "none" if ttl_ms is None else "processingTime"
    return events.groupBy("node").transformWithStateInPandas(_Health(ttl_ms), "node string, seen long, ok_of_last long, incident boolean", "update", mode)


class _Near(StatefulProcessor):
    """State of a bucket: the latest time of each title with its ticker, forgotten once nothing can be near it, and of each
    address, which is kept; and the timer that forgets titles where no more rows come. Both are held as digests."""

    KEYS = ["high", "low"]

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "latest binary, timer long")

    def _keep(self, latest: pd.DataFrame, mark: int) -> None:
        ends = (latest["at"] + NEAR_HOURS * 3600) * 1000
        titles = latest["titled"]
        latest = latest[~titles | (ends > mark)]
        timer = max(int(ends[titles].max()), mark + 1) if (titles & (ends > mark)).any() else None
        if timer is not None:
            self.handle.registerTimer(timer)
        if len(latest):
            self.held.update((_packed(latest), timer))
        else:
            self.held.clear()

    def handleInputRows(self, key, rows, timerValues):
        batch = _ordered(rows, ["at", "asset_id"])
        prior = batch.groupby(self.KEYS, sort=False)["at"].shift().to_numpy(dtype=np.float64)
        latest = batch[[*self.KEYS, "titled", "at"]]
        if self.held.exists():
            packed, timer = self.held.get()
            if timer is not None:
                self.handle.deleteTimer(timer)
            held = _unpacked(packed)
            before = batch[self.KEYS].merge(held[[*self.KEYS, "at"]], "left", on=self.KEYS)["at"].to_numpy(dtype=np.float64)
            prior = np.fmax(prior, before)
            latest = pd.concat([held, latest])
        # An address that came before, a title whose latest article is less than some hours older; without one, NaN.
        near = np.where(batch["titled"], batch["at"].to_numpy() < prior + NEAR_HOURS * 3600, ~np.isnan(prior))
        self._keep(latest.groupby([*self.KEYS, "titled"], sort=False)["at"].max().reset_index(), timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame({"asset_id": batch["asset_id"], "titled": batch["titled"], "is_near": near})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.held.exists():
            self._keep(_unpacked(self.held.get()[0]), timerValues.getCurrentWatermarkInMs())
        return iter(())

    def close(self) -> None:
        pass


def near_copies(news: DataFrame, late: str = "4 hours", buckets: int = BUCKETS) -> DataFrame:
    """For each article and rule (url: its address came before; title: its title and ticker came less than some hours
    before) whether it repeats another. Articles without the rule's columns have no row of it; later ones than the
    watermark allows are dropped. news: asset_id, title, ticker, published, url."""
    rules = F.array(F.struct(F.lit("url").alias("rule"), canonical_url(F.col("url")).alias("a"), F.lit("").alias("b")),
                    F.struct(F.lit("title").alias("rule"), normalized_title(F.col("title")).alias("a"), F.col("ticker").alias("b")))
    rows = news.withWatermark("published", late).select("asset_id", "published", F.unix_seconds("published").alias("at"), F.explode(rules).alias("r")).select("asset_id", "published", "at", "r.*")
    rows = rows.filter("a is not null and b is not null")
    # Titles may be whole texts: from here on a key is 120 bits of its SHA-256. Neither a title's form nor the end of an address is ambiguous here.
    digest = F.sha2(F.concat_ws("\0", "rule", "a", "b"), 256)
    high, low = (F.conv(F.substring("key", k, 15), 16, 10).cast("long") for k in (1, 16))
    rows = rows.select("asset_id", "published", "at", (F.col("rule") == "title").alias("titled"), digest.alias("key")).select("asset_id", "published", "at", "titled", high.alias("high"), low.alias("low"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("high", "low"), F.lit(buckets)))
    found = rows.groupBy("bucket").transformWithStateInPandas(_Near(), "asset_id long, titled boolean, is_near boolean", "append", "eventTime")
    return found.select("asset_id", F.when(F.col("titled"), "title").otherwise("url").alias("rule"), "is_near")


class _Status(StatefulProcessor):
    """State: status, when the run started, rows so far. A timer ends a run that takes too long."""

    ENDS = {"end": "SUCCEEDED", "cancel": "CANCELLED"}

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "status string, started long, n long")

    def _row(self, key, status, started, n):
        self.state.update((status, started, n))
        return pd.DataFrame({"run_id": [key[0]], "status": [status], "n": [n]})

    def handleInputRows(self, key, rows, timerValues):
        status, started, n = self.state.get() if self.state.exists() else ("QUEUED", -1, 0)
        for now, command in _ordered(rows, ["second", "seq"])[["second", "command"]].itertuples(index=False):
            now = int(now)
            if status == "RUNNING" and now - started > TIMEOUT_S:
                status = "FAILED_SYSTEM"
            if status in ("QUEUED", "RUNNING"):
                if command == "start" and status == "QUEUED":
                    status, started = "RUNNING", now
                    self.handle.registerTimer((started + TIMEOUT_S) * 1000 + 1000)
                status = self.ENDS.get(command, status)
        yield self._row(key, status, started, n + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        status, started, n = self.state.get()
        if status == "RUNNING":
            yield self._row(key, "FAILED_SYSTEM", started, n + 1)

    def close(self) -> None:
        pass


def run_status(commands: DataFrame, late: str = "1 minute") -> DataFrame:
    """The status of each run as its commands come (run_id, at, seq, command: queue, start, end, cancel): what ends it first
    counts, and a run that has started and not ended after TIMEOUT_S seconds fails. n: how many rows a run has had so far."""
    rows = commands.withWatermark("at", late).withColumn("second", F.unix_seconds("at"))
    return rows.groupBy("run_id").transformWithStateInPandas(_Status(), "run_id string, status string, n long", "update", "eventTime")


def replay(rows: DataFrame, batch: str, build: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, int], None], mode: str, parts: int | None = None) -> None:
    """Runs a stream over rows that come in batches, by the number in a column, each as several files (parts). The stream is ended
    after each batch and goes on from its checkpoint."""
    spark = rows.sparkSession
    parts = parts or max(4, spark.sparkContext.defaultParallelism)
    source, progress = (shared.folder(spark, f"stream-{x}") for x in ("source", "progress"))
    held = shared.stored(rows, "stream-rows")
    schema = held.drop(batch).schema
    with state_store(spark):
        for (number,) in held.select(batch).distinct().orderBy(batch).collect():  # a row a batch
            held.filter(F.col(batch) == number).drop(batch).repartition(parts).write.mode("append").parquet(source)
            stream = build(spark.readStream.schema(schema).parquet(source))
            stream.writeStream.foreachBatch(write).option("checkpointLocation", progress).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def replayed(rows: DataFrame, batch: str, build: Callable[[DataFrame], DataFrame], mode: str, keys: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """The result of ``replay``: of mode append all rows, of mode update each key's last one."""
    spark, kinds = rows.sparkSession, []
    out = shared.folder(spark, "stream-out")

    def write(frame: DataFrame, number: int) -> None:
        kinds.append(frame.schema.toDDL())
        frame.write.mode("overwrite").parquet(f"{out}/batch={number}")

    replay(rows, batch, build, write, mode, parts)
    if not kinds:  # no rows, no batches
        return spark.createDataFrame([], build(rows.drop(batch)).schema)
    found = spark.read.schema(f"{kinds[-1]}, batch long").parquet(out)
    if mode == "append":
        return found.drop("batch")
    rest = [c for c in found.columns if c not in keys and c != "batch"]
    best = found.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("row"))
    return best.select(*keys, "row.*")
