"""Streams with state and sinks: the live snapshot with eviction, fan-out, single flight.

The live snapshot's state lies in the state store, a value and a timer a bucket of
vessels (``live_changes``), and what a batch changes is what it writes.  ``Snapshot`` is
the plain form for small fleets: a whole table a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidewake.sources.readers import AHEAD_S

#: Seconds after which a vessel that isn't in a batch leaves the snapshot.
STALE_S = 1800
#: Seconds that event times are moved ahead in a stream: its watermark starts at the epoch, and what isn't after that would go as too late.
CLOCK_S = 100 * 31_557_600
Sink = Callable[[DataFrame, int], None]


def clamped(positions: DataFrame, arrival: str = "arrived") -> DataFrame:
    """A time ahead of the arrival is the arrival."""
    return positions.withColumn("ts", F.when(F.col("ts") > F.col(arrival) + AHEAD_S, F.col(arrival)).otherwise(F.col("ts")))


def deduplicated(positions: DataFrame, days: int = 7) -> DataFrame:
    """The first row of each (mmsi, ts); rows later than the horizon are dropped, as retention drops them.

    Times may be zero or negative, down to ``CLOCK_S`` seconds before the epoch.
    """
    at = positions.filter("mmsi is not null and ts is not null").withColumn("at", F.timestamp_micros((F.col("ts") * 1e6).cast("long") + CLOCK_S * 1_000_000))
    # The time of the watermark is a key, so that keys beyond it leave the state.
    return at.withWatermark("at", f"{days} days").dropDuplicates(["mmsi", "at"]).drop("at")


#: The state store that keeps timers.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FIX = "ts double, tie long, lon double, lat double, sog double"
CHANGE = f"mmsi long, {FIX}, gone boolean"
HELD = pa.schema([("mmsi", pa.int64()), ("ts", pa.float64()), ("tie", pa.int64()), ("lon", pa.float64()), ("lat", pa.float64()), ("sog", pa.float64())])
#: Buckets of vessels: a call of Python and a few of the state store for each, not for each vessel, in a batch.
BUCKETS = 512


class LatestFixes(StatefulProcessor):
    """The latest fixes of a bucket's vessels, and a timer that lets the oldest go when the watermark has passed them.

    Of fixes at one time the greater ``tie`` is the later.  A fix that is no
    later than the one that is known changes nothing.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.fixes = handle, handle.getValueState("fixes", "fixes binary")

    def held(self) -> pd.DataFrame:
        return pa.ipc.open_stream(self.fixes.get()[0]).read_pandas() if self.fixes.exists() else HELD.empty_table().to_pandas()

    def hold(self, fixes: pd.DataFrame, old: pd.DataFrame, fired: bool = False) -> None:
        """Fixes instead of the old ones; the timer stands at the first expiry.  Spark takes one away that fired."""
        before, after = (expiry(x["ts"].min()) if len(x) else None for x in (old, fixes))
        if before is not None and before != after and not fired:
            self.handle.deleteTimer(before)
        if after is not None and after != before:
            self.handle.registerTimer(after)
        if not len(fixes):
            self.fixes.clear()
            return
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, HELD) as w:
            w.write_table(pa.Table.from_pandas(fixes, HELD, preserve_index=False))
        self.fixes.update((sink.getvalue().to_pybytes(),))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        old = self.held()
        best = old.assign(known=True)
        for pdf in rows:
            best = latest(pd.concat([pdf[HELD.names].assign(known=False), best]) if len(best) else pdf[HELD.names].assign(known=False))
        if not best["known"].all():
            self.hold(best[HELD.names], old)
            yield best.loc[~best["known"], HELD.names].assign(gone=False)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        old = self.held()
        gone = old["ts"].map(expiry) <= max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        self.hold(old[~gone], old, fired=True)
        yield old[gone].assign(gone=True)

    def close(self) -> None:
        pass


def latest(fixes: pd.DataFrame) -> pd.DataFrame:
    """Each vessel's latest fix; of equal ones the one that is known."""
    return fixes.sort_values(["mmsi", "ts", "tie", "known"], na_position="first").drop_duplicates("mmsi", keep="last")


def expiry(ts: float) -> int:
    """The time of a fix in whole milliseconds, as the watermark has it."""
    return int(ts * 1000)


def live_changes(positions: DataFrame, stale_s: int = STALE_S, buckets: int = BUCKETS) -> DataFrame:
    """What changes in the live snapshot: each vessel's new latest fix, and those that went.

    A vessel goes when its latest fix is ``stale_s`` behind the latest of all
    fixes; rows that are later than that are dropped, as they would go at once.
    So the snapshot doesn't depend on how the rows are cut into batches.  Sets
    the session's state store to the one that keeps timers, for new streams.
    The state is kept by ``buckets`` of vessels, a number that a checkpoint fixes.
    """
    spark = positions.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    at = positions.filter("mmsi is not null and ts is not null").withColumn("at", F.timestamp_millis((F.col("ts") * 1000).cast("long"))).withWatermark("at", f"{stale_s} seconds")
    bucket = at.withColumn("bucket", F.pmod(F.xxhash64("mmsi"), F.lit(buckets)))
    return bucket.groupBy("bucket").transformWithStateInPandas(LatestFixes(), CHANGE, "Append", "EventTime")


class ChangeLog:
    """A folder a batch of changes, and the snapshot that they give.

    A batch that is run again replaces its own folder; a batch that is missing
    among those that are there is an error, not an emptier snapshot.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def __call__(self, batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def batches(self) -> list[int]:
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return []
        names = [s.getPath().getName() for s in files.listStatus(folder)]
        return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))

    def whole(self, committed: int | None = None) -> int:
        """The last batch (or ``committed``), if none up to it is missing."""
        have = [n for n in self.batches() if committed is None or n <= committed]
        last = committed if committed is not None else max(have, default=-1)
        if have != list(range(last + 1)):
            raise FileNotFoundError(f"batches {sorted(set(range(last + 1)) - set(have))} of {self.path} are missing")
        return last

    def snapshot(self, committed: int | None = None) -> DataFrame:
        """``mmsi, ts, tie, lon, lat, sog`` as of the last batch, or of batch ``committed``; that and all before it must be there."""
        last = self.whole(committed)
        if last < 0:
            return self.spark.createDataFrame([], f"mmsi long, {FIX}")
        rows = self.spark.read.schema(CHANGE + ", batch long").parquet(self.path).filter(F.col("batch") <= last)
        # Within a batch a vessel's fix comes before its going.
        newest = rows.groupBy("mmsi").agg(F.max_by(F.struct("ts", "tie", "lon", "lat", "sog", "gone"), F.struct("batch", "gone")).alias("m"))
        return newest.filter("not m.gone").select("mmsi", "m.ts", "m.tie", "m.lon", "m.lat", "m.sog")


class Snapshot:
    """The latest fix of each vessel; one that a batch lacks stays until it is ``STALE_S`` old."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def read(self, version: int) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.path}/version-{version:09d}")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def __call__(self, batch: DataFrame, number: int) -> None:
        latest = batch.groupBy("mmsi").agg(F.max_by(F.struct("ts", "lon", "lat", "sog"), F.struct("ts", "lon")).alias("m")).select("mmsi", "m.*")
        now = latest.agg(F.max("ts").alias("now"))
        old = self.read(number - 1)
        if old is None and number > 0:
            raise FileNotFoundError(f"version {number - 1} of {self.path} is missing")
        if old is not None:
            stay = old.join(latest.select("mmsi", F.col("ts").alias("new_ts")), "mmsi", "left").crossJoin(F.broadcast(now))
            older = stay.filter("new_ts < ts or new_ts is null and ts >= coalesce(now, ts) - " + str(STALE_S)).select("mmsi", "ts", "lon", "lat", "sog")
            latest = latest.join(older.select("mmsi"), "mmsi", "left_anti").unionByName(older)
        latest.write.mode("overwrite").parquet(f"{self.path}/version-{number:09d}")


class FanOut:
    """Gives each batch to every sink; a sink that fails is dropped and the others go on."""

    def __init__(self, sinks: dict[str, Sink]) -> None:
        self.sinks, self.dropped = dict(sinks), {}

    def __call__(self, batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for name, sink in list(self.sinks.items()):
                try:
                    sink(batch, number)
                except Exception as e:  # any client's failure is its own
                    self.dropped[name] = repr(e)
                    del self.sinks[name]
        finally:
            batch.unpersist()


def run(stream: DataFrame, sink: Sink, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Starts a stream into a sink: over what is there, or ``every`` so often.  With its checkpoint it goes on where it stopped."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def single_flight(requests: DataFrame, running: DataFrame) -> DataFrame:
    """Of the requests (scene, asked) the first of each scene that isn't running."""
    first = requests.groupBy("scene").agg(F.min("asked").alias("asked"))
    return first.join(running.select("scene"), "scene", "left_anti")


def recovered(scenes: DataFrame) -> DataFrame:
    """Scenes that were being processed when the service stopped are to do again."""
    return scenes.withColumn("status", F.when(F.col("status") == "processing", "catalogued").otherwise(F.col("status")))


def swap(analysis: DataFrame, path: str) -> None:
    """Replaces the analyses of the slicks in ``analysis``, and no other.

    The new rows are written before any old ones go, but a folder a slick is
    replaced one after the other; ``publish.Analyses`` swaps all at once.
    """
    analysis.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slick_id").parquet(path)
