"""Streaming ingest: positions deduplicated by (mmsi, ts), and the live snapshot.

The horizon of the dedup state is the retention of seven days.  The queries
run over the files that are there (``availableNow``), so they equal the batch.
Those over the feed's documents stop halfway and go on from their checkpoint.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.plans.dialect import DUCKDB, SPARK
from tidewake.plans.query import register
from tidewake.plans.scratch import shared_dir, written
from tidewake.sources.feed import feed, write_documents
from tidewake.sources.fixtures import tables, with_tables
from tidewake.streaming.live import STALE_S, ChangeLog, deduplicated, live_changes, run


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of positions from the events' files."""
    raw = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    view = f"events_{uuid.uuid4().hex}"
    raw.createOrReplaceTempView(view)
    return spark.sql(tables(SPARK)["ais"][1].replace("from events", f"from {view}"))


def _table(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """The stream's result, written by the executors to the shared folder; a batch that is run again replaces its own folder."""
    where = f"{shared_dir(spark)}/tidewake/stream-{uuid.uuid4().hex}"
    done: set[str] = set()

    def write(batch: DataFrame, number: int) -> None:
        path = f"{where}/batch-{number:09d}"
        batch.write.mode("overwrite").parquet(path)
        done.add(path)

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{where}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    if not done:
        return spark.createDataFrame([], stream.schema)
    # In complete mode every batch holds the whole result.
    return spark.read.schema(stream.schema).parquet(*(sorted(done)[-1:] if mode == "complete" else sorted(done)))


def stream_ingest_equals_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Times that are one after rounding are one fix, so they are rounded before rows are compared.
    once = deduplicated(positions(spark, sf_dir).select("mmsi", F.round("ts", 3).alias("ts")))
    return _table(spark, once, "append")


def stream_live_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = positions(spark, sf_dir).groupBy("mmsi").agg(F.max(F.struct("ts", "event_id", "lon", "lat")).alias("m"))
    return _table(spark, latest.select("mmsi", F.round("m.ts", 3).alias("ts"), F.round("m.lon", 5).alias("lon"), F.round("m.lat", 5).alias("lat")), "complete")


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The events' positions before and from the middle of their time."""
    register(spark, sf_dir)
    rows = written(spark.sql(tables(SPARK)["ais"][1]), "positions")
    first, last = rows.agg(F.min("ts"), F.max("ts")).first()
    middle = ((first or 0.0) + (last or 0.0)) / 2
    return rows.filter(F.col("ts") < middle), rows.filter(F.col("ts") >= middle)


def feed_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (vessel, millisecond) of the feed's documents, by a stream that stops after half of them and goes on."""
    where = f"{shared_dir(spark)}/tidewake/feed-{uuid.uuid4().hex}"
    log = ChangeLog(spark, f"{where}/out")
    for i, half in enumerate(halves(spark, sf_dir)):
        # The documents of a later fetch have greater names.
        write_documents(half, f"{where}/fetched-{i}")
        deliver(spark, f"{where}/fetched-{i}", f"{where}/documents", f"{i}-")
        fixes = feed(spark, f"{where}/documents", stream=True, lines=True)
        once = deduplicated(fixes).select("mmsi", F.round(F.col("ts") * 1000).cast("long").alias("ms"))
        run(once, log, f"{where}/checkpoint").awaitTermination()
    log.whole()
    return spark.read.schema("mmsi long, ms long").parquet(*(f"{where}/out/batch={n}" for n in log.batches()))


def deliver(spark: SparkSession, source: str, folder: str, prefix: str) -> None:
    """Moves documents into a folder under names with a prefix, as a fetcher does."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path(folder))
    for s in files.listStatus(path(source)):
        if not s.getPath().getName().startswith(("_", ".")):
            files.rename(s.getPath(), path(f"{folder}/{prefix}{s.getPath().getName()}"))


def stream_evicting_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live snapshot of a stream of many batches that stops halfway: state and timers in the state store."""
    where = f"{shared_dir(spark)}/tidewake/snapshot-{uuid.uuid4().hex}"
    log, kind = ChangeLog(spark, f"{where}/out"), "mmsi long, ts double, tie long, lon double, lat double, sog double"
    for half in halves(spark, sf_dir):
        half.withColumnRenamed("event_id", "tie").select("mmsi", "ts", "tie", "lon", "lat", "sog").repartitionByRange(3, "ts").write.mode("append").parquet(f"{where}/in")
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 2).parquet(f"{where}/in")
        run(live_changes(stream), log, f"{where}/checkpoint").awaitTermination()
    return log.snapshot().select("mmsi", F.round("ts", 3).alias("ts"), F.round("lon", 5).alias("lon"), F.round("lat", 5).alias("lat"), "sog")


QUERIES = {f.__name__: f for f in (stream_ingest_equals_batch, stream_live_snapshot, feed_ingest, stream_evicting_snapshot)}
ORACLE = {
    "stream_ingest_equals_batch": with_tables(DUCKDB, ("ais",)) + "select distinct mmsi, round(ts, 3) as ts from ais",
    "stream_live_snapshot": with_tables(DUCKDB, ("ais",)) + "select mmsi, round(ts, 3) as ts, round(lon, 5) as lon, round(lat, 5) as lat from (select *, row_number() over (partition by mmsi order by ts desc, event_id desc) as rn from ais) r where rn = 1",
    "feed_ingest": with_tables(DUCKDB, ("ais",)) + "select distinct mmsi, cast(floor(ts * 1000) as bigint) as ms from ais",
    "stream_evicting_snapshot": with_tables(DUCKDB, ("ais",)) + f"select mmsi, round(ts, 3) as ts, round(lon, 5) as lon, round(lat, 5) as lat, sog from (select *, row_number() over (partition by mmsi order by ts desc, event_id desc) as rn, max(ts) over () as latest from ais) r where rn = 1 and floor(ts * 1000) > floor(latest * 1000) - {STALE_S * 1000}",
}
