"""The position feed as a Spark data source: snapshot documents that a fetcher leaves in a folder, by name.

``spark.readStream.format("position_feed").option("path", folder)`` gives every
fix of every document once: the offset is the name of the last document that was
read, and a restart goes on after it.  A fetcher names documents so that later
ones are greater, and moves them into the folder whole; names that begin with
``_`` or ``.`` are passed over.  Documents of one batch are read in parallel, a
task each.  A document that isn't JSON fails the batch, so nothing is lost
unseen.  The folder is one that driver and executors reach by the same path or
URI (local, S3 or HDFS).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from tidewake.plans.ship import ship
from tidewake.sources.readers import normalised

FEED = "mmsi long, timestamp_ms long, lon double, lat double, sog double, cog double, navstat int, document string"
_ARROW = pa.schema([("mmsi", pa.int64()), ("timestamp_ms", pa.int64()), ("lon", pa.float64()), ("lat", pa.float64()), ("sog", pa.float64()), ("cog", pa.float64()), ("navstat", pa.int32()), ("document", pa.string())])


def _opened(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    path = re.sub(r"^file:/+", "/", path)
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def names(path: str) -> list[str]:
    """The documents of a folder in order; none where it isn't there yet."""
    from pyarrow import fs

    files, folder = _opened(path)
    found = files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(f.base_name for f in found if f.is_file and f.base_name[0] not in "_.")


def fixes(document: dict) -> Iterator[tuple]:
    """The fixes of a document as it has them; what lacks a place has null ones."""
    for feature in document.get("features") or ():
        told, at = feature.get("properties") or {}, (feature.get("geometry") or {}).get("coordinates") or (None, None)
        ms, nav = told.get("timestampExternal"), told.get("navStat")
        place = [float(x) if x is not None else None for x in at[:2]]
        yield told.get("mmsi"), int(ms) if ms is not None else None, *place, *(float(told[k]) if told.get(k) is not None else None for k in ("sog", "cog")), int(nav) if nav is not None else None


class _Documents:
    """Reading of documents; shared by the batch and the stream."""

    def __init__(self, path: str, lines: bool) -> None:
        self.path, self.lines = path, lines

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        files, folder = _opened(self.path)
        with files.open_input_stream(f"{folder.rstrip('/')}/{partition.value}") as f:
            text = f.readall().decode()
        for part in text.splitlines() if self.lines else [text]:
            rows = [(*fix, partition.value) for fix in fixes(json.loads(part))] if part.strip() else []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


class _Batch(_Documents, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return [InputPartition(n) for n in names(self.path)]


class _Stream(_Documents, DataSourceStreamReader):
    def initialOffset(self) -> dict[str, str]:
        return {"last": ""}

    def latestOffset(self) -> dict[str, str]:
        return {"last": max(names(self.path), default="")}

    def partitions(self, start: dict[str, str], end: dict[str, str]) -> list[InputPartition]:
        return [InputPartition(n) for n in names(self.path) if start["last"] < n <= end["last"]]

    def commit(self, end: dict[str, str]) -> None:
        pass

    def stop(self) -> None:
        pass


class PositionFeed(DataSource):
    """Options: ``path``; ``lines`` (true: a document a line)."""

    @classmethod
    def name(cls) -> str:
        return "position_feed"

    def schema(self) -> str:
        return FEED

    def _given(self) -> tuple[str, bool]:
        return self.options["path"], self.options.get("lines", "false").lower() == "true"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(*self._given())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(*self._given())


def feed(spark: SparkSession, path: str, now: Column | float | None = None, stream: bool = False, lines: bool = False) -> DataFrame:
    """``mmsi, ts, lon, lat, sog, cog, navstat, document`` of the folder's documents.

    With ``now`` (seconds), a missing time is now, one ahead of it is clamped,
    and rows without vessel or place or outside the area go; without it a fix
    keeps the time that it has.
    """
    ship(spark)
    spark.dataSource.register(PositionFeed)
    reader = (spark.readStream if stream else spark.read).format("position_feed").option("path", path).option("lines", str(lines).lower())
    rows = reader.load().withColumn("ts", F.col("timestamp_ms") / 1000).select("mmsi", "ts", "lon", "lat", "sog", "cog", "navstat", "document")
    return rows if now is None else normalised(rows, now)


def write_documents(positions: DataFrame, path: str, seconds: float = 3600.0, most: int = 1000) -> None:
    """Positions (``mmsi, ts, lon, lat, sog, cog, navstat``) as snapshot documents, a line each: of ``seconds`` and of ``most`` fixes or so.

    What a fetcher would have left; a file holds documents of one span of time, and later ones have greater names.
    """
    told = F.struct("mmsi", F.floor(F.col("ts") * 1000).cast("long").alias("timestampExternal"), "sog", "cog", F.col("navstat").alias("navStat"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"), told.alias("properties"))
    span = F.floor(F.col("ts") / seconds)
    of_span = positions.select(span.alias("span"), feature.alias("f"))
    n = of_span.groupBy("span").count().select("span", F.greatest(F.ceil(F.col("count") / most), F.lit(1)).cast("int").alias("parts"))
    dealt = of_span.join(n, "span").withColumn("part", F.pmod(F.xxhash64(F.to_json("f")), F.col("parts")))
    text = dealt.groupBy("span", "part").agg(F.collect_list("f").alias("features")).select("span", F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("value"))
    text.repartitionByRange("span").sortWithinPartitions("span").select("value").write.text(path)
