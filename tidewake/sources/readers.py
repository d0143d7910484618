"""Readers of the feeds' documents, from files: positions, vessels, met arrays, catalogue, historical slicks, patches, tiles.

Fetching is not part of the engine; whatever fetches leaves the documents in a
folder, and these read them in parallel, or as a stream where that is said.
"""

from __future__ import annotations

import io
import os
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.sources import images
from tidewake.sources.fixtures import AOI

POSITIONS = "features array<struct<geometry: struct<coordinates: array<double>>, properties: struct<mmsi: long, timestampExternal: long, sog: double, cog: double, navStat: int>>>"
VESSELS = "mmsi long, name string, shipType int, destination string, draught double, imo string, callSign string, length double, width double"
HOURLY = "latitude double, longitude double, hourly struct<time: array<string>, wind_speed_10m: array<double>, wind_direction_10m: array<double>, ocean_current_velocity: array<double>, ocean_current_direction: array<double>>"
CATALOGUE = "value array<struct<Id: string, Name: string, ContentDate: struct<Start: string>, ContentLength: long, GeoFootprint: struct<coordinates: array<array<array<double>>>>>>"
SLICKS = "features array<struct<geometry: struct<coordinates: array<array<array<double>>>>, properties: struct<id: long, slick_timestamp: string, cls: int, machine_confidence: double, area: double, length: double, s1_scene_id: string>>>"
#: Seconds that a position may be ahead of the clock.
AHEAD_S = 60


@dataclass(frozen=True)
class Settings:
    """What a deployment sets; each field by an environment variable of its name in capitals."""

    data_dir: str = "data"
    poll_s: float = 30.0
    retention_days: float = 7.0
    hindcast_h: float = 18.0
    forecast_h: float = 24.0
    particles: int = 100

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        env = dict(os.environ) if env is None else env
        kinds = {"str": str, "float": float, "int": int}
        return cls(**{f.name: kinds[f.type](env[f.name.upper()]) for f in fields(cls) if f.name.upper() in env})


def normalised(rows: DataFrame, now: Column | float) -> DataFrame:
    """Rows with a vessel, a place and a time not ahead of ``now``; a missing time is now; within the area."""
    now = now if isinstance(now, Column) else F.lit(float(now))
    ts = F.coalesce("ts", now)
    known = rows.filter("mmsi is not null and mmsi <> 0 and lon is not null and lat is not null").withColumn("ts", F.when(ts > now + AHEAD_S, now).otherwise(ts))
    return known.filter(F.col("lon").between(AOI[0], AOI[2]) & F.col("lat").between(AOI[1], AOI[3]))


def positions(spark: SparkSession, path: str, now: Column | float, stream: bool = False) -> DataFrame:
    """``mmsi, ts, lon, lat, sog, cog, navstat`` of GeoJSON snapshots."""
    reader = (spark.readStream if stream else spark.read).schema(POSITIONS).option("multiLine", True)
    f = reader.json(path).select(F.explode("features").alias("f")).select("f.properties.*", F.col("f.geometry.coordinates").alias("at"))
    rows = f.select("mmsi", (F.col("timestampExternal") / 1000).alias("ts"), F.get("at", F.lit(0)).alias("lon"), F.get("at", F.lit(1)).alias("lat"), "sog", "cog", F.col("navStat").alias("navstat"))
    return normalised(rows, now)


def vessels(spark: SparkSession, path: str) -> DataFrame:
    """Metadata of vessels from arrays of objects; missing lengths and widths are 0."""
    rows = spark.read.schema(VESSELS).option("multiLine", True).json(path).filter("mmsi is not null")
    return rows.select("mmsi", "name", F.col("shipType").alias("ship_type"), F.col("destination").alias("dest"), "draught", "imo", F.col("callSign").alias("call_sign"), F.coalesce("length", F.lit(0.0)).alias("length"), F.coalesce("width", F.lit(0.0)).alias("width"))


def uv(speed: Column, direction: Column) -> tuple[Column, Column]:
    """Components of a flow from a direction FROM which it comes, in degrees."""
    return -speed * F.sin(F.radians(direction)), -speed * F.cos(F.radians(direction))


def seconds(text: Column) -> Column:
    """Epoch seconds of a feed's time: a number, or a text of a time in UTC."""
    stated = F.coalesce(F.try_to_timestamp(F.concat(text, F.lit("Z"))), F.try_to_timestamp(text))
    return F.coalesce(text.try_cast("double"), F.unix_timestamp(stated).cast("double"))


def met_grid(spark: SparkSession, path: str, marine: str | None = None, currents: str = "from") -> DataFrame:
    """``lon, lat, ts, wind_u, wind_v, cur_u, cur_v`` in m/s from documents of the forecast, one or an array of one a point.

    ``marine`` is the folder of the currents' documents, which go with the
    forecast's file of the same name by position; None: the documents hold both.
    Winds are in m/s, currents in km/h.  Directions are those from which a flow
    comes; ``currents="to"`` says that the feed's currents go to theirs.  The
    first document's times serve all of its file; arrays that end early give nulls.
    """
    if currents not in ("from", "to"):
        raise ValueError("currents must be from or to")

    def documents(folder: str) -> DataFrame:
        files = spark.read.option("wholetext", True).text(folder).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.trim("value").alias("value"))
        listed = F.when(F.col("value").startswith("["), F.col("value")).otherwise(F.concat(F.lit("["), "value", F.lit("]")))
        return files.select("file", F.from_json(listed, f"array<struct<{HOURLY.replace('latitude double, longitude double, hourly ', 'latitude: double, longitude: double, hourly: ')}>>").alias("docs"))

    winds = documents(path).select("file", "docs", F.get("docs", F.lit(0)).hourly.time.alias("times"))
    both = winds.withColumn("sea", F.col("docs")) if marine is None else winds.join(documents(marine).select("file", F.col("docs").alias("sea")), "file", "left")
    point = both.select("times", "sea", F.posexplode("docs").alias("i", "wind")).select("times", "wind", F.get("sea", F.col("i")).alias("sea"))
    hours = point.select("wind", "sea", F.posexplode("times").alias("k", "time")).filter("time is not null")

    def at(c: str) -> Column:
        return F.get(F.col(c), F.col("k"))

    turn = 0 if currents == "from" else 180
    (wu, wv), (cu, cv) = uv(at("wind.hourly.wind_speed_10m"), at("wind.hourly.wind_direction_10m")), uv(at("sea.hourly.ocean_current_velocity") / 3.6, at("sea.hourly.ocean_current_direction") + turn)
    return hours.select(F.col("wind.longitude").alias("lon"), F.col("wind.latitude").alias("lat"), seconds(F.col("time")).alias("ts"), wu.alias("wind_u"), wv.alias("wind_v"), cu.alias("cur_u"), cv.alias("cur_v"))


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Scenes of catalogue answers, with the outline of their footprint."""
    v = spark.read.schema(CATALOGUE).option("multiLine", True).json(path).select(F.explode("value").alias("v")).select("v.*")
    start = F.unix_micros(F.to_timestamp("ContentDate.Start")) / 1e6
    return v.select(F.col("Id").alias("product_id"), F.col("Name").alias("name"), start.alias("sensed_start"), (F.col("ContentLength") / 1e6).alias("size_mb"), F.get("GeoFootprint.coordinates", F.lit(0)).alias("footprint"))


def centroid(ring: Column) -> tuple[Column, Column]:
    """Centroid of a closed ring of [lon, lat] by signed areas; of a ring without area the mean of its points."""
    n = F.size(ring)
    pairs = F.zip_with(F.slice(ring, 1, n - 1), F.slice(ring, 2, n - 1), lambda a, b: F.struct(a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2")))
    cross = lambda p: p["x1"] * p["y2"] - p["x2"] * p["y1"]
    total = lambda f: F.aggregate(pairs, F.lit(0.0), lambda s, p: s + f(p))
    mean = lambda i: F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[i]) / n
    area = total(cross)
    return tuple(F.coalesce(F.try_divide(total(lambda p, i=i: (p[f"{'xy'[i]}1"] + p[f"{'xy'[i]}2"]) * cross(p)), 3 * area), mean(i)) for i in (0, 1))


def historical_slicks(spark: SparkSession, path: str) -> DataFrame:
    """Slicks of GeoJSON pages; a slick that two pages hold counts once."""
    f = spark.read.schema(SLICKS).option("multiLine", True).json(path).select(F.explode("features").alias("f")).select("f.properties.*", F.get("f.geometry.coordinates", F.lit(0)).alias("ring"))
    lon, lat = centroid(F.col("ring"))
    # Whatever zone the text names, its clock time is UTC.
    ts = F.unix_micros(F.to_timestamp(F.concat(F.regexp_replace("slick_timestamp", "(Z|[+-][0-9]{2}:?[0-9]{2})$", ""), F.lit("Z")))) / 1e6
    return f.filter("id is not null").dropDuplicates(["id"]).select("id", ts.alias("ts"), "cls", F.col("machine_confidence").alias("confidence"), F.col("area").alias("area_m2"), F.col("length").alias("length_m"), F.round(lon, 5).alias("centroid_lon"), F.round(lat, 5).alias("centroid_lat"), F.col("s1_scene_id").alias("s1_scene"))


def labelled_patches(spark: SparkSession, folder: str) -> DataFrame:
    """``path, label, h, w, db`` of .npy, .png and .tif crops under ``oil`` (1) and ``lookalike`` (0); digital numbers become decibels."""
    how = {".npy": lambda b: np.load(io.BytesIO(b), allow_pickle=False), ".png": images.png, ".tif": images.tiff, "tiff": images.tiff}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for path, content in zip(pdf.path, pdf.content, strict=True):
                img = how[path[-4:].lower()](content).astype(np.float32)
                if img.size and img.max() > 0 and img.min() >= 0:
                    img = 10 * np.log10(np.maximum(img, 1e-3))
                out.append((path, int("/oil/" in path), *img.shape[-2:], img.ravel()))
            yield pd.DataFrame(out, columns=["path", "label", "h", "w", "db"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{npy,png,tif,tiff,NPY,PNG,TIF,TIFF}").load(folder)
    return files.select("path", "content").mapInPandas(run, "path string, label int, h int, w int, db array<float>")


def write_tiles(tiles: DataFrame, path: str) -> None:
    """Training tiles (kind, scene, i, j, image, mask) by kind, so that a sampler reads one kind alone."""
    tiles.write.mode("overwrite").option("compression", "zstd").partitionBy("kind").parquet(path)


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("kind string, scene string, i int, j int, image array<float>, mask array<float>").parquet(path).select("kind", "scene", "i", "j", "image", "mask")
