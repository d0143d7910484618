"""Product archives and land files: members of zip archives by range, records of polygon shapefiles.

Archives are listed from their directories alone, and only the members that are
asked for are read, so a product of a gigabyte costs its band.  Paths are ones
that all executors reach (local, S3 or HDFS).
"""

from __future__ import annotations

import struct
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewake.plans.ship import ship
from tidewake.sources.feed import _opened

MEMBERS = "path string, member string, bytes long"
#: A polygon's kinds in a shapefile: plain, with heights, with measures.
POLYGONS = (5, 15, 25)


def _archive(path: str) -> zipfile.ZipFile:
    files, name = _opened(path)
    return zipfile.ZipFile(files.open_input_file(name))


def members(spark: SparkSession, folder: str) -> DataFrame:
    """``path, member, bytes`` of all files in the zip archives of a folder."""
    ship(spark)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for path in pdf.path:
                with _archive(path) as z:
                    yield pd.DataFrame([(path, i.filename, i.file_size) for i in z.infolist() if not i.is_dir()], columns=["path", "member", "bytes"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(folder).select("path").mapInPandas(run, MEMBERS)


def contents(chosen: DataFrame) -> DataFrame:
    """``chosen`` (path, member) with ``content``, read one member at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for path, member in zip(pdf.path, pdf.member, strict=True):
                with _archive(path) as z:
                    yield pd.DataFrame([(path, member, z.read(member))], columns=["path", "member", "content"])

    return chosen.select("path", "member").mapInPandas(run, "path string, member string, content binary")


def measurements(listed: DataFrame) -> DataFrame:
    """``path, member, band``: of each archive the first VV raster by name, else the first one; an archive without any gives no row."""
    name = F.lower(F.element_at(F.split("member", "/"), -1))
    rasters = listed.filter(F.lower("member").rlike(r"(^|/)measurement/[^/]+\.tiff?$")).withColumn("name", name)
    # An archive without a .tiff may have .tif files.
    rank = F.row_number().over(Window.partitionBy("path").orderBy(F.col("name").endswith(".tif"), ~F.col("name").contains("vv"), "member"))
    band = F.when(F.col("name").contains("vv"), "vv").when(F.col("name").contains("vh"), "vh").otherwise("vv")
    return rasters.withColumn("rank", rank).filter("rank = 1").select("path", "member", band.alias("band"))


def calibrations(listed: DataFrame) -> DataFrame:
    """``scene, xml``: the first calibration document of each archive, by the archive's path."""
    documents = listed.filter(F.lower(F.element_at(F.split("member", "/"), -1)).rlike(r"cal.*\.xml$"))
    first = documents.groupBy("path").agg(F.min("member").alias("member"))
    return contents(first).select(F.col("path").alias("scene"), F.col("content").cast("string").alias("xml"))


def polygons(content: bytes) -> Iterator[tuple[int, int, list[tuple[float, float]]]]:
    """(record, part, points) of a polygon shapefile; null shapes have none."""
    code, kind = struct.unpack(">i", content[:4])[0], struct.unpack("<i", content[32:36])[0]
    if code != 9994 or kind not in POLYGONS:
        raise ValueError(f"no polygon shapefile: code {code}, kind {kind}")
    at, end = 100, min(len(content), 2 * struct.unpack(">i", content[24:28])[0])
    while at + 12 <= end:
        record, words = struct.unpack(">2i", content[at : at + 8])
        body = memoryview(content)[at + 8 : at + 8 + 2 * words]
        at += 8 + 2 * words
        if struct.unpack("<i", body[:4])[0] == 0:
            continue
        n_parts, n_points = struct.unpack("<2i", body[36:44])
        starts = [*struct.unpack(f"<{n_parts}i", body[44 : 44 + 4 * n_parts]), n_points]
        flat = struct.unpack(f"<{2 * n_points}d", body[44 + 4 * n_parts : 44 + 4 * n_parts + 16 * n_points])
        for part, (lo, hi) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
            yield record, part, list(zip(flat[2 * lo : 2 * hi : 2], flat[2 * lo + 1 : 2 * hi : 2], strict=True))


def land_rings(spark: SparkSession, folder: str, least: int = 4, least_area: float = 1e-7) -> DataFrame:
    """``file, record, part, hole, ring`` of the shapefiles of a folder: rings of ``least`` points or more and over ``least_area`` square degrees.

    A ring is an array of (k, lon, lat), its first point again at the end as in
    the file; holes run against the clock.  A file is one task.
    """
    ship(spark)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for path, content in zip(pdf.path, pdf.content, strict=True):
                found = [(path, *ring[:2], [{"k": k, "lon": x, "lat": y} for k, (x, y) in enumerate(ring[2])]) for ring in polygons(content)]
                for i in range(0, len(found), 256):
                    yield pd.DataFrame(found[i : i + 256], columns=["file", "record", "part", "ring"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.shp").load(folder).select("path", "content")
    rings = files.mapInPandas(run, "file string, record int, part int, ring array<struct<k: int, lon: double, lat: double>>")
    n = F.size("ring")
    origin = F.get("ring", F.lit(0))
    step = F.zip_with(F.slice("ring", 1, F.greatest(n - 1, F.lit(0))), F.slice("ring", 2, F.greatest(n - 1, F.lit(0))), _cross(origin))
    signed = F.aggregate(step, F.lit(0.0), lambda s, x: s + x) / 2
    return rings.filter(n >= least).withColumn("signed", signed).filter(F.abs("signed") > least_area).select("file", "record", "part", (F.col("signed") > 0).alias("hole"), "ring")


def _cross(origin: Column):
    return lambda a, b: (a.lon - origin.lon) * (b.lat - origin.lat) - (b.lon - origin.lon) * (a.lat - origin.lat)
