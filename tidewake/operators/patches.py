"""Dark patches of the fixture's raster by the tile engine, their features and outlines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.operators import models, tiles
from tidewake.operators.raster import oil_prior
from tidewake.plans.dialect import SPARK
from tidewake.plans.query import register
from tidewake.plans.scratch import written
from tidewake.sources.fixtures import with_tables

#: Square kilometres of a fixture's pixel: 20 m.
PIXEL_KM2 = 0.0004


def scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir)
    return tiles.tiled(spark.sql(with_tables(SPARK, ("sar",)) + "select 'scene' as scene, cast(r as bigint) as r, cast(c as bigint) as c, v from sar"))


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.closed(tiles.dark(scene(spark, sf_dir)))


def label_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dark pixels with the label of their component."""
    return tiles.labelled(mask(spark, sf_dir)).select("r", "c", "label")


def component_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each component's pixels, and whether its area is a slick's."""
    return tiles.sizes(tiles.labelled(mask(spark, sf_dir)), PIXEL_KM2).drop("scene")


def patch_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shape, contrast, edge, texture and surroundings of each patch."""
    return tiles.features(scene(spark, sf_dir), tiles.labelled(mask(spark, sf_dir))).drop("scene")


def outline(pdf: pd.DataFrame) -> pd.DataFrame:
    """The outer ring of a patch: pixel edges between inside and outside, walked from the top left corner."""
    inside = set(zip(pdf.r, pdf.c, strict=True))
    step: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r, c in inside:
        for a, b, out in (((r, c), (r, c + 1), (r - 1, c)), ((r, c + 1), (r + 1, c + 1), (r, c + 1)), ((r + 1, c + 1), (r + 1, c), (r + 1, c)), ((r + 1, c), (r, c), (r, c - 1))):
            if out not in inside:
                step.setdefault(a, []).append(b)
    at = first = min(step)
    ring = [first]
    while True:
        at = step[at].pop(0)
        if at == first:
            break
        ring.append(at)
    x, y = np.array([p[1] for p in ring], float), np.array([p[0] for p in ring], float)
    area = abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2
    return pd.DataFrame({"label": [int(pdf.label.iloc[0])], "ring": [" ".join(f"{int(a)},{int(b)}" for a, b in zip(x, y, strict=True))], "area_px": [float(area)]})


def scanned(pixels: DataFrame, pixel_km2: float, land_km: DataFrame | None = None, model=None) -> DataFrame:
    """Slicks of scenes (scene, r, c, v in decibels, sea only): smoothed, thresholded, closed, labelled, sized, scored and outlined.

    ``land_km`` (scene, r, c, land_km) is looked up at a patch's centre; without a model the prior scores.
    """
    image = written(tiles.lee(tiles.tiled(pixels)), "smooth")
    labels = written(tiles.labelled(tiles.closed(tiles.dark(image))), "patches")
    sized = tiles.sizes(labels, pixel_km2)
    kept = written(labels.join(sized.filter("in_band").select("scene", "label"), ["scene", "label"]), "kept")
    found = tiles.features(image, kept).withColumn("area_km2", F.col("area_px") * pixel_km2)
    centre = kept.groupBy("scene", "label").agg(F.round(F.avg("r")).cast("long").alias("r"), F.round(F.avg("c")).cast("long").alias("c"))
    far = centre.withColumn("land_km", F.lit(None).cast("double")) if land_km is None else centre.join(land_km, ["scene", "r", "c"], "left")
    found = found.join(far.select("scene", "label", F.round("land_km", 2).alias("dist_land_km")), ["scene", "label"])
    prior = oil_prior("area_km2", "contrast_db", "edge_sharpness", "homogeneity", "complexity", "dark_fraction_local", "dist_land_km")
    rings = kept.groupBy("scene", "label").applyInPandas(lambda pdf: outline(pdf).drop(columns="area_px").assign(scene=pdf.scene.iloc[0]), "label long, ring string, scene string")
    return models.score_patches(found, model, prior).join(rings, ["scene", "label"])


def simplified(ring: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """Douglas-Peucker on a closed ring (first point not repeated), from its first point and the one farthest from it."""
    pts = np.array([*ring, ring[0]], float)
    far = int(np.argmax(((pts - pts[0]) ** 2).sum(axis=1)))
    keep = np.zeros(len(pts), bool)
    keep[[0, far, -1]] = True
    todo = [(0, far), (far, len(pts) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d = pts[b] - pts[a]
        rest = pts[a + 1 : b] - pts[a]
        length = float(np.hypot(*d))
        away = np.abs(d[0] * rest[:, 1] - d[1] * rest[:, 0]) / length if length else np.hypot(*rest.T)
        i = int(np.argmax(away))
        if away[i] > tolerance:
            keep[a + 1 + i] = True
            todo += [(a, a + 1 + i), (a + 1 + i, b)]
    return [tuple(p) for p in pts[:-1][keep[:-1]]]


def simplified_rings(rings: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """``rings`` (id, ring) with fewer corners, none farther than ``tolerance`` from the new outline."""

    def run(frames):
        for pdf in frames:
            pdf["ring"] = [[{"lon": x, "lat": y} for x, y in simplified([(p["lon"], p["lat"]) for p in ring], tolerance)] for ring in pdf.ring]
            yield pdf[["id", "ring"]]

    plain = rings.select("id", F.transform("ring", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("ring"))
    return plain.mapInPandas(run, "id long, ring array<struct<lon: double, lat: double>>")


def slick_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_components(spark, sf_dir).groupBy("label").applyInPandas(outline, "label long, ring string, area_px double")


def simple_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners that are left of each slick's footprint at 0.001 degrees."""
    register(spark, sf_dir)
    rings = spark.sql(with_tables(SPARK, ("rings",)) + "select * from rings")
    return simplified_rings(rings).select(F.col("id").cast("long").alias("id"), F.size("ring").alias("corners"))


QUERIES = {f.__name__: f for f in (label_components, component_bands, patch_features, slick_polygons, simple_outlines)}
