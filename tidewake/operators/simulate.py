"""Particle drift by slick: seeding, midpoint steps with a random walk, hindcast and forecast.

Each slick has its own seeded generator, so results repeat whatever the batches;
the particles of all slicks of a batch are integrated as one array.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tidewake.plans.query import query
from tidewake.operators.drift import DEFLECTION, STEP, STOKES, WINDAGE

METRES, DIFFUSION, PARTICLES = 111_320.0, 1.5, 100
HINDCAST_H, FORECAST_H = 18, 24
Forcing = Callable[[np.ndarray, np.ndarray, float], tuple[np.ndarray, ...]]
OUT = "id long, hour int, lon double, lat double, spread_m double, n long"


@query("drift_slicks", "slicks", "releases")
def slick_rows(d):
    return "select s.id, s.centroid_lon, s.centroid_lat, s.major_axis_km, s.minor_axis_km, s.orientation_deg, s.detected_at, r.age_h from slicks s join releases r on r.id = s.id"


def analytic(lon: np.ndarray, lat: np.ndarray, ts: float) -> tuple[np.ndarray, ...]:
    """Wind and current of the fixture's field."""
    it = ts / 3600
    return 5 + 2 * np.sin((lon - 21.8) / 3.52 + it / 5), -3 + np.cos((lat - 58.9) / 0.9 + it / 7), 0.1 + 0.05 * np.sin(it / 6) + 0.0 * lon, -0.05 + 0.02 * np.cos((lon - 21.8) / 5.28)


def velocity(xy: np.ndarray, ts: float, lon0: float, lat0: float, forcing: Forcing, aspect: float = 1.0, axis: float = 0.0) -> np.ndarray:
    """Current, wind turned to the right by a share that grows with the slick's cross section, and Stokes drift."""
    scale = METRES * np.cos(np.radians(lat0))
    wu, wv, cu, cv = forcing(lon0 + xy[:, 0] / scale, lat0 + xy[:, 1] / METRES, ts)
    cross = np.sin(np.mod(np.abs(np.arctan2(wv, wu) - axis), np.pi))
    share = WINDAGE * (1 + 0.22 * (aspect - 1) * cross)
    turn = -np.radians(DEFLECTION + np.where(np.equal(aspect, 1), 0.0, 7.5 * (cross - 0.5)))
    u = cu + share * (wu * np.cos(turn) - wv * np.sin(turn)) + STOKES * wu
    v = cv + share * (wu * np.sin(turn) + wv * np.cos(turn)) + STOKES * wv
    return np.stack([u, v], axis=1)


def integrate(lon0, lat0, start: np.ndarray, ts, hours: float, forcing: Forcing, rng: np.random.Generator | np.ndarray, backward: bool = False, diffusion: float = DIFFUSION, aspect=1.0, axis=0.0) -> list[tuple[int, np.ndarray]]:
    """(hour, positions in metres) at each full hour; place, time and shape are of all particles or one each, ``rng`` draws the walk or has it, step by step."""
    xy, sign = start.copy(), -1.0 if backward else 1.0
    walk = np.sqrt(2 * diffusion * (0.35 if backward else 1.0) * STEP)
    out = [(0, xy.copy())]
    for step in range(1, int(hours * 3600 / STEP) + 1):
        k1 = velocity(xy, ts, lon0, lat0, forcing, aspect, axis)
        k2 = velocity(xy + sign * k1 * STEP / 2, ts + sign * STEP / 2, lon0, lat0, forcing, aspect, axis)
        xy = xy + sign * k2 * STEP + (walk * (rng[step - 1] if isinstance(rng, np.ndarray) else rng.standard_normal(xy.shape)) if diffusion else 0.0)
        ts = ts + sign * STEP
        if step % (3600 // STEP) == 0:
            out.append((step * STEP // 3600, xy.copy()))
    return out


def seed(major_km: float, minor_km: float, axis: float, n: int, rng: np.random.Generator) -> np.ndarray:
    """Points in the footprint: a rectangle about the centre along the axis."""
    p = (rng.random((n, 2)) - 0.5) * 1000 * np.array([major_km, minor_km])
    c, s = np.cos(axis), np.sin(axis)
    return p @ np.array([[c, s], [-s, c]])


#: Slicks integrated at once.
BATCH = 48


def _run(backward: bool, hours: int, particles: int, salt: int):
    steps = int(hours * 3600 / STEP)

    def batch(pdf: pd.DataFrame) -> pd.DataFrame:
        axis = np.radians(pdf.orientation_deg.to_numpy(float))
        major, minor = pdf.major_axis_km.to_numpy(float), pdf.minor_axis_km.to_numpy(float)
        aspect = np.clip(major / np.maximum(minor, 1e-6), 1, 5)
        starts, walks = [], np.empty((steps, len(pdf), particles, 2))
        for k, slick in enumerate(pdf.id):
            rng = np.random.default_rng([int(slick), salt])
            starts.append(seed(major[k], minor[k], axis[k], particles, rng))
            walks[:, k] = rng.standard_normal((steps, particles, 2))
        each = lambda x: np.repeat(np.asarray(x, float), particles)
        lon, lat = pdf.centroid_lon.to_numpy(float), pdf.centroid_lat.to_numpy(float)
        scale, out = METRES * np.cos(np.radians(lat)), []
        for hour, xy in integrate(each(lon), each(lat), np.concatenate(starts), each(pdf.detected_at), hours, analytic, walks.reshape(steps, -1, 2), backward, aspect=each(aspect), axis=each(axis)):
            xy = xy.reshape(len(pdf), particles, 2)
            m = xy.mean(axis=1)
            spread = np.sqrt(((xy - m[:, None]) ** 2).sum(axis=2).mean(axis=1))
            out.append(pd.DataFrame({"id": pdf.id.to_numpy(), "hour": hour, "lon": lon + m[:, 0] / scale, "lat": lat + m[:, 1] / METRES, "spread_m": spread, "n": particles}))
        return pd.concat(out)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield from (batch(pdf.iloc[i : i + BATCH]) for i in range(0, len(pdf), BATCH))

    return run


def drifted(slicks: DataFrame, backward: bool, hours: int, particles: int = PARTICLES, salt: int = 1) -> DataFrame:
    """Centre and spread of each slick's particles at each hour; slicks are dealt evenly, since little data is much work."""
    n = 2 * slicks.sparkSession.sparkContext.defaultParallelism
    return slicks.repartition(n, "id").mapInPandas(_run(backward, hours, particles, salt), OUT)


def hindcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drifted(slick_rows.run(spark, sf_dir), True, HINDCAST_H, salt=1)


def forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drifted(slick_rows.run(spark, sf_dir), False, FORECAST_H, salt=2)


def analyze_slicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Origin at the snapshot nearest the slick's age, with its spread, and the forecast's last cone."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    ages = slick_rows.run(spark, sf_dir).select("id", "age_h", "major_axis_km", "detected_at")
    near = Window.partitionBy("id").orderBy(F.abs(F.col("hour") - F.col("age_h")), "hour")
    origin = hindcast(spark, sf_dir).join(ages, "id").withColumn("rn", F.row_number().over(near)).filter("rn = 1")
    sigma = F.greatest(F.col("spread_m") / 1000, 0.3 + 0.1 * F.col("major_axis_km"), F.lit(0.5))
    last = forecast(spark, sf_dir).filter(F.col("hour") == FORECAST_H).select("id", F.col("lon").alias("end_lon"), F.col("lat").alias("end_lat"), F.col("spread_m").alias("end_spread_m"))
    return origin.join(last, "id").select("id", F.col("lon").alias("origin_lon"), F.col("lat").alias("origin_lat"), F.round(sigma, 2).alias("sigma_km"), (F.col("detected_at") - F.col("age_h") * 3600).alias("release_ts"), "end_lon", "end_lat", (0.6 * F.col("end_spread_m") / 1000 + F.greatest(0.1 * F.col("major_axis_km"), F.lit(0.1))).alias("cone_km"))


QUERIES = {f.__name__: f for f in (hindcast, forecast, analyze_slicks)}
