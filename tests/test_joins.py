"""As-of joins, calibration, clipping, met windows and areas on rows worked by hand or by brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tidewake.operators import asof, calibrate, clip, dedup, raster


@pytest.mark.parametrize("span", [10.0, 1e9])
def test_nearest_equals_brute_force(spark, span):
    rng = random.Random(1)
    fixes = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None, *(float(rng.randint(-50, 400)) for _ in range(9))]), i, f"f{i}") for i in range(300)]
    fixes += [(4, 5000.0, 900, "far"), (1, 20.0, 901, "x"), (1, 20.0, 899, "y")]
    asked = [(i, rng.choice([1, 2, 3, 4, 5, None]), float(rng.randint(-100, 500))) for i in range(120)] + [(500, 1, 20.0), (500, 1, 20.0), (501, 1, None)]
    got = asof.nearest(spark.createDataFrame(asked, "id long, k long, t double").withColumn("_more", F.lit("x")), spark.createDataFrame(fixes, "k long, ts double, n long, name string"), "k", "t", "ts", ["n"], ["name", "n"], span)

    def want(k, t):
        near = [(abs(f[1] - t), f[1], f[2], f[3]) for f in fixes if k is not None and t is not None and f[0] == k and f[1] is not None]
        return min(near)[1:] if near else None

    key = lambda r: str(r)
    assert sorted(((r.id, r.k, r.t, (r.fix.ts, r.fix.n, r.fix.name) if r.fix else None) for r in got.collect()), key=key) == sorted(((*a, want(a[1], a[2])) for a in asked), key=key)


def document(*vectors):
    rows = "".join(f"<calibrationVector><line>{line}</line><pixel>{pixel}</pixel><sigmaNought>{sigma}</sigmaNought></calibrationVector>" for line, pixel, sigma in vectors)
    return f"<calibration>{rows}</calibration>"


def test_calibration_by_hand(spark):
    docs = spark.createDataFrame([("a", document((600, "0 10 20", "20 30 0"), (10, "0 10 20", "100 200 400"))), ("b", document((0, "5", "2")))], "scene string, xml string")
    rows = [(1, "a", 10, 5.0, 150.0), (2, "a", 599, 25.0, 40.0), (3, "a", 600, 0.0, 20.0), (4, "a", 5000, 20.0, 9.0), (5, "a", 9, 5.0, 9.0), (6, "b", 3, 99.0, 20.0), (7, "c", 3, 1.0, 1.0), (8, "a", 20, 0.0, 0.0), (9, "a", 20, 0.0, 1e-9), (10, "a", None, 0.0, 1.0)]
    got = {r.id: (r.lut, r.db) for r in calibrate.calibrated(spark.createDataFrame(rows, "id int, scene string, line int, pixel double, dn double"), calibrate.luts(docs)).collect()}
    assert got[1] == (150.0, 0.0) and got[2] == (400.0, pytest.approx(-20.0)) and got[3] == (20.0, 0.0)
    assert got[4] == got[5] == got[7] == got[10] == (None, None)  # a table value of 0, before the first vector, no document, no line
    assert got[6] == (2.0, pytest.approx(20.0)) and got[8] == (100.0, None) and got[9] == (100.0, pytest.approx(-80.0))


def ring(*points):
    return F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points))


@pytest.mark.parametrize(("points", "want"), [
    (((0, 0), (2, 0), (2, 2), (0, 2)), 1.0),  # a corner of a square
    (((0, 1), (1, 0), (2, 1), (1, 2)), 0.5),  # a rotated square
    (((5, 5), (6, 5), (6, 6), (5, 6)), 0.0),  # apart
    (((-9, -9), (9, -9), (9, 9), (-9, 9)), 1.0),  # the box within
    (((1.2, 1.2), (1.8, 1.2), (1.8, 1.8), (1.2, 1.8)), 0.36),  # within the box
])
def test_clip_by_hand(spark, points, want):
    box = tuple(F.lit(float(v)) for v in (1, 1, 2, 2))
    for given in (points, points[::-1]):
        cut = spark.range(1).select(clip.clip_to_box(ring(*given), box).alias("r")).select("r", clip.area(F.col("r")).alias("a")).first()
        assert cut.a == pytest.approx(want) and all(1 <= p.x <= 2 and 1 <= p.y <= 2 for p in cut.r)
    assert spark.range(1).select(clip.area(clip.clip_to_box(F.array().cast("array<struct<x: double, y: double>>"), box)).alias("a")).first().a == 0


def test_areas_by_hand(spark):
    rows = [(0, 0.1, 0), (0, 0.4, 0), (0, 0.35, 1), (0, 0.8, 1), (1, 0.5, 1), (1, 0.5, 0), (2, 0.5, 1), (3, 1.0, 1), (3, 1.0, 1), (3, 1.0, 0), (3, -7.0, 0), (0, None, 1)]
    for ranges in (1, 3, 256):
        got = {r.fold: r.auc for r in raster.areas(spark.createDataFrame(rows, "f int, s double, y int"), "f", "s", "y", ranges).collect()}
        assert got == {0: pytest.approx(0.75), 1: 0.5, 2: None, 3: pytest.approx(0.75)}


def test_a_window_takes_the_live_field_the_dates_or_constants(spark):
    from tidewake.operators.inputs import met_window

    day = 86400.0
    met = [(0, 0, 40 * day - 3600, 2.0, 0.0, 0.0, 0.0), (0, 0, 40 * day, 4.0, 0.0, 0.0, 0.0), (1, 0, 3.5 * day, 8.0, 1.0, 0.0, 0.0), (1, 0, 5 * day, 100.0, 1.0, 0.0, 0.0)]
    tables = {
        "met_obs": spark.createDataFrame(met, "ix long, iy long, ts double, wind_u double, wind_v double, cur_u double, cur_v double"),
        "met_windows": spark.createDataFrame([(1, 40 * day - 1800, 40 * day), (2, 3.9 * day, 3.95 * day), (3, 9 * day, 9.1 * day), (4, 39 * day, 41 * day)], "id long, t0 double, t1 double"),
        "met_points": spark.createDataFrame([(0, 0), (1, 0)], "ix long, iy long"),
    }
    got = {(r.id, r.ix): (r.source, r.hours, r.wind_u) for r in met_window.over(spark, **tables).collect()}
    assert got == {
        (1, 0): ("live", 1, 4.0), (1, 1): ("live", 0, 0.0),
        (2, 0): ("dates", 0, 0.0), (2, 1): ("dates", 1, 8.0),
        (3, 0): ("constant", 0, 5.0), (3, 1): ("constant", 0, 5.0),
        (4, 0): ("dates", 2, 3.0), (4, 1): ("dates", 0, 0.0),
    }


def test_detections_of_a_batch_take_those_that_come_after(spark):
    rng = random.Random(4)
    place = lambda: (round(24 + rng.randint(0, 60) / 1000, 3), round(59 + rng.randint(0, 40) / 1000, 3))
    slicks = [(i, f"s{i % 2}", *place()) for i in range(6)]
    batch = [(100 + i, f"s{i % 3}", *place()) for i in range(150)]
    got = {r.n: (r.target, r.first, r.inserted) for r in dedup.absorbed(spark.createDataFrame(slicks, "id long, scene string, lon double, lat double"), spark.createDataFrame(batch, "n long, scene string, lon double, lat double").repartition(3)).collect()}
    there, want = [(s, lon, lat, i, None) for i, s, lon, lat in slicks], {}
    for n, scene, lon, lat in batch:
        hit = next((t for t in there if t[0] == scene and lon - 0.01 <= t[1] <= lon + 0.01 and lat - 0.01 <= t[2] <= lat + 0.01), None)
        want[n] = (hit[3], hit[4], False) if hit else (None, None, True)
        if not hit:
            there.append((scene, lon, lat, None, n))
    assert got == want and any(w[1] for w in want.values())
