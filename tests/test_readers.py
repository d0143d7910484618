"""Readers on literal documents."""

import json
import math

import numpy as np
import pytest

from tidewake.operators import models
from tidewake.sources import readers

NOW = 1_700_000_000.0


def write(folder, name, doc):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(json.dumps(doc))
    return str(folder)


def feature(mmsi, ms, lon=24.9, lat=59.6, **more):
    return {"geometry": {"coordinates": [lon, lat]}, "properties": {"mmsi": mmsi, "timestampExternal": ms, "sog": 3.5, "cog": 90.0, "navStat": 0, **more}}


def test_positions(spark, tmp_path):
    features = [feature(230000001, NOW * 1000), feature(230000002, NOW * 1000 + 3_600_000), feature(None, NOW * 1000), feature(230000003, None), feature(230000004, NOW * 1000, lon=2.0)]
    features.append({"geometry": {"coordinates": []}, "properties": {"mmsi": 230000005, "timestampExternal": 1}})
    where = write(tmp_path / "ais", "a.json", {"features": features})
    got = {r.mmsi: r.ts for r in readers.positions(spark, where, NOW).collect()}
    assert got == {230000001: NOW, 230000002: NOW, 230000003: NOW}
    write(tmp_path / "ais", "b.json", {"features": [feature(230000009, NOW * 1000 - 5000)]})
    assert readers.positions(spark, where, NOW).count() == 4


def test_vessels_and_empty_documents(spark, tmp_path):
    where = write(tmp_path, "v.json", [{"mmsi": 1, "name": "A", "shipType": 80}, {"name": "no mmsi"}])
    (r,) = readers.vessels(spark, where).collect()
    assert (r.mmsi, r.ship_type, r.length, r.width, r.imo) == (1, 80, 0.0, 0.0, None)
    assert readers.vessels(spark, write(tmp_path / "none", "v.json", [])).count() == 0


def hourly(time, **arrays):
    return {"hourly": {"time": time, **arrays}}


@pytest.mark.parametrize("time", [[1722470400, 1722474000], ["2024-08-01T00:00", "2024-08-01T01:00"]])
def test_met_grid(spark, tmp_path, time):
    # Worked by hand: wind from 270 degrees at 5 m/s blows east; a current of 3.6 km/h with 90 degrees runs west at 1 m/s.
    both = {"wind_speed_10m": [5.0, 10.0], "wind_direction_10m": [270.0, 0.0], "ocean_current_velocity": [3.6], "ocean_current_direction": [90.0]}
    where = write(tmp_path, "p.json", {"latitude": 59.0, "longitude": 22.0, **hourly(time, **both)})
    got = readers.met_grid(spark, where).orderBy("ts").collect()
    assert [(r.lon, r.lat, r.ts) for r in got] == [(22.0, 59.0, 1722470400.0), (22.0, 59.0, 1722474000.0)]
    assert got[0].wind_u == pytest.approx(5) and got[0].wind_v == pytest.approx(0, abs=1e-9)
    assert got[0].cur_u == pytest.approx(-1) and got[0].cur_v == pytest.approx(0, abs=1e-9)
    assert got[1].wind_v == pytest.approx(-10) and got[1].cur_u is None
    other = readers.met_grid(spark, where, currents="to").orderBy("ts").first()
    assert other.cur_u == pytest.approx(1)
    with pytest.raises(ValueError):
        readers.met_grid(spark, where, currents="up")


def test_met_grid_of_two_feeds(spark, tmp_path):
    at = [{"latitude": 59.0, "longitude": 22.0}, {"latitude": 59.0, "longitude": 23.0}, {"latitude": 60.0, "longitude": 22.0}]
    wind = [p | hourly([3600 * i for i in range(3)], wind_speed_10m=[1.0 + j] * (3 - j), wind_direction_10m=[180.0] * 3) for j, p in enumerate(at)]
    sea = [{"latitude": 59.1, "longitude": 22.1} | hourly([0], ocean_current_velocity=[7.2, None], ocean_current_direction=[0.0, 0.0])] * 2
    for folder, doc in (("w", wind), ("s", sea)):
        write(tmp_path / folder, "a.json", doc)
    got = {(r.lon, r.lat, r.ts): r for r in readers.met_grid(spark, str(tmp_path / "w"), str(tmp_path / "s")).collect()}
    assert len(got) == 9  # each point at the three times of the first document
    assert got[22.0, 59.0, 0.0].wind_v == pytest.approx(1) and got[22.0, 60.0, 3600.0].wind_v is None and got[23.0, 59.0, 3600.0].wind_v == pytest.approx(2)
    assert got[22.0, 59.0, 0.0].cur_v == pytest.approx(-2) and got[22.0, 59.0, 3600.0].cur_v is None and got[22.0, 60.0, 0.0].cur_v is None


def test_catalogue_and_slicks(spark, tmp_path):
    doc = {"value": [{"Id": "x", "Name": "S1A_IW_GRDH", "ContentDate": {"Start": "2024-08-01T04:30:00.500Z"}, "ContentLength": 2_500_000, "GeoFootprint": {"coordinates": [[[20, 58], [21, 58], [21, 59], [20, 58]]]}}]}
    (s,) = readers.catalogue(spark, write(tmp_path / "c", "c.json", doc)).collect()
    assert (s.product_id, s.sensed_start, s.size_mb, len(s.footprint)) == ("x", 1722486600.5, 2.5, 4)
    ring = [[24.0, 59.0], [24.2, 59.0], [24.2, 59.1], [24.0, 59.1], [24.0, 59.0]]
    page = {"features": [{"geometry": {"coordinates": [ring]}, "properties": {"id": 7, "slick_timestamp": "2024-08-01T00:00:00+03:00", "cls": 2, "machine_confidence": 0.9, "area": 5.0, "length": 6.0, "s1_scene_id": "S"}}]}
    flat = {"features": [{"geometry": {"coordinates": [[[1.0, 2.0], [1.0, 2.0]]]}, "properties": {"id": 8}}, page["features"][0]]}
    where = write(tmp_path / "s", "1.json", page)
    write(tmp_path / "s", "2.json", flat)
    got = {r.id: r for r in readers.historical_slicks(spark, where).collect()}
    assert got.keys() == {7, 8} and got[7].ts == 1722470400.0
    assert (got[7].centroid_lon, got[7].centroid_lat) == (pytest.approx(24.1), pytest.approx(59.05)) and got[8].centroid_lon == 1.0


def test_patches_tiles_and_models(spark, tmp_path):
    for kind, value in (("oil", 100.0), ("lookalike", -12.0)):
        (tmp_path / kind).mkdir()
        np.save(tmp_path / kind / "a.npy", np.full((3, 4), value))
    got = {r.label: r for r in readers.labelled_patches(spark, str(tmp_path)).collect()}
    assert got[1].db == [pytest.approx(20.0)] * 12 and got[0].db == [-12.0] * 12 and (got[0].h, got[0].w) == (3, 4)
    tiles = spark.createDataFrame([("pos", "s", 0, 8, [1.0, 2.0], [0.0, 1.0])], "kind string, scene string, i int, j int, image array<float>, mask array<float>")
    readers.write_tiles(tiles, str(tmp_path / "tiles"))
    assert readers.read_tiles(spark, str(tmp_path / "tiles")).collect() == tiles.collect()
    rows = spark.range(40).selectExpr("cast(id % 2 as int) as label", "id as area_px", "1.5 + id % 2 as complexity", "4e0 * (id % 2) as contrast_db", "0.5 as edge_sharpness", "0.6 as homogeneity", "2.0 as elongation", "0.1 as dark_fraction_local")
    with pytest.raises(ValueError):
        models.train_patches(rows.limit(10))
    assert models.load_model(spark, str(tmp_path / "none")) == (None, {})
    models.save_model(models.train_patches(rows), str(tmp_path / "m"), version="1")
    model, facts = models.load_model(spark, str(tmp_path / "m"))
    scored = models.score_patches(rows, model, "0.0").collect()
    assert facts == {"version": "1"} and all((r.p > 0.5) == (r.label == 1) for r in scored)
    assert models.score_patches(rows, None, "0.25").first().p == 0.25


def test_settings():
    s = readers.Settings.from_env({"POLL_S": "5", "PARTICLES": "600", "OTHER": "x"})
    assert (s.poll_s, s.particles, s.data_dir) == (5.0, 600, "data") and math.isclose(s.retention_days, 7)
