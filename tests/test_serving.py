"""What clients read: GeoJSON, evidence, ages, by hand."""

import json

from tidewake.operators import attribution, serving
from tidewake.plans.dialect import SPARK


def test_features_are_geojson(spark):
    rows = spark.createDataFrame([(1, 5.0, 24.123456, 59.5, None, 90.0, 3, 'The "Sea\\Wolf"\n', None)], "mmsi long, ts double, lon double, lat double, sog double, cog double, navstat int, name string, ship_type int")
    (r,) = serving.features(rows).collect()
    assert json.loads(r.feature) == {"type": "Feature", "geometry": {"type": "Point", "coordinates": [24.12346, 59.5]}, "properties": {"mmsi": 1, "ts": 5.0, "sog": None, "cog": 90.0, "navStat": 3, "name": 'The "Sea\\Wolf"\n', "shipType": None}}


def test_sentences_by_hand(spark):
    kind = "min_km double, hit boolean, slow double, med double, n_fixes long, silent_s double, axis double, course double, slow_open double, gap_min double, on_record long, ship_type int"
    rows = [
        (4.26, False, 0.254, 7.26, 9, 3720.0, 10.0, 81.4, 0.129, 61.8, 40, 81),
        (7.0, True, None, None, 1, None, 10.0, None, None, None, None, None),
        (16.04, False, 1.0, 0.0, 2, None, None, 12.0, 0.0, 0.0, 3, 52),
    ]
    cols = attribution.sentences(SPARK, "hit", "ship_type")
    got = spark.createDataFrame(rows, kind).selectExpr(*(f"{x} as {k}" for k, x in cols.items())).collect()
    assert got[0].asDict() == {
        "crossing": "track passes within 4.3 km of origin point", "speed": "25% of fixes < 3 kn (median SOG 7.3 kn)", "gap": "AIS silent 62 min overlapping release window",
        "type": "tanker: prior 1.00", "course": "movement 81° aligns with slick axis ±45°", "behavior": "behaviour: 13% slow in open sea, max AIS gap 62 min (40 fixes on record)",
    }
    assert got[1].asDict() == {
        "crossing": "track crosses slick footprint", "speed": "no speed data recorded", "gap": "single fix (limited temporal tracking)",
        "type": "unknown: prior 0.35", "course": "no axis/heading reference", "behavior": "behaviour: 0% slow in open sea, max AIS gap 0 min (0 fixes on record)",
    }
    assert (got[2].crossing, got[2].gap, got[2].course) == ("track stays 16.0 km from release origin", "no suspicious AIS gaps", "no axis/heading reference") and got[2].type == "reserve: prior 0.40"


def test_ages_by_hand(spark):
    rows = spark.createDataFrame([(None,), (0,), (59,), (60,), (3599,), (3600,), (86399,), (200000,)], "s long")
    assert [r.a for r in rows.selectExpr(f"{serving.time_ago(SPARK, 's')} as a").collect()] == ["—", "just now", "just now", "1m ago", "59m ago", "1h ago", "23h ago", "2d ago"]
