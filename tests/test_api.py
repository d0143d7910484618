"""The client's functions on literal rows and on empty tables; formulas by hand."""

import math

import pytest

from tidewake import api
from tidewake.functions import lookups

FIXES = "mmsi long, ts double, lon double, lat double, sog double, cog double, navstat int, event_id long"
VESSELS = "mmsi long, name string, ship_type int, dest string, draught double, imo string, length int, width int"


def km(lon1, lat1, lon2, lat2):
    a = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(a))


@pytest.fixture(scope="module")
def fixes(spark):
    # Still for 20 minutes, silent for an hour, then under way; a missing speed counts as moving.
    rows = [(1, 0.0, 24.0, 59.0, 0.2, 0.0, 1, 1), (1, 600.0, 24.0, 59.0, 0.1, 0.0, 1, 2), (1, 1200.0, 24.0, 59.0, None, 0.0, 0, 3), (1, 4900.0, 24.1, 59.0, 9.0, 90.0, 99, 4), (1, 90000.0, 24.2, 59.1, 11.0, 45.0, 0, 5), (2, 50.0, 25.0, 60.0, 5.0, 0.0, 0, 6)]
    return spark.createDataFrame(rows, FIXES)


@pytest.fixture(scope="module")
def vessels(spark):
    return spark.createDataFrame([(1, "A", 80, " PORT ", 57.0, "", 0, 20), (366000001, "B", 33, "  ", 0.0, "0", 100, 0)], VESSELS)


def test_details(spark, fixes, vessels):
    (d,) = api.vessel_details(fixes, vessels, 1).collect()
    assert (d.type_label, d.imo, d.length, d.width, d.draught, d.destination) == ("Tanker", None, None, 20, 5.7, "PORT")
    assert (d.ts, d.nav_status, d.n_fixes, d.dark_gaps) == (90000.0, "Under way (engine)", 5, 2)
    legs = [km(24.0, 59.0, 24.1, 59.0), km(24.1, 59.0, 24.2, 59.1)]
    assert d.distance_km == round(sum(legs), 3) and d.recent_km == round(legs[1], 3)
    (other,) = api.vessel_details(fixes, vessels, 366000001).collect()
    assert (other.flag, other.imo, other.destination, other.draught, other.n_fixes) == ("United States", None, None, None, None)
    (unknown,) = api.vessel_details(fixes, vessels, 999).collect()
    assert (unknown.flag, unknown.type_label, unknown.name) == ("Unknown (MID 000)", "Unknown", None)


def test_stops_and_tracks(fixes):
    (s,) = api.vessel_stops(fixes, 1).collect()
    assert (s.start_ts, s.minutes) == (0.0, 20.0)
    ts = lambda **k: [r.ts for r in api.vessel_track(fixes, 1, **k).collect()]
    assert ts() == [90000.0] and ts(hours=24) == [4900.0, 90000.0]
    assert ts(from_ts=500, to_ts=1300) == [600.0, 1200.0] and len(ts(from_ts=6000, to_ts=7000)) == 5
    assert api.vessel_track(fixes, 77).count() == 0


def test_live_lists_and_limits(spark, fixes, vessels):
    live = {r.mmsi: r for r in api.vessels_live(fixes, vessels).collect()}
    assert live[1].name == "A" and live[1].ts == 90000.0 and live[2].name is None
    scenes = spark.createDataFrame([(str(i), "n", float(i), "clear", 1.0) for i in range(3)], "product_id string, name string, sensed_start double, status string, size_mb double")
    assert [r.product_id for r in api.scenes(scenes, 0).collect()] == ["2"] and api.scenes(scenes, 9999).count() == 3
    events = spark.createDataFrame([(i,) for i in range(5)], "id long")
    assert [r.id for r in api.event_log(events, 2).collect()] == [4, 3] and api.event_log(events, -5).count() == 1
    slicks = spark.createDataFrame([(1, 5.0), (2, 9.0)], "id long, detected_at double")
    ranked = spark.createDataFrame([(1, 1, 50.0, 2), (1, 2, 70.0, 1)], "slick_id long, mmsi long, score double, rank long")
    assert [(r.id, r.suspects, r.best_score) for r in api.slicks(slicks, ranked).collect()] == [(2, None, None), (1, 2, 70.0)]
    assert [(r.rank, r.type_label) for r in api.slick_detail(ranked, vessels, 1).collect()] == [(1, "Unknown"), (2, "Tanker")]
    assert api.status(fixes, scenes, slicks).first().asDict() == {"positions": 6, "vessels": 2, "last_ts": 90000.0, "scenes": 3, "slicks": 2}


def test_empty_tables(spark, fixes, vessels):
    none, no_vessel = fixes.limit(0), vessels.limit(0)
    assert api.vessels_live(none, no_vessel).count() == 0 and api.vessel_track(none, 1).count() == 0 and api.vessel_stops(none, 1).count() == 0
    assert api.vessel_details(none, no_vessel, 1).first().name is None


def test_any_named_query_over_own_tables(spark, fixes):
    got = {r.mmsi: r for r in api.named(spark, "dark_gaps", ais=fixes).collect()}
    assert (got[1].dark_gaps, got[1].long_gaps, got[2].dark_gaps) == (2, 2, 0)


def test_flag_register():
    assert len(lookups.FLAGS) == 205
    assert {lookups.FLAGS[k] for k in ("366", "367", "368", "369", "338")} == {"United States"}
    assert (lookups.FLAGS["216"], lookups.FLAGS["269"], lookups.FLAGS["310"]) == ("Hungary", "Switzerland", "Bermuda")
