"""Releases against tracks in blocks and packs: the plans move no pair, and odd tables give what a plain look gives."""

import math

import numpy as np
import pyarrow as pa
import pytest

from tidewake import registry
from tidewake.operators import meetings, suspects

SF = "/root/testdata/sf0.001"
FIXES = "mmsi long, ts double, lon double, lat double, sog double, event_id long"


@pytest.mark.parametrize("name", ["candidate_vessels", "factor_proximity", "factor_crossing", "factor_speed", "factor_gap", "factor_course", "evidence_text", "evidence_sentences", "nearest_fix_asof"])
def test_pairs_are_not_shuffled(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    pairs = plan.split("CartesianProduct")
    assert len(pairs) == 2 and "Exchange" not in pairs[0] and "SortMergeJoin" not in pairs[0]


def test_fallback_shuffles_a_row_a_release_and_nothing_is_broadcast(spark):
    plan = registry.QUERIES["candidate_fallback"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "BroadcastHashJoin Inner" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("size", [1, 3, 4096])
def test_packs_hold_whole_vessels(monkeypatch, size):
    rows = pa.table({"day": [0] * 7 + [1] * 2, "mmsi": [1, 1, 2, 2, 2, 2, None, None, 3], "ts": [float(i) for i in range(9)]})
    batches = [b for i in range(0, 9, 2) for b in rows.slice(i, 2).to_batches()]
    out = pa.Table.from_batches(list(meetings.packed(["mmsi"], size, ("ts",) * 6)(iter(batches))))
    packs = [pa.ipc.open_stream(d.as_py()).read_all() for d in out["data"]]
    assert pa.concat_tables(packs).equals(rows.combine_chunks()) or pa.concat_tables(packs).to_pydict() == rows.to_pydict()
    assert all(len(set(p["day"].to_pylist())) == 1 for p in packs)
    whose = [(p["day"][0].as_py(), m) for p in packs for m in set(p["mmsi"].to_pylist())]
    assert len(whose) == len(set(whose))


def test_small_tiles_and_packs_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(3)
    n = 400
    fixes = [(int(m), float(t), float(x), float(y), None if t % 7 < 1 else float(s), i) for i, (m, t, x, y, s) in enumerate(zip(rng.integers(1, 9, n), rng.uniform(0, 2e5, n), rng.uniform(22, 26, n), rng.uniform(58, 61, n), rng.uniform(0, 12, n)))]
    releases = [(i, float(x), float(y), float(t), 2.0, 30.0) for i, (x, y, t) in enumerate(zip(rng.uniform(22, 26, 40), rng.uniform(58, 61, 40), rng.uniform(0, 2e5, 40)))]
    rings = [(r[0], [(r[1] + dx, r[2] + dy) for dx, dy in ((-0.3, -0.1), (0.3, -0.1), (0.3, 0.1), (-0.3, 0.1))]) for r in releases]
    frames = spark.createDataFrame(fixes, FIXES), spark.createDataFrame(releases, "id long, olon double, olat double, release_ts double, sigma_km double, orientation_deg double"), spark.createDataFrame(rings, "id long, ring array<struct<lon:double,lat:double>>")
    got = {(r.id, r.mmsi): r for r in suspects.factors(*frames, more=("told",)).collect()}

    def km(a, b, c, d):
        h = math.sin(math.radians(d - b) / 2) ** 2 + math.cos(math.radians(b)) * math.cos(math.radians(d)) * math.sin(math.radians(c - a) / 2) ** 2
        return 2 * 6371 * math.asin(math.sqrt(h))

    want, crossings = set(), 0
    for i, x, y, at, _, _ in releases:
        near = 100 / 110.574, 100 / (111.320 * math.cos(math.radians(y)))
        for m in range(1, 9):
            own = sorted((f for f in fixes if f[0] == m and at - 50400 <= f[1] <= at + 14400 and abs(f[2] - x) <= near[1] and abs(f[3] - y) <= near[0]), key=lambda f: (f[1], f[5]))
            if not own:
                continue
            want.add((i, m))
            r = got[i, m]
            assert r.n_fixes == len(own) and r.min_km == pytest.approx(min(km(x, y, f[2], f[3]) for f in own), abs=1e-9)
            speeds = [f[4] for f in own if f[4] is not None]
            assert r.med == (pytest.approx(float(np.median(speeds))) if speeds else None)
            silent = [(min((b[1] - a[1]) / 5400, 1), -a[1], b[1] - a[1]) for a, b in zip(own, own[1:]) if b[1] - a[1] > 900 and min(b[1], at + 3600) > max(a[1], at - 3600)]
            assert r.best == (max(silent)[0] if silent else None) and r.silent_s == (max(silent)[2] if silent else None)
            assert (r.lon0, r.lon1) == (own[0][2], own[-1][2])
            crossings += bool(r.hit)
    assert want == {k for k in got if k in want} and want and crossings
    monkeypatch.setattr(meetings, "TILE", 64)
    rows = pa.table({k: [f[i] for f in fixes] for i, k in enumerate(("mmsi", "ts", "lon", "lat", "sog", "event_id"))}).sort_by([("mmsi", "ascending"), ("ts", "ascending")])
    edges = suspects.boxed(frames[1]).join(frames[2], "id").toArrow().combine_chunks()
    of = meetings.pairs(("least", "near", "speed", "gap", "crossing", "course", "told"), (), suspects.MARGIN)
    small = pa.Table.from_batches(list(of(edges, rows))).to_pylist()
    assert {(r["id"], r["mmsi"]) for r in small} == want
    for r in small:
        whole = got[r["id"], r["mmsi"]]
        assert all(whole[c] == r[c] for c in r)
