"""Each SQL query against DuckDB on the smallest tables, and invariants of the rest."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from tidewake import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as from '{f}'")
    return con


def rows(frame: pd.DataFrame) -> list:
    cell = lambda v: "" if pd.isna(v) else v if isinstance(v, str) else repr(float(v) + 0.0)
    return sorted(tuple(map(cell, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_equals_duckdb(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.sql(registry.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_suspects_are_ranked_without_gaps(spark):
    got = registry.QUERIES["suspect_ranking"](spark, SF).toPandas()
    assert got.score.between(0, 100).all()
    for _, g in got.groupby("slick_id"):
        assert sorted(g["rank"]) == list(range(1, len(g) + 1))
        assert g.sort_values("rank").score.is_monotonic_decreasing


def test_weights_sum_to_one():
    from tidewake.operators.attribution import WEIGHTS

    assert abs(sum(WEIGHTS.values()) - 1) < 1e-12


def test_drift_transport_and_spread():
    import numpy as np

    from tidewake.operators import simulate as S

    uniform = lambda lon, lat, ts: (np.full(len(lon), 5.0), np.zeros(len(lon)), np.ones(len(lon)), np.zeros(len(lon)))
    rng = np.random.default_rng(1)
    out = S.integrate(21.5, 59.5, np.zeros((200, 2)), 0.0, 6, uniform, rng)
    speed = np.hypot(*out[-1][1].mean(axis=0)) / 6 / 1000
    assert 3.2 < speed < 5.2
    still = lambda lon, lat, ts: tuple(np.zeros(len(lon)) for _ in range(4))
    xy = S.integrate(21.5, 59.5, np.zeros((4000, 2)), 0.0, 4, still, rng, diffusion=2.0)[-1][1]
    assert np.sqrt((xy**2).sum(axis=1).mean()) == pytest.approx(np.sqrt(4 * 2.0 * 4 * 3600), rel=0.05)


def test_drift_repeats(spark):
    a, b = (registry.QUERIES["hindcast"](spark, SF).toPandas().sort_values(["id", "hour"]) for _ in range(2))
    assert rows(a) == rows(b) and (a.groupby("id").size() == 19).all()


def test_an_outline_matches_its_patch(spark):
    from tidewake.operators import patches

    got = registry.QUERIES["slick_polygons"](spark, SF).collect()
    sizes = {r.label: r.px for r in registry.QUERIES["component_bands"](spark, SF).collect()}
    assert got and all(r.area_px == sizes[r.label] for r in got)
    line = [(0.0, 0.0), (1.0, 0.0005), (2.0, 0.0), (2.0, 1.0), (0.0, 1.0)]
    assert patches.simplified(line, 0.001) == [(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (0.0, 1.0)]
