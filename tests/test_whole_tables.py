"""Queries that must answer for every row of their tables."""

from tidewake import registry

SF = "/root/testdata/sf0.001"


def test_nearest_fix_answers_for_all_releases_without_a_nested_loop(spark):
    got = registry.QUERIES["nearest_fix_asof"](spark, SF)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.filter("id % 10 <> 0").count() > 0


def test_opacity_scales_over_all_slicks(spark):
    got = registry.QUERIES["risk_opacity_minmax"](spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/orders.parquet").count()
    assert got._jdf.queryExecution().executedPlan().toString().count("Window") == 0
