"""Drawn paths: tasks follow the number of particles."""

from tidewake import registry
from tidewake.operators import inputs

SF = "/root/testdata/sf0.001"


def test_more_particles_are_more_tasks(spark, monkeypatch):
    want = sorted(registry.QUERIES["decimated_paths"](spark, SF).collect())
    monkeypatch.setattr(inputs, "TASK", 200)
    got = registry.QUERIES["decimated_paths"](spark, SF)
    n = spark.read.parquet(f"{SF}/lineitem.parquet").count() // 200
    assert n > 4 and "hashpartitioning(slick_id" in got._jdf.queryExecution().executedPlan().toString() and f", {n})" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(got.collect()) == want
