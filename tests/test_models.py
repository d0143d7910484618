"""The risk forests are those of the survey (X8 to X10), end, and their areas are those of ranks."""

import json

import pytest
from pyspark.sql import functions as F

from tidewake.operators import models

SF = "/root/testdata/sf0.001"


def test_forests_are_whole(spark):
    assert (models.CV_TREES, models.GRID_TREES, models.PATCH_TREES) == (300, 400, 300)
    f = models.forest(models.CV_TREES)
    assert (f.getNumTrees(), f.getMaxDepth(), f.getMinInstancesPerNode(), f.getCacheNodeIds()) == (300, 30, 5, True)


def test_folds_are_balanced_by_size():
    got = models.folds({20: 100, 25: 90, 21: 10, 22: 10, 23: 10, 24: 10})
    assert got[20] != got[25] and len(set(got.values())) == 5


@pytest.fixture(scope="module")
def rows(spark):
    # One table for all tests of this module: the features of the smallest data.
    return models.training(spark, SF)


def test_training_rows(spark, rows):
    got = rows.toPandas()
    assert got.cell.is_unique and set(got.target) == {0, 1} and set(got.fold) == set(range(models.FOLDS))
    assert got[got.target == 1].weight.sum() == pytest.approx(got[got.target == 0].weight.sum())
    # A band of longitude lies in one fold.
    assert (got.assign(band=got.lon // 1).groupby("band").fold.nunique() == 1).all()
    assert all("tidewake/training" in f for f in rows.inputFiles())


def rank_area(ps, ys):
    """Area under the curve by the ranks of the positives, ties by their mean rank."""
    order = sorted(range(len(ps)), key=lambda i: ps[i])
    rank, i = [0.0] * len(ps), 0
    while i < len(order):
        j = i
        while j < len(order) and ps[order[j]] == ps[order[i]]:
            j += 1
        for m in order[i:j]:
            rank[m] = (i + j + 1) / 2
        i = j
    n = sum(ys)
    return (sum(r for r, y in zip(rank, ys, strict=True) if y) - n * (n + 1) / 2) / (n * (len(ys) - n))


def test_cross_validation_ends_and_equals_ranks(spark, rows, monkeypatch):
    monkeypatch.setattr(models, "CV_TREES", 20)
    monkeypatch.setattr(models, "TREES_EACH", 8)
    monkeypatch.setattr(models, "training", lambda *_: rows)
    got = {r.fold: r for r in models.risk_cv_auc(spark, SF).collect()}
    assert set(got) == set(range(models.FOLDS)) and sum(r.n_test for r in got.values()) == rows.count()
    test = rows.filter("fold = 0")
    grown = [models.forest(n, seed=models.SEED + i).fit(rows.filter("fold <> 0")) for i, n in enumerate((8, 8, 4))]
    scored = models.scored(test, grown).select("p", "target").collect()
    assert got[0].auc == pytest.approx(rank_area([r.p for r in scored], [r.target for r in scored]), abs=0.01)
    one = grown[0]
    (a, b) = (sorted(x.select("cell", F.round("p", 9).alias("p")).collect()) for x in (models.scored(test, [one]), models._probability(one.setPredictionCol("prediction").setProbabilityCol("probability").transform(test))))
    assert a == b and models.parts(20) == [8, 8, 4]


def test_served_grid_and_importances(spark, rows, monkeypatch):
    monkeypatch.setattr(models, "GRID_TREES", 20)
    monkeypatch.setattr(models, "training", lambda *_: rows)
    grid = models.risk_grid_predict(spark, SF).toPandas()
    assert len(grid) == rows.count() and grid.p.between(0, 1).all() and grid.cell.is_unique
    known = rows.select("cell", "target").toPandas().merge(grid, on="cell")
    assert known[known.target == 1].p.mean() > known[known.target == 0].p.mean() + 0.1
    ranked = models.risk_importances(spark, SF).orderBy("rank").collect()
    assert {r.feature for r in ranked} == set(models.INPUTS) and sum(r.importance for r in ranked) == pytest.approx(1, abs=1e-3)
    assert [r.importance for r in ranked] == sorted((r.importance for r in ranked), reverse=True)


def test_a_fold_without_positives_has_no_area(spark, rows, monkeypatch):
    one = rows.withColumn("target", F.when(F.col("fold") == 3, F.col("target")).otherwise(0))
    monkeypatch.setattr(models, "training", lambda *_: one)
    assert all(r.auc is None for r in models.risk_cv_auc(spark, SF).collect())


def test_patches_are_cross_validated(spark):
    labelled = spark.range(60).selectExpr("concat('p', id) as path", "cast(id % 2 as int) as label", "id as area_px", "1.5 + id % 2 as complexity", "4e0 * (id % 2) as contrast_db", "0.5 as edge_sharpness", "0.6 as homogeneity", "2.0 as elongation", "0.1 as dark_fraction_local", "case when id % 3 = 0 then null else 5e0 end as dist_land_km")
    inputs = [*models.PATCH_INPUTS, "dist_land_km"]
    got = models.patch_cv_f1(labelled, inputs=inputs, trees=5).collect()
    assert len(got) == 5 and sum(r.n_test for r in got) == 60 and all(r.f1 == 1.0 for r in got)
    scored = models.score_patches(labelled, models.train_patches(labelled, inputs, 5), "0.0")
    assert scored.columns == [*labelled.columns, "p"] and scored.filter("(p > 0.5) <> (label = 1)").count() == 0


def test_a_published_forest_is_served(spark, rows, monkeypatch, tmp_path):
    for name in ("CV_TREES", "GRID_TREES"):
        monkeypatch.setattr(models, name, 6)
    where = str(tmp_path / "risk")
    assert models.risk_status(spark, where) == {"trained": False}
    with pytest.raises(FileNotFoundError):
        models.risk_cells(spark, where)
    with pytest.raises(ValueError):
        models.publish_risk(rows.withColumn("target", F.lit(0)), where)
    facts = models.publish_risk(rows, where, history="trial")
    status = models.risk_status(spark, where)
    assert status == {"trained": True, **facts} and status["n_cells"] == rows.count() and status["history"] == "trial" and len(status["auc_folds"]) == 5
    assert sum(status["importances"].values()) == pytest.approx(1, abs=1e-3)
    cells = models.risk_cells(spark, where, min_p=0.3, limit=7).collect()
    assert len(cells) == 7 and [c.p for c in cells] == sorted((c.p for c in cells), reverse=True) and cells[-1].p >= 0.3
    outline = json.loads(cells[0].feature)
    (ring,) = outline["geometry"]["coordinates"]
    assert outline["properties"] == {"p": cells[0].p} and ring[0] == ring[4] and ring[1][0] - ring[0][0] == pytest.approx(0.05, abs=1e-3)
    assert models.risk_cells(spark, where, limit=10**9).count() == rows.count()
