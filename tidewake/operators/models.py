"""Risk models: forest over grid features, folds by longitude band, probabilities of cells."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from multiprocessing.pool import ThreadPool
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from tidewake.operators.grid import risk_features, target_grid
from tidewake.operators.serving import clamped
from tidewake.plans.scratch import shared_dir, written
from tidewake.sources.fixtures import CELL

INPUTS = ["shore_km", "density", "lane_km", "terminal_km", "lat", "lon"]
FOLDS, SEED = 5, 7
#: Trees of a fold's forest and of the served one.
CV_TREES, GRID_TREES = 300, 400
#: Cells with slicks that a served forest needs.
LEAST_POSITIVE = 30
#: Trees that are grown in one go; a forest's others grow at the same time, with other seeds.
TREES_EACH = 50
T = TypeVar("T")


def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sea cells with features, target, class weight and fold, as a table in the shared folder; one action counts classes and bands."""
    from pyspark.ml.feature import VectorAssembler

    joined = risk_features.run(spark, sf_dir).join(target_grid.run(spark, sf_dir), "cell").fillna(50.0, ["lane_km"])
    rows = written(joined.withColumn("band", F.floor("lon").cast("int")), "risk-rows")
    bands = {r.band: (r.n, r.positive) for r in rows.groupBy("band").agg(F.count("*").alias("n"), F.sum("target").alias("positive")).collect()}  # 360 at most
    share = sum(b[1] for b in bands.values()) / max(sum(b[0] for b in bands.values()), 1) or 0.5
    # Both classes weigh alike in total.
    weight = F.when(F.col("target") == 1, 0.5 / max(share, 1e-6)).otherwise(0.5 / max(1 - share, 1e-6))
    fold = folds({b: n for b, (n, _) in bands.items()})
    known = F.element_at(F.create_map(*(F.lit(x) for item in fold.items() for x in item)), F.col("band")) if fold else F.lit(0)
    rows = VectorAssembler(inputCols=INPUTS, outputCol="features").transform(rows.withColumn("weight", weight).withColumn("fold", known))
    return written(rows.select("cell", "lon", "lat", "target", "weight", "fold", "features"), "training")


def folds(sizes: dict[int, int]) -> dict[int, int]:
    """Fold of each longitude band (360 at most): the largest band first, each to the fold with fewest rows."""
    held, out = [0] * FOLDS, {}
    for band in sorted(sizes, key=lambda b: (sizes[b], b), reverse=True):
        out[band] = held.index(min(held))
        held[out[band]] += sizes[band]
    return out


def forest(trees: int, label: str = "target", leaf: int = 5, seed: int = SEED):
    """A forest whose levels look up each row's nodes in a cached column, not in trees that are sent along.

    The cache's lineage is cut by checkpoints every ten levels, in the session's checkpoint folder.
    """
    from pyspark.ml.classification import RandomForestClassifier

    return RandomForestClassifier(labelCol=label, weightCol="weight", numTrees=trees, minInstancesPerNode=leaf, maxDepth=30, seed=seed, cacheNodeIds=True, checkpointInterval=10, maxMemoryInMB=256)


def checkpointed(spark: SparkSession) -> None:
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def side_by_side(spark: SparkSession, n: int, of_one: Callable[[int], T]) -> list[T]:
    """Results for 0 to n - 1; their jobs run at the same time, since the levels of one forest are many and small."""
    with ThreadPool(max(1, min(n, spark.sparkContext.defaultParallelism))) as pool:
        return pool.map(inheritable_thread_target(spark)(of_one), range(n), chunksize=1)


def parts(trees: int) -> list[int]:
    """The trees of the forests that make one forest together: ``TREES_EACH``, and the rest in the last."""
    return [min(TREES_EACH, trees - i) for i in range(0, trees, TREES_EACH)]


def scored(rows: DataFrame, grown: list) -> DataFrame:
    """``p``: the mean of all trees' probabilities, from forests with their own numbers of trees."""
    from pyspark.ml.functions import vector_to_array

    out = rows
    for i, model in enumerate(grown):
        out = model.setProbabilityCol(f"p_{i}").setPredictionCol("").setRawPredictionCol("").transform(out)
    trees = sum(m.getNumTrees for m in grown)
    mean = sum((F.element_at(vector_to_array(f"p_{i}"), 2) * m.getNumTrees for i, m in enumerate(grown)), F.lit(0.0)) / trees
    return out.select(*rows.columns, mean.alias("p"))


def fold_areas(rows: DataFrame) -> list[tuple[int, int, int, float | None]]:
    """(fold, rows, positives, area under the curve) by models of the other folds; no area where a side lacks a class."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    spark, score = rows.sparkSession, BinaryClassificationEvaluator(labelCol="target", rawPredictionCol="p")
    checkpointed(spark)
    held = {r.fold: (r.n, r.positive) for r in rows.groupBy("fold").agg(F.count("*").alias("n"), F.sum("target").alias("positive")).collect()}
    n, positive = (sum(h[i] for h in held.values()) for i in (0, 1))
    whole = [k for k, (size, own) in held.items() if 0 < own < size and 0 < positive - own < n - size]
    todo = [(k, i, trees) for k in whole for i, trees in enumerate(parts(CV_TREES))]
    grown = side_by_side(spark, len(todo), lambda j: forest(todo[j][2], seed=SEED + todo[j][1]).fit(rows.filter(F.col("fold") != todo[j][0])))
    areas = {k: float(score.evaluate(scored(rows.filter(F.col("fold") == k), [g for g, t in zip(grown, todo, strict=True) if t[0] == k]))) for k in whole}
    return [(k, *held.get(k, (0, 0)), areas.get(k)) for k in range(FOLDS)]


def risk_cv_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area under the curve of each fold, by a model of the other folds; null where a side lacks a class."""
    return spark.createDataFrame(fold_areas(training(spark, sf_dir)), "fold int, n_test long, positive long, auc double")


def grown_on(rows: DataFrame) -> list:
    """The served forest, in parts."""
    checkpointed(rows.sparkSession)
    trees = parts(GRID_TREES)
    return side_by_side(rows.sparkSession, len(trees), lambda i: forest(trees[i], seed=SEED + i).fit(rows))


def served(spark: SparkSession, sf_dir: str) -> tuple[list, DataFrame]:
    """The served forest and the rows that it was fitted on."""
    rows = training(spark, sf_dir)
    return grown_on(rows), rows


def risk_grid_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of each sea cell, in sample as the served grid is."""
    grown, rows = served(spark, sf_dir)
    return scored(rows, grown).select("cell", F.round("lon", 4).alias("lon"), F.round("lat", 4).alias("lat"), F.round("p", 4).alias("p"))


def importances(grown: list, names: list[str]) -> list[tuple[str, float]]:
    """Inputs of a forest by importance, the highest first; they sum to 1."""
    mean = sum(m.featureImportances.toArray() * m.getNumTrees for m in grown) / sum(m.getNumTrees for m in grown)
    found = zip(names, mean.tolist(), strict=True)
    return sorted(((n, round(x, 4)) for n, x in found), key=lambda f: (-f[1], f[0]))


def risk_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance of each input of the served forest, by rank."""
    ranked = importances(served(spark, sf_dir)[0], INPUTS)
    return spark.createDataFrame([(i, *f) for i, f in enumerate(ranked, 1)], "rank int, feature string, importance double")


def publish_risk(rows: DataFrame, path: str, history: str = "") -> dict[str, object]:
    """Fits the served forest on training rows and writes it, the cells' probabilities and the facts on it, in that order.

    A folder is of one training; what serves it looks at the facts first, so it
    sees nothing of one that failed.  Refuses fewer than ``LEAST_POSITIVE`` cells with slicks.
    """
    spark = rows.sparkSession
    n, positive = rows.agg(F.count("*"), F.coalesce(F.sum("target"), F.lit(0))).first()
    if positive < LEAST_POSITIVE:
        raise ValueError(f"{positive} cells with slicks are too few")
    areas = fold_areas(rows)
    grown = grown_on(rows)
    for i, part in enumerate(grown):
        part.write().overwrite().save(f"{path}/forest/{i}")
    corner = lambda c, sign: F.round(F.col(c) + sign * CELL / 2, 4)
    cells = scored(rows, grown).select(corner("lon", -1).alias("lon0"), corner("lat", -1).alias("lat0"), corner("lon", 1).alias("lon1"), corner("lat", 1).alias("lat1"), F.round("p", 4).alias("p"))
    cells.write.mode("overwrite").parquet(f"{path}/cells")
    known = [a for *_, a in areas if a is not None]
    facts = {"features": INPUTS, "importances": dict(importances(grown, INPUTS)), "auc_mean": sum(known) / len(known) if known else None, "auc_folds": [a for *_, a in areas], "trained_at": time.time(), "n_cells": n, "n_positive": positive, "history": history, "cell_deg": CELL}
    spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/facts")
    return facts


def risk_status(spark: SparkSession, path: str) -> dict[str, object]:
    """``trained`` and the facts on the published forest."""
    try:
        (row,) = spark.read.text(f"{path}/facts").collect()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return {"trained": False}
        raise
    return {"trained": True, **json.loads(row.value)}


def risk_cells(spark: SparkSession, path: str, min_p: float = 0.0, limit: int = 4000) -> DataFrame:
    """The published cells of ``min_p`` or more as GeoJSON features, the likeliest first; ``limit`` from 1 to 20,000."""
    if not risk_status(spark, path)["trained"]:
        raise FileNotFoundError(f"no risk model was published at {path}")
    at = lambda x, y: F.array(F.col(x), F.col(y))
    ring = F.array(at("lon0", "lat0"), at("lon1", "lat0"), at("lon1", "lat1"), at("lon0", "lat1"), at("lon0", "lat0"))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"), F.struct("p").alias("properties")))
    rows = spark.read.parquet(f"{path}/cells").filter(F.col("p") >= min_p).orderBy(F.desc("p"), "lat0", "lon0").limit(clamped(limit, 20_000))
    return rows.select("p", feature.alias("feature"))


def _probability(rows: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return rows.withColumn("p", F.element_at(vector_to_array("probability"), 2))


#: Inputs, trees, least leaf and least samples of the patch classifier.
PATCH_INPUTS = ["area_px", "complexity", "contrast_db", "edge_sharpness", "homogeneity", "elongation", "dark_fraction_local"]
PATCH_TREES, PATCH_LEAF, PATCH_SAMPLES = 300, 3, 20
#: What a missing input of a patch counts as.
ABSENT = 999.0


def train_patches(labelled: DataFrame, inputs: list[str] = PATCH_INPUTS, trees: int = PATCH_TREES):
    """A forest over patch features with a ``label`` (1: oil), classes balanced; refuses fewer than ``PATCH_SAMPLES`` rows.

    An input that is missing (a patch far from any land has no distance) counts as ``ABSENT``.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import SQLTransformer, VectorAssembler

    checkpointed(labelled.sparkSession)
    counts = {r.label: r["count"] for r in labelled.groupBy("label").count().collect()}
    n = sum(counts.values())
    if n < PATCH_SAMPLES or len(counts) < 2:
        raise ValueError(f"{n} labelled patches of {len(counts)} classes are too few")
    weighted = labelled.withColumn("weight", F.when(F.col("label") == 1, n / (2 * counts[1])).otherwise(n / (2 * counts[0])))
    filled = SQLTransformer(statement="select *, " + ", ".join(f"coalesce(cast(`{c}` as double), {ABSENT}) as `input_{c}`" for c in inputs) + " from __THIS__")
    vector = VectorAssembler(inputCols=[f"input_{c}" for c in inputs], outputCol="features")
    return Pipeline(stages=[filled, vector, forest(trees, "label", PATCH_LEAF)]).fit(weighted)


def patch_cv_f1(labelled: DataFrame, key: str = "path", inputs: list[str] = PATCH_INPUTS, trees: int = PATCH_TREES) -> DataFrame:
    """``fold, n_test, f1`` of oil patches by a model of the other folds; patches go to folds by a hash of ``key``.

    Five folds, fewer for under 20 patches; null where a fold holds no oil or none is found.
    """
    known = written(labelled, "patches")
    k = max(2, min(FOLDS, known.count() // 4))
    rows = known.withColumn("fold", F.pmod(F.xxhash64(key), F.lit(k)).cast("int"))

    def f1(i: int) -> tuple[int, int, float | None]:
        test = rows.filter(F.col("fold") == i)
        found = score_patches(test, train_patches(rows.filter(F.col("fold") != i), inputs, trees), "0e0")
        oil, hit = F.col("label") == 1, F.col("p") > 0.5
        n, right, wrong, lost = found.agg(F.count("*"), F.count_if(oil & hit), F.count_if(~oil & hit), F.count_if(oil & ~hit)).first()
        return i, n, 2 * right / (2 * right + wrong + lost) if right + wrong + lost else None

    spark = labelled.sparkSession
    return spark.createDataFrame(side_by_side(spark, k, f1), "fold int, n_test long, f1 double")


def save_model(model, path: str, **facts: str) -> None:
    """A model and a row of facts on it, side by side."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    spark.createDataFrame([facts or {"kind": "model"}]).write.mode("overwrite").json(f"{path}/facts")


def load_model(spark: SparkSession, path: str):
    """The model and its facts; neither where nothing was saved."""
    from pyspark.ml import PipelineModel

    try:
        facts = spark.read.json(f"{path}/facts").first().asDict()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None, {}
        raise
    return PipelineModel.load(f"{path}/model"), facts


def score_patches(features: DataFrame, model, prior: str) -> DataFrame:
    """``p``: the model's probability of oil, or the expression ``prior`` where there is no model."""
    if model is None:
        return features.withColumn("p", F.expr(prior))
    scored = _probability(model.transform(features))
    return scored.select(*features.columns, "p")


QUERIES = {f.__name__: f for f in (risk_cv_auc, risk_grid_predict, risk_importances)}
