"""Detections of one batch against the slicks that are there and against each other, in the order in which they came.

A detection within ``BOX`` degrees on both axes of a slick of its scene updates
that slick (of several the one of the least id); any other is inserted, and
then takes those that come after it.  Whether a detection is inserted depends on
earlier neighbours alone, so it is settled in rounds: each decides all whose
earlier neighbours are decided.  Neighbours meet on cells of the box's size, so
a scene of any number of detections is many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.plans.dialect import SPARK
from tidewake.plans.query import register
from tidewake.plans.scratch import written
from tidewake.sources.fixtures import with_tables

BOX = 0.01


def _spread(rows: DataFrame) -> DataFrame:
    """A row in each of the nine cells that its box can touch."""
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    return rows.withColumn("kx", F.explode(F.transform(around, lambda i: F.floor(F.col("lon") / BOX) + i))).withColumn("ky", F.explode(F.transform(around, lambda i: F.floor(F.col("lat") / BOX) + i)))


def _celled(rows: DataFrame, *names: str) -> DataFrame:
    return rows.select("scene", F.floor(F.col("lon") / BOX).alias("kx"), F.floor(F.col("lat") / BOX).alias("ky"), *names, F.col("lon").alias("at_lon"), F.col("lat").alias("at_lat"))


def _near() -> Column:
    return F.col("at_lon").between(F.col("lon") - BOX, F.col("lon") + BOX) & F.col("at_lat").between(F.col("lat") - BOX, F.col("lat") + BOX)


def absorbed(slicks: DataFrame, batch: DataFrame) -> DataFrame:
    """``n, scene, target, inserted, first`` of each detection (``n`` in order, scene, lon, lat).

    ``target`` is the slick (id, scene, lon, lat) that it updates, ``first`` the
    detection of the batch that was inserted and takes it; both are null where
    it is inserted itself.
    """
    spread = written(_spread(batch.select("n", "scene", "lon", "lat")), "detections")
    hits = spread.join(_celled(slicks, "id"), ["scene", "kx", "ky"]).filter(_near()).groupBy("n").agg(F.min("id").alias("target"))
    state = written(batch.select("n", "scene").join(hits, "n", "left").withColumn("inserted", F.when(F.col("target").isNotNull(), False)).withColumn("first", F.lit(None).cast("long")), "state")
    pairs = spread.join(_celled(batch.withColumnRenamed("n", "m"), "m"), ["scene", "kx", "ky"]).filter((F.col("m") < F.col("n")) & _near()).select("n", "m")
    pairs = written(pairs.join(state.filter("inserted is null").select("n"), "n"), "neighbours")
    while state.filter("inserted is null").limit(1).count():
        # The least open one of any neighbourhood is decided in each round.
        earlier = pairs.join(state.select(F.col("n").alias("m"), F.col("inserted").alias("of_m")), "m").groupBy("n").agg(F.min(F.when(F.col("of_m"), F.col("m"))).alias("taker"), F.count_if(F.col("of_m").isNull()).alias("undecided"), F.min(F.when(F.col("of_m").isNull(), F.col("m"))).alias("least_open"))
        joined = state.join(earlier, "n", "left")
        known = F.col("inserted").isNotNull()
        # A taker counts once no earlier open one could come before it.
        taken = F.col("taker").isNotNull() & (F.col("least_open").isNull() | (F.col("taker") < F.col("least_open")))
        free = F.col("taker").isNull() & (F.coalesce("undecided", F.lit(0)) == 0)
        state = written(joined.select("n", "scene", "target", F.when(known, F.col("inserted")).when(taken, False).when(free, True).alias("inserted"), F.when(known, F.col("first")).when(taken, F.col("taker")).alias("first")), "state")
    return state


def slick_dedup_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every historical slick of a scene as a detection, by id, against the scenes' slicks."""
    register(spark, sf_dir)
    table = lambda name: spark.sql(f"{with_tables(SPARK, (name,))}select * from {name}")
    slicks = table("slicks").select("id", F.col("scene_id").alias("scene"), F.col("centroid_lon").alias("lon"), F.col("centroid_lat").alias("lat"))
    batch = table("hist_slicks").filter("s1_scene is not null").select(F.col("id").alias("n"), F.col("s1_scene").alias("scene"), F.col("centroid_lon").alias("lon"), F.col("centroid_lat").alias("lat"))
    return absorbed(slicks, batch)


QUERIES = {"slick_dedup_batch": slick_dedup_batch}
