"""What a client asks for, as functions over DataFrames.

``fixes``: mmsi, ts, lon, lat, sog, cog, navstat, event_id.  ``vessels``: mmsi,
name, ship_type, dest, draught, imo, length, width.  ``scenes``: product_id, name,
sensed_start, status, size_mb.  ``slicks``: id, scene_id, detected_at, ...
``suspects``: slick_id, mmsi, score, rank, ...  Empty tables give empty answers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewake.functions.lookups import flag_case, nav_status_case, ship_type_case
from tidewake.operators import serving, suspects, tracks

#: Hours of a track, and fixes of its fallbacks.
TRACK_HOURS, NEAREST, LATEST = 18, 100, 300


def status(fixes: DataFrame, scenes: DataFrame, slicks: DataFrame) -> DataFrame:
    """One row: positions, vessels, last fix, scenes and slicks."""
    ais = fixes.agg(F.count(F.lit(1)).alias("positions"), F.count_distinct("mmsi").alias("vessels"), F.max("ts").alias("last_ts"))
    return ais.crossJoin(scenes.agg(F.count(F.lit(1)).alias("scenes"))).crossJoin(slicks.agg(F.count(F.lit(1)).alias("slicks")))


def latest(fixes: DataFrame) -> DataFrame:
    m = F.max_by(F.struct("ts", "lon", "lat", "sog", "cog", "navstat"), F.struct("ts", "event_id"))
    return fixes.groupBy("mmsi").agg(m.alias("m")).select("mmsi", "m.*")


def vessels_live(fixes: DataFrame, vessels: DataFrame) -> DataFrame:
    """The latest fix of every vessel with its name and type, where known."""
    return latest(fixes).join(vessels.select("mmsi", "name", "ship_type"), "mmsi", "left")


def vessel_track(fixes: DataFrame, mmsi: int, hours: float = TRACK_HOURS, from_ts: float | None = None, to_ts: float | None = None) -> DataFrame:
    """A vessel's fixes in time: of a range (else the nearest to its middle), or of the hours before its own last fix."""
    own = fixes.filter(F.col("mmsi") == mmsi).select("ts", "lon", "lat", "sog", "cog")
    if from_ts is None or to_ts is None:
        last = own.agg(F.max("ts").alias("last_ts"))
        return own.crossJoin(F.broadcast(last)).filter(F.col("ts") >= F.col("last_ts") - hours * 3600).drop("last_ts").orderBy("ts")
    within = own.filter(F.col("ts").between(from_ts, to_ts))
    if within.limit(1).count():
        return within.orderBy("ts")
    return own.orderBy(F.abs(F.col("ts") - (from_ts + to_ts) / 2), "ts").limit(NEAREST).orderBy("ts")


def vessel_details(fixes: DataFrame, vessels: DataFrame, mmsi: int) -> DataFrame:
    """One row: the card, labels, flag, latest fix and history; an unknown vessel has its number and flag."""
    spark = fixes.sparkSession
    asked = spark.createDataFrame([(mmsi,)], "mmsi long")
    known = asked.join(vessels.filter(F.col("mmsi") == mmsi), "mmsi", "left")
    card = known.selectExpr(
        "mmsi", "name", "ship_type", f"{ship_type_case('ship_type', 0)} as type_label", f"{ship_type_case('ship_type', 1)} as type_icon",
        flag_case("substr(lpad(cast(mmsi as string), 9, '0'), 1, 3)") + " as flag", "nullif(nullif(imo, '0'), '') as imo",
        "nullif(length, 0) as length", "nullif(width, 0) as width", "nullif(round(draught / 10, 1), 0) as draught", "nullif(trim(dest), '') as destination",
    )
    own = fixes.filter(F.col("mmsi") == mmsi)
    live = latest(own).selectExpr("mmsi", "lon", "lat", "sog", "cog", "ts", f"{nav_status_case('navstat')} as nav_status")
    history = tracks.vessel_history.over(spark, ais=own).drop("first_ts").join(tracks.dark_gaps.over(spark, ais=own).select("mmsi", "dark_gaps"), "mmsi", "left")
    return card.join(live, "mmsi", "left").join(history.drop("last_ts"), "mmsi", "left")


def vessel_stops(fixes: DataFrame, mmsi: int) -> DataFrame:
    """The eight longest stops of a vessel."""
    return tracks.vessel_stops.over(fixes.sparkSession, ais=fixes.filter(F.col("mmsi") == mmsi)).orderBy("rank")


def scenes(table: DataFrame, limit: int = 40) -> DataFrame:
    return table.orderBy(F.desc("sensed_start"), "product_id").limit(serving.clamped(limit, 500))


def slicks(table: DataFrame, ranked: DataFrame) -> DataFrame:
    """Slicks, the newest first, with the number of their suspects and the highest score."""
    best = ranked.groupBy("slick_id").agg(F.count(F.lit(1)).alias("suspects"), F.max("score").alias("best_score"))
    return table.join(best, table["id"] == best["slick_id"], "left").drop("slick_id").orderBy(F.desc("detected_at"), "id")


def slick_detail(ranked: DataFrame, vessels: DataFrame, slick_id: int, top: int = 15) -> DataFrame:
    """A slick's suspects by rank with what is known of the vessels."""
    own = ranked.filter(F.col("slick_id") == slick_id)
    known = vessels.select("mmsi", "name", "ship_type")
    return own.drop("name", "ship_type").join(known, "mmsi", "left").withColumn("type_label", F.expr(ship_type_case("ship_type", 0))).orderBy("rank").limit(top)


def analyze(fixes: DataFrame, releases: DataFrame, vessels: DataFrame, rings: DataFrame, conduct: DataFrame, top: int = 15) -> DataFrame:
    """The ranked suspects of the releases, in the shape of ``suspects``."""
    return suspects.score_vessels(fixes, releases, vessels, rings, conduct, top).withColumnRenamed("id", "slick_id")


def risk_status(cells: DataFrame) -> DataFrame:
    return cells.agg(F.count(F.lit(1)).alias("cells"), F.max("p").alias("highest"))


def risk_grid(cells: DataFrame, min_p: float = 0.0, limit: int = 20_000) -> DataFrame:
    return cells.filter(F.col("p") >= min_p).orderBy(F.desc("p"), "lon", "lat").limit(serving.clamped(limit, 20_000))


def event_log(events: DataFrame, limit: int = 100) -> DataFrame:
    return events.orderBy(F.desc("id")).limit(serving.clamped(limit, 500))


def running_distance(fixes: DataFrame) -> DataFrame:
    """Each fix with the kilometres its vessel has sailed until it."""
    legs = tracks.leg_distance.over(fixes.sparkSession, ais=fixes).select("event_id", "leg_km")
    w = Window.partitionBy("mmsi").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return fixes.join(legs, "event_id").withColumn("sailed_km", F.coalesce(F.sum("leg_km").over(w), F.lit(0.0)))


def named(spark: SparkSession, name: str, **tables: DataFrame) -> DataFrame:
    """Any named query over a caller's tables."""
    from tidewake.registry import BY_NAME

    return BY_NAME[name].over(spark, **tables)
