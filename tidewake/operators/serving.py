"""What the service answers: listings, cards, GeoJSON, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewake.plans.query import query


def clamped(limit: int, most: int) -> int:
    """A caller's limit, between 1 and ``most``."""
    return max(1, min(limit, most))


@query("scenes_recent", "scenes")
def scenes_recent(d, limit: int = 40):
    return f"select product_id, name, sensed_start, status from scenes order by sensed_start desc, product_id limit {clamped(limit, 500)}"


@query("newest_scene", "scenes")
def newest_scene(d):
    return "select status, max_by(product_id, sensed_start * 1e7 + seq) as product_id, max(sensed_start) as sensed_start from scenes group by status"


@query("largest_product", "scenes")
def largest_product(d):
    return "select substr(name, 1, 25) as name, max_by(product_id, size_mb * 1e9 - seq) as product_id, round(max(size_mb), 2) as size_mb from scenes group by substr(name, 1, 25)"


@query("scene_name_parse", "scenes")
def scene_name_parse(d):
    pat = "^(S1[ABCD])_(IW|EW|SM)_(GRD[HMS])_(1SD[HV]|1SS[HV])_([0-9T]{15})_"
    part = lambda i: f"nullif(regexp_extract(name, '{pat}', {i}), '')"
    start = d.parse_utc("stamp")
    return f"""select product_id, mission, mode, product, pols, {start} as start_ts, lower(name) like '%grdh%' as is_grdh from (
  select product_id, name, {part(1)} as mission, {part(2)} as mode, {part(3)} as product, {part(4)} as pols, {part(5)} as stamp from scenes) p"""


@query("epoch_text", "hist_slicks")
def epoch_text(d):
    return f"select id, {d.utc_text('ts + id % 86400')} as at_utc from hist_slicks"


@query("slicks_recent", "slicks")
def slicks_recent(d):
    return "select id, detected_at, confidence from slicks order by detected_at desc, id limit 50"


@query("slicks_per_scene", "slicks")
def slicks_per_scene(d):
    return "select scene_id, count(*) as n, min(detected_at) as first_at from slicks group by scene_id"


@query("suspects_per_slick", "suspects")
def suspects_per_slick(d):
    return "select slick_id, count(*) as n, max(score) as top_score from suspects group by slick_id"


@query("suspects_top15", "suspects", "vessels")
def suspects_top15(d):
    return """select slick_id, s.mmsi, score, rank, name, ship_type from (select *, cast(row_number() over (partition by slick_id order by score desc, mmsi) as bigint) as rank from suspects) s
  left join vessels v on v.mmsi = s.mmsi where rank <= 15"""


@query("suspects_left_join_vessels", "suspects", "vessels")
def suspects_left_join_vessels(d):
    return "select slick_id, s.mmsi, score, name from suspects s left join vessels v on v.mmsi = s.mmsi order by score desc, slick_id, s.mmsi limit 8"


def latest_runs(table) -> DataFrame:
    """Of each slick and direction the run with the greatest id; of runs that share it the first that a scan meets, whatever task's rows come first."""
    newest = Window.partitionBy("slick_id", "direction").orderBy(F.desc("id"), "place")
    placed = table("drift_runs").withColumn("place", F.monotonically_increasing_id())
    return placed.withColumn("rn", F.row_number().over(newest)).filter("rn = 1").select("slick_id", "direction", "id", "origin_sigma_km")


@query("latest_drift_run", "drift_runs", frame=latest_runs)
def latest_drift_run(d):
    return "select slick_id, direction, id, origin_sigma_km from (select *, row_number() over (partition by slick_id, direction order by id desc) as rn from drift_runs) r where rn = 1"


@query("event_log_recent", "event_log")
def event_log_recent(d):
    return "select id, kind, severity, message from event_log order by id desc limit 100"


#: The severities of each filter of the log.
SEVERITIES = {"alert": ("alert", "spill"), "warning": ("warning", "gap"), "info": ("info", "action")}


def severity_group(severity: str) -> str:
    """The filter that shows a severity; none where no filter but all does."""
    return "case " + " ".join(f"when {severity} in ({', '.join(map(repr, s))}) then '{name}'" for name, s in SEVERITIES.items()) + " end"


@query("event_filter_search", "event_log")
def event_filter_search(d):
    """Events that hold a text, whatever its case and signs, with the filter that shows them."""
    return f"select id, severity, message, {severity_group('severity')} as shown_by from event_log where instr(lower(message), 'vessel 1') > 0 or instr(lower(kind), 'vessel 1') > 0"


@query("event_severity_counts", "event_log")
def event_severity_counts(d):
    return "select count(*) as n, count_if(severity in ('alert', 'spill')) as alerts, count_if(severity in ('warning', 'gap')) as warnings, count_if(severity not in ('alert', 'spill', 'warning', 'gap')) as infos from event_log"


def features(rows: DataFrame) -> DataFrame:
    """``mmsi, feature``: each vessel's latest position as a GeoJSON feature; null properties stay, texts are escaped."""
    point = F.struct(F.lit("Point").alias("type"), F.array(F.round("lon", 5), F.round("lat", 5)).alias("coordinates"))
    told = F.struct("mmsi", F.round("ts", 3).alias("ts"), "sog", "cog", F.col("navstat").alias("navStat"), "name", F.col("ship_type").alias("shipType"))
    whole = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), told.alias("properties"))
    return rows.select("mmsi", F.to_json(whole, {"ignoreNullFields": "false"}).alias("feature"))


def live_features(table) -> DataFrame:
    latest = table("ais").groupBy("mmsi").agg(F.max_by(F.struct("ts", "lon", "lat", "sog", "cog", "navstat"), F.struct("ts", "event_id")).alias("m")).select("mmsi", "m.*")
    return features(latest.join(table("vessels").select("mmsi", "name", "ship_type"), "mmsi", "left"))


@query("vessels_live_geojson", "ais", "vessels", frame=live_features)
def vessels_live_geojson(d):
    return """select a.mmsi, cast(to_json({'type': 'Feature', 'geometry': {'type': 'Point', 'coordinates': [round(lon, 5), round(lat, 5)]},
    'properties': {'mmsi': a.mmsi, 'ts': round(ts, 3), 'sog': sog, 'cog': cog, 'navStat': navstat, 'name': name, 'shipType': ship_type}}) as varchar) as feature
  from (select *, row_number() over (partition by mmsi order by ts desc, event_id desc) as rn from ais) a left join vessels v on v.mmsi = a.mmsi where rn = 1"""


def time_ago(d, seconds: str) -> str:
    """How long ago in words, of whole seconds that are null where no time is known."""
    part = lambda n: f"cast({d.idiv(seconds, str(n))} as varchar(20))"
    return f"case when {seconds} is null then '—' when {seconds} < 60 then 'just now' when {seconds} < 3600 then {part(60)} || 'm ago' when {seconds} < 86400 then {part(3600)} || 'h ago' else {part(86400)} || 'd ago' end"


@query("event_ages", "event_log")
def event_ages(d):
    """Of each event its age at the newest one, in words; a time ahead is now, one of zero unknown."""
    return f"""select id, {time_ago(d, 'away')} as age from (select id, case when ts <> 0 then greatest(cast(floor(newest - ts) as bigint), 0) end as away
  from (select id, case when id % 97 = 0 then 0e0 when id % 89 = 0 then ts + 1e9 else ts end as ts from event_log) e cross join (select max(ts) as newest from event_log) n) a"""


@query("wrapped_longitudes", "hist_slicks")
def wrapped_longitudes(d):
    """Longitudes beyond the date line, within -180 to 180."""
    return f"""select id, round(case when lon between -180e0 and 180e0 then lon else {d.pmod('lon + 180e0', '360e0')} - 180e0 end, 6) as lon
  from (select id, centroid_lon + (id % 9 - 4) * 155e0 as lon from hist_slicks) s"""


@query("json_roundtrip", "suspects")
def json_roundtrip(d):
    text = """'{"score":' || cast(cast(score * 10 as bigint) as varchar(20)) || ',"evidence":"' || evidence || '"}'"""
    get = (lambda k: f"get_json_object(js, '$.{k}')") if d.spark else (lambda k: f"json_extract_string(js, '$.{k}')")
    return f"select slick_id, mmsi, cast({get('score')} as bigint) as score_e1, {get('evidence')} as evidence from (select slick_id, mmsi, {text} as js from suspects) j"


@query("risk_opacity_minmax", "hist_slicks")
def risk_opacity_minmax(d):
    return "select id, round((confidence - lo) / nullif(hi - lo, 0e0), 4) as opacity from hist_slicks cross join (select min(confidence) as lo, max(confidence) as hi from hist_slicks) m"


@query("cone_thinning", "drift_runs")
def cone_thinning(d):
    return """select slick_id, id, k from (select slick_id, id, row_number() over (partition by slick_id order by id) - 1 as k, count(*) over (partition by slick_id) as n from drift_runs) r
  where k % 3 = 2 or k = 0 or k = n - 1"""


@query("circle_polygon", "slicks")
def circle_polygon(d):
    return f"""select id, k, round(centroid_lon + confidence / (111.320e0 * cos(radians(centroid_lat))) * cos(radians(5e0 * k)), 6) as lon,
  round(centroid_lat + confidence / 110.574e0 * sin(radians(5e0 * k)), 6) as lat from slicks cross join {d.numbers(73, 'k')} c"""


@query("risk_grid_topk", "grid", "ais_cells")
def risk_grid_topk(d):
    return """select cell, p from (select ix + 189 * iy as cell, round(1e0 - exp(-count(*) / 1e1), 4) as p from ais_cells where ix between 0 and 188 and iy between 0 and 47 group by ix, iy) r
  where p >= 0.05e0 order by p desc, cell limit 100"""


QUERIES = (scenes_recent, newest_scene, largest_product, scene_name_parse, epoch_text, slicks_recent, slicks_per_scene, suspects_per_slick, suspects_top15, suspects_left_join_vessels, latest_drift_run, event_log_recent, event_filter_search, event_severity_counts, vessels_live_geojson, event_ages, wrapped_longitudes, json_roundtrip, risk_opacity_minmax, cone_thinning, circle_polygon, risk_grid_topk)
