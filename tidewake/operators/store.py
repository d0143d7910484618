"""Store semantics: dedup, upserts, retention, catalogue rules, as set operations over whole tables."""

from __future__ import annotations

from tidewake.plans.query import query
from tidewake.sources.fixtures import AOI

#: Seconds that positions are kept: seven days, squeezed as the fixture's time is.
RETENTION_DAYS, SQUEEZE = 7, 40
RETENTION_S = RETENTION_DAYS * 86400 / SQUEEZE
NOW = "(select max(ts) from ais)"
IN_AOI = f"lon between {AOI[0]}e0 and {AOI[2]}e0 and lat between {AOI[1]}e0 and {AOI[3]}e0"

#: A feed as it comes: some rows lack a vessel or a place, some are ahead of the clock, some come twice.
FEED = """select event_id, case when event_id % 17 = 0 then null when event_id % 19 = 0 then 0 else mmsi end as mmsi,
  case when event_id % 23 = 0 then ts + 7200e0 else ts end as ts, case when event_id % 29 = 0 then null else lon end as lon, lat, sog, 0 as copy from ais
  union all select event_id, mmsi, ts, lon + 1e-3, lat, sog, 1 as copy from ais where event_id % 5 = 0"""


@query("position_normalise", "ais", steps=lambda d: [("feed", FEED)])
def position_normalise(d):
    return f"""select event_id, copy, mmsi, round(case when ts > now_ts + 60e0 then now_ts else ts end, 3) as ts, round(lon, 5) as lon, round(lat, 5) as lat, sog
  from feed cross join (select max(ts) as now_ts from ais) c where mmsi is not null and mmsi <> 0 and lon is not null and lat is not null and {IN_AOI}"""


@query("future_ts_clamp", "ais", steps=lambda d: [("feed", FEED)])
def future_ts_clamp(d):
    return "select count_if(ts > now_ts + 60e0) as clamped, count(*) as n, round(max(case when ts > now_ts + 60e0 then now_ts else ts end), 3) as last_ts from feed cross join (select max(ts) as now_ts from ais) c"


@query("ais_dedup_first_wins", "ais", steps=lambda d: [("feed", FEED)])
def ais_dedup_first_wins(d):
    return """select mmsi, round(ts, 3) as ts, round(lon, 5) as lon from (
  select *, row_number() over (partition by mmsi, ts order by copy, event_id) as rn from feed where mmsi is not null and mmsi <> 0 and lon is not null) r where rn = 1"""


@query("vessel_upsert_last_wins", "vessels")
def vessel_upsert_last_wins(d):
    return """select mmsi, name, draught from (select *, row_number() over (partition by mmsi order by seq desc) as rn from (
  select mmsi, name, draught, 1 as seq from vessels union all select mmsi, case when mmsi % 2 = 0 then null else name || '*' end as name, draught + 1e0 as draught, 2 as seq from vessels where mmsi % 3 = 0) u) r where rn = 1"""


@query("suspect_upsert", "suspects")
def suspect_upsert(d):
    return """select slick_id, mmsi, score from (select *, row_number() over (partition by slick_id, mmsi order by seq desc) as rn from (
  select slick_id, mmsi, score, 1 as seq from suspects union all select slick_id, mmsi, score + 1e0 as score, 2 as seq from suspects where mmsi % 4 = 1) u) r where rn = 1"""


@query("new_scenes_anti", "scenes")
def new_scenes_anti(d):
    return "select product_id, name from scenes s where not exists (select 1 from scenes k where k.seq % 3 <> 0 and k.product_id = s.product_id)"


@query("catalogue_filter_top20", "scenes")
def catalogue_filter_top20(d):
    return """select product_id, name, sensed_start from scenes where name like '%GRDH%' and seq % 5 <> 0
  and sensed_start > (select max(sensed_start) from scenes) - 172800e0 order by sensed_start desc, product_id limit 20"""


@query("retention_positions", "ais")
def retention_positions(d):
    return f"select mmsi, count(*) as n from ais where ts >= {NOW} - {RETENTION_S}e0 group by mmsi"


@query("aoi_filter", "ais")
def aoi_filter(d):
    return f"select event_id, mmsi from ais where {IN_AOI}"


@query("slick_dedup_box", "slicks")
def slick_dedup_box(d):
    # The first slick of a scene within 0.01 degrees on both axes takes the detection; the rest are inserted.
    return """select n.id, min(o.id) as hit from (select id + 1000000 as id, scene_id, centroid_lon + (id % 5) * 4e-3 as lon, centroid_lat + (id % 3) * 4e-3 as lat from slicks) n
  left join slicks o on o.scene_id = n.scene_id and o.centroid_lon between n.lon - 0.01e0 and n.lon + 0.01e0 and o.centroid_lat between n.lat - 0.01e0 and n.lat + 0.01e0 group by n.id"""


def evicted(d):
    """Sums before each archive: within its hour by a window, before the hour by the hours' sums (a row an hour, however many archives)."""
    h = d.idiv("cast(sensed_start as bigint)", "3600")
    order = "over (partition by hour order by sensed_start, seq rows between unbounded preceding and current row)"
    return [
        ("done", f"select *, {h} as hour, cast(size_mb * 100 as bigint) as size from scenes where status in ('detected', 'clear', 'error')"),
        ("hours", "select hour, cast(sum(size) as bigint) as of_hour from done group by hour"),
        ("before_hour", "select hour, cast(coalesce(sum(of_hour) over (order by hour rows between unbounded preceding and 1 preceding), 0) as bigint) as earlier from hours"),
        ("before_each", f"select d.product_id, d.status, b.earlier + cast(sum(d.size) {order.replace('partition by hour', 'partition by d.hour').replace('order by sensed_start, seq', 'order by d.sensed_start, d.seq')} as bigint) - d.size as before from done d join before_hour b on b.hour = d.hour"),
    ]


@query("cache_eviction_running_sum", "scenes", steps=evicted)
def cache_eviction_running_sum(d):
    # Oldest archives of done scenes go while what is left is over the limit.
    return "select product_id, status from before_each cross join (select sum(cast(size_mb * 100 as bigint)) as total from scenes) t where t.total - before > cast(t.total * 0.7e0 as bigint)"


@query("point_lookup", "ais", "slicks", "scenes")
def point_lookup(d):
    return """select 'fixes' as what, cast(count(*) as bigint) as n from ais where mmsi = (select min(mmsi) from ais) union all select 'slick', count(*) from slicks where id = 3
  union all select 'scene', count(*) from scenes where product_id = '7'"""


@query("in_list_anthro", "hist_slicks")
def in_list_anthro(d):
    return "select cls, count(*) as n, round(avg(area_m2), 3) as area from hist_slicks where cls in (2, 4, 5, 6, 7, 8) group by cls"


@query("training_slick_filter", "hist_slicks")
def training_slick_filter(d):
    return "select id, s1_scene, cls from hist_slicks where s1_scene is not null and cls in (2, 4, 5, 6, 7, 8) and coalesce(case when id % 11 = 0 then null else confidence end, 0e0) >= 0.7e0"


@query("hist_top_scenes", "hist_slicks")
def hist_top_scenes(d):
    return "select s1_scene, count(*) as n from hist_slicks where s1_scene is not null and centroid_lat between 53.5e0 and 62e0 group by s1_scene order by n desc, s1_scene limit 16"


@query("scene_by_name_or_id", "scenes")
def scene_by_name_or_id(d):
    return "select product_id, status from scenes where name = (select min(name) from scenes) union select product_id, status from scenes where product_id = '11'"


@query("table_counts", "ais", "vessels", "slicks", "scenes", "hist_slicks")
def table_counts(d):
    return " union all ".join(f"select '{t}' as name, count(*) as n from {t}" for t in ("ais", "vessels", "slicks", "scenes", "hist_slicks"))


@query("scenes_by_status", "scenes")
def scenes_by_status(d):
    return "select status, count(*) as n from scenes group by status"


@query("class_balance", "hist_slicks")
def class_balance(d):
    return "select count(*) as n, count_if(cls in (2, 4, 5, 6, 7, 8)) as positives, round(avg(case when cls in (2, 4, 5, 6, 7, 8) then 1e0 else 0e0 end), 5) as share from hist_slicks"


QUERIES = (position_normalise, future_ts_clamp, ais_dedup_first_wins, vessel_upsert_last_wins, suspect_upsert, new_scenes_anti, catalogue_filter_top20, retention_positions, aoi_filter, slick_dedup_box, cache_eviction_running_sum, point_lookup, in_list_anthro, training_slick_filter, hist_top_scenes, scene_by_name_or_id, table_counts, scenes_by_status, class_balance)
