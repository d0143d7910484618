"""Domain tables from the driver's tables, as SQL for either engine.

The driver has no vessel data, so both the engine's queries and their oracle
read these definitions.  ``tables(d)`` maps names to (needs, select).
"""

from __future__ import annotations

from tidewake.plans.dialect import Dialect

#: Area of interest (lon0, lat0, lon1, lat1), cell size in degrees and margin of the risk grid.
AOI, CELL, MARGIN = (21.8, 58.9, 30.6, 60.7), 0.05, 0.3
GRID_NX, GRID_NY = 189, 48
#: Main oil terminals of the area (lat, lon).
TERMINALS = ((60.337, 28.750), (59.665, 28.290), (60.627, 28.550), (59.852, 29.750), (59.405, 27.900), (59.480, 24.900), (60.280, 25.600), (60.210, 25.150), (60.470, 21.950), (55.700, 21.130), (54.400, 18.660), (57.050, 24.100), (58.900, 17.950))

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def tables(d: Dialect) -> dict[str, tuple[tuple[str, ...], str]]:
    t = f"({d.micros('ts')} - 1704067200000000) / 4e7"
    lon0, lat1 = AOI[0] - MARGIN, AOI[3] + MARGIN
    return {
        "ais": ((), f"""select (201 + (user_id * 13) % 579) * 1000000 + user_id as mmsi, {t} as ts,
  22.0e0 + (user_id * 104729 % 8000) / 1e3 + 0.05e0 * sin({t} / 3.6e3 + user_id) as lon,
  59.0e0 + (user_id * 1299709 % 1500) / 1e3 + 0.03e0 * cos({t} / 5.4e3 + user_id) as lat,
  case when event_type = 'error' and event_id % 5 = 0 then null else value / 1e1 end as sog,
  cast((event_id * 37) % 360 as double) as cog, cast(event_id % 16 as int) as navstat, event_id from events"""),
        "vessels": ((), """select (201 + (user_id * 13) % 579) * 1000000 + user_id as mmsi, 'VESSEL-' || cast(user_id as varchar(20)) as name,
  cast((user_id * 7) % 90 as int) as ship_type, case when user_id % 4 = 0 then '  ' else ' PORT ' || cast(user_id % 17 as varchar(20)) || ' ' end as dest,
  cast((user_id * 3) % 150 as double) as draught,
  case when user_id % 10 = 0 then null when user_id % 9 = 0 then '0' else cast(9000000 + user_id as varchar(20)) end as imo,
  cast(20 + (user_id * 11) % 280 as int) as length, cast(5 + (user_id * 3) % 40 as int) as width
  from (select distinct user_id from events) u where user_id % 11 <> 3"""),
        "slicks": ((), f"""select s_suppkey as id, round(22.0e0 + (s_suppkey * 104729 % 8000) / 1e3, 5) as centroid_lon,
  round(59.0e0 + (s_suppkey * 1299709 % 1500) / 1e3, 5) as centroid_lat, 1.5e4 + (s_suppkey * 7919 % 45000) as detected_at,
  0.2e0 + (s_suppkey * 31 % 97) / 2e1 as major_axis_km, 0.1e0 + (s_suppkey * 31 % 97) / 6e1 as minor_axis_km,
  0.1e0 + (s_suppkey * 17 % 53) / 1e2 as area_km2, cast(s_suppkey * 37 % 180 as double) as orientation_deg,
  (s_suppkey * 13 % 100) / 1e2 as confidence, 'S1A_' || cast(s_suppkey % 9 as varchar(20)) as scene_id from supplier"""),
        "releases": (("slicks",), """select id, centroid_lon as olon, centroid_lat as olat, orientation_deg, major_axis_km, area_km2,
  greatest(least(0.8e0 + 0.4e0 * major_axis_km + 0.5e0 * sqrt(area_km2), 17e0), 1e0) as age_h,
  detected_at - greatest(least(0.8e0 + 0.4e0 * major_axis_km + 0.5e0 * sqrt(area_km2), 17e0), 1e0) * 3600e0 as release_ts,
  greatest(0.3e0 + 0.1e0 * major_axis_km, 1e0) as sigma_km from slicks"""),
        "cases": (("releases",), """select id, olon, olat + case when id % 11 = 0 then 2e0 else 0e0 end as olat, release_ts + case when id % 7 = 0 then 9e6 else 0e0 end as release_ts,
  sigma_km, orientation_deg from releases"""),
        "ring": (("slicks",), """select id, k, centroid_lon + (case when k in (0, 3) then 1e0 else -1e0 end * major_axis_km * cos(radians(orientation_deg))
    - case when k in (0, 1) then 1e0 else -1e0 end * minor_axis_km * sin(radians(orientation_deg))) / 2e0 / (111.320e0 * cos(radians(centroid_lat))) as lon,
  centroid_lat + (case when k in (0, 3) then 1e0 else -1e0 end * major_axis_km * sin(radians(orientation_deg))
    + case when k in (0, 1) then 1e0 else -1e0 end * minor_axis_km * cos(radians(orientation_deg))) / 2e0 / 110.574e0 as lat
  from slicks cross join (""" + " union all ".join(f"select {k} as k" for k in range(4)) + ") corners"),
        "ring_edges": (("ring",), "select a.id, a.k, a.lon as x1, a.lat as y1, b.lon as x2, b.lat as y2 from ring a join ring b on a.id = b.id and b.k = (a.k + 1) % 4"),
        "rings": (("ring",), f"select id, {'array_sort(collect_list(struct(k, lon, lat)))' if d.spark else 'list(struct_pack(k, lon, lat) order by k)'} as ring from ring group by id"),
        "hist_slicks": ((), f"""select o_orderkey as id, {d.micros('cast(o_orderdate as timestamp)')} / 1e6 as ts, cast(o_orderkey % 9 as int) as cls, (o_orderkey * 7 % 100) / 1e2 as confidence,
  1e4 + (o_orderkey * 31 % 9973) * 1e2 as area_m2, 22.0e0 + (o_orderkey * 104729 % 8000) / 1e3 as centroid_lon,
  53.0e0 + (o_orderkey * 1299709 % 13000) / 1e3 as centroid_lat, case when o_orderkey % 13 = 0 then null else 'S1A_' || cast(o_custkey % 40 as varchar(20)) end as s1_scene from orders"""),
        "scenes": ((), """select cast(p_partkey as varchar(20)) as product_id, p_partkey as seq, case when p_partkey % 7 = 0 then 'OTHER_' else 'S1A_IW_GRDH_1SDV_' end || '202408'
    || lpad(cast(1 + p_partkey % 28 as varchar(20)), 2, '0') || 'T' || lpad(cast(p_partkey % 24 as varchar(20)), 2, '0') || lpad(cast(p_partkey % 60 as varchar(20)), 2, '0') || lpad(cast(p_partkey * 7 % 60 as varchar(20)), 2, '0') || '_' || cast(p_partkey as varchar(20)) as name,
  1.7e9 + (p_partkey * 7919 % 1000000) as sensed_start, cast(p_retailprice as double) as size_mb,
  case p_size % 5 when 0 then 'catalogued' when 1 then 'processing' when 2 then 'detected' when 3 then 'clear' else 'error' end as status from part"""),
        "event_log": ((), f"""select event_id as id, {d.micros('ts')} / 1e6 as ts, event_type as kind,
  case event_id % 6 when 0 then 'alert' when 1 then 'spill' when 2 then 'warning' when 3 then 'gap' when 4 then 'info' else 'action' end as severity,
  'Vessel ' || cast(user_id as varchar(20)) || ' ' || event_type as message, value from events"""),
        "suspects": ((), """select s_suppkey as slick_id, (201 + (u * 13) % 579) * 1000000 + u as mmsi, round((s_suppkey * 31 + u * 17) % 1000 / 1e1, 1) as score,
  'closest approach ' || cast((s_suppkey * 3 + u) % 90 as varchar(20)) || '.' || cast(u % 10 as varchar(20)) || ' km (5 min from est. release)' as evidence,
  'open sea share (' || cast(20 + u % 60 as varchar(20)) || ' fixes on record)' as behaviour from supplier cross join (""" + " union all ".join(f"select cast({u} as bigint) as u" for u in range(1, 26)) + ") us"),
        "drift_runs": ((), "select l_orderkey * 8 + l_linenumber as id, l_suppkey as slick_id, case when l_linenumber % 2 = 0 then 'backward' else 'forward' end as direction, cast(l_quantity as double) as origin_sigma_km from lineitem"),
        "grid": ((), f"""select iy * {GRID_NX} + ix as cell, ix, iy, {lon0:.10g}e0 + ix * {CELL}e0 as lon, {lat1:.10g}e0 - iy * {CELL}e0 as lat
  from {d.numbers(GRID_NX, 'ix')} a cross join {d.numbers(GRID_NY, 'iy')} b"""),
        "ais_cells": (("ais",), f"""select *, {d.trunc(f'(lon - ({lon0:.10g}e0 - {CELL / 2}e0)) / {CELL}e0')} as ix, {d.trunc(f'({lat1:.10g}e0 - lat) / {CELL}e0')} as iy from ais"""),
        "terminals": ((), " union all ".join(f"select {i} as tid, {lat}e0 as tlat, {lon}e0 as tlon" for i, (lat, lon) in enumerate(TERMINALS))),
        "met": ((), f"""select ix, iy, it, 21.8e0 + ix * 1.76e0 as lon, 58.9e0 + iy * 0.45e0 as lat, it * 3600e0 as ts,
  5e0 + 2e0 * sin(ix / 2e0 + it / 5e0) as wind_u, -3e0 + cos(iy / 2e0 + it / 7e0) as wind_v, 0.1e0 + 0.05e0 * sin(it / 6e0) as cur_u, -0.05e0 + 0.02e0 * cos(ix / 3e0) as cur_v
  from {d.numbers(6, 'ix')} a cross join {d.numbers(5, 'iy')} b cross join {d.numbers(24, 'it')} c"""),
        "met_points": ((), f"select ix, iy from {d.numbers(6, 'ix')} a cross join {d.numbers(5, 'iy')} b"),
        "met_obs": ((), f"""select ix, iy, ts, avg(-speed * sin(radians(dir))) as wind_u, avg(-speed * cos(radians(dir))) as wind_v, avg(-flow / 3.6e0 * sin(radians(cdir))) as cur_u, avg(-flow / 3.6e0 * cos(radians(cdir))) as cur_v from (
  select l_suppkey % 6 as ix, l_partkey % 5 as iy, {d.micros('cast(l_shipdate as timestamp)')} / 1e6 + (l_orderkey % 24) * 3600e0 as ts, cast(l_quantity as double) / 3e0 as speed, cast(l_orderkey * 7 % 360 as double) as dir,
    cast(l_discount as double) * 3e1 as flow, cast(l_orderkey * 11 % 360 as double) as cdir from lineitem) o group by ix, iy, ts"""),
        "met_windows": (("met_obs",), f"""select s_suppkey as id, case when s_suppkey % 4 = 0 then last_ts - 4e5 when s_suppkey % 9 = 1 then last_ts + 9e6 else 7e8 + (s_suppkey * 7919 % 2300) * 86400e0 end as t0,
  case when s_suppkey % 4 = 0 then last_ts - 4e5 when s_suppkey % 9 = 1 then last_ts + 9e6 else 7e8 + (s_suppkey * 7919 % 2300) * 86400e0 end + 3600e0 * (4 + s_suppkey % 70) as t1 from supplier cross join (select max(ts) as last_ts from met_obs) m"""),
        # A pixel's speckle is the mean of whole numbers of its lineitem rows, so that both engines have the same digits.
        "speckle": ((), "select l_orderkey % 4096 as id, 1e0 * sum(l_linenumber * 3 + l_suppkey % 11 + l_partkey % 13) / count(*) as n from lineitem group by l_orderkey % 4096"),
        "sar": (("speckle",), f"""select cast(p.id % 64 as int) as c, cast(floor(p.id / 64) as int) as r,
  -18e0 + 2e0 * sin(floor(p.id / 64) / 5e0) + 1.5e0 * cos((p.id % 64) / 7e0) + (coalesce(s.n, 2e1) - 2e1) / 2e1 - case when power(floor(p.id / 64) - 30e0, 2) + power((p.id % 64) - 34e0, 2) < 81e0 then 12e0 else 0e0 end as v
  from {d.numbers(4096)} p left join speckle s on s.id = p.id"""),
        "files": ((), """select p_partkey + case when p_partkey % 13 = 0 then 100000 else 0 end as scene, 'scenes/' || cast(p_partkey % 50 as varchar(20)) as directory, cast((p_partkey * 31 + k * 17) % 1000 + 1 as bigint) as bytes,
  's1a-iw-grd-' || case when k = 3 then 'notes.xml' else case when k = 1 and p_partkey % 5 <> 0 then 'vv' else 'vh' end || '-' || cast(9 - k as varchar(2)) || '.tiff' end as name
  from part cross join (""" + " union all ".join(f"select {k} as k" for k in range(4)) + ") ks"),
        "calibration": ((), """select p_partkey as scene, '<calibration>' || '<calibrationVector><line>0</line><pixel>0 40 80 120</pixel><sigmaNought>310.5 305.25 ' || cast(300 + p_partkey % 7 as varchar(9)) || ' 299</sigmaNought></calibrationVector>'
  || '<calibrationVector><line>500</line><pixel>0 40 80 120</pixel><sigmaNought>311 306 301 300</sigmaNought></calibrationVector>'
  || '<calibrationVector><line>' || cast(1000 + p_partkey % 11 as varchar(9)) || '</line><pixel>0 40 80 120</pixel><sigmaNought>312 307 302 301.75</sigmaNought></calibrationVector></calibration>' as xml from part"""),
        "samples": ((), """select l_orderkey * 8 + l_linenumber as id, l_partkey + case when l_orderkey % 101 = 0 then 10000000 else 0 end as scene, cast(l_orderkey * 37 % 1500 - 20 as int) as line,
  cast(l_suppkey * 13 % 140 as double) as pixel, case when l_linenumber = 7 then 0e0 else cast(l_extendedprice as double) / 1e2 end as dn from lineitem"""),
        "land": ((), """select n_nationkey as id, k, 22.2e0 + (n_nationkey * 13 % 17) * 0.5e0 + (0.1e0 + (n_nationkey % 4) * 0.09e0) * cos(k * pi() / 3e0) as lon,
  58.8e0 + (n_nationkey * 7 % 11) * 0.2e0 + (0.08e0 + (n_nationkey % 3) * 0.05e0) * sin(k * pi() / 3e0) as lat from nation cross join (""" + " union all ".join(f"select {k} as k" for k in range(6)) + """) ks
  where k < case when n_nationkey % 9 = 4 then 2 else 6 end"""),
        "land_rings": (("land",), f"select id, {'array_sort(collect_list(struct(k, lon, lat)))' if d.spark else 'list(struct_pack(k, lon, lat) order by k)'} as ring from land group by id"),
        "particles": ((), "select l_suppkey as slick_id, cast(l_linenumber as bigint) as step, cast(l_extendedprice as double) / 1e1 as x, cast(l_quantity as double) * 1e2 as y from lineitem"),
    }


def with_tables(d: Dialect, names: tuple[str, ...], extra: list[tuple[str, str]] = [], given: dict[str, str] | None = None) -> str:
    """A WITH list of the named tables, what they need before them, and further ones; ``given`` tables are views with the rows of a caller."""
    known, out = tables(d), {}

    def add(n: str) -> None:
        if n in (given or {}):
            out[n] = f"select * from {given[n]}"
        elif n not in out:
            for m in known[n][0]:
                add(m)
            out[n] = known[n][1]

    for n in names:
        add(n)
    # The oracle computes each table once; Spark inlines them, so that filters and columns reach the scans.
    parts = [f"{n} as {'' if d.spark else 'materialized '}({s})" for n, s in [*out.items(), *extra]]
    return "with " + ",\n".join(parts) + "\n" if parts else ""
