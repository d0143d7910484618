"""The risk grid: cells, density, lanes, terminals, features, targets; ring geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewake.operators.shore import CELL_KM, distance_transform, shore_grid, valid_land
from tidewake.plans.dialect import SPARK, haversine
from tidewake.plans.query import query
from tidewake.sources.fixtures import with_tables

IN_GRID = "ix between 0 and 188 and iy between 0 and 47"


def density(d):
    return [
        ("dense", f"select ix, iy, count(*) as n from ais_cells where {IN_GRID} group by ix, iy"),
        ("p90", f"select {d.percentile('ln(1e0 + n)', 0.9)} as cut from dense"),
        ("lane_cells", "select g.cell, g.ix, g.iy from dense n join grid g on g.ix = n.ix and g.iy = n.iy cross join p90 where ln(1e0 + n.n) >= p90.cut"),
    ]


#: Fixes of each cell that has any.
OF_CELL = f"(select ix, iy, count(*) as n from ais_cells where {IN_GRID} group by ix, iy)"


@query("grid_cells", "grid", "ais_cells")
def grid_cells(d):
    return f"select g.cell, g.ix, g.iy, round(g.lon, 6) as lon, round(g.lat, 6) as lat, coalesce(n.n, 0) as fixes from grid g left join {OF_CELL} n on n.ix = g.ix and n.iy = g.iy"


@query("ais_density", "grid", "ais_cells", steps=density)
def ais_density(d):
    return "select g.cell, round(ln(1e0 + coalesce(n.n, 0)), 5) as density from grid g left join dense n on g.ix = n.ix and g.iy = n.iy"


@query("lane_mask_p90", "grid", "ais_cells", steps=density)
def lane_mask_p90(d):
    return "select cell from lane_cells"


def lanes_away(table):
    """``cell, cells``: distance to the nearest lane cell by the distance transform."""
    grid = table("grid")
    return distance_transform(grid, grid.sparkSession.sql(lane_mask_p90.text(SPARK)))


@query("lane_distance", "grid", "ais_cells", steps=density, frame=lambda t: lanes_away(t).select("cell", F.round(F.col("cells") * CELL_KM, 4).alias("lane_km")))
def lane_distance(d):
    return f"select g.cell, round({CELL_KM}e0 * min(sqrt(power(g.ix - l.ix, 2) + power(g.iy - l.iy, 2))), 4) as lane_km from grid g cross join lane_cells l group by g.cell"


#: Of each cell the distance to the nearest of the terminals.
TO_TERMINAL = f"select cell, round(min({haversine('lon', 'lat', 'tlon', 'tlat')}), 4) as terminal_km from grid cross join terminals group by cell"


@query("terminal_distance", "grid", "terminals", "ais_cells")
def terminal_distance(d):
    return f"select g.cell, t.terminal_km, coalesce(n.n, 0) as fixes from grid g join ({TO_TERMINAL}) t on t.cell = g.cell left join {OF_CELL} n on n.ix = g.ix and n.iy = g.iy"


@query("target_grid", "grid", "hist_slicks")
def target_grid(d):
    ix, iy = d.trunc("(centroid_lon - 21.475e0) / 0.05e0"), d.trunc("(61e0 - centroid_lat) / 0.05e0")
    return f"""select g.cell, case when t.ix is null then 0 else 1 end as target from grid g left join (
  select distinct {ix} as ix, {iy} as iy from hist_slicks where cls in (2, 4, 5, 6, 7, 8)) t on g.ix = t.ix and g.iy = t.iy"""


def features(table):
    """Of each sea cell: distances to shore, lane and terminal, density, place."""
    grid = table("grid")
    spark = grid.sparkSession
    shore = shore_grid(table).filter("cells > 0").select("cell", F.round(F.col("cells") * CELL_KM, 4).alias("shore_km"))
    dense, far = spark.sql(ais_density.text(SPARK)), spark.sql(with_tables(SPARK, ("grid", "terminals")) + TO_TERMINAL)
    lane = lanes_away(table).select("cell", F.round(F.col("cells") * CELL_KM, 4).alias("lane_km"))
    rows = grid.join(shore, "cell").join(dense, "cell").join(lane, "cell").join(far, "cell")
    return rows.select("cell", "shore_km", "density", "lane_km", "terminal_km", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("risk_features", "grid", "ais_cells", "terminals", "land", steps=lambda d: density(d) + valid_land(d), frame=features)
def risk_features(d):
    return f"""select g.cell, round(s.cells * {CELL_KM}e0, 4) as shore_km, round(ln(1e0 + coalesce(n.n, 0)), 5) as density, l.lane_km, t.terminal_km, round(g.lat, 6) as lat, round(g.lon, 6) as lon
  from grid g join shore s on s.cell = g.cell left join dense n on g.ix = n.ix and g.iy = n.iy
  left join (select a.cell, round({CELL_KM}e0 * min(sqrt(power(a.ix - b.ix, 2) + power(a.iy - b.iy, 2))), 4) as lane_km from grid a cross join lane_cells b group by a.cell) l on l.cell = g.cell
  left join ({TO_TERMINAL}) t on t.cell = g.cell where s.cells > 0"""


@query("ring_centroid_area", "ring_edges")
def ring_centroid_area(d):
    cross = "(x1 * y2 - x2 * y1)"
    return f"""select id, round(sum((x1 + x2) * {cross}) / nullif(3e0 * sum({cross}), 0e0), 4) as lon, round(sum((y1 + y2) * {cross}) / nullif(3e0 * sum({cross}), 0e0), 4) as lat,
  round(abs(sum((x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0)) / 2e0) * 111.320e0 * 111.320e0 * cos(radians(max(y0))), 4) as area_km2, round(min(x1), 5) as lon0, round(max(x1), 5) as lon1
  from (select *, min(x1) over (partition by id) as x0, min(y1) over (partition by id) as y0 from ring_edges) e group by id"""


@query("point_in_polygon", "ring_edges", "slicks")
def point_in_polygon(d):
    px, py = "(s.centroid_lon + (p.k - 4) * 0.012e0)", "(s.centroid_lat + (p.k - 4) * 0.003e0 + 1e-5)"
    return f"""select s.id, p.k, count_if((e.y1 > {py}) <> (e.y2 > {py}) and {px} < (e.x2 - e.x1) * ({py} - e.y1) / nullif(e.y2 - e.y1, 0e0) + e.x1) % 2 = 1 as inside
  from slicks s cross join {d.numbers(9, 'k')} p join ring_edges e on e.id = s.id group by s.id, p.k"""


@query("slick_axes", "ring_edges")
def slick_axes(d):
    # The closing vertex counts twice, as it is in the ring's list.
    pts = "select id, x1 as x, y1 as y from ring_edges union all select id, x1, y1 from ring_edges where k = 0"
    return f"""select id, round(sqrt(greatest((sxx + syy) / 2e0 + r, 0e0)), 4) as major, round(sqrt(greatest((sxx + syy) / 2e0 - r, 0e0)), 4) as minor, round({d.pmod('degrees(0.5e0 * atan2(2e0 * sxy, sxx - syy))', '180e0')}, 2) as orientation from (
  select *, sqrt(power((sxx - syy) / 2e0, 2) + sxy * sxy) as r from (
    select id, var_samp(x) as sxx, var_samp(y) as syy, covar_samp(x, y) as sxy from (select p.id, (p.x - s.cx) * 111.320e0 * cos(radians(s.cy)) as x, (p.y - s.cy) * 110.574e0 as y from ({pts}) p
      join (select id, avg(x1) as cx, avg(y1) as cy from ring_edges group by id) s on s.id = p.id) m group by id) c) v"""


QUERIES = (grid_cells, ais_density, lane_mask_p90, lane_distance, terminal_distance, target_grid, risk_features, ring_centroid_area, point_in_polygon, slick_axes)
