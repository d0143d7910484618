"""Met fields and drift: explode, components, trilinear sampling, integration, snapshots."""

from __future__ import annotations

from tidewake.plans.query import query

#: Windage share of the wind, its deflection to the right (degrees), Stokes share and step (s).
WINDAGE, DEFLECTION, STOKES, STEP = 0.03, 20.0, 0.02, 300


@query("met_explode", "slicks")
def met_explode(d):
    wind = "transform(sequence(0, 23), i -> 5e0 + sin(p + i / 3e0))" if d.spark else "list_transform(range(0, 24), lambda i: 5e0 + sin(p + i / 3e0))"
    src = f"(select p, {wind} as speeds from (select id as p from slicks) n)"
    if d.spark:
        return f"select p, pos as hour, round(speed, 5) as speed from {src} s lateral view posexplode(speeds) x as pos, speed"
    return f"select p, cast(hour as int) as hour, round(speeds[hour + 1], 5) as speed from {src} s cross join {d.numbers(24, 'hour')} h"


@query("uv_from_dir", "ais")
def uv_from_dir(d):
    return "select event_id, round(-coalesce(sog, 0e0) * sin(radians(cog)), 5) as u, round(-coalesce(sog, 0e0) * cos(radians(cog)), 5) as v from ais"


@query("local_frame", "ring", "slicks")
def local_frame(d):
    return "select r.id, r.k, round((r.lon - s.centroid_lon) * 111320e0 * cos(radians(s.centroid_lat)), 3) as x_m, round((r.lat - s.centroid_lat) * 111320e0, 3) as y_m from ring r join slicks s on s.id = r.id"


@query("morph_age", "releases")
def morph_age(d):
    return "select id, round(age_h, 4) as age_h, round(release_ts, 3) as release_ts from releases"


@query("morph_age_of_outline", "ring", "ring_edges", "slicks")
def morph_age_of_outline(d):
    """The age of slicks whose axis or area isn't known, from their outline's bounds and area; others' from what is known."""
    mx = "111320e0 * cos(radians(centroid_lat))"
    return f"""select id, missing, round(greatest(least(0.8e0 + 0.4e0 * major_km + 0.5e0 * sqrt(km2), 17e0), 1e0), 4) as age_h from (
  select s.id, s.missing, case when s.missing then greatest(b.dx * {mx} / 1e3, b.dy * 111320e0 / 1e3, 0.2e0) else s.major_axis_km end as major_km,
    case when s.missing then greatest(e.deg2 * ({mx}) * 111320e0 / 1e6, 0.05e0) else s.area_km2 end as km2
  from (select id, centroid_lat, major_axis_km, area_km2, id % 3 = 0 as missing from slicks) s join (select id, max(lon) - min(lon) as dx, max(lat) - min(lat) as dy from ring group by id) b on b.id = s.id
  join (select e.id, abs(sum((x1 - c.centroid_lon) * (y2 - c.centroid_lat) - (x2 - c.centroid_lon) * (y1 - c.centroid_lat))) / 2e0 as deg2 from ring_edges e join slicks c on c.id = e.id group by e.id) e on e.id = s.id) a"""


@query("origin_sigma", "slicks")
def origin_sigma(d):
    return "select id, round(greatest((id * 37 % 4000) / 1e3, 0.3e0 + 0.1e0 * major_axis_km, 0.5e0) + 1e-9, 2) as sigma_km, round(least(greatest((id * 37 % 4000) / 1e3, 0.3e0 + 0.1e0 * major_axis_km, 0.5e0) / 3e0, 6e0), 4) as age_sigma_h from slicks"


@query("forecast_cone", "slicks")
def forecast_cone(d):
    return f"select id, h, round(0.6e0 * (id * 37 % 4000 + 50e0 * h) / 1e3 + greatest(0.1e0 * coalesce(major_axis_km, 0e0), 0.1e0), 4) as radius_km from slicks cross join {d.numbers(25, 'h')} n"


@query("shape_factors", "slicks")
def shape_factors(d):
    cross = f"sin({d.pmod('abs(radians(orientation_deg) - 0.7e0)', 'pi()')})"
    ratio = "least(greatest(major_axis_km / minor_axis_km, 1e0), 5e0)"
    return f"select id, round({WINDAGE}e0 * (1e0 + 0.22e0 * ({ratio} - 1e0) * {cross}), 6) as windage, round({DEFLECTION}e0 + 7.5e0 * ({cross} - 0.5e0), 4) as deflection from slicks"


@query("ensemble_spread", "particles")
def ensemble_spread(d):
    return """select slick_id, step, round(avg(x), 3) as x, round(avg(y), 3) as y, round(sqrt(avg(power(x - cx, 2) + power(y - cy, 2))), 3) as spread, count(*) as n
  from (select *, avg(x) over (partition by slick_id, step) as cx, avg(y) over (partition by slick_id, step) as cy from particles) p group by slick_id, step"""


@query("snapshot_nearest_age", "particles", "releases")
def snapshot_nearest_age(d):
    return """select id, step, round(gap, 4) as gap from (select r.id, p.step, abs(r.age_h - p.step) as gap, row_number() over (partition by r.id order by abs(r.age_h - p.step), p.step) as rn
  from releases r join (select distinct slick_id, step from particles) p on p.slick_id = r.id) s where rn = 1"""


@query("field_sample_trilinear", "met", "slicks")
def field_sample_trilinear(d):
    # Cell and fraction are clipped to the grid; eight corners join on their indexes.
    low = lambda x, n: f"cast(least(greatest(floor({x}), 0e0), {n}e0) as int)"
    clip = lambda x: f"least(greatest({x}, 0e0), 1e0)"
    return f"""select q.id, round(sum(w * wind_u), 5) as wind_u, round(sum(w * wind_v), 5) as wind_v, round(sum(w * cur_u), 5) as cur_u, round(sum(w * cur_v), 5) as cur_v from (
  select id, i + a.b as ix, j + e.b as iy, k + f.b as it, case when a.b = 1 then fx else 1e0 - fx end * case when e.b = 1 then fy else 1e0 - fy end * case when f.b = 1 then ft else 1e0 - ft end as w from (
    select *, {clip('gx - i')} as fx, {clip('gy - j')} as fy, {clip('gt - k')} as ft from (
      select *, {low('gx', 4)} as i, {low('gy', 3)} as j, {low('gt', 22)} as k from (
        select id, (centroid_lon - 21.8e0) / 1.76e0 as gx, (centroid_lat - 58.9e0) / 0.45e0 as gy, detected_at / 3600e0 as gt from slicks) g) h) c
    cross join {d.numbers(2, 'b')} a cross join {d.numbers(2, 'b')} e cross join {d.numbers(2, 'b')} f) q
  join met m on m.ix = q.ix and m.iy = q.iy and m.it = q.it group by q.id"""


@query("drift_deterministic")
def drift_deterministic(d):
    # Constant forcing: both midpoint stages see the same velocity; a snapshot an hour (12 steps).
    turn = f"radians(-{DEFLECTION}e0)"
    u = f"(0.1e0 + {WINDAGE}e0 * (5e0 * cos({turn}) - -3e0 * sin({turn})) + {STOKES}e0 * 5e0)"
    v = f"(-0.05e0 + {WINDAGE}e0 * (5e0 * sin({turn}) + -3e0 * cos({turn})) + {STOKES}e0 * -3e0)"
    first = "select 0, cast(0e0 as double), cast(0e0 as double)"
    step = f"select step + 1, x + {STEP}e0 * {u}, y + {STEP}e0 * {v} from run where step < 288"
    return d.recursion("run", "step, x, y", first, step, 300) + " select cast(step as int) as step, round(x, 4) as x, round(y, 4) as y from run where step % 12 = 0"


QUERIES = (met_explode, uv_from_dir, local_frame, morph_age, morph_age_of_outline, origin_sigma, forecast_cone, shape_factors, ensemble_spread, snapshot_nearest_age, field_sample_trilinear, drift_deterministic)
