"""Convex outlines cut by boxes: four half-planes folded over the ring's edges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.plans.query import query

#: Side of a tile in degrees.
TILE = 0.25


def _edges(ring: Column) -> Column:
    """(a, b) of each edge; the ring isn't closed."""
    return F.zip_with(ring, F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _half(ring: Column, plane: Column) -> Column:
    """The part of a ring where x * plane.a + y * plane.b + plane.c is not negative."""
    side = lambda p: p.x * plane.a + p.y * plane.b + plane.c

    def cut(e: Column) -> Column:
        share = side(e.a) / (side(e.a) - side(e.b))
        return F.struct((e.a.x + share * (e.b.x - e.a.x)).alias("x"), (e.a.y + share * (e.b.y - e.a.y)).alias("y"))

    def step(e: Column) -> Column:
        in_a, in_b = side(e.a) >= 0, side(e.b) >= 0
        return F.when(in_a & in_b, F.array(e.b)).when(in_a, F.array(cut(e))).when(in_b, F.array(cut(e), e.b)).otherwise(F.slice(F.array(e.b), 1, 0))

    return F.flatten(F.transform(_edges(ring), step))


def clip_to_box(ring: Column, box: tuple[Column, Column, Column, Column]) -> Column:
    """A convex ring (an array of structs x, y, not closed) within a box (x0, y0, x1, y1); empty where they don't meet."""
    planes = ((1.0, 0.0, -box[0]), (-1.0, 0.0, box[2]), (0.0, 1.0, -box[1]), (0.0, -1.0, box[3]))
    listed = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), c.alias("c")) for a, b, c in planes))
    return F.aggregate(listed, ring, _half)


def area(ring: Column) -> Column:
    """Area of a ring in the square of its unit; relative to its first corner, for the sake of digits."""
    p = F.get(ring, F.lit(0))
    cross: Callable[[Column], Column] = lambda e: (e.a.x - p.x) * (e.b.y - p.y) - (e.b.x - p.x) * (e.a.y - p.y)
    return F.abs(F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + cross(e))) / 2


def tiles_of(table) -> DataFrame:
    """Each footprint by the tiles that it lies in, tile by tile of its bounds."""
    corners = table("ring").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", F.col("lon").alias("x"), F.col("lat").alias("y")))).alias("ring"))
    rings = corners.select("id", F.transform("ring", lambda p: F.struct(p.x.alias("x"), p.y.alias("y"))).alias("ring"))

    def spread(axis: str) -> Column:
        at = F.transform("ring", lambda p: F.floor(p[axis] / TILE))
        return F.explode(F.sequence(F.array_min(at), F.array_max(at)))

    cells = rings.select("*", spread("x").alias("ix")).select("*", spread("y").alias("iy"))
    box = tuple(F.col(i) * TILE + more for i, more in (("ix", 0.0), ("iy", 0.0), ("ix", TILE), ("iy", TILE)))
    cut = cells.withColumn("ring", clip_to_box(F.col("ring"), box)).filter(F.size("ring") >= 3).withColumn("area", area(F.col("ring")))
    xs, ys = F.transform("ring", lambda p: p.x), F.transform("ring", lambda p: p.y)
    ends = [F.round(f(c), 6).alias(n) for c, f, n in ((xs, F.array_min, "lon0"), (ys, F.array_min, "lat0"), (xs, F.array_max, "lon1"), (ys, F.array_max, "lat1"))]
    return cut.filter("area > 1e-9").select("id", "ix", "iy", F.round(F.col("area") * 1e6, 3).alias("area_e6"), *ends)


@query("footprint_tiles", "ring", "ring_edges", frame=tiles_of)
def footprint_tiles(d):
    """The same from the corners of each inside the other and the crossings of their sides, by angle."""
    t = f"{TILE}e0"
    inside_box = "x >= left_ - 1e-12 and x <= right_ + 1e-12 and y >= low_ - 1e-12 and y <= high_ + 1e-12"
    return f"""select id, ix, iy, round(area * 1e6, 3) as area_e6, round(lon0, 6) as lon0, round(lat0, 6) as lat0, round(lon1, 6) as lon1, round(lat1, 6) as lat1 from (
  select id, ix, iy, abs(sum((x - ox) * (ny - oy) - (nx - ox) * (y - oy))) / 2e0 as area, min(x) as lon0, min(y) as lat0, max(x) as lon1, max(y) as lat1 from (
    select *, coalesce(lead(x) over w, first_value(x) over w) as nx, coalesce(lead(y) over w, first_value(y) over w) as ny from (
      select *, min(x) over g as ox, min(y) over g as oy, atan2(y - avg(y) over g, x - avg(x) over g) as turn from (
        select distinct id, ix, iy, round(x, 11) as x, round(y, 11) as y from (
          select b.id, ix, iy, left_, low_, right_, high_, r.lon as x, r.lat as y from boxes b join ring r on r.id = b.id
          union all
          select id, ix, iy, left_, low_, right_, high_, cx, cy from (
            select b.*, case when c.k in (0, 3) then left_ else right_ end as cx, case when c.k < 2 then low_ else high_ end as cy from boxes b cross join (select unnest(range(4)) as k) c) q
          where (select count(*) from ring_edges e where e.id = q.id and (e.x2 - e.x1) * (cy - e.y1) - (e.y2 - e.y1) * (cx - e.x1) >= 0) in (0, 4)
          union all
          select b.id, ix, iy, left_, low_, right_, high_, s.bound, e.y1 + (e.y2 - e.y1) * (s.bound - e.x1) / (e.x2 - e.x1) from boxes b join ring_edges e on e.id = b.id
            cross join lateral (select unnest([left_, right_]) as bound) s where (e.x1 - s.bound) * (e.x2 - s.bound) < 0
          union all
          select b.id, ix, iy, left_, low_, right_, high_, e.x1 + (e.x2 - e.x1) * (s.bound - e.y1) / (e.y2 - e.y1), s.bound from boxes b join ring_edges e on e.id = b.id
            cross join lateral (select unnest([low_, high_]) as bound) s where (e.y1 - s.bound) * (e.y2 - s.bound) < 0) p
        where {inside_box}) u window g as (partition by id, ix, iy)) a window w as (partition by id, ix, iy order by turn)) o group by id, ix, iy) f
  where area > 1e-9""".replace("boxes b", f"""(select id, ix, iy, ix * {t} as left_, iy * {t} as low_, (ix + 1) * {t} as right_, (iy + 1) * {t} as high_ from (
            select id, ix, unnest(range(ya, yb + 1)) as iy from (select id, unnest(range(xa, xb + 1)) as ix, ya, yb from (
              select id, cast(floor(min(lon) / {t}) as bigint) as xa, cast(floor(max(lon) / {t}) as bigint) as xb, cast(floor(min(lat) / {t}) as bigint) as ya, cast(floor(max(lat) / {t}) as bigint) as yb from ring group by id) m) n) k) b""")


QUERIES = (footprint_tiles,)
