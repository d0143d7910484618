"""Rules of the inputs: archives, scene files, met windows, polygons' bounds, tiles and pages, as set operations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewake.plans.dialect import SPARK
from tidewake.plans.query import query
from tidewake.sources.fixtures import AOI

#: Pixels of a scene after decimation, particles of a drawn path, rows of a page.
MAX_PIXELS, PATHS, PAGE_ROWS = 40_000_000, 120, 1000
#: Degrees around the footprints of a training scene, and the training tiles: side, stride, positive pixels, least negatives.
TRAIN_MARGIN, TILE, STRIDE, POSITIVE, LEAST = 0.08, 16, 8, 40, 40

#: Seconds of a day and of the live field (14 days back, 3 ahead), and what stands for a field that isn't there.
DAY_S, LIVE_S, CALM = 86400.0, 17 * 86400.0, (5.0, -3.0, 0.1, -0.05)


@query("band_choice", "files")
def band_choice(d):
    """VV first, else the first file by name; its band is what the name says."""
    return """select scene, name, case when lower(name) like '%vv%' then 'vv' when lower(name) like '%vh%' then 'vh' else 'vv' end as band from (
  select *, row_number() over (partition by scene order by case when lower(name) like '%vv%' then 0 else 1 end, name) as rn from files where name like '%.tiff') r where rn = 1"""


@query("directory_sizes", "files")
def directory_sizes(d):
    return "select directory, count(*) as n_files, cast(sum(bytes) as bigint) as bytes from files group by directory"


@query("scene_files", "files", "scenes")
def scene_files(d):
    """Files by scene, with what is known of it; files of unknown scenes stay."""
    return """select f.scene, s.name, s.status, f.n_files, f.bytes from (select scene, count(*) as n_files, cast(sum(bytes) as bigint) as bytes from files group by scene) f
  left join scenes s on s.seq = f.scene"""


@query("calibration_vectors", "calibration")
def calibration_vectors(d):
    """(line, pixel, value) of a calibration document; lists of both sides go by position."""
    if d.spark:
        vectors = "posexplode(from_xml(xml, 'calibrationVector array<struct<line:int,pixel:string,sigmaNought:string>>').calibrationVector)"
        return f"""select scene, line, cast(split(pixel, ' ')[i] as int) as pixel, round(cast(split(sigma, ' ')[i] as double), 4) as sigma from (
  select scene, v.line as line, v.pixel as pixel, v.sigmaNought as sigma, posexplode(split(v.pixel, ' ')) as (i, part) from (select scene, {vectors} as (k, v) from calibration) a) b"""
    return """select scene, line, cast(string_split(pixel, ' ')[i] as int) as pixel, round(cast(string_split(sigma, ' ')[i] as double), 4) as sigma from (
  select scene, cast(regexp_extract(v, '<line>([0-9]+)<', 1) as int) as line, regexp_extract(v, '<pixel>([^<]*)<', 1) as pixel, regexp_extract(v, '<sigmaNought>([^<]*)<', 1) as sigma, unnest(range(1, 5)) as i
  from (select scene, unnest(string_split(xml, '</calibrationVector>')[:3]) as v from calibration) a) b"""


@query("scene_decimation", "scenes")
def scene_decimation(d):
    """The least whole factor that brings a window within the pixel limit, and the size of what is read."""
    return f"""select product_id, decim, cast(greatest(floor(h / decim), 1e0) as bigint) as out_h, cast(greatest(floor(w / decim), 1e0) as bigint) as out_w from (
  select *, greatest(ceil(sqrt(h * w / {MAX_PIXELS}e0)), 1e0) as decim from (select product_id, 5e3 + seq * 31 % 12000 as h, 8e3 + seq * 57 % 18000 as w from scenes) s) t"""


def window_fields(table):
    """Joined on (point, day): a window asks for the days that it touches, so no side is broadcast and no row meets rows of other days."""
    windows, met = table("met_windows"), table("met_obs")
    live = met.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).select(F.greatest("first_ts", F.col("last_ts") - LIVE_S).alias("first_ts"), "last_ts")
    known = windows.crossJoin(live)  # one row
    covered = F.coalesce((F.col("first_ts") <= F.col("t0")) & (F.col("last_ts") >= F.col("t1")), F.lit(False))
    day = lambda c: F.floor(c / DAY_S)
    known = known.withColumn("live", covered).withColumn("lo", F.when(F.col("live"), F.col("t0")).otherwise(day(F.col("t0")) * DAY_S))
    known = known.withColumn("hi", F.when(F.col("live"), F.col("t1")).otherwise((day(F.col("t1")) + 2) * DAY_S))
    asked = known.select("id", "live", "lo", "hi", F.explode(F.sequence(day(F.col("lo")), day(F.col("hi")))).alias("day"))
    hours = asked.join(met.withColumn("day", day(F.col("ts"))), "day")
    inside = (F.col("ts") >= F.col("lo")) & F.when(F.col("live"), F.col("ts") <= F.col("hi")).otherwise(F.col("ts") < F.col("hi"))
    parts = ("wind_u", "wind_v", "cur_u", "cur_v")
    found = hours.filter(inside).groupBy("id", "ix", "iy").agg(F.count("*").alias("hours"), *(F.avg(c).alias(c) for c in parts))
    points = known.select("id", "live").crossJoin(table("met_points")).join(found, ["id", "ix", "iy"], "left")
    any_hour = found.groupBy("id").agg(F.lit(1).alias("some"))
    source = F.when(F.col("live"), "live").when(F.col("some").isNotNull(), "dates").otherwise("constant")
    # What a point lacks within a field is 0; a window without any field has the constants.
    value = [(F.round(F.when(F.col("source") == "constant", F.lit(k)).otherwise(F.coalesce(c, F.lit(0.0))), 4) + 0.0).alias(c) for c, k in zip(parts, CALM, strict=True)]
    return points.join(any_hour, "id", "left").withColumn("source", source).select("id", "ix", "iy", "source", F.coalesce("hours", F.lit(0)).alias("hours"), *value)


@query("met_window", "met_windows", "met_obs", "met_points", frame=window_fields)
def met_window(d):
    """Where each point of a window's field comes from: the live field if it covers the window, else the dates' hours, else constants."""
    at = f"case when w.live then m.ts between w.t0 and w.t1 else m.ts >= floor(w.t0 / {DAY_S}) * {DAY_S} and m.ts < (floor(w.t1 / {DAY_S}) + 2) * {DAY_S} end"
    pick = lambda c, k: f"round(case when source = 'constant' then {k}e0 else coalesce({c}, 0e0) end, 4) + 0e0 as {c}"
    return f"""select id, ix, iy, source, hours, {", ".join(pick(c, k) for c, k in zip(("wind_u", "wind_v", "cur_u", "cur_v"), CALM, strict=True))} from (
  select p.id, p.ix, p.iy, p.hours, wind_u, wind_v, cur_u, cur_v, case when live then 'live' when sum(hours) over (partition by id) > 0 then 'dates' else 'constant' end as source from (
    select w.id, q.ix, q.iy, w.live, count(m.ts) as hours, avg(m.wind_u) as wind_u, avg(m.wind_v) as wind_v, avg(m.cur_u) as cur_u, avg(m.cur_v) as cur_v
    from (select w.*, coalesce(greatest(l.first_ts, l.last_ts - {LIVE_S}) <= w.t0 and l.last_ts >= w.t1, false) as live from met_windows w cross join (select min(ts) as first_ts, max(ts) as last_ts from met_obs) l) w
    cross join met_points q left join met_obs m on m.ix = q.ix and m.iy = q.iy and {at} group by w.id, q.ix, q.iy, w.live) p) s"""


@query("field_coverage", "slicks", "met")
def field_coverage(d):
    return "select s.id, s.detected_at - 3600e0 * (id % 20) >= m.first_ts and s.detected_at <= m.last_ts as covered from slicks s cross join (select min(ts) as first_ts, max(ts) as last_ts from met) m"


#: Particles of a task.
TASK = 500_000


def dealt_paths(table):
    """Runs are dealt to tasks by the number of particles, so a task's sort doesn't grow with them."""
    rows = table("particles")
    spark, view = rows.sparkSession, f"particles_{uuid.uuid4().hex}"
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // TASK)
    rows.repartition(n, "slick_id").createOrReplaceTempView(view)
    return spark.sql(decimated_paths.body(SPARK).replace("particles", view))


@query("decimated_paths", "particles", frame=dealt_paths)
def decimated_paths(d):
    """At most ``PATHS`` particles of a run, evenly spaced, the first and the last among them: those at floor(k (n - 1) / (PATHS - 1))."""
    k = d.idiv(f"(i * {PATHS - 1} + n - 2)", "(n - 1)")
    return f"""select slick_id, i, round(x, 3) as x, round(y, 3) as y from (select p.*, n, row_number() over (partition by p.slick_id order by step, x, y) - 1 as i from particles p
    join (select slick_id, count(*) as n from particles group by slick_id) c on c.slick_id = p.slick_id) r
  where case when n <= {PATHS} then true else {d.idiv(f'({k} * (n - 1))', str(PATHS - 1))} = i end"""


@query("largest_polygon", "ring_edges", "slicks")
def largest_polygon(d):
    """Of a patch's outlines the one of the greatest area, by the outlines' own areas."""
    area = "abs(sum((e.x1 - s.centroid_lon) * (e.y2 - s.centroid_lat) - (e.x2 - s.centroid_lon) * (e.y1 - s.centroid_lat))) / 2e0 * 111.320e0 * 111.320e0 * cos(radians(max(s.centroid_lat)))"
    return f"""select patch, k, area from (select patch, k, area, row_number() over (partition by patch order by area desc, k) as rn from (
  select cast(e.id % 40 as bigint) as patch, e.id as k, round({area}, 4) as area from ring_edges e join slicks s on s.id = e.id group by e.id) a) r where rn = 1"""


@query("footprint_in_box", "ring")
def footprint_in_box(d):
    """The part of a footprint's bounds within a box; none if they don't meet."""
    lon0, lat0, lon1, lat1 = (f"{x}e0" for x in (AOI[0] + 1, AOI[1] + 0.4, AOI[2] - 2, AOI[3] - 0.4))
    return f"""select id, round(greatest(x0, {lon0}), 5) as lon0, round(greatest(y0, {lat0}), 5) as lat0, round(least(x1, {lon1}), 5) as lon1, round(least(y1, {lat1}), 5) as lat1
  from (select id, min(lon) as x0, max(lon) as x1, min(lat) as y0, max(lat) as y1 from ring group by id) b where greatest(x0, {lon0}) < least(x1, {lon1}) and greatest(y0, {lat0}) < least(y1, {lat1})"""


@query("union_bounds", "ring", "slicks")
def union_bounds(d):
    m = f"{TRAIN_MARGIN}e0"
    return f"select scene_id, round(min(lon) - {m}, 5) as lon0, round(min(lat) - {m}, 5) as lat0, round(max(lon) + {m}, 5) as lon1, round(max(lat) + {m}, 5) as lat1 from ring r join slicks s on s.id = r.id group by scene_id"


@query("segmenter_choice", "scenes")
def segmenter_choice(d):
    """The mode that was asked for, where its checkpoint is; the threshold otherwise."""
    return """select product_id, mode, has_checkpoint, case when mode in ('auto', 'unet') and has_checkpoint then 'unet' else 'heuristic' end as chosen
  from (select product_id, case seq % 3 when 0 then 'auto' when 1 then 'unet' else 'heuristic' end as mode, status <> 'error' as has_checkpoint from scenes) m"""


@query("tile_sampling", "sar")
def tile_sampling(d):
    """Training tiles: mostly finite, with enough dark pixels or none; of the latter half as many again as of the former, or ``LEAST``, by a fixed hash."""
    return f"""select i, j, kind from (select *, row_number() over (partition by kind order by md5(cast(i as varchar(9)) || '/' || cast(j as varchar(9))), i, j) as rn, count(case when kind = 'pos' then 1 end) over () as n_pos from (
    select i, j, case when dark >= {POSITIVE} then 'pos' else 'neg' end as kind from (
      select t.i, t.j, count_if(s.v < -24e0) as dark, count(s.v) as finite from (select a.i * {STRIDE} as i, b.j * {STRIDE} as j from {d.numbers((64 - TILE) // STRIDE, 'i')} a cross join {d.numbers((64 - TILE) // STRIDE, 'j')} b) t
        join sar s on s.r between t.i and t.i + {TILE - 1} and s.c between t.j and t.j + {TILE - 1} group by t.i, t.j) n
    where finite >= 0.9e0 * {TILE * TILE} and (dark >= {POSITIVE} or dark = 0)) k) r where kind = 'pos' or rn <= greatest(1.5e0 * n_pos, {LEAST})"""


@query("patch_levels", "particles")
def patch_levels(d):
    """Labelled patches: values that look like digital numbers become decibels."""
    return """select p.slick_id, p.step, round(case when m.hi > 0 and m.lo >= 0 then 10e0 * log10(greatest(p.v, 1e-3)) else p.v end, 4) as db from (select slick_id, step, x - case when slick_id % 2 = 0 then 1e7 else 0e0 end as v from particles) p
  join (select slick_id, max(x - case when slick_id % 2 = 0 then 1e7 else 0e0 end) as hi, min(x - case when slick_id % 2 = 0 then 1e7 else 0e0 end) as lo from particles group by slick_id) m on m.slick_id = p.slick_id"""


def numbered(d):
    """Rows within a box, numbered from 0 by id: within a range of ids by a window, before it by the ranges' counts."""
    return [
        ("boxed", f"select id, {d.idiv('id', '4096')} as part from hist_slicks where centroid_lon between {AOI[0]}e0 and {AOI[2]}e0 and centroid_lat between 55e0 and 63e0"),
        ("parts", "select part, count(*) as n from boxed group by part"),
        ("before_part", "select part, cast(coalesce(sum(n) over (order by part rows between unbounded preceding and 1 preceding), 0) as bigint) as earlier from parts"),
        ("in_order", "select b.id, p.earlier + row_number() over (partition by b.part order by b.id) - 1 as i from boxed b join before_part p on p.part = b.part"),
    ]


@query("historical_pages", "hist_slicks", steps=numbered)
def historical_pages(d):
    """Rows within a box by pages, all of them; the last page is the first short one.  A fetch's limit of pages is its reader's."""
    return f"select page, count(*) as n, min(id) as first_id, max(id) as last_id from (select id, {d.idiv('i', str(PAGE_ROWS))} as page from in_order) p group by page"


QUERIES = (band_choice, directory_sizes, scene_files, calibration_vectors, scene_decimation, met_window, field_coverage, decimated_paths, largest_polygon, footprint_in_box, union_bounds, segmenter_choice, tile_sampling, patch_levels, historical_pages)
