"""Radar rasters in long form: decibels, Lee filter, thresholds, morphology, texture, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewake.operators import tiles
from tidewake.plans.query import query

#: Side of the fixture's raster, and of its background blocks (over ``LEAST_BLOCK`` pixels each).
SIDE, BLOCK_SIDE = 64, 32


def around(d, name: str, source: str, reach: int, agg: str) -> tuple[str, str]:
    """Aggregates over the square of neighbours, edges mirrored, as offsets joined on pixels."""
    side = 2 * reach + 1
    fold = lambda x: f"case when {x} < 0 then -{x} - 1 when {x} > {SIDE - 1} then {2 * SIDE - 1} - {x} else {x} end"
    return (name, f"""select p.r, p.c, {agg} from (select r, c, {fold(f'(r + a.i - {reach})')} as nr, {fold(f'(c + b.j - {reach})')} as nc from {source} cross join {d.numbers(side, 'i')} a cross join {d.numbers(side, 'j')} b) p
  join {source} q on q.r = p.nr and q.c = p.nc group by p.r, p.c""")


def lee(d):
    return [
        around(d, "local", "sar", 3, "avg(q.v) as m, greatest(avg(q.v * q.v) - avg(q.v) * avg(q.v), 1e-6) as var"),
        ("noise", "select greatest(avg(var), 1e-3) as nv from local"),
        ("smooth", "select s.r, s.c, l.m + l.var / (l.var + n.nv) * (s.v - l.m) as v from sar s join local l on l.r = s.r and l.c = s.c cross join noise n"),
    ]


def blocks(d):
    br, bc = (d.idiv(f"s.{k}", str(BLOCK_SIDE)) for k in "rc")
    return [
        ("stats", f"select {d.idiv('r', str(BLOCK_SIDE))} as br, {d.idiv('c', str(BLOCK_SIDE))} as bc, count(*) as n, avg(v) as mu, stddev_pop(v) as sd from sar group by 1, 2"),
        ("dark", f"""select s.r, s.c, s.v from sar s join stats b on b.br = {br} and b.bc = {bc} cross join (select avg(v) as mu, stddev_pop(v) as sd from sar) g
  where s.v < case when b.n >= {tiles.LEAST_BLOCK} then b.mu else g.mu end - {tiles.K_SIGMA}e0 * case when b.n >= {tiles.LEAST_BLOCK} then b.sd else g.sd end"""),
    ]


def tiled(table):
    return tiles.tiled(table("sar").selectExpr("'scene' as scene", "cast(r as bigint) as r", "cast(c as bigint) as c", "v"), BLOCK_SIDE)


@query("lee_filter", "sar", steps=lee)
def lee_filter(d):
    return "select r, c, round(v, 4) as v from smooth"


@query("block_stats", "sar", steps=blocks)
def block_stats(d):
    return "select cast(br as int) as br, cast(bc as int) as bc, n, round(mu, 4) as mu, round(sd, 4) as sd from stats"


@query("dark_pixels", "sar", steps=blocks)
def dark_pixels(d):
    return "select r, c, round(v, 4) as v from dark"


@query("closing_3x3", "sar", steps=lambda d: [*blocks(d), ("mask", "select s.r, s.c, case when k.r is null then 0 else 1 end as v from sar s left join dark k on k.r = s.r and k.c = s.c"), around(d, "grown", "mask", 1, "max(q.v) as v"), around(d, "closed", "grown", 1, "min(q.v) as v")])
def closing_3x3(d):
    return "select r, c from closed where v = 1"


def sized(table):
    found = tiles.sizes(tiles.labelled(tiles.dark(tiled(table)), BLOCK_SIDE), tiles.MIN_AREA_KM2 / 125)
    label = F.shiftright("label", tiles.COLUMN_BITS) * SIDE + F.col("label") % (1 << tiles.COLUMN_BITS)
    return found.select("px", label.alias("label"), "in_band")


@query("component_sizes", "sar", steps=blocks, frame=sized)
def component_sizes(d):
    # The oracle walks from every dark pixel to all that it reaches.
    return f"""select count(*) as px, root as label, count(*) between 125 and 200000 as in_band from (
  select id, min(seen) as root from (with recursive reach as (select cast(r * {SIDE} + c as bigint) as id, cast(r * {SIDE} + c as bigint) as seen, r, c from dark
    union select p.id, cast(k.r * {SIDE} + k.c as bigint), k.r, k.c from reach p join dark k on abs(k.r - p.r) + abs(k.c - p.c) = 1) select id, seen from reach) w group by id) g group by root"""


@query("db_convert", "sar")
def db_convert(d):
    return "select r, c, round(10e0 * log10(power(10e0, v / 10e0)), 4) as db, round(coalesce(least(greatest((v + 32e0) / 24e0, 0e0), 1e0), 0.5e0), 5) as norm from sar"


@query("glcm_homogeneity", "sar")
def glcm_homogeneity(d):
    q = d.trunc("15e0 * least(greatest((v - lo) / greatest(hi - lo, 1e-6), 0e0), 1e0)")
    return f"""select round(sum(n / (1e0 + power(a - b, 2))) / sum(n), 5) as homogeneity, cast(sum(n) as bigint) as pairs from (select x.q as a, y.q as b, count(*) as n from levels x join levels y on y.r = x.r and y.c = x.c + 3 group by 1, 2) g""".replace("levels", f"(select r, c, {q} as q from sar cross join (select {d.percentile('v', 0.02)} as lo, {d.percentile('v', 0.98)} as hi from sar) p)")


@query("tile_plan", "scenes")
def tile_plan(d):
    # 256 px tiles of each scene's thumbnail; the last of each axis lies flush with the edge.
    most = -(-1100 // 256)
    axis = lambda n: f"(select seq, least(k * 256, {n} - 256) as o from sized cross join {d.numbers(most, 'k')} t where k * 256 < {n})"
    sized = "(select seq, 300 + seq * 31 % 800 as h, 260 + seq * 57 % 840 as w from scenes)"
    return f"select y.seq, cast(y.o as int) as y0, cast(y.o + 256 as int) as y1, cast(x.o as int) as x0, cast(x.o + 256 as int) as x1 from {axis('h')} y join {axis('w')} x on x.seq = y.seq".replace("from sized", f"from {sized} s")


@query("lut_interpolate", "sar")
def lut_interpolate(d):
    # Calibration vectors every 10 lines and 16 pixels; a row takes the last line at or before it, pixels interpolate.
    lut = f"(select l.k * 10 as line, p.k * 16 as px, 400e0 + l.k + p.k / 2e0 as s from {d.numbers(7, 'k')} l cross join {d.numbers(5, 'k')} p)"
    return f"""select s.r, s.c, round(a.s + (b.s - a.s) * (s.c - a.px) / 16e0, 4) as sigma from sar s join {lut} a on a.line = {d.idiv('s.r', '10')} * 10 and a.px = {d.idiv('s.c', '16')} * 16
  join {lut} b on b.line = a.line and b.px = a.px + 16"""


def oil_prior(area: str, contrast: str, sharp: str, homog: str, cx: str, dark: str, land: str) -> str:
    """How much a patch is like oil, 0 to 1, without a model; an unknown distance to land adds nothing."""
    sig = lambda x: f"(1e0 / (1e0 + exp(-least(greatest({x}, -30e0), 30e0))))"
    return f"""least(greatest(0.20e0 * {sig(f'(log10(greatest({area}, 0.01e0)) + 1e0) / 1.4e0')} + 0.30e0 * {sig(f'({contrast} - 3.5e0) / 2.5e0')} + 0.15e0 * {sig(f'({sharp} - 1.2e0) / 1.2e0')} + 0.10e0 * ({homog} - 0.45e0) / 0.35e0
  + 0.10e0 * case when {cx} < 8e0 then {sig(f'(6e0 - {cx}) / 2e0')} else 0.15e0 end + 0.05e0 * (1e0 - least({dark}, 1e0)) + case when {land} is null then 0e0 else 0.10e0 * {sig(f'({land} - 3e0) / 3e0')} end, 0e0), 1e0)"""


@query("oil_prior_score", "hist_slicks")
def oil_prior_score(d):
    return f"""select id, round({oil_prior('area', 'contrast', 'sharp', 'homog', 'cx', 'dark', 'land')}, 4) as prior from (
  select id, area_m2 / 1e6 as area, (id % 90) / 1e1 as contrast, (id % 37) / 1e1 as sharp, 0.3e0 + (id % 50) / 1e2 as homog, 1e0 + (id % 100) / 1e1 as cx, (id % 120) / 1e2 as dark, case when id % 7 = 0 then null else (id % 200) / 1e1 end as land from hist_slicks) f"""


@query("pixel_area", "slicks")
def pixel_area(d):
    return "select id, round(111.32e0 * 110.574e0 * cos(radians(least(greatest(centroid_lat, 45e0), 70e0))) * (2e-4 + id / 1e8) * 2e-4, 9) as km2 from slicks"


@query("iou_metrics", "sar", steps=blocks)
def iou_metrics(d):
    return """select tp, fp, fn, round(1e0 * tp / nullif(tp + fp + fn, 0), 5) as iou, round(1e0 * tp / nullif(tp + fn, 0), 5) as recall, round(2e0 * tp / nullif(2 * tp + fp + fn, 0), 5) as dice, round(1e0 * tp / nullif(tp + fp, 0), 5) as prec from (
  select count_if(p and t) as tp, count_if(p and not t) as fp, count_if(t and not p) as fn from (select k.r is not null as p, power(s.r - 30e0, 2) + power(s.c - 34e0, 2) < 100e0 as t from sar s left join dark k on k.r = s.r and k.c = s.c) m) c"""


def areas(rows: DataFrame, fold: str, score: str, label: str, ranges: int = 256) -> DataFrame:
    """``fold, auc``: each positive beats the negatives below it, and half of those beside it.

    Counts by distinct score are combined before the shuffle; what lies below
    comes from the sums of ``ranges`` ranges of scores, and within a range by a
    window over its distinct scores.  Null where a class is missing.
    """
    given = rows.select(F.col(fold).alias("fold"), F.col(score).cast("double").alias("s"), F.col(label).cast("int").alias("y")).filter("s is not null and y is not null")
    ends = given.agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    of_range = F.least(F.floor((F.col("s") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * ranges), F.lit(ranges - 1))
    counts = given.groupBy("fold", "s").agg(F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col("y") == 1, 0).otherwise(1)).alias("neg"))
    counts = counts.crossJoin(F.broadcast(ends)).withColumn("part", F.coalesce(of_range, F.lit(0))).drop("lo", "hi")
    before = Window.partitionBy("fold").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.groupBy("fold", "part").agg(F.sum("neg").alias("n")).select("fold", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lower"))
    within = Window.partitionBy("fold", "part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    below = counts.join(parts, ["fold", "part"]).withColumn("beaten", F.col("lower") + F.coalesce(F.sum("neg").over(within), F.lit(0)) + F.col("neg") / 2)
    sums = below.groupBy("fold").agg(F.sum(F.col("pos") * F.col("beaten")).alias("won"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return sums.select("fold", (F.col("won") / F.nullif(F.col("p").cast("double") * F.col("n"), F.lit(0.0))).alias("auc"))


def slick_areas(table) -> DataFrame:
    rows = table("hist_slicks").selectExpr("cast(id % 5 as int) as fold", "confidence", "case when (id * 31 % 100) / 1e2 + confidence > 1e0 then 1 else 0 end as y")
    return areas(rows, "fold", "confidence", "y").select("fold", F.round("auc", 5).alias("auc"))


#: Side of a test tile and pixels that make a detection in it.
TEST_TILE, DETECTED = 16, 40


@query("segmentation_report", "sar", steps=blocks)
def segmentation_report(d):
    """Of each segmenter its pixel IoU, detection recall and false alarms over test tiles; tiles that are empty on both sides tell nothing."""
    tile = lambda k: d.idiv(f"m.{k}", str(TEST_TILE))
    return f"""select model, count(*) as tiles, round(1e0 * sum(shared) / nullif(sum(pred + truth - shared), 0), 5) as iou,
  round(1e0 * count_if(truth >= {DETECTED} and pred >= {DETECTED}) / nullif(count_if(truth >= {DETECTED}), 0), 5) as recall, count_if(truth < {DETECTED} and pred >= {DETECTED}) as false_alarms from (
  select model, {tile('r')} as ti, {tile('c')} as tj, count_if(p) as pred, count_if(t) as truth, count_if(p and t) as shared from (
    select a.model, s.r, s.c, power(s.r - 30e0, 2) + power(s.c - 34e0, 2) < 100e0 as t, case a.model when 'blocks' then k.r is not null else s.v < -22e0 end as p
    from sar s cross join (select 'blocks' as model union all select 'threshold') a left join dark k on k.r = s.r and k.c = s.c) m group by model, {tile('r')}, {tile('c')}) n where pred > 0 or truth > 0 group by model"""


@query("auc_rank_sum", "hist_slicks", frame=slick_areas)
def auc_rank_sum(d):
    return """select fold, round((sum(case when y = 1 then rk else 0e0 end) - p * (p + 1e0) / 2e0) / nullif(p * (n - p), 0e0), 5) as auc from (
  select fold, y, avg(rn) over (partition by fold, s) as rk, sum(1e0 * y) over (partition by fold) as p, count(*) over (partition by fold) as n from (
    select *, row_number() over (partition by fold order by s) as rn from (select id, cast(id % 5 as int) as fold, confidence as s, case when (id * 31 % 100) / 1e2 + confidence > 1e0 then 1 else 0 end as y from hist_slicks) b) r) q group by fold, p, n"""


QUERIES = (lee_filter, block_stats, dark_pixels, closing_3x3, component_sizes, db_convert, glcm_homogeneity, tile_plan, lut_interpolate, oil_prior_score, pixel_area, iou_metrics, segmentation_report, auc_rank_sum)
