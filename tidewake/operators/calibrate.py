"""Calibration of raster samples: the scene's last vector at or before the line, linear in the pixel.

A scene's samples are joined by (scene, block of lines), so a scene of any size
is many tasks; a block carries the few vectors that it needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.plans.query import query

#: Lines of a block, and the least backscatter.
BLOCK_LINES, LEAST = 256, 1e-8
VECTORS = "calibrationVector array<struct<line: int, pixel: string, sigmaNought: string>>"


def numbers(text: Column) -> Column:
    return F.transform(F.split(F.trim(text), r"\s+"), lambda x: x.cast("double"))


def luts(documents: DataFrame, scene: str = "scene", xml: str = "xml") -> DataFrame:
    """``scene, pixels, vectors``: the first vector's pixels serve all of a document; vectors by line."""
    parsed = documents.select(F.col(scene).alias("scene"), F.from_xml(F.col(xml), F.lit(VECTORS)).calibrationVector.alias("found"))
    return parsed.select("scene", numbers(F.get("found", F.lit(0)).pixel).alias("pixels"), F.array_sort(F.transform("found", lambda v: F.struct(v.line.alias("line"), numbers(v.sigmaNought).alias("sigma")))).alias("vectors"))


def interpolated(x: Column, xs: Column, ys: Column) -> Column:
    """``ys`` at ``x`` over ascending ``xs``, flat beyond both ends."""
    i = F.size(F.filter(xs, lambda v: v <= x))
    x0, x1, y0, y1 = F.get(xs, i - 1), F.get(xs, i), F.get(ys, i - 1), F.get(ys, i)
    return F.when(i == 0, F.get(ys, F.lit(0))).when(i >= F.size(xs), F.get(ys, F.size(xs) - 1)).otherwise(y0 + (y1 - y0) * (x - x0) / (x1 - x0))


def calibrated(samples: DataFrame, known: DataFrame) -> DataFrame:
    """``samples`` (scene, line, pixel, dn, ...) with ``lut`` and ``db``.

    Null where the scene has no document, the line comes before its first vector, or the number or the table's value is 0.
    """
    blocked = samples.withColumn("_block", F.floor(F.col("line") / BLOCK_LINES))
    begin, end = F.col("_block") * BLOCK_LINES, (F.col("_block") + 1) * BLOCK_LINES
    below = F.filter("vectors", lambda v: v.line < end)
    needed = F.filter(F.col("_below"), lambda v, i: (i == F.size("_below") - 1) | (F.get("_below", i + 1).line > begin))
    blocks = blocked.select("scene", "_block").distinct().join(known, "scene").withColumn("_below", below).select("scene", "_block", "pixels", needed.alias("_vectors"))
    joined = blocked.join(blocks, ["scene", "_block"], "left")
    vector = F.element_at(F.filter("_vectors", lambda v: v.line <= F.col("line")), -1)
    vector = F.when(F.size(F.filter("_vectors", lambda v: v.line <= F.col("line"))) > 0, vector)
    lut = F.nullif(interpolated(F.col("pixel"), F.col("pixels"), vector.sigma), F.lit(0.0))
    rows = joined.withColumn("lut", lut)
    dn = F.nullif(F.col("dn").cast("double"), F.lit(0.0))
    power = dn * dn / (F.col("lut") * F.col("lut"))
    return rows.withColumn("db", F.when(power.isNotNull(), 10 * F.log10(F.greatest(power, F.lit(LEAST))))).select(*samples.columns, "lut", "db")


def rows_of(table) -> DataFrame:
    out = calibrated(table("samples"), luts(table("calibration")))
    return out.select("id", "scene", "line", F.round("lut", 6).alias("lut"), F.round("db", 6).alias("db"))


@query("calibrated_samples", "samples", "calibration", frame=rows_of)
def calibrated_samples(d):
    """Backscatter of samples by their scene's own document."""
    between = "ys[i] + (ys[i + 1] - ys[i]) * (pixel - xs[i]) / (xs[i + 1] - xs[i])"
    return f"""select id, scene, line, round(lut, 6) as lut, round(case when dn <> 0 and lut is not null then 10e0 * log10(greatest(dn * dn / (lut * lut), {LEAST})) end, 6) as db from (
  select id, scene, line, dn, nullif(case when i = 0 then ys[1] when i = len(xs) then ys[len(xs)] else {between} end, 0e0) as lut from (
    select s.*, v.ys, p.xs, len(list_filter(p.xs, lambda x: x <= s.pixel)) as i from samples s asof left join (
      select scene, cast(regexp_extract(v, '<line>([0-9]+)<', 1) as int) as line, list_transform(string_split(regexp_extract(v, '<sigmaNought>([^<]*)<', 1), ' '), lambda x: cast(x as double)) as ys
      from (select scene, unnest(string_split(xml, '</calibrationVector>')[:3]) as v from calibration) a) v on v.scene = s.scene and s.line >= v.line
    left join (select scene, list_transform(string_split(regexp_extract(xml, '<pixel>([^<]*)<', 1), ' '), lambda x: cast(x as double)) as xs from calibration) p on p.scene = s.scene) c) e"""


QUERIES = (calibrated_samples,)
