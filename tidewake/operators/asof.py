"""As-of joins at any gap: of each request the fix of its key that is nearest in time.

Fixes and requests are cut into spans of time, so neither a busy key nor a long
silence is one task.  Within a span two running windows carry the fix before
and the fix after; what a span lacks comes from the spans' own first and last
fixes, a row a (key, span), carried over the spans of a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewake.plans.query import query

#: Seconds of a span.
SPAN_S = 21600.0


def nearest(requests: DataFrame, fixes: DataFrame, key: str, at: str, fix_at: str, order: list[str], carried: list[str], span_s: float = SPAN_S) -> DataFrame:
    """``requests`` with ``fix``, a struct of ``fix_at`` and the ``carried`` columns of the nearest fix, null where the key has none.

    Of two fixes as near the earlier one counts, of fixes at one time the first by ``order``.
    Requests without key or time have none; all requests stay, repeated ones too.
    """
    def span(c: str):
        return F.floor(F.col(c) / span_s)

    first = F.min(F.struct(*order, *(F.col(c).alias(f"_{c}") for c in carried))).alias("v")
    once = fixes.filter(F.col(key).isNotNull() & F.col(fix_at).isNotNull()).groupBy(F.col(key).alias("_key"), F.col(fix_at).alias("_t")).agg(first)
    fix = F.struct(F.col("_t").alias(fix_at), *(F.col(f"v._{c}").alias(c) for c in carried)).alias("_fix")
    known = once.select("_key", "_t", span("_t").alias("_span"), fix)
    row = F.struct(*requests.columns).alias("_row")
    asked = requests.select(F.col(key).alias("_key"), F.col(at).cast("double").alias("_t"), row).filter("_key is not null and _t is not null").withColumn("_span", span("_t"))

    both = known.withColumn("_asks", F.lit(0)).unionByName(asked.withColumn("_asks", F.lit(1)), allowMissingColumns=True)
    up, down = (Window.partitionBy("_key", "_span").orderBy(o, "_asks") for o in (F.col("_t"), F.desc("_t")))
    met = both.withColumn("_before", F.last("_fix", True).over(up.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_after", F.last("_fix", True).over(down.rowsBetween(Window.unboundedPreceding, 0))).filter("_asks = 1")

    ends = known.groupBy("_key", "_span").agg(F.min_by("_fix", "_t").alias("_first"), F.max_by("_fix", "_t").alias("_last"))
    spans = ends.withColumn("_asks", F.lit(0)).unionByName(asked.select("_key", "_span", F.lit(1).alias("_asks")).distinct(), allowMissingColumns=True)
    spans = spans.groupBy("_key", "_span").agg(F.max("_asks").alias("_asks"), F.first("_first", True).alias("_first"), F.first("_last", True).alias("_last"))
    earlier, later = (Window.partitionBy("_key").orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.col("_span"), F.desc("_span")))
    carry = spans.select("_key", "_span", "_asks", F.last("_last", True).over(earlier).alias("_earlier"), F.last("_first", True).over(later).alias("_later")).filter("_asks = 1").drop("_asks")

    full = met.join(carry, ["_key", "_span"]).select("_row", "_t", F.coalesce("_before", "_earlier").alias("a"), F.coalesce("_after", "_later").alias("b"))
    back, ahead = F.col("_t") - F.col(f"a.{fix_at}"), F.col(f"b.{fix_at}") - F.col("_t")
    chosen = F.when(F.col("b").isNull() | (back <= ahead), F.col("a")).otherwise(F.col("b"))
    found = full.select("_row.*", chosen.alias("fix"))
    lost = requests.filter(F.col(key).isNull() | F.col(at).isNull()).withColumn("fix", F.lit(None).cast(found.schema["fix"].dataType))
    return found.unionByName(lost)


def suspects_at_release(table):
    requests = table("suspects").select("slick_id", "mmsi").join(table("releases").select(F.col("id").alias("slick_id"), "release_ts"), "slick_id")
    found = nearest(requests, table("ais"), "mmsi", "release_ts", "ts", ["event_id"], ["lon", "lat", "event_id"])
    return found.select("slick_id", "mmsi", F.round("fix.ts", 3).alias("ts"), F.round("fix.lon", 5).alias("lon"), F.round("fix.lat", 5).alias("lat"), "fix.event_id", F.round(F.abs(F.col("fix.ts") - F.col("release_ts")), 3).alias("dt"))


@query("suspect_fix_asof", "suspects", "releases", "ais", frame=suspects_at_release)
def suspect_fix_asof(d):
    """Where each suspect was at its slick's release: its nearest fix, however far off."""
    return """select slick_id, mmsi, round(ts, 3) as ts, round(lon, 5) as lon, round(lat, 5) as lat, event_id, round(abs(ts - release_ts), 3) as dt from (
  select s.slick_id, s.mmsi, r.release_ts, a.ts, a.lon, a.lat, a.event_id, row_number() over (partition by s.slick_id, s.mmsi order by abs(a.ts - r.release_ts), a.ts, a.event_id) as rn
  from suspects s join releases r on r.id = s.slick_id left join ais a on a.mmsi = s.mmsi) n where rn = 1"""


QUERIES = (suspect_fix_asof,)
