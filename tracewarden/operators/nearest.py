"""As-of lookups without pairing rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def next_point(probes: DataFrame, points: DataFrame, group: str, gap_us: int, slice_us: int) -> DataFrame:
    """For every probe the earliest point of its group within ``[at, at + gap_us]``.

    ``probes`` has (group, at), ``points`` has (group, at, payload) with ``at`` in
    microseconds; both are unique in (group, at). Probes and points are laid on one
    time line per (group, slice). The next point is either in the probe's own slice
    or the first one of the next slice that has any; the latter comes from a window
    over one row per slice.
    """
    slot = F.floor(F.col("at") / slice_us).alias("slice")
    found = F.struct("at", "payload")
    line = points.select(group, slot, "at", found.alias("point"), F.lit(False).alias("probe")).unionByName(
        probes.select(group, slot, "at", F.lit(True).alias("probe")), allowMissingColumns=True
    )
    backwards = Window.partitionBy(group, "slice").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, 0)
    inside = line.withColumn("inside", F.last("point", ignorenulls=True).over(backwards)).where("probe")
    slices = line.groupBy(group, "slice").agg(F.min("point").alias("head"))
    later = Window.partitionBy(group).orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    heads = slices.select(group, "slice", F.last("head", ignorenulls=True).over(later).alias("after"))
    best = F.coalesce("inside", "after")
    return (
        inside.join(heads, [group, "slice"])
        .select(group, "at", best.alias("next"))
        .where(F.col("next.at") - F.col("at") <= gap_us)
        .select(group, "at", F.col("next.payload").alias("payload"))
    )
