"""Trailing-window tests per key that no hot key can break."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Totals = dict[str, Column]


def trailing_hits(
    rows: DataFrame,
    key: str,
    measures: Totals,
    seconds: int,
    slice_seconds: int,
    hit: Callable[[Totals], Column],
    surely: Callable[[Totals, Totals], Column],
    possibly: Callable[[Totals, Totals], Column],
    slices: DataFrame | None = None,
) -> DataFrame:
    """Keys for which ``hit`` holds over ``(t - seconds, t]`` at the time t of some row.

    ``measures`` are non-negative whole numbers per row; ``hit`` sees their window
    sums. ``slices`` may bring their sums per (key, slice), under the same names. A plain window over the key would put all rows of a hot key into one
    task. Here rows are first summed per (key, time slice), which combines on the
    map side. For every slice the sums of the slices that are wholly or partly
    inside the window bound the true sums from below and above:

    * ``surely(low, high)``: the test holds for all sums within the bounds. One such
      slice settles the key.
    * ``possibly(low, high)``: it holds for some sums within the bounds. Slices of
      unsettled keys where it does are looked at row by row, and nothing else is.

    The row-level step needs only the slice itself and the one the window's edge
    runs through, so its groups are (key, slice), too. The answer is exact.
    """
    if seconds % slice_seconds:
        raise ValueError("the window must be a whole number of slices")
    width, slice_us = seconds // slice_seconds, slice_seconds * 1_000_000
    names = list(measures)
    us = F.unix_micros("timestamp")
    narrow = rows.select(
        F.col(key), us.alias("us"), F.floor(us / slice_us).alias("slice"), *[m.alias(n) for n, m in measures.items()]
    )

    if slices is None:
        slices = narrow.groupBy(key, "slice").agg(*[F.sum(n).alias(n) for n in names])
    else:
        slices = slices.where(" OR ".join(f"{n} > 0" for n in names)).select(key, "slice", *names)
    by_slice = Window.partitionBy(key).orderBy("slice")

    def over(first: int, last: int) -> Totals:
        frame = by_slice.rangeBetween(first, last)
        return {n: F.coalesce(F.sum(n).over(frame), F.lit(0).cast("bigint")) for n in names}

    high, low_at_end, low_inside = over(-width, 0), over(1 - width, 0), over(1 - width, -1)
    bounds = slices.select(
        key,
        "slice",
        *[c.alias(f"high_{n}") for n, c in high.items()],
        *[c.alias(f"end_{n}") for n, c in low_at_end.items()],
        *[c.alias(f"mid_{n}") for n, c in low_inside.items()],
    )
    col = lambda prefix: {n: F.col(f"{prefix}_{n}") for n in names}
    tested = bounds.withColumns(
        {"sure": surely(col("end"), col("high")), "open": possibly(col("mid"), col("high"))}
    ).withColumn("settled", F.max("sure").over(Window.partitionBy(key)))
    settled = tested.where("sure").select(key)
    unsettled = tested.where("NOT settled AND open").select(key, "slice", *[f"mid_{n}" for n in names])

    # A row enters at its own time and leaves one window later, a fixed number of slices on.
    enter = F.struct(F.col("slice").alias("slice"), F.col("us").alias("at"), F.lit(True).alias("enters"))
    leave = F.struct(
        (F.col("slice") + width).alias("slice"), (F.col("us") + seconds * 1_000_000).alias("at"),
        F.lit(False).alias("enters"),
    )
    # Only rows of open slices, and of those one window before, are laid out at all.
    needed = unsettled.select(key, F.explode(F.array(F.col("slice"), F.col("slice") - width)).alias("slice")).distinct()
    steps = narrow.join(needed, [key, "slice"], "left_semi").select(key, *names, F.inline(F.array(enter, leave)))
    gain = {n: F.when(F.col("enters"), F.col(n)).otherwise(-F.col(n)) for n in names}
    tail = {n: F.when(~F.col("enters"), F.col(n)).otherwise(F.lit(0)) for n in names}
    moments = (
        steps.join(unsettled, [key, "slice"])
        .groupBy(key, "slice", "at")
        .agg(
            F.bool_or("enters").alias("enters"),
            *[F.sum(c).alias(f"gain_{n}") for n, c in gain.items()],
            *[F.sum(c).alias(f"tail_{n}") for n, c in tail.items()],
            *[F.first(f"mid_{n}").alias(f"mid_{n}") for n in names],
        )
    )
    group = Window.partitionBy(key, "slice")
    so_far = group.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    sums = {
        n: F.col(f"mid_{n}") + F.sum(f"tail_{n}").over(group) + F.sum(f"gain_{n}").over(so_far) for n in names
    }
    exact = (
        moments.select(key, "enters", *[c.alias(n) for n, c in sums.items()])
        .where("enters")
        .where(hit({n: F.col(n) for n in names}))
        .select(key)
    )
    return settled.union(exact).distinct()
