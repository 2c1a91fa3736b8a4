"""Mixing of sources to target weights.

Sizes are added up per source, targets are shared by weight, and a source's target over
its size is the rate at which its documents repeat. A document comes floor(rate) times,
and once more with the fraction as probability; the draw is a hash of the seed and the
document's id, so reruns agree and no state is shared between tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.common import BLANKS, checkpointed, free_prefix, text_of, with_position

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST_REPEATS = 2
SEED = "mix-1"


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def draw(ids: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the seed and the id; a null id draws like the text 'null'."""
    digits = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(ids.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digits, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def targets(
    sizes: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    budget: float = BUDGET,
    most_repeats: int = MOST_REPEATS,
) -> DataFrame:
    """``source, source_size, target, rate`` from rows of ``source, size``.

    Weights go round by the sources' order in code points, null last. The sum of targets
    is ``budget`` times all sizes. A target stops at ``most_repeats`` times its source's
    size; the excess is shared anew by weight until none is above. Each round caps at least
    one more source, and only two sums go through the driver.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = with_position(sources, [F.col("source").asc_nulls_last()], "place")
    shares = F.array(*map(F.lit, weights))
    placed = placed.withColumn("weight", F.get(shares, (F.col("place") % len(weights)).cast("int")))
    limit = (F.lit(most_repeats) * F.col("source_size")).cast("double")
    total = placed.agg(F.sum("source_size"), F.sum("weight")).first()
    wanted, left, open_weight = budget * (total[0] or 0), budget * (total[0] or 0), total[1] or 1
    while True:
        above = limit * F.lit(float(open_weight)) < F.col("weight") * F.lit(float(left))
        capped, weight = placed.agg(
            F.coalesce(F.sum(F.when(above, limit)), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0))
        ).first()
        if weight in (0, open_weight):
            break
        left, open_weight = wanted - capped, weight
    target = F.when(above, limit).otherwise(F.col("weight") * F.lit(float(left)) / F.lit(float(open_weight)))
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0))
    return placed.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def copies(rate: Column, ids: Column, seed: str = SEED) -> Column:
    whole = F.floor(rate)
    return whole + F.when(draw(ids, seed) < rate - whole, 1).otherwise(0)


def _rated(docs: DataFrame, rates: DataFrame, prefix: str = "_") -> DataFrame:
    """``docs`` beside their source's row of ``rates``; a hot source stays spread, Spark splits its rows."""
    named = rates.select(*[F.col(c).alias(prefix + c) for c in rates.columns])
    return docs.join(named, F.col("source").eqNullSafe(F.col(f"{prefix}source")))


def plan(docs: DataFrame, **settings) -> DataFrame:
    """One row per input row: ``doc_id, size, source_size, target, rate, copies, taken``.

    Defined cases: a null text has size 0; null is a source of its own; an empty table
    gives an empty plan; repeated rows each count and draw alike. Other columns are ignored.
    """
    rows = checkpointed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", n_words(text_of()).alias("size")))
    found = _rated(rows, targets(rows, **settings)).withColumn("copies", copies(F.col("_rate"), F.col("doc_id")))
    return found.select(
        "doc_id",
        "size",
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        F.col("_rate").alias("rate"),
        "copies",
        (F.col("size") * F.col("copies")).alias("taken"),
    )


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as the plan says, with the columns of ``docs``.

    Columns may have any name. Cases are defined as in :func:`plan`.
    """
    prefix = free_prefix(docs)
    sizes = docs.select("source", n_words(text_of()).alias("size"))
    rated = _rated(docs, targets(sizes, **settings), prefix)
    times = copies(F.col(f"{prefix}rate"), F.col("doc_id")).cast("int")
    return rated.withColumn(f"{prefix}copy", F.explode(F.array_repeat(F.lit(0), times))).select(*[F.col(f"`{c}`") for c in docs.columns])
