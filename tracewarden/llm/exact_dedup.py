"""Exact deduplication with a split of heavy hitters.

Texts are compared by the SHA-256 of their text with every run of blanks made one space.
A digest that a third of all rows share would send them all to one task. So frequent
digests are found first: each task keeps a Misra-Gries summary of bounded size, the
summaries are added up, the leading candidates are counted exactly, and the verified
winners (digest, row that stays, number of rows) are broadcast. Rows of these digests are
settled where they are. All other digests are shuffled as usual.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.common import BLANKS, checkpointed, text_of

#: Digests in a summary, and at most as many rows of about 120 bytes in the broadcast.
CAPACITY = 1000


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, f"{BLANKS}+", " ")


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Misra-Gries: a digest with more than 1/(CAPACITY+1) of the task's rows is in the summary."""
    kept: Counter = Counter()
    for batch in batches:
        for found in batch.column(0).value_counts():
            kept[found["values"].as_py()] += found["counts"].as_py()
        if len(kept) > CAPACITY:
            cut = sorted(kept.values(), reverse=True)[CAPACITY]
            kept = Counter({k: v - cut for k, v in kept.items() if v > cut})
    yield pa.RecordBatch.from_pydict(
        {"digest": pa.array(list(kept), pa.string()), "seen": pa.array(list(kept.values()), pa.int64())}
    )


def frequent_digests(rows: DataFrame) -> DataFrame:
    """At most ``CAPACITY`` candidates; a digest with over 2/(CAPACITY+1) of all rows is among them."""
    return (
        rows.select("digest")
        .mapInArrow(_summaries, "digest string, seen long")
        .groupBy("digest")
        .agg(F.sum("seen").alias("seen"))
        .orderBy(F.desc("seen"), "digest")
        .limit(CAPACITY)
        .select("digest")
    )


def _totals(rows: DataFrame) -> DataFrame:
    """Of equal texts, the row that stays and their number. Sums within tasks come first."""
    return rows.groupBy("digest").agg(F.min("rank").alias("first"), F.count("*").alias("group_size"))


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    The row with the smallest id of its group stays. Defined cases: a null text is an
    empty one; a null id is larger than all others (``keep_id`` is null only if all ids of
    the group are); of rows with the same text and the same smallest id exactly one stays.
    An empty table gives an empty result; other columns of ``docs`` are not read.
    """
    rows = checkpointed(
        docs.select(
            F.col(id_column).cast("long").alias("doc_id"), F.sha2(normalised(text_of(text_column)), 256).alias("digest")
        ).withColumn(
            "rank",
            F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.monotonically_increasing_id().alias("row")),
        )
    )
    candidates = checkpointed(frequent_digests(rows))
    winners = checkpointed(_totals(rows.join(F.broadcast(candidates), "digest")).where("group_size > 1"))
    marked = rows.join(F.broadcast(winners), "digest", "left")  # at most CAPACITY rows
    heavy = marked.where("group_size is not null")
    rest = marked.where("group_size is null").select("digest", "doc_id", "rank")
    light = rest.join(_totals(rest), "digest")
    return heavy.unionByName(light).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rank.row") == F.col("first.row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
