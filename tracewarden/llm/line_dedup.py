"""Line deduplication across documents.

A line's key is the line without blanks at both ends, A-Z in lower case. Keys of enough
length that enough documents hold lose all their lines but those in the largest document.
Only hashes travel: (hash, part) is range-partitioned and sorted by document (largest
first) and position, and a window streams through each run for its first document. The
part, a hash of the document, spreads a line that a third of all documents hold over as
many runs as there are shuffle partitions. What returns to a document is a bitmap of the
lines it keeps, 64 to a word, cut after the last word with a dropped line; a document that
keeps everything has none. Column functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.llm.common import BLANK_CHARS, ascii_lower, checkpointed, free_prefix, text_of

LEAST_CHARS = 40
LEAST_DOCS = 5


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANK_CHARS)))


def _text_hash() -> Column:
    """Tells rows with the same id and different texts apart."""
    return F.xxhash64(text_of())


def occurrences(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``doc_id, text_hash, at, hash`` of every line that is long enough."""
    lines = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        _text_hash().alias("text_hash"),
        F.posexplode(lines_of(text_of())).alias("at", "line"),
    )
    return lines.withColumn("line", line_key(F.col("line"))).where(F.length("line") >= least_chars).select(
        "doc_id", "text_hash", "at", F.unhex(F.substring(F.sha2("line", 256), 1, 32)).alias("hash")
    )


def keep_bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``doc_id, text_hash, n_dropped, bitmap`` of the documents that lose lines.

    Bit i % 64 of word i / 64 tells whether line i stays; lines after the last word stay.
    Defined cases: a null text is one empty line; rows with the same id are one document
    (null is one id, smaller than all others) and each keeps or loses its own lines; an
    empty table gives none.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(parts)).alias("part")
    largest = F.col("doc_id").desc_nulls_last()
    ranged = (
        checkpointed(occurrences(docs, least_chars))  # read three times: for the range bounds, the runs and the drops
        .select("*", part)
        .repartitionByRange(parts, "hash", "part")
        .sortWithinPartitions("hash", "part", largest, "at")
    )
    run = Window.partitionBy("hash", "part").orderBy(largest, "at")
    first_of_doc = (F.row_number().over(run) == 1) | ~F.col("doc_id").eqNullSafe(F.lag("doc_id").over(run))
    runs = (
        ranged.select("hash", "part", "doc_id", first_of_doc.cast("long").alias("opens"))
        .groupBy("hash", "part")
        .agg(F.sum("opens").alias("docs"), F.max("doc_id").alias("keeper"))
    )
    repeated = checkpointed(
        runs.groupBy("hash")
        .agg(F.sum("docs").alias("docs"), F.max("keeper").alias("keeper"))
        .where(F.col("docs") >= least_docs)
        .select("hash", "keeper")
    )
    dropped = ranged.join(repeated, "hash").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    words = dropped.groupBy("doc_id", "text_hash", F.shiftright("at", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, at & 63)")).alias("bits")
    )
    entries = words.groupBy("doc_id", "text_hash").agg(
        F.map_from_entries(F.collect_list(F.struct("word", F.bitwise_not("bits")))).alias("words"),
        F.max("word").alias("last"),
        F.sum(F.bit_count("bits")).alias("n_dropped"),
    )
    bitmap = F.transform(
        F.sequence(F.lit(0), F.col("last")), lambda i: F.coalesce(F.element_at("words", i), F.lit(-1).cast("long"))
    )
    return entries.select("doc_id", "text_hash", "n_dropped", bitmap.alias("bitmap"))


def kept_lines(lines: Column, bitmap: Column) -> Column:
    """The lines whose bit is set; a null bitmap keeps all."""

    def stays(_: Column, i: Column) -> Column:
        word = F.coalesce(F.get(bitmap, F.shiftright(i, 6)), F.lit(-1).cast("long"))
        return F.bit_get(word, i.bitwiseAND(F.lit(63))) == 1

    return F.when(bitmap.isNull(), lines).otherwise(F.filter(lines, stays))


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, prefix: str = "_") -> DataFrame:
    """``docs`` with ``_bitmap`` and ``_n_dropped`` (or another prefix), null where all lines stay."""
    named = bitmaps.select(*[F.col(c).alias(prefix + c) for c in bitmaps.columns]).hint("shuffle_hash")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(f"{prefix}doc_id")) & (_text_hash() == F.col(f"{prefix}text_hash"))
    return docs.join(named, same, "left").drop(f"{prefix}doc_id", f"{prefix}text_hash")


def drop_repeated_lines(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with repeated lines gone from ``text`` and all other columns as they were.

    A text that loses nothing stays as it is, a null one null; a text that loses every
    line is empty. A column ``n_chars`` keeps its old value. Columns may have any name.
    """
    prefix = free_prefix(docs)
    marked, bitmap = with_bitmaps(docs, keep_bitmaps(docs, **settings), prefix), F.col(f"{prefix}bitmap")
    text = F.when(bitmap.isNull(), F.col("text")).otherwise(F.array_join(kept_lines(lines_of(text_of()), bitmap), "\n"))
    return marked.withColumn("text", text).select(*[F.col(f"`{c}`") for c in docs.columns])
