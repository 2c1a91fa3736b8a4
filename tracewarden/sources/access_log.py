"""Access-log text to typed rows and rejects.

Two line formats are told apart per line, so one file may mix them:

* combined: ``IP - - [15/Nov/2024:09:00:08 +0500] "POST /x HTTP/1.1" 200 33 "-" "agent"``
* custom:   ``2026-04-01T09:00:01Z IP METHOD URL STATUS BYTES agent…``
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# White space as text tools see it: Unicode's (flag U) and the four separators before the blank
_S, _N = r"[\s\x1c-\x1f]", r"[^\s\x1c-\x1f]"

_IS_COMBINED = rf"(?U)\A{_N}+{_S}+{_N}+{_S}+{_N}+{_S}+\["

# Both patterns swallow the whole line and lay their groups out one per line:
# a text line holds no newline, so splitting there is safe, and one regex run
# per line replaces one run per field.
_COMBINED = (
    rf"(?dU)\A({_N}+){_S}+{_N}+{_S}+{_N}+{_S}+\[([^\]]+)\]{_S}+"
    rf'"({_N}+){_S}+(.*?){_S}+HTTP/{_N}+"{_S}+(\d+){_S}+(\d+){_S}+"[^"]*"{_S}+"([^"]*)".*\z'
)
_COMBINED_ORDER = "$2\n$1\n$3\n$4\n$5\n$6\n$7"
_CUSTOM = rf"(?dU)\A({_N}+){_S}+({_N}+){_S}+({_N}+){_S}+({_N}+){_S}+(\d+){_S}+(\d+){_S}+(.+)\z"
_CUSTOM_ORDER = "$1\n$2\n$3\n$4\n$5\n$6\n$7"

_HAS_ZONE = r"(?:[Zz]|[+-]\d{2}:?\d{2})\z"


def read_lines(spark: SparkSession, path) -> DataFrame:
    """Log lines with their file and a number that rises within the file.

    The number is the place of the line's file block (in MiB) in the upper bits and
    the row number of the reading task in the lower 33. It orders the lines of a
    file whatever order the blocks are read in, and costs no pass over the data;
    :func:`numbered_rejects` turns it into true line numbers.
    """
    block = F.shiftright(F.col("_metadata.file_block_start"), 20)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        (F.shiftleft(block, 33) + row).alias("lineno"),
        F.make_valid_utf8("value").alias("value"),
    )


def combined_fields(line: Column) -> Column:
    return F.split(F.regexp_replace(line, _COMBINED, _COMBINED_ORDER), "\n")


def custom_fields(line: Column) -> Column:
    return F.split(F.regexp_replace(line, _CUSTOM, _CUSTOM_ORDER), "\n")


def combined_time(text: Column) -> Column:
    return F.coalesce(
        F.try_to_timestamp(text, F.lit("d/MMM/yyyy:H:m:s Z")), F.try_to_timestamp(text, F.lit("d/MMM/yyyy:H:m:s XXX"))
    )


def custom_time(text: Column) -> Column:
    """Each row is parsed alone; a time without a zone is UTC."""
    return F.try_to_timestamp(F.when(text.rlike(_HAS_ZONE), text).otherwise(F.concat(text, F.lit("Z"))))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)\A{_S}+|{_S}+\z", "")


def _typed(lines: DataFrame) -> DataFrame:
    value = F.col("value")
    content = lines.where(~value.startswith("#") & value.rlike(f"(?U){_N}"))
    shaped = content.withColumn("combined", value.rlike(_IS_COMBINED)).withColumn(
        "f", F.when(F.col("combined"), combined_fields(value)).otherwise(custom_fields(value))
    )
    f = F.col("f")
    matched = F.size(f) == 7
    pick = lambda i: F.when(F.col("matched"), f[i])
    typed = shaped.withColumn("matched", matched).withColumns(
        {
            "timestamp": F.when(F.col("combined"), combined_time(pick(0))).otherwise(custom_time(pick(0))),
            "ip": pick(1),
            "method": F.when(F.col("combined"), F.upper(pick(2))).otherwise(pick(2)),
            "url_full": pick(3),
            "status": pick(4).try_cast("int"),
            "bytes": pick(5).try_cast("bigint"),
            "user_agent": F.when(F.col("combined"), pick(6)).otherwise(_strip(pick(6))),
        }
    )
    reason = (
        F.when(~F.col("matched"), "no match")
        .when(F.col("timestamp").isNull(), "bad time")
        .when(F.col("status").isNull() | F.col("bytes").isNull(), "bad number")
    )
    # Filters do not move below a generator, so the callers' test of the reason
    # reuses the parsed fields instead of running every regex a second time.
    return typed.select("*", F.explode(F.array(reason)).alias("reason"))


def _columns_present(lines: DataFrame, names) -> list[str]:
    return [n for n in names if n in lines.columns]


def parse_lines(lines: DataFrame) -> DataFrame:
    """The lines that parse. Blank lines and lines starting with ``#`` are skipped."""
    keep = _columns_present(lines, ("file", "lineno"))
    return _typed(lines).where("reason IS NULL").select(
        *keep, "timestamp", "ip", "method", "url_full", "status", "bytes", "user_agent"
    )


def parse_rejects(lines: DataFrame) -> DataFrame:
    """The lines that do not parse, with the reason.

    Lines of the custom format with an unreadable time are listed too, although a
    text tool may drop them without a word.
    """
    keep = _columns_present(lines, ("file", "lineno"))
    return _typed(lines).where("reason IS NOT NULL").select(*keep, "value", "reason")


def read_log(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """Parsed rows and rejects of one or more text files."""
    lines = read_lines(spark, path)
    return parse_lines(lines), parse_rejects(lines)


def numbered_rejects(rejects: DataFrame, lines: DataFrame) -> DataFrame:
    """Rejects with true line numbers, counted from 1 in every file.

    Lines are counted per file block; prefix sums over these few counts give every
    block its offset, without sorting or moving the lines themselves.
    """
    block = F.shiftright("lineno", 33).alias("block")
    counts = lines.groupBy("file", block).agg(F.count("*").alias("n"), F.min("lineno").alias("first_id"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("file", "block", "first_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return (
        rejects.withColumn("block", block)
        .join(offsets, ["file", "block"])
        .select("file", (F.col("offset") + F.col("lineno") - F.col("first_id") + 1).alias("lineno"), "value", "reason")
    )
