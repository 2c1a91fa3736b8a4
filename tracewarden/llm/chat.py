"""Chat formatting as one relational plan.

The turns of a conversation are collected as structs and sorted by turn, adjacent turns of
one role are merged into a block by an array aggregation, and blocks are concatenated with
markers. Texts and roles carry no marker of their own: a backslash breaks every control
string in them, and one more backslash every broken one, so reading back is exact. The
loss mask is a list of code point spans beside the block that holds them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<|start|>", "<|turn|>", "<|end|>\n"
#: Strings with a meaning for this template or for common tokenizers; none survives in a text.
_CONTROL = "\\|(?:start|turn|end|im_start|im_end|endoftext|startoftext)\\||/?s>|/?INST\\]|/?SYS>>"
#: First character of a control string, then backslashes, then its rest.
_PLAIN = f"(<|\\[)(\\\\*)({_CONTROL})"
_BROKEN = f"(<|\\[)\\\\(\\\\*)({_CONTROL})"
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _PLAIN, "$1\\\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _BROKEN, "$1$2$3")


def _role_line(role: Column) -> Column:
    """The role on one line."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _role_of(line: Column) -> Column:
    return F.replace(F.replace(unescape(line), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_mask`` from rows of ``conv_id, turn, role, text``.

    ``loss_mask`` lists ``(block, start, end)``: code points within block ``block`` (from
    0) of ``formatted``, blocks being what ends in ``CLOSE``; one span for each assistant turn.
    Defined cases: a null text or role is empty, a null turn comes first, equal turns go by
    role, then text, repeated rows all stay, rows with a null ``conv_id`` are one
    conversation, an empty table gives no rows. Other columns are not read.
    """
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    sorted_turns = (
        turns.select("conv_id", turn.alias("t"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("t")).alias("turns"))
    )
    # Merge neighbours of one role: places where the role changes, then the turns between them.
    changes = F.expr(
        "filter(sequence(0, size(turns) - 1), i -> i = 0 OR get(turns, i).role <> get(turns, i - 1).role)"
    )
    blocks = F.expr(
        "transform(changes, (at, i) -> named_struct('role', get(turns, at).role, 'texts', transform("
        "slice(turns, at + 1, coalesce(get(changes, i + 1), size(turns)) - at), t -> t.text)))"
    )
    staged = sorted_turns.withColumn("changes", changes).withColumn("blocks", blocks)
    written = F.transform(
        "blocks",
        lambda b: F.struct(
            F.concat(F.lit(OPEN), _role_line(b["role"]), F.lit("\n")).alias("head"),
            F.transform(b["texts"], escape).alias("texts"),
            (b["role"] == TRAINED_ROLE).alias("trained"),
        ),
    )
    staged = staged.select("conv_id", written.alias("blocks"))
    formatted = F.array_join(
        F.transform("blocks", lambda b: F.concat(b["head"], F.array_join(b["texts"], MIDDLE), F.lit(CLOSE))), ""
    )
    # Ends of the texts of a block: running sums of lengths, a marker between neighbours.
    spans = F.expr(
        f"""flatten(transform(blocks, (b, k) -> IF(NOT b.trained, array(), aggregate(b.texts,
            named_struct('at', length(b.head), 'spans', CAST(array() AS array<struct<block:int,start:int,end:int>>)),
            (acc, t) -> named_struct('at', acc.at + length(t) + {len(MIDDLE)}, 'spans', array_append(acc.spans,
                named_struct('block', k, 'start', acc.at, 'end', acc.at + length(t)))),
            acc -> acc.spans))))"""
    )
    return staged.select("conv_id", formatted.alias("formatted"), spans.alias("loss_mask"))


def blocks_of(formatted: Column) -> Column:
    """The blocks of a formatted conversation, each without its end marker."""
    parts = F.split(formatted, "<\\|end\\|>\n", -1)
    return F.slice(parts, 1, F.size(parts) - 1)


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: an array of ``role, text``."""
    role_at = len(OPEN) + 1

    def turns_of(block: Column) -> Column:
        line_end = F.instr(block, "\n")
        return F.transform(
            F.split(F.substr(block, line_end + 1), "<\\|turn\\|>", -1),
            lambda t: F.struct(
                _role_of(F.substr(block, F.lit(role_at), line_end - role_at)).alias("role"), unescape(t).alias("text")
            ),
        )

    return F.flatten(F.transform(blocks_of(formatted), turns_of))


def loss_texts(formatted: Column, loss_mask: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""

    def under(blocks: Column) -> Column:
        return F.transform(
            loss_mask, lambda s: unescape(F.substr(F.get(blocks, s["block"]), s["start"] + 1, s["end"] - s["start"]))
        )

    # Through a one-element array, so the blocks are split once and not for each span.
    return F.get(F.transform(F.array(blocks_of(formatted)), under), F.lit(0))
