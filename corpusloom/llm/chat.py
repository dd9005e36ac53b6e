"""Chat formatting: every assistant turn becomes an example of its own (column functions only).

The context of an example is all turns before its reply; only the reply is trainable. Turns are
written as ``<s>[ROLE]role[/ROLE]text</s>``. Control strings inside roles and texts are broken up
by a backslash after their first character, and backslashes are doubled, so the output can be read
back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, HEADER, CLOSE = "<s>[ROLE]", "[/ROLE]", "</s>"
#: What could be taken for a control string: first character, and the rest.
CONTROL = r"(<|\[)(/?s>|/?INST\]|/?ROLE\])"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, CONTROL, "$1\\\\$2")


def unescape(text: Column) -> Column:
    """The inverse of ``escape``: two backslashes are one, a single one was inserted."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def prefix_targets(conversations: DataFrame) -> DataFrame:
    """Examples of ``conversations`` (conv_id, turn, role, text).

    Returns conv_id, example (from 0), n_turns (of the example), formatted, loss_start and
    loss_chars (the trainable span of ``formatted`` in code points), last (whether the example
    holds the whole conversation).

    Turns are ordered by turn (null first), then role, then text; repeated rows are turns of their
    own. A null role or text is empty; rows with a null conv_id make one conversation. Turns after
    the last reply, and conversations without a reply, make a last example with nothing to train
    on, so no turn is lost. Other columns are ignored; an empty table has no examples. One
    shuffle; an example is built from its conversation's row when it is written, so only turns and
    one example at a time are in memory.
    """
    turn = F.struct(
        F.col("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    whole = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    head = lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(HEADER))
    piece = lambda t: F.concat(head(t), escape(t["text"]), F.lit(CLOSE))
    replies = F.filter(
        F.sequence(F.lit(1), F.size("turns")),
        lambda i: (F.get("turns", i - 1)["role"] == ASSISTANT) | (i == F.size("turns")),
    )
    rows = whole.select(
        "conv_id", "turns", F.transform("turns", piece).alias("pieces"), replies.alias("ends")
    ).select("*", F.posexplode("ends").alias("example", "n_turns"))
    target = F.get("turns", F.col("n_turns") - 1)
    return rows.select(
        "conv_id",
        F.col("example").cast("long").alias("example"),
        F.col("n_turns").cast("long").alias("n_turns"),
        F.array_join(F.slice("pieces", 1, F.col("n_turns")), "").alias("formatted"),
        F.length(head(target)).alias("head_chars"),
        F.length(F.get("pieces", F.col("n_turns") - 1)).alias("piece_chars"),
        (target["role"] == ASSISTANT).alias("trained"),
        (F.col("n_turns") == F.size("turns")).alias("last"),
    ).select(
        "conv_id",
        "example",
        "n_turns",
        "formatted",
        (F.length("formatted") - F.col("piece_chars") + F.col("head_chars"))
        .cast("long")
        .alias("loss_start"),
        F.when(
            F.col("trained"), F.col("piece_chars") - F.col("head_chars") - F.lit(len(CLOSE))
        )
        .otherwise(0)
        .cast("long")
        .alias("loss_chars"),
        "last",
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) written in a formatted example."""
    parts = F.split(formatted, CLOSE)
    return F.transform(
        F.slice(parts, 1, F.size(parts) - 1),
        lambda p: F.struct(
            unescape(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), HEADER, 1)).alias("role"),
            unescape(F.substring_index(p, HEADER, -1)).alias("text"),
        ),
    )


def trained_text(formatted: Column, start: Column, chars: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return unescape(F.substr(formatted, start.cast("int") + 1, chars.cast("int")))
