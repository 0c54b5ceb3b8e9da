"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example of its own: all preceding turns are context, the
reply alone is under the loss mask.  Turns after the last reply (or a conversation without
any) are kept in a final example without a target, so the output holds every turn.

Template of a turn: ``<|im_start|>{role}\\n{text}<|im_end|>\\n``.  Inside roles and texts
``\\`` becomes ``\\\\`` and ``<|`` becomes ``<\\|``, so no marker can arise from content and
the original reads back exactly; in roles a newline becomes ``\\n``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    """Texts with ``\\`` and ``<|`` escaped; no ``<|`` is left."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """The inverse of :func:`escape`: pairs are read from the left."""
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    parts = F.regexp_extract_all(role, F.lit(r"(?s)\\.|[^\\]+"), F.lit(0))
    back = F.transform(parts, lambda p: F.when(p == "\\n", F.lit("\n")).when(p.startswith("\\"), F.substring(p, 2, 1)).otherwise(p))
    return F.array_join(back, "")


def expand(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per example: ``conv_id, example, is_last, formatted, loss_start, loss_chars``.

    ``formatted`` is the escaped example; the mask covers ``loss_chars`` code points from
    ``loss_start`` (0-based; -1 where nothing is trainable).  ``is_last`` marks the example
    that holds every turn.  Null roles and texts count as empty; turns are ordered by their
    number (nulls first), then role and text, repeated rows staying; a null conversation id is
    one conversation.  Roles other than ``assistant`` are never trainable.  Extra columns are
    ignored; an empty table gives no rows.

    One conversation is assembled in one row, since its digest is sequential; the examples of
    a conversation come from that row without another shuffle.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("m"),
    )
    held = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    piece = lambda m: F.concat(F.lit(START), escape_role(m["role"]), F.lit("\n"), escape(m["text"]), F.lit(END))
    told = held.select(
        "conv_id",
        F.transform("ms", piece).alias("pieces"),
        F.transform("ms", lambda m: F.when(m["role"] == "assistant", F.length(escape(m["text"]))).otherwise(-1)).alias("loss"),
    )
    ends = F.filter(F.sequence(F.lit(1), F.size("loss")), lambda i: (F.element_at("loss", i) >= 0) | (i == F.size("loss")))
    each = told.select("conv_id", "pieces", "loss", F.posexplode(ends).alias("example", "upto"))
    formatted = F.array_join(F.slice("pieces", F.lit(1), F.col("upto")), "")
    loss = F.element_at("loss", F.col("upto"))
    return each.select(
        "conv_id",
        "example",
        (F.col("upto") == F.size("pieces")).alias("is_last"),
        formatted.alias("formatted"),
        loss.alias("l"),
    ).select(
        "conv_id",
        "example",
        "is_last",
        "formatted",
        F.when(F.col("l") >= 0, F.length("formatted") - F.lit(len(END)) - F.col("l")).otherwise(F.lit(-1)).alias("loss_start"),
        F.greatest(F.col("l"), F.lit(0)).alias("loss_chars"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted example as an array of ``struct<role, text>``."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda _, i: i > 0)
    body = lambda p: F.substring(p, F.lit(1), F.length(p) - F.lit(len(END)))
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(body(F.substring(p, F.instr(p, "\n") + F.lit(1), F.length(p)))).alias("text"),
        ),
    )


def conversation_digest(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: turns, their hash, and all text under the mask."""
    masked = F.when(F.col("loss_start") >= 0, unescape(F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_chars")))).otherwise(F.lit(""))
    per = examples.select(
        "conv_id",
        F.struct("example", masked.alias("loss")).alias("e"),
        F.when(F.col("is_last"), F.col("formatted")).alias("whole"),
        F.length("formatted").cast("long").alias("chars"),
    )
    held = per.groupBy("conv_id").agg(
        F.sort_array(F.collect_list("e")).alias("es"),
        F.max("whole").alias("whole"),
        F.sum("chars").alias("formatted_chars"),
        F.count(F.lit(1)).alias("n_examples"),
    )
    read = held.select("conv_id", read_turns(F.col("whole")).alias("ts"), F.array_join(F.col("es.loss"), "").alias("loss"), "formatted_chars", "n_examples")
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    return read.select(
        "conv_id",
        F.size("ts").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("ts", line), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
    )

