"""Chat formatting in DataFrame operations only.

A conversation becomes one text: adjacent turns of a role are one block `<turn ROLE>...</turn>`, with `<part>`
between its turns. In texts `\\` is written `\\b` and `<` is written `\\l`, in roles `>` is also written
`\\g`; so every `<` is the template's own and every text can be read back. The text comes in segments, each
with a flag that tells whether it counts for the loss: those of the assistant's turns do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, PART = "<turn ", "</turn>", "<part>"
LEARNED = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    plain = F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">"))
    return F.replace(plain, F.lit("\\b"), F.lit("\\"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value worked out once."""
    return F.transform(F.array(value), use)[0]


def conversations(rows: DataFrame) -> DataFrame:
    """conv_id, turns (array of turn, role, text in order) of rows by turn.

    A null text or role is empty. Turns are ordered by number, nulls first; ties by role, then text, so repeated rows
    stay as repeated turns. Rows without conv_id are one conversation. One conversation is one row, as it becomes one text.
    """
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                    F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def _segments(turns: Column) -> Column:
    """Text and flag of every piece: a block for each run of one role, its turns joined from the run's slice."""
    n = F.size(turns)
    begins = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (turns[i - 1].role != turns[F.greatest(i - 2, F.lit(0))].role))

    def block(begins: Column) -> Column:
        def one(at: Column, k: Column) -> Column:
            end = F.coalesce(F.get(begins, k + 1), n + 1)
            run = F.slice(turns, at, end - at)
            role = turns[at - 1].role
            learned = role == LEARNED
            head = F.concat(F.lit(OPEN), F.replace(escape(role), F.lit(">"), F.lit("\\g")), F.lit(">"))
            texts = F.flatten(F.transform(run, lambda t, j: F.array(
                F.struct(F.when(j == 0, F.lit("")).otherwise(F.lit(PART)).alias("text"), F.lit(False).alias("loss")),
                F.struct(escape(t.text).alias("text"), learned.alias("loss")))))
            return F.concat(F.array(F.struct(head.alias("text"), F.lit(False).alias("loss"))), texts,
                            F.array(F.struct(F.lit(CLOSE).alias("text"), F.lit(False).alias("loss"))))

        return F.filter(F.flatten(F.transform(begins, one)), lambda s: s.text != "")

    return let(begins, block)


def format_chats(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, segments (array of text, loss: joined they are the formatted text) of rows by turn."""
    segments = conversations(rows).select("conv_id", let(F.col("turns"), _segments).alias("segments"))
    return segments.select("conv_id", F.array_join(F.transform("segments", lambda s: s.text), "").alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """The turns (array of role, text) of a formatted text."""
    blocks = F.filter(F.split(formatted, CLOSE), lambda b: b != "")

    def turns(block: Column) -> Column:
        end = F.locate(">", block)
        role = unescape(F.substring(block, F.lit(len(OPEN) + 1), end - len(OPEN) - 1))
        body = F.substring(block, end + 1, F.length(block))
        return F.transform(F.split(body, PART, -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def learned_text(segments: Column) -> Column:
    """All text that counts for the loss, as it was before it was escaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s.loss), lambda s: unescape(s.text)), "")
