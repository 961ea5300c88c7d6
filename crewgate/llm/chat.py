"""Operator 6: chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted; adjacent
turns of one role become one block of the template

    <|im_start|>ROLE\\nTEXT<|im_sep|>TEXT...<|im_end|>\\n

Control strings inside texts and roles are escaped reversibly: ``~`` becomes
``~0``, ``<|`` becomes ``<~1``, and in roles a line feed becomes ``~2``.  So the
template's own marks are the only ``<|`` of the output and splitting at them
gives every turn back (``read_back``).

``format_conversations`` returns ``segments``: array of (text, loss) whose texts
joined are the formatted conversation; ``loss`` marks the texts of the
assistant, without any mark.  All steps are linear in the number of turns.

A conversation is one training sample and one output row, so its turns meet in
one task; what is moved per conversation is that sample's own text, combined on
the map side.

Edge cases.  Null texts and null roles are empty strings.  Turns sort by
(turn, role, text), nulls first, so ties and repeated rows have a defined
place and all stay.  A null conversation id is a conversation of its own.  An
empty table gives no row.  Other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's marks.
START, SEP, END, LOSS_ROLE = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n", "assistant"


def _swap(c: Column, pairs) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape(c: Column) -> Column:
    return _swap(c, (("~", "~0"), ("<|", "<~1")))


def unescape(c: Column) -> Column:
    return _swap(c, (("<~1", "<|"), ("~0", "~")))


def escape_role(c: Column) -> Column:
    return _swap(escape(c), (("\n", "~2"),))


def unescape_role(c: Column) -> Column:
    return unescape(_swap(c, (("~2", "\n"),)))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, segments: array<struct<text, loss>>, formatted) per conversation."""
    turns = F.array_sort(F.collect_list(F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"))))
    rows = conversations.select("conv_id", "turn", "role", "text").groupBy("conv_id").agg(
        turns.alias("turns"))
    # a turn with the roles before and after it: where a run of one role begins and ends
    roles = F.transform("turns", lambda t: t.role)
    none = F.array(F.lit(None).cast("string"))
    n = F.size("turns")
    rows = rows.select("conv_id", F.arrays_zip(
        F.col("turns"), F.concat(none, F.slice(roles, 1, n - 1)).alias("before"),
        F.concat(F.slice(roles, 2, n), none).alias("after")).alias("runs"))

    def pieces(r):
        role = r["turns"].role
        head = F.when(r["before"].eqNullSafe(role), F.lit(SEP)).otherwise(
            F.concat(F.lit(START), escape_role(role), F.lit("\n")))
        tail = F.when(r["after"].eqNullSafe(role), F.lit("")).otherwise(F.lit(END))
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(r["turns"].text).alias("text"),
                     (role == F.lit(LOSS_ROLE)).alias("loss")),
            F.struct(tail.alias("text"), F.lit(False).alias("loss")))

    rows = rows.select("conv_id", F.flatten(F.transform("runs", pieces)).alias("segments"))
    return rows.select("conv_id", "segments", F.array_join(
        F.transform("segments", lambda s: s.text), "").alias("formatted"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role, text>>."""
    blocks = F.split(formatted, r"\Q" + END + r"\E")
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)       # nothing follows the last mark

    def turns(block):
        body = F.substr(block, F.lit(len(START) + 1))
        role = F.substring_index(body, "\n", 1)
        texts = F.split(F.substr(body, F.length(role) + 2), r"\Q" + SEP + r"\E")
        return F.transform(texts, lambda t: F.struct(
            unescape_role(role).alias("role"), unescape(t).alias("text")))
    return F.flatten(F.transform(blocks, turns))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s.loss),
                                    lambda s: unescape(s.text)), "")


def digests(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted conversations hold, read back from them."""
    rows = formatted.select("conv_id", read_back(F.col("formatted")).alias("turns"),
                            loss_text(F.col("segments")).alias("loss"), "formatted")
    said = F.array_join(F.transform("turns", lambda t: F.concat(
        t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return rows.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
