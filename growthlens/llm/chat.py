"""Preference formatting of conversations.

A pair holds a chosen and a rejected conversation, each an array of turns in order.
Their longest common prefix of turns (same role, same text) is rendered once as the
prompt; what follows is rendered per side as a completion with a loss mask in which
only the assistant's words and its end mark count. Masks are run lengths in
characters, ``0x<n>`` for ignored and ``1x<n>`` for trained stretches, so they can be
applied to any tokenisation. All of it is array expressions; the only shuffle of whole
texts gathers the turns of a conversation, which its rendered row has to hold anyway.

Defined results: rows without a conversation id are dropped. A null turn number comes
first, equal numbers go by role and text. A null role is ``unknown``, a null text
empty. If one side is a prefix of the other, its completion is empty; if both are
equal, both are. Marks of the template inside roles and texts are broken by a blank.
Repeated rows are repeated turns. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from growthlens.llm.common import written
from growthlens.operators.ids import dense_ids

#: The marks of the template.
START, END = "<|im_start|>", "<|im_end|>"
RANGE_IDS = 100_000  # ids of conversations that one task puts in order


def turns_of(rows: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """``id, turns`` per conversation; a turn is ``(turn, role, text)``."""
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    known = rows.filter(F.col(id_column).isNotNull())
    return known.groupBy(id_column).agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def _safe(text: Column) -> Column:
    return F.replace(text, F.lit("<|im_"), F.lit("< |im_"))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(START), _safe(turn["role"]), F.lit("\n"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _safe(t["text"]), F.lit(f"{END}\n"))), "")


def _mask(turns: Column) -> Column:
    def runs(t: Column) -> Column:
        head, body = F.length(_head(t)), F.length(_safe(t["text"])) + len(END)
        trained = F.concat(F.lit("0x"), head.cast("string"), F.lit(" 1x"), body.cast("string"), F.lit(" 0x1"))
        return F.when(t["role"] == "assistant", trained).otherwise(F.concat(F.lit("0x"), (head + body + 1).cast("string")))

    return F.array_join(F.transform(turns, runs), " ")


def common_turns(a: Column, b: Column) -> Column:
    """How many turns both sides share from the start."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    first_apart = F.array_position(same, F.lit(False))
    return F.when(first_apart == 0, F.size(a)).otherwise(first_apart - 1).cast("int")


def format_preferences(pairs: DataFrame) -> DataFrame:
    """``pair_id, chosen, rejected`` (arrays of turns) to the prompt and two masked completions."""
    split = pairs.withColumn("n_common", common_turns(F.col("chosen"), F.col("rejected")))
    rest = {s: F.slice(F.col(s), F.col("n_common") + 1, F.greatest(F.size(s), F.lit(1))) for s in ("chosen", "rejected")}
    split = split.select(
        "pair_id",
        "n_common",
        F.slice("chosen", F.lit(1), F.col("n_common")).alias("common"),
        rest["chosen"].alias("chosen"),
        rest["rejected"].alias("rejected"),
    )
    return split.select(
        "pair_id",
        "n_common",
        _render(F.col("common")).alias("prompt"),
        _render(F.col("chosen")).alias("chosen"),
        _mask(F.col("chosen")).alias("chosen_mask"),
        _render(F.col("rejected")).alias("rejected"),
        _mask(F.col("rejected")).alias("rejected_mask"),
    )


def last_replies(rows: DataFrame) -> DataFrame:
    """``conv_id, reply`` of every conversation in which the assistant speaks: its last words."""
    replies = rows.filter(F.col("conv_id").isNotNull() & (F.col("role") == "assistant"))
    text = F.coalesce("text", F.lit("")).alias("text")
    last = F.max(F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").cast("long").alias("turn"), text))
    return replies.groupBy("conv_id").agg(last.alias("last")).select("conv_id", F.col("last.text").alias("reply"))


def neighbours(ids: DataFrame) -> DataFrame:
    """``conv_id, neighbour``: the next id there is; the last one's is the first.

    Ids are put in order by ranges (``dense_ids``), so gaps between them do not matter.
    """
    numbering = dense_ids(ids, "conv_id", "_number", RANGE_IDS)
    following = numbering.table.select(
        F.col("conv_id").alias("neighbour"), F.pmod(F.col("_number") - 1, F.lit(max(numbering.size, 1))).alias("_number")
    )
    return numbering.table.join(following, "_number").select("conv_id", "neighbour")


def swapped_replies(rows: DataFrame) -> DataFrame:
    """Preference pairs from plain conversations: ``pair_id, chosen, rejected``.

    The chosen side is the conversation up to its last reply of the assistant. In the
    rejected side one reply, chosen by the id from all of them, gives way to the last reply
    of the next conversation that has one; those that follow stay. Every conversation with a reply gives
    a pair; the last one's neighbour is the first, and a single one is its own.
    """
    replies = written(last_replies(rows), "last_replies")
    others = replies.withColumnsRenamed({"conv_id": "neighbour", "reply": "other"})
    others = neighbours(replies).join(others, "neighbour").select("conv_id", "other")
    places = F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i + 1)), lambda i: i.isNotNull())
    talks = turns_of(rows).withColumn("places", places)
    talks = talks.join(others, "conv_id").withColumn("last", F.array_max("places"))
    at = F.get("places", F.pmod(F.col("conv_id"), F.size("places")).cast("int"))
    talks = talks.withColumn("at", at)

    def swapped(t: Column, i: Column) -> Column:
        text = F.when(i + 1 == F.col("at"), F.col("other")).otherwise(t["text"])
        return F.struct(t["turn"].alias("turn"), t["role"].alias("role"), text.alias("text"))

    chosen = F.slice("turns", F.lit(1), F.col("last"))
    return talks.select(F.col("conv_id").alias("pair_id"), chosen.alias("chosen"), F.transform(chosen, swapped).alias("rejected"))
