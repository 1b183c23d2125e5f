"""Preference formatting: chosen and rejected conversations become one prompt and two masked completions.

Main path: DataFrame functions only.

The longest common prefix of turns (same role and text) is rendered once as the prompt; what follows in either
conversation is its completion. A completion's mask runs over its characters: "0x15,1x40" leaves 15 characters untrained
(the turn's header) and trains on 40 (the text and end mark of an assistant's turn; other roles' are 0).

Nulls: a null role or text counts as empty when rendered; two nulls are equal when compared. Rows without conv_id belong
to no conversation and take no part; a null turn sorts first. Repeated turn numbers stand in order of role, then text.
A conversation without a partner is kept with a null rejected_id, an empty rejected completion and, having nothing to share, an empty
prompt. Empty tables give empty results; other columns are ignored. One conversation's turns come together in one row,
since its rendering is one value; nothing larger than one pair is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of a rendered turn.
START, END = "<|im_start|>", "<|im_end|>\n"
TRAINED_ROLE = "assistant"


def _header(turn: Column) -> Column:
    return F.concat(F.lit(START), F.coalesce(turn["role"], F.lit("")), F.lit("\n"))


def _body(turn: Column) -> Column:
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit(END))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), _body(t))), "")


def mask(turns: Column) -> Column:
    trained = lambda t: F.when(t["role"] == TRAINED_ROLE, F.lit(",1x")).otherwise(F.lit(",0x"))
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("0x"), F.length(_header(t)).cast("string"), trained(t), F.length(_body(t)).cast("string"))), ",")


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading turns that are equal."""
    same = F.zip_with(a, b, lambda x, y: x.isNotNull() & y.isNotNull() & x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def with_other_answers(turns: DataFrame, donor: Column) -> DataFrame:
    """turns (conv_id, turn, role, text) as preference data where there is none: pair, is_chosen, conv_id, turn, role, text.

    A conversation as it stands is the chosen side of pair conv_id. The rejected side, under the id of the donor (an expression on conv_id), has the same turns up to the last answer of
    the conversation, and in its place the donor's last answer. Without an answer of its own or of the donor there is no rejected side. The last answer is the one of the greatest (turn, text)."""
    rows = turns.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", "role", "text")
    last = rows.where(F.col("role") == TRAINED_ROLE).groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("own"))
    other = last.select(F.col("conv_id").alias("donor"), F.col("own.text").alias("answer"))
    given = last.select("conv_id", "own", donor.alias("donor")).join(other, "donor")
    before = F.struct("turn", "role", "text") < F.struct(F.col("own.turn"), F.lit(TRAINED_ROLE), F.col("own.text"))
    shared = rows.join(given, "conv_id").where(before).select(F.col("conv_id").alias("pair"), F.lit(False), F.col("donor").alias("conv_id"), "turn", "role", "text")
    answer = given.select(F.col("conv_id").alias("pair"), F.lit(False), F.col("donor").alias("conv_id"), F.col("own.turn").alias("turn"), F.lit(TRAINED_ROLE).alias("role"), F.col("answer").alias("text"))
    whole = rows.select(F.col("conv_id").alias("pair"), F.lit(True).alias("is_chosen"), "conv_id", "turn", "role", "text")
    return whole.union(shared).union(answer)


def preference_pairs(turns: DataFrame, pair_id: Column, chosen: Column) -> DataFrame:
    """turns: conv_id, turn, role, text; pair_id and chosen (a boolean) are expressions over conv_id that say which pair and which side a conversation is of.

    One row for each pair. One shuffle, by pair."""
    side = lambda of: F.transform(F.array_sort(F.filter("all", lambda t: t["chosen"] == of)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        pair_id.alias("pair_id"), F.struct(chosen.alias("chosen"), F.col("turn"), F.col("role"), F.col("text"), F.col("conv_id")).alias("t")
    )
    pairs = rows.groupBy("pair_id").agg(
        F.collect_list("t").alias("all"), F.min(F.when(F.col("t.chosen"), F.col("t.conv_id"))).alias("chosen_id"), F.min(F.when(~F.col("t.chosen"), F.col("t.conv_id"))).alias("rejected_id")
    )
    pairs = pairs.select("pair_id", "chosen_id", "rejected_id", side(True).alias("c"), side(False).alias("r")).withColumn("shared", common_prefix(F.col("c"), F.col("r")))
    rest = lambda x: F.slice(x, F.col("shared") + 1, F.greatest(F.size(x) - F.col("shared"), F.lit(0)))
    return pairs.select(
        "pair_id", "chosen_id", "rejected_id", "shared", F.size("c").alias("chosen_turns"), F.size("r").alias("rejected_turns"),
        render(F.slice("c", F.lit(1), F.col("shared"))).alias("prompt"),
        render(rest("c")).alias("chosen"), render(rest("r")).alias("rejected"), mask(rest("c")).alias("chosen_mask"), mask(rest("r")).alias("rejected_mask"),
    )
