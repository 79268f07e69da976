"""Preference formatting of conversations (operator 10), with DataFrame functions only.

For each pair of a chosen and a rejected conversation the longest common prefix of turns (equal
role and text, from the first turn on) is rendered once as the prompt; what follows is rendered as
two completions. A mask tells, run by run, which characters of a completion are trained on: the
text and end mark of assistant turns. It is written as ``flag:length`` runs joined by commas.

Turns are brought together by conversation, conversations by pair; a conversation is one training
example and has to fit one row, however many pairs use it (such a conversation meets its pairs in
a join that Spark splits if it is skewed).

Defined cases. Turns are ordered by turn, role and text, nulls first; equal rows count once. A null
role or text counts as empty. Turns of a null conversation id belong to none. A pair is left out
if a side is null or has no turns. Equal rows of pairs count once; a pair id with other sides is
another pair, with a row of its own. If a conversation is a prefix of the other (or equal to it), its
completion and mask are empty. Empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the public ChatML format.
START, END = "<|im_start|>", "<|im_end|>\n"


def conversations_of(turns: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id`` and its turns in order."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.where("conv_id is not null").select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_set("t")).alias("turns"))


def common_turns(a: Column, b: Column) -> Column:
    """Number of turns that both arrays have in common from the first on."""
    n = F.least(F.size(a), F.size(b))
    differs = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: (x["role"] != y["role"]) | (x["text"] != y["text"]))
    at = F.array_position(differs, True)
    return F.when(at == 0, n).otherwise(at.cast("int") - 1)


def head(t: Column) -> Column:
    return F.concat(F.lit(START), t["role"], F.lit("\n"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(head(t), t["text"], F.lit(END))), "")


def mask(turns: Column) -> Column:
    def runs(t: Column) -> Column:
        before, after = F.length(head(t)), F.length(t["text"]) + len(END)
        trained = F.concat(F.lit("0:"), before.cast("string"), F.lit(",1:"), after.cast("string"))
        return F.when(t["role"] == "assistant", trained).otherwise(F.concat(F.lit("0:"), (before + after).cast("string")))

    return F.array_join(F.transform(turns, runs), ",")


def format_preferences(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, role, text)``, ``pairs(pair_id, chosen_id, rejected_id)`` -> one row per pair."""
    convs = conversations_of(turns)
    ids = ["pair_id", "chosen_id", "rejected_id"]
    side = lambda flag, c: F.struct(F.lit(flag).alias("chosen"), F.col(c).alias("conv_id"))
    sides = pairs.select(*ids).distinct().select(*ids, F.explode(F.array(side(True, "chosen_id"), side(False, "rejected_id"))).alias("s")).select(*ids, "s.*")
    both = (
        sides.join(convs, "conv_id")
        .groupBy(*ids)
        .agg(F.first(F.when(F.col("chosen"), F.col("turns")), True).alias("a"), F.first(F.when(~F.col("chosen"), F.col("turns")), True).alias("b"))
        .where("a is not null and b is not null")
        .withColumn("k", common_turns(F.col("a"), F.col("b")))
    )
    rest = {x: F.slice(F.col(x), F.col("k") + 1, F.size(x)) for x in "ab"}
    return both.select(
        "pair_id",
        "chosen_id",
        "rejected_id",
        F.col("k").cast("long").alias("n_prompt_turns"),
        rendered(F.slice("a", F.lit(1), F.col("k"))).alias("prompt"),
        rendered(rest["a"]).alias("chosen"),
        rendered(rest["b"]).alias("rejected"),
        mask(rest["a"]).alias("chosen_mask"),
        mask(rest["b"]).alias("rejected_mask"),
    )


def neighbours_as_pairs(turns: DataFrame) -> DataFrame:
    """Pairs for a table that names none: conversation 2k is chosen, 2k + 1 rejected."""
    k = F.floor(F.col("conv_id") / 2)
    return turns.where("conv_id is not null").select(k.alias("pair_id")).distinct().select("pair_id", (F.col("pair_id") * 2).alias("chosen_id"), (F.col("pair_id") * 2 + 1).alias("rejected_id"))
