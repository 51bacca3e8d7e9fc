"""Preference pairs for training: the turns both conversations begin with become the prompt, the rest two completions.

Only assistant turns are learnt; spans say where they stand in a completion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "<|end|>"


def _clean(text: Column) -> Column:
    """A text can't forge a turn: its own ``<|`` is set apart."""
    return F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("<|"), F.lit("< |"))


def conversations_as_rows(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv_id, turns: array of (role, text) in order; turns with the same number stand by role, then text."""
    said = F.struct(F.col(turn_col).alias("turn"), _clean(F.coalesce(F.col(role_col), F.lit("user"))).alias("role"), _clean(F.col(text_col)).alias("text"))
    return turns.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(said)).alias("turns"))


def _head(t: Column) -> Column:
    return F.concat(F.lit("<|"), t["role"], F.lit("|>\n"))


def _turn(t: Column) -> Column:
    return F.concat(_head(t), t["text"], F.lit(END + "\n"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _turn), "")


def _spans(turns: Column) -> Column:
    """``start-end`` in code points of each assistant turn's text with its end mark, separated by blanks."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        begin = state["at"] + F.length(_head(t))
        to = begin + F.length(t["text"]) + len(END)
        span = F.concat(begin.cast("string"), F.lit("-"), to.cast("string"))
        return F.struct((to + 1).alias("at"), F.when(t["role"] == "assistant", F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    return F.array_join(F.aggregate(turns, start, step, lambda s: s["spans"]), " ")


def preference_pairs(
    turns: DataFrame, pairs: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """Per row of pairs (pair_id, chosen_id, rejected_id): n_shared (turns of the longest common prefix), prompt, and for
    both sides the completion and the spans of it that count.

    A side whose id is null or has no turns is an empty conversation; turns without a conversation's id belong to none.
    Null roles count as user, null texts as empty; repeated turns are kept; other columns are ignored; empty tables give
    empty results. A conversation becomes one row, so it has to fit one (2 GB).
    """
    rows = conversations_as_rows(turns, id_col, turn_col, role_col, text_col)
    side = lambda name: rows.select(F.col("conv_id").alias(f"{name}_id"), F.col("turns").alias(name))
    both = pairs.select("pair_id", "chosen_id", "rejected_id").join(side("chosen"), "chosen_id", "left").join(side("rejected"), "rejected_id", "left")
    none = F.expr("cast(array() as array<struct<turn: bigint, role: string, text: string>>)")
    plain = lambda name: F.transform(F.coalesce(F.col(name), none), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    both = both.withColumn("chosen", plain("chosen")).withColumn("rejected", plain("rejected"))
    least = F.least(F.size("chosen"), F.size("rejected"))
    equal = F.transform(F.arrays_zip("chosen", "rejected"), lambda z: F.coalesce(z["chosen"] == z["rejected"], F.lit(False)))
    first = F.array_position(equal, F.lit(False))
    both = both.withColumn("n_shared", F.when(first > 0, first - 1).otherwise(least).cast("long"))
    rest = lambda name: F.slice(F.col(name), (F.col("n_shared") + 1).cast("int"), F.greatest(F.size(name) - F.col("n_shared"), F.lit(0)).cast("int"))
    both = both.withColumn("c", rest("chosen")).withColumn("r", rest("rejected"))
    return both.select(
        "pair_id",
        "chosen_id",
        "rejected_id",
        "n_shared",
        _rendered(F.slice(F.col("chosen"), F.lit(1), F.col("n_shared").cast("int"))).alias("prompt"),
        _rendered(F.col("c")).alias("chosen"),
        _spans(F.col("c")).alias("chosen_spans"),
        _rendered(F.col("r")).alias("rejected"),
        _spans(F.col("r")).alias("rejected_spans"),
    )
