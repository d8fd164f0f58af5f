"""Chat formatting: drop logged snapshots that longer conversations continue, then render, in column functions only.

Every conversation gets a hash after each of its turns, rolled over (role, text).
A conversation whose last hash is another's hash at the same turn is a prefix of
it: if the other is longer, or is equal and has a smaller id, it is dropped by an
anti-join. What stays is rendered as one training text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskrank.session import materialise


def assemble(df: DataFrame) -> DataFrame:
    """(conv_id, turns, marks): the ordered turns of each conversation and its hash after each.

    Turns come by ``turn``, ties by role and text; repeated rows count once; null
    roles and texts are empty ones, rows with a null turn come first, and rows
    without a conv_id belong to no conversation and are left out.
    """
    rows = df.where(F.col("conv_id").isNotNull()).select(
        "conv_id", F.struct(F.col("turn").cast("long").alias("turn"),
                            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("said"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_set("said")).alias("turns"))

    def roll(marks: Column, said: Column) -> Column:
        last = F.coalesce(F.get(marks, F.size(marks) - 1), F.lit(""))
        turn = F.concat_ws(":", last, F.length(said["role"]).cast("string"), said["role"], said["text"])
        return F.concat(marks, F.array(F.sha2(turn, 256)))

    return grouped.withColumn("marks", F.aggregate("turns", F.array().cast("array<string>"), roll))


def render(turns: Column) -> Column:
    """Role headers and texts; a text cannot forge a header, as its own ``<|`` is written ``< |``."""
    return F.array_join(F.transform(turns, lambda s: F.concat(
        F.lit("<|"), F.replace(s["role"], F.lit("|"), F.lit("")), F.lit("|>\n"),
        F.replace(s["text"], F.lit("<|"), F.lit("< |")), F.lit("\n<|end|>\n"))), "")


def maximal_conversations(df: DataFrame) -> DataFrame:
    """(conv_id, n_turns, rendered) of the conversations that no other one continues or repeats."""
    held = materialise(assemble(df), "conversations")
    own = held.select("conv_id", F.size("marks").alias("n_turns"), F.element_at("marks", -1).alias("mark"))
    ends = own.groupBy("mark").agg(F.min("conv_id").alias("first_id"))
    # Hashes before the last turn: whoever ends in one of them is continued by this conversation.
    inner = held.select(F.explode(F.slice("marks", 1, F.size("marks") - 1)).alias("mark")).distinct()
    maximal = ends.join(inner, "mark", "left_anti").select(F.col("first_id").alias("conv_id"))
    return held.join(maximal, "conv_id", "left_semi").select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), render(F.col("turns")).alias("rendered"))
