"""Preference formatting of conversations, in DataFrame operations only.

The longest common turn prefix of a chosen and a rejected conversation is rendered once as the
prompt; the turns after it are rendered as two completions, with the character spans a loss may
count: the assistant's texts and their end marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Template: head of a turn, then its text, then the end mark.
HEAD, TAIL, END = "<|", "|>\n", "<|end|>\n"


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit(HEAD), turn["role"], F.lit(TAIL), turn["text"], F.lit(END))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def _spans(turns: Column, role: str) -> Column:
    """``start-end`` of the role's texts with end marks in the rendered turns, comma-joined."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(t["role"]) + len(HEAD) + len(TAIL)
        end = begin + F.length(t["text"]) + len(END)
        span = F.array(F.concat_ws("-", begin.cast("string"), end.cast("string")))
        return F.struct(end.alias("at"), F.when(t["role"] == role, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.array_join(F.aggregate(turns, start, step, lambda acc: acc["out"]), ",")


def preferences(turns: DataFrame, pairs: DataFrame, role: str = "assistant") -> DataFrame:
    """Render pairs of conversations as prompt and masked completions.

    ``turns(conv_id, turn, role, text)`` and ``pairs(pair_id, chosen_id, rejected_id)``; other
    columns are ignored. Returns per pair ``pair_id, chosen_id, rejected_id, n_prefix, n_chosen,
    n_rejected`` (turns), ``prompt, chosen, rejected`` (texts), ``chosen_spans, rejected_spans``.

    Turns are ordered by turn, role and text; repeated turns stay. A null role is ``unknown``, a
    null text is empty. Turns without ``conv_id`` belong to no conversation. A conversation that is
    missing or null has no turns: the prompt is empty and so is its completion. A conversation may
    stand in many pairs; its turns then move once for each. Repeated rows of ``pairs`` are one pair;
    without pairs there are no rows.
    """
    sides = pairs.select(F.col("pair_id").cast("long").alias("pair_id"), F.col("chosen_id").cast("long").alias("chosen_id"), F.col("rejected_id").cast("long").alias("rejected_id")).distinct()
    said = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    wanted = sides.select("pair_id", "chosen_id", "rejected_id", F.posexplode(F.array("chosen_id", "rejected_id")).alias("side", "conv_id"))
    met = wanted.join(said, "conv_id", "left")
    turn = F.struct("turn", "role", "text")
    spoken = F.col("role").isNotNull()
    both = met.groupBy("pair_id", "chosen_id", "rejected_id").agg(
        *(F.array_sort(F.collect_list(F.when(spoken & (F.col("side") == k), turn))).alias(name) for k, name in enumerate("cr"))
    )
    n = F.least(F.size("c"), F.size("r"))
    equal = F.zip_with(F.slice("c", F.lit(1), n), F.slice("r", F.lit(1), n), lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"]))
    stop = F.array_position(equal, False)
    prefix = F.when(stop == 0, n).otherwise(stop - 1).cast("int")
    both = both.withColumn("k", prefix)
    after = lambda x: F.slice(x, F.col("k") + 1, F.size(x))
    return both.select(
        "pair_id",
        "chosen_id",
        "rejected_id",
        F.col("k").cast("long").alias("n_prefix"),
        (F.size("c") - F.col("k")).cast("long").alias("n_chosen"),
        (F.size("r") - F.col("k")).cast("long").alias("n_rejected"),
        _render(F.slice("c", F.lit(1), F.col("k"))).alias("prompt"),
        _render(after("c")).alias("chosen"),
        _render(after("r")).alias("rejected"),
        _spans(after("c"), role).alias("chosen_spans"),
        _spans(after("r"), role).alias("rejected_spans"),
    )
