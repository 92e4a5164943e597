"""Preference formatting: shared turns become one prompt, the rest of either conversation a masked completion.

For a pair of conversations the longest common prefix of turns (role and text equal) is rendered once; what follows in each is
rendered as its completion. A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``; the markers are taken out of roles and texts, so
no text can forge a turn. Masks are character spans of a completion that carry loss: the text and end marker of assistant turns.

Turns are gathered per conversation (ordered by turn, then role and text), a conversation once; pairs are then joined to them by
id, so a conversation in very many pairs is a skewed join and not a group.

Defined cases: null roles and texts count as empty. Repeated turns stay, in order. Turns with a null conversation id belong to no
conversation. A pair with a missing side treats it as a conversation without turns. Equal conversations have the whole
conversation as prompt and empty completions. Empty tables give an empty result. Extra columns are unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _clean(c: Column) -> Column:
    """Markers are removed; a marker that this puts together is broken up by its bar."""
    bare = F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit(OPEN), F.lit("")), F.lit(CLOSE), F.lit(""))
    return F.replace(F.replace(bare, F.lit(OPEN), F.lit("< |im_start|>")), F.lit(CLOSE), F.lit("< |im_end|>"))


def conversations_of(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> (conv_id, turns array<struct<role, text>>)."""
    rows = common.add_id_check(turns, ["conv_id", "turn", "role", "text"]).where("conv_id is not null")
    parts = rows.select("conv_id", F.struct("turn", _clean(F.col("role")).alias("role"), _clean(F.col("text")).alias("text")).alias("t"))
    listed = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))  # the turns of one conversation
    return listed.select("conv_id", F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays of turns."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE + "\n"))), "")


def loss_spans(turns: Column) -> Column:
    """Spans (start, length) in code points of the assistant parts of ``rendered(turns)``."""
    empty = F.lit(None).cast("array<struct<start:int,length:int>>")
    none = F.coalesce(empty, F.array().cast("array<struct<start:int,length:int>>"))

    def add(acc, t):
        head = F.length(t["role"]) + len(OPEN) + 1
        body = F.length(t["text"]) + len(CLOSE)
        span = F.array(F.struct((acc["at"] + head).cast("int").alias("start"), body.cast("int").alias("length")))
        return F.struct((acc["at"] + head + body + 1).cast("int").alias("at"), F.when(t["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), none.alias("spans")), add, lambda acc: acc["spans"])


def preferences(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (pair_id, chosen_id, rejected_id) -> prompt, completions and loss spans, a row a pair."""
    convs = common.scratch(conversations_of(turns), "conversations")
    c = convs.withColumnsRenamed({"conv_id": "_c", "turns": "_ct"})
    r = convs.withColumnsRenamed({"conv_id": "_r", "turns": "_rt"})
    met = pairs.join(c, F.col("chosen_id") == F.col("_c"), "left").join(r, F.col("rejected_id") == F.col("_r"), "left")
    nothing = F.array().cast("array<struct<role:string,text:string>>")
    met = met.select("pair_id", "chosen_id", "rejected_id", F.coalesce("_ct", nothing).alias("ct"), F.coalesce("_rt", nothing).alias("rt"))
    met = met.withColumn("n_common", common_turns(F.col("ct"), F.col("rt")))
    rest = lambda x: F.slice(x, F.col("n_common") + 1, F.greatest(F.lit(0), F.size(x) - F.col("n_common")))
    return met.select(
        "pair_id", "chosen_id", "rejected_id", "n_common",
        rendered(F.slice("ct", F.lit(1), F.col("n_common"))).alias("prompt"),
        rendered(rest(F.col("ct"))).alias("chosen"), rendered(rest(F.col("rt"))).alias("rejected"),
        loss_spans(rest(F.col("ct"))).alias("chosen_spans"), loss_spans(rest(F.col("rt"))).alias("rejected_spans"),
    )


def neighbour_pairs(turns: DataFrame) -> DataFrame:
    """Every conversation once: ids 2k (chosen) and 2k + 1 (rejected) are a pair; a side may be missing."""
    ids = turns.select("conv_id").where("conv_id is not null").distinct()
    k = F.floor(F.col("conv_id") / 2).cast("long")
    even, odd = F.pmod("conv_id", F.lit(2)) == 0, F.pmod("conv_id", F.lit(2)) == 1
    return ids.groupBy(k.alias("pair_id")).agg(F.max(F.when(even, F.col("conv_id"))).alias("chosen_id"), F.max(F.when(odd, F.col("conv_id"))).alias("rejected_id"))


def spans_text(spans: Column) -> Column:
    """start+length, start+length, ... as text."""
    return F.array_join(F.transform(spans, lambda s: F.concat(s["start"].cast("string"), F.lit("+"), s["length"].cast("string"))), ",")
