"""Chat formatting of logged conversations, after cumulative snapshots are collapsed.

A log often holds a conversation again and again as it grows. Each turn gets the hash of all turns up
to it, rolled forward by a window over the conversation; a conversation whose last hash is the hash of
a shorter prefix of another one is that one's snapshot. Snapshots go by an anti-join on hashes, and
what is left is rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from townhall.llm.common import materialize

#: What a turn is rendered as, and the marks that texts may not hold as they are. Fixed values.
BEGIN, END = "<|im_start|>", "<|im_end|>"


def rendered_turn(role: Column, text: Column) -> Column:
    """One turn in the chat format; marks inside a text lose their bars, so they can't end a turn."""
    safe = lambda c: F.replace(F.replace(c, F.lit(BEGIN), F.lit("<im_start>")), F.lit(END), F.lit("<im_end>"))
    return F.concat(F.lit(BEGIN), safe(F.coalesce(role, F.lit("unknown"))), F.lit("\n"), safe(F.coalesce(text, F.lit(""))), F.lit(END), F.lit("\n"))


def rolling_prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, place, turn, role, text, and the two hashes of the turns up to and with this one.

    A turn's hash covers its place, so the exclusive-or of hashes over a prefix stands for the prefix in
    its order; two independent hashes make 128 bits. Rows alike in all four columns are one turn.
    """
    each = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    each = each.filter("conv_id is not null").distinct()
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), F.col("text").asc_nulls_last())
    placed = each.withColumn("place", F.row_number().over(order))
    content = [F.col("place"), F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.withColumns({
        "h1": F.bit_xor(F.xxhash64(F.lit("first"), *content)).over(so_far),
        "h2": F.bit_xor(F.xxhash64(*content, F.lit("second"))).over(so_far),
    })


def collapse_snapshots(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies: the maximal conversations, each once under its least id.

    Both sides of the anti-join have every hash once, so a first turn that a third of all conversations
    begin with is one row there.
    """
    p = turns.select("conv_id", "place", "h1", "h2")
    last = p.groupBy("conv_id").agg(F.max(F.struct("place", "h1", "h2")).alias("l"))
    whole = last.groupBy(F.col("l.place").alias("place"), F.col("l.h1").alias("h1"), F.col("l.h2").alias("h2")).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    shorter = p.withColumn("next", F.lead("place").over(Window.partitionBy("conv_id").orderBy("place"))).filter("next is not null").select("place", "h1", "h2").distinct()
    return whole.join(shorter, ["place", "h1", "h2"], "left_anti").select("conv_id", F.col("place").cast("long").alias("n_turns"), "copies")


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies, chat: every maximal conversation, rendered.

    turns: conv_id, turn, role, text; other columns don't matter. Turns stand in the order of turn, then
    role, then text, nulls last; rows alike in all of them are one turn. A null role is "unknown", a null
    text empty (either differs from the string in comparisons). Rows without conv_id belong to no
    conversation and are left out. Equal conversations stay once, under the least id, with their number.
    An empty table gives no rows.
    """
    prefixes = materialize(rolling_prefixes(turns), "turn-prefixes")
    kept = collapse_snapshots(prefixes)
    parts = prefixes.join(kept, "conv_id").withColumn("part", rendered_turn(F.col("role"), F.col("text")))
    chats = parts.groupBy("conv_id", "n_turns", "copies").agg(F.array_sort(F.collect_list(F.struct("place", "part"))).alias("parts"))
    return chats.select("conv_id", "n_turns", "copies", F.array_join("parts.part", "").alias("chat"))
