"""Chat formatting: collapse of cumulative snapshots, then rendering. DataFrame functions only.

A logging client may store a conversation again after each turn. A rolling hash of the turns read so far, an XOR over a
window of hashes of (position, role, text), names every prefix; two such hashes with different salts make 128 bits. A
conversation whose own name is a proper prefix of another's goes by an anti-join; of equal conversations the smallest id
stays. Names are made distinct before the join, so a first turn that very many conversations share is one row of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def _rows(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    return conversations.select(F.col(conv_id).alias("id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def _mixed(salt: str, place: Column) -> Column:
    """The hash of one turn at its place in the conversation."""
    return F.xxhash64(F.lit(salt), place, "role", "text")


def _prefix_names(rows: DataFrame) -> DataFrame:
    """(id, i, n, h1, h2): the name of the first i of a conversation's n turns."""
    own = Window.partitionBy("id")
    ordered = own.orderBy("turn", "role", "text")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = rows.withColumn("i", F.row_number().over(ordered)).withColumn("n", F.count("*").over(own))
    rolling = lambda salt: F.bit_xor(_mixed(salt, F.col("i"))).over(so_far)
    return numbered.select("id", "i", "n", rolling("a").alias("h1"), rolling("b").alias("h2"))


def format_chats(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", start: str = START, end: str = END) -> DataFrame:
    """The maximal conversations: conv_id, n_turns, n_copies (equal conversations, itself included), chat (rendered).

    Turns are ordered by turn, then role and text. A conversation is dropped if its turns, as (role, text) in order, are the
    first turns of a longer one; of equal ones the smallest conv_id stays. Only what stays is rendered. Rendered turns read
    ``<|im_start|>role\\ntext<|im_end|>\\n``. Null roles and texts count as empty; null turns come first. A row with a null
    conv_id belongs to no other: it is a conversation of one turn, whose id stays null unless an equal one has an id, so
    such rows are no hot group. Repeated rows are turns of their own. Texts of any length are kept whole. An empty table
    gives an empty table. Other columns are ignored, whatever their names.
    """
    rows = _rows(conversations, conv_id, turn, role, text)
    known, unknown = rows.filter("id is not null"), rows.filter("id is null")
    names = _prefix_names(known)
    first = F.lit(1)
    single = unknown.select("id", F.lit(1).cast("long").alias("n"), _mixed("a", first).alias("h1"), _mixed("b", first).alias("h2"), "role", "text")
    whole = names.filter("i = n").select("id", "n", "h1", "h2").unionByName(single.select("id", "n", "h1", "h2"))
    whole = whole.groupBy("n", "h1", "h2").agg(F.min("id").alias("kept_id"), F.count("*").alias("n_copies"))
    prefixes = names.filter("i < n").select(F.col("i").cast("long").alias("n"), "h1", "h2").distinct()
    kept = whole.join(prefixes, ["n", "h1", "h2"], "left_anti")
    line = lambda r, t: F.concat(F.lit(start), r, F.lit("\n"), t, F.lit(end + "\n"))
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    mine = known.join(kept.select("kept_id", "n", "n_copies"), F.col("id") == F.col("kept_id")).groupBy("id", "n", "n_copies").agg(turns.alias("turns"))
    chats = mine.select("id", "n", "n_copies", F.array_join(F.transform("turns", lambda x: line(x["role"], x["text"])), "").alias("chat"))
    alone = kept.filter("kept_id is null").join(single.groupBy("h1", "h2").agg(F.first("role").alias("role"), F.first("text").alias("text")), ["h1", "h2"])
    chats = chats.unionByName(alone.select(F.col("kept_id").alias("id"), "n", "n_copies", line(F.col("role"), F.col("text")).alias("chat")))
    return chats.select(F.col("id").alias(conv_id), F.col("n").alias("n_turns"), "n_copies", "chat")
