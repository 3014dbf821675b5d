"""Chat formatting with cumulative-snapshot collapse.

Logs often keep a conversation after every turn, so that each snapshot is a prefix of the next.
A conversation's prefixes get rolling hashes: the hash of a prefix is the exclusive or of the
hashes of (place, digest of role and text) of its turns, two independent 64-bit ones, so a running total over
ordered turns gives them all, in blocks that Spark can deal out. A conversation whose whole hash is
a proper prefix's of another one is dropped by an anti-join, and of equal ones the smallest id
stays. Only what remains is rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns are ranked and hashed in blocks of so many turn numbers, so a very long conversation is many groups.
BLOCK = 512
#: What a null turn number counts as.
NO_TURN = -(1 << 63)


def _turns(df: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    return df.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("conv_id"), F.coalesce(F.col(turn_col).cast("long"), F.lit(NO_TURN)).alias("turn"), role.alias("role"), text.alias("text"),
        F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
    )


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, n, last, ha, hb): for each place n in each conversation the hashes of its first n
    turns, and whether it is the last place."""
    turns = turns.select("conv_id", "turn", "digest", F.floor(F.col("turn") / BLOCK).alias("block"))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "digest")
    placed = turns.withColumn("i", F.row_number().over(inside))
    sizes = turns.groupBy("conv_id", "block").agg(F.count("*").alias("size"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("conv_id", "block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"), F.sum("size").over(Window.partitionBy("conv_id")).alias("total"))
    placed = placed.join(sizes, ["conv_id", "block"]).withColumn("n", F.col("start") + F.col("i"))
    placed = placed.withColumn("xa", F.xxhash64("n", "digest")).withColumn("xb", F.xxhash64("digest", "n"))
    blocks = placed.groupBy("conv_id", "block").agg(F.bit_xor("xa").alias("ba"), F.bit_xor("xb").alias("bb"))
    blocks = blocks.select("conv_id", "block", *[F.coalesce(F.bit_xor(c).over(before), F.lit(0)).alias(c) for c in ("ba", "bb")])
    # By place, since equal turns may come in another order than when they got theirs.
    up_to = Window.partitionBy("conv_id", "block").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("ra", F.bit_xor("xa").over(up_to)).withColumn("rb", F.bit_xor("xb").over(up_to))
    return placed.join(blocks, ["conv_id", "block"]).select(
        "conv_id", "n", (F.col("n") == F.col("total")).alias("last"), F.col("ba").bitwiseXOR(F.col("ra")).alias("ha"), F.col("bb").bitwiseXOR(F.col("rb")).alias("hb")
    )


def maximal(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, n_turns, n_equal): the conversations that are no proper prefix of another, one of
    each group of equal ones (the smallest id) with the group's size."""
    found = prefixes(_turns(df, id_col, turn_col, role_col, text_col))
    whole = found.where("last").groupBy("n", "ha", "hb").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_equal"))
    proper = found.where("NOT last").select("n", "ha", "hb").distinct()
    return whole.join(proper, ["n", "ha", "hb"], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_equal")


def rendered(role: Column, text: Column) -> Column:
    """One turn; a marker inside a role or text is broken by a space, so that it can't end the turn."""
    safe = lambda c: F.regexp_replace(c, r"<\|(im_start|im_end)\|>", "<| $1|>")
    return F.concat(F.lit("<|im_start|>"), safe(role), F.lit("\n"), safe(text), F.lit("<|im_end|>\n"))


def format_chats(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, n_turns, n_equal, chat: every maximal conversation with its turns rendered in order.

    Turns stand by number; null numbers come first, ties and repeated rows go by the MD5 of role and
    text and all count. Null roles and texts are empty. Rows with a null id take no part; other
    columns play none. A conversation's chat is one value, so its turns meet in one row; hashing and
    collapsing do not need that. An empty table gives no rows.
    """
    keep = maximal(df, id_col, turn_col, role_col, text_col)
    turns = _turns(df, id_col, turn_col, role_col, text_col).join(keep, "conv_id")
    parts = turns.groupBy("conv_id", "n_turns", "n_equal").agg(F.array_sort(F.collect_list(F.struct("turn", "digest", rendered(F.col("role"), F.col("text")).alias("t")))).alias("turns"))
    return parts.select("conv_id", "n_turns", "n_equal", F.array_join(F.transform("turns", lambda x: x["t"]), "").alias("chat"))
