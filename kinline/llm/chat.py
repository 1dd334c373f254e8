"""Chat formatting with collapse of cumulative snapshots.

Logs often hold a conversation once after every turn. A conversation goes if its turns are the first turns
of a longer one, or all turns of one with a smaller id. Prefixes are compared by rolling hashes: a turn's
prefix hash is the exclusive or of 120 bits of hash of (turn, role, text) over it and all turns before it.
Anti-joins against the distinct prefix hashes retain maximal conversations, which are then rendered.

A conversation of any number of turns is dealt out in blocks of turns: the running hash within a block is a
window of that block alone, and what the blocks before add is a window over one row for each block. Rendered
text comes in segments of the same blocks, so no task gathers a conversation whole.

Everything is DataFrame functions. Defined results: a turn that is repeated (same conversation, number, role
and text) counts once; turns of one number are ordered by role and text; null role and text count as empty
when rendered, and differ from empty ones in comparisons; a null turn comes before all others when rendered with them
in a segment, and counts as turn -1 among the numbers; rows without a conversation id are left out; an empty table
gives none; other columns are ignored. Control tokens within a role or text are rendered with a blank after their first
character, and line ends of a role as blanks, so no text can forge a turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256  # turns of a segment
CONTROL = ["<|im_start|>", "<|im_end|>"]  # fixed values


def _plain(x: Column, role: bool = False) -> Column:
    """Without control tokens: the bar of each gets a blank before it. A role is one line."""
    for token in CONTROL:
        x = F.replace(x, F.lit(token), F.lit(f"<{' '}{token[1:]}"))
    return F.translate(x, "\r\n", "  ") if role else x


def _turns(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.filter("conv_id is not null").distinct()
    order = F.coalesce("turn", F.lit(-1))
    state = [F.coalesce("turn", F.lit(-(1 << 62))), F.coalesce(F.concat(F.lit("."), "role"), F.lit("")), F.coalesce(F.concat(F.lit("."), "text"), F.lit(""))]
    digest = F.sha2(F.to_json(F.array(*[x.cast("string") for x in state])), 256)
    half = lambda i: F.conv(F.substring(digest, i, 15), 16, 10).cast("long")
    return rows.withColumns({"seg": F.floor(order / BLOCK).cast("long"), "h1": half(1), "h2": half(17)})


def _prefixes(turns: DataFrame) -> DataFrame:
    """Each turn with the hash of all turns up to its number."""
    block = Window.partitionBy("conv_id", "seg")
    upto = block.orderBy(F.coalesce("turn", F.lit(-1))).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    totals = turns.groupBy("conv_id", "seg").agg(F.bit_xor("h1").alias("t1"), F.bit_xor("h2").alias("t2"), F.count("*").alias("tn"))
    base = totals.select("conv_id", "seg", *[F.coalesce(f(c).over(before), F.lit(0)).alias(b) for f, c, b in ((F.bit_xor, "t1", "b1"), (F.bit_xor, "t2", "b2"), (F.sum, "tn", "bn"))])
    within = turns.select("conv_id", "seg", "turn", F.bit_xor("h1").over(upto).alias("p1"), F.bit_xor("h2").over(upto).alias("p2"), F.count("*").over(upto).alias("pn"))
    return within.distinct().join(base, ["conv_id", "seg"]).select("conv_id", F.expr("p1 ^ b1").alias("h1"), F.expr("p2 ^ b2").alias("h2"), (F.col("pn") + F.col("bn")).alias("n"))


def maximal_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies): conversations that no other one contains; ``n_copies`` have the same turns."""
    turns = _turns(conversations)
    whole = turns.groupBy("conv_id").agg(F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"), F.count("*").alias("n"))
    own = whole.groupBy("h1", "h2", "n").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    longer = _prefixes(turns).join(whole.select("conv_id", F.col("n").alias("all")), "conv_id").filter("n < all").select("h1", "h2", "n").distinct()
    return own.join(longer, ["h1", "h2", "n"], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_copies")


def format_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, segment, n_turns, n_copies, rendered) of maximal conversations; segments in order make up one."""
    kept = maximal_conversations(conversations)
    key = F.struct(F.coalesce("turn", F.lit(-1)).alias("t"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    segments = _turns(conversations).groupBy("conv_id", "seg").agg(F.array_sort(F.collect_list(key)).alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(F.lit("<|im_start|>"), _plain(t["role"], role=True), F.lit("\n"), _plain(t["text"]), F.lit("<|im_end|>\n"))), "")
    return segments.join(kept, "conv_id").select("conv_id", F.col("seg").alias("segment"), "n_turns", "n_copies", text.alias("rendered"))
