r"""Chat formatting from event logs, in DataFrame functions only.

A log holds events of conversations: ``delta`` appends to a message, ``edit``
replaces it, ``regenerate`` clears it and takes back every later message written
before.  The final messages are folded from each conversation's events in the order
of their sequence numbers and rendered:

    [INST]role[/INST]text</s>

for each message.  Inside roles and texts a backslash is doubled and every control
string gets a backslash after its first character, so neither ends a turn early,
and :func:`unescape` restores both exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE, END = "[INST]", "[/INST]", "</s>"
_CONTROL = r"([<\[])(/?s>|/?INST\]|/?SYS\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    r"""Drops each single backslash and keeps one of each pair."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def turn_events(conversations: DataFrame) -> DataFrame:
    """A table of whole turns (conv_id, turn, role, text) as a log of one delta for each row; equal turns go by role and text."""
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    return conversations.select("conv_id", "turn", "role", "text").withColumn("message", F.row_number().over(order).cast("long")).select("conv_id", "message", F.col("message").alias("seq"), F.lit("delta").alias("kind"), "role", "text")


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, message, role, text) of a log (conv_id, message, seq, kind, role, text).

    Null kinds count as delta, null texts and roles as empty, null message numbers
    count as smallest, null sequence numbers come first; a null conv_id is one conversation.  Events of equal sequence number are
    taken in the order of kind, role and text, so repeated rows of a log append
    twice.  A message's role is that of its first live event that names one.  Messages of
    which only a regeneration is left are empty.

    The log moves once, by conversation; the windows and groups after that need no
    further shuffle.  A conversation is one string in the end, so it is the unit of
    work by definition; the fold itself is per message.
    """
    log = events.select(
        "conv_id",
        F.coalesce("message", F.lit(-(1 << 62))).alias("message"),
        "seq",
        F.coalesce("kind", F.lit("delta")).alias("kind"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    later = Window.partitionBy("conv_id").orderBy(F.desc_nulls_last("seq"), F.desc("kind"), F.desc("role"), F.desc("text")).rowsBetween(Window.unboundedPreceding, -1)
    cut = F.min(F.when(F.col("kind") == "regenerate", F.col("message"))).over(later)
    live = log.withColumn("cut", cut).filter("cut is null or message < cut")
    steps = F.array_sort(F.collect_list(F.struct("seq", "kind", "role", "text")))
    grouped = live.groupBy("conv_id", "message").agg(steps.alias("steps"))
    # what precedes the last edit or regeneration doesn't count; the rest is appended
    marks = F.transform("steps", lambda s, i: F.when(s["kind"].isin("edit", "regenerate"), i))
    first = F.coalesce(F.array_max(marks), F.lit(0))
    kept = F.slice("steps", first + 1, F.size("steps") - first)
    text = F.array_join(F.transform(kept, lambda s: F.when(s["kind"] == "regenerate", F.lit("")).otherwise(s["text"])), "")
    named = F.filter(F.transform("steps", lambda s: s["role"]), lambda r: r != "")
    return grouped.select("conv_id", "message", F.coalesce(F.get(named, F.lit(0)), F.lit("")).alias("role"), text.alias("text"))


def format_chats(messages: DataFrame, learn_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row for each conversation: conv_id, formatted, n_turns, loss_mask.

    ``loss_mask`` has an entry for each turn: its code points in ``formatted``, and
    the start (within the turn) and length of the part to learn, which is the text
    of turns of ``learn_roles``; length 0 elsewhere.
    """
    turn = F.struct("message", escape(F.col("role")).alias("role"), escape(F.col("text")).alias("text"), F.col("role").isin(*learn_roles).alias("learn"))
    turns = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    head = len(OPEN) + len(CLOSE)
    rendered = F.array_join(F.transform("turns", lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(CLOSE), t["text"], F.lit(END))), "")

    def mask(t: Column) -> Column:
        start = F.length(t["role"]) + head
        size = F.length(t["text"])
        return F.struct((start + size + len(END)).alias("chars"), start.alias("start"), F.when(t["learn"], size).otherwise(0).alias("length"))

    return turns.select("conv_id", rendered.alias("formatted"), F.size("turns").cast("long").alias("n_turns"), F.transform("turns", mask).alias("loss_mask"))


def parse_chats(formatted: DataFrame) -> DataFrame:
    """Reads formatted text back: conv_id, turns (array of role, text), learned (array of the masked texts, unescaped), formatted.

    Turns come from the text alone, the learned parts from the text and the mask.
    """
    parts = F.split("formatted", END, -1)
    ends = F.slice(parts, 1, F.size(parts) - 1)
    cut = formatted.select("conv_id", "formatted", "loss_mask", ends.alias("parts"))
    body = lambda p: F.substring(p, len(OPEN) + 1, 1 << 30)
    role = lambda p: F.substring_index(body(p), CLOSE, 1)
    turn = lambda p: F.struct(unescape(role(p)).alias("role"), unescape(F.substring(body(p), F.length(role(p)) + len(CLOSE) + 1, F.lit(1 << 30))).alias("text"))
    learned = F.zip_with("parts", "loss_mask", lambda p, m: unescape(F.substring(p, m["start"] + 1, m["length"])))
    return cut.select("conv_id", "formatted", F.transform("parts", turn).alias("turns"), learned.alias("learned"))
