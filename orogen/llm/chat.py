"""Chat formatting with a grammar that reads back what was written.

    conversation := turn*
    turn         := "<|turn:" level "|>" role "<|text|>" text "<|end|>"
    level        := "0" | "1"

A turn is first written raw, at level 0, and read by the parser; if role and text don't come back as they were, its
content is escaped, level 1: a backslash is doubled and "<|" becomes "<\\|".  Between "<" and "|" an escaped text has
an even number of backslashes from the source or the one that was put in, so that unescaping is unambiguous, and no
escaped text holds a mark.  The finished conversation is parsed once more and compared with its turns (``round_trip``).

All of it is built-in expressions.  The rows of a conversation are brought together once, by its id, after each
turn has been rendered where it lies: the output is one string per conversation, and its digest is sequential.

Defined cases: null role or text is the empty string; turns are in order of turn (null first), then role and text;
repeated rows are turns of their own; a null conv_id is one conversation; an empty table gives no conversations; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, TEXT, END = "<|turn:", "<|text|>", "<|end|>"
HEAD = len(OPEN) + 1 + len("|>")


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _render(level: int, role: Column, text: Column) -> Column:
    if level:
        role, text = escape(role), escape(text)
    return F.concat(F.lit(f"{OPEN}{level}|>"), role, F.lit(TEXT), text, F.lit(END))


def parse(formatted: Column) -> Column:
    """array<struct<level, role, text>> of a formatted conversation, text still escaped at level 1."""
    turns = F.slice(F.split(formatted, r"<\|end\|>"), 1, F.size(F.split(formatted, r"<\|end\|>")) - 1)

    def turn(t: Column) -> Column:
        role = F.substring_index(t, TEXT, 1)
        return F.struct(F.substring(role, len(OPEN) + 1, 1).alias("level"), F.substring(role, HEAD + 1, 1 << 30).alias("role"), F.substr(t, F.length(role) + len(TEXT) + 1).alias("text"))

    return F.transform(turns, turn)


def plain(turns: Column) -> Column:
    """Parsed turns as array<struct<role, text>> without escapes."""
    undo = lambda t, c: F.when(t["level"] == "1", unescape(t[c])).otherwise(t[c]).alias(c)
    return F.transform(turns, lambda t: F.struct(undo(t, "role"), undo(t, "text")))


def format_conversations(rows: DataFrame, mask_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, turns (read back from it), loss_spans (of each turn under the loss
    mask the first character from 0, the length, and whether it is escaped), round_trip."""
    source = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    same = plain(parse(_render(0, F.col("role"), F.col("text")))) == F.array(F.struct("role", "text"))
    rendered = source.select("conv_id", "turn", "role", "text", F.when(same, _render(0, F.col("role"), F.col("text"))).otherwise(_render(1, F.col("role"), F.col("text"))).alias("out"))
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    rendered = rendered.withColumn("at", F.coalesce(F.sum(F.length("out")).over(before), F.lit(0)))
    one = rendered.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "at", "out"))).alias("__t"))
    masked = F.filter("__t", lambda t: t["role"] == mask_role)
    head = lambda t: F.length(F.substring_index(t["out"], TEXT, 1)) + len(TEXT)
    span = lambda t: F.struct((t["at"] + head(t)).alias("start"), (F.length(t["out"]) - head(t) - len(END)).alias("length"), t["out"].startswith(f"{OPEN}1").alias("escaped"))
    one = one.select(
        "conv_id", F.array_join(F.transform("__t", lambda t: t["out"]), "").alias("formatted"), F.transform(masked, span).alias("loss_spans"),
        F.transform("__t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("__source"),
    )
    one = one.withColumn("turns", plain(parse(F.col("formatted"))))
    return one.select("conv_id", "formatted", "turns", "loss_spans", (F.col("turns") == F.col("__source")).alias("round_trip"))


def loss_text(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask, read from the formatted conversation."""

    def one(s: Column) -> Column:
        raw = F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))
        return F.when(s["escaped"], unescape(raw)).otherwise(raw)

    return F.array_join(F.transform(spans, one), "")
