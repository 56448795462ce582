"""Chat formatting: every assistant turn becomes an example of its own, with all preceding turns as its context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's control strings (fixed values of the format).
START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """Doubles backslashes and breaks ``<|`` with a single one, so that no control string can stand in a text."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """The inverse: a single backslash stands only between ``<`` and ``|``."""
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n>"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n>"), F.lit("\n")))


def chat_examples(turns: DataFrame, target_role: str = "assistant") -> DataFrame:
    """``(conv_id, example, n_turns, formatted, loss_start, loss_length)`` from rows ``(conv_id, turn, role, text)``.

    For every turn of ``target_role`` one example: all turns up to it in template form, of which only that reply's text, the
    ``loss_length`` characters after the first ``loss_start``, is trainable. Turns after the last reply make one more example without a
    trainable part, so that no turn is lost. Null roles and texts count as empty; turns that share a number are ordered by role and
    text, null numbers come first; repeated rows are turns of their own; a null conv_id is a conversation. Other columns are ignored.
    A conversation's prefixes are built from one array, so memory is bounded by the longest conversation.
    """
    clean = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = clean.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    head = F.lit(START)
    marked = F.transform("turns", lambda t: F.struct(
        (t["role"] == target_role).alias("target"),
        F.length(escape(t["text"])).alias("chars"),
        F.concat(head, escape_role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(END + "\n")).alias("block"),
    ))
    grouped = grouped.select("conv_id", marked.alias("m"))
    ends = F.filter(F.sequence(F.lit(1), F.size("m")), lambda i: F.element_at("m", i)["target"] | (i == F.size("m")))
    rows = grouped.select("conv_id", "m", F.posexplode(ends).alias("example", "n_turns"))
    last = F.element_at("m", F.col("n_turns"))
    rows = rows.select("conv_id", "example", "n_turns", F.array_join(F.transform(F.slice("m", 1, F.col("n_turns")), lambda b: b["block"]), "").alias("formatted"), last.alias("last"))
    size = F.when(F.col("last")["target"], F.col("last")["chars"]).otherwise(0)
    start = F.length("formatted") - len(END) - 1 - F.col("last")["chars"]
    return rows.select("conv_id", "example", "n_turns", "formatted", start.cast("long").alias("loss_start"), size.cast("long").alias("loss_length"))


def read_turns(formatted: Column) -> Column:
    """The ``(role, text)`` structs that a formatted string holds."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda p: p != "")

    def one(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        text = F.substr(p, F.length(role) + 2, F.length(p) - F.length(role) - 2 - len(END))
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    return F.transform(parts, one)


def loss_text(formatted: Column, start: Column, length: Column) -> Column:
    return unescape(F.substr(formatted, (start + 1).cast("int"), length.cast("int")))


def conversation_digests(examples: DataFrame) -> DataFrame:
    """What the examples of each conversation say, read back from them: turns, trainable text and sizes."""
    own = examples.select(
        "conv_id", "example", "n_turns", "formatted",
        loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_length")).alias("loss"),
    )
    whole = own.groupBy("conv_id").agg(
        F.max_by("formatted", "n_turns").alias("whole"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda s: s["loss"]), "").alias("loss"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
    )
    read = whole.withColumn("read", read_turns(F.col("whole")))
    said = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"), "formatted_chars",
    )
