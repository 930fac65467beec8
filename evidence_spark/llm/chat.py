"""Chat formatting with Spark expressions only: no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of the template. Every block starts with <s>; NEXT parts the turns that one block merges.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "[OUT]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[END]", "[NEXT]"]
OPENS = {"user": ("[INST] ", " [/INST]"), "assistant": ("[OUT] ", " </s>"), "system": ("<<SYS>> ", " <</SYS>>")}


def escape(c: Column) -> Column:
    """Doubles backslashes and puts one behind the first sign of each control string, so that none stays in a text."""
    rest = "|".join(x[1:].replace("[", r"\[").replace("]", r"\]") for x in CONTROL)
    return F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), rf"(<|\[)(?={rest})", r"$1\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"\\(\\?)", "$1")


def _part(block: Column) -> tuple[Column, Column]:
    """Opening and closing of a block (role, turns)."""
    other = F.concat(F.lit("[ROLE]"), escape(block["role"]), F.lit("[/ROLE] "))
    first, last = other, F.lit(" [END]")
    for role, (a, b) in OPENS.items():
        first = F.when(block["role"] == role, F.lit(a)).otherwise(first)
        last = F.when(block["role"] == role, F.lit(b)).otherwise(last)
    return F.concat(F.lit("<s>"), first), last


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted), one row for each conversation.

    The turn structs of a conversation are collected and sorted by turn (ties: by role, then text, so repeated rows stay
    next to each other). Adjacent turns of one role form a block, found by comparing each with its predecessor in the
    sorted array. Null texts and roles count as empty; rows with a null conv_id form a conversation of their own; a null
    turn sorts first. Other columns are ignored, an empty table gives an empty result. A conversation is one value of the
    result, so its turns must fit in one row: 2 GB of text, and in the memory of the task that joins them.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    one = F.struct(F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("t"))
    chats = chats.withColumn("starts", F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: (i == 0) | (F.get("t", i)["role"] != F.get("t", i - 1)["role"])))
    blocks = F.transform(
        "starts",
        lambda s, k: F.struct(F.get("t", s)["role"].alias("role"), F.slice("t", s + 1, F.coalesce(F.get("starts", k + 1), F.size("t")) - s).alias("turns")),
    )
    chats = chats.select("conv_id", blocks.alias("blocks"))

    def written(block: Column) -> Column:
        first, last = _part(block)
        return F.concat(first, F.array_join(F.transform(block["turns"], lambda t: escape(t["text"])), "[NEXT]"), last)

    return chats.select("conv_id", F.array_join(F.transform("blocks", written), "").alias("formatted"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns): the turns (role, text) in order, read back from the formatted text alone."""

    def parsed(block: Column) -> Column:
        role, body = unescape(F.regexp_extract(block, r"(?s)^\[ROLE\](.*?)\[/ROLE\] ", 1)), F.regexp_extract(block, r"(?s)^\[ROLE\].*?\[/ROLE\] (.*) \[END\]$", 1)
        for name, (a, b) in OPENS.items():
            own = F.startswith(block, F.lit(a))
            role = F.when(own, F.lit(name)).otherwise(role)
            body = F.when(own, F.substring(block, F.lit(len(a) + 1), F.char_length(block) - len(a) - len(b))).otherwise(body)
        return F.transform(F.split(body, r"\[NEXT\]", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    blocks = F.filter(F.split("formatted", "<s>", -1), lambda b: b != "")
    return formatted.select("conv_id", "formatted", F.flatten(F.transform(blocks, parsed)).alias("turns"))


def chat_digests(formatted: DataFrame) -> DataFrame:
    """What op1 returns of each formatted chat. The loss mask covers the texts of assistant blocks, without any mark."""
    t = read_chats(formatted)
    line = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda x: x["role"] == "assistant"), lambda x: x["text"]), "")
    return t.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(line, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
