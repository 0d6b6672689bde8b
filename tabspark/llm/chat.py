"""Chat formatting by prefix-target expansion (operator 4), with DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it as context, then that reply,
the only text under the loss mask (``loss_start``, ``loss_chars``, in code points).  A conversation that does not end with
an assistant turn has one more example of all its turns with nothing to train on, so that the
output holds every turn.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``.  In roles and texts the control strings of this and
other common templates lose their first character to a percent code, and ``%`` itself is coded
first, so ``unescape(escape(t)) = t`` for every t and no text can end a turn.

Turns are gathered by conversation (an example of n turns is a row of that size in any case);
examples are made from them one by one, so a long conversation costs its own output, not more.

Defined cases: a NULL text or role is empty; turns of equal number are ordered by role, then text; NULL ids are one conversation, NULL turn
numbers come first; a conversation without assistant turns has the one example without loss; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabspark.llm.files import prepare, saved

# Control strings and the codes of what replaces their first character.
START, END = "<|im_start|>", "<|im_end|>"
CONTROL = ("<|", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")
CODES = {"<": "%3C", "[": "%5B", "%": "%25", "\n": "%0A"}


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("%"), F.lit(CODES["%"]))
    for mark in CONTROL:
        text = F.replace(text, F.lit(mark), F.lit(CODES[mark[0]] + mark[1:]))
    return text


def unescape(text: Column) -> Column:
    for char in ("<", "[", "\n", "%"):
        text = F.replace(text, F.lit(CODES[char]), F.lit(char))
    return text


def format_chats(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, example, last, formatted, loss_start, loss_chars), one row an example; ``last`` marks the one with all turns."""
    who = F.coalesce(F.col(role), F.lit(""))
    says = escape(F.coalesce(F.col(text), F.lit("")))
    shown = F.replace(escape(who), F.lit("\n"), F.lit(CODES["\n"]))
    head = F.concat(F.lit(START), shown, F.lit("\n"))
    turns = rows.select(
        F.col(conv).alias("conv"),
        F.struct(F.col(turn).alias("at"), who.alias("who"), F.coalesce(F.col(text), F.lit("")).alias("raw"), head.alias("head"), says.alias("says")).alias("t"),
    )
    whole = turns.groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    whole = whole.select(
        "conv", F.size("ts").alias("n"), F.col("ts.head").alias("heads"), F.col("ts.says").alias("says"), F.col("ts.who").alias("who"),
        F.transform("ts", lambda t: F.concat(t["head"], t["says"], F.lit(END + "\n"))).alias("shown"),
    )
    ends = F.filter(F.sequence(F.lit(1), F.col("n")), lambda k: (F.element_at("who", k) == "assistant") | (k == F.col("n")))
    each = whole.select("*", F.explode(ends).alias("k"))
    trained = F.element_at("who", F.col("k")) == "assistant"
    context = F.concat(F.array_join(F.slice("shown", 1, F.col("k") - 1), ""), F.element_at("heads", F.col("k")))
    each = each.select("conv", F.col("k").alias("example"), (F.col("k") == F.col("n")).alias("last"), context.alias("context"), F.element_at("says", F.col("k")).alias("reply"), trained.alias("trained"))
    return each.select(
        F.col("conv").alias(conv), "example", "last", F.concat("context", "reply", F.lit(END + "\n")).alias("formatted"),
        F.when(F.col("trained"), F.char_length("context")).alias("loss_start"), F.when(F.col("trained"), F.char_length("reply")).otherwise(0).alias("loss_chars"),
    )


def write(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The examples as a Parquet table (Zstandard: contexts repeat), read back."""
    prepare(rows.sparkSession)
    return saved(format_chats(rows, conv, turn, role, text), "chat-examples", compression="zstd")


def parse(formatted: Column) -> Column:
    """The turns of a formatted example as an array of (role, text)."""
    parts = F.split(formatted, r"<\|im_end\|>\n")
    bodies = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.substr(p, F.lit(len(START) + 1)))
    cut = lambda p: F.instr(p, "\n")
    return F.transform(bodies, lambda p: F.struct(unescape(F.substr(p, F.lit(1), cut(p) - 1)).alias("role"), unescape(F.substr(p, cut(p) + 1)).alias("text")))


def digests(examples: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Per conversation, from the written examples: what its turns and its loss texts are."""
    turns = F.when(F.col("last"), parse(F.col("formatted")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.when(F.col("loss_start").isNotNull(), unescape(F.substr("formatted", F.col("loss_start") + 1, F.col("loss_chars"))))
    each = examples.select(F.col(conv).alias("conv"), "example", F.char_length("formatted").cast("long").alias("chars"), loss.alias("loss"), turns.alias("turns"))
    each = each.select("conv", "example", "chars", "loss", F.size("turns").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha"))
    whole = each.groupBy("conv").agg(
        F.max("n_turns").cast("long").alias("n_turns"), F.max("turns_sha").alias("turns_sha256"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", F.coalesce("loss", F.lit("")).alias("loss")))), lambda x: x["loss"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    return whole.select(
        F.col("conv").alias(conv), "n_turns", "turns_sha256", F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )
