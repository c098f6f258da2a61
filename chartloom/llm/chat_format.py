"""Chat formatting by prefix-target expansion, in DataFrame functions alone.

A turn is written `<|im_start|>role<|im_sep|>text<|im_end|>`. Every assistant turn becomes an example of
its own: all turns before it as context, then the reply, whose text alone is under the loss mask (a span
of code points). Turns after the last reply, or of a conversation without one, are kept as a row with
nothing under the mask, so that every turn can be read back.

Inside roles and texts a backslash is doubled and one is put behind the first character of each control
string, of this template or of others in common use; `unescaped` takes them out again.

Null roles and texts count as empty. Turns are ordered by turn, ties by role, then text; repeated rows are
repeated turns. Rows without conv_id are one conversation. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: First characters of control strings: <| ... , <s>, </s>, [INST], [/INST], <<SYS>>, <</SYS>>.
CONTROL = r"([<\[])(?=\||/?s>|/?INST\]|<SYS>>|</SYS>>)"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def chat_examples(turns: DataFrame) -> DataFrame:
    """(conv_id, example, formatted, loss_start, loss_length); loss_start counts code points from 0, and
    loss_length is 0 in a row without a reply.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    one = F.struct("turn", text("role").alias("role"), text("text").alias("text"))
    conv = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("turns"))
    head = lambda t: F.concat(F.lit(START), escaped(t["role"]), F.lit(SEP))
    conv = conv.withColumn("written", F.transform("turns", lambda t: F.concat(head(t), escaped(t["text"]), F.lit(END))))
    replies = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: F.get("turns", i)["role"] == "assistant")
    last = F.size("turns") - 1
    rows = conv.withColumn("replies", replies)
    at = F.when(F.get("turns", last)["role"] == "assistant", F.col("replies")).otherwise(F.array_append("replies", last))
    rows = rows.select("conv_id", "turns", "written", F.posexplode(at).alias("example", "i"))
    t = F.get("turns", F.col("i"))
    before = F.array_join(F.slice("written", 1, F.col("i")), "")
    trained = t["role"] == "assistant"
    return rows.select(
        "conv_id",
        "example",
        F.concat(before, F.get("written", F.col("i"))).alias("formatted"),
        F.when(trained, F.length(before) + F.length(head(t))).otherwise(0).alias("loss_start"),
        F.when(trained, F.length(escaped(t["text"]))).otherwise(0).alias("loss_length"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text, formatted_chars): turns as (role, text), from the formatted rows alone."""
    literal = lambda s: r"\Q" + s + r"\E"
    parts = F.slice(F.split("whole", literal(START)), 2, F.greatest(F.size(F.split("whole", literal(START))) - 1, F.lit(0)))
    conv = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"),
        F.array_sort(F.collect_list(F.struct("example", F.expr("substring(formatted, loss_start + 1, loss_length)").alias("loss")))).alias("masked"),
        F.sum(F.length("formatted")).alias("formatted_chars"),
    )
    turn = lambda p: F.struct(unescaped(F.split_part(p, F.lit(SEP), F.lit(1))).alias("role"), unescaped(F.split_part(F.split_part(p, F.lit(SEP), F.lit(2)), F.lit(END), F.lit(1))).alias("text"))
    return conv.select("conv_id", F.transform(parts, turn).alias("turns"), F.array_join(F.transform("masked", lambda m: unescaped(m["loss"])), "").alias("loss_text"), "formatted_chars")
