"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example: all turns before it as context, and its text alone under the loss mask. Turns after the last
assistant turn (or a conversation without one) become one more example without a target, so that the output holds every turn.

Template: <|turn|>ROLE<|says|>TEXT<|end|> for each turn. A control string inside a role or text gets a backslash after its bracket
(one more, if it has some already), so no text holds one, and unescaping takes one away again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
#: Control strings of this and other common templates: bracket, backslashes, rest.
CONTROL = r"([<\[])(\\*)(\||/?s>|</?SYS>>|/?INST\])"
ESCAPED = r"([<\[])\\(\\*)(\||/?s>|</?SYS>>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def chat_examples(turns: DataFrame) -> DataFrame:
    """conv_id, example (from 0), formatted, loss_start and loss_end (code points of `formatted`; equal if nothing is trainable).

    Takes rows of conv_id, turn, role, text. Turns go by turn number, those of equal number by role and text; null numbers last. Null
    roles and texts are empty; a null conv_id is a conversation like any other; repeated rows are repeated turns. Other columns are
    ignored. An empty table gives no examples. One shuffle, on conv_id; a conversation is a row and must fit in memory.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(TURN), escape(role), F.lit(SAYS))
    row = F.struct(F.col("turn").isNull().alias("last"), F.col("turn"), role.alias("role"), text.alias("text"), head.alias("head"), escape(text).alias("body"))
    grouped = turns.select("conv_id", row.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    rendered = F.transform("ts", lambda t: F.concat(t["head"], t["body"], F.lit(END)))
    targets = F.filter(F.sequence(F.lit(1), F.size("ts")), lambda i: F.element_at("ts", i)["role"] == "assistant")
    with_tail = F.when(F.element_at("ts", -1)["role"] == "assistant", F.col("targets")).otherwise(F.concat("targets", F.array(F.size("ts"))))
    upto = F.col("upto")
    last = F.element_at("ts", upto)
    has_target = F.array_contains("targets", upto)
    before = F.array_join(F.slice("rendered", 1, upto - 1), "")
    begin = F.length("before") + F.length(last["head"])
    return (
        grouped.withColumn("rendered", rendered)
        .withColumn("targets", targets)
        .select("conv_id", "ts", "rendered", "targets", F.posexplode(with_tail).alias("example", "upto"))
        .withColumn("before", before)
        .select(
            "conv_id",
            "example",
            F.concat("before", F.element_at("rendered", upto)).alias("formatted"),
            F.when(has_target, begin).otherwise(F.lit(0)).cast("long").alias("loss_start"),
            F.when(has_target, begin + F.length(last["body"])).otherwise(F.lit(0)).cast("long").alias("loss_end"),
        )
    )


def read_back(examples: DataFrame) -> DataFrame:
    """From the examples alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples."""
    loss = unescape(F.substring("formatted", F.col("loss_start").cast("int") + 1, (F.col("loss_end") - F.col("loss_start")).cast("int")))
    per = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", loss.alias("loss")))), lambda x: x["loss"]), "").alias("loss"),
        F.sum(F.length("formatted")).alias("formatted_chars"),
        F.count(F.lit(1)).alias("n_examples"),
    )
    pieces = F.filter(F.split("whole", r"<\|end\|>"), lambda x: x != "")
    said = lambda x: F.split(F.substring(x, len(TURN) + 1, 2**31 - 1), r"<\|says\|>")
    turns = F.transform(pieces, lambda x: F.concat(unescape(said(x)[0]), F.lit("\n"), unescape(said(x)[1]), F.lit("\n")))
    return per.withColumn("turns", turns).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join("turns", "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
        "n_examples",
    )
