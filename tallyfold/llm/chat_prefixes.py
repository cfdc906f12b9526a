"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and
only that reply is trainable. What follows the last reply, or a conversation without one,
becomes a last example without anything to train on, so that no turn is lost.

A turn is START role \\n text END \\n. Control strings inside roles and texts get a backslash
after their first character, backslashes are doubled, and line breaks in roles are
escaped; unescape() takes all of it back. Offsets count code points.

Turns are ordered by turn, ties by role and text; null turns come first. Null texts and
roles count as empty. Rows without conv_id form one conversation. A conversation is put
together in one place, as its examples are. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]")


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(turns: DataFrame, target: str = "assistant") -> DataFrame:
    """conv_id, example (from 0), formatted, loss_start, loss_end (null where nothing is trainable)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.select("conv_id", F.struct("turn", role.alias("role"), text.alias("text")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    head = lambda t: F.concat(F.lit(START), F.replace(escape(t["role"]), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))
    shown = whole.select("conv_id", F.transform("ts", lambda t: F.struct((t["role"] == target).alias("own"), head(t).alias("head"), escape(t["text"]).alias("body"))).alias("ts"))
    at = F.filter(F.sequence(F.lit(0), F.size("ts") - 1), lambda i: F.element_at("ts", i + 1)["own"] | (i == F.size("ts") - 1))
    each = shown.select("conv_id", "ts", F.posexplode(at).alias("example", "i"))
    joined = lambda n: F.array_join(F.transform(F.slice("ts", F.lit(1), n), lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n"))), "")
    last = F.element_at("ts", F.col("i") + 1)
    each = each.select("conv_id", "example", joined(F.col("i")).alias("before"), last.alias("t"))
    start = F.when(F.col("t.own"), F.length("before") + F.length("t.head"))
    return each.select("conv_id", "example", F.concat("before", "t.head", "t.body", F.lit(END + "\n")).alias("formatted"), start.alias("loss_start"), (start + F.length("t.body")).alias("loss_end"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted example."""
    parts = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda p: p != "")
    at = r"(?s)^<\|im_start\|>((?:[^\\\n]|\\.)*)\n(.*)$"
    return F.transform(parts, lambda p: F.struct(unescape(F.regexp_extract(p, at, 1)).alias("role"), unescape(F.regexp_extract(p, at, 2)).alias("text")))


def read_back(examples: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from formatted examples alone."""
    loss = unescape(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    rows = examples.select("conv_id", "example", F.length("formatted").cast("long").alias("chars"), "formatted", F.coalesce(loss, F.lit("")).alias("loss"))
    got = rows.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("longest"),
        F.sum("chars").alias("formatted_chars"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
    )
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    got = got.withColumn("turns", read_turns(F.col("longest")))
    return got.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
