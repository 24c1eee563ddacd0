"""Preference pairs as one prompt and two masked completions.

The longest common turn prefix of the chosen and the rejected conversation is rendered once as
prompt; what follows in each is rendered as completion, with the character spans that training
should score: the content and end mark of assistant turns. Only DataFrame functions run here, on one
row for each pair; turns of a conversation are combined on the map side before the shuffle.

Turns are ordered by their number, then role and text, so ties and repeated rows have one order.
Defined cases: a null role is "user", a null text is empty; a null key is a conversation of its own;
equal conversations give a whole prompt and two empty completions; a pair with one side only has an
empty prompt and an empty other side; marks of the template inside a text are broken up by a space;
an empty table gives an empty table; further columns are ignored. A conversation makes one row, so
that it has to fit into one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
_TURNS = "array<struct<role:string,text:string>>"


def gather(turns: DataFrame, key: str, turn: str = "turn") -> DataFrame:
    """(key, turns): the ordered turns of each conversation."""
    each = F.struct(F.col(turn).alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = F.array_sort(F.collect_list(each))
    return turns.groupBy(F.col(key).alias(key)).agg(F.transform(ordered, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def pair(chosen: DataFrame, rejected: DataFrame, key: str) -> DataFrame:
    """Pair two tables of turns by ``key``: (key, chosen, rejected)."""
    a, b = gather(chosen, key).withColumnRenamed("turns", "chosen"), gather(rejected, key).select(F.col(key).alias("__k"), F.col("turns").alias("rejected"))
    none = F.array().cast(_TURNS)
    both = a.join(b, F.col(key).eqNullSafe(F.col("__k")), "full")
    return both.select(F.coalesce(F.col(key), F.col("__k")).alias(key), F.coalesce("chosen", none).alias("chosen"), F.coalesce("rejected", none).alias("rejected"))


def _parts(t: Column) -> tuple[Column, Column]:
    """The header and the body of a rendered turn."""
    safe = F.replace(t["text"], F.lit("<|im_"), F.lit("<| im_"))
    return F.concat(F.lit(START), t["role"], F.lit("\n")), F.concat(safe, F.lit(END))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(*_parts(t))), "")


def spans(turns: Column) -> Column:
    """array<struct<start,stop>>: what of the rendered turns is scored, in characters."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        head, body = _parts(t)
        start = acc["at"] + F.length(head)
        stop = start + F.length(body)
        more = F.when(t["role"] == "assistant", F.array_append(acc["spans"], F.struct(start.alias("start"), stop.alias("stop")))).otherwise(acc["spans"])
        return F.struct(stop.alias("at"), more.alias("spans"))

    return F.aggregate(turns, zero, step)["spans"]


def preferences(pairs: DataFrame) -> DataFrame:
    """``pairs`` (key columns, chosen, rejected) with n_prompt_turns, prompt, both completions and their spans."""
    same = F.zip_with("chosen", "rejected", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    df = pairs.withColumn("__same", same)
    df = df.withColumn("n_prompt_turns", (F.coalesce(F.nullif(F.array_position("__same", False), F.lit(0)), F.size("__same") + 1) - 1).cast("int"))
    rest = lambda c: F.slice(c, F.col("n_prompt_turns") + 1, F.size(c))
    df = df.withColumn("prompt", render(F.slice("chosen", F.lit(1), F.col("n_prompt_turns"))))
    df = df.withColumn("__c", rest("chosen")).withColumn("__r", rest("rejected"))
    keep = [c for c in pairs.columns if c not in ("chosen", "rejected")]
    return df.select(*keep, "n_prompt_turns", "prompt", render(F.col("__c")).alias("chosen"), render(F.col("__r")).alias("rejected"), spans(F.col("__c")).alias("chosen_spans"), spans(F.col("__r")).alias("rejected_spans"))


def with_reversed_answer(conversations: DataFrame, key: str) -> DataFrame:
    """Pair each conversation with itself, the words of its last assistant turn in reverse order."""
    df = gather(conversations, key).withColumnRenamed("turns", "chosen")
    n = F.size("chosen")
    back = F.array_position(F.transform(F.reverse("chosen"), lambda t: t["role"] == "assistant"), True)
    df = df.withColumn("__last", F.when(back > 0, n - back))
    worse = lambda t: F.struct(t["role"].alias("role"), F.array_join(F.reverse(F.split(t["text"], " ")), " ").alias("text"))
    return df.select(key, "chosen", F.transform("chosen", lambda t, i: F.when(i == F.col("__last"), worse(t)).otherwise(t)).alias("rejected"))


def op1(spark, sf_dir: str) -> DataFrame:
    out = preferences(with_reversed_answer(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id"))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["stop"])), ",").alias(c)
    return out.select("conv_id", "n_prompt_turns", "prompt", "chosen", "rejected", text("chosen_spans"), text("rejected_spans"))
