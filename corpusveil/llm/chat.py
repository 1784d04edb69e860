"""Preference formatting: one prompt, two masked completions.

For each pair of a chosen and a rejected conversation the longest common prefix of turns (same
role and text) is rendered once as the prompt; what follows in each is its completion. The
mask of a completion lists the code-point ranges that are trained on: the texts of assistant
turns with their end mark, not headers or other roles. If the prefix swallows a whole
conversation, its completion is empty.

Template: `<|im_start|>role`, a line break, the text, `<|im_end|>`, a line break. Marks inside
texts and roles are broken by a blank after `<`, so no text can open or close a turn.

Defined cases: a null text is empty, a null role is user; turns are ordered by turn, role and
text with nulls first, so repeated or unnumbered turns have one order; a conversation id that
is missing on one side gives no pair; an empty table gives an empty result. Other columns are
not read.

Scale: a conversation is one row once gathered, since its rendering is one string; gathering
hashes by conversation id, and copies of a conversation under many ids stay apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import folded

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def turns_of(conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, turns: array of (role, text) in order."""
    clear = lambda c, default: F.replace(F.coalesce(F.col(c), F.lit(default)), F.lit("<|"), F.lit("< |"))
    turn = F.struct("turn", clear("role", "user").alias("role"), clear("text", "").alias("text"))
    gathered = conversations.groupBy(key).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return gathered.select(key, F.transform("turns", lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))).alias("turns"))


def header(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn.role, F.lit("\n"))


def rendered(turn: Column) -> Column:
    return F.concat(header(turn), turn.text, F.lit(CLOSE + "\n"))


def common_turns(a: Column, b: Column) -> Column:
    """How many leading turns are the same."""
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("same"))

    def step(s: Column, p: Column) -> Column:
        same = s.same & p.a.eqNullSafe(p.b)
        return F.struct((s.n + same.cast("int")).alias("n"), same.alias("same"))

    both = F.slice(F.arrays_zip(a.alias("a"), b.alias("b")), 1, F.least(F.size(a), F.size(b)))
    return F.aggregate(both, start, step, lambda s: s.n)


def mask(turns: Column) -> Column:
    """(start, end) ranges of the rendered turns that are trained on."""
    kind = "struct<start:int,end:int>"

    def step(at: Column, t: Column) -> tuple[Column, Column]:
        begin = at + F.length(header(t))
        end = begin + F.length(t.text) + len(CLOSE)
        own = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return end + 1, F.when(t.role == "assistant", own).otherwise(F.array().cast(f"array<{kind}>"))

    return folded(turns, F.lit(0), step, kind)


def preferences(chosen: DataFrame, rejected: DataFrame, key: str = "conv_id") -> DataFrame:
    """chosen, rejected: key and turns. One row per key in both: key, prompt, prompt_turns,
    chosen, chosen_mask, rejected, rejected_mask."""
    pairs = chosen.join(rejected.withColumnRenamed("turns", "_other"), key).withColumn("_n", common_turns(F.col("turns"), F.col("_other")))
    rest = lambda c: F.slice(c, F.col("_n") + 1, F.greatest(F.size(c), F.lit(1)))
    text = lambda c: F.array_join(F.transform(c, rendered), "")
    parts = pairs.select(key, F.slice("turns", F.lit(1), F.col("_n")).alias("_p"), rest(F.col("turns")).alias("_c"), rest(F.col("_other")).alias("_r"))
    return parts.select(
        key,
        text(F.col("_p")).alias("prompt"),
        F.size("_p").cast("long").alias("prompt_turns"),
        text(F.col("_c")).alias("chosen"),
        mask(F.col("_c")).alias("chosen_mask"),
        text(F.col("_r")).alias("rejected"),
        mask(F.col("_r")).alias("rejected_mask"),
    )


def off_topic_pairs(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs from a plain table: chosen is a conversation up to its last assistant turn;
    rejected is the same with that turn's text taken from the conversation with the next id
    (its own first assistant text where that has none). Both by conv_id; a conversation without
    an assistant turn gives no pair."""
    turns = turns_of(conversations)
    last = F.aggregate("turns", F.struct(F.lit(0).alias("i"), F.lit(0).alias("at")), lambda s, t: F.struct((s.i + 1).alias("i"), F.when(t.role == "assistant", s.i + 1).otherwise(s.at).alias("at")), lambda s: s.at)
    ended = turns.withColumn("_last", last).filter("_last > 0").withColumn("turns", F.slice("turns", F.lit(1), F.col("_last")))
    answer = F.get("turns", F.col("_last") - 1).text
    other = ended.select((F.col("conv_id") - 1).alias("conv_id"), answer.alias("_answer"))
    own = F.get(F.filter("turns", lambda t: t.role == "assistant"), F.lit(0)).text
    swapped = F.struct(F.lit("assistant").alias("role"), F.coalesce("_answer", own).alias("text"))
    rejected = ended.join(other, "conv_id", "left").select("conv_id", F.concat(F.slice("turns", F.lit(1), F.col("_last") - 1), F.array(swapped)).alias("turns"))
    return ended.select("conv_id", "turns"), rejected


def digest(pairs: DataFrame, key: str = "conv_id") -> DataFrame:
    spell = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s.start.cast("string"), s.end.cast("string"))), ",").alias(c)
    sha = lambda c: F.sha2(F.col(c), 256).alias(f"{c}_sha256")
    return pairs.select(key, "prompt_turns", sha("prompt"), sha("chosen"), spell("chosen_mask"), sha("rejected"), spell("rejected_mask"))
