"""Preference formatting of chosen and rejected conversations.

The longest common turn prefix of a pair is rendered once as the prompt; what
follows on each side is a completion, with a mask: the spans (code points, end
exclusive) of assistant text that count for the loss.  DataFrame expressions
only; each pair is one row, so nothing is gathered beyond a conversation.

Defined cases: null roles and texts are empty; turns with a null number come
first, ties go by role, then text; repeated rows are turns of their own; a row
without conv_id belongs to no conversation, and so to no pair; very long
conversations and texts are rendered whole; a side that ends with the prefix has
an empty completion and mask; sides that differ at once have an empty prompt;
other columns are ignored, whatever their names; empty tables give no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"


def turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: pair_id and its turns in order, array<struct<role, text>>."""
    one = F.struct(F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
                   F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = conversations.select(F.col(id_col).cast("long").alias("pair_id"), one.alias("one")).where("pair_id IS NOT NULL")
    return (rows.groupBy("pair_id").agg(F.sort_array(F.collect_list("one")).alias("every"))
            .select("pair_id", F.transform("every", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns")))


def stale_pairs(conversations: DataFrame, **columns) -> DataFrame:
    """Pairs from single conversations with two assistant turns at least.

    Chosen is the conversation up to its last assistant turn; rejected ends with
    the assistant's previous answer instead, which doesn't answer the last turn.
    One pair a conversation: pairs of all its answers would repeat its turns in
    every prompt, so the result would grow with the square of its length.
    """
    at = F.expr("array_max(filter(transform(turns, (t, i) -> if(t.role = 'assistant', i, -1)), i -> i >= 0))")
    before = F.expr("array_max(filter(transform(turns, (t, i) -> if(t.role = 'assistant' AND i < at, i, -1)), i -> i >= 0))")
    return (turns(conversations, **columns).withColumn("at", at).withColumn("stale", before).where("stale IS NOT NULL")
            .select("pair_id", F.expr("slice(turns, 1, at + 1)").alias("chosen"),
                    F.expr("concat(slice(turns, 1, at), slice(turns, stale + 1, 1))").alias("rejected")))


def _rendered(turns: str) -> str:
    return f"array_join(transform({turns}, t -> concat('{OPEN}', t.role, '{MIDDLE}', t.text, '{CLOSE}')), '')".replace("\n", "\\n")


def _mask(turns: str) -> str:
    """Spans "start:end" of assistant text in the rendered turns."""
    head, tail = len(OPEN) + len(MIDDLE), len(CLOSE)
    step = (f"(acc, t) -> named_struct('at', acc.at + {head + tail} + length(t.role) + length(t.text), 'spans', "
            f"if(t.role = 'assistant' AND length(t.text) > 0, concat(acc.spans, array(concat(acc.at + {head} + length(t.role), ':', "
            f"acc.at + {head} + length(t.role) + length(t.text)))), acc.spans))")
    return f"array_join(aggregate({turns}, named_struct('at', 0, 'spans', cast(array() AS array<string>)), {step}, acc -> acc.spans), ',')"


def format_pairs(pairs: DataFrame) -> DataFrame:
    """pair_id, prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask from array<struct<role, text>> sides."""
    common = F.expr("aggregate(sequence(0, greatest(least(size(chosen), size(rejected)), 1) - 1), 0, (n, i) -> "
                    "if(n = i AND i < least(size(chosen), size(rejected)) AND get(chosen, i) <=> get(rejected, i), n + 1, n))")
    side = lambda c: f"slice({c}, prompt_turns + 1, greatest(size({c}) - prompt_turns, 0))"
    return pairs.withColumn("prompt_turns", common).select(
        "pair_id", F.col("prompt_turns").cast("long").alias("prompt_turns"), F.expr(_rendered("slice(chosen, 1, prompt_turns)")).alias("prompt"),
        F.expr(_rendered(side("chosen"))).alias("chosen"), F.expr(_mask(side("chosen"))).alias("chosen_mask"),
        F.expr(_rendered(side("rejected"))).alias("rejected"), F.expr(_mask(side("rejected"))).alias("rejected_mask"))
