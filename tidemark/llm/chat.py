"""Chat formatting by relational means: sorted turn structs, merged neighbours of one role, concatenated pieces.

A conversation becomes ``<|turn|>role<|text|>text<|part|>text<|end|>...``: adjacent turns of one role share a block, their
texts divided by ``<|part|>``. Control strings inside roles and texts, of this template and of other common ones, get a
backslash after their first character and every backslash is doubled, so `unescape` gives back the original.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, PART, END = "<|turn|>", "<|text|>", "<|part|>", "<|end|>"
CONTROL = r"<(?=\||s>|/s>|<SYS>>|</SYS>>)|\[(?=INST\]|/INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$0\\")


def unescape(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, r"([<\[])\\(?!\\)", "$1"), F.lit("\\\\"), F.lit("\\"))


def _block(block: Column, learn: str) -> Column:
    """Pieces of one merged block: header, texts with dividers, end."""
    def piece(text, loss):
        return F.struct(text.alias("piece"), loss.alias("loss"))
    no, under = F.lit(False), block["role"] == learn
    texts = F.flatten(F.transform(block["texts"], lambda t, k: F.when(k == 0, F.array(piece(escape(t), under))).otherwise(
        F.array(piece(F.lit(PART), no), piece(escape(t), under)))))
    head = F.array(piece(F.concat(F.lit(TURN), escape(block["role"]), F.lit(TEXT)), no))
    return F.concat(head, texts, F.array(piece(F.lit(END), no)))


def format_chats(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """``(conv_id, formatted, segments)`` for each conversation of ``turns(conv_id, turn, role, text)``.

    ``segments`` cut ``formatted`` into pieces with a loss flag, set exactly on the texts of the role ``learn``. Missing roles
    and texts are empty strings; turns that tie are ordered by role and text and repeated rows stay; a missing turn number
    comes first; rows without a conversation form one of their own; no rows give no rows; other columns are ignored.
    """
    kept = turns.select("conv_id", F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    turns = F.col("turns")
    return (
        kept.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
        .withColumn("starts", F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (
            F.get(turns, i)["role"] != F.get(turns, i - 1)["role"])))
        .withColumn("blocks", F.transform("starts", lambda s, j: F.struct(
            F.get(turns, s)["role"].alias("role"),
            F.transform(F.slice(turns, s + 1, F.coalesce(F.get("starts", j + 1), F.size(turns)) - s),
                        lambda t: t["text"]).alias("texts"))))
        .select("conv_id", F.flatten(F.transform("blocks", lambda b: _block(b, learn))).alias("segments"))
        .select("conv_id", F.array_join(F.col("segments.piece"), "").alias("formatted"), "segments")
    )


def read_back(chats: DataFrame) -> DataFrame:
    """``(conv_id, turns, loss_text, formatted_chars)`` parsed from the output of `format_chats`; turns are (role, text), unescaped."""
    def parts(block):
        halves = F.split(F.regexp_replace(block, r"<\|end\|>$", ""), r"<\|text\|>", -1)
        return F.transform(F.split(F.get(halves, F.lit(1)), r"<\|part\|>", -1), lambda t: F.struct(
            unescape(F.get(halves, F.lit(0))).alias("role"), unescape(t).alias("text")))
    blocks = F.split("formatted", r"<\|turn\|>", -1)
    under = F.filter("segments", lambda s: s["loss"])
    return chats.select(
        "conv_id", F.flatten(F.transform(F.slice(blocks, 2, F.greatest(F.size(blocks) - 1, F.lit(0))), parts)).alias("turns"),
        F.array_join(F.transform(under, lambda s: unescape(s["piece"])), "").alias("loss_text"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))


def digests(chats: DataFrame) -> DataFrame:
    """What can be read back of each formatted conversation, as counts and digests."""
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read_back(chats).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
