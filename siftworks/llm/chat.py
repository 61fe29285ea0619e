"""Chat formatting with Spark expressions only.

Rows (conv_id, turn, role, text) become one text per conversation: turn structs are collected and sorted, adjacent
turns of one role are merged into a block, and blocks are concatenated:

    <s>role[INST]text</s>        and, for merged turns,        <s>role[INST]text[/INST]text</s>

The four control strings are escaped inside roles and texts by a backslash and a digit, backslashes too, so that the output
can be read back exactly. The loss mask is a list of spans (start and length in code points) of assistant texts.

Edge cases: null texts and roles count as empty; null turns come first; rows of one turn are ordered by role and text,
repeated rows stay as further turns; rows with a null conv_id make one conversation; further columns are not read.
A conversation is one row of the result and so must fit in one task; nothing larger is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, HEAD, NEXT, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
#: What stands for each string inside texts; the backslash is escaped first and restored last.
ESCAPES = [("\\", "\\0"), (OPEN, "\\1"), (HEAD, "\\2"), (NEXT, "\\3"), (CLOSE, "\\4")]
ASSISTANT = "assistant"


def escape(c: Column) -> Column:
    for plain, code in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted string, loss array<struct<start int, chars int>>), one row per conversation."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    n = F.size("turns")
    # where blocks of one role begin (from 1)
    begins = F.filter(
        F.sequence(F.lit(1), n),
        lambda i: (i == 1) | (F.element_at("turns", i)["role"] != F.try_element_at("turns", F.greatest(i - 1, F.lit(1)))["role"]),
    )
    starts = grouped.withColumn("begins", begins)
    blocks = F.transform(
        "begins",
        lambda s, j: F.struct(
            F.element_at("turns", s)["role"].alias("role"),
            F.slice("turns", s, F.coalesce(F.try_element_at("begins", j + 2), F.size("turns") + 1) - s)["text"].alias("texts"),
        ),
    )
    # a block as pieces, each with whether the loss counts it
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    no = F.lit(False)
    pieces = F.flatten(
        F.transform(
            "blocks",
            lambda b: F.concat(
                F.array(piece(F.concat(F.lit(OPEN), escape(b["role"]), F.lit(HEAD)), no)),
                F.flatten(
                    F.transform(
                        b["texts"],
                        lambda t, k: F.array(piece(F.when(k > 0, F.lit(NEXT)).otherwise(F.lit("")), no), piece(escape(t), b["role"] == ASSISTANT)),
                    )
                ),
                F.array(piece(F.lit(CLOSE), no)),
            ),
        )
    )
    cut = starts.select("conv_id", blocks.alias("blocks")).select("conv_id", pieces.alias("pieces"))
    empty = F.array().cast("array<struct<start:int,chars:int>>")
    spans = F.aggregate(
        "pieces",
        F.struct(F.lit(1).alias("at"), empty.alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.char_length(p["text"])).alias("at"),
            F.when(p["loss"], F.array_append(acc["spans"], F.struct(acc["at"].alias("start"), F.char_length(p["text"]).alias("chars"))))
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
    )["spans"]
    return cut.select("conv_id", F.array_join(F.col("pieces")["text"], "").alias("formatted"), spans.alias("loss"))


def _quoted(s: str) -> str:
    return f"\\Q{s}\\E"


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    blocks = F.filter(F.split(formatted, _quoted(CLOSE), -1), lambda b: b.startswith(OPEN))
    return F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.substr(b, F.instr(b, HEAD) + len(HEAD)), _quoted(NEXT), -1),
                lambda t: F.struct(unescape(F.substr(F.substring_index(b, HEAD, 1), F.lit(len(OPEN) + 1))).alias("role"), unescape(t).alias("text")),
            ),
        )
    )


def read_loss(formatted: Column, loss: Column) -> Column:
    """The text under the loss mask."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(formatted, s["start"], s["chars"]))), "")


def chat_digests(rows: DataFrame) -> DataFrame:
    """Format ``rows`` and read the output back: counts and digests per conversation."""
    out = format_conversations(rows)
    back = out.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss")).alias("loss_text"))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(flat, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
