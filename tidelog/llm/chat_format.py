"""Chat formatting: typed content parts become one marked-up training text for each conversation.

A visitor goes over the parts of every turn. Text parts are escaped and copied; image, audio and document parts
become ordered placeholders, and each leaves an attachment record (its place, kind, reference and the number of
tokens that the placeholder expands to). Everything is DataFrame expressions: one shuffle by conversation.

Template of a turn: ``<|im_start|>ROLE<|im_sep|>TEXT<|im_end|>\\n``. Inside roles and texts ``<\\`` is written as
``<\\\\`` and ``<|`` as ``<\\|``, so that no control string can come from a text; :func:`unescape` reverses it.

Defined results for odd input: a null text or part list is empty text; a null role is an empty role; a part of an
unknown kind counts as text; turns that share a number are ordered by role and text; repeated rows are turns of
their own; a null conv_id is one conversation; an empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
ATTACHED = ("image", "audio", "document")
PARTS_TYPE = "array<struct<kind:string,text:string,ref:string,tokens:bigint>>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\"), F.lit("<\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("<\\\\"), F.lit("<\\"))


def text_part(text: Column) -> Column:
    """The part list of a turn that is plain text."""
    none = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), none.cast("string").alias("ref"), none.cast("bigint").alias("tokens"))).cast(PARTS_TYPE)


def visit_part(part: Column) -> Column:
    """The markup of one part: a placeholder for an attachment, else the escaped text."""
    marks = F.concat(F.lit("<|"), part["kind"], F.lit("|>"))
    return F.when(part["kind"].isin(*ATTACHED), marks).otherwise(escape(F.coalesce(part["text"], F.lit(""))))


def format_chats(turns: DataFrame, text_token_chars: int = 4) -> DataFrame:
    """One row per conversation from rows (conv_id, turn, role, parts).

    formatted: the text. loss_mask: for each piece of the text between control strings, whether it is under the
    loss (assistant texts only). attachments: in order, (position, kind, ref, tokens). expanded_tokens: what the
    attachments expand to, a null count as 0. n_turns: the turns.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce(F.col("parts"), F.array().cast(PARTS_TYPE)).alias("parts"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def markup(t: Column) -> Column:
        body = F.array_join(F.transform(t["parts"], visit_part), "")
        return F.concat(F.lit(START), escape(t["role"]), F.lit(SEP), body, F.lit(END + "\n"))

    attached = F.filter(F.flatten(F.transform("turns", lambda t: t["parts"])), lambda p: p["kind"].isin(*ATTACHED))
    mask = F.flatten(F.transform("turns", lambda t: F.array(F.lit(False), F.lit(False), t["role"] == "assistant")))
    return (
        grouped.select(
            "conv_id",
            F.size("turns").cast("bigint").alias("n_turns"),
            F.array_join(F.transform("turns", markup), "").alias("formatted"),
            F.concat(mask, F.array(F.lit(False))).alias("loss_mask"),
            attached.alias("found"),
        )
        .withColumn("attachments", F.transform("found", lambda p, i: F.struct(i.alias("position"), p["kind"].alias("kind"), p["ref"].alias("ref"), F.coalesce(p["tokens"], F.lit(0)).alias("tokens"))))
        .withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda n, a: n + a["tokens"]))
        .drop("found")
    )


def read_back(chats: DataFrame) -> DataFrame:
    """The digests of format_chats' output, taken from the formatted text and its mask alone."""
    control = r"<\|im_(?:start|sep|end)\|>"
    pieces = chats.withColumn("pieces", F.split("formatted", control, -1))
    turn_at = F.sequence(F.lit(0), F.col("n_turns").cast("int") - 1)

    def turn_text(i: Column) -> Column:
        role, text = (unescape(F.get("pieces", 3 * i + k)) for k in (1, 2))
        return F.concat(role, F.lit("\n"), text, F.lit("\n"))

    under = F.filter("pieces", lambda p, i: F.get("loss_mask", i))
    return (
        pieces.withColumn("loss", F.array_join(F.transform(under, unescape), ""))
        .select(
            "conv_id",
            "n_turns",
            F.sha2(F.array_join(F.transform(turn_at, turn_text), "").cast("binary"), 256).alias("turns_sha256"),
            F.length("loss").cast("bigint").alias("loss_chars"),
            F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
            F.length("formatted").cast("bigint").alias("formatted_chars"),
        )
    )
