r"""Chat formatting by a grammar round trip, with DataFrame functions only.

A conversation is rendered by the grammar

    conversation := turn*        turn := "<s>[INST]" role "[/INST]" text "</s>"

where neither role nor text may hold a control string. The parser is deterministic: it cuts at "</s>", takes what stands up
to the first "[/INST]" for the role, refuses control strings elsewhere, and takes a backslash away before any character.
Each turn is first rendered as it is and parsed again. If the parser does not give back the turn, its role and text are
escaped: each backslash is doubled, and a backslash goes behind the first character of each control string. As an escaped
text holds no control string and each of its backslashes stands before its own character, the second parse is always right.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, HEAD, CLOSE = "<s>[INST]", "[/INST]", "</s>"
#: The strings that mark turns.
CONTROL = ("</s>", "<s>", "[/INST]", "[INST]")


def escaped(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.regexp_replace(text, r"<(/?s>)", r"<\\$1")
    return F.regexp_replace(text, r"\[(/?INST\])", r"[\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(HEAD), text, F.lit(CLOSE))


def _plain(text: Column) -> Column:
    """Whether no control string is in the text."""
    found = [F.contains(text, F.lit(x)) for x in CONTROL]
    return ~(found[0] | found[1] | found[2] | found[3])


def parsed(formatted: Column) -> Column:
    """The turns as an array of (role, text); null if the text doesn't follow the grammar."""
    pieces = F.split(formatted, F.lit(r"</s>"))
    body = lambda piece: F.substring(piece, F.lit(len(OPEN) + 1), F.length(piece))
    role = lambda piece: F.substring_index(body(piece), HEAD, 1)
    text = lambda piece: F.substring(piece, F.length(role(piece)) + len(OPEN) + len(HEAD) + 1, F.length(piece))
    fits = lambda piece: F.startswith(piece, F.lit(OPEN)) & F.contains(body(piece), F.lit(HEAD)) & _plain(role(piece)) & _plain(text(piece))
    turns = F.transform(
        F.slice(pieces, 1, F.size(pieces) - 1),
        lambda piece: F.when(fits(piece), F.struct(unescaped(role(piece)).alias("role"), unescaped(text(piece)).alias("text"))),
    )
    return F.when((F.element_at(pieces, -1) == "") & ~F.exists(turns, lambda t: t.isNull()), turns)


def formatted(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (start and length in code points of each assistant text).

    conversations: conv_id, turn, role, text; other columns are ignored. Turns stand in the order of turn (null last), ties
    by role and text; repeated rows are turns of their own; a null role or text is empty; rows of null conv_id are one
    conversation; an empty table gives no rows. A turn is rendered, parsed, escaped if it isn't read back as it was, and parsed again, in its own row;
    one that even then isn't read back raises; only the finished
    strings of a conversation, which are one output row anyhow, meet in one place.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    source = F.array(F.struct("role", "text"))
    rows = rows.withColumn("same", F.coalesce(parsed(rendered(F.col("role"), F.col("text"))) == source, F.lit(False)))
    for name in ("role", "text"):
        rows = rows.withColumn(f"out_{name}", F.when(F.col("same"), F.col(name)).otherwise(escaped(F.col(name))))
    rows = rows.withColumn("piece", rendered(F.col("out_role"), F.col("out_text"))).withColumn("loss", F.col("role") == "assistant")
    again = F.col("same") | F.coalesce(parsed(F.col("piece")) == source, F.lit(False))
    rows = rows.withColumn("piece", F.when(again, F.col("piece")).otherwise(F.raise_error(F.concat(F.lit("a turn isn't read back as it was: "), F.col("piece")))))
    rows = rows.select("conv_id", "turn", "role", "text", "piece", "loss", F.length("out_role").alias("role_length"), F.length("out_text").alias("text_length"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    before = F.coalesce(F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("place", F.row_number().over(order)).withColumn("start", before + F.col("role_length") + len(OPEN) + len(HEAD))
    turns = F.array_sort(F.collect_list(F.struct("place", "piece", "loss", F.col("start").cast("int").alias("start"), F.col("text_length").alias("length"))))
    grouped = placed.groupBy("conv_id").agg(turns.alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))
    return grouped.select("conv_id", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted_rows: DataFrame) -> DataFrame:
    """The formatted rows with turns, parsed from the text alone, and loss_text, the unescaped text under the loss mask."""
    loss = F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return formatted_rows.withColumn("turns", parsed(F.col("formatted"))).withColumn("loss_text", F.array_join(loss, ""))
