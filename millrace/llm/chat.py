"""Chat formatting by a grammar round trip, in DataFrame functions alone.

Grammar of the rendered text::

    conversation = turn*
    turn         = "<|im_start|>" role "\\n" body "<|im_end|>" "\\n"

Neither role nor body holds a control string. Content that does is escaped: a backslash goes
in front of the bar of every ``<|`` (and one more of every ``<\\|``, ``<\\\\|``, …), and a
line end in a role becomes ``<|nl|>``. Each turn is first rendered as it is, parsed again and
compared to its source; where the two differ it is rendered escaped. The parser always takes
one backslash away, so it needs no mark to tell which turns were escaped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Code points of a piece of a text that spans are cut from.
_BLOCK = 4096
START, END, LINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
_TURN = r"(?s)^\n?<\|im_start\|>([^\n]*)\n(.*)$"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(LINE))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(LINE), F.lit("\n")))


def render(role: Column, body: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), body, F.lit(END + "\n"))


def parse(text: Column) -> Column:
    """The turns of a rendered text: array<struct<role, text>>.

    An element is null where the text does not follow the grammar. An empty text has no turn.
    """
    pieces = F.split(text, r"<\|im_end\|>", -1)

    def turn(piece: Column) -> Column:
        role, body = F.regexp_extract(piece, _TURN, 1), F.regexp_extract(piece, _TURN, 2)
        valid = piece.rlike(_TURN) & ~F.contains(role, F.lit(START)) & ~F.contains(body, F.lit(START))
        return F.when(valid, F.struct(unescape_role(role).alias("role"), unescape(body).alias("text")))

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def masked(formatted: Column, spans: Column) -> Column:
    """The unescaped text under a loss mask, its spans joined in order.

    The text is cut into blocks of equal length once, so that a span near its end is not looked
    for from its start.
    """

    def cut(blocks: Column, span: Column) -> Column:
        first, last = (F.floor(place / _BLOCK).cast("int") for place in (span["start"], span["start"] + span["length"]))
        around = F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
        return unescape(F.substr(around, (span["start"] % _BLOCK + 1).cast("int"), span["length"].cast("int")))

    # An array of one element binds the blocks, so that they are computed once and not per span.
    blocks = F.array(F.regexp_extract_all(formatted, F.lit(rf"(?s).{{1,{_BLOCK}}}"), F.lit(0)))
    joined = F.transform(blocks, lambda known: F.array_join(F.transform(spans, lambda span: cut(known, span)), ""))
    return F.element_at(joined, 1)


def format_conversations(turns: DataFrame, assistant: str = "assistant") -> DataFrame:
    """One row per conversation of ``turns`` (conv_id, turn, role, text; other columns are ignored).

    Returns conv_id, formatted, source (array<struct<role, text>>), n_escaped (turns that had to
    be escaped), loss_spans (array<struct<start, length>>: code points of ``formatted`` under the
    loss mask, from 0, one span per assistant turn) and identical (``formatted`` parses to source).

    Turns stand in the order of turn; equal turns in that of role, then text; a null turn comes
    first. Null roles and texts are empty. Rows without conv_id form one conversation with a null
    id. Repeated rows are repeated turns. No rows give no conversation.

    One shuffle by conversation, as both the offsets and the text of a conversation need its
    turns together: a conversation is one value of the result, whatever its length.
    """
    order = ["turn", "role", "text"]
    source = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    plain = source.withColumn(
        "clash", ~parse(render(F.col("role"), F.col("text"))).eqNullSafe(F.array(F.struct("role", "text")))
    )
    shown = plain.withColumns(
        {
            "shown_role": F.when(F.col("clash"), escape_role(F.col("role"))).otherwise(F.col("role")),
            "shown_text": F.when(F.col("clash"), escape(F.col("text"))).otherwise(F.col("text")),
        }
    ).withColumn("line", render(F.col("shown_role"), F.col("shown_text")))
    by_turn = Window.partitionBy("conv_id").orderBy(*order)
    until = by_turn.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = shown.select(
        "conv_id",
        F.row_number().over(by_turn).alias("place"),
        "role",
        "text",
        "clash",
        "line",
        (
            F.sum(F.length("line").cast("long")).over(until)
            - F.length("shown_text")
            - len(END + "\n")
        ).alias("start"),
        F.length("shown_text").cast("long").alias("length"),
    )
    grouped = placed.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("place", "role", "text", "line", "start", "length"))).alias("turns"),
        F.sum(F.col("clash").cast("long")).alias("n_escaped"),
    )
    formatted = grouped.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda x: x["line"]), "").alias("formatted"),
        F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("source"),
        "n_escaped",
        F.transform(
            F.filter("turns", lambda x: x["role"] == assistant),
            lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")),
        ).alias("loss_spans"),
    )
    return formatted.withColumn("identical", parse(F.col("formatted")).eqNullSafe(F.col("source")))


def digest(formatted: DataFrame) -> DataFrame:
    """What a reader gets back from the rendered texts, one row per conversation: turns from the
    grammar, what is learned from the loss mask."""
    back = formatted.select(
        "conv_id", "formatted", "loss_spans", "n_escaped", "identical", parse(F.col("formatted")).alias("turns")
    )
    whole = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.withColumn("learned", masked(F.col("formatted"), F.col("loss_spans"))).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "n_escaped",
        "identical",
    )
