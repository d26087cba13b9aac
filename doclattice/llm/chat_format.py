"""Chat formatting with a grammar round trip.

Template (one string per conversation)::

    conversation := turn*
    turn         := "<|im_start|>" role "\\n" text "<|im_end|>" "\\n"

A deterministic parser reads a rendered string back by splitting it at its
control strings. A turn whose text or role does not survive that round trip is
escaped and the conversation is rendered and parsed again, at rising levels
until the recovered turns equal the source:

* level 0: nothing is escaped;
* level 1: only the turns that conflict are escaped;
* level 2: every turn is escaped.

Escaping puts one backslash between ``<`` and ``|`` of every ``<\\...\\|`` (a
``<``, any number of backslashes, a ``|``); unescaping removes one. An escaped
text holds no ``<|``, so level 2 always parses back, whatever the text says.
Line feeds in roles are escaped alike as ``<\\n|``.

Nulls: a null text or role counts as empty; rows with a null conv_id form one
conversation; rows with a null turn come first. Ties of turn are ordered by
role, then text; repeated rows stay as repeated turns. An empty table gives no
rows. Columns other than conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclattice.llm.common import let

START, END = "<|im_start|>", "<|im_end|>"
#: Any control string: none may stand inside a text.
CONTROL = r"<\|[A-Za-z0-9_]+\|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """As escape; a line feed, which would end the role, becomes ``<\\n|``, itself escaped where it stands in a source."""
    return F.replace(F.regexp_replace(role, r"<(\\*)(n?)\|", r"<\\$1$2|"), F.lit("\n"), F.lit("<n|"))


def unescape_role(role: Column) -> Column:
    return F.regexp_replace(F.replace(role, F.lit("<n|"), F.lit("\n")), r"<\\(\\*)(n?)\|", r"<$1$2|")


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a rendered conversation; null roles and texts where the grammar does not hold."""
    pieces = F.slice(F.split(formatted, F.lit(r"<\|im_start\|>"), F.lit(-1)), 2, 2**30)
    tail = END + "\n"

    def turn(piece: Column) -> Column:
        at = F.locate("\n", piece)
        text = F.substring(piece, at + 1, F.length(piece) - at - len(tail))
        sound = (at > 0) & F.endswith(piece, F.lit(tail)) & ~F.rlike(text, F.lit(CONTROL))
        role = F.substring(piece, F.lit(1), at - 1)
        return F.when(sound, F.struct(unescape_role(role).alias("role"), unescape(text).alias("text")))

    return F.transform(pieces, turn)


def loss_mask(formatted: Column, role: str = "assistant") -> Column:
    """Run lengths of the mask over a rendered conversation: array<struct<chars, loss>>, in code points, covering all of it."""
    pieces = F.slice(F.split(formatted, F.lit(r"<\|im_start\|>"), F.lit(-1)), 2, 2**30)

    def runs(piece: Column) -> Column:
        at = F.locate("\n", piece)
        size = F.length(piece) - at - len(END) - 1
        run = lambda n, loss: F.struct(n.cast("long").alias("chars"), loss.alias("loss"))
        is_loss = unescape_role(F.substring(piece, F.lit(1), at - 1)) == role
        return F.array(run(at + len(START), F.lit(False)), run(size, is_loss), run(F.lit(len(END) + 1), F.lit(False)))

    return F.flatten(F.transform(pieces, runs))


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under a loss_mask(), unescaped: each turn's run is cut out of the rendered string by the run lengths alone."""
    pieces = F.slice(F.split(formatted, F.lit(r"<\|im_start\|>"), F.lit(-1)), 2, 2**30)

    def cut(m: Column, piece: Column, i: Column) -> Column:
        head, run = F.get(m, 3 * i), F.get(m, 3 * i + 1)
        return F.when(run["loss"], unescape(F.substring(piece, (head["chars"] - len(START) + 1).cast("int"), run["chars"].cast("int"))))

    return let(mask, lambda m: F.array_join(F.transform(pieces, lambda p, i: cut(m, p, i)), ""))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, escape_level."""
    rows = conversations.select(
        "conv_id",
        F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    source = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    raw = grouped.select(
        "conv_id",
        source.alias("source"),
        F.array_join(F.transform(source, lambda t: render_turn(t["role"], t["text"])), "").alias("level0"),
    )

    def level1(t: Column) -> Column:
        return F.when(
            F.size(F.filter(parse(render_turn(t["role"], t["text"])), lambda p: p.eqNullSafe(t))) == 1,
            render_turn(t["role"], t["text"]),
        ).otherwise(render_turn(escape_role(t["role"]), escape(t["text"])))

    full = F.array_join(F.transform("source", lambda t: render_turn(escape_role(t["role"]), escape(t["text"]))), "")
    result = lambda formatted, level: F.struct(formatted.alias("formatted"), F.lit(level).alias("escape_level"))
    sound = lambda formatted: parse(formatted).eqNullSafe(F.col("source"))
    once = raw.select(
        "conv_id",
        "source",
        F.when(sound(F.col("level0")), result(F.col("level0"), 0)).otherwise(result(F.array_join(F.transform("source", level1), ""), 1)).alias("r"),
    )
    return once.select(
        "conv_id",
        F.when((F.col("r.escape_level") == 0) | sound(F.col("r.formatted")), F.col("r")).otherwise(result(full, 2)).alias("r"),
    ).select("conv_id", "r.formatted", "r.escape_level")


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds what the parser finds: turns (array<struct<role, text>>) and loss_mask."""
    return formatted.withColumns({"turns": parse(F.col("formatted")), "loss_mask": loss_mask(F.col("formatted"))})


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Digests of formatted conversations, computed from the rendered strings alone."""
    text = F.col("formatted")
    found = formatted.select("conv_id", "formatted", parse(text).alias("turns"), masked_text(text, loss_mask(text)).alias("loss"))
    spoken = found.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("all"),
        "loss",
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    return spoken.select(
        "conv_id",
        "n_turns",
        F.sha2("all", 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
