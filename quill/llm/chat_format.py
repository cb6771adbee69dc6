"""Chat formatting with a grammar round trip, in DataFrame functions only.

Grammar of the output: ``conversation := turn*``,
``turn := "<s>" level "[INST]" role "[/INST]" text "</s>"`` where level is 0, 1 or 2.
Level 0 holds role and text as they are. Level 1 puts ESC after the first character of every control string
and after every ESC, level 2 replaces ESC and both first characters outright. Each turn is rendered at
level 0, parsed again by the same parser that reads the output, and compared with its source; turns that
differ are rendered at level 1, and those that still differ at level 2, which leaves no control string in
any content and so always comes back the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings and the escape character of the template.
BEGIN, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
ESC = "␛"

_CONTROL = r"(<(?=s>|/s>)|\[(?=INST\]|/INST\])|" + ESC + ")"


def escape(text: Column, level: int) -> Column:
    """Content as it stands in the output at a level."""
    if level == 0:
        return text
    if level == 1:
        return F.regexp_replace(text, _CONTROL, "$1" + ESC)
    out = F.replace(text, F.lit(ESC), F.lit(ESC + "0"))
    out = F.replace(out, F.lit("<"), F.lit(ESC + "1"))
    return F.replace(out, F.lit("["), F.lit(ESC + "2"))


def unescape(text: Column, level: Column) -> Column:
    """The inverse of :func:`escape`; level is the digit that the turn carries."""
    one = F.regexp_replace(text, "([<\\[" + ESC + "])" + ESC, "$1")
    two = F.replace(text, F.lit(ESC + "2"), F.lit("["))
    two = F.replace(two, F.lit(ESC + "1"), F.lit("<"))
    two = F.replace(two, F.lit(ESC + "0"), F.lit(ESC))
    return F.when(level == "1", one).when(level == "2", two).otherwise(text)


def render(role: Column, text: Column, level: int) -> Column:
    """One turn of the output."""
    return F.concat(F.lit(BEGIN + str(level) + OPEN), escape(role, level), F.lit(CLOSE), escape(text, level), F.lit(END))


def parse(formatted: Column) -> Column:
    """Turns (level, role, text, prefix length) of a formatted string, read from left to right.

    A turn ends at the first end mark; its role ends at the first close mark; role and text hold no control string.
    Anything else gives a turn with nulls.
    """
    bodies = F.split(formatted, "\\Q" + END + "\\E", -1)
    bodies = F.slice(bodies, 1, F.greatest(F.size(bodies) - 1, F.lit(0)))  # what follows the last end mark is empty

    def turn(body: Column) -> Column:
        head = F.regexp_extract(body, r"^<s>([012])\[INST\]", 1)
        start = len(BEGIN) + 1 + len(OPEN)
        at = F.locate(CLOSE, body, start + 1)
        inner = lambda t: ~t.rlike(r"</?s>|\[/?INST\]")
        ok = (head != "") & (at > 0) & inner(F.substring(body, start + 1, at - 1 - start)) & inner(F.substring(body, at + len(CLOSE), F.length(body)))
        role = F.when(ok, F.substring(body, start + 1, at - 1 - start))
        text = F.when(ok, F.substring(body, at + len(CLOSE), F.length(body)))
        return F.struct(head.alias("level"), unescape(role, head).alias("role"), unescape(text, head).alias("text"), F.when(ok, at - 1 + len(CLOSE)).alias("prefix"))

    return F.transform(bodies, turn)


def _comes_back(rendered: Column, role: Column, text: Column) -> Column:
    got = parse(rendered)
    return (F.size(got) == 1) & got[0]["role"].eqNullSafe(role) & got[0]["text"].eqNullSafe(text)


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with ``rendered`` and ``level``: one row for each input row; no row needs another.

    Null roles and texts count as empty. Other columns are dropped.
    """
    role, text = F.col("role"), F.col("text")
    df = turns.select("conv_id", "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    df = df.withColumn("rendered", render(role, text, 0)).withColumn("level", F.when(_comes_back(F.col("rendered"), role, text), F.lit(0)))
    for level in (1, 2):
        redo = F.col("level").isNull()
        df = df.withColumn("rendered", F.when(redo, render(role, text, level)).otherwise(F.col("rendered")))
        df = df.withColumn("level", F.when(redo, F.when(_comes_back(F.col("rendered"), role, text), F.lit(level))).otherwise(F.col("level")))
    return df


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row for each conversation: conv_id, formatted (its text) and segments (pieces of the text with ``loss``).

    Turns are in order of turn, then role and text, nulls first; rows that are repeated stay repeated. Segments joined give
    formatted; those with loss hold each assistant text as it stands there. Rows with a null conv_id form one conversation.
    A conversation is one value in the end, so it must fit a task; the rendering itself works turn by turn.
    """
    t = format_turns(turns)
    body = parse(F.col("rendered"))[0]
    prefix = body["prefix"].cast("int")
    loss = F.col("role") == "assistant"
    t = t.select(
        "conv_id",
        F.struct("turn", "role", "text", "rendered", loss.alias("loss"), F.when(loss, prefix).otherwise(F.length("rendered")).alias("prefix")).alias("t"),
    )
    t = t.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    pieces = F.flatten(
        F.transform(
            "t",
            lambda x: F.array(
                F.struct(F.substring(x["rendered"], F.lit(1), x["prefix"]).alias("text"), F.lit(False).alias("loss")),
                F.struct(F.substring(x["rendered"], x["prefix"] + 1, F.length(x["rendered"]) - x["prefix"] - len(END)).alias("text"), x["loss"].alias("loss")),
                F.struct(F.when(x["loss"], F.lit(END)).otherwise("").alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    return t.select("conv_id", F.array_join(F.transform("t", lambda x: x["rendered"]), "").alias("formatted"), F.filter(pieces, lambda p: p["text"] != "").alias("segments"))


def read_back(formatted: DataFrame) -> DataFrame:
    """What the output says: conv_id, turns (role, text), loss_text (all assistant texts, unescaped) and formatted.

    The loss text comes from the loss segments; each is unescaped by the level of its turn's mark, the segment before it.
    """
    level = lambda before: F.substring(before, len(BEGIN) + 1, 1)
    texts = F.transform(
        F.filter(F.transform("segments", lambda s, i: F.struct(s["text"].alias("text"), s["loss"].alias("loss"), i.alias("i"))), lambda s: s["loss"]),
        lambda s: unescape(s["text"], level(F.element_at("segments", s["i"])["text"])),
    )
    return formatted.select(
        "conv_id",
        F.transform(parse(F.col("formatted")), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"),
        F.array_join(texts, "").alias("loss_text"),
        "formatted",
    )
