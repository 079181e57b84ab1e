"""Conversations as training text: every assistant turn becomes an example with all turns before it as context.

A turn is written as MARK, its role, SEP, its text and END. Inside roles and texts every ESCAPE is doubled and every character that
begins a control string gets an ESCAPE before it, so control strings occur only as controls, and reading back undoes it exactly.

An example is the conversation up to and with one assistant turn; only that turn's text is trainable. Examples of one conversation
are prefixes of one formatted text, so they are kept as ends in it and not as copies: a conversation of n turns stays n
turns long. `unfold` writes them out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

ESCAPE, MARK, SEP, END = "\\", "### ", ": ", " </turn>\n"


def escape(text: Column) -> Column:
    """Backslashes doubled, then one before every `#`, `<` and `:`, so that no control string is left inside."""
    return F.regexp_replace(text, r"([\\#<:])", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text") -> DataFrame:
    """(conv_id, pieces, examples) per conversation.

    `pieces` are the formatted turns in the order of turn, role and text, nulls first; their concatenation is the formatted conversation.
    `examples` are structs (piece, stop, loss_start, loss_length): the example is the first `stop` characters, of which
    `loss_length` from `loss_start` (counted from 0) are trainable. A conversation that does not end with an assistant turn has one
    more example for the rest, without trainable characters, so nothing is lost. Null roles and texts are empty; a
    null conv_id is a conversation of its own; repeated rows are turns of their own. Other columns are ignored; an empty table
    gives an empty result.
    """
    rows = turns.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"))
    written = rows.select(
        "conv_id", "turn", "role", "text", F.concat(F.lit(MARK), escape(F.col("role")), F.lit(SEP)).alias("head"),
        escape(F.col("text")).alias("body"))
    # where a turn ends is a running sum, so a long conversation takes a pass and not a copy of its turns per turn
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    placed = written.select(
        "conv_id", "role", "head", "body", (F.row_number().over(order) - 1).alias("piece"),
        F.sum(F.length("head") + F.length("body") + len(END)).over(
            order.rowsBetween(Window.unboundedPreceding, 0)).cast("int").alias("stop"))
    part = F.struct("piece", "stop", F.length("body").alias("length"), (F.col("role") == "assistant").alias("trained"),
                    F.concat("head", "body", F.lit(END)).alias("text"))
    parts = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))

    def example(p: Column, trained: bool = True) -> Column:
        begin = p["stop"] - len(END) - p["length"] if trained else p["stop"]
        return F.struct(p["piece"], p["stop"], begin.alias("loss_start"), (p["length"] if trained else F.lit(0)).alias("loss_length"))

    last = F.element_at("parts", -1)
    ends = F.transform(F.filter("parts", lambda p: p["trained"]), lambda p: example(p))
    rest = F.when(~last["trained"], F.array(example(last, False)))
    return parts.select("conv_id", F.transform("parts", lambda p: p["text"]).alias("pieces"),
                        F.concat(ends, F.coalesce(rest, F.array().cast(
                            "array<struct<piece:int,stop:int,loss_start:int,loss_length:int>>"))).alias("examples"))


def unfold(formatted: DataFrame) -> DataFrame:
    """(conv_id, example, prompt, target, loss_length, chars, is_last): a row per example, its context as the prompt.

    The first `loss_length` characters of the target are trainable, `chars` counts prompt and target, and the last example of a
    conversation holds all of it. A target is cut from its own turn; only prompts that are asked for are written out.
    """
    whole = formatted.select("conv_id", "pieces", F.size("examples").alias("n"), F.posexplode("examples").alias("example", "e"))
    return whole.select("conv_id", "example", F.expr("substring(concat_ws('', pieces), 1, e.loss_start)").alias("prompt"),
                        F.expr("right(get(pieces, e.piece), e.stop - e.loss_start)").alias("target"),
                        F.col("e.loss_length").alias("loss_length"), F.col("e.stop").alias("chars"),
                        (F.col("example") == F.col("n") - 1).alias("is_last"))


def _turns(whole: Column) -> Column:
    """Structs (role, text) of a formatted conversation, cut out at control strings and unescaped."""
    # the space and `<` of END are neighbours only where it closes a turn: inside texts a backslash stands between them
    cut = F.split(whole, " </turn>\n")
    # possessive quantifiers: a role of any length is read without recursion and without going back
    return F.transform(F.slice(cut, 1, F.size(cut) - 1), lambda t: F.struct(
        unescape(F.regexp_extract(t, r"(?s)^### ((?:[^\\:]++|\\.)*+): ", 1)).alias("role"),
        unescape(F.regexp_extract(t, r"(?s)^### (?:[^\\:]++|\\.)*+: (.*+)$", 1)).alias("text")))


def read_examples(examples: DataFrame) -> DataFrame:
    """(conv_id, turns, losses, formatted_chars) as `read_back` gives them, from the rows of `unfold`: losses from each example's target, turns
    from the last example's prompt and target."""
    loss = unescape(F.expr("substring(target, 1, loss_length)"))
    read = examples.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("example", loss.alias("loss")))).alias("losses"),
        F.sum(F.col("chars").cast("long")).alias("formatted_chars"),
        F.max(F.when(F.col("is_last"), F.concat("prompt", "target"))).alias("whole"))
    return read.select("conv_id", _turns(F.col("whole")).alias("turns"), F.col("losses.loss").alias("losses"), "formatted_chars")


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, losses, formatted_chars) read from the formatted text alone.

    `turns` are structs (role, text) cut out at control strings and unescaped, `losses` the unescaped trainable text of each example,
    `formatted_chars` the characters of all examples together.
    """
    text = formatted.select("conv_id", "examples", F.concat_ws("", "pieces").alias("whole"))
    # the space and `<` of END are neighbours only where it closes a turn: inside texts a backslash stands between them
    cut = F.split(F.expr("substring(whole, 1, element_at(examples, -1).stop)"), " </turn>\n")
    text = text.select("conv_id", "examples", F.slice(cut, 1, F.size(cut) - 1).alias("closed"))
    # possessive quantifiers: a role of any length is read without recursion and without going back
    turns = F.transform("closed", lambda t: F.struct(
        unescape(F.regexp_extract(t, r"(?s)^### ((?:[^\\:]++|\\.)*+): ", 1)).alias("role"),
        unescape(F.regexp_extract(t, r"(?s)^### (?:[^\\:]++|\\.)*+: (.*+)$", 1)).alias("text")))

    def masked(e: Column) -> Column:
        # counted within the turn that ends the example: places in the whole text would be searched from its start
        piece = F.concat(F.get("closed", e["piece"]), F.lit(END))
        return unescape(F.substring(piece, F.length(piece) - (e["stop"] - e["loss_start"]) + 1, e["loss_length"]))

    total = F.aggregate("examples", F.lit(0).cast("long"), lambda n, e: n + e["stop"])
    return text.select("conv_id", turns.alias("turns"), F.transform("examples", lambda e: masked(e)).alias("losses"),
                       total.alias("formatted_chars"))
