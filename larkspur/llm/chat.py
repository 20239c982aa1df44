"""Chat formatting with typed content parts, a reversible template and a loss mask.

A message's content is an array of typed parts. A visitor turns each part into text: text parts are escaped, image,
audio and document parts become a placeholder and an attachment record with its reference and expanded token count. Turns are
marked and joined in order; every control string in a text or role is escaped, so the output can be read back.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Marks of the template. Turns of trained roles stand between TRAINED, others between PROMPT.
PROMPT = ("[INST]", "[/INST]")
TRAINED = ("<s>", "</s>")
TEXT_MARK = "<|text|>"
CONTROLS = r"</?s>|\[/?INST\]|<</?SYS>>|<\|(?:text|image|audio|document)\|>"
OPENS = r"^(?:\[INST\]|<s>)"
CLOSES = r"\[/INST\]|</s>"
TRAINED_ROLES = ("assistant",)

PART = "struct<type string, text string, ref string, width int, height int, seconds double, pages int>"

# Token counts of one attachment: pixels of an image patch's side, audio tokens a second, tokens a page.
PATCH = 28
AUDIO_RATE = 25
PAGE_TOKENS = 256


def escaped(text: Column) -> Column:
    """Double each backslash and put one behind the first character of each control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"(?=(?:{CONTROLS}))(.)", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def text_parts(messages: DataFrame, text: str = "text") -> DataFrame:
    """Messages whose content is one text part; a null text is an empty one. A column ``parts`` is replaced."""
    part = F.struct(
        F.lit("text").alias("type"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"),
        F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"),
        F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"),
    )
    return messages.withColumn("parts", F.array(part))


def part_text(part: Column) -> Column:
    """A part as text: escaped text or a placeholder. Null and unknown parts show their text, if any."""
    attached = part["type"].isin("image", "audio", "document")
    return F.when(attached, F.concat(F.lit("<|"), part["type"], F.lit("|>"))).otherwise(
        escaped(F.coalesce(part["text"], F.lit("")))
    )


def part_tokens(part: Column) -> Column:
    """Tokens an attachment expands to; sizes that are missing or below one count as one."""
    side = lambda c: F.greatest(F.ceil(F.coalesce(c, F.lit(1)) / F.lit(PATCH)), F.lit(1))
    return (
        F.when(part["type"] == "image", side(part["width"]) * side(part["height"]))
        .when(part["type"] == "audio", F.greatest(F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_RATE), F.lit(1)))
        .otherwise(F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(1)).cast("long") * PAGE_TOKENS)
        .cast("long")
    )


def format_chats(messages: DataFrame) -> DataFrame:
    """One row per conversation from rows (conv_id, turn, role, parts).

    Returns conv_id, n_turns, ``formatted``, ``loss_spans`` (array of start and length in code points: the contents of
    trained roles' turns) and ``attachments`` in order of their placeholders (turn index, kind, reference, tokens, and
    the token position they would begin at if text had none). Turns are ordered by turn, then role, then content, so that
    ties and repeated rows have one result; null turns come first. A null role is empty, null parts are no content,
    a null conv_id is a conversation of its own. Other columns are ignored.
    """
    parts = F.filter(F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    role = F.coalesce(F.col("role"), F.lit(""))
    trained = role.isin(*TRAINED_ROLES)
    rows = messages.select(
        "conv_id",
        "turn",
        role.alias("role"),
        F.concat(F.when(trained, TRAINED[0]).otherwise(PROMPT[0]), escaped(role), F.lit(TEXT_MARK)).alias("opening"),
        F.array_join(F.transform(parts, part_text), "").alias("body"),
        F.when(trained, TRAINED[1]).otherwise(PROMPT[1]).alias("closing"),
        trained.alias("trained"),
        F.transform(
            F.filter(parts, lambda p: p["type"].isin("image", "audio", "document")),
            lambda p: F.struct(p["type"].alias("kind"), p["ref"].alias("ref"), part_tokens(p).alias("n_tokens")),
        ).alias("attached"),
    )
    in_order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "body", F.col("attached").cast("string"))
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    own = F.char_length("opening") + F.char_length("body") + F.char_length("closing")
    tokens = F.aggregate("attached", F.lit(0).cast("long"), lambda acc, a: acc + a["n_tokens"])
    placed = rows.withColumns(
        {
            "place": F.row_number().over(in_order),
            "start": F.coalesce(F.sum(own).over(before), F.lit(0)).cast("long"),
            "tokens_before": F.coalesce(F.sum(tokens).over(before), F.lit(0)),
        }
    )
    attached = F.transform(
        "attached",
        lambda a, i: F.struct(
            (F.col("place") - 1).alias("turn_index"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["n_tokens"].alias("n_tokens"),
            (F.col("tokens_before") + F.aggregate(F.slice(F.col("attached"), 1, i), F.lit(0).cast("long"), lambda acc, b: acc + b["n_tokens"])).alias("token_start"),
        ),
    )
    turn = F.struct(
        "place",
        F.concat("opening", "body", "closing").alias("shown"),
        F.when(F.col("trained"), F.struct((F.col("start") + F.char_length("opening")).alias("start"), F.char_length("body").cast("long").alias("length"))).alias("span"),
        attached.alias("attached"),
    )
    gathered = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return gathered.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join("turns.shown", "").alias("formatted"),
        F.filter("turns.span", lambda s: s.isNotNull()).alias("loss_spans"),
        F.flatten("turns.attached").alias("attachments"),
    )


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, unescaped; placeholders stay in the text."""
    shown = F.filter(F.split(formatted, CLOSES), lambda t: t != "")
    halves = F.transform(shown, lambda t: F.split(F.regexp_replace(t, OPENS, ""), r"<\|text\|>", 2))
    return F.transform(halves, lambda h: F.struct(unescaped(h[0]).alias("role"), unescaped(h[1]).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    cut = lambda s: unescaped(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))
    return F.array_join(F.transform(spans, cut), "")
