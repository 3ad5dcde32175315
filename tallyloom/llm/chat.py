"""Chat formatting with typed content parts (operator 6), in SQL functions only.

A conversation becomes one string.  A visitor flattens the parts of each turn:
text is escaped, an image, audio or document part leaves a placeholder such as
``<image>``, and the n-th placeholder belongs to the n-th entry of
``attachments``, which records turn, kind, reference and the tokens it expands
to.  The template is ::

    <turn>role\\ntext</turn>\\n

Inside texts ``\\`` becomes ``\\b`` and ``<`` becomes ``\\l`` (in roles and kinds a
line break also becomes ``\\n``), so no control string can occur in them and the
step is undone exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens that an attachment expands to where its part names no count.
EXPANSION = {"image": 256, "audio": 128, "document": 512}
PARTS = "array<struct<kind:string,text:string,ref:string,tokens:long>>"
TRAINED = "assistant"
_OPEN, _CLOSE = "<turn>", "</turn>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def escape_name(name: Column) -> Column:
    return F.replace(escape(name), F.lit("\n"), F.lit("\\n"))


def unescape_name(name: Column) -> Column:
    return unescape(F.replace(name, F.lit("\\n"), F.lit("\n")))


def _is_text(part: Column) -> Column:
    return F.coalesce(part["kind"], F.lit("text")) == "text"


def _visit(part: Column) -> Column:
    return F.when(_is_text(part), escape(F.coalesce(part["text"], F.lit("")))).otherwise(F.concat(F.lit("<"), escape_name(part["kind"]), F.lit(">")))


def _tokens(part: Column) -> Column:
    default = F.lit(0).cast("long")
    for kind, n in EXPANSION.items():
        default = F.when(part["kind"] == kind, F.lit(n).cast("long")).otherwise(default)
    return F.coalesce(part["tokens"], default)


def format_chats(turns: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_spans, attachments, attachment_tokens``, one row per conversation.

    ``turns`` has conv_id, turn, role and text, or ``parts`` of type ``PARTS``
    instead of text.  ``loss_spans`` (start, length, in code points of
    ``formatted``) cover what the assistant says.  Rows go by turn (null first),
    ties by role, then content; a repeated row is a further turn.  Null texts,
    roles and parts count as empty, null conv_ids as one conversation.  Other
    columns are ignored; an empty table gives no rows.  The one shuffle is that
    of the grouping; a conversation is one output row and so meets in a task."""
    if "parts" in turns.columns:
        parts = F.coalesce(F.col("parts").cast(PARTS), F.array().cast(PARTS))
    else:
        parts = F.array(F.struct(F.lit("text").alias("kind"), F.col("text").cast("string").alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("tokens")))
    message = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), parts.alias("parts"))
    chats = turns.select(F.col("conv_id").cast("long"), message.alias("m")).groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("messages"))
    chats = chats.withColumn(
        "pieces",
        F.transform(
            "messages",
            lambda m: F.struct(
                F.concat(F.lit(_OPEN), escape_name(m["role"]), F.lit("\n")).alias("head"),
                F.array_join(F.transform(m["parts"], _visit), "").alias("body"),
                (m["role"] == TRAINED).alias("trained"),
            ),
        ),
    )
    spans = "array<struct<start:long,length:long>>"
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(spans).alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        begins = acc["at"] + F.char_length(p["head"])
        length = F.char_length(p["body"]).cast("long")
        span = F.array(F.struct(begins.alias("start"), length.alias("length"))).cast(spans)
        return F.struct((begins + length + len(_CLOSE)).alias("at"), F.when(p["trained"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    attached = F.flatten(
        F.transform(
            "messages",
            lambda m: F.transform(
                F.filter(m["parts"], lambda p: ~_is_text(p)),
                lambda p: F.struct(m["turn"].alias("turn"), p["kind"].alias("kind"), p["ref"].alias("ref"), _tokens(p).alias("tokens")),
            ),
        )
    )
    return chats.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(_CLOSE))), "").alias("formatted"),
        F.aggregate("pieces", start, step, lambda acc: acc["spans"]).alias("loss_spans"),
        attached.alias("attachments"),
        F.aggregate(attached, F.lit(0).cast("long"), lambda n, x: n + x["tokens"]).alias("attachment_tokens"),
    )


def read_chats(formatted: DataFrame) -> DataFrame:
    """The inverse: ``conv_id, turns (array of role, text), loss_text``, from the string and its mask alone.

    Placeholders stay in the texts as they are."""
    pieces = F.split("formatted", _CLOSE, -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def parse(p: Column) -> Column:
        cut = F.instr(p, "\n")
        role = F.substring(p, F.lit(len(_OPEN) + 1), cut - len(_OPEN) - 1)
        return F.struct(unescape_name(role).alias("role"), unescape(F.substring(p, cut + 1, F.char_length(p))).alias("text"))

    masked = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.select("conv_id", F.transform(pieces, parse).alias("turns"), F.array_join(masked, "").alias("loss_text"), F.char_length("formatted").cast("long").alias("formatted_chars"))
