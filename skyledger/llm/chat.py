"""Chat formatting from an event log (operator 10): DataFrame functions only.

An event is (conv_id, seq, kind, msg, role, text).  Kinds: ``message`` starts message ``msg`` with
a text, ``delta`` appends to it, ``edit`` and ``regenerate`` replace all of it so far (later deltas
append to the new text), ``delete`` removes it.  A message stands where its first event stood.

Rendering: each message is ``<turn ROLE>\\n`` + text + ``</turn>\\n``.  Inside roles and texts ``\\``
is written ``\\s`` and ``<`` is written ``\\l`` (in roles also ``>`` as ``\\g`` and a line feed as ``\\n``),
so no text can hold a control string, and the text is read back exactly.  The loss mask is the list
of code-point spans [start, end) of the assistant's texts in the output (``cut_spans`` reads the text
under it); ``loss_flags`` says the same by message.

Defined results: null text is empty; null role is the empty role; null kind is ``message``; a null
``seq`` sorts first; events of equal ``seq`` are ordered by kind, role, text; an event other than
``message`` for an unknown ``msg`` starts it.  A null conv_id is a conversation of its own.  A
conversation whose messages are all deleted gives no row; an empty table gives none.  A
conversation is one row of the output, so it must fit a task; everything before it is per message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOSS_ROLE = "assistant"
_END = "</turn>\n"
#: Code points of the blocks that spans are cut from.
BLOCK = 1 << 16


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit(">"), F.lit("\\g")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\g"), F.lit(">")))


def fold_events(events: DataFrame) -> DataFrame:
    """The final messages: (conv_id, pos, role, text), one row a message."""
    e = events.select("conv_id", "msg", F.coalesce("kind", F.lit("message")).alias("kind"), "seq",
                      F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    at = F.struct("seq", "kind", "role", "text")
    by_message = Window.partitionBy("conv_id", "msg")
    replaces = F.col("kind") != "delta"
    e = (e.withColumn("__at", at)
         .withColumn("__pos", F.min("__at").over(by_message))
         .withColumn("__last", F.max(F.when(replaces, F.col("__at"))).over(by_message))
         .where(F.col("__last").isNull() | (F.col("__at") >= F.col("__last"))))
    parts = F.array_sort(F.collect_list("__at"))
    return (e.groupBy("conv_id", "msg")
            .agg(parts.alias("__parts"), F.first("__pos").alias("__pos"), F.first("__last").alias("__last"))
            .where(F.col("__last").isNull() | (F.col("__last.kind") != "delete"))
            .select("conv_id", F.struct("__pos", "msg").alias("pos"),
                    F.coalesce("__last.role", "__pos.role").alias("role"),
                    F.array_join(F.transform("__parts", lambda p: p["text"]), "").alias("text")))


def render(messages: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """One row a conversation: conv_id, formatted, loss_spans, loss_flags."""
    head = F.concat(F.lit("<turn "), escape_role(F.col("role")), F.lit(">\n"))
    m = (messages.withColumn("__head", head).withColumn("__body", escape(F.col("text")))
         .withColumn("__segment", F.concat("__head", "__body", F.lit(_END)))
         .withColumn("__size", F.char_length("__segment").cast("long")))
    before = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("__size").over(before), F.lit(0).cast("long")) + F.char_length("__head")
    m = m.withColumn("__start", start).withColumn("__end", F.col("__start") + F.char_length("__body"))
    turns = F.array_sort(F.collect_list(F.struct("pos", F.col("__segment").alias("segment"), F.col("__start").alias("start"),
                                                 F.col("__end").alias("end"), (F.col("role") == loss_role).alias("loss"))))
    return (m.groupBy("conv_id").agg(turns.alias("__turns"))
            .select("conv_id", F.array_join(F.transform("__turns", lambda t: t["segment"]), "").alias("formatted"),
                    F.transform(F.filter("__turns", lambda t: t["loss"]),
                                lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"))).alias("loss_spans"),
                    F.transform("__turns", lambda t: t["loss"]).alias("loss_flags")))


def read_back(formatted: Column) -> Column:
    """The messages in a formatted conversation: array of (role, text)."""
    chunks = F.slice(F.split(formatted, _END), 1, F.size(F.split(formatted, _END)) - 1)

    def turn(chunk: Column) -> Column:
        head = F.substring_index(chunk, ">\n", 1)
        return F.struct(unescape_role(F.substr(head, F.lit(len("<turn ") + 1))).alias("role"),
                        unescape(F.substr(chunk, F.length(head) + len(">\n") + 1)).alias("text"))

    return F.transform(chunks, turn)


def cut_spans(formatted: Column, spans: Column, block: int = BLOCK) -> Column:
    """The unescaped text under the spans, in order; null for a null text.

    Finding a code point takes time in proportion to its place, so the text is first cut into blocks,
    and each span is put together from the blocks it lies in."""
    starts = F.sequence(F.lit(0), F.floor(F.greatest(F.char_length(formatted) - 1, F.lit(0)) / block).cast("int"))
    blocks = F.transform(starts, lambda i: F.substring(formatted, i * block + 1, F.lit(block)))

    def piece(of: Column, span: Column, i: Column) -> Column:
        at = F.greatest(span["start"] - i * block, F.lit(0))
        return F.substring(F.get(of, i.cast("int")), (at + 1).cast("int"), (F.least(span["end"] - i * block, F.lit(block)) - at).cast("int"))

    def text(of: Column, span: Column) -> Column:
        within = F.sequence(F.floor(span["start"] / block), F.floor((span["end"] - 1) / block))
        return unescape(F.array_join(F.transform(within, lambda i: piece(of, span, i)), ""))

    # an array of one, so that the blocks are made once for all spans
    held = F.filter(spans, lambda s: s["end"] > s["start"])
    return F.transform(F.array(blocks), lambda of: F.array_join(F.transform(held, lambda s: text(of, s)), ""))[0]
