"""Conversations rebuilt from event logs and rendered with a chat template that can be read back.

An event belongs to a conversation and to one of its messages and has a place (seq) in
the log. ``message`` starts a message, ``delta`` appends to it, ``edit`` replaces what
it says, ``regenerate`` drops what it says and starts anew. An edit or regeneration
also takes back every later message as far as it was written before. Folding groups
by conversation and message, so a long conversation is no single group; only what has
to be read in order, such as a digest, streams through one task in bounded memory.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import Batches

# Control strings of this and of common templates.
CONTROL = r"(</?s>|\[/?(?:ROLE|INST)\]|<</?SYS>>)"
_DIGESTS = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
])


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, message, role, text) as the log of (conv_id, message, seq, kind, role, text) leaves them.

    Events of one seq are taken in the order of kind, then text. Null texts and roles
    count as empty; a message has the role of its first living event. Unknown kinds
    append. A null conv_id is a conversation of its own; no events, no messages. Places
    and messages may be of any type that has an order. Texts are gathered per message only;
    of a conversation, one task reads in order what its messages were last reset at.
    """
    resets = F.max(F.when(F.col("kind").isin("edit", "regenerate"), F.col("seq"))).alias("reset")
    last = events.groupBy("conv_id", "message").agg(resets)
    before = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("taken_back", F.max("reset").over(before))
    known = events.select("conv_id", "message", "seq", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    same = (known["conv_id"].eqNullSafe(last["conv_id"])) & (known["message"].eqNullSafe(last["message"]))
    living = known.join(last, same).select(known["*"], "reset", "taken_back")
    living = living.filter((F.col("reset").isNull() | (F.col("seq") >= F.col("reset"))) & (F.col("taken_back").isNull() | (F.col("seq") > F.col("taken_back"))))
    parts = F.array_sort(F.collect_list(F.struct("seq", "kind", "text", "role"))).alias("parts")  # of one message
    folded = living.groupBy("conv_id", "message").agg(parts)
    return folded.select("conv_id", "message", F.col("parts")[0]["role"].alias("role"), F.array_join(F.transform("parts", lambda x: x["text"]), "").alias("text"))


def escape(text: F.Column) -> F.Column:
    """A backslash in front of every control string."""
    return F.regexp_replace(text, F.lit(CONTROL), F.lit(r"\\$1"))


def unescape(text: F.Column) -> F.Column:
    return F.regexp_replace(text, F.lit(r"\\" + CONTROL), F.lit("$1"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, message, piece, loss_start, loss_length): a conversation is its pieces in the order of message.

    The loss mask covers the texts of assistants: ``loss_length`` code points of the
    piece from ``loss_start``, 0-based; none elsewhere. White space parts text from
    control strings, so a text that ends in a backslash cannot hide one.
    """
    head = F.concat(F.lit("<s>[ROLE] "), escape(F.col("role")), F.lit(" [/ROLE] "))
    piece = F.concat(head, escape(F.col("text")), F.lit(" </s>"))
    learnt = F.col("role") == "assistant"
    return messages.select(
        "conv_id", "message", piece.alias("piece"),
        F.when(learnt, F.length(head)).otherwise(0).alias("loss_start"),
        F.when(learnt, F.length(escape(F.col("text")))).otherwise(0).alias("loss_length"),
    )


def read_back(pieces: DataFrame) -> DataFrame:
    """(conv_id, message, role, text, loss_text, formatted_chars) from rendered pieces alone."""
    form = r"(?s)\A<s>\[ROLE\] (.*?) \[/ROLE\] (.*) </s>\z"
    return pieces.select(
        "conv_id", "message",
        unescape(F.regexp_extract("piece", form, 1)).alias("role"),
        unescape(F.regexp_extract("piece", form, 2)).alias("text"),
        unescape(F.substring("piece", F.col("loss_start") + 1, F.col("loss_length"))).alias("loss_text"),
        F.length("piece").alias("formatted_chars"),
    )


def conversation_digests(turns: DataFrame) -> DataFrame:
    """One row per conversation of ``read_back``: counts and digests, taken in order from a sorted stream."""

    def digests(batches: Batches) -> Batches:
        current, state = object(), None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if state is None or row["conv_id"] != current:
                    if state:
                        done.append(_closed(current, state))
                    current, state = row["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += 1
                state[1].update(f"{row['role']}\n{row['text']}\n".encode("utf-8", "surrogatepass"))
                state[2] += len(row["loss_text"])
                state[3].update(row["loss_text"].encode("utf-8", "surrogatepass"))
                state[4] += row["formatted_chars"]
            yield pa.RecordBatch.from_pylist(done, schema=_DIGESTS)
        if state:
            yield pa.RecordBatch.from_pylist([_closed(current, state)], schema=_DIGESTS)

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "message")
    return ordered.mapInArrow(digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _closed(conv_id: int | None, state: list) -> dict:
    return dict(zip(_DIGESTS.names, (conv_id, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])))


def turn_events(conversations: DataFrame) -> DataFrame:
    """A table of whole turns as a log that leads to it, so that folding has something to fold.

    A turn of an assistant is drafted, regenerated and streamed on in a delta; any other one
    is drafted and edited. Turns follow each other by turn, then role, then a hash of the text;
    a row that comes several times is as many turns. No conversation is gathered for this.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    turns = counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    message = F.struct("turn", "role", F.xxhash64("text").alias("hash"), "copy")
    half = F.length("text") / 2
    start, rest = F.substring("text", F.lit(1), half.cast("int")), F.substring("text", half.cast("int") + 1, F.length("text"))
    draft = F.concat(rest, start)

    def event(step: int, kind: str, text: F.Column) -> F.Column:
        return F.struct(F.lit(step).alias("step"), F.lit(kind).alias("kind"), text.alias("text"))

    streamed = F.array(event(0, "message", draft), event(1, "regenerate", start), event(2, "delta", rest))
    edited = F.array(event(0, "message", draft), event(1, "edit", F.col("text")))
    told = turns.select("conv_id", message.alias("message"), "role", F.explode(F.when(F.col("role") == "assistant", streamed).otherwise(edited)).alias("e"))
    seq = F.struct("message.turn", "message.role", "message.hash", "message.copy", "e.step")
    return told.select("conv_id", "message", seq.alias("seq"), "e.kind", "role", "e.text")
