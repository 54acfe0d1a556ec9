"""Chat formatting from event logs.

``fold_events`` rebuilds messages: the log is partitioned by conversation and message and sorted by sequence;
a message, edit or regeneration starts a message's text anew, deltas append to it, a delete takes it away.
``render`` writes one piece of text a message; the pieces of a conversation in order are its formatted text, so
a conversation of any length never has to be one string. ``read_back`` streams the sorted pieces through an incremental
parser with the state of one turn and two running hashes.

A turn is ``### role: text</turn>`` and a line feed. Inside texts a backslash, ``#`` and the ``<`` of ``</turn>`` get a
backslash before them, inside roles also ``:``; so no control string occurs inside a turn, and unescaping gives the text back.

Defined results: null text or role is ''; a null conversation id is a conversation of its own; turns sort by number (null first), then
role, then text; repeated rows are repeated turns; an empty log gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import arrow_schema, prepared, table

TURN, SAY, END = "### ", ": ", "</turn>\n"
MASKED = "assistant"
KEYS = ["conv_id", "seq", "message"]


def fold_events(events: DataFrame) -> DataFrame:
    """Messages (conv_id, seq, message, role, text) of events (conv_id, seq, message, kind, role, text).

    Kinds: message, edit, regenerate, delta, delete. ``seq`` of a message is that of its first event.
    """
    e = F.struct(F.col("seq"), F.coalesce("kind", F.lit("message")).alias("kind"), F.col("role"), F.coalesce("text", F.lit("")).alias("text"))
    own = events.groupBy("conv_id", "message").agg(F.sort_array(F.collect_list(e)).alias("own"))
    start = F.coalesce(F.array_max(F.transform("own", lambda x, i: F.when(x["kind"] != "delta", i))), F.lit(0))
    own = own.withColumn("start", start).withColumn("live", F.slice("own", F.col("start") + 1, F.size("own")))
    role = F.element_at(F.filter(F.transform("own", lambda x: x["role"]), lambda r: r.isNotNull()), -1)
    own = own.filter(F.col("live")[0]["kind"] != "delete")
    return own.select(
        "conv_id", F.element_at("own", 1)["seq"].alias("seq"), "message",
        F.coalesce(F.when(F.exists("own", lambda x: x["role"].isNotNull()), role), F.lit("")).alias("role"),
        F.array_join(F.transform("live", lambda x: x["text"]), "").alias("text"),
    )


def escaped(text: Column, more: str = "") -> Column:
    for c in "\\#" + more:
        text = F.replace(text, F.lit(c), F.lit("\\" + c))
    return F.replace(text, F.lit("</turn>"), F.lit("\\</turn>"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, seq, message, piece, loss_from, loss_to): the mask's code points inside the piece, equal ends for none."""
    head = F.concat(F.lit(TURN), escaped(F.col("role"), ":"), F.lit(SAY))
    body = escaped(F.col("text"))
    on = F.col("role") == MASKED
    start = F.length(head)
    return messages.select(
        *KEYS, F.concat(head, body, F.lit(END)).alias("piece"),
        F.when(on, start).otherwise(0).alias("loss_from"), F.when(on, start + F.length(body)).otherwise(0).alias("loss_to"),
    )


_ESCAPE = re.compile(r"\\(.)", re.DOTALL)
_ROLE = re.compile(r"### ((?:[^\\:]|\\.)*): ", re.DOTALL)


def unescaped(text: str) -> str:
    return _ESCAPE.sub(r"\1", text)


def turns_of(piece: str) -> Iterator[tuple[str, str]]:
    """The (role, text) of the turns of formatted text, without its escapes."""
    at = 0
    while at < len(piece):
        head = _ROLE.match(piece, at)
        if head is None:
            raise ValueError("not formatted text")
        at = head.end()
        stop = at
        while True:  # the first end mark without a backslash; a backslash always belongs to the character after it
            stop = piece.index(END, stop)
            before = stop
            while before > at and piece[before - 1] == "\\":
                before -= 1
            if (stop - before) % 2 == 0:
                break
            stop += 1
        yield unescaped(head[1]), unescaped(piece[at:stop])
        at = stop + len(END)


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(pieces: DataFrame) -> DataFrame:
    """The digest of each conversation, read from its formatted pieces in order with constant memory."""
    prepared(pieces.sparkSession)
    types = arrow_schema(READ)
    rows = pieces.withColumn("conv_id", F.col("conv_id").cast("long")).repartition("conv_id").sortWithinPartitions(*KEYS, "piece").select("conv_id", "piece", "loss_from", "loss_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, state = object(), None
        for batch in batches:
            for conv, piece, lo, hi in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        out.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in turns_of(piece):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                masked = unescaped(piece[lo:hi])
                state[2] += len(masked)
                state[3].update(masked.encode())
                state[4] += len(piece)
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), types, strict=True)], schema=types)
                out = []
        if state is not None:
            out.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), types, strict=True)], schema=types)

    return rows.mapInArrow(run, READ)


def events_of(conversations: DataFrame) -> DataFrame:
    """The log of (conv_id, turn, role, text) rows: a message each; an assistant's begins empty and is streamed in two deltas, as replies are."""
    same = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    text, half = F.coalesce("text", F.lit("")), F.floor(F.length(F.coalesce("text", F.lit(""))) / 2).cast("int")
    event = lambda step, kind, part: F.struct(F.lit(step).alias("step"), F.lit(kind).alias("kind"), part.alias("text"))
    streamed = F.array(event(0, "message", F.lit("")), event(1, "delta", F.substring(text, F.lit(1), half)), event(2, "delta", F.substring(text, half + 1, F.length(text))))
    rows = conversations.select("conv_id", "turn", "role", F.row_number().over(same).alias("nth"), F.when(F.col("role") == MASKED, streamed).otherwise(F.array(event(0, "message", text))).alias("own"))
    rows = rows.select("conv_id", "turn", "role", "nth", F.explode("own").alias("e"))
    return rows.select("conv_id", F.struct("turn", "nth", F.col("e.step").alias("step")).alias("seq"), F.struct("turn", "nth").alias("message"), F.col("e.kind").alias("kind"), "role", F.col("e.text").alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], own.schema)
    return read_back(render(fold_events(events_of(own.unionByName(extra)))))


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok', 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok', 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)) AS turns_sha256,
       sum(CASE WHEN r = 'assistant' THEN length(t) ELSE 0 END)::bigint AS loss_chars,
       sha256(string_agg(CASE WHEN r = 'assistant' THEN t ELSE '' END, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)) AS loss_sha256,
       sum(length(r) + length(r) - length(translate(r, '\#:', '')) + length(replace(r, '</turn>', 'x</turn>')) - length(r)
           + length(t) + length(t) - length(translate(t, '\#', '')) + length(replace(t, '</turn>', 'x</turn>')) - length(t) + 14)::bigint AS formatted_chars
FROM c GROUP BY conv_id
"""
