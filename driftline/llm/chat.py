"""Chat formatting from event logs.

An event is (conv_id, seq, message, kind, role, text). seq orders a
conversation's events, message is the number of the message it is about. Kinds:
"message" and "delta" append text to their message, "edit" sets it, "regenerate"
empties it; an edit or a regeneration also drops all that was logged before it
for that message and for later ones. fold() reconstructs the final messages,
render() writes them in a template, read() gets turns and loss mask back from
what was written.

Scale: no step holds a conversation together. Events are folded by message;
which resets apply is found by blocks of messages and then within a block;
text is rendered by blocks of turns. Only digests(), whose result is one hash of
the whole conversation, reads a conversation in order, row by row, without
keeping it.

Template: "### role: text</turn>\\n". In roles and texts a backslash and the
first character of each control string get a backslash in front, which read()
takes off again. Loss mask: (start, end) in code points of each assistant text
within its block.

A table of turns becomes a log by numbered() and logged(), whose fold is the
table again.

Edge cases: null texts and roles are empty ones; null kinds count as "message";
events with null conv_id form one conversation (ids of any size beside it stay what they are); a message whose events are all
dropped is gone; events that tie in seq are ordered by kind and text. Extra
columns are dropped.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.plans.scans import running
from driftline.session import ship

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>"
_ESCAPE = re.compile(r"\\|### |: |</turn>")
_UNESCAPE = re.compile(r"\\(.)", re.S)
#: What may end a role or a text: the control string itself, met outside of an escape.
_ROLE_END, _TEXT_END = re.compile(r"\\.|: ", re.S), re.compile(r"\\.|</turn>", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def numbered(rows: DataFrame, ranges: int | None = None) -> DataFrame:
    """(conv_id, message, role, text): rows (conv_id, turn, role, text) as messages from 0 on, one a row.

    Rows are in order of turn, those without one last; rows that tie, repeated
    ones too, are in order of role and text, each a message of its own. Rows are
    counted over ranges of (conv_id, turn, role, text), so no task holds a
    conversation, nor the rows of one turn.
    """
    ev = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    placed = running(ev, ["conv_id"], [F.asc_nulls_last("turn"), F.asc("role"), F.asc("text")], {"message": F.lit(1).cast("long")}, ranges)
    return placed.select("conv_id", "message", "role", "text")


def logged(messages: DataFrame) -> DataFrame:
    """An event log whose fold() is the messages (conv_id, message, role, text).

    An assistant's message is begun, regenerated and streamed in two deltas;
    anyone else's is sent as a draft, its first half, and edited.
    """
    half = F.floor(F.char_length("text") / 2).cast("int")
    head, tail = F.substring(F.col("text"), F.lit(1), half), F.substring(F.col("text"), half + 1, F.char_length("text"))
    event = lambda n, kind, text: F.struct(F.lit(n).alias("n"), F.lit(kind).alias("kind"), text.alias("text"))
    streamed = F.array(event(0, "delta", tail), event(1, "regenerate", F.lit("")), event(2, "delta", head), event(3, "delta", tail))
    edited = F.array(event(0, "message", head), event(1, "edit", F.col("text")))
    each = messages.withColumn("e", F.explode(F.when(F.col("role") == "assistant", streamed).otherwise(edited)))
    return each.select("conv_id", (F.col("message") * 4 + F.col("e.n")).alias("seq"), "message", "e.kind", "role", "e.text")


def fold(events: DataFrame, block: int = 1024) -> DataFrame:
    """(conv_id, message, role, text, alive): the final messages. block: message numbers taken together."""
    ev = events.select("conv_id", "seq", "message", F.coalesce("kind", F.lit("message")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ev = ev.withColumn("block", F.floor(F.col("message") / block))
    resets = ev.where(F.col("kind").isin("edit", "regenerate"))
    by_message = resets.groupBy("conv_id", "block", "message").agg(F.max("seq").alias("reset"))
    by_block = resets.groupBy("conv_id", "block").agg(F.max("seq").alias("reset"))
    # What holds for a block's first message: the latest reset of any block before it.
    known = ev.groupBy("conv_id", "block").agg(F.lit(1).alias("one")).drop("one").join(by_block.withColumnRenamed("conv_id", "rc").withColumnRenamed("block", "rb"), (F.col("conv_id").eqNullSafe(F.col("rc"))) & (F.col("block").eqNullSafe(F.col("rb"))), "left")
    ahead = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    entry = known.select("conv_id", "block", F.max("reset").over(ahead).alias("entry"))
    messages = ev.groupBy("conv_id", "block", "message").agg(
        F.sort_array(F.collect_list(F.struct("seq", "kind", "text", "role"))).alias("log"),
        F.max(F.when(F.col("kind").isin("edit", "regenerate"), F.col("seq"))).alias("reset"),
    )
    messages = messages.join(entry.select(F.col("conv_id").alias("ec"), F.col("block").alias("eb"), "entry"), F.col("conv_id").eqNullSafe(F.col("ec")) & F.col("block").eqNullSafe(F.col("eb")), "left").drop("ec", "eb")
    upto = Window.partitionBy("conv_id", "block").orderBy("message").rowsBetween(Window.unboundedPreceding, 0)
    bar = F.greatest("entry", F.max("reset").over(upto))
    live = messages.withColumn("bar", bar).withColumn("log", F.filter("log", lambda e: F.col("bar").isNull() | (e["seq"] >= F.col("bar"))))
    live = live.where(F.size("log") > 0)
    final = F.aggregate("log", F.lit(""), lambda acc, e: F.when(e["kind"] == "edit", e["text"]).when(e["kind"] == "regenerate", F.lit("")).otherwise(F.concat(acc, e["text"])))
    return live.select("conv_id", "message", F.col("log")[0]["role"].alias("role"), final.alias("text"))


def render(messages: DataFrame, block: int = 256) -> DataFrame:
    """(conv_id, block, formatted, loss): the written turns of each block of message numbers, and the loss mask's spans."""
    ship(messages.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            roles, texts = ([x or "" for x in rows.column(k).to_pylist()] for k in (2, 3))
            heads = [f"{OPEN}{escape(r)}{MIDDLE}" for r in roles]
            written = [f"{h}{escape(t)}{CLOSE}\n" for h, t in zip(heads, texts)]
            ends = [len(w) - len(CLOSE) - 1 for w in written]
            made = [pa.array(written, pa.string()), pa.array([len(h) for h in heads], pa.int32()), pa.array(ends, pa.int32()), pa.array([r == "assistant" for r in roles], pa.bool_())]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *made], ["conv_id", "message", "turn", "start", "end", "on"])

    kind = messages.schema["conv_id"].dataType.simpleString()
    turns = messages.select("conv_id", F.col("message").cast("long").alias("message"), "role", "text").mapInArrow(write, f"conv_id {kind}, message long, turn string, start int, end int, on boolean")
    packed = turns.groupBy("conv_id", F.floor(F.col("message") / block).alias("block")).agg(F.sort_array(F.collect_list(F.struct("message", "turn", "start", "end", "on"))).alias("t"))
    spans = F.aggregate(
        "t",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans")),
        lambda acc, x: F.struct((acc["at"] + F.char_length(x["turn"])).alias("at"), F.when(x["on"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + x["start"]).alias("start"), (acc["at"] + x["end"]).alias("end"))))).otherwise(acc["spans"]).alias("spans")),
        lambda acc: acc["spans"],
    )
    return packed.select("conv_id", "block", F.array_join(F.transform("t", lambda x: x["turn"]), "").alias("formatted"), spans.alias("loss"))


def _ends(mark: re.Pattern, text: str, at: int) -> int:
    """Where the first mark outside of an escape stands, -1 if nowhere; one match is held at a time, so a long text costs no more than itself."""
    return next((m.start() for m in mark.finditer(text, at) if m[0][0] != "\\"), -1)


def read(formatted: str, loss) -> tuple[list[tuple[str, str]], list[str]]:
    """Turns (role, text) and the texts under the loss mask, of one block."""
    turns, at = [], 0
    while at < len(formatted):
        colon = _ends(_ROLE_END, formatted, at + len(OPEN)) if formatted.startswith(OPEN, at) else -1
        close = _ends(_TEXT_END, formatted, colon + len(MIDDLE)) if colon >= 0 else -1
        if close < 0:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(formatted[at + len(OPEN) : colon]), unescape(formatted[colon + len(MIDDLE) : close])))
        at = close + len(CLOSE) + 1
    return turns, [unescape(formatted[s["start"] : s["end"]]) for s in loss]


def digests(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), all read back from the blocks.

    Blocks go by in order of conversation and block; what is kept is the state of
    two hashes.
    """
    ship(formatted.sparkSession)
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, known = None, [], None

        def batch() -> pa.RecordBatch:
            rows = [(n, a.hexdigest(), k, b.hexdigest(), m) for _, n, a, k, b, m in out]
            columns = [pa.array([x[0] for x in out], known), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())))]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        for rows in batches:
            known = rows.column(0).type
            for conv, text, loss in zip(*(rows.column(k).to_pylist() for k in range(3))):
                if now is None or now[0] != conv:
                    if now is not None:
                        out.append(now)
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                turns, masked = read(text, loss)
                for role, said in turns:
                    now[2].update(f"{role}\n{said}\n".encode())
                for said in masked:
                    now[3] += len(said)
                    now[4].update(said.encode())
                now[1] += len(turns)
                now[5] += len(text)
            if len(out) > 4096:
                yield batch()
        if now is not None:
            out.append(now)
            yield batch()

    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    names = [c.split()[0] for c in schema.split(", ")]
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "block").select("conv_id", "formatted", "loss")
    return ordered.mapInArrow(taken, schema)
