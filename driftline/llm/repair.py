"""Conversation structure repair: the cheapest edits that make roles alternate.

Roles, by their first characters, shall read (s?(ua)+)?. Reading a conversation's
rows is a walk through a lattice of (rows read, state of the grammar), made while
it is walked: keep a row (cost 0), give it the role user or assistant (2), delete it
(3; blank and repeated rows must go), or insert an empty row of user or assistant
(2) anywhere; a truncated row that stays adds 1. Dijkstra's search goes by (cost,
audit), audit being the initials of the edits so far, and stops at the first end
node taken from the queue in which the grammar accepts. A state and an initial
give one next state, so an audit is one walk; no audit of a node begins another
one of the same cost, so the least one of a node goes on as the least.

Scale: a row comes into the search as one character, which says its initial and
its fault. A conversation is searched by blocks of `BLOCK` rows, from each state
to each state, blocks apart from each other; an audit in a queue is never longer
than a block's. Blocks of long conversations are then put together by the least
costs to go. For that, a block that is not the last ends with a row's edit
(inserted rows lead the next block), so that no audit of a block begins another one
and a tie is decided in the first block where audits differ. Equal blocks are
searched once a worker. Texts are not in the search; they meet the edits again by
the row's place.

Edge cases: null roles and texts are one blank, so a null text is a blank row; rows
are in order of turn, those without one first, rows of one turn by role and text;
rows without a conv_id are one conversation. An initial other than s, u and a is
never kept. Conversations without rows are given in the report with zeros. Extra
columns are dropped.
"""

from __future__ import annotations

import hashlib
import heapq
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.streams import ordered_sha256
from driftline.plans.scans import running
from driftline.session import ship, table

BLOCK = 512
#: A row's character: its initial (s, u, a, other) by what is wrong with it (nothing, truncated, must go).
CODES = "suaoSUAO1234"
#: States of the grammar: nothing read, a system row, a user row, an assistant row; the initial that leads from one to the next.
START, ACCEPTING = 0, (0, 3)
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
EDITS = "array<struct<s:int,t:int,cost:bigint,audit:string,roles:string>>"
WAYS = "array<struct<block:bigint,s:int,t:int>>"
OTHER_THAN_SPACE = r"[^\x20\x09-\x0D]"


def _moves(code: str | None, state: int, insert: bool):
    """(edit, initial of the row that is left or "-", cost, rows read, next state)."""
    by = NEXT[state]
    if code is not None:
        wrong, initial = divmod(CODES.index(code), 4)
        yield "D", "-", 3, 1, state
        if wrong < 2:
            if (now := "suao"[initial]) in by:
                yield "K", now, wrong, 1, by[now]
            for r in by.keys() & {"u", "a"}:
                yield "R", r, 2 + wrong, 1, by[r]
    if insert:
        for r in by.keys() & {"u", "a"}:
            yield "I", r, 2, 0, by[r]


def _search(codes: str, start: int, goals: tuple[int, ...], first_only: bool) -> list[tuple[int, int, int, str, str]]:
    """(start, end state, cost, audit, roles) of the end nodes among goals in the order in which they leave the queue.

    first_only: the block is the last one; the search ends at the first of the
    goals, and rows may be inserted behind the last row.
    """
    n, queue, seen, out = len(codes), [(0, "", 0, start, "")], set(), []
    while queue:
        cost, audit, at, state, roles = heapq.heappop(queue)
        if (at, state) in seen:
            continue
        seen.add((at, state))
        if at == n and state in goals:
            out.append((start, state, cost, audit, roles))
            if first_only or len(out) == len(goals):
                break
        for edit, initial, more, read, then in _moves(codes[at] if at < n else None, state, at < n or first_only):
            if (at + read, then) not in seen:
                heapq.heappush(queue, (cost + more, audit + edit, at + read, then, roles + initial))
    return out


@lru_cache(1 << 14)
def walks(codes: str, first: bool, last: bool) -> list[tuple[int, int, int, str, str]]:
    """The walks through a block: from the start or from each state, to the best accepting end or to each state."""
    return [w for s in ((START,) if first else range(4)) for w in _search(codes, s, ACCEPTING if last else (0, 1, 2, 3), last)]


def block_walks(codes: pd.Series, first: pd.Series, last: pd.Series) -> pd.Series:
    named = ("s", "t", "cost", "audit", "roles")
    return pd.Series([[dict(zip(named, w)) for w in walks(c, bool(f), bool(z))] for c, f, z in zip(codes, first, last)])


def _through(options: list[list[tuple[int, int, int, int]]]) -> list[tuple[int, int]]:
    """(s, t) of each block on the cheapest way through all; options: (s, t, cost, place of its audit among those from s)."""
    togo: list[dict] = [{None: 0}]
    for k, block in enumerate(reversed(options)):
        best: dict = {}
        for s, t, cost, _ in block:
            rest = togo[-1].get(None if k == 0 else t)
            if rest is not None and cost + rest < best.get(s, 1 << 62):
                best[s] = cost + rest
        togo.append(best)
    togo.reverse()
    out, state = [], START
    for k, block in enumerate(options):
        rest = togo[k + 1]
        s, t, _, _ = min((x for x in block if x[0] == state and (None if k + 1 == len(options) else x[1]) in rest), key=lambda x: (x[2] + rest[None if k + 1 == len(options) else x[1]], x[3]))
        out.append((s, t))
        state = t
    return out


def ways(blocks: pd.Series) -> pd.Series:
    """Blocks of each conversation, in order, as (block, [(s, t, cost, rank)])."""
    return blocks.map(lambda of: [{"block": b["block"], "s": s, "t": t} for b, (s, t) in zip(of, _through([[(o["s"], o["t"], o["cost"], o["rank"]) for o in b["options"]] for b in of]))])


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy): rows damaged by crc32("conv_id:turn") modulo 20.

    0 drops a row, 1 empties its text, 2 takes full stops, exclamation and question
    marks out, 3 repeats it, 4 gives it the role user. Nulls count as one blank.
    """
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    n = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), n.alias("n")).where("n <> 0")
    text = F.when(F.col("n") == 1, "").when(F.col("n") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("n") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("n") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))


def judged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, place, fault): rows in order, numbered from 0, each with its first fault or null."""
    filled = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    ev = rows.select("conv_id", F.col("turn"), filled("role"), filled("text"))
    said = F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    ev = table(running(ev, ["conv_id"], [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")], {"place": F.lit(1).cast("long")}).withColumn("said", said))
    firsts = ev.groupBy("conv_id", "said").agg(F.min("place").alias("place")).select(F.col("conv_id").alias("f_conv"), F.col("place").alias("f_place"))
    ev = ev.join(firsts, F.col("conv_id").eqNullSafe(F.col("f_conv")) & (F.col("place") == F.col("f_place")), "left")
    fault = F.when(~F.col("text").rlike(OTHER_THAN_SPACE), "blank").when(F.col("f_place").isNull(), "duplicate").when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
    return ev.select("conv_id", "turn", "role", "text", "place", fault.alias("fault"))


def edits(judged_rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, block, n, edit, initial, place, cost): each edit in order (block, n); place is that of the row it is about, null for an insertion.

    cost is the whole cost of the edit's block, on its first edit; null on others.
    """
    ship(judged_rows.sparkSession)
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3) + F.when(F.col("fault") == "truncated", 4).when(F.col("fault").isNull(), 0).otherwise(8)
    rows = judged_rows.select("conv_id", "place", F.substring(F.lit(CODES), code + 1, F.lit(1)).alias("code"))
    packed = rows.groupBy("conv_id", F.floor(F.col("place") / block).alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "code"))), lambda x: x["code"]), "").alias("codes"))
    ends = packed.groupBy(F.col("conv_id").alias("e_conv")).agg(F.max("block").alias("final"))
    packed = packed.join(ends, F.col("conv_id").eqNullSafe(F.col("e_conv"))).drop("e_conv")
    packed = table(packed.withColumn("walks", F.pandas_udf(block_walks, EDITS)("codes", F.col("block") == 0, F.col("block") == F.col("final"))))
    alone = packed.where("final = 0").select("conv_id", "block", F.col("walks")[0].alias("w"))
    long = packed.where("final > 0")
    rank = F.transform("walks", lambda o: F.struct(o["s"], o["t"], o["cost"], F.size(F.filter("walks", lambda p: (p["s"] == o["s"]) & (p["audit"] < o["audit"]))).alias("rank")))
    chosen = long.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", rank.alias("options")))).alias("of")).select("conv_id", F.explode(F.pandas_udf(ways, WAYS)("of")).alias("c"))
    chosen = chosen.select(F.col("conv_id").alias("c_conv"), F.col("c.block").alias("c_block"), F.col("c.s").alias("c_s"), F.col("c.t").alias("c_t"))
    met = long.join(chosen, F.col("conv_id").eqNullSafe(F.col("c_conv")) & (F.col("block") == F.col("c_block")))
    met = met.select("conv_id", "block", F.filter("walks", lambda o: (o["s"] == F.col("c_s")) & (o["t"] == F.col("c_t")))[0].alias("w"))
    walked = alone.unionByName(met)
    each = walked.select("conv_id", "block", "w", F.posexplode(F.split("w.audit", "(?!^)")).alias("n", "edit")).where("edit <> ''")
    read = F.char_length(F.translate(F.substring(F.col("w.audit"), F.lit(1), F.col("n") + 1), "I", ""))
    return each.select(
        "conv_id", "block", "n", "edit", F.substring(F.col("w.roles"), F.col("n") + 1, F.lit(1)).alias("initial"),
        F.when(F.col("edit") != "I", F.col("block") * block + read - 1).alias("place"), F.when(F.col("n") == 0, F.col("w.cost")).alias("cost"),
    )


def repaired(judged_rows: DataFrame, made: DataFrame) -> DataFrame:
    """(conv_id, block, n, edit, role, text): the conversations after the edits, in order (block, n); deleted rows are gone."""
    left = made.where("edit <> 'D'")
    rows = judged_rows.select(F.col("conv_id").alias("r_conv"), F.col("place").alias("r_place"), F.col("role").alias("old"), "text")
    met = left.join(rows, F.col("conv_id").eqNullSafe(F.col("r_conv")) & (F.col("place") == F.col("r_place")), "left")
    role = F.when(F.col("edit") == "K", F.col("old")).when(F.col("initial") == "u", "user").otherwise("assistant")
    return met.select("conv_id", "block", "n", "edit", role.alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def report(original: DataFrame, rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation of `original`, whose rows now are `rows`."""
    known = table(judged(rows))
    of = lambda fault: F.count_if(F.col("fault") == fault).alias(fault)
    faults = known.groupBy("conv_id").agg(of("blank"), of("duplicate"), of("truncated"))
    turns = known.groupBy("conv_id", "turn").count().groupBy("conv_id").agg((F.coalesce(F.max("turn") - F.min("turn") + 1, F.lit(0)) - F.count("turn")).cast("long").alias("gaps"))
    initial = F.substring("role", 1, 1)
    here = known.select("conv_id", "place", initial.alias("second"))
    before = known.select(F.col("conv_id").alias("b_conv"), (F.col("place") + 1).alias("b_place"), initial.alias("first"))
    pairs = here.join(before, F.col("conv_id").eqNullSafe(F.col("b_conv")) & (F.col("place") == F.col("b_place")))
    illegal = pairs.groupBy("conv_id").agg(F.count_if(~F.concat("first", "second").isin("su", "ua", "au")).alias("illegal"))
    made = table(edits(known, block))
    audits = made.groupBy("conv_id", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "edit"))), lambda x: x["edit"]), "").alias("audit"), F.sum("cost").alias("cost"))
    audits = audits.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"]), "").alias("audit"), F.sum("cost").alias("cost"))
    hashes = ordered_sha256(repaired(known, made), ["conv_id"], ["block", "n"], F.concat("role", F.lit(":"), "text"), "\n", "repaired_sha256")
    out = original.select("conv_id").distinct()
    for k, part in enumerate((faults, turns, illegal, audits, hashes)):
        out = out.join(part.withColumnRenamed("conv_id", f"conv_{k}"), F.col("conv_id").eqNullSafe(F.col(f"conv_{k}")), "left").drop(f"conv_{k}")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
