"""Prefix trie of conversations.

A node of depth d is a sequence of d turns that conversations begin with; those
are its members. Every conversation has a chain of SHA-256 digests, one for each
of its prefixes, so that equal prefixes have equal digests: prefixes are exploded
and grouped by (depth, digest) into nodes.

Chain: the digest of a turn t is c(d) = SHA-256(c(d-1) + t), within a block of
`BLOCK` turns; a block starts from nothing, and its prefixes after the first block
are hashed once more behind the chain over the last digests of the blocks before.
So the blocks of one long conversation are the work of many tasks.

Subtree sums: every node goes to all its ancestors. A node is called after its
smallest member; the nodes of one name are a run of neighbouring depths, from
where their member leaves smaller ones to its end. As a run hangs below any
ancestor as a whole, runs are exploded to the runs above, once to each, at the
depth where they leave it, and sums within a run are taken along it. A run has no
more ancestor runs than its conversation has turns, so the explosion never has
more rows than there are prefixes; with single nodes it would be square in the
length of a conversation.

Edge cases: turns are in order of turn number, those without one first; turns that
tie, repeated ones too, are in order of their digest (equal ones are told apart
by place), each a turn. Null roles and texts are empty. Rows without a conv_id
belong to no conversation and are left out. No conversation, no node: without
any, not even the root is there. Extra columns are dropped.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.streams import ordered_sha256
from driftline.plans.scans import running
from driftline.session import ship, table

BLOCK = 1024
#: Turns that a conversation takes from another one are fewer than this.
HEADS = 9


def turn_digest(role: Column, text: Column) -> Column:
    """SHA-256 of "characters of the role:role" and the text: no two turns have one string."""
    return F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))


def placed(rows: DataFrame) -> DataFrame:
    """(conv_id, place, digest, bytes): the turns of each conversation, numbered from 0, and the UTF-8 bytes of their texts."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = rows.where("conv_id is not null").select("conv_id", F.col("turn").alias("turn"), turn_digest(role, text).alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    return running(turns, ["conv_id"], [F.asc_nulls_first("turn"), F.asc("digest")], {"place": F.lit(1).cast("long")}).drop("turn")


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, place, digest, bytes) and conversations (conv_id, turns), each begun by another one's turns.

    Conversation c has the first h turns of conversation c - c % 5 and then its own
    after the first h, h being crc32 of its number in decimal, modulo 9. Remainders
    of negative numbers are taken as positive ones, so five neighbours share a head.
    """
    own = table(placed(rows))
    convs = own.groupBy("conv_id").agg(F.count("*").alias("own"))
    first = own.where(F.col("place") < HEADS).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("place", "digest", "bytes"))).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    convs = convs.select("conv_id", "own", h.alias("h"), (F.col("conv_id") - F.pmod("conv_id", F.lit(5))).alias("base")).join(first, "base", "left")
    taken = F.coalesce(F.slice("head", 1, F.col("h")), F.array().cast("array<struct<place:bigint,digest:binary,bytes:bigint>>"))
    convs = convs.select("conv_id", "own", "h", taken.alias("taken"))
    led = convs.select("conv_id", F.explode("taken").alias("t")).select("conv_id", "t.place", "t.digest", "t.bytes")
    after = own.join(convs.select("conv_id", "h", F.size("taken").alias("k")), "conv_id").where("place >= h")
    turns = led.unionByName(after.select("conv_id", (F.col("k") + F.col("place") - F.col("h")).cast("long").alias("place"), "digest", "bytes"))
    return turns, convs.select("conv_id", (F.size("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).cast("long").alias("turns"))


def _chain(digests) -> list[bytes]:
    out, last = [], b""
    for d in digests:
        last = hashlib.sha256(last + bytes(d)).digest()
        out.append(last)
    return out


def _chains(digests: pd.Series) -> pd.Series:
    return digests.map(_chain)


def chained(digests: Column) -> Column:
    return F.pandas_udf(_chains, "array<binary>")(digests)


def prefixes(turns: DataFrame, convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, depth, digest, bytes, ends): every prefix of every conversation, the empty one too; bytes are its last text's."""
    ship(turns.sparkSession)
    parts = turns.groupBy("conv_id", F.floor(F.col("place") / block).alias("block")).agg(F.sort_array(F.collect_list(F.struct("place", "digest", "bytes"))).alias("t"))
    parts = table(parts.select("conv_id", "block", chained(F.transform("t", lambda x: x["digest"])).alias("chain"), F.transform("t", lambda x: x["bytes"]).alias("bytes")))
    several = parts.join(convs.where(F.col("turns") > block), "conv_id", "left_semi")
    lasts = several.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("block", F.element_at("chain", -1).alias("last")))), lambda x: x["last"]).alias("lasts"))
    before = lasts.select("conv_id", F.posexplode(chained(F.col("lasts"))).alias("n", "carry")).select("conv_id", (F.col("n") + 1).cast("long").alias("block"), "carry")
    each = parts.join(before, ["conv_id", "block"], "left").select("conv_id", "block", "carry", F.posexplode(F.arrays_zip("chain", "bytes")).alias("n", "x"))
    digest = F.when(F.col("carry").isNull(), F.col("x.chain")).otherwise(F.unhex(F.sha2(F.concat("carry", "x.chain"), 256)))
    each = each.select("conv_id", (F.col("block") * block + F.col("n") + 1).alias("depth"), digest.alias("digest"), "x.bytes")
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.unhex(F.lit(hashlib.sha256(b"").hexdigest())).alias("digest"), F.lit(0).cast("long").alias("bytes"))
    return root.unionByName(each).join(convs, "conv_id").select("conv_id", "depth", "digest", "bytes", (F.col("depth") == F.col("turns")).alias("ends"))


def trie(turns: DataFrame, convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, prefix_sha256), one row a node.

    turns: (conv_id, place from 0, digest, bytes). convs: (conv_id, turns), also
    those without any. saved_tokens counts UTF-8 bytes: what a store that keeps
    each node's last text once has less to keep.
    """
    every = table(prefixes(turns, convs, block))
    nodes = every.groupBy("depth", "digest").agg(F.min("conv_id").alias("name"), F.count("*").alias("n_convs"), F.count_if("ends").alias("n_ends"), F.max("bytes").alias("bytes"))
    nodes = nodes.withColumn("saves", (F.col("n_convs") - 1) * F.col("bytes")).withColumn("leaf", (F.col("n_convs") == F.col("n_ends")).cast("long")).drop("bytes")
    nodes = table(nodes)
    named = every.select("conv_id", "depth", "digest", "ends").join(nodes.select("depth", "digest", "name", "saves", "leaf"), ["depth", "digest"])
    # One row for each conversation and each run on its path: its own run, and those above it with the depth where it leaves them.
    met = table(named.groupBy("conv_id", "name").agg(F.min("depth").alias("top"), F.max("depth").alias("deep"), F.sum("saves").alias("saves"), F.sum("leaf").alias("leaves")))
    own = met.where("conv_id = name").drop("name")
    above = met.where("conv_id <> name").select("conv_id", F.col("name").alias("above"), F.col("deep").alias("left_at"))
    hung = above.join(own, "conv_id")
    below = hung.groupBy(F.col("above").alias("name"), F.col("left_at").alias("depth")).agg(F.sum("saves").alias("b_saves"), F.sum("leaves").alias("b_leaves"), F.count_if(F.col("left_at") == F.col("top") - 1).alias("b_children"))
    parents = hung.where("left_at = top - 1").select(F.col("conv_id").alias("name"), "above")
    runs = own.select(F.col("conv_id").alias("name"), "top", "deep").join(parents, "name", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    full = nodes.join(runs, "name").join(below, ["name", "depth"], "left")
    full = full.select(
        "name", "depth", "digest", "n_convs", "n_ends",
        F.when(F.col("depth") > F.col("top"), F.col("name")).otherwise(F.col("above")).alias("parent_conv_id"),
        (zero("b_children") + (F.col("depth") < F.col("deep")).cast("long")).alias("n_children"),
        (F.col("leaf") + zero("b_leaves")).alias("leaves"), (F.col("saves") + zero("b_saves")).alias("saves"),
        F.floor(F.col("depth") / block).alias("block"),
    )
    full = table(full)
    # Sums along a run, from its end up: within blocks of depths, and what the blocks below hold.
    deeper = Window.partitionBy("name").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = full.groupBy("name", "block").agg(F.sum("leaves").alias("leaves"), F.sum("saves").alias("saves"))
    carry = blocks.select("name", "block", F.sum("leaves").over(deeper).alias("c_leaves"), F.sum("saves").over(deeper).alias("c_saves")).where("c_leaves is not null")
    along = Window.partitionBy("name", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    full = full.withColumn("leaves", F.sum("leaves").over(along)).withColumn("saves", F.sum("saves").over(along)).join(carry, ["name", "block"], "left")
    ended = named.where("ends").select("name", "depth", "conv_id")
    ends = ordered_sha256(ended, ["name", "depth"], ["conv_id"], F.col("conv_id").cast("string"), ",", "ends_sha256")
    return full.join(ends, ["name", "depth"], "left").select(
        F.col("name").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", (F.col("leaves") + zero("c_leaves")).alias("n_leaves"), (F.col("saves") + zero("c_saves")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), F.lower(F.hex("digest")).alias("prefix_sha256"),
    )
