"""SimHash near-duplicates: fingerprints of word shingles, linked by pigeonhole blocks.

fingerprints() takes whole texts. link() cuts the 64 bits into distance + 1
blocks, so that two fingerprints within the distance agree on one of them, joins
on blocks and verifies the Hamming distance. Equal fingerprints are one node, so
a group of copies costs no pairs. A block value that many different fingerprints
share (more than crowd) is not paired: there every fingerprint names all
fingerprints within half the distance of it, and two of them are within the
distance exactly if they name a common one. Those who name it are at most as
many as it has such neighbours, whatever the group's size, and all of them are
within the distance of each other, so hanging them on the smallest loses no
component.

Edge cases: null and empty texts have fingerprint 0 and link like any other; a
text with fewer words than a shingle has one shingle, all its words. Repeated
rows come out once each. Nodes are fingerprints, not ids: rows that share an id but
not a text are linked by their texts alone, so an id may be in several components. An empty table gives an empty result. Other columns of
the input are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.components import connected_components
from driftline.session import durable, ship


def _fingerprint(text: str, words: int, seed: int, block: int = 1 << 16) -> int:
    import numpy as np
    import xxhash

    parts = text.encode("utf-8").lower().split()  # bytes: only A-Z, and only x20 and x09-x0D
    if not parts:
        return 0
    n = max(1, len(parts) - words + 1)
    runs = map(b" ".join, zip(*(islice(parts, k, None) for k in range(words)))) if len(parts) >= words else iter([b" ".join(parts)])
    hashes = map(partial(xxhash.xxh64_intdigest, seed=seed), runs)
    ones = np.zeros(64, np.int64)
    while len(some := np.fromiter(islice(hashes, block), np.uint64)):
        bits = np.unpackbits(some.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for k in range(0, len(bits), 240):
            ones += bits[k : k + 240].sum(axis=0, dtype=np.uint8)
    out = int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])
    return out - (1 << 64) if out >> 63 else out


def fingerprint(text: Column, words: int = 5, seed: int = 42) -> Column:
    """The 64-bit SimHash of a text, as a signed long."""

    @F.arrow_udf("long")
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([_fingerprint(t.as_py() or "", words, seed) for t in texts], pa.int64())

    return made(text)


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 5, seed: int = 42) -> DataFrame:
    """(id, fp) of every row."""
    ship(docs.sparkSession)
    return docs.select(F.col(id), fingerprint(F.col(text), words, seed).alias("fp"))


def link(nodes: DataFrame, distance: int = 2, crowd: int = 64) -> DataFrame:
    """Edges (a, b) between the nodes (fp, node), one row a different fingerprint, that connect all pairs within the distance.

    distance is even: half of it is what a fingerprint is moved by in crowded blocks.
    """
    if distance % 2:
        raise ValueError("distance must be even")
    nodes = nodes.select("fp", "node")
    n = distance + 1
    cuts = [64 * k // n for k in range(n + 1)]
    block = [F.struct(F.lit(k).alias("k"), F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1 if hi - lo < 64 else -1)).alias("v")) for k, (lo, hi) in enumerate(zip(cuts, cuts[1:]))]
    keyed = nodes.select("fp", "node", F.explode(F.array(*block)).alias("b")).select("fp", "node", "b.k", "b.v")
    shared = durable(keyed.groupBy("k", "v").agg(F.count("*").alias("n")).where("n > 1"))
    keyed = durable(keyed.join(shared, ["k", "v"]))
    few = keyed.where(F.col("n") <= crowd)
    x, y = few.alias("x"), few.alias("y")
    pairs = x.join(y, [F.col("x.k") == F.col("y.k"), F.col("x.v") == F.col("y.v"), F.col("x.fp") < F.col("y.fp"), F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= distance])
    pairs = pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    masks = [sum(1 << i for i in bits) for r in range(distance // 2 + 1) for bits in combinations(range(64), r)]
    masks = F.array(*(F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in masks))
    crowded = keyed.where(F.col("n") > crowd).select("fp", "node").distinct()
    named = crowded.select("node", F.explode(masks).alias("mask"), "fp").select("node", F.col("fp").bitwiseXOR(F.col("mask")).alias("at"))
    met = named.groupBy("at").agg(F.min("node").alias("a"), F.collect_list("node").alias("all")).where(F.size("all") > 1)
    stars = met.select("a", F.explode("all").alias("b")).where("a != b")
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 5, seed: int = 42, distance: int = 2) -> DataFrame:
    """(id, fingerprint, component_id): each row's fingerprint in hex and the smallest id reachable over links."""
    fps = durable(fingerprints(docs, id, text, words, seed))
    nodes = durable(fps.groupBy("fp").agg(F.min(id).alias("least")))
    found = durable(connected_components(link(nodes.select("fp", F.col("fp").alias("node")), distance)))
    sets = nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("set"))
    sets = durable(sets)
    named = durable(sets.join(sets.groupBy("set").agg(F.min("least").alias("component_id")), "set").select("fp", "component_id"))
    return fps.join(named, "fp").select(id, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
