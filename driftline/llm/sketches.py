"""Wide SimHash fingerprints, for near-duplicates by similarity instead of a few bits.

A 64-bit fingerprint tells texts of Jaccard similarity 0.8 apart by about ten
bits, more than blocks can guarantee. Here a text's set of word shingles is
projected on many random directions, and the signs are its bits; what a shingle
adds to them is drawn from its own hash, so texts agree by their words alone. Two
texts of similarity J differ in arccos(2J / (1 + J)) / pi of the bits on average.

Candidates share one of 23 keys (bands()), each the hash of six min-hashes of the
set. Two sets of similarity J share a min-hash with probability J whatever their
size, and so a key with probability 1 - (1 - J^6)^23: 0.9990 at 0.8, 0.9999 at
0.85. That does not depend on the number of texts, and unrelated texts share none
by chance.

Candidates near enough by the Hamming distance of their fingerprints are verified:
the 64-bit hashes of their shingles, as sets, must have the similarity. The
distance only filters (wide()): it allows a quarter more than the share above,
which small sets need (four shingles against five differ in 3/16 of the bits), and
5 standard errors.

Tables of fingerprints alone (link() without keys) have blocks of their bits for
keys; shape() gives the blocks for a number of texts and a recall.

What is joined on a key carries 64 of the bits, taken from all over the
fingerprint. A pair goes on if these differ by no more than 4.5 standard errors
over the share allowed, which one pair in 300,000 at that share fails.

Equal sets of shingles are one node. A key that more nodes share than crowd
is not paired: all its nodes are compared with one of them, its hub, which links
those near to it in one star; only the others are compared with every node, in
cells of bounded size that answer with no more links than they have nodes. So a
group of near copies costs as many comparisons as it has members, unless they
are not alike after all, and no link is lost.

Edge cases: null and empty texts have no shingles and are one node; a text with
fewer words than a shingle has one. Rows with the same id and different texts
each have their set. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.components import connected_components
from driftline.session import durable, release, ship


def wide(similarity: float, bits: int) -> int:
    """Bits that hardly any texts of that similarity differ in more than, be they as short as can be."""
    share = 1.25 * math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(bits * share + 5 * math.sqrt(bits * share * (1 - share)))


def bands(similarity: float, recall: float = 0.999, rows: int = 6) -> int:
    """Keys of so many min-hashes that a pair just alike enough shares one of with that probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def shape(texts: int, similarity: float, least: int = 20, recall: float = 0.91) -> tuple[int, int]:
    """(bits, bits in a block): blocks for so many texts, and enough of them to find that share of pairs just alike enough."""
    block = max(least, math.ceil(math.log2(max(2, texts))))
    one = (1 - math.acos(2 * similarity / (1 + similarity)) / math.pi) ** block
    blocks = math.ceil(math.log(1 - recall) / math.log(1 - one))
    return -(-blocks * block // 64) * 64, block


def shingles(text: str, words: int) -> np.ndarray:
    """The distinct hashes of a text's word shingles, in order."""
    import xxhash

    parts = text.encode("utf-8").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    runs = map(b" ".join, zip(*(parts[k:] for k in range(words)))) if len(parts) >= words else [b" ".join(parts)]
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, runs), np.uint64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def signs(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The fingerprint of a set of hashes, packed in 64-bit integers; the signs of each hash are drawn from it alone."""
    steps = np.uint64(0x9E3779B97F4A7C15) * np.arange(1, bits // 64 + 1, dtype=np.uint64)
    ones = np.zeros(bits, np.int64)
    for at in range(0, len(hashes), 1024):
        some = _mixed(hashes[at : at + 1024, None] + steps)
        ones += np.unpackbits(some.view(np.uint8), axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(2 * ones > len(hashes)).view("<i8")


def minkeys(hashes: np.ndarray, n: int, rows: int = 6) -> np.ndarray:
    """n keys of a set of hashes, each of rows min-hashes; an empty set has none."""
    if not len(hashes):
        return np.empty(0, np.int64)
    seeds = _mixed(np.uint64(0xD1B54A32D192ED03) * np.arange(1, n * rows + 1, dtype=np.uint64))
    least = np.full(n * rows, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 1024):
        least = np.minimum(least, _mixed(hashes[at : at + 1024, None] ^ seeds).min(axis=0))
    return _mixed((least * (seeds | np.uint64(1))).reshape(n, rows).sum(axis=1, dtype=np.uint64)).view(np.int64)


def sketch(text: Column, words: int = 5, bits: int = 1280, keys: int = 23) -> Column:
    """A text's fingerprint, keys, and one hash of its whole set of shingles (node)."""

    @F.arrow_udf("struct<node:bigint,sk:array<bigint>,keys:array<bigint>>")
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import xxhash

        for texts in batches:
            sets = [shingles(t.as_py() or "", words) for t in texts]
            node = np.array([xxhash.xxh3_64_intdigest(h.tobytes()) for h in sets], np.uint64).view(np.int64)
            flat = np.concatenate([np.empty(0, np.int64), *(signs(h, bits) for h in sets)])
            sk = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, bits // 64), pa.int32()), pa.array(flat, pa.int64()))
            found = [minkeys(h, keys) for h in sets]
            sizes = np.cumsum([0, *map(len, found)])
            ks = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *found]), pa.int64()))
            yield pa.StructArray.from_arrays([pa.array(node, pa.int64()), sk, ks], ["node", "sk", "keys"])
        release()

    return made(text)


def _sets(text: Column, words: int) -> Column:
    """A text's set of shingle hashes."""

    @F.arrow_udf("array<bigint>")
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            sets = [shingles(t.as_py() or "", words).view(np.int64) for t in texts]
            sizes = np.cumsum([0, *map(len, sets)])
            yield pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *sets]), pa.int64()))
        release()

    return made(text)


def _differ(a: str, b: str, n: int) -> Column:
    """Bits that two fingerprints differ in."""
    out = F.lit(0)
    for k in range(n):
        out = out + F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k]))
    return out


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets have that Jaccard similarity."""
    few, many = sorted((len(a), len(b)))
    if few < similarity * many - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (few + many - both) - 1e-9


def _cell(most: int, similarity: float | None):
    def links(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        """Links between the nodes of two parts that are near enough, without those that others make needless."""
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        out = []
        if len(a) and len(b):
            others, ids = np.stack(b["sk2"].to_numpy()).view(np.uint64), b["node2"].to_numpy()  # bits are counted in unsigned numbers
            sets = None if similarity is None else b["set2"].to_numpy()
            for node, sk, mine in zip(a["node"], a["sk"], a["sk"] if similarity is None else a["set"]):
                for k in np.flatnonzero(np.bitwise_count(others ^ np.asarray(sk, np.int64).view(np.uint64)).sum(axis=1) <= most).tolist():
                    x, y = top(node), top(int(ids[k]))
                    if x != y and (sets is None or alike(mine, sets[k], similarity)):
                        up[max(x, y)] = min(x, y)
                        out.append((node, int(ids[k])))
        return pd.DataFrame(out, columns=["a", "b"])

    return links


def link(nodes: DataFrame, bits: int, most: int, block: int = 20, crowd: int = 12, part: int = 1024, similarity: float | None = None, sets=None) -> DataFrame:
    """Edges (a, b) between nodes (node, sk) that connect all candidate pairs within most bits.

    With a similarity, the bits only nominate: sets makes (node, set) of given
    nodes, and a pair is linked if its sets have the similarity. Nodes with keys
    are candidates by these, others by blocks of their bits.
    """
    n = bits // 64
    # Block k holds the bits from k * block on; it lies in one or two of the words.
    cuts = []
    for k in range(bits // block):
        word, at = divmod(k * block, 64)
        low = F.shiftrightunsigned(F.col("sk")[word], at)
        if at + block > 64:
            low = low.bitwiseOR(F.shiftleft(F.col("sk")[word + 1], 64 - at))
        cuts.append(F.struct(F.lit(k).alias("k"), low.bitwiseAND(F.lit((1 << block) - 1)).alias("v")))
    some = F.lit(0).cast("long")
    for k in range(n):
        mask = sum(1 << i for i in range(64) if i % n == k)
        some = some.bitwiseOR(F.col("sk")[k].bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)))
    share = most / bits
    far = math.floor(64 * share + 4.5 * math.sqrt(64 * share * (1 - share) * max(0.0, 1 - 64 / bits)))
    keyed = nodes.select("node", some.alias("some"), F.explode(F.array(*cuts)).alias("b")).select("node", "some", "b.k", "b.v")
    if "keys" in nodes.columns:
        keyed, nodes = nodes.select("node", some.alias("some"), F.posexplode("keys").alias("k", "v")), nodes.select("node", "sk")
    shared = durable(keyed.groupBy("k", "v").agg(F.count("*").alias("n")).where("n > 1"))
    keyed = durable(keyed.join(shared, ["k", "v"]))
    few = keyed.where(F.col("n") <= crowd)
    x, y = few.select("k", "v", F.col("node").alias("a"), F.col("some").alias("s")), few.select("k", "v", F.col("node").alias("b"), F.col("some").alias("t"))
    pairs = x.join(y, ["k", "v"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("s").bitwiseXOR(F.col("t"))) <= far)).select("a", "b")

    # Fingerprints join by node, once a pair; blocks move node numbers alone.
    crowded = keyed.where(F.col("n") > crowd).select("k", "v", "node")
    hubs = durable(crowded.groupBy("k", "v").agg(F.min("node").alias("hub")))
    seen = durable(crowded.join(hubs, ["k", "v"]))
    pairs = durable(pairs.unionByName(seen.where("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))).distinct())
    with_a = pairs.join(nodes.select(F.col("node").alias("a"), F.col("sk").alias("ska")), "a")
    near = durable(with_a.join(nodes.select(F.col("node").alias("b"), F.col("sk").alias("skb")), "b").where(_differ("ska", "skb", n) <= most).select("a", "b"))
    full = nodes.select("node", "sk")
    if similarity is not None:
        named = near.select(F.explode(F.array("a", "b")).alias("node"))
        found = durable(sets(named.unionByName(seen.select("node")).distinct()))
        full = full.join(found, "node")
        both, all = F.size(F.array_intersect("seta", "setb")), F.size("seta") + F.size("setb")
        with_a = near.join(found.toDF("a", "seta"), "a").join(found.toDF("b", "setb"), "b")
        near = durable(with_a.where(both >= similarity * (all - both) - 1e-9).select("a", "b"))
    rest = durable(seen.where("node != hub").join(near, (F.col("hub") == F.col("a")) & (F.col("node") == F.col("b")), "left_anti").select("k", "v", "node"))
    parts = lambda rows, name: rows.groupBy("k", "v").agg(F.ceil(F.count("*") / part).cast("int").alias(name))
    grid = durable(parts(rest, "pa").join(parts(seen, "pb"), ["k", "v"]))
    deal = lambda rows, own, other, mine, theirs: (
        rows.join(grid, ["k", "v"]).join(full, "node").withColumn(mine, F.pmod(F.xxhash64("node"), F.col(own)).cast("int")).withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).select("k", "v", "i", "j", *full.columns)
    )
    keys = ["k", "v", "i", "j"]
    every = deal(seen, "pb", "pa", "j", "i").toDF("k2", "v2", "i2", "j2", *(f"{c}2" for c in full.columns))
    cells = deal(rest, "pa", "pb", "i", "j").groupBy(keys).cogroup(every.groupBy("k2", "v2", "i2", "j2"))
    return near.unionByName(cells.applyInPandas(_cell(most, similarity), "a long, b long")).distinct()


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8, bits: int = 1280) -> DataFrame:
    """(id, component_id) of each row: the smallest id reachable over links of at least the similarity."""
    ship(docs.sparkSession)
    texts = docs.select(F.col(id).alias("id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    rows = durable(texts.withColumn("s", sketch(F.col("text"), words, bits, bands(similarity))).select("id", "mark", "s.*"))
    nodes = durable(rows.groupBy("node").agg(F.min("id").alias("low"), F.first("sk").alias("sk"), F.first("keys").alias("keys"), F.min(F.struct("id", "mark")).alias("from")))

    def sets(named: DataFrame) -> DataFrame:
        # One text a node, of the row that from names; rows that agree in id and text are told apart by no one.
        wanted = durable(nodes.join(named, "node").select("node", F.col("from.id").alias("from_id"), F.col("from.mark").alias("from_mark")))
        each = texts.join(wanted, F.col("id").eqNullSafe(F.col("from_id")) & (F.col("mark") == F.col("from_mark")))
        return each.dropDuplicates(["node"]).select("node", _sets(F.col("text"), words).alias("set"))

    edges = link(nodes.select("node", "sk", "keys"), bits, wide(similarity, bits), part=256, similarity=similarity, sets=sets)
    found = connected_components(edges)
    named = durable(nodes.join(found, "node", "left").select("node", "low", F.coalesce("component", "node").alias("c")))
    lows = durable(named.groupBy("c").agg(F.min("low").alias("component_id")))
    labelled = durable(named.join(lows, "c").select("node", "component_id"))
    return rows.join(labelled, "node").select(F.col("id").alias(id), "component_id")
