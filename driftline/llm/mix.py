"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

targets() shares the whole size out by weight, no source above a multiple of its
own size. mix() lays every source out as a line of draws: its documents in a
permuted order (a keyed hash), once for each full pass its target holds, then from
the start again as many as still fit and one more that comes nearest to the rest. The line is cut into blocks of
documents; a binary tree splits the blocks' counts between output shards, at
each node by one multivariate-hypergeometric draw, so each shard gets exact
counts that add up to the sources' own. A shard takes disjoint runs of the
permuted blocks and is shuffled by another keyed hash.

The order needs no task that sees a whole source: sizes are summed by ranges of
the hash, ranges are added up by source, and rows are summed within a range.
What the driver sees is one row a source (name, rows, size).

Every draw comes from the seed and the rows, so reruns agree. Edge cases: a null
text has size 0, a null source is a source of its own that sorts last; a source
without words has target 0; a table without words or rows gives zeros or
nothing. Repeated rows are drawn one by one. Extra columns pass through the
draws; those named like a column made here (HELPERS) give way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.session import durable, ship

WORD = r"[^\x20\x09-\x0D]+"
#: Names of columns that are made here; an input column of such a name gives way.
HELPERS = frozenset("id size h k docs source_size target passes rest more got last bucket before nth one draws draw block shard place w0 c0".split())


#: Sources, a row each, that are broadcast; more than that are joined as any table.
SMALL = 100_000


def _few(rows: DataFrame, n: int) -> DataFrame:
    """rows, broadcast if their number n is small."""
    return F.broadcast(rows) if n <= SMALL else rows


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def share(sizes: Sequence[int], weights: Sequence[float], most: float = 3.0) -> list[float]:
    """Targets that add up to all sizes, by weight; none above most times its own size."""
    caps, out = [most * s for s in sizes], [0.0] * len(sizes)
    rest, still = float(sum(sizes)), {i for i, s in enumerate(sizes) if s > 0}
    while still:
        total = sum(weights[i] for i in sorted(still))
        over = [i for i in still if rest * weights[i] / total > caps[i]]
        if not over:
            for i in still:
                out[i] = rest * weights[i] / total
            break
        for i in sorted(over):
            out[i] = caps[i]
            rest -= caps[i]
            still.discard(i)
    return out


def targets(sized: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), most: float = 3.0) -> DataFrame:
    """(source, k, docs, source_size, target) of sized (source, size); weights repeat over sources by code point, null last."""
    found = sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size")).collect()
    found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8")))
    goal = share([r["source_size"] for r in found], [weights[i % len(weights)] for i in range(len(found))], most)
    rows = [(r["source"], i, r["docs"], r["source_size"], g) for i, (r, g) in enumerate(zip(found, goal))]
    return sized.sparkSession.createDataFrame(rows, "source string, k int, docs long, source_size long, target double")


def lay_out(docs: DataFrame, seed: int = 7, weights: Sequence[float] = (5.0, 2.0, 1.0), most: float = 3.0, span: int = 4096, text: str = "text", id: str = "doc_id") -> tuple[DataFrame, dict[int, int]]:
    """Rows and the draws of each source by its number. Rows: docs with size, source_size, target, k (its source's number), nth (its place in its source's order) and draws.

    span: rows that a range of the hash holds on average; it bounds what one
    task orders at a time.
    """
    docs = docs.drop(*(c for c in docs.columns if c.lower() in HELPERS and c not in (id, text)))
    base = docs.withColumn("size", words(F.col(text))).withColumn("h", F.xxhash64(F.lit(seed), F.col(id), F.col(text)))
    light = durable(base.select(F.col(id).alias("id"), "source", "size", "h"))
    goal = targets(light, weights, most)
    few = goal.count()
    bits = max(0, math.ceil(math.log2(max(1, light.count() / span))))
    bucket = (F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long")).alias("bucket")
    placed = light.join(_few(goal.select("source", "k"), few), light["source"].eqNullSafe(goal["source"])).select("k", "id", "size", "h", bucket)
    sums = placed.groupBy("k", "bucket").agg(F.sum("size").alias("w"), F.count("*").alias("c"))
    ahead = Window.partitionBy("k").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = durable(sums.select("k", "bucket", F.coalesce(F.sum("w").over(ahead), F.lit(0)).alias("w0"), F.coalesce(F.sum("c").over(ahead), F.lit(0)).alias("c0")))
    within = Window.partitionBy("k", "bucket").orderBy("h", "id")

    def ordered(rows: DataFrame) -> DataFrame:
        """rows (k, bucket, h, id, size) with nth and before, the words ahead of each in its source's order."""
        joined = rows.join(sums, ["k", "bucket"])
        upto = F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0))
        return joined.withColumn("before", F.col("w0") + upto - F.col("size")).withColumn("nth", F.col("c0") + F.row_number().over(within) - 1).drop("w0", "c0")

    passes = F.coalesce(F.floor(F.col("target") / F.nullif("source_size", F.lit(0))), F.lit(0)).cast("long")
    goal = goal.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    fits = F.col("before") + F.col("size") <= F.col("rest")
    lined = durable(ordered(placed).join(_few(goal.select("k", "rest"), few), "k").withColumn("fits", fits))
    ahead = lined.groupBy("k").agg(F.sum(F.col("fits").cast("long")).alias("more"), F.sum(F.when(F.col("fits"), F.col("size")).otherwise(0)).alias("got"))
    goal = goal.join(ahead, "k")
    # One more document, the one that comes nearest to what is still missing.
    off = F.abs(F.col("rest") - F.col("got") - F.col("size"))
    last = lined.where("not fits").drop("rest").join(_few(goal.select("k", "rest", "got"), few), "k").where(off < F.col("rest") - F.col("got"))
    last = last.groupBy("k").agg(F.min(F.struct(off.alias("off"), "nth")).alias("best")).select("k", F.col("best.nth").alias("last"))
    plan = goal.join(last, "k", "left").collect()  # one row a source
    goal = sized_schema(docs.sparkSession, plan)
    named = base.join(_few(goal, few), base["source"].eqNullSafe(goal["source"])).drop(goal["source"]).withColumn("bucket", bucket)
    named = ordered(named.withColumn("id", F.col(id)))
    named = named.withColumn("one", F.when(fits, F.col("nth")).when(F.col("nth") == F.col("last"), F.col("more")))
    out = named.withColumn("draws", F.col("passes") + F.col("one").isNotNull().cast("long"))
    return out.drop("bucket", "before", "h", "rest", "got", *({"id"} - {id})), {r["k"]: r["passes"] * r["docs"] + r["more"] + (r["last"] is not None) for r in plan}


def sized_schema(spark, rows) -> DataFrame:
    """The sources' plan as a table again; a row a source."""
    schema = "k int, source string, docs long, source_size long, target double, passes long, rest double, more long, got long, last long"
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


def quotas(blocks: Sequence[int], shards: int, seed: int, spark, depth: int = 6) -> DataFrame:
    """(shard, k, blocks): the counts of each source's blocks in each shard, by the splitting tree.

    A node holds one count a source, and is split by one draw. A task splits a
    node down to depth levels below it; what it leaves are the next step's rows,
    dealt anew, so that a step runs on as many tasks as there are nodes and no
    task has more than one Python worker.
    """
    ship(spark)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for nodes in batches:
            rows, todo = [], [(lo, hi, np.asarray(counts, np.int64), depth) for lo, hi, counts in zip(nodes["lo"], nodes["hi"], nodes["counts"])]
            while todo:
                lo, hi, counts, more = todo.pop()
                if hi - lo < 2 or not more:
                    rows.append((lo, hi, counts))
                    continue
                mid, total = (lo + hi) // 2, int(counts.sum())
                share = total * (mid - lo) // (hi - lo)
                left, free, rest, rng = np.zeros_like(counts), share, total, np.random.default_rng([seed, lo, hi])
                for i, c in enumerate(counts.tolist()):
                    rest -= c
                    left[i] = got = int(rng.hypergeometric(c, rest, free)) if c and free else 0
                    free -= got
                todo += [(lo, mid, left, more - 1), (mid, hi, counts - left, more - 1)]
            yield pd.DataFrame(rows, columns=["lo", "hi", "counts"])

    schema = "lo long, hi long, counts array<long>"
    nodes = spark.createDataFrame([(0, shards, [int(b) for b in blocks])], schema).coalesce(1)
    for level in range(0, max(0, math.ceil(math.log2(shards))), depth):
        nodes = (nodes.repartition(1 << min(level, 12), "lo") if level else nodes).mapInPandas(split, schema)
    return nodes.select(F.col("lo").alias("shard"), F.posexplode("counts").alias("k", "blocks"))


def _mix(docs: DataFrame, seed: int = 7, weights: Sequence[float] = (5.0, 2.0, 1.0), most: float = 3.0, block: int = 64, shard_blocks: int = 32, text: str = "text", id: str = "doc_id") -> tuple[DataFrame, int]:
    """The draws, and the number of shards."""
    laid, draws = lay_out(docs, seed, weights, most, text=text, id=id)
    counts = {k: -(-n // block) for k, n in draws.items()}
    blocks = [counts.get(k, 0) for k in range(max(counts, default=-1) + 1)]
    shards = max(1, math.ceil(sum(blocks) / shard_blocks))
    spark = docs.sparkSession
    runs = quotas(blocks, shards, seed, spark).where("blocks > 0")
    upto = F.sum("blocks").over(Window.partitionBy("k").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    dealt = runs.withColumn("end", upto).select("k", "shard", F.explode(F.sequence(F.col("end") - F.col("blocks"), F.col("end") - 1)).alias("block"))
    drawn = laid.withColumn("draw", F.explode_outer(F.when(F.col("draws") > 0, F.sequence(F.lit(0), F.col("draws") - 1))))
    drawn = drawn.withColumn("block", F.floor((F.col("draw") * F.col("docs") + F.when(F.col("draw") < F.col("passes"), F.col("nth")).otherwise(F.col("one"))) / block))
    out = drawn.join(durable(dealt), ["k", "block"], "left")
    out = out.withColumn("place", F.when(F.col("shard").isNotNull(), F.xxhash64(F.lit(seed + 1), "shard", "k", "nth", "draw"))).drop("block", "passes", "docs", "one", "more", "last")
    return out, shards


def mix(docs: DataFrame, **options) -> DataFrame:
    """docs as often as they are drawn: with size, source_size, target, draws, draw (from 0), shard and place.

    A document that is not drawn comes once, with null draw, shard and place.
    block: documents in a block. shard_blocks: blocks in a shard, on average.
    """
    return _mix(docs, **options)[0]


def shuffled(docs: DataFrame, alone: int = 512, together: int = 16, **options) -> DataFrame:
    """The draws of a mix dealt out by shard, in each shard in their shuffled order, ready to be written.

    Up to alone shards, each is a partition; of more, together are dealt to one.
    options: those of mix.
    """
    mixed, shards = _mix(docs, **options)
    parts = min(shards, max(alone, math.ceil(shards / together)))
    return mixed.where("shard is not null").repartitionById(parts, (F.col("shard") % parts).cast("int")).sortWithinPartitions("shard", "place")
