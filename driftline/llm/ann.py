"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first.

fit() builds the tree on a bounded sample; Spark then drops every vector down to
its leaf. A query walks the tree with a priority queue of nodes ordered by their
distance and names the leaves it comes to, in that order. How many leaves are
visited is calibrated: some queries are compared with every vector, and the
visits are widened until the wanted recall is reached.

Nearness is the largest inner product. All vectors get one more component that
makes their norms equal, which turns it into the smallest distance for the tree;
scores come from the original vectors, in double precision.

Scale: queries and leaves meet in cells of bounded size. A leaf's vectors are
dealt to as many salted parts as its size needs, a leaf's queries to as many
chunks, and each cell of part and chunk keeps its own best, so no leaf, however
crowded, is one task. What goes to the executors whole is the tree, whose size
the sample bounds.

Edge cases: vectors null, zero, of another length than most or with null or
non-finite components take no part, neither as query nor as candidate. Equal
scores go by smaller id. Rows with the same id are rows of their own: each is a
candidate of all others, and each that is a query has its own k rows of result.
Fewer candidates than k: all of them are given. Empty tables give an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.session import durable, ship


def usable(vectors: DataFrame, id: str, vector: str, zero: bool = False) -> DataFrame:
    """(row, id, v array<double>) of the rows that can take part, all of one length; row tells rows of one id apart."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id).cast("long").alias("id"), v.alias("v")).where("v is not null and size(v) > 0 and id is not null")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    if not zero:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    widths = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    return rows.where(F.size("v") == (widths["w"] if widths else 0))


class Tree:
    """Nodes of the k-means tree: centres, children; leaves are numbered."""

    def __init__(self, sample: np.ndarray, branch: int, leaf: int, seed: int):
        self.centres, self.children, self.leaf_of = [sample.mean(axis=0)], [[]], {}
        rng, todo = np.random.default_rng(seed), [(0, sample)]
        while todo:
            node, rows = todo.pop()
            near = self._split(rows, branch, rng) if len(rows) > leaf else None
            if near is None:
                self.leaf_of[node] = len(self.leaf_of)
                continue
            for c in range(near.max() + 1):
                part = rows[near == c]
                if len(part):
                    self.centres.append(part.mean(axis=0))
                    self.children.append([])
                    self.children[node].append(len(self.centres) - 1)
                    todo.append((len(self.centres) - 1, part))
        self.centres = np.array(self.centres)

    @staticmethod
    def _split(rows: np.ndarray, branch: int, rng, rounds: int = 8) -> np.ndarray | None:
        distinct = np.unique(rows, axis=0)
        if len(distinct) < 2:
            return None
        centres = distinct[rng.choice(len(distinct), min(branch, len(distinct)), replace=False)]
        for _ in range(rounds):
            near = ((centres**2).sum(axis=1) - 2 * rows @ centres.T).argmin(axis=1)
            centres = np.array([rows[near == c].mean(axis=0) if (near == c).any() else centres[c] for c in range(len(centres))])
        return near if len(np.unique(near)) > 1 else None

    def descend(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out, todo = np.empty(len(rows), np.int64), [(0, np.arange(len(rows)))]
        while todo:
            node, which = todo.pop()
            kids = self.children[node]
            if not kids:
                out[which] = self.leaf_of[node]
                continue
            c = self.centres[kids]
            near = ((c**2).sum(axis=1) - 2 * rows[which] @ c.T).argmin(axis=1)
            for i, kid in enumerate(kids):
                if (near == i).any():
                    todo.append((kid, which[near == i]))
        return out

    def visit(self, row: np.ndarray, leaves: int, sizes: dict[int, int] | None = None, need: int = 0) -> list[int]:
        """The first leaves that a best-bin-first traversal comes to; more of them, until they hold need vectors by sizes."""
        out, queue, held = [], [(0.0, 0)], 0
        while queue and (len(out) < leaves or (sizes is not None and held < need)):
            _, node = heapq.heappop(queue)
            kids = self.children[node]
            if not kids:
                out.append(self.leaf_of[node])
                held += (sizes or {}).get(out[-1], 0)
                continue
            gaps = ((self.centres[kids] - row) ** 2).sum(axis=1)
            for gap, kid in zip(gaps.tolist(), kids):
                heapq.heappush(queue, (gap, kid))
        return out


def _lifted(rows: np.ndarray, norm: float) -> np.ndarray:
    """One more component, so that all rows have the same norm."""
    more = np.sqrt(np.maximum(0.0, norm**2 - (rows**2).sum(axis=1)))
    return np.column_stack([rows, more])


def best_of(q_rows: np.ndarray, q: np.ndarray, v_rows: np.ndarray, v_ids: np.ndarray, v: np.ndarray, k: int) -> list[tuple[int, int, int, float]]:
    """(query's row, row, id, score): each query's best rows of a block, its own row left out; ties to the smaller id."""
    rough = q @ v.T
    slack = 1e-9 * (1.0 + np.abs(rough).max(axis=1))
    rough[q_rows[:, None] == v_rows[None, :]] = -np.inf
    take = min(k, rough.shape[1])
    floor = np.partition(rough, rough.shape[1] - take, axis=1)[:, rough.shape[1] - take]
    out = []
    for i in range(len(q)):
        near = np.flatnonzero((rough[i] >= floor[i] - slack[i]) & (rough[i] > -np.inf))
        score = (v[near] * q[i]).sum(axis=1)
        order = np.lexsort((v_rows[near], v_ids[near], -score))[:k]
        out += [(int(q_rows[i]), int(v_rows[near[o]]), int(v_ids[near[o]]), float(score[o])) for o in order]
    return out


def _cells(left, right, k: int) -> pd.DataFrame:
    rows = []
    if len(left) and len(right):
        v_rows, v_ids, v = right["row"].to_numpy(), right["id"].to_numpy(), np.stack(right["v"].to_numpy())
        names = dict(zip(left["qrow"], left["qid"]))
        for at in range(0, len(left), 256):
            part = left.iloc[at : at + 256]
            rows += [(r, names[r], *x) for r, *x in best_of(part["qrow"].to_numpy(), np.stack(part["q"].to_numpy()), v_rows, v_ids, v, k)]
    return pd.DataFrame(rows, columns=["query_row", "query_id", "vec_row", "vec_id", "score"])


def _merge(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, over its cells."""
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "vec_row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


ANSWER = ("query_id", "rank", "vec_id", "score")
_FOUND = "query_row long, query_id long, vec_row long, vec_id long, score double"


def in_cells(queries: DataFrame, vectors: DataFrame, k: int, part_rows: int = 8192, chunk_rows: int = 1024) -> DataFrame:
    """The best of queries (qrow, qid, q, cell) among vectors (row, id, v, cell) of the same cell, in pieces of bounded size."""
    sizes = durable(vectors.groupBy("cell").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts")))
    asked = durable(queries.groupBy("cell").agg(F.ceil(F.count("*") / chunk_rows).cast("int").alias("chunks")))
    grid = durable(sizes.join(asked, "cell"))
    v = vectors.join(grid, "cell").withColumn("part", F.pmod(F.xxhash64("row", F.lit(1)), F.col("parts")).cast("int"))
    v = v.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("cell", "part", "chunk", "row", "id", "v")
    q = queries.join(grid, "cell").withColumn("chunk", F.pmod(F.xxhash64("qrow", F.lit(2)), F.col("chunks")).cast("int"))
    q = q.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("cell", "part", "chunk", "qrow", "qid", "q")
    keys = ["cell", "part", "chunk"]
    return q.groupBy(keys).cogroup(v.groupBy(keys)).applyInPandas(lambda a, b: _cells(a, b, k), _FOUND)


def search(vectors: DataFrame, every: int = 20, k: int = 20, id: str = "vec_id", vector: str = "embedding", sample: int = 8192, branch: int = 8, leaf: int = 64, recall: float = 0.97, calibrate: int = 256, seed: int = 11) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id is divisible by every.

    sample: rows the tree is fitted on, at most. calibrate: queries, at most,
    whose neighbours are also looked up in all vectors to choose the visits.
    recall: what the visits must reach on them.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = durable(usable(vectors, id, vector))
    stats = rows.agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("norm")).first()
    queries = rows.where(F.col("id") % every == 0).select(F.col("row").alias("qrow"), F.col("id").alias("qid"), F.col("v").alias("q"))
    if not stats["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    norm = stats["norm"]
    # The smallest keyed hashes: the same rows each time, spread over the whole table.
    picked = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id", "v").limit(sample).collect()
    tree = Tree(_lifted(np.array([r["v"] for r in picked], np.float64), norm), branch, leaf, seed)
    shared, leaves = spark.sparkContext.broadcast(tree), len(tree.leaf_of)

    def to_leaf(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                b["cell"] = shared.value.descend(_lifted(np.stack(b["v"].to_numpy()), norm))
                yield b

    def to_visits(most: int):
        def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                lifted = np.column_stack([np.stack(b["q"].to_numpy()), np.zeros(len(b))]) if len(b) else []
                seen = [shared.value.visit(x, most, sizes, k + 1) for x in lifted]
                b["cell"] = seen
                yield b.explode("cell").assign(cell=lambda d: d["cell"].astype("int64"))

        return visits

    placed = durable(rows.mapInPandas(to_leaf, "row long, id long, v array<double>, cell long"))
    sizes = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # one row a leaf
    some = durable(queries.orderBy(F.xxhash64("qid", F.lit(seed + 1)), "qid", "q").limit(calibrate))
    truth = _merge(in_cells(some.withColumn("cell", F.lit(0).cast("long")), rows.withColumn("cell", F.lit(0).cast("long")), k), k)
    where = truth.join(placed.select(F.col("row").alias("vec_row"), "cell"), "vec_row").select("query_row", "cell").collect()
    visits = _calibrated(tree, {r["qrow"]: np.append(np.array(r["q"]), 0.0) for r in some.collect()}, where, recall, leaves)
    asked = queries.mapInPandas(to_visits(visits), "qrow long, qid long, q array<double>, cell long")
    return _merge(in_cells(durable(asked), placed, k), k).select(*ANSWER)


def _calibrated(tree: Tree, queries: dict, where: list, recall: float, leaves: int) -> int:
    """The fewest leaf visits at which the true neighbours (query_row, cell) are met often enough, widened by a half at a time."""
    orders = {q: {leaf: i for i, leaf in enumerate(tree.visit(v, leaves))} for q, v in queries.items()}
    places = np.array([orders[r["query_row"]][r["cell"]] for r in where])
    visits = 1
    while visits < leaves and len(places) and (places < visits).mean() < recall:
        visits = min(leaves, visits + max(1, visits // 2))
    return visits
